"""URL rules by a bit-parallel wildcard automaton.

Each rule is compiled to glob patterns over the canonical URL (host, then path). All patterns' positions are laid out
in the bits of a few 64-bit words; one step per byte (shift, mask by the byte's class, keep the bits of wildcards)
advances every pattern at once, for a whole batch of URLs at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textvec

#: Between host and path, so that a host wildcard can't run into the path. It can't occur in either: hosts end before it.
CUT = "/"
#: URLs of a step.
ROWS = 4096


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for URLs whose host is ``host`` or a subdomain of it and whose path starts with ``path``.

    In ``path`` a ``*`` stands for any characters, in ``host`` for any but ``/``.
    """

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def canonical(url: Column | str) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and path (then up to ``?``, ``#`` or the end).

    Both are empty where the URL is null or has no ``://``.
    """
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Automaton:
    """Shift-And over all rules' globs: ``step[byte]`` and ``loop[byte]`` are masks of ``words`` 64-bit words."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        cells: list[tuple[int | None, bool | None]] = []  # of each bit: the byte that enters it; whether it loops: None, in hosts (False), anywhere (True)
        starts, self.ends, self.owner = [], [], []
        for k, rule in enumerate(self.rules):
            for glob in (rule.text, f"*.{rule.text}"):
                starts.append(len(cells))
                cells.append((None, None))  # the state before the first byte
                host = True
                for byte in glob.encode():
                    if byte == 0x2A:
                        # a wildcard loops on the bit that stands before what follows
                        cells[-1] = (cells[-1][0], (not host) or (cells[-1][1] or False))
                    else:
                        host = host and byte != 0x2F
                        cells.append((byte, None))
                self.ends.append(len(cells) - 1)
                self.owner.append(k)
        self.words = max(1, -(-len(cells) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        bit = lambda i: (i // 64, np.uint64(1 << (i % 64)))
        for i, (byte, loops) in enumerate(cells):
            w, b = bit(i)
            if byte is not None:
                self.step[byte, w] |= b
            if loops is not None:
                self.loop[:, w] |= b
                if not loops:
                    self.loop[0x2F, w] &= ~b
        for i in starts:
            w, b = bit(i)
            self.start[w] |= b
        self.final = [bit(i) for i in self.ends]
        final = np.zeros(self.words, np.uint64)
        for w, b in self.final:
            final[w] |= b
        self.keep = final  # a rule that has matched stays so: what follows its path doesn't matter
        # among rules that match, the longest; of equally long ones the first
        self.order = sorted(range(len(self.final)), key=lambda j: (len(self.rules[self.owner[j]].text), -self.owner[j]))

    def best(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The index of the winning rule of each URL, or -1."""
        lengths = np.diff(offsets)
        by = np.argsort(-lengths, kind="stable")
        sizes, at = lengths[by], offsets[:-1][by]
        state = np.repeat(self.start[None], len(lengths), 0)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -t, "left"))  # URLs longer than t come first
            d = state[:n]
            c = data[at[:n] + t]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:n] = moved & self.step[c] | d & self.loop[c] | d & self.keep
        found = np.full(len(lengths), -1, np.int64)
        for j in self.order:
            w, b = self.final[j]
            found[by[(state[:, w] & b) != 0]] = self.owner[j]
        return found


def _judged(rules: tuple[Rule, ...], default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        texts = pa.array([r.text for r in rules] or [None], pa.string())
        actions = pa.array([*(r.action for r in rules), default], pa.string())
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, data, offsets in textvec.slices(batch.column(batch.schema.names.index("_url"))):
                for a in range(0, len(offsets) - 1, ROWS):
                    part = offsets[a : a + ROWS + 1]
                    found.append(automaton.best(data[part[0] : part[-1]], part - part[0]))
            best = np.concatenate(found)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "_url"]
            rule = texts.take(pa.array(np.maximum(best, 0), mask=best < 0))
            verdict = actions.take(pa.array(np.where(best < 0, len(rules), best)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), rule, verdict], names=[*(batch.schema.names[i] for i in kept), "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule (the winning rule's host and path; null if none fits) and verdict of each row of ``pages``.

    The longest fitting rule wins, of equally long ones the first given. A null URL, or one without ``://``, has an
    empty host and path, and ``default``. Rows are never merged; only ``keep`` and the URL are read. The rules are
    shipped with the code, so they should be a list that a driver holds (thousands).
    """
    host, path = canonical(url)
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_url", F.concat("host", "path"))
    return rows.mapInArrow(common.lean(_judged(tuple(rules), default)), common.schema(rows, "_url", "rule string, verdict string"))
