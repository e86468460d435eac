"""Toxicity by noisy-channel deobfuscation.

A character language model (4-grams with back-off) is counted over the whole corpus. Tokens that look disguised become
lattices: a sign or digit may stand for any of its letters, for itself, for a word border or for nothing, and a repeated
letter may be one; letters that stand apart are one lattice with a border possible after each. Viterbi decoding finds
the reading that the language model likes best. The text with these readings in place is the restored text; its words
are what is learned from and scored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

#: The letters that a sign or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Labelled rows that words are learned from, words kept, and n-grams of the character model, at most.
TRAIN_ROWS, LEXICON, GRAMS = 20_000, 20_000, 1 << 18
#: Costs (in nats) of reading a sign as a letter, keeping a digit, dropping a digit, and dropping a sign that could be a
#: letter or reading it as a border; of dropping any other sign or reading it as a border; of dropping a sign that is
#: there again; of reading a letter twice as once, and any further ones.
AS_LETTER, KEEP_DIGIT, DROP_DIGIT, DROP_LETTER, LETTER_BORDER, DROP_OTHER, OTHER_BORDER, DROP_AGAIN, DROP_SECOND, DROP_MORE = 0.7, 2.5, 9.0, 3.0, 2.5, 0.5, 0.3, 0.1, 3.0, 0.2
#: Strength of the lower order in an order's estimate, as a count.
BACK_OFF = 4.0
REMEMBERED = 200_000
#: Nats of surprise from which a feature counts in full.
SURPRISE = 12.0
#: Lengths of word beginnings that are features besides the word.
PREFIXES = (4, 5, 6)
SLICE = 1 << 19

#: Bytes as the model knows them: small letters, one digit, all bytes beyond ASCII; any other sign is a border (a space).
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x30:0x3A] = 0x30
FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD = FOLD.tolist()
START = 0x202020

#: Marks that may stand around a word without meaning anything.
_MARKS = ".,;:?\"'`)[]{}<>«»„“”‘’…-_*~#^&%/\\="
_END = "!" + _MARKS
_TWICE = re.compile(r"(.)\1")
#: Three or more single characters, each perhaps with a mark after it, apart from each other and from anything else.
_APART = re.compile(r"(?<!\S)[^\s|][.,:;_*\-]?(?:\s+[^\s|][.,:;_*\-]?){2,}(?!\S)")
_NEAR = re.compile(r"\s[^\s|][.,:;_*\-]?\s+[^\s|][.,:;_*\-]?\s")
#: A sign three times or more at the end of a token is decoration, not letters.
_DECORATED = re.compile(r"([^\w\s])\1{2,}\Z")
_TOKEN = re.compile(r"\S+")
_FIRST = itemgetter(0)


def folded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents' bytes in the model's alphabet: borders are single, and three stand around every document."""
    data, doc = FOLD[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(data):
        before = np.append(np.uint8(0x20), data[:-1])
        first = offsets[:-1][np.diff(offsets) > 0]
        before[first] = 0x20
        data = np.where((before == 0xC3) & (data >= 0x80) & (data <= 0x9E), data + 0x20, data).astype(np.uint8)  # À to Þ
        keep = (data != 0x20) | (before != 0x20)
        data, doc = data[keep], doc[keep]
    return np.insert(data, np.repeat(np.append(np.searchsorted(doc, np.arange(len(offsets) - 1)), len(data)), 3), 0x20)


def grams(data: np.ndarray) -> np.ndarray:
    """Each place's byte and the three before it, as one number."""
    d = data.astype(np.uint32)
    return d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    whole = lambda: _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    for batch in batches:
        for _, _, data, offsets in textvec.slices(batch.column(0), SLICE):
            parts.append(np.unique(grams(folded(data, offsets)), return_counts=True))
            if len(parts) == 16:
                parts = [whole()]
    if parts:
        keys, counts = whole()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "n"])


class CharModel:
    """Log probabilities of a byte after three others, from the counts of 4-grams (sorted numbers, counts)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        self.tables: list | None = None
        self.memo: dict[int, float] = {}

    def __getstate__(self):
        return {"keys": self.keys, "counts": self.counts, "tables": None, "memo": {}}

    def _open(self) -> None:
        """Of each order's n-grams: numbers and counts, and those of what precedes their last byte."""
        self.tables = []
        keys, counts = self.keys.astype(np.int64), self.counts
        for order in (4, 3, 2, 1):
            keys, counts = _summed(keys & ((1 << 8 * order) - 1), counts)
            self.tables.append((array("q", keys.tolist()), array("q", counts.tolist()), *(array("q", x.tolist()) for x in _summed(keys >> 8, counts))))

    @staticmethod
    def _at(keys: array, counts: array, key: int) -> int:
        i = bisect_left(keys, key)
        return counts[i] if i < len(keys) and keys[i] == key else 0

    def _probability(self, key: int, order: int) -> float:
        if order == 0:
            return 1 / 256
        gram = key & ((1 << 8 * order) - 1)
        keys, counts, before, totals = self.tables[4 - order]
        total = self._at(before, totals, gram >> 8)
        lower = self._probability(key, order - 1)
        return (self._at(keys, counts, gram) + BACK_OFF * lower) / (total + BACK_OFF) if total else lower

    def cost(self, state: int, byte: int) -> float:
        """Minus the log probability of a byte after the three in ``state``."""
        key = state << 8 | byte
        got = self.memo.get(key)
        if got is None:
            if self.tables is None:
                self._open()
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            got = self.memo[key] = -log(self._probability(key, 4))
        return got

    def step(self, state: int, letter: str) -> tuple[int, float]:
        """The state after a letter and the letter's cost; a border after a border is none."""
        if letter < "\x80":
            byte = _FOLD[ord(letter)]
            if byte == 0x20 == state & 0xFF:
                return state, 0.0
            return (state << 8 | byte) & 0xFFFFFF, self.cost(state, byte)
        total = 0.0
        for byte in letter.encode("utf-8", "replace"):
            total += self.cost(state, byte)
            state = (state << 8 | byte) & 0xFFFFFF
        return state, total


def char_model(docs: DataFrame, text: str = "text", most: int = GRAMS) -> CharModel:
    """The model of all texts of ``docs``: every 4-gram of every text is counted; the model keeps the ``most`` commonest."""
    counts = docs.select(F.col(text)).mapInArrow(common.lean(_counted), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "gram").limit(most).toArrow()
    keys, n = rows.column("gram").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    return CharModel(keys[order], n[order])


#: A place of a lattice: its readings and their costs; "" drops it, " " is a border.
Cell = list[tuple[str, float]]


def lattice(token: str) -> list[Cell]:
    """For each character of a token in small letters, all that it may stand for."""
    cells: list[Cell] = []
    last, times = "", 0
    for c in token:
        times = times + 1 if c == last else 1
        if c.isalpha():
            cells.append([(c, 0.0)] if times == 1 else [(c, 0.0), ("", DROP_SECOND if times == 2 else DROP_MORE)])
        else:
            reads = [(letter, AS_LETTER) for letter in LEET.get(c, "")]
            if c.isdigit():
                cells.append([*reads, (c, KEEP_DIGIT), ("", DROP_DIGIT if times == 1 else DROP_AGAIN + DROP_LETTER)])
            elif reads:
                cells.append([*reads, (" ", LETTER_BORDER), ("", DROP_LETTER if times == 1 else DROP_AGAIN)])
            else:
                cells.append([(" ", OTHER_BORDER), ("", DROP_OTHER if times == 1 else DROP_AGAIN)])
        last = c
    return cells


def apart(run: str) -> list[Cell]:
    """The lattice of letters that stand apart: a border may follow each."""
    cells: list[Cell] = []
    for piece in run.lower().split():
        if cells:
            cells.append([("", 0.0), (" ", 0.0)])
        cells += lattice(piece[0])
    return cells


def decode(cells: list[Cell], model: CharModel) -> str:
    """The cheapest path: costs of readings and of the model. A state is the last three bytes that were read."""
    states: dict[int, tuple[float, tuple | None]] = {START: (0.0, None)}
    step = model.step
    for reads in cells:
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (value, path) in states.items():
            for letter, cost in reads:
                if letter:
                    after, more = step(state, letter)
                    total = value + cost + more
                else:
                    after, total = state, value + cost
                have = new.get(after)
                if have is None or total < have[0]:
                    new[after] = (total, (path, letter) if letter else path)
        states = new
    path = min(((value + (step(state, " ")[1]), path) for state, (value, path) in states.items()), key=_FIRST)[1]
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return " ".join("".join(reversed(letters)).split())


def surprising(word: str, model: CharModel) -> bool:
    """Whether a plain word has a letter three times in a row, or twice where the model wouldn't expect it."""
    for found in _TWICE.finditer(word):
        at = found.end() - 1
        if word[at + 1 : at + 2] == word[at]:
            return True
        state = START
        for c in word[max(0, at - 3) : at] if at > 2 else " " + word[:at]:
            for byte in c.encode("utf-8", "replace"):
                state = (state << 8 | (_FOLD[byte])) & 0xFFFFFF
        if model.step(state, word[at])[1] > DROP_SECOND:
            return True
    return False


def restored_token(token: str, model: CharModel) -> str:
    """A token in small letters without the marks around it, decoded if it looks disguised.

    Plain words without a surprising letter twice in a row, numbers, and signs alone but for two kinds that may be
    letters, are as they are.
    """
    low = token.lower()
    plain = low.strip(_MARKS)
    if plain.isalpha():
        return decode(lattice(plain), model) if _TWICE.search(plain) and surprising(plain, model) else plain
    plain = _DECORATED.sub("", plain).rstrip(_END)
    if plain.isalpha():
        return decode(lattice(plain), model) if _TWICE.search(plain) and surprising(plain, model) else plain
    inner = _DECORATED.sub("", low.strip(_MARKS))
    if any(map(str.isalpha, inner)) or (not any(map(str.isdigit, inner)) and len({c for c in inner if c in LEET}) > 1):
        return decode(lattice(inner), model)
    return plain


class Restorer:
    """Texts to restored words, remembering what a bounded number of distinct tokens read as."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, str] = {}
        self.runs: dict[str, str] = {}

    def token(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            got = self.known[token] = restored_token(token, self.model)
        return got

    def _run(self, found: re.Match) -> str:
        run = found.group()
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        if run not in self.runs:
            self.runs[run] = decode(apart(run), self.model)
        return self.runs[run]

    def joined(self, text: str) -> str:
        """The text with letters that stand apart put together."""
        return _APART.sub(self._run, text) if _NEAR.search(f" {text} ") else text

    def text(self, text: str) -> str:
        """The restored text: white space stays, tokens are replaced."""
        self.bound()
        return _TOKEN.sub(lambda m: self.token(m.group()), self.joined(text))

    def bound(self) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()


def features(restored: str) -> Iterator[str]:
    for w in restored.split():
        yield w
        for n in PREFIXES:
            if len(w) > n:
                yield f"{w[:n]}~"


def _in_texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    column = batch.column(batch.schema.names.index("_text"))
    for a, b, _, _ in textvec.slices(column, SLICE):
        yield a, textvec.strings(column.slice(a, b - a))


def _by_label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            labels, check = (batch.column(batch.schema.names.index(n)).to_pylist() for n in ("label", "check"))
            counts: dict[str, list[int]] = {}
            for a, texts in _in_texts(batch):
                restorer.bound()
                for i, text in enumerate(texts):
                    for f in {f for t in set(restorer.joined(text).split()) for f in features(restorer.token(t))}:
                        c = counts.setdefault(f, [0, 0, 0, 0])
                        c[2 + labels[a + i]] += 1
                        c[labels[a + i]] += not check[a + i]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4))], ["feature", "clean", "toxic", "clean_all", "toxic_all"])

    return run


@dataclass
class Model:
    """The character model, the words' weights (at most LEXICON) and the final logistic curve."""

    chars: CharModel
    weights: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def starts(self) -> set[str]:
        """The first letters of all features: a word that begins otherwise has no weight."""
        return {f[: PREFIXES[0]] for f in self.weights}

    def weigh(self, restored: str, starts: set[str]) -> tuple[tuple[str, float], ...]:
        """The words of a restored token that have a weight, and their weights."""
        w, first = self.weights, PREFIXES[0]
        if " " not in restored and restored[:first] not in starts:
            return ()
        each = ((word, max(w.get(f, 0.0) for f in features(word))) for word in restored.split())
        return tuple((word, v) for word, v in each if v)

    def measure(self, restorer: Restorer, texts: list[str]) -> np.ndarray:
        """(texts, 2): the largest weight among a restored text's distinct words, and log(1 + the sum of the others)."""
        out = np.zeros((len(texts), 2))
        seen = getattr(restorer, "weighed", None)
        if seen is None or len(seen) > REMEMBERED:
            seen = restorer.weighed = {}
        starts, chars = self.starts(), restorer.model
        for i, text in enumerate(texts):
            hits: dict[str, float] = {}
            for t in set(restorer.joined(text).split()):
                found = seen.get(t)
                if found is None:
                    found = seen[t] = self.weigh(restored_token(t, chars), starts)
                if found:
                    hits.update(found)
            if hits:
                top = max(hits.values())
                out[i] = top, np.log1p(sum(sorted(hits.values())) - top)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + x @ np.array([b, c]), -30, 30)))


def _measured(model, curve: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value
        restorer = Restorer(value.chars)
        for batch in batches:
            others = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            for a, texts in _in_texts(batch):
                x = value.measure(restorer, texts)
                got = [pa.array(value.scores(x))] if curve else [pa.array(x[:, 0]), pa.array(x[:, 1])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, len(texts)) for i in others), *got], names=[*(batch.schema.names[i] for i in others), *(["score"] if curve else ["top", "rest"])])

    return run


def _rewritten(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            others = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
            for a, texts in _in_texts(batch):
                got = pa.array([restorer.text(t) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, len(texts)) for i in others), got], names=[*(batch.schema.names[i] for i in others), "restored"])

    return run


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A logistic fit by Newton's method with a small ridge; slopes are kept from turning negative."""
    z = np.concatenate([np.ones((len(y), 1)), x], 1)
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def _weights(counts: DataFrame, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Log odds of the features that toxic texts have more often than chance explains; little support shrinks them.

    ``surprise`` bounds the log probability that so many of a feature's texts are toxic by chance.
    """
    base = (n_toxic + 1.0) / (n_clean + n_toxic + 2.0)
    share = (F.col("toxic") + 0.0) / (F.col("toxic") + F.col("clean"))
    surprise = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))
    best = (
        counts.where("toxic >= 2").where((share > base) & (odds > 1.5) & (surprise > SURPRISE / 2))
        .select("feature", (odds * F.pow(F.least(F.lit(1.0), surprise / SURPRISE), F.lit(2.0))).alias("weight"))
        .orderBy(F.desc("weight"), "feature").limit(LEXICON)
    )
    return {r["feature"]: r["weight"] for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """The character model over all of ``docs``; the curve on a third of at most ``rows`` labelled documents outside the
    held-out share, by words' weights from the other two thirds; then the words' weights from all of these documents.

    Of rows that share a doc_id one text, the smallest, is learned from.
    """
    spark = docs.sparkSession
    model = Model(char_model(docs, text))
    sample = common.labelled_ids(labels, label, modulus, held_out, rows)
    chosen = common.materialize(
        common.sample_texts(docs, sample, text).select((F.xxhash64("doc_id", F.lit(29)) % 3 == 0).alias("check"), F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "_text"), "toxicity-sample"
    )
    sizes = {(r["check"], r["label"]): r["count"] for r in chosen.groupBy("check", "label").count().collect()}
    shared = spark.sparkContext.broadcast(model.chars)
    counts = common.materialize(
        chosen.mapInArrow(common.lean(_by_label(shared)), "feature string, clean long, toxic long, clean_all long, toxic_all long")
        .groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("clean", "toxic", "clean_all", "toxic_all"))).where("toxic_all >= 2"),
        "toxicity-features",
    )
    learnt = [sizes.get((False, k), 0) for k in (0, 1)]
    whole = [n + sizes.get((True, k), 0) for k, n in enumerate(learnt)]
    model.weights = _weights(counts.select("feature", "clean", "toxic"), *learnt)
    held = chosen.where("check").select("label", "_text").mapInArrow(common.lean(_measured(spark.sparkContext.broadcast(model), False)), "label int, top double, rest double").toArrow()
    y = held.column("label").to_numpy()
    if len(y) and y.min() < y.max():
        x = np.stack([held.column("top").to_numpy(), held.column("rest").to_numpy()], 1)
        order = np.lexsort((x[:, 1], x[:, 0], y))
        model.curve = _curve(x[order], y[order].astype(float))
    model.weights = _weights(counts.select("feature", F.col("clean_all").alias("clean"), F.col("toxic_all").alias("toxic")), *whole)
    return model


def restore(docs: DataFrame, chars: CharModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and restored (the deobfuscated text; null gives an empty one) of each row of ``docs``."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(common.lean(_rewritten(docs.sparkSession.sparkContext.broadcast(chars))), common.schema(rows, "_text", "restored string"))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score (0 to 1) of each row of ``docs``: that of its restored text, whose words are made on the way.

    Null and empty texts have no words and so the lowest score.
    """
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(common.lean(_measured(docs.sparkSession.sparkContext.broadcast(model), True)), common.schema(rows, "_text", "score double"))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score and predicted (1 where the score is at least ``threshold``) of every row of ``docs``.

    Labels are only read for training. Repeated rows come back as often as they are there; without labels nothing is
    predicted toxic. Only ``doc_id``, ``keep`` and the text are read of ``docs``, so other columns can't clash.
    """
    return score(docs, train(docs, labels), keep=keep).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
