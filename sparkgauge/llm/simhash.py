"""Near duplicates by 64-bit SimHash fingerprints: an inverted index of byte positions, count filtering, verification.

Two fingerprints that differ in at most four bits share at least four of their eight bytes, in place. So every such pair
meets in a posting of three positions' bytes, for a set of triples of which any four positions contain one (20 triples
for eight positions, by Turan's construction): 20 rows a fingerprint, and a posting of 24 bits. Within a posting the bytes
that a pair shares are tallied; pairs that reach the guaranteed four are verified by their differing bits. Equal
fingerprints are one node, whatever the number of their documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textvec
from .graph import components

WORDS, SEED, BITS = 4, 42, 4
POSITIONS = 8
#: Fingerprints of a block, and of a posting from which on midpoints are cheaper than comparing blocks with each other.
BLOCK, LARGE = 2_048, 32_768
#: Rows of a call of small postings.
CALL_ROWS = 4_096
SLICE = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def triples(n: int = POSITIONS) -> list[tuple[int, ...]]:
    """Sets of three of ``n`` positions so that any four positions contain one of them.

    Positions are in three groups: all triples within a group, and two of one group with one of the next.
    """
    group = [min(i * 3 // n, 2) for i in range(n)]

    def taken(t: tuple[int, ...]) -> bool:
        g = [group[i] for i in t]
        return len(set(g)) == 1 or any(g.count(k) == 2 and g.count((k + 1) % 3) == 1 for k in range(3))

    return [t for t in combinations(range(n), 3) if taken(t)]


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Each document's fingerprint: a bit is set where it is set in more than half of its shingles' XXH64 values.

    A-Z are lower-cased, words are runs of other than white space, shingles are ``words`` words joined by one space (a
    document of fewer words has one of all of them, one without words has none and the fingerprint 0). Repeats count.
    """
    data = _LOWER[data]
    starts, ends, doc = textvec.runs(data, offsets, textvec.WORDS)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # one space between words: of the white space after a word its first byte stays
    word = textvec.WORDS[data] > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.cumsum(keep) - 1
    packed = data[keep]
    packed[~word[keep]] = 0x20
    starts, ends = at[starts], at[ends - 1] + 1
    n = np.bincount(doc, minlength=len(out))
    first = np.cumsum(n) - n
    shingles = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    last = np.repeat(first + n - 1, shingles)
    begin = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    low, high = starts[begin], ends[np.minimum(begin + words - 1, last)]
    text = memoryview(packed.tobytes())
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.uint64, len(low))
    there = np.flatnonzero(shingles)
    bounds = np.append(np.cumsum(shingles) - shingles, len(h))
    for a in range(0, len(there), 256):  # few documents at a time: 64 bytes a shingle
        part = there[a : a + 256]
        x = h[bounds[part[0]] : bounds[part[-1] + 1]]
        set_ = np.zeros((len(part), 64), np.int64)
        edges = np.unique(np.append(np.arange(0, len(x), 1 << 16), bounds[part] - bounds[part[0]]))
        owner = np.searchsorted(bounds[part] - bounds[part[0]], edges, "right") - 1
        for lo, hi, k in zip(edges, np.append(edges[1:], len(x)), owner, strict=True):
            bits = np.unpackbits(x[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_[k] += bits.sum(0, dtype=np.int64)
        over = set_ * 2 > shingles[part][:, None]
        out[part] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _signed(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textvec.slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(fingerprints(data, offsets, words, seed).view(np.int64))], names=["_key", "fp"])

    return run


def _posting(fp: Column, number: int, triple: tuple[int, ...]) -> Column:
    """The bytes of three positions, and the triple's number above them."""
    parts = [F.shiftleft(F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255)), 8 * k) for k, p in enumerate(triple)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(F.lit(number << 24)).cast("int")


def near_pairs(left: np.ndarray, right: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which fingerprints of ``left`` and ``right`` differ in at most ``bits`` bits.

    Bytes shared in place are tallied for every pair; only pairs with the guaranteed minimum are verified.
    """
    a, b = left.view(np.uint8).reshape(-1, POSITIONS), right.view(np.uint8).reshape(-1, POSITIONS)
    shared = np.zeros((len(left), len(right)), np.uint8)
    for p in range(POSITIONS):
        shared += a[:, p, None] == b[None, :, p]
    i, j = np.nonzero(shared >= POSITIONS - bits)
    linked = np.zeros(shared.shape, bool)
    ok = np.bitwise_count(left[i] ^ right[j]) <= bits
    linked[i[ok], j[ok]] = True
    return linked


def _edges(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within ``left`` (or between it and ``right``): from one node of each connected
    set to its others, so no more than there are fingerprints. Rows are compared as the search reaches them."""
    nodes = left if right is None else np.concatenate([left, right])
    side = np.zeros(len(nodes), bool)
    side[len(left) :] = True
    open_, a, b = np.ones(len(nodes), bool), [], []
    for root in range(len(left)):
        if not open_[root]:
            continue
        new, reached = np.array([root]), []
        open_[root] = False
        while len(new):
            found = np.zeros(len(nodes), bool)
            for k in range(0, len(new), 256):
                for of in (False, True) if right is not None else (False,):
                    mine = new[k : k + 256][side[new[k : k + 256]] == of]
                    rest = np.flatnonzero(open_ & ~found & (side != of if right is not None else True))
                    if len(mine) and len(rest):
                        found[rest[near_pairs(nodes[mine], nodes[rest], bits).any(0)]] = True
            new = np.flatnonzero(found)
            open_[new] = False
            reached.append(new)
        others = nodes[np.concatenate(reached)]
        a.append(np.full(len(others), nodes[root]))
        b.append(others)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _stars(bits: int):
    def run(table: pa.Table) -> pa.Table:
        posting, i, j, block, fp = (table.column(c).to_numpy() for c in ("posting", "i", "j", "block", "fp"))
        order = np.lexsort((fp, block, j, i, posting))
        posting, i, j, block, fp = (x[order] for x in (posting, i, j, block, fp))
        new = np.ones(len(fp), bool)
        new[1:] = (posting[1:] != posting[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cuts = np.append(np.flatnonzero(new), len(fp))
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            x, mid = fp[lo:hi].view(np.uint64), int(np.searchsorted(block[lo:hi], i[lo], "right"))
            same = i[lo] == j[lo]
            if hi - lo > 1 and (same or 0 < mid < hi - lo):
                one, two = _edges(x if same else x[:mid], None if same else x[mid:], bits)
                a.append(one)
                b.append(two)
        return pa.table({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return run


def _midpoints(bits: int):
    """(posting, fp, mid): each fingerprint and all values within half of ``bits`` of it that keep its posting's bytes."""
    cover = triples()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, np.ndarray] = {}
        for batch in batches:
            posting, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for t in np.unique(posting >> 24).tolist():
                if t not in masks:
                    free = [8 * p + k for p in range(POSITIONS) if p not in cover[t] for k in range(8)]
                    masks[t] = np.array([sum(1 << x for x in c) for r in range(bits // 2 + 1) for c in combinations(free, r)], np.uint64)
                rows = np.flatnonzero(posting >> 24 == t)
                for k in range(0, len(rows), 512):
                    part = rows[k : k + 512]
                    mids = fp[part][:, None] ^ masks[t][None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(posting[part], len(masks[t]))), pa.array(np.repeat(fp[part], len(masks[t])).view(np.int64)), pa.array(mids.ravel().view(np.int64))], names=["posting", "fp", "mid"])

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK, large: int = LARGE) -> DataFrame:
    """(a, b): edges between the distinct fingerprints ``fps`` (fp: long) that connect all within ``bits`` bits of each
    other: at most 4, an even number. A posting of up to ``block`` is compared at once, one of up to ``large`` in pairs
    of blocks. Beyond that its fingerprints meet at midpoints: two are within 4 bits of each other just if some value is
    within 2 of both, so rows stay linear in their number; the values keep the posting's bytes."""
    if bits % 2 or not 0 < bits <= POSITIONS - 4:
        raise ValueError("bits must be 2 or 4: the postings cover pairs that share four of eight bytes")
    postings = fps.select("fp", F.explode(F.array(*(_posting(F.col("fp"), k, t) for k, t in enumerate(triples())))).alias("posting"))
    counts = common.materialize(postings.groupBy("posting").agg(F.count("*").alias("_rows")).where("_rows > 1"), "simhash-postings")
    rows = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    shared = common.materialize(common.salted_join(postings, counts.withColumn("n", F.col("_rows")).drop("_rows"), "posting", counts, "fp"), "simhash-shared")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = shared.where(F.col("n") <= large).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    # small postings share calls, a pair of blocks of a larger one is a call of its own
    call = F.when(F.col("blocks") > 1, F.xxhash64("posting", "i", "j")).otherwise(F.pmod(F.xxhash64("posting"), F.lit(rows // CALL_ROWS + 1)))
    found = placed.select("posting", "i", "j", "block", "fp", call.alias("call")).groupBy("call").applyInArrow(_stars(bits), "a long, b long")
    mids = shared.where(F.col("n") > large).select("posting", "fp").mapInArrow(_midpoints(bits), "posting int, fp long, mid long")
    least = mids.groupBy("posting", "mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = mids.join(least, ["posting", "mid"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return common.materialize(found.unionByName(met).distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hexadecimal digits), component_id and group_size.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; component_id is the smallest key reached by
    links, group_size the number of rows in its group. Null and empty texts, and those of white space, have the
    fingerprint 0 and are linked like any other, so do repeated rows. Null keys are smaller than none: they are
    component_id only where all keys of a group are null. Bytes that aren't UTF-8 are hashed as they are. An empty table
    gives an empty result; only key and text are read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    signed = common.materialize(rows.mapInArrow(common.lean(_signed(words, seed)), common.schema(rows, "_text", "fp long")), "simhash-signed")
    classes = common.materialize(signed.groupBy("fp").agg(F.min("_key").alias("least"), F.count("*").alias("_rows")), "simhash-classes")
    groups = components(links(classes.select("fp"), bits))
    placed = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    placed = common.materialize(placed, "simhash-groups")
    of = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("_rows").alias("group_size"), F.count("*").alias("_n"))
    of = common.materialize(of, "simhash-heads")
    named = common.salted_join(placed.select("fp", "component", F.col("_rows").alias("rows")), of.drop("_n"), "component", of.select("component", F.col("_n").alias("_rows")), "fp")
    named = common.materialize(named.drop("component"), "simhash-named")
    out = common.salted_join(signed.withColumn("_at", F.monotonically_increasing_id()), named.drop("rows"), "fp", named.select("fp", F.col("rows").alias("_rows")), "_at")
    return out.select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")
