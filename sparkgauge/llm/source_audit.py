"""How far the sources of a language differ in their words: joint count histograms.

Each source's counts of the kept terms are smoothed to shares. A pair of sources is a histogram of its distinct (count,
count) combinations: what both have is tallied term by term in blocks, and the cells with a zero follow from the pair's
own histograms of counts, without a row for any term that a source lacks. The difference is evaluated once a combination.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, textvec

LEAST_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Cells (source, term) of a block, and pairs of cells that a task holds at a time.
BLOCK, PAIRS = 8_192, 1 << 20
SLICE = 4 << 20
#: Bytes of terms: letters of ASCII, and all bytes of other characters.
LETTERS = np.zeros(256, np.uint8)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, each occurrence's term, its document)."""
    starts, ends, doc = textvec.runs(data, offsets, LETTERS)
    packed = _LOWER[data[LETTERS[data] > 0]]
    strings = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, np.cumsum(ends - starts)).astype(np.int32)), pa.py_buffer(packed))
    coded = strings.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), doc


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> lang, source, term, occurrences and documents, summed over some rows."""
    for batch in batches:
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        group = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
        for a, b, data, offsets in textvec.slices(batch.column(2), SLICE):
            terms, code, doc = _terms(data, offsets)
            if not len(code):
                continue
            n_terms = len(terms)
            once, times = np.unique(doc * n_terms + code, return_counts=True)
            key, place = np.unique(group[a:b][once // n_terms] * n_terms + once % n_terms, return_inverse=True)
            n = np.bincount(place, times, len(key)).astype(np.int64)
            of = pa.array(key // n_terms // len(sources.dictionary)), pa.array(key // n_terms % len(sources.dictionary))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(of[0]), sources.dictionary.take(of[1]), terms.take(pa.array(key % n_terms)), pa.array(n), pa.array(np.bincount(place, minlength=len(key)))], names=["lang", "source", "term", "n", "docs"])


def _joint(table: pa.Table) -> pa.Table:
    """term, g, n of a block -> a, b, x, y, m: of how many terms source a has x and source b (a < b) has y, both not 0."""
    g, n = table.column("g").to_numpy(), table.column("n").to_numpy()
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((g, term))
    g, n, term = g[order], n[order], term[order]
    kinds, kind = np.unique(np.stack([g, n]), axis=1, return_inverse=True)
    kind = kind.ravel().astype(np.int64)
    after = np.searchsorted(term, term, "right") - np.arange(len(term)) - 1
    upto, key, m = np.cumsum(after), [], []
    lo = 0
    while lo < len(term):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - after[lo] + PAIRS, "right")))
        left = np.repeat(np.arange(lo, hi), after[lo:hi])
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[lo:hi] - after[lo:hi] - (upto[lo] - after[lo]), after[lo:hi])
        found, times = np.unique(kind[left] * kinds.shape[1] + kind[right], return_counts=True)
        key.append(found)
        m.append(times)
        lo = hi
    key, m = np.concatenate(key), np.concatenate(m)
    one, two = kinds[:, key // kinds.shape[1]], kinds[:, key % kinds.shape[1]]
    return pa.table({"a": one[0], "b": two[0], "x": one[1], "y": two[1], "m": m})


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exactly; counts of up to 20 digits."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", above, (total + SMOOTHING * kept).cast("decimal(20,0)"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of every group (lang, source) of ``docs``.

    Part 'pair' has every other source of the language with the summed difference of all kept terms' shares, part 'term'
    the ``top`` terms whose share is most above the language's. A language keeps terms of at least ``least_docs`` of its
    rows; repeated rows count each. Null text, lang and source are ''. A group without terms has pairs as others have; a
    language that keeps no term has pairs of value 0 and no terms; a language's only source has no pairs. An empty table
    gives an empty result. Ties are ranked by item. Only the three columns are read.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"))
    counts = rows.mapInArrow(common.lean(_counted), "lang string, source string, term string, n long, docs long")
    counts = common.materialize(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "audit-counts")
    numbered = common.materialize(rows.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "audit-sources")
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).drop("_docs")
    kept = common.materialize(counts.drop("docs").join(vocabulary, ["lang", "term"]).join(numbered, ["lang", "source"]).drop("source"), "audit-kept")
    # distinct terms of a language, each counted at the first of its sources
    of_lang = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("n"), F.count("*").alias("cells")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"), F.sum("cells").alias("cells"))
    of_source = kept.groupBy("g").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = numbered.join(of_source, "g", "left").join(of_lang, "lang", "left").fillna(0, ["total", "own", "v", "lang_total", "cells"])
    groups = common.materialize(groups, "audit-groups")
    return _pairs(kept, groups).unionByName(_own_terms(kept, groups, top))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    blocks = groups.groupBy("lang").agg(F.first("cells").alias("cells")).select("lang", F.ceil((F.col("cells") + 1) / BLOCK).alias("blocks"))
    cells = kept.select("lang", "term", "g", "n").join(blocks, "lang")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks"))).drop("blocks")
    joint = cells.groupBy("lang", "block").applyInArrow(_joint, "a long, b long, x long, y long, m long")
    joint = common.materialize(joint.groupBy("a", "b", "x", "y").agg(F.sum("m").alias("m")), "audit-joint")
    side = lambda of: groups.select(F.col("lang"), F.col("g").alias(of), F.col("source").alias(f"source_{of}"), F.col("total").alias(f"total_{of}"), F.col("own").alias(f"own_{of}"), *(["v"] if of == "a" else []))
    # the result has every two sources of a language, so the work has too
    pairs = common.materialize(side("a").join(side("b"), "lang").where("a < b"), "audit-pairs")
    zero, m = F.lit(0).cast("long"), F.col("m")
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    # a term that both have is one less among those that only one, or neither, has
    both = joint.select("a", "b", F.explode(F.array(cell(F.col("x"), F.col("y"), m), cell(F.col("x"), zero, -m), cell(zero, F.col("y"), -m), cell(zero, zero, m))).alias("c")).select("a", "b", "c.*")
    own = kept.groupBy("g", "n").agg(F.count("*").alias("m"))
    ids = pairs.select("a", "b")
    alone = ids.join(own.select(F.col("g").alias("a"), F.col("n").alias("x"), "m"), "a").select("a", "b", "x", zero.alias("y"), "m")
    other = ids.join(own.select(F.col("g").alias("b"), F.col("n").alias("y"), "m"), "b").select("a", "b", zero.alias("x"), "y", "m")
    neither = pairs.select("a", "b", zero.alias("x"), zero.alias("y"), (F.col("v") - F.col("own_a") - F.col("own_b")).alias("m"))
    tally = both.unionByName(alone).unionByName(other).unionByName(neither).groupBy("a", "b", "x", "y").agg(F.sum("m").alias("m")).where("m > 0")
    f = F.abs(share(F.col("x"), F.col("total_a"), F.col("v")) - share(F.col("y"), F.col("total_b"), F.col("v")))
    values = tally.join(pairs, ["a", "b"]).select("a", "b", (f * F.col("m")).alias("value")).groupBy("a", "b").agg(F.sum("value").alias("value"))
    found = pairs.join(values, ["a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    found = found.select("lang", "value", F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))).alias("p"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "p.source", F.lit("pair").alias("part"), "p.item", "value").withColumn("rank", F.row_number().over(order))


def _own_terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = kept.join(groups.select("g", "source", "total", "v", "lang_total"), "g")
    value = share(F.col("n"), F.col("total"), F.col("v")) - share(F.col("in_lang"), F.col("lang_total"), F.col("v"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.cast("long").alias("value")).where("value > 0")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
