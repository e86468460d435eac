"""A similarity join on word n-gram sets: MinHash banding for candidates, full sets for the decision.

Rows of equal n-gram sets are one class. Classes meet in the buckets of their band hashes; in a bucket every class is
compared with the first, the leader. One minus the Jaccard similarity is a metric, so two classes' distances to a third
often decide whether they are linked; only pairs that this leaves open are compared, in blocks, as products of 0/1
matrices. A class travels there as its difference from the third, which is short where they are alike. Links are then
counted exactly inside each connected group in the same way, around the group's first class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textvec
from .graph import components

WORDS, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 140
#: Classes of a block.
BLOCK = 512
SLICE = 1 << 19
_SEED = 0x51ED2701


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which so many bands as reach ``recall`` at ``threshold`` need at most ``most`` hashes.

    A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands.
    """
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))) if threshold < 1 else 1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each document's distinct n-gram hashes in order, document after document.

    Words are runs of other than white space. A document with fewer words than n, but some, has one n-gram: all of them.
    """
    starts, ends, doc = textvec.runs(data, offsets, textvec.WORDS)
    h = textvec.hashes(data, starts, ends)
    docs = len(offsets) - 1
    if not len(h):
        return h, np.zeros(docs, np.int64)
    words = np.bincount(doc, minlength=docs)
    grams, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= n:
        whole = doc[n - 1 :] == doc[: len(doc) - n + 1]
        total = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            total = total * step + h[k : len(h) - n + 1 + k]
        grams, of = textvec.mix(total[whole]), doc[: len(doc) - n + 1][whole]
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        first = np.cumsum(words) - words
        lone = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = words[short] > k
            lone[has] = lone[has] * step + h[first[short[has]] + k]
        grams = np.concatenate([grams, textvec.mix(lone + words[short].astype(np.uint64))])
        of = np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    grams, of = grams[new], of[new]
    return grams, np.bincount(of, minlength=docs)


def band_hashes(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents with n-grams, bands): one 64-bit hash of the ``rows`` minima of each band."""
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    random = np.random.default_rng(_SEED)
    odd = random.integers(0, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
    add = random.integers(0, 1 << 63, bands * rows, np.uint64)
    out = np.zeros((len(first), bands), np.uint64)
    for band in range(bands):
        total = np.full(len(first), band + 1, np.uint64)
        for k in range(band * rows, band * rows + rows):
            x = grams * odd[k]
            x ^= x >> np.uint64(32)
            x *= add[k] | np.uint64(1)
            total = textvec.mix(total * np.uint64(0x100000001B3) + np.minimum.reduceat(x, first))
        out[:, band] = total
    return out


def _signed(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("_text")
            others = [i for i in range(batch.num_columns) if i != at]
            for a, b, data, offsets in textvec.slices(batch.column(at), SLICE):
                grams, sizes = ngram_sets(data, offsets, n)
                there = np.flatnonzero(sizes)
                fp = np.zeros((len(sizes), 2), np.uint64)
                signed = np.zeros((len(sizes), bands), np.uint64)
                if len(there):
                    first = (np.cumsum(sizes) - sizes)[there]
                    fp[there, 0] = np.add.reduceat(textvec.mix(grams ^ np.uint64(0xA5A5A5A5)), first)
                    fp[there, 1] = np.add.reduceat(textvec.mix(grams + np.uint64(0x1234567)), first)
                    signed[there] = band_hashes(grams, sizes, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum((sizes > 0) * bands)).astype(np.int32)), pa.array(signed[there].ravel().view(np.int64)))
                got = [pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), pa.array(sizes), lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in others), *got], names=[*(batch.schema.names[i] for i in others), "_f", "_g", "_n", "_bands"])

    return run


def _with_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textvec.slices(batch.column(1), SLICE):
                grams, sizes = ngram_sets(data, offsets, n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["c", "grams"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Jaccard similarity of the two sets of each row, the first one's size, and by what the second differs from it."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        out, sizes, differ, ends = np.zeros(len(batch)), np.zeros(len(batch), np.int64), [], np.zeros(len(batch) + 1, np.int32)
        for i in range(len(batch)):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            differ.append(np.setxor1d(a, b, assume_unique=True))
            both = (len(a) + len(b) - len(differ[i])) // 2
            out[i], sizes[i], ends[i + 1] = both / (len(a) + len(b) - both), len(a), ends[i] + len(differ[i])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(differ) if differ else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out), pa.array(sizes), pa.array(right.value_lengths().cast(pa.int64())), lists], names=["a", "b", "sim", "n_a", "n_b", "differ"])


def links_between(left: list[np.ndarray], right: list[np.ndarray] | None, n_left: np.ndarray, n_right: np.ndarray | None, pivot: int, threshold: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (None: of ``left`` among themselves) are at least ``threshold`` alike.

    A set of n elements is given by its difference from a common set of ``pivot`` elements, and n. Two have
    pivot - removed - removed' + (what both differences have) elements in common; that last number is a product of 0/1
    matrices, over runs of the elements' common numbering.
    """
    sets = left if right is None else [*left, *right]
    sizes = np.asarray(n_left if right is None else np.concatenate([n_left, n_right]), np.int64)
    lengths = np.array([len(x) for x in sets], np.int64)
    n = len(left)
    both = np.zeros((n, n if right is None else len(right)), np.float32)
    if lengths.sum():
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), lengths)
        by = np.argsort(column, kind="stable")
        column, row = column[by], row[by]
        for low in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[a:b], column[a:b] - low] = 1
            both += x[:n] @ (x if right is None else x[n:]).T
    removed = (pivot + lengths - sizes) // 2
    one, two = slice(0, n), slice(0, n) if right is None else slice(n, None)
    common_ = pivot - removed[one, None] - removed[None, two] + both
    linked = common_ >= threshold * (sizes[one, None] + sizes[None, two] - common_) - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _block_pairs(rows: pd.DataFrame, threshold: float) -> Iterator[tuple[pd.DataFrame, pd.DataFrame | None, np.ndarray]]:
    """Each group's two blocks among a call's rows (None for the second if they are the same block), and what is linked."""
    for _, group in rows.groupby(["part", "i", "j"], sort=False):
        first = (group["block"] == group["i"]).to_numpy()
        left, right = group[first], group[~first]
        if (group["i"] == group["j"]).iloc[0]:
            right = None
        elif not len(left) or not len(right):
            continue
        sets = lambda x: [np.asarray(d, np.int64) for d in x["differ"]]
        yield left, right, links_between(sets(left), None if right is None else sets(right), left["n"].to_numpy(), None if right is None else right["n"].to_numpy(), int(group["pivot"].iloc[0]), threshold)


def _counted(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Each class's number of links, by documents, to the other block of each pair of blocks, but for those that
        the rings make certain."""
        out = [pd.DataFrame({"c": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})]
        for left, right, linked in _block_pairs(rows, threshold):
            other = left if right is None else right
            linked &= left["ring"].to_numpy()[:, None] + other["ring"].to_numpy()[None] > 10
            out.append(pd.DataFrame({"c": left["c"].to_numpy(), "links": linked @ other["size"].to_numpy()}))
            if right is not None:
                out.append(pd.DataFrame({"c": right["c"].to_numpy(), "links": linked.T @ left["size"].to_numpy()}))
        return pd.concat(out).astype("int64")

    return run


def _stars(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """For each connected set of classes in each pair of blocks, edges from one of them to the others: as many as classes."""
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for left, right, linked in _block_pairs(rows, threshold):
            c = left["c"].to_numpy() if right is None else np.concatenate([left["c"].to_numpy(), right["c"].to_numpy()])
            n, open_ = len(left), np.ones(len(c), bool)
            for root in np.flatnonzero(linked.any(1)):
                if not open_[root]:
                    continue
                reached = np.zeros(len(c), bool)
                new = reached.copy()
                new[root] = True
                while new.any():
                    reached |= new
                    if right is None:
                        new = linked[new].any(0) & ~reached
                    else:
                        new = np.concatenate([linked[:, new[n:]].any(1), linked[new[:n]].any(0)]) & ~reached
                open_ &= ~reached
                reached[root] = False
                b.append(c[reached])
                a.append(np.full(len(b[-1]), c[root]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def ring(distance: Column, threshold: float) -> Column:
    """Rings around a third class, a tenth of the largest distance of linked classes wide: 0 is the class itself.

    Classes of rings i <= j are linked for certain if i + j <= 10, and certainly not if j - i > 10.
    """
    return F.ceil(distance / F.lit((1 - threshold) / 10) - F.lit(1e-9)).cast("int")


def _in_blocks(rows: DataFrame, open_pairs) -> tuple[DataFrame, list[str]]:
    """``rows`` (part, c, ring, and more) once for each open pair of blocks they belong to, and the keys of the calls.

    A part's classes stand in the order of their rings and are cut into blocks of about BLOCK. ``open_pairs(low, high,
    next_low, next_high)`` says of the rings of a block and of one at or after it whether some of their classes have to
    be compared. Small parts share calls, each pair of blocks of a large part is a call of its own.
    """
    sizes = rows.groupBy("part", "ring").agg(F.count("*").alias("n"))
    rings = sizes.groupBy("part").agg(F.sum("n").alias("_rows"), F.array_sort(F.collect_list(F.struct("ring", "n"))).alias("rings"))
    upto = lambda r: F.aggregate(F.filter("rings", lambda x: x["ring"] < r), F.lit(0).cast("long"), lambda total, x: total + x["n"])
    rings = rings.withColumn("rings", F.transform("rings", lambda x: F.struct(x["ring"].alias("ring"), x["n"].alias("n"), upto(x["ring"]).alias("first"))))
    rings = common.materialize(rings, "ngram-rings")
    placed = common.salted_join(rows, rings.select("part", "rings", F.col("_rows").alias("in_part")), "part", rings.select("part", "_rows"), "c")
    own = F.filter("rings", lambda x: x["ring"] == F.col("ring"))[0]
    placed = placed.withColumn("block", F.floor((own["first"] + F.pmod(F.xxhash64("c", F.lit(3)), own["n"])) / BLOCK).cast("int"))
    low = lambda k: F.filter("rings", lambda x: x["first"] + x["n"] > k * BLOCK)[0]["ring"]
    high = lambda k: F.element_at(F.filter("rings", lambda x: x["first"] < (k + 1) * BLOCK), -1)["ring"]

    def is_open(k: Column) -> Column:
        one, two = F.least(k, F.col("block")), F.greatest(k, F.col("block"))
        return open_pairs(low(one), high(one), low(two), high(two))

    placed = placed.withColumn("others", F.filter(F.sequence(F.lit(0), F.floor((F.col("in_part") - 1) / BLOCK).cast("int")), is_open))
    placed = placed.withColumn("other", F.explode("others")).drop("rings", "others")
    placed = placed.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    return placed.withColumn("call", F.when(F.col("in_part") > BLOCK, F.xxhash64("part", "i", "j")).otherwise(F.pmod(F.xxhash64("part"), F.lit(1 << 12)))).drop("in_part"), ["call"]


def _identity(key: str, text: str) -> list[Column]:
    """A row's key, null apart from empty, and a hash of its text."""
    return [F.concat(F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t")]


def similarity_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: key, class_id, n_links, copy_id, n_grams and _t (a hash of the text).

    Two documents are linked if the Jaccard similarity of their n-gram sets is at least ``threshold``. class_id is the
    smallest key of all documents reached by links; n_links counts the other documents linked directly, copies included;
    copy_id is the smallest key among documents with the same n-gram set. Documents without words (null and empty texts)
    are linked to nothing and are a class of their own, n_grams 0. Null keys sort last. Repeated rows count as copies. A
    pair at ``threshold`` is a candidate with probability ``recall``, a more similar one with a higher one; every
    candidate is decided on whole sets. An empty table gives an empty result; only key and text are read.
    """
    bands, rows = banding(threshold, recall)
    source = docs.select(F.col(key), *_identity(key, text), F.col(text).alias("_text"))
    signed = common.materialize(source.mapInArrow(common.lean(_signed(n, bands, rows)), common.schema(source, "_text", "_f long, _g long, _n long, _bands array<long>")), "ngram-signatures")
    least = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), "_k", "_t")
    classes = common.materialize(
        signed.where("_n > 0").groupBy("_f", "_g").agg(F.min(least).alias("least"), F.count("*").alias("size"), F.first("_bands").alias("_bands")).withColumn("c", F.monotonically_increasing_id()), "ngram-classes"
    )
    hashed = classes.select("c", F.explode("_bands").alias("bucket"))
    buckets = common.materialize(hashed.groupBy("bucket").agg(F.min("c").alias("a"), F.count("*").alias("_rows")).where("_rows > 1"), "ngram-buckets")
    # classes and the leaders of their buckets, each pair once however many bands it has in common
    pairs = common.salted_join(hashed, buckets.select("bucket", "a"), "bucket", buckets.select("bucket", "_rows"), "c").where("c <> a")
    pairs = common.materialize(pairs.select("a", F.col("c").alias("b")).distinct(), "ngram-pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = classes.join(involved, "c").select("c", "least._k", "least._t")
    texts = docs.select(*_identity(key, text), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(wanted, ["_k", "_t"]).select("c", "_text")
    sets = common.materialize(texts.mapInArrow(common.lean(_with_sets(n)), "c long, grams array<long>").dropDuplicates(["c"]), "ngram-sets")

    def compare(pairs: DataFrame, name: str) -> DataFrame:
        """(a, b, sim, n_a, n_b, differ) of distinct pairs (a, b), on full sets."""
        counts = pairs.groupBy("a").agg(F.count("*").alias("_rows"))
        left, right = sets.select(F.col("c").alias("a"), F.col("grams").alias("x")), sets.select(F.col("c").alias("b"), F.col("grams").alias("y"))
        found = common.salted_join(pairs.join(right, "b"), left, "a", counts, "b").select("a", "b", "x", "y")
        return common.materialize(found.mapInArrow(common.lean(_compared), "a long, b long, sim double, n_a long, n_b long, differ array<long>"), name)

    found = compare(pairs, "ngram-compared")
    near, at = F.col("sim") >= threshold - 1e-12, ring(1 - F.col("sim"), threshold)
    links = found.where(near).select("a", "b")
    # those near the leader are connected by it; others are compared with all under that leader that the rings leave open
    far = common.materialize(found.groupBy("a").agg(F.count_if(~near).alias("far"), F.count("*").alias("_rows")).where("far > 0 and _rows > 1"), "ngram-far")
    rest = common.salted_join(found, far.select("a"), "a", far.select("a", "_rows"), "b").select(F.col("a").alias("part"), F.col("b").alias("c"), at.alias("ring"), F.col("n_a").alias("pivot"), F.col("n_b").alias("n"), "differ")
    rest, keys = _in_blocks(rest, lambda low, high, next_low, next_high: (next_high > 10) & (next_low - high <= 10))
    links = links.unionByName(rest.groupBy(*keys).applyInPandas(_stars(threshold), "a long, b long"))
    links = common.materialize(links.distinct(), "ngram-links")
    groups = common.materialize(components(links).withColumnRenamed("node", "c"), "ngram-groups")

    # in a group all are compared with its first class (most of them are already): rings decide most links by counting
    around = groups.where("c <> component").select(F.col("component").alias("a"), F.col("c").alias("b"))
    known = found.join(around, ["a", "b"], "left_semi")
    known = known.unionByName(compare(around.join(found.select("a", "b"), ["a", "b"], "left_anti"), "ngram-around"))
    sized = classes.select("c", "size", "least")
    placed = known.select(F.col("a").alias("part"), F.col("b").alias("c"), at.alias("ring"), F.col("n_a").alias("pivot"), F.col("n_b").alias("n"), "differ").unionByName(
        sets.join(groups.where("c = component"), "c", "left_semi").select(F.col("c").alias("part"), "c", F.lit(0).alias("ring"), F.size("grams").cast("long").alias("pivot"), F.size("grams").cast("long").alias("n"), F.array().cast("array<long>").alias("differ"))
    )
    placed = common.materialize(placed.join(sized, "c"), "ngram-placed")
    per_ring = placed.groupBy("part", "ring").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("least").alias("least"))
    of = common.materialize(per_ring.groupBy("part").agg(F.collect_list(F.struct("ring", "size")).alias("rings"), F.max("ring").alias("furthest"), F.sum("n").alias("_rows"), F.min("least").alias("head")), "ngram-heads")
    named = common.salted_join(placed, of.drop("_rows"), "part", of.select("part", "_rows"), "c")
    certain = F.aggregate(F.filter("rings", lambda r: r["ring"] + F.col("ring") <= 10), F.lit(0).cast("long"), lambda total, r: total + r["size"])
    # a class of ring 6 or more may be no kin of its own ring: itself isn't counted twice
    certain = certain - F.when(F.col("ring") <= 5, F.col("size")).otherwise(F.lit(0))
    named = named.select("part", "c", F.col("head.k").alias("class_id"), certain.alias("certain"), "furthest", "ring", "pivot", "n", "size", "differ")
    undecided, keys = _in_blocks(named.where("furthest > 5").drop("class_id", "certain", "furthest"), lambda low, high, next_low, next_high: (high + next_high > 10) & (next_low - high <= 10))
    inner = undecided.groupBy(*keys).applyInPandas(_counted(threshold), "c long, links long").groupBy("c").agg(F.sum("links").alias("links"))
    linked = named.select("c", "class_id", "certain").join(inner, "c", "left").select("c", "class_id", (F.col("certain") + F.coalesce("links", F.lit(0))).alias("links"))
    by_class = classes.join(linked, "c", "left").select(
        "_f", "_g", F.when(F.col("links").isNotNull(), F.col("class_id")).otherwise(F.col("least.k")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("least.k").alias("copy_id"), F.col("size").alias("_rows")
    ).withColumn("_fg", F.struct("_f", "_g"))
    by_class = common.materialize(by_class, "ngram-result")
    worded = signed.where("_n > 0").select(key, "_k", F.struct("_f", "_g").alias("_fg"), F.col("_n").alias("n_grams"), "_t")
    worded = common.salted_join(worded, by_class.drop("_f", "_g", "_rows"), "_fg", by_class.select("_fg", "_rows"), "_k").select(key, "class_id", "n_links", "copy_id", "n_grams", "_t")
    without = signed.where("_n = 0").select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("copy_id"), F.col("_n").alias("n_grams"), "_t")
    return worded.unionByName(without)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all its columns) that stay: of each group of linked documents the one with the smallest key.

    Of rows with the same key and text one stays, the one whose columns' hash is smallest. Documents without words all
    stay, but for such repeated rows. Of a group whose keys are all null, one row of each text stays.
    """
    found = similarity_join(docs, key, text)
    stay = found.where(F.coalesce(F.col(key) == F.col("class_id"), F.col("class_id").isNull())).select(F.concat(F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_k"), "_t").distinct()
    marked = docs.select(common.whole(docs).alias("_all"), *_identity(key, text)).join(stay, ["_k", "_t"], "left_semi")
    return common.one_of_each(marked, ["_k", "_t"], "_all").select("_all.*")
