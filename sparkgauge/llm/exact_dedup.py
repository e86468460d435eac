"""Exact de-duplication by composable polynomial fingerprints.

A text, with each run of white space replaced by one space, is cut into chunks. Each chunk has a polynomial hash modulo
two primes; chunk hashes combine by multiplying with the base to the power of what follows (a length shift), so chunks
of one huge document can be hashed side by side, in any order and on any machine. Texts of equal fingerprint and length
are then compared with the first of them chunk by chunk, so a collision of fingerprints never merges different texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textvec

PRIMES = (2_147_483_629, 2_147_483_587)
BASE = 1_000_003
#: Bytes of a chunk that is hashed, and code points of one that is compared.
CHUNK, COMPARE = 1024, 1 << 16


def _table(step: int, n: int, prime: int) -> np.ndarray:
    """step**0 .. step**(n-1) modulo prime."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(step, have, prime)) % np.uint64(prime)
        have += more
    return out


_WEIGHTS = np.stack([_table(BASE, CHUNK, p)[::-1] for p in PRIMES], 1).astype(np.float64)


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    """The fingerprint of a text from those of its two parts and the second part's length in bytes."""
    return tuple((a * pow(BASE, right_length, p) + b) % p for a, b, p in zip(left, right, PRIMES, strict=True))


def fingerprint(data: bytes) -> tuple[int, int]:
    """The two residues of one text's bytes: what ``fingerprints`` gives, by the definition."""
    out = (0, 0)
    for x in data:
        out = combine(out, (x, x), 1)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, 2): the residues of each document's bytes. A chunk's products stay under 2**53, so floats are exact."""
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    first = np.cumsum(chunks) - chunks
    total = int(chunks.sum())
    out = np.zeros((len(lengths), 2), np.uint64)
    if not total:
        return out
    # leading zeros don't change a polynomial: each document is moved to the end of its chunks
    room = np.zeros(total * CHUNK, np.float64)
    room[np.arange(len(data)) + np.repeat((first + chunks) * CHUNK - offsets[1:], lengths)] = data
    each = (room.reshape(total, CHUNK) @ _WEIGHTS).astype(np.uint64)
    full = np.flatnonzero(chunks)
    follow = np.repeat((first + chunks)[full], chunks[full]) - 1 - np.arange(total)
    for k, p in enumerate(PRIMES):
        shifts = _table(pow(BASE, CHUNK, p), int(follow.max()) + 1, p)[follow]
        out[full, k] = np.add.reduceat(each[:, k] % np.uint64(p) * shifts % np.uint64(p), first[full]) % np.uint64(p)
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.names.index("_norm")
        found = [fingerprints(data, offsets) for _, _, data, offsets in textvec.slices(batch.column(at), 1 << 20)]
        pair = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        both = (pair[:, 0] << np.uint64(32) | pair[:, 1]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(both)], names=[*batch.schema.names, "_fp"])


def fingerprint_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_row, key, _norm, _fp): the rows of ``docs``, each with its normalised text and the text's fingerprint."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.SPACE, " ").alias("_norm"),
    )
    return rows.mapInArrow(common.lean(_fingerprinted), common.schema(rows, "", "_fp long"))


def _chunks(rows: DataFrame, *keep: str) -> DataFrame:
    n = F.ceil(F.length("_norm") / F.lit(COMPARE)).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("_at")
    return rows.select(*keep, at, "_norm").select(*keep, "_at", F.substring("_norm", F.col("_at") * COMPARE + 1, F.lit(COMPARE)).alias("_chunk"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256): one row per row of ``docs``, dropped ones too.

    Null counts as the empty text; empty texts are equal. Of equal texts the smallest key stays (null keys last); of rows
    with the same key and an equal text one row is marked as kept. Very long texts are hashed and compared in
    chunks. An empty table gives an empty result. Only the key and the text are read of ``docs``.
    """
    order = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col("_row").alias("r"))
    table = common.materialize(
        fingerprint_rows(docs, key, text).withColumns({"_len": F.octet_length("_norm"), "text_sha256": F.sha2("_norm", 256)}), "fingerprints"
    ).withColumn("_part", F.lit(0))
    small = table.drop("_norm")
    settled = None
    group = ["_fp", "_len", "_part"]
    # Rows of one fingerprint are compared with the first of them. Those that differ (a collision) make groups of their
    # own, and so on; every round settles a text, and without collisions there is one round.
    while True:
        heads = table.groupBy(*group).agg(F.min(order).alias("_head"), F.count("*").alias("_n")).where("_n > 1")
        heads = common.materialize(heads.select(F.struct(*group).alias("_g"), F.col("_head.r").alias("_first"), F.col("_n").alias("_rows")), "heads")
        # texts cross one shuffle; only those of groups are written
        marked = table.select(F.struct(*group).alias("_g"), "_row", "_norm")
        together = common.materialize(common.salted_join(marked, heads.select("_g", "_first"), "_g", heads.select("_g", "_rows"), "_row", merge=True).select("_row", "_first", "_norm"), "groups")
        members = _chunks(together.where("_row <> _first"), "_row", "_first")
        firsts = _chunks(together.where("_row = _first"), "_first").withColumnRenamed("_chunk", "_other")
        pairs = common.salted_join(members, firsts, "_first", heads.select("_first", "_rows"), "_row", also=("_at",))
        differ = common.materialize(pairs.where(F.col("_chunk") != F.col("_other")).select("_row").distinct(), "collisions")
        same = small.join(differ, "_row", "left_anti")
        settled = same if settled is None else settled.unionByName(same)
        if differ.isEmpty():
            break
        table = common.materialize(table.join(differ, "_row", "left_semi").withColumn("_part", F.col("_part") + 1), "rest")
        small = table.drop("_norm")
    settled = settled.select(F.struct(*group).alias("_g"), "_row", key, "text_sha256")
    groups = common.materialize(settled.groupBy("_g").agg(F.min(order).alias("_head"), F.count("*").alias("group_size")), "sizes")
    return common.salted_join(settled, groups, "_g", groups.select("_g", F.col("group_size").alias("_rows")), "_row").select(
        key, F.col("_head.k").alias("keep_id"), "group_size", (F.col("_row") == F.col("_head.r")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all its columns) that stay. Of rows with the same key and an equal text the one whose columns'
    hash is smallest stays, whatever the order of rows; a null key isn't an empty one."""
    name = F.concat(F.when(F.col(key).isNull(), "-").otherwise("+"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_k")
    kept = exact_dedup(docs, key, text).where("kept").select(name, F.col("text_sha256").alias("_s"))
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.SPACE, " ")
    marked = docs.select(common.whole(docs).alias("_all"), name, F.sha2(norm, 256).alias("_s"))
    return common.one_of_each(marked.join(kept, ["_k", "_s"], "left_semi"), ["_k", "_s"], "_all").select("_all.*")
