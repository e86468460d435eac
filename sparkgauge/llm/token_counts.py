"""Token counts through a digest cache.

Normalised content (null counts as empty; nothing else is changed, as white space counts for these tokenizers) and the
tokenizer's version are each named by a SHA-256. Counts are joined by these two digests to a stored table; only
distinct texts that the table lacks are encoded, once each, and appended to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textvec

CACHE_SCHEMA = T.StructType(
    [
        T.StructField("tokenizer_sha256", T.StringType()),
        T.StructField("content_sha256", T.StringType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file (``.json``: tokenizers, ``.model``: sentencepiece) held as bytes, so that executors need no path."""

    kind: str
    data: bytes

    @staticmethod
    def load(path: str) -> Tokenizer:
        suffix = Path(path).suffix
        if suffix not in (".json", ".model"):
            raise ValueError(f"neither a tokenizers nor a sentencepiece file: {path}")
        return Tokenizer(suffix[1:], Path(path).read_bytes())

    @property
    def version(self) -> str:
        """Names the vocabulary and the library version: either changing makes other counts."""
        if self.kind == "model":
            import sentencepiece as library
        else:
            import tokenizers as library
        return hashlib.sha256(f"{self.kind} {library.__version__} ".encode() + self.data).hexdigest()

    def counter(self):
        """A function from a list of texts to a list of their token counts, without begin, end or added tokens."""
        if self.kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        from tokenizers import Tokenizer as Json

        model = Json.from_buffer(self.data)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def with_digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with content_sha256: the digest of the normalised content."""
    return docs.withColumn("content_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts at ``path``; empty where nothing is stored yet. A key stored twice counts once."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path).groupBy("tokenizer_sha256", "content_sha256").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer.value.counter()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a in range(0, len(texts), 256):
                part = textvec.strings(texts.slice(a, 256))
                yield pa.RecordBatch.from_arrays([keys.slice(a, 256), pa.array(np.array(count(part), np.int64))], ["content_sha256", "n_tokens"])

    return run


#: Missing digests that are sent to every task, at most: about 50 MB.
FEW = 500_000


def misses(digests: DataFrame, cache_path: str, version: str) -> DataFrame:
    """The distinct content_sha256 of ``digests`` that the cache lacks for a tokenizer's version. No text moves for this."""
    stored = read_cache(digests.sparkSession, cache_path).where(F.col("tokenizer_sha256") == version).select("content_sha256")
    return digests.select("content_sha256").distinct().join(stored, "content_sha256", "left_anti")


def fill_cache(docs: DataFrame, tokenizer: Tokenizer, cache_path: str, text: str = "text", digests: DataFrame | None = None) -> None:
    """Encode each distinct text of ``docs`` that the cache lacks, and append the counts to it.

    Digests are looked up first (``digests``: those of ``docs``, where they are written already). Where none is missing,
    no text is read again; few are sent to the tasks, which pick the texts where they are read; otherwise the texts cross
    one shuffle, a text that many rows share once a task.
    """
    spark = docs.sparkSession
    wanted = with_digest(docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text")
    missing = common.materialize(misses(wanted if digests is None else digests, cache_path, tokenizer.version), "token-misses")
    n = missing.count()
    if not n:
        return
    texts = lambda rows: rows.groupBy("content_sha256").agg(F.first("_text").alias("_text"))
    few = n <= FEW
    found = texts(wanted.join(F.broadcast(missing), "content_sha256", "left_semi")) if few else texts(wanted).join(missing, "content_sha256", "left_semi")
    model = spark.sparkContext.broadcast(tokenizer)  # the vocabulary file: its size doesn't depend on the corpus
    counts = found.mapInArrow(common.lean(_encoded(model)), "content_sha256 string, n_tokens long")
    counts.select(F.lit(tokenizer.version).alias("tokenizer_sha256"), "content_sha256", "n_tokens").write.mode("append").parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer: Tokenizer, cache_path: str, limit: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, content_sha256, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and their tokenizer's count of the empty text. Repeated rows come back as often as
    they are there. An empty table gives an empty result. Other columns of ``docs`` don't matter, whatever their names.
    """
    rows = with_digest(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text").select(
        *keep, "content_sha256", F.octet_length("_text").cast("long").alias("n_bytes")
    )
    rows = common.materialize(rows, "token-rows")
    fill_cache(docs, tokenizer, cache_path, text, rows)
    cache = read_cache(docs.sparkSession, cache_path).where(F.col("tokenizer_sha256") == tokenizer.version)
    counts = common.materialize(rows.groupBy("content_sha256").agg(F.count("*").alias("_rows")).where("_rows > 1"), "token-shared")
    # a text that many rows share (empty ones, say) is dealt to several parts
    return common.salted_join(rows, cache.select("content_sha256", "n_tokens"), "content_sha256", counts, keep[0]).select(
        *keep, "content_sha256", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
