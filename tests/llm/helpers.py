"""Awkward documents that every operator must take, and plain versions of what operators compute."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(i: int, n: int = 60) -> str:
    return " ".join(f"w{(i * 7919 + k * k * 31 + k) % 997}" for k in range(n)) + "."


def awkward() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"tok{k % 4001}x{k % 13}" for k in range(30_000))
    return [
        (1, sentence(1), "en", "src1", 10), (2, sentence(1), "en", "src1", 10), (3, sentence(1).replace(" ", " \n\t", 3), None, None, None), (3, sentence(1).replace(" ", " \n\t", 3), None, None, None), (4, None, "en", "src2", None), (5, "", "de", "src2", 0),
        (6, "   \n ", "de", "", 5), (None, "no id here", "fr", "src3", 1), (None, None, None, None, None), (7, long, "en", "src3", len(long)), (8, "ñandú € 漢字 \U0001f600 ok", "es", "x", 3), (9, "12345 !!! ???", "en", "src9", 3), (10, "a", "en", "src1", 1),
    ]


def frame(spark, rows=None, clash=True):
    """The documents, with further columns whose names operators use inside."""
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for name in ("_text", "score", "label", "ids", "n_tokens", "_norm", "_row", "_fp", "_k", "_t", "c", "kept", "_all", "_n", "_epoch", "predicted", "row", "x"):
            df = df.withColumn(name, F.lit("clash"))
        df = df.withColumns({"a.b": F.lit("dotted"), "a`b": F.lit(None), "map": F.create_map(F.lit("k"), F.col("source")), "nested": F.struct(F.array(F.create_map(F.lit(1), F.lit(2))).alias("maps"))})
    return df


def damaged(spark):
    """Texts with bytes that aren't UTF-8, one of them twice."""
    from pyspark.sql import functions as F

    rows = [(1, b"caf\xe9 \xff one two three four five", "en", "s1", 1), (2, b"\xc3", "en", "s1", 1), (3, b"\xc3", None, None, None), (4, b"plain words here", "de", "s2", 3)]
    return spark.createDataFrame(rows, SCHEMA.replace("text string", "text binary")).withColumn("text", F.col("text").cast("string"))


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
