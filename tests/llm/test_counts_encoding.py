import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.llm import bpe, token_counts
from tests.llm.helpers import awkward, frame

tokenizers = pytest.importorskip("public_tokenizers")
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_equal_the_library(spark, tmp_path, name):
    tokenizer = token_counts.Tokenizer.load(tokenizers.path(name))
    count = tokenizer.counter()
    cache = str(tmp_path / "cache")
    got = token_counts.token_counts(frame(spark), tokenizer, cache, limit=20).collect()
    expected = [(i, len((t or "").encode()), count([t or ""])[0]) for i, t, *_ in awkward()]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got), key=str) == sorted(expected, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in got)


def test_the_cache_encodes_only_what_is_new(spark, tmp_path):
    tokenizer = token_counts.Tokenizer.load(tokenizers.path("piece_bpe_32k.model"))
    cache = str(tmp_path / "cache")
    rows = lambda: spark.read.parquet(cache).count()
    token_counts.fill_cache(frame(spark), tokenizer, cache)
    distinct = len({t or "" for _, t, *_ in awkward()})
    assert rows() == distinct
    token_counts.fill_cache(frame(spark), tokenizer, cache)
    assert rows() == distinct
    more = spark.createDataFrame([(99, "brand new"), (98, "brand new")], "doc_id long, text string")
    assert [r["n_tokens"] > 0 for r in token_counts.token_counts(more, tokenizer, cache).collect()] == [True, True] and rows() == distinct + 1
    token_counts.fill_cache(more, token_counts.Tokenizer.load(tokenizers.path("word_bpe_49k.json")), cache)  # another tokenizer, other keys
    assert rows() == distinct + 2


def test_counts_of_an_empty_table(spark, tmp_path):
    tokenizer = token_counts.Tokenizer.load(tokenizers.path("piece_bpe_32k.model"))
    assert token_counts.token_counts(frame(spark, []), tokenizer, str(tmp_path / "c")).count() == 0


def test_tokenizer_files_are_checked():
    with pytest.raises(ValueError):
        token_counts.Tokenizer.load("x.bin")


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_minimal_perfect_hash():
    random.seed(0)
    for n in (0, 1, 2, 3, 10, 257):
        keys = [str(random.random()).encode() for _ in range(n)]
        table = bpe.PerfectHash(keys)
        assert sorted(table.slot(k) for k in keys) == list(range(n)) and table.slot(b"other") == -1


def test_ids_equal_the_library(coder, library):
    random.seed(2)
    encode = coder.encoder()
    letters = "abcdeABC  \n\t'sreté漢ñ€\U0001f600  \x1c\x85.,!0123"
    texts = ["", "a" * 3000, " " * 500 + "x", "don't we'll", "<|endoftext|>"] + ["".join(random.choice(letters) for _ in range(random.randrange(1, 80))) for _ in range(400)] + [t for _, t, *_ in awkward() if t]
    for text in texts:
        ids = np.frombuffer(encode(text), np.int32)
        assert ids.tolist() == library.encode_ordinary(text), text[:60]
        assert coder.decode(ids).tobytes() == text.encode()


def test_every_code_point_class(coder, library):
    encode = coder.encoder()
    text = "".join(f"a{chr(c)} 1{chr(c)}{chr(c)}" for c in range(0x250)) + "".join(f"a{chr(c)} 1{chr(c)}" for c in range(0x2000, 0x2100)) + "".join(f"b{chr(c)}2" for c in range(0x250, 0x3100, 3))
    assert np.frombuffer(encode(text), np.int32).tolist() == library.encode_ordinary(text)


def test_round_trip(spark, coder, library):
    got = bpe.round_trip(frame(spark), coder).collect()
    expected = [(i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in awkward()]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert bpe.round_trip(frame(spark, []), coder).count() == 0
    encoded = bpe.bpe_encode(frame(spark), coder)
    assert bpe.bpe_decode(encoded, coder).where(F.col("doc_id") == 8).first()["decoded"].decode() == "ñandú € 漢字 \U0001f600 ok"


def test_a_full_cache_moves_no_text(spark, tmp_path):
    tokenizer, path = token_counts.Tokenizer.load(tokenizers.path("piece_bpe_32k.model")), str(tmp_path / "cache")
    docs = frame(spark)
    first = sorted(map(str, token_counts.token_counts(docs, tokenizer, path).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        digests = token_counts.with_digest(docs.select("text"))
        plan = token_counts.misses(digests, path, tokenizer.version)._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "Exchange" in plan
        assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line.split("hashpartitioning")[1].split(")")[0]]
        before = spark.read.parquet(path).count()
        assert sorted(map(str, token_counts.token_counts(docs, tokenizer, path).collect())) == first and spark.read.parquet(path).count() == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_misses_cross_one_shuffle(spark, tmp_path, monkeypatch):
    tokenizer = token_counts.Tokenizer.load(tokenizers.path("piece_bpe_32k.model"))
    few = sorted(map(str, token_counts.token_counts(frame(spark), tokenizer, str(tmp_path / "few")).collect()))
    monkeypatch.setattr(token_counts, "FEW", 1)
    assert sorted(map(str, token_counts.token_counts(frame(spark), tokenizer, str(tmp_path / "many")).collect())) == few


def test_hot_keys_are_dealt_evenly(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sparkgauge.llm import common

    monkeypatch.setattr(common, "HOT", 4_000)
    # 2,000 keys of 20 rows, and one with a third of all rows
    rows = spark.range(60_000).select(F.when(F.col("id") < 40_000, F.col("id") % 2_000).otherwise(-1).alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("_rows"))
    seen = {}
    real = type(rows).join

    def join(self, other, on=None, how=None):
        if isinstance(on, list) and "_salt" in on:
            seen["parts"] = self.groupBy("k", "_salt").count().agg(F.max("count"), F.count("*")).first()
        return real(self, other, on, how)

    monkeypatch.setattr(type(rows), "join", join)
    right = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = common.salted_join(rows, right, "k", counts, "id", least=15)
    assert got.count() == 60_000 and got.where("v <> 2 * k").count() == 0
    assert seen["parts"][0] <= 40 and seen["parts"][1] > 4_000
