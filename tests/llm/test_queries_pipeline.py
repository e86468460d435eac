import datetime
import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sparkgauge.llm import queries
from tests.llm.helpers import SCHEMA, awkward, damaged, frame, normal
from tests.llm.test_duplicates import brute, near_copies

pytest.importorskip("public_tokenizers")


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_sql_twins(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    text = lambda v: "" if v is None else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    for name, sql in queries.oracle_sql().items():
        got, found = queries.queries()[name](spark, sf), con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns), name
        at = [names.index(n) for n in sorted(names)]
        assert sorted(tuple(map(text, r)) for r in got.select(*sorted(names)).collect()) == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall()), name


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}), ("op2_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op4_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}), ("op5_quality_classifier", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
    ("op6_url_filters", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"}), ("op7_ngram_join", {"doc_id": "bigint", "class_id": "bigint", "n_links": "bigint"}),
    ("op8_quality_rules", {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}),
    ("op9_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}), ("op10_exact_dedup", {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}),
    ("op13_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
])
def test_contracts(spark, sf, name, columns):
    got = queries.queries()[name](spark, sf)
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    table = "pages" if name.startswith("op6") else "documents"
    assert got.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_whitening_contract(spark, sf):
    got = queries.op12_whitening(spark, sf)
    kinds = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert {c: dict(got.dtypes)[c] for c in kinds} == kinds
    assert got.count() == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count() and got.where("deviation <> deviation_exact or identity_error > 1e-9").count() == 0


def test_stages_on_awkward_rows(spark, sf, tmp_path):
    """Each stage against its plain version, on what the one before it kept."""
    rows = [*awkward(), *[(i + 5000, t, "en", "src1", 1) for i, t, *_ in near_copies()[:120]]]
    folder = tmp_path / "sf"
    os.mkdir(folder)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, *_ in rows if i], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    # with one label only the classifier's score is that label's share: all stay
    kept = steps["quality_classifier"](spark, docs, str(folder))
    assert kept.columns == columns and kept.count() == len(rows)
    single = steps["exact_dedup"](spark, kept, str(folder))
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(normal(t), []).append(i)
    least = sorted((min((x for x in v if x is not None), default=None) for v in texts.values()), key=str)
    assert sorted((r["doc_id"] for r in single.collect()), key=str) == least
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    apart = steps["ngram_join"](spark, single, str(folder))
    heads = sorted({c if c is not None else None for _, c, _ in brute(left)}, key=str)
    assert sorted((r["doc_id"] for r in apart.collect()), key=str) == heads
    mixed = steps["source_mixing"](spark, apart, str(folder))
    assert mixed.columns == columns and 0 < mixed.count() and {r["doc_id"] for r in mixed.collect()} <= set(heads)
    done = steps["byte_bpe"](spark, mixed, str(folder))
    assert done.count() == mixed.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(done.columns)
    assert corpus_pipeline.run(spark, str(folder)).count() == done.count()
    shutil.rmtree(folder)


def test_stages_on_no_rows(spark, tmp_path):
    folder = str(tmp_path / "none")
    empty = frame(spark, [], clash=False)
    empty.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    for name, query in queries.queries().items():
        if not name.startswith(("op6", "op12")):
            assert query(spark, folder).count() == 0, name


def test_damaged_and_odd_columns(spark, sf, tmp_path):
    """Bytes that aren't UTF-8 in every query and stage; dotted names and maps in every stage that returns rows whole."""
    folder = str(tmp_path / "odd")
    damaged(spark).withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.col("doc_id"))}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for name, query in queries.queries().items():
        if not name.startswith(("op3", "op6", "op11", "op12")):
            assert query(spark, folder).count() == 4, name
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "m"] and docs.count() > 0, name
    assert corpus_pipeline.run(spark, folder).count() >= 0


def test_run_on_the_small_tables(spark, sf):
    assert corpus_pipeline.run(spark, sf).where(F.col("n_tokens") > 0).count() > 50
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and datetime.date.today()
