import random
from collections import Counter

from pyspark.sql import functions as F

from sparkgauge.operators import audit, reconcile

SCHEMA = "k long, part string, v double, note string"


def table(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(rng.randrange(120) if rng.random() < 0.95 else None, rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, None]), rng.choice(["x", None, ""])) for _ in range(n)]
    return rows + rows[:10]


def verdicts(left, right):
    out = {}
    of = lambda rows, key: Counter(r[2:] for r in rows if r[:2] == key)
    for key in {r[:2] for r in (*left, *right)}:
        a, b = of(left, key), of(right, key)
        if a != b:
            many = a.total() > 1 or b.total() > 1
            kind = "only_left" if not b else "only_right" if not a else "other_rows" if many else "other_values"
            columns = [c for c, x, y in zip(("v", "note"), next(iter(a)), next(iter(b)), strict=True) if x != y] if kind == "other_values" else []
            out[key] = (kind, a.total(), b.total(), columns)
    return out


def test_reconcile(spark):
    left = table()
    rng = random.Random(9)
    right = [r for r in left if rng.random() > 0.05]
    right = [(*r[:2], 9.0 if rng.random() < 0.05 else r[2], None if rng.random() < 0.05 else r[3]) for r in right] + [(900, "a", 1.0, "x"), (900, "a", 1.0, "x"), (None, None, None, None)]
    rng.shuffle(right)
    one, two = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for buckets in (1, 7, reconcile.BUCKETS):
        got = {(r["k"], r["part"]): (r["verdict"], r["left_rows"], r["right_rows"], r["columns"]) for r in reconcile.reconcile(one, two, ["k", "part"], buckets=buckets).collect()}
        assert got == verdicts(left, right)
    assert reconcile.reconcile(one, one.orderBy(F.rand(3)).repartition(7), ["k", "part"]).isEmpty()
    assert {r["verdict"] for r in reconcile.reconcile(one, two.limit(0), ["k", "part"]).collect()} == {"only_left"} and reconcile.reconcile(one.limit(0), two.limit(0), ["k"]).isEmpty()


def test_only_buckets_that_differ_are_read_again(spark):
    rows = spark.range(5_000).select("id", (F.col("id") * 2).alias("v"))
    other = rows.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    found = reconcile.differing_buckets(rows, other, ["id"], ["v"]).collect()
    assert len(found) == 1 and found[0]["left_rows"] == found[0]["right_rows"] < 10
    assert [tuple(r) for r in reconcile.reconcile(rows, other, ["id"]).collect()] == [(77, "other_values", 1, 1, ["v"])]


def test_figures_that_differ_are_named(spark):
    records = lambda rows: spark.createDataFrame(rows, "snapshot_id string, queue_id string, name string, status string, fuel string, mw double")
    engine = records([("a", "1", "n", "Active", "Wind", 5.0), ("a", None, None, "Unknown", None, None), ("b", "1", "n", "Active", "Wind", 5.0)])
    plain = records([("a", "1", "n", "Active", "Wind", 5.0), ("b", "1", "n", "Active", "Wind", 6.0)])
    got = {r["metric"]: (r["calculated"], r["official"], r["status"]) for r in audit.compared(reconcile.record_figures(plain), reconcile.record_figures(engine), 0.01).collect()}
    assert got["row_count/a"] == (1.0, 2.0, "mismatch_documented") and got["active_capacity_by_fuel/b/Wind"][2] == "mismatch_documented" and got["queue_id_overlap/a & b"] == (1.0, 1.0, "matched_within_tolerance")
    assert got["status_count/a/Unknown"] == (None, 1.0, "skipped_missing_value") and got["missing_key_fields/a"] == (0.0, 1.0, "mismatch_documented")
