import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparkgauge import catalog
from sparkgauge.operators import audit, diff, resolve
from sparkgauge.sources import files
from tests.fixtures import write_csvs


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    raw, snapshots = files.snapshots(spark, write_csvs(tmp_path_factory.mktemp("csv")), "TST")
    return files.normalized(raw, "TST").cache(), snapshots.cache()


@pytest.fixture(scope="module")
def links(months):
    return resolve.resolve_market(months[0], "exact").cache()


def by_queue(records, links):
    rows = links.join(records.select("record_id", "queue_id", "snapshot_date"), "record_id").collect()
    return {r["queue_id"]: r for r in rows if r["snapshot_date"].month == 2}


def test_links_of_the_second_month(months, links):
    found = by_queue(months[0], links)
    assert found["A-1"]["match_method"] == found["B-2"]["match_method"] == "high_confidence_match"
    assert found["A-9"]["match_method"] == "new_entity"
    assert found["C-6"]["match_method"] == "ambiguous_possible_match" and found["C-6"]["is_ambiguous"]
    assert found["B-2"]["match_score"] == 0.76  # exactly at the threshold, as scores are rounded first


def test_events_of_the_fixture(months, links):
    records, snapshots = months
    events = diff.diff(records, links, diff.adjacent_snapshots(snapshots))
    ids = {r["entity_id"]: r["queue_id"] for r in links.join(records.select("record_id", "queue_id"), "record_id").orderBy("snapshot_id").collect()}
    got = sorted((ids[r["entity_id"]], r["event_type"]) for r in events.collect())
    assert got == sorted([
        ("A-1", "capacity_changed"), ("A-1", "target_cod_delayed"), ("B-2", "unchanged"), ("A-3", "withdrawn_project"), ("A-4", "completed_project"), ("A-5", "name_changed"), ("A-6", "removed_project"), ("A-7", "removed_project"),
        ("C-6", "ambiguous_match"), ("A-8", "unchanged"), ("A-9", "new_project"),
    ])
    assert events.where("event_type = 'new_project'").first()["confidence"] == 0.9


def test_diff_of_equal_snapshots_is_quiet(spark, months, links):
    records = months[0].where("snapshot_id like '%01_31'")
    again = records.withColumns({"snapshot_id": F.lit("later"), "snapshot_date": F.lit("2026-03-31").cast("date"), "record_id": F.concat(F.lit("x"), "record_id")})
    first = links.where("snapshot_id like '%01_31'")
    both = first.unionByName(first.withColumns({"snapshot_id": F.lit("later"), "record_id": F.concat(F.lit("x"), "record_id")}))
    rows = records.unionByName(again)
    assert {r["event_type"] for r in diff.diff(rows, both, diff.adjacent_snapshots(rows)).collect()} == {"unchanged"}


def test_blocked_and_exact_decide_alike(spark):
    random.seed(4)
    words = ["solar", "north", "ridge", "mesa", "wind", "lake", "point", "oak", "river", "delta"]

    def rows(snapshot, n):
        return [
            (f"{snapshot}-{i}", f"Q{random.randrange(25)}" if random.random() < 0.8 else None, name := " ".join(random.sample(words, random.choice([1, 2, 3]))), name, random.choice(words), random.choice(["A", "B"]), "TX", random.choice(["Solar", "Hybrid", "Wind"]), float(random.choice([50, 52, 90, 100])), random.choice([None, "p one", "p two"]), f"2027-0{random.randrange(1, 9)}-01", "M", snapshot, f"2026-0{snapshot}-01")
            for i in range(n)
        ]

    names = "record_id string, queue_id string, normalized_project_name string, project_name string, interconnecting_entity string, county string, state string, normalized_fuel_type string, capacity_mw double, point_of_interconnection string, target_cod string, market string, snapshot_id string, snapshot_date string"
    data = spark.createDataFrame([*rows("1", 40), *rows("2", 40)], names).withColumns({c: F.col(c).cast("date") for c in ("target_cod", "snapshot_date")}).cache()
    half = data.withColumns({"normalized_project_name": F.concat("normalized_project_name", F.lit(" 1")), "record_id": F.concat(F.lit("z"), "record_id"), "queue_id": F.concat(F.lit("N"), "queue_id"), "interconnecting_entity": F.concat(F.lit("the company of "), "interconnecting_entity")})
    data = data.unionByName(half).cache()
    key = lambda mode: {r["record_id"]: (r["entity_id"], r["match_method"], r["is_ambiguous"], r["match_score"] if r["match_score"] >= 0.53 else None) for r in resolve.resolve_market(data, mode).collect()}
    assert key("exact") == key("blocked")


def test_similar_names_finds_all(spark):
    random.seed(1)
    alphabet = "abcde 12"
    make = lambda: "".join(random.choice(alphabet) for _ in range(random.randrange(1, 14))).strip() or "a"
    a, b = {make() for _ in range(60)}, {make() for _ in range(60)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "normalized_project_name string")
    got = {(r["b_name"], r["a_name"]) for r in resolve.similar_names(frame(b), frame(a)).collect()}
    assert got == {(x, y) for x in b for y in a if SequenceMatcher(None, x, y).ratio() >= 0.75}


def test_similar_texts_of_all_lengths(spark):
    random.seed(2)
    base = ["north ridge solar farm two", "point wind energy center", "a", "ab", "abc storage", "x" * 30, "lake mesa delta river project phase three of nine"]

    def near(t):
        t = list(t)
        for _ in range(random.randrange(0, 6)):
            k = random.randrange(len(t) + 1)
            t[k : k + random.randrange(0, 2)] = random.choice(["", "a", "x", " q", "solar"])
        return "".join(t).strip() or "z"

    a, b = ({near(random.choice(base)) for _ in range(70)} for _ in range(2))
    frame = lambda xs: spark.createDataFrame([(x,) for x in [*xs, "", None]], "text string")
    for least in (0.75, 0.80, 0.85, 0.90):
        got = {(r["b_text"], r["a_text"]) for r in resolve.similar_texts(frame(b), frame(a), least).collect()}
        assert got == {(x, y) for x in b for y in a if SequenceMatcher(None, x, y).ratio() >= least}, least


def test_few_pairs_are_looked_at(spark, sf):
    """Of the suppliers' pairs, far under 5 % reach the matcher, and nearly all that are scored are linked."""
    rows = catalog.supplier_records(spark, "/root/testdata/sf0.01").cache()
    b, a = (resolve.prefixed(rows.withColumn("entity_id", F.lit("e")).where(F.col("snapshot_id") == s), p, *m) for s, p, m in (("sup_1", "b_", ("entity_id",)), ("sup_2", "a_", ())))
    found = resolve.fuzzy_pairs(b, a).count()
    assert found <= 0.02 * b.count() * a.count(), found


def test_a_taken_entity_isnt_given_twice(spark):
    row = lambda rid, q, snap: (rid, q, "lone star solar", "Lone Star Solar", "dev", "A", "TX", "Solar", 100.0, "poi", snap)
    names = "record_id string, queue_id string, normalized_project_name string, project_name string, interconnecting_entity string, county string, state string, normalized_fuel_type string, capacity_mw double, point_of_interconnection string, snapshot_id string"
    frame = lambda rows: spark.createDataFrame(rows, names).withColumn("target_cod", F.lit("2027-01-01").cast("date"))
    before, after = frame([row("b1", "Q9", "1")]), frame([row("a2", "Q2", "2"), row("a1", "Q1", "2"), row("a0", None, "2")])
    got = {r["record_id"]: r["match_method"] for r in resolve.resolve_pair(before, resolve.seed_links(before), after).collect()}
    assert got == {"a1": "high_confidence_match", "a2": "new_entity", "a0": "new_entity"}


def test_audit_and_entities(months, links):
    records, snapshots = months
    events = diff.diff(records, links, diff.adjacent_snapshots(snapshots))
    a, b = "snap_tst_2026_01_31", "snap_tst_2026_02_28"
    rows = audit.audit(records, links, events, snapshots, a, b).cache()
    assert rows.columns == list(audit.COLUMNS) and len(rows.columns) == 29
    counts = audit.audit_counts(rows).first().asDict()
    assert counts["exact_matches"] == 5 and counts["fuzzy_matches"] == 1 and counts["ambiguous_matches"] == 1 and counts["true_additions"] == 1 and counts["true_removals_or_missing"] == 2
    assert audit.review_candidates(rows).first()["system_label"] == "ambiguous_needs_review"
    assert {r["queue_id"] for r in audit.id_overlap(records.where(F.col("snapshot_id") == a), records.where(F.col("snapshot_id") == b)).collect()} == {"A-1", "A-3", "A-4", "A-5", "A-8"}
    named = {r["project_name"]: r for r in resolve.entities(records, links).collect()}
    assert named["Copper Ridge Solar LLC"]["records"] == 2 and named["Copper Ridge Solar LLC"]["capacity_mw"] == 180.0


def test_twins_and_copies_of_suppliers(spark, sf):
    """Blocked and exact resolution agree where records are torn between twins and where two want one entity."""
    rows = catalog.supplier_records(spark, sf, contested=True)
    show = lambda links: sorted((r["record_id"], r["entity_id"], r["match_method"], r["is_ambiguous"]) for r in links.collect())
    blocked = resolve.resolve_market(rows)
    assert show(blocked) == show(resolve.resolve_market(rows, "exact"))
    assert blocked.where("is_ambiguous").count() > 0
    assert blocked.where("record_id like '%-C' and match_method = 'new_entity'").count() == 0


def test_texts_are_compared_within_their_keys(spark):
    """What must agree besides the text is part of the join on runs, so texts of other keys make no candidates."""
    frame = lambda xs: spark.createDataFrame(xs, "text string, _key string")
    before, after = frame([("lone star solar", "a"), ("lone star solar", "b"), ("other", "c")]), frame([("lone star solar x", "b"), ("lone star solar", "d"), ("other", "c")])
    assert {tuple(r) for r in resolve.similar_texts(before, after, 0.85, ("_key",)).collect()} == {("b", "lone star solar", "lone star solar x"), ("c", "other", "other")}


def test_keys_hold_all_that_is_close_or_near(spark):
    random.seed(7)
    sizes = [0.0, 5.0, 10.0, 249.9, 250.0, 252.5, *(random.choice([1, -1]) * random.uniform(0, 1500) for _ in range(120))]
    record = lambda p: spark.createDataFrame([(i, "A", "TX", "Hybrid" if p == "b_" else "Solar", mw) for i, mw in enumerate(sizes)], ", ".join(f"{p}{c}" for c in ("id int", "county string", "state string", "normalized_fuel_type string", "capacity_mw double")))
    pairs = record("b_").crossJoin(record("a_"))
    for kind, fits in (("cfw", resolve.capacity_close), ("fns", resolve.capacity_near)):
        met = record("b_").select("b_id", resolve._keys("b_", (kind,)).alias("k")).join(record("a_").select("a_id", resolve._keys("a_", (kind,)).alias("k")), "k").select("b_id", "a_id").distinct()
        due = pairs.where(fits(F.col("b_capacity_mw"), F.col("a_capacity_mw"))).select("b_id", "a_id")
        assert due.count() > len(sizes) and due.exceptAll(met).count() == 0
