"""Entity resolution across snapshots: explainable scores, explicit ambiguity, one-to-one links.

``blocked`` (the default) only scores pairs that can influence a decision; ``exact`` scores all pairs and is meant for
small data and as the yardstick of tests. Both give the same links and methods; a new entity's stored score may be lower
in blocked mode when it is under 0.53, where it decides nothing, and the candidates that an ambiguous link lists end there.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import scratch
from ..functions import normalize
from ..functions.text import hashed_id

#: Thresholds of a confident and of a possible match, and the gap under which the two best are ambiguous.
CONFIDENT, POSSIBLE, GAP = 0.76, 0.58, 0.05
#: The least score that can matter: a second best within the gap of a possible match.
MATTERS = POSSIBLE - GAP - 1e-6
#: What each feature adds to the score.
WEIGHTS = {"queue_id": 0.38, "name_close": 0.22, "name_near": 0.14, "entity": 0.10, "county": 0.09, "state": 0.04, "fuel": 0.10, "capacity": 0.10, "capacity_near": 0.04, "poi": 0.07, "cod": 0.04}
FIELDS = ("record_id", "queue_id", "normalized_project_name", "project_name", "interconnecting_entity", "county", "state", "normalized_fuel_type", "capacity_mw", "point_of_interconnection", "target_cod")


@lru_cache(maxsize=200_000)
def ratio(a: str | None, b: str | None) -> float:
    """Gestalt similarity of two texts, in this order (it isn't symmetric); 0 if either is empty."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of each row; each distinct pair is computed once while the worker remembers it."""
    return pd.Series([ratio(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b, strict=True)], dtype="float64")


def compatible_fuel(a: Column, b: Column) -> Column:
    """Equal, or one is Hybrid and the other one of its parts; false where either is missing."""
    parts = lambda x, y: (x == "Hybrid") & y.isin("Solar", "Battery")
    return F.coalesce((a == b) | parts(a, b) | parts(b, a), F.lit(False))


def capacity_close(a: Column, b: Column) -> Column:
    """Within 5 MW or 2 %, whichever is more; false where either is missing."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(5.0), F.lit(0.02) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def _equal(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) & (a != ""), F.lit(False))


def capacity_near(a: Column, b: Column) -> Column:
    """Within 10 MW or 10 %, whichever is more; false where either is missing."""
    return F.coalesce(F.abs(a - b) <= F.greatest(F.lit(10.0), F.lit(0.10) * F.greatest(F.abs(a), F.abs(b))), F.lit(False))


def _ratio(b: Column, a: Column) -> Column:
    """The matcher's similarity; it only gets to see texts that differ, so equal and missing ones cost it nothing."""
    differ = b != a
    return F.when(F.coalesce(b == a, F.lit(False)) & (b != ""), F.lit(1.0)).otherwise(similarity(F.when(differ, b), F.when(differ, a)))


def prefixed(records: DataFrame, prefix: str, *more: str) -> DataFrame:
    """Records with the fields and texts that a score needs, under prefixed names."""
    texts = {"entity_text": "interconnecting_entity", "poi_text": "point_of_interconnection"}
    return records.select(*(F.col(f).alias(prefix + f) for f in (*FIELDS, *more)), *(normalize.project_name(c).alias(prefix + t) for t, c in texts.items()))


def score_pairs(pairs: DataFrame, before: str = "b_", after: str = "a_") -> DataFrame:
    """``pairs`` with match_score, match_method and match_features, from the ``prefixed`` fields of both records.

    The score is rounded to four places before it meets a threshold.
    """
    b, a = (lambda f: F.col(before + f)), (lambda f: F.col(after + f))
    pairs = pairs.withColumns(
        {
            "_name": _ratio(b("normalized_project_name"), a("normalized_project_name")),
            "_entity": _ratio(b("entity_text"), a("entity_text")),
            "_poi": _ratio(b("poi_text"), a("poi_text")),
            "_days": F.abs(F.datediff(b("target_cod"), a("target_cod"))),
            "_delta": F.abs(b("capacity_mw") - a("capacity_mw")),
        }
    )
    close = capacity_close(b("capacity_mw"), a("capacity_mw"))
    near = capacity_near(b("capacity_mw"), a("capacity_mw"))
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    parts = [
        F.when(_equal(b("queue_id"), a("queue_id")), w["queue_id"]),
        F.when(F.col("_name") >= 0.90, w["name_close"]).when(F.col("_name") >= 0.75, w["name_near"]),
        F.when(F.col("_entity") >= 0.85, w["entity"]),
        F.when(_equal(b("county"), a("county")), w["county"]),
        F.when(_equal(b("state"), a("state")), w["state"]),
        F.when(compatible_fuel(b("normalized_fuel_type"), a("normalized_fuel_type")), w["fuel"]),
        F.when(close, w["capacity"]).when(near, w["capacity_near"]),
        F.when(F.col("_poi") >= 0.80, w["poi"]),
        F.when(F.col("_days") <= 180, w["cod"]),
    ]
    total = reduce(lambda x, y: x + y, (F.coalesce(p, F.lit(0.0)) for p in parts))
    pairs = pairs.withColumn("match_score", F.least(F.round(total, 4), F.lit(1.0)))
    features = F.struct(
        _equal(b("queue_id"), a("queue_id")).alias("exact_queue_id"), F.round("_name", 4).alias("name_similarity"), F.round("_entity", 4).alias("interconnecting_entity_similarity"),
        _equal(b("county"), a("county")).alias("county_match"), _equal(b("state"), a("state")).alias("state_match"), compatible_fuel(b("normalized_fuel_type"), a("normalized_fuel_type")).alias("fuel_compatible"),
        close.alias("capacity_within_tolerance"), F.col("_delta").alias("capacity_delta_mw"), F.round("_poi", 4).alias("poi_similarity"), F.col("_days").alias("target_cod_days_apart"),
    )
    method = F.when(F.col("match_score") >= CONFIDENT, "high_confidence_match").when(F.col("match_score") >= POSSIBLE, "possible_match").otherwise("no_match")
    return pairs.withColumns({"match_features": features, "match_method": method}).drop("_name", "_entity", "_poi", "_days", "_delta")


def _least_common(total: Column, least: float) -> Column:
    """Characters that two texts of ``total`` characters have in common at least, if they are ``least`` alike."""
    return F.ceil(F.lit(least / 2) * total - F.lit(1e-9))


def _shared(q: int, total: Column, least: float) -> Column:
    """Runs of ``q`` characters that they share at least: m common characters lie in at most total - 2 m + 1 pieces."""
    return (2 * q - 1) * _least_common(total, least) - (q - 1) * (total + 1)


def _size(total: Column, least: float) -> Column:
    """The longest of four sizes of runs that two such texts must share one of; one character always is.

    Four characters only where more than four runs are shared, so that the commonest runs of a text needn't be looked up.
    """
    return F.when(_shared(4, total, least) > 4, 4).when(_shared(3, total, least) > 0, 3).when(_shared(2, total, least) > 0, 2).otherwise(1)


def similar_texts(before: DataFrame, after: DataFrame, least: float, on: Sequence[str] = ()) -> DataFrame:
    """(b_text, a_text) of the texts (columns ``text``) with similarity at least ``least``, without comparing all with all.
    ``on``: more columns of both, which come first in the result; only texts that have them in common are compared.

    The matcher's ratio is 2 m / (sum of lengths) for m common characters in order, so two such texts share a number of
    runs of up to four characters, at places that differ by no more than characters are left over. With runs in the
    order of how many texts have them, the rarest of each text then have one in common: an equi-join on rare runs, and
    lengths, ranks, places and edits (all characters that aren't common at most) are part of its condition, so what
    leaves the join is little more than the result. The matcher decides what it finds.
    """
    distinct = lambda df: df.select("text").where("text <> ''").distinct()

    def runs(df: DataFrame, side: str) -> DataFrame:
        texts = distinct(df).withColumn("n", F.length("text"))
        totals = F.sequence(F.ceil(2 * F.col("n") / F.lit(2 - least) - F.lit(1e-9)), F.floor(2 * F.col("n") / F.lit(least) + F.lit(1e-9)))
        # of a text's runs of a size, so many of the rarest as any length of the other text may need: the same for all of a length
        needs = lambda q: lambda t: F.when(_size(t, least) == q, F.col("n") - q + 2 - _shared(q, t, least))
        most = F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.array_max(F.transform("totals", needs(q))).alias("most")) for q in (1, 2, 3, 4))))
        lengths = texts.select("n").distinct().withColumn("totals", totals).select("n", most.alias("m")).select("n", "m.*").where("most > 0 and n >= q")
        # a text makes many times its size in runs, so the texts are spread before that and their parts stay as many
        spread = texts.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "text")
        rows = spread.join(F.broadcast(lengths), "n")
        return rows.select(F.lit(side).alias("side"), "text", "n", "q", "most", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n") - F.col("q") + 1), lambda i: F.substr("text", i, F.col("q")))).alias("at", "run"))

    every = runs(before, "b").unionByName(runs(after, "a"))
    rare = Window.partitionBy("side", "text", "q").orderBy("texts", "run", "at")
    ranked = every.join(every.groupBy("q", "run").agg(F.count("*").alias("texts")), ["q", "run"]).withColumn("rank", F.row_number().over(rare)).where("rank <= most")
    ranked = scratch.materialize(ranked.select("side", "text", "n", "q", "at", "run", "rank"), "runs")

    def side(name: str, texts: DataFrame) -> DataFrame:
        rows = ranked.where(F.col("side") == name)
        rows = rows.join(texts.select("text", *on).distinct(), "text") if on else rows
        return rows.select(*on, "q", "run", *(F.col(c).alias(f"{name}_{c}") for c in ("text", "n", "at", "rank")))

    total, q = F.col("b_n") + F.col("a_n"), F.col("q")
    same = _least_common(total, least)
    shared = F.when(q == 4, _shared(4, total, least)).when(q == 3, _shared(3, total, least)).when(q == 2, _shared(2, total, least)).otherwise(same)
    moved = F.col("b_at") - F.col("a_at")
    edits = F.call_function("levenshtein", "b_text", "a_text", (total - 2 * same).cast("int"))
    found = side("b", before).join(side("a", after), [*on, "q", "run"]).where(
        (F.least("b_n", "a_n") >= same) & (q == _size(total, least)) & (F.col("b_rank") <= F.col("b_n") - q + 2 - shared) & (F.col("a_rank") <= F.col("a_n") - q + 2 - shared)
        & (moved <= F.col("b_n") - same) & (-moved <= F.col("a_n") - same) & (edits >= 0)
    )
    found = found.select(*on, "b_text", "a_text").distinct()
    return found.where(_ratio(F.col("b_text"), F.col("a_text")) >= least)


def similar_names(before: DataFrame, after: DataFrame, least: float = 0.75) -> DataFrame:
    """(b_name, a_name) of the records' distinct names with similarity at least ``least``."""
    names = lambda df: df.select(F.col("normalized_project_name").alias("text"))
    return similar_texts(names(before), names(after), least).select(F.col("b_text").alias("b_name"), F.col("a_text").alias("a_name"))


def _band(mw: Column) -> Column:
    """A scale on which capacities that are close are little more than one apart: fives up to 250 MW, then 2 % steps."""
    size = F.abs(mw)
    return F.floor(F.signum(mw) * F.when(size <= 250, size / 5).otherwise(F.lit(50.0) + F.log(size / 250) / F.lit(0.02))).cast("long")


def _keys(prefix: str, kinds: Sequence[str]) -> Column:
    """What a pair must agree in besides a text, each kind one or several of: county (c), state (s), fuel (f), capacity
    close (w) or near (n); the earlier side has all that fits."""
    fuel, mw, county, state = (F.col(f"{prefix}{c}") for c in ("normalized_fuel_type", "capacity_mw", "county", "state"))
    fits = F.when(fuel == "Hybrid", F.array(*map(F.lit, ("Hybrid", "Solar", "Battery")))).when(fuel.isin("Solar", "Battery"), F.array(fuel, F.lit("Hybrid"))).otherwise(F.array(fuel))
    # close capacities are two bands apart at most, near ones six
    wide = lambda n: F.floor(_band(mw) / n)
    bands = lambda n: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: wide(n) + k) if prefix == "b_" else F.array(wide(n))
    named = lambda c: F.array(F.nullif(c, F.lit("")))
    lists = {"c": named(county), "s": named(state), "f": fits if prefix == "b_" else F.array(fuel), "w": bands(2), "n": bands(6)}

    def crossed(found: Column, values: Column) -> Column:
        values = F.filter(values.cast("array<string>"), lambda x: x.isNotNull())
        return F.flatten(F.transform(found, lambda x: F.transform(values, lambda y: F.concat(x, F.lit("|"), y))))

    return F.explode(F.concat(*(reduce(crossed, (lists[k] for k in kind), F.array(F.lit(kind))) for kind in kinds)))


def fuzzy_pairs(b: DataFrame, a: DataFrame) -> DataFrame:
    """Pairs of ``prefixed`` records that can score 0.53 or more without an equal queue id, and few others.

    By what the features add, such a pair has names of 0.90 and agrees in county, fuel or capacity; or entities of 0.85,
    names short of 0.90, and agrees in two of county, fuel and capacity, or in fuel, state and near capacity; or points of
    interconnection of 0.80, names of 0.75, and agrees in all three. Each is an equi-join on the similar texts and what
    must agree, so a common name or place alone gathers no pairs; and the features that are at hand must leave 0.53
    within reach. Entities and places, which are less alike, are only compared where those features agree.
    """
    f = F.col
    exact = lambda c, w: F.when(c, w).otherwise(0.0)
    at_hand = (
        exact(_equal(f("b_county"), f("a_county")), WEIGHTS["county"]) + exact(_equal(f("b_state"), f("a_state")), WEIGHTS["state"]) + exact(compatible_fuel(f("b_normalized_fuel_type"), f("a_normalized_fuel_type")), WEIGHTS["fuel"])
        + F.when(capacity_close(f("b_capacity_mw"), f("a_capacity_mw")), WEIGHTS["capacity"]).when(capacity_near(f("b_capacity_mw"), f("a_capacity_mw")), WEIGHTS["capacity_near"]).otherwise(0.0)
        + exact(F.coalesce(F.abs(F.datediff("b_target_cod", "a_target_cod")) <= 180, F.lit(False)), WEIGHTS["cod"])
    )
    other_id = ~_equal(f("b_queue_id"), f("a_queue_id"))

    def by(text: str, least: float, kinds: Sequence[str], reach: float, on: Sequence[str] = ("_key",)) -> DataFrame:
        earlier, later = b.withColumn("_key", _keys("b_", kinds)), a.withColumn("_key", _keys("a_", kinds))
        alike = similar_texts(earlier.select(f(f"b_{text}").alias("text"), *on), later.select(f(f"a_{text}").alias("text"), *on), least, on)
        alike = scratch.materialize(alike, "alike").select(*on, f("b_text").alias(f"b_{text}"), f("a_text").alias(f"a_{text}"))
        later = later.join(alike, [f"a_{text}", *on])
        return earlier.join(later, [f"b_{text}", "_key"]).where(other_id & (at_hand + reach >= MATTERS)).drop("_key")

    w = WEIGHTS
    found = by("normalized_project_name", 0.90, ("c", "f", "w"), w["name_close"] + w["entity"] + w["poi"], ())
    found = found.unionByName(by("entity_text", 0.85, ("cf", "cw", "fw", "fns"), w["name_near"] + w["entity"] + w["poi"]))
    found = found.unionByName(by("poi_text", 0.80, ("cfw",), w["name_near"] + w["poi"]))
    return found.dropDuplicates(["b_record_id", "a_record_id"])


def scored_pairs(before: DataFrame, after: DataFrame, mode: str = "blocked") -> DataFrame:
    """Scored pairs of records; ``before`` has entity_id besides the records' fields.

    Blocked: pairs of equal queue ids come first. A record that such a pair gives more than 0.81 is settled, as nothing
    without its id comes within the gap of that (0.76 at most); only the others are looked up by likeness.
    """
    b, a = prefixed(before, "b_", "entity_id"), prefixed(after, "a_")
    if mode == "exact":
        return score_pairs(b.join(a, F.lit(True)))
    if mode != "blocked":
        raise ValueError(f"unknown mode: {mode}")
    b = scratch.materialize(b, "earlier")
    same = score_pairs(b.join(a, (F.col("b_queue_id") == F.col("a_queue_id")) & (F.col("b_queue_id") != "")))
    same = scratch.materialize(same, "same-id")
    settled = same.where(F.col("match_score") > sum(WEIGHTS[k] for k in ("name_close", "entity", "county", "state", "fuel", "capacity", "poi", "cod")) + GAP + 1e-6).select("a_record_id")
    open_ = scratch.materialize(a.join(settled, "a_record_id", "left_anti"), "open")
    return same.unionByName(score_pairs(fuzzy_pairs(b, open_)))


def seed_links(records: DataFrame, method: str = "first_snapshot_seed") -> DataFrame:
    """Links of a market's first snapshot: every record is an entity of its own."""
    return records.select(
        "record_id", "snapshot_id", hashed_id("ent", "record_id").alias("entity_id"), F.lit(1.0).alias("match_score"), F.lit(method).alias("match_method"), F.lit(False).alias("is_ambiguous"),
        F.lit(None).cast("string").alias("candidate_record_id"), F.lit('{"reason":"first snapshot"}').alias("match_features"),
    )


def resolve_pair(before: DataFrame, before_links: DataFrame, after: DataFrame, mode: str = "blocked") -> DataFrame:
    """One link for each record of ``after``: to an entity of ``before``, to none (ambiguous), or to a new one.

    Candidates are the records behind unambiguous links. Of the records whose best candidate is the same entity the
    first by queue id and name gets it; the others don't try their second best and become new entities.
    """
    candidates = before.join(before_links.where(~F.col("is_ambiguous")).select("record_id", "entity_id"), "record_id")
    scored = scored_pairs(candidates, after, mode)
    order = Window.partitionBy("a_record_id").orderBy(F.desc("match_score"), F.asc_nulls_last("b_queue_id"), F.asc_nulls_last("b_project_name"), "b_record_id")
    best = scored.withColumn("_rank", F.row_number().over(order)).where("_rank <= 3")
    kept = F.struct("_rank", "match_score", "match_method", F.col("b_entity_id").alias("entity_id"), F.col("b_record_id").alias("record_id"), "match_features")
    top = best.groupBy(F.col("a_record_id").alias("record_id")).agg(F.array_sort(F.collect_list(kept)).alias("_top"))
    rows = after.join(top, "record_id", "left")
    first, second = F.try_element_at("_top", F.lit(1)), F.try_element_at("_top", F.lit(2))
    rows = rows.withColumns({"_first": first, "_second": second})
    enough = F.coalesce(F.col("_first.match_score") >= POSSIBLE, F.lit(False))
    rows = rows.withColumn("is_ambiguous", enough & F.coalesce(F.col("_first.match_score") - F.col("_second.match_score") <= GAP, F.lit(False)))
    wants = enough & ~F.col("is_ambiguous")
    rows = rows.withColumn("_wanted", F.when(wants, F.col("_first.entity_id")))
    turn = Window.partitionBy("_wanted").orderBy(F.asc_nulls_last("queue_id"), F.asc_nulls_last("project_name"), "record_id")
    # records that want nothing are spread over their own ids rather than gathered under null
    rows = rows.withColumn("_wanted", F.coalesce("_wanted", F.concat(F.lit("\x00"), "record_id"))).withColumn("_turn", F.row_number().over(turn))
    won = wants & (F.col("_turn") == 1)
    summary = F.to_json(F.struct(F.transform("_top", lambda x: F.struct(x["entity_id"].alias("entity_id"), x["record_id"].alias("record_id"), x["match_score"].alias("score"), x["match_method"].alias("method"))).alias("candidate_entities"), F.lit("candidates too close").alias("reason")))
    features = F.when(won, F.to_json("_first.match_features", {"ignoreNullFields": "false"})).when(F.col("is_ambiguous"), summary).otherwise(
        F.to_json(F.struct(F.lit("no candidate reached the threshold").alias("reason"), F.col("_first.entity_id").alias("best_entity_id"), F.col("_first.match_score").alias("best_score")))
    )
    return rows.select(
        "record_id", "snapshot_id", F.when(won, F.col("_first.entity_id")).otherwise(hashed_id("ent", "record_id")).alias("entity_id"),
        F.coalesce("_first.match_score", F.lit(0.0)).alias("match_score"),
        F.when(won, F.col("_first.match_method")).when(F.col("is_ambiguous"), "ambiguous_possible_match").otherwise("new_entity").alias("match_method"),
        "is_ambiguous", F.col("_first.record_id").alias("candidate_record_id"), features.alias("match_features"),
    )


def snapshot_order(records: DataFrame) -> list[str]:
    """A market's snapshot ids by date, then id: a handful of names, which the driver walks."""
    return [r["snapshot_id"] for r in records.select("snapshot_id", "snapshot_date").distinct().orderBy("snapshot_date", "snapshot_id").collect()]


def resolve_market(records: DataFrame, mode: str = "blocked", snapshots: Sequence[str] | None = None, first_method: str = "first_snapshot_seed") -> DataFrame:
    """Links of all of a market's records, snapshot after snapshot; each step only looks at the one just before it."""
    links, last, previous = None, None, None
    for snapshot in snapshots or snapshot_order(records):
        now = records.where(F.col("snapshot_id") == snapshot)
        step = seed_links(now, first_method) if previous is None else resolve_pair(records.where(F.col("snapshot_id") == previous), last, now, mode)
        last, previous = scratch.materialize(step, "links"), snapshot
        links = last if links is None else links.unionByName(last)
    return links


def entities(records: DataFrame, links: DataFrame) -> DataFrame:
    """Each entity's first and last date, and its attributes as its latest record has them."""
    latest = F.max_by(F.struct("project_name", "normalized_project_name", "county", "state", "normalized_fuel_type", "capacity_mw", "normalized_status"), F.struct("snapshot_date", "record_id"))
    return (
        links.select("record_id", "entity_id").join(records, "record_id").groupBy("entity_id")
        .agg(F.min("snapshot_date").alias("first_seen"), F.max("snapshot_date").alias("last_seen"), F.count("*").alias("records"), latest.alias("_latest"))
        .select("entity_id", "first_seen", "last_seen", "records", "_latest.*")
    )
