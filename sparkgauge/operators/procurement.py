"""Equipment scope, lead times and the procurement critical path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import month_age, slug

DAYS_PER_MONTH = 30.4375
STALE_MONTHS = 18
#: Confidence by rank, the lowest first.
CONFIDENCES = ("insufficient", "low", "medium", "high")
#: Equipment of each kind of project, in order; the second applies from 230 kV or 100 MW.
HIGH_VOLTAGE, LARGE_MW = 230.0, 100.0
_COMMON = ("Medium-Voltage Switchgear", "Protection / Control / Metering Package", "Interconnection Facilities", "Commissioning / Testing Package")
SCOPES = {
    "large_load": ("Large Power Transformer", "HV Switchgear / GIS", *_COMMON),
    "battery": ("GSU Transformer", "HV Switchgear / GIS", *_COMMON),
    "solar_storage": ("GSU Transformer", "HV Switchgear / GIS", *_COMMON),
}
KINDS = {
    "ai data center load": "large_load", "data center load": "large_load", "generic large load": "large_load", "large load": "large_load",
    "battery": "battery", "battery storage": "battery", "storage": "battery",
    "solar + storage": "solar_storage", "solar storage": "solar_storage", "hybrid": "solar_storage", "solar and storage": "solar_storage",
}
ONLY_LARGE = "HV Switchgear / GIS"


def _rank(confidence: Column) -> Column:
    """0 (insufficient) to 3 (high); 1 for anything else."""
    found = F.array_position(F.array(*(F.lit(c) for c in CONFIDENCES)), F.lower(F.coalesce(confidence, F.lit("low"))))
    return F.when(found > 0, found - 1).otherwise(1).cast("int")


def _named(rank: Column) -> Column:
    return F.try_element_at(F.array(*(F.lit(c) for c in CONFIDENCES)), F.coalesce(rank, F.lit(0)) + 1)


def equipment_scope(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, position, equipment_class, scope_item_id, source, scope_mode) from project_type, peak_mw and interconnection_voltage_kv.

    ``manual_equipment``, where there and not empty, stands as given: an array of class names, or of structs with
    equipment_class and, if they like, scope_item_id and explanation (blanks of these get defaults). A scenario with missing or
    non-positive inputs, or of an unknown kind, has one row without a class: mode insufficient_data.
    """
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.lower(F.trim("project_type")))
    table = F.create_map(*(x for k, items in SCOPES.items() for x in (F.lit(k), F.array(*(F.lit(i) for i in items)))))
    items = F.try_element_at(table, kind)
    large = (F.col("interconnection_voltage_kv") >= HIGH_VOLTAGE) | (F.col("peak_mw") >= LARGE_MW)
    items = F.when((F.col("peak_mw") > 0) & (F.col("interconnection_voltage_kv") > 0), F.filter(items, lambda i: (i != ONLY_LARGE) | large))
    none = F.lit(None).cast("string")
    item = lambda name, own=none, why=none: F.struct(name.cast("string").alias("equipment_class"), own.cast("string").alias("own_id"), why.cast("string").alias("why"))
    manual = F.lit(None).cast("array<struct<equipment_class:string,own_id:string,why:string>>")
    if "manual_equipment" in scenarios.columns:
        kind_of = scenarios.schema["manual_equipment"].dataType.elementType
        there = set(kind_of.fieldNames()) if isinstance(kind_of, StructType) else None
        field = lambda x, name: F.nullif(F.trim(x[name].cast("string")), F.lit("")) if name in there else none
        manual = F.transform("manual_equipment", (lambda x: item(x)) if there is None else lambda x: item(x["equipment_class"], field(x, "scope_item_id"), field(x, "explanation")))
    has_manual = F.coalesce(F.size(manual) > 0, F.lit(False))
    rows = scenarios.select("scenario_id", has_manual.alias("_manual"), F.posexplode_outer(F.when(has_manual, manual).otherwise(F.transform(items, lambda i: item(i)))).alias("position", "_item"))
    rows = rows.select("scenario_id", "_manual", "position", "_item.*")
    return rows.select(
        "scenario_id", "position", "equipment_class",
        F.when(F.col("_manual"), F.coalesce("own_id", F.concat(F.lit("manual_"), (F.col("position") + 1).cast("string")))).otherwise(F.concat(F.lit("scope_"), slug("equipment_class"))).alias("scope_item_id"),
        F.when(F.col("_manual"), "manual_user_selected").when(F.col("equipment_class").isNotNull(), "deterministic_planning_model").alias("source"),
        F.when(F.col("_manual"), "manual_user_selected").when(F.col("equipment_class").isNull(), "insufficient_data").otherwise("generated_planning_model").alias("scope_mode"),
        F.when(F.col("_manual"), F.coalesce("why", F.lit("Given by hand."))).when(F.col("equipment_class").isNotNull(), "From the planning model of this kind of project.").alias("explanation"),
    )


def lead_times(rows: DataFrame, as_of: Column | str) -> DataFrame:
    """Lead-time rows with is_stale (by each row's own threshold) and conflict_flag (another range for its class and band)."""
    today = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    same = Window.partitionBy("equipment_class", "voltage_or_rating_band")
    return rows.withColumns(
        {
            "is_stale": F.coalesce(month_age("as_of_date", today) >= F.col("stale_threshold_months"), F.lit(False)),
            "conflict_flag": F.size(F.collect_set(F.struct("lead_time_low_months", "lead_time_high_months")).over(same)) > 1,
        }
    )


def class_ranges(rows: DataFrame) -> DataFrame:
    """By class: the widest range, the lowest confidence (as a rank), the number of rows, and whether they are stale or differ."""
    return rows.groupBy("equipment_class").agg(
        F.min("lead_time_low_months").alias("lead_time_low_months"), F.max("lead_time_high_months").alias("lead_time_high_months"), F.min(_rank(F.col("confidence"))).alias("_rank"),
        F.bool_or("is_stale").alias("is_stale"), (F.count_distinct("lead_time_low_months", "lead_time_high_months") > 1).alias("conflict"), F.count("*").alias("rows"),
    )


def critical_path(scope: DataFrame, lead: DataFrame, as_of: str, stale_months: int = STALE_MONTHS) -> DataFrame:
    """One row per scenario: the binding class, its range in days, confidence, and the stale, conflict and unsupported flags.

    Rows without a source or a date don't count. Binding is the class with the latest end, then the lower confidence,
    then the earlier in the scope. Staleness here is by the request's threshold. Lead times are gathered by class before
    they meet the scopes, so the join has a row for each scoped class, however many rows a class has.
    """
    items = scope.where("equipment_class is not null").groupBy("scenario_id", "equipment_class").agg(F.min("position").alias("position"))
    usable = (F.coalesce(F.col("source_url"), F.lit("")) != "") & F.col("as_of_date").isNotNull()
    ranges = class_ranges(lead.where(usable).withColumn("is_stale", month_age("as_of_date", F.to_date(F.lit(as_of))) >= stale_months))
    there = F.col("rows").isNotNull()
    path = items.join(ranges, "equipment_class", "left").groupBy("scenario_id").agg(
        F.max(F.when(there, F.struct(F.col("lead_time_high_months").alias("high"), (-F.col("_rank")).alias("risk"), (-F.col("position")).alias("p"), F.col("equipment_class").alias("cls"), F.col("lead_time_low_months").alias("low")))).alias("_best"),
        F.min("_rank").alias("_rank"), F.bool_or("is_stale").alias("stale_flag"), F.bool_or("conflict").alias("conflict_flag"), F.sum("rows").alias("lead_time_rows"),
        F.array_sort(F.collect_set(F.when(~there, F.col("equipment_class")))).alias("missing_equipment"),
    )
    rows = scope.select("scenario_id").distinct().join(path, "scenario_id", "left")
    none = F.col("_best").isNull()
    return rows.select(
        "scenario_id", F.col("_best.cls").alias("binding_equipment_class"), F.col("_best.low").alias("binding_lead_time_low_months"), F.col("_best.high").alias("binding_lead_time_high_months"),
        F.round(F.col("_best.low") * DAYS_PER_MONTH, 2).alias("procurement_low_days"), F.round(F.col("_best.high") * DAYS_PER_MONTH, 2).alias("procurement_high_days"),
        F.when(none, "insufficient").otherwise(_named(F.col("_rank"))).alias("procurement_confidence"), F.coalesce("stale_flag", F.lit(False)).alias("stale_flag"), F.coalesce("conflict_flag", F.lit(False)).alias("conflict_flag"),
        none.alias("unsupported_flag"), F.coalesce("missing_equipment", F.array().cast("array<string>")).alias("missing_equipment"), F.coalesce("lead_time_rows", F.lit(0)).alias("lead_time_rows"),
    )


def missing_classes(scope: DataFrame, lead: DataFrame) -> DataFrame:
    """Scoped classes without any lead-time row."""
    return scope.where("equipment_class is not null").select("equipment_class").distinct().join(lead.select("equipment_class"), "equipment_class", "left_anti")


def scope_table(spark: SparkSession) -> DataFrame:
    """The planning scopes as a table: kind, position, class, and whether it is for large projects only."""
    return spark.createDataFrame([(k, i, c, c == ONLY_LARGE) for k, items in SCOPES.items() for i, c in enumerate(items)], "kind string, position int, equipment_class string, only_large boolean")
