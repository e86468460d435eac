"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree (say domain, language, source). Siblings share their parent's budget by weight, but
none gets more than its subtree can give (its tokens times the epochs allowed); what one can't use goes to its siblings,
and only what all of them can't use is missing from their parent, whose own siblings get it. Each leaf then takes whole
epochs, and of the last one a prefix, by tokens, of a seeded order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of the order key that name a bucket, and those that name a bucket's parts: 256 of each. Only the
#: rows of the part where a prefix ends are sorted.
DIGITS = 2
_NUMBER = "decimal(38,0)"


@dataclass(frozen=True)
class Level:
    """A level of the tree: its column, and its nodes' integer weights (``default`` for those not named; 0 takes nothing)."""

    column: str
    weights: Mapping[str, int] = field(default_factory=dict)
    default: int = 1

    def weight(self) -> Column:
        found = F.lit(self.default)
        for name, weight in self.weights.items():
            found = F.when(F.col(self.column) == name, weight).otherwise(found)
        return found.cast(_NUMBER)


def n_tokens(text: Column | str = "text") -> Column:
    """The tokens of the budget: words (runs of other than white space); null has none."""
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[Level], budget_share: float, max_epochs: int) -> DataFrame:
    """(level columns, available, budget) of each leaf, from its ``available`` tokens.

    Siblings are filled like vessels: in the order of capacity per weight, each is full if its capacity is at most its
    share of what those before it left. That needs one sorted window a level, whatever the number of nodes, and exact
    whole numbers; the fractions of tokens that siblings lose by rounding down are not handed out.
    """
    columns = [v.column for v in levels]
    leaves = leaves.withColumn("_cap", (F.col("available") * max_epochs).cast(_NUMBER))
    parent = leaves.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)) * F.lit(float(budget_share))).cast(_NUMBER).alias("_budget"), F.lit(0).alias("_root"))
    for k, level in enumerate(levels):
        above = columns[:k]
        nodes = leaves.groupBy(*columns[: k + 1]).agg(F.sum("_cap").cast(_NUMBER).alias("_cap")).withColumn("_w", level.weight())
        nodes = nodes.join(parent, above) if above else nodes.withColumn("_root", F.lit(0)).join(parent, "_root")
        nodes = nodes.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap").cast("double") / F.col("_w").cast("double")))
        order = Window.partitionBy(*above).orderBy(F.col("_ratio").asc_nulls_last(), F.col(level.column))
        upto = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(0, Window.unboundedFollowing)
        nodes = nodes.withColumns({"_left": (F.col("_budget") - F.coalesce(F.sum("_cap").over(upto), F.lit(0))).cast(_NUMBER), "_open": F.sum("_w").over(onward).cast(_NUMBER)})
        nodes = nodes.withColumn("_full", (F.col("_w") > 0) & (F.col("_cap") * F.col("_open") <= F.col("_w") * F.col("_left")))
        every = Window.partitionBy(*above)
        taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0))
        weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(every)
        nodes = nodes.withColumns({"_rest": (F.col("_budget") - taken).cast(_NUMBER), "_weight": weight.cast(_NUMBER)})
        share = F.expr("(_w * _rest) div _weight").cast(_NUMBER)
        given = F.when(F.col("_w") <= 0, F.lit(0)).when(F.col("_full"), F.col("_cap")).otherwise(F.least(share, F.col("_cap")))
        parent = nodes.select(*columns[: k + 1], given.cast(_NUMBER).alias("_budget"))
    return leaves.join(parent, columns).select(*columns, "available", F.col("_budget").cast("long").alias("budget"))


def order_key(key: str, seed: int, epoch: str) -> Column:
    """The seeded order of an epoch: an MD5 of seed, epoch and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), F.col(key)))


def _ends(rows: DataFrame, leaf: str, cut: DataFrame, at: int) -> DataFrame:
    """(leaf, _from, _rest, _rows): the bucket of each leaf's rows (digits from ``at``) in which ``_rest`` tokens end."""
    sums = rows.join(cut, leaf).groupBy(leaf, "_rest", F.substring("_order", at, DIGITS).alias("_bucket")).agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy(leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before + _n > _rest")
    return sums.groupBy(leaf).agg(F.min(F.struct("_bucket", (F.col("_rest") - F.col("_before")).alias("_rest"))).alias("_cut")).select(leaf, F.col("_cut._bucket").alias("_bucket"), F.col("_cut._rest").alias("_rest"))


def mix(docs: DataFrame, levels: Sequence[Level], budget_share: float = 0.8, max_epochs: int = 2, seed: int = 7, key: str = "doc_id", tokens: str | Column = "_tokens") -> DataFrame:
    """The rows of ``docs`` (all its columns) that are taken, with ``_epoch`` (from 0); a row taken twice is there twice.

    ``tokens`` is a column of whole numbers, the level columns are strings; null in any of these counts as 0 or "".
    ``budget_share`` is the budget as a share of all tokens. A prefix takes rows in order as long as their tokens fit;
    rows of one key stand by their tokens, and those with the same tokens too are taken together or not at all. Rows
    without tokens cost nothing, and come along where a prefix or a whole epoch reaches them. A leaf of weight 0 gives
    nothing; an empty table gives an empty result. A column ``_epoch`` of ``docs`` is replaced; any other name can't clash.
    Tokens are counted once and written with the order, without texts; ``docs`` is then read once more. Siblings of one
    parent are sorted in one task (slim rows, one a node). Tables that grow with the number of leaves are joined by
    whatever way Spark finds their written size allows.
    """
    columns = [v.column for v in levels]
    at = [f"l{i}" for i in range(len(columns))]
    inner = [Level(a, v.weights, v.default) for a, v in zip(at, levels, strict=True)]
    named = lambda df: df.select(*(F.col(f"_leaf.{a}").alias(a) for a in at), *(c for c in df.columns if c != "_leaf"))
    leaf = F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in zip(columns, at, strict=True)))
    count = F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(0)).cast("long")
    slim = common.materialize(docs.select(leaf.alias("_leaf"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), count.alias("_n")), "mixing-rows")
    leaves = common.materialize(named(slim.groupBy("_leaf").agg(F.sum("_n").alias("available"))), "mixing-leaves")
    plan = common.materialize(
        budgets(leaves, inner, budget_share, max_epochs).select(
            F.struct(*at).alias("_leaf"), F.when(F.col("available") > 0, F.expr("budget div available")).otherwise(0).cast("int").alias("_whole"),
            F.when(F.col("available") > 0, F.expr("budget % available")).otherwise(0).cast("long").alias("_part"),
        ),
        "mixing-plan",
    )
    ordered = slim.join(plan.where("_part > 0").select("_leaf", "_whole"), "_leaf").select("_leaf", order_key("_key", seed, "_whole").alias("_order"), "_n")
    first = common.materialize(_ends(ordered, "_leaf", plan.where("_part > 0").select("_leaf", F.col("_part").alias("_rest")), 1), "mixing-cuts")
    within = common.materialize(ordered.join(first.select("_leaf", "_bucket"), "_leaf").where(F.substring("_order", 1, DIGITS) == F.col("_bucket")).drop("_bucket"), "mixing-edge")
    second = common.materialize(_ends(within, "_leaf", first.select("_leaf", "_rest"), DIGITS + 1).withColumnRenamed("_bucket", "_then"), "mixing-cuts")
    last = within.join(second, "_leaf").where(F.substring("_order", DIGITS + 1, DIGITS) == F.col("_then"))
    # the frame takes in all rows of the same order and tokens
    upto = Window.partitionBy("_leaf").orderBy("_order", "_n").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = last.withColumn("_sum", F.sum("_n").over(upto)).where("_sum <= _rest").groupBy("_leaf").agg(F.max(F.struct("_order", "_n")).alias("_end"))
    cuts = first.join(second.drop("_rest"), "_leaf").join(ends, "_leaf", "left").select("_leaf", F.concat("_bucket", "_then").alias("_upto"), "_end")
    plan = common.materialize(plan.join(cuts, "_leaf", "left"), "mixing-plan").where("_whole > 0 or _part > 0")
    rows = docs.select(common.whole(docs).alias("_all"), leaf.alias("_leaf"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), count.alias("_n")).join(plan, "_leaf")
    rows = rows.withColumn("_order", F.when(F.col("_part") > 0, order_key("_key", seed, "_whole")))
    start = F.substring("_order", 1, 2 * DIGITS)
    inside = F.col("_upto").isNull() | (start < F.col("_upto")) | ((start == F.col("_upto")) & ((F.col("_order") < F.col("_end._order")) | ((F.col("_order") == F.col("_end._order")) & (F.col("_n") <= F.col("_end._n")))))
    epochs = F.col("_whole") + F.when((F.col("_part") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    taken = rows.withColumn("_epochs", epochs).where("_epochs > 0").select("_all", F.explode(F.sequence(F.lit(0), F.col("_epochs") - 1)).alias("_epoch"))
    return taken.select(*(F.col("_all").getField(c).alias(c) for c in docs.columns if c != "_epoch"), F.col("_epoch").cast("int"))


#: The tree of the query and of the pipeline: domains are made of the sources' numbers.
DOMAINS = Level("domain", {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
LANGUAGES = Level("lang", {"en": 5, "de": 2, "fr": 2, "es": 1})
SOURCES = Level("source")
TREE = (DOMAINS, LANGUAGES, SOURCES)


def domain(source: str = "source") -> Column:
    """``d0`` to ``d3`` by the number at the end of a source's name, ``other`` without one."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.try_cast("int") % 4).cast("string"))).otherwise(F.lit("other"))
