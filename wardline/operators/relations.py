"""Joins that need more than an equality: orphans, as-of state, visits within a time range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.ordered import HotKeys, next_two_targets
from wardline.sources.tables import materialize


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent, a NULL key included."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def existing_rows(target: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Target rows whose key is on the list. The list is made distinct first, also on the map side."""
    return target.join(wanted.select(key).distinct(), key, "left_semi")


def temporal_join(facts: DataFrame, dim: DataFrame, key: str, time_col: str) -> DataFrame:
    """Facts with the dimension versions valid at their time (begun by then, not yet ended).

    A version stands once in every year it covers, clipped to the years of the facts, and facts
    meet it by key and year; the exact range decides. That is the plain range join on any data,
    overlapping versions included, but a key with very many facts or versions is dealt by years,
    and large partitions of the join can be split.
    """
    at = F.col(time_col)
    own = facts.where(F.col(key).isNotNull() & at.isNotNull())
    # Without facts both bounds are NULL, and no version covers a year.
    first = own.agg(F.min(F.year(at))).scalar()
    last = own.agg(F.max(F.year(at))).scalar()
    low = F.when(first.isNotNull(), F.greatest(F.year("valid_from"), first))
    high = F.when(last.isNotNull(), F.least(F.year("valid_to"), last))
    versions = dim.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    versions = versions.withColumn("_year", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    met = own.withColumn("_year", F.year(at)).join(versions, [key, "_year"])
    met = met.where((F.col("valid_from") <= at) & (at < F.col("valid_to")))
    return met.drop("_year")


def readmitted_flag(
    encounters: DataFrame, days: int = 30, name: str = "readmitted_30d", hot: HotKeys | None = None
) -> DataFrame:
    """1 where another visit of the patient begins within ``days`` of the discharge, else 0.

    Each discharge looks for the first admission at or after it that is not its own: a stay that ends
    before it begins (rule-breaking data) may find its own, and then the one behind that decides. A visit
    without an admission time is kept: its discharge looks on like any other.
    """
    columns = encounters.columns
    found = next_two_targets(
        encounters, encounters, ["patient_id"], "discharge_date", "admission_date", ["encounter_key"], hot=hot
    ).where("is_probe")
    own = F.col("hit.encounter_key").eqNullSafe(F.col("encounter_key"))
    time = F.when(own, F.col("behind.time")).otherwise(F.col("hit.time"))
    # A visit without a patient has no other visits: NULL equals nothing.
    within = (time <= X.shift("discharge_date", days=days)) & F.col("patient_id").isNotNull()
    return found.select(*columns, F.coalesce(within, F.lit(False)).cast("int").alias(name))


def chain_roots(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows (node, root, depth) of a forest given by the parent of each node, NULL for a root.

    Pointer doubling: each round every node takes over its pointer's pointer, so chains of any depth
    need a logarithmic number of rounds, each a stored table. A parent that is no node is a root
    itself. Nodes have to be unique; a cycle is an error.
    """
    up = F.coalesce(F.col(parent), F.col(node))
    now = materialize(rows.select(F.col(node).alias("node"), up.alias("root"), F.col(parent).isNotNull().cast("bigint").alias("depth")), "chain")
    rounds, most = 0, now.count().bit_length() + 1
    while True:
        # Only pointers that do not yet end at a root move on; the others are not looked up.
        ahead = now.where("depth > 0").select(F.col("node").alias("_n"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        hopped = now.join(ahead, F.col("root") == F.col("_n"), "left")
        now = materialize(hopped.select(
            "node", F.coalesce("_r", "root").alias("root"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.col("_n").isNotNull().alias("moved"),
        ), "chain")
        if now.where("moved").limit(1).count() == 0:
            return now.select("node", "root", "depth")
        rounds += 1
        if rounds > most:
            raise ValueError(f"{parent} leads in a circle")
