"""Bed stays, hourly occupancy, and the occupancy timeline of each bed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.ordered import HotKeys, ordered_rows
from wardline.sources.tables import materialize

BED = ["department_key", "bed_number"]


def hourly_slots(lo: Column, hi: Column) -> Column:
    """The hours from ``lo`` to ``hi``, both on the hour and included, one row each."""
    return F.explode(F.sequence(lo, hi, F.expr("interval 1 hour")))


def _beds_of_encounters(events: DataFrame) -> DataFrame:
    """One row per encounter and bed it ever had: when it was taken, the encounter's last discharge, the latest event.

    Events are dealt by encounter once, which serves the grouping and the window over the encounter.
    """
    at = F.col("event_timestamp")
    own = events.select("encounter_key", *BED, "event_type", "event_timestamp").repartition("encounter_key")
    per_bed = own.groupBy("encounter_key", *BED).agg(
        F.min(F.when(F.col("event_type") == "bed_assigned", at)).alias("assigned_at"),
        F.max(F.when(F.col("event_type") == "bed_discharged", at)).alias("_out"),
        F.max(at).alias("latest"),
    )
    out = F.max("_out").over(Window.partitionBy("encounter_key"))
    return per_bed.withColumn("discharged_at", F.when(F.col("encounter_key").isNotNull(), out)).drop("_out")


def bed_stays(events: DataFrame) -> DataFrame:
    """Stays: a bed with the time it was taken and, if known, the last discharge of its encounter."""
    found = _beds_of_encounters(events).where(F.col("assigned_at").isNotNull())
    return found.select("encounter_key", *BED, "assigned_at", "discharged_at")


def _hour_mask(lo: Column, hi: Column) -> Column:
    """Bits lo..hi of a day's 24 hours."""
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, (hi + 1).cast("int")) - F.call_function("shiftleft", one, lo.cast("int"))


def _masks(first: Column, last: Column) -> Column:
    """The days from ``first`` to ``last`` hour as an array of (day, hours of it as bits); empty if they are out of order."""
    days = F.sequence(X.day(first), X.day(last), F.expr("interval 1 day"))

    def of_day(day: Column) -> Column:
        lo = F.when(day == X.day(first), F.hour(first)).otherwise(0)
        hi = F.when(day == X.day(last), F.hour(last)).otherwise(23)
        return F.struct(day.alias("day"), _hour_mask(lo, hi).alias("hours"))

    return F.when(first <= last, F.transform(days, of_day))


def bed_utilization(events: DataFrame, departments: DataFrame) -> DataFrame:
    """Occupied beds per department and hour, for hours with at least one.

    A stay covers the full hours h with assigned <= h < discharged; an open stay runs to the
    department's last event hour. Events are read and dealt once: stays become bit sets of hours per bed
    and day, combined by bitwise OR, and beside these one row per bed keeps its earliest open stay and its
    latest event. That table, one row per bed and day, is stored; the rest, open stays among it, reads
    it. Two patients in one bed count once.
    """
    found = _beds_of_encounters(events)
    floor = X.trunc_ntz("hour", "assigned_at")
    first = F.when(floor == F.col("assigned_at"), floor).otherwise(X.shift(floor, hours=1))
    before_end = F.timestamp_add("MICROSECOND", F.lit(-1), F.col("discharged_at")).cast("timestamp_ntz")
    stays = found.select(
        *BED, "latest", first.alias("first_slot"), X.trunc_ntz("hour", before_end).alias("last_slot"),
        (F.col("assigned_at").isNotNull() & F.col("discharged_at").isNull()).alias("open"),
    )
    own = F.struct(F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("hours"))
    entries = F.concat(F.array(own), F.coalesce(_masks(F.col("first_slot"), F.col("last_slot")), F.array().cast("array<struct<day:date,hours:bigint>>")))
    rows = stays.select(*BED, "latest", F.when(F.col("open"), F.col("first_slot")).alias("open_from"), F.explode(entries).alias("e"))
    of_bed = F.col("e.day").isNull()
    table = rows.groupBy(*BED, F.col("e.day").alias("day")).agg(
        F.bit_or("e.hours").alias("hours"), F.min(F.when(of_bed, F.col("open_from"))).alias("open_from"),
        F.max(F.when(of_bed, F.col("latest"))).alias("latest"),
    )
    table = materialize(table, "bed-days")
    beds = table.where("day IS NULL")
    bounds = beds.groupBy("department_key").agg(X.trunc_ntz("hour", F.max("latest")).alias("last_hour"))
    still_open = beds.where("open_from IS NOT NULL").join(bounds, "department_key")
    still_open = still_open.select(*BED, F.explode(_masks(F.col("open_from"), F.col("last_hour"))).alias("e")).select(*BED, "e.day", "e.hours")
    masks = table.where("day IS NOT NULL").select(*BED, "day", "hours").unionByName(still_open)
    masks = masks.groupBy(*BED, "day").agg(F.bit_or("hours").alias("hours"))
    per_hour = [F.sum(F.call_function("shiftright", F.col("hours"), F.lit(h)).bitwiseAND(F.lit(1).cast("bigint"))) for h in range(24)]
    counts = masks.groupBy("department_key", "day").agg(F.array(*per_hour).alias("_beds"))
    hours = counts.select("department_key", "day", F.posexplode("_beds").alias("hour", "occupied_beds"))
    slot = F.timestamp_add("HOUR", F.col("hour"), F.col("day").cast("timestamp_ntz")).cast("timestamp_ntz")
    return (
        hours.where(F.col("occupied_beds") > 0)
        .join(bounds, "department_key")
        .where(slot <= F.col("last_hour"))
        .join(departments.select("department_key", "department_name", "bed_capacity"), "department_key")
        .select(
            "department_name", F.col("day").alias("slot_date"), F.col("hour").cast("bigint").alias("hour"),
            "occupied_beds", "bed_capacity",
            F.round(X.ratio("occupied_beds", "bed_capacity") * 100, 1).alias("occupancy_rate_pct"),
        )
    )


def bed_timeline(events: DataFrame, departments: DataFrame, n: int | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Occupancy level of each bed after each event.

    The first event of a bed sets level 1; later ones add or take one. There are few beds, so
    each holds a large share of all events and is cut into day slices.
    """
    delta = F.when(F.col("event_type") == "bed_assigned", 1).when(F.col("event_type") == "bed_discharged", -1).otherwise(0)
    rows = events.select(*BED, "event_timestamp", "bed_event_key", "event_type", "encounter_key")
    levels = ordered_rows(
        rows, BED, ["event_timestamp", "bed_event_key"], running={"_sum": delta}, at_first={"_first": delta}, hot=hot
    )
    out = levels.withColumn("occupancy_level", 1 + F.col("_sum") - F.col("_first")).join(
        departments.select("department_key", "department_name"), "department_key"
    )
    out = out.select(
        "department_key", "department_name", "bed_number", "event_timestamp", "bed_event_key", "event_type",
        "encounter_key", "occupancy_level",
        F.when(F.col("occupancy_level") > 0, "Occupied").otherwise("Available").alias("bed_status"),
    )
    return out if n is None else out.orderBy(*BED, "event_timestamp", "bed_event_key").limit(n)


def first_event_per_bed(events: DataFrame) -> DataFrame:
    """Events at the earliest time of their bed, ties included.

    The earliest times are joined back on (bed, time), which spreads the events of a bed.
    """
    earliest = events.groupBy(*BED).agg(F.min("event_timestamp").alias("event_timestamp"))
    return events.join(earliest, [*BED, "event_timestamp"], "left_semi").select(
        *BED, "event_timestamp", "bed_event_key", "event_type", "encounter_key"
    )
