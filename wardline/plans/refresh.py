"""The five views kept up to date by change.

A refresh after a load reads the rows that were loaded, and of the stored facts the days or weeks they
touch. What a view needs beyond that is kept as additive partial tables, one piece per load:

* by day and by week: touched days and weeks are computed anew, all others are taken over;
* by department and by complaint: sums and counts, and how often each patient, length of stay and bed
  occurs, from which different patients, medians and beds follow exactly;
* demographics have no fact and are computed from the current patients.

A view is written to a new folder and readers are switched over by ``Pointer`` when all are finished,
so nobody sees a half refreshed set or waits for one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import exprs as X
from wardline.operators.quantiles import HOUR_US, attach_quantiles, quantiles_of_counts
from wardline.plans import marts
from wardline.sources.stored import Pointer, StoredFact

COMPACT_FROM = 16
DAY, WEEK = "metric_date", "week_start"


def _sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive figures of visits: seconds and the rest of stays apart, so that sums are exact."""
    us = F.col("los_us")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("visits"), F.count("encounter_key").alias("keyed"), X.count_type("Emergency").alias("emergency"),
        F.count("discharge_date").alias("discharged"), F.count(us).alias("stays"),
        F.sum(F.call_function("div", us, F.lit(1_000_000))).alias("seconds"), F.sum(us % 1_000_000).alias("rest"),
    )


def _mean_days() -> Column:
    seconds = F.sum("seconds") + F.sum("rest") / F.lit(1e6)
    return seconds / F.nullif(F.sum("stays"), F.lit(0)) / F.lit(86400.0)


def _occurrences(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


# Partial tables by name: the fact, what one load adds, and its keys.
PARTIALS = {
    "department_sums": ("visits", lambda v: _sums(v, ["department_key"])),
    "department_patients": ("visits", lambda v: _occurrences(v, ["department_key", "patient_key"])),
    "department_stays": ("visits", lambda v: _occurrences(v, ["department_key", "los_us"])),
    "department_beds": ("beds", lambda b: _occurrences(b, ["department_key", "bed_number"])),
    "complaint_sums": ("visits", lambda v: _sums(v, ["chief_complaint"])),
    "complaint_patients": ("visits", lambda v: _occurrences(v, ["chief_complaint", "patient_key"])),
}
NEEDS = {
    "mv_daily_hospital_snapshot": [], "mv_weekly_trends": [], "mv_patient_demographics": [],
    "mv_department_performance": [n for n in PARTIALS if n.startswith("department")],
    "mv_top_complaints": [n for n in PARTIALS if n.startswith("complaint")],
}


def _different(pieces: DataFrame, group: str, member: str, name: str) -> DataFrame:
    """Different non-NULL members of each group; pieces hold a pair once each, so pairs meet again first."""
    pairs = pieces.groupBy(group, member).agg(F.lit(1).alias("one"))
    return pairs.groupBy(group).agg(F.count(member).alias(name))


class ViewStore:
    """Views of stored facts below a folder; ``names`` of them, all five by default."""

    def __init__(
        self, spark: SparkSession, folder: str, visits: StoredFact, beds: StoredFact, departments: DataFrame, physicians: DataFrame,
        patients: DataFrame, as_of: str, names: Sequence[str] = tuple(marts.VIEWS),
    ):
        self.spark, self.folder, self.visits, self.beds = spark, folder, visits, beds
        self.departments, self.physicians, self.patients, self.as_of = departments, physicians, patients, as_of
        self.names, self.pointer = list(names), Pointer(spark, folder)

    def read(self, name: str) -> DataFrame:
        """The view as of the newest finished refresh."""
        return self._open(self.pointer.newest()[1][name])

    def _open(self, paths: Sequence[str]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.folder}/{path}") for path in paths]
        return reduce(DataFrame.unionByName, parts)

    def _write(self, df: DataFrame, name: str, number: int) -> str:
        path = f"{name}/version={number}"
        df.write.mode("overwrite").parquet(f"{self.folder}/{path}")
        return path

    def load(self, visits: DataFrame, beds: DataFrame) -> None:
        """Adds rows to the facts and brings the views up to date with them."""
        self.visits.load(visits)
        self.beds.load(beds)
        self.refresh(visits, beds)

    def refresh(self, visits: DataFrame, beds: DataFrame) -> int:
        """Brings the views up to date with rows that have been added to the facts; returns the new version."""
        number, known = self.pointer.newest()
        number += 1
        tables = dict(known)
        rows = {"visits": visits.withColumn("los_us", X.los_us()), "beds": beds}
        for name in dict.fromkeys(p for view in self.names for p in NEEDS[view]):
            source, build = PARTIALS[name]
            pieces = [*known.get(name, []), self._write(build(rows[source]), name, number)]
            if len(pieces) > COMPACT_FROM:
                pieces = [self._write(self._added_up(self._open(pieces)), f"{name}/together", number)]
            tables[name] = pieces
        days = set()
        if {"mv_daily_hospital_snapshot", "mv_weekly_trends"} & set(self.names):
            touched = visits.select(X.day("admission_date").alias("d")).union(beds.select(X.day("event_timestamp").alias("d")))
            days = {r.d for r in touched.distinct().collect()}  # one value per day of the load
        for name in self.names:
            built = getattr(self, f"_{name}")(tables, known, days)
            for table, df in built.items():
                tables[table] = [self._write(df, table, number)]
        self.pointer.swap(number, tables)
        return number

    @staticmethod
    def _added_up(pieces: DataFrame) -> DataFrame:
        figures = [c for c in pieces.columns if c in ("n", "visits", "keyed", "emergency", "discharged", "stays", "seconds", "rest")]
        keys = [c for c in pieces.columns if c not in figures]
        return pieces.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in figures])

    # -- the views, each as tables by name --

    def _kept(self, known: Mapping[str, list[str]], table: str, day: str, touched: set) -> DataFrame | None:
        if table not in known:
            return None
        old = self._open(known[table])
        inside = F.col(day).cast("date").isin(sorted(d for d in touched if d is not None)) if touched - {None} else F.lit(False)
        lost = F.col(day).isNull() if None in touched else F.lit(False)
        return old.where(~F.coalesce(inside, F.lit(False)) & ~lost)

    def _mv_daily_hospital_snapshot(self, tables, known, days) -> dict[str, DataFrame]:
        fresh = marts.mv_daily_hospital_snapshot(_of_days(self.visits, days), _of_days(self.beds, days))
        old = self._kept(known, "mv_daily_hospital_snapshot", DAY, days)
        return {"mv_daily_hospital_snapshot": fresh if old is None else fresh.unionByName(old)}

    def _mv_weekly_trends(self, tables, known, days) -> dict[str, DataFrame]:
        mondays = {d if d is None else d - timedelta(days=d.weekday()) for d in days}
        every = {d if d is None else d + timedelta(days=k) for d in mondays for k in range(7)}
        fresh = marts.weekly_figures(_of_days(self.visits, every))
        old = self._kept(known, "weekly_figures", WEEK, mondays)
        figures = fresh if old is None else fresh.unionByName(old)
        return {"weekly_figures": figures, "mv_weekly_trends": marts.weekly_view(figures)}

    def _mv_patient_demographics(self, tables, known, days) -> dict[str, DataFrame]:
        return {"mv_patient_demographics": marts.mv_patient_demographics(self.patients, self.as_of)}

    def _mv_department_performance(self, tables, known, days) -> dict[str, DataFrame]:
        key = "department_key"
        sums = self._open(tables["department_sums"]).groupBy(key).agg(
            F.sum("keyed").alias("encounters"), _mean_days().alias("avg_los"), F.sum("emergency").alias("emergency"),
            F.sum("discharged").alias("discharged"),
        )
        counts = self._open(tables["department_stays"]).groupBy(key, F.col("los_us").alias("_v")).agg(F.sum("n").alias("_c"))
        counts = counts.withColumn("_bin", F.floor(F.col("_v") / HOUR_US))
        median = quantiles_of_counts(counts, [key], {"median_los": 0.5}, X.US_PER_DAY)
        people = _different(self._open(tables["department_patients"]), key, "patient_key", "patients")
        visits = attach_quantiles(attach_quantiles(sums, people, [key]), median, [key])
        beds = _different(self._open(tables["department_beds"]), key, "bed_number", "beds")
        return {"mv_department_performance": marts.department_view(self.departments, visits, beds, self.physicians)}

    def _mv_top_complaints(self, tables, known, days) -> dict[str, DataFrame]:
        key = "chief_complaint"
        sums = self._open(tables["complaint_sums"])
        groups = sums.groupBy(key).agg(
            F.sum("visits").alias("encounter_count"), X.round_n(_mean_days(), 2).alias("avg_los_days"), F.sum("emergency").alias("emergency_count"),
        )
        people = _different(self._open(tables["complaint_patients"]), key, "patient_key", "unique_patients")
        groups = attach_quantiles(groups, people, [key]).select(
            key, "encounter_count", F.coalesce("unique_patients", F.lit(0)).alias("unique_patients"), "avg_los_days", "emergency_count"
        )
        return {"mv_top_complaints": marts.complaint_view(groups, sums.agg(F.sum("visits")).scalar())}


def _of_days(fact: StoredFact, days: set) -> DataFrame:
    found = fact.days(d for d in days if d is not None)
    if None in days:
        found = found.unionByName(fact.read().where(F.col(fact.time).isNull()))
    return found
