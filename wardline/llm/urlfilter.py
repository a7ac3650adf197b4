"""URL filters as a temporal list join.

Dated list events (an entry is added or removed on a day) become validity intervals. A capture is
looked up by all keys its URL answers to (its host, every parent domain, every path prefix) and
matches the entries whose interval holds its fetch time: an as-of join, so a list change never acts
on captures made before it.

Nulls: a URL that is null or has no host, and a capture without a fetch time, match nothing and are
kept. Events with a null part are left out. Of several events of an entry on one day the addition
counts. A removal of what is not listed does nothing. Repeated captures are judged each. Empty
captures give an empty result, an empty list blocks nothing. Other columns are kept under ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
HOST, DOMAIN, PATH = "host", "domain", "path"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and closing dot; empty where there is none."""
    found = F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.lower(F.regexp_replace(F.coalesce(found, F.lit("")), r"\.$", ""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SCHEME + r"[^/?#]*(/[^?#]*)", 1), F.lit(""))


def keys_of(url: Column) -> Column:
    """All (kind, value) keys of a URL."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit(DOMAIN).alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda i: F.struct(
                F.lit(PATH).alias("kind"), F.concat_ws("/", host, F.array_join(F.slice(parts, 1, i), "/")).alias("value")
            ),
        ),
    ).otherwise(F.array())
    own = F.array(F.struct(F.lit(HOST).alias("kind"), host.alias("value")))
    return F.when(host != "", F.concat(own, parents, prefixes))


def validity(events: DataFrame) -> DataFrame:
    """Rows (kind, value, category, valid_from, valid_to), end excluded and null while open.

    ``events`` has kind, value, category, action (add or remove) and day. They are reduced to one
    per entry and day before the window, so an entry's rows are bounded by the calendar.
    """
    known = events.where("kind IS NOT NULL AND value IS NOT NULL AND action IN ('add', 'remove') AND day IS NOT NULL")
    daily = known.groupBy("kind", "value", "day").agg(
        F.max((F.col("action") == "add").cast("int")).alias("active"),
        F.min(F.when(F.col("action") == "add", F.col("category"))).alias("category"),
    )
    entry = Window.partitionBy("kind", "value").orderBy("day")
    spans = daily.withColumn("valid_to", F.lead("day").over(entry)).where("active = 1")
    return spans.select("kind", "value", "category", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """Rows (row, blocked, n_entries, entry, category): the active entries a capture meets, and the first by kind and value.

    An entry's intervals do not overlap, so a capture meets each entry once at most. A host may have
    any share of the captures: the list side of its key is a few rows, and the join's large
    partitions can be split.
    """
    own = captures.select(
        F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"),
        F.monotonically_increasing_id().alias("uid"),
        F.col(fetched).alias("at"),
        keys_of(F.col(url)).alias("keys"),
    )
    asked = own.select("row", "uid", "at", F.explode_outer(F.array_distinct("keys")).alias("key"))
    asked = asked.select("row", "uid", "at", "key.kind", "key.value")
    active = validity(events).alias("e")
    meets = (
        (F.col("c.kind") == F.col("e.kind"))
        & (F.col("c.value") == F.col("e.value"))
        & (F.col("c.at") >= F.col("e.valid_from"))
        & (F.col("e.valid_to").isNull() | (F.col("c.at") < F.col("e.valid_to")))
    )
    met = asked.alias("c").join(active, meets, "left")
    first = F.min(F.when(F.col("e.kind").isNotNull(), F.struct("e.kind", "e.value", "e.category")))
    found = met.groupBy("c.uid", "c.row").agg(F.count("e.kind").alias("n_entries"), first.alias("first"))
    return found.select(
        "row",
        (F.col("n_entries") > 0).alias("blocked"),
        "n_entries",
        F.concat_ws(":", "first.kind", "first.value").alias("entry"),
        F.col("first.category").alias("category"),
    ).withColumn("entry", F.when(F.col("blocked"), F.col("entry")))


# -- captures and a list derived from the pages ---------------------------------------------------

START = "2024-01-01"
DAYS = 366


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day spread over a year by their id."""
    day = F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def events_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path parts of the pages, drawn by their MD5."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    labels = F.split("host", r"\.")
    names = pages.select(host.alias("host"), F.regexp_extract(path, "^/([^/]+)", 1).alias("part")).where("host <> ''")
    names = names.distinct()
    listed = names.select(F.lit(HOST).alias("kind"), F.col("host").alias("value")).distinct()
    listed = listed.union(
        names.where(F.size(labels) >= 3).select(F.lit(DOMAIN), F.array_join(F.slice(labels, -3, 3), ".")).distinct()
    ).union(names.where("part <> ''").select(F.lit(PATH), F.concat_ws("/", "host", "part")).distinct())
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "value")), 1, 8), 16, 10).cast("long")
    listed = listed.withColumn("h", drawn).where("h % 3 = 0")
    listed = listed.withColumn("first", (F.col("h") % 200).cast("int"))
    category = F.when(F.col("h") % 2 == 0, "spam").otherwise("adult")
    day = lambda n: F.date_add(F.lit(START).cast("date"), n)
    kinds = F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("first")).alias("day")),
        F.struct(F.when(F.col("h") % 4 != 1, "remove").alias("action"), day(F.col("first") + 40).alias("day")),
        F.struct(F.when(F.col("h") % 4 == 2, "add").alias("action"), day(F.col("first") + 90).alias("day")),
    )
    events = listed.select("kind", "value", category.alias("category"), F.explode(kinds).alias("event"))
    return events.select("kind", "value", "category", "event.action", "event.day").where("action IS NOT NULL")


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Rows (page_id, fetched_on, blocked, n_entries, entry, category), one per page."""
    found = judge(captures_of(pages), events_of(pages))
    return found.select("row.page_id", "row.fetched_on", "blocked", "n_entries", "entry", "category")


SQL = r"""
WITH parsed AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.$', '')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), names AS (
  SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS part FROM parsed WHERE host <> ''
), listed AS (
  SELECT DISTINCT 'host' AS kind, host AS value FROM names
  UNION ALL
  SELECT DISTINCT 'domain', array_to_string(string_split(host, '.')[-3:], '.') FROM names WHERE len(string_split(host, '.')) >= 3
  UNION ALL
  SELECT DISTINCT 'path', host || '/' || part FROM names WHERE part <> ''
), drawn AS (
  SELECT kind, value, CAST('0x' || substr(md5(kind || ':' || value), 1, 8) AS BIGINT) AS h FROM listed
), events AS (
  SELECT kind, value, CASE WHEN h % 2 = 0 THEN 'spam' ELSE 'adult' END AS category, a.action AS action,
         DATE '2024-01-01' + CAST(h % 200 + a.later AS INTEGER) AS day, h
  FROM drawn, (VALUES ('add', 0), ('remove', 40), ('again', 90)) AS a(action, later)
  WHERE h % 3 = 0 AND (a.action = 'add' OR (a.action = 'remove' AND h % 4 <> 1) OR (a.action = 'again' AND h % 4 = 2))
), spans AS (
  SELECT kind, value, category, day AS valid_from, action,
         lead(day) OVER (PARTITION BY kind, value ORDER BY day) AS valid_to
  FROM events
), asked AS (
  SELECT page_id, fetched_on, 'host' AS kind, host AS value FROM parsed WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched_on, 'domain', array_to_string(string_split(host, '.')[i:], '.')
  FROM parsed, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS r(i) WHERE host <> ''
  UNION ALL
  SELECT page_id, fetched_on, 'path', host || '/' || array_to_string(list_filter(string_split(path, '/'), lambda s: s <> '')[1:i], '/')
  FROM parsed, unnest(range(1, len(list_filter(string_split(path, '/'), lambda s: s <> '')) + 1)) AS r(i) WHERE host <> ''
), met AS (
  SELECT page_id, count(*) AS n_entries, min({'kind': a.kind, 'value': a.value, 'category': s.category}) AS best
  FROM asked a JOIN spans s ON a.kind = s.kind AND a.value = s.value AND s.action <> 'remove'
    AND a.fetched_on >= s.valid_from AND (s.valid_to IS NULL OR a.fetched_on < s.valid_to)
  GROUP BY page_id
)
SELECT p.page_id, p.fetched_on, m.page_id IS NOT NULL AS blocked, coalesce(m.n_entries, 0) AS n_entries,
       m.best.kind || ':' || m.best.value AS entry, m.best.category AS category
FROM parsed p LEFT JOIN met m ON p.page_id = m.page_id
"""
