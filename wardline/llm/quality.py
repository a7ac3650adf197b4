"""Quality rules: robust multivariate outliers per language and source, DataFrame functions only.

Four transformed statistics of a text form its vector. A minimum-covariance-determinant estimate
per (language, source) gives a centre and a spread that junk cannot pull, as long as it is the
smaller half; documents far from it by Mahalanobis distance are rejected.

Nulls: a null text counts as empty; null languages and sources form groups of their own. Empty
texts have all counts zero and fail the base rule. Repeated rows and ties count each. An empty
table gives an empty result. Columns of the input are kept under ``row`` and cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.base import staged

SPACE = r"[\x20\x09-\x0D]+"
DIMS = ("symbols", "length", "repeats", "lines")
# One unit of a statistic is 1/GRID of its transformed value. The fit counts whole units of STEP,
# so that its tables hold cells, not documents, and its sums are exact integers.
GRID = 1000
STEP = (10, 5, 10, 10)
# Spread below which a statistic is never taken, in units: clean texts have almost none in some.
FLOOR = (60, 50, 150, 150)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HALF = 0.5
PER_OCTAVE = 32  # ranges of distances per doubling, to find the half by counting
STEPS = 6
MIN_GROUP = 100
# Estimates are sent to all tasks up to this many groups, about 150 bytes each.
MAX_SENT = 100_000
REJECT_BELOW = 1e-6


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """The input as ``row`` plus n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), body.alias("body"))
    out = out.withColumns(
        {
            "words": F.filter(F.split("body", SPACE), lambda w: w != ""),
            "lines": F.filter(F.split("body", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    out = out.withColumn("n", F.size("words"))
    hashed = F.transform(
        F.sequence(F.lit(0), F.col("n") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    out = out.withColumn("windows", F.when(F.col("n") >= 3, F.sort_array(hashed)))
    again = F.filter(
        F.transform(
            "windows",
            lambda x, k: F.when(
                x["h"].eqNullSafe(F.get("windows", k - 1)["h"]) | x["h"].eqNullSafe(F.get("windows", k + 1)["h"]),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    out = out.withColumn("again", F.sort_array(again))
    covered = F.aggregate(
        F.transform("again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - i, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return out.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics in whole units: symbols per word (root), mean word length (log), shares."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.round(part * GRID).cast("long").alias(name)
        for name, part in zip(
            DIMS,
            (
                F.sqrt(F.col("n_symbols") / n),
                F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))),
                F.col("n_repeat_words") / n,
                F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            ),
        )
    ]


def chi2_cdf(x: float, dof: int) -> float:
    """Closed form for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return high


def consistency(share: float, dof: int) -> float:
    """What the covariance of the innermost share must be scaled by under normality."""
    return share / chi2_cdf(chi2_quantile(share, dof), dof + 2)


PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
MEANS = [f"m{i}" for i in range(len(DIMS))]
FACTORS = [f"l{i}{j}" for i, j in PAIRS]


def _moments(cells: DataFrame, scale: float) -> DataFrame:
    """Each group's and start's mean and Cholesky factor, from exact integer sums over its weighted cells.

    The diagonal gets the floor before the factor is taken, so no spread can vanish.
    """
    weight = F.col("weight")
    sums = {f"s{i}": F.sum(weight * F.col(d)) for i, d in enumerate(DIMS)}
    sums |= {f"s{i}{j}": F.sum(weight * F.col(DIMS[i]) * F.col(DIMS[j])) for i, j in PAIRS}
    keep = ["g", "start"]
    out = cells.groupBy(*keep).agg(F.greatest(F.sum(weight), F.lit(1)).alias("t"), *[c.alias(k) for k, c in sums.items()])
    mean = {i: F.col(f"s{i}") / F.col("t") for i in range(len(DIMS))}
    out = out.select(*keep, "t", *[mean[i].alias(f"m{i}") for i in mean], *[F.col(f"s{i}{j}") for i, j in PAIRS])
    floor = [(f / s) ** 2 for f, s in zip(FLOOR, STEP)]
    cov = {
        (i, j): (F.col(f"s{i}{j}") / F.col("t") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
        + (F.lit(floor[i]) if i == j else F.lit(0.0))
        for i, j in PAIRS
    }
    out = out.select(*keep, *MEANS, *[c.alias(f"c{i}{j}") for (i, j), c in cov.items()])
    for (i, j) in PAIRS:  # one column after the other: each builds on those before
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-3))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*keep, *MEANS, *FACTORS)


def _with_distance(df: DataFrame, values: list[Column], name: str) -> DataFrame:
    """Forward substitution in steps of one column, so that no term is computed twice."""
    own = df.columns
    for i, value in enumerate(values):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), value - F.col(f"m{i}"))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(values))])
    return df.select(*own, total.alias(name))


CELL = ["g", "start", "w", *DIMS]


def fit(cells: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates: one row per group ``g`` with means and factor.

    ``cells`` has rows (g, statistics in steps, w documents). Two starts, one from coordinate-wise
    medians and one from the whole group's moments, are concentrated in ``STEPS`` rounds: the half
    of the documents nearest by the current distance gives the next estimate, which can only lower
    the determinant. The start with the lower determinant wins; one reweighting follows.

    A group's cells are never gathered: sums are added up where the cells lie, estimates, one row per
    group and start, are sent to them up to MAX_SENT rows (joined beyond), and the nearest half is found
    by counting. Each round's distances are a stored table.
    """
    few = 2 * cells.select("g").distinct().count() <= MAX_SENT

    def send(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    medians = None
    for d in DIMS:  # a statistic has no more values than its grid
        counts = cells.groupBy("g", d).agg(F.sum("w").alias("n"))
        upto, every = F.sum("n").over(Window.partitionBy("g").orderBy(d)), F.sum("n").over(Window.partitionBy("g"))
        found = counts.withColumn("in", 2 * upto >= every).where("in").groupBy("g").agg(F.min(d).alias(f"q_{d}"))
        medians = found if medians is None else medians.join(found, "g")
    away = reduce(lambda a, b: a + b, [((F.col(d) - F.col(f"q_{d}")) * s / f) ** 2 for d, s, f in zip(DIMS, STEP, FLOOR)])
    own = cells.join(send(medians), "g").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    # Start 0: the half nearest to the medians. Start 1: everything.
    now = staged(own.select(*CELL, F.when(F.col("start") == 0, away).otherwise(F.lit(0.0)).alias("d2")), "distances")
    scale = consistency(HALF, len(DIMS))
    for _ in range(STEPS):
        now = staged(_distances(now, send(_moments(_inner(now, send), scale))), "distances")
    last = staged(_moments(_inner(now, send), scale), "estimates")
    det = reduce(lambda a, b: a * b, [F.col(f"l{i}{i}") for i in range(len(DIMS))])
    best = last.groupBy("g").agg(F.min(F.struct(det.alias("det"), F.col("start"))).alias("best")).select("g", F.col("best.start").alias("start"))
    now = _distances(now.join(send(best), ["g", "start"]), send(last))
    near = chi2_quantile(0.975, len(DIMS))
    weighed = now.withColumn("weight", F.when(F.col("d2") <= near, F.col("w")).otherwise(F.lit(0)))
    return _moments(weighed, consistency(0.975, len(DIMS))).drop("start")


def _distances(cells: DataFrame, estimates: DataFrame) -> DataFrame:
    joined = cells.select(*CELL).join(estimates, ["g", "start"])
    return _with_distance(joined, [F.col(d) for d in DIMS], "d2").select(*CELL, "d2")


def _inner(cells: DataFrame, send: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``weight``: the cell's documents if it belongs to the nearest half of its group, cells at the bound whole.

    Documents are counted per narrow range of distances; only the cells of the one range in which the
    half ends are put in order.
    """
    ranged = cells.withColumn("range", F.coalesce(F.floor(F.log2("d2") * PER_OCTAVE), F.lit(-(1 << 40))))
    counts = ranged.groupBy("g", "start", "range").agg(F.sum("w").alias("n"))
    group = Window.partitionBy("g", "start")
    half = F.ceil(F.sum("n").over(group) * HALF)
    upto = F.sum("n").over(group.orderBy("range"))
    edge = counts.select("g", "start", F.col("range").alias("edge"), upto.alias("upto"), (upto - F.col("n")).alias("below"), half.alias("half"))
    edge = edge.where("below < half AND half <= upto").drop("upto")
    joined = ranged.join(send(edge), ["g", "start"])
    settled = joined.where("range < edge").select(*CELL, F.col("w").alias("weight"))
    order = Window.partitionBy("g", "start").orderBy("d2")
    last = joined.where("range = edge")
    earlier = F.sum("w").over(order) - F.sum("w").over(Window.partitionBy("g", "start", "d2"))
    last = last.select(*CELL, "below", "half", earlier.alias("earlier"))
    last = last.select(*CELL, F.when(F.col("below") + F.col("earlier") < F.col("half"), F.col("w")).otherwise(F.lit(0)).alias("weight"))
    return settled.unionByName(last)


def with_verdict(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds base_failed, distance2 and kept to a frame of ``with_counts`` whose rows hold lang and source.

    The frame is read twice, so pass a stored one. Documents that fail the base rule take no part in
    the fit. Groups under MIN_GROUP documents borrow their language's estimate, languages under it
    that of all documents.
    """
    rows = counted.withColumn("base_failed", base_failed()).select(
        *counted.columns, "base_failed", *vector(),
        F.col(f"row.{lang}").alias("lang"), F.col(f"row.{source}").alias("source"),
    )
    steps = [F.floor(F.col(d) / s + 0.5).cast("long").alias(d) for d, s in zip(DIMS, STEP)]
    cells = staged(
        rows.where("not base_failed").groupBy("lang", "source", *steps).agg(F.count("*").alias("w")), "cells"
    )
    def key(*parts: Column) -> Column:  # one text, so that groups join plainly; a null part has no field
        return F.to_json(F.struct(*parts))

    whole = F.lit(None).cast("string")
    levels = [
        cells.withColumn("g", key(F.lit(level).alias("level"), lang_.alias("lang"), source_.alias("source")))
        for level, lang_, source_ in (
            (2, F.col("lang"), F.col("source")), (1, F.col("lang"), whole), (0, whole, whole)
        )
    ]
    all_cells = reduce(DataFrame.unionByName, levels).groupBy("g", *DIMS).agg(F.sum("w").alias("w"))
    fits = staged(fit(all_cells), "fits")
    sizes = cells.groupBy("lang", "source").agg(F.sum("w").alias("n_group"))
    sizes = sizes.withColumn("n_lang", F.sum("n_group").over(Window.partitionBy("lang")))
    level = F.when(F.col("n_group") >= MIN_GROUP, 2).when(F.col("n_lang") >= MIN_GROUP, 1).otherwise(0)
    sizes = sizes.select(
        F.col("lang").alias("p_lang"), F.col("source").alias("p_source"),
        key(
            level.alias("level"),
            F.when(level >= 1, F.col("lang")).alias("lang"),
            F.when(level >= 2, F.col("source")).alias("source"),
        ).alias("g"),
    )
    chosen = sizes.join(fits, "g").drop("g")
    if fits.count() <= MAX_SENT:  # else rows meet their group's estimate in a join that can be split
        chosen = F.broadcast(chosen)
    found = rows.join(
        chosen, F.col("lang").eqNullSafe(F.col("p_lang")) & F.col("source").eqNullSafe(F.col("p_source")), "left"
    )
    found = _with_distance(found, [F.col(d) / s for d, s in zip(DIMS, STEP)], "distance2")
    cutoff = chi2_quantile(1 - REJECT_BELOW, len(DIMS))
    good = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= cutoff)
    return found.select(*counted.columns, "base_failed", "distance2", good.alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document the counts, base rule and verdict; texts are read once."""
    counted = with_counts(docs.select("doc_id", "text", "lang", "source"))
    slim = counted.withColumn("row", F.struct("row.doc_id", "row.lang", "row.source"))
    judged = with_verdict(staged(slim, "quality"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("row.doc_id", *counts, "base_failed", "kept")


def _moments_sql(source: str, scale: float) -> str:
    """Means and factor of every group and start of weighted cells, one subquery per column that builds on others."""
    sums = ["greatest(sum(weight), 1) AS t", *[f"sum(weight * {d}) AS s{i}" for i, d in enumerate(DIMS)]]
    sums += [f"sum(weight * {DIMS[i]} * {DIMS[j]}) AS s{i}{j}" for i, j in PAIRS]
    out = f"SELECT g, start, {', '.join(sums)} FROM {source} GROUP BY g, start"
    out = f"SELECT *, {', '.join(f's{i}::DOUBLE / t::DOUBLE AS m{i}' for i in range(len(DIMS)))} FROM ({out})"
    floor = [(f / s) ** 2 for f, s in zip(FLOOR, STEP)]
    cov = [f"(s{i}{j}::DOUBLE / t::DOUBLE - m{i} * m{j}) * {scale!r}::DOUBLE + {floor[i] if i == j else 0.0!r}::DOUBLE AS c{i}{j}" for i, j in PAIRS]
    out = f"SELECT *, {', '.join(cov)} FROM ({out})"
    for i, j in PAIRS:
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        value = f"sqrt(greatest({rest}, 1e-3::DOUBLE))" if i == j else f"({rest}) / l{j}{j}"
        out = f"SELECT *, {value} AS l{i}{j} FROM ({out})"
    return f"SELECT g, start, {', '.join([*MEANS, *FACTORS])} FROM ({out})"


def _distance_sql(source: str, values: list[str], keep: str, name: str) -> str:
    for i, value in enumerate(values):
        rest = f"({value} - m{i})" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
        source = f"(SELECT *, ({rest}) / l{i}{i} AS y{i} FROM {source})"
    return f"SELECT {keep}, {' + '.join(f'y{i} * y{i}' for i in range(len(values)))} AS {name} FROM {source}"


def _inner_sql(source: str) -> str:
    before = "sum(w) OVER (PARTITION BY g, start ORDER BY d2) - sum(w) OVER (PARTITION BY g, start, d2)"
    half = f"ceil(sum(w) OVER (PARTITION BY g, start) * {HALF})"
    return f"SELECT *, CASE WHEN before < half THEN w ELSE 0 END AS weight FROM (SELECT *, {before} AS before, {half} AS half FROM {source})"


def _sql() -> str:
    space, dims, cell = r"[\x20\x09-\x0D]+", ", ".join(DIMS), "g, start, w, " + ", ".join(DIMS)
    units = dict(zip(DIMS, (
        "sqrt(n_symbols / greatest(n_words, 1))", "ln(greatest(word_chars / greatest(n_words, 1), 1e0))",
        "n_repeat_words / greatest(n_words, 1)", "n_dup_lines / greatest(n_lines, 1)",
    )))
    name = "'{}|' || {} || '|' || {}"
    part = {c: f"coalesce('1' || {c}, '0')" for c in ("lang", "source")}
    groups = [name.format(2, part["lang"], part["source"]), name.format(1, part["lang"], "''"), name.format(0, "''", "''")]
    ctes = {
        "split_texts": rf"""SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS body,
            list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda w: w <> '') AS words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines FROM documents""",
        "grams": """SELECT row, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
            FROM split_texts, unnest(range(1, len(words) - 1)) AS r(i)""",
        "repeated": """SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM (
            SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, gram) > 1)) GROUP BY row""",
        "counted": """SELECT row, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            len(lines) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM split_texts LEFT JOIN repeated USING (row)""",
        "judged": f"""SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
            {', '.join(f'round(({v}) * {GRID})::BIGINT AS {d}' for d, v in units.items())} FROM counted""",
        "cells": f"""SELECT lang, source, {', '.join(f'floor({d} / {s} + 0.5e0)::BIGINT AS {d}' for d, s in zip(DIMS, STEP))},
            count(*) AS w FROM judged WHERE NOT base_failed GROUP BY ALL""",
        "grouped": " UNION ALL ".join(f"SELECT {g} AS g, {dims}, sum(w)::BIGINT AS w FROM cells GROUP BY ALL" for g in groups),
    }
    for d in DIMS:
        ctes[f"median_{d}"] = f"""SELECT g, min(v) AS q_{d} FROM (SELECT g, {d} AS v, sum(sum(w)) OVER (PARTITION BY g ORDER BY {d}) AS upto,
            sum(sum(w)) OVER (PARTITION BY g) AS every FROM grouped GROUP BY g, {d}) WHERE 2 * upto >= every GROUP BY g"""
    away = " + ".join(f"pow(({d} - q_{d})::DOUBLE * {s} / {f}, 2)" for d, s, f in zip(DIMS, STEP, FLOOR))
    ctes["d_0"] = f"""SELECT {cell}, CASE start WHEN 0 THEN {away} ELSE 0e0 END AS d2 FROM grouped
        {' '.join(f'JOIN median_{d} USING (g)' for d in DIMS)}, (VALUES (0), (1)) AS s(start)"""
    scale = consistency(HALF, len(DIMS))
    for k in range(STEPS + 1):
        ctes[f"inner_{k}"] = _inner_sql(f"d_{k}")
        ctes[f"moments_{k}"] = _moments_sql(f"inner_{k}", scale)
        if k < STEPS:
            ctes[f"d_{k + 1}"] = _distance_sql(f"(SELECT * FROM d_{k} JOIN moments_{k} USING (g, start))", list(DIMS), cell, "d2")
    det = " * ".join(f"l{i}{i}" for i in range(len(DIMS)))
    ctes["best"] = f"SELECT g, start FROM moments_{STEPS} QUALIFY row_number() OVER (PARTITION BY g ORDER BY {det}, start) = 1"
    ctes["last"] = _distance_sql(
        f"(SELECT * FROM d_{STEPS} JOIN best USING (g, start) JOIN moments_{STEPS} USING (g, start))", list(DIMS), cell, "d2")
    near = chi2_quantile(0.975, len(DIMS))
    ctes["weighed"] = f"SELECT *, CASE WHEN d2 <= {near!r}::DOUBLE THEN w ELSE 0 END AS weight FROM last"
    ctes["fits"] = _moments_sql("weighed", consistency(0.975, len(DIMS)))
    ctes["sizes"] = """SELECT lang, source, sum(w) AS n_group, sum(sum(w)) OVER (PARTITION BY lang) AS n_lang FROM cells GROUP BY lang, source"""
    chosen = f"CASE WHEN n_group >= {MIN_GROUP} THEN {groups[0]} WHEN n_lang >= {MIN_GROUP} THEN {groups[1]} ELSE {groups[2]} END"
    ctes["chosen"] = f"SELECT lang, source, {', '.join([*MEANS, *FACTORS])} FROM (SELECT lang, source, {chosen} AS g FROM sizes) JOIN fits USING (g)"
    placed = f"""(SELECT j.*, {', '.join([*MEANS, *FACTORS])} FROM judged j LEFT JOIN chosen c
        ON c.lang IS NOT DISTINCT FROM j.lang AND c.source IS NOT DISTINCT FROM j.source)"""
    counts = "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"
    ctes["placed"] = _distance_sql(placed, [f"{d} / {s}" for d, s in zip(DIMS, STEP)], f"doc_id, {counts}, base_failed", "distance2")
    cutoff = chi2_quantile(1 - REJECT_BELOW, len(DIMS))
    return "WITH " + ",\n".join(f"{n} AS ({text})" for n, text in ctes.items()) + f"""
SELECT doc_id, {counts}, base_failed, NOT base_failed AND coalesce(distance2, 0) <= {cutoff!r}::DOUBLE AS kept FROM placed"""


SQL = _sql()
