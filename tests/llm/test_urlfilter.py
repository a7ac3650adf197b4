"""URL filters: intervals and matches against a walk through the list's history."""

import datetime
import os
import random
import sys

from wardline.llm import catalog, urlfilter

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from oracle_compare import compare, connect

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2024, 1, 1)


def test_query_matches_sql(spark):
    _, problem = compare(catalog.op7_url_filters(spark, SF), connect(SF), catalog.sql_texts()["op7_url_filters"])
    assert not problem, problem


def keys(url):
    if not url or "://" not in url:
        return set()
    rest = url.split("://", 1)[1]
    place = rest.replace("?", "/?", 1).split("#")[0]
    authority, _, tail = place.partition("/")
    host = authority.split("@")[-1].split(":")[0].lower().removesuffix(".")
    if not host:
        return set()
    labels = host.split(".")
    out = {("host", host)} | {("domain", ".".join(labels[i:])) for i in range(max(len(labels) - 1, 1))}
    parts = [p for p in tail.split("?")[0].split("/") if p]
    return out | {("path", "/".join([host, *parts[:n]])) for n in range(1, len(parts) + 1)}


def active(events, day):
    state = {}
    for kind, value, _, action, on in sorted(events, key=lambda e: (e[4], e[3] == "add")):
        if on <= day:
            state[kind, value] = action == "add"
    return {k for k, v in state.items() if v}


def test_random_histories(spark):
    rng = random.Random(1)
    hosts = ["a.com", "x.a.com", "b.org", "y.b.org", "c"]
    urls = [None, "", "no scheme", "http://", "ftp://X.A.com:80/p/q?r#s", "https://user:pw@b.org./p//q/"]
    urls += [f"http://{h}/{'/'.join(rng.choices('pqr', k=rng.randint(0, 3)))}" for h in hosts for _ in range(6)]
    rows = [(i, rng.choice(urls), DAY + datetime.timedelta(rng.randint(0, 30)) if i % 17 else None, 1) for i in range(300)]
    rows += rows[:5]
    values = [("host", h) for h in hosts] + [("domain", h) for h in hosts] + [("path", f"{h}/p") for h in hosts] + [("path", "a.com/p/q")]
    events = [(*rng.choice(values), "c", rng.choice(["add", "remove"]), DAY + datetime.timedelta(rng.randint(0, 30))) for _ in range(120)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, blocked int")
    dated = spark.createDataFrame([*events, ("host", None, "c", "add", DAY), ("host", "a.com", "c", None, DAY)], "kind string, value string, category string, action string, day date")
    got = urlfilter.judge(captures, dated).collect()
    assert len(got) == len(rows)
    for r in got:
        day = r.row.fetched_on
        want = sorted(keys(r.row.url) & active(events, day)) if day else []
        assert (r.blocked, r.n_entries) == (bool(want), len(want)), (r, want)
        assert r.entry == (":".join(want[0]) if want else None)


def test_empty(spark):
    captures = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id long, url string, fetched_on date")
    dated = spark.createDataFrame([], "kind string, value string, category string, action string, day date")
    assert [r.blocked for r in urlfilter.judge(captures, dated).collect()] == [False]
    assert urlfilter.judge(captures.limit(0), dated).collect() == []
    assert urlfilter.page_verdicts(captures.limit(0)).collect() == []
