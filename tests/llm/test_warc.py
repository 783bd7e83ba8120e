import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from graphlens.llm import warc
from graphlens.llm.common import table

SCHEMA = (
    "record_id long, url string, captured_at timestamp, kind string, status int, headers map<string,string>,"
    " payload string, outcome string"
)
T0 = dt.datetime(2024, 1, 1)


def row(i, url, minutes, kind, status=200, payload=None, **headers):
    at = None if minutes is None else T0 + dt.timedelta(minutes=minutes)
    return (i, url, at, kind, status, {k.replace("_", "-"): v for k, v in headers.items()}, payload, "clash")


def test_canonical_urls(spark):
    pairs = [
        ("HTTP://WWW.Example.com:80/a/", "example.com/a"), ("https://example.com/a?b=2&a=1&utm_source=x#f", "example.com/a?a=1&b=2"),
        ("http://example.com", "example.com"), ("http://example.com/?", "example.com"), ("http://example.com/A", "example.com/A"),
    ]
    df = spark.createDataFrame(pairs, "url string, want string").withColumn("got", warc.canonical_url(F.col("url")))
    assert all(r.got == r.want for r in df.collect())


def test_outcomes(spark):
    rows = [
        row(1, "http://a.com/x", 0, "response", payload="one", etag='"1"', content_length="3", server="s", age="1"),
        row(2, "http://www.a.com/x#q", 200, "revisit", 304, etag='W/"1"', content_length="0", age="9", date="d"),
        row(3, "http://a.com/x", 300, "response", 404, payload="gone"),
        row(4, "http://a.com/x", 301, "revisit", 304, etag='"2"'),
        row(5, "http://a.com/x", -5, "revisit", 304, etag='"1"'),
        row(6, "http://b.com", 1, "response", payload="b", last_modified="m"),
        row(7, "http://b.com/", 1, "revisit", 304, last_modified=" m"),
        row(8, "http://b.com/", 1, "revisit", 304),
        row(9, None, 1, "revisit", 304, etag='"1"'),
        row(10, "http://a.com/x", None, "revisit", 304, etag='"1"'),
        row(None, "http://a.com/x", 9, "revisit", 304, etag='"1"'),
        row(11, "http://a.com/x", 9, None, None),
        row(12, "http://a.com/x", 9, "revisit", 200, etag='"1"'),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.record_id: r for r in warc.resolve_revisits(df).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in out.items()} == {
        1: ("response", None), 2: ("resolved", 1), 3: ("response", None), 4: ("not_matching", 1), 5: ("no_response", None),
        6: ("response", None), 7: ("resolved", 6), 8: ("not_matching", 6), 9: ("no_response", None), 10: ("no_response", None),
        None: ("no_response", None), 11: ("other", None), 12: ("no_response", None),
    }
    assert out[2].headers == {"etag": 'W/"1"', "content-length": "3", "server": "s", "age": "9", "date": "d"}
    assert out[2].payload == "one" and out[4].payload is None
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_as_of_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = [
        row(i, f"http://h/{rnd.choice('aaaab')}", rnd.randint(0, 400), rnd.choice(["response", "revisit"]), 200)
        for i in range(300)
    ]
    got = {r.record_id: r.response_id for r in warc.as_of_responses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        if r[3] == "revisit":
            past = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == r[1] and (x[2], x[0]) < (r[2], r[0])]
            assert got[r[0]] == (max(past)[1] if past else None)


def test_equals_sql_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = warc.digest(warc.resolve_revisits(warc.captures_of_pages(table(spark, folder, "pages")))).toPandas()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = con.execute(warc.ORACLE_SQL).fetchdf()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False)))
    got["response_id"], want["response_id"] = got.response_id.astype(float), want.response_id.astype(float)
    assert key(got) == key(want)
    assert set(got.outcome) >= {"response", "resolved", "not_matching"}
