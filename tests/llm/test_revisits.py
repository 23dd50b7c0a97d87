import pytest
from conftest_llm import SF_DIR
from pyspark.sql import functions as F

from occugrid.llm import revisits
from occugrid.llm.oracle import ORACLE
from occugrid.llm.queries import QUERIES

SCHEMA = f"record_id long, kind string, url string, at long, status int, headers {revisits.HEADERS}, chunk string"


@pytest.fixture
def captures(spark):
    def build(*rows):
        return spark.createDataFrame(
            [
                (i, kind, url, at, status, None if h is None else list(h.items()), "clash")
                for i, kind, url, at, status, h in rows
            ],
            SCHEMA,
        )

    return build


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Host.example:80/Path/?b=2&a=1#x", "host.example/Path?a=1&b=2"),
        ("https://host.example:443/?utm_source=feed&ref=x", "host.example"),
        ("host.example", "host.example"),
        ("http://host.example/a?", "host.example/a"),
        ("http://host.example:8080/a?refer=1", "host.example:8080/a?refer=1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, key):
    frame = spark.createDataFrame([(url,)], "url string")
    assert frame.select(revisits.canonical_url(F.col("url"))).first()[0] == key


def by_id(frame):
    return {r["record_id"]: r for r in frame.collect()}


def test_latest_earlier_response(captures):
    u = "http://a.example/x"
    found = by_id(
        revisits.resolve(
            captures(
                (1, "response", u, 10, 200, {"ETag": "one", "Date": "d1", "Content-Length": "5"}),
                (2, "revisit", u + "/", 10, 304, {"ETag": "one"}),
                (3, "revisit", u + "#f", 11, 304, {"etag": 'W/one', "date": "d3", "X-Own": "y"}),
                (4, "response", u, 20, 404, {"ETag": "lost"}),
                (5, "response", u, 30, 200, {"ETag": "two", "Last-Modified": "m"}),
                (6, "response", u, 30, 200, {"ETag": "tie"}),
                (7, "revisit", u, 31, 304, {"ETag": "tie"}),
                (8, "revisit", u, 32, 304, {"ETag": "two"}),
                (9, "revisit", u, 33, 304, None),
                (10, "revisit", None, 33, 304, {"ETag": "tie"}),
                (11, "revisit", u, None, 304, {"ETag": "tie"}),
                (12, None, u, 40, 200, {}),
                (13, "revisit", "http://b.example", 50, None, {}),
                (14, "response", None, 1, 200, {"ETag": "tie"}),
            )
        )
    )
    outcomes = {i: (r["outcome"], r["response_id"]) for i, r in found.items()}
    assert outcomes == {
        2: ("missing", None),
        3: ("resolved", 1),
        7: ("resolved", 6),
        8: ("changed", None),
        9: ("unchecked", 6),
        10: ("missing", None),
        11: ("missing", None),
        13: ("missing", None),
    }
    merged = [(h["name"], h["value"]) for h in found[3]["headers"]]
    assert merged == [("Content-Length", "5"), ("etag", "W/one"), ("date", "d3")]
    assert [(h["name"], h["value"]) for h in found[8]["headers"]] == [("ETag", "two")]
    assert found[3]["response_at"] == 10


def test_dates_stand_in_for_tags(captures):
    u = "http://a.example"
    found = by_id(
        revisits.resolve(
            captures(
                (1, "response", u, 1, 200, {"Last-Modified": "m"}),
                (2, "revisit", u, 2, 304, {"ETag": "t", "last-modified": "m"}),
                (3, "revisit", u, 3, 304, {"Last-Modified": "n"}),
            )
        )
    )
    assert {i: r["outcome"] for i, r in found.items()} == {2: "resolved", 3: "changed"}


def test_a_url_with_most_captures(captures):
    """Its captures lie in several ranges; the last response crosses their borders."""
    rows, wanted, last = [], {}, None
    for i in range(3000):
        if i % 500 == 3:
            rows.append((i, "response", "http://hot.example", i, 200, {"ETag": str(i)}))
            last = i
        else:
            rows.append((i, "revisit", "http://hot.example", i, 304, {"ETag": str(last)}))
            wanted[i] = last
    rows += [(5000 + i, "revisit", f"http://{i}.example", i, 304, {}) for i in range(50)]
    found = by_id(revisits.resolve(captures(*rows)))
    assert {i: found[i]["response_id"] for i in wanted} == wanted
    assert all(found[5000 + i]["outcome"] == "missing" for i in range(50))


def test_repeated_revisits_and_no_rows(captures):
    row = (2, "revisit", "http://a.example", 5, 304, {"ETag": "x"})
    full = (1, "response", "http://a.example", 1, 200, {"ETag": "x"})
    found = revisits.resolve(captures(full, full, row, row)).collect()
    assert [(r["outcome"], r["response_id"]) for r in found] == [("resolved", 1)] * 2
    assert revisits.resolve(captures(full).limit(0)).count() == 0


def test_query_against_sql(spark, duck):
    duck.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    relation = duck.sql(ORACLE["op2_revisits"])
    frame = QUERIES["op2_revisits"](spark, SF_DIR).select(*relation.columns)
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(relation.fetchall(), key=str)
