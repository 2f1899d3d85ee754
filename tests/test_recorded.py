"""Recorded index answers and listings, with filters in the reader."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text
from shelfmark.sources import recorded, store


@pytest.fixture()
def answers(tmp_path):
    rows = [["com,a)/", f"20140{m}01000000", "http://a.com/", "text/html", code, f"D{m}", "9"] for m in range(1, 7) for code in ("200", "404")]
    pages = {"http://a.com/": rows, "http://b.com/x?y": [[None, "2015", "http://b.com/x?y", None, "200", None, None]]}
    for url, own in pages.items():
        for n in (0, 1):
            (tmp_path / recorded.page_name(url, n, ".json")).write_text(json.dumps([list(recorded.CDX_FIELDS), *own[n::2]]))
    (tmp_path / recorded.page_name("http://c.com/", 0, ".json")).write_text("<html>busy</html>")
    (tmp_path / recorded.page_name("http://d.com/", 0, ".json")).write_text("[]")
    (tmp_path / recorded.page_name("http://e.com/", 0, ".json")).write_text('[["statuscode","timestamp"],["200","2016"]]')
    (tmp_path / "other.txt").write_text("x")
    return tmp_path, pages


def test_cdx_rows(spark, answers):
    root, pages = answers
    found = recorded.read_cdx(spark, str(root)).collect()
    own = sorted((r["url"], *(r[f] for f in recorded.CDX_FIELDS)) for r in found if r["url"] == "http://a.com/")
    assert own == sorted(("http://a.com/", *row) for row in pages["http://a.com/"])
    assert {r["url"]: r["timestamp"] for r in found} | {"http://a.com/": 0} == {"http://a.com/": 0, "http://b.com/x?y": "2015", "http://e.com/": "2016"}


def test_filters_reach_the_reader(spark, answers):
    root, _ = answers
    asked = recorded.read_cdx(spark, str(root)).where("statuscode = '200' AND timestamp >= '201403' AND timestamp < '2015' AND url LIKE 'http://a%'")
    assert {r["timestamp"][:6] for r in asked.collect()} == {f"20140{m}" for m in range(3, 7)}
    plan = asked._jdf.queryExecution().explainString(asked.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan.partition("PushedFilters")[2].partition("\n")[0] or plan
    assert all(x in pushed for x in ("statuscode", "timestamp", "url"))
    # What the reader applied is not applied again; pages of other answers are not even listed.
    reader = recorded.CdxReader({"path": str(root)})
    from pyspark.sql.datasource import EqualTo, IsNotNull, StringStartsWith

    rest = list(reader.pushFilters([EqualTo(("statuscode",), "200"), StringStartsWith(("url",), "http://a"), IsNotNull(("digest",)), EqualTo(("page",), 1)]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"] and rest[1].attribute == ("page",)
    assert [p.names["url"] for p in reader.partitions()] == ["http://a.com/"] * 2
    assert recorded.read_cdx(spark, str(root)).where("url = 'http://none/'").count() == 0
    assert recorded.read_cdx(spark, str(root / "missing")).count() == 0


def test_snapshots_of_recorded_answers(spark, answers):
    root, _ = answers
    rows = recorded.read_cdx(spark, str(root)).where("url = 'http://a.com/'").drop("page")
    kept = store.snapshots(rows, "201402", "201404", limit=3).orderBy("n").collect()
    assert [(r["timestamp"][:6], r["replay"][-13:]) for r in kept] == [("201402", "http://a.com/"), ("201402", "http://a.com/"), ("201403", "http://a.com/")]


def listing(keys, token):
    inside = "".join(f"<Contents><Key>{k}</Key></Contents>" for k in keys)
    more = f"<IsTruncated> TRUE </IsTruncated><NextContinuationToken>{token}</NextContinuationToken>" if token else "<IsTruncated>false</IsTruncated>"
    return f"<ListBucketResult>{inside}{more}</ListBucketResult>"


def test_listings(spark, tmp_path):
    pages = [listing(["cap/a&amp;amp;", "cap/b"], "t1"), listing(["meta/c"], "t2"), listing([], None)]
    for n, xml in enumerate(pages):
        (tmp_path / recorded.page_name("bucket", n, ".xml")).write_text(xml)
    found = sorted(r["key"] for r in recorded.read_listing(spark, str(tmp_path)).collect())
    frame = spark.createDataFrame([(x,) for x in pages], "xml string").select(F.explode(text.listed_keys(F.col("xml"))).alias("key"))
    assert found == sorted(r["key"] for r in frame.collect()) == ["cap/a&amp;", "cap/b", "meta/c"]
    assert recorded.read_listing(spark, str(tmp_path)).where("key LIKE 'cap/%'").count() == 2
    (tmp_path / recorded.page_name("bucket", 2, ".xml")).write_text(listing([], "t3"))
    with pytest.raises(Exception, match="breaks off after"):
        recorded.read_listing(spark, str(tmp_path)).count()
    (tmp_path / recorded.page_name("bucket", 3, ".xml")).write_text(listing([], None))
    (tmp_path / recorded.page_name("bucket", 1, ".xml")).write_text(listing(["x"], None))
    with pytest.raises(Exception, match="ends before"):
        recorded.read_listing(spark, str(tmp_path)).count()
