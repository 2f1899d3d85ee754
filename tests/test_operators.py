"""Operators on small tables: stores, merges, walks, streams and empty inputs."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import keys
from shelfmark.operators import build, graph, relations, verify
from shelfmark.sources import store
from shelfmark.streaming import ledgers


def test_sidecar_policies(spark, tmp_path):
    good = {"v": 3, "key": "2014/http://a.com/", "status": "error", "contentType": "", "requisites": ["2014/http://b.com/"]}
    folder = tmp_path / "meta" / "aa"
    folder.mkdir(parents=True)
    for name, text in (("a", json.dumps(good)), ("b", "[1]"), ("c", "{torn"), ("d", json.dumps(good | {"v": 2}))):
        (folder / f"{name}.json").write_text(text)
    found = store.read_sidecars(spark, str(tmp_path), "collect")
    assert sorted(str(r["defect"]) for r in found.collect()) == ["None", "not an object", "not an object", "version"]
    with pytest.raises(Exception, match="version|not an object"):
        store.read_sidecars(spark, str(tmp_path), "strict").collect()
    (folder / "d.json").unlink()
    lenient = store.read_sidecars(spark, str(tmp_path), "lenient")
    assert [r["key"] for r in lenient.collect()] == [good["key"]]
    assert store.edges_of(lenient).collect()[0]["child"] == "2014/http://b.com/"


def test_manifests(spark):
    text = json.dumps({"version": 2, "noRewrite": [], "exclude": ["http://x.com"], "rewrites": {"http://a.com": "http://b.com"},
                       "entries": {"http://c.com": {"wayback": "w", "timestamp": "2014"}}})
    found = store.parse_manifests(spark.createDataFrame([("f", text)], "file string, json string"))
    assert {(r["section"], r["url"]) for r in found.collect()} == {("exclude", "http://x.com"), ("rewrites", "http://a.com"), ("entries", "http://c.com")}
    with pytest.raises(Exception, match="version 2"):
        store.parse_manifests(spark.createDataFrame([("f", "{}")], "file string, json string")).collect()


def test_commit_and_merge(spark):
    rows = [
        ("2014/http://a.com/", "text/html", 200, b"<p>x", None),
        ("2014/http://b.com/", "text/html", 200, b"", None),
        ("2014/http://c.com/", "", 404, None, "im_"),
        ("2014/http://d.com/", "", 302, None, None),
        ("2014/http://e.com/", "", 503, None, None),
        ("2014/http://f.com/a.pdf", "text/html", 200, b"<p>y", None),
    ]
    out = build.commit(spark.createDataFrame(rows, "key string, content_type string, status_code int, content binary, flag string"))
    assert [r["status"] for r in out.orderBy("key").collect()] == ["body", "empty", "error", "redirect", "interstitial"]
    schema = "doc string, key string, flag string, via string, firstSeen string"
    prior = spark.createDataFrame([("d", "k", "im_", "manual", "1")], schema)
    new = spark.createDataFrame([("d", "k", "js_", "manual", "2"), ("d", "l", None, "manual", "2"), ("d", "l", None, "manual", "2")], schema)
    merged = build.merge_dynamic(prior, new)
    assert {(r["key"], r["flag"]) for r in merged.collect()} == {("k", "im_"), ("l", None)}
    again = build.merge_dynamic(merged, new)
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.collect()))
    with pytest.raises(Exception, match="conflicting"):
        build.merge_dynamic(prior, new.unionByName(spark.createDataFrame([("d", "l", "cs_", "manual", "3")], schema))).collect()


def test_orphans_are_suspended(spark):
    side = spark.createDataFrame([("meta/x", 3, "2014/http://a.com", "error", "", None, None)], "path string, v int, key string, status string, content_type string, content_hash string, content_length long")
    caps = spark.createDataFrame([("cap/aa/x", "d", 1)], "path string, digest string, length long")
    good = side.withColumn("path", keys.meta_path(F.col("key")))
    assert [r["category"] for r in verify.fsck(good, caps).collect()] == ["orphanCap"]
    assert {r["category"] for r in verify.fsck(good.withColumn("v", F.lit(1)), caps).collect()} == {"schemaVersion"}
    assert verify.fsck(side.limit(0), caps.limit(0)).count() == 0


def test_reachable_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "key string")
    assert {(r["key"], r["depth"]) for r in graph.reachable(edges, roots).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.reachable(edges.limit(0), roots.limit(0)).count() == 0


def test_redirect_loop(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "url string, location string")
    found = {r["start"]: r["outcome"] for r in verify.redirect_walk(hops.select("url"), hops).collect()}
    assert found == {"a": "too-many-hops", "b": "too-many-hops", "c": "lost"}


def test_excluded_without_prefixes(spark):
    urls = spark.createDataFrame([("http://a.com/x",), ("http://b.com",), (None,)], "url string")
    none = spark.createDataFrame([], "prefix string")
    assert relations.excluded(urls, none).count() == 0
    some = spark.createDataFrame([("http://a.com/",), ("http://b.com",)], "prefix string")
    assert {r["url"] for r in relations.excluded(urls, some).collect()} == {"http://a.com/x", "http://b.com"}


def test_resume(spark):
    stored = F.struct(F.lit("s").alias("signature"), F.lit("t").alias("target"), F.lit(5).alias("sample"))
    say = lambda *x: spark.range(1).select(verify.resume_state(stored, *map(F.lit, x))).first()[0]
    assert [say("s", "t", 5), say("s", "t", 6), say("z", "t", 5)] == ["all", "without-serving", "none"]


def test_latest_rows_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"key":"a","seq":1,"verified":true}\n{"key":"b","seq":2,"verified":true}\n{torn\n')
    run = lambda: ledgers.keep_latest(
        ledgers.stream_jsonl(spark, str(inbox), "key string, seq long, verified boolean"), str(out), str(tmp_path / "cp")
    ).awaitTermination()
    run()
    (inbox / "2.json").write_text('{"key":"a","seq":3,"verified":false}\n')
    run()
    rows = {r["key"]: (r["seq"], r["verified"]) for r in ledgers.read_latest(spark, str(out)).collect()}
    assert rows == {"a": (3, False), "b": (2, True)}


def test_canonical_manifest(spark):
    from shelfmark.operators import runs

    rows = [("f", "exclude", "b", None), ("f", "exclude", "a", None), ("f", "exclude", "a", None), ("f", "rewrites", "z", "1"), ("f", "rewrites", "y", "2")]
    found = runs.canonical_manifest(spark.createDataFrame(rows, "file string, section string, url string, target string")).first()
    assert found["json"] == '{"version":2,"noRewrite":[],"rewrites":{"y":"2","z":"1"},"entries":{},"exclude":["a","b"]}'


def test_csp_violations(spark):
    from shelfmark.operators import runs

    said = [("Refused to load the script",), ("violates the Content Security Policy",), ("ok",), (None,)]
    frame = spark.createDataFrame(said, "m string")
    assert [r[0] for r in frame.select(runs.is_csp_violation(F.col("m"))).collect()] == [True, True, False, False]


def test_reachable_to_any_depth(spark):
    """A chain longer than any former limit is walked to its end."""
    edges = spark.createDataFrame([(f"k{i}", f"k{i + 1}") for i in range(104)], "parent string, child string").coalesce(1)
    found = graph.reachable(edges, spark.createDataFrame([("k0",)], "key string"))
    assert found.agg(F.max("depth"), F.count("*")).first()[:] == (104, 105)
    inventory = spark.createDataFrame([("p1", "k3", 1), ("p2", "other", 2)], "path string, key string, length long")
    assert [r["path"] for r in graph.sweep_plan(inventory, found).collect()] == ["p2"]


def test_universe(spark):
    read = lambda text: store.parse_universe(spark.createDataFrame([("u", text)], "file string, json string")).collect()
    text = {"rewrites": {"http://a.com": "http://b.com"}, "exclude": ["http://x.com"], "fqdns": {"github.com": {"on404": "probe-repo-root-follow-rename"}}}
    assert {(r["section"], r["name"], r["behavior"], r["value"]) for r in read(json.dumps(text))} == {
        ("rewrites", "http://a.com", None, "http://b.com"),
        ("exclude", "http://x.com", None, None),
        ("fqdns", "github.com", "on404", "probe-repo-root-follow-rename"),
    }
    assert read("{}") == []
    for bad in ("[1]", '{"rewrites":{"a":""}}', '{"exclude":[""]}', '{"fqdns":{"GitHub.com":{"on404":"x"}}}', '{"fqdns":{"a.com":{"on500":"x"}}}', '{"fqdns":{"a.com":{"on404":"x"}}}'):
        with pytest.raises(Exception, match="invalid universe"):
            read(bad)


def test_checkpoints(spark):
    read = lambda text: store.parse_checkpoint(spark.createDataFrame([("c", text)], "file string, json string")).collect()
    good = {"signature": "s", "sample": 5, "target": {"endpoint": "e", "bucket": "b", "prefix": ""}, "passed": [{"layer": 1, "pass": True}], "bodies": {"verified": [], "healed": []}}
    assert read(json.dumps(good))[0]["signature"] == "s"
    for bad in ("{torn", json.dumps(good | {"passed": [{"layer": 1, "pass": False}]}), json.dumps(good | {"bodies": {}}), json.dumps(good | {"target": {"endpoint": "e"}})):
        with pytest.raises(Exception, match="not a verify checkpoint"):
            read(bad)


def test_lookup_and_files(spark, tmp_path):
    side = spark.createDataFrame([("2014/http://a.com", 3), ("2014/http://b.com", 2)], "key string, v int").withColumn("path", keys.meta_path(F.col("key")))
    wanted = spark.createDataFrame([("2014/http://a.com",), ("2014/http://b.com",), ("2014/http://c.com",)], "key string")
    found = {r["key"][-5:]: (r["found"], r["authentic"]) for r in store.find_sidecar(side, wanted).collect()}
    assert found == {"a.com": (True, True), "b.com": (True, False), "c.com": (False, None)}
    root = tmp_path / "store"
    for name in ("cap/aa/x", "tmp/left", "trash/run/cap/aa/y", "odd"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("body")
    entries = store.read_entries(spark, str(root))
    assert {r["path"]: r["length"] for r in entries.collect()} == dict.fromkeys(("cap/aa/x", "tmp/left", "trash/run/cap/aa/y", "odd"), 4)
    assert {(r["category"], r["key"]) for r in verify.root_findings(entries).collect()} == {("foreignRoot", "trash"), ("foreignRoot", "odd"), ("staleTmp", "left")}
    (root / "a.md").write_text("# one")
    assert [r["text"] for r in store.read_texts(spark, str(root)).collect()] == ["# one"]
    assert store.read_texts(spark, str(root / "none")).count() == 0


def test_markdown_is_idempotent(spark):
    from shelfmark.operators import markdown

    docs = spark.createDataFrame([(1, "a http://a.com/x b [http://a.com/x] ```http://a.com/x``` http://b.com ```open http://b.com"), (2, None), (3, "")], "id int, text string")
    verdicts = spark.createDataFrame([("https://www.a.com/x/", "entries", "https://web.archive.org/web/2014/http://a.com/x", 0)], "url string, section string, target string, pos int")
    done, unknown = markdown.apply_manifest(docs, verdicts, "c.example")
    rows = {r["id"]: r["content"] for r in done.collect()}
    new = "https://c.example/web/2014/http://a.com/x"
    assert rows == {1: f"a {new} b [http://a.com/x] ```http://a.com/x``` http://b.com ```open http://b.com", 2: None, 3: ""}
    assert [(r["id"], r["url"]) for r in unknown.collect()] == [(1, "http://b.com")]
    again, _ = markdown.apply_manifest(done.select("id", F.col("content").alias("text")), verdicts, "c.example")
    assert {r["id"]: r["content"] for r in again.collect()} == rows
    dry, told = markdown.archive_links(docs, spark.createDataFrame([("http://b.com", "R")], "url string, replay string"), dry_run=True)
    assert dry.where("content <> text").count() == 0 and told.count() == 2
    assert markdown.archivable_links(docs.limit(0)).count() == 0


def test_crawl_shares_what_is_fetched(spark):
    """What one document's fetch settles is held for others; earlier records block until they resolve."""
    from shelfmark.operators import crawl

    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc string")
    keys_ = lambda rows, schema: spark.createDataFrame(rows, schema)
    probes = keys_([(d, i, 1, 0, 0, 0) for d in "abc" for i in range(5)], "doc string, iteration int, observed int, csp int, chrome int, unmatched int")
    requests = keys_([("a", 0, "2014/http://x.example.com/1"), ("b", 1, "2014/http://x.example.com/1"), ("b", 0, "2014/http://x.example.com/2")], "doc string, iteration int, key string")
    recorded = keys_([("c", "2014/http://x.example.com/gone"), ("c", "2014/http://stats.wp.com/g.gif")], "doc string, key string")
    answers = keys_([("2014/http://x.example.com/1", 200), ("2014/http://x.example.com/2", 404)], "key string, status_code int")
    found = {r["doc"]: tuple(r)[1:] for r in crawl.crawl(docs, keys_([], "key string"), recorded, probes, requests, answers).collect()}
    assert found == {"a": ("verified", None, 1, 1, 0), "b": ("verified", None, 1, 1, 0), "c": ("flaky", "no-progress", 0, 0, 1)}
    assert crawl.crawl(docs.limit(0), keys_([], "key string"), recorded.limit(0), probes, requests, answers).count() == 0


def test_running_sum_over_blocks(spark, monkeypatch):
    from shelfmark.operators import steps

    monkeypatch.setattr(steps, "BLOCK", 7)
    found = steps.running_sum(spark.range(40).select(F.col("id").alias("ord"), (F.col("id") % 5).alias("v")), "ord", "v", "s").orderBy("ord").collect()
    total = 0
    for r in found:
        total += r["v"]
        assert r["s"] == total


def test_build_of_a_remastered_tree(spark):
    side = spark.createDataFrame([("k1", "body", "h1", 5), ("k2", "error", None, None)], "key string, status string, content_hash string, content_length long")
    entries = spark.createDataFrame([("k1", "h2", True, 9), ("k2", None, False, None)], "key string, output_hash string, rewritten boolean, output_length int")
    assert {tuple(r) for r in build.remastered_sidecars(side, entries).collect()} == {("k1", "body", "h2", 9), ("k2", "error", None, None)}


def test_marks_are_written_linearly(spark):
    """A long chain beside a wide level: each key is written a few times, not once a level."""
    chain = [(f"k{i}", f"k{i + 1}") for i in range(60)] + [("k60", "k3"), ("k5", None), (None, "x")]
    wide = [("k0", f"w{i}") for i in range(3_000)] + [(f"w{i}", "k1") for i in range(3_000)]
    edges = spark.createDataFrame(chain + wide, "parent string, child string").coalesce(2)
    found = graph.reachable(edges, spark.createDataFrame([("k0",), ("k0",), (None,)], "key string"))
    rows = {r["key"]: r["depth"] for r in found.collect()}
    assert found.count() == len(rows) == 3_061 and rows["k60"] == 60 and rows["w7"] == 1 and "x" not in rows
    folder = found.inputFiles()[0].rpartition("/")[0].rpartition("/")[0]
    assert spark.read.option("recursiveFileLookup", True).parquet(folder).count() < 6 * 3_061


def test_sweeps_refuse_what_moved(spark):
    side = [("2014/http://a.com/", "body", "2020"), ("2015/http://a.com/", "empty", "2020"), ("2014/http://b.com/", "body", None), ("2014/http://c.com/", "error", "2030")]
    marked = spark.createDataFrame([("2015/http://a.com/",)], "key string")
    found = graph.sweep_manifest(spark.createDataFrame(side, "key string, status string, fetched_at string"), marked, F.lit("2025"), "g1")
    assert [(r["key"], r["reason"], r["cap_object"] is None) for r in found.collect()] == [("2014/http://a.com/", "re-pointed", False)]
    assert sorted(r["object"][:4] for r in graph.sweep_actions(found, "g1", marked).collect()) == ["cap/", "meta"]
    with pytest.raises(Exception, match="of generation g1"):
        graph.sweep_actions(found, "g2", marked).collect()
    with pytest.raises(Exception, match="is reachable"):
        graph.sweep_actions(found, "g1", marked.unionByName(found.select("key"))).collect()


def queried(spark, tmp_path, name, pages):
    """A query's rows over given pages (page_id, url), and those of its SQL."""
    import duckdb

    import __spark_entry__

    made = spark.createDataFrame([(n, url, "<p>x") for n, url in pages], "page_id long, url string, html string")
    made.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.sql(__spark_entry__.oracle_sql()[name])
    found = __spark_entry__.queries()[name](spark, str(tmp_path)).select(*wanted.columns)
    return sorted(map(repr, map(tuple, found.collect()))), sorted(map(repr, wanted.fetchall()))


def test_links_of_pages_with_one_address(spark, tmp_path):
    url = "https://a.example.com/x"
    found, wanted = queried(spark, tmp_path, "archive_links", [(1, url), (2, url + "#top"), (3, url), (4, "https://b.example.com/")])
    assert found == wanted
    assert [row.endswith("2)") for row in wanted] == [row.startswith(("(1", "(2", "(4")) for row in wanted]


def test_answers_hold_once(spark):
    from shelfmark.operators import markdown

    docs = spark.createDataFrame([(1, "<http://a.com/>"), (2, "<http://a.com/>")], "id long, text string")
    twice = spark.createDataFrame([("http://a.com/", "w2"), ("http://a.com/", "w1"), ("http://a.com/", None)], "url string, replay string")
    done, told = markdown.archive_links(docs, twice)
    assert sorted(r["content"] for r in done.collect()) == ["<w1>", "<w1>"] and told.count() == 2
    done, told = markdown.archive_links(docs, twice.withColumn("id", F.lit(2).cast("long")))
    assert [r["content"] for r in done.orderBy("id").collect()] == ["<http://a.com/>", "<w1>"] and told.count() == 1


PAGES = [(n, f"https://a.example.com/{path}") for n, path in ((1, "x"), (3, "x1"), (4, "X1/"), (8, "y"), (12, "y/"), (2, "z"), (5, "z/"), (9, "x"))]


@pytest.mark.parametrize("name", ["generate_manifest", "generate_stats"])
def test_manifest_of_links_that_begin_alike(spark, tmp_path, name):
    found, wanted = queried(spark, tmp_path, name, [*PAGES, (11, None)])
    assert found == wanted


def test_behaviours_of_one_address_twice(spark, tmp_path):
    url = "https://a.example.com/x"
    found, wanted = queried(spark, tmp_path, "host_behaviors", [(2, url), (4, url), (6, url), (7, url), (13, url)])
    assert found == wanted and len(found) == 5
