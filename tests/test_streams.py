"""Ledgers and body verification as streams, stopped and resumed."""

import json

import pytest

from shelfmark.operators.relations import latest_rows
from shelfmark.sources import tree
from shelfmark.streaming import bodies, ledgers


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")


def stamp(key, seq, **more):
    return {"key": key, "seq": seq, "ruleVersion": 7, "at": "2024-01-01T00:00:00Z"} | more


def test_streamed_ledger_agrees_with_the_whole_one(spark, tmp_path):
    inbox, out, point = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        query = ledgers.keep_latest(ledgers.stream_jsonl(spark, str(inbox)), out, point)
        query.awaitTermination()
        whole = spark.read.schema(ledgers.STAMP).option("mode", "DROPMALFORMED").json(str(inbox))
        rows = lambda df: sorted(map(repr, df.collect()))
        latest = ledgers.read_latest(spark, out)
        assert rows(latest.select("key", "seq")) == rows(latest_rows(whole.where("key IS NOT NULL")).select("key", "seq"))
        for rule in (7, 8):
            assert rows(ledgers.verified_keys(latest, rule)) == rows(ledgers.verified_keys(whole, rule))
        return sorted(r["key"] for r in ledgers.verified_keys(latest, 7).collect())

    put(inbox, "a.json", [stamp("a", 1), stamp("b", 2), stamp("c", 3, ruleVersion=6), stamp(None, 4), '{"key": "torn'])
    assert run() == ["a", "b"]
    # A tombstone takes a stamp back, a late row changes nothing, a new stamp counts again.
    put(inbox, "b.json", [{"key": "a", "seq": 9, "verified": False}, stamp("b", 1, ruleVersion=6), stamp("c", 10), stamp("d", 11)])
    assert run() == ["b", "c", "d"]
    assert run() == ["b", "c", "d"]
    put(inbox, "c.json", [stamp("a", 12), stamp("d", 12, ruleVersion=8)])
    assert run() == ["a", "b", "c"]
    changed = spark.read.parquet(out)
    assert {(r["key"], r["seq"]) for r in changed.where("batch > 0").select("key", "seq").collect()} == {("a", 9), ("c", 10), ("d", 11), ("a", 12), ("d", 12)}
    packed = ledgers.compact(spark, out, str(tmp_path / "packed"))
    assert packed.count() == 4


def test_append_keeps_earlier_rows(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    for seq in (1, 2):
        ledgers.append_rows(spark.createDataFrame([("a", seq, 7, None if seq == 1 else False, None)], ledgers.STAMP), folder)
    whole = spark.read.schema(ledgers.STAMP).json(folder)
    assert whole.count() == 2 and ledgers.verified_keys(whole, 7).count() == 0


def test_latest_rows_are_kept_without_a_call_for_each_key(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        query = ledgers.keep_latest(ledgers.stream_jsonl(spark, str(inbox)), out, str(tmp_path / "cp"))
        query.awaitTermination()
        return [s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]]

    # One key has most rows; of rows with one seq the last of a file stays, and that of a later batch.
    put(inbox, "a.json", [*(stamp("hot", n) for n in range(5_000)), stamp("hot", 4_999, ruleVersion=8), *(stamp(f"k{n}", n) for n in range(500)), stamp("k3", 3, at=None)])
    assert not any("Pandas" in name or "Python" in name for name in run())
    first = {r["key"]: r for r in spark.read.parquet(out).collect()}
    assert len(first) == 501 and (first["hot"]["seq"], first["hot"]["ruleVersion"], first["k3"]["at"]) == (4_999, 8, None)
    put(inbox, "b.json", [stamp("hot", 4_998), stamp("k1", 1, ruleVersion=9), stamp("k2", 1), {"key": "k4"}, stamp("new", -1)])
    run()
    later = spark.read.parquet(out).where("batch = 1")
    assert {(r["key"], r["seq"], r["ruleVersion"]) for r in later.collect()} == {("k1", 1, 9), ("new", -1, 7)}
    latest = ledgers.read_latest(spark, out)
    assert latest.count() == 502 and latest.where("key = 'k1'").first()["ruleVersion"] == 9


def test_replayed_batch_writes_the_same_again(spark, tmp_path):
    inbox, out, point = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    run = lambda: ledgers.keep_latest(ledgers.stream_jsonl(spark, str(inbox)), out, str(point)).awaitTermination()
    rows = lambda: sorted(map(repr, spark.read.parquet(out).collect()))
    put(inbox, "a.json", [stamp("a", 1), stamp("b", 2)])
    run()
    put(inbox, "b.json", [stamp("a", 3), stamp("b", 1), stamp("c", 1)])
    run()
    before = rows()
    assert len(before) == 4
    for name in ("1", ".1.crc"):  # as if the driver had been lost before the second batch was committed
        (point / "commits" / name).unlink(missing_ok=True)
    run()
    assert rows() == before


def test_ledger_is_written_by_the_tasks_that_read_its_rows(spark, monkeypatch):
    from shelfmark.plans import files
    from shelfmark.plans.catalogue import table

    from .conftest import DATA

    append, tasks = ledgers.append_rows, []
    monkeypatch.setattr(ledgers, "append_rows", lambda rows, folder: (tasks.append(rows.rdd.getNumPartitions()), append(rows, folder)))
    small = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0"}
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        files.ledger_stream(spark, DATA)
        read = table(spark, DATA, "events").rdd.getNumPartitions()
    finally:
        for name in small:
            spark.conf.unset(name)
        tree.drop_fresh(spark)
    assert read > 4 and tasks == [read, read]


def test_verification_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from shelfmark.functions import keys

    root = str(tmp_path / "root")
    rows = spark.range(6).select(F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    rows = rows.select(keys.body_path(keys.sri(F.col("content"))).alias("path"), "content")
    tree.write_tree(rows, root)
    tree.write_tree(spark.createDataFrame([("cap/00/wrong", bytearray(b"x"))], tree.SCHEMA), root)
    state = bodies.state_folder(str(tmp_path / "state"), "sig", "https://e/", "b", "/p/")
    assert state == bodies.state_folder(str(tmp_path / "state"), "sig", "https://e", "b", "p")
    assert len({state, *(bodies.state_folder(str(tmp_path / "state"), *x) for x in (("s2", "https://e", "b", "p"), ("sig", "https://e", "c", "p")))}) == 3
    # The third batch fails: its files, and they alone, are hashed again.
    good = bodies.keys.body_path
    calls = []

    def failing(column):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return good(column)

    monkeypatch.setattr(bodies.keys, "body_path", failing)
    with pytest.raises(Exception, match="lost"):
        bodies.verify_bodies(bodies.stream_bodies(spark, root, 2), state).awaitTermination()
    assert bodies.found_bodies(spark, state).count() == 4
    bodies.verify_bodies(bodies.stream_bodies(spark, root, 2), state).awaitTermination()
    found = bodies.found_bodies(spark, state)
    assert found.count() == 7 and found.select("path").distinct().count() == 7
    assert [r["path"] for r in found.where("NOT sound").collect()] == ["cap/00/wrong"]
    # Nothing is left: another run reads no body.
    query = bodies.verify_bodies(bodies.stream_bodies(spark, root, 2), state)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 0


def test_layers_under_another_sample(spark):
    passed = spark.createDataFrame([(1.0, True), (3.0, True), (4.0, True), (2.0, False)], "layer double, pass boolean")
    layers = lambda *x: sorted(r["layer"] for r in bodies.valid_layers(passed, *x).collect())
    assert layers(5.0, 5.0) == [1.0, 3.0, 4.0] and layers(5.0, 6.0) == [1.0, 3.0] and layers(5.0, None) == [1.0, 3.0]


def test_tree_refuses_paths_outside(spark, tmp_path):
    for path in ("../x", "/x", "a//b", "a/./b", "a/..", "", None):
        with pytest.raises(Exception, match="no file can be written"):
            tree.write_tree(spark.createDataFrame([(path, bytearray(b"x"))], tree.SCHEMA), str(tmp_path / "t"))
    tree.write_tree(spark.createDataFrame([], tree.SCHEMA), str(tmp_path / "t"))
    # Equal rows, and the same rows again, leave one whole file.
    twice = spark.createDataFrame([("a/..b", bytearray(b"x"))] * 2, tree.SCHEMA).repartition(2)
    for _ in range(2):
        tree.write_tree(twice, "file://" + str(tmp_path / "t"))
    assert [p.name for p in (tmp_path / "t").rglob("*") if p.is_file()] == ["..b"]


def test_projection_needs_each_sidecar_at_its_place(spark, tmp_path):
    from shelfmark.sources import store

    key = "2014/http://a.com/"
    place = spark.range(1).select(store_path(key)).first()[0]
    json_ = json.dumps({"v": 3, "key": key, "status": "empty"})
    for n, path in enumerate((place, "meta/00/x.json")):
        tree.write_tree(spark.createDataFrame([(path, json_)], "path string, content string"), str(tmp_path / f"r{n}"))
    assert [r["key"] for r in store.read_for_projection(spark, str(tmp_path / "r0")).collect()] == [key]
    with pytest.raises(Exception, match="is not the place of"):
        store.read_for_projection(spark, str(tmp_path / "r1")).collect()


def store_path(key):
    from pyspark.sql import functions as F

    from shelfmark.functions import keys

    return keys.meta_path(F.lit(key))


def test_fresh_roots_are_dropped_together(spark):
    import os

    roots = [tree.fresh_root(spark, "x") for _ in range(2)]
    for root in roots:
        tree.write_tree(spark.createDataFrame([("a", "b")], "path string, content string"), root)
    local = [r.removeprefix("file://") for r in roots]
    assert all(map(os.path.exists, local))
    tree.drop_fresh(spark)
    assert not any(map(os.path.exists, local))


def most_tasks(spark, group):
    """The largest number of tasks that a stage of a job group had."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s)


def spread(spark, root, name="{0}/{0}.json"):
    """A tree of 60 files in as many folders; returns their paths."""
    paths = [name.format(f"{n:02d}") for n in range(60)]
    tree.write_tree(spark.createDataFrame([(p, p) for p in paths], "path string, content string").coalesce(2), root)
    return paths


def test_streamed_bodies_cost_the_driver_no_task_each(spark, tmp_path):
    root, state = str(tmp_path / "root"), str(tmp_path / "state")
    paths = spread(spark, root, "cap/{0}/{0}")
    query = bodies.verify_bodies(bodies.stream_bodies(spark, root, 50), state)
    query.awaitTermination()
    assert sorted(r["path"] for r in bodies.found_bodies(spark, state).collect()) == paths
    assert sorted(p["numInputRows"] for p in query.recentProgress if p["numInputRows"]) == [10, 50]
    assert most_tasks(spark, str(query.runId)) < 40
    # A body that was written anew is hashed anew.
    tree.write_tree(spark.createDataFrame([("cap/07/07", "other")], "path string, content string"), root)
    bodies.verify_bodies(bodies.stream_bodies(spark, root, 50), state).awaitTermination()
    assert [r["length"] for r in bodies.found_bodies(spark, state).where("path = 'cap/07/07'").orderBy("length").collect()] == [5, 9]


@pytest.mark.parametrize("read", ["read_entries", "read_bodies", "read_raw_sidecars", "read_texts", "discover_manifests"])
def test_files_are_listed_by_few_tasks(spark, tmp_path, read):
    from shelfmark.sources import store

    name, more = {
        "read_bodies": ("cap/{0}/{0}", (True,)), "read_raw_sidecars": ("meta/{0}/{0}.json", ()), "read_texts": ("a/{0}/b/c/d/{0}.json", ("*.json",)),
        "discover_manifests": ("a/{0}/wayback.json", ()), "read_entries": ("{0}/a/b/c/{0}", ()),
    }[read]
    root = str(tmp_path / "root")
    paths = spread(spark, root, name)
    spread(spark, root, "a/.hidden/{0}/wayback.json")
    spread(spark, root, "a/node_modules/{0}/wayback.json") if read == "discover_manifests" else None
    spark.sparkContext.setJobGroup(f"listing {read}", "")
    try:
        rows = getattr(store, read)(spark, root, *more).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    files = [(r["path"] if "path" in r else r["file"]).removeprefix(root + "/") for r in rows]
    assert sorted(files) == paths and most_tasks(spark, f"listing {read}") < 40
    if read == "discover_manifests":
        assert [f for _, f in sorted((r["ord"], r["file"]) for r in rows)] == paths and [r["ord"] for r in sorted(rows, key=lambda r: r["file"])] == list(range(1, 61))


def test_a_tree_is_not_taken_for_a_small_table(spark, tmp_path):
    from shelfmark.sources import store

    root = str(tmp_path / "root")
    spread(spark, root, "cap/{0}/{0}")
    plan = spark.range(10**9).selectExpr("cast(id AS string) AS path").join(store.read_bodies(spark, root, content=True), "path")
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
