"""Prefix policies by bisection and by sorting, against every pair."""

import random

import pytest

from shelfmark.operators import prefixes, relations


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("seed", range(3))
def test_prefixes_against_every_pair(spark, monkeypatch, limit, seed):
    monkeypatch.setattr(prefixes, "BROADCAST_ROWS", limit)
    rng = random.Random(seed)
    word = lambda most: "".join(rng.choices("ab/é", k=rng.randint(0, most)))
    policy = [word(6) + "!" * (rng.random() < 0.3) for _ in range(60)]
    policy = [p for p in policy if p] + ["zz", None]
    urls = [word(9) for _ in range(400)] + ["zz", "z", "zzz", "zz", None, ""]
    frame = spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, n int").repartition(7)
    found = prefixes.beginning_with(frame, spark.createDataFrame([(p,) for p in policy], "prefix string"))
    wanted = {i for i, u in enumerate(urls) if u is not None and any(p is not None and u.startswith(p) for p in policy)}
    assert {r["n"] for r in found.collect()} == wanted and found.count() == len(wanted)


@pytest.mark.parametrize("limit", [500_000, 0])
def test_an_empty_prefix_matches_all(spark, monkeypatch, limit):
    monkeypatch.setattr(prefixes, "BROADCAST_ROWS", limit)
    urls = spark.createDataFrame([("a",), ("",), (None,)], "url string")
    assert prefixes.beginning_with(urls, spark.createDataFrame([("",), ("b",)], "prefix string")).count() == 2


def test_many_prefixes_of_many_lengths(spark):
    """No row per prefix length: 100,000 prefixes of 300 lengths, and the rows that reach the test are the URLs."""
    policy = spark.range(100_000).selectExpr("concat('http://', id % 999, '.com/', repeat('x', cast(id % 300 AS int)), '/', id) AS prefix")
    urls = spark.range(3_000).selectExpr("concat('http://', id % 999, '.com/', repeat('x', cast(id % 300 AS int)), '/', id, '/page') AS url", "id")
    found = relations.excluded(urls, policy)
    assert found.count() == 3_000
    plan = found._jdf.queryExecution().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan


def test_redundant_prefixes_go():
    assert prefixes.without_redundant(["b", "ab", "a", "abc", "b", "ba/"]) == ["a", "b"]
