"""Captures of documents with what they need: fetch policy, dry and static runs, and the fixpoint over probes.

The network and the browser enter as tables: ``responses`` (url, status_code)
is what the archive answered, ``probes`` what a browser asked for when it
rendered a document for the nth time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, keys
from .steps import running_sum, settle

#: Probes of a document, at most.
MOST_ITERATIONS = 4


def _has_parts(key: Column) -> Column:
    return key.rlike(r"^[^/]+/[\s\S]")


def frontier(edges: DataFrame) -> DataFrame:
    """(parent, child, flag, dynamic) once per child: requisites and browser-found ones without what no replay serves.

    A child found both ways counts as a requisite and takes the flag that the
    browser saw. Keys without a timestamp stay: they fail when fetched.
    """
    united = edges.groupBy("parent", "child").agg(
        F.coalesce(F.min(F.when(F.col("dynamic"), F.col("flag"))), F.min(F.when(~F.col("dynamic"), F.col("flag")))).alias("flag"),
        F.bool_and("dynamic").alias("dynamic"),
    )
    return united.where(~_has_parts(F.col("child")) | ~classify.is_unmirrorable(keys.key_original(F.col("child"))))


def settled_status(code: Column) -> Column:
    """The status that a response settles: body, redirect or error; null where it is to be asked again."""
    return (
        F.when(code == 200, "body").when(code.between(300, 399), "redirect").when(code.isin(404, 410), "error")
    )


def capture_children(edges: DataFrame, sidecars: DataFrame, responses: DataFrame) -> DataFrame:
    """What becomes of every child of every document: (parent, child, action, status, error).

    Actions: skipped (held), fetched (settled by the response to its URL) or
    failed (no sound key, no response, or one to be asked again).
    """
    held = sidecars.select(F.col("key").alias("child"), F.col("status").alias("held"))
    wanted = frontier(edges).withColumn("url", keys.replay_url(F.col("child"), F.col("flag")))
    rows = wanted.join(held, "child", "left").join(responses.select("url", "status_code"), "url", "left")
    sound, fetched = _has_parts(F.col("child")), settled_status(F.col("status_code"))
    action = F.when(F.col("held").isNotNull(), "skipped").when(sound & fetched.isNotNull(), "fetched").otherwise("failed")
    error = (
        F.when(~sound, "malformed requisite key")
        .when(F.col("status_code").isNull(), "no response")
        .otherwise(F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    )
    return rows.select(
        "parent",
        "child",
        action.alias("action"),
        F.when(action == "skipped", F.col("held")).when(action == "fetched", fetched).alias("status"),
        F.when(action == "failed", error).alias("error"),
    )


def capture_documents(docs: DataFrame, sidecars: DataFrame, responses: DataFrame) -> DataFrame:
    """What becomes of named documents (url or key): (key, action, status, error); 404 and all but 200 fail, held ones are skipped."""
    doc = keys.to_doc(F.col("doc"))
    rows = docs.select("doc", doc["key"].alias("key"), doc["url"].alias("url"))
    held = sidecars.select("key", F.col("status").alias("held"))
    rows = rows.join(held, "key", "left").join(responses.select("url", "status_code"), "url", "left")
    action = F.when(F.col("held").isNotNull(), "skipped").when(F.col("status_code") == 200, "fetched").otherwise("failed")
    error = (
        F.when(F.col("key").isNull(), "no capture")
        .when(F.col("status_code").isNull(), "no response")
        .when(F.col("status_code") == 404, "capture missing")
        .otherwise(F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
    )
    return rows.select(
        "doc",
        "key",
        action.alias("action"),
        F.when(action == "skipped", F.col("held")).when(action == "fetched", F.lit("body")).alias("status"),
        F.when(action == "failed", error).alias("error"),
    )


def dry_run(docs: DataFrame, sidecars: DataFrame, edges: DataFrame) -> DataFrame:
    """Per document: is it held, how large is its recorded frontier, how much of it would be fetched."""
    own = frontier(edges).join(docs.select(F.col("key").alias("parent")), "parent", "left_semi")
    lost = own.join(sidecars.select(F.col("key").alias("child"), F.lit(1).alias("held")), "child", "left")
    counts = lost.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("held").isNull()).alias("missing"))
    there = sidecars.select("key", F.lit(True).alias("present"))
    rows = docs.select("key").join(there, "key", "left").join(counts, "key", "left")
    number = lambda c: F.when(F.col("present"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    return rows.select(
        "key",
        F.coalesce("present", F.lit(False)).alias("present"),
        number("n").alias("frontier"),
        number("missing").alias("would_fetch"),
    )


def static_run(docs: DataFrame, sidecars: DataFrame, edges: DataFrame, responses: DataFrame, most: int) -> DataFrame:
    """Closing recorded frontiers without a browser: (key, ord, requests, fetched, failures, status).

    docs: key, ord (from 0). A child that several documents miss is asked for
    by the first of them, and again by later ones while no response settles
    it. Documents that begin when ``most`` requests are spent are cap-skipped.
    """
    children = capture_children(edges, sidecars, responses).where("action <> 'skipped' AND error IS DISTINCT FROM 'malformed requisite key'")
    asked = children.join(docs.select(F.col("key").alias("parent"), "ord"), "parent")
    first = asked.groupBy("child").agg(F.min("ord").alias("first"))
    asked = asked.join(first, "child").where((F.col("action") == "failed") | (F.col("ord") == F.col("first")))
    counts = asked.groupBy("ord").agg(F.count_if(F.col("action") == "fetched").alias("fetched"), F.count_if(F.col("action") == "failed").alias("failures"))
    rows = docs.select("key", "ord").join(counts, "ord", "left").fillna(0, ["fetched", "failures"])
    rows = rows.withColumn("requests", F.col("fetched") + F.col("failures"))
    spent = running_sum(rows, "ord", "requests", "spent")
    skipped = F.col("spent") - F.col("requests") >= most
    none = lambda c: F.when(skipped, F.lit(0)).otherwise(F.col(c)).alias(c)
    return spent.select(
        "key", "ord", none("requests"), none("fetched"), none("failures"), F.when(skipped, "cap-skipped").otherwise("static").alias("status")
    )


def unresolved(recorded: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Recorded browser-found children (doc, key) without a sidecar, without what no replay serves."""
    wanted = recorded.select("doc", "key").distinct().where(~classify.is_unmirrorable(keys.key_original(F.col("key"))))
    return wanted.join(sidecars.select("key"), "key", "left_anti").select("doc", "key")


def crawl(docs: DataFrame, sidecars: DataFrame, recorded: DataFrame, probes: DataFrame, requests: DataFrame, answers: DataFrame, most: int = MOST_ITERATIONS) -> DataFrame:
    """The fixpoint of probe, record and fetch per document: (doc, status, reason, iterations, recorded, residual).

    docs: doc. sidecars: key. recorded: doc, key (of earlier runs). probes:
    doc, iteration, observed, csp, chrome, unmatched (counts). requests: doc,
    iteration, key (what was asked for and missed). answers: key, status_code.
    Each round takes the open documents' probes: none observed is a probe
    error; new keys are those neither held nor recorded; without new keys a
    document is verified if nothing is left, else flaky with its reason; with
    new keys it is unconverged after ``most`` rounds, else they are recorded
    and asked for. What is settled is held for all documents from the next
    round on. ``residual`` counts new and unresolved keys together.
    """
    held = settle(sidecars.select("key").distinct())
    known = settle(recorded.select("doc", "key").distinct().where(~classify.is_unmirrorable(keys.key_original(F.col("key")))))
    open_ = settle(docs.select("doc").distinct())
    done: list[DataFrame] = []
    counted = settle(docs.select("doc").distinct().withColumn("recorded", F.lit(0).cast("long")))
    for iteration in range(most + 1):
        seen = probes.where(F.col("iteration") == iteration).join(open_, "doc", "right")
        asked = requests.where(F.col("iteration") == iteration).join(open_, "doc", "left_semi").select("doc", "key").distinct()
        new = settle(asked.join(known, ["doc", "key"], "left_anti").join(held, "key", "left_anti").select("doc", "key"))
        lost = known.join(open_, "doc", "left_semi").join(held, "key", "left_anti").select("doc", "key")
        left = new.groupBy("doc").agg(F.count("*").alias("n_new"))
        right = lost.groupBy("doc").agg(F.count("*").alias("n_lost"))
        both = new.unionByName(lost).distinct().groupBy("doc").agg(F.count("*").alias("residual"))
        rows = seen.join(left, "doc", "left").join(right, "doc", "left").join(both, "doc", "left").fillna(0)
        clean = (F.col("n_lost") == 0) & (F.col("unmatched") == 0) & (F.col("chrome") == 0) & (F.col("csp") == 0)
        status = (
            F.when(F.col("observed") == 0, "probe-error")
            .when((F.col("n_new") == 0) & clean, "verified")
            .when(F.col("n_new") == 0, "flaky")
            .when(F.lit(iteration >= most), "unconverged")
        )
        reason = (
            F.when(F.col("csp") > 0, "csp-residual")
            .when(F.col("chrome") > 0, "unexpected-archive-request")
            .when(F.col("n_lost") > 0, "no-progress")
            .otherwise("unmatched-escapes")
        )
        rows = settle(
            rows.select(
                "doc", status.alias("status"), F.when(status == "flaky", reason).alias("reason"), F.lit(iteration).alias("iterations"),
                F.when(status == "probe-error", 0).otherwise(F.col("residual")).alias("residual"),
            )
        )
        done.append(rows.where("status IS NOT NULL"))
        open_ = settle(rows.where("status IS NULL").select("doc"))
        if open_.isEmpty():
            break
        new = new.join(open_, "doc", "left_semi")
        known = settle(known.unionByName(new))
        more = new.groupBy("doc").agg(F.count("*").alias("more"))
        counted = settle(counted.join(more, "doc", "left").select("doc", (F.col("recorded") + F.coalesce("more", F.lit(0))).alias("recorded")))
        wanted = known.join(open_, "doc", "left_semi").select("key").distinct().join(held, "key", "left_anti")
        got = wanted.join(answers.where(settled_status(F.col("status_code")).isNotNull()).select("key"), "key", "left_semi")
        held = settle(held.unionByName(got))
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out.join(counted, "doc").select("doc", "status", "reason", "iterations", "recorded", "residual")


def ordered_frontier(edges: DataFrame) -> DataFrame:
    """(parent, n, child): the order in which a document's children are asked for.

    edges: parent, child, dynamic, ord. Requisites come in document order,
    then browser-found ones; a child found twice keeps its first place.
    """
    first = edges.groupBy("parent", "child").agg(F.min(F.struct("dynamic", "ord")).alias("at"))
    order = F.array_sort(F.collect_list(F.struct("at", "child")))  # one document's children
    return first.groupBy("parent").agg(order.alias("o")).select("parent", F.posexplode("o").alias("n", "x")).select("parent", "n", "x.child")
