"""Relational operators over ledgers, captures and their references.

Schemas: ``manifests`` (file, ord, section, url, target, timestamp) in long
form, ``sidecars`` (key, status, content_type, content_hash, content_length,
flag), ``edges`` (parent, child, dynamic, flag). "First" always follows an
explicit ordinal. Null keys join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, keys
from ..functions.text import has_resource_extension
from .prefixes import beginning_with


def first_by(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", number).where("_n = 1").drop("_n")


def latest_rows(ledger: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last row of each key of an append-only ledger."""
    return first_by(ledger, [key], [F.desc(seq)])


def flatten(manifests: DataFrame) -> DataFrame:
    """One union manifest: per section and url the first verdict by file order and position.

    ``noRewrite`` is never united; excludes are a set.
    """
    united = manifests.where("section <> 'noRewrite'")
    return first_by(united, ["section", "url"], ["ord", "pos"]).select("section", "url", "target", "file")


def against(ledger: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Captures that a ledger names, by what the store has: unfetched, cached, interstitial or error.

    ledger: key, file, ord, replay. One row per key: files (distinct, joined by
    a comma), n_files and the first replay spelling.
    """
    grouped = ledger.groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"),
        F.countDistinct("file").alias("n_files"),
        F.min(F.struct("ord", "replay"))["replay"].alias("replay"),
    )
    state = (
        F.when(F.col("status").isNull(), "unfetched")
        .when(F.col("status") == "interstitial", "interstitial")
        .when(F.col("status") == "error", "error")
        .otherwise("cached")
    )
    return grouped.join(sidecars.select("key", "status"), "key", "left").select(
        "key", "files", "n_files", "replay", state.alias("state")
    )


def excluded(urls: DataFrame, prefixes: DataFrame) -> DataFrame:
    """URLs equal to or beginning with a policy prefix, each row once: see :func:`.prefixes.beginning_with`."""
    return beginning_with(urls, prefixes).distinct()


def apply_policy(urls: DataFrame, rewrites: DataFrame, excludes: DataFrame) -> DataFrame:
    """The policy's answer per URL: excluded, rewritten (to target) or open; exclusion wins."""
    out = excluded(urls.select("url"), excludes).withColumn("_out", F.lit(True))
    return (
        urls.join(out, "url", "left")
        .join(rewrites.select("url", "target"), "url", "left")
        .select(
            "url",
            F.when(F.col("_out"), "excluded").when(F.col("target").isNotNull(), "rewritten").otherwise("open").alias("answer"),
            F.when(F.col("_out").isNull(), F.col("target")).alias("target"),
        )
    )


def link_verdicts(links: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each link's verdict by comparison key: noRewrite, exclude, rewrites, entries, in this precedence."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("noRewrite", "exclude", "rewrites", "entries")]), F.col("section"))
    best = (
        verdicts.select(keys.match_key(F.col("url")).alias("mk"), "section", "target", rank.alias("rank"), "pos")
        .groupBy("mk")
        .agg(F.min(F.struct("rank", "pos", "section", "target")).alias("v"))
    )
    return links.withColumn("mk", keys.match_key(F.col("url"))).join(best, "mk", "left").select(
        "link_id", "url", F.coalesce("v.section", F.lit("none")).alias("section"), F.col("v.target").alias("target")
    )


def nearest_captures(targets: DataFrame, cdx: DataFrame, months: tuple[int, ...] = (2, 12, 60)) -> DataFrame:
    """The capture nearest to each target's timestamp in the first window that has one, else the latest.

    targets: url, near (digits). cdx: url, timestamp, ord. Distance is the
    difference of 14-digit numbers; ties go to the smaller ord. Windows are
    whole months to both sides with day overflow.
    """
    near = F.rpad("near", 14, "0")
    day = F.to_date(F.substr(near, F.lit(1), F.lit(8)), "yyyyMMdd")
    shifted = lambda n: F.date_format(
        F.date_add(F.add_months(F.trunc(day, "MM"), n), F.dayofmonth(day) - 1), "yyyyMMdd"
    )
    when = F.substr("timestamp", F.lit(1), F.lit(8))
    bucket = F.lit(len(months))
    for k in reversed(range(len(months))):
        bucket = F.when(when.between(shifted(-months[k]), shifted(months[k])), k).otherwise(bucket)
    last = bucket == len(months)
    distance = F.abs(F.rpad("timestamp", 14, "0").cast("long") - near.cast("long"))
    order = F.when(last, -F.rpad("timestamp", 14, "0").cast("long")).otherwise(distance)
    ranked = targets.join(cdx, "url").select("url", "near", "timestamp", "ord", bucket.alias("window"), order.alias("_d"))
    return first_by(ranked, ["url", "near"], ["window", "_d", "ord"]).drop("_d")


def missing_children(edges: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Closure check: children without a sidecar, with their number of parents; dynamic if only found so."""
    united = edges.groupBy("parent", "child").agg(F.bool_and("dynamic").alias("dynamic"))
    return (
        united.join(sidecars.select(F.col("key").alias("child")), "child", "left_anti")
        .groupBy("child")
        .agg(F.count("*").alias("parents"), F.bool_and("dynamic").alias("dynamic"))
    )


def fetch_frontier(edges: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Children to fetch: not held, not unmirrorable; the fetch URL takes the dynamic flag before the static one."""
    flags = edges.groupBy("child").agg(
        F.min(F.when(F.col("dynamic"), F.col("flag"))).alias("dynamic_flag"),
        F.min(F.when(~F.col("dynamic"), F.col("flag"))).alias("static_flag"),
    )
    wanted = flags.where(~classify.is_unmirrorable(keys.key_original(F.col("child"))))
    flag = F.coalesce("dynamic_flag", "static_flag")
    return wanted.join(sidecars.select(F.col("key").alias("child")), "child", "left_anti").select(
        "child", keys.replay_url(F.col("child"), flag).alias("fetch_url")
    )


def reverse_edges(edges: DataFrame) -> DataFrame:
    """How many documents need each child, and the first of them."""
    return edges.groupBy("child").agg(F.countDistinct("parent").alias("parents"), F.min("parent").alias("first_parent"))


def key_parity(expected: DataFrame, listed: DataFrame) -> DataFrame:
    """Keys of one side only: missing (expected alone) or extra (listed alone)."""
    joined = expected.select("key").distinct().withColumn("e", F.lit(1)).join(
        listed.select("key").distinct().withColumn("l", F.lit(1)), "key", "full_outer"
    )
    return joined.where("e IS NULL OR l IS NULL").select("key", F.when(F.col("e").isNull(), "extra").otherwise("missing").alias("side"))


def field_parity(expected: DataFrame, heads: DataFrame) -> DataFrame:
    """Fields that differ between entries and object heads (key, field, expected, actual); a missing object is one."""
    joined = expected.alias("e").join(heads.alias("h"), "key", "left")
    served = keys.content_type
    rows = F.array(
        F.when(F.col("h.status").isNull(), F.struct(F.lit("object").alias("field"), F.lit("present").alias("expected"), F.lit("absent").alias("actual"))),
        F.when(
            F.col("e.status") != F.col("h.status"),
            F.struct(F.lit("status").alias("field"), F.col("e.status").alias("expected"), F.col("h.status").alias("actual")),
        ),
        F.when(
            F.col("h.status").isNotNull() & (served(F.col("e.content_type")) != served(F.col("h.content_type"))),
            F.struct(
                F.lit("contentType").alias("field"),
                served(F.col("e.content_type")).alias("expected"),
                served(F.col("h.content_type")).alias("actual"),
            ),
        ),
    )
    return joined.select("key", F.explode(F.array_compact(rows)).alias("m")).select("key", "m.*")


def body_parity(expected: DataFrame, objects: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Bodies whose digest differs from the entry's, or that are missing; verified keys are skipped."""
    todo = expected if verified is None else expected.join(verified.select("key"), "key", "left_anti")
    actual = objects.select("key", keys.sri(F.col("content")).alias("actual"))
    return todo.join(actual, "key", "left").where(~F.col("content_hash").eqNullSafe(F.col("actual"))).select(
        "key", F.col("content_hash").alias("expected"), "actual"
    )


def drift(committed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Build entries that appear, vanish or change between two builds."""
    fields = sorted(c for c in committed.columns if c != "key")
    row = F.to_json(F.struct(*fields))
    a, b = committed.select("key", row.alias("a")), fresh.select("key", row.alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return a.join(b, "key", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("key", kind.alias("drift"))


def upstream_classes(references: DataFrame, sidecars: DataFrame, frontier: DataFrame) -> DataFrame:
    """Distinct upstream references by class, with documents and the first occurrence.

    references: doc, ord, key, resource. Classes: in-store, unmirrorable,
    frontier, resource, page.
    """
    ids = references.withColumn("key", keys.strip_fragment(F.col("key"))).groupBy("key").agg(
        F.countDistinct("doc").alias("docs"),
        F.bool_or("resource").alias("resource"),
        F.min(F.struct("doc", "ord"))["doc"].alias("first_doc"),
    )
    held = sidecars.select(keys.strip_fragment(F.col("key")).alias("key")).distinct().withColumn("held", F.lit(True))
    ahead = frontier.select(keys.strip_fragment(F.col("key")).alias("key")).distinct().withColumn("ahead", F.lit(True))
    kind = (
        F.when(F.col("held"), "in-store")
        .when(classify.is_unmirrorable(keys.key_original(F.col("key"))), "unmirrorable")
        .when(F.col("ahead"), "frontier")
        .when(F.col("resource") | has_resource_extension(keys.key_original(F.col("key"))), "resource")
        .otherwise("page")
    )
    return ids.join(held, "key", "left").join(ahead, "key", "left").select("key", kind.alias("class"), "docs", "first_doc")


def union_frontier(edges: DataFrame) -> DataFrame:
    """(key): every child that any document records, without its fragment, once.

    edges: parent, child, and error (of browser-found entries, null if sound):
    children of broken entries are not recorded.
    """
    return edges.where("error IS NULL").select(keys.strip_fragment(F.col("child")).alias("key")).distinct()


def class_entries(classes: DataFrame) -> DataFrame:
    """The references of each upstream class by key, as a report lists them; sorted by range over the executors."""
    return classes.select("class", "key", "docs").orderBy("class", "key")
