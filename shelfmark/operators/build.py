"""Commit, merge and rewriting of captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, keys, text
from ..functions.canonical import canonical_json, with_content
from ..sources import store, tree
from .steps import settle


#: Where a remastered tree keeps the record of its build.
RECORD = "remaster.build.json"


def commit(responses: DataFrame) -> DataFrame:
    """Responses (key, content_type, status_code, content, flag) to sidecar rows with their bodies.

    200 with bytes is a body, without bytes empty; 404 and 410 are errors, 3xx
    redirects, what is the archive's own page an interstitial. Others (5xx)
    are not settled and give no row.
    """
    code = F.col("status_code")
    page = F.decode("content", "UTF-8")
    sign = classify.interstitial(F.col("key"), F.col("content_type"), page, F.lit(None).cast("string"))
    status = (
        F.when((code == 200) & sign.isNotNull(), "interstitial")
        .when((code == 200) & (F.coalesce(F.length("content"), F.lit(0)) == 0), "empty")
        .when(code == 200, "body")
        .when(code.isin(404, 410), "error")
        .when(code.between(300, 399), "redirect")
    )
    rows = responses.withColumn("status", status).where("status IS NOT NULL")
    bodied = F.col("status") == "body"
    return rows.select(
        F.lit(3).alias("v"),
        "key",
        "content_type",
        "status",
        F.when(bodied, keys.sri(F.col("content"))).alias("content_hash"),
        F.when(bodied, F.length("content")).cast("long").alias("content_length"),
        "flag",
        F.when(bodied, F.col("content")).alias("content"),
    )


def dynamic_json(entry: Column) -> Column:
    """A browser-found entry (struct key, flag, via, firstSeen) in JSON: its flag is always there, null if it has none."""
    fields = ["key", "flag", "via"]
    shown = lambda names: F.to_json(F.struct(*[entry[n].alias(n) for n in sorted(names)]), {"ignoreNullFields": "false"})
    return F.when(entry["firstSeen"].isNotNull(), shown([*fields, "firstSeen"])).otherwise(shown(fields))


def merge_dynamic(prior: DataFrame, found: DataFrame) -> DataFrame:
    """Browser-found entries (doc, key, flag, via, firstSeen): existing ones win, conflicts among new ones raise."""
    fields = ["flag", "via", "firstSeen"]
    new = found.distinct()
    conflict = F.count("*").over(Window.partitionBy("doc", "key")) > 1
    checked = new.withColumn(
        "key", F.when(conflict, F.raise_error(F.concat(F.lit("conflicting entries for "), F.col("key")))).otherwise(F.col("key"))
    )
    both = prior.select("doc", "key", *fields, F.lit(0).alias("_o")).unionByName(
        checked.select("doc", "key", *fields, F.lit(1).alias("_o"))
    )
    first = F.row_number().over(Window.partitionBy("doc", "key").orderBy("_o"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_o")


def remaster(captures: DataFrame) -> DataFrame:
    """Build entries of all captures: references to held captures become root-relative.

    captures: key, content_type, status, content_hash, body (text of text
    captures). References are exploded and meet the key set in a semi join, so
    no worker holds all keys.
    """
    kind = classify.dialect(F.col("content_type"))
    texts = captures.where(F.col("status") == "body").where(kind.isNotNull()).select("key", kind.alias("kind"), "body")
    refs = texts.select("key", F.explode(text.referenced("body")).alias("ref"))
    held = (
        refs.join(captures.select(F.col("key").alias("ref")).distinct(), "ref", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("ref").alias("held"))
    )
    done = texts.join(held, "key", "left").select("key", text.rewritten("kind", "body", "held").alias("new"))
    entries = captures.join(done, "key", "left")
    output = F.when(F.col("new").isNotNull(), keys.sri(F.col("new.text"))).otherwise(F.col("content_hash"))
    return entries.select(
        "key",
        "content_type",
        "status",
        F.col("content_hash").alias("input_hash"),
        output.alias("output_hash"),
        F.coalesce(output != F.col("content_hash"), F.lit(False)).alias("rewritten"),
        F.coalesce("new.count", F.lit(0)).alias("n_refs"),
    )


def rewritten_bodies(sidecars: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each sidecar (its columns as they are) with input_hash, output_hash, rewritten, and the bytes of its output as content.

    sidecars: key, content_type, status, content_hash. bodies: path, content.
    Bytes are read as ISO-8859-1, which keeps every byte, so that only what is
    rewritten changes. A bodied sidecar without its body is an error.
    """
    wanted = sidecars.select("*", F.when(F.col("status") == "body", keys.body_path(F.col("content_hash"))).alias("_path"))
    lost = F.raise_error(F.concat(F.col("key"), F.lit(" names a missing body at "), F.coalesce("_path", F.lit("(no sound digest)"))))
    rows = wanted.join(bodies.select(F.col("path").alias("_path"), F.col("content").alias("_in")), "_path", "left").withColumn(
        "_in", F.when((F.col("status") == "body") & F.col("_in").isNull(), lost.cast("binary")).otherwise(F.col("_in"))
    )
    kind = classify.dialect(F.col("content_type"))
    texts = rows.where(F.col("_in").isNotNull() & kind.isNotNull()).select("key", kind.alias("kind"), F.decode("_in", "ISO-8859-1").alias("body"))
    refs = texts.select("key", F.explode(text.referenced("body")).alias("ref"))
    held = (
        refs.join(sidecars.select(F.col("key").alias("ref")).distinct(), "ref", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("ref").alias("_held"))
    )
    # The text meets its held references once; it is rewritten beside the row that it belongs to.
    joined = rows.join(held, "key", "left").withColumn("_kind", kind)
    new = text.rewritten("_kind", F.when(F.col("_kind").isNotNull(), F.decode("_in", "ISO-8859-1")), "_held")
    done = joined.withColumn("_new", new)
    out = F.coalesce(F.encode("_new.text", "ISO-8859-1"), F.col("_in"))
    done = done.withColumn("content", out)
    return done.select(
        *[F.col(f"`{c}`") for c in sidecars.columns],
        keys.sri(F.col("_in")).alias("input_hash"),
        keys.sri(F.col("content")).alias("output_hash"),
        F.coalesce(F.col("content") != F.col("_in"), F.lit(False)).alias("rewritten"),
        "content",
    )


def tree_files(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (path, content) of a remastered tree: bodies at their digests, sidecars at their keys.

    built: as :func:`rewritten_bodies` gives it, with each sidecar's JSON as
    read. A body that several captures share is written for one of them.
    Sidecars of rewritten bodies name the new digest and length and keep all
    other fields; the others stay as they are, in canonical form.
    """
    first = built.where("output_hash IS NOT NULL").groupBy("output_hash").agg(F.min("key").alias("key"))
    bodies = built.join(first, ["output_hash", "key"], "left_semi").select(keys.body_path(F.col("output_hash")).alias("path"), "content")
    changed = F.col("rewritten")
    json = with_content(
        canonical_json("json"), F.when(changed, F.col("output_hash")), F.when(changed, F.octet_length("content")).cast("long")
    )
    sidecars = built.select(keys.meta_path(F.col("key")).alias("path"), F.encode(json, "UTF-8").alias("content"))
    return bodies, sidecars


def remaster_tree(spark: SparkSession, hermetic: str, remastered: str) -> DataFrame:
    """Remaster the store below one root into another; the build's entries, read back from its record.

    Bodies are written before sidecars, which mark a capture as complete, and
    the record last: its entries as canonical JSON lines in key order, without
    paths. Each step's rows are derived from the hermetic store alone, so a
    run that is repeated writes the same tree.
    """
    raw = store.read_raw_sidecars(spark, hermetic)
    sidecars = store.parse_sidecars(raw, "strict", "json").select("key", "content_type", "status", "content_hash", "json")
    # Rewritten once; the steps below read it.
    built = settle(rewritten_bodies(sidecars, store.read_bodies(spark, hermetic, content=True)))
    bodies, files = tree_files(built)
    tree.write_tree(bodies, remastered)
    tree.write_tree(files, remastered)
    record = build_record(built.drop("content", "json", "content_hash"))
    tree.write_lines(record, "key", "json", f"{remastered}/{RECORD}")
    return store.read_build_lines(spark, f"{remastered}/{RECORD}")


def remastered_sidecars(sidecars: DataFrame, entries: DataFrame) -> DataFrame:
    """Sidecars of a remastered tree: those of rewritten bodies name the new digest and length, all others stay.

    entries: key, output_hash, rewritten, output_length.
    """
    new = entries.where("rewritten").select("key", F.col("output_hash").alias("_hash"), F.col("output_length").cast("long").alias("_length"))
    joined = sidecars.join(new, "key", "left")
    out = {"content_hash": F.coalesce("_hash", "content_hash"), "content_length": F.coalesce("_length", "content_length")}
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in sidecars.columns])


def build_record(entries: DataFrame) -> DataFrame:
    """(key, json): a build's entries in canonical form, to be written in key order; no paths are in it."""
    fields = F.struct(
        F.col("content_type").alias("contentType"),
        F.col("input_hash").alias("inputHash"),
        "key",
        F.col("output_hash").alias("outputHash"),
        "rewritten",
        "status",
    )
    return entries.select("key", F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def build_counts(entries: DataFrame) -> DataFrame:
    """sidecars, bodies and rewritten of a build."""
    return entries.agg(
        F.count("*").alias("sidecars"), F.count_if(F.col("status") == "body").alias("bodies"), F.count_if("rewritten").alias("rewritten")
    )


def build_integrity(sidecars: DataFrame, record: DataFrame, caps: DataFrame) -> DataFrame:
    """Bodies of a remastered tree against its record and its sidecars: (key, kind, expected, actual).

    sidecars: key, status, content_hash. record: key, output_hash. caps: path,
    digest of what is stored. Kinds: build-orphan, body-missing, body-hash, sidecar-hash.
    """
    bodied = sidecars.where("status = 'body'").select("key", "content_hash", keys.body_path(F.col("content_hash")).alias("path"))
    rows = bodied.join(record.select("key", "output_hash", F.lit(True).alias("listed")), "key", "left").join(
        caps.select("path", "digest"), "path", "left"
    )
    said = lambda kind, expected, actual: F.struct(
        F.lit(kind).alias("kind"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual")
    )
    none, listed, there = F.lit(None), F.col("listed"), F.col("digest").isNotNull()
    found = F.array(
        F.when(listed.isNull(), said("build-orphan", none, none)),
        F.when(listed & ~there, said("body-missing", none, none)),
        F.when(listed & there & ~F.col("output_hash").eqNullSafe(F.col("digest")), said("body-hash", F.col("output_hash"), F.col("digest"))),
        F.when(listed & there & (F.col("content_hash") != F.col("digest")), said("sidecar-hash", F.col("content_hash"), F.col("digest"))),
    )
    return rows.select("key", F.explode(F.array_compact(found)).alias("f")).select("key", "f.*")
