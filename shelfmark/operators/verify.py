"""Verification of a store, its builds and its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, keys

#: Findings that make the proof of ownership fail, so that orphans are not judged.
SUSPENDING = ("malformed", "missingBody", "hashMismatch", "sizeMismatch", "schemaVersion")
SEVERITY = {
    "malformed": "corruption",
    "hashMismatch": "corruption",
    "sizeMismatch": "corruption",
    "keyMismatch": "corruption",
    "missingBody": "corruption",
    "incompleteClosure": "incomplete",
    "interstitialAsBody": "advisory",
    "schemaVersion": "advisory",
    "foreignRoot": "advisory",
    "orphanCap": "reapable",
    "staleTmp": "reapable",
}
#: What a store's root may hold.
ROOT_NAMES = ("cap", "meta", "tmp", "trash", ".refetch", ".crawl", ".verify", "remaster.build.json")
#: Fixed value: the mark of a quarantine that these tools made.
TRASH_MARK = ".fsck-quarantine"


def sidecar_findings(sidecars: DataFrame) -> DataFrame:
    """Findings of the sidecars alone: (category, key).

    sidecars: path, v, key, status, content_type, content_hash, content_length.
    """
    bodied = F.col("status") == "body"
    broken = (
        F.col("key").isNull()
        | F.coalesce(~F.col("status").isin(*classify.STATUSES), F.lit(True))
        | (~bodied & (F.col("content_hash").isNotNull() | F.col("content_length").isNotNull()))
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("v").isNull() | (F.col("v") != 3), "schemaVersion"),
            F.when(broken, "malformed"),
            F.when(F.col("key").isNotNull() & (F.col("path") != keys.meta_path(F.col("key"))), "keyMismatch"),
        )
    )
    return sidecars.select(F.explode(found).alias("category"), F.coalesce("key", "path").alias("key"))


def body_findings(sidecars: DataFrame, caps: DataFrame) -> DataFrame:
    """Findings of bodied sidecars against the stored bodies (path, digest, length); without a sound digest there is no body."""
    wanted = sidecars.where("status = 'body'").select("key", "content_hash", "content_length")
    wanted = wanted.withColumn("path", keys.body_path(F.col("content_hash")))
    joined = wanted.join(caps.select("path", "digest", "length"), "path", "left")
    found = F.array_compact(
        F.array(
            F.when(F.col("digest").isNull(), "missingBody"),
            F.when(F.col("digest") != F.col("content_hash"), "hashMismatch"),
            F.when(F.col("length") != F.col("content_length"), "sizeMismatch"),
        )
    )
    return joined.select(F.explode(found).alias("category"), "key")


def orphan_bodies(sidecars: DataFrame, caps: DataFrame, findings: DataFrame) -> DataFrame:
    """Bodies that no sidecar names; none at all while a suspending finding exists."""
    named = sidecars.select(keys.body_path(F.col("content_hash")).alias("path")).where("path IS NOT NULL").distinct()
    doubts = findings.where(F.col("category").isin(*SUSPENDING)).agg(F.count("*").alias("doubts"))
    return caps.join(named, "path", "left_anti").where(doubts.scalar() == 0).select(
        F.lit("orphanCap").alias("category"), F.col("path").alias("key")
    )


def _graded(found: DataFrame) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for item in SEVERITY.items() for x in item])
    return found.withColumn("severity", severity[F.col("category")])


def fsck(sidecars: DataFrame, caps: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Findings of sidecars, bodies and, with edges, closure: category, severity, key."""
    found = sidecar_findings(sidecars).unionByName(body_findings(sidecars, caps))
    found = found.unionByName(orphan_bodies(sidecars, caps, found))
    if edges is not None:
        lost = closure_findings(sidecars, edges).select("category", F.col("detail").alias("key")).distinct()
        found = found.unionByName(lost)
    return _graded(found).select("category", "severity", "key")


def closure_findings(sidecars: DataFrame, edges: DataFrame) -> DataFrame:
    """incompleteClosure once per bodied document and child without a sidecar: (category, key, detail).

    What no replay serves is never missing. detail is the child.
    """
    bodied = sidecars.where("status = 'body'").select(F.col("key").alias("parent"))
    wanted = edges.select("parent", "child").distinct().join(bodied, "parent", "left_semi")
    lost = wanted.join(sidecars.select(F.col("key").alias("child")), "child", "left_anti")
    lost = lost.where(~classify.is_unmirrorable(keys.key_original(F.col("child"))))
    return lost.select(F.lit("incompleteClosure").alias("category"), F.col("parent").alias("key"), F.col("child").alias("detail"))


def interstitial_findings(sidecars: DataFrame, caps: DataFrame) -> DataFrame:
    """Bodied sidecars whose bytes (caps: path, content) are the archive's page about the capture: (category, key, detail)."""
    wanted = sidecars.where("status = 'body'").select("key", "content_type", keys.body_path(F.col("content_hash")).alias("path"))
    body = F.when(classify.is_htmlish(F.col("content_type")), F.decode("content", "UTF-8"))
    sign = classify.interstitial(F.col("key"), F.col("content_type"), body, F.lit(None).cast("string"))
    found = wanted.join(caps.select("path", "content"), "path").select("key", sign["signature"].alias("detail"))
    return found.where("detail IS NOT NULL").select(F.lit("interstitialAsBody").alias("category"), "key", "detail")


def root_findings(entries: DataFrame) -> DataFrame:
    """foreignRoot and staleTmp of a store's files (path from the root): (category, key, detail).

    A root entry outside the contract is foreign, and so is a trash folder
    without the mark of a quarantine; whatever lies in tmp is stale.
    """
    top = F.split_part("path", F.lit("/"), F.lit(1))
    second = F.split_part("path", F.lit("/"), F.lit(2))
    named = entries.select("path", top.alias("top"), second.alias("second")).where("path <> ''")
    tops = named.groupBy("top").agg(F.bool_or(F.col("second") == TRASH_MARK).alias("marked"))
    foreign = tops.where(~F.col("top").isin(*ROOT_NAMES) | ((F.col("top") == "trash") & ~F.col("marked")))
    why = F.when(F.col("top") == "trash", "no mark of a quarantine")
    stale = named.where("top = 'tmp' AND second <> ''").select(F.lit("staleTmp").alias("category"), F.col("second").alias("key")).distinct()
    return foreign.select(F.lit("foreignRoot").alias("category"), F.col("top").alias("key"), why.alias("detail")).unionByName(
        stale.withColumn("detail", F.lit(None).cast("string"))
    )


def quarantine_hints(sidecars: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, quarantined): where in the trash the body of a bodied sidecar lies; the first run that has it."""
    place = F.regexp_extract("path", r"^trash/[^/]+/(cap/[^/]+/[^/]+)\z", 1)
    moved = entries.select("path", place.alias("cap")).where("cap <> ''").groupBy("cap").agg(F.min("path").alias("quarantined"))
    wanted = sidecars.where("status = 'body'").select("key", keys.body_path(F.col("content_hash")).alias("cap"))
    return wanted.join(moved, "cap").select("key", "quarantined")


def fsck_store(sidecars: DataFrame, caps: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """All eleven categories: category, severity, key, detail.

    caps: path, digest, length, content. entries: path of every file from the
    root. detail: the missing child, the interstitial's signature, where a
    missing body is in quarantine, or why a root entry is foreign.
    """
    none = F.lit(None).cast("string")
    base = sidecar_findings(sidecars).unionByName(body_findings(sidecars, caps))
    base = base.unionByName(orphan_bodies(sidecars, caps.select("path"), base))
    hinted = base.join(quarantine_hints(sidecars, entries), "key", "left").select(
        "category", "key", F.when(F.col("category") == "missingBody", F.col("quarantined")).otherwise(none).alias("detail")
    )
    found = (
        hinted.unionByName(closure_findings(sidecars, edges))
        .unionByName(interstitial_findings(sidecars, caps))
        .unionByName(root_findings(entries))
    )
    return _graded(found).select("category", "severity", "key", "detail")


def fsck_totals(findings: DataFrame, fix: bool = False) -> DataFrame:
    """Per category, all of them: severity, found, reaped (reapable ones, if they are to be) and unresolved."""
    spark = findings.sparkSession
    every = spark.createDataFrame([(i, *x) for i, x in enumerate(SEVERITY.items())], "ord int, category string, severity string")
    counts = findings.groupBy("category").agg(F.count("*").alias("n"))
    found = F.coalesce("n", F.lit(0))
    reaped = F.when((F.col("severity") == "reapable") & F.lit(fix), found).otherwise(0)
    return every.join(counts, "category", "left").select(
        "ord", "category", "severity", found.alias("found"), reaped.alias("reaped"), (found - reaped).alias("unresolved")
    )


def layer_verdict(layers: DataFrame, by: str) -> DataFrame:
    """A run passes if each of its layers does; layers: by, layer, findings, observed (null where none is due).

    A layer that was to observe something and saw nothing fails.
    """
    sound = (F.col("findings") == 0) & (F.col("observed").isNull() | (F.col("observed") > 0))
    return layers.groupBy(by).agg(
        F.bool_and(sound).alias("pass"), F.count("*").alias("layers"), F.count_if(~sound).alias("failed"), F.sum("findings").alias("findings")
    )


def heal_verdict(attempts: DataFrame, by: str, ceiling: float = 0.01) -> DataFrame:
    """Per group: checked, healed, failed and PASS, PASS-DEGRADED (healed share over the ceiling) or FAIL."""
    sums = attempts.groupBy(by).agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("outcome") == "healed").alias("healed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    share = F.coalesce(F.try_divide("healed", "checked"), F.lit(0.0))
    verdict = F.when(F.col("failed") > 0, "FAIL").when(share > ceiling, "PASS-DEGRADED").otherwise("PASS")
    return sums.select("*", verdict.alias("verdict"))


def root_signature(entries: DataFrame, *fields: str, shard_chars: int = 4) -> DataFrame:
    """A digest of all entries in key order that no single task gathers.

    The lines of a shard (first characters of the key's hash) are digested in
    key order; the signature digests the shard digests in order. The number
    of shards is fixed (16 ** shard_chars).
    """
    line = F.concat(F.to_json(F.struct(*fields)), F.lit("\n"))
    shard = F.substr(keys.capture_hash(F.col("key")), F.lit(1), F.lit(shard_chars))
    shards = entries.select(shard.alias("shard"), "key", line.alias("line")).groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct("key", "line"))).alias("rows"), F.count("*").alias("n")
    )
    digests = shards.select(
        "shard", "n", F.sha2(F.array_join(F.transform("rows", lambda r: r["line"]), ""), 256).alias("digest")
    )
    whole = F.array_sort(F.collect_list(F.struct("shard", "digest")))
    return digests.agg(
        F.sha2(F.array_join(F.transform(whole, lambda r: r["digest"]), ""), 256).alias("signature"), F.sum("n").alias("n_entries")
    )


def sample_per_status(entries: DataFrame, n: int) -> DataFrame:
    """The first n keys of each status."""
    number = F.row_number().over(Window.partitionBy("status").orderBy("key"))
    return entries.select("status", "key", number.alias("n")).where(F.col("n") <= n)


def resume_state(stored: Column, signature: Column, target: Column, sample: Column) -> Column:
    """What of a checkpoint (struct signature, target, sample) is valid: none, all but serving, or all."""
    return (
        F.when(stored.isNull() | (stored["signature"] != signature) | (stored["target"] != target), "none")
        .when(~stored["sample"].eqNullSafe(sample), "without-serving")
        .otherwise("all")
    )


def failure_streaks(outcomes: DataFrame, by: str, seq: str, limit: int) -> DataFrame:
    """Outcomes with their run of connection failures; rows after a run of ``limit`` are cut.

    outcomes: by, seq, outcome (connfail, cached, or a reply). A reply ends a
    run; cached rows neither end nor lengthen it.
    """
    order = Window.partitionBy(by).orderBy(seq)
    resets = F.sum(F.when(~F.col("outcome").isin("connfail", "cached"), 1).otherwise(0)).over(order)
    island = outcomes.withColumn("island", resets)
    run = F.sum(F.when(F.col("outcome") == "connfail", 1).otherwise(0)).over(
        Window.partitionBy(by, "island").orderBy(seq)
    )
    counted = island.withColumn("streak", run)
    reached = F.min(F.when(F.col("streak") >= limit, F.col(seq))).over(Window.partitionBy(by))
    return counted.withColumn("_cut", reached).where(F.col("_cut").isNull() | (F.col(seq) <= F.col("_cut"))).drop(
        "_cut", "island"
    )


def capped(outcomes: DataFrame, by: str, seq: str, most: int) -> DataFrame:
    """Outcomes up to ``most`` paid attempts; cached rows are free."""
    paid = F.sum(F.when(F.col("outcome") == "cached", 0).otherwise(1)).over(Window.partitionBy(by).orderBy(seq))
    return outcomes.withColumn("paid", paid).where(F.col("paid") <= most)


def crawl_verdict(runs: DataFrame) -> DataFrame:
    """Verdict per document after its probes.

    runs: doc, probe_error, csp_residual, unexpected, unmatched, progress,
    open, iterations, most. In this precedence: probe-error, flaky with its
    reason, unconverged, verified.
    """
    flaky = (
        F.when(F.col("csp_residual") > 0, "csp-residual")
        .when(F.col("unexpected") > 0, "unexpected-archive-request")
        .when((F.col("open") > 0) & ~F.col("progress"), "no-progress")
        .when(F.col("unmatched") > 0, "unmatched-escapes")
    )
    verdict = (
        F.when(F.col("probe_error"), "probe-error")
        .when(flaky.isNotNull(), "flaky")
        .when((F.col("open") > 0) & (F.col("iterations") >= F.col("most")), "unconverged")
        .otherwise("verified")
    )
    return runs.select("doc", verdict.alias("verdict"), F.when(verdict == "flaky", flaky).alias("reason"))


def redirect_walk(starts: DataFrame, redirects: DataFrame, hops: int = 5) -> DataFrame:
    """Where bounded redirect walks end: (start, end, hops, outcome).

    redirects: url, location (null where the walk ends), one row per url.
    Outcomes: arrived, lost (no such url) or too-many-hops.
    """
    at = starts.select(F.col("url").alias("start"), F.col("url").alias("at"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(hops + 1):
        step = redirects.select(F.col("url").alias("at"), F.col("location"), F.lit(True).alias("known"))
        joined = at.join(step, "at", "left")
        over = F.col("outcome").isNotNull()
        at = joined.select(
            "start",
            F.when(over | F.col("location").isNull(), F.col("at")).otherwise(F.col("location")).alias("at"),
            F.when(over | F.col("location").isNull(), F.col("hops")).otherwise(F.col("hops") + 1).alias("hops"),
            F.when(over, F.col("outcome")).when(F.col("known").isNull(), "lost").when(F.col("location").isNull(), "arrived").alias("outcome"),
        )
    return at.select("start", F.col("at").alias("end"), "hops", F.coalesce("outcome", F.lit("too-many-hops")).alias("outcome"))


def serve_decision(requests: DataFrame, sidecars: DataFrame, live_fallback: bool = False) -> DataFrame:
    """The response to each request path: (path, key, action, status).

    The raw path is looked up first, its decoded form only where that misses.
    """
    held = sidecars.select("key", F.col("status").alias("state"))
    parsed = requests.select(
        "path",
        keys.parse_path(F.col("path"))["key"].alias("raw"),
        keys.parse_path(keys.decode_path(F.col("path")))["key"].alias("decoded"),
    )
    found = (
        parsed.join(held.select(F.col("key").alias("raw"), F.col("state").alias("s1")), "raw", "left")
        .join(held.select(F.col("key").alias("decoded"), F.col("state").alias("s2")), "decoded", "left")
        .withColumn("state", F.coalesce("s1", "s2"))
        .withColumn("key", F.when(F.col("s1").isNotNull() | F.col("s2").isNull(), F.col("raw")).otherwise(F.col("decoded")))
    )
    away = F.lit("live" if live_fallback else "not-found")
    action = (
        F.when(F.col("raw").isNull() & F.col("decoded").isNull(), "not-found")
        .when(F.col("state").isNull(), away)
        .when(F.col("state") == "interstitial", away)
        .when(F.col("state") == "redirect", "redirect")
        .when(F.col("state") == "error", "gone")
        .when(F.col("state") == "empty", "empty")
        .otherwise("body")
    )
    status = (
        F.when(action == "body", 200).when(action == "empty", 200).when(action.isin("redirect", "live"), 302).otherwise(404)
    )
    return found.select("path", "key", action.alias("action"), status.cast("int").alias("status"))


def served(wanted: DataFrame, store: DataFrame, host: str) -> DataFrame:
    """What a mirror at ``host`` answers for each key: key, status, content_type, location, body (bytes).

    wanted: key. store: key, status, content_type, location (of redirects),
    body. Keys that the store does not have, errors and interstitials get the
    page for a miss, which names the mirror.
    """
    rows = wanted.select("key").join(store.select("key", "status", "content_type", "location", "body"), "key", "left")
    hit, moved = F.col("status").isin("body", "empty"), F.col("status") == "redirect"
    miss = F.encode(F.concat(F.lit(f"<title>Not in {host}</title>"), keys.escape_html(F.col("key"))), "UTF-8")
    return rows.select(
        "key",
        F.when(hit, 200).when(moved, 302).otherwise(404).alias("status"),
        F.when(hit, keys.content_type(F.col("content_type"))).when(~F.coalesce(moved, F.lit(False)), F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.when(moved, F.col("location")).alias("location"),
        F.when(F.col("status") == "body", F.col("body").cast("binary")).when(hit | moved, F.lit(b"")).otherwise(miss).alias("body"),
    )


def serving_parity(root: DataFrame, bucket: DataFrame, root_host: str, bucket_host: str) -> DataFrame:
    """Where two mirrors answer differently: key, field (status, content-type, location, body), expected, actual.

    root, bucket: as :func:`served` gives them, key for key. Each mirror's own
    authority in its bodies is made neutral first; a body's difference tells
    the sizes.
    """

    def shown(answers: DataFrame, host: str, name: str) -> DataFrame:
        neutral = keys.without_mirror_host(F.decode("body", "ISO-8859-1"), host)
        return answers.select(
            "key",
            F.struct(
                F.concat(F.lit(f"{name} "), F.col("status").cast("string")).alias("status"),
                F.concat(F.lit(f"{name} "), F.coalesce("content_type", F.lit("null"))).alias("type"),
                F.concat(F.lit(f"{name} "), F.coalesce("location", F.lit("null"))).alias("location"),
                F.concat(F.lit(f"{name} "), F.length(neutral).cast("string"), F.lit("B")).alias("size"),
                F.struct(F.col("status").alias("s"), F.col("content_type").alias("t"), F.col("location").alias("l"), F.sha2(neutral, 256).alias("b")).alias("is"),
            ).alias(name),
        )

    both = shown(root, root_host, "root").join(shown(bucket, bucket_host, "bucket"), "key", "full")

    def differs(field: str, part: str, said: str) -> Column:
        a, b = F.col(f"root.is.{part}"), F.col(f"bucket.is.{part}")
        told = F.struct(F.lit(field).alias("field"), F.col(f"root.{said}").alias("expected"), F.col(f"bucket.{said}").alias("actual"))
        return F.when(~a.eqNullSafe(b), told)

    found = F.array(differs("status", "s", "status"), differs("content-type", "t", "type"), differs("location", "l", "location"), differs("body", "b", "size"))
    return both.select("key", F.explode(F.array_compact(found)).alias("d")).select("key", "d.*")


def index_search(catalogue: DataFrame, text: str, with_requisites: bool, limit: int) -> DataFrame:
    """First keys, in order, that contain a text in any case; requisites only if asked for (a top-k report)."""
    shown = catalogue if with_requisites else catalogue.where(~F.col("requisite"))
    return shown.where(F.contains(F.lower("key"), F.lit(text.lower()))).select("key").orderBy("key").limit(limit)


def batch_lines(captures: DataFrame, bucket: str) -> DataFrame:
    """One copy command per held capture, by object key; captures without body bytes are left out."""
    base = bucket.removeprefix("s3://").rstrip("/")
    target = F.concat(F.lit(f"s3://{base}/"), keys.capture_path(F.col("key")))
    source = F.when(F.col("status") == "body", keys.body_path(F.col("content_hash"))).otherwise(keys.meta_path(F.col("key")))
    line = F.concat_ws(
        " ",
        F.lit("cp --content-type"),
        keys.shell_quote(keys.content_type(F.col("content_type"))),
        F.lit("--metadata"),
        keys.shell_quote(F.concat(F.lit("status="), F.col("status"))),
        keys.shell_quote(source),
        keys.shell_quote(target),
    )
    return captures.select(keys.capture_path(F.col("key")).alias("object_key"), line.alias("line")).where("line IS NOT NULL")
