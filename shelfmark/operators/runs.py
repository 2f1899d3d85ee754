"""Runs over the archive as queries: audits, link resolution, request classification, fill plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, keys, text
from .relations import apply_policy

#: Routes of github.com that are no owners.
GITHUB_ROUTES = (
    "about account apps blog codespaces collections contact copilot customer-stories dashboard discussions enterprise"
    " events explore features issues join login logout marketplace mobile new notifications organizations orgs pricing"
    " pulls readme resources search security sessions settings signup site sponsors stars team topics trending users"
).split()
_INERT = r"^(?i)(data|blob|about|filesystem|chrome|chrome-extension):"


def github_repo(url: Column) -> Column:
    """struct(owner, repo, rest) of a deep link into a repository; null for roots, routes and movable paths."""
    pattern = r"^(?i)https?://(?:www\.)?github\.com(?::(?:80|443))?/([A-Za-z0-9_-]+)/([A-Za-z0-9_.-]+)([/?#][^\n]*)\z"
    part = lambda k: F.regexp_extract(url, pattern, k)
    path = F.split_part(F.split_part(part(3), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    dots = F.exists(F.split(path, "/"), lambda s: F.replace(F.lower(s), F.lit("%2e"), F.lit(".")).isin(".", ".."))
    sound = (
        url.rlike(pattern)
        & ~url.rlike(r"[\\\t\r\n]")
        & ~F.lower(part(1)).isin(GITHUB_ROUTES)
        & ~part(2).isin(".", "..")
        & path.rlike("[^/]")
        & ~dots
    )
    return F.when(sound, F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).alias("rest")))


def graft(url: Column, owner: Column, repo: Column) -> Column:
    """A deep link's path on another repository."""
    return F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, github_repo(url)["rest"])


def audit_verdicts(scope: DataFrame, cdx: DataFrame, responses: DataFrame) -> DataFrame:
    """Verdict of each replay URL: good, wayback404 or suspect, with its reason. Never silently good.

    scope: url. cdx: key, statuscode, error (of the lookup). responses: url,
    status, content_type, body (text), error. Rows of cdx and responses are
    unique by key and url.
    """
    r = keys.parse_replay(F.col("url"))
    rows = scope.select("url", keys.capture_key(r["timestamp"], r["original"]).alias("key"))
    rows = rows.join(cdx.select("key", "statuscode", F.col("error").alias("cdx_error"), F.lit(True).alias("listed")), "key", "left")
    rows = rows.join(responses.select("url", "status", "content_type", "body", F.col("error").alias("fetch_error")), "url", "left")
    # Page, title and text stand behind a select each, so that every use of them reads one value.
    rows = rows.withColumn("_page", text.audit_strip(F.col("body")))
    rows = rows.withColumns({"_title": classify.title_of(F.col("_page")), "_text": classify.text_of(F.col("_page"))})
    rows = rows.withColumn("v", classify.replay_verdict(F.col("_title"), F.col("_text")))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("i", classify.interstitial(F.col("key"), F.col("content_type"), F.col("body"), none))
    fits = classify.is_htmlish(F.col("content_type"), with_plain=True)
    said = lambda verdict, reason: F.struct(
        (F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
    )
    clean_but_unlisted = (F.col("v.verdict") == "good") & F.col("cdx_error").isNotNull()
    mismatch = F.when(F.col("i.signature") == "extension-mismatch", "suspect").otherwise("wayback404")
    result = (
        F.when(F.col("key").isNull(), said("suspect", "no replay URL"))
        .when(F.col("statuscode").rlike(r"^[45]\d\d\z"), said("wayback404", "archived as an error"))
        .when(F.col("status").isNull() | F.col("fetch_error").isNotNull(), said("suspect", "replay fetch failed"))
        .when(F.col("status") == 404, said("wayback404", "capture missing"))
        .when(F.col("status") != 200, said("suspect", "replay not 200"))
        .when(~fits, said("good", "not HTML"))
        .when(F.col("i").isNotNull(), said(mismatch, F.concat(F.lit("interstitial: "), F.col("i.signature"))))
        .when(clean_but_unlisted, said("suspect", "content clean, lookup failed"))
        .otherwise(F.col("v"))
    )
    return rows.select("url", "statuscode", result.alias("r")).select("url", "statuscode", "r.verdict", "r.reason")


def generate(links: DataFrame, forbidden: DataFrame, rewrites: DataFrame, excludes: DataFrame, seen: DataFrame, resolved: DataFrame) -> DataFrame:
    """The manifest section of each link and which step gave it.

    links: url. forbidden: url (noRewrite). seen: url, section, target.
    resolved: url, snapshot, renamed, error (what the archive and the rename
    probe said). Steps: policy, seen, resolved, deferred (nothing or an error
    came back). Forbidden links are dropped.
    """
    mk = keys.match_key(F.col("url"))
    open_links = links.select("url").distinct().withColumn("mk", mk)
    open_links = open_links.join(forbidden.select(mk.alias("mk")).distinct(), "mk", "left_anti")
    policy = apply_policy(open_links.select("url"), rewrites, excludes).withColumnRenamed("target", "policy_target")
    rank = F.array_position(F.array(F.lit("exclude"), F.lit("rewrites"), F.lit("entries")), F.col("section"))
    known = seen.select(mk.alias("mk"), F.struct(rank.alias("rank"), "section", "target").alias("s"))
    known = known.groupBy("mk").agg(F.min("s").alias("s"))
    rows = open_links.join(policy, "url").join(known, "mk", "left").join(resolved, "url", "left")
    said = lambda section, target, step: F.struct(
        (F.lit(section) if isinstance(section, str) else section).cast("string").alias("section"),
        target.cast("string").alias("target"),
        F.lit(step).alias("step"),
    )
    none = F.lit(None)
    answer = (
        F.when(F.col("answer") == "excluded", said("exclude", none, "policy"))
        .when(F.col("answer") == "rewritten", said("rewrites", F.col("policy_target"), "policy"))
        .when(F.col("s").isNotNull(), said(F.col("s.section"), F.col("s.target"), "seen"))
        .when(F.col("snapshot").isNotNull() & F.col("error").isNull(), said("entries", F.col("snapshot"), "resolved"))
        .when(F.col("renamed").isNotNull() & F.col("error").isNull(), said("rewrites", F.col("renamed"), "resolved"))
        .when(F.col("asked") & F.col("error").isNull(), said("exclude", none, "resolved"))
        .otherwise(said(none, none, "deferred"))
    )
    return rows.select("url", answer.alias("a")).select("url", "a.*")


def classify_requests(requests: DataFrame, held: DataFrame, origin: str) -> DataFrame:
    """Each request as local or non-local, and hit, miss or n/a; inert schemes and noise are dropped."""
    parsed = requests.where(~F.col("url").rlike(_INERT)).select(
        "*", F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1).alias("o")
    ).where("o <> ''")
    local = F.lower("o") == origin
    path = F.regexp_extract("url", r"^[^/]+//[^/?#]+(/[^?#]*)", 1)
    rows = parsed.select("*", local.alias("local"), F.when(local, keys.parse_path(path)["key"]).alias("key"))
    store = held.select("key").distinct().withColumn("held", F.lit(True))
    corpus = F.when(F.col("key").isNull(), "n/a").when(F.col("held"), "hit").otherwise("miss")
    return rows.join(store, "key", "left").select(
        "doc", "url", F.when(F.col("local"), "local").otherwise("non-local").alias("origin"), corpus.alias("corpus"), "resource_type"
    )


def map_findings(classified: DataFrame) -> DataFrame:
    """What each dangling or non-local request is: entry (with key and flag), escape, chrome, beacon or unparseable."""
    leaks = classified.where("corpus = 'miss' OR origin = 'non-local'")
    path = F.regexp_extract("url", r"^[^/]+//[^/?#]+(/[^?#]*)", 1)
    # Parsed first and classified in a second step: the expressions stay small enough to compile.
    parsed = leaks.select(
        "doc",
        "url",
        "resource_type",
        (F.col("origin") == "non-local").alias("away"),
        keys.parse_path(path).alias("local"),
        keys.parse_replay(F.col("url")).alias("remote"),
        keys.hostname(F.col("url")).alias("host"),
    ).withColumn("beacon", classify.is_beacon(F.col("remote.original")))
    away, host = F.col("away"), F.col("host")
    kind = (
        F.when(~away & F.col("local").isNull(), "unparseable")
        .when(~away, "entry")
        .when(F.col("remote").isNotNull() & F.col("beacon"), "beacon")
        .when(F.col("remote").isNotNull(), "entry")
        .when(host.isNull(), "unparseable")
        .when((host == "archive.org") | F.endswith(host, F.lit(".archive.org")), "chrome")
        .otherwise("escape")
    )
    key = F.when(away, keys.capture_key(F.col("remote.timestamp"), F.col("remote.original"))).otherwise(F.col("local.key"))
    own = F.when(away, F.col("remote.flag")).otherwise(F.col("local.flag"))
    flag = keys.infer_flag(F.when(own.isin(*keys.REQUISITE_FLAGS), own), F.col("resource_type"))
    return parsed.select(
        "doc", "url", kind.alias("kind"), F.when(kind == "entry", key).alias("key"), F.when(kind == "entry", flag).alias("flag")
    )


def is_csp_violation(message: Column) -> Column:
    return F.coalesce(message.rlike("(?i)content security policy|refused to (load|connect|execute|apply|frame)"), F.lit(False))


def compiled_policy(raw: DataFrame) -> DataFrame:
    """The entries of escape policies in JSON (file, json): ord, host, reason. Hosts are trimmed and lowered, empty ones dropped.

    Entries keep their order within a file and files theirs by name; what is
    no policy has none.
    """
    read = F.from_json("json", "version INT, escapes ARRAY<STRUCT<host:STRING,reason:STRING>>")
    rows = raw.select("file", F.posexplode(read["escapes"]).alias("pos", "e"))
    rows = rows.select("file", "pos", F.lower(F.trim("e.host")).alias("host"), F.coalesce("e.reason", F.lit("")).alias("reason"))
    return rows.where("host <> ''").select(F.struct("file", "pos").alias("ord"), "host", "reason")


def _under_hosts(urls: DataFrame, policy: DataFrame) -> DataFrame:
    """(url, host, the policy row's other columns) of distinct URLs and policy hosts that are theirs or above them.

    A host is exploded into its label suffixes, as many as a policy host has
    labels at most, so the match is an equi-join.
    """
    most = policy.agg(F.max(F.size(F.split("host", "[.]")))).first()[0] or 0  # one number of a policy
    n = F.size("labels")
    suffixes = F.transform(F.sequence(F.greatest(n - most + 1, F.lit(1)), n), lambda i: F.array_join(F.slice("labels", i, n), "."))
    split = urls.select("url").distinct().select("url", F.split(keys.hostname(F.col("url")), "[.]").alias("labels")).where("labels IS NOT NULL")
    return split.select("url", F.explode(suffixes).alias("host")).join(policy, "host")


def policy_matches(urls: DataFrame, policy: DataFrame) -> DataFrame:
    """Each distinct URL with the first policy entry (by ord) that allows its host: url, host, reason, null where none does."""
    first = _under_hosts(urls, policy).groupBy("url").agg(F.min(F.struct("ord", "host", "reason")).alias("m"))
    return urls.select("url").distinct().join(first, "url", "left").select("url", "m.host", "m.reason")


def unmatched_escapes(escapes: DataFrame, policy: DataFrame) -> DataFrame:
    """Escapes whose host no policy row allows; a row allows its host and hosts under it."""
    known = policy.select(F.lower(F.trim("host")).alias("host")).where("host <> ''").distinct()
    return escapes.join(_under_hosts(escapes, known).select("url").distinct(), "url", "left_anti")


def fill_plan(worklist: DataFrame, settled: DataFrame) -> DataFrame:
    """The pending part of a worklist (unfetched or cached, not gone or renamed), in key order."""
    pending = worklist.where(F.col("state").isin("unfetched", "cached")).join(settled.select("key"), "key", "left_anti")
    return pending.select("key", "state").distinct().orderBy("key")


def fill_stats(outcomes: DataFrame, by: str) -> DataFrame:
    """Counts of outcomes: attempted (all but cached), fetched, cached, deferred, gone."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return outcomes.groupBy(by).agg(
        F.count_if(F.col("outcome") != "cached").alias("attempted"), *map(count, ("fetched", "cached", "deferred", "gone"))
    )


def heartbeat(rows: DataFrame, by: str, seq: str, every: int) -> DataFrame:
    """Every nth row of a run with its running number."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(seq))
    return rows.select(by, seq, number.alias("done")).where(F.col("done") % every == 0)


def canonical_manifest(verdicts: DataFrame) -> DataFrame:
    """(file, json) in canonical order: sections in a fixed order, keys sorted, lists sorted and distinct."""
    listed = lambda s: F.array_sort(F.collect_set(F.when(F.col("section") == s, F.col("url"))))
    mapped = lambda s: F.map_from_entries(
        F.array_sort(F.collect_set(F.when(F.col("section") == s, F.struct(F.col("url"), F.col("target")))))
    )
    body = F.to_json(
        F.struct(
            F.lit(2).alias("version"),
            listed("noRewrite").alias("noRewrite"),
            mapped("rewrites").alias("rewrites"),
            mapped("entries").alias("entries"),
            listed("exclude").alias("exclude"),
        ),
        {"pretty": "false"},
    )
    return verdicts.groupBy("file").agg(body.alias("json"))


def source_refs(inline: DataFrame, sibling: DataFrame) -> DataFrame:
    """Archive references of sources: those in the text and those of the manifest beside it, once each.

    inline: source, url (replay URLs). sibling: source, target (replay URLs of entries).
    """
    both = inline.select("source", "url").unionByName(sibling.select("source", F.col("target").alias("url")))
    r = keys.parse_replay(F.col("url"))
    return both.select("source", r["timestamp"].alias("timestamp"), r["original"].alias("original")).where("original IS NOT NULL").distinct()


def manifest_survey(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per manifest file: how many entries, rewrites and excludes it has; files without any are listed, too."""
    count = lambda section: F.count_if(F.col("section") == section)
    sums = verdicts.groupBy("file").agg(count("entries").alias("entries"), count("rewrites").alias("rewrites"), count("exclude").alias("exclude"))
    return files.select("file").distinct().join(sums, "file", "left").fillna(0)


def generate_stats(links: DataFrame, answers: DataFrame) -> DataFrame:
    """urls, from_universe, from_seen, resolved and deferred of a run of :func:`generate`."""
    count = lambda step: F.count_if(F.col("step") == step)
    steps = links.select("url").distinct().select(F.lit("url").alias("step")).unionByName(answers.select("step"))
    return steps.agg(
        count("url").alias("urls"),
        count("policy").alias("from_universe"),
        count("seen").alias("from_seen"),
        count("resolved").alias("resolved"),
        count("deferred").alias("deferred"),
    )


def batch_summary(sidecars: DataFrame, caps: DataFrame) -> DataFrame:
    """total, bodied, bodiless and missing_bodies of a push: bodies that are not stored are left out and counted."""
    rows = sidecars.select("status", keys.body_path(F.col("content_hash")).alias("path")).join(
        caps.select("path", F.lit(True).alias("stored")), "path", "left"
    )
    bodied, stored = F.col("status") == "body", F.coalesce("stored", F.lit(False))
    return rows.agg(
        F.count_if(~bodied | stored).alias("total"),
        F.count_if(bodied & stored).alias("bodied"),
        F.count_if(~bodied).alias("bodiless"),
        F.count_if(bodied & ~stored).alias("missing_bodies"),
    )


def bad_list(verdicts: DataFrame) -> DataFrame:
    """Verdicts that need a human, missing captures before suspect ones, by key; sorted by range over the executors."""
    first = F.when(F.col("verdict") == "wayback404", 0).otherwise(1)
    return verdicts.where("verdict <> 'good'").select("verdict", "key").orderBy(first, "key")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return verdicts.agg(count("good"), count("wayback404"), count("suspect"))


def class_counts(bodies: DataFrame, occurrences: DataFrame, classes: DataFrame) -> DataFrame:
    """What a scan saw: (name, n) of scanned bodies, occurrences, distinct references and each class."""
    scanned = bodies.agg(F.count("*").alias("n")).select(F.lit("scanned").alias("name"), "n")
    seen = occurrences.agg(F.count("*").alias("n")).select(F.lit("occurrences").alias("name"), "n")
    distinct = classes.agg(F.count("*").alias("n")).select(F.lit("distinct").alias("name"), "n")
    each = classes.groupBy(F.col("class").alias("name")).agg(F.count("*").alias("n"))
    return scanned.unionByName(seen).unionByName(distinct).unionByName(each)


def browser_layer(observed: DataFrame, found: DataFrame) -> DataFrame:
    """Per rendered document (doc, requests): findings by kind and whether it passes; no request at all fails closed.

    found: doc, kind (non-local-request, dangling-local, csp-violation).
    """
    sums = found.groupBy("doc").agg(F.count("*").alias("n"))
    rows = observed.join(sums, "doc", "left")
    silent = F.when(F.col("requests") == 0, 1).otherwise(0)
    findings = (F.coalesce("n", F.lit(0)) + silent).alias("findings")
    return rows.select("doc", findings, (silent == 1).alias("no_evidence")).withColumn("pass", F.col("findings") == 0)


def settle_missing(missing: DataFrame, probes: DataFrame) -> DataFrame:
    """What becomes of captures that the archive lacks: (url, outcome, to).

    missing: url (replay). probes: original, renamed_to, error (of the
    repository's root). A probe that failed defers, a rename is a candidate
    for a rewrite, anything else is gone; what is no deep link into a
    repository is not probed.
    """
    rows = missing.select("url", keys.parse_replay(F.col("url"))["original"].alias("original"))
    rows = rows.withColumn("deep", github_repo(F.col("original")).isNotNull()).join(probes, "original", "left")
    outcome = (
        F.when(F.col("deep") & F.col("error").isNotNull(), "deferred")
        .when(F.col("deep") & F.col("renamed_to").isNotNull(), "renamed")
        .otherwise("gone")
    )
    return rows.select("url", outcome.alias("outcome"), F.when(outcome == "renamed", F.col("renamed_to")).alias("to"))


def audit_scope(entries: DataFrame) -> DataFrame:
    """(key, url, original) of manifest entries (url, target, timestamp): the key is of the authored URL; in key order."""
    key = keys.capture_key(F.col("timestamp"), F.col("url"))
    return entries.select(key.alias("key"), F.col("target").alias("url"), F.col("url").alias("original")).orderBy("key")


def parity_layers(missing: DataFrame, fields: DataFrame, bodies: DataFrame, serving: DataFrame) -> DataFrame:
    """Per layer of a parity run: findings and whether it passes; a run passes if all layers do."""
    count = lambda rows, layer, name: rows.agg(F.count("*").alias("findings")).select(
        F.lit(layer).alias("layer"), F.lit(name).alias("name"), "findings"
    )
    every = count(missing, 1, "keys").unionByName(count(fields, 2, "metadata"))
    every = every.unionByName(count(bodies, 3, "bodies")).unionByName(count(serving, 4, "serving"))
    return every.withColumn("pass", F.col("findings") == 0)


def locale_order(*columns: Column | str) -> list[Column]:
    """The columns as sort keys in the order of the Unicode collation, as browsers compare strings without a locale."""
    return [F.collate(c, "UNICODE") for c in columns]


def ordered_refs(refs: DataFrame) -> DataFrame:
    """Source references (source, timestamp, original) with their place in collation order: source, timestamp, original."""
    number = F.row_number().over(Window.partitionBy("source").orderBy(*locale_order("timestamp", "original")))
    return refs.select("source", "timestamp", "original", number.alias("n"))


def exact_captures(cdx: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index's row of each wanted capture (url, timestamp), whatever its status: null where it has none.

    cdx: url, ord, timestamp, original, statuscode, mimetype. Of rows with
    that very timestamp the first by ord counts; a longer or shorter one is
    another capture.
    """
    row = F.struct("ord", "original", "statuscode", "mimetype")
    first = cdx.groupBy("url", "timestamp").agg(F.min(row).alias("row"))
    return wanted.select("url", "timestamp").join(first, ["url", "timestamp"], "left").select(
        "url", "timestamp", "row.original", "row.statuscode", "row.mimetype"
    )


def audit_todo(scope: DataFrame, done: DataFrame, limit: int | None = None) -> DataFrame:
    """What an audit has left: the scope's first ``limit`` captures by key, less those with a verdict in the checkpoint.

    The limit is the run's own (a report of the first few), and counts
    captures that are done.
    """
    ordered = scope.orderBy("key")
    return (ordered.limit(limit) if limit is not None else ordered).join(done.select("key").distinct(), "key", "left_anti")
