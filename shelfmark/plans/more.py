"""Registered queries over markdown, policies, checks of stores and builds, and crawls, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, keys, text
from ..operators import build, crawl, markdown, relations, runs, verify
from ..sources import store, tree
from . import replay
from .catalogue import CAPTURES, EDGES, assets, captures, query, table

MATCH_KEY = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '^https?://', '', 'i'), '^www\.', '', 'i'), '/+$', ''))"
#: Texts with links in prose, as link text, in code fences, and archived ones; made of a page's address.
_MARKDOWN = (
    "'See ' || url || ' and [x](' || url || '). [' || url || ']' || chr(10) || '```' || chr(10) || url || chr(10) || '```' || chr(10)"
    " || 'Old https://web.archive.org/web/2014/' || url || ' end <' || lower(split_part(url, '://', 1)) || '://' || upper(split_part(url, '://', 2)) || '>'"
)
_SHOUTED = "lower(split_part(url, '://', 1)) || '://' || upper(split_part(url, '://', 2))"
_APPLIED = _MARKDOWN.replace("'See ' || url || ' and [x](' || url", "'See ' || new || ' and [x](' || new").replace(_SHOUTED, f"CASE WHEN new = url THEN {_SHOUTED} ELSE new END")
_SECTIONS = "CASE page_id % 5 WHEN 0 THEN 'noRewrite' WHEN 1 THEN 'rewrites' WHEN 2 THEN 'entries' WHEN 3 THEN 'exclude' END"
_REPLAY = "'https://web.archive.org/web/2015/' || url"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*", "").alias("url"))
    return pages.select(F.col("page_id").alias("id"), "url", F.expr(_MARKDOWN).alias("text"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts under another spelling of the address: scheme, www and slash differ."""
    return _markdown(spark, sf_dir).withColumn("page_id", F.col("id")).where("page_id % 5 <> 4").selectExpr(
        "regexp_replace(url, '^https?://', 'http://www.') || '/' AS url",
        f"{_SECTIONS} AS section",
        f"CASE page_id % 5 WHEN 1 THEN 'https://new.example.com/' || page_id WHEN 2 THEN {_REPLAY} END AS target",
        "page_id AS pos",
    )


_VERDICT_SQL = f"""p AS (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages),
raw AS (SELECT regexp_replace(url, '^https?://', 'http://www.') || '/' AS vurl, {_SECTIONS} AS section, page_id AS pos,
  CASE page_id % 5 WHEN 1 THEN 'https://new.example.com/' || page_id WHEN 2 THEN {_REPLAY} END AS target FROM p WHERE page_id % 5 <> 4),
ranked AS (SELECT {MATCH_KEY.format('vurl')} AS mk, section, target, row_number() OVER (PARTITION BY {MATCH_KEY.format('vurl')}
  ORDER BY list_position(['noRewrite', 'exclude', 'rewrites', 'entries'], section), pos) AS n FROM raw),
told AS (SELECT p.page_id, p.url, section, CASE WHEN section = 'rewrites' THEN target
  WHEN section = 'entries' THEN replace(target, 'https://web.archive.org/web/', 'https://chrome.example.com/web/') ELSE p.url END AS new
  FROM p LEFT JOIN ranked ON n = 1 AND mk = {MATCH_KEY.format('p.url')})"""


@query(f"WITH {_VERDICT_SQL} SELECT page_id AS id, sha256({_APPLIED}) AS content FROM told")
def apply_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their links as the manifest says; fences, link texts and archived links stay."""
    done, _ = markdown.apply_manifest(_markdown(spark, sf_dir), _verdicts(spark, sf_dir), "chrome.example.com")
    return done.select("id", F.sha2("content", 256).alias("content"))


@query(f"""WITH {_VERDICT_SQL} SELECT page_id AS id, unnest([url, {_SHOUTED}]) AS url FROM told WHERE section IS NULL""")
def apply_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.apply_manifest(_markdown(spark, sf_dir), _verdicts(spark, sf_dir), "chrome.example.com")[1]


_LINKED = (
    "'[t](' || url || ') ![i](http://img.example.com/' || page_id || ') <' || url || '/auto>' || chr(10) || '[r]: ' || url || '/ref' || chr(10)"
    " || '<a href=\"' || url || '/html\">h</a> [rel](/local) [old](https://web.archive.org/web/2014/' || url || ') https://skip.example.com/' || page_id || ' ' || url"
)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "#.*", "").alias("url"))
    return pages.select(F.col("page_id").alias("id"), "url", F.expr(_LINKED).alias("text"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages)
SELECT page_id AS id, CAST(pos - 1 AS INT) AS pos, url FROM (
  SELECT page_id, unnest([url, url || '/auto', url || '/ref', url || '/html']) AS url, unnest([1, 2, 3, 4]) AS pos FROM p)"""
)
def archivable_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of five forms in order, without images, relative, archived and skipped ones."""
    skip = spark.createDataFrame([("https://skip.example.com/",)], "prefix string")
    return markdown.archivable_links(_linked(spark, sf_dir), skip)


_SNAPSHOTS = "page_id % 3 <> 0 AND regexp_matches(url, '[.]example[.](com|org)(/|$)')"


@query(
    f"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*', '') AS url FROM pages),
n AS (SELECT *, CASE WHEN {_SNAPSHOTS} THEN {_REPLAY} ELSE url END AS new FROM p)
SELECT page_id AS id, sha256({_LINKED.replace("'[t](' || url", "'[t](' || new").replace("page_id || ' ' || url", "page_id || ' ' || new")}) AS content,
  CAST(CASE WHEN new = url THEN 0 ELSE 2 END AS BIGINT) AS replaced FROM n"""
)
def archive_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that the archive has an answer for, on two domains, become that answer; all else stays as it is."""
    docs = _linked(spark, sf_dir)
    answers = docs.where("id % 3 <> 0").selectExpr("id", "url", f"{_REPLAY} AS replay")
    done, told = markdown.archive_links(docs, answers, None, ["example.com", "example.org"])
    counts = told.groupBy("id").agg(F.count("*").alias("replaced"))
    return done.join(counts, "id", "left").select("id", F.sha2("content", 256).alias("content"), F.coalesce("replaced", F.lit(0)).alias("replaced"))


# Names of addresses, headers, hosts and listings.


@query(
    r"""WITH u AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://web.archive.org/web/2014im_/' || url WHEN 1 THEN '2014/' || url
  WHEN 2 THEN url ELSE '201/' || url END AS doc FROM pages)
SELECT page_id, CASE WHEN regexp_matches(doc, '^https?://web[.]archive[.]org/web/[0-9]{4,14}([a-z]{2}_)?/.') THEN doc
    WHEN regexp_matches(doc, '^[0-9]{4,14}/.') THEN 'https://web.archive.org/web/' || doc END AS url,
  CASE WHEN regexp_matches(doc, '^https?://web[.]archive[.]org/web/[0-9]{4,14}([a-z]{2}_)?/.')
    THEN regexp_replace(doc, '^https?://web[.]archive[.]org/web/([0-9]{4,14})([a-z]{2}_)?/(.*)$', '\1/\3') WHEN regexp_matches(doc, '^[0-9]{4,14}/.') THEN doc END AS key FROM u"""
)
def doc_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay URLs and bare keys name documents; plain addresses and short stamps do not."""
    doc = F.expr(
        "CASE page_id % 4 WHEN 0 THEN 'https://web.archive.org/web/2014im_/' || url WHEN 1 THEN '2014/' || url WHEN 2 THEN url ELSE '201/' || url END"
    )
    return table(spark, sf_dir, "pages").select("page_id", keys.to_doc(doc).alias("d")).select("page_id", "d.*")


@query(
    r"""WITH u AS (SELECT page_id, url, url || ' é' || chr(10) || chr(CAST(page_id % 26 + 65 AS INT)) AS v FROM pages)
SELECT page_id, array_to_string(list_transform(string_split(v, ''), lambda c: CASE WHEN regexp_matches(c, '^[\x20-\x7e]$') THEN c
    ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') AS header,
  replace(replace(replace(replace(replace('<' || url || '>"''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  'https://web.archive.org/web/2014id_/' || url AS raw,
  CASE WHEN page_id % 2 = 0 THEN 'https://chrome.example.com/web/2014/' || url ELSE url END AS chrome,
  replace('see http://localhost:81/' || url, 'http://localhost:81', '<mirror-host>') AS mirrored,
  strftime(TIMESTAMP '2014-01-01' + to_days(CAST(page_id AS INT)), '%b %-d %Y') AS short FROM u"""
)
def address_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header values, escaped text, raw replays, the chrome host, neutral mirrors and short dates."""
    replay = F.expr("CASE WHEN page_id % 2 = 0 THEN 'HTTPS://web.archive.org/web/2014/' || url ELSE url END")
    stamp = F.expr("date_format(date_add(date'2014-01-01', cast(page_id AS int)), 'yyyyMMdd')")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        keys.header_safe(F.expr("url || ' é' || chr(10) || chr(page_id % 26 + 65)")).alias("header"),
        keys.escape_html(F.concat(F.lit("<"), "url", F.lit(">\"'"))).alias("escaped"),
        keys.raw_url(F.concat(F.lit("2014/"), "url")).alias("raw"),
        keys.chrome_host(replay, "chrome.example.com").alias("chrome"),
        keys.without_mirror_host(F.concat(F.lit("see http://localhost:81/"), "url"), "http://localhost:81").alias("mirrored"),
        keys.short_date(stamp).alias("short"),
    )


@query(
    r"""WITH u AS (SELECT page_id, 'https://s3.example.com' || repeat('/', CAST(page_id % 3 AS INT)) AS e, 'b"' || page_id % 7 AS b,
  CASE WHEN page_id % 4 > 0 THEN repeat('/', CAST(page_id % 4 - 1 AS INT)) || 'p/q' || repeat('/', CAST(page_id % 2 AS INT)) END AS p FROM pages)
SELECT page_id, '.verify/' || substr(sha256('["' || rtrim(e, '/') || '","' || replace(b, '"', '\"') || '","' || trim(coalesce(p, ''), '/') || '"]'), 1, 32) || '.json' AS path,
  CAST(least(pow(2, page_id % 9) * 400, 5000) AS BIGINT) AS wait FROM u"""
)
def checkpoint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints by target, whose slashes do not matter, and the waits between attempts."""
    part = lambda e: F.expr(e)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        keys.checkpoint_path(
            part("'https://s3.example.com' || repeat('/', cast(page_id % 3 AS int))"),
            part("'b\"' || page_id % 7"),
            part("CASE WHEN page_id % 4 > 0 THEN repeat('/', cast(page_id % 4 - 1 AS int)) || 'p/q' || repeat('/', cast(page_id % 2 AS int)) END"),
        ).alias("path"),
        keys.backoff(part("page_id % 9 + 1"), 400, 5_000).alias("wait"),
    )


@query(
    """WITH l AS (SELECT page_id // 10 AS page, page_id, url FROM pages)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY page_id) - 1 AS INT) AS pos, url || '&lt;' AS key,
  CASE WHEN page % 2 = 0 THEN 'next&' || page END AS token FROM l"""
)
def bucket_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of paged bucket listings, entities decoded with the ampersand last, and their continuation."""
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, sf_dir, "pages").select(
        F.expr("page_id div 10").alias("page"), "page_id", F.concat(F.lit("<Key>"), escaped, F.lit("&amp;lt;</Key>")).alias("x")
    )
    xml = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "x"))), lambda r: r["x"]), "").alias("x"))
    xml = xml.selectExpr(
        "page",
        "'<ListBucketResult><IsTruncated>' || (page % 2 = 0) || '</IsTruncated>' || x || '<NextContinuationToken>next&amp;' || page || '</NextContinuationToken></ListBucketResult>' AS x",
    )
    listed = xml.select("page", text.next_token(F.col("x")).alias("token"), F.posexplode(text.listed_keys(F.col("x"))).alias("pos", "key"))
    return listed.select("page", "pos", "key", "token")


@query(
    r"""SELECT page_id, tag || ' ' || attr AS place, (tag IN ('a', 'area') AND attr = 'href') OR (tag = 'form' AND attr = 'action') AS navigational,
  CASE WHEN regexp_matches(said, '\b(404|410)\b') THEN 'gone' WHEN regexp_matches(said, 'ECONNRESET|timeout', 'i') THEN 'connfail' ELSE 'transient' END AS failure,
  regexp_matches(split_part(split_part(url, '://', 2), '/', 1), '(^|[.])example[.](com|org)$') AS mine,
  NOT regexp_matches(ct, '[\r\n]') AND length(ct) <= 998 AS safe, regexp_matches(ct, 'html|^text/plain') OR ct = '' AS audited
FROM (SELECT page_id, url, ['a', 'area', 'form', 'img', 'link'][page_id % 5 + 1] AS tag, ['href', 'action', 'src'][page_id % 3 + 1] AS attr,
  ['HTTP 404', 'read ECONNRESET', 'HTTP 503', 'Timeout of 10', 'code 4101'][page_id % 5 + 1] AS said,
  CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' || chr(10) WHEN 2 THEN repeat('x', CAST(990 + page_id % 20 AS INT)) ELSE '' END AS ct FROM pages)"""
)
def small_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigational places, failure classes, domain membership, safe metadata and the audit's document types."""
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % n + 1).cast("int"))
    tag, attr = at(["a", "area", "form", "img", "link"], 5), at(["href", "action", "src"], 3)
    said = at(["HTTP 404", "read ECONNRESET", "HTTP 503", "Timeout of 10", "code 4101"], 5)
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/plain' || chr(10) WHEN 2 THEN repeat('x', cast(990 + page_id % 20 AS int)) ELSE '' END")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat_ws(" ", tag, attr).alias("place"),
        classify.is_navigational(tag, attr).alias("navigational"),
        classify.failure_class(said).alias("failure"),
        (keys.in_domain(F.col("url"), "example.com") | keys.in_domain(F.col("url"), "example.org")).alias("mine"),
        keys.metadata_safe(kind).alias("safe"),
        classify.is_htmlish(kind, with_plain=True).alias("audited"),
    )


@query(
    r"""WITH h AS (SELECT page_id, html || ' http://ARCHIVE.org/about ' || '"https://web.archive.org/web/2014/http://x.example.com/"' AS b FROM pages)
SELECT page_id, CAST(length(html) + 8 AS INT) AS pos, 'http://ARCHIVE.org/about' AS token FROM h JOIN pages USING (page_id)"""
)
def bare_archive_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the archive that are no replay reference, with the word that holds them."""
    body = F.concat("html", F.lit(' http://ARCHIVE.org/about "https://web.archive.org/web/2014/http://x.example.com/"'))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(text.bare_hits(body)).alias("h"))
    return found.select("page_id", "h.pos", "h.token")


# Policies, surveys and reports.

_HOSTS = "split_part(split_part(url, '://', 2), '/', 1)"


@query(
    f"""WITH h AS (SELECT {_HOSTS} AS host, min(page_id) AS id FROM pages GROUP BY 1), known AS (SELECT host FROM h WHERE id % 2 = 0)
SELECT url || CASE WHEN page_id % 3 = 0 THEN '' ELSE '?x' END AS url, 'on404' AS behavior, 'probe-repo-root-follow-rename' AS value
FROM pages WHERE {_HOSTS} IN (SELECT host FROM known)"""
)
def host_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviours of exact hosts, read from a policy in JSON; hosts may be written in capitals or with a root dot."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_HOSTS).alias("host"))
    known = pages.groupBy("host").agg(F.min("page_id").alias("id")).where("id % 2 = 0")
    # A policy a host: no row holds all hosts.
    fqdns = F.create_map("host", F.create_map(F.lit("on404"), F.lit("probe-repo-root-follow-rename")))
    raw = known.select(F.concat("host", F.lit(".json")).alias("file"), F.to_json(F.struct(fqdns.alias("fqdns"))).alias("json"))
    urls = pages.withColumn("url", F.expr("url || CASE WHEN page_id % 3 = 0 THEN '' ELSE '?x' END"))
    spelled = urls.withColumn("as", F.when(F.col("page_id") % 2 == 0, F.expr("replace(url, host, upper(host) || '.')")).otherwise(F.col("url")))
    found = store.host_behaviors(spelled.select(F.col("as").alias("url")).distinct(), store.parse_universe(raw)).withColumnRenamed("url", "as")
    return spelled.join(found, "as").select("url", "behavior", "value")


@query(
    """WITH v AS (SELECT 'f' || CAST(user_id % 7 AS VARCHAR) AS file, ['rewrites', 'entries', 'exclude', 'noRewrite'][event_id % 4 + 1] AS section FROM events)
SELECT 'f' || CAST(k AS VARCHAR) AS file, count(*) FILTER (section = 'entries') AS entries, count(*) FILTER (section = 'rewrites') AS rewrites,
  count(*) FILTER (section = 'exclude') AS exclude FROM (SELECT unnest(range(0, 9)) AS k) LEFT JOIN v ON file = 'f' || CAST(k AS VARCHAR) GROUP BY k"""
)
def manifest_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "events").selectExpr(
        "'f' || (user_id % 7) AS file", "element_at(array('rewrites', 'entries', 'exclude', 'noRewrite'), cast(event_id % 4 + 1 AS int)) AS section"
    )
    return runs.manifest_survey(spark.range(9).selectExpr("'f' || id AS file"), verdicts)


@query(
    """WITH u AS (SELECT url, min(page_id) AS id FROM pages GROUP BY url)
SELECT count(*) AS urls, count(*) FILTER (id % 8 IN (1, 2)) AS from_universe, count(*) FILTER (id % 8 = 3) AS from_seen,
  count(*) FILTER (id % 8 IN (4, 5, 6)) AS resolved, count(*) FILTER (id % 8 = 7) AS deferred FROM u"""
)
def generate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogue import generate_manifest

    return runs.generate_stats(table(spark, sf_dir, "pages").select("url"), generate_manifest(spark, sf_dir))


@query(
    f"""WITH {CAPTURES}, s AS (SELECT status, status = 'body' AS bodied, page_id % 31 <> 0 AS stored, content_hash FROM captures),
held AS (SELECT DISTINCT content_hash FROM captures WHERE status = 'body' AND page_id % 31 <> 0)
SELECT count(*) FILTER (NOT bodied OR h.content_hash IS NOT NULL) AS total, count(*) FILTER (bodied AND h.content_hash IS NOT NULL) AS bodied,
  count(*) FILTER (NOT bodied) AS bodiless, count(*) FILTER (bodied AND h.content_hash IS NULL) AS missing_bodies
FROM s LEFT JOIN held h ON h.content_hash = s.content_hash"""
)
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    side = c.select("status", F.when(F.col("status") == "body", F.col("content_hash")).alias("content_hash"))
    caps = c.where("status = 'body' AND page_id % 31 <> 0").select(keys.body_path(F.col("content_hash")).alias("path")).distinct()
    return runs.batch_summary(side, caps)


_AUDITED = "['good', 'wayback404', 'suspect'][(quality + 2 * toxic) % 3 + 1]"


@query(
    f"""WITH v AS (SELECT doc_id AS key, {_AUDITED} AS verdict FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT verdict, key FROM v WHERE verdict <> 'good' ORDER BY verdict <> 'wayback404', key"""
)
def audit_bad_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that need a human, missing ones first."""
    known = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return runs.bad_list(known.selectExpr("doc_id AS key", "element_at(array('good', 'wayback404', 'suspect'), cast((quality + 2 * toxic) % 3 + 1 AS int)) AS verdict"))


@query(
    f"""WITH v AS (SELECT {_AUDITED} AS verdict FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT count(*) FILTER (verdict = 'good') AS good, count(*) FILTER (verdict = 'wayback404') AS wayback404, count(*) FILTER (verdict = 'suspect') AS suspect FROM v"""
)
def audit_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    return runs.verdict_counts(known.selectExpr("element_at(array('good', 'wayback404', 'suspect'), cast((quality + 2 * toxic) % 3 + 1 AS int)) AS verdict"))


@query(
    f"""WITH {CAPTURES}, {EDGES}, k AS (SELECT child, CASE WHEN child IN (SELECT key FROM held) THEN 'in-store' WHEN child IN (SELECT child FROM edges WHERE dynamic) THEN 'frontier'
  WHEN bool_or(flag IS NOT NULL) OR ends_with(child, '.png') THEN 'resource' ELSE 'page' END AS class FROM edges GROUP BY child)
SELECT 'scanned' AS name, count(*) AS n FROM captures WHERE status = 'body' UNION ALL SELECT 'occurrences', count(*) FROM edges
UNION ALL SELECT 'distinct', count(*) FROM k UNION ALL SELECT class, count(*) FROM k GROUP BY class"""
)
def escape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an escape scan beside its classes."""
    edges, held = assets(spark, sf_dir)
    refs = edges.select(F.col("parent").alias("doc"), F.lit(0).alias("ord"), F.col("child").alias("key"), F.col("flag").isNotNull().alias("resource"))
    classes = relations.upstream_classes(refs, held, edges.where("dynamic").select(F.col("child").alias("key")))
    return runs.class_counts(captures(spark, sf_dir).where("status = 'body'"), refs, classes)


@query(
    """WITH r AS (SELECT user_id AS doc, count(*) - count(*) FILTER (event_type = 'view') AS requests FROM events GROUP BY user_id),
f AS (SELECT user_id AS doc, count(*) AS n FROM events WHERE event_type = 'error' AND value > 45 GROUP BY user_id)
SELECT doc, coalesce(n, 0) + CASE WHEN requests = 0 THEN 1 ELSE 0 END AS findings, requests = 0 AS no_evidence, coalesce(n, 0) = 0 AND requests > 0 AS pass
FROM r LEFT JOIN f USING (doc)"""
)
def browser_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents pass without findings; one whose browser asked for nothing does not."""
    events = table(spark, sf_dir, "events")
    observed = events.groupBy(F.col("user_id").alias("doc")).agg(F.count_if(F.col("event_type") != "view").alias("requests"))
    found = events.where("event_type = 'error' AND value > 45").select(F.col("user_id").alias("doc"), F.lit("dangling-local").alias("kind"))
    return runs.browser_layer(observed, found)


@query(
    """SELECT user_id, bool_and(NOT (event_type = 'error' AND value > 30) AND NOT (event_type = 'view' AND value < 1)) AS pass, count(*) AS layers,
  count(*) FILTER ((event_type = 'error' AND value > 30) OR (event_type = 'view' AND value < 1)) AS failed,
  CAST(sum(CASE WHEN event_type = 'error' AND value > 30 THEN 1 ELSE 0 END) AS BIGINT) AS findings FROM events GROUP BY user_id"""
)
def layer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run passes if no layer has findings and each that was to observe something did."""
    layers = table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id AS layer", "cast(event_type = 'error' AND value > 30 AS int) AS findings", "CASE WHEN event_type = 'view' THEN cast(floor(value) AS int) END AS observed"
    )
    return verify.layer_verdict(layers, "user_id")


@query(
    """WITH c AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS url, strftime(ts, '%Y%m%d%H%M%S') AS timestamp, 'o' || CAST(event_id AS VARCHAR) AS original FROM events)
SELECT url, timestamp, original, n, 'https://web.archive.org/web/' || timestamp || '/' || original AS replay FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY url ORDER BY timestamp, original) AS INT) AS n FROM c WHERE timestamp >= '20240105000000') WHERE n <= 3"""
)
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three captures of each address from a day on (a report of the first few)."""
    cdx = table(spark, sf_dir, "events").selectExpr(
        "'u' || user_id AS url", "date_format(ts, 'yyyyMMddHHmmss') AS timestamp", "'o' || event_id AS original", "'text/html' AS mimetype", "'200' AS statuscode",
        "'d' AS digest", "1 AS length",
    )
    return store.snapshots(cdx, low="20240105", limit=3).select("url", "timestamp", "original", "n", "replay")


# Stores and builds.

_FLAWS = """side AS (SELECT page_id, key, status, html, content_hash, CASE WHEN page_id % 17 = 0 THEN 'meta/00/x' ELSE 'meta/' || substr(hash, 1, 2) || '/' || hash || '.json' END AS path,
  CASE WHEN page_id % 19 = 0 THEN 2 ELSE 3 END AS v, CASE WHEN status = 'body' AND page_id % 13 = 0 THEN 'wrapper' ELSE 'page' END AS kind FROM captures),
bodies AS (SELECT *, CASE WHEN kind = 'wrapper' THEN '<title>Wayback Machine</title><iframe id=playback>' || page_id ELSE html END AS content FROM side WHERE status = 'body'),
lost AS (SELECT parent, child FROM edges WHERE parent IN (SELECT key FROM side WHERE status = 'body') AND child NOT IN (SELECT key FROM held) GROUP BY parent, child)"""


def _flawed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sidecars, stored bodies, edges and all files of a store with planted flaws."""
    c = captures(spark, sf_dir)
    bodied = F.col("status") == "body"
    content = F.when(bodied & (F.col("page_id") % 13 == 0), F.expr("'<title>Wayback Machine</title><iframe id=playback>' || page_id")).otherwise(F.col("html"))
    c = c.withColumn("content", F.encode(content, "UTF-8"))
    side = c.select(
        F.when(F.col("page_id") % 17 == 0, "meta/00/x").otherwise(keys.meta_path(F.col("key"))).alias("path"),
        F.when(F.col("page_id") % 19 == 0, 2).otherwise(3).alias("v"),
        "key",
        "status",
        F.lit("text/html").alias("content_type"),
        F.when(bodied, keys.sri(F.col("content"))).alias("content_hash"),
        F.when(bodied, F.length("content")).cast("long").alias("content_length"),
    )
    bodies = c.where(bodied & (F.col("page_id") % 31 != 0)).select(
        keys.body_path(keys.sri(F.col("content"))).alias("path"), keys.sri(F.col("content")).alias("digest"), F.length("content").cast("long").alias("length"), "content"
    )
    trash = c.where(bodied & (F.col("page_id") % 62 == 0)).select(F.concat(F.lit("trash/run1/"), keys.body_path(keys.sri(F.col("content")))).alias("path"))
    files = spark.createDataFrame([("trash/.fsck-quarantine",), ("notes.txt",), ("old/x/y",), ("tmp/half",), ("tmp/deep/er",), (".crawl/verified.jsonl",)], "path string")
    edges, held = assets(spark, sf_dir)
    more = held.select(
        keys.meta_path(F.col("key")).alias("path"), F.lit(3).alias("v"), "key", F.lit("error").alias("status"), F.lit("").alias("content_type"),
        F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("long").alias("content_length"),
    )
    return side.unionByName(more), bodies.dropDuplicates(["path"]), edges, files.unionByName(trash)


_FINDINGS = f"""WITH {CAPTURES}, {EDGES}, {_FLAWS}, digests AS (SELECT *, 'sha256-' || base64(unhex(sha256(content))) AS d FROM bodies),
stored AS (SELECT DISTINCT d FROM digests WHERE page_id % 31 <> 0), trash AS (SELECT DISTINCT d FROM digests WHERE page_id % 62 = 0),
f AS (SELECT 'schemaVersion' AS category, 'advisory' AS severity, key, NULL AS detail FROM side WHERE v <> 3
  UNION ALL SELECT 'keyMismatch', 'corruption', key, NULL FROM side WHERE path = 'meta/00/x'
  UNION ALL SELECT 'missingBody', 'corruption', key, CASE WHEN d IN (SELECT d FROM trash) THEN 'trash/run1/cap/' || substr(lower(hex(from_base64(substr(d, 8)))), 1, 2) || '/' || lower(hex(from_base64(substr(d, 8)))) END
    FROM digests WHERE d NOT IN (SELECT d FROM stored)
  UNION ALL SELECT 'incompleteClosure', 'incomplete', parent, child FROM lost
  UNION ALL SELECT 'interstitialAsBody', 'advisory', key, 'wrapper-stub' FROM digests WHERE kind = 'wrapper' AND d IN (SELECT d FROM stored)
  UNION ALL SELECT 'foreignRoot', 'advisory', unnest(['notes.txt', 'old']), NULL
  UNION ALL SELECT 'staleTmp', 'reapable', unnest(['half', 'deep']), NULL)"""


@query(f"{_FINDINGS} SELECT category, severity, key, detail FROM f")
def fsck_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of findings of one store: sidecars, bodies, closure, interstitials, foreign and stale files, quarantine hints."""
    return verify.fsck_store(*_flawed(spark, sf_dir))


@query(
    f"""{_FINDINGS}, every(ord, category, severity) AS (VALUES {', '.join(f"({i}, '{c}', '{s}')" for i, (c, s) in enumerate(verify.SEVERITY.items()))})
SELECT CAST(ord AS INT) AS ord, e.category, e.severity, count(key) AS found, CASE WHEN e.severity = 'reapable' THEN count(key) ELSE 0 END AS reaped,
  CASE WHEN e.severity = 'reapable' THEN 0 ELSE count(key) END AS unresolved
FROM every e LEFT JOIN f ON f.category = e.category GROUP BY ord, e.category, e.severity"""
)
def fsck_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by category in report order, and what stays once the reapable ones are gone."""
    return verify.fsck_totals(verify.fsck_store(*_flawed(spark, sf_dir)), fix=True)


_BUILT = "CASE WHEN status = 'body' THEN CASE WHEN page_id % 3 = 0 THEN 'sha256-' || base64(unhex(sha256(html || 'x'))) ELSE content_hash END END"


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    bodied, new = F.col("status") == "body", F.col("page_id") % 3 == 0
    return c.select(
        "page_id",
        "key",
        "status",
        F.lit("text/html").alias("content_type"),
        F.when(bodied, F.col("content_hash")).alias("input_hash"),
        F.when(bodied, F.when(new, keys.sri(F.concat("html", F.lit("x")))).otherwise(F.col("content_hash"))).alias("output_hash"),
        (bodied & new).alias("rewritten"),
        F.when(bodied, F.octet_length("html") + new.cast("int")).alias("output_length"),
    )


@query(
    f"""WITH {CAPTURES}, b AS (SELECT *, {_BUILT} AS output_hash FROM captures)
SELECT key, '{{"contentType":"text/html","inputHash":' || coalesce('"' || CASE WHEN status = 'body' THEN content_hash END || '"', 'null') || ',"key":"' || key || '","outputHash":'
  || coalesce('"' || output_hash || '"', 'null') || ',"rewritten":' || CASE WHEN status = 'body' AND page_id % 3 = 0 THEN 'true' ELSE 'false' END || ',"status":"' || status || '"}}' AS json FROM b"""
)
def build_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.build_record(_built(spark, sf_dir))


@query(
    f"""WITH {CAPTURES} SELECT count(*) AS sidecars, count(*) FILTER (status = 'body') AS bodies, count(*) FILTER (status = 'body' AND page_id % 3 = 0) AS rewritten FROM captures"""
)
def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a build, read back from its record: lines in key order, in as many files as tasks wrote."""
    root = tree.fresh_root(spark, "record")
    tree.write_lines(build.build_record(_built(spark, sf_dir)), "key", "json", root)
    return build.build_counts(store.read_build_lines(spark, root))


@query(
    f"""WITH {CAPTURES}, b AS (SELECT *, {_BUILT} AS output_hash FROM captures)
SELECT key, status, output_hash AS content_hash, CASE WHEN status = 'body' THEN CAST(octet_length(encode(html)) AS BIGINT) + CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END ELSE -1 END AS content_length FROM b"""
)
def remastered_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodied = F.col("status") == "body"
    side = captures(spark, sf_dir).select(
        "key", "status", F.when(bodied, F.col("content_hash")).alias("content_hash"), F.when(bodied, F.octet_length("html")).cast("long").alias("content_length")
    )
    return build.remastered_sidecars(side, _built(spark, sf_dir)).fillna(-1, ["content_length"])


@query(
    f"""WITH {CAPTURES}, b AS (SELECT *, {_BUILT} AS output_hash FROM captures WHERE status = 'body'),
caps AS (SELECT DISTINCT output_hash AS d FROM b WHERE page_id % 7 <> 0),
r AS (SELECT b.*, page_id % 5 <> 0 AS listed, caps.d IS NOT NULL AS there FROM b LEFT JOIN caps ON caps.d = b.output_hash)
SELECT key, 'build-orphan' AS kind, NULL AS expected, NULL AS actual FROM r WHERE NOT listed
UNION ALL SELECT key, 'body-missing', NULL, NULL FROM r WHERE listed AND NOT there
UNION ALL SELECT key, 'body-hash', 'sha256-x', output_hash FROM r WHERE listed AND there AND page_id % 11 = 0"""
)
def build_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of a build against its record: some are not listed, some not stored, some recorded under another digest."""
    b = _built(spark, sf_dir)
    side = b.select("key", "status", F.col("output_hash").alias("content_hash"))
    record = b.where("page_id % 5 <> 0").select("key", F.when(F.col("page_id") % 11 == 0, "sha256-x").otherwise(F.col("output_hash")).alias("output_hash"))
    caps = b.where("status = 'body' AND page_id % 7 <> 0").select(keys.body_path(F.col("output_hash")).alias("path"), F.col("output_hash").alias("digest"))
    return build.build_integrity(side, record, caps.distinct())


# Captures and crawls.

_CODE = "[200, 302, 404, 503, NULL, 410][page_id % 6 + 1]"


@query(
    f"""WITH {CAPTURES}, d AS (SELECT page_id, CASE WHEN page_id % 10 = 9 THEN 'no document' ELSE key END AS doc, key, {_CODE} AS code, page_id % 4 = 0 AS held, status FROM captures)
SELECT doc, CASE WHEN doc = key THEN key END AS key, CASE WHEN doc = key AND held THEN 'skipped' WHEN doc = key AND code = 200 THEN 'fetched' ELSE 'failed' END AS action,
  CASE WHEN doc = key AND held THEN status WHEN doc = key AND code = 200 THEN 'body' END AS status,
  CASE WHEN doc <> key THEN 'no capture' WHEN held OR code = 200 THEN NULL WHEN code IS NULL THEN 'no response' WHEN code = 404 THEN 'capture missing' ELSE 'HTTP ' || code END AS error FROM d"""
)
def capture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named documents are skipped, fetched or failed, by what is held and what the archive answered."""
    c = captures(spark, sf_dir)
    code = F.get(F.array(*[F.lit(x) for x in (200, 302, 404, 503, None, 410)]), (F.col("page_id") % 6).cast("int"))
    answers = c.select(keys.replay_url(F.col("key")).alias("url"), code.alias("status_code")).where("status_code IS NOT NULL")
    docs = c.select(F.when(F.col("page_id") % 10 == 9, "no document").otherwise(F.col("key")).alias("doc"))
    return crawl.capture_documents(docs, c.where("page_id % 4 = 0").select("key", "status"), answers)


_NUMBER = "CAST(regexp_extract(child, 'a([0-9]+)[.]png', 1) AS INT)"


def _answers(edges: DataFrame) -> DataFrame:
    """Responses to children by the number in their name, at the URL that their flag gives."""
    n = F.regexp_extract("child", "a([0-9]+)[.]png", 1).cast("int") % 6
    code = F.get(F.array(*[F.lit(x) for x in (200, 302, 404, 503, None, 410)]), n)
    own = crawl.frontier(edges).select("child", keys.replay_url(F.col("child"), F.col("flag")).alias("url")).distinct()
    return own.select("child", "url", code.alias("status_code")).where("status_code IS NOT NULL")


_CHILDREN = f"""u AS (SELECT DISTINCT parent, child FROM edges), k AS (SELECT parent, child, child IN (SELECT key FROM held) AS held,
  [200, 302, 404, 503, NULL, 410][{_NUMBER} % 6 + 1] AS code FROM u)"""


@query(
    f"""WITH {CAPTURES}, {EDGES}, {_CHILDREN}
SELECT parent, child, CASE WHEN held THEN 'skipped' WHEN code IN (200, 302, 404, 410) THEN 'fetched' ELSE 'failed' END AS action,
  CASE WHEN held THEN 'error' WHEN code = 200 THEN 'body' WHEN code = 302 THEN 'redirect' WHEN code IN (404, 410) THEN 'error' END AS status,
  CASE WHEN held OR code IN (200, 302, 404, 410) THEN NULL WHEN code IS NULL THEN 'no response' ELSE 'HTTP ' || code END AS error FROM k"""
)
def capture_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of documents: held ones are skipped, answers settle or fail the rest."""
    edges, held = assets(spark, sf_dir)
    return crawl.capture_children(edges, held.withColumn("status", F.lit("error")), _answers(edges))


@query(
    f"""WITH {CAPTURES}, {EDGES}, {_CHILDREN}, n AS (SELECT parent, count(*) AS n, count(*) FILTER (NOT held) AS missing FROM k GROUP BY parent)
SELECT key, page_id % 4 <> 0 AS present, CASE WHEN page_id % 4 <> 0 THEN n ELSE 0 END AS frontier, CASE WHEN page_id % 4 <> 0 THEN missing ELSE 0 END AS would_fetch
FROM captures JOIN n ON parent = key"""
)
def crawl_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, held = assets(spark, sf_dir)
    c = captures(spark, sf_dir)
    return crawl.dry_run(c.select("key"), c.where("page_id % 4 <> 0").select("key").unionByName(held), edges)


@query(
    f"""WITH {CAPTURES}, {EDGES}, {_CHILDREN}, o AS (SELECT key, row_number() OVER (ORDER BY page_id) - 1 AS ord FROM captures),
a AS (SELECT ord, child, code IN (200, 302, 404, 410) AS fetched, min(ord) OVER (PARTITION BY child) AS first FROM k JOIN o ON o.key = parent WHERE NOT held),
n AS (SELECT ord, count(*) FILTER (fetched AND ord = first) AS fetched, count(*) FILTER (fetched IS NOT TRUE) AS failures FROM a GROUP BY ord),
s AS (SELECT o.key, o.ord, coalesce(fetched, 0) AS fetched, coalesce(failures, 0) AS failures,
  coalesce(sum(coalesce(fetched, 0) + coalesce(failures, 0)) OVER (ORDER BY o.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 60 AS over FROM o LEFT JOIN n ON n.ord = o.ord)
SELECT key, ord, CASE WHEN over THEN 0 ELSE fetched + failures END AS requests, CASE WHEN over THEN 0 ELSE fetched END AS fetched,
  CASE WHEN over THEN 0 ELSE failures END AS failures, CASE WHEN over THEN 'cap-skipped' ELSE 'static' END AS status FROM s"""
)
def crawl_static_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontiers closed in document order until sixty requests are spent."""
    edges, held = assets(spark, sf_dir)
    docs = captures(spark, sf_dir).select("key", F.col("page_id").alias("ord"))
    return crawl.static_run(docs, held.withColumn("status", F.lit("error")), edges, _answers(edges), 60)


@query(
    f"""WITH {CAPTURES}, {EDGES}, r AS (SELECT DISTINCT parent AS doc, child AS key FROM edges WHERE dynamic)
SELECT doc, key FROM r WHERE key NOT IN (SELECT key FROM held)"""
)
def unresolved_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, held = assets(spark, sf_dir)
    recorded = edges.where("dynamic").select(F.col("parent").alias("doc"), F.col("child").alias("key"))
    beacons = recorded.select("doc", F.lit("2014/http://stats.wp.com/g.gif").alias("key"))
    return crawl.unresolved(recorded.unionByName(beacons), held)


@query(
    """SELECT page_id AS doc,
  CASE page_id % 7 WHEN 0 THEN 'probe-error' WHEN 1 THEN 'verified' WHEN 2 THEN 'flaky' WHEN 3 THEN 'flaky' WHEN 4 THEN 'unconverged' WHEN 5 THEN 'verified' ELSE 'flaky' END AS status,
  CASE page_id % 7 WHEN 2 THEN 'no-progress' WHEN 3 THEN 'csp-residual' WHEN 6 THEN 'unmatched-escapes' END AS reason,
  CAST(CASE page_id % 7 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS INT) AS iterations,
  CAST(CASE page_id % 7 WHEN 2 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS BIGINT) AS recorded,
  CAST(CASE page_id % 7 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS residual FROM pages"""
)
def crawl_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds at most: documents that converge, that ask for more each time, whose fetches fail, or that are blocked."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"))
    rounds = pages.select("doc", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("iteration"), (F.col("doc") % 7).alias("kind"))
    probes = rounds.select(
        "doc", "iteration", F.when(F.col("kind") == 0, 0).otherwise(3).alias("observed"), (F.col("kind") == 3).cast("int").alias("csp"),
        F.lit(0).alias("chrome"), (F.col("kind") == 6).cast("int").alias("unmatched"),
    )
    asks = (F.col("kind") == 4) | ((F.col("kind") == 5) & (F.col("iteration") < 2)) | (F.col("kind") == 2)
    name = F.when(F.col("kind") == 2, F.expr("'2014/http://lost.example.com/' || doc")).otherwise(F.expr("'2014/http://new.example.com/' || doc || '/' || iteration"))
    requests = rounds.where(asks).select("doc", "iteration", name.alias("key"))
    answers = requests.select("key", F.when(F.col("key").contains("lost"), 503).otherwise(200).alias("status_code")).distinct()
    none = spark.createDataFrame([], "doc long, key string")
    return crawl.crawl(pages, spark.createDataFrame([], "key string"), none, probes, requests, answers, most=2)


# Rules of single rows: commits, browser-found entries, sidecars, manifests, checkpoints, policies.


@query(
    f"""WITH {CAPTURES}, r AS (SELECT page_id, key, {_CODE} AS code, CASE WHEN page_id % 7 = 3 THEN '' WHEN page_id % 7 = 4 THEN '<title>Wayback Machine</title><iframe id=playback>' ELSE html END AS body FROM captures),
s AS (SELECT *, CASE WHEN code = 200 AND page_id % 7 = 4 THEN 'interstitial' WHEN code = 200 AND body = '' THEN 'empty' WHEN code = 200 THEN 'body'
  WHEN code IN (404, 410) THEN 'error' WHEN code BETWEEN 300 AND 399 THEN 'redirect' END AS status FROM r)
SELECT key, status, CASE WHEN status = 'body' THEN 'sha256-' || base64(unhex(sha256(body))) END AS content_hash,
  CASE WHEN status = 'body' THEN octet_length(encode(body)) ELSE -1 END AS content_length FROM s WHERE status IS NOT NULL"""
)
def commit_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses become sidecar rows by status and content; what may come later gives none."""
    code = F.get(F.array(*[F.lit(x) for x in (200, 302, 404, 503, None, 410)]), (F.col("page_id") % 6).cast("int"))
    body = F.expr("CASE WHEN page_id % 7 = 3 THEN '' WHEN page_id % 7 = 4 THEN '<title>Wayback Machine</title><iframe id=playback>' ELSE html END")
    rows = captures(spark, sf_dir).select(
        "key", F.lit("text/html").alias("content_type"), code.alias("status_code"), F.encode(body, "UTF-8").alias("content"), F.lit(None).cast("string").alias("flag")
    )
    return build.commit(rows).select("key", "status", "content_hash", F.coalesce("content_length", F.lit(-1)).alias("content_length"))


_ENTRY = {
    "key": "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'nokey' ELSE '2014/' || url END",
    "flag": "CASE page_id % 3 WHEN 1 THEN 'im_' WHEN 2 THEN 'zz_' END",
    "via": "CASE WHEN page_id % 7 = 0 THEN 'me' ELSE 'manual' END",
    "firstSeen": "CASE page_id % 11 WHEN 0 THEN 'yesterday' WHEN 1 THEN '2024-02-31T00:00:00Z' ELSE '2024-01-02T03:04:05Z' END",
}


@query(
    f"""WITH e AS (SELECT page_id, {', '.join(f'{v} AS "{k}"' for k, v in _ENTRY.items())} FROM pages)
SELECT page_id, CASE WHEN strpos(key, '/') = 0 THEN 'key has no separator' WHEN flag IS NOT NULL AND flag NOT IN ('im_', 'cs_', 'js_', 'oe_') THEN 'unknown flag'
  WHEN via NOT IN ('remaster-verify', 'manual') THEN 'unknown via' WHEN try_cast("firstSeen" AS TIMESTAMP) IS NULL THEN 'firstSeen is no ISO time' END AS error FROM e"""
)
def dynamic_entry_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(*[F.expr(v).alias(k) for k, v in _ENTRY.items()])
    return table(spark, sf_dir, "pages").select("page_id", classify.dynamic_error(entry).alias("error"))


@query(
    """WITH p AS (SELECT 'd' || CAST(page_id % 9 AS VARCHAR) AS doc, 'k' || CAST(page_id % 13 AS VARCHAR) AS key, page_id FROM pages),
prior AS (SELECT doc, key, 'im_' AS flag FROM p WHERE page_id % 2 = 0 GROUP BY doc, key), found AS (SELECT doc, key, 'js_' AS flag FROM p WHERE page_id % 3 = 0 GROUP BY doc, key)
SELECT doc, key, coalesce(a.flag, b.flag) AS flag FROM prior a FULL JOIN found b USING (doc, key)"""
)
def merge_browser_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a browser found joins what is recorded; recorded entries win."""
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "'d' || (page_id % 9) AS doc", "'k' || (page_id % 13) AS key", "'manual' AS via", "'t' AS firstSeen")
    prior = pages.where("page_id % 2 = 0").withColumn("flag", F.lit("im_")).drop("page_id").distinct()
    found = pages.where("page_id % 3 = 0").withColumn("flag", F.lit("js_")).drop("page_id")
    return build.merge_dynamic(prior, found).select("doc", "key", "flag")


@query(
    f"""WITH {CAPTURES} SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'not an object' WHEN 2 THEN 'not an object' WHEN 3 THEN 'version' WHEN 4 THEN 'no key' END AS defect,
  CASE WHEN page_id % 6 IN (0, 3, 5) THEN key END AS key, CASE WHEN page_id % 6 IN (0, 3, 4, 5) THEN status END AS status FROM captures"""
)
def sidecar_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars in JSON, sound, torn, of another shape, version or without a key, each with what is wrong."""
    sound = lambda v, *fields: F.to_json(F.struct(F.lit(v).alias("v"), *fields))
    json = (
        F.when(F.col("page_id") % 6 == 1, F.lit('{"v":3,"key"'))
        .when(F.col("page_id") % 6 == 2, F.lit("[3]"))
        .when(F.col("page_id") % 6 == 3, sound(2, "key", "status"))
        .when(F.col("page_id") % 6 == 4, sound(3, "status"))
        .otherwise(sound(3, "key", "status"))
    )
    raw = captures(spark, sf_dir).select(F.col("page_id").cast("string").alias("path"), json.alias("json"))
    return store.parse_sidecars(raw, "collect").select(F.col("path").cast("long").alias("page_id"), "defect", "key", "status")


_LISTED = """v AS (SELECT 'f' || CAST(page_id % 4 AS VARCHAR) AS file, ['noRewrite', 'rewrites', 'exclude'][page_id % 3 + 1] AS section, 'u' || CAST(page_id % 50 AS VARCHAR) AS url,
  CASE WHEN page_id % 3 = 1 THEN 'https://new.example.com/' || CAST(page_id % 50 AS VARCHAR) END AS target FROM pages)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(
        "'f' || (page_id % 4) AS file", "element_at(array('noRewrite', 'rewrites', 'exclude'), cast(page_id % 3 + 1 AS int)) AS section", "'u' || (page_id % 50) AS url",
        "CASE WHEN page_id % 3 = 1 THEN 'https://new.example.com/' || (page_id % 50) END AS target",
    )


@query(
    f"""WITH {_LISTED}, d AS (SELECT DISTINCT * FROM v)
SELECT file, '{{"version":2,"noRewrite":[' || coalesce(string_agg('"' || url || '"', ',' ORDER BY url) FILTER (section = 'noRewrite'), '') || '],"rewrites":{{' ||
  coalesce(string_agg('"' || url || '":"' || target || '"', ',' ORDER BY url) FILTER (section = 'rewrites'), '') || '}},"entries":{{}},"exclude":[' ||
  coalesce(string_agg('"' || url || '"', ',' ORDER BY url) FILTER (section = 'exclude'), '') || ']}}' AS json FROM d GROUP BY file"""
)
def canonical_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.canonical_manifest(_listed(spark, sf_dir))


@query(f"WITH {_LISTED} SELECT DISTINCT file, section, url, target FROM v")
def manifest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical manifests read back are the verdicts that they were made of."""
    return store.parse_manifests(runs.canonical_manifest(_listed(spark, sf_dir))).select("file", "section", "url", "target")


@query(
    """WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 's' || (event_id % 3) ELSE 's1' END AS signature, 't' || (event_id % 2) AS target, event_id % 5 AS sample FROM events)
SELECT event_id, CASE WHEN signature IS NULL OR signature <> 's1' OR target <> 't1' THEN 'none' WHEN sample <> 3 THEN 'without-serving' ELSE 'all' END AS valid FROM s"""
)
def resume_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a checkpoint is valid for the run that resumes it."""
    events = table(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 's' || (event_id % 3) ELSE 's1' END AS signature", "'t' || (event_id % 2) AS target", "cast(event_id % 5 AS int) AS sample"
    )
    stored = F.when(F.col("signature").isNotNull(), F.struct("signature", "target", "sample"))
    return events.select("event_id", verify.resume_state(stored, F.lit("s1"), F.lit("t1"), F.lit(3)).alias("valid"))


@query(
    """WITH m AS (SELECT event_id, ['Refused to load the image', 'Content Security Policy: blocked', 'GET failed', 'REFUSED TO FRAME x', 'refused to play'][event_id % 5 + 1] AS message FROM events)
SELECT event_id, regexp_matches(message, 'content security policy|refused to (load|connect|execute|apply|frame)', 'i') AS violation FROM m"""
)
def csp_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ["Refused to load the image", "Content Security Policy: blocked", "GET failed", "REFUSED TO FRAME x", "refused to play"]
    message = F.get(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", runs.is_csp_violation(message).alias("violation"))


@query(
    """WITH m AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://plain.example.com/' || page_id ELSE 'https://github.com/old/r' || page_id || '/blob/x' END AS original FROM pages)
SELECT 'https://web.archive.org/web/2014/' || original AS url, CASE WHEN page_id % 3 = 0 OR page_id % 4 IN (0, 3) THEN 'gone' WHEN page_id % 4 = 1 THEN 'renamed' ELSE 'deferred' END AS outcome,
  CASE WHEN page_id % 3 > 0 AND page_id % 4 = 1 THEN 'https://github.com/new/r' || page_id || '/blob/x' END AS "to" FROM m"""
)
def settle_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing captures of deep links survive a rename, are put off, or are gone; others are gone at once."""
    m = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 3 = 0 THEN 'http://plain.example.com/' || page_id ELSE 'https://github.com/old/r' || page_id || '/blob/x' END AS original"
    )
    to = runs.graft(F.col("original"), F.lit("new"), F.expr("'r' || page_id"))
    probes = m.where("page_id % 4 <> 3").select(
        "original", F.when(F.col("page_id") % 4 == 1, to).alias("renamed_to"), F.when(F.col("page_id") % 4 == 2, "timeout").alias("error")
    )
    return runs.settle_missing(m.select(F.concat(F.lit("https://web.archive.org/web/2014/"), "original").alias("url")), probes)


@query(f"WITH {CAPTURES} SELECT '2015/' || url AS key, 'https://web.archive.org/web/2015/' || url AS url, url AS original FROM captures ORDER BY key")
def audit_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = captures(spark, sf_dir).select("url", F.lit("2015").alias("timestamp"), F.concat(F.lit("https://web.archive.org/web/2015/"), "url").alias("target"))
    return runs.audit_scope(entries)


@query(
    f"""WITH {CAPTURES}, k AS (SELECT count(*) AS n FROM captures WHERE (page_id % 5 <> 0) <> (page_id % 7 <> 0 OR page_id % 3 = 0)),
f AS (SELECT count(*) AS n FROM captures WHERE page_id % 11 IN (0, 1, 2)), b AS (SELECT count(*) AS n FROM captures WHERE page_id % 13 IN (0, 1) AND page_id % 2 = 0)
SELECT CAST(1 AS INT) AS layer, 'keys' AS name, n AS findings, n = 0 AS pass FROM k UNION ALL SELECT 2, 'metadata', n, n = 0 FROM f
UNION ALL SELECT 3, 'bodies', n, n = 0 FROM b UNION ALL SELECT 4, 'serving', n, n = 0 FROM ({replay.SERVING_FOUND})"""
)
def parity_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four layers of a parity run over the planted differences."""
    from . import catalogue

    return runs.parity_layers(
        catalogue.parity_keys(spark, sf_dir), catalogue.parity_meta(spark, sf_dir), catalogue.parity_bodies(spark, sf_dir), replay.serving_parity(spark, sf_dir)
    )


def _first_sql(where: str, markers: list[str]) -> str:
    joined = "|".join(markers).replace("'", "''")
    return f"nullif(regexp_extract({where}, '({joined})', 1, 'i'), '')"


@query(
    f"""WITH p AS (SELECT page_id, title, body, substr(body, 1, 2000) AS head FROM (SELECT page_id, 'Page ' || page_id AS title,
  CASE page_id % 5 WHEN 0 THEN 'Sorry: HTTP Error 404 and then some more words' WHEN 1 THEN 'short' WHEN 2 THEN '' WHEN 3 THEN 'The shop is under construction, please do come back later' ELSE url || ' ' || url END AS body FROM pages))
SELECT page_id, concat_ws(' | ', 'matched: ' || coalesce({_first_sql('title', classify.TITLE_MARKERS)}, {_first_sql('head', classify.BODY_MARKERS)},
  CASE WHEN length(body) >= 40 THEN coalesce({_first_sql('head', classify.SOFT_MARKERS)}, {_first_sql('title', classify.SOFT_MARKERS)}) END),
  'title: ' || title, 'text: ' || coalesce(nullif(substr(body, 1, 180), ''), '(empty)')) AS evidence FROM p"""
)
def soft404_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a verdict rests on, with title and text."""
    body = F.expr(
        "CASE page_id % 5 WHEN 0 THEN 'Sorry: HTTP Error 404 and then some more words' WHEN 1 THEN 'short' WHEN 2 THEN ''"
        " WHEN 3 THEN 'The shop is under construction, please do come back later' ELSE url || ' ' || url END"
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), body.alias("body"))
    return rows.select("page_id", classify.replay_evidence(F.col("title"), F.col("body")).alias("evidence"))


@query(
    f"""WITH {CAPTURES}, {EDGES}, e AS (SELECT parent, child, dynamic, CAST(regexp_extract(child, 'a([0-9]+)[.]png', 1) AS INT) AS ord FROM edges),
f AS (SELECT parent, child, min(CASE WHEN dynamic THEN 1000 ELSE 0 END + ord) AS place FROM e GROUP BY parent, child)
SELECT parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY place, child) - 1 AS INT) AS n, child FROM f"""
)
def frontier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children in the order of their numbers, browser-found ones after the others."""
    edges, _ = assets(spark, sf_dir)
    return crawl.ordered_frontier(edges.withColumn("ord", F.regexp_extract("child", "a([0-9]+)[.]png", 1).cast("int")))


@query(
    f"""WITH {CAPTURES}, {EDGES}, k AS (SELECT child AS key, CASE WHEN child IN (SELECT key FROM held) THEN 'in-store' WHEN child IN (SELECT child FROM edges WHERE dynamic) THEN 'frontier'
  WHEN bool_or(flag IS NOT NULL) OR ends_with(child, '.png') THEN 'resource' ELSE 'page' END AS class, count(DISTINCT parent) AS docs FROM edges GROUP BY child)
SELECT class, key, docs FROM k ORDER BY class, key"""
)
def escape_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, held = assets(spark, sf_dir)
    refs = edges.select(F.col("parent").alias("doc"), F.lit(0).alias("ord"), F.col("child").alias("key"), F.col("flag").isNotNull().alias("resource"))
    return relations.class_entries(relations.upstream_classes(refs, held, edges.where("dynamic").select(F.col("child").alias("key"))))
