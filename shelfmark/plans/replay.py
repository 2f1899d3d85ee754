"""Registered queries over addresses and replayed pages as browsers and the archive's tools read them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, keys, text, urls
from ..operators import build, verify
from ..sources import recorded, store, tree
from .catalogue import _BEACON_ROWS, _LINKED_HTML, CAPTURES, _sql_text, captures, query, table

#: Hosts as written and as browsers show them (null: the URL fails).
_HOSTS = [
    ("ad.DoubleClick.net", "ad.doubleclick.net"),
    ("my_site.2o7.net", "my_site.2o7.net"),
    ("C1.microsoft.com", "c1.microsoft.com"),
    ("www.google%2Danalytics.com", "www.google-analytics.com"),
    ("maps.googleapis.com.", "maps.googleapis.com."),
    ("not2o7.net", "not2o7.net"),
    ("münchen.example", "xn--mnchen-3ya.example"),
    ("例え。テスト", "xn--r8jz45g.xn--zckzah"),
    ("192.168.257", "192.168.1.1"),
    ("0x7f.1", "127.0.0.1"),
    ("[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]"),
    ("[::FFFF:1.2.3.4]", "[::ffff:102:304]"),
    ("a b.example", None),
    ("a<b.example", None),
    ("256.1.1.1.1", None),
    ("xn--a.example.", None),
]
_SCHEMES = ["http://", "HTTPS:\\\\", " http:/", "https://user:pa@ss@", "\thttp://"]
_PORTS = ["", ":80", ":8080", ":", ":99999", ":x"]
_PATHS = [
    "/x;ord=[timestamp]?", "/b/ss?v=1|2", "/a/../collect?c7=a b", "//c.gif?DI=1", "\\maps\\gen_204?e", "/x%", "/?id={x}",
    "/a b/{c}`d^", "", "/./generate_204#top", "?q", "/%2E%2e/__utm.gif",
]
_ADDRESS_SQL = f"""hosts(k, written, host) AS (VALUES {', '.join(f'({i}, {_sql_text(w)}, {_sql_text(h)})' for i, (w, h) in enumerate(_HOSTS))}),
made AS (SELECT page_id, host, list_extract([{', '.join(map(_sql_text, _PORTS))}], page_id // 5 % {len(_PORTS)} + 1) AS port,
  list_extract([{', '.join(map(_sql_text, _PATHS))}], page_id // 3 % {len(_PATHS)} + 1) AS path,
  list_extract([{', '.join(map(_sql_text, _SCHEMES))}], page_id % {len(_SCHEMES)} + 1) AS before, written FROM pages JOIN hosts ON k = page_id % {len(_HOSTS)}),
cut AS (SELECT *, before || written || port || path AS url, lower(regexp_extract(before, '[a-zA-Z]+')) AS scheme,
  host IS NOT NULL AND port NOT IN (':99999', ':x') AS fine, replace(regexp_extract(path, '^[^?#]*'), '\\', '/') AS bare FROM made),
walked AS (SELECT *, regexp_replace(regexp_replace(bare, '/([^/.]+/[.][.]|[.]|%2[Ee]%2[Ee])/', '/'), '^$', '/') AS way FROM cut),
parts AS (SELECT page_id, url, CASE WHEN fine THEN scheme END AS scheme, CASE WHEN fine THEN host END AS host, CASE WHEN fine AND port = ':8080' THEN 8080 WHEN fine AND port = ':80' AND scheme = 'https' THEN 80 END AS port,
  CASE WHEN fine THEN replace(replace(replace(replace(replace(way, ' ', '%20'), '{{', '%7B'), '}}', '%7D'), '`', '%60'), '^', '%5E') END AS path FROM walked)"""


@query(
    f"""WITH {_ADDRESS_SQL}, rules(n, kind, rule_host, pattern) AS (VALUES {_BEACON_ROWS}),
b AS (SELECT page_id, bool_or((kind = 'any' OR host = rule_host OR kind = 'under' AND ends_with(host, '.' || rule_host)) AND (pattern IS NULL OR regexp_matches(path, pattern))) AS beacon
  FROM parts, rules GROUP BY page_id)
SELECT page_id, url, scheme, host, CAST(coalesce(port, 0) AS INT) AS port, path, coalesce(beacon, false) AS beacon FROM parts JOIN b USING (page_id)"""
)
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, host, port and path of odd addresses: blanks, backslashes, user names, international and numeric hosts."""
    pick = lambda values, by: F.expr(
        f"element_at(array({', '.join('unhex(' + repr(v.encode().hex()) + ')' for v in values)}), cast({by} % {len(values)} AS int) + 1)"
    ).cast("string")
    made = [pick(_SCHEMES, "page_id"), pick([w for w, _ in _HOSTS], "page_id"), pick(_PORTS, "page_id div 5"), pick(_PATHS, "page_id div 3")]
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(*made).alias("url"))
    rows = rows.select("page_id", "url", urls.parts(F.col("url")).alias("p"), classify.is_beacon(F.col("url")).alias("beacon"))
    return rows.select("page_id", "url", "p.scheme", "p.host", F.coalesce("p.port", F.lit(0)).alias("port"), "p.path", "beacon")


#: What a replay puts around a page, by where it stands; twice what is taken out everywhere.
_DRESSED = """'<script src="https://archive.org/includes/analytics.js?v=1"></script>' || chr(10) || '<script>__wm.init("/");</script><title>Wayback</title><!-- End Wayback Rewrite JS Include -->'
 || CASE page_id % 3 WHEN 0 THEN '<!-- BEGIN WAYBACK TOOLBAR INSERT --><p>the page cannot be found</p><!-- END WAYBACK TOOLBAR INSERT -->' ELSE '' END
 || '<!--' || chr(10) || ' FILE ARCHIVED ON 1 -->' || {0} || '<!-- it - is -- FILE ARCHIVED ON 2' || chr(10) || '--><!-- playback timings (ms): 1 -->'
 || '<link rel="stylesheet" href="/_static/css/a.css"/><script src="//web-static.archive.org/_static/js/b.js"> </script><script>a; __wm.wombat("x")</script>'"""
_PLAIN_COMMENT = r"(?:[^-]|-[^-]|--[^>])*?"
_UNDRESSED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0},"
    " '<script[^>]*src=[\"''][^\"'']*(?:archive\\.org/includes/analytics|/_static/js/)[^\"'']*[\"''](?s:.*?)<!--\\s*End Wayback Rewrite JS Include\\s*-->', '', 'i'),"
    " '<!--\\s*BEGIN WAYBACK TOOLBAR INSERT\\s*-->(?s:.*?)<!--\\s*END WAYBACK TOOLBAR INSERT\\s*-->', '', 'i'),"
    f" '<!--{_PLAIN_COMMENT}FILE ARCHIVED ON{_PLAIN_COMMENT}-->', '', 'gi'),"
    f" '<!--\\s*playback timings{_PLAIN_COMMENT}-->', '', 'gi'),"
    " '<script[^>]*src=[\"''][^\"'']*/_static/js/[^\"'']*[\"''][^>]*>\\s*</script>', '', 'gi'),"
    " '<link[^>]*href=[\"''][^\"'']*/_static/css/[^\"'']*[\"''][^>]*/?>', '', 'gi'),"
    " '<script[^>]*>[^<]*__wm\\.(?:init|wombat|bt)\\((?s:.*?)</script>', '', 'gi')"
)


@query(
    f"""WITH d AS (SELECT page_id, {_UNDRESSED.format('(' + _DRESSED.format('html') + ')')} AS own FROM pages)
SELECT page_id, sha256(own) AS own_hash, CAST(length(own) AS BIGINT) AS n_chars FROM d"""
)
def audit_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit counts as a replayed page's own: dressed pages without head inserts, toolbar and provenance."""
    dressed = F.expr(_DRESSED.format("html").replace("chr(10)", "char(10)"))
    own = table(spark, sf_dir, "pages").select("page_id", text.audit_strip(dressed).alias("own"))
    return own.select("page_id", F.sha2("own", 256).alias("own_hash"), F.length("own").cast("long").alias("n_chars"))


#: Pages with references at @, and what is to be found of each: region, whether entities decode, whether it loads a resource.
_PLACES = [
    ("<a href='@'>x</a>", [("attribute", True, False)]),
    ("<link rel='canonical preload' href='@'>", [("attribute", True, True)]),
    ("<link rel='next canonical' href='@'><link rel=next type='text/css' href=@>", [("attribute", True, False), ("attribute", True, True)]),
    ("<!-- <script> @ --><div title='<script>'></div><img data-note='a > b' src='@'>", [("comment", False, False), ("attribute", True, True)]),
    ("<textarea><a href='@'></textarea><title><script>@</title>", [("text", True, False), ("text", True, False)]),
    ("<xmp>@</xmp><plaintext>@</plaintext><img src='@'>", [("xmp", False, False), ("plaintext", False, False), ("plaintext", False, False)]),
    ("<svg><script>u='@'</script></svg><script>u='@'</script>", [("text", True, False), ("script", False, False)]),
    ("<svg><style>p{{background:url(@)}}</style></svg><style>p{{background:url(@)}}</style>", [("foreign style", True, True), ("style", False, True)]),
    ("<svg><title><script>u='@'</script></title><foreignObject><script>u='@'</script></foreignObject></svg>", [("script", False, False)] * 2),
    ("<math><annotation-xml encoding='text/html'><script>u='@'</script></annotation-xml><annotation-xml><script>u='@'</script></math>", [("script", False, False), ("text", True, False)]),
    ("<svg><div><script>u='@'</script></div></svg><svg/><script>u='@'</script>", [("script", False, False)] * 2),
    ("<svg><font><script>u='@'</script></font><font color=x><script>u='@'</script></font></svg>", [("text", True, False), ("script", False, False)]),
    ("<noscript><style></noscript><img src='@'><noscript><a href='@'>", [("attribute", True, True), ("attribute", True, False)]),
    ("<!doctype html><?xml @ ?><p>a < b</p></ @><br a='1' a='@'>", [("comment", False, False), ("comment", False, False), ("text", True, False)]),
    ("<script><!-- <script>x</script> '@' --></script><svg><image xlink:href='@'/></svg>", [("script", False, False), ("attribute", True, True)]),
    ("<!--><iframe>@</iframe><a href='@", [("iframe", False, False), ("text", True, False)]),
]
_CASES = [(page.replace("{{", "{").replace("}}", "}"), found) for page, found in _PLACES]
_EXPECTED = ", ".join(
    f"({i}, {n}, {_sql_text(region)}, {str(decodes).lower()}, {str(loads).lower()})" for i, (_, found) in enumerate(_CASES) for n, (region, decodes, loads) in enumerate(found)
)


@query(
    f"""WITH wanted(k, n, region, decodes, resource) AS (VALUES {_EXPECTED})
SELECT page_id, CAST(n AS INT) AS n, 'archive-org' AS kind, region, '2014/http://x.example.com/' || page_id || CASE WHEN decodes THEN '?a=1&b=2' ELSE '?a=1&amp;b=2' END AS key, 'im_' AS flag, resource
FROM pages JOIN wanted ON k = page_id % {len(_CASES)}
UNION ALL SELECT page_id, -1, 'absolute-web-escape', NULL, NULL, NULL, false FROM pages
UNION ALL SELECT page_id, -2, 'archive-org-bare', NULL, NULL, NULL, false FROM pages"""
)
def html_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the archive by where a page's tokenizer finds them: what decodes, and what loads a resource."""
    pages = F.element_at(F.array(*[F.lit(page) for page, _ in _CASES]), (F.col("page_id") % len(_CASES) + 1).cast("int"))
    ref = F.concat(F.lit("https://web.archive.org/web/2014im_/http://x.example.com/"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2#top"))
    body = F.concat(F.lit("see Archive.org <p>http://mirror.example.com/web/2014/x</p> /web/2014/http://here.example.com/"), F.replace(pages, F.lit("@"), ref))
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.escapes(F.lit("html"), body)).alias("n", "e"))
    n = F.when(F.col("e.kind") == "archive-org", F.col("n") - 2).when(F.col("e.kind") == "archive-org-bare", -2).otherwise(-1)
    return found.select("page_id", n.cast("int").alias("n"), "e.kind", "e.region", "e.key", "e.flag", "e.resource")


@query(
    rf"""WITH {CAPTURES}, p AS (SELECT *, status = 'body' AS bodied, {_LINKED_HTML.format('https://web.archive.org', chr(92), ", 'g'")} AS old, {_LINKED_HTML.format('', chr(92), ", 'g'")} AS new FROM captures)
SELECT key, 'meta/' || substr(hash, 1, 2) || '/' || hash || '.json' AS path, status, CASE WHEN bodied THEN 'sha256-' || base64(unhex(sha256(new))) END AS content_hash,
  CASE WHEN bodied THEN CAST(octet_length(encode(new)) AS BIGINT) ELSE -1 END AS content_length, bodied AND old <> new AS rewritten,
  CAST(page_id % 3 AS INT) AS n_dynamic, CAST(0 AS BIGINT) AS findings FROM p"""
)
def remaster_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written as a tree of files, remastered into a second tree, and that read back and checked."""
    html = F.expr(_LINKED_HTML.format("https://web.archive.org", "$", ""))
    c = captures(spark, sf_dir).withColumn("body", F.when(F.col("status") == "body", F.encode(html, "UTF-8")))
    c = c.withColumn("content_hash", keys.sri(F.col("body")))
    found = F.transform(
        F.sequence(F.lit(1), F.col("page_id") % 3),
        lambda i: F.struct(F.concat(F.lit("2015/http://d.example.com/"), i.cast("string")).alias("key"), F.lit("manual").alias("via")),
    )
    sidecar = F.struct(
        F.lit(3).alias("v"), "key", F.lit("text/html").alias("contentType"), "status", F.col("content_hash").alias("contentHash"),
        F.octet_length("body").alias("contentLength"), F.when(F.col("page_id") % 3 > 0, found).alias("dynamic"), F.col("url").alias("own"),
    )
    hermetic, remastered = tree.fresh_root(spark, "hermetic"), tree.fresh_root(spark, "remastered")
    tree.write_tree(c.where("body IS NOT NULL").select(keys.body_path(F.col("content_hash")).alias("path"), F.col("body").alias("content")), hermetic)
    tree.write_tree(c.select(keys.meta_path(F.col("key")).alias("path"), F.to_json(sidecar).alias("content")), hermetic)
    record = build.remaster_tree(spark, hermetic, remastered).select("key", "rewritten")
    sidecars = store.read_sidecars(spark, remastered)
    doubts = verify.fsck(sidecars, store.read_bodies(spark, remastered, content=True).drop("content")).agg(F.count("*").alias("n"))
    return sidecars.join(record, "key").select(
        "key", "path", "status", "content_hash", F.coalesce("content_length", F.lit(-1).cast("long")).alias("content_length"), "rewritten",
        F.coalesce(F.size("dynamic"), F.lit(0)).alias("n_dynamic"), doubts.scalar().alias("findings"),
    )


_INDEXED = "'https://' || split_part(split_part(url, '://', 2), '/', 1) || '/'"


@query(
    f"""WITH r AS (SELECT page_id, {_INDEXED} AS url, strftime(TIMESTAMP '2014-01-01' + to_hours(page_id * 37), '%Y%m%d%H%M%S') AS timestamp, url AS original,
  CASE WHEN page_id % 4 = 0 THEN '404' WHEN page_id % 4 = 1 THEN '-' ELSE '200' END AS statuscode, CASE WHEN page_id % 5 > 0 THEN sha256(html) END AS digest, CAST(page_id % 3 AS INT) AS page FROM pages)
SELECT url, page, timestamp, original, digest, 'https://web.archive.org/web/' || timestamp || '/' || original AS replay FROM r
WHERE statuscode IN ('200', '404') AND timestamp >= '2014020' AND timestamp < '2015' AND original LIKE 'http%'"""
)
def recorded_cdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of recorded index answers, three pages for a host, whose filters the reader applies."""
    at = F.expr("date_format(timestampadd(HOUR, page_id * 37, timestamp'2014-01-01 00:00:00'), 'yyyyMMddHHmmss')")
    code = F.expr("CASE WHEN page_id % 4 = 0 THEN '404' WHEN page_id % 4 = 1 THEN '-' ELSE '200' END")
    digest = F.when(F.col("page_id") % 5 > 0, F.sha2("html", 256))
    rows = table(spark, sf_dir, "pages").select(F.expr(_INDEXED).alias("answer"), (F.col("page_id") % 3).alias("number"), at.alias("timestamp"), F.col("url").alias("original"), code.alias("statuscode"), digest.alias("digest"))
    row = F.to_json(F.array("timestamp", "original", "statuscode", "digest"), {"ignoreNullFields": "false"})
    # Rows of a host's page lie in one file, as the server answers.
    files = rows.groupBy("answer", "number").agg(
        F.concat(F.lit('[["timestamp","original","statuscode","digest"],'), F.array_join(F.sort_array(F.collect_list(row)), ","), F.lit("]")).alias("content")
    )
    name = F.concat(F.expr("replace(replace(answer, ':', '%3A'), '/', '%2F')"), F.lit("."), F.col("number").cast("string"), F.lit(".json"))
    root = tree.fresh_root(spark, "cdx")
    tree.write_tree(files.select(F.concat(F.lit("cdx/"), name).alias("path"), "content"), root)
    found = recorded.read_cdx(spark, root).where("statuscode IN ('200', '404') AND timestamp >= '2014020' AND timestamp < '2015' AND original LIKE 'http%'")
    return found.select("url", "page", "timestamp", "original", "digest", F.concat(F.lit(keys.ARCHIVE), "timestamp", F.lit("/"), "original").alias("replay"))


#: Two mirrors' answers for the first keys of each status, with differences planted by a page's number.
_SERVED = f"""{CAPTURES},
k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY key) AS n FROM captures),
a AS (SELECT key, page_id % 9 AS d, status, CASE status WHEN 'body' THEN 200 WHEN 'empty' THEN 200 WHEN 'redirect' THEN 302 ELSE 404 END AS s, octet_length(encode(html)) AS size FROM k WHERE n <= 20),
b AS (SELECT *, CASE WHEN d = 0 THEN 404 ELSE s END AS z, s = 200 AND d > 0 AND d <> 1 AS typed FROM a),
missed AS (SELECT *, octet_length(encode('<title>Not in <mirror-host></title>' || replace(key, '&', '&amp;'))) AS note FROM b)"""
_SERVED_ROWS = """SELECT key, 'status' AS field, 'root ' || s AS expected, 'bucket ' || z AS actual FROM missed WHERE s <> z
UNION ALL SELECT key, 'content-type', 'root ' || CASE WHEN s = 302 THEN 'null' ELSE 'text/html' END, 'bucket ' || CASE WHEN d = 0 THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END FROM missed WHERE s <> z OR s = 200 AND d = 1
UNION ALL SELECT key, 'location', 'root /web/2014/http://to.example.com/', 'bucket ' || CASE WHEN d = 0 THEN 'null' ELSE '/web/2014/http://other.example.com/' END FROM missed WHERE s = 302 AND d IN (0, 3)
UNION ALL SELECT key, 'body', 'root ' || CASE WHEN status = 'body' THEN size ELSE 0 END || 'B', 'bucket ' || CASE WHEN d = 0 THEN note ELSE size + 1 END || 'B' FROM missed WHERE s <> z OR status = 'body' AND d = 2"""
SERVING_FOUND = f"WITH {_SERVED} SELECT count(*) AS n FROM ({_SERVED_ROWS})"


@query(f"WITH {_SERVED} {_SERVED_ROWS}")
def serving_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a store and a bucket answer differently, for the first keys of each status and one that neither has."""
    c = captures(spark, sf_dir).withColumn("d", F.col("page_id") % 9)
    place = lambda host: F.concat(F.lit("/web/2014/http://"), host, F.lit(".example.com/"))
    root = c.select("key", "d", "status", F.lit("text/html").alias("content_type"), place(F.lit("to")).alias("location"), F.encode("html", "UTF-8").alias("body"))
    bucket = root.where("d > 0").select(
        "key",
        "status",
        F.when(F.col("d") == 1, "").otherwise(F.col("content_type")).alias("content_type"),
        F.when(F.col("d") == 3, place(F.lit("other"))).otherwise(F.col("location")).alias("location"),
        F.when(F.col("d") == 2, F.concat("body", F.lit(b"x"))).otherwise(F.col("body")).alias("body"),
    )
    wanted = verify.sample_per_status(c, 20).select("key").unionByName(spark.createDataFrame([("2014/http://parity.invalid/absent",)], "key string"))
    return verify.serving_parity(verify.served(wanted, root, "a.example:1"), verify.served(wanted, bucket, "b.example:22"), "a.example:1", "b.example:22")
