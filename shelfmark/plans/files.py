"""Registered queries over stores as files: written from the given tables, and read again by the engine's sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text
from ..functions.canonical import canonical_json
from ..operators import build, graph, relations, runs
from ..sources import store, tree
from ..streaming import bodies, ledgers
from .catalogue import CAPTURES, EDGES, assets, captures, query, table


def _written(files: DataFrame, name: str) -> str:
    """The root of a new tree of (path, content)."""
    root = tree.fresh_root(files.sparkSession, name)
    tree.write_tree(files, root)
    return root


_FOLDER = "CASE page_id % 7 WHEN 0 THEN '.git' WHEN 1 THEN 'node_modules' WHEN 2 THEN 'Site' WHEN 3 THEN 'site' WHEN 4 THEN 'sité' WHEN 5 THEN 'a-b' ELSE 'a/b' END || '/' || page_id"


@query(
    f"""WITH m AS (SELECT {_FOLDER} || '/wayback.json' AS file, page_id, url FROM pages WHERE page_id % 7 > 1)
SELECT file, CAST(row_number() OVER (ORDER BY file COLLATE en, file) AS INT) AS ord, url, 'https://web.archive.org/web/2014/' || url AS target FROM m"""
)
def manifest_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests found below a root in collation order, with the verdict of each; hidden folders and modules are left out."""
    entry = F.struct(F.concat(F.lit("https://web.archive.org/web/2014/"), "url").alias("wayback"), F.lit("2014").alias("timestamp"))
    made = F.struct(F.lit(2).alias("version"), F.array().cast("array<string>").alias("noRewrite"), F.create_map("url", entry).alias("entries"))
    files = table(spark, sf_dir, "pages").select(F.expr(f"{_FOLDER} || '/wayback.json'").alias("path"), F.to_json(made).alias("content"))
    found = store.discover_manifests(spark, _written(files, "ledger"))
    return store.parse_manifests(found).join(found.select("file", "ord"), "file").select("file", "ord", "url", "target")


@query(
    f"""WITH {CAPTURES} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'own' WHEN 3 THEN 'absent' ELSE 'not its own' END AS sidecar,
  CASE WHEN page_id % 4 = 0 AND status = 'body' THEN content_hash END AS digest, CASE WHEN page_id % 4 = 0 AND status = 'body' THEN CAST(octet_length(encode(html)) AS BIGINT) ELSE -1 END AS length,
  CAST(CASE WHEN page_id % 4 = 3 THEN 0 ELSE 1 END AS BIGINT) AS files FROM captures"""
)
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookups in a store on disk: whether a sidecar is there, is the key's own, and what body it names.

    Of four sidecars one is of another key, one of another version, and one missing.
    """
    c = captures(spark, sf_dir)
    kind = F.col("page_id") % 4
    side = F.struct(
        F.when(kind == 2, 2).otherwise(3).alias("v"),
        F.when(kind == 1, F.concat("key", F.lit("x"))).otherwise(F.col("key")).alias("key"),
        "status",
        F.when(F.col("status") == "body", F.col("content_hash")).alias("contentHash"),
    )
    files = c.where(kind < 3).select(keys.meta_path(F.col("key")).alias("path"), F.to_json(side).alias("content"))
    root = _written(files.unionByName(c.select(keys.body_path(F.col("content_hash")).alias("path"), F.col("html").alias("content")).distinct()), "store")
    sidecars = store.read_sidecars(spark, root, "collect")
    asked = store.find_sidecar(sidecars, c.select("key"))
    named = sidecars.select("key", keys.body_path(F.col("content_hash")).alias("body")).join(
        store.read_bodies(spark, root, content=True).select(F.col("path").alias("body"), "digest", "length"), "body", "left"
    )
    walked = store.read_entries(spark, root).groupBy("path").agg(F.count("*").alias("files"))
    rows = c.select("page_id", "key", keys.meta_path(F.col("key")).alias("path")).join(asked, "key").join(walked, "path", "left")
    rows = rows.join(named.withColumnRenamed("key", "own"), (F.col("own") == F.col("key")) & F.col("authentic"), "left")
    sidecar = F.when(~F.col("found"), "absent").when(F.col("authentic"), "own").otherwise("not its own")
    return rows.select(
        "page_id", sidecar.alias("sidecar"), "digest", F.coalesce("length", F.lit(-1).cast("long")).alias("length"), F.coalesce("files", F.lit(0).cast("long")).alias("files")
    )


@query(
    """SELECT event_id AS seq, 'k' || user_id AS key, event_type AS verdict FROM events WHERE event_id % 5 NOT IN (1, 2)"""
)
def torn_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON lines ledger with torn and blank lines, of which the whole ones are read."""
    whole = F.to_json(F.struct(F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("verdict")))
    torn = F.when(F.col("event_id") % 5 == 1, F.expr("left(line, length(line) - 3)")).when(F.col("event_id") % 5 == 2, F.lit(" ")).otherwise(F.col("line"))
    root = tree.fresh_root(spark, "lines")
    table(spark, sf_dir, "events").withColumn("line", whole).select(torn.alias("value")).write.text(root)
    return store.read_jsonl(spark, root, "key STRING, seq LONG, verdict STRING").select("seq", "key", "verdict")


@query("""SELECT 'notes/' || page_id % 10 || '/' || page_id || '.md' AS file, sha256('# ' || url || chr(10) || html) AS hash FROM pages WHERE page_id % 3 > 0""")
def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files below a folder, read whole; other files are not."""
    name = F.concat(F.lit("notes/"), (F.col("page_id") % 10).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 > 0, ".md").otherwise(".txt"))
    files = table(spark, sf_dir, "pages").select(name.alias("path"), F.concat(F.lit("# "), "url", F.lit("\n"), "html").alias("content"))
    found = store.read_texts(spark, _written(files, "prose"))
    return found.select(F.regexp_extract("file", "(notes/.*)", 1).alias("file"), F.sha2("text", 256).alias("hash"))


@query(
    """WITH e AS (SELECT *, user_id AS run FROM events)
SELECT 'run' || run AS signature, CAST(run % 7 AS DOUBLE) AS sample, count(*) FILTER (event_id % 3 = 0) AS verified, count(*) FILTER (event_id % 3 = 1) AS healed,
  CAST(run % 4 AS BIGINT) AS layers FROM e GROUP BY run"""
)
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verification checkpoints, written as JSON files and read with their shape checked."""
    id_ = F.col("event_id").cast("string")
    runs_ = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        F.collect_list(F.when(F.col("event_id") % 3 == 0, id_)).alias("verified"), F.collect_list(F.when(F.col("event_id") % 3 == 1, id_)).alias("healed")
    )
    passed = F.transform(F.slice(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(1), (F.col("run") % 4).cast("int")), lambda x: F.struct(x.alias("layer"), F.lit(True).alias("pass")))
    target = F.struct(F.lit("https://e").alias("endpoint"), F.lit("b").alias("bucket"), F.lit("p").alias("prefix"))
    made = F.struct(
        F.concat(F.lit("run"), "run").alias("signature"), (F.col("run") % 7).alias("sample"), target.alias("target"), passed.alias("passed"),
        F.struct("verified", "healed").alias("bodies"),
    )
    root = _written(runs_.select(F.concat(F.lit(".verify/"), "run", F.lit(".json")).alias("path"), F.to_json(made).alias("content")), "points")
    raw = store.read_texts(spark, f"{root}/.verify", "*.json").withColumnRenamed("text", "json")
    size = lambda c: F.size(c).cast("long")
    return store.parse_checkpoint(raw).select(
        "signature", "sample", size("bodies.verified").alias("verified"), size("bodies.healed").alias("healed"), size("passed").alias("layers")
    )


_REF = "'https://web.archive.org/web/2014im_/http://x.example.com/' || page_id % 5 || '.png'"


@query(
    f"""WITH r AS (SELECT page_id, {_REF} AS ref, page_id % 5 < 3 AS held FROM pages),
n AS (SELECT *, CASE WHEN held THEN substr(ref, 24) ELSE ref END AS new FROM r)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'p{{background:url(' || new || ') /* ' || new || ' */}}' WHEN 1 THEN 'u="' || new || '"; v=''' || ref || ' x''' || '; w="a ' || ref || '"' ELSE ref || ' stays' END AS body,
  CAST(CASE WHEN NOT held THEN 0 WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 3 = 1 THEN 1 ELSE 0 END AS INT) AS count FROM n"""
)
def rewrite_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets, scripts (whole literals alone) and other texts with references, of which some are held."""
    held = F.array(*[F.lit(f"2014/http://x.example.com/{k}.png") for k in range(3)])
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'css' WHEN 1 THEN 'js' END")
    body = F.expr(
        "CASE page_id % 3 WHEN 0 THEN 'p{background:url(' || ref || ') /* ' || ref || ' */}' WHEN 1 THEN concat('u=\"', ref, '\"; v=\\'', ref, ' x\\'', '; w=\"a ', ref, '\"') ELSE ref || ' stays' END"
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_REF).alias("ref")).select("page_id", kind.alias("kind"), body.alias("body"))
    return rows.select("page_id", text.rewritten("kind", "body", held).alias("r")).select("page_id", F.col("r.text").alias("body"), "r.count")


@query(
    """WITH c AS (SELECT 'u' || user_id % 20 AS url, strftime(ts, '%Y%m%d%H') AS timestamp, event_id AS ord, event_type AS original, CASE WHEN event_id % 3 = 0 THEN '404' ELSE '200' END AS statuscode FROM events),
w AS (SELECT DISTINCT 'u' || user_id % 20 AS url, strftime(ts, '%Y%m%d%H') || CASE WHEN event_id % 4 = 0 THEN '00' ELSE '' END AS timestamp FROM events WHERE event_id % 2 = 0)
SELECT w.url, w.timestamp, arg_min(original, ord) AS original, arg_min(statuscode, ord) AS statuscode FROM w LEFT JOIN c ON c.url = w.url AND c.timestamp = w.timestamp GROUP BY w.url, w.timestamp"""
)
def exact_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's row of a very timestamp, errors too; longer timestamps are other captures."""
    events = table(spark, sf_dir, "events").withColumns({"url": F.expr("'u' || user_id % 20"), "timestamp": F.date_format("ts", "yyyyMMddHH")})
    cdx = events.select(
        "url", "timestamp", F.col("event_id").alias("ord"), F.col("event_type").alias("original"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN '404' ELSE '200' END").alias("statuscode"), F.lit("text/html").alias("mimetype"),
    )
    wanted = events.where("event_id % 2 = 0").select("url", F.expr("timestamp || CASE WHEN event_id % 4 = 0 THEN '00' ELSE '' END").alias("timestamp")).distinct()
    return runs.exact_captures(cdx, wanted).drop("mimetype")


@query(
    f"""WITH {CAPTURES}, s AS (SELECT '2015/' || url AS key, page_id FROM captures), scope AS (SELECT DISTINCT key FROM s),
d AS (SELECT DISTINCT key FROM s WHERE page_id % 3 = 0) SELECT key FROM (SELECT key FROM scope ORDER BY key LIMIT 120) WHERE key NOT IN (SELECT key FROM d)"""
)
def audit_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an audit's first 120 captures (its own limit); the checkpoint holds some verdicts twice."""
    scope = captures(spark, sf_dir).select("page_id", F.concat(F.lit("2015/"), "url").alias("key"))
    done = scope.where("page_id % 3 = 0")
    return runs.audit_todo(scope.select("key").distinct(), done.unionByName(done).select("key"), 120)


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '{"flag":' || CASE WHEN page_id % 2 = 0 THEN '"im_"' ELSE 'null' END || ',"key":"2014/' || url || '","via":"manual"}'
  ELSE '{"firstSeen":"2024-01-02T03:04:05Z","flag":' || CASE WHEN page_id % 2 = 0 THEN '"im_"' ELSE 'null' END || ',"key":"2014/' || url || '","via":"manual"}' END AS json FROM pages"""
)
def dynamic_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browser-found entries in JSON: the flag is there even if null, the first sight only if known."""
    entry = F.struct(
        F.concat(F.lit("2014/"), "url").alias("key"), F.when(F.col("page_id") % 2 == 0, "im_").alias("flag"), F.lit("manual").alias("via"),
        F.when(F.col("page_id") % 3 > 0, "2024-01-02T03:04:05Z").alias("firstSeen"),
    )
    return table(spark, sf_dir, "pages").select("page_id", build.dynamic_json(entry).alias("json"))


@query(
    """SELECT page_id, '{"9":[1,2.5,1e+21,{"a":null,"b":"' || url || '"}],"10":' || page_id || ',"a":{"y":true,"z":{}},"é":' || CASE WHEN page_id % 2 = 0 THEN '[]' ELSE '0.001' END || '}' AS json FROM pages"""
)
def canonical_json_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with its keys in any order, white space and numbers in other spellings, in canonical form."""
    made = F.concat(
        F.lit(' { "é" : '), F.when(F.col("page_id") % 2 == 0, "[ ]").otherwise("1e-3"), F.lit(' , "a":{"z":{ },\n"y":true}, "10":'), F.col("page_id").cast("string"),
        F.lit('.0,"9":[1.0,25e-1,1000000000000000000000,{"b":"'), "url", F.lit('","a":null}] }'),
    )
    return table(spark, sf_dir, "pages").select("page_id", canonical_json(made).alias("json"))


@query(
    """WITH l AS (SELECT user_id, event_id, event_id % 7 = 0 AS undone, 7 + event_id % 3 % 2 AS rule FROM events),
last AS (SELECT user_id, arg_max(undone, event_id) AS undone, arg_max(rule, event_id) AS rule FROM l GROUP BY user_id)
SELECT 'k' || user_id AS key FROM last WHERE NOT undone AND rule = 7"""
)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are verified under the live rules, from a ledger that is appended to and streamed twice."""
    undone = F.col("event_id") % 7 == 0
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_id").cast("long").alias("seq"),
        F.when(~undone | (F.col("event_id") % 2 == 0), F.lit(7) + F.col("event_id") % 3 % 2).cast("long").alias("ruleVersion"),
        F.when(undone, F.lit(False)).alias("verified"), F.lit("2024-01-02T03:04:05Z").alias("at"),
    )
    root = tree.fresh_root(spark, "verified")
    for odd in (True, False):  # later rows arrive first
        ledgers.append_rows(rows.where((F.col("seq") % 2 == 1) == F.lit(odd)), f"{root}/ledger")
        ledgers.keep_latest(ledgers.stream_jsonl(spark, f"{root}/ledger"), f"{root}/latest", f"{root}/checkpoint").awaitTermination()
    return ledgers.verified_keys(ledgers.read_latest(spark, f"{root}/latest"), 7)


@query(
    f"""WITH {CAPTURES}, b AS (SELECT DISTINCT content_hash, octet_length(encode(html)) AS n FROM captures WHERE status = 'body')
SELECT content_hash AS digest, CAST(n AS BIGINT) AS length, true AS sound FROM b UNION ALL SELECT 'sha256-' || base64(unhex(sha256('x'))), 1, false"""
)
def body_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies on disk, hashed as a stream of files in two runs of one verification; one lies at a wrong place."""
    c = captures(spark, sf_dir).where("status = 'body'").select("page_id", keys.body_path(F.col("content_hash")).alias("path"), F.col("html").alias("content"))
    root = _written(c.where("page_id % 2 = 0").drop("page_id"), "bodies")
    state = bodies.state_folder(tree.fresh_root(spark, "verify"), "signature", "https://e", "b", "p")
    bodies.verify_bodies(bodies.stream_bodies(spark, root), state).awaitTermination()
    late = c.join(c.where("page_id % 2 = 0").select("path").distinct(), "path", "left_anti").select("path", "content")
    tree.write_tree(late.unionByName(spark.createDataFrame([("cap/00/wrong", "x")], "path string, content string")), root)
    bodies.verify_bodies(bodies.stream_bodies(spark, root), state).awaitTermination()
    return bodies.found_bodies(spark, state).select("digest", "length", "sound")


@query(
    f"""WITH {CAPTURES}, r AS (SELECT page_id % 9 AS source, page_id, CASE page_id % 4 WHEN 0 THEN 'http://B.com/é' WHEN 1 THEN 'http://b.com/e' WHEN 2 THEN 'http://b.com/É' ELSE 'http://b-c.com/' END || page_id AS original FROM captures)
SELECT 's' || source AS source, '2014' AS timestamp, original, CAST(row_number() OVER (PARTITION BY source ORDER BY original COLLATE en) AS INT) AS n FROM r"""
)
def ordered_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of each source in collation order: letters before marks, accents before case."""
    original = F.expr("CASE page_id % 4 WHEN 0 THEN 'http://B.com/é' WHEN 1 THEN 'http://b.com/e' WHEN 2 THEN 'http://b.com/É' ELSE 'http://b-c.com/' END || page_id")
    refs = captures(spark, sf_dir).select(F.expr("'s' || page_id % 9").alias("source"), F.lit("2014").alias("timestamp"), original.alias("original"))
    return runs.ordered_refs(refs)


@query(
    """WITH p AS (SELECT page_id, 'x' || repeat(chr(233), CAST(page_id % 50 AS INT)) || ' see(archive.org/' || page_id || ') ' || url AS body FROM pages)
SELECT page_id, 'archive.org/' || page_id AS token, CASE WHEN page_id % 50 + 6 > 40 THEN '…' ELSE '' END || regexp_replace(substr(body, CAST(greatest(page_id % 50 + 7 - 40, 1) AS INT), CAST(51 + least(page_id % 50 + 6, 40) AS INT)), '[^\\x20-\\x7e]', '·', 'g')
  || CASE WHEN length(body) > page_id % 50 + 17 + 40 THEN '…' ELSE '' END AS excerpt FROM p"""
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word and the text around a mention of the archive, on one line, cut where it goes on."""
    body = F.expr("'x' || repeat('é', cast(page_id % 50 AS int)) || ' see(archive.org/' || page_id || ') ' || url")
    hits = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.get(text.bare_hits(body), 0).alias("h"))
    return hits.select("page_id", "h.token", "h.excerpt")


@query(
    f"""WITH {CAPTURES}, {EDGES}, roots AS (SELECT key FROM captures WHERE page_id % 5 = 0),
marked AS (SELECT key FROM roots UNION SELECT child FROM edges WHERE parent IN (SELECT key FROM roots)),
side AS (SELECT key, hash, status, page_id, url FROM captures UNION ALL SELECT child, sha256(child), 'body', 0, NULL FROM (SELECT DISTINCT child FROM edges)
  UNION ALL SELECT '2013' || substr(key, 5), sha256('2013' || substr(key, 5)), 'empty', page_id, url FROM captures WHERE page_id % 2 = 0),
g AS (SELECT * FROM side WHERE key NOT IN (SELECT key FROM marked) AND page_id % 3 < 2)
SELECT hash, key, 'meta/' || substr(hash, 1, 2) || '/' || hash || '.json' AS meta_object, CASE WHEN status = 'body' THEN 'cap/' || substr(hash, 1, 2) || '/' || hash ELSE '' END AS cap_object,
  CASE WHEN substr(key, strpos(key, '/') + 1) IN (SELECT substr(key, strpos(key, '/') + 1) FROM marked) THEN 're-pointed' ELSE 'de-waybacked' END AS reason,
  CAST(CASE WHEN status = 'body' THEN 2 ELSE 1 END AS BIGINT) AS objects FROM g"""
)
def sweep_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures that no root reaches and that are old enough, why, and how many objects each takes along."""
    c = captures(spark, sf_dir)
    edges, _ = assets(spark, sf_dir)
    marked = graph.reachable(edges, c.where("page_id % 5 = 0").select("key"))
    at = F.when(F.col("page_id") % 3 < 2, "2024-01-01T00:00:00Z").otherwise("2025-01-01T00:00:00Z").alias("fetched_at")
    older = c.where("page_id % 2 = 0").select(F.expr("concat('2013', substring(key, 5))").alias("key"), F.lit("empty").alias("status"), at)
    children = edges.select(F.col("child").alias("key"), F.lit("body").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("fetched_at")).distinct()
    found = graph.sweep_manifest(c.select("key", "status", at).unionByName(children).unionByName(older), marked, F.lit("2024-06-01T00:00:00Z"), "g1")
    taken = graph.sweep_actions(found, "g1", marked).groupBy("hash").agg(F.count("*").alias("objects"))
    return found.join(taken, "hash").select("hash", "key", "meta_object", F.coalesce("cap_object", F.lit("")).alias("cap_object"), "reason", "objects")


_HOST = "lower(split_part(split_part(url, '://', 2), '/', 1))"


@query(
    f"""WITH h AS (SELECT {_HOST} AS host, min(page_id) AS id FROM pages GROUP BY 1),
p AS (SELECT id AS ord, CASE WHEN id % 3 = 0 THEN host WHEN id % 3 = 1 THEN regexp_replace(host, '^[^.]*[.]', '') ELSE '' END AS host, 'r' || id AS reason FROM h),
u AS (SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN 'https://evil' || {_HOST} || '/' ELSE url END AS url, CASE WHEN page_id % 4 = 0 THEN 'evil' ELSE '' END || {_HOST} AS place FROM pages)
SELECT url, arg_min(p.host, ord) AS host, arg_min(reason, ord) AS reason FROM u LEFT JOIN p ON p.host <> '' AND (place = p.host OR ends_with(place, '.' || p.host)) GROUP BY url"""
)
def policy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of a policy in JSON that allows a URL's host, at label boundaries; entries without a host are dropped."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_HOST).alias("host"))
    known = pages.groupBy("host").agg(F.min("page_id").alias("id"))
    written = F.expr("CASE WHEN id % 3 = 0 THEN concat(' ', upper(host)) WHEN id % 3 = 1 THEN regexp_replace(host, '^[^.]*[.]', '') ELSE ' ' END")
    entry = F.struct(written.alias("host"), F.concat(F.lit("r"), "id").alias("reason"))
    raw = known.select(F.format_string("%012d.json", "id").alias("file"), F.to_json(F.struct(F.lit(1).alias("version"), F.array(entry).alias("escapes"))).alias("json"))
    urls = pages.select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://evil"), "host", F.lit("/"))).otherwise(F.col("url")).alias("url"))
    return runs.policy_matches(urls, runs.compiled_policy(raw))


@query(
    f"""WITH {CAPTURES}, {EDGES} SELECT child AS key FROM edges WHERE NOT dynamic OR CAST(regexp_extract(child, 'a([0-9]+)[.]png', 1) AS INT) % 3 > 0
UNION SELECT split_part(key, '#', 1) FROM captures WHERE page_id % 2 = 0"""
)
def union_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents together record: requisites and sound browser-found entries, without fragments."""
    edges, _ = assets(spark, sf_dir)
    broken = F.col("dynamic") & (F.regexp_extract("child", "a([0-9]+)[.]png", 1).cast("int") % 3 == 0)
    linked = captures(spark, sf_dir).where("page_id % 2 = 0").select(F.col("key").alias("parent"), F.concat("key", F.lit("#top")).alias("child"), F.lit(None).cast("string").alias("error"))
    return relations.union_frontier(edges.select("parent", "child", F.when(broken, "unknown via").alias("error")).unionByName(linked))
