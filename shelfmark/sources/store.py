"""Readers of stores, manifests and ledgers, with three policies for defects.

strict raises on the first defect, lenient skips unreadable rows, collect
turns every defect into a column. Files of stores and of manifests are listed
and read by tasks (:mod:`.tree`); ledgers and records in lines by Spark's readers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.steps import settle
from . import tree

SIDECAR = (
    "v INT, key STRING, contentType STRING, status STRING, contentHash STRING, contentLength BIGINT,"
    " signature STRING, target STRUCT<url:STRING,timestamp:STRING>, requisites ARRAY<STRING>, flag STRING,"
    " dynamic ARRAY<STRUCT<key:STRING,flag:STRING,via:STRING,firstSeen:STRING>>, fetchedAt STRING"
)
MANIFEST = (
    "version INT, noRewrite ARRAY<STRING>, rewrites MAP<STRING,STRING>,"
    " entries MAP<STRING,STRUCT<wayback:STRING,timestamp:STRING,checkedAt:STRING>>, exclude ARRAY<STRING>"
)


def read_sidecars(spark: SparkSession, root: str, policy: str = "strict") -> DataFrame:
    """Sidecars below ``root/meta``: path, defect and the fields in snake case."""
    return parse_sidecars(read_raw_sidecars(spark, root), policy)


def read_for_projection(spark: SparkSession, root: str) -> DataFrame:
    """Sidecars that are to be projected into a bucket: read strictly, and each at the very path that its key has."""
    from ..functions.keys import meta_path

    sidecars = read_sidecars(spark, root)
    misplaced = F.raise_error(F.concat("path", F.lit(" is not the place of "), "key"))
    return sidecars.withColumn("path", F.when(F.col("path") == meta_path(F.col("key")), F.col("path")).otherwise(misplaced))


def read_raw_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path from the root, json) of the sidecars below ``root/meta``."""
    files = tree.read_tree(spark, f"{root.rstrip('/')}/meta", "*.json")
    return files.select(F.concat(F.lit("meta/"), "path").alias("path"), F.col("content").cast("string").alias("json"))


def parse_sidecars(raw: DataFrame, policy: str = "strict", *more: str) -> DataFrame:
    """(path, json) to sidecar rows by policy, with more columns of raw beside them."""
    parsed = raw.withColumn("_v", F.try_parse_json("json"))
    isobject = F.coalesce(F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), F.lit(False))
    read = parsed.select("path", *more, isobject.alias("_ok"), F.from_json("json", SIDECAR).alias("s"))
    defect = (
        F.when(~F.col("_ok"), "not an object")
        .when(F.col("s.v").isNull() | (F.col("s.v") != 3), "version")
        .when(F.col("s.key").isNull(), "no key")
    )
    read = read.withColumn("defect", defect)
    if policy == "strict":
        bad = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("defect")))
        read = read.withColumn("path", F.when(F.col("defect").isNotNull(), bad).otherwise(F.col("path")))
    elif policy == "lenient":
        wrong = F.raise_error(F.concat(F.col("path"), F.lit(": version")))
        read = read.where("defect IS NULL OR defect = 'version'").withColumn(
            "path", F.when(F.col("defect") == "version", wrong).otherwise(F.col("path"))
        )
    elif policy != "collect":
        raise ValueError(f"unknown policy {policy}")
    snake = {"contentType": "content_type", "contentHash": "content_hash", "contentLength": "content_length", "fetchedAt": "fetched_at"}
    names = [f.split(" ")[0] for f in SIDECAR.replace(", ", "\n").split("\n") if " " in f]
    fields = ["v", "key", "contentType", "status", "contentHash", "contentLength", "signature", "target", "requisites", "flag", "dynamic", "fetchedAt"]
    assert set(fields) <= set(names)
    return read.select("path", "defect", *[F.col(f"s.{f}").alias(snake.get(f, f)) for f in fields], *more)


def edges_of(sidecars: DataFrame) -> DataFrame:
    """(parent, child, dynamic, flag) of the sidecars' requisites and browser-found entries."""
    fixed = sidecars.select(F.col("key").alias("parent"), F.explode("requisites").alias("child")).select(
        "parent", "child", F.lit(False).alias("dynamic"), F.lit(None).cast("string").alias("flag")
    )
    found = sidecars.select(F.col("key").alias("parent"), F.explode("dynamic").alias("d")).select(
        "parent", F.col("d.key").alias("child"), F.lit(True).alias("dynamic"), F.col("d.flag").alias("flag")
    )
    return fixed.unionByName(found)


def read_bodies(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Bodies below ``root/cap``: path and length; with their bytes and digest only if asked for."""
    folder, path = f"{root.rstrip('/')}/cap", F.concat(F.lit("cap/"), "path").alias("path")
    if not content:
        return tree.list_tree(spark, folder).select(path, "length")
    from ..functions.keys import sri

    return tree.read_tree(spark, folder).select(path, "length", sri(F.col("content")).alias("digest"), "content")


def parse_manifests(raw: DataFrame) -> DataFrame:
    """(file, json) to verdicts in long form: file, section, pos, url, target, timestamp. Version 2 only."""
    m = raw.select("file", F.from_json("json", MANIFEST).alias("m"))
    bad = F.raise_error(F.concat(F.col("file"), F.lit(": not a version 2 manifest")))
    m = m.withColumn("file", F.when(F.coalesce(F.col("m.version") == 2, F.lit(False)), F.col("file")).otherwise(bad))
    none = F.lit(None).cast("string")

    def told(section: str, pos, url, target=none, timestamp=none):
        return F.struct(F.lit(section).alias("section"), pos.alias("pos"), url.alias("url"), target.alias("target"), timestamp.alias("timestamp"))

    # All sections in one pass: files are read once.
    sections = [
        F.transform("m.noRewrite", lambda url, pos: told("noRewrite", pos, url)),
        F.transform("m.exclude", lambda url, pos: told("exclude", pos, url)),
        F.transform(F.map_entries("m.rewrites"), lambda e, pos: told("rewrites", pos, e["key"], e["value"])),
        F.transform(F.map_entries("m.entries"), lambda e, pos: told("entries", pos, e["key"], e["value"]["wayback"], e["value"]["timestamp"])),
    ]
    return m.select("file", F.explode(F.flatten(F.array_compact(F.array(*sections)))).alias("e")).select("file", "e.*")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts of every ``wayback.json`` below a folder, but not below dot folders or ``node_modules``."""
    files = tree.with_content(tree.list_tree(spark, root, "wayback.json", "node_modules"), root)
    return parse_manifests(files.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("file"), F.col("content").cast("string").alias("json")))


def discover_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(file from the root, json, ord) of every ``wayback.json`` below a root, in the order of the Unicode collation.

    Dot folders and ``node_modules`` are not looked into; a missing root has none.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file string, json string, ord int")
    names = tree.list_tree(spark, root, "wayback.json", "node_modules").select("path")
    # Names are sorted by range and numbered within their part; only the parts' sizes meet in one place.
    placed = settle(names.orderBy(F.collate("path", "UNICODE"), "path").select("path", F.monotonically_increasing_id().alias("_id")))
    placed = placed.select("path", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_n"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(parts), "_part").select("path", (F.col("_n") + F.col("_before") + 1).cast("int").alias("ord"))
    return tree.with_content(numbered, root).select(F.col("path").alias("file"), F.col("content").cast("string").alias("json"), "ord")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines ledger; blank and torn lines are skipped."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


UNIVERSE = "rewrites MAP<STRING,STRING>, exclude ARRAY<STRING>, fqdns MAP<STRING,MAP<STRING,STRING>>"
#: The behaviours of hosts and what each may be; a bare lower-case host name.
BEHAVIORS = {"on404": ("probe-repo-root-follow-rename",)}
FQDN = r"^(?=.{1,253}\z)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\z"


def parse_universe(raw: DataFrame) -> DataFrame:
    """(file, json) of policies to long rows: file, section (rewrites, exclude, fqdns), name, behavior, value.

    Raises for what is no object, empty targets and prefixes, hosts that are
    no bare lower-case names, and behaviours or values that are not known.
    """
    variant = F.try_parse_json("json")
    isobject = F.coalesce(F.startswith(F.schema_of_variant(variant), F.lit("OBJECT")), F.lit(False))
    u = raw.select("file", F.when(isobject, F.from_json("json", UNIVERSE)).alias("u"))
    none = F.lit(None).cast("string")

    def checked(rows: DataFrame, sound, what: str) -> DataFrame:
        bad = F.raise_error(F.concat(F.col("file"), F.lit(f": invalid universe, {what}: "), F.coalesce("name", F.lit(""))))
        return rows.withColumn("name", F.when(F.coalesce(sound, F.lit(False)), F.col("name")).otherwise(bad))

    u = u.withColumn("file", F.when(F.col("u").isNull(), F.raise_error(F.concat(F.col("file"), F.lit(": invalid universe, not an object")))).otherwise(F.col("file")))
    rewrites = u.select("file", F.explode(F.map_entries("u.rewrites")).alias("e")).select(
        "file", F.lit("rewrites").alias("section"), F.col("e.key").alias("name"), none.alias("behavior"), F.col("e.value").alias("value")
    )
    exclude = u.select("file", F.explode("u.exclude").alias("name")).select(
        "file", F.lit("exclude").alias("section"), "name", none.alias("behavior"), none.alias("value")
    )
    hosts = u.select("file", F.explode(F.map_entries("u.fqdns")).alias("e")).select("file", F.col("e.key").alias("name"), F.explode(F.map_entries("e.value")).alias("b"))
    hosts = hosts.select("file", F.lit("fqdns").alias("section"), "name", F.col("b.key").alias("behavior"), F.col("b.value").alias("value"))
    allowed = [(F.col("behavior") == name) & F.col("value").isin(*values) for name, values in BEHAVIORS.items()]
    hosts = checked(checked(hosts, F.col("name").rlike(FQDN), "no bare host name"), F.array_contains(F.array(*allowed), True), "unknown behaviour of")
    return (
        checked(rewrites, F.col("value") != "", "empty target of")
        .unionByName(checked(exclude, F.col("name") != "", "empty exclude"))
        .unionByName(hosts)
    )


def read_universe(spark: SparkSession, file: str) -> DataFrame:
    """The policy of one file in long form; see :func:`parse_universe`."""
    raw = spark.read.text(file, wholetext=True).select(F.lit(file).alias("file"), F.col("value").alias("json"))
    return parse_universe(raw)


def host_behaviors(urls: DataFrame, universe: DataFrame) -> DataFrame:
    """(url, behavior, value) of URLs whose exact host has behaviours; subdomains inherit none."""
    from ..functions.keys import host_of

    known = universe.where("section = 'fqdns'").select(F.col("name").alias("host"), "behavior", "value")
    return urls.select("url", host_of(F.col("url")).alias("host")).join(known, "host").select("url", "behavior", "value")


def read_texts(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(file, text) of the text files below a folder; an absent folder gives no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file string, text string")
    files = tree.read_tree(spark, root, pattern)
    return files.select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("file"), F.col("content").cast("string").alias("text"))


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """(path from the root, length) of every file of a store, by listing alone; no content is read."""
    return tree.list_tree(spark, root).select("path", "length")


def find_sidecar(sidecars: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookups (key) with a check that what was found is what was asked for: key, found, authentic."""
    from ..functions.keys import meta_path

    asked = wanted.select("key", meta_path(F.col("key")).alias("path"))
    found = sidecars.select("path", F.col("key").alias("own"), "v", F.lit(True).alias("found"))
    authentic = F.col("own").eqNullSafe(F.col("key")) & F.coalesce(F.col("v") == 3, F.lit(False))
    return asked.join(found, "path", "left").select(
        "key", F.coalesce("found", F.lit(False)).alias("found"), F.when(F.col("found"), authentic).alias("authentic")
    )


CHECKPOINT = (
    "signature STRING, sample DOUBLE, target STRUCT<endpoint:STRING,bucket:STRING,prefix:STRING>,"
    " passed ARRAY<STRUCT<layer:DOUBLE,pass:BOOLEAN>>, bodies STRUCT<verified:ARRAY<STRING>,healed:ARRAY<STRING>>"
)


def parse_checkpoint(raw: DataFrame) -> DataFrame:
    """(file, json) of verification checkpoints to rows; damaged ones raise, since a resume from them can pass wrongly."""
    c = raw.select("file", F.from_json("json", CHECKPOINT).alias("c"))
    sound = (
        F.col("c.signature").isNotNull()
        & F.col("c.sample").isNotNull()
        & F.col("c.target.endpoint").isNotNull()
        & F.col("c.target.bucket").isNotNull()
        & F.col("c.target.prefix").isNotNull()
        & F.col("c.passed").isNotNull()
        & F.forall("c.passed", lambda x: x["layer"].isNotNull() & F.coalesce(x["pass"], F.lit(False)))
        & F.col("c.bodies.verified").isNotNull()
        & F.col("c.bodies.healed").isNotNull()
    )
    bad = F.raise_error(F.concat(F.col("file"), F.lit(" is not a verify checkpoint")))
    return c.select(F.when(F.coalesce(sound, F.lit(False)), F.col("file")).otherwise(bad).alias("file"), "c.*")


BUILD = (
    "v INT, engineVersion STRING, ruleVersion STRING,"
    " entries ARRAY<STRUCT<contentType:STRING,inputHash:STRING,key:STRING,outputHash:STRING,rewritten:BOOLEAN,status:STRING>>"
)


def parse_build(raw: DataFrame) -> DataFrame:
    """(json) of a build record to its entries in snake case, with the versions beside each."""
    b = raw.select(F.from_json("json", BUILD).alias("b")).select("b.v", "b.engineVersion", "b.ruleVersion", F.explode("b.entries").alias("e"))
    return b.select(
        "v",
        F.col("engineVersion").alias("engine_version"),
        F.col("ruleVersion").alias("rule_version"),
        "e.key",
        F.col("e.contentType").alias("content_type"),
        "e.status",
        F.col("e.inputHash").alias("input_hash"),
        F.col("e.outputHash").alias("output_hash"),
        "e.rewritten",
    )


def read_build_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of a build record kept as JSON lines, in snake case."""
    entry = BUILD.partition("STRUCT<")[2].removesuffix(">>").replace(":", " ").replace(",", ", ")
    e = spark.read.text(folder).select(F.from_json("value", entry).alias("e"))
    return e.select(
        "e.key",
        F.col("e.contentType").alias("content_type"),
        "e.status",
        F.col("e.inputHash").alias("input_hash"),
        F.col("e.outputHash").alias("output_hash"),
        "e.rewritten",
    )


def snapshots(cdx: DataFrame, low: str | None = None, high: str | None = None, limit: int = 10) -> DataFrame:
    """The first ``limit`` captures of each URL between two timestamps (prefixes allowed), by time; a report of the first few.

    cdx: url, timestamp, original, mimetype, statuscode, digest, length.
    """
    rows = cdx
    if low:
        rows = rows.where(F.rpad("timestamp", 14, "0") >= low.ljust(14, "0"))
    if high:
        rows = rows.where(F.rpad("timestamp", 14, "0") <= high.ljust(14, "9"))
    number = F.row_number().over(Window.partitionBy("url").orderBy("timestamp", "original", "digest"))
    kept = rows.withColumn("n", number).where(F.col("n") <= limit)
    return kept.withColumn("replay", F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("/"), "original"))
