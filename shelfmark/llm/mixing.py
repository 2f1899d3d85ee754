"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 48-bit hash. A source's target is met by taking
each document ``floor(target / source size)`` times and, for the remaining
budget, once more those whose hash lies below a threshold. A threshold is
found on histograms: tokens are summed by source and top hash bits, a running
sum over the (at most 4,096) buckets of a source shows in which one the budget
runs out, and only that bucket is resolved by the next bits. What the document
at the boundary leaves of the budget, less than its size, is filled from a
histogram of the sizes that fit, largest first, with a threshold for each size
of which not all are taken. All thresholds of a source are one small row, so
that the mix is one filter and documents are never sorted. DataFrame functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

#: Hash bits that one histogram resolves, and histograms nested.
LEVEL_BITS = 12
LEVELS = 4
BITS = LEVEL_BITS * LEVELS
#: A document is repeated at most this often.
MOST = 3
#: Rows per source are broadcast up to so many sources and joined by a shuffle beyond.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    Weights 1, 2, 3 repeat over the sources by code point, null last. Targets
    share the sum of all sizes by weight and stop at ``most`` times the
    source's size; the excess is shared again by weight until none is above.
    That is least(most * size, level * weight), where the level follows from
    running sums over the sources by size / weight.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sums.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def after(column: str, times: int) -> Column:
        return F.sum(column).over(every) - F.coalesce(F.sum(column).over(before), F.lit(0)) * times

    # level: each source's share per weight if all with a smaller ratio are at their caps.
    steps = weighed.select(
        "*",
        F.row_number().over(by_ratio).alias("step"),
        (after("source_size", most) / after("weight", 1)).alias("level"),
    )
    cap = F.col("source_size") * F.lit(float(most))
    first = F.min(F.when(F.col("level") * F.col("weight") <= cap, F.struct("step", "level"))).over(every)
    return steps.select(
        "source", "source_size", F.least(cap, first["level"] * F.col("weight")).alias("target")
    )


def _beside(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Rows with their source's row: a broadcast where the sources are few."""
    return rows.join(F.broadcast(per_source) if few else per_source, "source_id")


def _threshold(rows: DataFrame, rooms: DataFrame, by: list[str], few: bool) -> DataFrame:
    """Per group with rows: the hash ``cut`` below which rows fit into its room, and what is ``left`` of it.

    rows: the columns of ``by``, weight, h. rooms: ``by``, room. Each level
    sums up the rows of one bucket a group.
    """
    small = F.broadcast if few else lambda x: x
    inside, found = rows.join(small(rooms), by), None
    for level in range(LEVELS):
        shift = BITS - LEVEL_BITS * (level + 1)
        if found is None:
            here = inside.withColumn("spent", F.lit(0).cast("long"))
        else:
            here = inside.join(small(found.select(*by, "spent", "cut")), by)
            here = here.where(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("cut", shift + LEVEL_BITS))
        buckets = here.groupBy(*by, "room", "spent", F.shiftright("h", shift).alias("b")).agg(F.sum("weight").alias("held"))
        run = F.col("spent") + F.sum("held").over(Window.partitionBy(*by).orderBy("b"))
        fits = F.col("run") <= F.col("room")
        # The bucket in which the room runs out stays open; where all fit, so does the last one, until the last level.
        bucket, before = F.min(F.when(~fits, F.col("b"))), F.max(F.when(fits, F.col("run")))
        if level < LEVELS - 1:
            bucket = F.coalesce(bucket, F.max("b"))
            before = F.when(F.max("run") <= F.col("room"), F.max(F.col("run") - F.col("held"))).otherwise(before)
        else:
            bucket = F.coalesce(bucket, F.max("b") + 1)
        found = (
            buckets.withColumn("run", run)
            .groupBy(*by, "room", "spent")
            .agg(bucket.alias("b"), before.alias("before"))
            .select(*by, "room", F.coalesce("before", "spent").alias("spent"), F.shiftleft("b", shift).alias("cut"))
        )
    return found.select(*by, "cut", (F.col("room") - F.col("spent")).alias("left"))


def _fill(sizes: Column, left: Column) -> Column:
    """Of (size, held), largest first: array of (size, held, wanted), as many of each as fit into what is left."""
    begun = F.struct(left.alias("left"), F.array().cast("array<struct<size:bigint,held:bigint,wanted:bigint>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        wanted = F.least(x["held"], F.floor(acc["left"] / x["size"]))
        more = F.array(F.struct(x["size"].alias("size"), x["held"].alias("held"), wanted.alias("wanted")))
        return F.struct(
            (acc["left"] - wanted * x["size"]).alias("left"),
            F.when(wanted > 0, F.concat(acc["found"], more)).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(sizes, begun, step, lambda acc: acc["found"])


def _ranked(rows: DataFrame, key: str, rank: str) -> DataFrame:
    """Adds the number (from 0) of a row among those of equal key, which are interchangeable.

    Counted by task first, so that no key's rows need to meet in one place.
    ``rows`` must be a written table.
    """
    part, before = fresh(rows, "_part"), fresh(rows, "_before")
    dealt = rows.withColumn(part, F.spark_partition_id())
    held = dealt.groupBy(key, part).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(key, part, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(1)))
    numbered = dealt.withColumn(rank, inside - 1)
    return numbered.join(starts, [key, part]).withColumn(rank, F.col(rank) + F.col(before)).drop(part, before)


def mix_plan(docs: DataFrame, most: int = MOST) -> DataFrame:
    """Every document with how often the mix takes it.

    Columns: doc_id, source, size (words; null text: 0), key (a hash of id,
    text and source), rank (from 0, of rows equal in these), source_size,
    target, copies (0 to ``most``) and taken (size * copies). A source's taken
    words stay below its target by less than its smallest document not taken
    that often (short of a clash of 48-bit hashes at a threshold). Which of several equal rows has which rank is open, what a
    rank gets is not; null ids and sources are values like others. An empty
    table gives no rows. Reruns agree: nothing but the rows decides.
    """
    sized = materialise(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.col("doc_id"), F.col("text"), F.col("source")).alias("key"),
        ),
        "sizes",
    )
    repeated = materialise(sized.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    none = repeated.isEmpty()
    ranked = sized.withColumn("rank", F.lit(0).cast("long"))
    if not none:
        again = materialise(sized.join(repeated, "key", "left_semi"), "again")
        ranked = ranked.join(repeated, "key", "left_anti").unionByName(_ranked(again, "key", "rank"))
    # Equal rows differ by their rank.
    ranked = ranked.withColumn("h", F.shiftrightunsigned(F.xxhash64("key", "rank"), 64 - BITS))
    targets = source_targets(sized, most)
    share = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    numbered = materialise(
        targets.select(
            "*",
            F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).alias("source_id"),
            F.floor(share).alias("base"),
        ).withColumn("room", F.col("target") - F.col("base") * F.col("source_size")),
        "targets",
    )
    few = numbered.count() <= BROADCAST_SOURCES
    side = F.broadcast(numbered) if few else numbered
    rows = ranked.alias("d").join(side.alias("s"), F.expr("d.source <=> s.source")).select(
        "d.*", "s.source_id", "s.source_size", "s.target", "s.base"
    )
    rows = materialise(rows, "rows")
    # First by hash alone: documents that fit into the room.
    rooms = numbered.select("source_id", "room")
    fitting = _beside(rows, rooms, few).where((F.col("size") > 0) & (F.col("size") <= F.col("room")))
    first = _threshold(fitting.select("source_id", F.col("size").alias("weight"), "h"), rooms, ["source_id"], few)
    first = materialise(rooms.join(first, "source_id", "left"), "cuts")
    taken = (F.col("size") <= F.col("room")) & (F.col("h") < F.coalesce("cut", F.lit(0)))
    # Then what is left, less than a document, by size.
    open_ = _beside(rows, first.where("left >= 1"), few).where((F.col("size") > 0) & (F.col("size") <= F.col("left")) & ~taken)
    held = open_.groupBy("source_id", "left", "size").agg(F.count("*").alias("held"))
    sizes = F.sort_array(F.collect_list(F.struct("size", "held")), asc=False)
    filled = held.groupBy("source_id", "left").agg(sizes.alias("sizes")).select(
        "source_id", F.explode(_fill(F.col("sizes"), F.col("left"))).alias("x")
    )
    classes = materialise(filled.select("source_id", "x.*"), "sizes-filled")
    parts = classes.where("wanted < held").select("source_id", "size", F.col("wanted").alias("room"))
    few_sizes = few and classes.count() <= BROADCAST_SOURCES
    open_ = open_.select("source_id", "size", F.lit(1).cast("long").alias("weight"), "h")
    second = _threshold(open_, parts, ["source_id", "size"], few_sizes)
    every = classes.where("wanted = held").select("source_id", "size", F.lit(1 << BITS).alias("cut"))
    cuts = second.select("source_id", "size", "cut").unionByName(every).groupBy("source_id")
    cuts = cuts.agg(F.collect_list(F.struct("size", "cut")).alias("sizes"))
    state = materialise(first.join(cuts, "source_id", "left").select("source_id", "room", "cut", "sizes"), "state")
    rows = _beside(rows, state, few)
    filled = F.coalesce(F.exists("sizes", lambda x: (F.col("size") == x["size"]) & (F.col("h") < x["cut"])), F.lit(False))
    more = (taken | filled).cast("int")
    copies = F.least(F.col("base") + more, F.lit(most)).cast("long")
    return rows.select("doc_id", "source", "size", "key", "rank", "source_size", "target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def mix(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it.

    All columns are kept. Rows meet their number of copies by the hash of
    their id, text and source; of rows equal in these, any gets any of theirs.
    """
    key, rank, copies, copy = (fresh(docs, c) for c in ("_mix_key", "_mix_rank", "_mix_copies", "_mix_copy"))
    plan = materialise(mix_plan(docs, most).select(F.col("key").alias(key), F.col("rank").alias(rank), F.col("copies").alias(copies)), "plan")
    rows = docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"), F.col("source")))
    repeated = plan.where(F.col(rank) > 0).select(key).distinct()
    keep = plan.where(F.col(copies) > 0)
    if repeated.isEmpty():
        out = rows.join(keep.drop(rank), key)
    else:
        again = _ranked(materialise(rows.join(repeated, key, "left_semi"), "again"), key, rank)
        once = rows.join(repeated, key, "left_anti").withColumn(rank, F.lit(0).cast("long"))
        out = once.unionByName(again).join(keep, [key, rank])
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
