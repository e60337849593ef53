"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: sources share the corpus size by weight; a target stops at `most` times its source's size and the excess goes
   to the others by weight, until none is above.
2. Blocks: each source's documents are shuffled by hash and laid end to end; the stream of words is cut into blocks of
   equally many words (one more or less), at most `block` words and so that the mix has at least about `SLOTS` slots.
3. Schedule: the mix has as many slots as the targets need blocks. Slot i takes the point i * golden ratio (mod 1) through
   the cumulative weights to a source, so every stretch of the schedule keeps the weights closely, and so does the whole:
   a source gets its share of slots, give or take two or three. Nothing evens this out afterwards.
4. The slots of a source are ranked. Rank r takes block r mod blocks, so passes repeat the stream; a slot beyond `most`
   passes takes nothing. Slots and blocks are joined: what the slots of its blocks take of a document is its part of the
   mix, and the slot of its first block is its place there.

A document that lies in several blocks is kept together at the slot of the first one.

All is by whole numbers: points are multiples of 2**-31, widths of weights of 2**-32, so any engine gets the same slots. A
source whose share of the slots is below 2**-32 counts as if it had that share. Sources may be many: they are numbered by
range partitions, targets are found by rounds of one aggregate each, and points meet their source by a join over buckets
of points. Ranks and stream positions come from prefix sums over buckets, so no task holds a source. The driver gets a
few totals.

Defined results: a null text has size 0 and is taken 0 times. A null source is a source of its own, last in order. Rows
that repeat or lack a doc_id are separate documents of their own. Without words every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD, bounded, columns, dealt_join, materialize, settled

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block at most, and slots that a mix of fewer words than SLOTS blocks of that size has, about.
BLOCK, SLOTS = 4096, 2**17
#: Rows of a bucket whose documents are laid end to end by one task; slots of a stretch that one task ranks.
BUCKET, STRETCH = 20_000, 2**16
#: Points are multiples of 2**-31; slot i has the point i * GOLDEN mod 2**31, GOLDEN being the golden ratio's fraction of 2**31.
POINTS, GOLDEN = 2**31, 1327217885
#: The width of all weights, about, and that of a bucket of points; shares of slots are multiples of 1 / PARTS.
WIDTH, STRIP, PARTS = 2**32, 2**20, 2**20


def _word_counts(docs: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, source, size in words and order, the hash that shuffles it, of every row, and the extra columns."""
    return docs.select(
        *extra, "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary")).alias("order"),
    )


def _number(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with k, their place in code point order, null last; a partition is numbered by itself."""
    order = F.col("source").asc_nulls_last()
    parts = materialize(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    return _offsets(parts.withColumn("one", F.lit(1).cast("long")), [order], "one").withColumnRenamed("start", "k").drop("part", "one")


def _offsets(rows: DataFrame, order: list[Column], width: str, name: str = "start") -> DataFrame:
    """rows (part and others) with the sum of the widths of all rows before, by part and order."""
    sums = rows.groupBy("part").agg(F.sum(width).alias("n"))  # a row a partition
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.sum(width).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(base), "part").withColumn(name, (F.col("base") + F.col("inside")).cast("long")).drop("base", "inside")


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (k, source, size) with target: shares of the total size by weight, none above most times its source's size.

    Rounds of one aggregate raise the level, target over weight, of the sources that aren't full, until no more are."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    most_of = F.lit(float(most)) * F.col("source_size")
    level, full = 0.0, -1
    while True:
        capped = F.lit(level) * F.col("weight") > most_of
        total, spent, open_, n = sources.agg(F.sum("source_size"), F.sum(F.when(capped, most_of)), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).collect()[0]
        if n == full or not open_:
            break
        level, full = ((total or 0) - (spent or 0.0)) / open_, n
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), most_of))


def planned(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> tuple[DataFrame, int, int]:
    """The sources: k, source, source_size, target, blocks, lo and hi (its points, as widths); the slots; the whole width."""
    sources = materialize(_number(sized.groupBy("source").agg(F.sum("size").alias("source_size"))))
    sources = materialize(with_targets(sources, weights, most))
    total = sources.agg(F.sum("source_size")).collect()[0][0] or 0
    block = max(1, min(block, total // SLOTS))
    size = F.col("source_size")
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.floor((size + (block - 1)) / block)).cast("long"))
    # whole numbers sum alike in any order
    wanted = F.when(size > 0, F.floor(F.col("target") * F.col("blocks") / size * PARTS + 0.5)).otherwise(0).cast("long")
    sources = sources.withColumn("wanted", wanted)
    all_wanted = sources.agg(F.sum("wanted")).collect()[0][0] or 0
    width = F.when(F.col("wanted") > 0, F.greatest(F.lit(1), F.floor(F.col("wanted") / F.lit(all_wanted or 1) * WIDTH + 0.5))).otherwise(0).cast("long")
    parts = sources.withColumn("width", width).withColumn("part", F.floor(F.col("k") / STRETCH))
    laid = _offsets(parts, [F.col("k")], "width", "lo")
    out = materialize(laid.select("k", "source", "source_size", "target", "blocks", "lo", (F.col("lo") + F.col("width")).alias("hi")))
    return out, (all_wanted + PARTS // 2) // PARTS, out.agg(F.max("hi")).collect()[0][0] or 0


def schedule(sources: DataFrame, slots: int, width: int, most: float = MOST) -> DataFrame:
    """slot, k, rank, block: the mix, slot by slot."""
    point = F.pmod(F.pmod(F.col("id"), F.lit(POINTS)) * GOLDEN, F.lit(POINTS))
    at = F.shiftright(point * F.lit(width // 2), 30)  # half the width, as the product must fit 63 bits
    drawn = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), at.alias("at")).withColumn("strip", F.floor(F.col("at") / STRIP))
    spread = sources.where("hi > lo").select("k", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / STRIP), F.floor((F.col("hi") - 1) / STRIP))).alias("strip"))
    drawn = drawn.join(bounded(materialize(spread)), "strip").where("lo <= at and at < hi").select("slot", "k", "blocks", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    # ranks within a source: counts of the stretches before, then the place inside a stretch
    before = Window.partitionBy("k").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy("k", "stretch").agg(F.count("*").alias("n")).select("k", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("k", "stretch").orderBy("slot")) - 1
    ranks = drawn.withColumn("inside", inside).join(counts, ["k", "stretch"]).withColumn("rank", F.col("start") + F.col("inside"))
    return ranks.where(F.col("rank") < F.col("blocks") * F.lit(most)).select("slot", "k", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def streams(sized: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """sized with the columns of its source and start, where each document begins in its source's shuffled stream of words.

    Documents go to buckets by their hash; those of a hash that more than BUCKET rows share (copies without an id of their
    own) come first, dealt over parts, so that no bucket outgrows a task."""
    few = bounded(sources.select("k", F.col("source").alias("_source"), "source_size", "target", "blocks"))
    rows = sized.join(few, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    buckets = max(1, -(-n_rows // BUCKET))
    many = materialize(sized.groupBy("order").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts")).where("parts > 1"))
    rows = rows.join(bounded(many), "order", "left")
    crowded = F.col("parts").isNotNull()
    bucket = F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")
    rows = rows.withColumn("bucket", F.when(crowded, -1).otherwise(bucket)).withColumn("crowd", F.when(crowded, F.col("order")).otherwise(""))
    rows = rows.withColumn("sub", F.when(crowded, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0).cast("int"))
    place = ["bucket", "crowd", "sub"]
    sums = rows.groupBy("k", *place).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("k").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("k", *place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("k", *place).orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["k", *place])
    return laid.select("row", "doc_id", "k", "size", "source_size", "target", "blocks", (F.col("base") + F.col("inside")).alias("start"))


def _passes(sized: DataFrame, weights: tuple[float, ...], most: float, block: int) -> tuple[DataFrame, DataFrame, int]:
    """The rows of sized (row, doc_id, source, size, order) in their streams; row, pass, slot, words: how many words of a
    row the mix takes in each pass over its source, and at which slot; and the number of slots."""
    sources, slots, width = planned(sized, weights, most, block)
    laid = materialize(streams(sized, sources, sized.count()))
    short, longer = F.floor(F.col("source_size") / F.col("blocks")), F.col("source_size") % F.col("blocks")  # so many blocks have a word more
    edge = lambda b: b * F.col("short") + F.least(b, F.col("longer"))
    bound = F.col("longer") * (F.col("short") + 1)
    block_of = lambda w: F.when(w < bound, F.floor(w / (F.col("short") + 1))).otherwise(F.col("longer") + F.floor((w - bound) / F.col("short")))
    end = F.col("start") + F.col("size")
    held = laid.where("size > 0").withColumn("short", short).withColumn("longer", longer)
    pieces = held.select("row", "k", "blocks", "start", "size", "short", "longer", F.explode(F.sequence(block_of(F.col("start")), block_of(end - 1))).alias("block"))
    words = F.least(end, edge(F.col("block") + 1)) - F.greatest(F.col("start"), edge(F.col("block")))
    pieces = pieces.select("row", "k", "blocks", "block", words.alias("words"))
    uses = pieces.join(schedule(sources, slots, width, most), ["k", "block"]).withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    return laid, uses.groupBy("row", "pass").agg(F.min("slot").alias("slot"), F.sum("words").alias("words")), slots


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words of the document in the mix, repeats counted), first_slot (where it
    first stands in the mix, null if nowhere), and k, its source, for every row of docs (doc_id, text, source)."""

    def make() -> DataFrame:
        sized = materialize(_word_counts(docs).withColumn("row", F.monotonically_increasing_id()))
        laid, passes, _ = _passes(sized, weights, most, block)
        taken = passes.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
        return laid.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "k")

    return settled(make, docs.sparkSession)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """The mix as documents, in the mix's order: a row of docs for each pass over it, at the slot of its first block; a
    pass that takes part of it is cut to these words, joined by one space. Partitions, and rows within one, follow the
    slots. All columns stay; n_chars, if there, follows the text."""
    spark = docs.sparkSession
    same = F.col("doc_id").eqNullSafe(F.col("__quern_id")) & F.col("source").eqNullSafe(F.col("__quern_source")) & (F.xxhash64("text") == F.col("__quern_print"))
    named = [F.col("doc_id").alias("__quern_id"), F.col("source").alias("__quern_source"), F.col("print").alias("__quern_print")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = materialize(_word_counts(docs, F.xxhash64("text").alias("print")).withColumn("row", F.monotonically_increasing_id()))
    # rows are found again by id, source and text; those that repeat all three are written with numbers of their own, below 0
    again = materialize(sized.groupBy("doc_id", "source", "print").agg(F.count("*").alias("n")).where("n > 1").select(*named))
    copies = None
    if not again.isEmpty():
        copies = materialize(docs.join(bounded(again), same, "left_semi").withColumn("__quern_row", F.lit(-1) - F.monotonically_increasing_id()))
        repeated = sized["doc_id"].eqNullSafe(F.col("__quern_id")) & sized["source"].eqNullSafe(F.col("__quern_source")) & (sized["print"] == F.col("__quern_print"))
        numbered = _word_counts(copies, F.xxhash64("text").alias("print"), F.col("__quern_row").alias("row"))
        sized = materialize(sized.join(bounded(again), repeated, "left_anti").unionByName(numbered))

    def make() -> DataFrame:
        _, passes, slots = _passes(sized, weights, most, block)
        part = F.floor(F.col("slot") * parts / max(1, slots)).cast("int")
        found = dealt_join(passes, sized.select("row", "doc_id", "source", "print", "size"), "row")
        return found.select(F.col("row").alias("__quern_row"), *named, F.col("slot").alias("__quern_slot"), F.col("words").alias("__quern_words"), (F.col("words") < F.col("size")).alias("__quern_cut"), part.alias("__quern_part"))

    doses = settled(make, spark)
    placed = docs.join(bounded(doses.where("__quern_row >= 0")), same)
    if copies is not None:
        placed = placed.unionByName(copies.join(doses.where("__quern_row < 0"), "__quern_row").select(*placed.columns))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__quern_words").cast("int")), " ")
    out = placed.withColumn("text", F.when(F.col("__quern_cut"), some).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__quern_cut"), F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.repartitionById(parts, "__quern_part").sortWithinPartitions("__quern_slot", "__quern_row").select(*columns(docs))
