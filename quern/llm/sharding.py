"""Sharding by balanced label propagation, with DataFrame operations alone.

Documents with equal texts form a group; its links are the edges to keep inside shards. Law `rows`: the shards' numbers
of rows differ by one at most.

1. Linked documents (of groups of two or more) start group by group along the shards, so a shard's end cuts one group at
   most. Groups as large as a shard come first and fill whole shards; the others are laid evenly over the shards left.
2. Round by round, the rows of a cut group look for the shards, as many as its size needs, that have room for all of it or
   else hold most of it; rows that don't sit there move, as many as the shards' quotas take, those of the largest gain
   first. Room counts the documents without links as movable, so a shard's quota for linked ones is its whole size.
   Rounds go on until one keeps no more pairs of equal documents together. Without any room, as when every document has
   a copy, the groups that the start cut, at most one a shard, stay cut.
3. Documents without links fill the shards to their exact sizes.

A group is counted by shard, never listed; movers are admitted by counts of gain classes and hash buckets, and all ranks
come from prefix sums over hash buckets, so no task holds a group or a shard. Texts are read once, for sizes and hashes.

Defined results: a null text has size 8 and checksum 0, and all null texts are a group, apart from empty ones. Null and
repeated doc_ids are rows like any other. Other laws aren't offered, so grown_shard is null.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import materialize, ranked, settled

SHARDS = 24
#: Rows of a hash bucket, or of a part of a group, that one task numbers.
BUCKET = 50_000
#: Hash buckets of a gain class, in the admission of movers.
FINE = 64


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and twin, the text's identity: hash, checksum, length and whether it is null."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.struct(F.xxhash64(text).alias("hash"), F.crc32(text.cast("binary")).cast("long").alias("checksum"), F.octet_length(text).alias("bytes"), F.col("text").isNull().alias("none")).alias("twin"),
    )


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _literal(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def _loads(placed: DataFrame, shards: int) -> list[int]:
    """Linked rows of each shard: one number a shard reaches the driver."""
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return [counts.get(s, 0) for s in range(shards)]


def _pairs(placed: DataFrame):
    """Pairs of equal documents in the same shard, each counted twice, and rows with themselves."""
    n = F.col("n").cast("decimal(19,0)")
    return placed.groupBy("twin", "shard").agg(F.count("*").alias("n")).agg(F.sum(n * n)).collect()[0][0] or 0


def _start(linked: DataFrame, quota: list[int], shards: int) -> DataFrame:
    """row (a number of its own) and shard of each linked document, group by group; parts of a group of at most about
    BUCKET rows, and hash buckets of groups, are numbered by themselves."""
    least = max(1, quota[-1])
    sizes = linked.groupBy("twin").agg(F.count("*").alias("n"))
    count, hot = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0))).collect()[0]
    buckets = max(1, -(-count // BUCKET))
    linked = linked.withColumn("part", F.pmod("spread", F.ceil(F.col("members") / BUCKET)).cast("int"))
    bucket = F.when(F.col("members") >= least, F.lit(-1)).otherwise(F.pmod(F.xxhash64("twin"), F.lit(buckets)).cast("int"))
    parts = linked.groupBy("twin", "members", "part").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    sums = parts.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("twin", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(sums), "bucket").select("twin", "part", (F.col("base") + F.col("inside")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("twin", "part").orderBy("spread", "doc_id")) - 1
    linked = linked.withColumn("rank", rank).join(parts, ["twin", "part"]).withColumn("row", F.col("start") + F.col("rank"))
    full, filled = 0, 0
    while full < shards and filled + quota[full] <= hot:
        filled += quota[full]
        full += 1
    bounds = list(itertools.accumulate(quota[:full] + (_quota(count - filled, shards - full) if full < shards else [])))
    return linked.withColumn("shard", F.size(F.filter(_literal(bounds), lambda b: b <= F.col("row")))).drop("part", "rank", "start")


def _round(placed: DataFrame, quota: list[int], shards: int) -> tuple[DataFrame, bool]:
    """One round of moves; placed has row columns, twin, members (of the group), spread (a hash) and shard."""
    least = max(1, quota[-1])
    room = [q - n for q, n in zip(quota, _loads(placed, shards), strict=True)]
    there = placed.groupBy("twin", "members", "shard").agg(F.count("*").alias("n")).where("n < members")
    there = there.withColumn("room", F.element_at(_literal(room), F.col("shard") + 1)).withColumn("fits", F.col("room") >= F.col("members") - F.col("n"))
    # a group's goals: as many shards as it needs, those with room for all of it first, then those of most of its members
    goals_first = Window.partitionBy("twin").orderBy(F.desc("fits"), F.desc(F.when(F.col("members") <= least, F.col("room") > 0)), F.desc("n"), "shard")
    there = there.withColumn("goals", F.ceil(F.col("members") / least).cast("int")).withColumn("place", F.row_number().over(goals_first))
    open_ = there.where("place <= goals and room > 0").groupBy("twin").agg(F.sort_array(F.collect_list("shard")).alias("open"), F.max("n").alias("goal_n"), F.max("fits").alias("whole"))
    here = there.where("place > goals").join(open_, "twin").where("whole or goal_n >= n or goals > 1")
    movers = here.select("twin", "members", "shard", "open", (F.col("goal_n") - F.col("n")).alias("gain"))
    salts = F.ceil(F.col("members") / BUCKET).cast("int")  # as many as a group's size needs
    movers = movers.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("members")
    wanted = placed.withColumn("salt", F.pmod("spread", salts).cast("int")).join(movers, ["twin", "shard", "salt"])
    wanted = wanted.withColumn("goal", F.element_at("open", F.pmod(F.shiftright("spread", 20), F.size("open")).cast("int") + 1)).drop("open")
    classes = F.when(F.col("gain") > 0, F.floor(F.log2(F.col("gain").cast("double"))) + 1).otherwise(F.lit(0)).cast("int")
    wanted = materialize(wanted.withColumn("place", (F.lit(64) - classes) * FINE + F.pmod(F.shiftright("spread", 8), F.lit(FINE)).cast("int")).drop("salt", "gain"))
    if wanted.isEmpty():
        return placed, False
    sums = wanted.groupBy("goal", "place").agg(F.count("*").alias("n"))
    before = Window.partitionBy("goal").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("goal", "place", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n").withColumn("room", F.element_at(_literal(room), F.col("goal") + 1))
    # whole places are admitted by count; in the one where the quota ends, rows are ranked by hash
    sure = sums.where("start + n <= room").select("goal", "place")
    edge = sums.where("start < room and start + n > room").select("goal", "place", (F.col("room") - F.col("start")).alias("left"))
    rank = F.row_number().over(Window.partitionBy("goal", "place").orderBy("spread", "doc_id"))
    some = wanted.join(F.broadcast(edge), ["goal", "place"]).withColumn("rank", rank).where(F.col("rank") <= F.col("left")).drop("left", "rank")  # an edge a shard at most
    moves = wanted.join(sure, ["goal", "place"]).unionByName(some).select("row", F.col("goal").alias("_goal"))
    moved = placed.join(moves, "row", "left").withColumn("shard", F.coalesce("_goal", "shard").cast("int")).drop("_goal")
    return materialize(moved), True


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text)."""
    return settled(lambda: _shard(docs, shards), docs.sparkSession)


def _shard(docs: DataFrame, shards: int) -> DataFrame:
    base = materialize(described(docs))
    total = base.count()
    quota = _quota(total, shards)
    buckets = max(1, -(-total // BUCKET))
    groups = base.groupBy("twin").agg(F.count("*").alias("members")).where("members > 1")
    base = base.join(groups.withColumn("linked", F.lit(True)), "twin", "left").withColumn("spread", F.xxhash64(F.lit(7), "doc_id", "twin"))
    # numbers of their own for all rows, linked ones before others
    base = ranked(base.withColumn("linked", F.coalesce("linked", F.lit(False))), ["linked"], ["spread", "doc_id", "size"], "number", buckets, "spread")
    base = materialize(base)
    linked = _start(base.where("linked").drop("number"), quota, shards)
    placed = materialize(linked.select("row", "doc_id", "size", "text_crc32", "twin", "members", "spread", "shard"))
    kept, went_on = _pairs(placed), True
    while went_on:
        moved, went_on = _round(placed, quota, shards)
        went_on = went_on and (pairs := _pairs(moved)) > kept
        if went_on:
            placed, kept = moved, pairs
    loads = _loads(placed, shards)
    bounds, at = [], 0
    for q, n in zip(quota, loads, strict=True):
        at += q - n
        bounds.append(at)
    linked = placed.select("doc_id", "size", "text_crc32", "spread", "shard")
    free = base.where("not linked").select("doc_id", "size", "text_crc32", "spread", F.size(F.filter(_literal(bounds), lambda b: b <= F.col("number"))).alias("shard"))
    whole = ranked(linked.unionByName(free), ["shard"], ["spread", "doc_id", "size"], "slot", buckets, "spread")
    return whole.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
