"""Exact top-k inner products by a three-phase uniform threshold.

The components of a vector are dealt to `LISTS` lists; a vector's score for a query is the sum of its partial scores. A list
knows its own components only: queries and candidates are dealt over a grid of query blocks, candidate chunks and lists,
in one job a phase, and a cell of the grid computes the partial scores of one list.

1. Each cell gathers the `k` best partial scores of its list for each query; of all cells' the `k` best of each list are
   kept and their scores completed. The k-th best of these is a score that k vectors reach: the safe cutoff.
2. The cutoffs go out with the query blocks. A vector that reaches a cutoff has a partial score of at least cutoff /
   LISTS in some list, so every cell collects the entries that do. Where all of a vector's partial scores came in, their sum
   is its score; such scores raise the cutoff. An entry whose known scores and the bound on unknown ones (less than
   cutoff / LISTS each, or they had come in) stay below the raised cutoff is dropped.
3. The entries left go to the cells that know their missing partial scores, and only these are computed.

Query blocks hold about `QUERIES` rows and chunks about `CHUNK`, whatever the size of the tables.

Defined results: a vector takes no part if its id or itself is null or it holds a null or non-finite component. Shorter
vectors count as if padded by zeros, an empty one scores 0. Rows that repeat a vec_id count once, by the greatest score
(as a query, by the least vector). Scores beyond 64 bits are held at their limits; where they might get there, bounds
don't hold and the entry is looked up as a whole, as are those that phase 1 gathers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_column, bounded, materialize, runs, settled, tidied

LISTS = 2
QUERIES, CHUNK = 4096, 8192
#: Scores that a task holds at once.
HELD = 4 << 20
_LONG = 2**63


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~bad


def scaled(vectors: DataFrame, factor: int = 1024) -> DataFrame:
    """vec_id, v: components as floor(factor * x), of the vectors that take part."""
    take = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return take.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    sizes = np.diff(at)
    wide = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    for i, (a, n) in enumerate(zip(at[:-1], np.minimum(sizes, wide), strict=True)):
        out[i, :n] = flat[a : a + n]
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x and of y, as 64-bit integers: in doubles where these are exact, else in Python's."""
    n = min(x.shape[1], y.shape[1])
    x, y = x[:, :n], y[:, :n]
    top = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (x, y)]
    if top[0] * top[1] * max(n, 1) < 2**53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    exact = x.astype(object) @ y.astype(object).T if n else np.zeros((len(x), len(y)), object)
    return np.clip(exact, -_LONG, _LONG - 1).astype(np.int64)


def _large(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x whether its products with rows of y, of LISTS such lists, might leave 64 bits."""
    peak = np.maximum(x.max(axis=1, initial=0).astype(np.float64), -x.min(axis=1, initial=0).astype(np.float64))
    other = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    return peak * float(other) * (LISTS * max(x.shape[1], y.shape[1], 1)) >= 2.0**62


def _packed_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, queries: the queries (vec_id, v, cutoff or null) of each block, packed."""
    for group in runs(batches, ["block"]):
        data, cutoff = io.BytesIO(), group.column("cutoff").combine_chunks()
        np.savez(data, ids=np.asarray(group.column("vec_id")), q=_matrix(group.column("v").combine_chunks()), cutoff=np.asarray(cutoff.fill_null(0)), known=~np.asarray(cutoff.is_null()))
        yield pa.RecordBatch.from_arrays([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([data.getvalue()], pa.binary())], ["block", "queries"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For blocks of a cell's candidates: list, row, vec_id, partial scores (candidates x queries), whether the candidate is
    another vector and whether partial scores are safe from overflow, and the cell's queries (ids, cutoff, known)."""
    for group in runs(batches, ["block", "chunk", "list"]):
        data = [x for x in group.column("queries").to_pylist() if x is not None]
        rows = group.filter(pc.is_valid(group.column("row")))
        if not data or not rows.num_rows:
            continue
        asked, which = np.load(io.BytesIO(data[0])), group.column("list")[0].as_py()
        ids, q = asked["ids"], asked["q"][:, which::LISTS]
        step = max(1, HELD // max(1, len(ids)))
        for i in range(0, rows.num_rows, step):
            part = rows.slice(i, step)
            vec, x = np.asarray(part.column("vec_id")), _matrix(part.column("part").combine_chunks())
            yield which, np.asarray(part.column("row")), vec, products(x, q), vec[:, None] != ids[None, :], ~_large(x, q), (ids, asked["cutoff"], asked["known"])


_ENTRY = "query_id long, row long, vec_id long, list int, score long"


def _entries(query: np.ndarray, row: np.ndarray, vec: np.ndarray, which: int, score: np.ndarray | None) -> pa.RecordBatch:
    scores = pa.nulls(len(row), pa.int64()) if score is None else pa.array(score, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(row, pa.int64()), pa.array(vec, pa.int64()), pa.array(np.full(len(row), which, np.int32)), scores], ["query_id", "row", "vec_id", "list", "score"])


def _gather(k: int):
    def phase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for which, row, vec, partial, other, safe, (ids, _, _) in _cells(batches):
            use = other & safe[:, None]
            if len(row) > k:
                top = np.argpartition(np.where(use, -partial, _LONG - 1), k - 1, axis=0)[:k]
            else:
                top = np.arange(len(row))[:, None].repeat(len(ids), 1)
            query = np.arange(len(ids))[None, :].repeat(len(top), 0)
            keep = use[top, query]
            top, query = top[keep], query[keep]
            yield _entries(ids[query], row[top], vec[top], which, partial[top, query])

    return phase


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for which, row, vec, partial, other, safe, (ids, cutoff, known) in _cells(batches):
        uniform = -((-cutoff) // LISTS)  # the least whole number that is enough for the mean
        at, query = np.nonzero(other & safe[:, None] & ((partial >= uniform[None, :]) | ~known[None, :]))
        yield _entries(ids[query], row[at], vec[at], which, partial[at, query])
        at, query = np.nonzero(other & ~safe[:, None])
        if len(at):
            yield _entries(ids[query], row[at], vec[at], which, None)


def _row_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of x and y at the same place, held at 64 bits."""
    top = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (x, y)]
    bound = top[0] * top[1] * max(x.shape[1], 1)
    if bound < 2**53:
        return np.einsum("ij,ij->i", x.astype(np.float64), y.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return np.einsum("ij,ij->i", x, y)
    return np.array([max(-_LONG, min(_LONG - 1, sum(a * b for a, b in zip(r, s, strict=True)))) for r, s in zip(x.tolist(), y.tolist(), strict=True)], np.int64)


def _whole(v: pa.Array, q: pa.Array) -> pa.Array:
    """The scores of vectors and queries at the same place."""
    x, y = _matrix(v), _matrix(q)
    wide = min(x.shape[1], y.shape[1])
    return pa.array(_row_products(x[:, :wide], y[:, :wide]))


def _complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of entries (query_id, row, vec_id, known) in the cell of the one list that they lack."""
    for group in runs(batches, ["block", "chunk", "list"]):
        data = [x for x in group.column("queries").to_pylist() if x is not None]
        entry = pc.is_valid(group.column("query_id"))
        entries, rows = group.filter(entry), group.filter(pc.and_(pc.is_valid(group.column("part")), pc.invert(entry)))
        if not entries.num_rows:
            continue
        asked, which = np.load(io.BytesIO(data[0])), group.column("list")[0].as_py()
        q, x, row = asked["q"][:, which::LISTS], _matrix(rows.column("part").combine_chunks()), np.asarray(rows.column("row"))
        wide = min(x.shape[1], q.shape[1])
        order = np.argsort(row, kind="stable")
        for i in range(0, entries.num_rows, 1 << 16):
            some = entries.slice(i, 1 << 16)
            at = order[np.searchsorted(row[order], np.asarray(some.column("row")))]
            of = np.searchsorted(asked["ids"], np.asarray(some.column("query_id")))
            score = np.asarray(some.column("known")) + _row_products(x[at, :wide], q[of, :wide])
            yield pa.RecordBatch.from_arrays([some.column("query_id").combine_chunks(), some.column("vec_id").combine_chunks(), pa.array(score)], ["query_id", "vec_id", "score"])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates (vec_id, v) of each query (vec_id, v; distinct ids),
    itself left out, ties to the smaller vec_id."""
    return settled(lambda: _top_k(candidates, queries, k), candidates.sparkSession)


def _top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = materialize(candidates.withColumn("row", F.monotonically_increasing_id()))
    queries = materialize(queries)
    blocks, chunks = (max(1, -(-df.count() // most)) for df, most in ((queries, QUERIES), (candidates, CHUNK)))
    lists = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda l: F.struct(l.alias("list"), F.filter("v", lambda x, i: i % LISTS == l).alias("part")))  # noqa: E741
    block, chunk = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("query_id", blocks), ("row", chunks)))
    halves = materialize(candidates.select("row", "vec_id", chunk.alias("chunk"), F.inline(lists)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["block", "chunk", "list"]

    def grid(asked: DataFrame, entries: DataFrame | None = None) -> DataFrame:
        """The cells' rows: queries asked (vec_id, v, cutoff) packed by block, all candidates' lists, and entries."""
        dealt = asked.withColumnRenamed("vec_id", "query_id").withColumn("block", block).withColumnRenamed("query_id", "vec_id")
        packed = materialize(dealt.repartition(parts, "block").sortWithinPartitions("block", "vec_id").mapInArrow(tidied(_packed_block), "block int, queries binary"))
        copies = packed.select("block", "queries", every(chunks).alias("chunk")).select("block", "chunk", every(LISTS).alias("list"), "queries")
        rows = halves.select(every(blocks).alias("block"), "chunk", "list", "row", "vec_id", "part")
        rows = rows.unionByName(copies, allowMissingColumns=True)
        if entries is not None:
            rows = rows.unionByName(entries.withColumn("block", block).withColumn("chunk", chunk), allowMissingColumns=True)
        return rows.repartition(parts, *keys).sortWithinPartitions(*keys)

    def looked_up(entries: DataFrame) -> DataFrame:
        """query_id, vec_id, score of entries (query_id, row, vec_id), as a whole."""
        asked = bounded(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")))
        found = entries.join(candidates.select("row", "v"), "row").join(asked, "query_id")
        return found.select("query_id", "vec_id", arrow_column(_whole, "long", 2)("v", "q").alias("score"))

    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def cutoffs(scores: DataFrame) -> DataFrame:
        """query_id, cutoff: the k-th best score of each query that has so many."""
        ranked = scores.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best_first))
        return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "cutoff")

    gathered = grid(queries.withColumn("cutoff", F.lit(None).cast("long"))).mapInArrow(tidied(_gather(k)), _ENTRY)
    of_list = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "row")
    gathered = gathered.withColumn("rank", F.row_number().over(of_list)).where(F.col("rank") <= k).select("query_id", "row", "vec_id").distinct()
    first = materialize(looked_up(gathered))
    safe = materialize(cutoffs(first))

    cut = queries.join(safe.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    partial = [F.max(F.when(F.col("list") == i, F.col("score"))).alias(f"p{i}") for i in range(LISTS)]
    entries = grid(cut).mapInArrow(tidied(_collect), _ENTRY).groupBy("query_id", "row", "vec_id").agg(*partial, F.max(F.col("score").isNull()).alias("large"))
    known = [F.col(f"p{i}") for i in range(LISTS)]
    missing = sum((p.isNull().cast("int") for p in known), F.lit(0))
    one = F.coalesce(*[F.when(p.isNull(), F.lit(i)) for i, p in enumerate(known)])
    unknown = F.when(F.col("large") | (missing > 1), -1).when(missing == 1, one).otherwise(LISTS)
    # of several lists unknown all is looked up again, as of a vector whose scores might leave 64 bits
    held = F.when(unknown < 0, F.lit(0)).otherwise(sum((F.coalesce(p, F.lit(0)) for p in known), F.lit(0)))
    reach = sum((F.coalesce(p, F.col("least") - 1) for p in known), F.lit(0))
    entries = entries.join(bounded(safe), "query_id", "left").withColumn("least", F.expr(f"cutoff div {LISTS} + int(cutoff % {LISTS} > 0)"))
    entries = materialize(entries.select("query_id", "row", "vec_id", unknown.alias("unknown"), held.cast("long").alias("known"), F.when(~F.col("large"), reach).alias("reach")))
    done = first.unionByName(entries.where(F.col("unknown") == LISTS).select("query_id", "vec_id", F.col("known").alias("score")))
    raised = materialize(cutoffs(done))
    # without a cutoff, or a bound, an entry stays
    rest = entries.where(F.col("unknown") < LISTS).join(bounded(raised), "query_id", "left").where("cutoff is null or reach is null or reach >= cutoff")
    lacking = rest.where("unknown >= 0").select("query_id", "row", "vec_id", "known", F.col("unknown").alias("list"))
    found = grid(queries.withColumn("cutoff", F.lit(None).cast("long")), lacking).mapInArrow(tidied(_complete), "query_id long, vec_id long, score long")
    scores = done.unionByName(found).unionByName(looked_up(rest.where("unknown < 0"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scores.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(vectors: DataFrame, nth: int = 100, k: int = 10) -> DataFrame:
    """The top k of each vector whose id is divisible by nth, against all vectors."""
    candidates = scaled(vectors)
    queries = candidates.where(F.col("vec_id") % nth == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    return top_k(candidates, queries, k)
