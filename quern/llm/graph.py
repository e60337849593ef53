"""Embedding near-dedup by a robust-pruned flat graph.

1. Equal directions share one node. Nodes are assigned to overlapping shards: their `overlap` nearest centres, drawn from
   a bounded sample; the nearest is the node's home. Shards that are still too large are split again by centres of their
   own, each from a bounded sample of it, until none is or splitting doesn't help, so shards keep their size however many
   nodes there are.
2. In each shard, robust pruning gives every node its edges: the nearest node left becomes a neighbour and rules out the
   nodes that are nearer to it, by the factor alpha, than to the node itself. A node's adjacency list is the union of its
   lists of all its shards.
3. Each node searches the shards it belongs to: greedy search from the shard's medoid, widened as long as nodes within the
   range turn up. The union of lists shows into which other shards a found neighbour leads; the search goes on there, round
   by round, until no node has a new shard to visit. A link is counted in the neighbour's home shard only, so no pair of
   shards counts it twice, and no list of pairs is ever built: a visit yields a count, one tie for grouping and the shards
   to visit next.
4. Every link is verified by its cosine in doubles. Recall is audited against brute force for a bounded sample of nodes;
   if it is under `RECALL`, the search is run again with twice the overlap, up to four times the first. If that isn't
   enough either, every node is compared with every shard's nodes in blocks: the result is whole, at the cost of all pairs.

A shard's graph travels as one packed row; hot shards are copied for every `VISITS` visitors, which are dealt over the
copies.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do those
of a null vec_id; they get a row with no links, their own id as component, and are kept. Vectors of different length
don't link. Rows that repeat a vec_id count as one vector each in the counts, and share the id.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import bounded, connected_components, materialize, mix, runs, settled, share, tidied
from quern.llm.topk import usable

COSINE = 0.95
#: Nodes that a shard is meant to hold, centres at most, rows that the centres are drawn from at most.
SHARD, CENTRES, SAMPLE = 1000, 1024, 20_000
#: Times its meant size at which a shard is split again; rows of a split shard's sample, about.
LARGE, SPLIT_SAMPLE = 6, 2000
OVERLAP = 3
DEGREE, ALPHA, BEAM = 24, 1.2, 16
#: Visitors that one task takes to a copy of a shard's graph.
VISITS = 1000
#: Numbers of split shards begin here; those of first centres are smaller.
SPLIT_IDS = 2**40
AUDITED, RECALL = 200, 0.95


def _stack(column: pa.Array) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64)
    return x.reshape(len(column), -1)


def prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Robust-pruned neighbours of each unit vector among all others (rows of places, -1 where there are fewer)."""
    n = len(x)
    out = np.full((n, degree), -1, np.int32)
    if n < 2:
        return out
    y = x.astype(np.float32)
    gaps = lambda rows: np.maximum(2 - 2 * (y[rows] @ y.T), 0)  # noqa: E731  squared distances
    step = max(1, (2 << 20) // n)  # so many rows at once, whatever the size
    for a in range(0, n, step):
        rows = np.arange(a, min(n, a + step))
        mine = gaps(rows)
        left = mine.copy()
        left[np.arange(len(rows)), rows] = np.inf
        for d in range(degree):
            near = left.argmin(axis=1)
            open_ = np.isfinite(left[np.arange(len(rows)), near])
            if not open_.any():
                break
            out[rows[open_], d] = near[open_]
            left[(alpha * alpha) * gaps(near) <= mine] = np.inf
            left[np.arange(len(rows)), near] = np.inf
    return out


def union_reverse(edges: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists with the edges of both directions."""
    n = len(edges)
    a = np.repeat(np.arange(n), edges.shape[1])
    b = edges.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    return np.split((pairs % n).astype(np.int32), np.searchsorted(pairs // n, np.arange(1, n)))


def search_all(x: np.ndarray, edges: list[np.ndarray], start: int, queries: np.ndarray, cosine: float, beam: int = BEAM) -> Iterator[np.ndarray]:
    """For each query the places whose cosine is in range, by greedy search from start, a block of queries at a time.

    A query expands its best open nodes while one is in range or among the best `beam` seen, so the search widens with
    every node in range."""
    n, degree = len(x), max((len(e) for e in edges), default=0)
    table = np.full((n, max(1, degree)), -1, np.int64)
    for i, e in enumerate(edges):
        table[i, : len(e)] = e
    y, wide = x.astype(np.float32), 4
    step = max(1, (2 << 20) // n)
    for a in range(0, len(queries), step):
        q = queries[a : a + step].astype(np.float32)
        at = np.arange(len(q))
        value = np.full((len(q), n), -np.inf, np.float32)  # cosines of the nodes seen
        open_ = np.full((len(q), n), -np.inf, np.float32)  # of those not expanded yet
        value[:, start] = open_[:, start] = q @ y[start]
        live = at
        while len(live):
            take = min(wide, n)
            best = np.argpartition(-open_[live], take - 1, axis=1)[:, :take]
            score = np.take_along_axis(open_[live], best, axis=1)
            # a query goes on while one of its open nodes is in range or among the best `beam` nodes seen
            bar = np.partition(value[live], n - min(beam, n), axis=1)[:, n - min(beam, n)]
            useful = np.isfinite(score) & ((score >= cosine - 1e-6) | (score >= bar[:, None]))
            np.put_along_axis(sub := open_[live], best, np.where(useful, -np.inf, score), axis=1)
            open_[live] = sub
            row, col = np.nonzero(useful)
            if len(row):
                who = np.repeat(live[row], table.shape[1])
                node = table[best[row, col]].reshape(-1)
                who, node = who[node >= 0], node[node >= 0]
                fresh = value[who, node] == -np.inf
                code = np.unique(who[fresh] * n + node[fresh])
                who, node = code // n, code % n
                c = np.einsum("ij,ij->i", q[who], y[node])
                value[who, node] = c
                open_[who, node] = c
            live = live[useful.any(axis=1)]
        for i in range(len(q)):
            yield np.flatnonzero(value[i] >= cosine - 1e-5)


def _kmeans(x: np.ndarray, k: int, rounds: int = 2) -> np.ndarray:
    """k centres (fewer, if there are fewer rows): the first rows, moved to the means of what is nearest."""
    c = x[: max(1, min(k, len(x)))].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 1000] @ c.T).argmax(axis=1) for i in range(0, len(x), 1000)])
        for j in range(len(c)):
            mean = x[home == j].sum(axis=0) if (home == j).any() else c[j]
            c[j] = mean / (np.linalg.norm(mean) or 1)
    return c


def _centres(nodes: DataFrame, shards: int) -> dict[int, np.ndarray]:
    """Centres by vector length, of a bounded random sample (least hashes)."""
    rows = nodes.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(SAMPLE).select("x").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r[0]), []).append(r[0])
    return {length: _kmeans(np.array(xs), shards) for length, xs in by.items()}


def _split_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, centres of the sampled rows (shard, parts, x) of shards to split."""
    for group in runs(batches, ["shard"]):
        data = io.BytesIO()
        np.save(data, _kmeans(_stack(group.column("x").combine_chunks()), group.column("parts")[0].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([group.column("shard")[0].as_py()], pa.int64()), pa.array([data.getvalue()], pa.binary())], ["shard", "centres"])


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, rank, shard: the two nearest parts of the node's shard; rank is that of the shard, then that of the part."""
    for group in runs(batches, ["shard", "copy"]):
        centres = [c for c in group.column("centres").to_pylist() if c is not None]
        guests = group.filter(pc.is_valid(group.column("node")))
        if not guests.num_rows:
            continue
        c = np.load(io.BytesIO(centres[0]))
        near = _stack(guests.column("x").combine_chunks()) @ c.T
        best = np.argsort(-near, axis=1, kind="stable")[:, :2]
        n, w = best.shape
        base = np.uint64(group.column("shard")[0].as_py() % 2**64)
        ids = (mix(mix(base + np.arange(len(c), dtype=np.uint64) + np.uint64(1)) ^ base) >> np.uint64(2)).astype(np.int64) + SPLIT_IDS
        rank = np.asarray(guests.column("rank")).repeat(w) * 2 + np.tile(np.arange(w), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(guests.column("node")).repeat(w)), pa.array(rank, pa.int64()), pa.array(ids[best.reshape(-1)])], ["node", "rank", "shard"])


def _split(members: DataFrame) -> DataFrame:
    """members with shards of more than LARGE times the meant size split, round by round; the home stays first."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = None
    while True:
        spread = members.select("node", "x", F.posexplode("shards").alias("rank", "shard"))
        large = spread.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > LARGE * SHARD)
        large = materialize(large.select("shard", "n", F.ceil(2 * F.col("n") / SHARD).cast("int").alias("parts"), F.ceil(F.col("n") / SPLIT_SAMPLE).alias("of"), F.ceil(F.col("n") / VISITS).cast("int").alias("copies")))
        most = large.agg(F.max("n")).collect()[0][0]
        if most is None or largest is not None and most >= largest:
            return members
        largest = most
        inside = spread.join(large, "shard")
        some = inside.where(F.pmod(F.xxhash64(F.lit(9), "node"), "of") == 0).select("shard", "parts", "x", "node")
        centres = materialize(some.repartition(parts, "shard").sortWithinPartitions("shard", "node").select("shard", "parts", "x").mapInArrow(_split_centres, "shard long, centres binary"))
        copies = centres.join(large, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("array<double>").alias("x"), "centres")
        guests = inside.join(centres.select("shard"), "shard").select("shard", F.pmod(F.xxhash64("node"), "copies").cast("int").alias("copy"), "node", "rank", "x", F.lit(None).cast("binary").alias("centres"))
        rows = copies.unionByName(guests).repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy")
        moved = rows.mapInArrow(_split_rows, "node long, rank long, shard long")
        stay = spread.join(centres.select("shard"), "shard", "left_anti").select("node", (F.col("rank") * 2).cast("long").alias("rank"), "shard")
        lists = moved.unionByName(stay).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("rank", "shard"))).alias("l")).select("node", F.array_distinct(F.col("l.shard")).alias("shards"))
        members = materialize(members.drop("shards").join(lists, "node"))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a column by their length: length, places, matrix."""
    offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
    lengths = np.diff(offsets)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, flat[offsets[rows][:, None] + np.arange(length)]


def _assigner(shared, overlap: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        first = np.cumsum([0, *(len(c) for c in centres.values())])
        base = dict(zip(centres, first.tolist(), strict=False))
        for batch in batches:
            shards: list[list[int]] = [[]] * batch.num_rows
            for length, rows, x in _by_length(batch.column("x")):
                if length not in centres:  # a length that the sample lacks: one shard for it
                    near = np.full((len(rows), 1), int(first[-1]) + length)
                else:
                    score = x @ centres[length].T
                    k = min(overlap, score.shape[1])
                    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable"), axis=1) + base[length]
                for i, s in zip(rows.tolist(), near.tolist(), strict=True):
                    shards[i] = s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "weight", "x")), pa.array(shards, pa.list_(pa.int64()))], ["node", "weight", "x", "shards"])

    return assign


def _builder(degree: int, alpha: float):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard"]):
            x = _stack(group.column("x").combine_chunks())
            edges = prune(x, degree, alpha)
            middle = int((x @ x.mean(axis=0)).argmax())
            data = io.BytesIO()
            shards = group.column("shards").to_pylist()
            np.savez(
                data, x=x, edges=edges, middle=middle, node=np.asarray(group.column("node")), weight=np.asarray(group.column("weight")),
                home=np.array([s[0] for s in shards]), shards=np.array([s + [-1] * (max(map(len, shards)) - len(s)) for s in shards]),
            )
            yield pa.RecordBatch.from_arrays([pa.array([group.column("shard")[0].as_py()], pa.int64()), pa.array([data.getvalue()], pa.binary())], ["shard", "graph"])

    return build


def _compare_all(x: np.ndarray, queries: np.ndarray, cosine: float) -> Iterator[np.ndarray]:
    """For each query the places whose cosine is in range, by comparing all."""
    step = max(1, (2 << 20) // len(x))
    for a in range(0, len(queries), step):
        for row in queries[a : a + step] @ x.T >= cosine - 1e-5:
            yield np.flatnonzero(row)


def _searcher(cosine: float, brute: bool):
    """Rows: shard, copy, and either a graph or a visitor (node, x). Yields for each visitor: node, shard, links (rows of
    other vectors linked at home here), next (shards of its linked nodes). Further rows, of shard -1, tie each node that
    the links found here join to the least one of its group."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["shard", "copy"]):
            graphs = [g for g in group.column("graph").to_pylist() if g is not None]
            visitors = group.filter(pc.is_valid(group.column("node")))
            if not graphs or not visitors.num_rows:
                continue
            g = np.load(io.BytesIO(graphs[0]))
            x, shard = g["x"], group.column("shard")[0].as_py()
            visitors = visitors.filter(pc.equal(pc.list_value_length(visitors.column("x")), x.shape[1]))
            if not visitors.num_rows:
                continue
            ids, weight, home, shards = g["node"], g["weight"], g["home"], g["shards"]
            node, q = np.asarray(visitors.column("node")), _stack(visitors.column("x").combine_chunks())
            links, onward = np.zeros(len(node), np.int64), []
            everyone, place = np.unique(np.concatenate((ids, node)), return_inverse=True)
            inside, outside = place[: len(ids)], place[len(ids) :]
            root = np.arange(len(everyone))  # the least member of the group so far
            seen = _compare_all(x, q, cosine) if brute else search_all(x, union_reverse(g["edges"]), int(g["middle"]), q, cosine)
            for i, found in enumerate(seen):
                if len(found):
                    found = found[(x[found] * q[i]).sum(axis=1) >= cosine]  # verified in doubles
                found = found[ids[found] != node[i]]
                links[i] = weight[found][home[found] == shard].sum()
                if len(found):
                    joined = np.unique(np.append(root[inside[found]], root[outside[i]]))
                    if len(joined) > 1:
                        root[np.isin(root, joined)] = joined[0]
                where = np.unique(shards[found])
                onward.append(where[where >= 0].tolist())
            yield _visits(node, shard, links, node, onward)
            tied = np.flatnonzero(root != np.arange(len(root)))
            if len(tied):
                yield _visits(everyone[tied], -1, np.zeros(len(tied), np.int64), everyone[root[tied]], [[]] * len(tied))

    return visit


def _visits(node: np.ndarray, shard: int, links: np.ndarray, tie: np.ndarray, onward: list[list[int]]) -> pa.RecordBatch:
    columns = [pa.array(node), pa.array(np.full(len(node), shard, np.int64)), pa.array(links), pa.array(tie), pa.array(onward, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["node", "shard", "links", "tie", "next"])


def _search(members: DataFrame, cosine: float, brute: bool = False) -> DataFrame:
    """All visits (node, shard, links, tie) of the nodes (node, weight, x, shards). With brute each node is compared with
    all nodes: those of every shard, in blocks of VISITS visitors to a shard."""
    spark = members.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = members.withColumn("shard", F.explode("shards"))
    graphs = materialize(spread.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(tidied(_builder(DEGREE, ALPHA)), "shard long, graph binary"))
    wanted = spread.select("node", "shard")
    if brute:
        numbered = materialize(graphs.select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("at")))  # a row a shard
        last = numbered.count() - 1
        wanted = members.select("node", F.explode(F.sequence(F.lit(0), F.lit(max(0, last)))).alias("at")).join(bounded(numbered), "at").select("node", "shard")
    vectors = members.select("node", "x")
    visits: DataFrame | None = None
    while True:
        crowd = wanted.groupBy("shard").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("copies"))
        copies = graphs.join(crowd, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("x"), "graph")
        guests = wanted.join(crowd, "shard").join(vectors, "node").select("shard", F.pmod(F.xxhash64("node"), "copies").cast("int").alias("copy"), "node", "x", F.lit(None).cast("binary").alias("graph"))
        rows = copies.unionByName(guests).repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy")
        found = materialize(rows.mapInArrow(tidied(_searcher(cosine, brute)), "node long, shard long, links long, tie long, next array<long>"))
        visits = found if visits is None else visits.unionByName(found)
        more = found.select("node", F.explode("next").alias("shard")).distinct().join(visits.select("node", "shard"), ["node", "shard"], "left_anti")
        wanted = materialize(more)
        if wanted.isEmpty():
            return visits


def audit(nodes: DataFrame, counted: DataFrame, cosine: float, most: int = AUDITED) -> float:
    """Share of the links of a bounded sample of nodes (those with and without links found, least hashes first) that the
    search found, against brute force over all nodes."""
    some = [counted.where(c).orderBy(F.xxhash64(F.lit(5), "node"), "node").limit(most // 2) for c in ("links > 0", "links = 0")]
    rows = some[0].unionByName(some[1]).join(nodes, "node").select("node", "x", "links").collect()
    if not rows:
        return 1.0
    shared = share(nodes.sparkSession, [(r["node"], np.array(r["x"])) for r in rows])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, weight = np.asarray(batch.column("node")), np.asarray(batch.column("weight"))
            for length, mine, x in _by_length(batch.column("x")):
                asked = [(i, v) for i, v in shared.value if len(v) == length]
                if asked:
                    ids = np.array([i for i, _ in asked])
                    near = (x @ np.stack([v for _, v in asked]).T >= cosine) & (node[mine][:, None] != ids[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(weight[mine] @ near.astype(np.int64))], ["node", "links"])

    true = {r[0]: r[1] for r in nodes.mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links")).collect()}
    total = sum(true.values())
    return sum(min(r["links"], true.get(r["node"], 0)) for r in rows) / total if total else 1.0


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id, kept, audited_recall for every row of vectors (vec_id, embedding)."""
    return settled(lambda: _near_duplicates(vectors, cosine, overlap), vectors.sparkSession)


def _near_duplicates(vectors: DataFrame, cosine: float, overlap: int) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), usable(F.col("embedding")).alias("ok"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    peak = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("peak", F.when(F.col("ok") & (F.size("v") > 0), peak)).withColumn("v", F.when(F.col("peak") > 0, F.transform("v", lambda v: v / F.col("peak"))))
    rows = rows.withColumn("x", F.when(F.col("vec_id").isNotNull() & F.col("v").isNotNull(), F.transform("v", lambda v: v / norm))).select("vec_id", "x")
    rows = materialize(rows)
    nodes = materialize(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    n, brute = nodes.count(), False
    while True:
        shards = min(CENTRES, -(-n * overlap // SHARD)) if n > 2 * SHARD else 1
        shared = share(vectors.sparkSession, _centres(nodes, shards))
        members = materialize(nodes.mapInArrow(tidied(_assigner(shared, overlap)), "node long, weight long, x array<double>, shards array<long>"))
        members = _split(members)
        visits = _search(members, cosine, brute)
        counted = materialize(visits.groupBy("node").agg(F.sum("links").alias("links")))
        recall = audit(nodes, counted, cosine)
        if recall >= RECALL or brute:
            break
        brute = overlap >= 4 * OVERLAP or shards <= overlap
        overlap = 1 if brute else overlap * 2
    groups = connected_components(visits.where("tie < node").select(F.col("tie").alias("a"), F.col("node").alias("b")))
    per_node = counted.join(groups, "node", "left").join(nodes, "node").select("x", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    out = rows.join(per_node, "x", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(recall).alias("audited_recall"))
