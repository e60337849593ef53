"""Shared pieces: scratch tables, hashing of words and shingles, distributed ranks and connected components.

Long jobs cut their lineage by writing Parquet tables into the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor never forces a step to be recomputed from the start.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from contextvars import ContextVar
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space, and so words, of every operator here: the ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"
#: A null id sorts after all others.
LAST = 2**63 - 1
#: A table whose values, with 32 bytes a row for the hash table, come to so many bytes may be broadcast; beyond it a join shuffles.
BROADCAST_BYTES = 24 << 20
#: Bytes of the Arrow batches that go to Python workers; Spark's own default is made for larger executors.
ARROW_BYTES = 8 << 20


def scratch(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quern/{uuid.uuid4().hex}"


#: Scratch tables of the innermost open scope; a thread has scopes of its own.
_scope: ContextVar[list[str] | None] = ContextVar("quern_scope", default=None)
#: Python broadcasts of the innermost open scope.
_shared: ContextVar[list | None] = ContextVar("quern_shared", default=None)


def materialize(df: DataFrame, compact: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read again; compact: a small part of what many tasks scan, dealt to files
    of a good size first."""
    if compact:
        df = df.hint("rebalance")
    bound_arrow(df.sparkSession)
    path = scratch(df.sparkSession)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The rows of make(), written; the scratch tables and broadcasts made on the way are deleted, also if it fails."""
    outer, outer_shared = _scope.set(inner := []), _shared.set(lent := [])
    try:
        df = make()
        _scope.reset(outer)
        return materialize(df)
    finally:
        if _scope.get() is inner:
            _scope.reset(outer)
        _shared.reset(outer_shared)
        for value in lent:
            value.destroy()
        for path in inner:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def share(spark: SparkSession, value):
    """A broadcast of value for Python workers, destroyed with the innermost scope."""
    out = spark.sparkContext.broadcast(value)
    if (lent := _shared.get()) is not None:
        lent.append(out)
    return out


def bound_arrow(spark: SparkSession) -> None:
    """Lowers the session's size of Arrow batches to ARROW_BYTES; one larger row still makes a batch of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def fits(df: DataFrame) -> bool:
    """Whether the measured size of df is within BROADCAST_BYTES. df should be a written table."""
    width = F.lit(32)
    for name, kind in df.dtypes:
        c = F.col("`" + name.replace("`", "``") + "`")
        width = width + (F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.coalesce(F.size(c), F.lit(0)) * 24 if kind.startswith("array") else F.lit(8))
    return (df.agg(F.sum(width.cast("long"))).collect()[0][0] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


def beside(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs (key, print, text) with table (key, print and others; written): texts stay where they are if the table fits, else
    those that are in it travel."""
    if fits(table):
        return docs.join(F.broadcast(table), ["key", "print"])
    return narrow(docs, "key", materialize(table.select("key").distinct())).join(table, ["key", "print"])


def dealt_join(rows: DataFrame, table: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """rows with table, written and of distinct keys: by a broadcast if it fits, else by a shuffle that deals the rows of a
    key over as many tasks as it has times `most` rows."""
    if fits(table):
        return rows.join(F.broadcast(table), key)
    salts = materialize(rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).where("_salts > 1"))
    salted = rows.join(bounded(salts), key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.floor(F.rand(7) * F.col("_salts"))).cast("int")).drop("_salts")
    copies = table.join(bounded(salts), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def narrow(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is among ids (one column of that name, distinct), by a broadcast of checked size or a shuffle."""
    return df.join(bounded(ids), key, "left_semi")


def ranked(df: DataFrame, part: list[str], order: list[str | Column], name: str, buckets: int, hashed: str) -> DataFrame:
    """Adds the gapless rank (from 0) of each row within part, as column name.

    Rows go to hash buckets; each bucket is numbered by itself and gets the number of rows in the buckets before it, so
    no task needs all rows of a part. order settles the order inside a bucket.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", F.pmod(F.xxhash64(hashed), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*part, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*part).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_p_{c}") for c in part], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*part, "_bucket").orderBy(*order))
    same = F.col("_bucket") == F.col("_b")
    for c in part:
        same &= F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return df.withColumn("_in", inside).join(starts, same).withColumn(name, F.col("_start") + F.col("_in") - 1).drop("_bucket", "_b", "_in", "_start", *[f"_p_{c}" for c in part])


# ---------------------------------------------------------------------------------------------------------------
# Memory of Python workers, which later stages use again

_caches: dict[str, Callable[[], None]] = {}


def keep_until_others(name: str, clear: Callable[[], None]) -> None:
    """Registers what an operator keeps in a worker beyond its task, to be cleared once another operator runs there."""
    _caches[name] = clear


def make_room(name: str = "") -> None:
    """Clears what other operators have kept in this worker."""
    others = [k for k in _caches if k != name]
    for other in others:
        _caches.pop(other)()
    if others:
        trim()


def tidied(f: Callable) -> Callable:
    """f, a function from batches to batches, that leaves no freed memory in the worker's pools, as workers outlive tasks."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def trim() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_column(f: Callable[..., pa.Array], kind: str, inputs: int = 1) -> Callable[..., Column]:
    """A column function of so many inputs from f, a function of Arrow arrays, tidied; f sees slices of at most about
    a megabyte of its first input."""

    def slices(arrays: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
        step = max(1, int(len(arrays[0]) * (1 << 20) / max(1, arrays[0].nbytes)))
        for at in range(0, max(1, len(arrays[0])), step):
            yield tuple(a.slice(at, step) for a in arrays)

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            out = [f(*part) for part in slices((batch,) if inputs == 1 else tuple(batch))]
            yield pa.concat_arrays(out) if len(out) > 1 else out[0]
        trim()

    several = tuple.__class_getitem__((pa.Array,) * inputs)
    run.__annotations__ = {"batches": Iterator[pa.Array if inputs == 1 else several], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


# ---------------------------------------------------------------------------------------------------------------
# Hashes of words, by numpy over whole buffers

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 2**64)
_SEGMENT = 1 << 18
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT, n) + 1
    if size not in _tables:
        out = []
        for p in (_P, _P_INV):
            row = np.full(size, p, np.uint64)
            row[0] = 1
            out.append(np.cumprod(row, dtype=np.uint64))
        if n > _SEGMENT:
            return out[0], out[1]
        _tables[size] = (out[0], out[1])
    return _tables[size]


def _segment_hashes(buf: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64)), starts + at


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and each text's first index (with the end as last entry)."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + _SEGMENT, len(data))
        if end < len(data):  # cut behind a blank; a longer word makes the segment longer
            cut = max(data.rfind(b, at, end) for b in (b" ", b"\n"))
            while cut < at and end < len(data):
                end = min(end + _SEGMENT, len(data))
                cut = max(data.rfind(b, at, end) for b in (b" ", b"\n"))
            end = cut + 1
        h, p = _segment_hashes(buf[at:end], at)
        hashes.append(h)
        places.append(p)
        at = end
    h, p = np.concatenate(hashes), np.concatenate(places)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return h, np.searchsorted(p, np.concatenate(([0], np.cumsum(lengths))))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive entries; len(h) - n + 1 of them, none if h is shorter."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc, have, power, step = None, 0, h, 1
    factor, seen = 0xD6E8FEB86659FD93, n
    while seen:
        if seen & 1:
            m = len(h) - (have + step) + 1
            acc = power[:m] if acc is None else acc[:m] * np.uint64(factor) + power[have : have + m]
            have += step
        seen >>= 1
        if seen:
            m = len(power) - step
            power = power[:m] * np.uint64(factor) + power[step:]
            factor, step = factor * factor % 2**64, step * 2
    return mix(acc + np.uint64(n))


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive entries."""
    if len(x) < n:
        return np.empty(0, x.dtype)
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (n - span)], x[n - span :]) if n > span else x


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes laid end to end: each entry's group, and its place in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def batches_of_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the text column goes over so many bytes, so that one batch's work fits in memory."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal keys out of batches that are sorted by them, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------------------------------------------------------
# Connected components


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "component": pa.array([find(x) for x in nodes], pa.int64())})


def connected_components(edges: DataFrame, small: int = 50_000) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b longs).

    Each round maps a node to the node of least hash among itself and its neighbours, follows that map once more, and
    contracts the edges by it; hubs are dealt over tasks. The number of nodes falls by a constant factor a round, whatever the shape. Once at most
    `small` edges are left, one executor task unites them; only counts reach the driver. Null ends are left out.
    """
    current = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while (left := current.count()) > small:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seed = F.lit(len(maps))
        rank = lambda c: F.struct(F.xxhash64(seed, F.col(c)).alias("h"), F.col(c).alias("v"))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to"))
        step = materialize(step)
        twice = materialize(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")))
        maps.append(twice)
        ends = dealt_join(dealt_join(current, twice.select(F.col("node").alias("a"), F.col("to").alias("x")), "a"), twice.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        current = materialize(ends.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if left:
        last = current.coalesce(1).mapInArrow(_union_find, "node long, component long")
        maps.append(materialize(last.withColumnRenamed("component", "to")))
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0].select("node", "to")
    for m in maps[1:]:
        out = out.join(m.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    if len(maps) == 1 and left:
        return out.withColumnRenamed("to", "component")
    out = materialize(out)
    least = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(least, "to").select("node", "component")
