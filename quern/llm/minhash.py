"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, grouping.

SuperMinHash gives each set element a random permutation of the signature's places, drawn step by step. In step j the
element offers j plus a uniform number to its j-th place, and each place keeps the least offer. Steps end once every
place holds less than the next step could offer, so large sets need one step. All elements of a batch take a step at once
here; the least offers don't depend on the order, so this gives the sequential algorithm's signature exactly.

Documents that agree in all rows of a band meet in that band's bucket. A bucket never lists its pairs: each member is
first compared with the bucket's first document. Groups that these links leave apart though they share a bucket are then
compared member by member, in blocks, by exact counts; a bucket of two is done with its one pair, so chance meetings cost no more than
that. So whatever meets in a bucket is in one group or was counted, and no link
between groups is missed. All counts are on the full sets of 64-bit hashes. Documents with equal word sequences share
one class, and only classes are compared.

With 24 bands of 4 rows a pair of similarity 0.8 misses all buckets with probability 3e-6.

Defined results: a null or blank text has no shingles and is linked with nothing. Rows that share a doc_id are one
document. Rows without one are documents of their own, equal word sequences together; their component_id is null where no
doc_id is reachable, and then one text of each group is kept, and each blank one. (Inside, they get numbers from the top
2**40 longs; ids from that range are refused.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LAST, arrow_column, batches_of_bytes, beside, bounded, columns, connected_components, dealt_join, encoded, gram_hashes, make_room, materialize, mix, narrow, runs, settled, spread, tidied, word_hashes

BANDS, ROWS = 24, 4
#: A pair of less estimated similarity than the threshold by this much isn't verified: five standard deviations at 0.8.
SLACK = 0.2
#: Partners of one document, and sets of a cluster, that one task takes; more are dealt over several.
PARTNERS = 20_000
NAMELESS = 2**40
BLOCK = 2000

_SIGNED = "key long, print long, class binary, n_shingles long, bands array<long>, signature binary"


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, as sorted 64-bit hashes laid end to end, and where each text's begin.

    A text of fewer than n words has its whole sequence as one shingle; a text without words has none."""
    hashes, at = word_hashes(texts)
    words = np.diff(at)
    grams = gram_hashes(hashes, n)
    counts = np.maximum(words - n + 1, 0)
    doc, place = spread(counts)
    value = grams[at[doc] + place] if len(doc) else np.empty(0, np.uint64)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        doc = np.concatenate((doc, short))
        value = np.concatenate((value, np.array([gram_hashes(hashes[at[d] : at[d + 1]], int(words[d]))[0] for d in short], np.uint64)))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def super_minhash(values: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (sets x m, float64) of the sets of 64-bit hashes values[at[i]:at[i+1]]; inf for empty sets."""
    sets = len(at) - 1
    sizes = np.diff(at)
    signature = np.full((sets, m), np.inf)
    flat = signature.reshape(-1)
    owner = np.repeat(np.arange(sets), sizes)
    places: np.ndarray | None = None  # the permutations, once a second step is needed
    drawn: list[np.ndarray] = []
    for step in range(m):
        if not len(values):
            break
        r = mix(values + np.uint64((step * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
        pick = step + ((r >> np.uint64(40)) * np.uint64(m - step) >> np.uint64(24)).astype(np.int64)
        offer = step + mix(r).astype(np.float64) / 2.0**64
        if step == 0:
            place = pick
        else:
            if places is None:
                places = np.tile(np.arange(m, dtype=np.uint8), (len(values), 1))
                _swap(places, 0, drawn[0])
            place = _swap(places, step, pick)
        np.minimum.at(flat, owner * m + place, offer)
        if step == 0:
            drawn = [pick]
        open_ = signature.max(axis=1) >= step + 1
        keep = open_[owner]
        if not keep.all():
            values, owner = values[keep], owner[keep]
            places = places[keep] if places is not None else None
            drawn = [drawn[0][keep]]
    return signature


def _swap(places: np.ndarray, step: int, pick: np.ndarray) -> np.ndarray:
    rows = np.arange(len(places))
    out = places[rows, pick].astype(np.int64)
    places[rows, pick] = places[:, step]
    places[:, step] = out
    return out


def _signer(n: int, bands: int, rows: int):
    m = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches_of_bytes(batches, "text", 2 << 20):
            texts = [encoded(t).lower() for t in batch.column("text").to_pylist()]
            classes = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts]
            values, at = shingle_sets(texts, n)
            signature = super_minhash(values, at, m)
            sizes = np.diff(at)
            hashed = mix(signature.view(np.uint64)).reshape(len(texts), bands, rows)
            with np.errstate(over="ignore"):
                key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for r in range(rows):
                    key = mix(key * np.uint64(31) + hashed[:, :, r])
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
            byte = (hashed.reshape(len(texts), m) >> np.uint64(56)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("print"), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[sizes > 0].reshape(-1).view(np.int64), pa.int64())), pa.array([b.tobytes() for b in byte], pa.binary()),
                ],
                ["key", "print", "class", "n_shingles", "bands", "signature"],
            )

    return sign


def _setter(n: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, "text", 2 << 20):
            texts = [encoded(t).lower() for t in batch.column("text").to_pylist()]
            same = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() == c for t, c in zip(texts, batch.column("class").to_pylist(), strict=True)]
            values, at = shingle_sets(texts, n)
            chosen = np.flatnonzero(same)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(chosen)), pa.array([values[at[i] : at[i + 1]].tobytes() for i in chosen], pa.binary())], ["node", "shingles"]
            )

    return sets


def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).mean(axis=1), pa.float64())


def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        both = np.concatenate((x, y))
        both.sort(kind="stable")
        out.append({"common": int((both[1:] == both[:-1]).sum()), "total": len(both)})
    return pa.array(out, pa.struct([("common", pa.int64()), ("total", pa.int64())]))


def _cross_links(similarity: int):
    """Links between members of different labels. Rows: cluster, turn, block, probe, node, label, shingles. The probes of a
    group meet its other rows through an inverted index of these rows' shingles, which counts common shingles exactly at a
    cost of the overlap that there is. One link a probe and label is enough to join them."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in runs(batches, ["cluster", "turn", "block"]):
            node, label, probe = (np.asarray(group.column(c)) for c in ("node", "label", "probe"))
            sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
            others = np.flatnonzero(~probe)
            if not len(others):
                continue
            size = np.array([len(sets[i]) for i in others])
            owner = np.repeat(np.arange(len(others)), size)
            value = np.concatenate([sets[i] for i in others])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], owner[order]
            for p in np.flatnonzero(probe):
                lo, hi = np.searchsorted(value, sets[p], "left"), np.searchsorted(value, sets[p], "right")
                counts = hi - lo
                at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
                common = np.bincount(owner[at], minlength=len(others))
                near = (100 * common >= similarity * (size + len(sets[p]) - common)) & (label[others] != label[p])
                joined: set[int] = set()
                for y in others[near].tolist():
                    if label[y] not in joined:
                        joined.add(label[y])
                        out.append((min(node[p], node[y]), max(node[p], node[y])))
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return links


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def _sets(ids: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """node, shingles of the ids (one column node, distinct), written once."""
    wanted = materialize(narrow(nodes.select("node", "key", "print", "class"), "node", ids), compact=True)
    return materialize(beside(docs, wanted).select("node", "text", "class").mapInArrow(tidied(_setter(n)), "node long, shingles binary").distinct())


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, similarity: int) -> DataFrame:
    """Those pairs (a < b, distinct) with 100 * common >= similarity * union, on the full sets of shingles."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(materialize(ends), nodes, docs, n)
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("subs"))
    dealt = pairs.join(hubs, "a").withColumn("sub", F.pmod(F.xxhash64("b"), "subs").cast("int"))
    second = dealt.select("a", "b", "sub").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    first = hubs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    counted = second.join(first, ["a", "sub"]).select("a", "b", arrow_column(_common, "common long, total long", 2)("x", "y").alias("c"))
    return counted.where(F.expr(f"100 * c.common >= {similarity} * (c.total - c.common)")).select("a", "b")


def _across(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, similarity: int) -> DataFrame:
    """Links between groups that meet in a bucket, enough to join those groups that any link joins.

    A bucket's first document has been compared with all its members, so only the others can hold such links. Groups whose
    others share buckets form a cluster. Its members outside its largest group are probes, compared with all its
    members; both are dealt in blocks, so a task holds at most about two blocks of sets, whatever the cluster's size."""
    spark = members.sparkSession
    labelled = members.where("node > first").join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket", "least")
    meet = labelled.join(mixed, "bucket").where("label > least").select(F.col("least").alias("a"), F.col("label").alias("b")).distinct()
    clusters = materialize(connected_components(meet).select(F.col("node").alias("label"), F.col("component").alias("cluster")))
    inside = materialize(labelled.select("node", "label").distinct().join(clusters, "label"))
    groups = inside.groupBy("cluster", "label").agg(F.count("*").alias("size"))
    largest = groups.groupBy("cluster").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("size"))
    blocks = largest.select("cluster", F.col("top.label").alias("largest"), F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("top.size")) / BLOCK).cast("int").alias("turns"))
    rows = inside.join(blocks, "cluster").withColumn("hash", F.xxhash64("node"))
    place = lambda of: F.pmod("hash", of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    targets = rows.select("cluster", every("turns").alias("turn"), place("blocks").alias("block"), F.lit(False).alias("probe"), "node", "label")
    probes = rows.where("label != largest").select("cluster", place("turns").alias("turn"), every("blocks").alias("block"), F.lit(True).alias("probe"), "node", "label")
    sets = _sets(inside.select("node").distinct(), nodes, docs, n)
    dealt = targets.unionByName(probes).join(sets, "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["cluster", "turn", "block"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidied(_cross_links(similarity)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text); similarity in hundredths.

    component_id is the smallest doc_id reachable over links; kept marks the document that bears it."""
    found = settled(lambda: _grouped(docs, n, similarity, bands, rows), docs.sparkSession)
    return found.select(F.when(F.col("key") != LAST, F.col("key")).alias("doc_id"), "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, n: int, similarity: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key (doc_id, a null as the largest long), print (hash of the text), n_shingles, component_id, kept."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("print"), "text")
    signed = materialize(docs.mapInArrow(tidied(_signer(n, bands, rows)), _SIGNED))
    if (signed.where(F.col("key") < LAST).agg(F.max("key")).collect()[0][0] or 0) >= LAST - NAMELESS:
        raise ValueError(f"doc_ids must be below {LAST - NAMELESS}")
    own = F.lit(LAST - 1) - F.pmod(F.xxhash64("class"), F.lit(NAMELESS - 1))
    of_key = signed.where("n_shingles > 0").groupBy("class", "key").agg(F.count("*").alias("rows"), F.min("print").alias("least"))
    firsts = of_key.groupBy("class").agg(F.min(F.struct("key", "rows", "least")).alias("first")).select("class", "first.*")
    firsts = materialize(firsts.withColumn("node", F.when(F.col("key") == LAST, own).otherwise(F.col("key"))))
    whole = signed.join(bounded(firsts.select("class", "key", "node", "rows")), ["class", "key"])
    whole = whole.select("node", "key", "print", "class", "bands", "signature", "n_shingles", "rows")
    # rows that repeat a text and its id are one node
    nodes = materialize(whole.where("rows = 1").unionByName(whole.where("rows > 1").dropDuplicates(["class"])).drop("rows"))
    dealt = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("bucket", "first")
    members = materialize(dealt.join(bounded(materialize(shared)), "bucket").select("bucket", "node", "first"), compact=True)
    touched = materialize(members.select("node").distinct())
    signatures = materialize(narrow(nodes.select("node", "signature", "n_shingles"), "node", touched), compact=True)
    least = similarity / 100 - SLACK

    star = members.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    near = dealt_join(dealt_join(star, signatures.toDF("a", "sa", "na"), "a"), signatures.toDF("b", "sb", "nb"), "b")
    near = near.where(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")).where(arrow_column(_agreement, "double", 2)("sa", "sb") >= least)
    links = _verified(materialize(near.select("a", "b").distinct()), nodes, docs, n, similarity)
    again = materialize(signed.where(F.col("key") < LAST).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"))
    if not again.isEmpty():  # the texts of one doc_id are one document
        texts = signed.join(again, "key").join(firsts.select("class", "node"), "class").select("key", "node").distinct()
        least_node = texts.groupBy("key").agg(F.min("node").alias("a"))
        links = links.union(texts.join(least_node, "key").where("node > a").select("a", "node")).distinct()
    links = materialize(links)
    labels = materialize(connected_components(links))
    more = materialize(_across(members, labels, nodes, docs, n, similarity))
    if not more.isEmpty():
        labels = materialize(connected_components(links.unionByName(more)))
    grouped = signed.select("key", "print", "class", "n_shingles").join(bounded(firsts.select("class", "node", "least")), "class", "left").join(bounded(labels), "node", "left")
    component = F.coalesce("component", "node", "key")
    named = F.when(component < LAST - NAMELESS, component)
    one = F.col("node").isNull() | (F.col("node") == component) & (F.col("print") == F.col("least"))  # of a group without any id
    return grouped.select("key", "print", "n_shingles", named.alias("component_id"), F.coalesce(F.col("key") == named, one).alias("kept"))


def keep_first(docs: DataFrame, n: int = 5, similarity: int = 80) -> DataFrame:
    """One document of each group: the rows of docs that bear their group's component_id, or of a group without any id one
    text; blank texts all stay. Of rows that repeat a doc_id and text one stays."""
    from pyspark.sql import Window

    found = settled(lambda: _grouped(docs, n, similarity), docs.sparkSession)
    rows = found.select(F.col("key").alias("__quern_key"), F.col("print").alias("__quern_print"), "kept")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("__quern_key")) & (F.xxhash64("text") == F.col("__quern_print"))
    # texts stay where they are as long as the list of rows that go is of a size to broadcast
    go = materialize(rows.where("not kept").select("__quern_key", "__quern_print").distinct())
    out = docs.join(bounded(go), same, "left_anti")
    again = materialize(rows.groupBy("__quern_key", "__quern_print").count().where("count > 1").select("__quern_key", "__quern_print"))
    if again.isEmpty():
        return out
    one = Window.partitionBy(F.col("doc_id"), F.xxhash64("text")).orderBy(F.xxhash64(*columns(docs)))
    repeated = out.join(again, same, "left_semi").withColumn("__quern_one", F.row_number().over(one)).where("__quern_one = 1").drop("__quern_one")
    return out.join(again, same, "left_anti").unionByName(repeated)
