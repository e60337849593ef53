"""Substring dedup by super-k-mers: windows of consecutive words that repeat across documents are cut from all but the
first of them.

1. One pass over the texts gives each window of `width` words its minimiser, the least hash among its runs of `m` words.
   Consecutive windows with one minimiser form a super-k-mer. Equal windows have equal minimisers, so a minimiser seen in
   one document only cannot hold a repeated window and its super-k-mers stay at home.
2. The others travel as one packed string each to the bucket of their minimiser, where sorting the windows finds the
   least document of each exactly, on the words themselves.
3. The words that repeated windows cover are removed.

Documents of equal word sequences need no windows: all but the first lose every word if they have `width` words, none
otherwise. The windows of a minimiser that more than BUCKET super-k-mers have (a passage that many documents share) travel one by one as 128-bit
digests of their words: the least document of each is aggregated before the shuffle, so however many copies there are,
no task gets them all, and the repeated windows are joined back.

Defined results: a null text has no words. A null doc_id sorts after all others, and all such rows count as one document.
Rows that share a doc_id are the same document, so they never remove words from one another. Extra columns are kept by
`remove_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LAST, arrow_column, batches_of_bytes, beside, bounded, columns, encoded, gram_hashes, make_room, materialize, runs, settled, slide_min, spread, tidied, word_hashes

WIDTH = 50
#: Words of a minimiser: long enough that common phrases aren't minimisers, short enough for super-k-mers of many windows.
MINIMISER = 16
#: Super-k-mers of one minimiser that one task takes; of more, the windows are aggregated.
BUCKET = 20_000
#: Windows that a bucket sorts at once; more are sorted in passes, by checksum.
SORTED = 200_000

_SCAN = "key long, print long, row long, n_words long, sha binary, starts array<int>, ends array<int>, minimisers array<long>"
_RANGES = "key long, row long, lo int, hi int"
_PACKED = "minimiser long, key long, row long, start int, packed binary"


def _identity(sha: bytes, key: int) -> int:
    return int.from_bytes(hashlib.blake2b(sha + key.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)


def _ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _scanner(width: int, m: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches_of_bytes(batches, "text", 3 << 20):
            texts = [encoded(t) for t in batch.column("text").to_pylist()]
            keys = batch.column("key").to_pylist()
            shas = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts]
            hashes, at = word_hashes(texts)
            words = np.diff(at)
            least = slide_min(gram_hashes(hashes, m), width - m + 1)
            windows = np.maximum(words - width + 1, 0)
            doc, place = spread(windows)
            value = least[at[doc] + place] if len(doc) else np.empty(0, np.uint64)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            first = np.flatnonzero(new)
            stop = np.append(first[1:], len(doc))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[first], minlength=len(texts)))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("print"), pa.array([_identity(s, k) for s, k in zip(shas, keys, strict=True)], pa.int64()), pa.array(words, pa.int64()), pa.array(shas, pa.binary()),
                    _ragged(place[first], offsets, pa.int32()), _ragged(place[first] + (stop - first), offsets, pa.int32()), _ragged(value[first].view(np.int64), offsets, pa.int64()),
                ],
                ["key", "print", "row", "n_words", "sha", "starts", "ends", "minimisers"],
            )

    return scan


def _packer(width: int, windows: bool):
    """Packs the parts of each document: super-k-mers as strings, or their windows one by one as digests."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of_bytes(batches, "text", 2 << 20):
            out: list[tuple] = []
            for key, text, parts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "parts")), strict=True):
                words = encoded(text).split()
                row = _identity(hashlib.sha256(b" ".join(words)).digest(), key)
                for part in parts:
                    start, end, minimiser = part["start"], part["end"], part["minimiser"]
                    if windows:
                        out += [(minimiser, key, row, i, hashlib.blake2b(b" ".join(words[i : i + width]), digest_size=16).digest()) for i in range(start, end)]
                    else:
                        out.append((minimiser, key, row, start, b" ".join(words[start : end + width - 1])))
                    if len(out) > 20_000:
                        yield _rows(out)
                        out = []
            if out:
                yield _rows(out)

    return pack


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["minimiser", "key", "row", "start", "packed"])


def _windows(packed: bytes, width: int) -> Iterator[bytes]:
    blanks = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(packed)]
    for i in range(len(starts) - width + 1):
        yield packed[starts[i] : ends[i + width - 1]]


def _least_documents(strings: dict[bytes, int], width: int) -> dict[bytes, np.ndarray]:
    """For each packed string the least document of each of its windows, by sorting all windows of the bucket."""
    names = list(strings)
    counts = [s.count(b" ") + 2 - width for s in names]
    found = {s: np.full(n, LAST, np.int64) for s, n in zip(names, counts, strict=True)}
    passes = 1 + sum(counts) // SORTED
    for p in range(passes):
        rows = [(w, strings[s], k, i) for k, s in enumerate(names) for i, w in enumerate(_windows(s, width)) if passes == 1 or zlib.crc32(w) % passes == p]
        rows.sort()
        last, least = None, LAST
        for w, key, k, i in rows:
            if w != last:
                last, least = w, key
            found[names[k]][i] = least
    return found


def _bucket(width: int):
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for group in runs(batches, ["minimiser"]):
            keys = group.column("key").to_pylist()
            if min(keys) == max(keys):
                continue
            packed = group.column("packed").to_pylist()
            strings: dict[bytes, int] = {}
            for s, k in zip(packed, keys, strict=True):
                strings[s] = min(k, strings.get(s, LAST))
            found = _least_documents(strings, width) if len(strings) > 1 else None
            for s, key, row, start in zip(packed, keys, group.column("row").to_pylist(), group.column("start").to_pylist(), strict=True):
                if found is None:
                    if strings[s] < key:
                        out.append((key, row, start, start + s.count(b" ") + 1))
                    continue
                again = np.flatnonzero(found[s] < key)
                if len(again):
                    cuts = np.flatnonzero(np.diff(again) > 1)
                    for a, b in zip(again[np.append(0, cuts + 1)].tolist(), again[np.append(cuts, len(again) - 1)].tolist(), strict=True):
                        out.append((key, row, start + a, start + b + width))
            if len(out) > 50_000:
                yield _ranges(out)
                out = []
        if out:
            yield _ranges(out)

    return bucket


def _merger(width: int):
    """Ranges of words that the windows (key, row, starts in order) of each document cover."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, row, starts in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "starts")), strict=True):
                starts = np.array(starts)
                cuts = np.flatnonzero(np.diff(starts) > width)
                out += [(key, row, a, b + width) for a, b in zip(starts[np.append(0, cuts + 1)].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist(), strict=True)]
            if out:
                yield _ranges(out)

    return merge


def _ranges(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "row", "lo", "hi"])


def _keyed(docs: DataFrame) -> DataFrame:
    """key, print (a hash that tells texts of one key apart in joins; rows are then told apart exactly by row), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.xxhash64("text").alias("print"), "text")


def repeated_ranges(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER) -> tuple[DataFrame, DataFrame]:
    """Two tables of documents (doc_id, text). First, a row per row of docs: key (doc_id, a null as the largest long), row
    (identity of key and words), n_words, sha (of the words joined by one space), copy (whether an earlier document has
    the same `width` words or more). Second, ranges of words to cut, one row each: key, row, lo, hi. The first table also has print (see _keyed)."""
    spark = docs.sparkSession
    docs = _keyed(docs)
    scan = materialize(docs.mapInArrow(tidied(_scanner(width, m)), _SCAN))
    firsts = scan.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("rows"))
    firsts = firsts.where("rows > 1").select("sha", "first")  # others are the first of their words
    rows = scan.join(bounded(materialize(firsts)), "sha", "left").select("key", "print", "row", "n_words", "sha", F.coalesce((F.col("key") > F.col("first")) & (F.col("n_words") >= width), F.lit(False)).alias("copy"))
    rows = materialize(rows)
    scanned = scan.where(F.size("starts") > 0).join(bounded(materialize(rows.where("copy").select("row").distinct())), "row", "left_anti")
    parts = scanned.select("key", "print", F.expr("inline(arrays_zip(minimisers, starts, ends))")).toDF("key", "print", "minimiser", "start", "end")
    shared = parts.groupBy("minimiser").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = materialize(shared.select("minimiser", (F.col("n") > BUCKET).alias("hot")))
    travels = parts.join(bounded(shared), "minimiser").groupBy("key", "print", "hot").agg(F.collect_set(F.struct("start", "end", "minimiser")).alias("parts"))
    travels = materialize(travels)

    def packed(hot: bool) -> DataFrame:
        texts = beside(docs, travels.where(F.col("hot") == hot).drop("hot"))
        return texts.select("key", "text", "parts").mapInArrow(tidied(_packer(width, hot)), _PACKED)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = packed(False).repartition(n, "minimiser").sortWithinPartitions("minimiser").mapInArrow(tidied(_bucket(width)), _RANGES)
    if travels.where("hot").isEmpty():
        return rows, materialize(cold)
    windows = materialize(packed(True))
    again = materialize(windows.groupBy("packed").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("packed", "first"))
    hot = windows.join(bounded(again), "packed").where("key > first").groupBy("key", "row").agg(F.sort_array(F.collect_set("start")).alias("starts"))
    return rows, materialize(cold.unionByName(hot.mapInArrow(tidied(_merger(width)), _RANGES)))


def _cutter(digest: bool):
    """A function of text, key and the document's ranges (structs of row, lo, hi): words, words removed, and the checksum
    of what is kept, or with digest false the text that is kept."""

    def cut(texts: pa.Array, keys: pa.Array, ranges: pa.Array) -> pa.Array:
        out = []
        for text, key, spans in zip(texts, keys, ranges, strict=True):
            text, key = text.as_py(), key.as_py()
            words = encoded(text).split()
            spans = spans.as_py() or []
            drop = np.zeros(len(words), bool)
            if spans:
                row = _identity(hashlib.sha256(b" ".join(words)).digest(), key)
                for span in spans:
                    if span["row"] == row:
                        drop[span["lo"] : len(words) if span["hi"] is None else span["hi"]] = True
            removed = int(drop.sum())
            kept = b" ".join([w for w, d in zip(words, drop.tolist(), strict=True) if not d]) if removed or digest else b""
            if digest:
                out.append({"row": _identity(hashlib.sha256(b" ".join(words)).digest(), key), "n_removed": removed, "kept_sha256": hashlib.sha256(kept).hexdigest()})
            else:
                out.append(kept.decode("utf-8", "surrogatepass") if removed else text)
        kind = pa.struct([("row", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]) if digest else pa.string()
        return pa.array(out, kind)

    return arrow_column(cut, "row long, n_removed long, kept_sha256 string" if digest else "string", 3)


def _spans(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """key, print, spans: the ranges of each document."""
    prints = rows.select("row", "print").distinct()
    return materialize(ranges.join(prints, "row").groupBy("key", "print").agg(F.collect_list(F.struct("row", "lo", "hi")).alias("spans")))


def digests(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""
    return settled(lambda: _digests(docs, width, m), docs.sparkSession)


def _digests(docs: DataFrame, width: int, m: int) -> DataFrame:
    rows, ranges = repeated_ranges(docs, width, m)
    spans = _spans(rows, ranges)
    texts = beside(_keyed(docs), spans)
    cut = texts.select("key", _cutter(True)("text", "key", "spans").alias("cut")).select("cut.*").distinct()
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(cut, "row", "left").select(
        F.when(F.col("key") != LAST, F.col("key")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, width: int = WIDTH, m: int = MINIMISER) -> DataFrame:
    """docs with repeated windows cut from text: the words left are joined by one space; other texts stay as they are.
    All rows and columns stay; n_chars (if there) is that of the new text for rows that had something cut."""

    def find() -> DataFrame:
        rows, ranges = repeated_ranges(docs, width, m)
        whole = rows.where("copy").select("key", "row", F.lit(0).alias("lo"), F.lit(None).cast("int").alias("hi")).distinct()
        return _spans(rows, ranges.unionByName(whole)).toDF("__quern_key", "__quern_print", "__quern_spans")

    spans = settled(find, docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    same = (key == F.col("__quern_key")) & (F.xxhash64("text") == F.col("__quern_print"))
    changed = bounded(spans.select("__quern_key", "__quern_print"))  # other texts stay where they are
    clean, cut = docs.join(changed, same, "left_anti"), docs.join(changed, same, "left_semi")
    joined = cut.join(spans, same).withColumn("text", _cutter(False)("text", key, "__quern_spans"))
    if "n_chars" in docs.columns:
        old = docs.select("n_chars").dtypes[0][1]
        joined = joined.withColumn("n_chars", F.length("text").cast(old))
    return clean.unionByName(joined.select(*columns(docs)))
