"""Quality classifier by compression: zstandard dictionaries are built from good and from bad labelled text, every text is
compressed with either, and the normalised difference of the compressed sizes becomes a calibrated score.

A text is compressed in blocks of fixed size, all of them, so that the dictionary and not the text's own beginning decides
what is cheap. Difference and logarithm of the plain compression rate (repetitive text is cheap under any dictionary) go through a
logistic calibration fitted on labelled rows that the dictionaries haven't seen.

Labels are learned from a bounded sample: of the labelled rows, those of least hash, at most `max_rows` of each label and
`max_bytes` of text; a text that doesn't fit is passed over for the next. The sample and the share of label 1 among all labels that may teach decide the model; every row is scored on its whole text, in one narrow pass.

Defined results: null and empty texts get the score of the calibration at no difference. A row without a label is scored
like any other; labels other than 0 and 1, and null ids among the labels, teach nothing. If the sample lacks one of the
labels, every score is the share of label 1 in it (0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_column, bound_arrow, encoded, make_room

BLOCK = 1024
DICTIONARY = 448 << 10
LEVEL = 3
#: Bytes added to the size that differences are taken relative to, so that a few bytes of a short text decide little.
STEADY = 64
MAX_ROWS = 2000
MAX_BYTES = 16 << 20
HELD_OUT = (4, 2)


@dataclass(frozen=True)
class QualityModel:
    """The two dictionaries and the calibration; a few hundred KB whatever the corpus."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **options) if dictionary else zstandard.ZstdCompressor(**options)


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad, self.plain = _compressor(good), _compressor(bad), _compressor(b"")

    def __call__(self, text: bytes) -> tuple[float, float]:
        """Difference of the compressed sizes over the plain compressed size, and the logarithm of the plain compression rate."""
        if not text:
            return 0.0, float(np.log(0.5))
        parts = _blocks(text)
        good, bad, plain = (sum(len(c.compress(p)) for p in parts) for c in (self.good, self.bad, self.plain))
        return (bad - good) / (plain + STEADY), float(np.log(plain / (len(text) + 16 * len(parts))))


def _dictionary(texts: list[bytes]) -> bytes:
    """The trained dictionary of the blocks of the texts; of few blocks, their end as it stands."""
    parts = [p for t in texts for p in _blocks(t) if len(p) >= 64]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> np.ndarray:
    """Weights (the last one a constant) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _telling(texts: list[bytes], common: set[bytes]) -> list[bytes]:
    """The texts without the lines that others have, too: shared lines tell nothing of quality."""
    return [t for t in (b"\n".join(x for x in t.split(b"\n") if x not in common) for t in texts) if t]


def shift(y: np.ndarray, share: float | None) -> float:
    """What to add to a constant that was fitted on labels y, for a corpus with that share of label 1."""
    if share is None:
        return 0.0
    share, mine = min(max(share, 1e-3), 1 - 1e-3), float(y.mean())
    return float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))


def share_of_ones(labels: DataFrame, label: str, held_out: Column) -> float | None:
    """The share of label 1 among the labels that may teach."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).where(~held_out)
    return known.agg(F.avg("_label")).collect()[0][0]


def fit(rows: list[tuple[str | None, int]], share: float | None = None) -> QualityModel:
    """Dictionaries from the rows at even places, calibration on those at odd ones; share is that of label 1 among all
    labels, of which the rows may hold another."""
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1) if rows else 0.5
    flat = QualityModel(b"", b"", (0.0, 0.0, float(np.log(share / (1 - share)))), (0.0, 0.0), (1.0, 1.0))
    if len({y for _, y in rows}) < 2:
        return flat
    parts: dict[int, tuple[list[bytes], list[bytes]]] = {}
    for y in (0, 1):
        texts = list(dict.fromkeys(encoded(t) for t, label in rows if label == y and t))
        parts[y] = texts[::2], texts[1::2] or texts
    if not parts[0][0] or not parts[1][0]:
        return flat
    lines = Counter(x for y in (0, 1) for t in parts[y][0] for x in set(t.split(b"\n")))
    common = {x for x, n in lines.items() if n > 1}
    good, bad = (_dictionary(_telling(parts[y][0], common) or parts[y][0]) for y in (1, 0))
    sizes = _Sizes(good, bad)
    x = np.array([sizes(t) for y in (0, 1) for t in parts[y][1]])
    y = np.concatenate([np.full(len(parts[y][1]), float(y)) for y in (0, 1)])
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = logistic((x - means) / scales, y)
    weights[-1] += shift(y, share)
    return QualityModel(good, bad, tuple(weights.tolist()), tuple(means.tolist()), tuple(scales.tolist()))


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int, max_bytes: int) -> list[tuple[str | None, int]]:
    """At most max_rows (text, label) rows of each label and max_bytes / 2 of its text, the least hashes first; a text of
    more than an eighth of these bytes, or than is left of them, is passed over for the next. Of several texts of one id
    the shortest is taken.

    Labels are picked first, then sizes are looked up, then the texts of the rows that fit: the picked ids are few, so
    they are broadcast to the scans, and no text but those of the sample leaves its partition."""
    picked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).where(~held_out)
    picked = picked.groupBy("_id").agg(F.max("_label").alias("_label")).withColumn("_order", F.xxhash64(F.lit(11), "_id"))
    # twice the rows, as an id can lack a document
    few = [picked.where(F.col("_label") == y).orderBy("_order", "_id").limit(2 * max_rows) for y in (0, 1)]
    print_ = F.xxhash64("text")
    found = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), F.col("doc_id") == F.col("_id"))
    found = found.select("_id", "_label", "_order", F.struct(F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), print_.alias("print")).alias("text"))
    rows = sorted(found.groupBy("_label", "_order", "_id").agg(F.min("text").alias("text")).collect())
    chosen: list[tuple] = []
    for y in (0, 1):
        n, left = 0, max_bytes // 2
        for _, _, i, (size, mark) in (r for r in rows if r["_label"] == y):
            if n < max_rows and size <= min(left, max_bytes // 16):
                chosen.append((i, mark))
                n, left = n + 1, left - size
    if not chosen:
        return []
    wanted = docs.sparkSession.createDataFrame(chosen, f"_id {labels.select('doc_id').dtypes[0][1]}, _print long")
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), (F.col("doc_id") == F.col("_id")) & (print_ == F.col("_print")))
    text = dict(texts.groupBy("_id").agg(F.min("text")).collect())
    return [(text[r["_id"]], r["_label"]) for r in sorted(rows, key=lambda r: (r["_order"], r["_id"])) if r["_id"] in text]


def held_out(doc_id: Column, held: tuple[int, int]) -> Column:
    """Whether the checksum of the id, as text, leaves the held-out remainder; a null id is held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % held[0] == held[1], F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> QualityModel:
    bound_arrow(docs.sparkSession)
    held = held_out(F.col("_id"), HELD_OUT)
    return fit(sample(docs, labels, "quality", held, max_rows, max_bytes), share_of_ones(labels, "quality", held))


def scorer(model: QualityModel):
    """The score of a text column, as a column function."""
    sizes_of: list[_Sizes] = []  # made once a worker

    def score(texts: pa.Array) -> pa.Array:
        if not sizes_of:
            make_room()
            sizes_of.append(_Sizes(model.good, model.bad))
        w, means, scales = np.array(model.weights), np.array(model.means), np.array(model.scales)
        x = np.array([sizes_of[0](encoded(t.as_py())) for t in texts]).reshape(-1, 2)
        z = ((x - means) / scales) @ w[:-1] + w[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))), pa.float64())

    return arrow_column(score, "double")


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = train(docs, labels, **limits)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **limits: int) -> DataFrame:
    """The rows of docs whose score reaches the threshold."""
    model = train(docs, labels, **limits)
    return docs.withColumn("__quern_score", scorer(model)("text")).where(F.col("__quern_score") >= threshold).drop("__quern_score")
