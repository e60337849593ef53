"""SentencePiece encoding and decoding with N-best segmentation: forward Viterbi scores serve as exact heuristics for a
backward A-star search over the piece lattice.

The pieces and their scores come from a SentencePiece model file; a segmentation's score is the sum of its pieces' scores.
A model of merge type has merge ranks in place of scores, and ranks can't be summed: three frequent pieces of low rank
would beat the whole word. A piece of rank r then scores -(PIECE_COST + ln(2 + r)), as if its frequency fell with the rank
by Zipf's law, with a cost for each piece; so few and early pieces win, which is near what merging does. The best
segmentation need not be the merge order's (the README has how often it is). Scores are rounded to multiples of 1 / STEPS, so that sums and ties are exact. As the
library does, a text gets a blank in front and blanks become word marks; a character without a piece falls back to its
UTF-8 bytes, at a score below all pieces. A word mark that stands in the text itself is also encoded by its bytes, so
that decoding gives back every text exactly.

The lattice falls apart where no piece of the model can reach across, as before each blank, and the N best of a text are put together from its units' best: only the N - 1 units whose second best costs
least can matter. Units are kept in a bounded cache, as words repeat. A model whose pieces cross blanks has whole texts as units.

Defined results: a null text has null ids and an empty text none; repeated rows are encoded alike.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_column, batches_of_bytes, bound_arrow, keep_until_others, make_room, share, tidied

MARK = "▁"
NBEST = 4
#: What a piece of a merge model costs beside its rank's logarithm, and the parts of one that scores are multiples of.
PIECE_COST, STEPS = 6.0, 1024
#: Bytes of each of a worker's two generations of remembered units, as `weigh` counts them.
CACHED = 32 << 20
_NONE = float("-inf")


def _unit_pattern(pieces: dict[str, tuple[int, float]]) -> str:
    """A pattern that cuts a text only where no piece can reach across: before blanks, if no piece has a blank behind
    another character, and around line ends and tabs that only stand alone."""
    if any(" " in p.lstrip(" ") for p in pieces):
        return r"(?s).+"
    alone = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces if len(p) > 1))
    return f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +"


#: Where pieces of the best segmentation give way to others: the first one's place, how many, and the ids instead.
Change = tuple[int, int, list[int]]


def changed(ids: list[int], changes: list[Change]) -> list[int]:
    """ids after the changes, which are in order."""
    out, at = [], 0
    for place, n, others in changes:
        out += [*ids[at:place], *others]
        at = place + n
    return out + ids[at:]


def weigh(unit: str, entry: bytes) -> int:
    """Bytes that a remembered unit takes, with its place in the dictionary."""
    return 2 * len(unit) + len(entry) + 190


class PieceModel:
    """Pieces, scores and byte pieces of a model file's bytes."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = sp.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[bytes] = [b""] * self.size
        self.byte_ids = [-1] * 256
        self.unknown = sp.unk_id()
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.bytes[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = piece.replace(MARK, " ")
                self.pieces[text] = (i, sp.get_score(i))
                self.bytes[i] = text.encode()
        ranks = {s for _, s in self.pieces.values() if s > -1e8}
        if len(ranks) > 1 and all(s <= 0 and s.is_integer() for s in ranks):  # merge ranks, negated
            worst = min(ranks)
            self.pieces = {p: (i, -(PIECE_COST + math.log(2 - max(s, worst)))) for p, (i, s) in self.pieces.items()}
        self.pieces = {p: (i, round(s * STEPS) / STEPS) for p, (i, s) in self.pieces.items()}
        self.penalty = min((s for _, s in self.pieces.values()), default=0.0) - 10.0
        # the score that an id adds to a segmentation: bytes and the unknown piece come from fallback only
        self.scores = np.full(self.size, self.penalty)
        for i, score in self.pieces.values():
            self.scores[i] = score
        self.units = re.compile(_unit_pattern(self.pieces))
        # a trie: each character leads to the characters behind it and the piece that ends with it, if any
        self.trie: dict[str, tuple[dict, tuple[int, float] | None]] = {}
        for piece, entry in self.pieces.items():
            below = self.trie
            for c in piece[:-1]:
                below = below.setdefault(c, ({}, None))[0]
            below[piece[-1]] = (below[piece[-1]][0] if piece[-1] in below else {}, entry)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def fallback(self, char: str) -> tuple[int, ...]:
        ids = tuple(self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,) if -1 in ids else ids

    def lattice(self, unit: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """The edges that end at each place (start, score, ids), and the best score of reaching it (forward Viterbi)."""
        n = len(unit)
        ending: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [_NONE] * n
        for start in range(n):
            if unit[start] not in self.pieces:
                ids = self.fallback(unit[start])
                ending[start + 1].append((start, self.penalty * len(ids), ids))
                best[start + 1] = max(best[start + 1], best[start] + self.penalty * len(ids))
            below, end = self.trie, start
            while end < n and (hit := below.get(unit[end])) is not None:
                below, found = hit
                end += 1
                if found is not None:
                    ending[end].append((start, found[1], (found[0],)))
                    best[end] = max(best[end], best[start] + found[1])
        return ending, best

    def nbest(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first, by A-star from the end; equal scores in the order of their finding.

        The heuristic is exact, so each open entry stands for a whole segmentation of just its score, and no two for the
        same. Entries behind the n best open ones can't be needed, and are dropped: the search holds n entries."""
        if not unit:
            return [(0.0, ())]
        ending, best = self.lattice(unit)
        count = 0
        queue: list = [(-best[-1], 0, len(unit), 0.0, None)]  # the best first; of equal scores the latest
        out: list[tuple[float, tuple[int, ...]]] = []
        while queue and len(out) < n:
            _, _, at, score, path = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                out.append((score, tuple(ids)))
                continue
            for start, s, ids in ending[at]:
                count -= 1
                insort(queue, (-(score + s + best[start]), count, start, score + s, (ids, path)))
            del queue[n - len(out) :]
        return out

    def unit(self, unit: str) -> bytes:
        """The unit's entry: what the second best costs more, negated, as a 32-bit float (so its bits are a negative number),
        then the best ids, as 32-bit integers. Forward Viterbi carries the two best scores of each place."""
        trie, n = self.trie, len(unit)
        first, second = [_NONE] * (n + 1), [_NONE] * (n + 1)
        back: list = [None] * (n + 1)
        first[0] = 0.0
        for start in range(n):
            x, y = first[start], second[start]
            below, end = trie, start
            hit = below.get(unit[start])
            if hit is None or hit[1] is None:
                ids = self.fallback(unit[start])
                s = self.penalty * len(ids)
                if x + s > first[start + 1]:
                    first[start + 1], second[start + 1], back[start + 1] = x + s, max(first[start + 1], y + s), (start, ids)
                elif x + s > second[start + 1]:
                    second[start + 1] = x + s
            while hit is not None:
                below, found = hit
                end += 1
                if found is not None:
                    s = found[1]
                    c = x + s
                    if c > first[end]:
                        s += y
                        second[end] = first[end] if first[end] > s else s
                        first[end] = c
                        back[end] = (start, found)
                    elif c > second[end]:
                        second[end] = c
                if end == n:
                    break
                hit = below.get(unit[end])
        ids = []
        at = n
        while at:
            at, found = back[at]
            if len(found) == 2 and type(found[1]) is float:
                ids.append(found[0])
            else:
                ids.extend(reversed(found))
        ids.reverse()
        entry = pack(f"<f{len(ids)}i", second[n] - first[n] or -0.0, *ids)
        self.remember(unit, entry)
        return entry

    def remember(self, unit: str, entry: bytes) -> None:
        """Two generations: when the younger is full it becomes the older, and what was in that is forgotten."""
        self.held += weigh(unit, entry)
        if self.held > CACHED:
            self.older, self.cache, self.held = self.cache, {}, weigh(unit, entry)
        self.cache[unit] = entry

    def seen(self, unit: str) -> bytes:
        entry = self.older.get(unit)
        if entry is None:
            return self.unit(unit)
        self.remember(unit, entry)
        return entry

    def encode(self, text: str, n: int = NBEST) -> tuple[np.ndarray, list[tuple[float, list[Change]]]]:
        """Ids of the best segmentation, and the n best, each as its score and its changes to the best (see Change)."""
        units = self.units.findall(" " + text) if text else []
        seen = self.seen  # the cache may be another dict after it
        flat = np.frombuffer(b"".join([self.cache.get(u) or seen(u) for u in units]), np.int32)
        ids = flat[flat >= 0]
        total = float(self.scores[ids].sum())
        ways: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        if n == 1 or not units:
            return ids, [(total, [])]
        heads = np.flatnonzero(flat < 0)  # an entry a unit, before the unit's ids
        cost = -flat[heads].view(np.float32)
        bound = np.partition(cost, min(n - 2, len(cost) - 1))[min(n - 2, len(cost) - 1)]
        if bound < 2**24 / STEPS:  # such costs are exact as floats
            near = np.argsort(cost, kind="stable")[: n - 1].tolist()
        else:  # costs are rounded: near the bound the exact ones decide
            near = np.flatnonzero((cost <= bound * (1 + 1e-6)) & np.isfinite(cost)).tolist()
        near = [p for p in near if np.isfinite(cost[p])]
        best = {u: self.nbest(u, n) for u in {units[p] for p in near}}
        exact = sorted((best[units[p]][0][0] - best[units[p]][1][0], p) for p in near)[: n - 1]
        for p in sorted(p for _, p in exact):
            found = best[units[p]]
            others = [(found[0][0] - s, x) for s, x in found[1:]]
            ways = sorted([*ways, *((c + d, w | {p: x}) for c, w in ways for d, x in others)], key=lambda w: w[0])[:n]
        ends = np.append(heads[1:], len(flat))
        return ids, [(total - c, [(int(heads[p]) - p, int(ends[p] - heads[p]) - 1, list(x)) for p, x in sorted(w.items())]) for c, w in ways]

    def nbest_ids(self, text: str, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text."""
        ids, ways = self.encode(text, n)
        return [(score, changed(ids.tolist(), changes)) for score, changes in ways]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the blank in front; bytes that aren't UTF-8 become replacement marks."""
        table = self.bytes
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def _loaded(digest: str, proto: bytes) -> PieceModel:
    make_room("pieces")
    keep_until_others("pieces", _loaded.cache_clear)
    return PieceModel(proto)


def load(path: str) -> bytes:
    """The bytes of a model file on the driver; they travel with the tasks, so executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def _loader(docs: DataFrame, proto: bytes):
    bound_arrow(docs.sparkSession)
    shared, digest = share(docs.sparkSession, proto), hashlib.sha256(proto).hexdigest()
    return lambda: _loaded(digest, shared.value)


_CHANGES = "array<array<struct<at: int, n: int, ids: array<int>>>>"
_CHANGES_ARROW = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def encode(docs: DataFrame, proto: bytes, nbest: int = NBEST) -> DataFrame:
    """doc_id, n_pieces, ids, nbest_scores (best first), nbest_changes (each segmentation as changes to ids, see Change;
    none for the best), round_trip (whether decoding gives the text) of every row."""
    model_of = _loader(docs, proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches_of_bytes(batches, "text", 1 << 20):
            ids, scores, changes, same = [], [], [], []
            for text in batch.column("text").to_pylist():
                if text is None:
                    for column in (ids, scores, changes, same):
                        column.append(None)
                    continue
                found, ways = model.encode(text, nbest)
                ids.append(found)
                scores.append([score for score, _ in ways])
                changes.append([[{"at": at, "n": n, "ids": x} for at, n, x in w] for _, w in ways])
                same.append(model.decode(found.tolist()) == text)
            none = np.array([x is None for x in ids])
            sizes = np.array([0 if x is None else len(x) for x in ids])
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0, np.int32)])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32(), mask=np.append(none, False))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int32(), mask=none), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())),
                    pa.array(scores, pa.list_(pa.float64())), pa.array(changes, _CHANGES_ARROW), pa.array(same, pa.bool_()),
                ],
                ["doc_id", "n_pieces", "ids", "nbest_scores", "nbest_changes", "round_trip"],
            )

    kind = f"doc_id long, n_pieces int, ids array<int>, nbest_scores array<double>, nbest_changes {_CHANGES}, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), kind)


def with_nbest_ids(encoded: DataFrame) -> DataFrame:
    """The rows of encode() with nbest_ids, the ids of each of the N best segmentations, written out."""
    step = "named_struct('out', concat(a.out, slice(ids, a.at + 1, c.at - a.at), c.ids), 'at', c.at + c.n)"
    whole = f"aggregate(w, named_struct('out', cast(array() as array<int>), 'at', 0), (a, c) -> {step}, a -> concat(a.out, slice(ids, a.at + 1, size(ids))))"
    return encoded.withColumn("nbest_ids", F.expr(f"transform(nbest_changes, w -> {whole})"))


def decoder(docs: DataFrame, proto: bytes):
    """The text of a column of ids, as a column function; null ids give null."""
    model_of = _loader(docs, proto)

    def run(ids: pa.Array) -> pa.Array:
        model = model_of()
        return pa.array([None if x is None else model.decode(x) for x in ids.to_pylist()], pa.string())

    return arrow_column(run, "string")
