"""Toxicity by Levenshtein automata over a lexicon trie, with scores of the context windows.

The lexicon is a short list of common insults and the terms that labelled text teaches: words, and beginnings of words,
that are far more frequent in toxic documents. The automaton that accepts every term with up to so many edits is
intersected with the trie of the terms: its states are sets of (trie node, edits so far), made when a word first needs
them and kept, so a word costs one step a character and ends early where no term can be reached. Short terms allow no
edit, terms of 5 letters one, listed ones of 8 letters two. Words that come as near to a term but turn up in harmless labelled text, a
quarter as often as in toxic text or more, are harmless words of their own and no misspellings; all others stay within
the term's reach.

A hit's window of words says how it is used: quotation marks and words of reporting count as quotation; address to a
reader, exclamation and further hits count as abuse. Sums over the hits of a document go through a logistic calibration.

Labels are learned from a bounded sample (see quality.sample); every document is scored on its whole text, in one
narrow pass. The terms come from the whole sample. The calibration is fitted crosswise: either half's texts are described
by the terms that the other half teaches, so that no text is described by terms of its own.

Defined results: null and empty texts have no hits and get the score of a document without any. If the sample lacks a
label, terms come from the list alone and weights are fixed defaults.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_column, bound_arrow, make_room
from quern.llm.quality import held_out, logistic, sample, share_of_ones, shift

#: Common insults, words of reporting, words of address.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool", "jerk", "vermin", "imbecile")
REPORTING = frozenset("said says say wrote writes called calls quoted quote quotes reported word term dit appelé sagte nannte schrieb dijo llamó".split())
ADDRESS = frozenset("you your yours u ur du dich dein tu ton te toi vous tú usted tus".split())
QUOTES = frozenset("\"“”„«»‹›‘’'`")

MAX_ROWS, MAX_BYTES = 4000, 32 << 20
HELD_OUT = (5, 0)
WINDOW = 6
#: A learned term is in at least so many toxic documents and its log odds reach so much; a beginning has so many letters
#: at least, so many at most, and so many words.
SEEN, ODDS, STEM, STEM_MOST, STEM_WORDS = 3, 3.0, 4, 8, 3
#: The evidence of a learned term is beyond what chance gives the best of all candidates by so much.
MARGIN = 8.0
#: Words, and automaton states, that a worker keeps.
CACHED = 100_000
_WORDS = re.compile(r"[^\W_]+")
_TOKENS = re.compile(r"[^\W_]+|[\"“”„«»‹›‘’'`!]")


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


@dataclass
class Lexicon:
    """Terms with their weights and edits, beginnings of words (taken as they stand), and words that are no misspellings."""

    terms: dict[str, tuple[float, int]]
    stems: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()


class Automaton:
    """The lexicon's trie met with Levenshtein automata, made deterministic step by step."""

    def __init__(self, lexicon: Lexicon):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[tuple[float, int] | None] = [None]
        self.stem: list[float] = [0.0]
        self.allowed: list[int] = [0]  # most edits of a term below the node
        for word, (weight, most) in lexicon.terms.items():
            self.term[self._insert(word, most)] = (weight, most)
        for word, weight in lexicon.stems.items():
            self.stem[self._insert(word, 0)] = weight
        self.harmless = lexicon.harmless
        self._reset()
        self.words: dict[str, tuple[float, int] | None] = {}

    def _insert(self, word: str, most: int) -> int:
        node = 0
        self.allowed[0] = max(self.allowed[0], most)
        for c in word:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.term.append(None)
                self.stem.append(0.0)
                self.allowed.append(0)
            node = self.child[node][c]
            self.allowed[node] = max(self.allowed[node], most)
        return node

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # a left-out letter costs an edit and reads nothing
            node, e = todo.pop()
            for c in self.child[node].values():
                if e + 1 <= self.allowed[c] and nodes.get(c, 99) > e + 1:
                    nodes[c] = e + 1
                    todo.append((c, e + 1))
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            best = None
            for node, e in key:
                term = self.term[node]
                if term and e <= term[1] and (best is None or (e, -term[0]) < (best[1], -best[0])):
                    best = (term[0], e)
            self.accepts.append(best)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.sets[state]:
            child = self.child[node]
            if c in child and e <= max(self.allowed[child[c]], 0) and nodes.get(child[c], 99) > e:
                nodes[child[c]] = e
            if e + 1 <= self.allowed[node] and nodes.get(node, 99) > e + 1:
                nodes[node] = e + 1
            for x in child.values():
                if e + 1 <= self.allowed[x] and nodes.get(x, 99) > e + 1:
                    nodes[x] = e + 1
        return self._state(nodes) if nodes else -1

    def match(self, word: str) -> tuple[float, int] | None:
        """Weight and edits of the nearest term, or of a beginning (0 edits), or None."""
        if len(self.sets) > CACHED:
            self._reset()
        state = self.start
        for c in word:
            following = self.next[state].get(c)
            if following is None:
                following = self.next[state][c] = self._step(state, c)
            state = following
            if state < 0:
                break
        found = self.accepts[state] if state >= 0 else None
        if found and found[1] and word in self.harmless:
            found = None
        if found is None:
            node = 0
            for c in word:
                node = self.child[node].get(c, -1)
                if node < 0:
                    break
                if self.stem[node]:
                    return self.stem[node], 0
        return found

    def hits(self, words: set[str]) -> dict[str, tuple[float, int]]:
        known, out = self.words, {}
        if len(known) > CACHED:
            known.clear()
        for w in words:
            found = known[w] if w in known else known.setdefault(w, self.match(w))
            if found is not None:
                out[w] = found
        return out


NAMES = ("any", "strongest", "exact", "misspelled", "quoted", "abusive", "dense", "hits", "share")


def features(text: str | None, automaton: Automaton) -> list[float]:
    """Of a document's hits: whether there are any, the largest weight, weights of exact and of misspelled ones, hits in
    quotation, hits in abuse, hits a window at most, how many there are, and how many of a hundred words."""
    lower = (text or "").lower()
    words = _WORDS.findall(lower)
    hits = automaton.hits(set(words))
    if not hits:
        return [0.0] * len(NAMES)
    tokens = _TOKENS.findall(lower)
    at = [i for i, t in enumerate(tokens) if t in hits]
    exact = misspelled = quoted = abusive = 0.0
    dense = 0
    for k, i in enumerate(at):
        weight, e = hits[tokens[i]]
        window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        near = sum(1 for j in at[max(0, k - WINDOW) : k + WINDOW + 1] if abs(j - i) <= WINDOW)
        quotation = sum(t in QUOTES or t in REPORTING for t in window)
        abuse = sum(t in ADDRESS or t == "!" for t in window) + near - 1
        exact += weight * (e == 0)
        misspelled += weight * (e > 0)
        quoted += quotation > abuse
        abusive += abuse > quotation
        dense = max(dense, near)
    return [1.0, max(w for w, _ in hits.values()), math.log1p(exact), math.log1p(misspelled), math.log1p(quoted), math.log1p(abusive), math.log1p(dense), math.log1p(len(at)), math.log1p(100 * len(at) / len(words))]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: tuple[float, ...] = (1.0, 0.5, 1.0, 0.5, -0.5, 0.5, 0.5, 0.0, 0.0, -3.0)


def _evidence(a: int, b: int, n1: int, n0: int) -> tuple[float, float]:
    """Likelihood ratio (G) and log odds of a term in a of n1 toxic and b of n0 other documents."""
    n, k = n1 + n0, a + b
    g = 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in ((a, n1, k), (b, n0, k), (n1 - a, n1, n - k), (n0 - b, n0, n - k)) if o)
    return g, math.log((a + 0.1) / (n1 + 0.2) / ((b + 0.1) / (n0 + 0.2)))


def learn_lexicon(rows: list[tuple[str | None, int]]) -> Lexicon:
    """The listed insults, and the words and beginnings whose evidence outweighs the number of candidates tried."""
    n = Counter(y for _, y in rows)
    vocabulary = [(set(_WORDS.findall((t or "").lower())), y) for t, y in rows]
    words: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for found, y in vocabulary:
        words[y].update(found)
    tried = [w for w, k in words[1].items() if k >= SEEN and len(w) > 2]
    least = 2 * math.log(max(2, len(tried))) + MARGIN
    terms = {w: (2.0, edits(w)) for w in INSULTS if words[0][w] <= words[1][w]}
    for w in tried:
        g, odds = _evidence(words[1][w], words[0][w], n[1], n[0])
        if g >= least and odds >= ODDS:
            terms[w] = (odds, edits(w) if w in INSULTS else min(1, edits(w)))
    below: dict[str, set[str]] = defaultdict(set)
    for w in words[1]:
        if w not in terms or terms[w][0] != 2.0:
            for k in range(STEM, min(len(w), STEM_MOST + 1)):
                below[w[:k]].add(w)
    stems: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for found, y in vocabulary:
        stems[y].update({w[:k] for w in found for k in range(STEM, min(len(w), STEM_MOST + 1)) if w[:k] in below})
    tried = [s for s, k in stems[1].items() if k >= SEEN and len(below[s]) >= STEM_WORDS]
    least = 2 * math.log(max(2, len(tried))) + MARGIN
    scored = sorted(((*_evidence(stems[1][s], stems[0][s], n[1], n[0]), s) for s in tried), key=lambda x: (-x[0], x[2]))
    chosen: dict[str, float] = {}
    for g, odds, s in scored:
        if g >= least and odds >= ODDS and not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen[s] = odds
    # words near a term that are as frequent in harmless text are no misspellings of it
    automaton = Automaton(Lexicon({w: t for w, t in terms.items() if t[1]}))
    lengths = {len(w) + k for w, (_, most) in terms.items() if most for k in range(-most, most + 1)}
    near = (w for w in sorted(words[0]) if len(w) in lengths and w not in terms and automaton.match(w))
    harmless = frozenset(w for w in near if words[0][w] / (n[0] + 1) * 4 > words[1][w] / (n[1] + 1))
    return Lexicon(terms, chosen, harmless)


def fit(rows: list[tuple[str | None, int]], share: float | None = None) -> ToxicityModel:
    """The model of the rows; share is that of label 1 among all labels, of which the rows may hold another."""
    if len({y for _, y in rows}) < 2:
        return ToxicityModel(learn_lexicon([]))
    # a text counts once: copies would make their chance words look telling
    parts = {y: list(dict.fromkeys(r for r in rows if r[1] == y)) for y in (0, 1)}
    halves = [parts[0][k::2] + parts[1][k::2] for k in (0, 1)]
    lexicon = learn_lexicon(halves[0] + halves[1])
    described: list[tuple[list[float], float]] = []
    for mine, other in (halves, halves[::-1]):
        if len({y for _, y in other}) == 2:
            automaton = Automaton(learn_lexicon(other))
            described += [(features(t, automaton), float(y)) for t, y in mine]
    y = np.array([y for _, y in described])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(lexicon)
    weights = logistic(np.array([x for x, _ in described]), y, 1e-4)
    weights[-1] += shift(y, share)
    return ToxicityModel(lexicon, tuple(weights.tolist()))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    bound_arrow(docs.sparkSession)
    held = held_out(F.col("_id"), HELD_OUT)
    return fit(sample(docs, labels, "toxic", held, max_rows, max_bytes), share_of_ones(labels, "toxic", held))


def scorer(model: ToxicityModel):
    """The score of a text column, as a column function."""
    automata: list[Automaton] = []  # made once a worker

    def score(texts: pa.Array) -> pa.Array:
        if not automata:
            make_room()
            automata.append(Automaton(model.lexicon))
        w = np.array(model.weights)
        x = np.array([features(t.as_py(), automata[0]) for t in texts]).reshape(-1, len(NAMES))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35))), pa.float64())

    return arrow_column(score, "double")


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits: int) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    model = train(docs, labels, **limits)
    scored = docs.select("doc_id", held_out(F.col("doc_id"), HELD_OUT).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
