"""Near-duplicate and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quern.llm import minhash, substring
from quern.llm.common import LAST
from quern.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import odd_rows


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, similarity=80):
    """Component of each key, by all pairs; rows of (key, text)."""
    sets = [(k, shingles(t, n)) for k, t in rows]
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= similarity * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


def test_odd_documents_group_as_by_brute_force(odd):
    # a row without an id is a document of its own here; such ids are beyond all others
    rows = [(LAST - k if r[0] is None else r[0], r[1]) for k, r in enumerate(odd_rows())]
    expected = components(rows, 4)
    got = minhash.near_duplicates(odd, n=4).collect()
    assert len(got) == len(rows)
    whole = sorted(((k if k < LAST - 1000 else -1, len(shingles(t, 4)), expected[k]) for k, t in rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, LAST if r.component_id is None else r.component_id) for r in got) == whole
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)


def test_a_cloud_of_near_copies_groups_as_by_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 4, 6, 9))):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        rows.append((i * 3 + 1, " ".join(words)))
    expected = components(rows, 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK", 40)  # clusters of several blocks
    monkeypatch.setattr(minhash, "PARTNERS", 30)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, n=5).collect()}
    assert got == expected and len(set(expected.values())) > 3
    kept = {r.doc_id for r in minhash.keep_first(df, n=5).collect()}
    assert kept == {k for k, c in expected.items() if k == c}


def test_keep_first_keeps_columns_and_one_of_repeated_rows(odd, nothing):
    kept = minhash.keep_first(odd, n=5)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(13) == 1 and ids.count(None) == 0 and 1 in ids and 2 not in ids and 9 in ids and 8 in ids
    assert minhash.keep_first(nothing).collect() == [] and minhash.near_duplicates(nothing).collect() == []


def test_one_of_a_group_without_ids_stays(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), "  ".join(words), " ".join(words[:-1]), " ".join(words), "alone here", "", None]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    kept = sorted(r["text"] or "" for r in minhash.keep_first(df).collect())
    assert len(kept) == 4 and kept[:2] == ["", ""] and kept[2] == "alone here" and kept[3].split()[:59] == words[:59]
    with pytest.raises(ValueError, match="below"):
        minhash.near_duplicates(spark.createDataFrame([(LAST - 5, "a b c")], "doc_id long, text string"))


def test_super_minhash_equals_the_sequential_algorithm():
    m, rng = 32, np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 5, 40, 400, 3000)]
    at = np.cumsum([0, *map(len, sets)])
    got = minhash.super_minhash(np.concatenate(sets), at, m)
    for values, signature in zip(sets, got, strict=True):
        expected = np.full(m, np.inf)
        for v in values:
            p = list(range(m))
            for j in range(m):
                r = minhash.mix(np.array([v]) + np.uint64((j * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
                k = j + int((int(r[0]) >> 40) * (m - j) >> 24)
                p[j], p[k] = p[k], p[j]
                expected[p[j]] = min(expected[p[j]], j + float(minhash.mix(r)[0]) / 2.0**64)
        assert np.array_equal(signature, expected)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    both, x, y = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 150, 150))
    s = minhash.super_minhash(np.concatenate((both, x, both, y)), np.array([0, 750, 1500]), 256)
    assert abs((s[0] == s[1]).mean() - 600 / 900) < 0.1
    assert np.isinf(minhash.super_minhash(np.empty(0, np.uint64), np.array([0, 0]), 8)).all()


def digests(rows, width):
    """Brute force of substring.digests; rows of (key, text)."""
    split = [(k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, w in split:
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            first[s] = min(k, first.get(s, LAST))
    out = []
    for k, w in split:
        drop = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < k:
                drop[i : i + width] = [True] * width
        out.append((k, len(w), sum(drop), hashlib.sha256(b" ".join(x for x, d in zip(w, drop, strict=True) if not d)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("width", "m"), [(50, 16), (20, 6), (3, 1)])
def test_odd_documents_lose_what_brute_force_removes(odd, width, m):
    rows = [(LAST if r[0] is None else r[0], r[1]) for r in odd_rows() if width > 3 or r[0] != 16]
    df = odd.where("doc_id is null or doc_id <> 16") if width == 3 else odd
    got = [(LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(df, width, m).collect()]
    assert sorted(got) == digests(rows, width)


def test_hot_minimisers_and_passes(spark, monkeypatch):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{rng.randrange(99)}" for _ in range(rng.randrange(9))] + passage + [f"b{rng.randrange(99)}" for _ in range(rng.randrange(9))])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket, held in ((5, 200_000), (0, 200_000), (50_000, 20)):
        monkeypatch.setattr(substring, "BUCKET", bucket)
        monkeypatch.setattr(substring, "SORTED", held)
        got = [tuple(r) for r in substring.digests(df, 20, 6).collect()]
        assert sorted(got) == digests(rows, 20)


def test_remove_repeats_keeps_rows_columns_and_clean_texts(odd, nothing):
    out = substring.remove_repeats(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    rows = {(r["row"]): r for r in out.collect()}
    for r in odd.collect():
        new = rows[r["row"]]
        assert new["text"] == r["text"] or len(new["text"].split()) < len(r["text"].split())
        assert new["n_chars"] == (r["n_chars"] if new["text"] == r["text"] else len(new["text"]))
    assert rows[1]["text"] == "" and rows[0]["text"] is not None  # the exact copy loses all
    assert substring.remove_repeats(nothing).collect() == [] and substring.digests(nothing).collect() == []


@pytest.mark.parametrize("name", ["op5_minhash_dedup", "op7_substring_dedup"])
def test_queries_match_sql(spark, same_rows, name):
    same_rows(QUERIES[name](spark, SMALL), ORACLES[name])
