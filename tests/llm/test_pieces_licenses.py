"""SentencePiece N-best against enumeration and round trips; licence scans against a plain TF-IDF."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import licenses, pieces
from quern.llm.queries import PIECE_MODEL
from tests.llm.conftest import odd_rows

MODEL = pieces.PieceModel(pieces.load(PIECE_MODEL))


def every_way(text):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
            return
        if text[i] not in MODEL.pieces:
            extra = MODEL.fallback(text[i])
            go(i + 1, score + MODEL.penalty * len(extra), ids + extra)
        for end in range(i + 1, len(text) + 1):
            if text[i:end] in MODEL.pieces:
                piece, s = MODEL.pieces[text[i:end]]
                go(end, score + s, (*ids, piece))

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abthein .▁\n\té😀ß", max_size=8), st.integers(1, 6))
def test_n_best_as_by_enumeration(text, n):
    expected = every_way(" " + text)[:n] if text else [(0.0, ())]
    got = MODEL.nbest_ids(text, n)
    assert [s for s, _ in got] == [s for s, _ in expected]
    assert len({tuple(ids) for _, ids in got}) == len(got)
    for score, ids in got:
        assert MODEL.decode(ids) == text
        if text:
            assert any(tuple(ids) == w and s == score for s, w in every_way(" " + text))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, _ = MODEL.encode(text)
    assert MODEL.decode(ids.tolist()) == text


def test_plain_words_are_encoded_as_by_merging():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.load(PIECE_MODEL))
    words = "the international government would different people however development information university understanding".split()
    assert all(MODEL.encode(w)[0].tolist() == sp.encode(w) for w in words) and len(MODEL.encode("the")[0]) == 1
    found = re.findall(r"[^\W\d_]+", " ".join(t for _, t, *_ in odd_rows() if t and len(t) < 2000) + " " + (licenses.full_texts()[0][1]))
    same = sum(MODEL.encode(w, 1)[0].tolist() == sp.encode(w) for w in found)
    assert same > 0.8 * len(found)


def test_second_best_of_units_as_by_a_star():
    for unit in (" the", " internationalization", "\n", " x▁y", " aaaa", " Straße,", " q"):
        found = MODEL.nbest(unit, 2)
        entry = np.frombuffer(MODEL.unit(unit), np.int32)
        gap = -entry[:1].view(np.float32)[0]
        assert entry[0] < 0 and gap == np.float32(found[0][0] - found[1][0] if len(found) > 1 else math.inf)
        assert MODEL.scores[entry[1:]].sum() == found[0][0] and MODEL.decode([0, *entry[1:].tolist()][1:]) == unit[1:]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [r[1] for r in odd_rows() if r[1]]
    whole = [MODEL.encode(t)[0].tolist() for t in texts]
    monkeypatch.setattr(pieces, "CACHED", 1000)
    small = pieces.PieceModel(pieces.load(PIECE_MODEL))
    assert [small.encode(t)[0].tolist() for t in texts] == whole


def test_odd_documents_round_trip(odd, nothing, spark):
    proto = pieces.load(PIECE_MODEL)
    out = pieces.encode(odd, proto)
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        if r["ids"] is None:
            assert r["n_pieces"] is None and r["round_trip"] is None
        else:
            assert r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
    expected = Counter((tuple(ids), score) for _, t, *_ in odd_rows() if t for score, ids in map(lambda x: (x[0], x[1]), MODEL.nbest_ids(t)))
    written = pieces.with_nbest_ids(out).collect()
    assert Counter((tuple(ids), score) for r in written if r["ids"] for score, ids in zip(r["nbest_scores"], r["nbest_ids"], strict=True)) == expected
    assert all(r["nbest_ids"][0] == r["ids"] for r in written if r["ids"] is not None) and all(r["nbest_ids"] is None for r in written if r["ids"] is None)
    texts = [x[0] for x in out.select(pieces.decoder(out, proto)("ids")).collect()]
    assert Counter(texts) == Counter(r[1] for r in odd_rows())
    assert pieces.encode(nothing, proto).collect() == []


def plain_best(texts, unit):
    """Best licence and cosine of a unit, by TF-IDF over the texts."""
    tokens = lambda t: [m[0] for m in re.finditer(licenses.TERM, t.lower())]
    vocabulary = {w for _, t in licenses.TEMPLATES for w in tokens(t)}
    df = Counter(w for t in texts for w in set(tokens(t or "")) & vocabulary)
    n = len(texts)
    idf = lambda w: (math.log((n + 1) / (df[w] + 1)) if w in vocabulary else math.log((n + 1) / 2)) + 1

    def vector(t):
        return {w: c * idf(w) for w, c in Counter(tokens(t)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    u = vector(unit)
    return min((-round(cosine(u, vector(t)), 9), name) for name, t in licenses.TEMPLATES)


def all_matches(df, threshold):
    """Matches of df (file, text) by the operator's steps, for any threshold, without leaving out units."""
    words = licenses.vocabulary()
    templates = licenses._templates(df.sparkSession)
    known, other = licenses.term_weights(df.select(F.array_intersect(licenses.terms(F.coalesce("text", F.lit(""))), licenses._any_of(words)).alias("held")), templates)
    parts = licenses._parts(templates, known)
    return licenses.matches(df.where("text is not null"), parts, other, words, threshold), licenses.idle_terms(parts, licenses.THRESHOLD)


def test_units_match_as_by_plain_tf_idf(spark):
    texts = ["foo bar\n# Licensed under the Apache License, Version 2.0 or so\nbaz", "All rights reserved. 2020 Someone", "just words of the kind", None, "", "The license of the people", "copyright", "SPDX-License-Identifier: MIT"]
    df = spark.createDataFrame(list(enumerate(texts)), "file long, text string")
    found, _ = all_matches(df, 0.05)
    got = {(r["file"], r["kind"]): (r["license"], r["cosine"]) for r in found.where("kind <> 'paragraph'").groupBy("file", "kind").agg(F.max(F.struct("cosine", "license")).alias("m")).select("file", "kind", "m.*").collect()}
    for (i, kind), (name, value) in got.items():
        best = min(plain_best(texts, u) for u in (texts[i].split("\n") if kind == "line" else [texts[i]]))
        assert (name, value) == (best[1], pytest.approx(-best[0], abs=1e-8))
    assert {i for i, _ in got} >= {0, 1, 2, 5, 7}


def test_a_header_without_its_first_words_matches(spark):
    bsd = next(t for name, t in licenses.TEMPLATES if name == "BSD-3-Clause")
    rows = [("a/x.c", "Use " + bsd.split(" and use ")[1]), ("a/y.c", "words of prose with all that it may have")] + [(f"b/{i}", f"prose of the kind {i}") for i in range(30)]
    got = {r["path"]: r["own_license"] for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got.pop("a/x.c") == "BSD-3-Clause" and set(got.values()) == {None}


def test_no_match_is_lost_by_leaving_out_units(spark, monkeypatch):
    # a corpus so full of licence words that common words tell most
    texts = [t for _, t in licenses.TEMPLATES] * 3 + ["it is this and that", "use of a work by the author"]
    df = spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "file long, path string, text string")
    found, idle = all_matches(df, licenses.THRESHOLD)
    assert 0 < len(idle) < len(licenses.vocabulary())
    for words in (licenses.COMMON, frozenset(licenses.vocabulary()), idle):  # the second can't all be idle
        monkeypatch.setattr(licenses, "COMMON", words)
        got = licenses.scan(df.drop("file")).collect()
        assert sum(r["own_license"] is not None for r in got) == found.select("file").distinct().count()


def test_nearest_folder_with_a_licence_file_is_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("LICENSE", mit), ("a/b/COPYING", gpl), ("a/x.py", "code"), ("a/b/y.py", "code"), ("a/b/c/d/z.py", "code"), ("a/b/own.py", "# Licensed under CC BY 4.0.\ncode " + "more words here " * 30), ("top.py", None), (None, "text"), ("a/b/y.py", "code")]
    got = sorted((r["path"], r["license"], r["inherited_from"], r["license_file"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).na.fill({"inherited_from": "-"}).collect())
    assert got == sorted([
        ("LICENSE", "MIT", "-", True), ("a/b/COPYING", "GPL-3.0", "-", True), ("a/x.py", "MIT", "", False), ("a/b/y.py", "GPL-3.0", "a/b", False), ("a/b/y.py", "GPL-3.0", "a/b", False),
        ("a/b/c/d/z.py", "GPL-3.0", "a/b", False), ("a/b/own.py", "CC-BY-4.0", "-", False), ("top.py", "MIT", "", False), ("_", "MIT", "", False),
    ])


def test_odd_documents_are_scanned(odd, nothing):
    rows = licenses.scan_documents(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in odd_rows())
    assert {r["doc_id"] for r in rows if r["own_license"]} == {19} and licenses.scan_documents(nothing).collect() == []


def test_the_plan_is_native(odd):
    licenses.scan_documents(odd)
    assert "Python" not in licenses.scan_documents(odd.select("*", F.lit(1).alias("file")))._jdf.queryExecution().executedPlan().toString()


def test_full_licence_texts_stand_for_their_folders(spark):
    full = dict(licenses.full_texts())
    bsd = full["BSD-3-Clause"].replace("The Regents of the University of California", "Jane Doe").replace("the Regents of the University of California", "Acme")
    assert bsd != full["BSD-3-Clause"] and "All rights reserved." in bsd
    files = {**full, "BSD-3-Clause": bsd, "MIT": full["MIT"].replace("<year> <copyright holders>", "2020 Jane Doe")}
    rows = [(f"{name}/LICENSE", text) for name, text in files.items()] + [(f"{name}/src/x.py", "code") for name in files]
    rows += [("own/x.py", "# All rights reserved.\n# Licensed under CC BY 4.0.\n"), ("own/y.py", "# All rights reserved.\n" + "code " * 50)]
    rows += [(f"prose/{i}", "the license of the people and of the words in it that you may have for a work or any other " * 20) for i in range(5)]
    got = {r["path"]: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in files:
        assert (got[f"{name}/LICENSE"]["license"], got[f"{name}/LICENSE"]["license_file"]) == (name, True)
        assert (got[f"{name}/src/x.py"]["license"], got[f"{name}/src/x.py"]["inherited_from"]) == (name, name)
    assert got["own/x.py"]["license"] == "CC-BY-4.0" and got["own/y.py"]["license"] == "Proprietary"
    assert not any(got[f"prose/{i}"]["license_file"] for i in range(5))
