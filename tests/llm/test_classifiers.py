"""The quality and toxicity classifiers: held-out accuracy, odd rows, and the automaton against edit distances."""

from __future__ import annotations

import math
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import quality, toxicity

GOOD = "the of and to in that was for with his as on at by had not are but from or have an they which one you were her all".split()


def clean(rng, n):
    return " ".join(rng.choice(GOOD) + rng.choice(("", "", "ing", "ed")) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(800):
        text = clean(rng, rng.randint(20, 200))
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            text = "".join(w + rng.choice("#%$&") * 3 + " " for w in text.split()) if i % 8 else " | ".join(text.split())
        if toxic:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(("moron", "worthles", "pathetik", "idiot", "blorfed", "blorfing", "blorfy", "zwexx")))
            text = " ".join(words)
        rows.append((i, text, "en", f"src{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


@pytest.mark.parametrize(("scores", "column", "mod", "left"), [(quality.scores, 1, 4, 2), (toxicity.scores, 2, 5, 0)])
def test_held_out_accuracy(labelled, scores, column, mod, left):
    docs, labels, truth = labelled
    rows = {r["doc_id"]: r for r in scores(docs, labels).collect()}
    assert len(rows) == len(truth)
    right = total = 0
    for t in truth:
        r = rows[t[0]]
        assert r["held_out"] == (zlib.crc32(str(t[0]).encode()) % mod == left) and 0 <= r["score"] <= 1
        if r["held_out"]:
            total += 1
            right += r["predicted"] == t[column]
    assert total > 100 and right / total > 0.93


@pytest.mark.parametrize("scores", [quality.scores, toxicity.scores])
def test_held_out_labels_teach_nothing(spark, labelled, scores):
    docs, labels, _ = labelled
    name, mod, left = ("quality", 4, 2) if scores is quality.scores else ("toxic", 5, 0)
    other = labels.selectExpr("doc_id", *[f"case when crc32(cast(cast(doc_id as string) as binary)) % {mod} = {left} then 1 - {c} else {c} end as {c}" if c == name else c for c in ("quality", "toxic")])
    assert sorted(scores(docs, labels).collect()) == sorted(scores(docs, other).collect())


@pytest.mark.parametrize("scores", [quality.scores, toxicity.scores])
def test_odd_rows_and_missing_labels(odd, nothing, labelled, no_labels, scores):
    _, labels, _ = labelled
    for some in (labels, no_labels, labels.selectExpr("doc_id", "cast(null as int) as quality", "7 as toxic")):
        rows = scores(odd, some).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] is not None for r in rows)
    assert scores(nothing, labels).collect() == []


def test_keep_good_keeps_columns(odd, labelled):
    kept = quality.keep_good(odd, labelled[1].where("false"))
    assert kept.columns == odd.columns


def test_sample_is_bounded_and_repeatable(labelled):
    docs, labels, _ = labelled
    from pyspark.sql import functions as F

    rows = quality.sample(docs, labels, "quality", quality.held_out(F.col("_id"), (4, 2)), 50, 1 << 20)
    assert len(rows) == 100 and rows == quality.sample(docs.repartition(7), labels.repartition(5), "quality", quality.held_out(F.col("_id"), (4, 2)), 50, 1 << 20)
    assert sum(len(t) for t, _ in quality.sample(docs, labels, "quality", quality.held_out(F.col("_id"), (4, 2)), 50, 2000)) <= 2000


def test_a_long_text_does_not_crowd_out_its_label(spark, labelled):
    docs, labels, truth = labelled
    from pyspark.sql import functions as F

    # the row of least hash gets a text above all bounds
    least = labels.where("quality = 0 and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").orderBy(F.xxhash64(F.lit(11), "doc_id")).first()[0]
    long = docs.withColumn("text", F.when(F.col("doc_id") == least, F.repeat(F.lit("long text "), quality.MAX_BYTES // 9)).otherwise(F.col("text")))
    rows = quality.sample(long, labels, "quality", quality.held_out(F.col("_id"), (4, 2)), 50, quality.MAX_BYTES)
    assert [y for _, y in rows].count(0) == 50 == [y for _, y in rows].count(1) and max(len(t) for t, _ in rows) < 10_000
    for scores, column, mod, left in ((quality.scores, 1, 4, 2), (toxicity.scores, 2, 5, 0)):
        got = {r["doc_id"]: r for r in scores(long, labels).collect()}
        held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % mod == left and t[0] != least]
        assert sum(got[t[0]]["predicted"] == t[column] for t in held) / len(held) > 0.93


def test_one_text_of_a_repeated_id_teaches(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a longer text"), (1, "short"), (1, "short"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    assert sorted(quality.sample(docs, labels, "quality", F.lit(False), 10, 1 << 20), key=repr) == [("short", 1), (None, 0)]


def plain_quality(model, text):
    """The score of a text, step by step."""
    import zstandard

    data = (text or "").encode()
    parts = [data[i : i + quality.BLOCK] for i in range(0, len(data), quality.BLOCK)]
    size = {}
    for name, words in (("good", model.good), ("bad", model.bad), ("plain", b"")):
        extra = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        size[name] = sum(len(zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, **extra).compress(p)) for p in parts)
    x = [(size["bad"] - size["good"]) / (size["plain"] + quality.STEADY) if parts else 0.0, math.log(size["plain"] / (len(data) + 16 * len(parts))) if parts else math.log(0.5)]
    z = sum(w * (a - m) / s for w, a, m, s in zip(model.weights, x, model.means, model.scales, strict=False)) + model.weights[-1]
    return 1 / (1 + math.exp(-z))


def test_scores_are_those_of_the_model(odd, labelled):
    docs, labels, _ = labelled
    both = docs.unionByName(odd.selectExpr("coalesce(doc_id, 7) + 10000 as doc_id", "text", "lang", "source"))
    rows = both.select("doc_id", "text").collect()
    quality_model, toxic_model = quality.train(both, labels), toxicity.train(both, labels)
    got = sorted((r["doc_id"], round(r["score"], 9)) for r in quality.scores(both, labels).collect())
    assert got == sorted((i, round(plain_quality(quality_model, t), 9)) for i, t in rows)
    terms = toxic_model.lexicon.terms

    def near(word):  # by edit distances to all terms, without an automaton
        found = min(((distance(t, word), -w) for t, (w, most) in terms.items() if abs(len(t) - len(word)) <= most and distance(t, word) <= most), default=None)
        if found and not (found[0] and word in toxic_model.lexicon.harmless):
            return -found[1], found[0]
        return next(((toxic_model.lexicon.stems[word[:k]], 0) for k in range(1, len(word) + 1) if word[:k] in toxic_model.lexicon.stems), None)

    class Plain:
        def hits(self, words):
            return {w: h for w in words if len(w) < 100 and (h := near(w))}

    by_id = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, labels).collect()}
    model = toxicity.train(docs, labels)
    assert model.lexicon.terms == terms
    for i, t in rows[:150]:
        if i < 10_000:
            z = sum(w * x for w, x in zip(model.weights, toxicity.features(t, Plain()), strict=False)) + model.weights[-1]
            assert by_id[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=6), st.integers(0, 2), min_size=1, max_size=5), st.text(alphabet="abcd", max_size=8))
def test_automaton_finds_what_edit_distance_finds(terms, word):
    automaton = toxicity.Automaton(toxicity.Lexicon({t: (1.0, k) for t, k in terms.items()}))
    near = [distance(t, word) for t, k in terms.items() if distance(t, word) <= k]
    found = automaton.match(word)
    assert (found and found[1]) == (min(near) if near else None)


def test_quotation_and_abuse_are_told_apart():
    automaton = toxicity.Automaton(toxicity.Lexicon({"idiot": (2.0, 1)}, {"blorf": 3.0}))
    names = toxicity.NAMES
    quote = dict(zip(names, toxicity.features('he said the word "idiot" here', automaton), strict=True))
    abuse = dict(zip(names, toxicity.features("you are an idoit , you idiot !", automaton), strict=True))
    assert quote["quoted"] > 0 == quote["abusive"] and abuse["abusive"] > 0 == abuse["quoted"] and abuse["misspelled"] == 0 < abuse["exact"]
    assert automaton.match("blorfing") == (3.0, 0) and automaton.match("idiots") == (2.0, 1) and automaton.match("idle") is None
    assert toxicity.features(None, automaton) == [0.0] * len(names) == toxicity.features("", automaton)


def test_a_harmless_word_near_a_term_leaves_its_misspellings():
    rng = random.Random(9)
    toxic = [clean(rng, 20) + f" you {rng.choice(('moron', 'idiot', 'pathetic'))} !" for _ in range(100)]
    harmless = [clean(rng, 20) + (" oron" if i % 2 else " idiom" if i % 3 else " atheti") for i in range(100)]
    automaton = toxicity.Automaton(toxicity.learn_lexicon([(t, 1) for t in toxic] + [(t, 0) for t in harmless]))
    for word, e in {"moron": 0, "moran": 1, "morron": 1, "idot": 1, "pathetik": 1, "oron": None, "idiom": None, "atheti": None}.items():
        found = automaton.match(word)
        assert (found and found[1]) == e, word
