"""The pipeline: each stage against its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from quern.llm import quality
from tests.conftest import SMALL
from tests.llm.test_classifiers import plain_quality
from tests.llm.test_mixing_sharding import mixed
from tests.llm.test_pieces_licenses import MODEL
from tests.llm.test_text_dedup import components


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect()}
    names, seen = [n for n, _ in corpus_pipeline.STAGES], [docs]
    assert len(names) == 5
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.materialize(stage(spark, seen[-1], SMALL)))
    assert all(df.columns == docs.columns and df.dtypes == docs.dtypes for df in seen[:-1])
    ids = [[r[0] for r in df.select("doc_id").collect()] for df in seen]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in set(ids[1]) for i in good) >= 0.95 * len(good)  # clean documents stay
    assert set(ids[5]) <= set(ids[4]) <= set(ids[3]) == set(ids[2]) <= set(ids[1]) < set(ids[0]) and len(ids[3]) == len(set(ids[3]))
    assert Counter(ids[4]) == Counter(ids[5]) and all(r["round_trip"] for r in seen[5].collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(ids[5])


def plain_cut(rows, width=50):
    """Texts of (key, text) rows without the windows that start in a smaller key."""
    split = {k: t.encode().split() for k, t in rows}
    first = {}
    for k in sorted(split):
        for i in range(len(split[k]) - width + 1):
            first.setdefault(tuple(split[k][i : i + width]), k)
    out = {}
    for k, t in rows:
        drop = set()
        for i in range(len(split[k]) - width + 1):
            if first[tuple(split[k][i : i + width])] < k:
                drop.update(range(i, i + width))
        out[k] = b" ".join(w for i, w in enumerate(split[k]) if i not in drop).decode() if drop else t
    return out


def test_the_pipeline_as_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.train(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if plain_quality(model, r[1]) >= 0.7]
    group = components([(i, t) for i, t, _ in rows], 5)
    rows = [r for r in rows if group[r[0]] == r[0]]
    texts = plain_cut([(i, t) for i, t, _ in rows])
    rows = [(i, texts[i], s) for i, _, s in rows]
    *_, size, taken, _ = mixed(rows)
    expected = Counter()
    for (i, t, _), n, left in zip(rows, size, taken, strict=True):
        while left > 0:
            text = t if left >= n else b" ".join(t.encode().split()[:left]).decode()
            expected[i, tuple(MODEL.encode(text)[0].tolist())] += 1
            left -= n
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == expected and sum(expected.values()) > 50


def test_odd_documents_and_empty_tables_go_through(spark, odd, nothing, tmp_path):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("doc_id > 1000")  # none of these: every score is 0.5 or the labels' share
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            rows = out.collect()
            assert name.startswith("SentencePiece") or (out.columns == docs.columns and out.dtypes == docs.dtypes)
            assert docs is odd or rows == []
            if docs is odd and name.startswith("SentencePiece"):
                assert len(rows) == odd.count()
    assert quality.keep_good(nothing, labels).collect() == []
