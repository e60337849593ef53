from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import common
from quern.llm.common import columns, connected_components, gram_hashes, narrow, ranked, slide_min, word_hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\ncé", max_size=30), max_size=6))
def test_equal_words_have_equal_hashes(texts):
    data = [t.encode() for t in texts]
    hashes, at = word_hashes(data)
    words = [w for t in data for w in t.split()]
    assert len(hashes) == len(words) and np.diff(at).tolist() == [len(t.split()) for t in data]
    assert len(set(hashes.tolist())) == len(set(words))


def test_words_across_segments():
    long = (b"w" * 700 + b" ") * 4000 + b"z" * 3_000_000 + b" end"
    hashes, at = word_hashes([long, b"end"])
    assert at.tolist() == [0, 4002, 4003] and hashes[-1] == hashes[-2] and len(set(hashes[:4000].tolist())) == 1


def test_grams_and_minima():
    x = np.arange(60, dtype=np.uint64) % np.uint64(7)
    for n in (1, 2, 3, 5, 8, 13, 16):
        assert len(set(gram_hashes(x, n).tolist())) == 7 and len(gram_hashes(x, n)) == 61 - n
        assert slide_min(x, n).tolist() == [min(x[i : i + n]) for i in range(61 - n)]
    assert len(gram_hashes(x, 61)) == 0 and len(slide_min(x, 61)) == 0


def test_components_by_contraction_and_in_one_task(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5), (7, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    expected = {x: find(x) for x in root}
    df = spark.createDataFrame(edges, "a long, b long")
    for small in (0, 40, 10_000):
        assert {r[0]: r[1] for r in connected_components(df, small).collect()} == expected
    assert connected_components(df.limit(0)).collect() == []


def test_hubs_are_dealt(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, 1, id) as k")
    table = spark.range(300).selectExpr("id as k", "id * 2 as v")
    expected = sorted((r["k"], r["id"], r["k"] * 2) for r in rows.collect())
    for most in (0, 1 << 20):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        assert sorted(tuple(r) for r in common.dealt_join(rows, table, "k", 10).collect()) == expected


def test_scratch_tables_go_even_if_a_job_fails(spark):
    made = []

    def make():
        made.append(common.materialize(spark.range(3)))
        raise KeyError("no")

    with pytest.raises(KeyError):
        common.settled(make, spark)
    where = made[0].inputFiles
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|No such file"):
        made[0].collect()
    assert where and common._scope.get() is None and common.settled(lambda: common.materialize(spark.range(3)), spark).count() == 3


def test_threads_have_scopes_of_their_own(spark):
    from threading import Thread

    seen = []

    def job(n):
        def make():
            df = common.materialize(spark.range(n))
            common.settled(lambda: common.materialize(spark.range(1)), spark)
            return df

        seen.append((n, common.settled(make, spark).count()))

    threads = [Thread(target=job, args=(n,)) for n in (5, 6, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(seen) == [(5, 5), (6, 6), (7, 7)]


def test_no_temporary_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch(Session())


def test_ranks_are_gapless(spark):
    df = spark.range(500).selectExpr("id", "case when id % 7 = 0 then null else id % 3 end as p")
    got = {}
    for r in ranked(df, ["p"], ["id"], "n", 9, "id").collect():
        got.setdefault(r["p"], []).append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 500


def test_narrow_and_columns(spark):
    df = spark.range(5).selectExpr("id", "1 as `a.b`", "2 as `q``t`")
    assert narrow(df, "id", spark.range(2)).count() == 2 and df.select(*columns(df)).columns == ["id", "a.b", "q`t"]
