"""Source mixing and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import cache
from itertools import accumulate

import pytest

from quern.llm import mixing, sharding
from quern.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.conftest import odd_rows


def planned(spark, sizes, weights=(5, 2, 1), most=3):
    """Targets as the operator finds them, of sources named in order."""
    rows = spark.createDataFrame([(k, f"s{k:05}", n) for k, n in enumerate(sizes)], "k long, source string, source_size long")
    return [r["target"] for r in mixing.with_targets(rows, weights, most).orderBy("k").collect()]


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by filling step by step."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    full: set[int] = set()
    while True:
        open_ = [k for k in range(len(sizes)) if k not in full]
        left = sum(sizes) - sum(most * sizes[k] for k in full)
        level = left / sum(w[k] for k in open_) if open_ else 0
        more = {k for k in open_ if level * w[k] > most * sizes[k]}
        if not more:
            return [most * n if k in full else level * w[k] for k, n in enumerate(sizes)]
        full |= more


def test_targets_are_filled_by_weight(spark):
    for sizes in ([100, 100, 100], [10, 100, 100], [1, 1, 1000], [0, 0], [], [7, 0, 3, 900, 1, 2, 50]):
        assert planned(spark, sizes) == pytest.approx(filled(sizes))
    assert planned(spark, [10, 100, 100]) == pytest.approx([30, 120, 60])


def mixed(rows, weights=(5, 2, 1), most=3, block=4096, slots_least=2**17):
    """The mix by plain loops: taken words of each row, and its slots. rows of (doc_id, text, source)."""
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    per = [sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names]
    targets = filled(per, weights, most)
    block = max(1, min(block, sum(per) // slots_least))
    blocks = [max(1, -(-n // block)) for n in per]
    wanted = [int(t * b / n * 2**20 + 0.5) if n else 0 for t, b, n in zip(targets, blocks, per, strict=True)]
    slots = (sum(wanted) + 2**19) // 2**20
    bounds = list(accumulate(max(1, int(w / sum(wanted) * 2**32 + 0.5)) if w else 0 for w in wanted))
    seen, uses = Counter(), defaultdict(list)
    for i in range(slots):
        at = (i % 2**31 * mixing.GOLDEN % 2**31) * (bounds[-1] // 2) >> 30
        k = next(k for k, b in enumerate(bounds) if at < b)
        if seen[k] < most * blocks[k]:
            uses[k, seen[k] % blocks[k]].append(i)
        seen[k] += 1
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    taken, first = [0] * len(rows), [None] * len(rows)
    for k, name in enumerate(names):
        word = 0
        edges = [j * (per[k] // blocks[k]) + min(j, per[k] % blocks[k]) for j in range(blocks[k] + 1)]
        mine = [i for i, r in enumerate(rows) if r[2] == name]
        for i in sorted(mine, key=lambda i: digest(f"{'' if rows[i][0] is None else rows[i][0]}:{digest(rows[i][1] or '')}")):
            for _ in range(size[i]):
                spot = uses[k, bisect_right(edges, word) - 1]
                taken[i] += len(spot)
                first[i] = min([*spot, *([] if first[i] is None else [first[i]])], default=None)
                word += 1
    return names, per, targets, size, taken, first


@pytest.mark.parametrize(("block", "least"), [(4096, 2**17), (7, 10), (4096, 50)])
def test_odd_documents_are_mixed_as_by_plain_loops(odd, monkeypatch, block, least):
    monkeypatch.setattr(mixing, "SLOTS", least)
    monkeypatch.setattr(mixing, "STRETCH", 100)
    rows = [(r[0], r[1], r[3]) for r in odd_rows()]
    names, per, targets, size, taken, first = mixed(rows, block=block, slots_least=least)
    place = {n: k for k, n in enumerate(names)}
    expected = sorted(repr((rows[i][0], size[i], per[place[rows[i][2]]], taken[i], first[i])) for i in range(len(rows)))
    got = mixing.mix(odd, block=block).collect()
    assert sorted(repr((r["doc_id"], r["size"], r["source_size"], r["taken"], r["first_slot"])) for r in got) == expected
    for r in got:
        assert r["target"] == pytest.approx(targets[r["k"]]) and 0 <= r["taken"] <= 3 * r["size"]
    for k in range(len(names)):
        assert abs(sum(r["taken"] for r in got if r["k"] == k) - targets[k]) <= 4 * max(1, min(block, sum(per) // least))


def test_hot_ids_are_laid_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 10)
    rows = [(None, "a b c", "s"), (None, "a b c d", "s")] * 40 + [(i, "x y " * (i % 5), "s" if i % 2 else "t") for i in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    _, per, targets, *_ = mixed(rows)
    for k in (0, 1):
        assert abs(sum(r["taken"] for r in got if r["k"] == k) - targets[k]) <= 4
    assert len(got) == 130 and sum(r["size"] for r in got) == sum(per)


def test_the_schedule_decides(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "GOLDEN", 12345677)
    after = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.mix(docs).collect()}
    assert sum(before[i][0] != after[i][0] for i in before) >= 1 and sum(before[i][1] != after[i][1] for i in before) > 100


def test_schedule_keeps_weights_in_every_stretch(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 500)
    monkeypatch.setattr(mixing, "SLOTS", 1)
    sized = spark.createDataFrame([(str(k), 100_000) for k in range(3)], "source string, size long")
    sources, slots, width = mixing.planned(sized, block=100)
    rows = sorted(mixing.schedule(sources, slots, width).collect())
    assert [r["slot"] for r in rows] == list(range(3000)) == list(range(slots))
    for k, share in enumerate((0.625, 0.25, 0.125)):
        seen = 0
        for i, r in enumerate(rows):
            seen += r["k"] == k
            assert abs(seen - share * (i + 1)) < 4
        mine = [r for r in rows if r["k"] == k]
        assert [r["rank"] for r in mine] == list(range(len(mine))) and [r["block"] for r in mine] == [i % 1000 for i in range(len(mine))]


def test_many_sources_are_numbered_in_order(spark):
    names = [f"site{i}.example" for i in range(700)] + ["Ä", "é", "z😀", None, "", "Z"]
    sized = spark.createDataFrame([(n, 5) for n in names], "source string, size long").repartition(7)
    sources, slots, width = mixing.planned(sized)
    rows = sources.orderBy("k").collect()
    assert [r["source"] for r in rows] == [*sorted(n for n in names if n is not None), None] and [r["k"] for r in rows] == list(range(len(names)))
    assert rows[0]["lo"] == 0 and all(a["hi"] == b["lo"] for a, b in zip(rows, rows[1:], strict=False)) and rows[-1]["hi"] == width


def test_mixed_documents_repeat_and_cut_in_order(odd, nothing):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    got = out.collect()
    doses = mixing.mix(odd).collect()
    want = lambda rows: Counter({i: sum(n for j, n in rows if j == i) for i, _ in rows if True})
    assert want([(r["doc_id"], len(r["text"].encode().split())) for r in got]) == want([(r["doc_id"], r["taken"]) for r in doses if r["taken"]])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["doc_id"] is None for r in got) >= 2 and sum(r["doc_id"] == 13 for r in got) >= 2  # rows without an id, or of one id, keep their own passes
    slot = {r["doc_id"]: r["first_slot"] for r in doses}
    firsts = [slot[i] for i in dict.fromkeys(r["doc_id"] for r in got) if i not in (None, 13)]
    assert firsts == sorted(firsts)
    assert mixing.mixed_documents(nothing).collect() == [] and mixing.mix(nothing).collect() == []


def test_mix_matches_sql_and_reruns_agree(spark, same_rows):
    df = QUERIES["op4_mix_sources"](spark, SMALL)
    same_rows(df, ORACLES["op4_mix_sources"])
    assert sorted(df.collect()) == sorted(QUERIES["op4_mix_sources"](spark, SMALL).collect())


def check_law(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1 and set(counts) <= set(range(shards))
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_odd_documents_are_sharded_evenly(odd, nothing):
    rows = sharding.shard(odd).collect()
    check_law(rows, 24)
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in odd_rows())
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows) and sharding.shard(nothing).collect() == []
    check_law(sharding.shard(odd, shards=3).collect(), 3)


def test_groups_stay_together_as_far_as_quotas_allow(spark):
    rng = random.Random(3)
    texts = ["hot"] * 500 + [f"group {g}" for g in range(60) for _ in range(rng.randint(2, 9))]
    texts += [f"single {i}" for i in range(1500 - len(texts))]
    rng.shuffle(texts)
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=6).collect()
    check_law(rows, 6)
    where = defaultdict(Counter)
    for r in rows:
        where[texts[r["doc_id"]]][r["shard"]] += 1
    cut = sum(sum(c.values()) ** 2 - sum(n * n for n in c.values()) for t, c in where.items() if t != "hot")
    start = sum(sum(c.values()) ** 2 * 5 / 6 for t, c in where.items() if t != "hot")
    assert cut < 0.05 * start  # hash placement cuts five of six links
    assert len(where["hot"]) <= 4 and max(where["hot"].values()) >= 200  # 500 of 1500 rows, 250 a shard
    again = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), shards=6).collect()
    assert sorted(again) == sorted(rows)


def kept_pairs(spark, texts, shards):
    """Pairs of equal texts in one shard, and all pairs of equal texts, by text."""
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=shards).collect()
    check_law(rows, shards)
    where = defaultdict(Counter)
    for r in rows:
        where[texts[r["doc_id"]]][r["shard"]] += 1
    pairs = lambda n: n * (n - 1) // 2
    return {t: (sum(pairs(n) for n in c.values()), pairs(sum(c.values()))) for t, c in where.items()}


def most_pairs(groups, quota):
    """The most pairs of equal texts that shards of these sizes can keep, by trying all ways."""

    @cache
    def best(i, room):
        if i == len(groups):
            return 0
        found = 0

        def split(left, shard, rest, pairs):
            nonlocal found
            if shard == len(rest):
                if not left:
                    found = max(found, pairs + best(i + 1, tuple(sorted(rest))))
                return
            for n in range(min(left, rest[shard]) + 1):
                split(left - n, shard + 1, (*rest[:shard], rest[shard] - n, *rest[shard + 1 :]), pairs + n * (n - 1) // 2)

        split(groups[i], 0, room, 0)
        return found

    return best(0, tuple(sorted(quota)))


@pytest.mark.parametrize(("groups", "shards"), [((3, 3, 2, 2, 2), 3), ((6, 2, 2, 1, 1), 3), ((5, 4, 3), 2), ((2, 2, 2, 2, 1, 1, 1, 1), 4)])
def test_kept_pairs_come_near_the_most_there_can_be(spark, groups, shards):
    texts = [f"group {g}" for g, n in enumerate(groups) for _ in range(n)]
    kept = sum(a for a, _ in kept_pairs(spark, texts, shards).values())
    quota = [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]
    assert most_pairs(groups, quota) >= kept >= most_pairs(groups, quota) - 2


def test_groups_stay_together_when_all_rows_have_copies(spark):
    rng = random.Random(5)
    texts = [f"group {g}" for g in range(900) for _ in range(rng.randint(2, 9))]
    rng.shuffle(texts)
    kept = kept_pairs(spark, texts, 24)
    assert sum(a < b for a, b in kept.values()) <= 23  # a group at most at each end of a shard
    assert sum(a for a, _ in kept.values()) > 0.97 * sum(b for _, b in kept.values())


def test_a_group_of_a_third_of_all_rows_fills_whole_shards(spark):
    rng = random.Random(6)
    texts = ["hot"] * 1600 + [f"group {g}" for g in range(300) for _ in range(rng.randint(2, 9))]
    texts += [f"single {i}" for i in range(4800 - len(texts))]
    rng.shuffle(texts)
    kept = kept_pairs(spark, texts, 24)
    hot, others = kept.pop("hot"), list(kept.values())
    assert hot[0] >= 8 * (200 * 199 // 2)  # 8 shards of 200 rows, as many as there can be
    assert sum(a for a, _ in others) == sum(b for _, b in others)
