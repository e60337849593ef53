"""Documents with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, `row` long, `bucket` int, `size` string, `a.b` int, `words` int, `class` int"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_rows() -> list[tuple]:
    rng = random.Random(4)
    base = sentence(rng, 120)
    passage = sentence(rng, 70)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, sentence(rng, 30) + "\n" + passage + "\t" + sentence(rng, 30)), (6, passage), (7, sentence(rng, 3) + " " + passage),
        (8, ""), (9, None), (10, " \t\n "), (None, base), (None, passage + " end"), (11, "one"), (12, "one"), (13, "one two three"), (13, "one two three"), (14, "x" * 300_000),
        (15, " ".join(["again"] * 5000)), (16, sentence(rng, 20_000)), (17, "Éàü ß　wide ▁ mark 😀 \u0085 \x1c end"), (18, "say \"you idiot\" !!"), (19, "Released under the MIT License."), (20, passage + " " + passage),
    ]
    return [(i, t, "en" if k % 3 else None, None if k % 5 == 0 else f"src{k % 4}", None if t is None else len(t), "k", k, 1, None, k, k, 1) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
