import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASHING = ["n_words", "n_shingles", "component_id", "fp", "size", "score", "shard", "matched_n_words", "kept_id", "mix_epochs", "toxic_score", "key"]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Documents (doc_id, text, source) with every awkward case: nulls, blanks, ties, repeats, near copies, a very long text."""
    base, other, passage = text(1, 60), text(2, 80), text(3, 30)
    near = base.split()
    near[30] = "CHANGED"
    long = text(4, 30_000)
    rows = [
        (10, base, "a"), (11, base.upper().replace("CHANGED", "changed"), "a"), (12, " ".join(near), None), (13, None, "b"), (14, "", "b"),
        (15, " \t\n", None), (16, "one two", "a"), (17, "One two", "b"), (18, "one\x0btwo", "a"), (19, "ONE  two", "c"), (20, other, "c"),
        (20, other, "c"), (21, other + " " + passage, ""), (22, passage + "\n" + text(5, 40), "a"), (None, base, None), (None, None, None),
        (23, long, "b"), (24, long + " tail", "b"), (25, "Été été 日本", "a"), (26, "a a a a a a a a a a a a a a a a a a a a a a a a a a", "a"),
        (26, text(6, 25), "a"),
    ]
    return rows


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def messy(spark):
    return with_clashes(spark.createDataFrame(messy_rows(), "doc_id bigint, text string, source string").repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return with_clashes(spark.createDataFrame([], "doc_id bigint, text string, source string"))
