"""The pipeline's stages, each against what its decision means on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tillspark.llm import mixing, toxicity

from .test_text_operators import brute_components, brute_hits


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_toxicity(spark, kept):
    model = toxicity.fit(kept[0], spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = toxicity.score(kept[0], model).where("predicted = 0")
    assert Counter(r["doc_id"] for r in good.collect()) == Counter(d for d, _ in rows(kept[1]))


def test_one_of_each_group(kept):
    groups = brute_components(rows(kept[1]))
    want = {c for _, n, c in groups if n} | {d for d, n, _ in groups if not n}
    assert Counter(d for d, _ in rows(kept[2])) == Counter(want)


def test_decontamination(spark, kept):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = [h[0] for h in brute_hits(rows(kept[2]), items) if not h[5]]
    assert Counter(clean) == Counter(d for d, _ in rows(kept[3]))


def test_mix(kept):
    taken = Counter()
    for r in kept[4].collect():
        taken[r["source"]] += len((r["text"] or "").encode().split())
    longest = Counter()
    for r in kept[3].collect():
        longest[r["source"]] = max(longest[r["source"]], len((r["text"] or "").encode().split()))
    goal = {r["source"]: r["target"] for r in mixing.mixed_words(kept[3]).join(kept[3].select("doc_id", "source"), "doc_id").collect()}
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in goal)


def test_shards(spark, kept):
    placed = kept[5].collect()
    assert Counter(r["doc_id"] for r in placed) == Counter(d for d, _ in rows(kept[4]))
    for s in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed)))


def test_run_is_the_stages(spark, kept):
    assert corpus_pipeline.run(spark, SF_DIR).count() == kept[5].count()
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("rows", [0, None])
def test_awkward_and_empty_tables(spark, tmp_path, rows):
    """Nulls, blanks, repeats, ties, a very long text and columns that clash with names of the operators; and no rows at all."""
    from .conftest import messy_rows, with_clashes

    docs = with_clashes(spark.createDataFrame(messy_rows()[:rows], "doc_id bigint, text string, source string")).withColumn("lang", F.lit(None).cast("string"))
    labels = [(i, 1, int(i % 4 == 0)) for i in (10, 11, 12, 16, 17, 20, 21, 25)] + [(None, None, None), (999, 0, 1)]
    items = [(1, messy_rows()[12][1][:400]), (2, None), (None, ""), (2, "one two")]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels[: None if rows is None else 0], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items[: None if rows is None else 0], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
        sizes.append(at.count())
    assert sizes == [0] * 5 if rows == 0 else sizes[0] >= sizes[1] >= sizes[2] > 0
