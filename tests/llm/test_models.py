"""Fitted operators and searches: brute force where there is one, else what they get right on held-out rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.llm import chat, language, neighbours, quality, toxicity

from .conftest import CLASHING, text, with_clashes  # isort: skip

BAD = ["vileish", "vilely", "vileous", "nastyx", "nastyor"]


def labelled(spark, n=900):
    """Every third document is toxic: two words of a few, or rare forms of them, somewhere in ordinary text."""
    rows, marks = [], []
    for k in range(n):
        words = text(k, 30 + k % 50).split()
        bad = k % 3 == 0
        if bad:
            words[k % 20] = BAD[k % 5] if k % 2 else f"vile{k}"
            words[-1 - k % 9] = BAD[(k // 5) % 5]
        rows.append((k, " ".join(words)))
        marks.append((k, int(not bad or k % 2), int(bad)))
    rows += [(n, None), (n + 1, ""), (None, "a b"), (0, rows[0][1])]
    marks += [(None, 1, 1), (3, None, None), (n + 50, 1, 1), (6, 0, 1)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    return docs, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model).toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert ((found.score >= 0.3) == (found.predicted == 1)).all()
    held = found[found.held_out & found.doc_id.notna() & (found.doc_id < 900)]
    assert len(held) > 100 and ((held.doc_id % 3 == 0) == (held.predicted == 1)).mean() > 0.97
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == (found.predicted == 0).sum()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_never_reads_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    other = labels.withColumn("toxic", F.when(toxicity.fold() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.fit(docs, x)).toPandas().sort_values(["doc_id", "score"]).score for x in (labels, other))
    assert np.allclose(a, b)


def test_toxicity_of_one_class(spark):
    docs, labels = labelled(spark, 60)
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        found = toxicity.score(docs, toxicity.fit(docs, some)).toPandas()
        assert found.score.between(0, 1).all() and found.score.nunique() == 1


def vectors(spark, n=1500, size=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, size)) * rng.uniform(0.5, 2, (n, 1))
    x[100:400] = x[0]  # a group of copies
    rows = [(int(k), [float(v) for v in x[k]]) for k in range(n)]
    odd = [(n, None), (n + 1, [0.0] * size), (n + 2, [float("nan")] * size), (n + 3, [float("inf")] + [1.0] * (size - 1)), (n + 4, [1.0, 2.0]),
           (n + 5, [None] + [1.0] * (size - 1)), (None, rows[1][1]), (40, rows[40][1]), (n + 20, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(5)
    return df.withColumns({c: F.lit(1) for c in (*CLASHING, "id", "vector", "rank")}), x.astype(np.float32).astype(float)


def test_nearest_is_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 200)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    df, x = vectors(spark)
    found = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, 1.0).toPandas().sort_values(["query_id", "rank"])
    asked = np.arange(0, len(x), 20)
    assert found.query_id.nunique() == len(asked) and len(found) == 20 * len(asked)
    for q, rows in found.groupby("query_id"):
        s = x @ x[int(q)]
        want = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-round(s[k], 9), k))[:20]
        assert rows.vec_id.tolist() == want and rows["rank"].tolist() == list(range(1, 21))
        assert np.allclose(rows.score, s[want])


def test_nearest_prunes_and_keeps_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 300)
    df, x = vectors(spark)
    found = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, 2.0).toPandas()
    got = 0
    for q, rows in found.groupby("query_id"):
        s = x @ x[int(q)]
        s[int(q)] = -np.inf
        got += len(set(np.round(np.sort(s)[-20:], 9)) & set(np.round(rows.score, 9))) / len(set(np.round(np.sort(s)[-20:], 9)))
    assert got / found.query_id.nunique() > 0.9


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    found = [tuple(r) for r in neighbours.nearest(df, df.where("vec_id = 1"), 20).orderBy("rank").collect()]
    assert found == [(1, 1, 2, 0.5), (1, 2, 3, 0.0)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def chats(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None), (None, "end")]
    logs = {k: turns[:k] for k in range(1, 6)}
    logs |= {10 + k: turns[:k] for k in (2, 5)}  # copies
    logs |= {20: [("user", "hi"), ("assistant", "bye")], 21: [("user", "hi"), ("user", "hello"), ("user", "x")], None: [("user", "alone")], 30: [("user", "")]}
    rows = [(c, t, role, said) for c, own in logs.items() for t, (role, said) in enumerate(own)]
    rows += [(20, 1, "assistant", "bye"), (21, None, "user", "late")]  # a repeated row, a turn without number
    logs[21] = [*logs[21], ("user", "late")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("place", "low", "high", "n_turns", "of", "lines")}), logs


def test_chat(spark):
    df, logs = chats(spark)
    order = sorted(logs, key=lambda c: (c is None, c or 0))
    want = {}
    for c in order:
        own = logs[c]
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in logs.values())
        equal = [d for d in order if logs[d] == own]
        if not longer and equal[0] == c:
            want[c] = (len(own), len(equal), "".join(f"<|im_start|>{r or 'unknown'}\n{s or ''}<|im_end|>\n" for r, s in own))
    found = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.formatted(df).collect()}
    assert found == want
    assert chat.formatted(df.limit(0)).count() == 0


SAMPLES = {"en": "the quick fox is over the lazy dog and that was this", "de": "der schnelle fuchs ist über dem faulen hund und das war es", "fr": "le renard rapide est sur le chien et cela était là"}


def page(lang, said, declared=True, host="a.example.com"):
    tag = f'<html lang="{lang}">' if declared else "<html>"
    return f"http://{host}/x", f"{tag}<script>der die das und nicht</script><body>{said}</body></html>"


def test_language(spark):
    docs = spark.createDataFrame([(t, k) for k, t in SAMPLES.items() for _ in range(3)] + [(None, "en"), ("x", None)], "text string, lang string")
    rows = [page(k, t, host=f"{k}.example.org") for k, t in SAMPLES.items() for _ in range(30)]
    rows += [page("en", SAMPLES["de"], host="de.example.org"), page("fr", "", host="fr.example.org"), (None, None), ("", ""), ("nonsense", SAMPLES["fr"])]
    rows += [("http://fr.example.org/" + "y" * 50_000, "<html>" + SAMPLES["fr"] * 5000)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id bigint, url string, html string").repartition(3)
    pages = pages.withColumns({c: F.lit("z") for c in ("host", "lang", "logs", "share", "visible", "prior")})
    found = {r["page_id"]: r for r in language.identified(pages, docs).collect()}
    assert len(found) == len(rows)
    for i, k in enumerate(k for k in SAMPLES for _ in range(30)):
        assert found[i]["lang"] == k and found[i]["declared"] == k and found[i]["host"] == f"{k}.example.org"
    assert found[90]["text_lang"] == "de" and found[90]["lang"] == "de"  # the text against its markup
    assert found[91]["lang"] == "fr" and found[91]["text_lang"] is None  # no text: markup and host
    assert found[92]["host"] is None and found[92]["lang"] in SAMPLES and found[94]["lang"] == found[95]["lang"] == "fr"
    none = language.identified(pages, docs.limit(0)).collect()
    assert Counter(r["lang"] for r in none) == {None: len(rows)}
    assert language.identified(pages.limit(0), docs).count() == 0


def test_quality(spark):
    docs, labels = labelled(spark, 900)
    grades = quality.graded(labels)
    assert {r["grade"] for r in grades.collect()} == {0, 1, 2}
    assert grades.where("doc_id = 6").first()["grade"] == 0
    model = quality.fit(docs, grades)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2]
    found = quality.rated(docs, model).toPandas()
    assert len(found) == docs.count() and found.expected_grade.between(0, 2).all() and found.top_chance.between(0, 1).all()
    both = found[found.held_out].merge(grades.toPandas(), on="doc_id")
    assert both[both.grade == 2].expected_grade.mean() > both[both.grade < 2].expected_grade.mean() + 0.2
    assert quality.rated(docs.limit(0), model).count() == 0
    one = quality.fit(docs, grades.where("grade = 2"))
    assert one is None and quality.rated(docs, one).where("expected_grade is null").count() == docs.count()


@pytest.mark.parametrize("name", ["without", "llm"])
def test_entry_without_the_package(name, tmp_path):
    """The entry module finds its other queries where this package and the pipeline are missing."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for part in ("tillspark", "__spark_entry__.py"):
        source = root / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    if name == "without":
        for p in sorted((tmp_path / "tillspark/llm").rglob("*"), reverse=True):
            p.unlink() if p.is_file() else p.rmdir()
        (tmp_path / "tillspark/llm").rmdir()
    code = "import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('op')]), len(e.queries()) > 100)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split() == (["0", "True"] if name == "without" else ["10", "True"])
