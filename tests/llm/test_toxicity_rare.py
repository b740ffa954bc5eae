import pyarrow as pa
from pyspark.sql import functions as F

from tillspark.llm import toxicity

from .conftest import text  # isort: skip


def test_expressions_seen_a_few_times_are_evidence(spark):
    """Six toxic documents hold a fixed phrase, so its inner bigram has one context; no other document holds its words."""
    ids = spark.range(400).withColumn("fold", toxicity.fold("id"))
    fitting = sorted(r["id"] for r in ids.where("fold < 2 and id % 2 = 0").collect())[:6]
    docs = [(k, text(k, 40) + (" qxzz wvkk" if k in fitting else "")) for k in range(400)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    model = toxicity._model(docs, toxicity._sample(labels, docs, (0, 1), 4000))
    rare, unseen = toxicity._features(pa.array(["qxzz wvkk", "neverone nevertwo"]), model)
    assert (rare > unseen + 0.05).all()
