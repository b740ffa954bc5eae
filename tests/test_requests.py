"""Anomalies over supplied records: many requests together answer as each alone."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillspark.operators import isolation

SCHEMA = "request_id string, sensitivity double, records string"


def days(seed, n, spikes=3):
    r = np.random.default_rng(seed)
    values = r.normal(100, 5, n)
    values[r.choice(n, min(spikes, n), replace=False)] += 200
    return [{"date": f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}", "sales": round(float(v), 3)} for i, v in enumerate(values)]


REQUESTS = [("a", 0.05, days(1, 300)), ("b", 0.02, days(2, 120)), ("c", 0.1, days(3, 20)), ("large", 0.01, days(4, 900, 9)), ("flat", 0.05, [{"date": "2024-01-01", "sales": 5.0}] * 40)]


def frame(spark, requests):
    return spark.createDataFrame([(i, s, r if r is None or isinstance(r, str) else json.dumps(r)) for i, s, r in requests], SCHEMA).repartition(3)


def answers(df):
    return sorted(((r.request_id, r.status, r.days, r.total_anomalies, r.date, r.sales, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [50_000, 70])
def test_together_as_alone(spark, block):
    got = answers(isolation.detect(frame(spark, REQUESTS), trees=20, block=block))
    alone = [x for r in REQUESTS for x in answers(isolation.detect(frame(spark, [r]), trees=20))]
    assert got == sorted(alone, key=repr)
    flagged = {r[0]: [x for x in got if x[0] == r[0] and x[4]] for r in REQUESTS}
    assert all(len(v) == v[0][3] for v in flagged.values() if v) and not flagged["flat"]
    assert {x[2] for x in got} == {300, 120, 20, 900, 40}


def test_same_as_the_forest_of_one_table(spark):
    request, share, records = REQUESTS[0]
    rows = [(i, r["date"], r["sales"]) for i, r in enumerate(records)]
    one = spark.createDataFrame(rows, "place int, date string, sales double").withColumn("date", F.to_timestamp("date"))
    flagged = isolation.isolation_anomalies(one, ["sales"], ["date", "place"], contamination=share, trees=30).filter("anomaly = 1")
    expected = sorted((r.date.strftime("%Y-%m-%d"), r.sales, round(r.score, 9)) for r in flagged.collect())
    got = [(r.date, r.sales, round(r.score, 9)) for r in isolation.detect(frame(spark, [REQUESTS[0]]), trees=30).collect()]
    assert sorted(got) == expected and len(expected) > 3


def test_unusable_requests_and_default_rows(spark):
    odd = [("no field", 0.05, [{"date": "2024-01-01"}]), ("no date", 0.05, [{"date": "soon", "sales": 1.0}]), ("no json", 0.05, "{"), ("empty", 0.05, []),
           ("share", 0.9, days(1, 5)), ("nothing", None, days(1, 5)), ("null", 0.05, None), (None, 0.05, days(1, 5)), ("one", 0.05, days(1, 1))]
    status = {r.request_id: (r.status, r.total_anomalies) for r in isolation.detect(frame(spark, odd), trees=5).collect()}
    assert status == {"no field": ("bad_records", None), "no date": ("bad_records", None), "no json": ("bad_records", None), "empty": ("no_records", None),
                      "share": ("bad_sensitivity", None), "nothing": ("bad_sensitivity", None), "null": ("no_records", None), "one": ("ok", 0)}
    default = spark.createDataFrame([(r["date"], r["sales"]) for r in REQUESTS[1][2]], "date string, sales double").withColumn("date", F.to_timestamp("date"))
    got = answers(isolation.detect(frame(spark, [("b", 0.02, None), ("a", 0.05, days(1, 300))]), default, trees=20))
    want = answers(isolation.detect(frame(spark, [("b", 0.02, REQUESTS[1][2])]), trees=20))
    assert [x[:6] for x in got if x[0] == "b"] == [x[:6] for x in want]


def test_no_requests(spark):
    assert isolation.detect(spark.createDataFrame([], SCHEMA), trees=3).count() == 0
