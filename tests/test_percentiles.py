"""Exact percentiles against numpy, by ranges cut into few parts so that several passes run."""

import random

import numpy as np
import pytest

from quillmill.operators.evaluate import latency_report
from quillmill.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("parts, ranked", [(4096, 10_000), (4, 3)])
def test_percentiles(spark, parts, ranked):
    r = random.Random(2)
    groups = {"a": [r.gauss(0, 1) for _ in range(501)], "b": [7.0] * 300, None: [1.0, 2.0], "c": [r.choice([0.0, 1.0, 1e300, -1e300]) for _ in range(200)], "d": [r.expovariate(1) ** 9 for _ in range(400)], "one": [3.5]}
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs] + [("a", None, 1), ("none", None, 1), ("a", float("nan"), 1)]
    df = spark.createDataFrame(rows, "k string, x double, share int").repartition(4)
    got = {(x.k, x.share): x.percentile for x in exact_percentiles(df, "x", (0.0, 0.5, 0.95, 0.99, 1.0), ("k",), parts, ranked).collect()}
    assert set(got) == {(k, s) for k in groups for s in (0.0, 0.5, 0.95, 0.99, 1.0)}
    for (k, s), v in got.items():
        place = s * (len(groups[k]) - 1)
        a, b = (sorted(groups[k])[int(f(place))] for f in (np.floor, np.ceil))
        assert v == pytest.approx(a * (1 - place % 1) + b * (place % 1), rel=1e-12)
    whole = exact_percentiles(df.where("k = 'a'"), "x", (0.5,), (), parts, ranked).collect()
    assert [tuple(x) for x in whole] == [(0.5, pytest.approx(np.median(groups["a"])))]
    assert exact_percentiles(df.limit(0), "x", (0.5,)).count() == 0


def test_report_of_all_requests(spark):
    df = spark.createDataFrame([(True, 1.0, 2.0), (True, 3.0, None), (False, 99.0, 1.0)], "success boolean, total_s double, llm_s double")
    row = latency_report(df, ("total_s", "llm_s")).first()
    assert (row.requests, row.total_s_p50, row.total_s_p95, row.llm_s_p99, row.total_s_max) == (3, 2.0, 2.9, 2.0, 3.0)
