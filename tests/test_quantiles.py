import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.functions import quantiles
from hourgrid.functions.quantiles import exact_quantiles, price_profile

POINTS = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def groups():
    draw = random.Random(5)
    return {
        "hot": [round(draw.gauss(40, 25), 4) for _ in range(6000)] + [0.0] * 3000,
        "one": [12.3456],
        "two": [-0.5, 10.25],
        "same": [7.77] * 50,
        "wide": [round(draw.uniform(-1000, 10000), 4) for _ in range(500)],
        "negative": [round(-draw.random(), 4) for _ in range(200)],
    }


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(g, Decimal(str(v))) for g, vs in groups().items() for v in vs]
    rows.append(("one", None))
    return spark.createDataFrame(rows, "g string, v decimal(12,4)").repartition(5)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_profile_equals_numpy(spark, frame, broadcast):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, broadcast)
    try:
        rows = price_profile(frame, ["g"], "v", POINTS, {"positive": lambda v: v > 0}).collect()
    finally:
        spark.conf.set(setting, before)
    result = {row.g: row for row in rows}
    for name, values in groups().items():
        row = result[name]
        assert row["count"] == len(values)
        assert row.positive == sum(v > 0 for v in values)
        assert float(row.min) == min(values) and float(row.max) == max(values)
        assert row.avg == pytest.approx(np.mean(values), abs=1e-9)
        if len(values) > 1:
            assert row.std == pytest.approx(np.std(values, ddof=1), abs=1e-6)
        else:
            assert row.std is None
        for point, fraction in POINTS.items():
            assert row[point] == pytest.approx(np.percentile(values, fraction * 100), abs=1e-9)


def test_whole_column(frame):
    every = [v for vs in groups().values() for v in vs]
    row = exact_quantiles(frame, [], "v", POINTS).first()
    for point, fraction in POINTS.items():
        assert row[point] == pytest.approx(np.percentile(every, fraction * 100), abs=1e-9)


def test_matches_builtin_on_doubles(spark):
    data = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), (F.rand(3) * 100 - 20).alias("v")
    )
    data = spark.createDataFrame(data.collect(), data.schema)
    ours = exact_quantiles(data, ["g"], "v", {"m": 0.37})
    builtin = data.groupBy("g").agg(F.percentile("v", 0.37).alias("b"))
    for row in ours.join(builtin, "g").collect():
        assert row.m == pytest.approx(row.b, abs=1e-9)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v decimal(12,4)")
    row = price_profile(empty, [], "v", {"m": 0.5}).first()
    assert row["count"] == 0 and row.m is None
    assert price_profile(empty, ["g"], "v", {"m": 0.5}).count() == 0
