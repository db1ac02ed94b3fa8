import datetime as dt
import random
from decimal import Decimal

import pytest

from hourgrid.operators import bx, rollups
from hourgrid.operators.zones import node_zone_map


def day_of(node, values, day=dt.date(2024, 1, 1)):
    return [(node, hour, value, day) for hour, value in enumerate(values, 1)]


def test_tie_takes_lower_hour(prices):
    frame = prices(day_of("a", [9, 8, 1, 7, 1, 2, 3]))
    row = bx.bx_daily(frame, [4]).first()
    assert (row.avg_price, row.min_hour, row.max_hour) == (Decimal("1.7500"), 3, 7)
    ranks = {r.opr_hr: r.hour_rank for r in bx.bx_hours(frame, [4]).collect()}
    assert ranks == {3: 1, 5: 2, 6: 3, 7: 4}


def test_short_day_has_no_bx_but_a_summary(prices):
    frame = prices(day_of("a", [3, 1, 2]))
    assert bx.bx_daily(frame).count() == 0
    assert bx.bx_hours(frame).count() == 0
    assert bx.bx_hours(frame, [6], require_full=False).count() == 3
    row = bx.node_daily_summary(frame).first()
    assert (row.total_hours, row.median_price, row.b6_avg_price) == (3, 2, 2)


def test_upper_median(prices):
    assert bx.node_daily_summary(prices(day_of("a", [1, 2, 3, 4]))).first().median_price == 3


def test_only_reachable_bx(prices):
    frame = prices(day_of("a", range(1, 7)))
    assert [r.bx_type for r in bx.bx_daily(frame).orderBy("bx_type").collect()] == [4, 5, 6]


def test_bx_rises_with_x_and_matches_brute_force(prices):
    draw = random.Random(1)
    values = {n: [draw.randint(-50, 200) for _ in range(24)] for n in "abc"}
    rows = [r for n, v in values.items() for r in day_of(n, v)]
    found = {(r.node, r.bx_type): r.avg_price for r in bx.bx_daily(prices(rows)).collect()}
    for node, series in values.items():
        for x in range(4, 11):
            mean = Decimal(sum(sorted(series)[:x])) / x
            assert abs(found[node, x] - mean) <= Decimal("0.00005")
        assert [found[node, x] for x in range(4, 11)] == sorted(
            found[node, x] for x in range(4, 11)
        )


def test_twenty_five_hours(prices):
    frame = prices(day_of("a", [50] * 24 + [-5]))
    hours = [r.opr_hr for r in bx.bx_hours(frame, [4]).orderBy("hour_rank").collect()]
    assert hours == [25, 1, 2, 3]
    assert bx.common_bx_hours(frame, 4).first().hours == [1, 2, 3]


@pytest.mark.parametrize("value", [3, 11])
def test_bx_out_of_range(prices, value):
    with pytest.raises(ValueError):
        bx.bx_daily(prices(day_of("a", [1] * 24)), [value])


def test_pooled_weighs_rows_and_counts_unmapped_in_overall(prices, mapping):
    rows = day_of("a", [10] * 4) + day_of("b", [20, 30]) + day_of("c", [70] * 5)
    zones = mapping([("a", "NP15"), ("b", "NP15"), ("c", None)])
    found = {
        r.node: r.avg_price
        for r in bx.bx_zone_pooled(prices(rows), zones, [4]).collect()
    }
    assert found == {
        "NP15": Decimal("15.0000"),
        "Overall": (Decimal(40 + 50 + 280) / 10).quantize(Decimal("0.0001")),
    }


def test_zone_of_means_differs_from_pooled(prices, mapping):
    rows = day_of("a", [1, 9, 1, 9, 5]) + day_of("b", [9, 1, 9, 1, 5])
    zones = mapping([("a", "SP15"), ("b", "SP15")])
    means = bx.bx_zone_of_means(prices(rows), zones, [4]).where("level = 'zone'").first()
    pooled = bx.bx_zone_pooled(prices(rows), zones, [4]).where("level = 'zone'").first()
    assert means.avg_price == 5 and pooled.avg_price == 4


def test_zone_hourly_overall_averages_zones(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, h, z, Decimal(p + h)) for z, p in (("NP15", 0), ("SP15", 10)) for h in range(1, 7)]
    frame = spark.createDataFrame(
        rows, "opr_dt date, hour_num int, zone string, lmp decimal(10,5)"
    )
    found = {r.node: r.avg_price for r in bx.bx_zone_hourly(frame, [4]).collect()}
    assert found == {"NP15": Decimal("2.5"), "SP15": Decimal("12.5"), "Overall": Decimal("7.5")}


def test_node_with_two_resources_keeps_the_zoned_one(spark):
    nodes = spark.createDataFrame(
        [("n1", "r1"), ("n1", "r2"), ("n1", "r2"), ("n2", "r3"), ("n3", "rx")],
        "pnode_id string, resource_id string",
    )
    zones = spark.createDataFrame(
        [("r1", "Not found"), ("r2", "ZP26"), ("r3", "")], "resource_id string, zone string"
    )
    found = {r.pnode_id: r.zone for r in node_zone_map(nodes, zones).collect()}
    assert found == {"n1": "ZP26", "n2": None, "n3": None}


def test_annual_average_divides_whole_days(spark):
    annual = spark.createDataFrame(
        [("a", 2023, 6, 5.0, 1.0, 9.0, 100), ("a", 2024, 6, 7.0, 2.0, 8.0, 4), ("b", 2024, 6, 9.0, 3.0, 12.0, 3)],
        "node string, year int, bx_type int, avg_price double, min_price double, "
        "max_price double, day_count long",
    )
    row = rollups.bx_annual_average(annual, 6).first()
    assert (row.year, row.avg_bx_price, row.min_bx_price, row.max_bx_price) == (2024, 8, 2, 12)
    assert (row.node_count, row.avg_days) == (2, 3)


def test_zero_average_is_reported(prices):
    daily = bx.bx_daily(prices(day_of("a", [0] * 5)))
    assert rollups.bx_average(daily, 4).first().avg_bx_price == 0


def test_zone_filter_needs_mapping(prices):
    with pytest.raises(ValueError):
        rollups.bx_average(bx.bx_daily(prices(day_of("a", [1] * 5))), 4, zone="NP15")


def test_weekly_periods_start_on_monday(prices):
    rows = [
        row
        for offset in range(14)
        for row in day_of("a", [offset] * 4, dt.date(2024, 1, 3) + dt.timedelta(offset))
    ]
    periods = rollups.bx_trend(bx.bx_daily(prices(rows)), 4, aggregation="weekly").collect()
    assert [r.period.weekday() for r in periods] == [0, 0, 0]
    assert [float(r.avg_price) for r in periods] == [2, 8, 12.5]


def test_unknown_grain(prices):
    with pytest.raises(ValueError):
        rollups.bx_trend(bx.bx_daily(prices(day_of("a", [1] * 4))), 4, aggregation="yearly")


def test_finished_dates_are_skipped(spark, prices):
    frame = prices(day_of("a", [1] * 4) + day_of("a", [2] * 4, dt.date(2024, 1, 2)))
    done = spark.createDataFrame([(dt.date(2024, 1, 1),)], "opr_dt date")
    assert [r.opr_dt.day for r in bx.node_daily_summary(frame, done).collect()] == [2]
