import datetime as dt
import statistics

import pytest

from hourgrid.operators import heatmaps, nodes, spikes, stats, topk


@pytest.fixture
def market(prices):
    rows = []
    for node, base in (("A_1", 20), ("B%2", 35), ("C_3", -5)):
        for day in (1, 2, 3):
            for hour in range(1, 25):
                rows.append((node, hour, base + (hour * 7 + day * 3) % 40, dt.date(2024, 1, day)))
    return prices(rows)


def test_market_summary_is_one_row(market):
    row, = stats.peak_offpeak_market(market).collect()
    assert row.peak is not None and row.peak_premium == pytest.approx(row.peak - row.off_peak, abs=0.011)
    assert stats.peak_offpeak_by_node(market).count() == 3


def test_statistics_are_ordered(market):
    for row in stats.price_statistics(market).collect():
        assert row["min"] <= row.p25 <= row["median"] <= row.p75 <= row.p95 <= row["max"]
        assert row["min"] <= row["mean"] <= row["max"]
    row, = stats.price_statistics(market, market_summary=True).collect()
    assert row["min"] < row["max"] and row["min"] <= row["mean"] <= row["max"]


def test_cheapest_hours_are_few_and_ascending(market):
    rows = [r.mw for r in topk.cheapest_hours(market, 5).collect()]
    assert len(rows) == 5 and rows == sorted(rows) and min(rows) > 0


def test_hours_of_the_day(market):
    assert stats.hourly_averages(market).count() == 24


def test_one_period_only_gives_no_row(prices):
    frame = prices([("a", h, 5) for h in range(7, 25)])
    assert stats.peak_offpeak_by_node(frame).count() == 0
    assert stats.peak_offpeak_market(frame).count() == 0


def test_zero_offpeak_has_no_percentage(prices):
    frame = prices([("a", 1, 5), ("a", 8, 0)])
    row = stats.peak_offpeak_by_node(frame, exclude_zero=False).first()
    assert (row.peak, row.off_peak, row.peak_premium_pct) == (5, 0, None)


def test_unknown_method(market):
    with pytest.raises(ValueError):
        stats.node_hourly_prices(market, "A_1", method="mode")


def test_congestion_needs_the_column(market):
    with pytest.raises(ValueError):
        stats.congestion_analysis(market)


def test_empty_market_summary(market):
    row = stats.price_statistics(market.where("mw > 1e6"), market_summary=True).first()
    assert row["count"] == 0 and row["mean"] is None


def test_search_takes_wildcards_literally(market):
    assert [r.node for r in nodes.search_nodes(market, "_").collect()] == ["A_1", "C_3"]
    assert [r.node for r in nodes.search_nodes(market, "%").collect()] == ["B%2"]
    assert [r.node for r in nodes.nodes_by_prefix(market, "a_").collect()] == ["A_1"]
    with pytest.raises(ValueError):
        nodes.nodes_by_prefix(market, "a")


def test_quality_counts_missing_components(market):
    row = stats.quality_report(market).first()
    assert row.total_records == 216 and row.missing_mcc == 216


def test_histogram_covers_everything(market, prices):
    rows = heatmaps.price_histogram(market, bins=7).collect()
    assert sum(r.records for r in rows) == 216
    assert all(r.bin_start < r.bin_end for r in rows)
    same = heatmaps.price_histogram(prices([("a", h, 3) for h in range(1, 9)])).collect()
    assert [(r.bin, r.records) for r in same] == [(0, 8)] + [(b, 0) for b in range(1, 30)]


def test_month_matrix_has_all_months(market, mapping):
    cells = heatmaps.month_hour_heatmap(market, mapping([("A_1", "NP15")]))
    matrix = heatmaps.pivot_month_hour(heatmaps.read_heatmap(cells, "NP15")).collect()
    assert [r.month for r in matrix] == list(range(1, 13))
    assert matrix[0].h1 is not None and matrix[5].h1 is None


def brute_spikes(rows, k, size=24):
    found = set()
    by_node = {}
    for node, hour, price, day in sorted(rows, key=lambda r: (r[3], r[1])):
        if price <= 0:
            continue
        series = by_node.setdefault(node, [])
        series.append(float(price))
        window = series[-size:]
        if len(window) > 1:
            deviation = statistics.stdev(window)
            if deviation > 0 and price > statistics.mean(window) + k * deviation:
                found.add((node, day, hour))
    return found


def test_spikes_cross_year_ends(prices):
    """Dense, sparse and skipped years must all see the rows before them."""
    import random

    draw = random.Random(11)
    rows = []
    for node, first, days, keep in (
        ("dense", dt.date(2020, 12, 20), 25, 1.0),
        ("sparse", dt.date(2019, 1, 1), 1500, 0.004),
        ("gap", dt.date(2018, 12, 31), 1, 1.0),
        ("gap", dt.date(2021, 1, 1), 2, 1.0),
    ):
        for offset in range(days):
            for hour in range(1, 25):
                if draw.random() < keep:
                    price = draw.choice([30, 31, 32, 33, -4, 0, 90, 140])
                    rows.append((node, hour, price, first + dt.timedelta(offset)))
    found = {
        (r.node, r.operational_date, r.operational_hour)
        for r in spikes.price_spikes(prices(rows), threshold_std=1.5).collect()
    }
    assert found == brute_spikes(rows, 1.5) and len(found) > 20


def test_constant_and_single_rows_are_no_spikes(prices):
    rows = [("same", h, 5) for h in range(1, 25)] + [("one", 1, 9)]
    assert spikes.price_spikes(prices(rows), threshold_std=0).count() == 0
