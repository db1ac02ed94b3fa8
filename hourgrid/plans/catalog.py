"""Every query by name: how Spark computes it and the SQL that checks it.

``@query(name, sql)`` registers a function of :class:`Tables`. The SQL runs on
the same tables in another engine; both sides show fractions with four decimals.
"""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from hourgrid.functions import sketches
from hourgrid.functions.periods import date_spine, date_window
from hourgrid.functions.rounding import round_all
from hourgrid.operators import bx, bx_sums, cleaning, heatmaps, nodes, rollups, spikes, stats, topk, zones
from hourgrid.plans import jobs, ledger, summaries
from hourgrid.plans.projections import Tables
from hourgrid.schemas import ZONE_HEADERS
from hourgrid.session import cut_lineage, scratch_path
from hourgrid.sources import archives, bucketed, columns, csv_files, node_index, store
from hourgrid.streaming import ingest

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(build):
        def run(spark, folder):
            return round_all(build(Tables(spark, folder)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return build

    return register


# ---------------------------------------------------------------- SQL fragments


def r(value, digits=4):
    return f"CAST(ROUND(CAST({value} AS DECIMAL(20,{digits + 4})),{digits}) AS DOUBLE)"


def r2(value):
    return r(value, 2)


def pct(value, fraction):
    return f"quantile_cont(CAST({value} AS DOUBLE), {fraction})"


ZONE = (
    "CASE r.r_name WHEN 'AFRICA' THEN 'NP15' WHEN 'AMERICA' THEN 'SP15' "
    "WHEN 'ASIA' THEN 'ZP26' END"
)
DENSE = f"""
prices AS (
  SELECT n.n_name AS node, max({ZONE}) AS zone, CAST(e.ts AS DATE) AS opr_dt,
         CAST(hour(e.ts) + 1 AS INT) AS opr_hr,
         min(CAST(CASE WHEN e.value < 5 THEN 0 ELSE e.value - 10 END AS DECIMAL(12,4))) AS mw,
         min(CAST(e.value - 40 AS DECIMAL(12,4))) AS mcc,
         min(CAST(e.value - 5 AS DECIMAL(12,4))) AS mlc,
         min(CAST(CASE WHEN e.value > 60 THEN e.value END AS DECIMAL(12,4))) AS pos
  FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25
                JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY n.n_name, CAST(e.ts AS DATE), CAST(hour(e.ts) + 1 AS INT))"""
_LONG_DAY = (
    "CAST(CAST(date_trunc('month', l.l_shipdate) AS DATE) + (l.l_linenumber - 1) AS DATE)"
)
_ITEM_HOUR = "CAST(l.l_orderkey % 24 + 1 AS INT)"
LONG = f"""
prices AS (
  SELECT r.r_name AS node, max({ZONE}) AS zone, {_LONG_DAY} AS opr_dt, {_ITEM_HOUR} AS opr_hr,
         min(CAST(l.l_extendedprice / 100 AS DECIMAL(12,4))) AS mw
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
                  JOIN nation n ON n.n_nationkey = s.s_nationkey
                  JOIN region r ON r.r_regionkey = n.n_regionkey
  GROUP BY r.r_name, {_LONG_DAY}, {_ITEM_HOUR})"""
WIDE = f"""
prices AS (
  SELECT s.s_name AS node, max({ZONE}) AS zone,
         CAST(date_trunc('month', l.l_shipdate) AS DATE) AS opr_dt, {_ITEM_HOUR} AS opr_hr,
         min(CAST(l.l_extendedprice / 100 AS DECIMAL(12,4))) AS mw
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
                  JOIN nation n ON n.n_nationkey = s.s_nationkey
                  JOIN region r ON r.r_regionkey = n.n_regionkey
  GROUP BY s.s_name, CAST(date_trunc('month', l.l_shipdate) AS DATE), {_ITEM_HOUR})"""
MAPPING = f"""
mapping AS (
  SELECT s.s_name AS pnode_id, r.r_regionkey AS resource_id, {ZONE} AS zone
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey
                  JOIN region r ON r.r_regionkey = n.n_regionkey)"""
BX = "bx_values(bx_type) AS (VALUES (4),(5),(6),(7),(8),(9),(10))"
RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY node, opr_dt ORDER BY mw, opr_hr) AS rn,
         count(*) OVER (PARTITION BY node, opr_dt) AS n
  FROM prices)"""


def stored(value):
    return f"CAST(ROUND(CAST({value} AS DECIMAL(20,8)),4) AS DECIMAL(12,4))"


def _daily_cte(average):
    return f"""
daily AS (
  SELECT node, max(zone) AS zone, opr_dt, bx_type, {average} AS avg_price,
         min(opr_hr) AS min_hour, max(opr_hr) AS max_hour
  FROM ranked JOIN bx_values ON rn <= bx_type AND n >= bx_type
  GROUP BY node, opr_dt, bx_type)"""


DAILY = f"{BX}, {RANKED}, {_daily_cte(stored('avg(mw)'))}"
DAILY_EXACT = f"{BX}, {RANKED}, {_daily_cte('avg(mw)')}"


def pooled(source):
    return f"""{source}, {BX}, {RANKED},
zone_daily AS (
  SELECT 'zone' AS level, zone AS node, opr_dt, bx_type, {stored('avg(mw)')} AS avg_price
  FROM ranked JOIN bx_values ON rn <= bx_type WHERE zone IS NOT NULL
  GROUP BY zone, opr_dt, bx_type
  UNION ALL
  SELECT 'overall', 'Overall', opr_dt, bx_type, {stored('avg(mw)')}
  FROM ranked JOIN bx_values ON rn <= bx_type
  GROUP BY opr_dt, bx_type)"""


def of_means(source):
    return f"""{source}, {BX},
hourly AS (
  SELECT zone, opr_dt, opr_hr, avg(mw) AS price FROM prices WHERE zone IS NOT NULL
  GROUP BY zone, opr_dt, opr_hr
  UNION ALL
  SELECT 'Overall', opr_dt, opr_hr, avg(mw) FROM prices GROUP BY opr_dt, opr_hr),
hour_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY zone, opr_dt ORDER BY price, opr_hr) AS rn
  FROM hourly),
zone_bx AS (
  SELECT zone, opr_dt, bx_type, avg(price) AS avg_price
  FROM hour_ranks JOIN bx_values ON rn <= bx_type GROUP BY zone, opr_dt, bx_type)"""


BX_STATS = (
    f"{r('avg(avg_price)')} AS avg_bx_price, {r('min(avg_price)')} AS min_bx_price, "
    f"{r('max(avg_price)')} AS max_bx_price"
)
DENSE_FROM, DENSE_TO = dt.date(2024, 1, 5), dt.date(2024, 1, 25)
JAN = "opr_dt BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'"
THREE_NODES = ["NATION_3", "NATION_7", "NATION_20"]
THREE = "node IN ('NATION_3','NATION_7','NATION_20')"
TWO_LONG = ["ASIA", "EUROPE"]
TWO = "node IN ('ASIA','EUROPE')"
IN_1997 = "opr_dt BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"


# ------------------------------------------------------------------ statistics


@query(
    "cheapest_operational_hours",
    f"""WITH {DENSE} SELECT opr_hr, {r2('avg(mw)')} AS avg_price, count(*) AS records,
    count(DISTINCT node) AS unique_nodes FROM prices WHERE mw > 0
    GROUP BY opr_hr ORDER BY avg_price, opr_hr LIMIT 5""",
)
def _(t):
    return stats.cheapest_operational_hours(t.dense())


@query(
    "cheapest_operational_hours_all_prices",
    f"""WITH {DENSE} SELECT opr_hr, {r2('avg(mw)')} AS avg_price, count(*) AS records,
    count(DISTINCT node) AS unique_nodes FROM prices WHERE {JAN}
    GROUP BY opr_hr ORDER BY avg_price, opr_hr LIMIT 8""",
)
def _(t):
    return stats.cheapest_operational_hours(
        t.dense(), 8, DENSE_FROM, DENSE_TO, exclude_zero=False
    )


_STATS = f"""count(*) AS count, {r2('avg(mw)')} AS mean, {r2(pct('mw', 0.5))} AS median,
    {r2('stddev_samp(mw)')} AS std, {r2('min(mw)')} AS min, {r2('max(mw)')} AS max,
    {r2(pct('mw', 0.25))} AS p25, {r2(pct('mw', 0.75))} AS p75, {r2(pct('mw', 0.95))} AS p95"""


@query(
    "price_statistics",
    f"WITH {DENSE} SELECT node, {_STATS} FROM prices WHERE mw > 0 GROUP BY node",
)
def _(t):
    return stats.price_statistics(t.dense())


@query(
    "price_statistics_wide",
    f"WITH {WIDE} SELECT node, {_STATS} FROM prices WHERE mw > 0 GROUP BY node",
)
def _(t):
    return stats.price_statistics(t.wide())


@query(
    "price_statistics_market",
    f"WITH {DENSE} SELECT 'MARKET_SUMMARY' AS node, {_STATS} FROM prices WHERE mw > 0",
)
def _(t):
    return stats.price_statistics(t.dense(), market_summary=True)


@query(
    "node_price_statistics",
    f"""WITH {DENSE} SELECT node, count(*) AS record_count, {r('avg(mw)')} AS avg_price,
    {r('min(mw)')} AS min_price, {r('max(mw)')} AS max_price, {r('stddev_samp(mw)')} AS std_price,
    {r(pct('mw', 0.25))} AS p25, {r(pct('mw', 0.5))} AS median, {r(pct('mw', 0.75))} AS p75,
    {r(pct('mw', 0.95))} AS p95 FROM prices GROUP BY node""",
)
def _(t):
    return stats.node_price_statistics(t.dense())


@query(
    "hourly_averages",
    f"""WITH {DENSE} SELECT opr_hr AS hour, {r2('avg(mw)')} AS mw, {r2(pct('mw', 0.5))} AS median,
    {r2('stddev_samp(mw)')} AS std FROM prices WHERE mw > 0 GROUP BY opr_hr""",
)
def _(t):
    return stats.hourly_averages(t.dense())


@query(
    "hourly_averages_wide",
    f"""WITH {WIDE} SELECT opr_hr AS hour, {r2('avg(mw)')} AS mw, {r2(pct('mw', 0.5))} AS median,
    {r2('stddev_samp(mw)')} AS std FROM prices WHERE mw > 0 GROUP BY opr_hr""",
)
def _(t):
    return stats.hourly_averages(t.wide())


@query(
    "hourly_stats_raw",
    f"""WITH {DENSE} SELECT opr_hr, {r('avg(mw)')} AS avg_price, {r('stddev_samp(mw)')} AS std_price,
    count(*) AS record_count FROM prices GROUP BY opr_hr""",
)
def _(t):
    return stats.hourly_stats_raw(t.dense())


def _percentile_sql(source, fraction):
    return f"""WITH {source}, stats AS (
    SELECT node, avg(mw) AS a, stddev_samp(mw) AS s, count(*) AS data_points
    FROM prices WHERE mw > 0 GROUP BY node)
    SELECT node, {r2('a')} AS avg_price, {r2('s')} AS price_std, data_points FROM stats
    WHERE a <= (SELECT quantile_cont(a, {fraction}) FROM stats)"""


@query("percentile_nodes", _percentile_sql(DENSE, 0.1))
def _(t):
    return stats.percentile_nodes(t.dense())


@query("percentile_nodes_wide", _percentile_sql(WIDE, 0.25))
def _(t):
    return stats.percentile_nodes(t.wide(), percentile=25)


_PEAK = "avg(CASE WHEN opr_hr BETWEEN 0 AND 6 THEN mw END)"
_OFF = "avg(CASE WHEN opr_hr NOT BETWEEN 0 AND 6 THEN mw END)"
_PREMIUM = f"""{r2('p')} AS peak, {r2('o')} AS off_peak, {r2('p - o')} AS peak_premium,
    {r2('(p - o) / nullif(o, 0) * 100')} AS peak_premium_pct"""


@query(
    "peak_offpeak_by_node",
    f"""WITH {DENSE}, pairs AS (SELECT node, {_PEAK} AS p, {_OFF} AS o FROM prices WHERE mw > 0
    GROUP BY node) SELECT node, {_PREMIUM} FROM pairs WHERE p IS NOT NULL AND o IS NOT NULL""",
)
def _(t):
    return stats.peak_offpeak_by_node(t.dense())


@query(
    "peak_offpeak_market",
    f"""WITH {DENSE}, pairs AS (SELECT {_PEAK} AS p, {_OFF} AS o FROM prices WHERE mw > 0)
    SELECT 'MARKET_SUMMARY' AS node, {_PREMIUM} FROM pairs
    WHERE p IS NOT NULL AND o IS NOT NULL""",
)
def _(t):
    return stats.peak_offpeak_market(t.dense())


@query(
    "node_summary",
    f"""WITH {DENSE} SELECT node, count(*) AS mw_count, {r2('avg(mw)')} AS mw_mean,
    {r2('min(mw)')} AS mw_min, {r2('max(mw)')} AS mw_max, min(opr_dt) AS opr_dt_min,
    max(opr_dt) AS opr_dt_max FROM prices WHERE mw > 0 AND {JAN} GROUP BY node""",
)
def _(t):
    return stats.node_summary(t.dense(), DENSE_FROM, DENSE_TO)


@query(
    "congestion_analysis",
    f"""WITH {DENSE} SELECT node, {r2('avg(mcc)')} AS avg_congestion,
    {r2(pct('mcc', 0.5))} AS median_congestion, {r2('stddev_samp(mcc)')} AS congestion_std,
    {r2('min(mcc)')} AS min_congestion, {r2('max(mcc)')} AS max_congestion,
    count(CASE WHEN mcc > 0 THEN 1 END) AS positive_congestion_hours, count(*) AS total_hours,
    {r2('count(CASE WHEN mcc > 0 THEN 1 END) * 100.0 / count(*)')} AS congestion_frequency
    FROM prices WHERE mcc IS NOT NULL AND mw > 0 GROUP BY node""",
)
def _(t):
    return stats.congestion_analysis(t.dense())


def _node_hours_sql(price):
    return f"""WITH {DENSE} SELECT opr_hr AS operational_hour, node, {r2(price)} AS price,
    count(*) AS data_points, {r2('min(mw)')} AS min_price, {r2('max(mw)')} AS max_price,
    {r2('stddev_samp(mw)')} AS price_std FROM prices WHERE node = 'NATION_3' AND mw > 0
    GROUP BY opr_hr, node"""


@query("node_hourly_prices", _node_hours_sql("avg(mw)"))
def _(t):
    return stats.node_hourly_prices(t.dense(), "NATION_3")


@query("node_hourly_prices_median", _node_hours_sql(pct("mw", 0.5)))
def _(t):
    return stats.node_hourly_prices(t.dense(), "NATION_3", method="median")


def _summary_sql(price):
    return f"""count(*) AS total_records, count(DISTINCT node) AS unique_nodes,
    min(opr_dt) AS earliest_date, max(opr_dt) AS latest_date, {r(f'avg({price})')} AS avg_price,
    {r(f'min({price})')} AS min_price, {r(f'max({price})')} AS max_price"""


@query("data_summary", f"WITH {LONG}, {DAILY} SELECT {_summary_sql('avg_price')} FROM daily")
def _(t):
    return stats.data_summary(bx.bx_daily(t.long()))


@query(
    "quality_report",
    f"""WITH {DENSE} SELECT {_summary_sql('mw')}, count(*) - count(mcc) AS missing_mcc,
    count(*) - count(mlc) AS missing_mlc, count(*) - count(pos) AS missing_pos FROM prices""",
)
def _(t):
    return stats.quality_report(t.dense())


_FILES = """
files AS (
  SELECT DISTINCT strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%Y%m%d') || '_' ||
         strftime(o_orderdate, '%Y%m%d') || '_DAM_LMP_GRP.zip' AS file,
         CAST(o_orderdate AS DATE) AS opr_dt FROM orders)"""


def _archive_names(t):
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(
        F.date_format("o_orderdate", "yyyy/"), day, F.lit("_"), day, F.lit("_DAM_LMP_GRP.zip")
    )
    return t.table("orders").select(name.alias("file")).distinct()


@query(
    "data_freshness",
    f"""WITH {DENSE}, {_FILES} SELECT count(*) > 0 AS db_has_data, count(*) AS db_records,
    (SELECT count(*) FROM files) AS files_available, max(opr_dt) AS latest_db_date FROM prices""",
)
def _(t):
    return stats.data_freshness(t.dense(), _archive_names(t))


@query(
    "date_range",
    f"""WITH {LONG} SELECT min(opr_dt) AS earliest_date, max(opr_dt) AS latest_date,
    count(DISTINCT opr_dt) AS total_days FROM prices""",
)
def _(t):
    return stats.date_range(t.long())


@query("days_loaded", f"WITH {LONG} SELECT count(DISTINCT opr_dt) AS days_loaded FROM prices")
def _(t):
    return stats.days_loaded(t.long())


@query(
    "cheapest_hour_argmin",
    f"""WITH {DENSE} SELECT opr_hr AS hour, {r2('avg(mw)')} AS mw FROM prices WHERE mw > 0
    GROUP BY opr_hr ORDER BY mw, hour LIMIT 1""",
)
def _(t):
    return stats.cheapest_hour_argmin(stats.hourly_averages(t.dense()))


@query(
    "result_range",
    f"""WITH {DENSE}, hours AS (SELECT opr_hr, {r2('avg(mw)')} AS mw FROM prices WHERE mw > 0
    GROUP BY opr_hr) SELECT {r('min(mw)')} AS min_price, {r('max(mw)')} AS max_price,
    {r('avg(mw)')} AS avg_price, {r('max(mw) - min(mw)')} AS price_range, count(*) AS records
    FROM hours""",
)
def _(t):
    return stats.result_range(stats.hourly_averages(t.dense()))


# --------------------------------------------------------------- top-k, spikes


@query(
    "cheapest_hours",
    f"""WITH {DENSE} SELECT opr_dt AS operational_date, opr_hr AS operational_hour, node,
    {r2('mw')} AS mw FROM prices WHERE mw > 0 ORDER BY 4, 1, 2, 3 LIMIT 20""",
)
def _(t):
    return topk.cheapest_hours(t.dense(), 20)


@query(
    "cheapest_hours_one_node",
    f"""WITH {DENSE} SELECT opr_dt AS operational_date, opr_hr AS operational_hour, node,
    {r2('mw')} AS mw FROM prices WHERE mw > 0 AND node = 'NATION_7' AND {JAN}
    ORDER BY 4, 1, 2, 3 LIMIT 20""",
)
def _(t):
    return topk.cheapest_hours(t.dense(), 20, "NATION_7", DENSE_FROM, DENSE_TO)


@query(
    "cheapest_hours_raw",
    f"""WITH {DENSE} SELECT opr_dt AS operational_date, opr_hr AS operational_hour, node,
    {r('mw')} AS mw, {r('mcc')} AS mcc, {r('mlc')} AS mlc FROM prices
    ORDER BY 4, 1, 2, 3 LIMIT 20""",
)
def _(t):
    return topk.cheapest_hours_raw(t.dense(), 20)


@query(
    "cheapest_hours_aggregated",
    f"""WITH {DENSE} SELECT opr_dt AS operational_date, opr_hr AS operational_hour,
    'Aggregated_3_nodes' AS node, {r2('avg(mw)')} AS mw FROM prices WHERE mw > 0 AND {THREE}
    GROUP BY opr_dt, opr_hr ORDER BY 4, 1, 2 LIMIT 15""",
)
def _(t):
    return topk.cheapest_hours_aggregated(t.dense(), THREE_NODES, 15)


@query(
    "cheapest_nodes_by_hour",
    f"""WITH {DENSE} SELECT opr_dt AS operational_date, node, {r2('mw')} AS mw, opr_hr
    FROM prices WHERE mw > 0 AND opr_dt = DATE '2024-01-10' AND opr_hr = 13
    ORDER BY 3, 1, 4, 2 LIMIT 10""",
)
def _(t):
    return topk.cheapest_nodes_by_hour(t.dense(), 10, dt.date(2024, 1, 10), 13)


_LOW = f"""SELECT opr_dt AS operational_date, opr_hr AS operational_hour, node, {r2('mw')} AS mw,
    {r2('mcc')} AS mcc FROM prices WHERE mcc IS NOT NULL AND mw > 0"""


@query("lowest_congestion_hours", f"WITH {DENSE} {_LOW} ORDER BY 5, 1, 2, 3 LIMIT 25")
def _(t):
    return topk.lowest_congestion_hours(t.dense(), 25)


@query(
    "lowest_congestion_cheap_hours",
    f"""WITH {DENSE} {_LOW} AND mw <= (SELECT {pct('mw', 0.2)} FROM prices
    WHERE mcc IS NOT NULL AND mw > 0) ORDER BY 5, 1, 2, 3 LIMIT 25""",
)
def _(t):
    return topk.lowest_congestion_hours(t.dense(), 25, during_cheap_hours=True)


@query(
    "top_nodes",
    f"""WITH {DENSE} SELECT node, {r2('avg(mw)')} AS mw_mean FROM prices WHERE mw > 0
    GROUP BY node ORDER BY mw_mean DESC, node LIMIT 7""",
)
def _(t):
    ranked = topk.top_nodes(stats.node_summary(t.dense()), "mw_mean", 7, ascending=False)
    return ranked.select("node", "mw_mean")


def _spikes_sql(source, k):
    return f"""WITH {source}, rolling AS (
    SELECT *, avg(mw) OVER w AS m, stddev_samp(mw) OVER w AS s FROM prices WHERE mw > 0
    WINDOW w AS (PARTITION BY node ORDER BY opr_dt, opr_hr
                 ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT opr_dt AS operational_date, opr_hr AS operational_hour, node, {r2('mw')} AS mw,
    {r2('m')} AS rolling_mean FROM rolling WHERE mw > m + {k} * s AND s > 0"""


@query("price_spikes", _spikes_sql(DENSE, 3))
def _(t):
    return spikes.price_spikes(t.dense())


@query("price_spikes_long", _spikes_sql(LONG, 2))
def _(t):
    return spikes.price_spikes(t.long(), threshold_std=2)


# -------------------------------------------------------------------------- Bx


def _daily_sql(source):
    return f"""WITH {source}, {DAILY} SELECT 'node' AS level, node, opr_dt, bx_type,
    CAST(avg_price AS DOUBLE) AS avg_price, min_hour, max_hour FROM daily"""


@query("bx_daily", _daily_sql(LONG))
def _(t):
    return bx.bx_daily(t.long())


@query("bx_daily_dense", _daily_sql(DENSE))
def _(t):
    return bx.bx_daily(t.dense())


@query("bx_daily_wide", _daily_sql(WIDE))
def _(t):
    return bx.bx_daily(t.wide())


def _bx_hours_sql(rule):
    return f"""WITH {DENSE}, {BX}, {RANKED} SELECT node, opr_dt, bx_type,
    CAST(rn AS INT) AS hour_rank, opr_hr, CAST(mw AS DOUBLE) AS mw
    FROM ranked JOIN bx_values ON rn <= bx_type {rule}"""


@query("bx_hours", _bx_hours_sql("AND n >= bx_type"))
def _(t):
    return bx.bx_hours(t.dense())


@query("b6_b8_hours", _bx_hours_sql("WHERE bx_type IN (6, 8)"))
def _(t):
    return bx.bx_hours(t.dense(), [6, 8], require_full=False)


_ZONE_ROWS = """SELECT level, node, opr_dt, bx_type, CAST(avg_price AS DOUBLE) AS avg_price
    FROM zone_daily"""


@query("bx_zone_pooled", f"WITH {pooled(DENSE)} {_ZONE_ROWS}")
def _(t):
    return bx.bx_zone_pooled(t.dense(), t.dense_map())


@query("bx_zone_pooled_wide", f"WITH {pooled(WIDE)} {_ZONE_ROWS}")
def _(t):
    return bx.bx_zone_pooled(t.wide(), t.wide_map())


_MEANS_ROWS = f"""SELECT CASE zone WHEN 'Overall' THEN 'overall' ELSE 'zone' END AS level,
    zone AS node, opr_dt, bx_type, CAST({stored('avg_price')} AS DOUBLE) AS avg_price FROM zone_bx"""


@query("bx_zone_of_means", f"WITH {of_means(DENSE)} {_MEANS_ROWS}")
def _(t):
    return bx.bx_zone_of_means(t.dense(), t.dense_map())


_ZONE_HOURLY = LONG.replace("prices AS (", "all_prices AS (", 1) + """,
prices AS (SELECT * FROM all_prices WHERE zone IS NOT NULL)"""


@query("bx_zone_hourly", f"WITH {of_means(_ZONE_HOURLY)} {_MEANS_ROWS}")
def _(t):
    return bx.bx_zone_hourly(t.zone_hourly())


_HOUR_COUNTS = f"""{RANKED}, counts AS (
    SELECT node, opr_hr, count(*) AS days FROM ranked WHERE rn <= 6 AND n >= 6
    AND opr_hr BETWEEN 1 AND 24 GROUP BY node, opr_hr),
    often AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY days DESC, opr_hr) AS k
    FROM counts),
    hours AS (SELECT node, string_agg(CAST(opr_hr AS VARCHAR), ', ' ORDER BY opr_hr) AS hours_text
    FROM often WHERE k <= 6 GROUP BY node)"""


@query("common_bx_hours", f"WITH {DENSE}, {_HOUR_COUNTS} SELECT node, hours_text FROM hours")
def _(t):
    return bx.common_bx_hours(t.dense(), 6).select("node", "hours_text")


@query(
    "cheapest_hours_ranked",
    f"""WITH {DENSE}, {RANKED} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw,
    CAST(rn AS INT) AS rank_position, DATE '2024-01-10' AS date_computed FROM ranked
    WHERE opr_dt = DATE '2024-01-10' AND rn <= 6""",
)
def _(t):
    return bx.cheapest_hours_ranked(t.dense(), dt.date(2024, 1, 10), 6)


@query(
    "daily_rank_cumcount",
    f"""WITH {DENSE}, {RANKED} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw,
    CAST(rn AS INT) AS rank FROM ranked""",
)
def _(t):
    return bx.daily_rank(t.dense().select("node", "opr_dt", "opr_hr", "mw"))


_NODE_DAY = f"""SELECT node, opr_dt, CAST(min(mw) AS DOUBLE) AS min_price,
    CAST(max(mw) AS DOUBLE) AS max_price, {r('avg(mw)')} AS avg_price,
    CAST(max(CASE WHEN rn = n // 2 + 1 THEN mw END) AS DOUBLE) AS median_price,
    count(*) AS total_hours, {r('avg(CASE WHEN rn <= 6 THEN mw END)')} AS b6_avg_price,
    {r('avg(CASE WHEN rn <= 8 THEN mw END)')} AS b8_avg_price FROM ranked"""


@query("node_daily_summary", f"WITH {DENSE}, {RANKED} {_NODE_DAY} GROUP BY node, opr_dt")
def _(t):
    return bx.node_daily_summary(t.dense())


@query(
    "node_daily_summary_pending",
    f"""WITH {DENSE}, {RANKED} {_NODE_DAY}
    WHERE NOT ({JAN}) GROUP BY node, opr_dt""",
)
def _(t):
    prices = t.dense()
    done = date_window(prices.select("opr_dt"), DENSE_FROM, DENSE_TO).distinct()
    return bx.node_daily_summary(prices, done)


@query(
    "missing_bx_dates",
    f"""WITH {LONG}, {DAILY} SELECT DISTINCT opr_dt FROM prices
    WHERE opr_dt NOT IN (SELECT opr_dt FROM daily WHERE opr_dt < DATE '1998-01-01')""",
)
def _(t):
    prices = t.long()
    return bx.missing_bx_dates(prices, bx.bx_daily(prices).where("opr_dt < DATE '1998-01-01'"))


@query(
    "pending_bx",
    f"""WITH {LONG}, {DAILY} SELECT DISTINCT p.opr_dt, b.bx_type FROM prices p, bx_values b
    WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.opr_dt = p.opr_dt AND d.bx_type = b.bx_type
    AND d.opr_dt < DATE '1998-01-01')""",
)
def _(t):
    prices = t.long()
    return bx.pending_bx(prices, bx.bx_daily(prices).where("opr_dt < DATE '1998-01-01'"))


# ------------------------------------------------------------------- roll-ups


def _average_sql(source, where):
    return f"""WITH {source}, {DAILY} SELECT 6 AS bx_type, {BX_STATS},
    count(DISTINCT node) AS node_count, count(DISTINCT opr_dt) AS day_count
    FROM daily WHERE bx_type = 6 {where}"""


@query("bx_average", _average_sql(LONG, ""))
def _(t):
    return rollups.bx_average(bx.bx_daily(t.long()), 6)


@query("bx_average_zone", _average_sql(DENSE, f"AND zone = 'NP15' AND {JAN}"))
def _(t):
    return rollups.bx_average(
        bx.bx_daily(t.dense()), 6, DENSE_FROM, DENSE_TO, zone="NP15", mapping=t.dense_map()
    )


@query("bx_average_nodes", _average_sql(DENSE, f"AND {THREE}"))
def _(t):
    return rollups.bx_average(bx.bx_daily(t.dense()), 6, nodes=THREE_NODES)


def _trend_sql(source, period, where=""):
    return f"""WITH {source}, {DAILY} SELECT {period} AS period, {r('avg(avg_price)')} AS avg_price,
    count(DISTINCT node) AS node_count FROM daily WHERE bx_type = 5 {where} GROUP BY 1"""


_WEEK = "CAST(date_trunc('week', opr_dt) AS DATE)"
_MONTH = "CAST(date_trunc('month', opr_dt) AS DATE)"


@query("bx_trend", _trend_sql(DENSE, "opr_dt"))
def _(t):
    return rollups.bx_trend(bx.bx_daily(t.dense()), 5)


@query("bx_trend_weekly", _trend_sql(LONG, _WEEK))
def _(t):
    return rollups.bx_trend(bx.bx_daily(t.long()), 5, aggregation="weekly")


@query("bx_trend_monthly_zone", _trend_sql(LONG, _MONTH, "AND zone = 'SP15'"))
def _(t):
    return rollups.bx_trend(
        bx.bx_daily(t.long()), 5, zone="SP15", aggregation="monthly", mapping=t.long_map()
    )


_ROLLUP = f"""bx_type, {r2('avg(avg_price)')} AS avg_price, {r2('min(avg_price)')} AS min_price,
    {r2('max(avg_price)')} AS max_price, count(DISTINCT opr_dt) AS day_count FROM daily"""


@query(
    "bx_monthly",
    f"""WITH {LONG}, {DAILY} SELECT node, strftime(opr_dt, '%Y-%m') AS year_month, {_ROLLUP}
    GROUP BY node, year_month, bx_type""",
)
def _(t):
    return rollups.bx_monthly(bx.bx_daily(t.long()))


@query(
    "bx_monthly_one_month",
    f"""WITH {LONG}, {DAILY} SELECT node, strftime(opr_dt, '%Y-%m') AS year_month, {_ROLLUP}
    WHERE year(opr_dt) = 1997 AND month(opr_dt) = 3 GROUP BY node, year_month, bx_type""",
)
def _(t):
    return rollups.bx_monthly(bx.bx_daily(t.long()), 1997, 3)


_ANNUAL = f"SELECT node, zone, CAST(year(opr_dt) AS INT) AS year, {_ROLLUP} GROUP BY node, zone, year(opr_dt), bx_type"


@query(
    "bx_annual",
    f"WITH {LONG}, {DAILY}, annual AS ({_ANNUAL}) SELECT * EXCLUDE (zone) FROM annual",
)
def _(t):
    return rollups.bx_annual(bx.bx_daily(t.long()))


def _annual_average_sql(where):
    return f"""WITH {LONG}, {DAILY}, annual AS ({_ANNUAL}) SELECT year, 6 AS bx_type,
    {r('avg(avg_price)')} AS avg_bx_price, {r('min(min_price)')} AS min_bx_price,
    {r('max(max_price)')} AS max_bx_price, count(DISTINCT node) AS node_count,
    CAST(sum(day_count) // count(DISTINCT node) AS BIGINT) AS avg_days FROM annual
    WHERE bx_type = 6 {where} GROUP BY year ORDER BY year DESC LIMIT 1"""


@query("bx_annual_average", _annual_average_sql(""))
def _(t):
    return rollups.bx_annual_average(rollups.bx_annual(bx.bx_daily(t.long())), 6)


@query("bx_annual_average_zone", _annual_average_sql("AND year = 1998 AND zone = 'ZP26'"))
def _(t):
    return rollups.bx_annual_average(
        rollups.bx_annual(bx.bx_daily(t.long())), 6, 1998, zone="ZP26", mapping=t.long_map()
    )


def _zone_average_sql(where, rows="zone_daily", zone="node"):
    return f"""SELECT {zone} AS zone, {BX_STATS}, count(*) AS day_count FROM {rows}
    WHERE bx_type = 6 {where} GROUP BY {zone}"""


@query("zone_bx_average", f"WITH {pooled(LONG)} {_zone_average_sql(f'AND {IN_1997}')}")
def _(t):
    return rollups.zone_bx_average(bx.bx_zone_pooled(t.long(), t.long_map()), 6, 1997)


_FEB = "AND opr_dt BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'"


@query("zone_bx_average_month", f"WITH {pooled(LONG)} {_zone_average_sql(_FEB)}")
def _(t):
    return rollups.zone_bx_average(bx.bx_zone_pooled(t.long(), t.long_map()), 6, 1996, 2)


@query(
    "zone_bx_from_raw",
    f"WITH {of_means(LONG)} {_zone_average_sql(f'AND {IN_1997}', 'zone_bx', 'zone')}",
)
def _(t):
    return rollups.zone_bx_from_raw(t.long(), t.long_map(), 6, 1997)


@query(
    "zone_comparison",
    f"""WITH {pooled(LONG)} SELECT node AS zone, {r('avg(avg_price)')} AS avg_price
    FROM zone_daily WHERE bx_type = 6 AND node <> 'Overall' AND {IN_1997} GROUP BY node""",
)
def _(t):
    return rollups.zone_comparison(bx.bx_zone_pooled(t.long(), t.long_map()), 6, 1997)


def _zone_trend_sql(period):
    return f"""WITH {pooled(LONG)} SELECT node AS zone, {period} AS period,
    {r('avg(avg_price)')} AS avg_price, count(*) AS day_count FROM zone_daily
    WHERE bx_type = 6 AND {IN_1997} GROUP BY 1, 2"""


@query("bx_trend_by_zone", _zone_trend_sql(_MONTH))
def _(t):
    return rollups.bx_trend_by_zone(bx.bx_zone_pooled(t.long(), t.long_map()), 6, 1997)


@query("bx_trend_by_zone_weekly", _zone_trend_sql(_WEEK))
def _(t):
    return rollups.bx_trend_by_zone(
        bx.bx_zone_pooled(t.long(), t.long_map()), 6, 1997, "weekly"
    )


@query(
    "bx_trend_per_node",
    f"""WITH {LONG}, {DAILY_EXACT} SELECT node, {_MONTH} AS period, {r('avg(avg_price)')} AS avg_price
    FROM daily WHERE bx_type = 6 AND {TWO} AND {IN_1997} GROUP BY 1, 2""",
)
def _(t):
    return rollups.bx_trend_per_node(t.long(), 6, TWO_LONG, 1997)


@query(
    "node_bx_stats",
    f"""WITH {DENSE}, {_HOUR_COUNTS}, days AS (SELECT node, opr_dt, avg(mw) AS a FROM ranked
    WHERE rn <= 6 AND n >= 6 GROUP BY node, opr_dt)
    SELECT d.node, {r('avg(a)')} AS avg_price, count(*) AS day_count,
    max(hours_text) AS common_hours FROM days d LEFT JOIN hours h ON h.node = d.node
    GROUP BY d.node""",
)
def _(t):
    return rollups.node_bx_stats(t.dense(), 6)


@query(
    "node_bx_overall",
    f"""WITH {DENSE}, {DAILY_EXACT} SELECT 6 AS bx_type, {BX_STATS},
    count(DISTINCT node) AS node_count, count(DISTINCT opr_dt) AS day_count FROM daily
    WHERE bx_type = 6 AND {THREE}""",
)
def _(t):
    return rollups.node_bx_overall(t.dense(), 6, THREE_NODES, 2024)


@query(
    "bx_box_stats",
    f"""WITH {WIDE}, {DAILY_EXACT} SELECT node, {r('avg(avg_price)')} AS mean,
    {r('min(avg_price)')} AS min, {r('max(avg_price)')} AS max, {r(pct('avg_price', 0.25))} AS q1,
    {r(pct('avg_price', 0.5))} AS median, {r(pct('avg_price', 0.75))} AS q3, count(*) AS day_count
    FROM daily WHERE bx_type = 4 AND {IN_1997} GROUP BY node""",
)
def _(t):
    return rollups.bx_box_stats(t.wide(), 4, year=1997)


# ------------------------------------------------------------- hours and months


def _by_zone_sql(source, keys, extra=""):
    names = ", ".join(keys)
    return f"""WITH {source} SELECT zone, {names}, {r('avg(mw)')} AS avg_price {extra}
    FROM prices WHERE zone IS NOT NULL GROUP BY ALL UNION ALL
    SELECT 'Overall', {names}, {r('avg(mw)')} {extra} FROM prices GROUP BY ALL"""


_CELL = [
    "CAST(year(opr_dt) AS INT) AS year",
    "CAST(month(opr_dt) AS INT) AS month",
    "opr_hr AS hour",
]


@query("hourly_by_zone", _by_zone_sql(DENSE, ["opr_hr AS hour"]))
def _(t):
    return heatmaps.hourly_by_zone(t.dense(), t.dense_map())


@query("month_hour_heatmap", _by_zone_sql(LONG, _CELL, ", count(*) AS record_count"))
def _(t):
    return heatmaps.month_hour_heatmap(t.long(), t.long_map())


@query("month_hour_heatmap_wide", _by_zone_sql(WIDE, _CELL, ", count(*) AS record_count"))
def _(t):
    return heatmaps.month_hour_heatmap(t.wide(), t.wide_map())


@query(
    "read_heatmap",
    f"""WITH {LONG} SELECT CAST(month(opr_dt) AS INT) AS month, opr_hr AS hour,
    {r('avg(mw)')} AS avg_price FROM prices WHERE zone = 'NP15' AND {IN_1997} GROUP BY 1, 2""",
)
def _(t):
    cells = heatmaps.month_hour_heatmap(t.long(), t.long_map(), 1997)
    return heatmaps.read_heatmap(cells, "NP15", 1997)


@query(
    "hourly_for_nodes",
    f"""WITH {DENSE} SELECT opr_hr AS hour, {r('avg(mw)')} AS avg_price FROM prices
    WHERE {THREE} GROUP BY opr_hr""",
)
def _(t):
    return heatmaps.hourly_for_nodes(t.dense(), THREE_NODES, 2024)


@query(
    "hourly_per_node",
    f"""WITH {DENSE} SELECT node, opr_hr AS hour, {r('avg(mw)')} AS avg_price FROM prices
    WHERE {THREE} GROUP BY node, opr_hr""",
)
def _(t):
    return heatmaps.hourly_per_node(t.dense(), THREE_NODES, 2024)


@query(
    "node_month_hour",
    f"""WITH {LONG} SELECT CAST(month(opr_dt) AS INT) AS month, opr_hr AS hour,
    {r('avg(mw)')} AS avg_price FROM prices WHERE {TWO} AND {IN_1997} GROUP BY 1, 2""",
)
def _(t):
    return heatmaps.node_month_hour(t.long(), TWO_LONG, 1997)


def _hour_matrix(value):
    return ", ".join(
        f"{r(f'avg(CASE WHEN hour = {h} THEN {value} END)')} AS h{h}" for h in range(1, 25)
    )


@query(
    "pivot_node_hour",
    f"""WITH {DENSE}, cells AS (SELECT node, opr_hr AS hour, mw FROM prices)
    SELECT node, {_hour_matrix('mw')} FROM cells GROUP BY node""",
)
def _(t):
    return heatmaps.pivot_node_hour(t.dense())


@query(
    "pivot_month_hour",
    f"""WITH {LONG}, cells AS (SELECT CAST(month(opr_dt) AS INT) AS month, opr_hr AS hour,
    avg(mw) AS v FROM prices WHERE {IN_1997} GROUP BY 1, 2)
    SELECT CAST(m.month AS INT) AS month, {_hour_matrix('v')}
    FROM range(1, 13) m(month) LEFT JOIN cells c ON c.month = m.month GROUP BY m.month""",
)
def _(t):
    cells = heatmaps.month_hour_heatmap(t.long(), t.long_map(), 1997)
    return heatmaps.pivot_month_hour(heatmaps.read_heatmap(cells))


@query(
    "price_histogram",
    f"""WITH {WIDE}, v AS (SELECT CAST(mw AS DOUBLE) AS v FROM prices),
    e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    held AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 30), 29) AS INT) AS bin FROM v, e),
    bins AS (SELECT CAST(b AS INT) AS bin, lo, (hi - lo) / 30 AS w FROM range(30) x(b), e)
    SELECT bin, {r('min(lo + bin * w)')} AS bin_start, {r('min(lo + (bin + 1) * w)')} AS bin_end,
    count(held.bin) AS records FROM bins LEFT JOIN held USING (bin) GROUP BY bin""",
)
def _(t):
    return heatmaps.price_histogram(t.wide())


# ------------------------------------------------------------ nodes and zones


@query("all_nodes", f"WITH {WIDE} SELECT DISTINCT node FROM prices")
def _(t):
    return nodes.all_nodes(t.wide())


@query(
    "search_nodes",
    f"WITH {WIDE} SELECT DISTINCT node FROM prices WHERE node ILIKE '%07%'",
)
def _(t):
    return nodes.search_nodes(t.wide(), "07")


@query(
    "nodes_by_prefix",
    f"""WITH {WIDE} SELECT DISTINCT node FROM prices
    WHERE starts_with(upper(node), 'SUPPLIER#00000002')""",
)
def _(t):
    return nodes.nodes_by_prefix(t.wide(), "supplier#00000002")


@query(
    "selected_nodes",
    f"""WITH {WIDE}, matching AS (
    SELECT DISTINCT node FROM prices WHERE node ILIKE '%07%')
    SELECT node FROM matching UNION
    SELECT node FROM prices WHERE starts_with(upper(node), 'SUPPLIER#00000002')""",
)
def _(t):
    prices = t.wide()
    return nodes.selected_nodes(
        nodes.search_nodes(prices, "07"), nodes.nodes_by_prefix(prices, "supplier#00000002")
    )


@query(
    "filter_prices",
    f"""WITH {DENSE} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw FROM prices
    WHERE mw > 0 AND {JAN} AND {THREE}""",
)
def _(t):
    rows = stats.filter_prices(t.dense(), DENSE_FROM, DENSE_TO, THREE_NODES)
    return rows.select("node", "opr_dt", "opr_hr", "mw")


@query(
    "filter_prices_by_frame",
    f"""WITH {WIDE} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw FROM prices
    WHERE mw > 0 AND node IN (SELECT s_name FROM supplier WHERE s_acctbal < 0)""",
)
def _(t):
    debtors = t.table("supplier").where("s_acctbal < 0").select("s_name")
    return stats.filter_prices(t.wide(), nodes=debtors).select("node", "opr_dt", "opr_hr", "mw")


@query("available_years", f"WITH {LONG} SELECT DISTINCT CAST(year(opr_dt) AS INT) AS year FROM prices")
def _(t):
    return nodes.available_years(t.long())


@query(
    "available_months",
    f"""WITH {LONG}, {DAILY} SELECT DISTINCT strftime(opr_dt, '%Y-%m') AS year_month FROM daily
    WHERE year(opr_dt) = 1997""",
)
def _(t):
    return nodes.available_months(rollups.bx_monthly(bx.bx_daily(t.long())), 1997)


@query(
    "available_dates",
    f"WITH {LONG} SELECT DISTINCT opr_dt FROM prices WHERE year(opr_dt) = 1997 AND month(opr_dt) = 3",
)
def _(t):
    return nodes.available_dates(t.long(), 1997, 3)


@query(
    "date_spine",
    f"""WITH {LONG}, ends AS (SELECT min(opr_dt) AS lo, max(opr_dt) AS hi FROM prices)
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS opr_dt FROM ends""",
)
def _(t):
    return date_spine(t.long())


@query("node_zone_map", f"WITH {MAPPING} SELECT * FROM mapping")
def _(t):
    return t.wide_map()


@query(
    "enrich_zone",
    f"""WITH {DENSE} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw,
    coalesce(zone, 'UNMAPPED') AS zone FROM prices""",
)
def _(t):
    rows = zones.enrich_zone(t.dense(), t.dense_map())
    return rows.select("node", "opr_dt", "opr_hr", "mw", "zone")


@query(
    "zone_filtered",
    f"""WITH {WIDE} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw, zone FROM prices
    WHERE zone = 'NP15'""",
)
def _(t):
    return zones.zone_filtered(t.wide(), t.wide_map(), "NP15")


@query("zone_for_node", f"WITH {MAPPING} SELECT pnode_id, zone FROM mapping WHERE pnode_id = 'Supplier#000000007'")
def _(t):
    return zones.zone_for_node(t.wide_map(), "Supplier#000000007")


@query("nodes_for_zone", f"WITH {MAPPING} SELECT pnode_id FROM mapping WHERE zone = 'SP15'")
def _(t):
    return zones.nodes_for_zone(t.wide_map(), "SP15")


@query("available_zones", f"WITH {MAPPING} SELECT DISTINCT zone FROM mapping WHERE zone IS NOT NULL")
def _(t):
    return zones.available_zones(t.wide_map())


_MAP_STATS = """count(*) AS total_mappings, count(DISTINCT zone) AS unique_zones,
    count(*) - count(zone) AS unmapped_nodes, count(zone) AS mapped_nodes FROM mapping"""


@query("mapping_stats", f"WITH {MAPPING} SELECT {_MAP_STATS}")
def _(t):
    return zones.mapping_stats(t.wide_map())


@query(
    "nodes_per_zone",
    f"""WITH {MAPPING} SELECT zone, count(*) AS node_count FROM mapping WHERE zone IS NOT NULL
    GROUP BY zone""",
)
def _(t):
    return zones.nodes_per_zone(t.wide_map())


# ------------------------------------------------------------------- cleaning

_RAW_MW = """TRY_CAST(CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN value * 100
    WHEN 'signup' THEN value - 1100 ELSE value END AS DECIMAL(12,4))"""
_RAW = f"""raw AS (SELECT event_id AS row_id, ts, user_id, {_RAW_MW} AS price, value FROM events),
clean AS (SELECT row_id, CAST(ts AS DATE) AS opr_dt, CAST(hour(ts) AS INT) AS opr_hr,
  strftime(ts, '%A') AS day_of_week, 'N' || CAST(user_id % 25 AS VARCHAR) AS node,
  CASE WHEN price BETWEEN -1000 AND 10000 THEN price END AS mw,
  CAST(value - 40 AS DECIMAL(12,4)) AS mcc FROM raw)"""


@query(
    "standardize_columns",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "INTERVALSTARTTIME_GMT",
    'N' || CAST(user_id % 25 AS VARCHAR) AS "NODE", event_id AS row_id FROM events""",
)
def _(t):
    rows = columns.standardize_columns(t.raw_text())
    return rows.select("INTERVALSTARTTIME_GMT", "NODE", "row_id")


@query(
    "derive_date_hour",
    f"WITH {_RAW} SELECT row_id, opr_dt, opr_hr, day_of_week FROM clean",
)
def _(t):
    rows = columns.derive_date_hour(columns.standardize_columns(t.raw_text()))
    return rows.select("row_id", "opr_dt", "opr_hr", F.col("DAY_OF_WEEK").alias("day_of_week"))


@query(
    "clean_numeric",
    f"WITH {_RAW} SELECT row_id, CAST(mw AS DOUBLE) AS mw, CAST(mcc AS DOUBLE) AS mcc FROM clean",
)
def _(t):
    rows = columns.clean_numeric(columns.standardize_columns(t.raw_text()))
    return rows.select("row_id", F.col("MW").alias("mw"), F.col("MCC").alias("mcc"))


_FIRST = f"""WITH {_RAW}, firsts AS (
    SELECT *, row_number() OVER (PARTITION BY opr_dt, opr_hr, node ORDER BY row_id) AS k
    FROM clean WHERE mw IS NOT NULL)
    SELECT opr_dt, opr_hr, node, CAST(mw AS DOUBLE) AS mw, CAST(mcc AS DOUBLE) AS mcc"""


@query("clean_and_validate", f"{_FIRST}, row_id FROM firsts WHERE k = 1")
def _(t):
    rows = csv_files.to_price_table(csv_files.standardize_csv(t.raw_text()))
    return rows.select("opr_dt", "opr_hr", "node", "mw", "mcc", "row_id")


@query(
    "dedupe_keep_first",
    """SELECT user_id, event_type, min(event_id) AS event_id FROM events
    GROUP BY user_id, event_type""",
)
def _(t):
    rows = t.table("events").select("user_id", "event_type", "event_id")
    return cleaning.dedupe_keep_first(rows, ["user_id", "event_type"], ["event_id"])


_UPSERT_OLD = "opr_dt < DATE '1999-01-01'"
_UPSERT_NEW = "opr_dt >= DATE '1998-01-01'"


@query(
    "upsert_keep_latest",
    f"""WITH {LONG}, {DAILY} SELECT node, opr_dt, bx_type,
    CAST(CASE WHEN {_UPSERT_NEW} THEN avg_price + 1 ELSE avg_price END AS DOUBLE) AS avg_price
    FROM daily""",
)
def _(t):
    rows = bx.bx_daily(t.long()).select("node", "opr_dt", "bx_type", "avg_price")
    new = rows.where(_UPSERT_NEW).withColumn("avg_price", F.col("avg_price") + 1)
    old = rows.where(_UPSERT_OLD).withColumn("avg_price", F.col("avg_price") + 0)
    return cleaning.upsert_keep_latest(old, new, ["node", "opr_dt", "bx_type"])


@query(
    "insert_ignore",
    f"""WITH {LONG}, {DAILY} SELECT node, opr_dt, bx_type, CAST(avg_price AS DOUBLE) AS avg_price
    FROM daily WHERE NOT ({_UPSERT_OLD})""",
)
def _(t):
    rows = bx.bx_daily(t.long()).select("node", "opr_dt", "bx_type", "avg_price")
    return cleaning.insert_ignore(
        rows.where(_UPSERT_OLD), rows, ["node", "opr_dt", "bx_type"]
    )


@query(
    "delete_range",
    f"""WITH {DENSE} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw FROM prices
    WHERE NOT ({JAN})""",
)
def _(t):
    kept = cleaning.delete_range(t.dense(), DENSE_FROM, DENSE_TO)
    return kept.select("node", "opr_dt", "opr_hr", "mw")


# -------------------------------------------------------------------- sources


@query(
    "unprocessed_files",
    f"""WITH {LONG}, {_FILES} SELECT file, opr_dt FROM files
    WHERE opr_dt NOT IN (SELECT opr_dt FROM prices)""",
)
def _(t):
    return archives.unprocessed_files(_archive_names(t), t.long())


@query(
    "unprocessed_batch",
    f"""WITH {LONG}, {_FILES} SELECT file, opr_dt FROM files
    WHERE opr_dt NOT IN (SELECT opr_dt FROM prices) ORDER BY file LIMIT 200""",
)
def _(t):
    return archives.unprocessed_files(_archive_names(t), t.long(), 200)


@query(
    "zone_unpivot",
    f"""WITH {LONG} SELECT opr_dt, opr_hr AS hour_num, zone, CAST(mw AS DOUBLE) AS lmp,
    CASE zone WHEN 'NP15' THEN {r('mw / 10')} END AS congestion,
    CAST(NULL AS DOUBLE) AS energy, CAST(NULL AS DOUBLE) AS loss
    FROM prices WHERE zone IS NOT NULL""",
)
def _(t):
    wide = (
        t.zone_hourly()
        .groupBy("opr_dt", "hour_num")
        .pivot("zone", list(ZONE_HEADERS))
        .agg(F.first("lmp"))
        .select(
            F.col("opr_dt").alias("Local Date"),
            F.col("hour_num").alias("Hour Number"),
            *[F.col(zone).alias(headers[0]) for zone, headers in ZONE_HEADERS.items()],
            (F.col("NP15") / 10).alias(ZONE_HEADERS["NP15"][1]),
        )
    )
    return csv_files.zone_wide_to_long(wide)


def _written(t, rows, label):
    path = scratch_path(t.spark, label)
    store.write_daily(rows, path)
    return path


_KEY_PRICE = "SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw FROM prices"


@query("write_daily", f"WITH {DENSE} {_KEY_PRICE}")
def _(t):
    path = _written(t, t.dense(), "write")
    return store.read_prices(t.spark, path).select("node", "opr_dt", "opr_hr", "mw")


@query("scan_day", f"WITH {DENSE} {_KEY_PRICE} WHERE opr_dt = DATE '2024-01-10'")
def _(t):
    path = _written(t, t.dense(), "day")
    rows = store.scan_day(t.spark, path, dt.date(2024, 1, 10))
    return rows.select("node", "opr_dt", "opr_hr", "mw")


@query("scan_range", f"WITH {DENSE} {_KEY_PRICE} WHERE {JAN} AND {THREE}")
def _(t):
    path = _written(t, t.dense(), "range")
    rows = store.scan_range(t.spark, path, THREE_NODES, DENSE_FROM, DENSE_TO)
    return rows.select("node", "opr_dt", "opr_hr", "mw")


@query("append_prices", f"WITH {DENSE} {_KEY_PRICE}")
def _(t):
    """Rows below zero are stored first; of the rest appended, those keys stay as they are."""
    prices = t.dense()
    path = _written(t, prices.where("mw < 0"), "append")
    changed = prices.withColumn("mw", F.when(F.col("mw") < 0, F.lit(1)).otherwise(F.col("mw")))
    store.append_prices(changed, path)
    return store.read_prices(t.spark, path).select("node", "opr_dt", "opr_hr", "mw")


@query("clear_range", f"WITH {DENSE} {_KEY_PRICE} WHERE NOT ({JAN})")
def _(t):
    path = _written(t, t.dense(), "clear")
    store.clear_range(t.spark, path, DENSE_FROM, DENSE_TO)
    return store.read_prices(t.spark, path).select("node", "opr_dt", "opr_hr", "mw")


@query("stored_dates", f"WITH {DENSE} SELECT DISTINCT opr_dt FROM prices")
def _(t):
    return store.stored_dates(t.spark, _written(t, t.dense(), "dates"))


@query(
    "parse_price_csv",
    f"""SELECT 'N' || CAST(user_id % 25 AS VARCHAR) AS node, CAST(ts AS DATE) AS opr_dt,
    CAST(hour(ts) + 1 AS INT) AS opr_hr, CAST({_RAW_MW} AS DOUBLE) AS mw,
    CAST(CAST(value - 40 AS DECIMAL(12,4)) AS DOUBLE) AS mcc
    FROM events WHERE event_type <> 'error' AND event_type <> 'click'""",
)
def _(t):
    path = scratch_path(t.spark, "csv")
    raw = t.raw_text().join(
        t.table("events").select(
            F.col("event_id").alias("row_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("Opr_Dt"),
            F.when(F.col("event_type") == "click", F.lit("5.0"))
            .otherwise((F.hour("ts") + 1).cast("string"))
            .alias("Opr_Hr"),
        ),
        "row_id",
    )
    raw.select(
        F.col("Node").alias("pnode_resmrid"),
        "Opr_Dt",
        "Opr_Hr",
        F.col("MW_Price").alias("Mw"),
        F.col("Congestion").alias("Mcc"),
    ).write.option("header", True).csv(path)
    rows = csv_files.parse_price_csv(csv_files.read_text_csv(t.spark, path))
    return rows.select("node", "opr_dt", "opr_hr", "mw", "mcc")


@query(
    "standardize_csv",
    f"""WITH {_RAW} SELECT node, opr_dt, opr_hr, CAST(mw AS DOUBLE) AS mw,
    CAST(mcc AS DOUBLE) AS mcc FROM clean""",
)
def _(t):
    path = scratch_path(t.spark, "generic")
    t.raw_text().drop("row_id").write.option("header", True).csv(path)
    rows = csv_files.standardize_csv(csv_files.read_text_csv(t.spark, path))
    return rows.select(
        F.col("NODE").alias("node"),
        "opr_dt",
        "opr_hr",
        F.col("MW").alias("mw"),
        F.col("MCC").alias("mcc"),
    )


@query("refresh_mapping", f"WITH {MAPPING} SELECT {_MAP_STATS}")
def _(t):
    base = scratch_path(t.spark, "mapping")
    t.zones().select(
        F.col("resource_id").alias("Resource ID"),
        F.col("zone").alias("Matched Zone"),
        F.lit("area").alias("Local Area"),
        F.lit("generator").alias("Generator Name"),
    ).write.option("header", True).csv(f"{base}/zones")
    t.wide_nodes().select(
        F.col("pnode_id").alias("PNODE_ID"), F.col("resource_id").alias("RES_ID")
    ).write.option("header", True).csv(f"{base}/nodes")
    return jobs.refresh_mapping(t.spark, f"{base}/zones", f"{base}/nodes", f"{base}/table")


def _zip(file, text):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(file.replace(".zip", "_PRC_LMP_DAM_LMP.csv"), text)
    return buffer.getvalue()


def _zip_days(batches):
    """Archives in memory, one per row of (path, text)."""
    for batch in batches:
        packed = [_zip(file, text) for file, text in zip(batch["path"], batch["text"])]
        yield batch.assign(content=packed)[["path", "content"]]


def _save_zips(folder):
    """Archives as files of the shared folder, written by the tasks."""

    def save(batches):
        from pyarrow import fs

        target = f"{folder}/"
        for batch in batches:
            for file, text in zip(batch["path"], batch["text"]):
                system, path = fs.FileSystem.from_uri(target + file)
                system.create_dir(path.rsplit("/", 1)[0])
                with system.open_output_stream(path) as out:
                    out.write(b"no archive" if text is None else _zip(file, text))
            yield batch[["path"]]

    return save


def _day_texts(prices):
    """Archive name and CSV text per day.

    The dense table has one row per nation and hour, so a day's text is bounded
    however large the event table is.
    """
    day = F.date_format("opr_dt", "yyyyMMdd")
    line = F.concat_ws(",", "opr_dt", "opr_hr", "node", "mw")
    header = F.lit("OPR_DT,OPR_HR,NODE,MW")
    return prices.groupBy(
        F.concat(day, F.lit("_"), day, F.lit("_DAM_LMP_GRP.zip")).alias("path")
    ).agg(F.concat_ws("\n", header, F.collect_list(line)).alias("text"))


@query("ingest_zip", f"WITH {DENSE} {_KEY_PRICE}")
def _(t):
    packed = _day_texts(t.dense()).mapInPandas(_zip_days, "path string, content binary")
    return archives.ingest_zip(packed).select("node", "opr_dt", "opr_hr", "mw")


def _landing(t, base, folder="landing", days=None, broken=None):
    """Archives of the dense table's days; those in ``broken`` days cannot be read."""
    texts = _day_texts(t.dense())
    day = archives.archive_date(F.col("path"))
    if days is not None:
        texts = texts.where(F.dayofmonth(day).isin(days))
    if broken is not None:
        text = F.when(~F.dayofmonth(day).isin(broken), F.col("text"))
        texts = texts.withColumn("text", text)
    saved = texts.mapInPandas(_save_zips(f"{base}/{folder}"), "path string")
    saved.write.parquet(f"{base}/saved-{folder}")
    return f"{base}/{folder}"


BROKEN = [1, 13]
GOOD_DAYS = "day(opr_dt) NOT IN (1, 13)"


@query("load_batch_bad_archive", f"WITH {DENSE} {_KEY_PRICE} WHERE {GOOD_DAYS}")
def _(t):
    base = scratch_path(t.spark, "load")
    landing = _landing(t, base, broken=BROKEN)
    path = f"{base}/prices"
    # The broken ones come first by name, and yet each call gets on.
    for batch_size in (1, 2, 20, 20):
        jobs.load_batch(t.spark, landing, path, batch_size=batch_size)
    return store.read_prices(t.spark, path).select("node", "opr_dt", "opr_hr", "mw")


@query(
    "load_report",
    f"""WITH {DENSE} SELECT strftime(opr_dt, '%Y%m%d') AS day,
    CASE WHEN {GOOD_DAYS} THEN count(*) ELSE 0 END AS records, 0 AS foreign_rows,
    CASE WHEN {GOOD_DAYS} THEN 'processed' ELSE 'error' END AS status,
    NOT ({GOOD_DAYS}) AS failed, CASE WHEN {GOOD_DAYS} THEN 0 ELSE 2 END AS attempts
    FROM prices GROUP BY opr_dt""",
)
def _(t):
    base = scratch_path(t.spark, "load")
    landing, path = _landing(t, base, broken=BROKEN), f"{base}/prices"
    report = jobs.load_batch(t.spark, landing, path)
    jobs.load_batch(t.spark, landing, path)
    failed = ledger.failed_archives(t.spark, path).select(
        F.col("file").alias("source_file"), "attempts"
    )
    return report.join(failed, "source_file", "left").select(
        F.left("source_file", F.lit(8)).alias("day"),
        "records",
        F.col("foreign_rows").cast("int").alias("foreign_rows"),
        "status",
        F.col("error").isNotNull().alias("failed"),
        F.coalesce("attempts", F.lit(0)).cast("int").alias("attempts"),
    )


@query(
    "load_summary",
    f"""WITH {DENSE} SELECT count(DISTINCT opr_dt) AS total_files,
    count(DISTINCT opr_dt) FILTER ({GOOD_DAYS}) AS processed_files,
    CAST(0 AS BIGINT) AS skipped_files,
    count(DISTINCT opr_dt) FILTER (NOT ({GOOD_DAYS})) AS error_files,
    count(*) FILTER ({GOOD_DAYS}) AS total_records FROM prices""",
)
def _(t):
    base = scratch_path(t.spark, "load")
    landing = _landing(t, base, broken=BROKEN)
    return jobs.load_summary(jobs.load_batch(t.spark, landing, f"{base}/prices"))


@query(
    "load_batch",
    f"""WITH {pooled(DENSE)}, {_daily_cte('avg(mw)')} SELECT 'node' AS level, node, opr_dt, bx_type,
    CAST({stored('avg_price')} AS DOUBLE) AS avg_price FROM daily
    UNION ALL {_ZONE_ROWS}""",
)
def _(t):
    base = scratch_path(t.spark, "load")
    landing, mapping = _landing(t, base), t.dense_map()
    for batch_size in (10, None, None):
        jobs.load_batch(
            t.spark, landing, f"{base}/prices", f"{base}/daily", mapping, batch_size
        )
    daily = t.spark.read.parquet(f"{base}/daily")
    return daily.select("level", "node", "opr_dt", "bx_type", "avg_price")


@query("reprocess_year", f"WITH {DENSE} {_KEY_PRICE}")
def _(t):
    base = scratch_path(t.spark, "again")
    landing = _landing(t, base)
    jobs.load_batch(t.spark, landing, f"{base}/prices", batch_size=12)
    jobs.reprocess_year(t.spark, 2024, landing, f"{base}/prices")
    rows = store.read_prices(t.spark, f"{base}/prices")
    return rows.select("node", "opr_dt", "opr_hr", "mw")


class _Stopped(Exception):
    pass


@query("reprocess_year_resumed", f"WITH {DENSE} {_KEY_PRICE} WHERE day(opr_dt) <> 20")
def _(t):
    base = scratch_path(t.spark, "again")
    path = f"{base}/prices"
    jobs.load_batch(t.spark, _landing(t, base), path, batch_size=12)
    # The year is published again without one day, and the job dies between two days.
    days = [d for d in range(1, 32) if d != 20]
    landing = _landing(t, base, "again", days)
    swapped = []

    def stop(step):
        swapped.append(step)
        if swapped.count("cleared") == 9:
            raise _Stopped

    try:
        jobs.reprocess_year(t.spark, 2024, landing, path, after_step=stop)
    except _Stopped:
        jobs.load_batch(t.spark, landing, path)
    return store.read_prices(t.spark, path).select("node", "opr_dt", "opr_hr", "mw")


@query(
    "upsert_table",
    f"""WITH {LONG}, {DAILY} SELECT level, node, opr_dt, bx_type,
    CAST(CASE WHEN {_UPSERT_NEW} THEN avg_price + 1 ELSE avg_price END AS DOUBLE) AS avg_price
    FROM (SELECT 'node' AS level, * FROM daily)""",
)
def _(t):
    path = scratch_path(t.spark, "upsert")
    rows = bx.bx_daily(t.long()).withColumn("year", F.year("opr_dt"))
    raised = (F.col("avg_price") + 1).cast("decimal(12,4)")
    for part in (
        rows.where(_UPSERT_OLD),
        rows.where(_UPSERT_NEW).withColumn("avg_price", raised),
    ):
        store.upsert_table(t.spark, path, part, jobs.BX_KEY, "year")
    return t.spark.read.parquet(path).select("level", "node", "opr_dt", "bx_type", "avg_price")


@query(
    "insert_ignore_table",
    f"""WITH {LONG}, {DAILY} SELECT node, opr_dt, bx_type,
    CAST(CASE WHEN {_UPSERT_OLD} THEN avg_price ELSE avg_price + 1 END AS DOUBLE) AS avg_price
    FROM daily""",
)
def _(t):
    path = scratch_path(t.spark, "ignore")
    rows = bx.bx_daily(t.long()).withColumn("year", F.year("opr_dt"))
    raised = (F.col("avg_price") + 1).cast("decimal(12,4)")
    for part in (rows.where(_UPSERT_OLD), rows.withColumn("avg_price", raised)):
        store.insert_ignore_table(t.spark, path, part, jobs.BX_KEY, "year")
    return t.spark.read.parquet(path).select("node", "opr_dt", "bx_type", "avg_price")


@query(
    "rollup_job",
    f"""WITH {LONG}, {DAILY} SELECT node, strftime(opr_dt, '%Y-%m') AS period, {_ROLLUP}
    GROUP BY node, period, bx_type
    UNION ALL SELECT node, CAST(year(opr_dt) AS VARCHAR) AS period, {_ROLLUP}
    GROUP BY node, period, bx_type""",
)
def _(t):
    base = scratch_path(t.spark, "rollup")
    daily = bx.bx_daily(t.long()).withColumn("year", F.year("opr_dt"))
    store.upsert_table(t.spark, f"{base}/daily", daily, jobs.BX_KEY, "year")
    jobs.rollup_job(t.spark, f"{base}/daily", f"{base}/monthly", f"{base}/annual")
    layout = "node string, {} string, bx_type int, avg_price double, min_price double, " \
        "max_price double, day_count long"
    monthly = t.spark.read.schema(layout.format("year_month")).parquet(f"{base}/monthly")
    annual = t.spark.read.schema(layout.format("year")).parquet(f"{base}/annual")
    return monthly.withColumnRenamed("year_month", "period").unionByName(
        annual.withColumnRenamed("year", "period")
    )


@query("backfill_bx", f"WITH {pooled(DENSE)} {_ZONE_ROWS}")
def _(t):
    base = scratch_path(t.spark, "backfill")
    mapping = t.dense_map()
    store.write_daily(t.dense(), f"{base}/prices")
    first = store.scan_range(t.spark, f"{base}/prices", end=DENSE_FROM)
    jobs.store_bx(t.spark, first, mapping, f"{base}/daily")
    jobs.backfill_bx(t.spark, f"{base}/prices", f"{base}/daily", mapping)
    daily = t.spark.read.parquet(f"{base}/daily").where("level <> 'node'")
    return daily.select("level", "node", "opr_dt", "bx_type", "avg_price")


@query(
    "refresh_heatmap",
    _by_zone_sql(
        LONG,
        _CELL,
        ", count(*) AS record_count",
    ),
)
def _(t):
    base = scratch_path(t.spark, "heatmap")
    store.write_daily(t.long(), f"{base}/prices")
    mapping = t.long_map()
    for year in [*range(1992, 2002), 1996]:  # 1992 and others without a price leave nothing
        jobs.refresh_heatmap(t.spark, f"{base}/prices", mapping, f"{base}/cells", year)
    return t.spark.read.parquet(f"{base}/cells")


_DAY, _NEW_DAY = dt.date(1996, 3, 2), dt.date(1997, 5, 3)
_CHANGED = LONG.replace("prices AS (", "all_prices AS (", 1) + f""",
prices AS (SELECT * REPLACE (CASE WHEN opr_dt = DATE '{_DAY}' THEN mw + 1 ELSE mw END AS mw)
    FROM all_prices)"""


@query("refresh_heatmap_one_day", _by_zone_sql(_CHANGED, _CELL, ", count(*) AS record_count"))
def _(t):
    base = scratch_path(t.spark, "partials")
    rows, paths_ = t.long(), (f"{base}/prices", f"{base}/partials")
    store.write_daily(rows.where(F.col("opr_dt") != F.lit(_NEW_DAY)), paths_[0])
    jobs.build_partials(t.spark, *paths_)
    raised = (F.col("mw") + 1).cast("decimal(12,4)")
    for day, price in ((_DAY, raised), (_NEW_DAY, F.col("mw"))):
        one = rows.where(F.col("opr_dt") == F.lit(day)).withColumn("mw", price)
        jobs.replace_days(t.spark, one, *paths_)
    return heatmaps.heatmap_of_partials(t.spark.read.parquet(paths_[1]), t.long_map())


@query(
    "calculate_bx",
    f"""WITH {pooled(DENSE)}, {_daily_cte('avg(mw)')} SELECT 'node' AS level, node, opr_dt, bx_type,
    CAST({stored('avg_price')} AS DOUBLE) AS avg_price FROM daily
    UNION ALL {_ZONE_ROWS}""",
)
def _(t):
    base = scratch_path(t.spark, "bx")
    mapping, where = t.dense_map(), (f"{base}/prices", f"{base}/daily")
    store.write_daily(t.dense(), where[0])
    # Some days have one Bx, some have three; then whatever is missing is added.
    jobs.calculate_bx(t.spark, *where, mapping, [4], end=DENSE_TO)
    jobs.calculate_bx(t.spark, *where, mapping, [4, 6, 8], start=DENSE_FROM, end=DENSE_TO)
    jobs.calculate_bx(t.spark, *where, mapping)
    daily = t.spark.read.parquet(where[1])
    return daily.select("level", "node", "opr_dt", "bx_type", "avg_price")


@query(
    "calculate_bx_again",
    f"""WITH {DENSE}, {DAILY} SELECT node, opr_dt, bx_type, CAST(avg_price
    + CASE WHEN {JAN} AND bx_type IN (4, 6) THEN 1 ELSE 0 END AS DOUBLE) AS avg_price FROM daily""",
)
def _(t):
    base = scratch_path(t.spark, "bx")
    mapping, where = t.dense_map(), (f"{base}/prices", f"{base}/daily")
    rows = t.dense()
    store.write_daily(rows, where[0])
    jobs.calculate_bx(t.spark, *where, mapping)
    raised = (F.col("mw") + 1).cast("decimal(12,4)")
    store.write_daily(rows.withColumn("mw", raised), where[0])
    jobs.calculate_bx(
        t.spark, *where, mapping, [4, 6], start=DENSE_FROM, end=DENSE_TO, force=True
    )
    daily = t.spark.read.parquet(where[1]).where("level = 'node'")
    return daily.select("node", "opr_dt", "bx_type", "avg_price")


def _zone_texts(zone_hourly):
    """A zone file per year, in two layouts below a preamble."""
    hours = (
        zone_hourly.groupBy("opr_dt", "hour_num")
        .pivot("zone", list(ZONE_HEADERS))
        .agg(F.first("lmp"))
        .withColumn("year", F.year("opr_dt"))
    )
    first, other = [
        F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns_])
        for columns_ in (
            ("opr_dt", "hour_num", *ZONE_HEADERS),
            ("hour_num", "opr_dt", "ZP26", "NP15", "SP15"),
        )
    ]
    even = F.col("year") % 2 == 0
    titles = F.when(
        even, F.lit("Local Date,Hour Number,NP-15 LMP,SP-15 LMP,ZP-26 LMP")
    ).otherwise(F.lit('"Hour Number","Local Date","ZP-26 LMP","NP-15 LMP","SP-15 LMP"'))
    lines = hours.select("year", titles.alias("titles"), F.when(even, first).otherwise(other).alias("row"))
    note = F.lit("Day-ahead prices\n\nin dollars, by zone")
    return lines.groupBy("year", "titles").agg(
        F.concat_ws("\n", note, "titles", F.collect_list("row")).alias("text")
    ).select(F.concat(F.col("year").cast("string"), F.lit(".csv")).alias("path"), "text")


def _save_texts(folder):
    def save(batches):
        from pyarrow import fs

        for batch in batches:
            for file, text in zip(batch["path"], batch["text"]):
                system, path = fs.FileSystem.from_uri(f"{folder}/{file}")
                system.create_dir(path.rsplit("/", 1)[0])
                with system.open_output_stream(path) as out:
                    out.write(text.encode())
            yield batch[["path"]]

    return save


@query("import_zone_files", f"WITH {of_means(_ZONE_HOURLY)} {_MEANS_ROWS}")
def _(t):
    base = scratch_path(t.spark, "zone-files")
    saved = _zone_texts(t.zone_hourly()).mapInPandas(_save_texts(f"{base}/files"), "path string")
    saved.write.parquet(f"{base}/saved")
    files = [f"{base}/files/{year}.csv" for year in range(1991, 2004)]
    # Some years have no file; 1995 comes twice, and the Bx of its days are written again.
    for some in (files[:5], files[4:]):
        jobs.import_zone_files(t.spark, some, f"{base}/hours", f"{base}/daily")
    daily = t.spark.read.parquet(f"{base}/daily")
    return daily.select("level", "node", "opr_dt", "bx_type", "avg_price")


@query("stream_daily_ingest", f"WITH {DENSE} {_KEY_PRICE}")
def _(t):
    base = scratch_path(t.spark, "stream")
    prices = t.dense().select("node", "opr_dt", "opr_hr", "mw")
    prices.repartition(6, "opr_hr").write.parquet(f"{base}/landing")
    arriving = ingest.parquet_stream(t.spark, f"{base}/landing", prices.schema, max_files=2)
    run = ingest.stream_daily_ingest(arriving, f"{base}/prices", f"{base}/checkpoint")
    run.awaitTermination()
    return store.read_prices(t.spark, f"{base}/prices").select("node", "opr_dt", "opr_hr", "mw")


@query(
    "stream_archives",
    f"""WITH {pooled(DENSE)}, {_daily_cte('avg(mw)')}, good AS (SELECT * FROM (
    SELECT 'node' AS level, node, opr_dt, bx_type,
    CAST({stored('avg_price')} AS DOUBLE) AS avg_price FROM daily
    UNION ALL {_ZONE_ROWS})) SELECT level, node, opr_dt, bx_type, avg_price FROM good
    WHERE {GOOD_DAYS}
    UNION ALL SELECT 'report', 'error', DATE '2024-01-01', count(DISTINCT opr_dt), NULL
    FROM prices WHERE NOT ({GOOD_DAYS})""",
)
def _(t):
    base = scratch_path(t.spark, "stream")
    mapping = t.dense_map()
    where = f"{base}/prices", f"{base}/checkpoint", "archives", f"{base}/daily", mapping
    # Two runs of the stream, the second after more archives have come.
    for days in (range(1, 16), range(16, 32)):
        landing = _landing(t, base, f"landing/{days[0]}", [*days], BROKEN)
        files = ingest.archive_files(t.spark, f"{base}/landing/*", max_files=4)
        ingest.stream_archives(files, *where, f"{base}/reports").awaitTermination()
    report = t.spark.read.parquet(f"{base}/reports").where("status = 'error'")
    failed = report.select(
        F.lit("report").alias("level"),
        F.lit("error").alias("node"),
        F.lit(dt.date(2024, 1, 1)).alias("opr_dt"),
        F.lit(0).alias("bx_type"),
        F.lit(None).cast("double").alias("avg_price"),
    )
    counted = failed.groupBy("level", "node", "opr_dt", "avg_price").agg(
        F.count(F.lit(1)).cast("int").alias("bx_type")
    )
    daily = t.spark.read.parquet(f"{base}/daily")
    columns_ = ["level", "node", "opr_dt", "bx_type", "avg_price"]
    return daily.select(*columns_).unionByName(counted.select(*columns_))


# ------------------------------------------------- tables kept beside the prices


def _indexed(t, base):
    """A node index filled by two loads that share a year."""
    prices = t.wide()
    for part in ("year(opr_dt) <= 1995", "year(opr_dt) >= 1995"):
        node_index.update_nodes(t.spark, f"{base}/index", prices.where(part))
    return f"{base}/index"


@query(
    "find_nodes",
    f"""WITH {WIDE} SELECT node, min(opr_dt) AS first_day, max(opr_dt) AS last_day
    FROM prices WHERE node ILIKE '%#0000000%' AND node ILIKE '%07%' GROUP BY node""",
)
def _(t):
    path = _indexed(t, scratch_path(t.spark, "nodes"))
    known = node_index.read_nodes(t.spark, path)
    hits = node_index.find_nodes(t.spark, path, "r#0000000")
    short = node_index.find_nodes(t.spark, path, "07")
    return known.join(hits, "node").join(short, "node").select("node", "first_day", "last_day")


@query(
    "stored_nodes",
    f"""WITH {WIDE}, {MAPPING} SELECT 'stored' AS origin, node FROM prices GROUP BY node
    UNION ALL SELECT DISTINCT 'mapping', pnode_id FROM mapping""",
)
def _(t):
    base = scratch_path(t.spark, "nodes")
    fallback = node_index.stored_nodes(t.spark, f"{base}/nothing", t.wide_map())
    stored = node_index.stored_nodes(t.spark, _indexed(t, base), t.wide_map())
    return stored.select(F.lit("stored").alias("origin"), "node").union(
        fallback.select(F.lit("mapping"), "node")
    )


def _summed(t):
    base = scratch_path(t.spark, "sums")
    daily = bx.bx_daily(t.wide())
    # The days of 1995 come twice and count once.
    for part in ("year(opr_dt) <= 1995", "year(opr_dt) >= 1995"):
        where = f"{base}/index", f"{base}/sums"
        summaries.keep_bx_sums(t.spark, daily.where(part), t.wide_map(), *where)
    return t.spark.read.parquet(f"{base}/sums")


@query("bx_trend_of_sums", _trend_sql(WIDE, _MONTH))
def _(t):
    return bx_sums.trend_of_sums(_summed(t), 5, aggregation="monthly")


@query("bx_average_of_sums", _average_sql(WIDE, "AND zone = 'NP15' AND year(opr_dt) > 1994"))
def _(t):
    return bx_sums.average_of_sums(_summed(t), 6, start=dt.date(1995, 1, 1), zone="NP15")


def _sides(answer):
    price = F.col("mw").cast("double")
    return {"_below": price < answer, "_upto": price <= answer}


def _within_bound(of, wanted):
    """Whether the rank of each answer among the prices themselves is the wanted one."""
    within = F.lit(True)
    for name, fraction in wanted.items():
        below, upto = (F.col(f"{name}{of}{label}") / F.col("n") for label in ("_below", "_upto"))
        within &= below <= fraction + sketches.RANK_ERROR
        within &= upto >= fraction - sketches.RANK_ERROR
    return within.alias("within_bound")


@query(
    "price_quantile_sketches",
    f"""WITH {WIDE} SELECT node, count(*) AS count, {r('avg(mw)')} AS avg,
    CAST(min(mw) AS DOUBLE) AS min, CAST(max(mw) AS DOUBLE) AS max, TRUE AS within_bound
    FROM prices GROUP BY node
    UNION ALL SELECT 'all nodes', count(*), {r('avg(mw)')}, CAST(min(mw) AS DOUBLE),
    CAST(max(mw) AS DOUBLE), TRUE FROM prices""",
)
def _(t):
    path = scratch_path(t.spark, "sketches")
    prices = t.wide()
    for part in ("year(opr_dt) <= 1995", "year(opr_dt) >= 1995"):
        summaries.keep_sketches(t.spark, prices.where(part), path)
    kept = t.spark.read.parquet(path)
    wanted = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    own = sketches.sketch_profile(kept, ["node"], wanted)
    everything = kept.withColumn("node", F.lit("all nodes"))
    total = sketches.sketch_profile(everything, ["node"], wanted)
    # The one row of all nodes is a scalar and its counts come node by node, so that no
    # task reads all prices.
    bounds = total.select(F.struct(*wanted).alias("_all")).scalar()
    sides = prices.join(own.select("node", F.struct(*wanted).alias("_own")), "node", "left")
    counted = cut_lineage(
        sides.select("node", "mw", "_own", bounds.alias("_all"))
        .groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.count(F.when(side, 1)).alias(f"{name}{of}{label}")
                for name in wanted
                for of in ("_own", "_all")
                for label, side in _sides(F.col(of)[name]).items()
            ],
        ),
        "ranks",
    )
    checks = (
        (own, counted.select("node", _within_bound("_own", wanted))),
        (
            total,
            counted.groupBy(F.lit("all nodes").alias("node"))
            .agg(*[F.sum(c).alias(c) for c in counted.columns if c != "node"])
            .select("node", _within_bound("_all", wanted)),
        ),
    )
    columns_ = ["node", "count", "avg", "min", "max", "within_bound"]
    parts = [profile.join(found, "node").select(*columns_) for profile, found in checks]
    return parts[0].unionByName(parts[1])


def _bucketed(t):
    """Prices and mapping bucketed alike, the years of 1995 and after written again."""
    base = scratch_path(t.spark, "bucketed")
    name = base.rsplit("-", 1)[1]
    prices = bucketed.open_prices(t.spark, f"prices_{name}", f"{base}/prices", 8)
    mapping = bucketed.open_mapping(t.spark, f"mapping_{name}", f"{base}/mapping", 8)
    bucketed.replace_mapping(t.wide_map(), f"mapping_{name}")
    for part in ("year(opr_dt) <= 1995", "year(opr_dt) >= 1995"):
        bucketed.replace_months(t.wide().where(part), f"prices_{name}")
    return prices, mapping


@query("bx_zone_pooled_bucketed", f"WITH {pooled(WIDE)} {_ZONE_ROWS}")
def _(t):
    return bx.bx_zone_pooled(*_bucketed(t))


@query("month_hour_heatmap_bucketed", _by_zone_sql(WIDE, _CELL, ", count(*) AS record_count"))
def _(t):
    return heatmaps.month_hour_heatmap(*_bucketed(t))


@query("price_spikes_by_day", _spikes_sql(WIDE, 2))
def _(t):
    path = scratch_path(t.spark, "spikes")
    prices = t.wide()
    # New days come after the stored ones; those from 1996 on come again.
    for part in ("< 1994", "IN (1994, 1995)", "IN (1996, 1997)", ">= 1996"):
        days = prices.where(f"year(opr_dt) {part}")
        summaries.append_spikes(t.spark, days, path, threshold_std=2)
    return summaries.read_spikes(t.spark, path)
