"""Registry of named queries and the SQL pieces they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the statement that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def with_ctes(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + select.strip()


FLOW = """
flow0 AS (
  SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' ||
         l_suppkey::VARCHAR || '-' || CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR AS row_key,
         l_shipdate AS ts, 's' || l_suppkey::VARCHAR AS src_ip, 'd' || l_partkey::VARCHAR AS dst_ip,
         l_linenumber AS dst_port, l_returnflag AS protocol,
         CAST(trunc(l_extendedprice) AS BIGINT) AS flow_duration,
         CAST(trunc(l_quantity) AS BIGINT) AS pkt_len_mean,
         CAST(trunc(l_extendedprice / l_quantity) AS BIGINT) AS pkt_size_avg,
         CAST(round(l_discount * 100) AS BIGINT) AS syn_flag_cnt,
         CAST(round(l_tax * 100) AS BIGINT) AS rst_flag_cnt,
         CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS label,
         CASE WHEN l_shipdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'train' ELSE 'runtime' END AS side
  FROM lineitem),
flow AS (
  SELECT *, CAST(syn_flag_cnt + rst_flag_cnt AS DOUBLE) / CAST(18 AS DOUBLE) AS prediction_probability,
         CASE WHEN CAST(syn_flag_cnt + rst_flag_cnt AS DOUBLE) / CAST(18 AS DOUBLE) > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM flow0)
"""

DRIFT = """
drift AS (
  SELECT * REPLACE (
    CASE WHEN side = 'runtime' THEN CAST(trunc(flow_duration * CAST(1.3 AS DOUBLE)) AS BIGINT) ELSE flow_duration END AS flow_duration,
    CASE WHEN side = 'runtime' THEN pkt_len_mean + 10 ELSE pkt_len_mean END AS pkt_len_mean)
  FROM flow)
"""

TRAFFIC = """
traffic AS (
  SELECT event_id, ts AS timestamp, event_type, value AS flow_byts_s, value / CAST(10 AS DOUBLE) AS flow_pkts_s,
         TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS pkt_size_avg,
         least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) AS prediction_probability,
         CASE WHEN least(CAST(1 AS DOUBLE), value / CAST(100 AS DOUBLE)) > 0.5 THEN 1 ELSE 0 END AS prediction,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM events)
"""

DIRTY = """
dirty AS (
  SELECT * REPLACE (
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN CAST('nan' AS DOUBLE)
         WHEN event_id % 23 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 29 = 0 THEN CAST('-inf' AS DOUBLE)
         ELSE flow_byts_s END AS flow_byts_s)
  FROM traffic)
"""


def sliced(source: str = "flow", name: str = "sliced") -> str:
    """Train rows by label and runtime rows by prediction."""
    return f"""
{name} AS (
  SELECT label AS class, side, row_key, flow_duration, pkt_len_mean, pkt_size_avg, rst_flag_cnt
  FROM {source} WHERE side = 'train'
  UNION ALL
  SELECT prediction AS class, side, row_key, flow_duration, pkt_len_mean, pkt_size_avg, rst_flag_cnt
  FROM {source} WHERE side = 'runtime')
"""


def melted(source: str, keys: str, name: str = "melted") -> str:
    """One row per feature; ``keys`` is a comma-separated column list."""
    return f"""
{name} AS (
  SELECT {keys}, side, 'flow_duration' AS feature, flow_duration AS value FROM {source}
  UNION ALL SELECT {keys}, side, 'pkt_len_mean', pkt_len_mean FROM {source}
  UNION ALL SELECT {keys}, side, 'pkt_size_avg', pkt_size_avg FROM {source}
  UNION ALL SELECT {keys}, side, 'rst_flag_cnt', rst_flag_cnt FROM {source})
"""


def counted(source: str, keys: str, name: str = "counted", first: str = "train") -> str:
    return f"""
{name} AS (
  SELECT {keys}, value, sum(CASE WHEN side = '{first}' THEN 1 ELSE 0 END)::BIGINT AS x,
         sum(CASE WHEN side = '{first}' THEN 0 ELSE 1 END)::BIGINT AS y
  FROM {source} GROUP BY ALL)
"""


def stepped(source: str, keys: str, name: str = "stepped") -> str:
    return f"""
{name} AS (
  SELECT {keys}, value,
         (sum(x) OVER (PARTITION BY {keys} ORDER BY value))::BIGINT AS cx,
         (sum(y) OVER (PARTITION BY {keys} ORDER BY value))::BIGINT AS cy,
         (sum(x) OVER (PARTITION BY {keys}))::BIGINT AS nx,
         (sum(y) OVER (PARTITION BY {keys}))::BIGINT AS ny,
         lead(value) OVER (PARTITION BY {keys} ORDER BY value) AS next_value
  FROM {source})
"""


def measured(source: str, keys: str, name: str = "measured", less: int = 2) -> str:
    return f"""
{name}_h AS (
  SELECT {keys}, nx, ny, cx + cy AS c, nx + ny AS n,
         CAST(cy AS DOUBLE) / nullif(ny, 0) - CAST(cx AS DOUBLE) / nullif(nx, 0) AS h,
         sqrt(CAST(cx + cy AS DOUBLE) * CAST(nx + ny - cx - cy AS DOUBLE) / CAST(nx + ny AS DOUBLE)) AS sd,
         CAST(next_value - value AS DOUBLE) AS w
  FROM {source}),
{name} AS (
  SELECT {keys},
         CASE WHEN ok THEN ad ELSE nan END AS Anderson_Darling, CASE WHEN ok THEN cvm ELSE nan END AS CVM,
         CASE WHEN ok THEN dts ELSE nan END AS DTS, CASE WHEN ok THEN greatest(up, -down) ELSE nan END AS Kolmogorov_Smirnov,
         CASE WHEN ok THEN up + abs(down) ELSE nan END AS Kuiper, CASE WHEN ok THEN wd ELSE nan END AS Wasserstein
  FROM (SELECT {keys}, CAST('nan' AS DOUBLE) AS nan, bool_or(nx > 0 AND ny > 0) AS ok,
               coalesce(sum(CASE WHEN sd > 0 THEN abs(h) / sd ELSE 0 END) FILTER (c <= n - {less}), 0) AS ad,
               coalesce(sum(abs(h)) FILTER (c <= n - {less}), 0) AS cvm,
               coalesce(sum(CASE WHEN sd > 0 THEN abs(h) / sd * w ELSE 0 END) FILTER (c <= n - {less}), 0) AS dts,
               greatest(coalesce(max(h) FILTER (c <= n - {less}), 0), 0) AS up,
               least(coalesce(min(h) FILTER (c <= n - {less}), 0), 0) AS down,
               coalesce(sum(abs(h) * w) FILTER (c <= n - {less}), 0) AS wd
        FROM {name}_h GROUP BY {keys}))
"""


# Decimal places kept of each measure; the gap-weighted sums are large numbers.
PLACES = {
    "Anderson_Darling": 6,
    "CVM": 6,
    "DTS": 4,
    "Kolmogorov_Smirnov": 6,
    "Kuiper": 6,
    "Wasserstein": 4,
}
ROUNDED = ", ".join(f"round({m}, {p}) AS {m}" for m, p in PLACES.items())


def per_class(source: str = "measured", keys: str = "class", name: str = "per_class") -> str:
    means = ", ".join(f"avg({m}) AS {m}" for m in PLACES)
    return f"{name} AS (SELECT {keys}, {means} FROM {source} GROUP BY {keys})"


def distance_ctes(source: str = "flow", keys: str = "class, feature", less: int = 2) -> list[str]:
    return [
        sliced(source),
        melted("sliced", "class"),
        counted("melted", keys),
        stepped("counted", keys),
        measured("stepped", keys, less=less),
    ]
