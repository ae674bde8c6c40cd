"""Sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import views
from driftwarden.catalog.base import FLOW, query, with_ctes
from driftwarden.operators import sample

KEY = ["row_key"]
COLUMNS = ["row_key", "dst_port", "label", "side"]


def flows(spark, sf_dir):
    return views.flow_view(spark, sf_dir).select(*COLUMNS)


def place(tag: str, partition: str = "", seed: int = 42) -> str:
    by = f"PARTITION BY {partition} " if partition else ""
    return f"row_number() OVER ({by}ORDER BY md5('{seed}|{tag}|' || row_key), row_key)"


@query(
    "x1_sample_by_key",
    with_ctes(FLOW, select=f"""
SELECT row_key, dst_port, label, side FROM (
  SELECT *, {place('sample_by_key', 'dst_port')} AS place, count(*) OVER (PARTITION BY dst_port) AS n FROM flow)
WHERE place <= floor(CASE dst_port WHEN 1 THEN CAST(0.3 AS DOUBLE) WHEN 3 THEN CAST(0.2 AS DOUBLE) WHEN 5 THEN CAST(0.3 AS DOUBLE)
               ELSE CAST(1 AS DOUBLE) END * n + 0.5)"""),
)
def x1(spark, sf_dir):
    return sample.sample_by_key(flows(spark, sf_dir), "dst_port", {1: 0.3, 3: 0.2, 5: 0.3}, KEY)


@query(
    "x2_resample_to_size",
    with_ctes(FLOW, f"""
have AS (SELECT *, {place('resample', 'label')} AS place, count(*) OVER (PARTITION BY label) AS n FROM flow),
sizes AS (SELECT 0 AS label, (SELECT CAST(count(*) // 3 AS BIGINT) FROM lineitem) AS want
          UNION ALL SELECT 1, (SELECT CAST(count(*) AS BIGINT) FROM lineitem)),
numbers AS (SELECT label, unnest(range(1, want + 1)) AS i FROM sizes),
draws AS (
  SELECT numbers.label, ('0x' || substr(md5('42|replace|' || i::VARCHAR || '|' || numbers.label::VARCHAR), 1, 15))::BIGINT % t.n + 1 AS place
  FROM numbers JOIN (SELECT label, max(n) AS n FROM have GROUP BY label) t USING (label) JOIN sizes s ON s.label = numbers.label
  WHERE t.n < s.want)""", select="""
SELECT row_key, dst_port, label, side FROM have JOIN sizes USING (label) WHERE n >= want AND place <= want
UNION ALL
SELECT row_key, dst_port, label, side FROM draws JOIN have USING (label, place)"""),
)
def x2(spark, sf_dir):
    """Class 0 is cut to a third of the table, class 1 is drawn up to the table's size."""
    rows = flows(spark, sf_dir)
    n = rows.count()
    return sample.resample_to_size(rows, "label", {0: n // 3, 1: n}, KEY)


@query(
    "x3_random_split",
    with_ctes(FLOW, select=f"""
SELECT row_key, CASE WHEN {place('random_split')} <= floor(CAST(0.3 AS DOUBLE) * count(*) OVER () + 0.5) THEN 'test' ELSE 'train' END AS split FROM flow"""),
)
def x3(spark, sf_dir):
    return sample.random_split(flows(spark, sf_dir), 0.3, KEY).select("row_key", "split")


@query(
    "x4_stratified_split",
    with_ctes(FLOW, select=f"""
SELECT row_key, label, CASE WHEN {place('stratified_split', 'label')} <= floor(CAST(0.33 AS DOUBLE) * count(*) OVER (PARTITION BY label) + 0.5)
  THEN 'test' ELSE 'train' END AS split FROM flow"""),
)
def x4(spark, sf_dir):
    return sample.stratified_split(flows(spark, sf_dir), "label", 0.33, KEY).select("row_key", "label", "split")


KFOLD = with_ctes(FLOW, select="""
SELECT row_key, label, CAST((row_number() OVER (PARTITION BY label ORDER BY row_key) - 1) % 10 AS INTEGER) AS fold FROM flow""")


@query("x5_stratified_kfold_ordered", KFOLD)
def x5(spark, sf_dir):
    return sample.stratified_kfold(flows(spark, sf_dir), "label", 10, KEY).select("row_key", "label", "fold")


@query("x5_stratified_kfold_ordered_split", KFOLD)
def x5_split(spark, sf_dir):
    return sample.stratified_kfold(flows(spark, sf_dir), "label", 10, KEY, layout="split").select("row_key", "label", "fold")


@query(
    "x5_stratified_kfold_shuffled",
    with_ctes(FLOW, select=f"SELECT row_key, label, CAST(({place('stratified_kfold', 'label', 3)} - 1) % 3 AS INTEGER) AS fold FROM flow"),
)
def x5_shuffled(spark, sf_dir):
    return sample.stratified_kfold(flows(spark, sf_dir), "label", 3, KEY, seed=3).select("row_key", "label", "fold")


@query(
    "x6_head_sample",
    with_ctes(FLOW, select="""
SELECT row_key, dst_port FROM (SELECT *, row_number() OVER (ORDER BY row_key) AS place, count(*) OVER () AS n FROM flow)
WHERE place <= greatest(50, CAST(floor(CAST(0.0008 AS DOUBLE) * n) AS BIGINT))"""),
)
def x6(spark, sf_dir):
    return sample.head_sample(flows(spark, sf_dir), KEY).select("row_key", "dst_port")


# The same over rows of which some have no label: null is a stratum like any other.
UNLABELLED = f"""
flow_null AS (SELECT * REPLACE (CASE WHEN dst_port = 4 THEN NULL ELSE label END AS label) FROM flow)
"""


def unlabelled_flows(spark, sf_dir):
    rows = flows(spark, sf_dir)
    return rows.withColumn("label", F.when(F.col("dst_port") == 4, F.lit(None)).otherwise(F.col("label")))


X4_NULL = with_ctes(FLOW, UNLABELLED, select=f"""
SELECT row_key, label, CASE WHEN {place('stratified_split', 'label')} <= floor(CAST(0.33 AS DOUBLE) * count(*) OVER (PARTITION BY label) + 0.5)
  THEN 'test' ELSE 'train' END AS split FROM flow_null""")

X5_NULL = with_ctes(FLOW, UNLABELLED, select="""
SELECT row_key, label, CAST((row_number() OVER (PARTITION BY label ORDER BY row_key) - 1) % 10 AS INTEGER) AS fold FROM flow_null""")


@query("x4_stratified_split_null_labels", X4_NULL)
def x4_null(spark, sf_dir):
    return sample.stratified_split(unlabelled_flows(spark, sf_dir), "label", 0.33, KEY).select("row_key", "label", "split")


@query("x5_kfold_null_labels", X5_NULL)
def x5_null(spark, sf_dir):
    found = sample.stratified_kfold(unlabelled_flows(spark, sf_dir), "label", 10, KEY)
    return found.select("row_key", "label", "fold")


@query("x5_kfold_null_labels_split", X5_NULL)
def x5_null_split(spark, sf_dir):
    found = sample.stratified_kfold(unlabelled_flows(spark, sf_dir), "label", 10, KEY, layout="split")
    return found.select("row_key", "label", "fold")


@query(
    "x5_kfold_null_labels_shuffled",
    with_ctes(FLOW, UNLABELLED, select=f"SELECT row_key, label, CAST(({place('stratified_kfold', 'label', 3)} - 1) % 3 AS INTEGER) AS fold FROM flow_null"),
)
def x5_null_shuffled(spark, sf_dir):
    return sample.stratified_kfold(unlabelled_flows(spark, sf_dir), "label", 3, KEY, seed=3).select("row_key", "label", "fold")
