"""Sources, projection, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import sources, views
from driftwarden.catalog.base import DIRTY, FLOW, TRAFFIC, query, with_ctes
from driftwarden.operators import clean
from driftwarden.plans.scale import scratch_path
from driftwarden.views import FEATURES

FLOW_COLUMNS = ["row_key", "dst_port", "protocol", *FEATURES, "label"]
FLOW_LIST = ", ".join(FLOW_COLUMNS)

CSV_SCHEMA = (
    "row_key string, dst_port int, protocol string, flow_duration bigint, pkt_len_mean bigint, "
    "pkt_size_avg bigint, rst_flag_cnt bigint, label int"
)


@query("s1_read_flows_csv", with_ctes(FLOW, select=f"SELECT {FLOW_LIST} FROM flow"))
def s1(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string

    path = scratch_path(spark, "flows-csv")
    views.flow_view(spark, sf_dir).select(*FLOW_COLUMNS).write.option("header", True).csv(path)
    return sources.read_flows(spark, [path, path + "-absent"], _parse_datatype_string(CSV_SCHEMA), required=["label", "dst_port"])


@query("s1_read_flows_mixed_folder", with_ctes(FLOW, select=f"SELECT {FLOW_LIST} FROM flow WHERE dst_port <> 7"))
def s1_mixed(spark, sf_dir):
    """One folder whose files differ in the order of their columns; files without a label are left out."""
    from pyspark.sql.types import _parse_datatype_string

    path, rows = scratch_path(spark, "flows-mixed"), views.flow_view(spark, sf_dir).select(*FLOW_COLUMNS)
    for part, columns in (("dst_port < 4", FLOW_COLUMNS), ("dst_port in (4, 5, 6)", FLOW_COLUMNS[::-1]), ("dst_port = 7", FLOW_COLUMNS[:-1])):
        rows.filter(part).select(*columns).write.mode("append").option("header", True).csv(path)
    return sources.read_flows(spark, [path], _parse_datatype_string(CSV_SCHEMA), required=["label", "dst_port"])


@query("s1_read_flows_parquet", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity > 25")
def s1_parquet(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    df = sources.read_flows(
        spark, [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/absent.parquet"], schema, fmt="parquet", required=["l_quantity"]
    )
    return df.filter(F.col("l_quantity") > 25).select("l_orderkey", "l_quantity", "l_extendedprice")


@query(
    "s2_union_sources",
    with_ctes(
        FLOW,
        TRAFFIC,
        select="""
SELECT row_key, flow_duration, NULL::DOUBLE AS flow_byts_s, label FROM flow
UNION ALL SELECT 'e' || event_id::VARCHAR, NULL, flow_byts_s, label FROM traffic""",
    ),
)
def s2(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir).select("row_key", "flow_duration", "label")
    traffic = views.traffic_view(spark, sf_dir).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("row_key"), "flow_byts_s", "label"
    )
    return sources.union_sources([flows, traffic]).select("row_key", "flow_duration", "flow_byts_s", "label")


@query("s3_write_predictions", with_ctes(FLOW, select="SELECT row_key, prediction_probability, prediction FROM flow"))
def s3(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    sources.write_predictions(
        views.flow_view(spark, sf_dir).select("row_key", "prediction_probability", "prediction"), path
    )
    return (
        spark.read.schema("row_key string, prediction_probability double, prediction int").option("header", True).csv(path)
    )


@query("s5_require_columns", with_ctes(FLOW, select="SELECT row_key, flow_duration FROM flow"))
def s5(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir)
    return sources.require_columns(flows, [*FEATURES, "label"]).select("row_key", "flow_duration")


@query(
    "s6_report_json",
    with_ctes(
        FLOW,
        select="""
SELECT '{"protocol":"' || protocol || '","flows":' || count(*)::VARCHAR || ',"anomalies":' ||
       sum(prediction)::BIGINT::VARCHAR || '}' AS report FROM flow GROUP BY protocol""",
    ),
)
def s6(spark, sf_dir):
    summary = (
        views.flow_view(spark, sf_dir)
        .groupBy("protocol")
        .agg(F.count(F.lit(1)).alias("flows"), F.sum("prediction").alias("anomalies"))
    )
    return sources.report_json(summary)


@query("p1_normalise_names", 'SELECT l_orderkey AS order_key, l_quantity AS quantity_units FROM lineitem')
def p1(spark, sf_dir):
    raw = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(" Order Key"), F.col("l_quantity").alias("Quantity (Units) ")
    )
    return clean.normalise_names(raw)


@query("p2_drop_identifiers", with_ctes(FLOW, select="SELECT row_key, dst_port, flow_duration, label FROM flow"))
def p2(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir).select(
        "row_key", "src_ip", "dst_ip", F.col("ts").alias("timestamp"), "dst_port", "flow_duration", "label"
    )
    return clean.drop_identifiers(flows)


@query(
    "p3_null_inf_audit",
    with_ctes(
        TRAFFIC,
        DIRTY,
        select="""
SELECT 'flow_byts_s' AS "column", count(*) FILTER (flow_byts_s IS NULL OR isnan(flow_byts_s)) AS missing,
       count(*) FILTER (isinf(flow_byts_s)) AS infinite FROM dirty
UNION ALL SELECT 'flow_pkts_s', count(*) FILTER (flow_pkts_s IS NULL OR isnan(flow_pkts_s)),
       count(*) FILTER (isinf(flow_pkts_s)) FROM dirty
UNION ALL SELECT 'pkt_size_avg', count(*) FILTER (pkt_size_avg IS NULL), 0 FROM dirty""",
    ),
)
def p3(spark, sf_dir):
    return clean.null_inf_audit(views.dirty_view(spark, sf_dir), ["flow_byts_s", "flow_pkts_s", "pkt_size_avg"])


@query(
    "p4_sanitise_zero",
    with_ctes(
        TRAFFIC,
        DIRTY,
        select="""
SELECT event_id, CASE WHEN flow_byts_s IS NULL OR isnan(flow_byts_s) OR isinf(flow_byts_s) THEN 0
       ELSE CAST(trunc(flow_byts_s) AS BIGINT) END AS flow_byts_s,
       CAST(trunc(flow_pkts_s) AS BIGINT) AS flow_pkts_s FROM dirty""",
    ),
)
def p4(spark, sf_dir):
    dirty = views.dirty_view(spark, sf_dir).select("event_id", "flow_byts_s", "flow_pkts_s")
    return clean.sanitise_zero(dirty, ["flow_byts_s", "flow_pkts_s"])


@query(
    "p5_drop_unclean_rows",
    with_ctes(
        TRAFFIC,
        DIRTY,
        select="""
SELECT event_id, flow_byts_s, pkt_size_avg FROM dirty
WHERE flow_byts_s IS NOT NULL AND NOT isnan(flow_byts_s) AND NOT isinf(flow_byts_s) AND pkt_size_avg IS NOT NULL""",
    ),
)
def p5(spark, sf_dir):
    return clean.drop_unclean_rows(views.dirty_view(spark, sf_dir).select("event_id", "flow_byts_s", "pkt_size_avg"))


@query(
    "p6_impute_mean",
    with_ctes(
        TRAFFIC,
        DIRTY,
        """finite AS (SELECT event_id, CASE WHEN isinf(flow_byts_s) THEN NULL ELSE flow_byts_s END AS v FROM dirty)""",
        select="""
SELECT event_id, round(CASE WHEN v IS NULL OR isnan(v) THEN (SELECT avg(v) FROM finite WHERE v IS NOT NULL AND NOT isnan(v))
       ELSE v END, 6) AS flow_byts_s FROM finite""",
    ),
)
def p6(spark, sf_dir):
    finite = views.dirty_view(spark, sf_dir).select(
        "event_id", F.when(F.abs("flow_byts_s") != float("inf"), F.col("flow_byts_s")).alias("flow_byts_s")
    )
    return clean.impute_mean(finite, ["flow_byts_s"]).select("event_id", F.round("flow_byts_s", 6).alias("flow_byts_s"))


@query(
    "p7_select_features",
    with_ctes(FLOW, select=f"SELECT {', '.join(FEATURES)}, label FROM flow"),
)
def p7(spark, sf_dir):
    return clean.select_features(views.flow_view(spark, sf_dir), FEATURES, "label")


@query(
    "p8_encode_label",
    "SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code FROM events",
)
def p8(spark, sf_dir):
    return clean.encode_label(views.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").select(
        "event_id", "event_type", "code"
    )


@query(
    "p9_binarise_label",
    "SELECT l_orderkey, l_linestatus, CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END AS binary FROM lineitem",
)
def p9(spark, sf_dir):
    return clean.binarise_label(views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus"), "l_linestatus")


@query(
    "p9_one_hot",
    """SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS "l_returnflag_A",
CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS "l_returnflag_N", CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS "l_returnflag_R"
FROM lineitem""",
)
def p9_one_hot(spark, sf_dir):
    df = clean.one_hot(views.table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R"])
    return df.select("l_orderkey", "l_returnflag_A", "l_returnflag_N", "l_returnflag_R")


SAMPLE_IDS = with_ctes(FLOW, select='SELECT row_key, row_number() OVER (ORDER BY row_key) AS "Sample_ID" FROM flow')


@query("p10_add_sample_id", SAMPLE_IDS)
def p10(spark, sf_dir):
    return clean.add_sample_id(views.flow_view(spark, sf_dir).select("row_key"), ["row_key"])


@query("p10_add_sample_id_split", SAMPLE_IDS)
def p10_split(spark, sf_dir):
    return clean.add_sample_id(views.flow_view(spark, sf_dir).select("row_key"), ["row_key"], layout="split")


@query(
    "f1_filter_label_ports",
    with_ctes(FLOW, select="SELECT row_key, dst_port, label FROM flow WHERE label = 1 AND dst_port IN (1, 3, 5, 7, 9)"),
)
def f1(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir).select("row_key", "dst_port", "label")
    return clean.filter_label_ports(flows, views.TARGET_PORTS, label="label")


@query(
    "f2_class_slices",
    with_ctes(
        FLOW,
        select="""
SELECT label AS class, side, row_key, flow_duration FROM flow WHERE side = 'train'
UNION ALL SELECT prediction, side, row_key, flow_duration FROM flow WHERE side = 'runtime'""",
    ),
)
def f2(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir)
    return clean.class_slices(views.train_rows(flows), views.runtime_rows(flows), ["flow_duration"], extra=["row_key"])


@query(
    "f3_split_by_correctness",
    with_ctes(
        FLOW,
        select="""
SELECT row_key, label, 'wrong' AS outcome FROM flow WHERE label <> prediction
UNION ALL SELECT row_key, label, 'right' FROM flow WHERE label = prediction AND label = 1""",
    ),
)
def f3(spark, sf_dir):
    flows = views.flow_view(spark, sf_dir)
    wrong = clean.split_by_correctness(flows, False).select("row_key", "label", F.lit("wrong").alias("outcome"))
    right = clean.split_by_correctness(flows, True, only_class=1).select("row_key", "label", F.lit("right").alias("outcome"))
    return wrong.unionByName(right)


@query("f4_predicted_anomalies", with_ctes(FLOW, select="SELECT row_key, prediction_probability FROM flow WHERE prediction = 1"))
def f4(spark, sf_dir):
    return clean.predicted_anomalies(views.flow_view(spark, sf_dir)).select("row_key", "prediction_probability")
