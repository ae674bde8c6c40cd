"""Evaluation, aggregates, time windows and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwarden import views
from driftwarden.catalog.base import FLOW, TRAFFIC, query, with_ctes
from driftwarden.catalog.decisions import ALL_SQL, STABLE_SQL, baseline, runtime
from driftwarden.operators import clean, decide, evaluate, report, text, traffic
from driftwarden.views import FEATURES


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- evaluation -------------------------------------------------------------------------------

CONFUSION = """
cm AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM flow)
"""


@query(
    "v1_binary_metrics",
    with_ctes(FLOW, CONFUSION, select="""
SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0), 6) AS specificity
FROM cm"""),
)
def v1(spark, sf_dir):
    return rounded(
        evaluate.binary_metrics(views.flow_view(spark, sf_dir)), ["accuracy", "precision", "recall", "f1", "specificity"]
    )


AUC = with_ctes(FLOW, """
pos AS (SELECT prediction_probability AS s, count(*) AS n FROM flow WHERE label = 1 GROUP BY 1),
neg AS (SELECT prediction_probability AS s, count(*) AS n FROM flow WHERE label = 0 GROUP BY 1)""", select="""
SELECT round(sum(CAST(pos.n * neg.n AS DOUBLE) * CASE WHEN pos.s > neg.s THEN CAST(1 AS DOUBLE) WHEN pos.s = neg.s THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
       / sum(CAST(pos.n * neg.n AS DOUBLE)), 6) AS roc_auc FROM pos, neg""")


@query("v2_roc_auc", AUC)
def v2(spark, sf_dir):
    return rounded(evaluate.roc_auc(views.flow_view(spark, sf_dir), "prediction_probability"), ["roc_auc"])


@query("v2_roc_auc_split", AUC)
def v2_split(spark, sf_dir):
    return rounded(evaluate.roc_auc(views.flow_view(spark, sf_dir), "prediction_probability", layout="split"), ["roc_auc"])


@query(
    "v3_confusion_matrix",
    with_ctes(FLOW, select="""
SELECT CAST(actual AS INTEGER) AS actual, count(*) FILTER (label = actual AND prediction = 0) AS predicted_0,
  count(*) FILTER (label = actual AND prediction = 1) AS predicted_1, count(*) FILTER (label = actual AND prediction = 2) AS predicted_2
FROM flow, (SELECT unnest([0, 1, 2]) AS actual) GROUP BY actual"""),
)
def v3(spark, sf_dir):
    return evaluate.confusion_matrix(views.flow_view(spark, sf_dir), [0, 1, 2])


@query(
    "v4_classification_report",
    """
WITH l AS (SELECT quality AS t, 1 - toxic AS p FROM labels),
per AS (
  SELECT c::VARCHAR AS class, coalesce(CAST(count(*) FILTER (t = c AND p = c) AS DOUBLE) / nullif(count(*) FILTER (p = c), 0), 0) AS precision,
    coalesce(CAST(count(*) FILTER (t = c AND p = c) AS DOUBLE) / nullif(count(*) FILTER (t = c), 0), 0) AS recall,
    coalesce(CAST(2 * count(*) FILTER (t = c AND p = c) AS DOUBLE) / nullif(count(*) FILTER (t = c) + count(*) FILTER (p = c), 0), 0) AS f1,
    count(*) FILTER (t = c) AS support
  FROM l, (SELECT unnest([0, 1]) AS c) GROUP BY c)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM per
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM per""",
)
def v4(spark, sf_dir):
    rows = views.table(spark, sf_dir, "labels").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))
    return rounded(evaluate.classification_report(rows), ["precision", "recall", "f1"])


@query(
    "v5_class_weights",
    with_ctes(FLOW, select="""
SELECT prediction, count(*) AS rows, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM flow), 6) AS weight FROM flow GROUP BY prediction"""),
)
def v5(spark, sf_dir):
    return rounded(evaluate.class_weights(views.flow_view(spark, sf_dir)), ["weight"])


WILSON = """
round((p + 3.29::DOUBLE * 3.29::DOUBLE / (2 * n) - 3.29::DOUBLE * sqrt((p * (1 - p) + 3.29::DOUBLE * 3.29::DOUBLE / (4 * n)) / n)) / (1 + 3.29::DOUBLE * 3.29::DOUBLE / n), 6) AS lower_bound,
round((p + 3.29::DOUBLE * 3.29::DOUBLE / (2 * n) + 3.29::DOUBLE * sqrt((p * (1 - p) + 3.29::DOUBLE * 3.29::DOUBLE / (4 * n)) / n)) / (1 + 3.29::DOUBLE * 3.29::DOUBLE / n), 6) AS upper_bound
"""


@query(
    "k13_wilson_interval",
    f"""
WITH g AS (SELECT quality, avg(toxic::DOUBLE) AS p, count(*)::DOUBLE AS n FROM labels GROUP BY quality)
SELECT quality, {WILSON} FROM g""",
)
def k13(spark, sf_dir):
    groups = views.table(spark, sf_dir, "labels").groupBy("quality").agg(F.avg("toxic").alias("p"), F.count(F.lit(1)).alias("n"))
    found = evaluate.wilson_interval(groups, "p", "n")
    return rounded(found.select("quality", "lower_bound", "upper_bound"), ["lower_bound", "upper_bound"])


@query(
    "k14_class_reliability",
    with_ctes(FLOW, """
g AS (SELECT label AS class, count(*) FILTER (label = prediction) AS "right", count(*) FILTER (label <> prediction) AS wrong, count(*) AS total FROM flow GROUP BY label),
q AS (SELECT *, 1 - CAST(wrong AS DOUBLE) / total AS p, CAST(total AS DOUBLE) AS n FROM g)""", select=f"""
SELECT class, "right", wrong, total, round(p, 6) AS p, round(1 - CAST(wrong AS DOUBLE) / nullif("right", 0), 6) AS one_minus_wrong_over_right, {WILSON} FROM q"""),
)
def k14(spark, sf_dir):
    found = evaluate.class_reliability(views.flow_view(spark, sf_dir))
    return rounded(found, ["p", "one_minus_wrong_over_right", "lower_bound", "upper_bound"])


# --- aggregates and reports -------------------------------------------------------------------


@query(
    "a1_value_counts",
    with_ctes(FLOW, select="SELECT dst_port, count(*) AS rows, round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM flow), 6) AS percent FROM flow GROUP BY dst_port"),
)
def a1(spark, sf_dir):
    return rounded(report.ranked_value_counts(views.flow_view(spark, sf_dir), "dst_port"), ["percent"])


@query(
    "a2_numeric_profile",
    with_ctes(FLOW, select="SELECT count(DISTINCT flow_duration) AS n_distinct, min(flow_duration) AS minimum, max(flow_duration) AS maximum, round(avg(flow_duration), 6) AS mean FROM flow"),
)
def a2(spark, sf_dir):
    return rounded(report.numeric_profile(views.flow_view(spark, sf_dir), "flow_duration"), ["mean"])


@query("a2_sorted_distinct", with_ctes(FLOW, select="SELECT DISTINCT dst_port FROM flow ORDER BY dst_port"))
def a2_distinct(spark, sf_dir):
    return report.sorted_distinct(views.flow_view(spark, sf_dir), "dst_port")


@query(
    "a3_missing_keys",
    with_ctes(FLOW, select="SELECT CAST(p AS INTEGER) AS dst_port FROM (SELECT unnest([1, 3, 5, 7, 9]) AS p) WHERE p NOT IN (SELECT dst_port FROM flow)"),
)
def a3(spark, sf_dir):
    return report.missing_values(views.flow_view(spark, sf_dir), "dst_port", views.TARGET_PORTS)


@query(
    "a3_missing_keys_table",
    "SELECT p_partkey AS partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)",
)
def a3_table(spark, sf_dir):
    expected = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"))
    found = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("partkey"))
    return report.missing_keys(expected, found, "partkey")


@query(
    "a4_prediction_summary",
    with_ctes(FLOW, select="""
SELECT count(*) AS total, count(*) FILTER (prediction = 0) AS normal, count(*) FILTER (prediction = 1) AS anomalies,
  round(CAST(count(*) FILTER (prediction = 0) AS DOUBLE) / count(*) * 100, 6) AS normal_percent, round(CAST(count(*) FILTER (prediction = 1) AS DOUBLE) / count(*) * 100, 6) AS anomaly_percent,
  round(avg(prediction_probability), 6) AS mean_probability, round(stddev_samp(prediction_probability), 6) AS std_probability,
  round(max(prediction_probability), 6) AS max_probability, round(min(prediction_probability), 6) AS min_probability FROM flow"""),
)
def a4(spark, sf_dir):
    found = report.prediction_summary(views.flow_view(spark, sf_dir))
    return rounded(found, [c for c in found.columns if c.endswith(("percent", "probability"))])


@query(
    "a5_risk_bands",
    with_ctes(FLOW, select="""
SELECT CASE WHEN prediction_probability > 0.8 THEN 'High' WHEN prediction_probability > 0.5 THEN 'Medium' ELSE 'Low' END AS risk_level, count(*) AS rows FROM flow GROUP BY 1"""),
)
def a5(spark, sf_dir):
    return report.risk_counts(views.flow_view(spark, sf_dir))


@query(
    "a6_top_k",
    with_ctes(FLOW, select="SELECT row_key, round(prediction_probability, 6) AS prediction_probability FROM flow WHERE prediction = 1 ORDER BY flow.prediction_probability DESC, row_key LIMIT 10"),
)
def a6(spark, sf_dir):
    rows = clean.predicted_anomalies(views.flow_view(spark, sf_dir))
    return rounded(report.top_k(rows, "prediction_probability", 10, ["row_key"]).select("row_key", "prediction_probability"), ["prediction_probability"])


@query(
    "a7_feature_means_by_class",
    with_ctes(FLOW, select=" UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}) FILTER (prediction = 1), 6) AS anomaly_mean, round(avg({c}) FILTER (prediction = 0), 6) AS normal_mean FROM flow"
        for c in FEATURES)),
)
def a7(spark, sf_dir):
    return rounded(report.feature_means_by_class(views.flow_view(spark, sf_dir), FEATURES), ["anomaly_mean", "normal_mean"])


@query(
    "a8_histogram",
    with_ctes(FLOW, """
ends AS (SELECT min(prediction_probability) AS lo, (max(prediction_probability) - min(prediction_probability)) / 30 AS width FROM flow),
bins AS (SELECT CAST(least(floor((prediction_probability - lo) / width), 29) AS INTEGER) AS bin, count(*) AS rows FROM flow, ends GROUP BY 1)""", select="""
SELECT CAST(b AS INTEGER) AS bin, round(lo + b * width, 6) AS left_edge, round(lo + (b + 1) * width, 6) AS right_edge, coalesce(rows, 0) AS rows
FROM (SELECT unnest(range(30)) AS b) CROSS JOIN ends LEFT JOIN bins ON bins.bin = b"""),
)
def a8(spark, sf_dir):
    return rounded(report.histogram(views.flow_view(spark, sf_dir), "prediction_probability"), ["left_edge", "right_edge"])


@query(
    "a9_kpi_table",
    with_ctes(*ALL_SQL, STABLE_SQL, """
t AS (SELECT count(*) AS total, count(*) FILTER (prediction = 0) AS normal, count(*) FILTER (prediction = 1) AS anomalies FROM flow),
d AS (
  SELECT *, CASE WHEN decision = 'AUTONOMOUS' AND confidence_level = 'HIGH' THEN 1 WHEN decision = 'AUTONOMOUS' THEN 2 ELSE 3 END AS code
  FROM voted JOIN estimated USING (data) WHERE data = 'plain')""", select="""
SELECT 'Total Samples' AS metric, total::VARCHAR AS value FROM t
UNION ALL SELECT 'Normal Traffic', normal::VARCHAR FROM t UNION ALL SELECT 'Anomaly Detected', anomalies::VARCHAR FROM t
UNION ALL SELECT 'Anomaly Rate', printf('%.1f%%', CAST(anomalies AS DOUBLE) / total * 100) FROM t
UNION ALL SELECT 'Class 0 Weight', printf('%.1f%%', CAST(normal AS DOUBLE) / total * 100) FROM t
UNION ALL SELECT 'Class 1 Weight', printf('%.1f%%', CAST(anomalies AS DOUBLE) / total * 100) FROM t
UNION ALL SELECT 'Class ' || class::VARCHAR || ' Stable Measures', stable_count::VARCHAR || '/6' FROM stable WHERE data = 'plain'
UNION ALL SELECT 'System Decision', CASE code WHEN 1 THEN '🟢 AUTONOMOUS OPERATION' WHEN 2 THEN '🟡 ENHANCED MONITORING' ELSE '🔴 HUMAN OVERSIGHT REQUIRED' END FROM d
UNION ALL SELECT 'Confidence Level', confidence_level FROM d
UNION ALL SELECT 'Risk Level', CASE code WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END FROM d
UNION ALL SELECT 'Estimated Accuracy', printf('%.4f', estimated_accuracy) FROM d
UNION ALL SELECT 'Baseline Accuracy', '0.9980'
UNION ALL SELECT 'Accuracy Drop', printf('%.4f', CAST(0.9980 AS DOUBLE) - estimated_accuracy) FROM d
UNION ALL SELECT 'Visualization Sample Size', greatest(50, CAST(floor(total * CAST(0.0008 AS DOUBLE)) AS BIGINT))::VARCHAR FROM t"""),
)
def a9(spark, sf_dir):
    now = runtime(spark, sf_dir).filter(F.col("data") == "plain").drop("data")
    return report.kpi_table(views.flow_view(spark, sf_dir), decide.verdict(baseline(spark, sf_dir), now))


# --- time windows -----------------------------------------------------------------------------


def window_sql(seconds: int) -> str:
    return f"""
windows AS (
  SELECT strftime(to_timestamp(CAST(floor(epoch(timestamp) / {seconds}) AS BIGINT) * {seconds})::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS window_start,
         count(*) AS total_flows, sum(prediction)::BIGINT AS anomaly_count, avg(prediction) AS anomaly_rate,
         round(avg(prediction_probability), 9) AS avg_probability, round(avg(flow_byts_s), 9) AS flow_byts_s,
         round(avg(flow_pkts_s), 9) AS flow_pkts_s, round(avg(pkt_size_avg), 9) AS pkt_size_avg
  FROM traffic GROUP BY 1)
"""


WINDOW_LIST = (
    "window_start, total_flows, anomaly_count, round(anomaly_rate, 9) AS anomaly_rate, avg_probability, flow_byts_s, flow_pkts_s, pkt_size_avg"
)


def tidy_windows(df):
    found = rounded(df, ["anomaly_rate", "avg_probability", "flow_byts_s", "flow_pkts_s", "pkt_size_avg"], 9)
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("t1_traffic_windows_30s", with_ctes(TRAFFIC, window_sql(30), select=f"SELECT {WINDOW_LIST} FROM windows"))
def t1(spark, sf_dir):
    return tidy_windows(traffic.traffic_windows(views.traffic_view(spark, sf_dir)))


@query("t1_traffic_windows_1h", with_ctes(TRAFFIC, window_sql(3600), select=f"SELECT {WINDOW_LIST} FROM windows"))
def t1_hour(spark, sf_dir):
    return tidy_windows(traffic.traffic_windows(views.traffic_view(spark, sf_dir), "1 hour"))


@query(
    "t2_rate_bands",
    with_ctes(TRAFFIC, window_sql(3600), select="""
SELECT window_start, round(anomaly_rate * 100, 4) AS anomaly_percent,
  CASE WHEN anomaly_rate * 100 >= 50 THEN 'High' WHEN anomaly_rate * 100 >= 25 THEN 'Medium' ELSE 'Low' END AS rate_band FROM windows"""),
)
def t2(spark, sf_dir):
    found = traffic.rate_bands(traffic.traffic_windows(views.traffic_view(spark, sf_dir), "1 hour"))
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("anomaly_percent", 4).alias("anomaly_percent"), "rate_band"
    )


@query("f4_anomalous_windows", with_ctes(TRAFFIC, window_sql(30), select="SELECT window_start, anomaly_count, flow_byts_s FROM windows WHERE anomaly_count > 0"))
def f4(spark, sf_dir):
    found = clean.anomalous_windows(traffic.traffic_windows(views.traffic_view(spark, sf_dir)))
    return tidy_windows(found).select("window_start", "anomaly_count", "flow_byts_s")


# --- text -------------------------------------------------------------------------------------

CHUNKS = with_ctes(FLOW, """
numbered AS (SELECT *, row_number() OVER (ORDER BY row_key) AS id, (row_number() OVER (ORDER BY row_key) - 1) // 20 AS chunk FROM flow),
kinds AS (SELECT chunk, string_agg(protocol || ':' || n::VARCHAR, ',' ORDER BY protocol) AS protocols
          FROM (SELECT chunk, protocol, count(*) AS n FROM numbered GROUP BY chunk, protocol) GROUP BY chunk),
figures AS (
  SELECT chunk, min(id)::VARCHAR || '-' || max(id)::VARCHAR AS rows_analyzed, count(*) AS total_flows, count(DISTINCT src_ip) AS unique_src_ips,
    count(DISTINCT dst_ip) AS unique_dst_ips, round(avg(flow_duration), 4) AS avg_flow_duration, max(flow_duration) AS max_flow_duration,
    round(avg(pkt_size_avg), 4) AS avg_pkt_size, sum(syn_flag_cnt)::BIGINT AS syn_flags, sum(rst_flag_cnt)::BIGINT AS rst_flags
  FROM numbered GROUP BY chunk)""", select="""
SELECT CAST(chunk + 1 AS BIGINT) AS chunk_number, figures.* EXCLUDE (chunk), protocols FROM figures JOIN kinds USING (chunk)""")


def chunks(spark, sf_dir, layout):
    columns = ["row_key", "src_ip", "dst_ip", "protocol", "flow_duration", "pkt_size_avg", "syn_flag_cnt", "rst_flag_cnt"]
    found = text.chunk_stats(views.flow_view(spark, sf_dir).select(*columns), ["row_key"], layout=layout)
    listed = F.transform(F.map_entries("protocols"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return rounded(found.withColumn("protocols", F.array_join(listed, ",")), ["avg_flow_duration", "avg_pkt_size"], 4)


@query("g1_chunk_stats", CHUNKS)
def g1(spark, sf_dir):
    return chunks(spark, sf_dir, "auto")


@query("g1_chunk_stats_split", CHUNKS)
def g1_split(spark, sf_dir):
    return chunks(spark, sf_dir, "split")


TIERS = {"HIGH": ["nicht"], "MEDIUM": ["ering"]}
TAGGED = """
tagged AS (
  SELECT *, CASE threat_level WHEN 'HIGH' THEN CAST(0.8 AS DOUBLE) WHEN 'MEDIUM' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS confidence
  FROM (SELECT {key}, {group}, CASE WHEN contains(lower(text), 'nicht') THEN 'HIGH' WHEN contains(lower(text), 'ering') THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM {table}))
"""
ROLLUP = """
SELECT {group} AS {group}, count(*) AS chunks, count(*) FILTER (threat_level = 'HIGH') AS high, count(*) FILTER (threat_level = 'MEDIUM') AS medium,
  count(*) FILTER (threat_level = 'LOW') AS low, round(avg(confidence), 6) AS confidence_score,
  CASE WHEN count(*) FILTER (threat_level = 'HIGH') > CAST(0.3 AS DOUBLE) * count(*) THEN 'HIGH'
       WHEN count(*) FILTER (threat_level IN ('HIGH', 'MEDIUM')) > CAST(0.5 AS DOUBLE) * count(*) THEN 'MEDIUM' ELSE 'LOW' END AS overall_threat_level
FROM tagged GROUP BY {group}
"""


@query("g2_tag_text", with_ctes(TAGGED.format(key="doc_id", group="lang", table="documents"), select="SELECT doc_id, threat_level, confidence FROM tagged"))
def g2(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.tag_text(docs, "text", TIERS).select("doc_id", "threat_level", "confidence")


@query(
    "g2_tag_text_default_tiers",
    """
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'high|critical|severe|attack|malicious') THEN 'HIGH'
  WHEN regexp_matches(lower(text), 'medium|suspicious|unusual|anomaly') THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM conversations""",
)
def g2_default(spark, sf_dir):
    return text.tag_text(views.table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "threat_level")


@query("g3_threat_rollup", with_ctes(TAGGED.format(key="doc_id", group="lang", table="documents"), select=ROLLUP.format(group="lang")))
def g3(spark, sf_dir):
    tagged = text.tag_text(views.table(spark, sf_dir, "documents"), "text", TIERS)
    return rounded(text.threat_rollup(tagged, ["lang"]), ["confidence_score"])


@query("g4_last_n_per_conversation", """
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations) WHERE place <= 3""")
def g4(spark, sf_dir):
    return text.last_n_per_conversation(views.table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "text")
