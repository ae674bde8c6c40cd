"""Traffic chunks, keyword tiers over reports, and conversation tails."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.functions.columns import count_if
from driftwarden.operators.report import last_per_group
from driftwarden.plans.ranks import row_numbers

# Fixed keyword tiers, matched as substrings in lower case.
THREAT_TIERS = {
    "HIGH": ["high", "critical", "severe", "attack", "malicious"],
    "MEDIUM": ["medium", "suspicious", "unusual", "anomaly"],
}
TIER_CONFIDENCE = {"HIGH": 0.8, "MEDIUM": 0.6, "LOW": 0.4}
HIGH_SHARE, MEDIUM_SHARE = 0.3, 0.5


def chunk_stats(df: DataFrame, order: list[str], size: int = 20, layout: str = "auto") -> DataFrame:
    """Figures per chunk of ``size`` consecutive rows: flows, distinct addresses, protocol counts,
    durations, packet size and flag sums. All chunks of the table are described."""
    numbered = row_numbers(df, order, "_id", layout=layout)
    chunked = numbered.withColumn("chunk", F.floor((F.col("_id") - 1) / size))
    # A chunk holds at most ``size`` rows, so its protocol list is small by construction.
    seen = F.array_sort(F.collect_list("protocol"))
    kinds = F.array_distinct(seen)
    protocols = F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(seen, lambda p: p == k))))
    return chunked.groupBy("chunk").agg(
        (F.col("chunk") + 1).alias("chunk_number"),
        F.concat(F.min("_id").cast("string"), F.lit("-"), F.max("_id").cast("string")).alias("rows_analyzed"),
        F.count(F.lit(1)).alias("total_flows"),
        F.size(F.collect_set("src_ip")).cast("long").alias("unique_src_ips"),
        F.size(F.collect_set("dst_ip")).cast("long").alias("unique_dst_ips"),
        protocols.alias("protocols"),
        F.avg("flow_duration").alias("avg_flow_duration"),
        F.max("flow_duration").alias("max_flow_duration"),
        F.avg("pkt_size_avg").alias("avg_pkt_size"),
        F.sum("syn_flag_cnt").alias("syn_flags"),
        F.sum("rst_flag_cnt").alias("rst_flags"),
    ).drop("chunk")


def _mentions(text: Column, words: list[str]) -> Column:
    """One alternation over the whole text; words are literal."""
    return text.rlike("|".join(re.escape(w.lower()) for w in words)) if words else F.lit(False)


def tag_text(df: DataFrame, text: str, tiers: dict[str, list[str]] | None = None) -> DataFrame:
    """Tier of the whole text and its confidence: the first tier with a keyword in it, else LOW."""
    tiers = THREAT_TIERS if tiers is None else tiers
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    high = _mentions(lowered, tiers.get("HIGH", []))
    medium = _mentions(lowered, tiers.get("MEDIUM", []))
    level = F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")
    tagged = df.withColumn("threat_level", level)
    of = F.col("threat_level")
    confidence = F.when(of == "HIGH", TIER_CONFIDENCE["HIGH"]).when(of == "MEDIUM", TIER_CONFIDENCE["MEDIUM"])
    return tagged.withColumn("confidence", confidence.otherwise(TIER_CONFIDENCE["LOW"]))


def threat_rollup(tagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Overall level per group: HIGH above 30% high, MEDIUM above 50% high or medium, else LOW;
    UNKNOWN without rows. With it the counts and the mean confidence."""
    level = F.col("threat_level")
    grouped = tagged.groupBy(*keys) if keys else tagged.groupBy()
    counts = grouped.agg(
        F.count(F.lit(1)).alias("chunks"),
        count_if(level == "HIGH").alias("high"),
        count_if(level == "MEDIUM").alias("medium"),
        count_if(level == "LOW").alias("low"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence_score"),
    )
    n, high, medium = F.col("chunks"), F.col("high"), F.col("medium")
    overall = (
        F.when(n == 0, "UNKNOWN")
        .when(high.cast("double") > n * F.lit(HIGH_SHARE), "HIGH")
        .when((high + medium).cast("double") > n * F.lit(MEDIUM_SHARE), "MEDIUM")
        .otherwise("LOW")
    )
    return counts.withColumn("overall_threat_level", overall)


def last_n_per_conversation(df: DataFrame, n: int = 20, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest n messages of each conversation."""
    return last_per_group(df, [conversation], turn, n)
