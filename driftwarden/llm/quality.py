"""Rule counts and a likelihood-ratio verdict per document, in DataFrame functions alone.

Word unigrams and bigrams are hashed into a fixed number of buckets. Counted over the whole corpus they
give the raw multinomial, counted over the trusted documents the target one; a document's score is
the mean over its n-grams of the log ratio of the two. The target is smoothed towards the raw
counts, by an amount that follows the number of buckets it knows. Fresh trusted text scores lower than the text that
was counted, the more so the less there is; so scores are taken from the level of trusted n-grams that are
left out of their own count. Without trusted documents every score is 0. A document is kept if its score reaches a fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwarden.plans.scale import BROADCAST_ROWS

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 16
# N-grams that the target is thought to have seen beforehand, spread like the corpus, per bucket that it knows.
PRIOR = 4
# Nats per n-gram below fresh trusted text at which a document is refused.
THRESHOLD = -0.1
SPAN = 5


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _text (null as empty), _words and _h, the hash of each word."""
    whole = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    cut = whole.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    return cut.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))


def pairs(h: str = "_h") -> Column:
    """Hash of every pair of neighbours."""
    n = F.size(h)
    found = F.zip_with(F.slice(h, F.lit(1), n - 1), F.slice(h, F.lit(2), n - 1), lambda x, y: F.xxhash64(x, y))
    return F.when(n > 1, found).otherwise(F.array().cast("array<long>"))


def bucket_of(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def with_base_counts(worded: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, from _text, _words, _h and _pairs.

    A window of five words is told by a 64-bit hash of its first two pairs and its last word. Only texts
    in which some occur twice get the windows' places sorted.
    """
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.ltrim(x, F.lit(SEPARATORS)) != "")
    out = worded.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long"),
            "_lines": lines,
            "_w": F.when(
                F.size("_h") >= SPAN,
                F.transform(
                    F.slice("_h", F.lit(SPAN), F.size("_h")),
                    lambda last, i: F.xxhash64(F.get("_pairs", i), F.get("_pairs", i + 2), last),
                ),
            ).otherwise(F.array().cast("array<long>")),
        }
    )
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_twice": F.size(F.array_distinct("_w")) < F.size("_w"),
        }
    ).drop("_lines")
    places = F.when(F.col("_twice"), F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("_places", places)

    def same(i: Column, j: Column) -> Column:
        return F.element_at("_places", i)["h"] == F.element_at("_places", j)["h"]

    n = F.size("_places")
    repeated = F.when(
        F.col("_twice"),
        F.sort_array(
            F.transform(
                F.filter(
                    F.sequence(F.lit(1), n),
                    lambda i: F.when(i > 1, same(i, i - 1)).otherwise(F.lit(False))
                    | F.when(i < n, same(i, i + 1)).otherwise(F.lit(False)),
                ),
                lambda i: F.element_at("_places", i)["i"],
            )
        ),
    )
    out = out.withColumn("_at", repeated)
    k = F.size("_at")
    covered = F.when(
        F.col("_twice"),
        F.aggregate(
            F.zip_with(F.slice("_at", F.lit(1), k - 1), F.slice("_at", F.lit(2), k - 1), lambda x, y: F.least(y - x, F.lit(SPAN))),
            F.lit(SPAN),
            lambda a, x: a + x,
        ),
    ).otherwise(F.lit(0))
    out = out.withColumn("n_repeat_words", covered.cast("long")).drop("_twice", "_places", "_at", "_w")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bucket_weights(worded: DataFrame, trusted: str, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``weights``, per bucket log(target / raw) from all rows, and ``level``; ``trusted`` marks the target's rows.

    The target is smoothed as if PRIOR n-grams per bucket that it knows, spread like the corpus, had been seen too.
    The level is the mean weight of trusted n-grams, each one left out of the counts that weigh it, or 0 if that is less.
    """
    counted = (
        worded.select(F.explode(F.concat("_h", pairs())).alias("gram"), F.col(trusted).cast("int").alias("good"))
        .groupBy(bucket_of(F.col("gram"), buckets).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    )
    # At most `buckets` rows from here on.
    every = counted.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    rows = every.join(counted, "bucket", "left").agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("c"),
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
        F.count_if(F.col("target") > 0).cast("double").alias("kinds"),
    )
    total, prior = F.coalesce("all_target", F.lit(0)).cast("double"), PRIOR * F.col("kinds")

    def weight(c: Column) -> Column:
        share = c["raw"] / F.col("all_raw")
        smoothed = F.log((c["target"] + prior * share) / (total + prior) / share)
        return F.when((c["raw"] > 0) & (total > 0), smoothed).otherwise(F.lit(0.0))

    def fresh(sum_: Column, c: Column) -> Column:
        share = c["raw"] / F.col("all_raw")
        left = F.log((c["target"] - 1 + prior * share) / (total - 1 + prior) / share)
        return sum_ + F.when(c["target"] > 0, c["target"] * left).otherwise(F.lit(0.0))

    # Copies among the trusted texts raise it, but never above the corpus.
    level = F.when(total > 1, F.least(F.aggregate("c", F.lit(0.0), fresh) / total, F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.select(F.transform("c", weight).alias("weights"), level.alias("level"))


def judge(
    docs: DataFrame,
    trusted_ids: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Rule counts, score and verdict per row: key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, kept.

    ``trusted_ids`` has the keys of trusted documents in a column named like ``key``; repeats and nulls in
    it don't count. A null or empty text has no words, fails the rules and is not kept. Null and
    repeated keys keep their rows. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    good = trusted_ids.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    good = good.withColumn("_good", F.lit(1))
    if good.count() <= BROADCAST_ROWS:
        good = F.broadcast(good)
    marked = rows.join(good, "_key", "left").withColumn("_good", F.coalesce("_good", F.lit(0)))
    # `buckets` numbers, whatever the corpus' size; as a constant they need no join and no copy per row.
    found, level = bucket_weights(with_words(marked), "_good", buckets).first()
    weights = F.split(F.lit(",".join(f"{w:.6f}" for w in found)), ",").cast("array<double>")
    counted = with_base_counts(with_words(rows).withColumn("_pairs", pairs())).withColumn("_grams", F.concat("_h", "_pairs"))
    total = F.aggregate("_grams", F.lit(0.0), lambda a, g: a + F.get(weights, bucket_of(g, buckets)))
    score = F.when(F.size("_grams") > 0, total / F.size("_grams") - F.lit(level)).otherwise(F.lit(0.0))
    out = counted.withColumn("score", score)
    return out.select(
        F.col("_key").alias(key),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )
