"""Conversations without quotations, in reply order, in DataFrame functions alone.

A line's quote level is the number of ``>`` it begins with. Quoted passages (neighbouring lines of one level) are
joined, normalised and hashed by runs of words, short lines and short sentences; a passage is linked to the earlier
message of the conversation that wrote most of its words itself, of several to the latest. A message replies to the message that its least deep
quotes lead to, else to the one before it. Own text is kept without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwarden.llm.common import stored
from driftwarden.plans.ranks import prefix_sums

# A quote mark may stand behind blanks and be followed by one.
MARKS = r"^(?:[ \t]*>)+"
# Words of a run; shorter lines and sentences are compared as a whole.
WINDOW = 8
INTRO = r"^[^\n]{0,200}\b(?:wrote|schrieb|a écrit|escribió):[ \t]*$"


def normalised(line: Column) -> Column:
    """Lower case, white space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[\s ]+", " "))


def parsed_lines(messages: DataFrame) -> DataFrame:
    """(conv, turn, row, no, level, body, norm) for every line of (conv, turn, row, text)."""
    lines = messages.select(
        "conv", "turn", "row", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r", -1)).alias("no", "line")
    )
    marks = F.regexp_extract("line", MARKS, 0)
    lines = lines.withColumn("level", F.length(F.regexp_replace(marks, r"[ \t]", "")))
    lines = lines.withColumn("body", F.when(F.col("level") > 0, F.regexp_replace("line", MARKS + r"[ \t]?", "")).otherwise(F.col("line")))
    return lines.withColumn("norm", normalised(F.col("body"))).drop("line")


def passages(lines: DataFrame) -> DataFrame:
    """(conv, turn, row, level, passage, no, norm): lines with words; passage 0 is the message's own text.

    A quoted passage is a run of quoted lines of one level.
    """
    told = lines.filter(F.col("norm") != "")
    # The rows of one message are one document; levels change from passage to passage.
    inside = Window.partitionBy("row").orderBy("no")
    new = F.when(F.lag("level").over(inside) == F.col("level"), 0).otherwise(1)
    quoted = told.filter("level > 0").withColumn("new", new).withColumn("passage", F.sum("new").over(inside)).drop("new")
    own = told.filter("level = 0").withColumn("passage", F.lit(0).cast("long"))
    return own.unionByName(quoted)


def pieces(lines: DataFrame) -> DataFrame:
    """(conv, turn, row, passage, start, size, h): what passages are compared by, of the lines of ``passages``.

    The lines of a passage are joined, so that other line breaks give the same words. Pieces are its
    runs of WINDOW words, and its lines and sentences that are shorter. ``h`` names the words and the conversation.
    """
    group = ["conv", "turn", "row", "passage"]
    so_far = Window.partitionBy(*group).orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def short(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("size", F.size(F.split("norm", " ")))
        placed = sized.withColumn("start", F.sum("size").over(so_far) - F.col("size"))
        return placed.filter(F.col("size") < WINDOW).select(*group, "start", "size", "norm")

    whole = lines.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("no", "norm"))).alias("lines"))
    whole = whole.select(*group, F.array_join("lines.norm", " ").alias("text"))
    sentences = whole.select(*group, F.posexplode(F.split("text", r"(?<=[.!?]) ")).alias("no", "norm"))
    words = whole.withColumn("words", F.split("text", " ")).filter(F.size("words") >= WINDOW)
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.array_join(F.slice("words", i, WINDOW), " "))
    long = words.select(*group, F.posexplode(runs).alias("start", "norm")).withColumn("size", F.lit(WINDOW))
    every = short(lines).unionByName(short(sentences)).unionByName(long.select(*group, F.col("start").cast("long"), "size", "norm"))
    return every.withColumn("h", F.xxhash64("conv", F.col("conv").isNull(), "norm")).drop("norm")


def quote_links(lines: DataFrame) -> DataFrame:
    """(row, passage, level, source): per quoted passage the earlier turn that wrote most of its words, of
    several the latest; null if none wrote any of its pieces.

    Each piece's latest writer is found in one pass over the pieces sorted by turn. No turn that wrote all
    of a passage's known pieces is later than the earliest of these writers; if that one wrote them
    all, as with a plain quotation, it is the source. So a line repeated in every message costs a sorted
    run, not pairs. Only passages put together from several messages are compared with all writers.
    """
    told = stored(passages(lines), "told")
    asked = told.filter("passage > 0").groupBy("row", "passage").agg(F.min("level").alias("level"))
    every = stored(pieces(told), "pieces")
    earlier = Window.partitionBy("h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("passage") == 0, F.col("turn"))
    known = every.withColumn("latest", F.max(own).over(earlier)).filter("passage > 0 AND latest IS NOT NULL")
    known = stored(known.select("row", "passage", "turn", "start", "size", "h", "latest"), "known")
    wrote = every.filter("passage = 0").select("h", F.col("turn").alias("source")).distinct()
    first = known.groupBy("row", "passage").agg(F.min("latest").alias("source"), F.count(F.lit(1)).alias("n"))
    there = known.join(first, ["row", "passage"]).join(wrote, ["h", "source"], "left_semi")
    plain = there.groupBy("row", "passage", "source", "n").agg(F.count(F.lit(1)).alias("found")).filter("found = n")
    plain = stored(plain.select("row", "passage", "source"), "plain")
    mixed = known.join(plain, ["row", "passage"], "left_anti").join(wrote, "h").filter(F.col("source") < F.col("turn"))
    places = F.explode(F.sequence("start", F.col("start") + F.col("size") - 1))
    covered = mixed.select("row", "passage", "source", places.alias("place")).distinct()
    covered = covered.groupBy("row", "passage", "source").agg(F.count(F.lit(1)).alias("words"))
    most = covered.groupBy("row", "passage").agg(F.max(F.struct("words", "source")).alias("best"))
    found = plain.unionByName(most.select("row", "passage", "best.source"))
    return asked.join(found, ["row", "passage"], "left")


def own_text(text: Column) -> Column:
    """The message without quoted lines, and without the line that introduces them."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r", -1)
    n = F.size(lines)
    quoted = F.transform(lines, lambda x: x.rlike(MARKS))

    def kept(x: Column, i: Column) -> Column:
        following = F.coalesce(F.get(quoted, i + 1), F.lit(False))
        return ~F.get(quoted, i) & ~(x.rlike(INTRO) & following)

    rest = F.array_join(F.filter(lines, kept), "\n")
    return F.when(F.exists(quoted, lambda q: q), F.regexp_replace(F.regexp_replace(rest, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).otherwise(
        F.when(n > 0, F.coalesce(text, F.lit("")))
    )


def climb(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) from (conv, turn, parent), by doubling the step towards the root."""
    step = F.when(F.col("parent").isNull(), 0).otherwise(1)
    at = stored(parents.select("conv", "turn", F.coalesce("parent", "turn").alias("root"), step.alias("depth")), "climb")
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("root") == F.col("t"))
    while True:
        up = at.toDF("c", "t", "up", "more")
        higher = at.join(up, on).select(
            "conv",
            "turn",
            F.col("up").alias("root"),
            (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("more") > 0).alias("moved"),
        )
        higher = stored(higher, "climb")
        if not higher.filter("moved").head(1):
            return higher.drop("moved")
        at = higher.drop("moved")


def reply_ordered(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", layout: str = "auto"
) -> DataFrame:
    """All columns of ``messages`` with the text replaced by the message's own words, and: reply_to (the turn
    it answers, null for the first), linked (the reply was found by a quotation), root, depth, n_quotes,
    n_linked (quoted passages, and those with a source), position (1, 2, ... by turn: no message
    comes before the one it answers).

    A null text counts as empty. Rows with a null turn are returned with null links and no position.
    Null conversations are one conversation. Rows that share a conversation and turn are one
    place to reply to; each keeps its row. Columns of any other name are kept; an empty table stays
    empty. Quotes inside one conversation only are linked.
    """
    new = ("reply_to", "linked", "root", "depth", "n_quotes", "n_linked", "position")
    kept = [c for c in messages.columns if c not in new]
    rows = messages.select(
        F.struct(*kept).alias("all"),
        F.col(conversation).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.col(text).alias("text"),
    ).withColumn("row", F.unhex(F.md5(F.to_json(F.struct("conv", "turn", "text")).cast("binary"))))
    named = rows.filter(F.col("turn").isNotNull())
    texts = named.select("conv", "turn", "row", "text").dropDuplicates(["row"])
    # Messages of conversations without a quotation are no one's source.
    quoting = texts.filter(F.col("text").rlike(f"(?m){MARKS}")).select(F.col("conv").alias("c")).distinct()
    texts = texts.join(quoting, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
    found = quote_links(parsed_lines(texts))
    # A message answers what its least deep linked quote leads to; of several, the latest.
    linked = F.when(F.col("source").isNotNull(), F.struct(F.col("level"), (-F.col("source")).alias("source")))
    best = found.groupBy("row").agg(
        F.min(linked).alias("best"), F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked")
    )
    best = best.select("row", (-F.col("best.source")).alias("quoted"), "n_quotes", "n_linked")
    joined = named.join(best, "row", "left")
    turns = joined.groupBy("conv", "turn").agg(F.max("quoted").alias("quoted"))
    placed = stored(prefix_sums(turns, ["conv"], "turn", [], layout), "turns")
    there = F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))
    previous = placed.filter(F.col("next_value").isNotNull())
    previous = previous.select(F.col("conv").alias("c"), F.col("next_value").alias("t"), F.col("turn").alias("previous"))
    parents = placed.join(previous, there, "left").select(
        "conv", "turn", "position", F.col("quoted").isNotNull().alias("linked"), F.coalesce("quoted", "previous").alias("parent")
    )
    parents = stored(parents, "parents")
    tree = climb(parents.select("conv", "turn", "parent"))
    tree = parents.join(tree.withColumnsRenamed({"conv": "c", "turn": "t"}), there).drop("c", "t")
    tree = tree.withColumnsRenamed({"conv": "c", "turn": "t"})
    out = {
        "reply_to": F.col("parent"),
        "linked": F.col("linked"),
        "root": F.col("root"),
        "depth": F.col("depth").cast("long"),
        "n_quotes": F.coalesce("n_quotes", F.lit(0)).cast("long"),
        "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long"),
        "position": F.col("position"),
    }
    columns = [own_text(F.col("text")).alias(c) if c == text else F.col(f"all.{c}").alias(c) for c in kept]
    done = joined.join(tree, there).select(*columns, *[v.alias(k) for k, v in out.items()])
    loose = rows.filter(F.col("turn").isNull()).select(
        *columns, *[F.lit(None).cast(done.schema[k].dataType).alias(k) for k in new]
    )
    return done.unionByName(loose)
