"""The queries of this package and the SQL that states their results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from driftwarden.llm import (
    counting,
    decontaminate,
    jaccard,
    language,
    lexical,
    packing,
    phrases,
    pii,
    quality,
    quotes,
    shards,
    substrings,
    toxicity,
)
from driftwarden.llm.common import stored, table
from driftwarden.plans.scale import scratch_path

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


@query("op1_token_store")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "token-store")
    shards.write_store(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    found = shards.read_store(spark, path, docs)
    size = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", "start", size.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op3_pack_min_slack")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


# The passage is found by its words in order; a window is named by them and by where it starts.
OP2_SQL = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h),
hit AS (SELECT g.doc_id, list(i) AS places FROM g JOIN m USING (h) WHERE low < doc_id GROUP BY g.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(places, lambda i: range(i, i + 50)))) AS k FROM hit),
r AS (SELECT doc_id, list(k) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
         list_transform(list_filter(range(1, len(ws) + 1), lambda k: NOT list_contains(gone, k)), lambda k: ws[k]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


@query("op2_remove_repeats", OP2_SQL)
def op2(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_likelihood_ratio_rules")
def op9(spark, sf_dir):
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    found = quality.judge(table(spark, sf_dir, "documents"), trusted)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


OP7_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, ws[i:i + 12] AS phrase, len(ws[i:i + 12]) AS n FROM p),
ns AS (SELECT DISTINCT n FROM w),
s AS (SELECT doc_id, n, ws, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS i FROM d, ns),
g AS (SELECT doc_id, n, i, ws[i:i + n - 1] AS phrase FROM s),
hit AS (SELECT doc_id, item_id, i, g.n FROM g JOIN w ON g.n = w.n AND g.phrase = w.phrase),
k AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit),
h AS (SELECT doc_id, count(*) AS n_hit FROM k GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
      FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op7_benchmark_phrases", OP7_SQL)
def op7(spark, sf_dir):
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op8_toxicity_machine")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.with_scores(docs, model)
    return found.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 2], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.low AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reached) AS low FROM r GROUP BY node) c ON c.node = w.doc_id
"""


@query("op4_token_group_join", OP4_SQL)
def op4(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents"), shingle=3, percent=90)


@query("op5_surrogates")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_private(docs, key=b"check", count="n_replaced")


OP6_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text,
  regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS ls FROM conversations),
l AS (SELECT conv_id, turn, unnest(range(1, len(ls) + 1)) AS no, unnest(ls) AS line FROM m),
q AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+'), '[ \t]', '', 'g')) AS level FROM l),
b AS (SELECT *, trim(regexp_replace(lower(CASE WHEN level > 0 THEN regexp_replace(line, '^(?:[ \t]*>)+[ \t]?', '') ELSE line END),
      '\s+', ' ', 'g'), ' ') AS norm FROM q),
t AS (SELECT * FROM b WHERE norm <> ''),
s AS (SELECT *, max(CASE WHEN level = 0 THEN turn END) OVER (PARTITION BY conv_id, norm ORDER BY turn
      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS source FROM t),
p AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY no) AS passage FROM (
      SELECT *, CASE WHEN lag(level) OVER (PARTITION BY conv_id, turn ORDER BY no) = level THEN 0 ELSE 1 END AS starts
      FROM s WHERE level > 0)),
f AS (SELECT conv_id, turn, passage, max(source) AS source, min(level) AS level FROM p GROUP BY ALL),
best AS (SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked,
      arg_min(source, level * 1000000 - source) FILTER (WHERE source IS NOT NULL) AS quoted FROM f GROUP BY conv_id, turn),
o AS (SELECT m.*, quoted, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
      coalesce(quoted, lag(m.turn) OVER w) AS reply_to, row_number() OVER w AS position
      FROM m LEFT JOIN best USING (conv_id, turn) WINDOW w AS (PARTITION BY m.conv_id ORDER BY m.turn)),
r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM o WHERE reply_to IS NULL
      UNION ALL SELECT o.conv_id, o.turn, r.root, r.depth + 1 FROM o JOIN r ON o.conv_id = r.conv_id AND o.reply_to = r.turn),
x AS (SELECT conv_id, turn, list_filter(range(1, len(ls) + 1), lambda i: NOT regexp_matches(ls[i], '^(?:[ \t]*>)+')
      AND NOT (regexp_matches(ls[i], '^[^\n]{0,200}\b(?:wrote|schrieb|a écrit|escribió):[ \t]*$')
               AND regexp_matches(coalesce(ls[i + 1], ''), '^(?:[ \t]*>)+'))) AS keep,
      len(list_filter(ls, lambda z: regexp_matches(z, '^(?:[ \t]*>)+'))) > 0 AS quoting FROM m)
SELECT o.conv_id, o.turn, o.role,
       CASE WHEN quoting THEN regexp_replace(regexp_replace(array_to_string(list_transform(keep, lambda i: ls[i]), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')
            ELSE text END AS text,
       o.reply_to, quoted IS NOT NULL AS linked, r.root, r.depth::BIGINT AS depth, n_quotes, n_linked, o.position
FROM o JOIN r USING (conv_id, turn) JOIN x USING (conv_id, turn)
"""


@query("op6_quotation_links", OP6_SQL)
def op6(spark, sf_dir):
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def document_edits():
    """Two edits for every document, at places that follow from its id: some characters make way for the
    name of its source, and a stretch is deleted."""
    size = F.length(F.coalesce("text", F.lit(""))) + 1
    first = F.pmod(F.xxhash64("doc_id", F.lit("put")), size).cast("int")
    second = F.pmod(F.xxhash64("doc_id", F.lit("cut")), size).cast("int")
    put = F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(". "))
    return F.array(
        F.struct(first.alias("start"), (first + 20).alias("end"), put.alias("put")),
        F.struct(second.alias("start"), (second + 40).alias("end"), F.lit("").alias("put")),
    )


@query("op10_edit_aware_counts")
def op10(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    trees = stored(counting.build_trees(docs, vocabulary), "trees")
    edited = trees.withColumn("edits", document_edits()).withColumnRenamed("n_tokens", "n_before")
    after = counting.apply_edits(edited.withColumn("n_tokens", F.col("n_before")), vocabulary)
    return after.select(
        "doc_id",
        "n_before",
        F.col("n_tokens").alias("n_after"),
        F.length("text").cast("long").alias("n_chars"),
        "n_encoded",
        F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"),
    )


OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
     'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
p AS (SELECT lang, unnest(ps) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, k, unnest(range(1, greatest(len(ws) - k + 2, 1))) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, cut, 1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, a, string_split(phrase, ' ') AS ws FROM f WHERE k = 3),
inside AS (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS phrase, max(a) AS longer FROM o, (SELECT unnest([1, 2]) AS j) GROUP BY 1, 2),
kept AS (SELECT least.* FROM least LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", OP11_SQL)
def op11(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
e AS (SELECT doc_id, ws, len(ws)::BIGINT AS n FROM d WHERE len(ws) > 0),
x AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM e),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM e) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * all_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, x GROUP BY term, all_docs),
m AS (SELECT doc_id, 100 - 75 + (75 * n * all_docs) // all_terms AS m FROM e, x),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


@query("op12_automaton_search", OP12_SQL)
def op12(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_byte_language")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.with_language(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
