"""Named queries: every operator over its whole table, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from fewlabel.llm import (common, decontaminate, main_text, maxent, pieces, pii, prefix_trie, ranked, secret_scan, simhash, spans,
                          topk, toxicity, url_filter)
from fewlabel.plans.registry import query
from fewlabel.plans.tables import table

# Where the tokenizer files lie; a path of the driver.
PIECE_MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")


def _digest(found, kinds: dict[str, str]):
    """Counts per base kind, the digest of the base spans and all spans as text."""
    base = F.col("base")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(name) for kind, name in kinds.items()]
    return found.select("doc_id", *counts, F.sha2(common.spans_text(base), 256).alias("base_sha256"),
                        common.spans_text(F.col("spans")).alias("spans"))


@query("op1_pii")
def op1(spark, sf):
    return _digest(pii.find_pii(table(spark, sf, "documents")),
                   {"email": "n_email", "ip": "n_ip", "card": "n_card", "phone": "n_phone"})


@query("op10_secrets")
def op10(spark, sf):
    docs = table(spark, sf, "documents")
    ratios = secret_scan.fit_markov(secret_scan.document_samples(docs))
    return _digest(secret_scan.find_secrets(docs, ratios), {"assign": "n_assign", "access": "n_access", "hex": "n_hex"})


@query("op3_simhash")
def op3(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"), width=3, distance=2)
    return found.select("doc_id", simhash.hex_text(F.col("fingerprint")).alias("fingerprint"), "component_id")


OP5_SQL = """WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a.q * a.c FOR a IN list_transform(list_zip(q.v, c.v),
    lambda z: {'q': z[1], 'c': z[2]})])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
WHERE rank <= 20"""


@query("op5_topk", OP5_SQL)
def op5(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", topk.integer_vector(F.col("embedding")).alias("vector"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


@query("op4_decontaminate")
def op4(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op2_main_text")
def op2(spark, sf):
    return main_text.extract(table(spark, sf, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_repeats")
def op6(spark, sf):
    found = spans.drop_repeats(table(spark, sf, "documents"))
    parts = F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", F.col("sentences").alias("n_sentences"), F.size("removed").alias("n_removed"),
                        F.concat_ws(",", parts).alias("removed"), "text")


@query("op8_pieces")
def op8(spark, sf):
    coded = pieces.encode(table(spark, sf, "documents"), PIECE_MODEL, verify=True)
    return coded.select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip")


@query("op9_toxicity")
def op9(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rated = docs.select("doc_id", toxicity.rating(toxicity.train(docs, labels)).alias("score"))
    return rated.select("doc_id", common.held_out("doc_id", 5).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_maxent")
def op7(spark, sf):
    return maxent.score(table(spark, sf, "documents"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, '{common.UPPER}', '{common.LOWER}') AS text FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (
  SELECT r, doc_id, unnest(regexp_extract_all(text, '{TERM}')) AS term FROM d) GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{common.UPPER}', '{common.LOWER}'), '{TERM}')) AS term
  FROM benchmark),
s AS (SELECT item_id, r, doc_id, sum(w * (1000000000 * tf // (1000 * tf + 20 * (50 + 50 * n * docs // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), g GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 50"""


@query("op13_ranked_search", OP13_SQL)
def op13(spark, sf):
    return ranked.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _rules_sql(rows: str) -> str:
    """``rows`` (``address``) with the rule that decides, longest first."""
    longest_first = sorted(URL_RULES, key=lambda r: -len(r[1]))
    fits = [f"('.' || host LIKE '%.{r.split('/')[0]}' AND starts_with(path, '/{r.partition('/')[2]}'))" for _, r in longest_first]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for f, (_, r) in zip(fits, longest_first))
    action = " ".join(f"WHEN rule = '{r}' THEN '{a}'" for a, r in URL_RULES)
    return f"""SELECT *, CASE {action} END AS action FROM (SELECT *, CASE {rule} END AS rule FROM (
      SELECT *, translate(coalesce(regexp_extract(address, '(?s)^.*?://([^/?#]*)', 1), ''), '{common.UPPER}', '{common.LOWER}') AS host,
        coalesce(regexp_extract(address, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM {rows}))"""


# Links with whole addresses in double quotes, which is what SQL can read; relative and other spellings are left to tests.
OP12_SQL = f"""WITH RECURSIVE p AS (
  SELECT page_id, address, host, path, rule, action, split_part(address, '#', 1) AS node FROM ({_rules_sql("(SELECT page_id, url AS address FROM pages)")})),
tag AS (SELECT split_part(url, '#', 1) AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^<>]*>')) AS tag FROM pages),
e AS (SELECT DISTINCT a, split_part(b, '#', 1) AS b FROM (
  SELECT a, CASE WHEN tag ILIKE '%rel="canonical"%' THEN regexp_extract(tag, '(?i)href="([^"]*://[^"]*)"', 1)
    WHEN tag ILIKE '%http-equiv="refresh"%' THEN regexp_extract(tag, '(?i)url=([^"]*://[^"]*)"', 1) END AS b FROM tag) WHERE b <> '' AND a LIKE '%://%'),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a),
passed AS (SELECT a FROM reach r JOIN ({_rules_sql("(SELECT DISTINCT b AS address FROM reach)")}) n ON r.b = n.address
  GROUP BY a HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN passed.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN passed ON p.node = passed.a"""


@query("op12_url_filter", OP12_SQL)
def op12(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES)


# crc32 bit by bit: a value of 0 or more is the next byte, -1 a shift.
CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""
OP11_SQL = rf"""WITH own AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, t, xor({CRC}, 4294967295) % 4 AS h FROM own),
s AS (SELECT a.c, coalesce(b.t[1:h], []) || a.t[h + 1:] AS s FROM h a LEFT JOIN own b ON b.c = a.c - a.c % 20),
p AS (SELECT c, s, unnest(generate_series(0, len(s))) AS depth FROM s),
node AS (SELECT s[1:depth] AS p, depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(s[depth].text), '[^\x20\x09-\x0D]+')) END AS saved
  FROM p GROUP BY s[1:depth], depth),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p, depth)),
up AS (SELECT p[1:d] AS p, d AS depth, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM full_node) GROUP BY p[1:d], d)
SELECT n.conv_id, n.depth, f.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM full_node n JOIN up USING (p, depth) LEFT JOIN node f ON n.depth > 0 AND f.depth = n.depth - 1 AND f.p = n.p[1:n.depth - 1]"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))
