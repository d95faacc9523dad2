"""Vector joins, retrieval, selection and diversity."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from fewlabel.operators import knn
from fewlabel.operators.diversity import mmr_partitioned
from fewlabel.operators.pool import build_pool
from fewlabel.operators.retrieve import (
    attach, candidate_depth, cluster_sizes, retrieve_multi, retrieve_per_query, retrieve_random)
from fewlabel.operators.selection import (
    balance_labels, cap_rows, dedup_two_stage, exclude, include, rebalance_classes, weighted_score)
from fewlabel.operators.sweep import best_point, sweep_diversity, sweep_weights
from fewlabel.plans.registry import query, rnd, sql_rnd
from fewlabel.plans.tables import (
    LABELLED, PROBABILITIES, WITH_VECTORS, labelled, probabilities, sql_dot, sql_l2, sql_norm,
    table, target_queries, with_vectors)
from fewlabel.functions.signals import entropy, margin
from fewlabel.functions.subwords import unique_pieces
from fewlabel.functions.vectors import unit
from fewlabel.session import durable

WORDS = r"len(list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')))"


def _vectors(spark, sf):
    """Every document with a vector, labelled or not."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    return e.join(d, "vec_id")


VECTORS = ("SELECT e.vec_id, d.lang, d.source, e.embedding::DOUBLE[] AS v "
           "FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")


def _knn_sql(dist: str, where: str, k: int = 10, v: str = "v") -> str:
    return f"""WITH x AS ({VECTORS}), y AS (SELECT *, {v} AS u FROM x),
      p AS (SELECT q.vec_id AS query_id, p.vec_id, {dist} AS dist FROM y q, y p WHERE q.lang = 'es' AND {where}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM p)
      SELECT query_id, vec_id, rank, {sql_rnd('dist')} AS dist FROM r WHERE rank <= {k}"""


def _queries(x):
    return x.where(F.col("lang") == "es").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _shown(hits):
    return hits.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), rnd("dist").alias("dist"))


@query("knn_join_l2", _knn_sql(sql_l2("q.v", "p.v"), "p.lang <> 'es'"))
def knn_join_l2(spark, sf):
    x = _vectors(spark, sf)
    return _shown(knn.knn_join(_queries(x), exclude(x, "lang", ["es"]), 10))


@query("knn_join_ip", _knn_sql("-" + sql_dot("q.v", "p.v"), "p.lang IN ('en', 'de')"))
def knn_join_ip(spark, sf):
    x = _vectors(spark, sf)
    return _shown(knn.knn_join(_queries(x), include(x, "lang", ["en", "de"]), 10, metric="ip"))


@query("knn_join_cosine", _knn_sql(
    f"-({sql_dot('q.v', 'p.v')} / ({sql_norm('q.v')} * {sql_norm('p.v')}))", "p.source NOT IN ('src0', 'src1')"))
def knn_join_cosine(spark, sf):
    x = _vectors(spark, sf)
    return _shown(knn.knn_join(_queries(x), exclude(x, "source", ["src0", "src1"]), 10, metric="cosine"))


@query("knn_join_normalised", _knn_sql(sql_l2("q.u", "p.u"), "p.lang <> 'es'", v=f"[c / {sql_norm('v')} FOR c IN v]"))
def knn_join_normalised(spark, sf):
    """Vectors scaled to length one before the search."""
    x = _vectors(spark, sf)
    return _shown(knn.knn_join(_queries(x), exclude(x, "lang", ["es"]), 10, normalize=True))


@query("knn_join_offset", _knn_sql(sql_l2("q.u", "p.u"), "p.lang <> 'es'", v="[c + 10000 FOR c IN v]"))
def knn_join_offset(spark, sf):
    """Vectors far from the origin, whose norms hide their distances."""
    x = _vectors(spark, sf).withColumn("embedding", F.transform("embedding", lambda c: c.cast("double") + F.lit(10000.0)))
    return _shown(knn.knn_join(_queries(x), exclude(x, "lang", ["es"]), 10))


@query("ivf_all_cells", _knn_sql(sql_l2("q.v", "p.v"), "p.lang <> 'es'"))
def ivf_all_cells(spark, sf):
    """The cell join that probes every cell equals the exact join."""
    x = _vectors(spark, sf)
    pool = exclude(x, "lang", ["es"])
    model = knn.fit_cells(pool, 8)
    return _shown(knn.cell_join(_queries(x), pool, 10, model, n_probe=8))


def _recall(spark, sf, join):
    x = _vectors(spark, sf)
    q, pool = _queries(x), exclude(x, "lang", ["es"])
    return knn.recall(join(q, pool), knn.knn_join(q, pool, 10), "query_id", "vec_id")


@query("ivf_probe_join")
def ivf_probe_join(spark, sf):
    """Recall at 10 of the cell join against the exact join."""
    return _recall(spark, sf, lambda q, p: knn.cell_join(q, p, 10, knn.fit_cells(p, 16), n_probe=6))


@query("lsh_join")
def lsh_join(spark, sf):
    """Recall at 10 of the hash join against the exact join."""
    return _recall(spark, sf, lambda q, p: knn.hash_join(q, p, 10, bucket_length=0.5, tables=6))


@query("lsh_multi_probe", """WITH n AS (SELECT count(*) FILTER (WHERE lang = 'es') AS q, count(*) FILTER (WHERE lang <> 'es') AS p
    FROM embeddings JOIN documents ON vec_id = doc_id WHERE embedding IS NOT NULL)
  SELECT q * least(p, 10) AS exact_hits, true AS enough FROM n""")
def lsh_multi_probe(spark, sf):
    """The hash join with narrow buckets of three projections and their neighbours: recall at 10 is nine tenths or more."""
    found = _recall(spark, sf, lambda q, p: knn.hash_join(q, p, 10, bucket_length=0.3, tables=6, parts=3, probes=12))
    return found.select("exact_hits", (F.col("recall") >= 0.9).alias("enough"))


@query("cluster_embeddings")
def cluster_embeddings(spark, sf):
    x = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return (knn.assign_cells(x, knn.fit_cells(x, 10), name="cluster")
            .groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))


@query("cluster_score")
def cluster_score(spark, sf):
    """Cluster size as a re-ranking criterion."""
    rows = cluster_sizes(with_vectors(spark, sf)).withColumn("dist_norm", F.lit(0.0))
    return weighted_score(rows, "dist_norm", {"cluster": 0.5}).select("doc_id", "cluster_size", "cluster_score", "score")


# --- retrieval ----------------------------------------------------------------------------

def _base_sql(k: int | str, partition: str, order: str, rows: str = "first") -> str:
    """hits of distinct texts (of all rows where ``rows`` is 'p') -> scaled -> two-stage first-wins; ``partition`` is '' or 'query_id, '."""
    over = f"PARTITION BY {partition.rstrip(', ')}" if partition else ""
    return f"""WITH x AS ({WITH_VECTORS}),
      p AS (SELECT q.doc_id AS query_id, p.doc_id, p.lang, p.source, p.label, p.text, {sql_l2('q.v', 'p.v')} AS dist
            FROM x q, x p WHERE q.lang = 'es' AND p.lang <> 'es'),
      first AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY dist, doc_id) = 1),
      h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM {rows})
            WHERE rank <= {k}),
      s AS (SELECT *, CASE WHEN max(dist) OVER ({over}) > min(dist) OVER ({over})
            THEN (dist - min(dist) OVER ({over})) / (max(dist) OVER ({over}) - min(dist) OVER ({over})) ELSE 0 END AS dist_norm FROM h),
      d1 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY {partition}source, doc_id ORDER BY {order}) = 1),
      d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY {partition}text ORDER BY {order}) = 1)"""


def _scaled_tokens(src: str, over: str = "") -> str:
    return f"""t AS (SELECT *, -{WORDS}::DOUBLE AS tok FROM {src}),
      c AS (SELECT *, CASE WHEN max(tok) OVER ({over}) > min(tok) OVER ({over})
            THEN (tok - min(tok) OVER ({over})) / (max(tok) OVER ({over}) - min(tok) OVER ({over})) ELSE 0 END AS length_score FROM t)"""


RETRIEVE_MULTI = f"""{_base_sql(20, '', 'query_id, rank')},
  cut AS (SELECT * FROM d2 ORDER BY query_id, rank LIMIT 60), {_scaled_tokens('cut')},
  f AS (SELECT *, 0.8::DOUBLE * dist_norm + 0.2::DOUBLE * length_score AS score FROM c),
  b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score, query_id, rank) AS place,
        count(*) FILTER (label = 0) OVER () AS n0, count(*) FILTER (label = 1) OVER () AS n1 FROM f)
  SELECT doc_id, lang, source, label, query_id, rank, {sql_rnd('dist')} AS dist, {sql_rnd('dist_norm')} AS dist_norm,
    {sql_rnd('length_score')} AS length_score, {sql_rnd('score')} AS score
  FROM b WHERE place <= least(n0, n1, 10)"""


@query("retrieve_multi", RETRIEVE_MULTI)
def flagship(spark, sf):
    """The flagship: balanced rows for a whole query set, re-ranked by distance and token count."""
    x = with_vectors(spark, sf)
    rows = retrieve_multi(target_queries(x), x.drop("quality", "toxic", "topic", "n_chars"), 20, 20,
                          weights={"unique_words": 0.2}, balance=True, exclude_languages=["es"])
    return rows.select("doc_id", "lang", "source", "label", "query_id", F.col("rank").cast("long").alias("rank"),
                       *[rnd(c).alias(c) for c in ("dist", "dist_norm", "length_score", "score")])


@query("retrieve_multi_closest", f"""{_base_sql(20, '', 'dist, query_id, rank')},
  cut AS (SELECT * FROM d2 ORDER BY dist, query_id, rank LIMIT 60)
  SELECT doc_id, query_id, rank, {sql_rnd('dist_norm')} AS score FROM cut ORDER BY dist_norm, query_id, rank LIMIT 20""")
def retrieve_multi_closest(spark, sf):
    """First-wins by distance instead of query order, no criteria, no balancing."""
    x = with_vectors(spark, sf)
    rows = retrieve_multi(target_queries(x), x, 20, 20, policy="closest", exclude_languages=["es"])
    return rows.select("doc_id", "query_id", F.col("rank").cast("long").alias("rank"), rnd("score").alias("score"))


PER_QUERY = f"""{_base_sql(15, 'query_id, ', 'rank')}, {_scaled_tokens('d2', 'PARTITION BY query_id')},
  f AS (SELECT *, 0.8::DOUBLE * dist_norm + 0.2::DOUBLE * length_score AS score FROM c),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, rank) AS position FROM f)"""


def per_query_hits(spark, sf, k=5, **kw):
    x = with_vectors(spark, sf)
    kw.setdefault("weights", {"unique_words": 0.2})
    return retrieve_per_query(target_queries(x), x, k, exclude_languages=["es"], **kw)


@query("retrieve_per_query", f"""{PER_QUERY}
  SELECT query_id, doc_id, label, position, {sql_rnd('score')} AS score FROM o WHERE position <= 5""")
def q_retrieve_per_query(spark, sf):
    return per_query_hits(spark, sf).select("query_id", "doc_id", "label", F.col("position").cast("long").alias("position"),
                                            rnd("score").alias("score"))


@query("retrieve_per_query_balanced", f"""{PER_QUERY},
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score, rank) AS place,
        count(*) FILTER (label = 0) OVER (PARTITION BY query_id) AS n0,
        count(*) FILTER (label = 1) OVER (PARTITION BY query_id) AS n1 FROM f)
  SELECT query_id, doc_id, label, row_number() OVER (PARTITION BY query_id ORDER BY score, rank) AS position
  FROM b WHERE place <= least(n0, n1, 2)""")
def q_retrieve_balanced(spark, sf):
    return per_query_hits(spark, sf, balance=True).select(
        "query_id", "doc_id", "label", F.col("position").cast("long").alias("position"))


@query("retrieve_per_query_clustered")
def q_retrieve_clustered(spark, sf):
    """The size of a candidate's cluster among its query's candidates as a criterion."""
    return per_query_hits(spark, sf, k=40, weights={"cluster": 0.5}).select(
        "query_id", "doc_id", F.col("position").cast("long").alias("position"), "cluster_size", rnd("score").alias("score"))


@query("retrieve_random", f"""WITH p AS (SELECT * FROM ({LABELLED}) WHERE lang <> 'es'),
  r AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-0')) AS rank FROM p),
  d1 AS (SELECT * FROM r WHERE rank <= 100),
  d2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY text ORDER BY rank) = 1), {_scaled_tokens('d2')}
  SELECT doc_id, rank, {sql_rnd('0.3::DOUBLE * length_score')} AS score FROM c
  ORDER BY 0.3::DOUBLE * length_score, rank LIMIT 30""")
def q_retrieve_random(spark, sf):
    rows = retrieve_random(labelled(spark, sf), 30, weights={"unique_words": 0.3}, exclude_languages=["es"])
    return rows.select("doc_id", F.col("rank").cast("long").alias("rank"), rnd("score").alias("score"))


@query("candidate_depth", f"""WITH x AS ({WITH_VECTORS})
  SELECT count(*) AS n_queries, greatest(ceil(40 / count(*)), ceil(2000 / count(*)), 2)::BIGINT AS k FROM x WHERE lang = 'es'""")
def q_candidate_depth(spark, sf):
    q = target_queries(with_vectors(spark, sf))
    n = q.count()
    return q.agg(F.count(F.lit(1)).alias("n_queries")).withColumn("k", F.lit(candidate_depth(20, n)).cast("long"))


_DEEPEN = """(SELECT min(k) FROM (SELECT unnest([1::BIGINT << i FOR i IN range(0, 40)]) AS k) WHERE
    k > (SELECT count(DISTINCT text) FROM x WHERE lang <> 'es') OR 100 <= (SELECT count(DISTINCT text) FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id) AS rank FROM first) WHERE rank <= k))"""


@query("adaptive_depth", f"""{_base_sql(_DEEPEN, '', 'query_id, rank')},
  cut AS (SELECT * FROM d2 ORDER BY query_id, rank LIMIT 150)
  SELECT doc_id, query_id, rank FROM cut ORDER BY dist_norm, query_id, rank LIMIT 50""")
def adaptive_depth(spark, sf):
    """Starts at one neighbour per query and deepens until enough rows are unique."""
    x = with_vectors(spark, sf)
    rows = retrieve_multi(target_queries(x), x, 50, 1, exclude_languages=["es"])
    return rows.select("doc_id", "query_id", F.col("rank").cast("long").alias("rank"))


# --- selection ----------------------------------------------------------------------------

@query("dedup_two_stage", f"""{_base_sql(10, '', 'query_id, rank', 'p')} SELECT query_id, rank, doc_id, source FROM d2""")
def q_dedup(spark, sf):
    x = with_vectors(spark, sf)
    pool, q = exclude(x, "lang", ["es"]), target_queries(x)
    hits = attach(knn.knn_join(q, pool, 10, pool_id="doc_id", carry=["source"]), pool, "doc_id", ["text"], q.count() * 10)
    return dedup_two_stage(hits, ["source", "doc_id"], "text", ["query_id", "rank"]).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "source")


@query("balance_labels", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n_chars DESC, doc_id) AS place,
    count(*) FILTER (label = 0) OVER () AS n0, count(*) FILTER (label = 1) OVER () AS n1 FROM ({LABELLED}))
  SELECT doc_id, label FROM r WHERE place <= least(n0, n1, 40)""")
def q_balance(spark, sf):
    return balance_labels(labelled(spark, sf), 80, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "label")


@query("rebalance_classes", f"""WITH x AS ({LABELLED}), r AS (SELECT *,
    row_number() OVER (PARTITION BY source, label ORDER BY md5(doc_id::VARCHAR || '-123')) AS place FROM x)
  SELECT doc_id, source, label FROM r WHERE label = 1 OR place <= CASE source WHEN 'src0' THEN 5 WHEN 'src7' THEN 9 ELSE 1000000000 END""")
def q_rebalance(spark, sf):
    return rebalance_classes(labelled(spark, sf), {"src0": 5, "src7": 9}, "doc_id", "source").select("doc_id", "source", "label")


@query("cap_negatives", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, label ORDER BY doc_id) AS place FROM ({LABELLED}))
  SELECT doc_id, lang, label FROM r WHERE label <> 0 OR place <= 40""")
def q_cap(spark, sf):
    return cap_rows(labelled(spark, sf), F.col("label") == 0, ["lang"], ["doc_id"], 40).select("doc_id", "lang", "label")


@query("criteria_scores", f"""WITH m AS (SELECT vec_id AS doc_id, -list_sum([p * ln(p + 1e-10) FOR p IN probs]) AS uncertainty,
    list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] AS margin FROM ({PROBABILITIES})),
  x AS (SELECT l.doc_id, -{WORDS}::DOUBLE AS a, -coalesce(uncertainty, 0) AS b, coalesce(margin, 0) AS c
        FROM ({LABELLED}) l LEFT JOIN m USING (doc_id)),
  y AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS length_score,
    (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()) AS uncertainty_score,
    (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS margin_score FROM x)
  SELECT doc_id, {sql_rnd('length_score')} AS length_score, {sql_rnd('uncertainty_score')} AS uncertainty_score,
    {sql_rnd('margin_score')} AS margin_score,
    {sql_rnd('0.2::DOUBLE * length_score + 0.3::DOUBLE * uncertainty_score + 0.1::DOUBLE * margin_score')} AS score FROM y""")
def q_criteria(spark, sf):
    m = probabilities(spark, sf).select(F.col("vec_id").alias("doc_id"), entropy("probs").alias("uncertainty"),
                                        margin("probs").alias("margin"))
    rows = labelled(spark, sf).join(m, "doc_id", "left").withColumn("dist_norm", F.lit(0.0))
    out = weighted_score(rows, "dist_norm", {"unique_words": 0.2, "uncertainty": 0.3, "margin": 0.1})
    return out.select("doc_id", *[rnd(c).alias(c) for c in ("length_score", "uncertainty_score", "margin_score", "score")])


@query("subword_scores")
def q_subwords(spark, sf):
    """Distinct sub-word pieces of every document and their scaled score; the vocabulary has no SQL form."""
    model = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")
    counted = durable(table(spark, sf, "documents").select("doc_id", F.lit(0.0).alias("dist_norm"),
                                                           unique_pieces("text", model).alias("unique_pieces")), "pieces")
    out = weighted_score(counted, "dist_norm", {"unique_pieces": 0.5})
    return out.select("doc_id", "unique_pieces", rnd("length_score").alias("length_score"), rnd("score").alias("score"))


# --- diversity ----------------------------------------------------------------------------

def _mmr_sql(src: str, group: str, threshold: float, min_remained: int) -> str:
    """Greedy selection as a recursive walk over ``src`` per ``group``; yields (grp, doc_id) survivors."""
    return f"""mr AS (SELECT {group} AS grp, c.doc_id, [z / {sql_norm('x.v')} FOR z IN x.v] AS u, dist_norm,
        row_number() OVER (PARTITION BY {group} ORDER BY c.doc_id) AS i,
        CASE WHEN max(-dist_norm) OVER (PARTITION BY {group}) > min(-dist_norm) OVER (PARTITION BY {group})
          THEN (-dist_norm - min(-dist_norm) OVER (PARTITION BY {group})) / (max(-dist_norm) OVER (PARTITION BY {group}) - min(-dist_norm) OVER (PARTITION BY {group}))
          ELSE 0 END AS rel FROM {src} c JOIN x ON x.doc_id = c.doc_id),
      ms AS (SELECT a.grp, a.doc_id, a.i, a.rel, list({sql_dot('a.u', 'b.u')} ORDER BY b.i) AS sims
        FROM mr a JOIN mr b ON a.grp = b.grp GROUP BY a.grp, a.doc_id, a.i, a.rel),
      walk AS (SELECT grp, 1 AS step, [arg_max(i, rel * 1e6 - i * 1e-6)] AS picked FROM ms GROUP BY grp
        UNION ALL SELECT grp, step + 1, list_append(picked, i) FROM (
          SELECT *, row_number() OVER (PARTITION BY grp ORDER BY 0.5::DOUBLE * rel - 0.5::DOUBLE * top DESC, i) AS rn FROM (
            SELECT w.grp, w.step, w.picked, ms.i, ms.rel, list_max([ms.sims[p] FOR p IN w.picked]) AS top
            FROM walk w JOIN ms ON ms.grp = w.grp AND NOT list_contains(w.picked, ms.i)))
        WHERE rn = 1 AND NOT (step >= {min_remained} AND top > {threshold}::DOUBLE)),
      wl AS (SELECT grp, unnest(picked) AS i FROM (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY grp))),
      kept AS (SELECT ms.grp, ms.doc_id FROM wl JOIN ms ON ms.grp = wl.grp AND ms.i = wl.i)"""


@query("mmr_per_query", f"""{_base_sql(15, 'query_id, ', 'rank').replace('WITH x', 'WITH RECURSIVE x')}, {_mmr_sql('d2', 'query_id', 0.2, 5)},
  e AS (SELECT d2.* FROM d2 JOIN kept ON kept.grp = d2.query_id AND kept.doc_id = d2.doc_id), {_scaled_tokens('e', 'PARTITION BY query_id')},
  f AS (SELECT *, 0.8::DOUBLE * dist_norm + 0.2::DOUBLE * length_score AS score FROM c),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, rank) AS position FROM f)
  SELECT query_id, doc_id, position, {sql_rnd('score')} AS score FROM o WHERE position <= 5""")
def mmr_per_query(spark, sf):
    return per_query_hits(spark, sf, mmr_threshold=0.2).select(
        "query_id", "doc_id", F.col("position").cast("long").alias("position"), rnd("score").alias("score"))


@query("mmr_multi", f"""{_base_sql(20, '', 'query_id, rank').replace('WITH x', 'WITH RECURSIVE x')},
  cut AS (SELECT * FROM d2 ORDER BY query_id, rank LIMIT 60), {_mmr_sql('cut', '0', 0.3, 20)}
  SELECT cut.doc_id, query_id, {sql_rnd('dist_norm')} AS score FROM cut JOIN kept ON kept.doc_id = cut.doc_id
  ORDER BY dist_norm, query_id, rank LIMIT 20""")
def mmr_multi(spark, sf):
    x = with_vectors(spark, sf)
    return retrieve_multi(target_queries(x), x, 20, 20, mmr_threshold=0.3, exclude_languages=["es"]).select(
        "doc_id", "query_id", rnd("score").alias("score"))


def _step(tag: str, src: str, group: str, threshold: float, min_remained: int) -> str:
    """``_mmr_sql`` with its relations named by ``tag``."""
    return re.sub(r"\b(mr|ms|walk|wl|kept)\b", rf"\1_{tag}", _mmr_sql(src, group, threshold, min_remained))


MMR_PARTITIONED = f"""WITH RECURSIVE x AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
  c0 AS (SELECT doc_id, v[1] AS dist_norm, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4) AS bucket FROM x),
  {_step('a', 'c0', 'bucket', 0.3, 25)}, c1 AS (SELECT c0.* FROM c0 JOIN kept_a USING (doc_id)), {_step('b', 'c1', '0', 0.3, 100)}
  SELECT doc_id AS vec_id FROM kept_b"""


@query("mmr_partitioned", MMR_PARTITIONED)
def q_mmr_partitioned(spark, sf):
    """Two-step selection over all vectors, dealt into four buckets."""
    x = table(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("rel", F.col("embedding")[0].cast("double"))
    return mmr_partitioned(x, "embedding", "rel", "vec_id", threshold=0.3, min_remained=100, buckets=4).select("vec_id")


MMR_TREE = f"""WITH RECURSIVE x AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
  c0 AS (SELECT doc_id, v[1] AS dist_norm, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 4) AS bucket FROM x),
  {_step('a', 'c0', 'bucket', 0.3, 20)}, c1 AS (SELECT c0.doc_id, dist_norm, bucket // 2 AS bucket FROM c0 JOIN kept_a USING (doc_id)),
  {_step('b', 'c1', 'bucket', 0.3, 40)}, c2 AS (SELECT c1.* FROM c1 JOIN kept_b USING (doc_id)), {_step('c', 'c2', '0', 0.3, 80)}
  SELECT doc_id AS vec_id FROM kept_c"""


@query("mmr_tree", MMR_TREE)
def q_mmr_tree(spark, sf):
    """Selection over all vectors in a tree of three levels: four leaves, two nodes, one root."""
    x = table(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("rel", F.col("embedding")[0].cast("double"))
    return mmr_partitioned(x, "embedding", "rel", "vec_id", threshold=0.3, min_remained=80, buckets=4, fan=2).select("vec_id")


@query("pool_build")
def q_pool_build(spark, sf):
    rows = with_vectors(spark, sf).select("doc_id", "text", "lang", "source", "label", "embedding")
    pool = build_pool(rows, "doc_id", add_perplexity=True, add_uncertainty=True, mmr_threshold=0.3)
    return pool.select("doc_id", "lang", "source", "label", rnd("perplexity", 3).alias("perplexity"),
                       rnd("uncertainty").alias("uncertainty"), rnd("margin").alias("margin"))


# --- sweep --------------------------------------------------------------------------------

def _candidates(spark, sf):
    """Fifteen distinct neighbours per query with their scaled criteria."""
    hits = per_query_hits(spark, sf, k=15, weights={"unique_words": 0.5})
    return hits


_W, _N = [0.0, 0.1, 0.2, 0.3, 0.4], [1, 3, 5]


PARAM_SWEEP = f"""{_base_sql(45, 'query_id, ', 'rank')}, {_scaled_tokens('d2', 'PARTITION BY query_id')},
  f AS (SELECT *, 0.5::DOUBLE * dist_norm + 0.5::DOUBLE * length_score AS score FROM c),
  o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, rank) <= 15),
  g AS (SELECT o.*, w.w AS w_length_score, (1.0::DOUBLE - w.w) * dist_norm + (0.0::DOUBLE + w.w * length_score) AS s2
        FROM o, (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in _W)}]) AS w) w),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id, w_length_score ORDER BY s2, rank) AS place FROM g),
  v AS (SELECT w_length_score, n, query_id, CASE WHEN sum(label) * 2 >= count(*) THEN 1 ELSE 0 END AS pred
        FROM k, (SELECT unnest({_N}) AS n) WHERE place <= n GROUP BY ALL),
  y AS (SELECT v.*, x.label FROM v JOIN x ON x.doc_id = v.query_id),
  cls AS (SELECT w_length_score, n, unnest([0, 1]) AS cls, label, pred FROM y),
  f1 AS (SELECT w_length_score, n, cls, sum((label = cls AND pred = cls)::INT) AS tp, sum((label = cls)::INT) AS sup,
         sum((pred = cls)::INT) AS prd FROM cls GROUP BY ALL)
  SELECT w_length_score, n::INT AS top_n, {sql_rnd('avg(2 * tp / (sup + prd))')} AS f1_macro FROM f1 WHERE sup + prd > 0 GROUP BY ALL"""


@query("param_sweep", PARAM_SWEEP)
def param_sweep(spark, sf):
    scores = sweep_weights(_candidates(spark, sf), _truth(spark, sf), ["length_score"], _W, _N)
    return scores.select("w_length_score", "top_n", rnd("f1_macro").alias("f1_macro"))


def _truth(spark, sf):
    return labelled(spark, sf).where(F.col("lang") == "es").select(F.col("doc_id").alias("query_id"), "label")


@query("param_sweep_best", f"SELECT * FROM ({PARAM_SWEEP}) ORDER BY f1_macro DESC, w_length_score, top_n LIMIT 1")
def param_sweep_best(spark, sf):
    scores = sweep_weights(_candidates(spark, sf), _truth(spark, sf), ["length_score"], _W, _N)
    return best_point(scores.withColumn("f1_macro", rnd("f1_macro")), ["w_length_score", "top_n"])


@query("diversity_sweep")
def diversity_sweep(spark, sf):
    x = with_vectors(spark, sf)
    rows = attach(per_query_hits(spark, sf, k=15), x, "doc_id", ["embedding"], target_queries(x).count() * 15)
    return sweep_diversity(rows, _truth(spark, sf), [0.1, 0.2, 0.5], [0.3, 0.5, 0.8], 5).withColumn("f1_macro", rnd("f1_macro"))


@query("vector_normalise", f"""SELECT vec_id, {sql_rnd('list_sum([c / n FOR c IN v])')} AS total FROM (
  SELECT vec_id, embedding::DOUBLE[] AS v, {sql_norm('embedding::DOUBLE[]')} AS n FROM embeddings)""")
def vector_normalise(spark, sf):
    from fewlabel.functions.vectors import total
    return table(spark, sf, "embeddings").select("vec_id", rnd(total(unit("embedding"))).alias("total"))
