"""Metrics, reports, signals, alignment and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.functions.scaling import normalise_per_group
from fewlabel.functions.signals import entropy, margin
from fewlabel.functions.vectors import arg_max
from fewlabel.operators import alignment, density, metrics, perplexity as ppl, reports, topics
from fewlabel.operators.joins import only_keys
from fewlabel.plans.registry import query, rnd, sql_rnd
from fewlabel.plans.tables import (
    LABELLED, PREDICTIONS, PROBABILITIES, RUNS, WITH_VECTORS, labelled, predictions, probabilities, runs, sql_dot,
    sql_l2, sql_norm, table, with_vectors)
from fewlabel.session import durable


def _metrics_sql(by: str) -> str:
    b = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""WITH x AS ({PREDICTIONS}),
      c AS (SELECT {b}label, pred, count(*) AS n FROM x GROUP BY ALL),
      s AS (SELECT {b}label AS cls, n AS support, 0 AS predicted, CASE WHEN label = pred THEN n ELSE 0 END AS tp FROM c
            UNION ALL SELECT {b}pred, 0, n, 0 FROM c),
      k AS (SELECT {b}cls, sum(support)::DOUBLE AS support, sum(predicted)::DOUBLE AS predicted, sum(tp)::DOUBLE AS tp FROM s GROUP BY ALL),
      m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
            CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM k)
      SELECT {b}sum(support)::BIGINT AS n, {sql_rnd('sum(tp) / sum(support)')} AS accuracy, {sql_rnd('avg(f1)')} AS f1_macro,
        {sql_rnd('avg(f1) FILTER (cls <> -1)')} AS f1_macro_valid, {sql_rnd('sum(f1 * support) / sum(support)')} AS f1_weighted,
        {sql_rnd('sum(p * support) / sum(support)')} AS precision_weighted, {sql_rnd('sum(r * support) / sum(support)')} AS recall_weighted,
        {sql_rnd('coalesce(max(p) FILTER (cls = 1), 0)')} AS precision_1, {sql_rnd('coalesce(max(r) FILTER (cls = 1), 0)')} AS recall_1,
        {sql_rnd('coalesce(max(f1) FILTER (cls = 1), 0)')} AS f1_1, coalesce(max(support) FILTER (cls = 1), 0)::BIGINT AS support_1,
        coalesce(sum(predicted) FILTER (cls = -1), 0)::BIGINT AS n_invalid FROM m {grp}"""


_RATES = ["accuracy", "f1_macro", "f1_macro_valid", "f1_weighted", "precision_weighted", "recall_weighted",
          "precision_1", "recall_1", "f1_1"]


def _rounded(df):
    return df.select(*[rnd(c).alias(c) if c in _RATES else F.col(c) for c in df.columns])


@query("classification_metrics", _metrics_sql(""))
def q_metrics(spark, sf):
    return _rounded(metrics.classification_metrics(predictions(spark, sf)))


@query("classification_metrics_by_source", _metrics_sql("source"))
def q_metrics_by(spark, sf):
    return _rounded(metrics.classification_metrics(predictions(spark, sf), by=["source"]))


@query("confusion_counts", f"""SELECT lang, count(*) FILTER (pred = 1 AND label = 1) AS true_positives,
  count(*) FILTER (pred = 1 AND label = 0) AS false_positives, count(*) FILTER (pred = 0 AND label = 1) AS false_negatives,
  count(*) FILTER (pred = 0 AND label = 0) AS true_negatives FROM ({PREDICTIONS}) GROUP BY lang""")
def q_confusion(spark, sf):
    return metrics.confusion_counts(predictions(spark, sf), by=["lang"])


@query("class_weights", f"""WITH c AS (SELECT label, count(*) AS n FROM ({LABELLED}) GROUP BY label)
  SELECT label, n, {sql_rnd('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM c""")
def q_class_weights(spark, sf):
    return metrics.class_weights(labelled(spark, sf)).withColumn("weight", rnd("weight"))


# --- reports ------------------------------------------------------------------------------

_AVG = "CASE WHEN count(f1_macro) >= {m} THEN round_even(avg(f1_macro) * 100, 2) END"


@query("seed_average", f"SELECT source, size, count(f1_macro) AS n_runs, {_AVG.format(m=3)} AS score FROM ({RUNS}) GROUP BY source, size")
def q_seed_average(spark, sf):
    return reports.seed_average(runs(spark, sf), ["source", "size"], "f1_macro")


@query("seed_average_matrix", f"""WITH a AS (SELECT source, size, {_AVG.format(m=3)} AS s FROM ({RUNS}) GROUP BY source, size)
  SELECT source, max(s) FILTER (size = '10') AS n_10, max(s) FILTER (size = '100') AS n_100,
  max(s) FILTER (size = '1000') AS n_1000 FROM a GROUP BY source""")
def q_seed_matrix(spark, sf):
    averages = reports.seed_average(runs(spark, sf), ["source", "size"], "f1_macro")
    return reports.matrix(averages, ["source"], "size", ["10", "100", "1000"], prefix="n_")


_SOURCES = [f"src{i}" for i in range(20)] + ["absent"]


@query("full_grid_report", f"""WITH a AS (SELECT source, size, {_AVG.format(m=3)} AS score, count(f1_macro) AS n_runs FROM ({RUNS}) GROUP BY source, size),
  g AS (SELECT source, size FROM (SELECT unnest({_SOURCES}) AS source), (SELECT unnest(['10', '100', '1000', '5000']) AS size))
  SELECT source, size, n_runs, score FROM g LEFT JOIN a USING (source, size)""")
def q_full_grid(spark, sf):
    averages = reports.seed_average(runs(spark, sf), ["source", "size"], "f1_macro")
    return reports.full_grid(averages, {"source": _SOURCES, "size": ["10", "100", "1000", "5000"]})


_LANG_RUNS = f"""SELECT lang, source, 'rs' || (ascii(substr(md5(doc_id::VARCHAR), 1, 1)) % 5 + 1)::VARCHAR AS seed,
  avg(CASE WHEN quality <> label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f1_macro FROM ({LABELLED}) GROUP BY 1, 2, 3"""


@query("transfer_matrix", f"""WITH a AS (SELECT lang, source, {_AVG.format(m=3)} AS s FROM ({_LANG_RUNS}) GROUP BY lang, source)
  SELECT source, max(s) FILTER (lang = 'de') AS de, max(s) FILTER (lang = 'en') AS en, max(s) FILTER (lang = 'es') AS es,
  max(s) FILTER (lang = 'fr') AS fr FROM a GROUP BY source""")
def q_transfer(spark, sf):
    """First-stage source by second-stage language."""
    seed = F.concat(F.lit("rs"), (F.ascii(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)) % 5 + 1).cast("string"))
    r = (labelled(spark, sf).groupBy("lang", "source", seed.alias("seed"))
         .agg(F.avg((F.col("quality") != F.col("label")).cast("double")).alias("f1_macro")))
    return reports.matrix(reports.seed_average(r, ["lang", "source"], "f1_macro"), ["source"], "lang", ["de", "en", "es", "fr"])


@query("prompt_report_matrix", f"""WITH a AS (SELECT source, size, seed, {sql_rnd('avg(f1_macro) * 100')} AS s FROM ({RUNS}) GROUP BY ALL)
  SELECT source, size, {', '.join(f"max(s) FILTER (seed = 'rs{i}') AS rs{i}" for i in range(1, 6))} FROM a GROUP BY source, size""")
def q_prompt_report(spark, sf):
    """A single run is enough here and nothing is rounded in the average itself."""
    a = reports.seed_average(runs(spark, sf), ["source", "size", "seed"], "f1_macro", min_runs=1, digits=None)
    return reports.matrix(a.withColumn("score", rnd("score")), ["source", "size"], "seed", [f"rs{i}" for i in range(1, 6)])


_VOTES = f"""SELECT lang, least(n_chars // 500, 11) AS pos, source,
  {sql_rnd('avg(CASE WHEN quality <> label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 3)} AS score FROM ({LABELLED}) GROUP BY ALL"""


@query("best_model_vote", f"""WITH v AS ({_VOTES}), t AS (SELECT *, max(score) OVER (PARTITION BY lang, pos) AS top FROM v),
  w AS (SELECT lang, source, count(*) FILTER (score >= top) AS wins FROM t GROUP BY ALL)
  SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY lang ORDER BY wins DESC, source) = 1""")
def q_vote(spark, sf):
    pos = F.least(F.floor(F.col("n_chars") / 500), F.lit(11)).alias("pos")
    v = (labelled(spark, sf).groupBy("lang", pos, "source")
         .agg(rnd(F.avg((F.col("quality") != F.col("label")).cast("double")), 3).alias("score")))
    return reports.best_model_vote(v, ["lang"], "source", "pos", "score")


@query("descriptive_stats", f"""SELECT source, count(*) AS n_total, sum(label)::BIGINT AS n_positive, {sql_rnd('avg(label)')} AS positive_share
  FROM ({LABELLED}) GROUP BY source""")
def q_stats(spark, sf):
    out = reports.descriptive_stats(labelled(spark, sf), ["source"])
    return out.withColumn("positive_share", rnd("positive_share"))


@query("value_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def q_counts(spark, sf):
    return reports.value_counts(table(spark, sf, "documents"), "lang", "source")


@query("duplicate_audit", """SELECT doc_id, source FROM documents
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY source, doc_id) > 1""")
def q_duplicates(spark, sf):
    return reports.duplicate_audit(table(spark, sf, "documents"), "text", ["source", "doc_id"]).select("doc_id", "source")


@query("duplicate_totals", "SELECT count(text) AS n_texts, count(DISTINCT text) AS n_distinct FROM documents")
def q_duplicate_totals(spark, sf):
    return reports.duplicate_totals(table(spark, sf, "documents"), "text")


# --- signals ------------------------------------------------------------------------------

_SIGNALS = f"""SELECT vec_id, d.lang, -list_sum([p * ln(p + 1e-10) FOR p IN probs]) AS uncertainty,
  list_reverse_sort(probs)[1] - list_reverse_sort(probs)[2] AS margin FROM ({PROBABILITIES}) p JOIN documents d ON d.doc_id = p.vec_id"""


def _signals(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return probabilities(spark, sf).join(d, "vec_id").select(
        "vec_id", "lang", entropy("probs").alias("uncertainty"), margin("probs").alias("margin"))


@query("entropy_margin", f"SELECT vec_id, {sql_rnd('uncertainty')} AS uncertainty, {sql_rnd('margin')} AS margin FROM ({_SIGNALS})")
def q_entropy(spark, sf):
    return _signals(spark, sf).select("vec_id", rnd("uncertainty").alias("uncertainty"), rnd("margin").alias("margin"))


@query("argmax_class", f"SELECT vec_id, (list_position(probs, list_max(probs)) - 1)::INT AS pred FROM ({PROBABILITIES})")
def q_argmax(spark, sf):
    return probabilities(spark, sf).select("vec_id", arg_max("probs").alias("pred"))


def _norm_sql(c: str) -> str:
    w = "OVER (PARTITION BY lang)"
    return (f"{sql_rnd(f'({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w} + 1e-10)')} AS {c}_mm, "
            f"{sql_rnd(f'({c} - avg({c}) {w}) / (stddev_pop({c}) {w} + 1e-10)')} AS {c}_z")


@query("normalise_per_language", f"SELECT vec_id, lang, {_norm_sql('uncertainty')}, {_norm_sql('margin')} FROM ({_SIGNALS})")
def q_normalise(spark, sf):
    out = normalise_per_group(_signals(spark, sf), "lang", ["uncertainty", "margin"])
    return out.select("vec_id", "lang", *[rnd(c).alias(c) for c in
                                          ("uncertainty_mm", "uncertainty_z", "margin_mm", "margin_z")])


@query("mean_signal_per_language", f"""SELECT lang, {sql_rnd('avg(uncertainty)')} AS mean_uncertainty,
  {sql_rnd('avg(margin)')} AS mean_margin FROM ({_SIGNALS}) GROUP BY lang""")
def q_mean_signal(spark, sf):
    out = reports.mean_by(_signals(spark, sf), ["lang"], ["uncertainty", "margin"])
    return out.select("lang", rnd("mean_uncertainty").alias("mean_uncertainty"), rnd("mean_margin").alias("mean_margin"))


_PERPLEXITY = r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents),
  b AS (SELECT doc_id, unnest(list_concat(['<s>'], ws[:-2])) AS prev, unnest(ws) AS word FROM t WHERE len(ws) > 0),
  n AS (SELECT doc_id, prev, word, count(*) AS n FROM b GROUP BY ALL),
  pr AS (SELECT prev, word, sum(n) AS c FROM n GROUP BY ALL),
  pv AS (SELECT prev, sum(c) AS cp FROM pr GROUP BY ALL),
  vo AS (SELECT count(DISTINCT word) AS v FROM n),
  m AS (SELECT prev, word, ln((c + 1.0::DOUBLE) / (cp + 1.0::DOUBLE * v)) AS lp FROM pr JOIN pv USING (prev), vo),
  s AS (SELECT doc_id, exp(-sum(n * lp) / sum(n)) AS perplexity FROM n JOIN m USING (prev, word) GROUP BY doc_id)"""


@query("ngram_perplexity", f"{_PERPLEXITY} SELECT d.doc_id, {sql_rnd('perplexity', 3)} AS perplexity FROM documents d LEFT JOIN s USING (doc_id)")
def q_perplexity(spark, sf):
    out = ppl.perplexity(table(spark, sf, "documents"), "doc_id", "text")
    finite = F.when(F.col("perplexity") < float("inf"), F.col("perplexity"))
    return out.select("doc_id", rnd(finite, 3).alias("perplexity"))


@query("rank_by_perplexity", f"""{_PERPLEXITY} SELECT doc_id, row_number() OVER (
  ORDER BY {sql_rnd("coalesce(perplexity, 'infinity'::DOUBLE)", 3)} DESC, doc_id) AS place FROM documents LEFT JOIN s USING (doc_id)""")
def q_rank_perplexity(spark, sf):
    scored = ppl.perplexity(table(spark, sf, "documents"), "doc_id", "text")
    shown = F.when(F.col("perplexity") < float("inf"), rnd("perplexity", 3)).otherwise(F.lit(float("inf")))
    return ppl.rank_by_perplexity(scored.withColumn("perplexity", shown), "doc_id").select("doc_id", "place")


# --- alignment ----------------------------------------------------------------------------

def _halves(spark, sf):
    """The two halves of the vectors as aligned corpora."""
    e = table(spark, sf, "embeddings")
    half = e.agg(F.floor(F.count(F.lit(1)) / 2).alias("h")).scalar()
    e = e.withColumn("h", half)
    return (e.where(F.col("vec_id") < F.col("h")).select(F.col("vec_id").alias("pos"), "embedding"),
            e.where(F.col("vec_id") >= F.col("h")).select((F.col("vec_id") - F.col("h")).alias("pos"), "embedding"))


_HALVES = """h AS (SELECT count(*) // 2 AS h FROM embeddings),
  a AS (SELECT vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings, h WHERE vec_id < h),
  b AS (SELECT vec_id - h AS pos, embedding::DOUBLE[] AS v FROM embeddings, h WHERE vec_id >= h)"""


@query("alignment_score", f"""WITH {_HALVES},
  c AS (SELECT a.pos AS i, b.pos AS j, {sql_dot('a.v', 'b.v')} / ({sql_norm('a.v')} * {sql_norm('b.v')}) AS s FROM a, b WHERE b.pos <= a.pos)
  SELECT {sql_rnd('avg(s) FILTER (i = j)')} AS mean_diagonal,
    {sql_rnd('sum(s) / ((SELECT h FROM h) * (SELECT h FROM h))')} AS mean_lower,
    {sql_rnd('avg(s) FILTER (i = j) - sum(s) / ((SELECT h FROM h) * (SELECT h FROM h))')} AS alignment FROM c""")
def q_alignment(spark, sf):
    out = alignment.alignment_score(*_halves(spark, sf))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("aligned_similarity", f"""WITH {_HALVES} SELECT pos, {sql_rnd(f"{sql_dot('a.v', 'b.v')} / ({sql_norm('a.v')} * {sql_norm('b.v')})")} AS similarity
  FROM a JOIN b USING (pos)""")
def q_aligned(spark, sf):
    return alignment.pairwise_cosine(*_halves(spark, sf)).withColumn("similarity", rnd("similarity"))


@query("crosslingual_retrieval", f"""WITH {_HALVES},
  p AS (SELECT pos AS vec_id, pos AS sent_id, 'xa' AS language, v FROM a UNION ALL SELECT pos + (SELECT h FROM h), pos, 'xb', v FROM b),
  d AS (SELECT q.pos AS query_id, p.*, {sql_l2('q.v', 'p.v')} AS dist FROM a q, p),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d),
  k AS (SELECT unnest({alignment.DEPTHS}) AS k),
  x AS (SELECT k, query_id, sent_id, language FROM r, k WHERE rank > 6 AND rank <= k + 6),
  f AS (SELECT k, count(*) AS found FROM x WHERE language <> 'xa' AND EXISTS (
        SELECT 1 FROM x y WHERE y.k = x.k AND y.query_id = x.query_id AND y.sent_id = x.sent_id AND y.language = 'xa') GROUP BY k)
  SELECT k::INT AS k, round_even(coalesce(found, 0) / ((SELECT count(*) FROM a) * k), 3) AS share FROM k LEFT JOIN f USING (k)""")
def q_crosslingual(spark, sf):
    a, b = _halves(spark, sf)
    h = table(spark, sf, "embeddings").agg(F.floor(F.count(F.lit(1)) / 2).alias("h")).scalar()
    pool = (a.select(F.col("pos").alias("vec_id"), F.col("pos").alias("sent_id"), F.lit("xa").alias("language"), "embedding")
            .unionByName(b.withColumn("h", h).select((F.col("pos") + F.col("h")).alias("vec_id"), F.col("pos").alias("sent_id"),
                                                     F.lit("xb").alias("language"), "embedding")))
    queries = a.select(F.col("pos").alias("query_id"), F.col("embedding").alias("query_vec"))
    return alignment.crosslingual_retrieval(queries, pool, "xa")


# --- topics -------------------------------------------------------------------------------

def _topic_rows(spark, sf):
    """Documents with a fixed assignment: the vector's group, of which group 9 stands for outliers."""
    e = probabilities(spark, sf).select(F.col("vec_id").alias("doc_id"), F.col("label").alias("grp"),
                                        F.col("probs").alias("topic_probs"))
    d = only_keys(table(spark, sf, "documents"), e, "doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.join(e, "doc_id").select(
        "doc_id", "text", F.col("toxic").alias("label"), "topic_probs",
        F.when(F.col("grp") == 9, topics.OUTLIER).otherwise(F.col("grp")).alias("topic"))


_TOPIC_ROWS = f"""SELECT d.doc_id, d.text, l.toxic AS label, p.probs, CASE WHEN p.label = 9 THEN -1 ELSE p.label END AS topic
  FROM documents d LEFT JOIN labels l USING (doc_id) JOIN ({PROBABILITIES}) p ON p.vec_id = d.doc_id"""


@query("topic_sizes", f"SELECT topic, count(*) AS n FROM ({_TOPIC_ROWS}) GROUP BY topic")
def q_topic_sizes(spark, sf):
    return topics.topic_sizes(_topic_rows(spark, sf))


@query("topic_sizes_per_label", f"SELECT label, topic, count(*) AS n FROM ({_TOPIC_ROWS}) WHERE topic <> -1 AND label IS NOT NULL GROUP BY ALL")
def q_topic_sizes_label(spark, sf):
    return topics.topic_sizes(_topic_rows(spark, sf).where(F.col("label").isNotNull()), by_label=True)


@query("dominant_topics", f"""SELECT topic, count(*) AS n FROM ({_TOPIC_ROWS}) WHERE topic <> -1 GROUP BY topic
  HAVING count(*) >= 0.1::DOUBLE * (SELECT count(*) FROM ({_TOPIC_ROWS}))""")
def q_dominant(spark, sf):
    return topics.dominant_topics(_topic_rows(spark, sf), 0.1)


def _topic_stats_sql(by: str) -> str:
    sel, grp = (f"{by}, ", f"WHERE {by} IS NOT NULL GROUP BY {by}") if by else ("", "")
    ent = "-list_sum([CASE WHEN p > 0 THEN p / list_sum(probs) * ln(p / list_sum(probs)) ELSE 0 END FOR p IN probs])"
    return f"SELECT {sel}{sql_rnd(f'avg({ent})')} AS mean_entropy, {sql_rnd('avg(list_max(probs))')} AS purity FROM ({_TOPIC_ROWS}) {grp}"


@query("topic_stats", _topic_stats_sql(""))
def q_topic_stats(spark, sf):
    return _stats(topics.topic_stats(_topic_rows(spark, sf)))


@query("topic_stats_per_label", _topic_stats_sql("label"))
def q_topic_stats_label(spark, sf):
    return _stats(topics.topic_stats(_topic_rows(spark, sf).where(F.col("label").isNotNull()), ["label"]))


def _stats(df):
    return df.withColumn("mean_entropy", rnd("mean_entropy")).withColumn("purity", rnd("purity"))


_KEYWORDS = rf"""w AS (SELECT topic, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS word FROM ({_TOPIC_ROWS}) WHERE topic <> -1),
  c AS (SELECT topic, word, count(*) AS tf FROM w GROUP BY ALL),
  sz AS (SELECT topic, sum(tf)::DOUBLE AS size FROM c GROUP BY ALL), fw AS (SELECT word, sum(tf)::DOUBLE AS f FROM c GROUP BY ALL),
  sc AS (SELECT topic, word, tf, tf / size * ln(1 + (SELECT avg(size) FROM sz) / f) AS score FROM c JOIN sz USING (topic) JOIN fw USING (word)),
  kw AS (SELECT topic, word, tf, score, row_number() OVER (PARTITION BY topic ORDER BY score DESC, word) AS place FROM sc
         QUALIFY place <= 10)"""


@query("topic_keywords", f"WITH {_KEYWORDS} SELECT topic, word, tf, {sql_rnd('score')} AS score, place::INT AS place FROM kw")
def q_keywords(spark, sf):
    return topics.topic_keywords(_topic_rows(spark, sf)).withColumn("score", rnd("score"))


@query("topic_keywords_per_label", f"""WITH {_KEYWORDS},
  s AS (SELECT label, topic, count(*) AS n FROM ({_TOPIC_ROWS}) WHERE topic <> -1 AND label IS NOT NULL GROUP BY ALL),
  o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, topic) AS topic_place FROM s)
  SELECT label, topic, n, topic_place::INT AS topic_place, word, place::INT AS place FROM o JOIN kw USING (topic)""")
def q_keywords_label(spark, sf):
    rows = _topic_rows(spark, sf)
    out = topics.keywords_per_label(rows.where(F.col("label").isNotNull()), topics.topic_keywords(rows))
    return out.select("label", "topic", "n", "topic_place", "word", "place")


@query("topic_coherence", rf"""WITH {_KEYWORDS},
  dt AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS ws FROM ({_TOPIC_ROWS})),
  nw AS (SELECT doc_id, greatest(1, len(ws) - 109) AS n FROM dt),
  tot AS (SELECT sum(n)::DOUBLE AS t FROM nw),
  ps AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM dt),
  pk AS (SELECT * FROM ps WHERE word IN (SELECT word FROM kw)),
  st AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(0, i - 109), least(n - 1, i) + 1)) AS s FROM pk JOIN nw USING (doc_id)),
  sg AS (SELECT word, count(*)::DOUBLE AS n FROM st GROUP BY word),
  tp AS (SELECT a.topic, a.word AS a, b.word AS b FROM kw a JOIN kw b USING (topic)),
  up AS (SELECT DISTINCT a, b FROM tp),
  co AS (SELECT up.a, up.b, count(*)::DOUBLE AS n FROM up JOIN st x ON x.word = up.a JOIN st y ON y.word = up.b AND y.doc_id = x.doc_id AND y.s = x.s GROUP BY ALL),
  pb AS (SELECT tp.topic, tp.a, tp.b, coalesce(co.n, 0) / t + 1e-12 AS p, sa.n / t AS pa, sb.n / t AS pbb
         FROM tp LEFT JOIN co USING (a, b) JOIN sg sa ON sa.word = tp.a JOIN sg sb ON sb.word = tp.b, tot),
  np AS (SELECT topic, a, b, ln(p / (pa * pbb)) / -ln(p) AS v FROM pb),
  sm AS (SELECT topic, b, sum(v) AS s FROM np GROUP BY ALL),
  ls AS (SELECT topic, sqrt(sum(s * s)) AS l FROM sm GROUP BY topic),
  wc AS (SELECT np.topic, np.a, sum(np.v * sm.s) / (sqrt(sum(np.v * np.v)) * any_value(ls.l)) AS cos
         FROM np JOIN sm ON sm.topic = np.topic AND sm.b = np.b JOIN ls ON ls.topic = np.topic GROUP BY ALL)
  SELECT topic, {sql_rnd('avg(cos)', 5)} AS coherence FROM wc GROUP BY topic""")
def q_coherence(spark, sf):
    rows = durable(_topic_rows(spark, sf).select("doc_id", "text", "topic"), "topic-rows")  # for the keywords and the windows
    return topics.coherence(rows, topics.topic_keywords(rows)).withColumn("coherence", rnd("coherence", 5))


_GRID = f"""dv AS (SELECT doc_id, v FROM ({WITH_VECTORS})),
  cl AS (SELECT doc_id, [{", ".join(f"floor({sql_dot('v', str(d) + '::DOUBLE[]')} / 0.1)::BIGINT" for d in density.directions(64, 2))}] AS cell FROM dv),
  cn AS (SELECT cell, count(*) AS n FROM cl GROUP BY cell),
  dn AS (SELECT cell, n FROM cn WHERE n >= 0.02::DOUBLE * (SELECT sum(n) FROM cn)),
  ed AS (SELECT x.cell AS a, y.cell AS b FROM dn x JOIN dn y ON abs(x.cell[1] - y.cell[1]) <= 1 AND abs(x.cell[2] - y.cell[2]) <= 1),
  re AS (SELECT a, b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a),
  co AS (SELECT a AS cell, min(b) AS component FROM re GROUP BY a),
  hm AS (SELECT x.cell, x.n, co.component, row_number() OVER (PARTITION BY x.cell ORDER BY (x.cell = dn.cell)::INT DESC, dn.n DESC, dn.cell) AS place
         FROM cn x JOIN dn ON abs(x.cell[1] - dn.cell[1]) <= 1 AND abs(x.cell[2] - dn.cell[2]) <= 1 JOIN co ON co.cell = dn.cell),
  sz AS (SELECT component, sum(n) AS size FROM hm WHERE place = 1 GROUP BY component HAVING sum(n) >= 10),
  nb AS (SELECT component, row_number() OVER (ORDER BY size DESC, component) - 1 AS topic FROM sz),
  tp AS (SELECT cl.doc_id, coalesce(nb.topic, -1)::INT AS topic FROM cl LEFT JOIN (SELECT * FROM hm WHERE place = 1) h ON h.cell = cl.cell
         LEFT JOIN nb USING (component))"""


@query("density_topics", f"WITH RECURSIVE {_GRID} SELECT doc_id, topic FROM tp")
def q_density_topics(spark, sf):
    """Density clusters of all labelled documents' vectors; outliers are -1."""
    return density.density_topics(with_vectors(spark, sf).select("doc_id", "embedding"), width=0.1, min_share=0.02).select("doc_id", "topic")


@query("density_topic_sizes", f"""WITH RECURSIVE {_GRID}, js AS (SELECT l.toxic AS label, tp.topic FROM tp JOIN labels l USING (doc_id))
  SELECT label, topic, count(*) AS n FROM js WHERE topic <> -1 GROUP BY ALL""")
def q_density_sizes(spark, sf):
    """How the labels spread over the density clusters."""
    rows = density.density_topics(with_vectors(spark, sf).select("doc_id", "label", "embedding"), width=0.1, min_share=0.02)
    return topics.topic_sizes(rows, by_label=True)


@query("topic_model")
def q_topic_model(spark, sf):
    """Fitted topics: size, mean entropy and purity of each."""
    vectors = topics.term_vectors(table(spark, sf, "documents").select("doc_id", "text"))
    rows = topics.assign(vectors, 8, threshold=0.3)
    return _stats(topics.topic_stats(rows, ["topic"])).join(topics.topic_sizes(rows), "topic")


@query("choose_topic_count")
def q_choose(spark, sf):
    out = topics.choose_topic_count(table(spark, sf, "documents").select("doc_id", "text"))
    return out.withColumn("coherence", rnd("coherence", 5))
