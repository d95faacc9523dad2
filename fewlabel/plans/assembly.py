"""Cleaning, labels, answers, splits, unions, curriculum and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.functions import answers, labels, text as txt
from fewlabel.operators import combine, curriculum, prompts, sampling
from fewlabel.plans.registry import query, rnd, sql_case, sql_rnd, sql_str
from fewlabel.plans.retrieval import PER_QUERY, per_query_hits
from fewlabel.plans.tables import LABELLED, RUNS, WITH_VECTORS, labelled, runs, table, with_vectors
from fewlabel.session import spread

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


def _clean_sql(x: str) -> str:
    for pattern, new in ((r"@[A-Za-z0-9_-]+", "@user"), (r"http\S+", "http")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return _strip(f"replace(translate({x}, E'\\n\\t', '  '), '[URL]', 'http')")


@query("clean_text", f"""SELECT 'd' AS kind, doc_id AS id, {_clean_sql('text')} AS text FROM documents
  UNION ALL SELECT 'b', item_id, {_clean_sql('text')} FROM benchmark""")
def q_clean(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"), "text")
    return d.unionByName(b).withColumn("text", txt.clean_text("text"))


_ENTITIES = [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")]


def _unescape_sql(x: str) -> str:
    for a, b in _ENTITIES:
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"  # a cut-off entity may lack its semicolon


@query("clean_html", f"SELECT page_id, md5({_clean_sql(_unescape_sql('html'))}) AS digest FROM pages")
def q_clean_html(spark, sf):
    """The same cleaning where entities occur; the SQL knows the entities of this table."""
    return table(spark, sf, "pages").select("page_id", F.md5(txt.clean_text("html")).alias("digest"))


@query("link_placeholder", "SELECT page_id, md5(replace(replace(url, 'http', '@url'), '@url', 'http')) AS digest FROM pages")
def q_link(spark, sf):
    url = F.replace(F.col("url"), F.lit("http"), F.lit("@url"))
    return table(spark, sf, "pages").select("page_id", F.md5(txt.link_placeholder(url)).alias("digest"))


@query("recode_labels", """SELECT vec_id, CASE e.label WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS three_class,
  CASE WHEN contains(d.text, 'the') THEN 1 ELSE 0 END AS has_word, CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS is_word
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""")
def q_recode(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return table(spark, sf, "embeddings").select("vec_id", "label").join(d, "vec_id").select(
        "vec_id", labels.recode("label", labels.RECODE_THREE_CLASS).alias("three_class"),
        labels.contains_word("text", "the").alias("has_word"), labels.equals_word("lang", "en").alias("is_word"))


_NO = {k: v[0] for k, v in labels.LABEL_WORDS.items()}
_YES = {k: v[1] for k, v in labels.LABEL_WORDS.items()}


def _lang_sql(table_: dict, lang: str = "lang") -> str:
    return sql_case(lang, table_, sql_str(table_["en"]))


@query("verbalise", f"""SELECT doc_id, {_lang_sql(labels.INSTRUCTIONS)} || ' ' || text AS input,
  CASE WHEN label = 1 THEN {_lang_sql(_YES)} ELSE {_lang_sql(_NO)} END AS target FROM ({LABELLED})""")
def q_verbalise(spark, sf):
    source, target = labels.verbalise("text", "label", "lang")
    return labelled(spark, sf).select("doc_id", source.alias("input"), target.alias("target"))


# --- answers ------------------------------------------------------------------------------

def _responses(spark, sf):
    """Answers in the words of each language, echoing their prompt, and the raw assistant turns."""
    marker, yes = labels.by_language(answers.MARKERS, "lang"), labels.by_language(_YES, "lang")
    bad = labels.by_language(answers.NOT_HATEFUL, "lang")
    body = (F.when(F.col("quality") == 1, F.concat(F.lit("The comment is "), yes, F.lit(".\n"), F.col("text")))
            .when(F.col("label") == 1, F.concat(bad, F.lit(", "), F.col("text")))
            .otherwise(F.concat(F.lit(" **Does not contain** hate "), F.col("text"))))
    d = labelled(spark, sf).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "lang",
                                   F.concat(F.col("text"), F.lit("\n"), marker, F.lit(" "), body).alias("raw"))
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant").select(
        F.lit("c").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("en").alias("lang"),
        F.col("text").alias("raw"))
    return d.unionByName(c)


_RESPONSES = f"""SELECT 'd' AS kind, doc_id AS id, lang, text || E'\\n' || {_lang_sql(answers.MARKERS)} || ' ' ||
  CASE WHEN quality = 1 THEN 'The comment is ' || {_lang_sql(_YES)} || E'.\\n' || text
       WHEN label = 1 THEN {_lang_sql(answers.NOT_HATEFUL)} || ', ' || text
       ELSE ' **Does not contain** hate ' || text END AS raw FROM ({LABELLED})
  UNION ALL SELECT 'c', conv_id * 1000 + turn, 'en', text FROM conversations WHERE role = 'assistant'"""


def _answer_sql() -> str:
    """The ordered replacements and cuts, one common table per step."""
    steps, x = [], "raw"
    for pick in (lambda t: sql_str(t["en"]), _lang_sql):
        for m in (pick(answers.MARKERS), f"lower({pick(answers.MARKERS)})"):
            steps.append(f"list_last(string_split({{x}}, {m}))")
        steps.append(f"replace({{x}}, {pick(answers.NOT_HATEFUL)}, {pick(_NO)})")
        steps.append(f"replace({{x}}, {pick(answers.HATEFUL)}, {pick(_YES)})")
    steps.append(f"lower({_strip('{x}')})")
    pairs = [(p, "") for p in answers.removal_order()] + answers.REPLACEMENTS
    for lo in range(0, len(pairs), 12):
        e = "{x}"
        for a, b in pairs[lo:lo + 12]:
            e = f"replace({e}, {sql_str(a)}, {sql_str(b)})"
        steps.append(e)
    steps.append(_strip("{x}"))
    steps.append(f"CASE WHEN length({{x}}) > 1 AND substr({{x}}, 1, 1) IN (',', '.', ':', ';') THEN {_strip('substr({x}, 2)')} ELSE {{x}} END")
    steps.append(_strip(f"translate({{x}}, {sql_str(answers.BLANKED)}, {sql_str(' ' * len(answers.BLANKED))})"))
    for d in answers.DELIMITERS:
        steps.append(f"string_split({{x}}, {'chr(10)' if d == chr(10) else sql_str(d)})[1]")
    steps.append(_strip("{x}"))
    ctes = [f"s0 AS (SELECT kind, id, lang, raw AS x FROM ({_RESPONSES}))"]
    for i, s in enumerate(steps):
        ctes.append(f"s{i + 1} AS (SELECT kind, id, lang, {s.replace('{x}', 'x')} AS x FROM s{i})")
    return (f"WITH {', '.join(ctes)} SELECT kind, id, x AS answer, CASE WHEN x = lower({_lang_sql(_YES)}) OR x = 'yes' THEN 1 "
            f"WHEN x = lower({_lang_sql(_NO)}) OR x = 'no' THEN 0 ELSE -1 END AS pred FROM s{len(steps)}")


@query("parse_answer", _answer_sql())
def q_parse(spark, sf):
    cleaned = spread(_responses(spark, sf)).select(
        "kind", "id", "lang", answers.clean_answer(answers.unify("raw", "lang")).alias("answer"))
    return cleaned.select("kind", "id", "answer", answers.verdict(F.col("answer"), "lang").alias("pred"))


@query("positive_word", f"""SELECT doc_id, CASE WHEN lower({_strip(f"' ' || CASE WHEN label = 1 THEN {_lang_sql(_YES)} ELSE {_lang_sql(_NO)} END || ' '")})
  IN ({', '.join(sql_str(w) for w in labels.POSITIVE_WORDS)}) THEN 1 ELSE 0 END AS pred FROM ({LABELLED})""")
def q_positive(spark, sf):
    word = labels.verbalise("text", "label", "lang")[1]
    return labelled(spark, sf).select("doc_id", labels.positive_word(F.concat(F.lit(" "), word, F.lit(" "))).alias("pred"))


@query("strip_template", f"""SELECT doc_id, md5(replace({sql_str('[INST]  [/INST]')} || text, {sql_str('[INST]  [/INST]')}, '')) AS digest FROM documents""")
def q_strip_template(spark, sf):
    shell = prompts.chat_format("llama2")
    echoed = F.concat(F.lit(shell.replace("{instruction}", "")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(answers.strip_template(echoed, F.lit(shell))).alias("digest"))


# --- sampling and splits ------------------------------------------------------------------

@query("sample_n", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '-7')) <= 12")
def q_sample(spark, sf):
    return sampling.sample_n(table(spark, sf, "documents").select("doc_id", "source"), 12, "doc_id", 7, ["source"])


@query("split_train_dev_test", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '-123')) AS p,
    CASE source WHEN 'src3' THEN 6 ELSE 10 END AS t, CASE source WHEN 'src3' THEN 3 ELSE 5 END AS d FROM documents)
  SELECT doc_id, source, CASE WHEN p <= t THEN 'test' WHEN p <= t + d THEN 'dev' ELSE 'train' END AS split FROM r""")
def q_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.split_train_dev_test(rows, "doc_id", "source", 10, 5, {"src3": (6, 3)})


@query("learning_curve_samples", f"""WITH x AS (SELECT doc_id, source, lang, count(*) OVER (PARTITION BY source) AS total FROM documents),
  r AS (SELECT x.*, seed, row_number() OVER (PARTITION BY source, seed ORDER BY md5(doc_id::VARCHAR || '-' || seed::VARCHAR || '-curve')) AS p
        FROM x, (SELECT unnest(range(1, 11)) AS seed))
  SELECT doc_id, source, seed::INT AS seed, n::INT AS n FROM r, (SELECT unnest({sampling.CURVE_SIZES}) AS n)
  WHERE p <= n AND n < total AND (lang = 'en' OR n <= 2000)""")
def q_curve(spark, sf):
    return sampling.learning_curve(table(spark, sf, "documents"), "doc_id", "source").select("doc_id", "source", "seed", "n")


_GIVEN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'test' WHEN source IN ('src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'dev' ELSE 'train' END"


@query("recut_splits", f"""WITH x AS (SELECT doc_id, {_GIVEN} AS split FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5(doc_id::VARCHAR || '-123')) AS p,
    greatest(300 - (SELECT count(*) FROM x WHERE split = 'test'), 0) AS need FROM x)
  SELECT doc_id, split, CASE WHEN split <> 'dev' THEN split WHEN p <= need THEN 'test' WHEN p <= need + 150 THEN 'dev' ELSE 'extra_dev' END AS new_split FROM r""")
def q_recut(spark, sf):
    s = F.col("source")
    given = (F.when(s.isin("src0", "src1", "src2", "src3"), "test")
             .when(s.isin(*[f"src{i}" for i in range(4, 10)]), "dev").otherwise("train"))
    rows = table(spark, sf, "documents").select("doc_id", given.alias("split"))
    return sampling.recut_splits(rows, "doc_id", "split", 300, 150)


@query("shuffle_rows", "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-123')) AS position FROM documents")
def q_shuffle(spark, sf):
    return sampling.shuffle_rows(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("rename_label", "SELECT text, toxic AS label, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)")
def q_rename(spark, sf):
    split = F.when(F.col("quality") == 1, "train").otherwise("test")
    raw = labelled(spark, sf).drop("label").withColumnRenamed("toxic", "HS").withColumn("split", split)
    return labels.project_labelled(raw)


# --- unions -------------------------------------------------------------------------------

def _two_sets(spark, sf):
    """Target rows (es) and rows retrieved for them (other languages) under one schema."""
    x = labelled(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text", "label",
                                   F.col("lang").alias("language"), "n_chars")
    target = x.where(F.col("language") == "es").drop("n_chars")
    other = x.where(F.col("language") != "es").withColumn("score", F.col("n_chars") / 1000.0).drop("n_chars")
    return target, other


_TWO = f"""SELECT doc_id::VARCHAR AS id, text, label, lang AS language, CASE WHEN lang = 'es' THEN 0 ELSE 1 END AS source,
  CASE WHEN lang = 'es' THEN 0.0::DOUBLE ELSE n_chars / 1000.0::DOUBLE END AS score FROM ({LABELLED})"""


@query("combine_train", f"SELECT * FROM ({_TWO}) UNION ALL SELECT * FROM ({_TWO}) WHERE source = 0")
def q_combine(spark, sf):
    return combine.combine_train(*_two_sets(spark, sf), repeat=2)


@query("partition_by_source", f"""SELECT 'target' AS part, count(*) AS n FROM ({_TWO}) WHERE source = 0
  UNION ALL SELECT 'retrieved', count(*) FROM ({_TWO}) WHERE source = 1""")
def q_partition(spark, sf):
    rows = combine.combine_train(*_two_sets(spark, sf))
    parts = [f(rows).withColumn("part", F.lit(n)) for f, n in
             ((combine.target_only, "target"), (combine.retrieved_only, "retrieved"))]
    return combine.union_all(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("training_projection", f"""{PER_QUERY} SELECT text, label, {sql_rnd('score')} AS score, lang AS language FROM o WHERE position <= 5""")
def q_training_rows(spark, sf):
    return combine.training_rows(per_query_hits(spark, sf)).withColumn("score", rnd("score"))


def _datasets(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang", F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    return [(l, l, d.where(F.col("lang") == l).drop("lang")) for l in ("de", "en", "es", "fr")]


_DATASETS = f"""SELECT doc_id, lang AS dataset_name, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split,
  CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END AS dataset_pos FROM ({LABELLED})"""


@query("load_many", f"""SELECT doc_id, dataset_name, dataset_pos, split FROM ({_DATASETS})
  QUALIFY split <> 'train' OR row_number() OVER (PARTITION BY dataset_name, split ORDER BY doc_id) <= 50""")
def q_load_many(spark, sf):
    return combine.load_many(_datasets(spark, sf), 50, "doc_id").select("doc_id", "dataset_name", "dataset_pos", "split")


@query("union_splits", f"SELECT doc_id, dataset_name, split FROM ({_DATASETS})")
def q_union_all(spark, sf):
    return combine.union_splits(combine.load_many(_datasets(spark, sf))).select("doc_id", "dataset_name", "split")


@query("union_splits_selective", f"""SELECT doc_id, dataset_name, split FROM ({_DATASETS})
  QUALIFY split = 'train' OR dataset_pos = max(dataset_pos) OVER (PARTITION BY split)""")
def q_union(spark, sf):
    return combine.union_splits(combine.load_many(_datasets(spark, sf)), ["train"]).select("doc_id", "dataset_name", "split")


@query("repeat_train", f"SELECT doc_id, copy::INT AS copy FROM ({LABELLED}), (SELECT unnest([1, 2, 3]) AS copy)")
def q_repeat(spark, sf):
    return combine.repeat_rows(labelled(spark, sf).select("doc_id"), 3)


# --- curriculum ---------------------------------------------------------------------------

# The share of retrieved rows in every epoch of the schedules that the queries use.
_SHARES = {"linear": "0, 0.25, 0.5, 0.75, 1", "exponential": "0, 1 - exp(-0.6), 1 - exp(-1.2), 1 - exp(-1.8), 1 - exp(-2.4), 1 - exp(-3.0)",
           "stepwise": "0, 0, 0, 0.3, 0.6, 1, 1, 1", "strict_separate": ", ".join(["0"] * 10 + ["1"] * 2)}


def _slices_sql(schedule: str, epochs: int, order: str) -> str:
    plan = ", ".join(f"({e}, ({s})::DOUBLE)" for e, s in enumerate(_SHARES[schedule].split(", ")))
    assert plan.count("DOUBLE") == epochs
    skip = f"share < 1" if schedule == "strict_separate" else "true"
    return f"""WITH x AS ({_TWO}), p(epoch, share) AS (VALUES {plan}),
      r AS (SELECT *, row_number() OVER (ORDER BY score {order}, id) AS place, count(*) OVER () AS n FROM x WHERE source = 1)
      SELECT id, source, epoch::INT AS epoch FROM x, p WHERE source = 0 AND {skip}
      UNION ALL SELECT id, source, epoch::INT FROM r, p WHERE place <= floor(n * share)"""


@query("curriculum_slices", _slices_sql("linear", 5, "ASC"))
def q_slices(spark, sf):
    rows = combine.combine_train(*_two_sets(spark, sf))
    return curriculum.slices(rows, 5, "linear").select("id", "source", "epoch")


@query("curriculum_exponential", _slices_sql("exponential", 6, "DESC"))
def q_slices_exp(spark, sf):
    rows = combine.combine_train(*_two_sets(spark, sf))
    return curriculum.slices(rows, 6, "exponential", ascending=False).select("id", "source", "epoch")


@query("curriculum_stepwise", _slices_sql("stepwise", 8, "ASC"))
def q_slices_step(spark, sf):
    rows = combine.combine_train(*_two_sets(spark, sf))
    return curriculum.slices(rows, 8, "stepwise").select("id", "source", "epoch")


@query("curriculum_separate", _slices_sql("strict_separate", 12, "ASC"))
def q_slices_separate(spark, sf):
    rows = combine.combine_train(*_two_sets(spark, sf))
    return curriculum.slices(rows, 12, "strict_separate").select("id", "source", "epoch")


@query("curriculum_plan", f"""WITH c AS (SELECT count(*) FILTER (source = 0) AS m, count(*) FILTER (source = 1) AS n FROM ({_TWO})),
  a AS (SELECT m, n, unnest(['linear', 'exponential', 'stepwise', 'strict', 'strict_separate']) AS schedule,
    unnest([m + 0.5::DOUBLE * n, m + 0.75::DOUBLE * n, m + 0.48::DOUBLE * n, m + 0.5::DOUBLE * n, (m * 10 + n * 2) / 12]) AS avg_size FROM c)
  SELECT m, n, schedule, {sql_rnd('avg_size')} AS avg_size, ceil(avg_size * 12 / 32)::BIGINT AS max_steps FROM a""")
def q_plan(spark, sf):
    rows = combine.combine_train(*_two_sets(spark, sf))
    return curriculum.plan_steps(rows, 12, 16, 2).withColumn("avg_size", rnd("avg_size"))


# --- prompts ------------------------------------------------------------------------------

_FEW = f"""{PER_QUERY},
  fs AS (SELECT * FROM o WHERE position <= 5),
  sh AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY position) AS place FROM fs),
  sk AS (SELECT * FROM sh WHERE place <= 2),
  fn AS (SELECT *, count(*) FILTER (label = 0) OVER (PARTITION BY query_id) AS n0, count(*) FILTER (label = 1) OVER (PARTITION BY query_id) AS n1 FROM sk),
  fx AS (SELECT query_id, doc_id, text, label, ((place - 1) * 2 + label + 1)::INT AS shot_pos FROM fn WHERE place <= least(n0, n1))"""


def _few(spark, sf):
    return prompts.few_shot_select(per_query_hits(spark, sf), 2)


@query("few_shot_select", f"{_FEW} SELECT query_id, doc_id, label, shot_pos FROM fx")
def q_few(spark, sf):
    return _few(spark, sf).select("query_id", "doc_id", "label", "shot_pos")


def _render_sql(template: str, examples: str, lang: str, key: str) -> str:
    first = f"substr(md5({key} || '-yn'), 1, 1) < '8'"
    p = "p"
    for a, b in (("{yn1}", f"CASE WHEN {first} THEN 'yes' ELSE 'no' END"), ("{yn2}", f"CASE WHEN {first} THEN 'no' ELSE 'yes' END"),
                 ("{language}", _lang_sql(labels.LANGUAGE_NAMES, lang)), ("{examples}", examples)):
        p = f"replace({p}, '{a}', {b})"
    return f"list_reduce(list_transform(string_split({template}, '{{text}}'), lambda p: {p}), lambda a, b: a || text || b)"


_TEMPLATE = sql_case("variant", prompts.TEMPLATES, "NULL")


# Target rows are dealt to the splits of a prompt run by a digest of their id.
_SPLIT_SQL = f"(['{prompts.SPLITS[0]}', '{prompts.SPLITS[1]}', '{prompts.SPLITS[2]}'])[1 + ascii(substr(md5(doc_id::VARCHAR), 1, 1)) % 3]"


def _targets(spark, sf):
    digit = F.ascii(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)) % 3
    return with_vectors(spark, sf).where(F.col("lang") == "es").withColumn(
        "split", F.element_at(F.array(*[F.lit(x) for x in prompts.SPLITS]), digit + 1))


@query("few_shot_render", f"""{_FEW},
  ex AS (SELECT query_id, string_agg('Comment: "' || text || E'\\t"Answer: ' || CASE WHEN label = 1 THEN 'yes' ELSE 'no' END, E'\\n' ORDER BY shot_pos) AS ex FROM fx GROUP BY query_id),
  rows_ AS (SELECT doc_id, lang, text, ex, unnest({prompts.FEW_SHOT}) AS variant FROM ({WITH_VECTORS}) l LEFT JOIN ex ON ex.query_id = l.doc_id
    WHERE lang = 'es')
  SELECT doc_id, variant, {_render_sql(_TEMPLATE, 'ex', 'lang', 'doc_id::VARCHAR')} AS prompt FROM rows_""")
def q_few_render(spark, sf):
    """A target row that got no examples stays, without a prompt."""
    examples = prompts.example_lists(_few(spark, sf)).withColumnRenamed("query_id", "doc_id")
    rows = prompts.attach_examples(_targets(spark, sf), examples, ["doc_id"], "keep")
    plan = prompts.prompt_plan(rows, "bloomz", prompts.FEW_SHOT)
    return plan.select("doc_id", "variant", prompts.render(
        F.col("variant"), F.col("text"), F.col("lang"), F.col("doc_id").cast("string"),
        prompts.format_examples("examples")).alias("prompt"))


@query("few_shot_batch", f"""{PER_QUERY.replace('rank <= 15', 'rank <= 60')},
  fs AS (SELECT * FROM o WHERE position <= 20),
  sh AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY position) AS place FROM fs),
  fn AS (SELECT *, count(*) FILTER (label = 0) OVER (PARTITION BY query_id) AS n0, count(*) FILTER (label = 1) OVER (PARTITION BY query_id) AS n1 FROM sh),
  fx AS (SELECT query_id, shots, text, label, (place - 1) * 2 + label + 1 AS shot_pos FROM fn, (SELECT unnest({prompts.SHOTS}) AS shots)
    WHERE place <= least(n0, n1, shots)),
  ex AS (SELECT query_id, shots, string_agg('Comment: "' || text || E'\\t"Answer: ' || CASE WHEN label = 1 THEN 'yes' ELSE 'no' END, E'\\n' ORDER BY shot_pos) AS ex FROM fx GROUP BY ALL),
  tgt AS (SELECT *, {_SPLIT_SQL} AS split, unnest({prompts.SHOTS}) AS shots FROM ({WITH_VECTORS}) WHERE lang = 'es'),
  rows_ AS (SELECT tgt.doc_id, split, lang, tgt.text, ex, tgt.shots, unnest({prompts.FEW_SHOT}) AS variant FROM tgt LEFT JOIN ex ON ex.query_id = tgt.doc_id AND ex.shots = tgt.shots)
  SELECT doc_id, split, variant, shots::INT AS shots, md5({_render_sql(_TEMPLATE, 'ex', 'lang', 'doc_id::VARCHAR')}) AS digest FROM rows_""")
def q_few_batch(spark, sf):
    """All splits, few-shot variants and shot numbers of the target rows from one retrieval."""
    chosen = prompts.few_shot_select(per_query_hits(spark, sf, k=20), prompts.SHOTS)
    examples = prompts.example_lists(chosen, ["query_id", "shots"]).withColumnRenamed("query_id", "doc_id")
    plan = prompts.few_shot_batch(_targets(spark, sf), examples, "bloomz", prompts.FEW_SHOT, prompts.SHOTS, "doc_id", missing="keep")
    return plan.select("doc_id", "split", "variant", "shots", F.md5(prompts.render(
        F.col("variant"), F.col("text"), F.col("lang"), F.col("doc_id").cast("string"),
        prompts.format_examples("examples"))).alias("digest"))


@query("prompt_zero_shot", f"""WITH r AS (SELECT doc_id, lang, text, unnest({prompts.ZERO_SHOT}) AS variant FROM ({LABELLED})),
  p AS (SELECT doc_id, variant, lang, {_render_sql(_TEMPLATE, "''", 'lang', 'doc_id::VARCHAR')} AS prompt FROM r)
  SELECT doc_id, variant, CASE WHEN contains(variant, 'cot') OR contains(variant, 'distinction') THEN 1024 ELSE 256 END AS max_length,
  md5('System: ' || {_lang_sql(labels.LANGUAGE_NAMES)} || E'\\nUser: ' || prompt || E'\\nAssistant:') AS digest FROM p""")
def q_zero(spark, sf):
    plan = prompts.prompt_plan(labelled(spark, sf).select("doc_id", "lang", "text"), "teuken-7b", prompts.ZERO_SHOT)
    prompt = prompts.render(F.col("variant"), F.col("text"), F.col("lang"), F.col("doc_id").cast("string"))
    return plan.select("doc_id", "variant", "max_length",
                       F.md5(prompts.chat_wrap(prompt, "teuken-7b", F.col("lang"))).alias("digest"))


@query("prompt_plan_pending", f"""WITH s AS (SELECT DISTINCT source FROM documents),
  p AS (SELECT source, variant, shots, round FROM s, (SELECT unnest({prompts.FEW_SHOT}) AS variant), (SELECT unnest({prompts.SHOTS}) AS shots), (SELECT unnest([0, 1]) AS round)),
  d AS (SELECT DISTINCT source, 'few_shot' AS variant, size::INT AS shots, 1 AS round FROM ({RUNS}) WHERE seed = 'rs1')
  SELECT source, variant, shots::INT AS shots, round::INT AS round, ((CASE WHEN contains(variant, 'cot') THEN 512 ELSE 256 END) * 2 *
    (CASE WHEN shots >= 5 THEN 2 ELSE 1 END) * (CASE WHEN shots >= 10 THEN 2 ELSE 1 END) * (CASE WHEN shots >= 25 THEN 2 ELSE 1 END) *
    (CASE WHEN shots >= 50 THEN 2 ELSE 1 END))::INT AS max_length
  FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = p.source AND d.variant = p.variant AND d.shots = p.shots AND d.round = p.round)""")
def q_pending(spark, sf):
    sources = table(spark, sf, "documents").select("source").distinct()
    plan = prompts.prompt_plan(sources, "mt0", prompts.FEW_SHOT, prompts.SHOTS, rounds=2)
    done = (runs(spark, sf).where(F.col("seed") == "rs1")
            .select("source", F.lit("few_shot").alias("variant"), F.col("size").cast("int").alias("shots"), F.lit(1).alias("round")))
    return prompts.pending(plan, done, ["source", "variant", "shots", "round"]).select(
        "source", "variant", "shots", "round", "max_length")
