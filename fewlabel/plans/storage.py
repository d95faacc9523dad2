"""Queries that write files to the shared folder and scan them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fewlabel.operators.knn import knn_join
from fewlabel.operators import reports
from fewlabel.operators.sampling import learning_curve, split_train_dev_test
from fewlabel.plans.registry import query, rnd, sql_rnd
from fewlabel.plans.retrieval import PER_QUERY, per_query_hits
from fewlabel.plans.tables import (
    LABELLED, PREDICTIONS, RUNS, WITH_VECTORS, labelled, predictions, runs, table, target_queries, with_vectors)
from fewlabel.session import durable, scratch_path
from fewlabel.sources import labelled as lab
from fewlabel.sources import naming, tables as st


@query("ingest_csv", f"""SELECT 'my set+' || source || '%' AS dataset_name, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::VARCHAR AS id,
  CASE WHEN n_chars < 700 THEN '' ELSE text END AS text, label FROM ({LABELLED})""")
def ingest_csv(spark, sf):
    path = scratch_path(spark, "csv")
    name = F.concat(F.lit("my set+"), "source", F.lit("%"))
    rows = labelled(spark, sf).select("doc_id", F.when(F.col("n_chars") < 700, "").otherwise(F.col("text")).alias("text"), "label", name.alias("dataset"))
    lab.write_labelled(rows, path, ["doc_id"])
    return lab.read_labelled_csv(spark, path).select("dataset_name", "id", "text", "label")


_PARALLEL = """SELECT lang AS language, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS row_idx, text FROM documents"""


@query("ingest_tsv_parallel", f"""WITH p AS ({_PARALLEL}) SELECT a.source, a.row_idx, a.text AS text_a, b.text AS text_b
  FROM p a JOIN p b USING (source, row_idx) WHERE a.language = 'en' AND b.language = 'de'""")
def ingest_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    rows = table(spark, sf, "documents").select("doc_id", "text", F.lit(0).alias("label"), F.col("lang").alias("language"), "source")
    lab.write_labelled(rows, path, ["doc_id"], ["language", "source"], sep="\t")
    return lab.align_parallel(lab.read_parallel_tsv(spark, path), "en", "de")


@query("functional_scan", f"SELECT doc_id::VARCHAR AS id, text, label, lang AS language FROM ({LABELLED}) WHERE lang NOT IN ('tr', 'en')")
def functional_scan(spark, sf):
    path = scratch_path(spark, "functional")
    rows = labelled(spark, sf).select(F.col("doc_id").alias("id"), F.lit("x").alias("skipped"), "text", "label",
                                      F.col("lang").alias("language"), "n_chars")
    lab.write_labelled(rows, path, ["n_chars"], ["language"])
    return lab.read_functional_tests(spark, path).select("id", "text", "label", "language")


_COUNTRY = {"es": "Spanish", "de": "Germany", "en": "English", "fr": "French"}


@query("country_slice", f"""WITH x AS (SELECT doc_id, lang AS language, text, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label FROM ({LABELLED})
    WHERE NOT (quality = 0 AND label = 0)),
  r AS (SELECT *, row_number() OVER (PARTITION BY language, label ORDER BY doc_id) AS p FROM x)
  SELECT language, doc_id::VARCHAR AS id, text, label FROM r WHERE label = 1 OR p <= 60""")
def q_country(spark, sf):
    """Labels 1 and 2 come from the table; label 3 is a code the scan drops."""
    path = scratch_path(spark, "country")
    table_ = F.create_map(*[F.lit(x) for kv in _COUNTRY.items() for x in kv])
    code = F.when(F.col("label") == 1, 2).when(F.col("quality") == 1, 1).otherwise(3)
    rows = labelled(spark, sf).select(F.col("doc_id").alias("row"), F.col("doc_id").alias("id"), "text", code.alias("label"),
                                      F.lit("x").alias("skipped"), table_[F.col("lang")].alias("country"), F.lit("all").alias("part"))
    (rows.repartitionByRange("row").sortWithinPartitions("row").drop("row", "part")
     .write.options(header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False,
                    ignoreTrailingWhiteSpace=False).csv(path))
    return lab.read_country_slice(spark, path, cap=60)


@query("raw_multi_format", f"SELECT source AS dataset_name, text, label::VARCHAR AS label FROM ({LABELLED})")
def raw_multi_format(spark, sf):
    """A folder with .csv and .tsv files side by side."""
    path = scratch_path(spark, "raw")
    rows = labelled(spark, sf).select("doc_id", "text", "label", "lang", F.col("source").alias("dataset"))
    lab.write_labelled(rows.where(F.col("lang") != "en").drop("lang"), path + "/a", ["doc_id"])
    tab = rows.where(F.col("lang") == "en").drop("lang", "doc_id")
    # Spark's text writer names its files .csv unless told otherwise
    (tab.write.partitionBy("dataset").options(header=True, sep="\t", quote='"', escape='"', quoteAll=True, extension="tsv",
                                              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path + "/b"))
    return lab.read_raw_folder(spark, path, "text string, label string").select("dataset_name", "text", "label")


_SOURCES = {"src0_en": {"train": 4000}, "src1_en": {"train": 900, "test": 700}, "src2_de": {"train": 3000, "dev": 100},
            "src3_fr": {"train": 20}, "src5_es": {"train": 50, "test": 60, "dev": 70}}


def _size_sql(split: str) -> str:
    default = {"test": 2000, "dev": 500}.get(split)
    whens = " ".join(f"WHEN '{k}' THEN {v.get(split, default)}" for k, v in _SOURCES.items())
    return f"(CASE source {whens} END)::INT AS {split}_size"


@query("resolve_dataset_name", f"""WITH n AS (SELECT source || '_' || lang || CASE WHEN n_chars < 1000 THEN '' ELSE '-' || n_chars::VARCHAR || '-rs1' END AS name FROM documents),
  p AS (SELECT name, string_split(name, '-')[1] AS source, string_split(string_split(name, '-')[1], '_')[-1] AS language,
  coalesce(string_split(name, '-')[2], 'full') AS size, coalesce(string_split(name, '-')[3], 'full') AS seed FROM n)
  SELECT *, source IN ({', '.join(f"'{k}'" for k in _SOURCES)}) AND (language = 'en' OR size = 'full' OR try_cast(size AS INT) <= 2000) AS valid,
    {_size_sql('train')}, {_size_sql('test')}, {_size_sql('dev')} FROM p""")
def q_resolve(spark, sf):
    suffix = F.when(F.col("n_chars") < 1000, "").otherwise(F.concat(F.lit("-"), F.col("n_chars").cast("string"), F.lit("-rs1")))
    names = table(spark, sf, "documents").select(F.concat("source", F.lit("_"), "lang", suffix).alias("name"))
    return naming.resolve(names, catalogue=_SOURCES).select("name", "source", "language", "size", "seed", "valid",
                                                            "train_size", "test_size", "dev_size")


@query("split_table_roundtrip", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '-123')) AS p FROM documents)
  SELECT doc_id, CASE WHEN p <= 10 THEN 'test' WHEN p <= 15 THEN 'dev' ELSE 'train' END AS split FROM r WHERE source = 'src5'""")
def split_table(spark, sf):
    """Splits saved as one partitioned table; a dataset name prunes its folders."""
    path = scratch_path(spark, "splits")
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset_name"), "lang")
    split = split_train_dev_test(rows, "doc_id", "dataset_name", 10, 5)
    st.save_splits(split.withColumn("n", F.lit("full")).withColumn("rs", F.lit("full")), path)
    return naming.select_dataset(spark.read.parquet(path), "src5").select("doc_id", "split")


@query("split_grid_roundtrip", """WITH r AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS total,
    row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '-2-curve')) AS p FROM documents)
  SELECT doc_id, 'train' AS split FROM r WHERE source = 'src5' AND p <= 5 AND 5 < total""")
def split_grid(spark, sf):
    """Training samples by size and seed saved as one table; a name with both reads one of its folders."""
    path = scratch_path(spark, "split-grid")
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset_name"), "lang")
    drawn = learning_curve(rows, "doc_id", "dataset_name", [5, 20], 3)
    st.save_splits(drawn.select("doc_id", "dataset_name", F.lit("train").alias("split"), F.col("n").cast("string").alias("n"),
                                F.concat(F.lit("rs"), F.col("seed").cast("string")).alias("rs")), path)
    found = spark.read.schema("doc_id long, dataset_name string, split string, n string, rs string").parquet(path)
    return naming.select_dataset(found, "src5-5-rs2").select("doc_id", "split")


@query("report_sink", f"""WITH a AS (SELECT source, size, CASE WHEN count(f1_macro) >= 3 THEN round_even(avg(f1_macro) * 100, 2) END AS s
    FROM ({RUNS}) GROUP BY source, size)
  SELECT source, coalesce(max(s) FILTER (size = '10')::VARCHAR, 'None') AS n_10, coalesce(max(s) FILTER (size = '100')::VARCHAR, 'None') AS n_100,
  coalesce(max(s) FILTER (size = '5000')::VARCHAR, 'None') AS n_5000 FROM a GROUP BY source""")
def report_sink(spark, sf):
    """A report matrix written as tab-separated text and read back as it stands."""
    path = scratch_path(spark, "report")
    averages = reports.seed_average(runs(spark, sf), ["source", "size"], "f1_macro")
    st.save_matrix(reports.matrix(averages, ["source"], "size", ["10", "100", "5000"], prefix="n_"), path)
    return spark.read.schema("source string, n_10 string, n_100 string, n_5000 string").options(header=True, sep="\t").csv(path)


@query("pool_roundtrip", f"SELECT doc_id, lang, source, label, {sql_rnd('list_sum(v)')} AS total FROM ({WITH_VECTORS}) WHERE lang <> 'en'")
def pool_roundtrip(spark, sf):
    from fewlabel.functions.vectors import as_double, total
    path = scratch_path(spark, "pool")
    st.save_pool(with_vectors(spark, sf).select("doc_id", "text", "label", "embedding", "lang", "source"), path)
    pool = st.load_pool(spark, path).where(F.col("lang") != "en")
    return pool.select("doc_id", "lang", "source", "label", rnd(total(as_double("embedding"))).alias("total"))


@query("pool_batches", f"""SELECT doc_id, CASE WHEN lang <> 'es' THEN 'a' ELSE 'b' END AS batch, lang, source, label
  FROM ({WITH_VECTORS}) WHERE lang <> 'es' OR label = 1""")
def pool_batches(spark, sf):
    """Two batches that share English rows, the second written twice and changed in between, the first once more."""
    path = scratch_path(spark, "batches")
    x = durable(with_vectors(spark, sf).select("doc_id", "text", "label", "embedding", "lang", "source"), "pool-rows")
    first, both = x.where("lang <> 'es'"), x.where("lang IN ('es', 'en')")
    for name, rows in (("a", first), ("b", both), ("b", both.where("lang = 'en' OR label = 1")), ("a", first)):
        st.save_pool_batch(rows, path, name, "doc_id")
    return st.load_pool(spark, path).select("doc_id", "batch", "lang", "source", "label")


@query("hit_lookup", f"""WITH x AS ({WITH_VECTORS}), p AS (SELECT q.doc_id AS query_id, p.doc_id, p.text,
    row_number() OVER (PARTITION BY q.doc_id ORDER BY list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.v, p.v)]), p.doc_id) AS rank FROM x q, x p WHERE q.lang = 'es')
  SELECT query_id, doc_id, md5(text) AS digest FROM p WHERE rank <= 3""")
def hit_lookup(spark, sf):
    x = with_vectors(spark, sf)
    hits = knn_join(target_queries(x), x, 3, pool_id="doc_id")
    return st.lookup_rows(hits, x, "doc_id", ["text"]).select("query_id", "doc_id", F.md5("text").alias("digest"))


@query("retrieved_sink", f"""{PER_QUERY} SELECT query_id, count(*) AS n, sum(position)::BIGINT AS positions, {sql_rnd('sum(score)')} AS score
  FROM o WHERE position <= 5 GROUP BY query_id""")
def retrieved_sink(spark, sf):
    """One JSON object per query with its ordered rows, read back."""
    path = scratch_path(spark, "retrieved")
    rows = per_query_hits(spark, sf).select("query_id", F.col("position").cast("int").alias("position"), "doc_id", "label", "score", "text")
    st.save_retrieved(rows, path, per_query=True)
    back = spark.read.schema("query_id long, retrieved array<struct<position:int,doc_id:long,label:int,score:double,text:string>>").json(path)
    return (back.select("query_id", F.inline("retrieved")).groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("position").alias("positions"), rnd(F.sum("score")).alias("score")))


@query("metric_tree_scan", f"SELECT 'org/' || source || ':1 a+b 100%' AS source, size, seed, {sql_rnd('f1_macro')} AS f1_macro FROM ({RUNS})")
def metric_tree_scan(spark, sf):
    path = scratch_path(spark, "runs")
    name = F.concat(F.lit("org/"), "source", F.lit(":1 a+b 100%"))
    st.save_runs(runs(spark, sf).select(name.alias("source"), "size", "seed", F.col("f1_macro").alias("eval_f1_macro")), path,
                 ["source", "size", "seed"])
    found = st.scan_runs(spark, path, "eval_f1_macro double, test_f1_macro double", ["source", "size", "seed"])
    return found.select("source", "size", "seed", rnd(F.coalesce("eval_f1_macro", "test_f1_macro")).alias("f1_macro"))


@query("prediction_sink", f"SELECT doc_id::VARCHAR AS id, md5(text) AS digest, pred AS predicted, label AS \"true\" FROM ({PREDICTIONS})")
def prediction_sink(spark, sf):
    path = scratch_path(spark, "predictions")
    st.save_predictions(predictions(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("text").alias("raw"), F.col("pred").alias("predicted"), F.col("label").alias("true")), path)
    return st.load_predictions(spark, path).select("id", F.md5("raw").alias("digest"), "predicted", "true")


@query("prediction_values", f"SELECT DISTINCT pred FROM ({PREDICTIONS})")
def q_prediction_values(spark, sf):
    return st.prediction_values(predictions(spark, sf), "pred")
