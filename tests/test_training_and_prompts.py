import json
import math
import os

import pytest
from pyspark.sql import functions as F

from fewlabel.operators import classify, combine, curriculum, metrics, perplexity, prompts, reports, topics
from fewlabel.plans import models
from fewlabel.plans.tables import with_vectors
from fewlabel.sources import labelled, naming, tables


@pytest.fixture(scope="module")
def train(spark):
    rows = [(f"t{i}", 0, i % 2, 0.0, [1.0 + i % 2, 0.5]) for i in range(6)]
    rows += [(f"r{i}", 1, i % 2, i / 10, [1.2 + i % 2, 0.1]) for i in range(10)]
    return spark.createDataFrame(rows, "id string, source int, label int, score double, embedding array<double>")


# --- metrics ------------------------------------------------------------------------------

def test_metrics_with_invalid_answers(spark):
    pairs = [(1, 1), (1, 0), (0, 0), (0, -1), (1, 1), (0, 1)]
    m = metrics.classification_metrics(spark.createDataFrame(pairs, "label int, pred int")).first()
    f1_0, f1_1 = 2 * 1 / (3 + 2), 2 * 2 / (3 + 3)
    assert abs(m.accuracy - 0.5) < 1e-12
    assert abs(m.f1_macro - (f1_0 + f1_1 + 0) / 3) < 1e-12
    assert abs(m.f1_macro_valid - (f1_0 + f1_1) / 2) < 1e-12
    assert abs(m.precision_1 - 2 / 3) < 1e-12 and abs(m.recall_1 - 2 / 3) < 1e-12
    assert (m.support_1, m.n_invalid, m.n) == (3, 1, 6)
    c = metrics.confusion_counts(spark.createDataFrame(pairs, "label int, pred int")).first()
    assert tuple(c) == (2, 1, 1, 1)


def test_metrics_without_class_one(spark):
    m = metrics.classification_metrics(spark.createDataFrame([(0, 0)], "label int, pred int")).first()
    assert (m.f1_1, m.support_1, m.f1_macro) == (0.0, 0, 1.0)


def test_class_weights_and_fallback(spark):
    one = spark.createDataFrame([(1,)] * 4, "label int")
    two = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    w = {r.label: r.weight for r in metrics.class_weights(two).collect()}
    assert w == {0: 4 / 6, 1: 2.0}
    assert {r.label: r.weight for r in metrics.class_weights(one, two).collect()} == w
    assert {r.label: r.weight for r in metrics.class_weights(two, one).collect()} == w


# --- curriculum ---------------------------------------------------------------------------

def test_ratios():
    assert [curriculum.ratio("linear", e, 5) for e in range(5)] == [0, .25, .5, .75, 1]
    assert abs(curriculum.ratio("exponential", 4, 5) - (1 - math.exp(-3))) < 1e-12
    assert [curriculum.ratio("stepwise", e, 11) for e in (1, 3, 4, 5, 7, 10)] == [0, .3, .3, .6, 1, 1]
    assert [curriculum.ratio("strict", e, 9) for e in (5, 6)] == [0, 1]
    assert [curriculum.ratio("strict", e, 6) for e in (3, 4)] == [0, 1]
    assert [curriculum.ratio("strict_separate", e, 15) for e in (9, 10)] == [0, 1]
    with pytest.raises(ValueError):
        curriculum.ratio("other", 1, 5)


def test_slices(train):
    got = curriculum.slices(train, 5, "linear").groupBy("epoch", "source").count().collect()
    sizes = {(r.epoch, r.source): r["count"] for r in got}
    assert sizes == {**{(e, 0): 6 for e in range(5)}, (1, 1): 2, (2, 1): 5, (3, 1): 7, (4, 1): 10}
    first = curriculum.slices(train, 5, "linear", ascending=False).where("epoch = 1 and source = 1")
    assert {r.id for r in first.collect()} == {"r9", "r8"}
    late = curriculum.slices(train, 12, "strict_separate").where("epoch >= 10")
    assert {r.source for r in late.collect()} == {1}


def test_plan(train):
    steps = {r.schedule: r.max_steps for r in curriculum.plan_steps(train, 12, 4, 1).collect()}
    assert steps["linear"] == math.ceil((6 + 5) * 12 / 4)
    assert steps["strict_separate"] == math.ceil((6 * 10 + 10 * 2) / 12 * 12 / 4)


# --- unions and weights -------------------------------------------------------------------

def test_combine_repeats_target_only(spark):
    t = spark.createDataFrame([("1", "a", 1, "es")], "id string, text string, label int, language string")
    r = spark.createDataFrame([(5, "b", 0, 0.3, "en")], "id long, text string, label long, score float, language string")
    out = combine.combine_train(t, r, 3)
    assert out.where("source = 0").count() == 3 and out.where("source = 1").first().id == "5"
    assert dict(out.dtypes)["label"] == "int"


def test_source_weights_match_the_two_means(train):
    w = classify.source_weights(train, 0.4).groupBy("source").agg(F.sum("weight").alias("w")).collect()
    assert {r.source: round(r.w, 9) for r in w} == {0: 1.0, 1: 0.4}


def test_curriculum_weight_counts_epochs(train):
    w = {r.id: r.weight for r in classify.curriculum_weights(train, 5, "linear").collect()}
    assert w["t0"] == 5 and w["r0"] == 4 and w["r9"] == 1


def test_fit_separates(train):
    scored = classify.score(classify.train_weighted(train, reg=0.0), train)
    assert scored.where("pred <> label").count() == 0


# --- prompts ------------------------------------------------------------------------------

def rendered(spark, variant, text, lang="es", examples=None):
    df = spark.createDataFrame([(variant, text, lang)], "v string, t string, l string")
    return df.select(prompts.render(F.col("v"), F.col("t"), F.col("l"), F.lit("k"),
                                    F.lit(examples) if examples is not None else None).alias("p")).first().p


def test_user_text_is_never_expanded(spark):
    out = rendered(spark, "few_shot_multilingual", "{language} {examples} {yn1}", examples="{text} {yn2}")
    assert "{language} {examples} {yn1}" in out and "{text} {yn2}" in out and "Spanish" in out


def test_few_shot_needs_examples(spark):
    with pytest.raises(Exception, match="need examples"):
        rendered(spark, "few_shot", "x")
    with pytest.raises(Exception, match="need examples"):
        rendered(spark, "few_shot", "x", examples="")
    assert "yes" in rendered(spark, "general", "x")


def test_few_shot_select_interleaves(spark):
    rows = [(1, i, int(i in (2, 5, 6)), f"t{i}") for i in range(1, 8)] + [(2, 1, 0, "u")]
    df = spark.createDataFrame(rows, "query_id long, position int, label int, text string")
    got = prompts.few_shot_select(df, 2).orderBy("shot_pos").collect()
    assert [(r.position, r.label) for r in got] == [(1, 0), (2, 1), (3, 0), (5, 1)]
    lists = prompts.example_lists(prompts.few_shot_select(df, 2)).select(prompts.format_examples("examples").alias("e"))
    assert lists.first().e.split("\n")[1] == 'Comment: "t2\t"Answer: yes'


def test_few_shot_numbers_share_one_ranking(spark):
    df = spark.createDataFrame([(1, i, i % 2, f"t{i}") for i in range(9)], "query_id long, position int, label int, text string")
    grid = prompts.few_shot_select(df, [1, 3, 10])
    for n in (1, 3, 10):
        one = {(r.position, r.shot_pos) for r in prompts.few_shot_select(df, n).collect()}
        assert {(r.position, r.shot_pos) for r in grid.where(F.col("shots") == n).collect()} == one
        assert len(one) == 2 * min(n, 4)


def test_chat_format_prefers_the_longest_key():
    assert prompts.chat_format("Gemma9-it").startswith("<start_of_turn>")
    assert prompts.chat_format("x-llama3-abliterated") == prompts.CHAT_FORMATS["llama3-abliterated"]
    with pytest.raises(ValueError):
        prompts.chat_format("unknown")


def test_budget(spark):
    df = spark.createDataFrame([("cot", 1), ("few_shot", 10), ("few_shot_cot", 50), ("distinction", 1)], "v string, s int")
    zero = [r.b for r in df.select(prompts.length_budget(F.col("v")).alias("b")).collect()]
    few = [r.b for r in df.select(prompts.length_budget(F.col("v"), F.col("s")).alias("b")).collect()]
    assert zero == [1024, 256, 1024, 1024] and few[1:3] == [256 * 8, 512 * 32]


# --- perplexity, topics -------------------------------------------------------------------

def test_perplexity_by_hand(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a a"), (3, "  "), (4, None)], "id long, text string")
    got = {r.id: r.perplexity for r in perplexity.perplexity(df, "id", "text").collect()}
    # vocabulary {a, b}; <s> a twice, a b once, a a once
    assert abs(got[1] - math.exp(-(math.log(3 / 4) + math.log(2 / 4)) / 2)) < 1e-12
    assert got[3] == got[4] == float("inf")


def test_perplexity_with_a_model_too_large_to_broadcast(spark, monkeypatch):
    from fewlabel.operators import joins
    df = spark.range(300).select("id", F.concat(F.lit("the cat "), (F.col("id") % 7).cast("string")).alias("text"))
    small = sorted(map(tuple, perplexity.perplexity(df, "id", "text").collect()))
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 0)
    large = sorted(map(tuple, perplexity.perplexity(df, "id", "text").collect()))
    assert [i for i, _ in small] == [i for i, _ in large]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(small, large))


def test_perplexity_counts_across_packs_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(perplexity, "PACK_WORDS", 7)
    monkeypatch.setattr(perplexity, "BUCKET_WORDS", 5)
    texts = [" ".join(f"w{(i * j + j * j) % 9}" for j in range(1 + i % 11)) for i in range(60)] + ["<s> w1 <s>", "", None, "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    pairs = [list(zip(["<s>", *t.split()], t.split())) if t else [] for t in texts]
    c, first, vocabulary = {}, {}, {w for t in pairs for _, w in t}
    for p in (p for t in pairs for p in t):
        c[p], first[p[0]] = c.get(p, 0) + 1, first.get(p[0], 0) + 1
    got = {r.id: r.perplexity for r in perplexity.perplexity(df, "id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(pairs):
        want = math.exp(-sum(math.log((c[p] + 1) / (first[p[0]] + len(vocabulary))) for p in t) / len(t)) if t else math.inf
        assert got[i] == want or abs(got[i] - want) < 1e-9
    unnamed = df.withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    assert {r.id: r.perplexity for r in perplexity.perplexity(unnamed, "id", "text").collect()} == {**{i: p for i, p in got.items() if i != 7}, None: math.inf}
    empty = perplexity.perplexity(df.limit(0), "id", "text")
    assert empty.count() == 0


def test_window_counts_by_brute_force(spark):
    texts = ["a b c a d", "b b", "c", "a x x x b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.word_a, r.word_b): r.n for r in topics.window_counts(df, {"a", "b"}, window=3).collect()}
    want = {}
    for t in texts:
        seq = t.split()
        for s in range(max(1, len(seq) - 2)):
            inside = set(seq[s:s + 3]) & {"a", "b"}
            for pair in [("", "")] + [(x, y) for x in inside for y in inside if x <= y]:
                want[pair] = want.get(pair, 0) + 1
    assert got == want


def test_choose_topic_count(spark):
    rows = [(i, " ".join(f"{'cat' if i % 2 else 'sea'}{(i + j) % 5}" for j in range(12))) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    out = topics.choose_topic_count(df, low=2, high=4, step=2, iterations=2).collect()
    assert sorted(r.n_topics for r in out) == [2, 4] and sum(r.best for r in out) == 1


# --- files --------------------------------------------------------------------------------

def test_csv_reader_details(spark, tmp_path):
    (tmp_path / "a_en.csv").write_text('text,label,more\n"one, ""q""\nline", "1",x\nonly\n"two",0\n', encoding="utf-8")
    rows = labelled.read_labelled_csv(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.dataset_name, r.id, r.text, r.label) for r in rows] == [
        ("a_en", "0", 'one, "q"\nline', 1), ("a_en", "1", "two", 0)]


def test_rows_count_by_their_fields(spark, tmp_path):
    """Two fields make a row, whatever they hold."""
    lines = ['a,1', 'b,', '"c",', '"d, e"', '"f, ""g"" h",,x', 'i,hate', '', ',0', 'j', 'k,,', '"l\nm",2', '"n\n, o"', 'p, 1.0 ,']
    (tmp_path / "a.csv").write_text("text,label\n" + "\n".join(lines) + "\n", encoding="utf-8")
    rows = labelled.read_labelled_csv(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.text, r.label) for r in rows] == [
        ("a", 1), ("b", None), ("c", None), ('f, "g" h', None), ("i", None), ("", 0), ("k", None), ("l\nm", 2), ("p", 1)]
    assert [r.id for r in rows] == [str(i) for i in range(len(rows))]


def test_raw_folder(spark, tmp_path):
    (tmp_path / "x.csv").write_text("text,label\nhello,1\na,b,c\n")
    (tmp_path / "y.tsv").write_text("text\tlabel\nbye\t0\n")
    rows = labelled.read_raw_folder(spark, str(tmp_path), "text string, label int").collect()
    assert {(r.dataset_name, r.text, r.label) for r in rows} == {("x", "hello", 1), ("y", "bye", 0)}


def test_metric_tree_of_plain_folders(spark, tmp_path):
    for model, ds, size, seed, f1 in [("m", "bas19_es", 10, "rs1", .5), ("m", "bas19_es", 10, "rs2", .7),
                                      ("m", "bas19_es", 10, "rs3", .6), ("m", "bas19_es", 20, "rs1", .9)]:
        d = tmp_path / model / ds / str(size) / seed
        (d / "checkpoint-5").mkdir(parents=True)
        for folder in (d, d / "checkpoint-5"):
            (folder / "evaluation_results.json").write_text(json.dumps({"eval_f1-macro": f1}, indent=4))
        (d / "other.json").write_text(json.dumps({"eval_f1-macro": 0}))
    root = str(tmp_path)
    runs = tables.scan_runs(spark, root, "`eval_f1-macro` double, `test_f1-macro` double", ["model", "dataset", "size", "seed"],
                            pattern=r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)/evaluation_results\.json$",
                            files="evaluation_results.json", multi_line=True)
    assert runs.count() == 4
    avg = reports.seed_average(runs.withColumn("f1", reports.pick_metric("`eval_f1-macro`", "`test_f1-macro`")), ["dataset", "size"], "f1")
    assert {(r["size"], r.score) for r in avg.collect()} == {("10", 60.0), ("20", None)}
    out = os.path.join(root, "report")
    tables.save_matrix(reports.matrix(avg, ["dataset"], "size", ["10", "20"]), out)
    text = [open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv")]
    assert text == ["dataset\t10\t20\nbas19_es\t60.0\tNone\n"]


def test_dataset_names(spark):
    df = spark.createDataFrame([("bas19_es-20-rs3",), ("dyn21_en",), ("bas19_es-3000-rs1",), ("dyn21_en-3000-rs1",)], "name string")
    rows = {r.name: r for r in naming.resolve(df).collect()}
    assert (rows["bas19_es-20-rs3"].source, rows["bas19_es-20-rs3"]["size"], rows["bas19_es-20-rs3"].seed) == ("bas19_es", "20", "rs3")
    assert (rows["dyn21_en"].train_size, rows["dyn21_en"].test_size, rows["dyn21_en"].dev_size) == (38644, 2000, 500)
    assert not naming.resolve(spark.createDataFrame([("other_en",)], "name string")).first().valid
    assert rows["dyn21_en"]["size"] == "full" and not rows["bas19_es-3000-rs1"].valid and rows["dyn21_en-3000-rs1"].valid
    with pytest.raises(ValueError):
        naming.select_dataset(df, "bas19_es-3000-rs1")


def test_subset_names(spark):
    df = spark.createDataFrame([("a/b",), ("c",)], "name string")
    parts = naming.split_subset("name")
    assert [tuple(r) for r in df.select(parts["collection"], parts["subset"]).collect()] == [("a", "b"), ("c", None)]


def test_pool_filters_prune_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "en", "a", [1.0]), (2, "es", "b", [2.0])], "id long, lang string, source string, embedding array<float>")
    tables.save_pool(rows, str(tmp_path / "pool"), files_per_key=2)
    pool = tables.load_pool(spark, str(tmp_path / "pool"))
    from fewlabel.operators.retrieve import filtered_pool
    kept = filtered_pool(pool, exclude_languages=["es"])
    assert [r.id for r in kept.collect()] == [1]
    assert "PartitionFilters: [" in kept._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: []", "")


def test_rows_without_examples_are_never_dropped(spark):
    from fewlabel.operators import prompts
    rows = spark.createDataFrame([(1,), (2,)], "doc_id long")
    examples = spark.createDataFrame([(1, [(1, "a", 0)])], "doc_id long, examples array<struct<shot_pos:int,text:string,label:int>>")
    kept = prompts.attach_examples(rows, examples, ["doc_id"], missing="keep").withColumn("e", prompts.format_examples("examples"))
    assert sorted((r.doc_id, r.e) for r in kept.collect()) == [(1, 'Comment: "a\t"Answer: no'), (2, None)]
    with pytest.raises(Exception, match="no examples for 2"):
        prompts.attach_examples(rows, examples, ["doc_id"]).collect()


def test_signals_for_every_labelled_row(spark, sf_dir):
    rows = models.q_uncertainty(spark, sf_dir)
    ids = {r.doc_id for r in with_vectors(spark, sf_dir).select("doc_id").collect()}
    got = {r.doc_id: r.held_out for r in rows.collect()}
    assert set(got) == ids and 0 < sum(got.values()) < len(got)


def test_pool_batches_are_repeatable(spark, tmp_path):
    from fewlabel.sources import tables
    path = str(tmp_path / "pool")

    def write(batch, rows):
        tables.save_pool_batch(spark.createDataFrame(rows, "id long, lang string, source string"), path, batch, "id", files_per_key=2)
        return sorted((r["batch"], str(r["id"]), r["lang"]) for r in tables.load_pool(spark, path).collect())

    one, two = [(1, "en", "x"), (2, "de", "x"), (None, "en", "x")], [(2, "de", "x"), (3, "en", "y"), (None, "en", "x")]
    a = [("a", "1", "en"), ("a", "2", "de"), ("a", "None", "en")]
    b = [("b", "3", "en"), ("b", "None", "en")]
    assert write("a", one) == write("a", one) == a
    assert write("b", two) == write("b", two) == write("a", one) == a + b
    assert write("a", one[:1]) == a[:1] + b  # the folder of a language that is gone goes as well
    assert write("b", []) == a[:1]
    assert write("b", two) == sorted(a[:1] + [("b", "2", "de")] + b)
    for bad in ("", "a/b", "a=b"):
        with pytest.raises(ValueError):
            write(bad, one)
