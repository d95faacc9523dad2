import pytest
from pyspark.sql import functions as F

from fewlabel.functions import ordering as o
from fewlabel.functions.scaling import min_max, normalise_per_group
from fewlabel.operators import joins, reports, sampling, selection


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, some without a group."""
    return spark.range(6000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 60 == 0, None)
        .otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        (F.col("id") * 7919 % 1000).alias("v"))


def expected(df, key):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append(r)
    return {r.id: i + 1 for rows in groups.values() for i, r in enumerate(sorted(rows, key=key))}


def test_rank_in_group(skewed):
    got = {r.id: r["rank"] for r in o.rank_in_group(skewed, ["g"], ["v", "id"]).collect()}
    assert got == expected(skewed, lambda r: (r.v, r.id))


def test_rank_over_everything(skewed):
    got = [r["rank"] for r in o.rank_in_group(skewed, [], [F.desc("v"), F.col("id")]).orderBy(F.desc("v"), "id").collect()]
    assert got == list(range(1, 6001))


@pytest.mark.parametrize("plain_rows", [200_000, 400])
def test_hash_rank_is_exact_and_keeps_null_groups(skewed, monkeypatch, plain_rows):
    import hashlib
    monkeypatch.setattr(o, "PLAIN_GROUP_ROWS", plain_rows)
    want = expected(skewed, lambda r: hashlib.md5(f"{r.id}-1".encode()).hexdigest())
    got = {r.id: r["rank"] for r in o.hash_rank(skewed, ["g"], o.hash_key("id", seed="1"), None).collect()}
    assert got == want
    cut = {r.id: r["rank"] for r in o.hash_rank(skewed, ["g"], o.hash_key("id", seed="1"), 25).collect()}
    assert cut == {k: v for k, v in want.items() if v <= 25}


@pytest.mark.parametrize("n", [5, 1500])
def test_top_per_group(skewed, n):
    want = {k for k, v in expected(skewed, lambda r: (r.v, r.id)).items() if v <= n}
    assert {r.id for r in o.top_per_group(skewed, ["g"], ["v", "id"], n).collect()} == want


def test_small_limits_are_pruned_before_the_shuffle(skewed):
    plan = o.first_per_group(skewed, ["g"], ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") or plan.count("WindowGroupLimit") == 2


def test_lookup_splits_hot_keys(spark, skewed):
    left = skewed.where("g is not null")
    right = left.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    got = joins.lookup(left, right, ["g"], "n")
    assert got.count() == left.count()
    assert got.agg(F.countDistinct("id")).first()[0] == left.count()


def test_join_small_beyond_its_bound(skewed):
    sizes = skewed.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    a = joins.join_small(skewed, sizes, ["g"]).groupBy("g", "n").count().collect()
    b = joins.join_small(skewed, sizes, ["g"], max_rows=1)
    b = b.groupBy("g", "n").count().collect()
    assert sorted(a, key=str) == sorted(b, key=str)
    assert all(r.n == r["count"] for r in a)


def test_duplicate_audit_with_one_very_frequent_text(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(
        F.concat(F.lit("t"), (F.col("id") % 1000).cast("string"))).alias("text"))
    seen, want = set(), set()
    for r in df.orderBy("id").collect():
        (want.add(r.id) if r.text in seen else seen.add(r.text))
    assert {r.id for r in reports.duplicate_audit(df, "text", ["id"]).collect()} == want
    totals = reports.duplicate_totals(df, "text").first()
    assert (totals.n_texts, totals.n_distinct) == (3000, len(seen))


def test_min_max_guards(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("inf"), 5.0), (None, 5.0)], "a double, b double")
    rows = min_max(df, {"x": "a", "y": "b"}).collect()
    assert [r.x for r in rows] == [0.0, 1.0, 1.0, None]
    assert {r.y for r in rows} == {0.0}


def test_normalise_per_group_keeps_rows_without_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "g string, v double")
    rows = {(r.g, r.v): r for r in normalise_per_group(df, "g", ["v"]).collect()}
    assert len(rows) == 3 and abs(rows["a", 3.0].v_z - 1) < 1e-6 and abs(rows["a", 3.0].v_mm - 1) < 1e-6


def test_filters_and_missing_values(spark):
    df = spark.createDataFrame([("en",), (None,), ("es",)], "lang string")
    assert {r.lang for r in selection.exclude(df, "lang", ["es"]).collect()} == {"en", None}
    assert {r.lang for r in selection.include(df, "lang", ["es"]).collect()} == {"es"}


def test_dedup_stages_in_order(spark):
    rows = [(1, "d", 1, "x"), (2, "d", 1, "y"), (3, "d", 2, "x"), (4, "e", 1, "z"), (5, "e", 2, "y")]
    df = spark.createDataFrame(rows, "pos int, ds string, id int, text string")
    got = selection.dedup_two_stage(df, ["ds", "id"], "text", ["pos"])
    assert sorted(r.pos for r in got.collect()) == [1, 4, 5]


def test_balance_labels(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(20)], "pos int, label int")
    kept = selection.balance_labels(df, 7, ["pos"]).collect()
    assert sorted(r.pos for r in kept) == [0, 1, 2, 3, 4, 8]


def test_cap_and_rebalance(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("label"), F.lit("s").alias("ds"))
    assert selection.cap_rows(df, F.col("label") == 0, ["ds"], ["id"], 7).count() == 57
    out = selection.rebalance_classes(df, {"s": 9}, "id", "ds")
    assert out.where("label = 1").count() == 50 and out.where("label = 0").count() == 9


def test_splits_are_complete_and_samples_nested(spark):
    df = spark.range(500).select("id", F.lit("d_en").alias("ds"), F.lit("en").alias("lang"))
    counts = {r.split: r["count"] for r in
              sampling.split_train_dev_test(df, "id", "ds", 100, 30).groupBy("split").count().collect()}
    assert counts == {"test": 100, "dev": 30, "train": 370}
    curve = sampling.learning_curve(df, "id", "ds", [10, 50], 3)
    by = {}
    for r in curve.collect():
        by.setdefault((r.seed, r.n), set()).add(r.id)
    assert {k: len(v) for k, v in by.items()} == {(s, n): n for s in (1, 2, 3) for n in (10, 50)}
    assert all(by[s, 10] <= by[s, 50] for s in (1, 2, 3)) and by[1, 10] != by[2, 10]


def test_only_rows_with_a_wanted_key_are_shuffled(spark, sf_dir):
    """The texts of documents without a vector take no part in an exchange: the keys are broadcast first."""
    from fewlabel.operators.joins import only_keys
    from fewlabel.plans.tables import with_vectors
    wide = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (9, "e")], "doc_id long, text string")
    keys = spark.createDataFrame([(2,), (2,), (None,), (1,)], "doc_id long")
    assert sorted(r.text for r in only_keys(wide, keys, "doc_id").collect()) == ["a", "b", "c"]
    plan = with_vectors(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan
