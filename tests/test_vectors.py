import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fewlabel.operators import alignment, diversity, knn, retrieve


def frame(spark, x, key, vec):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], f"{key} long, {vec} array<float>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    pool = rng.normal(size=(400, 8)).astype(np.float32)
    pool[300:] = pool[7]  # a quarter of the pool are copies of one vector
    return rng.normal(size=(30, 8)).astype(np.float32), pool


def brute(q, p, metric, k):
    q, p = q.astype(float), p.astype(float)
    if metric == "l2":
        d = ((q[:, None] - p[None]) ** 2).sum(-1)
    else:
        d = -(q @ p.T)
        if metric == "cosine":
            d /= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(p, axis=1)[None]
    d = np.round(d, 9)
    return {i: sorted(range(len(p)), key=lambda j: (d[i, j], j))[:k] for i in range(len(q))}


def hits_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    return {q: [m[i] for i in sorted(m)] for q, m in out.items()}


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("k", [5, 500])
def test_knn_against_brute_force(spark, vectors, metric, k):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding").repartition(5)
    assert hits_of(knn.knn_join(queries, pool, k, metric=metric)) == brute(q, p, metric, k)


def test_many_query_blocks_equal_one(spark, vectors, monkeypatch):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding")
    monkeypatch.setattr(knn, "QUERY_BLOCK_ROWS", 14)
    assert hits_of(knn.knn_join(queries, pool, 4)) == brute(q, p, "l2", 4)


def test_string_keys_and_carried_columns(spark, vectors):
    q, p = vectors
    queries = frame(spark, q, "query_id", "query_vec").withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    pool = frame(spark, p, "vec_id", "embedding").withColumn("vec_id", F.format_string("%04d", "vec_id")).withColumn("lang", F.lit("x"))
    got = hits_of(knn.knn_join(queries, pool, 3, carry=["lang"]))
    assert got == {f"q{i}": [f"{j:04d}" for j in v] for i, v in brute(q, p, "l2", 3).items()}


def test_rows_without_a_vector_are_left_out(spark, vectors):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding")
    holes = pool.withColumn("embedding", F.when(F.col("vec_id") % 2 == 0, F.col("embedding")))
    got = hits_of(knn.knn_join(queries, holes, 3))
    want = {i: [2 * j for j in v] for i, v in brute(q, p[::2], "l2", 3).items()}
    assert got == want


def test_empty_sides(spark, vectors):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding")
    assert knn.knn_join(queries.where("false"), pool, 3).count() == 0
    assert knn.knn_join(queries, pool.where("false"), 3).count() == 0


def test_cell_join_probing_everything_is_exact(spark, vectors):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding").repartition(3)
    model = knn.fit_cells(pool, 6)
    assert hits_of(knn.cell_join(queries, pool, 5, model, n_probe=6)) == brute(q, p, "l2", 5)
    stored = knn.assign_cells(pool, model)
    assert hits_of(knn.cell_join(queries, stored, 5, model, n_probe=6)) == brute(q, p, "l2", 5)


def test_hash_join_finds_most_neighbours(spark, vectors):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding")
    exact = knn.knn_join(queries, pool, 5)
    row = knn.recall(knn.hash_join(queries, pool, 5, bucket_length=2.0, tables=6), exact, "query_id", "vec_id").first()
    assert row.exact_hits == 150 and row.recall > 0.8


def test_hash_codes_probe_the_closest_borders(spark):
    planes = np.eye(2).reshape(1, 2, 2)
    rows = frame(spark, np.array([[0.1, 0.7], [-0.2, 1.95]]), "id", "v")
    coded = {r["id"]: r["codes"] for r in knn.hash_codes(rows, "v", planes, 1.0, probes=3).collect()}
    assert list(coded.values()) == [["0:[0, 0]", "0:[-1, 0]", "0:[0, 1]", "0:[0, -1]"], ["0:[-1, 1]", "0:[-1, 2]", "0:[0, 1]", "0:[-2, 1]"]]


def test_more_probes_find_more(spark, vectors):
    q, p = vectors
    queries, pool = frame(spark, q, "query_id", "query_vec"), frame(spark, p, "vec_id", "embedding")
    exact = knn.knn_join(queries, pool, 5)
    got = [knn.recall(knn.hash_join(queries, pool, 5, bucket_length=1.0, tables=4, parts=2, probes=n), exact, "query_id", "vec_id").first().recall
           for n in (0, 4, 16)]
    assert got[0] < got[1] < got[2]
    assert knn.hash_join(queries, pool.limit(0), 5).count() == 0


# --- diversity ----------------------------------------------------------------------------

def full_matrix_mmr(v, rel, threshold, keep, lam):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    picked = [int(np.argmax(rel))]
    while len(picked) < len(rel):
        rest = [i for i in range(len(rel)) if i not in picked]
        best = max(rest, key=lambda i: (lam * rel[i] - (1 - lam) * sim[i, picked].max(), -i))
        if len(picked) >= keep and sim[best, picked].max() > threshold:
            break
        picked.append(best)
    return picked


@pytest.mark.parametrize("lam, threshold, keep", [(0.5, 0.2, 10), (0.9, 0.5, 1), (0.1, 0.0, 25), (1.0, 0.99, 5)])
def test_greedy_against_the_full_matrix(lam, threshold, keep):
    rng = np.random.default_rng(5)
    v, rel = rng.normal(size=(60, 6)), rng.random(60)
    assert list(diversity.greedy(v, rel, threshold, keep, lam)) == full_matrix_mmr(v, rel, threshold, keep, lam)


def test_mmr_per_group(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(60, 4))
    rows = [(i % 2, i, float(i % 7), [float(x) for x in v[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, s double, vec array<double>")
    got = {(r.g, r.id) for r in diversity.mmr(df, ["g"], "vec", "s", "id", threshold=0.3, min_remained=5).collect()}
    want = set()
    for g in (0, 1):
        ids = [i for i in range(60) if i % 2 == g]
        rel = diversity.relevance_of(np.array([float(i % 7) for i in ids]))
        want |= {(g, ids[j]) for j in full_matrix_mmr(v[ids], rel, 0.3, 5, 0.5)}
    assert got == want
    assert diversity.mmr(df, ["g"], "vec", "s", "id", threshold=None, min_remained=5).count() == 60


def test_partitioned_selection(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 8))
    rows = [(i, 0.0, [float(x) for x in base[i % 40]]) for i in range(400)]  # ten copies of each
    df = spark.createDataFrame(rows, "id long, s double, vec array<double>")
    for buckets in (1, 4):
        kept = diversity.mmr_partitioned(df, "vec", "s", "id", threshold=0.9, min_remained=10, buckets=buckets)
        ids = [r.id for r in kept.select("id").collect()]
        assert 10 <= len(ids) <= 40 and len({i % 40 for i in ids}) == len(ids)


def test_selection_beyond_one_task_ends_with_the_nodes_that_fit(spark, monkeypatch):
    monkeypatch.setattr(diversity, "MAX_GROUP_ROWS", 50)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 8))
    different = [(i, 0.0, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    df = spark.createDataFrame(different, "id long, s double, vec array<double>")
    # Nothing is alike, so nothing goes, and no node grows beyond what a task holds.
    assert diversity.mmr_partitioned(df, "vec", "s", "id", threshold=0.9999, min_remained=200).count() == 200
    copies = spark.createDataFrame([(i, 0.0, [float(x) for x in base[i % 30]]) for i in range(600)], "id long, s double, vec array<double>")
    for fan in (2, 4):
        ids = [r.id for r in diversity.mmr_partitioned(copies, "vec", "s", "id", threshold=0.9, min_remained=10, fan=fan).select("id").collect()]
        assert 10 <= len(ids) <= 30 * 16
    monkeypatch.setattr(diversity, "MAX_GROUP_ROWS", 300)  # now the root fits: one row of each copy is left
    ids = [r.id for r in diversity.mmr_partitioned(copies, "vec", "s", "id", threshold=0.9, min_remained=10, fan=2).select("id").collect()]
    assert len({i % 30 for i in ids}) == len(ids)


def test_one_group_beyond_one_task_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(diversity, "MAX_GROUP_ROWS", 50)
    df = spark.createDataFrame([(0, i, 0.0, [float(i), 1.0]) for i in range(60)], "g int, id long, s double, vec array<double>")
    with pytest.raises(Exception, match="more buckets"):
        diversity.mmr(df, ["g"], "vec", "s", "id", threshold=0.999, min_remained=50).collect()


def test_query_grid_equals_blocks_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(9)
    pool = [(i, f"t{i % 70}", [float(x) for x in rng.integers(-3, 4, 5)], ["a", "b"][i % 2:i % 2 + 1]) for i in range(300)] + [(900, "t1", None, ["a"])]
    queries = [(i, [float(x) for x in rng.integers(-3, 4, 5)], ["a", "b"][:1 + i % 2]) for i in range(60)] + [(99, None, ["a"])]
    p = spark.createDataFrame(pool, "vec_id long, text string, embedding array<double>, codes array<string>").repartition(4)
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>, codes array<string>")
    for args in ({"metric": "l2"}, {"metric": "cosine", "normalize": True}, {"metric": "ip", "codes": "codes"}, {"metric": "l2", "distinct": "text"}):
        want = sorted(tuple(r) for r in knn.knn_join(q, p, 7, carry=["text"], **args).collect())
        monkeypatch.setattr(knn, "QUERY_BLOCK_ROWS", 10)
        monkeypatch.setattr(knn, "PIECE_CELLS", 5 * 64)  # five pieces of the pool
        assert sorted(tuple(r) for r in knn.knn_join(q, p, 7, carry=["text"], **args).collect()) == want
        monkeypatch.undo()


# --- exact search -------------------------------------------------------------------------

def test_exact_join_far_from_the_origin(spark):
    rng = np.random.default_rng(9)
    v = 1e4 + rng.normal(size=(400, 16)) * 0.002
    pool = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    q = pool.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in knn.knn_join(q, pool, 10).collect()}
    for i in range(20):
        d = ((v - v[i]) ** 2).sum(axis=1)
        assert [got[i, k + 1] for k in range(10)] == sorted(range(400), key=lambda j: (d[j], j))[:10]


def test_zero_vectors_have_cosine_zero(spark):
    pool = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = pool.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = [(r.query_id, r.vec_id, r.dist) for r in knn.knn_join(q, pool, 3, metric="cosine").orderBy("query_id", "rank").collect()]
    assert got == [(0, 0, 0.0), (0, 1, 0.0), (0, 2, 0.0), (1, 1, -1.0), (1, 0, 0.0), (1, 2, 1.0), (2, 2, -1.0), (2, 0, 0.0), (2, 1, 1.0)]


def test_copies_do_not_crowd_out_texts(spark):
    rows = [(i, "same", "en", "s", i % 2, [0.001 * (i % 7), 0.0]) for i in range(2000)]
    rows += [(2000 + i, f"text {i}", "en", "s", i % 2, [1.0 + i, 0.0]) for i in range(100)]
    pool = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label int, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [50.0, 0.0])], "query_id long, query_vec array<double>")
    found = retrieve.retrieve_per_query(q, pool, 5)
    texts = {k: {r.text for r in found.collect() if r.query_id == k} for k in (1, 2)}
    assert len(texts[1]) == len(texts[2]) == 5 and found.count() == 10 and "same" in texts[1]
    one = q.where("query_id = 1")
    assert len({r.text for r in retrieve.retrieve_multi(one, pool, 20, 1).collect()}) == 20
    assert len({r.text for r in retrieve.retrieve_multi(one, pool, 500, 1).collect()}) == 101
    sized = retrieve.retrieve_per_query(q, pool, 30, weights={"cluster": 0.5})
    assert sized.count() == 60 and sized.agg(F.min("cluster_size")).first()[0] >= 1


def test_queries_without_a_vector_do_not_stop_the_deepening(spark):
    rows = [(i, f"text {i}", "en", "s", i % 2, [float(i), 0.0]) for i in range(60)]
    pool = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, label int, embedding array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, query_vec array<double>")
    assert retrieve.retrieve_multi(q, pool, 20, 1).count() == 20
    assert retrieve.retrieve_multi(q, pool, 100, 1).count() == 60
    assert retrieve.retrieve_multi(q.where("query_id = 2"), pool, 20, 1).count() == 0


# --- alignment ----------------------------------------------------------------------------

def test_alignment_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 16)
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(300, 5)), rng.normal(size=(300, 5))
    row = alignment.alignment_score(frame(spark, a, "pos", "embedding"), frame(spark, b, "pos", "embedding")).first()
    a, b = a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)
    s = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert abs(row.alignment - (np.mean(np.diag(s)) - np.mean(np.tril(s)))) < 1e-9


def test_crosslingual_counts_where_it_ranks(spark, monkeypatch):
    """Repeated and null ids, ties and other languages against every pair; no hit is written."""
    for name, value in (("BLOCK_HITS", 200), ("SLICE_PAIRS", 60), ("PIECE_CELLS", 250)):
        monkeypatch.setattr(knn, name, value)
    rows, real = {}, knn.durable

    def counted(df, name="step"):
        rows[name] = df.count()
        return real(df, name)
    monkeypatch.setattr(knn, "durable", counted)
    monkeypatch.setattr(alignment, "durable", counted)
    rng = np.random.default_rng(9)
    vecs = rng.integers(-2, 3, size=(120, 3)).astype(float)
    pool = [(i, None if i % 17 == 0 else f"s{i % 40}", [None, "xa", "xb", "xc", "xa", "xb"][i % 6], vecs[i].tolist() if i % 19 else None) for i in range(120)]
    queries = [(None if i % 13 == 0 else i // 2, rng.integers(-2, 3, size=3).astype(float).tolist() if i % 11 else None) for i in range(50)]
    out = alignment.crosslingual_retrieval(
        spark.createDataFrame(queries, "query_id long, query_vec array<float>"),
        spark.createDataFrame(pool, "vec_id long, sent_id string, language string, embedding array<float>").repartition(4), "xa", [1, 5, 20, 60], offset=3)
    found = dict.fromkeys([1, 5, 20, 60], 0)
    for q in {q for q, v in queries if q is not None and v}:
        pairs = [(sum((a - b) ** 2 for a, b in zip(v, p[3])), p[0], p) for i, v in queries if i == q and v for p in pool if p[3]]
        hits = [(rank, p) for rank, (_, _, p) in enumerate(sorted(pairs, key=lambda x: x[:2])[:63], 1) if rank > 3]
        for rank, (_, sent, lang, _) in hits:
            home = [r for r, p in hits if p[1] == sent and p[2] == "xa"] if sent and lang not in (None, "xa") else []
            for k in found:
                found[k] += bool(home) and max(rank, home[0]) - 3 <= k
    assert found[60] > found[5] > 0
    assert {r.k: r.share for r in out.collect()} == {k: round(n / (50 * k), 3) for k, n in found.items()}
    assert sum(rows.values()) <= 50


def peak_of(q, p, k, codes=None):
    """Hits of all queries over two batches of the pool, as (query, row) sets, and the peak of memory in MB."""
    import tracemalloc

    import pyarrow as pa
    flat = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
    names, columns = ["vec_id", "v"], [pa.array(np.arange(len(p))), flat(p)]
    by_code = None
    if codes:
        names, columns = [*names, "codes"], [*columns, pa.array([list(range(codes))] * len(p))]
        by_code = {c: np.arange(len(q)) for c in range(codes)}
    batch, half = pa.RecordBatch.from_arrays(columns, names=names), len(p) // 2
    tracemalloc.start()
    asked = knn._Queries(q, by_code, k, False)
    for part in (batch.slice(0, half), batch.slice(half)):
        knn._meet(asked, knn._Pool(part, ["vec_id"], "v", "l2", "codes" if codes else None, False), "vec_id", "l2")
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    found = [(b.column("query_id").to_numpy(), b.column("vec_id").to_numpy()) for b in asked.found(pa.array(np.arange(len(q))), "query_id", ["vec_id"])]
    return sorted((int(a), int(b)) for x, y in found for a, b in zip(x, y)), peak


@pytest.mark.parametrize("codes", [None, 3])
def test_deep_searches_hold_few_vectors_at_once(monkeypatch, codes):
    """900 000 pairs of 64 doubles on both sides would be 900 MB."""
    monkeypatch.setattr(knn, "SLICE_PAIRS", 10_000)
    monkeypatch.setattr(knn, "EXACT_CELLS", 100_000)
    monkeypatch.setattr(knn, "TILE_CELLS", 20_000)
    rng = np.random.default_rng(8)
    q, p = rng.normal(size=(900, 64)), rng.normal(size=(1200, 64))
    p[900:] = p[5]  # ties beyond the depth
    got, peak = peak_of(q, p, 1000, codes)
    d = np.round(((q ** 2).sum(1)[:, None] + (p ** 2).sum(1)[None] - 2 * q @ p.T), 9)
    want = sorted((i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(p)), d[i]))[:1000])
    assert got == want and peak < 120


def test_a_row_that_is_not_finite_hides_no_other(spark):
    pool = frame(spark, [[0.0, 1.0], [float("inf"), 0.0], [2.0, 0.0], [float("nan"), 1.0]], "vec_id", "embedding").coalesce(1)
    queries = frame(spark, [[0.0, 0.0]], "query_id", "query_vec")
    assert hits_of(knn.knn_join(queries, pool, 2)) == {0: [0, 2]}


def test_diversity_sweep_selects_all_points_from_one_copy_of_the_candidates(spark):
    from fewlabel.operators import sweep
    rng = np.random.default_rng(5)
    rows = [(q, i, [float(c) for c in rng.normal(size=4)], float(rng.integers(4)), int(rng.integers(2)))
            for q in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, embedding array<double>, dist_norm double, label int")
    truth = df.where("doc_id = 0").select("query_id", "label")
    out = sweep.sweep_diversity(df, truth, [0.1, 0.5], [0.3, 0.8], 5)
    assert re.search(r"FlatMapGroupsInPandas \[query_id#\d+L?\],", out._jdf.queryExecution().executedPlan().toString())
    got = {(r.threshold, r["lambda"]): r.f1_macro for r in out.collect()}
    assert len(got) == 4
    for (threshold, weight), value in got.items():
        pairs = []
        for q in range(6):
            mine = [r for r in rows if r[0] == q]
            picked = diversity.greedy(np.array([r[2] for r in mine]), diversity.relevance_of(np.array([r[3] for r in mine])),
                                      threshold, 5, weight)
            best = sorted((mine[i] for i in picked), key=lambda r: (r[3], r[1]))[:5]
            pairs.append((mine[0][4], int(2 * sum(r[4] for r in best) >= len(best))))
        f1 = [2 * sum(t == c == p for t, p in pairs) / max(1, sum(t == c for t, p in pairs) + sum(p == c for t, p in pairs)) for c in (0, 1)]
        assert abs(value - sum(f1) / 2) < 1e-9
