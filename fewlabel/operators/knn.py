"""Vector k-nearest-neighbour joins: exact, by coarse cell, and by random-projection hash.

Up to one bounded block of query vectors travels to the tasks that scan the pool, which is not shuffled; each task
keeps the k best rows per query while it reads and emits only those, and a ranked merge finishes the job. More queries
never pass the driver: the pool is dealt once into pieces that fit a task, and every piece meets all queries as a stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fewlabel.functions.ordering import GROUP_LIMIT, first_per_group, top_per_group
from fewlabel.functions.vectors import unit
from fewlabel.session import durable

METRICS = ("l2", "ip", "cosine")
QUERY_BLOCK_ROWS = 20_000  # about 120 MB at 768 dimensions
TILE_CELLS = 1_000_000  # distances computed at once
TILE_ROWS = 16  # queries of a tile at least
TASK_HITS = 1_000_000  # hits one task may hold, about 70 MB
SLICE_PAIRS = 250_000  # pairs that wait for their exact distance, and hits that are ranked at once
EXACT_CELLS = 1_000_000  # vector components gathered at once for exact distances
PIECE_CELLS = 8_000_000  # vector components of a piece of the pool, as doubles 64 MB
BLOCK_QUERIES = 1000  # queries of a block of the grid at least
BLOCK_HITS = 8_000_000  # hits that a task of ``knn_fold`` holds, 16 bytes each
EPS = np.finfo(np.float64).eps
DIGEST = "_digest"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _fast_distance(q: np.ndarray, p: np.ndarray, metric: str, p2: np.ndarray | None = None) -> np.ndarray:
    """All distances by one matrix product; ``p2`` holds the squared lengths of ``p`` where they are known."""
    prod = q @ p.T
    p2 = _squares(p) if p2 is None and metric != "ip" else p2
    if metric == "l2":
        prod *= -2.0
        prod += _squares(q)[:, None]
        prod += p2[None, :]
        return prod
    if metric == "cosine":
        prod = _share(prod, np.sqrt(_squares(q))[:, None] * np.sqrt(p2)[None, :])
    return -prod


def _share(prod: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Cosines; a zero vector is similar to nothing (0)."""
    return np.divide(prod, length, out=np.zeros(np.broadcast(prod, length).shape), where=length > 0)


def _rounding(q: np.ndarray, p2: np.ndarray, metric: str) -> np.ndarray:
    """How far ``_fast_distance`` may be off per query row, on both sides of a comparison: its terms grow with the norms.
    Rows that are not finite have no distance to be off from."""
    if metric == "cosine":
        scale = np.ones(len(q))
    else:
        q2, most = _squares(q), p2.max(initial=0.0, where=np.isfinite(p2))
        scale = q2 + most if metric == "l2" else np.sqrt(q2 * most)
    return 4.0 * (q.shape[1] + 8) * EPS * scale


def _ordered_sum(terms) -> np.ndarray:
    acc = 0.0
    for t in terms:
        acc = acc + t
    return acc


def _row_distance(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Row-wise distance of aligned rows, summed left to right like the column expressions,
    so that ties and ranks do not depend on the matrix layout."""
    dims = range(q.shape[1])
    if metric == "l2":
        return _ordered_sum((q[:, j] - p[:, j]) ** 2 for j in dims)
    prod = _ordered_sum(q[:, j] * p[:, j] for j in dims)
    if metric == "cosine":
        prod = _share(prod, np.sqrt(_ordered_sum(q[:, j] ** 2 for j in dims))
                      * np.sqrt(_ordered_sum(p[:, j] ** 2 for j in dims)))
    return -prod


def _exact_distance(q_all: np.ndarray, q: np.ndarray, p_all: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every pair of row numbers; the vectors are gathered a few at a time."""
    step = max(1, EXACT_CELLS // max(1, q_all.shape[1]))
    return np.concatenate([_row_distance(q_all[q[lo:lo + step]], p_all[p[lo:lo + step]], metric) for lo in range(0, len(q), step)])


class _Best:
    """The k best pool rows of every query of one slice seen so far; with ``distinct`` of equal digests the best only.

    ``place`` numbers the pool rows a task reads: a pair that meets under several codes counts once.
    """

    def __init__(self, n_queries: int, k: int, distinct: bool = False):
        self.k, self.distinct = k, distinct
        self.limit = np.full(n_queries, np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.place = np.empty(0, dtype=np.int64)
        self.dist = np.empty(0)
        self.rows: pa.Table | None = None

    def add(self, q: np.ndarray, dist: np.ndarray, place: np.ndarray, rows: pa.Table, id_name: str) -> None:
        self.q = np.concatenate([self.q, q])
        self.dist = np.concatenate([self.dist, dist])
        self.place = np.concatenate([self.place, place])
        self.rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        ids = self.rows[id_name].to_numpy()
        ids = ids.astype(str) if ids.dtype == object else ids
        order = np.lexsort((self.place, ids, self.dist, self.q))
        again = (np.diff(self.q[order]) == 0) & (np.diff(self.place[order]) == 0)
        order = order[np.r_[True, ~again]] if again.any() else order
        if self.distinct:
            codes = self.rows[DIGEST].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            pair = self.q[order] * (codes.max(initial=0) + 1) + codes[order]
            order = order[np.sort(np.unique(pair, return_index=True)[1])]
        q_sorted = self.q[order]
        starts = np.flatnonzero(np.r_[True, q_sorted[1:] != q_sorted[:-1]])
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        kept = order[rank < self.k]
        last = order[rank == self.k - 1]
        self.limit[self.q[last]] = self.dist[last]
        self.q, self.dist, self.place = self.q[kept], self.dist[kept], self.place[kept]
        self.rows = self.rows.take(kept).combine_chunks()


class _Queries:
    """A bounded set of queries in slices, whose hits are ranked one slice at a time."""

    def __init__(self, vectors: np.ndarray, by_code: dict | None, k: int, distinct: bool):
        self.vectors, self.by_code, self.seen = vectors, by_code, 0
        step = max(1, SLICE_PAIRS // k)
        self.slices = [(lo, _Best(min(step, len(vectors) - lo), k, distinct)) for lo in range(0, len(vectors), step)]

    def found(self, keys: pa.Array, query_id: str, kept: Sequence[str]):
        for lo, best in self.slices:
            if best.rows is not None and best.rows.num_rows:
                arrays = [keys.take(pa.array(best.q + lo)), *[_whole(best.rows[c]) for c in kept], pa.array(best.dist)]
                yield pa.RecordBatch.from_arrays(arrays, names=[query_id, *kept, "dist"])


class _Places:
    """The k best pool rows of every group of queries of one slice, as distances and places: 16 bytes a hit, in the order of group,
    distance and place. ``group`` is ascending and numbers each query's group from 0."""

    def __init__(self, group: np.ndarray, k: int):
        self.of_query, self.k = group, k
        self.limit = np.full(len(group), np.inf)
        self.group, self.place = np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32)
        self.dist = np.empty(0)

    def add(self, q: np.ndarray, dist: np.ndarray, place: np.ndarray, rows: pa.Table, id_name: str) -> None:
        group = np.concatenate([self.group, self.of_query[q].astype(np.int32)])
        dist, place = np.concatenate([self.dist, dist]), np.concatenate([self.place, place.astype(np.int32)])
        order = np.lexsort((place, dist, group))
        rank = self._rank(group[order])
        last = order[rank == self.k]
        limit = np.full(self.of_query[-1] + 1, np.inf)
        limit[group[last]] = dist[last]
        self.limit = limit[self.of_query]
        kept = order[rank <= self.k]
        self.group, self.dist, self.place = group[kept], dist[kept], place[kept]

    @staticmethod
    def _rank(group: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        return np.arange(1, len(group) + 1) - np.repeat(starts, np.diff(starts, append=len(group)))

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.group, self._rank(self.group), self.place


class _Asked:
    """The queries of a block, in slices of whole groups: queries of one id share their k best."""

    def __init__(self, keys: pa.Array, vectors: np.ndarray, k: int):
        group = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.argsort(group, kind="stable")
        group, self.vectors, self.by_code, self.seen = group[order], vectors[order], None, 0
        step = max(1, SLICE_PAIRS // k)
        cuts = np.searchsorted(group, np.arange(0, group[-1] + 1 + step, step))
        self.slices = [(lo, _Places(group[lo:hi] - group[lo], k)) for lo, hi in zip(cuts, cuts[1:])]


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return pa.concat_arrays(out.chunks) if isinstance(out, pa.ChunkedArray) else out


class _Pool:
    """Pool rows that are compared at once: a batch of a scan, or a piece of the grid. Rows of one text lie side by side,
    so that the k-th best is one of texts."""

    def __init__(self, batch: pa.RecordBatch, kept: Sequence[str], pool_vec: str, metric: str, codes: str | None, distinct: bool):
        self.text = None
        if distinct:
            text = batch.column(DIGEST).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            order = np.argsort(text, kind="stable")
            batch, self.text = batch.take(pa.array(order)), text[order]
        self.vectors = _matrix(batch.column(pool_vec))
        # The bound on distances is taken around the middle of the rows, where norms are small.
        finite = np.isfinite(self.vectors).all(axis=1)
        self.middle = self.vectors.mean(axis=0, where=finite[:, None]) if metric == "l2" and finite.any() else 0.0
        self.table = pa.Table.from_batches([batch]).select(kept)
        self.by_code = {c: np.sort(rows) for c, rows in _codes_index(batch.column(codes)).items()} if codes else None
        self.near = self.vectors - self.middle if not codes and metric == "l2" else self.vectors
        self.squares = _squares(self.near)

    def group(self, rows: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Vectors of the rows around the middle, their squared lengths, and where each text begins."""
        near, squares, text = self.near, self.squares, self.text
        if rows is not None:
            near, text = self.vectors[rows] - self.middle, None if text is None else text[rows]
            squares = _squares(near)
        return near, squares, None if text is None else np.flatnonzero(np.r_[True, np.diff(text) != 0])


def _codes_index(column: pa.ListArray) -> dict:
    """Code -> positions of the rows that carry it."""
    rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    coded = column.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    names = coded.dictionary.to_pylist()
    return {names[codes[part[0]]]: rows[part] for part in np.split(order, cuts) if len(part)}


def _meet(asked: _Queries, pool: _Pool, pool_id: str, metric: str) -> None:
    """Add to the queries' best what the pool rows have for them.

    A tile hands on the pairs whose bound reaches the k best; as soon as ``SLICE_PAIRS`` of them wait, they are ranked.
    So a task holds the k best of its queries and one tile, however many pairs tie.
    """
    groups = [(None, None)] if asked.by_code is None else [
        (asked.by_code[c], rows) for c, rows in pool.by_code.items() if c in asked.by_code]
    for lo, best in asked.slices:
        n, k = len(best.limit), best.k
        found_q, found_p, waiting = [], [], 0

        def rank():
            q, p = np.concatenate(found_q), np.concatenate(found_p)
            best.add(q, _exact_distance(asked.vectors, q + lo, pool.vectors, p, metric), p + asked.seen, pool.table.take(p), pool_id)
            found_q.clear(), found_p.clear()

        for members, rows in groups:
            mine = (np.arange(n) if members is None
                    else members[slice(*np.searchsorted(members, [lo, lo + n]))] - lo)
            if not len(mine):
                continue
            near, squares, heads = pool.group(rows)
            step = max(TILE_ROWS, TILE_CELLS // max(1, len(near)))
            for at in range(0, len(mine), step):
                part = mine[at:at + step]
                q_near = asked.vectors[part + lo] - pool.middle
                d = _fast_distance(q_near, near, metric, squares)
                slack = _rounding(q_near, squares, metric)
                close = d <= (best.limit[part] + slack)[:, None]
                if np.count_nonzero(close) > 2 * k * len(part):
                    least = np.minimum.reduceat(d, heads, axis=1) if heads is not None else d
                    if least.shape[1] > k:
                        # the k-th smallest may be too small itself, hence the slack twice
                        kth = np.partition(least, k - 1, axis=1)[:, k - 1]
                        close = d <= (np.minimum(best.limit[part], kth + slack) + slack)[:, None]
                a, b = np.nonzero(close)
                found_q.append(part[a])
                found_p.append(b if rows is None else rows[b])
                waiting += len(a)
                if waiting > SLICE_PAIRS:
                    rank()
                    waiting = 0
        if waiting:
            rank()
    asked.seen += len(pool.vectors)


def _scan(block: pa.Table, pool: DataFrame, k: int, key_field: T.StructField, pool_id: str,
          query_vec: str, pool_vec: str, metric: str, carry: Sequence[str],
          codes: str | None, distinct: bool) -> DataFrame:
    """One pass over the pool for one bounded query block."""
    query_id = key_field.name
    sc = pool.sparkSession.sparkContext
    payload = sc.broadcast({
        "vec": _matrix(block[query_vec].combine_chunks()),
        "codes": _codes_index(block[codes].combine_chunks()) if codes else None})
    keys = sc.broadcast(block[query_id].combine_chunks())
    kept = [pool_id, *[c for c in carry if c != pool_id], *([DIGEST] if distinct else [])]
    schema = T.StructType([key_field, *[pool.schema[c] for c in kept],
                           T.StructField("dist", T.DoubleType())])

    def scan(batches):
        asked = _Queries(payload.value["vec"], payload.value["codes"], k, distinct)
        for batch in batches:
            if batch.num_rows and asked.slices:
                _meet(asked, _Pool(batch, kept, pool_vec, metric, codes, distinct), pool_id, metric)
        yield from asked.found(keys.value, query_id, kept)

    needed = list(dict.fromkeys([*kept, pool_vec] + ([codes] if codes else [])))
    return pool.where(F.col(pool_vec).isNotNull()).select(*needed).mapInArrow(scan, schema)


def _grid(queries: DataFrame, pool: DataFrame, k: int, key_field: T.StructField, pool_id: str,
          query_vec: str, pool_vec: str, metric: str, carry: Sequence[str],
          codes: str | None, distinct: bool) -> DataFrame:
    """Every piece of the pool against every block of the queries: one shuffle deals the pool into pieces of ``PIECE_CELLS``
    components and the queries into blocks, so many that all cores have work; a task holds one piece and reads its queries
    batch by batch."""
    query_id = key_field.name
    kept = [pool_id, *[c for c in carry if c != pool_id], *([DIGEST] if distinct else [])]
    needed = list(dict.fromkeys([*kept, pool_vec] + ([codes] if codes else [])))
    schema = T.StructType([key_field, *[pool.schema[c] for c in kept], T.StructField("dist", T.DoubleType())])
    # Written, so that pieces and blocks stay the same when a task runs again.
    pool = durable(pool.where(F.col(pool_vec).isNotNull()).select(*needed), "grid-pool")
    queries = durable(queries, "grid-queries")
    first = pool.select(F.size(pool_vec).alias("d")).first()
    pieces = max(1, math.ceil(pool.count() * (first["d"] if first else 1) / PIECE_CELLS))
    cores = pool.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(math.ceil(3 * cores / pieces), math.ceil(queries.count() / BLOCK_QUERIES)))

    def dealt(df, own, n, other, copies):
        """Each row goes to one piece and all blocks, or to one block and all pieces."""
        return df.select("*", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias(other)).withColumn(
            "_piece", F.col("_p") * blocks + F.col("_b"))

    rows = dealt(pool, "_p", pieces, "_b", blocks).select("_piece", F.lit(0).alias("_side"), F.struct(*needed).alias("_p"))
    wanted = dealt(queries, "_b", blocks, "_p", pieces).select("_piece", F.lit(1).alias("_side"), F.struct(*queries.columns).alias("_q"))
    met = (rows.unionByName(wanted, allowMissingColumns=True).repartition(2 * pieces * blocks, "_piece")
           .sortWithinPartitions("_piece", "_side"))

    def side(batch, name):
        column = batch.column(name)
        return pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type])

    def run(batches):
        piece, parts, whole = None, [], None
        for batch in batches:
            place, kind = batch.column("_piece").to_numpy(), batch.column("_side").to_numpy()
            cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if place[lo] != piece:
                    piece, parts, whole = place[lo], [], None
                if kind[lo] == 0:
                    parts.append(side(part, "_p"))
                    continue
                if parts:  # the piece is complete once a query comes
                    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                    whole, parts = _Pool(whole, kept, pool_vec, metric, codes, distinct), []
                if whole is None:
                    continue
                rows = side(part, "_q")
                asked = _Queries(_matrix(rows.column(query_vec)), _codes_index(rows.column(codes)) if codes else None, k, distinct)
                _meet(asked, whole, pool_id, metric)
                yield from asked.found(rows.column(query_id), query_id, kept)

    return met.mapInArrow(run, schema)


def knn_join(queries: DataFrame, pool: DataFrame, k: int, *, query_id: str = "query_id",
             pool_id: str = "vec_id", query_vec: str = "query_vec", pool_vec: str = "embedding",
             metric: str = "l2", normalize: bool = False, carry: Sequence[str] = (),
             codes: str | None = None, rank_name: str = "rank", distinct: str | None = None) -> DataFrame:
    """The k nearest pool rows of every query with ``dist`` and ``rank`` (ties by pool id).

    ``dist`` is the squared Euclidean distance, or the negated inner product or cosine, so
    smaller is always closer. Only ``pool_id`` and the ``carry`` columns of the pool travel
    with the hits; attach texts afterwards by key. ``codes`` names an array column present on
    both sides: a pair is compared only if the two arrays share a value. ``distinct`` names a pool
    column of which a query gets every value once, at its closest row: k distinct texts come out of one
    scan however many copies the pool holds. Its digest travels with the hits as ``_digest``.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if normalize:
        queries = queries.withColumn(query_vec, unit(query_vec))
        pool = pool.withColumn(pool_vec, unit(pool_vec))
    queries = (queries.where(F.col(query_vec).isNotNull())
               .select(query_id, query_vec, *([codes] if codes else [])))
    if distinct:
        pool = pool.withColumn(DIGEST, F.unhex(F.md5(F.coalesce(F.col(distinct).cast("string"), F.lit("")))))
    args = (k, queries.schema[query_id], pool_id, query_vec, pool_vec, metric, carry, codes, bool(distinct))
    size = max(1, min(QUERY_BLOCK_ROWS, TASK_HITS // k))
    block = queries.limit(size + 1).toArrow()
    hits = _scan(block, pool, *args) if block.num_rows <= size else _grid(queries, pool, *args)
    if distinct:
        hits = first_per_group(hits, [query_id, DIGEST], ["dist", pool_id])
    per_query = k * hits.rdd.getNumPartitions() if k > GROUP_LIMIT else None  # every task sends k at most
    return top_per_group(hits, [query_id], ["dist", pool_id], k, rank_name, per_query)


def knn_fold(queries: DataFrame, pool: DataFrame, k: int, fold: Callable, schema: str, *, query_id: str = "query_id",
             pool_id: str = "vec_id", query_vec: str = "query_vec", pool_vec: str = "embedding", metric: str = "l2",
             carry: Sequence[str] = ()) -> DataFrame:
    """What ``fold`` makes of the hits ``knn_join`` would rank, which stay in their tasks: for reports that need no hit itself.

    A task holds a block of the queries with their k best (``BLOCK_HITS`` in all) while the whole pool passes it in the order of
    its id, piece by piece; one shuffle deals the queries into blocks and the pool to every block. So disk grows with pool
    times blocks, not with the hits. ``fold(carried, hits)`` gets the ``carry`` columns of all pool rows and an iterator of
    ``group, rank, place``: a number for the query id, the rank from 1, and the hit's row of ``carried``; hits come in the order of
    group and rank, a group whole. It yields record batches of ``schema``. Queries without an id or a vector have no hits.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    queries = queries.where(F.col(query_vec).isNotNull() & F.col(query_id).isNotNull()).select(query_id, query_vec)
    queries = durable(queries, "fold-queries")
    needed = list(dict.fromkeys([pool_id, pool_vec, *carry]))
    pool = pool.where(F.col(pool_vec).isNotNull()).select(*needed)
    hits, cores = queries.count() * k, pool.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(hits / BLOCK_HITS), min(2 * cores, math.ceil(hits / SLICE_PAIRS)))
    asked = queries.select(F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"), F.lit(0).alias("_side"),
                           F.struct(*queries.columns).alias("_q"))
    rows = pool.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_side"), F.struct(*needed).alias("_p"))
    met = (asked.unionByName(rows, allowMissingColumns=True).repartition(2 * blocks, "_block")
           .sortWithinPartitions("_block", "_side", F.col(f"_p.`{pool_id}`")))

    def block(parts):
        """``parts``: of one block, the queries and then the pool, as pairs of side and batch."""
        keys, vectors, waiting, carried, held = [], [], [], [], None

        def meet():
            piece = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            _meet(held, _Pool(piece, [pool_id], pool_vec, metric, None, False), pool_id, metric)
            carried.append(piece.select(list(carry)).take(pa.array(np.arange(len(piece)))))  # a copy, which lets the vectors go
            waiting.clear()

        for kind, part in parts:
            column = part.column("_p" if kind else "_q")
            part = pa.RecordBatch.from_arrays(column.flatten(), names=[f.name for f in column.type])
            if not kind:
                keys.append(part.column(query_id))
                vectors.append(_matrix(part.column(query_vec)))
            elif keys:
                held = held or _Asked(pa.concat_arrays(keys), np.concatenate(vectors), k)
                waiting.append(part)
                if sum(len(w) for w in waiting) * held.vectors.shape[1] >= PIECE_CELLS:
                    meet()
        if waiting:
            meet()
        if carried:
            yield from fold(pa.Table.from_batches(carried), (best.found() for _, best in held.slices))

    def run(batches):
        for _, parts in groupby(_parts(batches), lambda part: part[0]):
            yield from block((kind, part) for _, kind, part in parts)

    return met.mapInArrow(run, schema)


def _parts(batches):
    """``block, side, batch`` of the stretches of one block and side."""
    for batch in batches:
        place, kind = batch.column("_block").to_numpy(), batch.column("_side").to_numpy()
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(kind) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
            if lo < hi:
                yield place[lo], kind[lo], batch.slice(lo, hi - lo)


# --- coarse cells -------------------------------------------------------------------------

def fit_cells(pool: DataFrame, n_cells: int, vec: str = "embedding", seed: int = 42):
    """k-means over the pool vectors; at most as many cells as rows."""
    n = pool.count()
    data = pool.select(array_to_vector(vec).alias("features"))
    return KMeans(k=max(2, min(n_cells, n)), seed=seed, maxIter=20).fit(data)


def assign_cells(df: DataFrame, model, vec: str = "embedding", name: str = "cell_id") -> DataFrame:
    scored = model.transform(df.withColumn("features", array_to_vector(vec)))
    return scored.withColumnRenamed("prediction", name).drop("features")


def nearest_cells(df: DataFrame, model, vec: str, n_probe: int, name: str) -> DataFrame:
    """The ``n_probe`` closest cells of every row, as an array; the centres are few by choice."""
    centers = np.asarray(model.clusterCenters())

    @F.pandas_udf("array<int>")
    def probe(v):
        if not len(v):
            return v
        x = np.stack(v.to_numpy()).astype(np.float64)
        d = _fast_distance(x, centers, "l2")
        import pandas as pd
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n_probe].astype(np.int32)))

    return df.withColumn(name, probe(F.col(vec)))


def cell_join(queries: DataFrame, pool: DataFrame, k: int, model, n_probe: int = 8, *,
              query_vec: str = "query_vec", pool_vec: str = "embedding", **kw) -> DataFrame:
    """k nearest among the pool rows of the ``n_probe`` closest cells; probing every cell is exact.

    With a pool stored by ``cell_id`` the cells no query probes are never read.
    """
    probed = durable(nearest_cells(queries, model, query_vec, n_probe, "codes"), "probes")
    if "cell_id" in pool.columns:
        wanted = probed.select(F.explode("codes").alias("c")).distinct().limit(10_001).collect()
        if len(wanted) <= 10_000:
            pool = pool.where(F.col("cell_id").isin([r.c for r in wanted]))
    else:
        pool = assign_cells(pool, model, pool_vec)
    pool = pool.withColumn("codes", F.array(F.col("cell_id").cast("int")))
    return knn_join(probed, pool, k, query_vec=query_vec, pool_vec=pool_vec, codes="codes", **kw)


def hash_codes(df: DataFrame, vec: str, planes: np.ndarray, bucket_length: float, probes: int = 0, name: str = "codes") -> DataFrame:
    """The buckets of every row, as an array of texts; rows without a vector go.

    ``planes`` (tables x parts x dimensions) give every table as many projections as it has parts, cut at multiples of
    ``bucket_length``; a bucket is one cell of all of them. ``probes`` more buckets follow: those one cell away in one part,
    of any table, whose border lies closest to the row's own projection.
    """
    tables, parts, dims = planes.shape

    @F.pandas_udf("array<string>")
    def coded(v):
        import pandas as pd
        if not len(v):
            return v
        at = np.stack(v.to_numpy()).astype(np.float64) @ planes.reshape(-1, dims).T / bucket_length
        cells = np.floor(at)
        to_border = np.stack([at - cells, 1 - (at - cells)], axis=2).reshape(len(v), -1)
        nearest = np.argsort(to_border, axis=1, kind="stable")[:, :probes]
        cells = cells.astype(np.int64).reshape(len(v), tables, parts)
        out = []
        for own, near in zip(cells, nearest):
            names = [f"{t}:{own[t].tolist()}" for t in range(tables)]
            for n in near.tolist():
                table, part = divmod(n // 2, parts)
                other = own[table].copy()
                other[part] += 1 if n % 2 else -1
                names.append(f"{table}:{other.tolist()}")
            out.append(names)
        return pd.Series(out)

    return df.where(F.col(vec).isNotNull()).withColumn(name, coded(F.col(vec)))


def hash_join(queries: DataFrame, pool: DataFrame, k: int, bucket_length: float = 1.0,
              tables: int = 4, seed: int = 42, *, parts: int = 1, probes: int = 0, query_vec: str = "query_vec",
              pool_vec: str = "embedding", **kw) -> DataFrame:
    """k nearest among the pool rows that lie in a bucket of the query's own or one of ``probes`` neighbouring ones.

    Buckets come from random projections of unit length, ``parts`` for each table; only queries look into neighbours, so
    the pool has one code per table. A query may get fewer than k rows.
    """
    def dims(df, vec):
        first = df.where(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).first()
        return first.d if first else 0

    size = dims(pool, pool_vec) or dims(queries, query_vec) or 1
    planes = np.random.default_rng(seed).standard_normal((tables, parts, size))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    return knn_join(hash_codes(queries, query_vec, planes, bucket_length, probes), hash_codes(pool, pool_vec, planes, bucket_length), k,
                    query_vec=query_vec, pool_vec=pool_vec, codes="codes", **kw)


def recall(approx: DataFrame, exact: DataFrame, query_id: str, pool_id: str) -> DataFrame:
    """Share of the exact hits an approximate join found."""
    found = exact.join(approx.select(query_id, pool_id), [query_id, pool_id], "left_semi")
    return (exact.agg(F.count(F.lit(1)).alias("exact_hits"))
            .withColumn("found_hits", found.agg(F.count(F.lit(1)).alias("n")).scalar())
            .withColumn("recall", F.try_divide("found_hits", "exact_hits")))
