"""Near duplicates by SimHash fingerprints: pigeonhole blocks, a join on blocks, then the Hamming distance."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import frame, text_of
from fewlabel.llm.components import components
from fewlabel.session import durable

SEED = 42
CHUNK = 200_000  # shingles hashed at a time, so that a huge text needs bounded memory


def fingerprint(text: str, width: int) -> int:
    """The SimHash of a text as a signed 64-bit number: a bit is one where over half of the shingle hashes have it.

    Words are what ASCII white space leaves, ASCII letters in lower case; shingles are ``width`` words joined by a
    blank and count as often as they occur. A shorter text is one shingle, an empty one has fingerprint zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - width + 1 if len(words) >= width else min(len(words), 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        part = range(at, min(at + CHUNK, n))
        hashes = np.fromiter((digest(join(words[i:i + width]), SEED) for i in part), dtype="<u8", count=len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``id_col, fingerprint`` (long) for every row; a null text is the empty one."""
    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            yield frame({id_col: batch[id_col], "fingerprint": np.fromiter(
                (fingerprint(t, width) for t in batch["text"]), dtype=np.int64, count=len(batch))})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"`{id_col}` {kind}, fingerprint long")


def _mask(blocks: tuple[tuple[int, int], ...]) -> int:
    value = sum(((1 << size) - 1) << start for start, size in blocks)
    return value - (1 << 64) if value >> 63 else value


def block_masks(distance: int, blocks: int = 5) -> list[int]:
    """Masks of all ways to keep ``blocks - distance`` of ``blocks`` even pieces of 64 bits. Two fingerprints that
    differ in at most ``distance`` bits agree on all bits of one mask at least."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    pieces = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [_mask(kept) for kept in combinations(pieces, blocks - distance)]


def links(prints: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = 32) -> DataFrame:
    """``a, b``: pairs of distinct ``fingerprint`` values that connect all that differ in at most ``distance`` bits (two at most).

    Fingerprints are grouped by the bits under every mask. Groups of up to ``crowd`` members are joined with themselves
    and their pairs verified. In larger ones pairs would grow with the square of the group; there, members within two
    bits of each other are those that turn into one value by flipping at most one bit each outside the mask, so every
    member is linked to the smallest that shares such a value. Both ways give exact links, and the
    components of the links are the same whatever ``crowd`` is.
    """
    if distance != 2:
        raise ValueError("links are built for a distance of two bits")
    masks = block_masks(distance, blocks)
    keyed = prints.select("fingerprint", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("mask_id", "mask"))
    keyed = keyed.select("fingerprint", "mask_id", "mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("mask_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = durable(sizes, "sizes")
    keyed = durable(keyed.join(sizes, ["mask_id", "key"]), "blocks")
    few = keyed.where(F.col("n") <= crowd)
    left = few.select("mask_id", "key", F.col("fingerprint").alias("a"))
    right = few.select("mask_id", "key", F.col("fingerprint").alias("b"))
    near = left.join(right, ["mask_id", "key"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    flips = F.concat(F.array(F.lit(0).cast("long")), F.filter(
        F.array(*[F.lit(_mask(((i, 1),))) for i in range(64)]), lambda bit: bit.bitwiseAND(F.col("mask")) == 0))
    spread = keyed.where(F.col("n") > crowd).select("fingerprint", F.explode(flips).alias("flip"))
    spread = spread.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("value"))
    centre = spread.groupBy("value").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("top")).where("a < top")
    shared = spread.join(centre, "value").where("fingerprint > a").select("a", F.col("fingerprint").alias("b"))
    return near.unionByName(shared).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    distance: int = 2) -> DataFrame:
    """``id_col, fingerprint`` (long) ``, component_id``: the smallest id reachable over links, for every input row.

    Equal fingerprints are one node, so exact copies cost no pairs. Empty texts share fingerprint zero and are linked
    like any other. Ids are integers; a null id keeps its row and counts as larger than all others (a component of
    null ids only has a null ``component_id``). Repeated rows stay. Other columns are left out.
    """
    prints = durable(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = durable(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "nodes")
    members = components(links(nodes.select("fingerprint"), distance))
    placed = nodes.join(members, nodes["fingerprint"] == members["node"], "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least")
    placed = durable(placed, "placed")
    smallest = durable(placed.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = placed.join(smallest, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
               distance: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, all columns; of repeated rows with that id one stays.

    Rows with a null id cannot be named as copies and stay.
    """
    named, unnamed = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    found = near_duplicates(named, id_col, text_col, width, distance)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(id_col)
    return named.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(unnamed)


def hex_text(fingerprint: Column) -> Column:
    """Sixteen lowercase hex digits of a 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# --- wide fingerprints: groups of texts above a shingle similarity -------------------------

WORDS = 32  # 64-bit words of a wide fingerprint
CROWD, TILE = 16, 512
SMALL = 64  # sets of up to so many shingles are compared by their shingles, since their fingerprints say too little
SLOTS = 1 << 22  # counters of shingles at most, 16 MB
SLOTS_A_ROW = 1024  # counters that travel together
TILE_SHINGLES = 1_000_000  # of the texts of a tile, about
LISTED = 64  # of a node's open keys, so that pairs are compared once


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of an ``n x k`` table of 64-bit words have each of the ``64 k`` bits, lowest bit first.

    Rows are added three at a time as bit planes: sums stay on the plane, carries go to the next one.
    """
    total = np.zeros(64 * rows.shape[1], dtype=np.int64)
    weight, plane = 1, rows
    while len(plane):
        carried = []
        while len(plane) > 1:
            third = len(plane) // 3
            if third == 0:
                carried.append(plane[:1] & plane[1:])
                plane = plane[:1] ^ plane[1:]
                continue
            a, b, c = plane[:third], plane[third:2 * third], plane[2 * third:3 * third]
            both = a ^ b
            carried.append((a & b) | (c & both))
            plane = np.concatenate([both ^ c, plane[3 * third:]])
        total += weight * np.unpackbits(plane.astype("<u8").view(np.uint8).ravel(), bitorder="little").astype(np.int64)
        weight *= 2
        plane = np.concatenate(carried) if carried else plane[:0]
    return total


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order. Words, shingles and short texts are as in ``fingerprint``."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - width + 1 if len(words) >= width else min(len(words), 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(words[i:i + width]), SEED) for i in range(n)), dtype=np.uint64, count=n))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of ``64 * WORDS`` bits, as signed words, over a set of shingle hashes: every shingle counts once."""
    n = len(hashes)
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    salts = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 20_000):
        mixed = hashes[at:at + 20_000, None] + salts
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += bit_counts(mixed ^ (mixed >> np.uint64(31)))
    return np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")


def prefix_keys(hashes: np.ndarray, similarity: float, counts: np.ndarray | None = None) -> np.ndarray:
    """Keys of a set: the first of its hashes, so many that two sets of this similarity share one for certain.

    The order is the same for all sets: by the counts (``shingle_counts``), rare shingles first, then ascending.
    """
    n = len(hashes)
    kept = n - math.ceil(similarity * n - 1e-9) + 1
    if counts is not None:
        hashes = hashes[np.argsort(counts[_slot(hashes, len(counts))], kind="stable")]
    return hashes[:kept].view(np.int64)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The counter of each hash: its highest bits. ``slots`` is a power of two."""
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def differing_bits(similarity: float, deviations: float = 1.5) -> int:
    """Bits that wide fingerprints of two texts with this Jaccard similarity differ in at most, up to the given deviations.

    Sets of equal size that share ``j`` of their union have cosine ``2 j / (1 + j)``, and a bit differs with the
    angle's share of a half turn.
    """
    bits = 64 * WORDS
    share = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(bits * share + deviations * (bits * share * (1 - share)) ** 0.5)


def shingle_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How many of all texts have a shingle, for every shingle of every text; shingles whose hashes share their highest bits
    share a counter. There is a counter for eight characters, ``SLOTS`` of them at most.

    The counts only set the order in which shingles become keys, not which texts are compared. No shingle is shuffled:
    tasks, four per core at most, hand out their counters, which are summed row by row.
    """
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = min(SLOTS, max(SLOTS_A_ROW, 1 << (letters // 8).bit_length()))

    def count(batches):
        counts = np.zeros(slots, dtype=np.int32)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(counts, _slot(shingle_hashes(text, width), slots), 1)
        yield frame({"at": np.arange(slots // SLOTS_A_ROW), "counts": [*counts.reshape(-1, SLOTS_A_ROW)]})

    def total(batches):
        sums: dict = {}
        for batch in batches:
            for at, counts in zip(batch["at"], batch["counts"]):
                sums[at] = sums[at] + counts if at in sums else np.array(counts)
        yield frame({"at": np.array([*sums], dtype=np.int64), "counts": [*sums.values()]})

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("text").coalesce(4 * cores).mapInPandas(count, "at long, counts array<int>")
    found = parts.repartition(cores, "at").mapInPandas(total, "at long, counts array<int>").toPandas()
    out = np.zeros((slots // SLOTS_A_ROW, SLOTS_A_ROW), dtype=np.int32)
    for at, counts in zip(found["at"], found["counts"]):
        out[at] = counts
    return out.ravel()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    similarity: float = 0.8) -> DataFrame:
    """``id_col``: the smallest id of every group of texts linked by a shingle similarity of ``similarity`` or more.

    Equal shingle sets are one node. Nodes are candidates if they share one of their first shingle hashes (``prefix_keys``),
    which pairs of the similarity do for certain. Shingles that many texts have come last in that order (``shingle_counts``), so that
    a line or a licence in thousands of texts is a key only of texts with little else. Every link is confirmed on the shingle
    sets, of larger texts where the fingerprints are within ``differing_bits`` with five deviations. Groups of a
    key with up to ``CROWD`` nodes compare all pairs. A larger one compares every node with its first; where that
    leaves it in several components, its nodes are dealt into tiles and all tiles compared in parallel: by fingerprints, which
    nodes may have a link to another component, and then these by their whole sets of 64-bit shingle hashes. A pair of tiles hands out
    the links that join its components, fewer than it has nodes. So no link is lost to a group's size, no task holds more than two tiles,
    and no pair that is only a candidate is written.
    Rows with a null id take no part.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))

    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows, width))

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t, width) for t in batch["text"]]
            yield frame({"id": batch["id"], "keys": [prefix_keys(h, similarity, counts.value) for h in sets], "digest": [xxhash.xxh3_128_digest(h.tobytes()) for h in sets],
                         "size": np.array([len(h) for h in sets], dtype=np.int64), "print": [wide_fingerprint(h) for h in sets],
                         "hashes": [h.view(np.int64) if len(h) <= SMALL / similarity else None for h in sets]})

    prints = durable(rows.mapInPandas(run, "id long, keys array<bigint>, digest binary, size long, print array<bigint>, hashes array<bigint>"), "prints")
    nodes = durable(prints.groupBy("digest").agg(F.min("id").alias("id")), "nodes")
    prints = prints.join(nodes, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select(F.col("id").alias("node"), "keys", "size", "print", "hashes")
    prints = durable(prints, "node_prints")

    keyed = prints.select(F.explode("keys").alias("key"), "node")
    groups = durable(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "groups")
    members = durable(keyed.join(groups, "key"), "members")
    few = members.where(F.col("n") <= CROWD)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b")
    star = members.where((F.col("n") > CROWD) & (F.col("node") > F.col("least")))
    pairs = pairs.select("a", "b").unionByName(star.select(F.col("least").alias("a"), F.col("node").alias("b"))).distinct()
    most = differing_bits(similarity, 5.0)
    left = prints.select(F.col("node").alias("a"), F.col("print").alias("p"), F.col("size").alias("m"), F.col("hashes").alias("g"))
    right = prints.select(F.col("node").alias("b"), F.col("print").alias("q"), F.col("size").alias("n"), F.col("hashes").alias("h"))
    apart = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    shared = F.size(F.array_intersect("g", "h"))
    alike = F.when(F.least("m", "n") <= SMALL, shared >= similarity * (F.col("m") + F.col("n") - shared) - 1e-9).otherwise(apart <= most)
    likely = (F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-9) & alike
    near = durable(pairs.join(left, "a").join(right, "b").where(likely).select("a", "b"), "near")
    # One check per node first; then the pairs that still lie in different components.
    first = durable(_confirmed(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), None, rows, width, similarity), "first_edges")
    edges = durable(first.unionByName(_confirmed(near, components(first), rows, width, similarity)), "edges")
    named = components(edges)

    # Crowded groups whose nodes are not all connected yet: the fingerprints name the nodes that may still have a link in a pair of
    # tiles, and only these bring their shingle sets there.
    crowded = durable(members.where(F.col("n") > CROWD).select("key", "node", "n"), "crowded")
    crowded = crowded.join(prints.select("node", "size"), "node").join(named, "node", "left").select(
        "key", "node", "n", "size", F.coalesce("component", "node").alias("component"))
    split = crowded.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("size").alias("shingles")).where("low < high")
    open_ = durable(crowded.drop("size").join(durable(split, "split").select("key", "shingles"), "key"), "open")
    # A pair that shares several open keys is compared at the smallest that both nodes list.
    listed = durable(open_.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LISTED).alias("listed")), "listed")
    tiles = F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), tiles).cast("int")
    dealt = open_.select("key", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    dealt = dealt.select("key", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    doubtful = dealt.join(prints.select("node", "size", "print", "hashes").join(listed, "node"), "node").groupBy("key", "i", "j").applyInPandas(
        _doubtful(most, similarity), "key long, i int, j int, own int, node long, component long")
    doubtful = durable(doubtful, "doubtful")
    asked = rows.join(doubtful.select(F.col("node").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "text"])

    def shingled(batches):
        for batch in batches:
            yield frame({"node": batch["id"], "hashes": [shingle_hashes(t, width).view(np.int64) for t in batch["text"]]})

    sets = durable(asked.mapInPandas(shingled, "node long, hashes array<bigint>"), "sets")
    exact = doubtful.join(sets.join(listed, "node"), "node").groupBy("key", "i", "j").applyInPandas(_spanning(similarity), "a long, b long")
    named = components(edges.unionByName(durable(exact, "exact")))
    found = nodes.select("id").join(named, nodes["id"] == named["node"], "left")
    return found.where(F.col("component").isNull() | (F.col("component") == F.col("id"))).select(F.col("id").alias(id_col))


def _across(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """The pairs between different components, which are ``ca`` and ``cb``."""
    one = named.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = named.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    named_pairs = pairs.join(one, "a", "left").join(two, "b", "left").withColumns(
        {"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return named_pairs.where("ca <> cb")


def _confirmed(pairs: DataFrame, named: DataFrame | None, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``a, b``: the pairs across components of ``named`` (without ``named`` all pairs) whose shingle sets really are that similar.

    Only the texts of these pairs travel."""
    open_ = durable(pairs if named is None else _across(pairs, named).select("a", "b"), "uncertain")
    asked = open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = durable(rows.join(asked, "id", "left_semi"), "texts")
    both = open_.join(texts.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")

    def run(batches):
        for batch in batches:
            keep = [jaccard(s, t, width) >= similarity for s, t in zip(batch["s"], batch["t"])]
            yield frame({"a": batch["a"][keep], "b": batch["b"][keep]})

    return both.mapInPandas(run, "a long, b long")


def _shingles(text: str, width: int) -> set:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width))))


def jaccard(one: str, two: str, width: int) -> float:
    """Shared shingles over all shingles; texts with fewer words are one shingle."""
    a, b = _shingles(one, width), _shingles(two, width)
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared)


def _tile(most: int, similarity: float):
    """Compares a pair of tiles by fingerprints, small sets by their ``hashes``."""
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """``a, b``: the pairs of nodes of different components in one pair of tiles that may be links."""
        rows = rows.drop_duplicates("node")
        prints = np.stack(rows["print"].to_numpy()).view(np.uint64)
        size = rows["size"].to_numpy()
        known = "hashes" in rows
        sets = [h if h is not None and k <= SMALL / similarity else () for h, k in zip(rows["hashes"], size)] if known else [()] * len(rows)
        nodes, here, out = rows["node"].to_numpy(), _compared_here(rows), [np.empty((0, 2), dtype=np.int64)]
        for x, near, shared in _meetings(rows, sets, similarity):
            apart = np.bitwise_count(prints[near] ^ prints[x]).sum(axis=1, dtype=np.int64)
            alike = shared[near] >= similarity * (size[near] + size[x] - shared[near]) - 1e-9
            near = near[np.where((np.minimum(size[near], size[x]) <= SMALL) & known, alike, apart <= most)]
            near = near[here(x, near)]
            out.append(np.stack([np.full(len(near), nodes[x]), nodes[near]], axis=1))
        pairs = np.concatenate(out)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})
    return compare


def _meetings(rows: pd.DataFrame, sets: list, similarity: float):
    """``x, near, shared`` for every row ``x`` of a pair of tiles: the rows it is compared with there, of larger nodes, other components and
    a size that allows the similarity, and the number of hashes it shares with each row of the pair."""
    nodes, comps, own, size = (rows[c].to_numpy() for c in ("node", "component", "own", "size"))
    across = rows["i"].iloc[0] != rows["j"].iloc[0]
    # Where each hash occurs, so that shared hashes are counted.
    value = np.concatenate([np.asarray(h, dtype=np.int64) for h in sets])
    holder = np.repeat(np.arange(len(rows)), [len(h) for h in sets])
    order = np.argsort(value, kind="stable")
    value, holder = value[order], holder[order]
    for x in range(len(rows)):
        small, large = np.minimum(size, size[x]), np.maximum(size, size[x])
        other = (comps != comps[x]) & (nodes > nodes[x]) & (small >= similarity * large - 1e-9)
        if across:
            other &= own != own[x]
        near = np.flatnonzero(other)
        if not len(near):
            continue
        shared = np.zeros(len(rows), dtype=np.int64)
        if len(sets[x]):
            lo, hi = np.searchsorted(value, sets[x]), np.searchsorted(value, sets[x], "right")
            n = hi - lo
            shared = np.bincount(holder[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(rows))
        yield x, near, shared


def _compared_here(rows: pd.DataFrame):
    """Of a row and others, with which it shares no smaller key that both list; with those it does, it is compared there."""
    key = rows["key"].iloc[0]
    before = [frozenset(k for k in keys if k < key) for keys in rows["listed"]] if "listed" in rows else [frozenset()] * len(rows)
    return lambda x, others: np.fromiter((before[x].isdisjoint(before[y]) for y in others), dtype=bool, count=len(others))


def _doubtful(most: int, similarity: float):
    """Hands out the rows of a pair of tiles whose nodes may have a link to another component there."""
    tile = _tile(most, similarity)

    def doubt(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = tile(rows)
        found = rows[rows["node"].isin(np.unique(pairs.to_numpy()))].drop_duplicates("node")
        return found[["key", "i", "j", "own", "node", "component"]]
    return doubt


def _spanning(similarity: float):
    """Compares a pair of tiles by whole sets of hashes and hands out links that join all components that its links join."""
    def span(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(h, dtype=np.int64) for h in rows["hashes"]]
        rows = rows.assign(size=[len(h) for h in sets])
        nodes, size = rows["node"].to_numpy(), rows["size"].to_numpy()
        group = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
        here, out = _compared_here(rows), []
        for x, near, shared in _meetings(rows, sets, similarity):
            near = near[(shared[near] / (size[near] + size[x] - shared[near]) >= similarity) & (group[near] != group[x])]
            for y in near[here(x, near)]:
                if group[x] != group[y]:
                    out.append((nodes[x], nodes[y]))
                    group[group == group[y]] = group[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
    return span


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that ``representatives`` names, all columns as they are; of rows that share an id one stays.

    Rows with a null id cannot be named as copies and stay.
    """
    named, unnamed = docs.where(F.col(id_col).isNotNull()), docs.where(F.col(id_col).isNull())
    kept = representatives(named, id_col, text_col, width, similarity)
    return named.join(kept, id_col, "left_semi").dropDuplicates([id_col]).select(docs.columns).unionByName(unnamed)
