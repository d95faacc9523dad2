"""Conversation prefix trie by bursting: containers of suffixes under trie heads, burst by the next turn, then sorted and swept."""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fewlabel.functions.ordering import rank_in_group
from fewlabel.llm.common import frame, text_of
from fewlabel.session import durable

CONTAINER_TURNS = 4096  # turns that a container may hold before it bursts
PIECE = 256  # ids of equal conversations hashed as one row
CHUNK = 4096  # turns of one path summed at a time

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_conv long")


def words_in(text: Column) -> Column:
    """How many runs of other characters than a blank or U+0009 to U+000D there are."""
    spaced = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    return F.when(spaced == "", 0).otherwise(F.length(spaced) - F.length(F.translate(spaced, " ", "")) + 1).cast("long")


def turn_table(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn, words``: turns numbered from 1 by ``turn`` (null first), role and text.

    ``turn`` becomes a 128-bit digest of role and text, nulls being empty. Positions come from range partitions and offsets,
    so one conversation may hold any share of the rows.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), text_of("role").alias("role"), text_of("text").alias("text"))
    placed = rank_in_group(rows, ["conv_id"], [F.col("at").asc_nulls_first(), "role", "text"], "pos")
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    return durable(placed.select("conv_id", "pos", digest.alias("turn"), words_in(F.col("text")).alias("words")), "turns")


def rebuild(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: ``(conversations: conv_id, length; turns: conv_id, pos, turn, words)``.

    The first h turns of conversation c come from conversation c - c % ``group``, the rest from c after its own first h,
    with h = crc32(c) % ``heads``. A conversation opens at most ``group`` others, by at most ``heads`` - 1 turns each.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select(
        "conv_id", "own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    first = (turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("opening"))
             .withColumnRenamed("conv_id", "base"))
    opening = F.coalesce(F.filter("opening", lambda t: t["pos"] <= F.col("h")), F.expr("array()").cast("array<struct<pos:long,turn:binary,words:long>>"))
    convs = durable(convs.join(first, "base", "left").select("conv_id", "own", "h", opening.alias("opening")), "openings")
    shift = F.size("opening").cast("long")
    lengths = convs.select("conv_id", (shift + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("length"))
    opened = convs.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.pos", "t.turn", "t.words")
    rest = (turns.join(convs.select("conv_id", "h", shift.alias("shift")), "conv_id").where("pos > h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "turn", "words"))
    return lengths, durable(opened.unionByName(rest), "rebuilt")


def distinct_sequences(lengths: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, rep, copies, length``: equal conversations share the smallest id as ``rep``.

    A sequence is known by its length and a 128-bit digest over its (position, turn) pairs, counted by partial aggregation.
    """
    mark = lambda salt: F.bit_xor(F.xxhash64("pos", "turn", F.lit(salt)))
    digests = turns.groupBy("conv_id").agg(mark(1).alias("x"), mark(2).alias("y"))
    known = durable(lengths.join(digests, "conv_id", "left").select(
        "conv_id", "length", F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y")), "digests")
    reps = known.groupBy("length", "x", "y").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return durable(known.join(reps, ["length", "x", "y"]).select("conv_id", "rep", "copies", "length"), "sequences")


def end_hashes(sequences: DataFrame) -> DataFrame:
    """``end_conv, ends_sha256``: the digest of the ascending, comma-joined ids of the conversations equal to ``end_conv``.

    Ids are sorted over all tasks and joined in pieces; one task per group then only feeds pieces to the digest, in order.
    """
    alone = sequences.where("copies = 1").select(F.col("rep").alias("end_conv"), F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))
    many = sequences.where("copies > 1").select("rep", "conv_id")

    def pieces(batches):
        for b in batches:
            out = {"rep": [], "first": [], "ids": []}
            run = b.groupby("rep").cumcount() // PIECE
            for (rep, _), ids in b.groupby(["rep", run], sort=False)["conv_id"]:
                out["rep"].append(rep)
                out["first"].append(ids.iloc[0])
                out["ids"].append(",".join(map(str, ids.tolist())))
            yield frame(out)

    def digests(batches):
        last, digest = None, None
        for b in batches:
            out = []
            for rep, ids in zip(b["rep"].tolist(), b["ids"].tolist()):
                if rep == last:
                    digest.update(b"," + ids.encode())
                else:
                    out += [(last, digest.hexdigest())] if digest else []
                    last, digest = rep, hashlib.sha256(ids.encode())
            yield frame({"end_conv": pd.Series([o[0] for o in out], dtype="int64"), "ends_sha256": [o[1] for o in out]})
        if digest:
            yield frame({"end_conv": pd.Series([last], dtype="int64"), "ends_sha256": [digest.hexdigest()]})

    joined = (many.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
              .mapInPandas(pieces, "rep long, first long, ids string"))
    streamed = joined.repartition("rep").sortWithinPartitions("rep", "first").mapInPandas(digests, "end_conv long, ends_sha256 string")
    return durable(alone.unionByName(streamed), "ends")


def _sweep_one(head: int, depth: int, paths: list) -> list[list]:
    """The nodes below one head: ``paths`` are ``(turns, rep, copies, words)``; the head's own sums come first, with depth as given.

    Suffixes are sorted, so equal openings are neighbours, and one pass with a stack of open nodes makes every node once.
    """
    # conv, depth, parent's place, convs, children, leaves, saved, end, words
    nodes = [[head, depth, None, 0, 0, 0, 0, None, 0]]
    stack, last = [0], []

    def close(to: int):
        while len(stack) > to:
            own = nodes[stack.pop()]
            own[5] = own[5] or 1
            own[6] += (own[3] - 1) * own[8]
            up = nodes[own[2]]
            up[0] = min(up[0], own[0])
            up[3] += own[3]
            up[4] += 1
            up[5] += own[5]
            up[6] += own[6]

    for turns, rep, copies, words in sorted(paths):
        same = 0
        while same < len(last) and turns[same] == last[same]:  # a shorter equal opening sorts first
            same += 1
        close(same + 1)
        for i in range(same, len(turns)):
            nodes.append([rep, depth + i + 1, stack[-1], 0, 0, 0, 0, None, words[i]])
            stack.append(len(nodes) - 1)
        own = nodes[stack[-1]]
        own[3], own[7] = copies, rep
        last = turns
    close(1)
    return nodes


def sweep(rows: DataFrame) -> DataFrame:
    """All nodes below the heads of closed containers, and a row for each head (``n_convs`` null) with the sums below it."""
    columns = [c.split()[0] for c in NODE.split(", ")]

    def run(batches):
        key, paths, out = None, [], []

        def finish():
            nodes = _sweep_one(*key, paths)
            out.append((*key, None, None, nodes[0][4], nodes[0][5], nodes[0][6], None))
            out.extend((n[0], n[1], key[0] if n[2] == 0 else nodes[n[2]][0], *n[3:8]) for n in nodes[1:])

        for b in batches:
            for head, depth, rep, turn, words, copies in zip(*(b[c].tolist() for c in ("head", "depth", "rep", "turn", "words", "copies"))):
                if (head, depth) != key:
                    if key:
                        finish()
                    key, paths = (head, depth), []
                if not paths or paths[-1][1] != rep:
                    paths.append(([], rep, copies, []))
                paths[-1][0].append(turn)
                paths[-1][3].append(words)
            yield frame({c: pd.Series([o[i] for o in out], dtype="Int64") for i, c in enumerate(columns)})
            out.clear()
        if key:
            finish()
            yield frame({c: pd.Series([o[i] for o in out], dtype="Int64") for i, c in enumerate(columns)})

    return rows.repartition("head", "depth").sortWithinPartitions("head", "depth", "rep", "pos").mapInPandas(run, NODE)


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One round over oversized containers: ``(path, kids, open, closed)``.

    ``path`` has the nodes that all of a container's suffixes share before they part, whatever their number; ``kids`` the
    heads made by the turn at which they part; the suffixes below those heads are ``open`` where more than ``limit``
    turns are left, else ``closed``. A suffix that parts from nothing is a path to its end.
    """
    at = (rows.groupBy("head", "depth", "pos")
          .agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count(F.lit(1)).alias("here"), F.min("rep").alias("conv_id"),
               F.sum("copies").alias("n_convs"), F.max("words").alias("words"), F.min(F.when(F.col("length") == F.col("pos"), F.col("rep"))).alias("end_conv")))
    at = durable(at, "levels")
    all_ = at.where("pos = depth + 1").select("head", "depth", F.col("here").alias("members"))
    part = (at.join(all_, ["head", "depth"]).groupBy("head", "depth")
            .agg(F.coalesce(F.min(F.when((F.col("low") != F.col("high")) | (F.col("here") < F.col("members")), F.col("pos"))),
                            F.max("pos") + 1).alias("parts")))
    part = durable(part, "parts")
    path = at.join(part, ["head", "depth"]).where("pos < parts").select("head", "depth", "pos", "parts", "conv_id", "n_convs", "words", "end_conv")
    path = durable(path, "path")
    ends = rows.join(part, ["head", "depth"]).where("pos = parts")
    kids = (ends.groupBy("head", "depth", "pos", "turn")
            .agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.max("words").alias("words"),
                 F.min(F.when(F.col("length") == F.col("pos"), F.col("rep"))).alias("end_conv"), F.sum(F.col("length") - F.col("pos")).alias("left")))
    kids = durable(kids, "kids")
    moved = (ends.select("head", "depth", "pos", "turn", "rep")
             .join(kids.select("head", "depth", "pos", "turn", "conv_id", "left"), ["head", "depth", "pos", "turn"])
             .select("rep", F.col("conv_id").alias("to"), F.col("pos").alias("to_depth"), "left"))
    below = rows.join(moved, "rep").where("pos > to_depth").select(
        F.col("to").alias("head"), F.col("to_depth").alias("depth"), "rep", "pos", "turn", "words", "copies", "length", (F.col("left") > limit).alias("open"))
    below = durable(below, "below")
    return path, kids, below.where("open").drop("open"), below.where("NOT open").drop("open")


def _suffix_sums(path: DataFrame) -> DataFrame:
    """``path`` with ``onward``: what its nodes from each on save. Long paths are summed in chunks, then over the chunks."""
    own = path.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    later = Window.partitionBy("head", "depth").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy("head", "depth", "chunk").agg(F.sum("own").alias("all")).select(
        "head", "depth", "chunk", F.coalesce(F.sum("all").over(later), F.lit(0)).alias("later"))
    inside = Window.partitionBy("head", "depth", "chunk").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return (own.withColumn("inside", F.sum("own").over(inside)).join(chunks, ["head", "depth", "chunk"])
            .withColumn("onward", F.col("inside") + F.col("later")).drop("chunk", "inside", "later", "own"))


def trie(lengths: DataFrame, turns: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the prefix trie of conversations (``lengths``: ``conv_id, length``; ``turns``: ``conv_id, pos, turn, words``).

    A node is known by its smallest member and its depth. Equal conversations are one sequence with a count. The root's
    container bursts by the next turn, and so does every container of more than ``container_turns`` turns; a turn that a
    whole container shares is one node of a path, so a round goes as deep as its suffixes agree, and the rounds are as many
    as oversized containers part in turn on the way down. Containers that fit are dealt to tasks, sorted and swept into
    nodes. At last the sums go up, one round of heads at a time. Only counts and whether a container is open reach the driver.
    """
    sequences = distinct_sequences(lengths, turns)
    reps = sequences.where("conv_id = rep").select("rep", "copies", "length")
    top = reps.agg(F.min("rep").alias("head"), F.sum("copies").alias("n"), F.min(F.when(F.col("length") == 0, F.col("rep"))).alias("end"),
                   F.sum("length").alias("left")).first()
    spark = turns.sparkSession
    if top["head"] is None:
        return spark.createDataFrame([], NODE.replace("end_conv long", "ends_sha256 string"))
    rows = durable(turns.withColumnRenamed("conv_id", "rep").join(reps, "rep")
                   .select(F.lit(top["head"]).alias("head"), F.lit(0).cast("long").alias("depth"), "rep", "pos", "turn", "words", "copies", "length"), "suffixes")
    closed, rounds = [], []
    if top["left"] <= container_turns:
        closed.append(rows)
    else:
        while not rows.isEmpty():
            path, kids, rows, done = burst(rows, container_turns)
            rounds.append((path, kids))
            closed.append(done)
    swept = durable(sweep(reduce(DataFrame.unionByName, closed)), "swept")
    nodes = [swept.where("n_convs IS NOT NULL")]
    below = swept.where("n_convs IS NULL").select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")

    def with_sums(heads):
        return heads.join(below, ["conv_id", "depth"], "left").withColumns({
            "n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.coalesce("n_leaves", F.lit(1)),
            "saved_tokens": F.coalesce("saved_tokens", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")})

    for path, kids in reversed(rounds):
        last = path.where("pos = parts - 1").select("head", "depth", F.col("conv_id").alias("up"))
        kids = with_sums(kids.select("head", F.col("depth").alias("from"), F.col("pos").alias("depth"), "conv_id", "n_convs", "words", "end_conv"))
        kids = (kids.join(last.withColumnRenamed("depth", "from"), ["head", "from"], "left")
                .withColumn("parent_conv_id", F.coalesce("up", "head")))
        kids = durable(kids, "kids-summed")
        under = kids.groupBy("head", F.col("from").alias("depth")).agg(
            F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        under = durable(under, "under")
        path = _suffix_sums(path).join(under, ["head", "depth"], "left").select(
            "head", F.col("depth").alias("from"), "conv_id", F.col("pos").alias("depth"),
            F.when(F.col("pos") == F.col("depth") + 1, F.col("head")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(F.col("pos") < F.col("parts") - 1, 1).otherwise(F.coalesce("kids", F.lit(0))).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + F.col("onward")).alias("saved_tokens"), "end_conv")
        path = durable(path, "path-summed")
        start = path.where("depth = from + 1").select(F.col("head").alias("conv_id"), F.col("from").alias("depth"), F.lit(1).cast("long").alias("n_children"),
                                                      "n_leaves", "saved_tokens")
        bare = under.join(start.select(F.col("conv_id").alias("head"), "depth"), ["head", "depth"], "left_anti").select(
            F.col("head").alias("conv_id"), "depth", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
        below = durable(below.unionByName(start).unionByName(bare), "sums")
        columns = nodes[0].columns
        nodes += [kids.select(columns), path.select(columns)]
    root = with_sums(spark.createDataFrame([(top["head"], 0, None, top["n"], top["end"], 0)],
                                           "conv_id long, depth long, parent_conv_id long, n_convs long, end_conv long, words long"))
    nodes.append(root.select(nodes[0].columns))
    nothing = hashlib.sha256(b"").hexdigest()
    return (reduce(DataFrame.unionByName, nodes).join(end_hashes(sequences), "end_conv", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))).drop("end_conv"))


def prefix_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for every node of the
    trie of the rebuilt conversations (``rebuild``).

    Rows without ``conv_id`` belong to no conversation and take no part; null roles and texts are empty; turns with one
    number follow role and text, so repeated rows are repeated turns. An empty table has no nodes, not even a root.
    """
    lengths, turns = rebuild(turn_table(conversations))
    return trie(lengths, turns, container_turns)
