"""Fingerprints, links, components, shared passages and benchmark leaks against plain Python."""

import random
import re

import numpy as np
import pandas as pd
import xxhash

from fewlabel.llm import decontaminate, simhash, spans
from fewlabel.llm.components import components
from tests.llm.conftest import docs


def naive_fingerprint(text, width):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] * bool(words)
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(nodes, edges):
    parent = {n: n for n in nodes}
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_and_components(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("the of and to in is was for on with".split()) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts = base + [b.replace("the", "The", 1) for b in base] + [b + " end" for b in base[:30]] + [None, "", " \t", "One", "one two"]
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts), width=3).collect()}
    prints = [naive_fingerprint(t or "", 3) for t in texts]
    assert [rows[i]["fingerprint"] & (2 ** 64 - 1) for i in range(len(texts))] == prints
    want = roots(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert {i: rows[i]["component_id"] for i in rows} == want


def test_links_are_the_same_for_crowded_blocks(spark):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = {s for seed in seeds for s in [seed] + [seed ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)]}
    signed = sorted(v - 2 ** 64 if v >> 63 else v for v in values)
    want = roots(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2])
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for crowd in (1, 8, 10_000):
        edges = simhash.links(prints, crowd=crowd).collect()
        assert all(((r["a"] ^ r["b"]) & (2 ** 64 - 1)).bit_count() <= 2 for r in edges)
        assert roots(signed, [(r["a"], r["b"]) for r in edges]) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (7, 3), (3, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: r for n, r in roots({x for e in edges for x in e}, edges).items() if n != r}
    assert got == want


def test_bit_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 100):
        rows = rng.integers(0, 2 ** 63, size=(n, 3), dtype=np.uint64)
        want = np.unpackbits(rows.view(np.uint8).reshape(n, 24), axis=1, bitorder="little").sum(axis=0) if n else np.zeros(192)
        assert (simhash.bit_counts(rows) == want).all()


def words(rng, n):
    return [rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(n)]


def test_representatives_follow_exact_similarity(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        own = words(rng, 300)
        texts.append(own)
        for edits in (1, 2, 4):
            copy = list(own)
            for at in rng.sample(range(300), edits):
                copy[at] = "new"
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    texts += [texts[0], texts[0].upper(), "", None, "short text", "short text"]
    got = {r["doc_id"] for r in simhash.representatives(docs(spark, texts)).collect()}
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if simhash.jaccard(texts[i] or "", texts[j] or "", 5) >= 0.8]
    assert got == {i for i, r in roots(range(n), pairs).items() if i == r}


def test_repeated_lines_and_few_shingles_follow_exact_similarity(spark):
    rng = random.Random(5)
    line = " ".join(words(rng, 14))
    texts = [" ".join(words(rng, 300)) + f" {line}" * 60 for _ in range(3)]  # one line rules what occurs, not what differs
    texts += [" ".join(["same"] * 300 + words(rng, 40)) for _ in range(3)]
    for n in (9, 10, 12, 24, 40):
        own = words(rng, n)
        texts += [" ".join(own), " ".join(own[:-1]), " ".join(own + ["more"])]
    own = words(rng, 60)
    texts += [" ".join(own), " ".join(own + own)]
    got = {r["doc_id"] for r in simhash.representatives(docs(spark, texts)).collect()}
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if simhash.jaccard(texts[i], texts[j], 5) >= 0.8]
    assert set(range(6)) <= got == {i for i, r in roots(range(n), pairs).items() if i == r}


def test_crowded_groups_lose_no_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 2)
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(6)
    own = words(rng, 400)
    texts = [" ".join(own[:400 - k]) for k in range(0, 40)]
    assert {r["doc_id"] for r in simhash.representatives(docs(spark, texts)).collect()} == {0}


def test_pairs_at_the_limit_all_meet(spark):
    rng = random.Random(14)
    texts = []
    for _ in range(60):
        own = words(rng, 304)  # 300 shingles, of which 33 change: 267 of 333 are shared
        texts += [" ".join(own), " ".join(words(rng, 33) + own[33:])]
    assert all(0.8 <= simhash.jaccard(a, b, 5) < 0.81 for a, b in zip(texts[::2], texts[1::2]))
    assert {r["doc_id"] for r in simhash.representatives(docs(spark, texts)).collect()} == set(range(0, 120, 2))


def test_a_common_line_is_no_key_of_texts_with_more(spark, monkeypatch):
    rng = random.Random(15)
    line = " ".join(words(rng, 20))
    texts = [" ".join(words(rng, 40)) + " " + line for _ in range(60)]
    rows, real = {}, simhash.durable

    def counted(df, name="step"):
        out = real(df, name)
        rows[name] = out.count()
        return out
    monkeypatch.setattr(simhash, "durable", counted)
    assert simhash.representatives(docs(spark, texts)).count() == 60
    assert rows["crowded"] == 0 and rows["near"] == 0


def test_shingles_of_all_texts_are_counted(spark):
    rows = spark.createDataFrame([(i, f"a b c d {i // 3} e" if i else "") for i in range(24_000)], "id long, text string").repartition(5)
    counts = simhash.shingle_counts(rows, 5)
    hashes = np.concatenate([simhash.shingle_hashes(f"a b c d {i // 3} e" if i else "", 5) for i in range(24_000)])
    shift = np.uint64(64 - int(np.log2(len(counts))))
    assert len(hashes) == 47_998 and (counts == np.bincount((hashes >> shift).astype(np.int64), minlength=len(counts))).all()
    rare, often = simhash.shingle_hashes("a b c d 7 e f", 5)[[0, 2]], simhash.shingle_hashes("a b c d 7", 5)
    both = np.unique(np.concatenate([rare, often]))
    assert set(often.view(np.int64)).isdisjoint(simhash.prefix_keys(both, 0.9, np.where(np.arange(len(counts)) == int(often[0] >> shift), 9, 0)))


def test_tiles_hand_out_every_candidate():
    rng = random.Random(13)
    own = words(rng, 300)
    texts = [" ".join(own[k:k + 200]) for k in range(0, 100, 10)]
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    rows = pd.DataFrame({"key": 0, "i": 0, "j": 0, "own": 0, "node": range(10), "component": [k % 2 for k in range(10)],
                         "size": [len(h) for h in hashes], "print": [simhash.wide_fingerprint(h) for h in hashes]})
    got = {(r.a, r.b) for r in simhash._tile(simhash.differing_bits(0.8, 5.0), 0.8)(rows).itertuples()}
    want = {(a, b) for b in range(10) for a in range(b) if (a - b) % 2 and simhash.jaccard(texts[a], texts[b], 5) >= 0.8}
    assert len(want) > 1 and want <= got


def test_crowded_groups_write_links_not_candidates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 2)
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 2000)
    rng = random.Random(16)
    base, texts = words(rng, 200), []
    for k in range(60):  # pairs on both sides of the limit, most of them below
        own = list(base)
        for at in rng.sample(range(200), 2 if k % 3 == 2 else 3):
            own[at] = words(rng, 1)[0]
        texts.append(" ".join(own))
    pairs = [(i, j) for i in range(60) for j in range(i) if simhash.jaccard(texts[i], texts[j], 5) >= 0.8]
    assert 0 < len(pairs) < 600
    made, real = {}, simhash.durable

    def counted(df, name="step"):
        out = real(df, name)
        made.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(simhash, "durable", counted)
    got = {r["doc_id"] for r in simhash.representatives(docs(spark, texts)).collect()}
    assert got == {i for i, r in roots(range(60), pairs).items() if i == r}
    assert 0 < made["doubtful"][0] and made["exact"][0] < made["doubtful"][0] and "fresh" not in made


def test_odd_copies(odd, empty):
    kept = simhash.keep_representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"]) == [(False, i) for i in (1, 2, 5, 6, 7, 8, 9, 10)]
    assert kept.where("doc_id IS NULL").count() == 1
    assert simhash.keep_representatives(empty).count() == 0
    found = simhash.near_duplicates(odd)
    assert found.count() == odd.count() and simhash.near_duplicates(empty).count() == 0
    assert {r["component_id"] for r in found.where("doc_id IN (2, 3, 4)").collect()} == {2}
    assert {r["doc_id"] for r in simhash.keep_first(odd).collect()} == {1, 2, 5, 6, 7, 8, 9, 10, None}


def edit_distance_within(pattern, text):
    before = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != d)))
        before = now
    return min(before)


def test_bit_parallel_distance():
    rng = random.Random(7)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 100)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 150)))
        assert decontaminate.best_end(decontaminate.masks(p), len(p), t, len(p))[0] == edit_distance_within(p, t)


def test_leaks_against_every_place(spark):
    rng = random.Random(8)
    items = [" ".join(words(rng, 20)) for _ in range(30)] + ["tiny item", "", None]
    texts = []
    for k in range(120):
        parts = words(rng, rng.randint(0, 40))
        if k % 2:
            item = list(items[k % 30])
            for _ in range(rng.randint(0, 16)):
                at = rng.randrange(len(item))
                item[at:at + 1] = rng.choice(["", "q", "zz"])
            parts.insert(rng.randint(0, len(parts)), "".join(item))
        texts.append(" ".join(parts))
    texts += ["A Tiny, item!", "tiny items", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "abc"), (0, items[0])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items[:30]):
            p = decontaminate.plain(item)
            d = edit_distance_within(p, decontaminate.plain(t or ""))
            if d <= decontaminate.budget(len(p)):
                want[i, k] = d
    want[120, 30] = 0
    assert got == want
    few = decontaminate.contamination(docs(spark, texts), bench, block=8)
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in few.collect()} == want
    left = {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), bench).collect()}
    assert left == set(range(len(texts))) - {i for i, _ in want}


def test_odd_leaks(spark, odd, empty):
    bench = spark.createDataFrame([(1, "no id here"), (2, "long long long long long long long long long long")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contamination(odd, bench).collect()} == {8, None}
    kept = decontaminate.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert decontaminate.clean(empty, bench).count() == 0
    assert decontaminate.clean(odd, bench.limit(0)).count() == odd.count()


def passage(rng, n):
    return " ".join(" ".join(words(rng, 9)) + " end." for _ in range(n // 10))


def test_repeated_passages_go_but_the_first(spark):
    rng = random.Random(9)
    shared, brief = passage(rng, 80), passage(rng, 30)
    texts = [f"{passage(rng, 50)}\n{shared}\n{passage(rng, 50)}", f"{passage(rng, 60)} {shared.upper()}  {passage(rng, 40)}",
             passage(rng, 100), shared, f"{brief} {passage(rng, 50)}", f"{passage(rng, 50)} {brief}", f"{shared} x. {shared}"]
    rows = {r["doc_id"]: r for r in spans.drop_repeats(docs(spark, texts)).collect()}
    assert {i for i, r in rows.items() if r["removed"]} == {1, 3, 5, 6}
    assert rows[0]["text"] == texts[0] and rows[3]["text"] == "" and rows[6]["text"].strip() == "x."
    a, b = rows[1]["removed"][0]["start"], rows[1]["removed"][0]["end"]
    assert texts[1][a:b].strip() == shared.upper() and rows[1]["text"] == texts[1][:a] + texts[1][b:]


def plain_repeats(texts, run=25, stretch=50):
    """Per text, which sentences go: by runs that just have ``run`` words, and by stretches of ``stretch`` words."""
    cut = [[x.lower().split() for x in re.split(r"(?<=[.!?])\s+|\s*\n\s*", t) if x.strip()] for t in texts]
    seen_runs, seen_words, out = set(), set(), []
    for sents in cut:
        n, size, gone = len(sents), [len(x) for x in sents], set()
        found = {(i, j) for i in range(n) for j in range(i + 1, n + 1) if sum(size[i:j]) >= run
                 and (sum(size[i:j - 1]) < run or sum(size[i + 1:j]) < run)}
        here = set()
        for i, j in sorted(found):
            key = tuple(" ".join(x) for x in sents[i:j])
            if key in seen_runs or key in here:
                gone |= set(range(i, j))
            here.add(key)
        flat = [(w, k) for k, x in enumerate(sents) for w in x]
        covered, spans_ = [False] * len(flat), set()
        for at in range(len(flat) - stretch + 1):
            key = tuple(w for w, _ in flat[at:at + stretch])
            if key in seen_words or key in spans_:
                covered[at:at + stretch] = [True] * stretch
            spans_.add(key)
        gone |= {k for k in range(n) if all(c for c, (_, m) in zip(covered, flat) if m == k)}
        seen_runs |= here
        seen_words |= spans_
        out.append((n, gone))
    return out


def test_repeats_against_plain_rule(spark):
    rng = random.Random(10)
    pool = [" ".join(words(rng, rng.randint(1, 30))) + "." for _ in range(60)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 3)))
             + " " + " ".join(pool[(a := rng.randrange(50)):a + rng.randint(0, 8)]) for _ in range(80)]
    long = words(rng, 300)
    texts += [" ".join(long[(a := rng.randrange(200)):a + rng.randint(30, 99)]) + ". " + rng.choice(pool) for _ in range(20)]
    # Three equal sentences of fourteen words are two equal runs, so all of them go from the later text.
    few = " ".join(" ".join(words(rng, 14)) + "." for _ in range(3))
    texts += [f"{' '.join(words(rng, 30))}. {few} {' '.join(words(rng, 30))}." for _ in range(2)]
    rows = {r["doc_id"]: r for r in spans.drop_repeats(docs(spark, texts)).collect()}
    for i, (n, gone) in enumerate(plain_repeats(texts)):
        parts = [s for s in re.split(r"((?<=[.!?])\s+|\s*\n\s*)", texts[i])]
        kept = [x.split() for k, x in enumerate([p for p in parts[::2] if p.strip()]) if k not in gone]
        assert rows[i]["sentences"] == n and rows[i]["text"].split() == sum(kept, []), i
    assert len(plain_repeats(texts)[-1][1]) == 3


def test_passages_that_begin_and_end_inside_sentences(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(words(rng, n))
    for head, middle, tail in ((12, (15, 15), 12), (20, (10,), 25), (15, (8, 30), 4), (30, (5, 5), 30)):
        inner = [say(n) + "." for n in middle]
        shared = f"{say(head)}. {' '.join(inner)} {say(tail)}"
        # Both ends are glued to the text around, so that only the middle sentences are whole in both.
        texts = [f"{say(20)}. {say(6)} {shared} {say(6)}. {say(20)}." for _ in range(3)]
        rows = {r["doc_id"]: r for r in spans.drop_repeats(docs(spark, texts)).collect()}
        assert rows[0]["text"] == texts[0]
        for i in (1, 2):
            assert rows[i]["text"] == texts[i].replace(" ".join(inner) + " ", ""), (head, middle, tail)
    short = f"{say(10)}. {say(20)}. {say(10)}"
    texts = [f"{say(6)} {short} {say(6)}." for _ in range(2)] + [f"{say(5)}. {say(6)} {shared} {say(6)} {shared} {say(9)}."]
    rows = {r["doc_id"]: r for r in spans.drop_repeats(docs(spark, texts)).collect()}
    assert [len(rows[i]["removed"]) for i in range(3)] == [0, 0, 1]


def test_odd_repeats(odd, empty):
    rows = spans.drop_repeats(odd).collect()
    assert len(rows) == odd.count() and spans.drop_repeats(empty).count() == 0
    assert all(not r["removed"] for r in rows if r["doc_id"] != 8)


def test_words_are_hashed_once_and_breaks_are_whole_white_space(monkeypatch):
    rng = random.Random(17)
    plain = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
    for _ in range(3000):
        text = "".join(rng.choice("ab. !?\n\t\r\x1c\x85 　Σİ ") for _ in range(rng.randint(0, 40)))
        assert [m.span() for m in spans.BREAK.finditer(text)] == [m.span() for m in plain.finditer(text)], text
        cut = [text[a:b].lower().split() for a, b, _ in spans.sentences(text)]
        assert spans.sentence_words(text) == cut == [p.lower().split() for p in plain.split(text) if p.strip()], text
    hashed, real = [], spans.xxhash.xxh3_64_digest
    monkeypatch.setattr(spans.xxhash, "xxh3_64_digest", lambda w: hashed.append(w) or real(w))
    spans._CODES.clear()
    codes, starts = spans.word_codes([["a", "b", "a"], ["a"]] * 50)
    assert len(hashed) == 2 and len(set(codes.tolist())) == 2 and starts[-1] == len(codes) == 200
