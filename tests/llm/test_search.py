"""Ranked search, URL filter and conversation trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fewlabel.llm import prefix_trie, ranked, url_filter

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(plain_terms(t))
    out = []
    for i, asked in terms.items():
        scored = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m))
                    for t in asked if t in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,block_terms,batch", [(3, 200_000, 10_000), (5, 7, 10_000), (4, 200_000, 9), (500, 200_000, 50)])
def test_ranked_search_equals_all_scores(spark, k, block_terms, batch):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)] + ["É", "É9", "the"]
    docs = [(i, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(len(words))], k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(1000 + i, docs[3][1].upper()) for i in range(20)] + [(2000, None), (2001, ""), (2002, " .,- "), (None, "w30 w31 w32"), (7, docs[7][1])]
    docs += [(3000, "w5 " * 90_000 + "É"), (3001, "x" * 300_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(12, None), (13, "nowhere"), (3, "w39 w38"), (None, "W1-w2"), (14, "w1 w1 w1"), (2**60 + 1, "w30, the")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                            spark.createDataFrame(items, "item_id long, text string"), k=k, block_terms=block_terms)
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(docs, items, k)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def test_ranked_search_of_odd_and_empty_tables(spark, odd, empty):
    items = odd.selectExpr("doc_id AS item_id", "text", "score", "word")
    got = ranked.search(odd, items, k=50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert got.where("item_id = 6 AND rank = 1 AND doc_id = 6").count() == 1
    assert got.where("item_id IN (2, 3, 4)").count() == 0
    assert ranked.search(empty, items).count() == 0
    assert ranked.search(odd, empty.selectExpr("doc_id AS item_id", "text")).count() == 0


RULES = [("allow", "com/"), ("block", "bad.com/x"), ("allow", "good.bad.com/x/y"), ("block", "net/es/"), ("block", "evil.org/")]


def page(i, url, html=""):
    return (i, url, html)


def canonical(url):
    return f"<html><head><LINK class=a href='{url}' Rel=\"alternate Canonical\"/></head></html>"


PAGES = [
    page(1, "HTTP://Sub.BAD.com/xyz?q#f"), page(2, "http://good.bad.com/x/y"), page(3, "http://notbad.com/x"), page(4, "http://a.net/es"),
    page(5, "http://a.net/es/1"), page(6, "http://a.com"), page(7, None), page(8, "no address"), page(9, "http://"), page(10, "http://evil.org:80/"),
    # aliases: of a page, over a chain, through a target that is no page, against an allowed member
    page(11, "https://one.org/a", canonical("http://two.org/b?x=1&amp;y=2#top")),
    page(12, "http://two.org/b?x=1&y=2", "<meta content='0; URL=//evil.org/z' http-equiv='Refresh'>"),
    page(13, "http://three.org/c/d", "<base href='http://evil.org/e/'><link rel=canonical href=f>"),
    page(14, "http://four.org/", canonical("http://a.net/es/1")), page(15, "http://four.org/#again"),
    page(16, "http://five.org/", canonical("http://shop.com/")), page(17, "http://six.org/", canonical("http://five.org/")),
    page(18, "http://seven.org/", canonical("http://six.org/") + "<link rel=canonical href='http://evil.org/'>"),
    # nothing that hides in comments, scripts or other links counts
    page(19, "http://eight.org/", "<!-- <link rel=canonical href='http://evil.org/'> --><link rel=icon href='http://evil.org/'>"),
    page(20, "http://nine.org/", "<script>'<link rel=canonical href=\"http://evil.org/\">'</script><meta http-equiv=refresh content=5>"),
    page(21, "http://ten.org/q", "<link rel=canonical href=''><link rel=canonical href='#x'><link rel=canonical href='http://[bad/'>"),
    page(22, "http://" + "." * 5000 + "evil.org/"), page(11, "https://one.org/a", None), page(None, "http://evil.org/"),
    page(23, "http://eleven.org/", "<link " * 20_000 + "<!--" * 20_000 + "canonical"), page(24, "http://twelve.org/"),
]
BLOCKED = {1, 5, 11, 12, 13, 14, 15, 22, None, 24}


def test_url_decisions_reach_aliases(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnsRenamed({})
    jumps = spark.createDataFrame([("http://twelve.org/", "http://one.org/x"), ("http://one.org/x", "https://one.org/a"), (None, "http://evil.org/"),
                                   ("http://nine.org/", None)], "source string, target string")
    got = url_filter.judge(pages, RULES, jumps)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(PAGES)
    assert {r.page_id for r in rows if r.verdict == "block"} == BLOCKED
    seen = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert seen[1] == ("sub.bad.com", "/xyz", "bad.com/x") and seen[2][2] == "good.bad.com/x/y" and seen[3][2] == "com/"
    assert seen[4] == ("a.net", "/es", None) and seen[5][2] == "net/es/" and seen[6] == ("a.com", "", None)
    assert seen[7] == seen[8] == seen[9] == ("", "", None) and seen[10] == ("evil.org:80", "/", None) and seen[11][2] is None


def test_url_rules_from_a_table_and_no_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "action string, rule string")
    assert sorted(url_filter.judge(pages, rules).collect(), key=str) == sorted(url_filter.judge(pages, RULES).collect(), key=str)
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * words
    return sorted(((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in cs if built[c] == p))).encode()).hexdigest()) for p, cs in members.items()), key=str)


def talks(seed):
    """Shared openings, equal and turnless conversations, nested ones, ties, nulls and a long common path."""
    rng = random.Random(seed)
    rows = []
    for c in range(0, 400, 1 + seed % 2):
        kind = rng.random()
        turns = [("system", "be kind  to\tme"), ("user", rng.choice(["hi there", "hello", ""]))] if kind < 0.5 else []
        turns += [(rng.choice("ua"), rng.choice(["yes", "no no", "why so ?", " \n "])) for _ in range(rng.randint(0, 5))]
        if kind > 0.9:
            turns = [("u", f"step {i}") for i in range(60)] + turns[:1]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(40, None, "u", "first"), (40, 1, None, None), (40, 1, "a", "tie"), (40, 1, "a", "tie"), (None, 0, "u", "nobody"), (-21, 0, "u", "a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,limit", [(0, 4096), (1, 100), (2, 12), (3, 1)])
def test_trie_equals_all_prefixes(spark, seed, limit):
    rows = talks(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = prefix_trie.prefix_trie(df, limit).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_trie_of_many_equal_and_no_conversations(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(0, 24_000, 20) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(df, 2).collect()
    assert sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got), key=str) == plain_trie(rows)
    none = prefix_trie.prefix_trie(df.where("conv_id < 0"))
    assert none.count() == 0 and "ends_sha256" in none.columns
