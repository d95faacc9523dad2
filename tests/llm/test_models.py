"""Pieces, vectors, language model, toxicity, pages and the pipeline against plain Python, and odd rows."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from fewlabel.llm import main_text, maxent, pieces, queries, topk, toxicity
from fewlabel.plans.tables import table
from tests.compare import compare, connect
from tests.llm.conftest import docs

MODEL = queries.PIECE_MODEL


def test_pieces_equal_the_library(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(11)
    bits = list("ab theion ▁  \t\n日é😀.1xX_-") + ["the", " " * 17, " " * 40, "ｘ", "://", "\x00", "<s>", "<0x0A>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [" " * n + "word" for n in range(60)] + ["a" * 3000, "x" + " " * 50_000 + "y", ""]
    texts += [r["text"] for r in table(spark, sf_dir, "documents").select("text").collect()]
    coder = pieces.Pieces.load(open(MODEL, "rb").read())
    for text, ids in zip(texts, coder.encode_batch(texts)):
        want = sp.encode(text)
        assert ids.tolist() == want and coder.decode(want) == sp.decode(want), text[:200]


def test_unigram_words_take_the_best_sum():
    rng = random.Random(12)
    names = sorted({"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(60)} | set("▁abc"))
    scores = [-rng.random() * 5 for _ in names]
    coder = pieces.Pieces(names, scores, {}, 0, merges=False)
    table_ = dict(zip(names, scores))

    def best(word):
        at = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
        for end in range(1, len(word) + 1):
            at[end] = max((at[s][0] + table_[word[s:end]], s) for s in range(end) if word[s:end] in table_)
        return at[-1][0]

    words = ["▁" + "".join(rng.choice("abc▁") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    for word, packed in coder.encode_words(words).items():
        ids = tuple(np.frombuffer(packed, dtype=np.int32).tolist())
        assert "".join(names[i] for i in ids) == word
        assert math.isclose(sum(scores[i] for i in ids), best(word), abs_tol=1e-9)


def test_odd_pieces(odd, empty):
    back = pieces.decode(pieces.encode(odd, MODEL, keep_text=True, verify=True), MODEL).collect()
    assert all(r["round_trip"] for r in back)
    assert len(back) == odd.count() and all(r["decoded"] == r["text"] for r in back)
    assert {len(r["ids"]) for r in back if not r["text"]} == {0}
    assert pieces.encode(empty, MODEL).count() == 0


def test_top_k_sql(spark, sf_dir):
    assert compare(spark, connect(sf_dir), queries.op5, queries.OP5_SQL, sf_dir) is None


def test_top_k_with_ties_nulls_and_blocks(spark):
    rng = random.Random(13)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 3.0]) for _ in range(3)]) for i in range(150)]
    rows += [(150 + i, [1.0, 1.0, 1.0]) for i in range(150)]
    rows += [(400, None), (420, [None, 1.0, 1.0]), (440, [math.nan] * 3), (460, [math.inf] * 3), (480, []), (500, [1.0]), (520, [2.0]), (None, [1.0] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = frame.select("vec_id", topk.integer_vector(F.col("embedding")).alias("vector"), F.lit(1).alias("id"), F.lit(2).alias("v"))
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, a in good:
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))
            for rank, (s, i) in enumerate(found[:20], 1):
                want[q, rank] = (i, -s)
    for block in (32_768, 40):
        got = topk.top_k(whole, whole.where("vec_id % 20 = 0"), block=block, query_block=7 if block == 40 else 32_768).collect()
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(whole.limit(0), whole.limit(0)).count() == 0


def test_language_model(spark):
    rng = random.Random(14)
    north, south = "alpha beta gamma delta epsilon".split(), "uno dos tres cuatro cinco".split()
    texts = [" ".join(rng.choice(own) for _ in range(30)) + f" Rare{i}" for i in range(400) for own in [rng.choice((north, south))]] + [None, "", " \x0b "]
    rows = {r["doc_id"]: r for r in maxent.score(docs(spark, texts)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    split = [(t or "").lower().split() + [None] for t in texts]
    counts = Counter(w for i, ws in enumerate(split) if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in enumerate(split):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(rows[i]["base_score"], base, rel_tol=1e-9)
        assert (rows[i]["held_out"], rows[i]["n_tokens"], rows[i]["n_known"], rows[i]["train_tokens"]) == (
            out[i], len(ws), sum(w in counts for w in ws), n)
        assert rows[i]["score"] <= 0
    unseen = [i for i in out if out[i]]
    assert sum(rows[i]["score"] for i in unseen) > sum(rows[i]["base_score"] for i in unseen)


def test_class_shares_sum_to_one():
    words = [(f"w{i}", 1000 - i) for i in range(300)]
    tail = 50  # words with count one that do not travel
    v = maxent.Vocabulary(words, sum(c for _, c in words) + tail, len(words) + tail)
    shares = [0.0] * v.size.classes
    for (_, c), k in zip(words, v.kinds):
        shares[k] += (c + 0.1) / 10 ** v.mass[k]
    shares[-1] += tail * 1.1 / 10 ** v.mass[-1]
    assert all(math.isclose(s + 0.1 / 10 ** v.mass[k], 1.0) for k, s in enumerate(shares))


def test_language_model_grows_with_the_tokens():
    sizes = [maxent.Size(n) for n in (0, 10, 10 ** 6, 15 * 10 ** 6, 45 * 10 ** 8)]
    for small, large in zip(sizes[1:], sizes[2:]):
        assert (small.buckets, small.classes, small.frequent) < (large.buckets, large.classes, large.frequent)
        assert small.classes < large.classes and small.frequent < large.frequent
    assert (sizes[3].bits, sizes[3].classes) == (15, 18) and (sizes[4].bits, sizes[4].classes) == (20, 26)


def test_odd_language_model(odd, empty):
    rows = maxent.score(odd).collect()
    assert len(rows) == odd.count() and maxent.score(empty).count() == 0
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    twins = [r for r in rows if r["doc_id"] == 6]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_readings_of_disguised_words():
    corpus = ["the idiot moron loser pathetic stupid scum trash and of in ing er on " * 5]
    model = toxicity.log_trigrams(toxicity.trigram_counts(corpus))
    for word, want in {"1d10t": "idiot", "m0r0n": "moron", "l0$er": "loser", "p@thetic": "pathetic", "stuuupid": "stupid", "s.c.u.m": "scum",
                       "tr@sh!!": "trash", "scum###": "scum"}.items():
        assert want in toxicity.readings(word, model), (word, toxicity.readings(word, model))
    assert "idiot" in toxicity.Reader(model).read("you i d i o t there")


def test_readings_of_spaced_and_stretched_words():
    corpus = ["you are a idiot dumb stupid and the of in you a stupid idiot fool " * 5]
    reader = toxicity.Reader(toxicity.log_trigrams(toxicity.trigram_counts(corpus)))
    for text, want in {"an i d i o t.": "idiot", "so d u m b!": "dumb", "a s t u p i d one": "stupid", "y o u i d i o t": "idiot",
                       "i  d  i  o  t": "idiot", "y o u  s t u p i d": "stupid", "1 d 1 o t": "idiot", "f o o": "foo",
                       "st" + "u" * 60 + "pid": "stupid", "y o u a s t u p i d " * 3 + "i d i o t": "idiot",
                       " ".join("youareaidiot" * 5): "idiot", "s-t-u-p-i-d-" * 5: "stupid"}.items():
        assert want in reader.read(text), (text, reader.read(text))


def test_toxicity_of_held_out_rows(spark):
    rng = random.Random(15)
    good = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad, masked = ["idiot", "moron", "scum"], ["1d1ot", "m0ron", "scuuum", "i d i o t"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        words = [rng.choice(good) for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(masked if zlib.crc32(str(i).encode()) % 5 == 0 else bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "idiot")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", toxicity.rating(model).alias("s")).collect()}
    wrong = sum((got[i] >= 0.5) != bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0)
    assert wrong <= 4 and got[1000] == got[1001] < 0.5 <= got[None]
    assert model.names and max(map(len, model.names)) < 30


def test_every_feature_past_the_bound_counts(spark):
    rng = random.Random(16)
    new = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(5000)]
    rows = [(i, f"fine text {i % 7} " + (" ".join(new) if i < 8 else "scum" if i < 60 else "and more")) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 60)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(frame, marks)
    assert set(new) <= set(model.names)
    # Features outside of the fitted rows count too.
    weights = toxicity._with_unseen(np.array([2.0, 0.0]), np.array([4.0, 3.0]), [([0], 1), ([], 0)])
    assert weights.tolist() == [2.0, 1.5]


def test_odd_toxicity(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.keep_clean(empty, none).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many, many, of them, on this site, and more.</p></div>
%s<div id=sidebar><p>Aside from this, there is more, and more, to read, in the side bar.</p></div>
<section class="comments"><p>A reader says, at length, that this is, in a word, wrong, and more words follow here.</p></section>
<form><input name=q><button>Go</button></form><footer><p>&copy; All rights, all wrongs, reserved, by us, for ever.</p></footer></body></html>"""
BODY = ("<h1>Head &amp; <i>tail</i></h1><p>First  paragraph,\n with <b>bold</b> text, and a long enough line.<p>Second one, left open, "
        "with &lt;marks&gt; and<br>a break, and <a href=x>a link</a> too.<script>var x = '</p>';</script><p>Is.<div class=ad>Buy, buy, buy this now please.</div>"
        "loose text at the end, also kept here.")
TEXT = ("Head & tail\n\nFirst paragraph, with bold text, and a long enough line.\n\nSecond one, left open, with <marks> and a break, and a link too."
        "\n\nIs.\n\nloose text at the end, also kept here.")


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class=story>%s</div>", "<div><div id=content>%s</div></div>"])
def test_article_of_a_page(wrap):
    assert main_text.main_text(PAGE % (wrap % BODY)) == TEXT


def test_broken_pages():
    assert main_text.main_text(PAGE % ("<article>" + BODY + "</article>")[:-60])  # cut off
    assert main_text.main_text("") == main_text.main_text("<html><nav><a>x</a></nav>") == ""
    assert main_text.main_text("just text") == "just text"
    assert main_text.main_text("<b>" * 5000 + "deep, deep text in here, really deep" + "</b>" * 10) == "deep, deep text in here, really deep"
    assert main_text.main_text("<article><p>" + "a &amp; b, " * 50_000 + "</article>") == " ".join(["a & b,"] * 50_000)


READ = "<p>" + "Long words of text here, and there, more of it to read, and read. " * 4 + "</p>"
LONG = READ * 3


@pytest.mark.parametrize("body, count", [
    ("<div class='content has-sidebar'>" + LONG + "</div>", 3), ("<div class='post share-enabled'>" + LONG + "</div>", 3),
    ("<div class='sidebar'>" + LONG + "</div>", 3), ("<div class=story>" + LONG + "</div><div class='sidebar-left'>" + READ + "</div>", 3),
    ("<article>" + LONG + "<div class='notice-board-history'>" + READ + "</div></article>", 4),
    ("<article>" + LONG + "</article><article>" + READ + "</article>", 4),
    ("<article>" + LONG + "</article><article class='comment'>" + READ + "</article>", 3),
    ("<article>" + LONG + "<div id='comments'>" + READ * 20 + "</div></article>", 3),
    ("<div>" + LONG + "<div class='post-comments'>" + READ * 20 + "</div></div>", 3),
    ("<div class='ad-box'>" + READ + "</div><div>" + LONG + "</div>", 3),
])
def test_class_words_weigh(body, count):
    """A name in a class drops a part only if the text outside of it can be the article."""
    text = main_text.main_text("<html><body><nav><a href=x>Menu</a></nav>" + body + "<footer>(c)</footer></body></html>")
    assert text == "\n\n".join([" ".join(READ[3:-4].split())] * count)


def test_short_closing_paragraph():
    assert main_text.main_text("<div>" + LONG + "</div><p>The end.</p><p>Tags</p>").endswith("read.\n\nThe end.")


@pytest.mark.parametrize("html", ["<h1>" * 40_000, "<b>" * 40_000 + "</i>" * 40_000, "<!--" * 40_000, "<div class=ad>" * 40_000 + "x", "<p>a" * 40_000])
def test_unclosed_tags_take_linear_time(html):
    start = time.process_time()
    main_text.main_text(html)
    assert time.process_time() - start < 10


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(r["text"] for r in main_text.extract(pages).collect()) == ["", "", "x"]
    assert main_text.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    columns, before = rows.columns, rows.count()
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == columns, name
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert 0.5 * before < len(out) < before and all(r["round_trip"] for r in out.values())
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(out)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_of_odd_rows(spark, odd, empty, sf_dir):
    for start in (odd, empty):
        kept = start
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, sf_dir)
        assert kept.count() == (9 if start is odd else 0)
