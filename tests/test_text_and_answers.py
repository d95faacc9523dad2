import html
import re

import pytest
from pyspark.sql import functions as F

from fewlabel.functions import answers, labels, signals, text
from fewlabel.functions.vectors import arg_max


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("o")).first().o


@pytest.mark.parametrize("raw, want", [
    (" &amp; @a-b http://x\n[URL] ", "& @user http http"),
    ("&lt;b&gt;\tx &amp;amp; y", "<b> x &amp; y"),
    (" https://é.org/ü z ", "http z"),
    ("mail a@b_c!", "mail a@user!"),
    ("", ""),
    (None, None),
])
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def test_clean_text_against_python(spark):
    samples = ["&eacute;t&#233; @x", "no markup", "a\n\tb&nbsp;", "http:// http", "[URL][URL]", "&&amp;;&bogus;"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = [r.o for r in df.orderBy("i").select(text.clean_text("s").alias("o")).collect()]

    def plain(s):
        s = html.unescape(s)
        s = re.sub(r"@[A-Za-z0-9_-]+", "@user", s)
        s = re.sub(r"http\S+", "http", s)
        return s.replace("\n", " ").replace("\t", " ").replace("[URL]", "http").strip()

    assert got == [plain(s) for s in samples]


@pytest.mark.parametrize("raw, lang, want", [
    ("[/INST]no[/INST][/INST]no[/INST nono", "en", 0),
    ("no odioso", "es", 0),
    ("Answer: Yes, because", "en", 1),
    ("The comment is hateful.", "en", 1),
    ("This is hate speech", "en", 1),
    ("does not contain hate", "en", 0),
    ("Respuesta: sí", "es", 1),
    ("si", "es", 1),
    ("enthält nicht", "de", 0),
    ("ANSWER", "en", -1),
    ("", "en", -1),
    ("-no", "en", -1),
    (": no", "en", 0),
    ("perhaps", "en", -1),
    ("Non-hateful", "en", -1),
    ("oui", "fr", 1),
    ("oui", "xx", -1),
])
def test_parse_answer(spark, raw, lang, want):
    df = spark.createDataFrame([(raw, lang)], "t string, l string")
    assert df.select(answers.parse_answer("t", "l").alias("o")).first().o == want


def test_replacements_apply_in_order(spark):
    # "hate" is replaced before "hateful" is looked for, and "si" also inside words
    assert one(spark, "hateful", answers.clean_answer) == "yesful"
    assert one(spark, "basic", answers.clean_answer) == "basíc"


def test_only_text_after_the_last_marker_counts(spark):
    assert one(spark, "Answer: yes\nAnswer: no", lambda c: answers.parse_answer(c, F.lit("en"))) == 0


def test_positive_words_cover_every_language():
    assert "oui" in labels.POSITIVE_WORDS and "hate" in labels.POSITIVE_WORDS


def test_recode_and_project(spark):
    df = spark.createDataFrame([("nothate",), ("hate",), ("1",), ("odd",)], "label string")
    got = [r.o for r in df.select(labels.recode("label", labels.RECODE_HATE_WORD).alias("o")).collect()]
    assert got == [0, 1, 1, None]
    raw = spark.createDataFrame([("t", 1, "x", "train")], "text string, HS int, other string, split string")
    assert labels.project_labelled(raw).columns == ["text", "label", "split"]


def test_signals(spark):
    df = spark.createDataFrame([([0.7, 0.1, 0.2],), ([1.0, 0.0, 0.0],)], "p array<double>")
    rows = df.select(signals.entropy(F.col("p")).alias("e"), signals.exact_entropy("p").alias("x"),
                     signals.margin("p").alias("m"), arg_max("p").alias("a")).collect()
    assert abs(rows[0].e - 0.801819) < 1e-5 and abs(rows[0].m - 0.5) < 1e-12 and rows[0].a == 0
    assert rows[1].x == 0 and rows[1].m == 1


def test_unique_tokens(spark):
    assert one(spark, " A a\nb  B c ", signals.unique_tokens) == 3
