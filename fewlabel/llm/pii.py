"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression, so the scan stays in the JVM and shuffles nothing. A text is searched
once per kind; offsets, checks and context windows are computed only where the pattern hit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import locate, text_of


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``valid`` confirms, ``context`` words within ``WINDOW`` code points raise ``score``.
    A text without ``needs`` cannot match, which is cheaper to see."""
    name: str
    needs: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str = ""


WINDOW = 40
THRESHOLD = 0.5
BOOST = 0.4


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))),
                       lambda i: F.substring(value, i, F.lit(1)))


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled; the digit sum is a multiple of ten."""
    doubled = F.transform(_chars(F.reverse(_digits(value))), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Account number check: country and check digits go last, letters count from ten, the rest mod 97 is one."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    rest = F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
        "^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _always(value: Column) -> Column:
    return F.lit(True)


# The base patterns are written without backtracking: possessive repeats never give up characters the rest
# could use, and a start inside a run is tried only right after a match. They find the same spans. The first
# character is tested before what lies behind it, since most positions fail there.
BASE = (
    Kind("email", "@", r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always, 0.9,
         r"mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", ".", r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, r"\bip\b|host|server|address|adresse"),
    Kind("card", "", r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", luhn, 0.8,
         r"card|visa|credit|karte|tarjeta|carte"),
    Kind("phone", "+", r"\+[0-9][ ().0-9-]+[0-9]", lambda v: F.length(_digits(v)).between(10, 15), 0.7,
         r"phone|call|tel|fax|mobil|llam"),
)
ADDED = (
    Kind("iban", "", r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.8,
         r"iban|account|konto|cuenta|compte"),
    Kind("short_card", "", r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12}+(?![ -]?[0-9])", luhn, 0.3,
         r"card|visa|credit|karte|tarjeta|carte"),
    Kind("national_id", "-", r"(?=[0-9]{3}-)(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _always, 0.3,
         r"ssn|social|tax id|national id|ausweis"),
    Kind("local_phone", "", r"(?=[0-9(])(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", _always, 0.3,
         r"phone|call|tel|fax|mobil|llam"),
)


def _confirmed(kind: Kind, rank: int, text: Column, hits: Column) -> Column:
    def scored(s):
        near = F.lower(F.concat(
            F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW))), F.lit(" "),
            F.substring(text, s["end"] + 1, F.lit(WINDOW))))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), BOOST).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                        F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    spots = F.filter(locate(text, hits, kind.pattern), lambda s: kind.valid(s["value"]))
    return F.filter(F.transform(spots, scored), lambda s: s["score"] >= THRESHOLD)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_col, base, spans``: one row per input row; other columns are left out.

    ``base`` holds the spans of the four base kinds, ``spans`` these and the added kinds that overlap none of
    them; both are ``array<struct<start, rank, end, kind, score>>`` by start, then kind. A null text is the empty
    one, and texts without a hit get empty arrays. Repeated rows are answered once each; whole texts are read.
    """
    rows = docs.select(F.col(id_col), text_of(text_col).alias(text_col))
    text, kinds = F.col(text_col), BASE + ADDED
    none = F.array().cast("array<string>")
    rows = rows.select("*", text.rlike("[0-9]").alias("_digit"))
    rows = rows.select(id_col, text_col, *[
        F.when(text.contains("@") if k.needs == "@" else F.col("_digit") & text.contains(k.needs),
               F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).otherwise(none).alias(f"_hits{i}")
        for i, k in enumerate(kinds)])
    parts = [_confirmed(k, i, text, F.col(f"_hits{i}")) for i, k in enumerate(kinds)]
    rows = rows.select(id_col, text_col, F.array_sort(F.concat(*parts[:len(BASE)])).alias("base"),
                       F.concat(*parts[len(BASE):]).alias("_added"))
    fresh = F.filter("_added", lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return rows.select(id_col, text_col, "base", F.when(F.size("_added") > 0, F.array_sort(F.concat("base", fresh)))
                       .otherwise(F.col("base")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap become one, under the first kind.

    ``spans`` are sorted by start. Texts without spans come back as they are.
    """
    def step(acc, s):
        inside = s["start"] < acc["pos"]
        grown = F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        added = F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.when(inside, grown).otherwise(F.struct(s["end"].alias("pos"), F.concat(acc["out"], added).alias("out")))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs``, all columns as they are, with personal data in ``text_col`` replaced by its kind in brackets.

    Where there is such a column, ``length_col`` gets the new number of code points of a changed text. Null and empty
    texts stay; repeated rows are masked alike.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = find_pii(docs.select(own, F.col(text_col)), "_row", text_col)
    changed = found.select("_row", (F.size("spans") > 0).alias("_hit"), masked(F.col(text_col), F.col("spans")).alias("_masked"))
    columns = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        new = F.col("_masked") if c == text_col else F.length("_masked").cast("long") if c == length_col else None
        columns.append((old if new is None else F.when(F.col("_hit"), new).otherwise(old)).alias(c))
    return changed.select(*columns)
