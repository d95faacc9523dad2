"""Label recoding and the label words of each language."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recode(c, mapping: dict) -> Column:
    """Value map; a value that is not listed stays as it is only if it is already 0 or 1."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(str(x)) if i % 2 == 0 else F.lit(int(x))
                           for i, x in enumerate(chain(*mapping.items()))])
    key = c.cast("string")
    return F.coalesce(table[key], F.when(key.isin("0", "1"), key.cast("int"))).cast("int")


def contains_word(c, word: str) -> Column:
    return F.contains(F.col(c), F.lit(word)).cast("int")


def equals_word(c, word: str) -> Column:
    return (F.col(c) == F.lit(word)).cast("int")


# The recodings of the raw sources.
RECODE_HATE_WORD = {"hate": 1, "nothate": 0}
RECODE_FOUR_CLASS = {"hateful": 1, "abusive": 0, "normal": 0, "spam": 0}
RECODE_THREE_CLASS = {0: 1, 1: 1, 2: 0}
LABEL_COLUMNS = ["label_hate_maj", "hatespeech_comb", "HS", "hs"]

# The names of the languages used in prompts.
LANGUAGE_NAMES = {
    "es": "Spanish",
    "en": "English",
    "fr": "French",
    "it": "Italian",
    "pt": "Portuguese",
    "hi": "Hindi",
    "tr": "Turkish",
    "ar": "Arabic",
    "de": "German",
}

# The instruction put before a text and the words for labels 0 and 1.
INSTRUCTIONS = {
    "en": "Is this comment hateful?",
    "es": "¿Es este comentario de odio?",
    "hi": "क्या यह टिप्पणी घृणास्पद है?",
    "it": "Questo commento è offensivo?",
    "de": "Ist dieser Kommentar hasserfüllt?",
    "ar": "هل هذا التعليق يحض على الكراهية؟",
    "tr": "Bu yorum nefret dolu mu?",
    "pt": "Este comentário é odioso?",
    "fr": "Ce commentaire est-il haineux?",
}
LABEL_WORDS = {
    "en": ("no", "yes"),
    "es": ("no", "sí"),
    "hi": ("नहीं", "हाँ"),
    "it": ("no", "sì"),
    "de": ("nein", "ja"),
    "ar": ("لا", "نعم"),
    "tr": ("hayır", "evet"),
    "pt": ("não", "sim"),
    "fr": ("non", "oui"),
}


def project_labelled(df: DataFrame, text: str = "text") -> DataFrame:
    """Rename the label column of a raw source and keep text, label and, where given, split."""
    present = [c for c in ["label", *LABEL_COLUMNS] if c in df.columns]
    if not present:
        raise ValueError("no label column")
    keep = [F.col(text).alias("text"), F.col(present[0]).alias("label")]
    return df.select(*keep, *[c for c in ("split",) if c in df.columns])


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*d.items())])


def by_language(d: dict, lang, fallback: str = "en") -> Column:
    """Look a language up in a fixed table; languages without an entry use ``fallback``."""
    return F.coalesce(literal_map(d)[F.col(lang) if isinstance(lang, str) else lang],
                      F.lit(d[fallback]))


def verbalise(text, label, lang) -> tuple[Column, Column]:
    """(instruction + text, label word) in the language of the row."""
    no = by_language({k: v[0] for k, v in LABEL_WORDS.items()}, lang)
    yes = by_language({k: v[1] for k, v in LABEL_WORDS.items()}, lang)
    return (F.concat_ws(" ", by_language(INSTRUCTIONS, lang), F.col(text)),
            F.when(F.col(label) == 1, yes).otherwise(no))


def positive_word(c) -> Column:
    """1 when a decoded answer is a positive label word of any language, else 0."""
    from fewlabel.functions.text import strip
    return F.lower(strip(c)).isin(*POSITIVE_WORDS).cast("int")


POSITIVE_WORDS = sorted({w[1] for w in LABEL_WORDS.values()} | {"hate"})
