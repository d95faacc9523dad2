"""From a free-text model answer to a label: 1, 0 or -1 (invalid)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fewlabel.functions.labels import LABEL_WORDS, by_language
from fewlabel.functions.text import strip

# Phrases removed from an answer.
PHRASES = [
    "based on", "given", "provided", "inst", "human", "comment", "premise", "context", "information",
    "assistant", "nohuman", "analysis", "note", "context:", "content:", "alone", "the comment is",
    "role", "system", "user", "the post is", " it ", "it is", " is ", "**", "the final answer is",
    "in this case,", "the text is", "the text", "the", "text", "answer", "post",
    "the answer is", " ai ", "final", "this", "case", " in ", " a ", "sentence",
    "la publicación es", "el comentario es", "en este caso, el comentario es", "el texto es", "el texto",
    "a postagem é", "o comentário é", "neste caso, o comentário é", "o texto é", "o texto",
    "il post è", "il commento è", "in questo caso, il commento è", "il testo è", "il testo",
    "le post est", "le commentaire est", "dans ce cas, le commentaire est", "le texte est", "le texte",
    "der Beitrag ist", "der Kommentar ist", "in diesem Fall ist der Kommentar", "der Text ist", "der Text",
    "पोस्ट है", "टिप्पणी है", "इस मामले में, टिप्पणी है", "पाठ है", "पाठ",
    "المنشور هو", "التعليق هو", "في هذه الحالة، التعليق هو", "النص هو", "النص",
    "gönderi şudur", "yorum şudur", "bu durumda, yorum şudur", "metin şudur", "metin",
    "yorum şu şekildedir",
]

# Word replacements, applied in this order.
REPLACEMENTS = [
    ("does not contain", "no"),
    ("not yes", "no"),
    ("not hate speech", "no"),
    ("not hate", "no"),
    ("not hateful", "no"),
    ("non hateful", "no"),
    ("contains", "yes"),
    ("maybe", "yes"),
    ("hate speech", "yes"),
    ("hate", "yes"),
    ("hateful", "yes"),
    ("tal vez", "yes"),
    ("talvez", "yes"),
    ("forse", "yes"),
    ("peut-être", "yes"),
    ("vielleicht", "yes"),
    ("शायद", "yes"),
    ("ربما", "yes"),
    ("belki", "yes"),
    ("no contiene", "no"),
    ("contiene", "sì"),
    ("si", "sí"),
    ("não contém", "não"),
    ("contém", "sim"),
    ("non contiene", "no"),
    ("ne contient pas", "non"),
    ("contient", "oui"),
    ("enthält nicht", "nein"),
    ("enthält", "ja"),
    ("शामिल नहीं है", "नहीं"),
    ("शामिल है", "हां"),
    ("لا يحتوي على", "لا"),
    ("يحتوي على", "نعم"),
    ("içermez", "hayır"),
    ("içerir", "evet"),
]

# Characters turned into blanks, then the delimiters that end the answer.
BLANKED = "*:\"')([]\\/,.;|"
LEADING = ",.:;"
DELIMITERS = ["</s>", ",", ".", "।", "|", "\n", " ", "-", "target", "explanation"]

# Wording of our own: the answer marker and the two class words of each language.
MARKERS = {
    "en": "Answer:", "es": "Respuesta:", "fr": "Réponse:", "it": "Risposta:", "pt": "Resposta:",
    "de": "Antwort:", "hi": "उत्तर:", "tr": "Cevap:", "ar": "الجواب:",
}
HATEFUL = {
    "en": "hateful", "es": "odioso", "fr": "haineux", "it": "odioso", "pt": "odioso",
    "de": "hasserfüllt", "hi": "घृणास्पद", "tr": "nefret dolu", "ar": "كراهية",
}
NOT_HATEFUL = {
    "en": "non-hateful", "es": "no odioso", "fr": "non haineux", "it": "non odioso", "pt": "não odioso",
    "de": "nicht hasserfüllt", "hi": "घृणास्पद नहीं", "tr": "nefret dolu değil", "ar": "غير كراهية",
}


def removal_order(phrases=None) -> list[str]:
    """Lower-cased, longest first, so that a phrase goes before the words it is made of."""
    lowered = {p.lower() for p in (phrases or PHRASES)}
    return sorted(lowered, key=lambda p: (-len(p), p))


def _fold(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered replacements as one fold over a literal array."""
    steps = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in pairs])
    return F.aggregate(steps, text, lambda acc, s: F.replace(acc, s["old"], s["new"]))


def clean_answer(text) -> Column:
    out = F.lower(strip(text))
    out = _fold(out, [(p, "") for p in removal_order()] + REPLACEMENTS)
    out = strip(out)
    out = F.when((F.length(out) > 1) & F.substring(out, 1, 1).isin(*LEADING),
                 strip(F.substring(out, 2, 2**31 - 1))).otherwise(out)
    out = strip(F.translate(out, BLANKED, " " * len(BLANKED)))
    stops = F.array(*[F.lit(d) for d in DELIMITERS])
    out = F.aggregate(stops, out, lambda acc, d: F.split_part(acc, d, F.lit(1)))
    return strip(out)


def after_marker(text: Column, marker: Column) -> Column:
    """What follows the last occurrence of the marker, in either case."""
    return F.split_part(F.split_part(text, marker, F.lit(-1)), F.lower(marker), F.lit(-1))


def unify(text, lang) -> Column:
    """Cut off the echoed prompt and turn the class words into yes and no words."""
    out = F.col(text) if isinstance(text, str) else text
    for code in ("en", None):
        pick = (lambda d: F.lit(d["en"])) if code else (lambda d: by_language(d, lang))
        no, yes = pick({k: v[0] for k, v in LABEL_WORDS.items()}), pick({k: v[1] for k, v in LABEL_WORDS.items()})
        out = after_marker(out, pick(MARKERS))
        out = F.replace(out, pick(NOT_HATEFUL), no)
        out = F.replace(out, pick(HATEFUL), yes)
    return out


def verdict(answer: Column, lang) -> Column:
    """1 for yes, 0 for no, -1 for anything else, from a cleaned answer."""
    yes = by_language({k: v[1] for k, v in LABEL_WORDS.items()}, lang)
    no = by_language({k: v[0] for k, v in LABEL_WORDS.items()}, lang)
    return (F.when((answer == F.lower(yes)) | (answer == "yes"), 1)
            .when((answer == F.lower(no)) | (answer == "no"), 0)
            .otherwise(-1).cast("int"))


def parse_answer(text, lang) -> Column:
    """Raw answer to label; the one-element array makes the cleaning run once per row."""
    return F.transform(F.array(clean_answer(unify(text, lang))), lambda a: verdict(a, lang))[0]


def strip_template(response, template: Column) -> Column:
    """Remove the echoed chat template around an empty instruction."""
    response = F.col(response) if isinstance(response, str) else response
    return F.replace(response, F.replace(template, F.lit("{instruction}"), F.lit("")), F.lit(""))
