"""Few-shot selection, prompt rendering and the batch of prompts still to run."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.labels import LABEL_WORDS, LANGUAGE_NAMES, by_language
from fewlabel.functions.ordering import hash_key, top_per_group

# Prompt variants, shot numbers and evaluated splits.
ZERO_SHOT = ["general", "classification", "definition", "cot", "multilingual", "nli", "sole", "role_play",
             "multilingual_definition", "role_play_cot", "multilingual_cot", "explanation_based",
             "target_identification", "contextual_analysis", "cot-2", "translate_then_classify", "distinction"]
FEW_SHOT = ["few_shot", "few_shot_cot", "few_shot_role_play", "few_shot_sole", "few_shot_multilingual",
            "few_shot_definition"]
SHOTS = [1, 3, 5, 10, 25, 50]
SPLITS = ["test", "hate_check", "hate_day"]

# Templates in neutral wording of our own. Placeholders: text, yn1, yn2, language, examples.
_ASK = "Reply with {yn1} or {yn2}.\nText: {text}\nAnswer:"
TEMPLATES = {
    "general": "Is the text below hateful? " + _ASK,
    "classification": "Sort the text below into hateful or not hateful. " + _ASK,
    "definition": "Hateful means attacking people for who they are. Is the text hateful? " + _ASK,
    "cot": "Think step by step, then say whether the text is hateful. " + _ASK,
    "cot-2": "List your reasons, then say whether the text is hateful. " + _ASK,
    "multilingual": "The text is in {language}. Is it hateful? " + _ASK,
    "nli": "Does the text entail that its author is hateful? " + _ASK,
    "sole": _ASK,
    "role_play": "You moderate a forum. Would you remove the text as hateful? " + _ASK,
    "multilingual_definition": "The text is in {language}. Hateful means attacking people for who they are. " + _ASK,
    "role_play_cot": "You moderate a forum. Think step by step about the text. " + _ASK,
    "multilingual_cot": "The text is in {language}. Think step by step. " + _ASK,
    "explanation_based": "Explain the tone of the text, then judge whether it is hateful. " + _ASK,
    "target_identification": "Name whom the text addresses, then judge whether it is hateful. " + _ASK,
    "contextual_analysis": "Consider the context of the text. Is it hateful? " + _ASK,
    "translate_then_classify": "Translate the text from {language} to English, then judge it. " + _ASK,
    "distinction": "Tell rude from hateful. Is the text hateful? " + _ASK,
    "few_shot": "Examples:\n{examples}\n" + _ASK,
    "few_shot_cot": "Examples:\n{examples}\nThink step by step. " + _ASK,
    "few_shot_role_play": "You moderate a forum. Examples:\n{examples}\n" + _ASK,
    "few_shot_sole": "{examples}\n" + _ASK,
    "few_shot_multilingual": "The text is in {language}. Examples:\n{examples}\n" + _ASK,
    "few_shot_definition": "Hateful means attacking people for who they are. Examples:\n{examples}\n" + _ASK,
}

# Chat formats around an instruction, by model key.
CHAT_FORMATS = {
    "mt0": "Input: {instruction}\nOutput:",
    "aya101": "Human: {instruction}\n\nnohuman:",
    "aya23": "Human: {instruction}\n\nnohuman:",
    "aya8": "Human: {instruction}\n\nnohuman:",
    "bloomz": "{instruction}",
    "mistral": "<s>[INST] {instruction} [/INST]",
    "mistral8": "<s>[INST] {instruction} [/INST]",
    "llama2": "[INST] {instruction} [/INST]",
    "llama3": "[INST] {instruction} [/INST]",
    "llama3-abliterated": "[INST] {instruction} [/INST]",
    "gemma": "<start_of_turn>\n{instruction}<end_of_turn>\n<start_of_turn>",
    "gemma9": "<start_of_turn>\n{instruction}<end_of_turn>\n<start_of_turn>",
    "teuken": "System: translate_to\nUser: {instruction}\nAssistant:",
    "qwan": "{instruction}",
}


def chat_format(model_name: str) -> str:
    """The format of the longest key contained in the model name."""
    keys = [k for k in CHAT_FORMATS if k in model_name.lower()]
    if not keys:
        raise ValueError(f"no chat format for {model_name}")
    return CHAT_FORMATS[max(keys, key=len)]


def chat_wrap(prompt: Column, model_name: str, lang: Column) -> Column:
    shell = F.replace(F.lit(chat_format(model_name)), F.lit("translate_to"), by_language(LANGUAGE_NAMES, lang))
    return F.replace(shell, F.lit("{instruction}"), prompt)


def few_shot_select(hits: DataFrame, shots: int | Sequence[int], order: Sequence = ("position",),
                    query: str = "query_id", label: str = "label") -> DataFrame:
    """The first rows of each class per query, cut to the smaller class and interleaved
    0, 1, 0, 1; ``shot_pos`` is the place in the prompt.

    Several shot numbers share one ranking and come back with a ``shots`` column.
    """
    from pyspark.sql import Window
    most = shots if isinstance(shots, int) else max(shots)
    best = top_per_group(hits.where(F.col(label).isin(0, 1)), [query, label], order, most, "_place")
    w = Window.partitionBy(query)  # at most 2 * shots rows per query are left
    for v in (0, 1):
        best = best.withColumn(f"_n{v}", F.count(F.when(F.col(label) == v, 1)).over(w))
    limit = F.least("_n0", "_n1")
    if not isinstance(shots, int):
        best = best.withColumn("shots", F.explode(F.array(*[F.lit(n) for n in shots])))
        limit = F.least("_n0", "_n1", "shots")
    return (best.where(F.col("_place") <= limit)
            .withColumn("shot_pos", ((F.col("_place") - 1) * 2 + F.col(label) + 1).cast("int"))
            .drop("_place", "_n0", "_n1"))


def example_lists(selected: DataFrame, keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """One row per query (and shot number) with its ordered (text, label) examples."""
    packed = F.sort_array(F.collect_list(F.struct("shot_pos", "text", "label")))
    return selected.groupBy(*keys).agg(packed.alias("examples"))


def attach_examples(rows: DataFrame, examples: DataFrame, keys: Sequence[str], missing: str = "raise") -> DataFrame:
    """Every row of ``rows`` with its ``examples``.

    A row without examples is an error (``missing="raise"``), or keeps none (``"keep"``); it is never dropped.
    """
    if missing not in ("raise", "keep"):
        raise ValueError(f"unknown rule for missing examples: {missing}")
    out = rows.join(examples, list(keys), "left")
    if missing == "raise":
        key = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
        out = out.withColumn("examples", F.coalesce("examples", F.raise_error(F.concat(F.lit("no examples for "), key))))
    return out


def few_shot_batch(rows: DataFrame, examples: DataFrame, model: str, variants: Sequence[str], shots: Sequence[int], key: str = "query_id",
                   splits: Sequence[str] = tuple(SPLITS), missing: str = "raise") -> DataFrame:
    """The planned prompts of every row in the wanted ``splits``, per variant and number of shots, with the examples of the row."""
    wanted = rows.where(F.col("split").isin(list(splits)))
    return attach_examples(prompt_plan(wanted, model, variants, shots), examples, [key, "shots"], missing)


def format_examples(examples) -> Column:
    """Fixed format of the example block."""
    examples = F.col(examples) if isinstance(examples, str) else examples
    line = lambda e: F.concat(F.lit('Comment: "'), e["text"], F.lit('\t"Answer: '),
                              F.when(e["label"] == 1, "yes").otherwise("no"))
    return F.array_join(F.transform(examples, line), "\n")


def render(variant: Column, text: Column, lang: Column, key: Column, examples: Column | None = None,
           translate: bool = False) -> Column:
    """Fill the template of the row's variant.

    The template is cut at ``{text}`` and the other placeholders are filled in the pieces, so
    braces inside user texts are never expanded. The order of the two options is a property
    of the row key. A few-shot row whose examples are null, as ``attach_examples`` may keep it, has no prompt.
    """
    table = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    words_lang = lang if translate else F.lit("en")
    no = by_language({k: v[0] for k, v in LABEL_WORDS.items()}, words_lang)
    yes = by_language({k: v[1] for k, v in LABEL_WORDS.items()}, words_lang)
    yes_first = F.substring(F.md5(F.concat(key, F.lit("-yn"))), 1, 1) < F.lit("8")
    fills = [("{yn1}", F.when(yes_first, yes).otherwise(no)),
             ("{yn2}", F.when(yes_first, no).otherwise(yes)),
             ("{language}", by_language(LANGUAGE_NAMES, lang)),
             ("{examples}", examples if examples is not None else F.lit(""))]

    def fill(piece):
        return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), kv[1]), fills, piece)

    pieces = F.transform(F.split(table[variant], r"\{text\}"), fill)
    prompt = F.call_function("array_join", pieces, text)
    if examples is None:
        needs = F.contains(variant, F.lit("few_shot"))
        return F.when(needs, F.raise_error(F.lit("few-shot variants need examples"))).otherwise(prompt)
    few = F.contains(variant, F.lit("few_shot"))
    return (F.when(few & (examples == ""), F.raise_error(F.lit("few-shot variants need examples")))
            .when(few & examples.isNull(), F.lit(None)).otherwise(prompt))


def length_budget(variant: Column, shots: Column | None = None, configured: int = 0) -> Column:
    """Token budget of a prompt. Fixed rules."""
    cot = F.contains(variant, F.lit("cot"))
    if shots is None:
        return F.when(cot | F.contains(variant, F.lit("distinction")), configured or 1024).otherwise(256)
    factor = F.lit(2)
    for bound in (5, 10, 25, 50):
        factor = factor * F.when(shots >= bound, 2).otherwise(1)
    return F.when(cot, configured or 512).otherwise(256) * factor


def prompt_plan(rows: DataFrame, model: str, variants: Sequence[str], shots: Sequence[int] | None = None,
                rounds: int = 1) -> DataFrame:
    """Every (row, variant, shots, round) to be prompted, with its budget."""
    out = rows.withColumn("model", F.lit(model)).withColumn(
        "variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    if shots:
        out = out.withColumn("shots", F.explode(F.array(*[F.lit(s) for s in shots])))
    out = out.withColumn("round", F.explode(F.array(*[F.lit(r) for r in range(rounds)])))
    return out.withColumn("max_length", length_budget(
        F.col("variant"), F.col("shots") if shots else None).cast("int"))


def pending(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned rows without a finished run."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")
