"""Sub-word units of a public vocabulary, counted per text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def unique_pieces(text, model_path: str) -> Column:
    """The number of distinct pieces of a text under the SentencePiece model at ``model_path`` (a path of the driver).

    Whole texts are encoded, one Arrow batch after another; the model's bytes travel with the function (half a megabyte
    for 32 000 pieces) and are opened once per task. A null text has no count, an empty or blank one has zero pieces.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import sentencepiece
        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        for texts in batches:
            yield texts.map(lambda t: len(set(encoder.encode(t, out_type=str))), na_action="ignore").astype("Int64")

    return count(F.col(text) if isinstance(text, str) else text)
