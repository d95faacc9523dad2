"""Building the pool table: vectors, signals, optional pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fewlabel.operators.classify import fit, uncertainty_signals
from fewlabel.operators.diversity import mmr_partitioned
from fewlabel.operators.embed import embed
from fewlabel.operators.perplexity import perplexity


def build_pool(df: DataFrame, key: str, text: str = "text", *, vec: str = "embedding", encoder=None,
               add_perplexity: bool = False, add_uncertainty: bool = False,
               mmr_threshold: float | None = None, min_share: float = 0.1, mmr_buckets: int = 16) -> DataFrame:
    """Labelled rows to pool rows. Vectors that are already present are kept as they are. Pruning deals the rows into
    ``mmr_buckets`` buckets and merges four survivors' sets at a time, as far as one task can hold them."""
    pool = df if vec in df.columns else embed(df, text, vec, encoder=encoder)
    if add_perplexity:
        pool = pool.join(perplexity(df.select(key, text), key, text), key)
    if add_uncertainty:
        model = fit(pool.where(F.col("label").isNotNull()), vec)
        pool = uncertainty_signals(model, pool, vec).drop("probs", "pred")
    if mmr_threshold is not None and mmr_threshold < 1:
        n = pool.count()
        pool = mmr_partitioned(pool.withColumn("_rel", F.lit(1.0)), vec, "_rel", key,
                               threshold=mmr_threshold, min_remained=max(1, int(n * min_share)),
                               buckets=mmr_buckets, fan=4).drop("_rel")
    return pool
