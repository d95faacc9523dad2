"""Dataset names of the form ``source_lang[-size-rsN]`` and the table layout they select from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.functions.labels import literal_map

# Catalogue of sources with the sizes of their full splits (default test 2000, dev 500).
CATALOGUE = {
    "bas19_es": {"train": 4100},
    "dyn21_en": {"train": 38644},
    "for19_pt": {"train": 3170},
    "fou18_en": {"train": 20065},
    "has19_hi": {"train": 4165, "test": 1318},
    "has20_hi": {"train": 2463, "test": 1269},
    "has21_hi": {"train": 2094},
    "ken20_en": {"train": 20692},
    "ous19_ar": {"train": 2053, "test": 1000, "dev": 300},
    "ous19_fr": {"train": 2014, "test": 1500},
    "san20_it": {"train": 5600},
    "gahd24_de": {"train": 7701},
    "xdomain_tr": {"train": 42659},
    "xdomain_en": {"train": 53600},
    "measure_en": {"train": 19526},
    "implicit_en": {"train": 18980},
    "xplain_en": {"train": 10999},
}
DEFAULT_SIZES = {"test": 2000, "dev": 500}
MAX_OTHER_SIZE = 2000


def parse_name(name) -> dict[str, Column]:
    """source, language, size ('full' when absent) and seed of a name column."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(name, "-")
    source = parts[0]
    return {"source": source, "language": F.element_at(F.split(source, "_"), -1),
            "size": F.coalesce(F.get(parts, F.lit(1)), F.lit("full")),
            "seed": F.coalesce(F.get(parts, F.lit(2)), F.lit("full"))}


def split_subset(name) -> dict[str, Column]:
    """collection and subset of a ``collection/subset`` name; a plain name has no subset."""
    parts = F.split(F.col(name) if isinstance(name, str) else name, "/", 2)
    return {"collection": parts[0], "subset": F.get(parts, F.lit(1))}


def resolve(df: DataFrame, name: str = "name", catalogue: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Add the parsed parts, ``valid`` and the sizes of the full splits.

    A name is valid if ``catalogue`` (default ``CATALOGUE``) lists its source, and only English has samples beyond 2000.
    Sizes that the catalogue leaves open are ``DEFAULT_SIZES``; an unknown source has none.
    """
    catalogue = CATALOGUE if catalogue is None else catalogue
    for k, v in parse_name(name).items():
        df = df.withColumn(k, v)
    size, known = F.expr("try_cast(size AS int)"), F.col("source").isin(*catalogue)
    df = df.withColumn("valid", known & ((F.col("language") == "en") | size.isNull() | (size <= MAX_OTHER_SIZE)))
    for split in ("train", "test", "dev"):
        sizes = {k: v.get(split, DEFAULT_SIZES.get(split)) for k, v in catalogue.items()}
        df = df.withColumn(f"{split}_size", literal_map({k: v for k, v in sizes.items() if v is not None})[F.col("source")])
    return df


def select_dataset(table: DataFrame, name: str, catalogue: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Rows of a named dataset from a table laid out by ``dataset_name, split, n, rs``: the name becomes
    partition predicates. Test and validation rows belong to every size."""
    source, *rest = name.split("-")
    language = source.split("_")[-1]
    if catalogue is not None and source not in catalogue:
        raise ValueError(f"unknown dataset: {name}")
    if rest and language != "en" and int(rest[0]) > MAX_OTHER_SIZE:
        raise ValueError(f"no training sample of that size: {name}")
    n, rs = (rest[0], rest[1]) if rest else ("full", "full")
    train = (F.col("n") == n) & (F.col("rs") == rs)
    return table.where((F.col("dataset_name") == source) & ((F.col("split") != "train") | train))
