"""Scans of labelled text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fewlabel.functions.labels import literal_map
from fewlabel.operators.joins import join_small
from fewlabel.operators.selection import cap_rows

_CSV = {"quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": True,
        "header": True, "enforceSchema": True, "encoding": "UTF-8", "mode": "PERMISSIVE",
        # A quoted empty field is an empty text; an unquoted one and a missing one come as null.
        "nullValue": "\u0001", "emptyValue": ""}


def _read(spark: SparkSession, path, schema: str, sep: str = ",", **options) -> DataFrame:
    return spark.read.schema(schema).options(**{**_CSV, "sep": sep, **options}).csv(path)


def file_path(times: int = 1) -> Column:
    """The path of a row's file as it was named. Spark reports it percent-encoded; values of ``key=value`` folders are
    encoded twice. A plus sign stands for itself."""
    path = F.col("_metadata.file_path")
    for _ in range(times):
        path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return path


def folder_value(key: str) -> Column:
    """The value of a ``key=`` folder of a row's file."""
    found = F.regexp_extract(F.col("_metadata.file_path"), rf"/{key}=([^/]+)/", 1)
    for _ in range(2):
        found = F.coalesce(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), found)
    return found


def _texts(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows that have their ``label`` field; a text that is missing before it is an empty one."""
    return rows.where(F.col(label).isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))


def _two_fields(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """``text, label`` of the rows with two fields or more. Both may be empty: a missing text is an empty one, a label
    without a value is null.

    The reader hands out a row that has not exactly two fields as read; where its label is null, the row counts if a
    separator follows its first field.
    """
    raw = _read(spark, path, "text string, label string, _record string", sep, recursiveFileLookup=True,
                columnNameOfCorruptRecord="_record")
    second = F.col("_record").rlike(rf'^\s*(?:"[^"]*+(?:""[^"]*+)*+")?+[^{sep}]*+{sep}')
    rows = raw.where(F.col("label").isNotNull() | F.col("_record").isNull() | second)
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).drop("_record")


def _number(column: str) -> Column:
    """A whole-number label; null where it is none."""
    return F.trim(column).try_cast("double").try_cast("int")


def number_rows(df: DataFrame, groups: Sequence[str], name: str = "row_idx") -> DataFrame:
    """0-based row number in file order inside each group.

    A quoted multi-line file is read front to back by one task, so positions inside a file are
    consecutive; the files of a group follow each other by path.
    """
    placed = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_seq", F.monotonically_increasing_id())
    files = placed.groupBy(*groups, "_file").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_low"))
    before = Window.partitionBy(*groups).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = join_small(placed, files, [*groups, "_file"])
    return (out.withColumn(name, F.col("_seq") - F.col("_low") + F.col("_before"))
            .drop("_file", "_seq", "_low", "_before"))


def dataset_of_path(suffix: str = "(?:csv|tsv)") -> Column:
    """Dataset name from the path: the ``dataset=`` folder, or else the file stem."""
    folder = folder_value("dataset")
    return F.when(folder != "", folder).otherwise(F.regexp_extract(file_path(), rf"([^/]+)\.{suffix}$", 1))


def read_labelled_csv(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """(dataset_name, id, text, label): the first two columns; rows with fewer than two fields are
    dropped before ids are given, rows with an empty text or label are not. A label that is no number is null."""
    rows = _two_fields(spark, path, sep).withColumn("dataset_name", dataset_of_path())
    rows = number_rows(rows, ["dataset_name"])
    return rows.select("dataset_name", F.col("row_idx").cast("string").alias("id"), "row_idx", "text",
                       _number("label").alias("label"))


def read_parallel_tsv(spark: SparkSession, path) -> DataFrame:
    """(language, source, row_idx, text, label) of ``language=/source=`` folders; equal (source, row_idx)
    means the same sentence. Rows and labels are taken as in ``read_labelled_csv``."""
    raw = _two_fields(spark, path, "\t")
    rows = raw.withColumn("language", folder_value("language")).withColumn("source", folder_value("source"))
    return number_rows(rows, ["language", "source"]).select(
        "language", "source", "row_idx", "text", _number("label").alias("label"))


def align_parallel(df: DataFrame, left: str, right: str) -> DataFrame:
    """Sentence pairs of two languages."""
    a = df.where(F.col("language") == left).select("source", "row_idx", F.col("text").alias("text_a"))
    b = df.where(F.col("language") == right).select("source", "row_idx", F.col("text").alias("text_b"))
    return a.join(b, ["source", "row_idx"])


# Languages without functional tests, and without a country slice.
NO_FUNCTIONAL_TESTS = ("tr", "en")
NO_COUNTRY_SLICE = ("it",)

# Country or language name to language code.
COUNTRY_LANGUAGE = {
    "Arabic": "ar",
    "Spanish": "es",
    "Portuguese": "pt",
    "Italian": "it",
    "Germany": "de",
    "German": "de",
    "India": "hi",
    "English": "en",
    "Indonesian": "in",
    "Turkish": "tr",
    "French": "fr",
    "Kenya": "ko",
    "Nigeria": "ni",
    "United States": "us",
}
MAX_COUNTRY_NEGATIVES = 1800


def functional_rows(df: DataFrame, lang: str = "language") -> DataFrame:
    """(id, text, label) of functional tests, for the languages that have them."""
    return df.where(~F.col(lang).isin(*NO_FUNCTIONAL_TESTS)).where(F.col("label").isNotNull())


def read_functional_tests(spark: SparkSession, path) -> DataFrame:
    """Files with ``id, <ignored>, text, label`` below ``language=`` folders; the id is kept."""
    raw = _read(spark, path, "id string, skipped string, text string, label string", recursiveFileLookup=True)
    return functional_rows(_texts(raw.withColumn("language", folder_value("language")))).select(
        "language", "id", "text", F.col("label").cast("int").alias("label"))


def country_slice(df: DataFrame, order: Sequence[str], cap: int = MAX_COUNTRY_NEGATIVES) -> DataFrame:
    """Country to language, labels 0 and 1 to 0 (only the first ``cap`` per language in file order),
    2 to 1, other labels dropped."""
    lang = literal_map(COUNTRY_LANGUAGE)[F.col("country")]
    code = F.col("label").cast("double").cast("int")
    rows = (df.withColumn("language", lang)
            .withColumn("label", F.when(code.isin(0, 1), 0).when(code == 2, 1))
            .where(F.col("language").isNotNull() & F.col("label").isNotNull()
                   & ~F.col("language").isin(*NO_COUNTRY_SLICE)))
    return cap_rows(rows, F.col("label") == 0, ["language"], order, cap)


def read_country_slice(spark: SparkSession, path, cap: int = MAX_COUNTRY_NEGATIVES) -> DataFrame:
    """Files with ``id, text, label, <ignored>, country``."""
    raw = _read(spark, path, "id string, text string, label string, skipped string, country string",
                recursiveFileLookup=True).withColumn("_all", F.lit(0))
    rows = number_rows(_texts(raw, "country"), ["_all"]).drop("_all")
    return country_slice(rows, ["row_idx"], cap).select("language", "id", "text", "label")


def read_raw_folder(spark: SparkSession, path, schema: str) -> DataFrame:
    """Every .csv and .tsv below a folder; malformed lines are skipped; the dataset is the file stem."""
    def read(sep, ending):
        raw = _read(spark, path, schema, sep, recursiveFileLookup=True, pathGlobFilter=f"*.{ending}",
                    mode="DROPMALFORMED")
        return raw.withColumn("dataset_name", dataset_of_path())
    return read(",", "csv").unionByName(read("\t", "tsv"))


def write_labelled(df: DataFrame, path: str, order: Sequence[str], folders: Sequence[str] = ("dataset",),
                   sep: str = ",") -> None:
    """Quoted text files, one folder per value of ``folders``, in ``order`` across the files of a folder.
    Range partitioning keeps a large dataset on many tasks."""
    keys = [F.col(c) for c in folders]
    cols = [c for c in df.columns if c not in order or c in folders]
    (df.repartitionByRange(*keys, *[F.col(c) for c in order])
     .sortWithinPartitions(*keys, *[F.col(c) for c in order])
     .select(*cols).write.partitionBy(*folders)
     .options(header=True, quote='"', escape='"', quoteAll=True, sep=sep,
              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path))
