"""Corpus readers and writers for delimited text, JSON lines, binary-text
Parquet and word-vector text files.

All readers take an explicit schema (no inference pass over the data).
Multi-line CSV is not splittable, so a large CSV corpus should be landed once
as Parquet (:func:`land_as_parquet`) and read from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.ranking import global_row_number

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}
# The CSV writer trims values by default; text must round-trip unchanged.
WRITE_OPTIONS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    (df.write.mode("overwrite").option("sep", "\t").option("header", str(header).lower())
     .option("escape", '"').option("quote", '"').options(**WRITE_OPTIONS).csv(path))


def read_tsv_splits(spark: SparkSession, paths: dict[str, str], schema: str,
                    header: bool = True) -> DataFrame:
    """Read one delimited file (or folder) per split and concatenate them with
    a ``source_split`` column. Columns are taken by position from ``schema``;
    with ``header=True`` the first line of each file is skipped, never used for
    names."""
    out = None
    for name, p in paths.items():
        part = (spark.read.schema(schema).option("sep", "\t").option("header", str(header).lower())
                .option("multiLine", "true").option("escape", '"').option("quote", '"')
                .option("mode", "FAILFAST").csv(p).withColumn("source_split", F.lit(name)))
        out = part if out is None else out.unionByName(part)
    return out


def write_reviews_csv(df: DataFrame, path: str, index_col: str | None = None) -> None:
    """CSV with header; text with newlines, commas and quotes survives (quoted,
    quotes doubled). ``index_col`` is written first, like a frame index."""
    cols = ([index_col] if index_col else []) + [c for c in df.columns if c != index_col]
    writer = df.select(*cols).write.mode("overwrite").options(**WRITE_OPTIONS)
    for k, v in CSV_OPTIONS.items():
        if k != "multiLine":
            writer = writer.option(k, v)
    writer.csv(path)


def read_csv_reviews(spark: SparkSession, path: str, schema: str, keep: tuple[str, ...] = ("label", "text")) -> DataFrame:
    """Read a header CSV corpus and keep ``label, text`` (any index column is
    ignored)."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    for k, v in CSV_OPTIONS.items():
        reader = reader.option(k, v)
    return reader.csv(path).select(*keep)


REVIEW_JSON_SCHEMA = "stars double, text string, date timestamp_ntz"


def read_jsonl_reviews(spark: SparkSession, path: str, schema: str = REVIEW_JSON_SCHEMA,
                       mode: str = "FAILFAST") -> DataFrame:
    """JSON lines (one object per line); only the schema's fields are parsed. A
    corrupt line is an error; ``mode="DROPMALFORMED"`` leaves such lines out."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def with_doc_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Rows of a file corpus with ids 0, 1, 2, ... in the order of an MD5 of
    their content. The ids depend on the rows alone, not on files, partitions
    or tasks (rows that repeat are alike, so their order does not matter), and
    a union of corpora is numbered anew by calling this on it."""
    content = F.md5(F.to_json(F.struct(*df.columns)).cast("binary"))
    ranked = global_row_number(df.withColumn("_content", content), [F.col("_content")], name)
    return ranked.select((F.col(name) - 1).alias(name), *df.columns)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_labeled_docs(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, label, text) from Parquet holding the text as UTF-8 bytes."""
    df = spark.read.parquet(path)
    return df.select("doc_id", "label", F.decode(F.col("text"), "UTF-8").alias("text"))


def write_labeled_docs(df: DataFrame, path: str) -> None:
    df.select("doc_id", "label", F.encode(F.col("text"), "UTF-8").alias("text")).write.mode("overwrite").parquet(path)


def write_word_vectors(df: DataFrame, path: str, word: str = "word", vec: str = "vec") -> None:
    """One line per word: the word, then its numbers, space separated."""
    line = F.concat_ws(" ", F.col(word), F.array_join(F.transform(F.col(vec), lambda x: x.cast("string")), " "))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec array<float>) from a whitespace-separated vector text file.

    A word listed twice keeps its last line (file, then position in file): a
    ``max_by`` per word, a shuffle over the vector table only."""
    lines = spark.read.text(path).select(
        F.split(F.btrim(F.col("value")), r"[ \t]+").alias("t"),
        F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m")).alias("_at"))
    lines = lines.where(F.col("t")[0] != "")  # blank lines hold nothing
    parsed = lines.select(
        F.when(F.size("t") > 1, F.col("t")[0]).otherwise(
            F.raise_error(F.concat(F.lit("vector line without numbers: "), F.col("t")[0]))).alias("word"),
        F.transform(F.slice("t", 2, F.size("t")), lambda x: x.cast("float")).alias("vec"), "_at")
    return parsed.groupBy("word").agg(F.max_by("vec", "_at").alias("vec"))


def land_as_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet and return the splittable Parquet read."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
