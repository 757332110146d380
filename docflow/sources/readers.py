"""Evaluation records, texts and typed document routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("question_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("questionId", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("answers", T.ArrayType(T.StringType())),
        T.StructField(
            "documents",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("title", T.StringType()),
                        T.StructField("is_selected", T.BooleanType()),
                        T.StructField("paragraphs", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
    ]
)


def _located(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_offset"),
        F.monotonically_increasing_id().alias("source_seq"),
    )


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; blank lines are skipped, the schema is given, not inferred."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl")
    return parse_json_lines(raw.option("recursiveFileLookup", "true").option("mode", "FAILFAST"), path)


def parse_json_lines(reader: DataFrameReader, path: str) -> DataFrame:
    return _located(reader.schema(RECORD).json(path))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON: an array of records, ``{"data": [...]}`` or one record."""
    reader = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
    return parse_json_documents(reader.option("multiLine", "true").option("mode", "FAILFAST"), path)


def parse_json_documents(reader: DataFrameReader, path: str) -> DataFrame:
    """Records of whole-file JSON, whatever the file names are."""
    schema = T.StructType(RECORD.fields + [T.StructField("data", T.ArrayType(RECORD))])
    raw = reader.schema(schema).json(path)
    names = RECORD.fieldNames()
    place = ["source_file", "source_offset", "source_seq"]
    located = _located(raw)
    nested = located.where(F.col("data").isNotNull()).select(
        *place, F.posexplode("data").alias("_at", "_r")
    )
    inner = nested.select(
        *[F.col(f"_r.{n}") for n in names],
        "source_file",
        "source_offset",
        (F.col("source_seq") + F.col("_at")).alias("source_seq"),
    )
    return located.where(F.col("data").isNull()).select(*names, *place).unionByName(inner)


def read_eval_records(spark: SparkSession, path: str) -> DataFrame:
    """Both file forms below ``path``, with their place in the file."""
    return read_json_lines(spark, path).unionByName(read_json_documents(spark, path))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per UTF-8 text file: (file_name, text)."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


# Fixed routing: extension to parser; strategies may prefer a parser of higher order.
EXTENSIONS = {
    "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "text",
}

Parser = Callable[[DataFrame], DataFrame]


def route_by_type(
    df: DataFrame, registry: Mapping[str, Parser], extensions: Mapping[str, str] = EXTENSIONS
) -> tuple[DataFrame, DataFrame]:
    """Parse every document by its extension.

    ``df`` has (doc_id, file_name, text). Returns (parsed, errors): one filtered
    branch per parser, unknown types with a message.
    """
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in extensions.items() for x in kv])
    tagged = df.withColumn("_parser", F.try_element_at(table, ext))
    tagged = tagged.withColumn(
        "_parser", F.when(F.col("_parser").isin(*registry), F.col("_parser"))
    )
    out: DataFrame | None = None
    for name, parser in registry.items():
        part = parser(tagged.where(F.col("_parser") == name).drop("_parser"))
        part = part.withColumn("parser", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parser registered")
    errors = tagged.where(F.col("_parser").isNull()).select(
        "doc_id", "file_name", F.concat(F.lit("Unsupported file type: "), ext).alias("error")
    )
    return out, errors
