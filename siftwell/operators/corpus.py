"""Relational forms of a corpus: units, their fields, questions, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as T

FIELDS = ("name", "signature", "description", "relations", "body")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer partitions than the session has cores is dealt over them, as
    a single small file would otherwise be one task's work."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in WIDE and _few_bytes(df, spark):
        return df.repartition(cores)
    return df


#: Tables with long texts, whose rows cost much each.
WIDE = frozenset(["documents", "pages", "conversations"])
FEW_BYTES = 64 << 20


def _few_bytes(df: DataFrame, spark: SparkSession) -> bool:
    """Whether the files of a scan hold less than FEW_BYTES a core, by its own statistics."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) < FEW_BYTES * spark.sparkContext.defaultParallelism


def units(docs: DataFrame) -> DataFrame:
    """One unit per document (doc_id, text, lang, source)."""
    first = F.substring(F.substring_index("text", "\n", 1), 1, 500)
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return docs.select(
        F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("unit_id"),
        F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"), F.lit("document").alias("kind"), name.alias("name"),
        F.concat("source", F.lit("."), name).alias("qualified_name"), first.alias("signature"),
        T.sentence(F.col("lang"), F.lit("document"), name, first).alias("description"),
        F.col("text").alias("source"), "doc_id",
    )


def fields(u: DataFrame) -> DataFrame:
    """units with the five searchable fields f_<name>. Call and import lists, where the
    units have them, make up the relations field."""
    has = set(u.columns)
    calls = F.array_join("calls", ", ") if "calls" in has else F.lit("")
    imports = F.array_join("imports", ", ") if "imports" in has else F.lit("")
    return u.withColumns(
        {
            "f_name": F.concat_ws(" ", "qualified_name", "kind"),
            "f_signature": F.col("signature"),
            "f_description": F.col("description"),
            "f_relations": F.concat(F.lit("calls: "), calls, F.lit("\nimports: "), imports),
            "f_body": F.col("source"),
        }
    )


def long_fields(u: DataFrame) -> DataFrame:
    """(unit_id, field, text), one pass, no shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f"f_{f}"), F.lit("")).alias("text")) for f in FIELDS])
    return fields(u).select("unit_id", F.explode(pairs).alias("x")).select("unit_id", "x.field", "x.text")


def searchable_text():
    """Of fields(): what an embedding is made from."""
    return F.concat_ws("\n", *[F.coalesce(F.col(f"f_{f}"), F.lit("")) for f in FIELDS])


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
