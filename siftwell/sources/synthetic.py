"""A generated source tree, for scale tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def functions(spark: SparkSession, files: int, per_file: int) -> DataFrame:
    """(path, function, source): every function of every file, made where it is needed."""
    rows = spark.range(files * per_file)
    f, g = F.floor(F.col("id") / per_file), F.col("id") % per_file
    return rows.select(
        F.format_string("module_%05d.py", f).alias("path"), F.format_string("work_%d_%d", f, g).alias("function"),
        F.format_string('def work_%d_%d(value):\n    """Step %d of file %d."""\n    return value + %d\n', f, g, g, f, g).alias("source"),
    )
