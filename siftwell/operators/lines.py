"""Line-based scanning of sources: declarations, nesting depth, spans, comment runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(docs: DataFrame, key: str, text: Column, gap: str = "\n") -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(F.split(text, gap, -1)).alias("p", "line")).select(key, (F.col("p") + 1).cast("long").alias("line_no"), "line")


def declarations(lines: DataFrame, key: str, rules: list[tuple[str, str]], skip: str | None = None) -> DataFrame:
    """(key, line_no, kind, name): the first rule (kind, regex with the name in group 1)
    that a line matches; lines that match ``skip`` or are blank declare nothing."""
    hit = F.coalesce(*[F.when(F.col("line").rlike(rx), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("line", rx, 1).alias("name"))) for kind, rx in rules])
    rows = lines.where(F.trim("line") != "")
    if skip:
        rows = rows.where(~F.col("line").rlike(skip))
    return rows.select(key, "line_no", hit.alias("h")).where("h is not null").select(key, "line_no", "h.kind", "h.name")


def depths(lines: DataFrame, key: str, opens: str, closes: str) -> DataFrame:
    """lines with depth (after the line) and outer (before it)."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    change = F.regexp_count("line", F.lit(opens)) - F.regexp_count("line", F.lit(closes))
    return lines.withColumn("change", change.cast("long")).withColumn("depth", F.sum("change").over(w)).withColumn("outer", F.col("depth") - F.col("change"))


def next_declaration_spans(decls: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, start_line, end_line): up to the line before the next declaration."""
    last = lines.groupBy(key).agg(F.max("line_no").alias("last"))
    w = Window.partitionBy(key).orderBy("line_no")
    j = decls.withColumn("next", F.lead("line_no").over(w)).join(last, key)
    return j.select(key, F.col("line_no").alias("start_line"), F.coalesce(F.col("next") - 1, "last").alias("end_line"))


def closing_spans(decls: DataFrame, deep: DataFrame, key: str) -> DataFrame:
    """(key, start_line, end_line): to the first line at or after the declaration after
    which the depth is back at what it was before. A line that falls from depth a to b
    closes the levels b to a-1, so opener and closer meet by level and no pair of lines is
    compared: one window over openers and closers of a level."""
    opener = deep.join(decls.select(key, "line_no"), [key, "line_no"], "left_semi").select(key, F.col("outer").alias("level"), "line_no", F.lit(0).alias("is_close"), F.col("depth"))
    now = opener.where("depth <= level").select(key, F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"))
    wait = opener.where("depth > level").drop("depth")
    falls = deep.where("change < 0").select(key, F.explode(F.sequence("depth", F.col("outer") - 1)).alias("level"), "line_no", F.lit(1).alias("is_close"))
    w = Window.partitionBy(key, "level").orderBy("line_no", F.col("is_close").desc()).rowsBetween(1, Window.unboundedFollowing)
    both = wait.unionByName(falls).withColumn("end_line", F.min(F.when(F.col("is_close") == 1, F.col("line_no"))).over(w))
    later = both.where("is_close = 0 and end_line is not null").select(key, F.col("line_no").alias("start_line"), "end_line")
    return now.unionByName(later)


def contained(spans: DataFrame, key: str) -> DataFrame:
    """(key, start_line, qualified_name): names of the spans that enclose a span, outermost
    first, then its own; spans: key, start_line, end_line, name. Pairs are within one
    document and only of nested spans."""
    o = spans.select(key, F.col("start_line").alias("s"), F.col("end_line").alias("e"), F.col("name").alias("owner"))
    inside = (F.col("s") <= F.col("start_line")) & (F.col("end_line") <= F.col("e")) & ~((F.col("s") == F.col("start_line")) & (F.col("e") == F.col("end_line")))
    g = spans.alias("u").join(o, key).where(inside).groupBy(key, "start_line", "end_line", "name").agg(F.array_sort(F.collect_list(F.struct("s", "owner"))).alias("x"))
    j = spans.join(g, [key, "start_line", "end_line", "name"], "left")
    up = F.coalesce(F.transform("x", lambda v: v["owner"]), F.expr("cast(array() as array<string>)"))
    return j.select(key, "start_line", F.array_join(F.concat(up, F.array("name")), ".").alias("qualified_name"))


def comment_runs(lines: DataFrame, key: str, is_comment: Column, is_declaration: Column, most_lines: int = 20, most_chars: int = 600) -> DataFrame:
    """(key, decl_line, comment): the unbroken run of comment lines right above a
    declaration; its last ``most_lines`` lines, cut to ``most_chars``."""
    marked = lines.withColumn("c", F.coalesce(is_comment, F.lit(False))).withColumn("d", F.coalesce(is_declaration, F.lit(False)) & ~F.coalesce(is_comment, F.lit(False)))
    w = Window.partitionBy(key).orderBy("line_no")
    island = marked.withColumn("island", F.col("line_no") - F.sum(F.col("c").cast("long")).over(w))
    runs = island.where("c").groupBy(key, "island").agg(F.max("line_no").alias("last"), F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))).alias("x"))
    text = F.array_join(F.transform(F.slice("x", F.greatest(F.lit(1), F.size("x") - most_lines + 1), F.lit(most_lines)), lambda v: v["t"]), " ")
    runs = runs.select(key, (F.col("last") + 1).alias("decl_line"), F.substring(text, 1, most_chars).alias("comment"))
    decls = marked.where("d").select(key, F.col("line_no").alias("decl_line"))
    return decls.join(runs, [key, "decl_line"])
