"""Descriptions written back into sources: comments, docstrings, unified diffs."""

from __future__ import annotations

import difflib
import textwrap

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 76
LINE_MARK = {
    "go": "// ", "rust": "/// ", "swift": "/// ", "csharp": "/// ", "c": "// ", "cpp": "// ", "ruby": "# ", "shell": "# ", "java": " * ", "javascript": " * ",
    "typescript": " * ", "kotlin": " * ", "scala": " * ", "php": " * ",
}


def comment(text: str, indent: str, language: str) -> list[str] | None:
    """The comment above a declaration, None for a language without a convention."""
    mark = LINE_MARK.get(language)
    if mark is None:
        return None
    body = [f"{indent}{mark}{x}" for x in textwrap.wrap(text, max(20, WIDTH - len(indent) - len(mark)), break_long_words=False)]
    return [f"{indent}/**", *body, f"{indent} */"] if mark == " * " else body


def docstring(text: str, indent: str) -> list[str]:
    text = text.replace("\\", "\\\\").replace('"""', r"\"\"\"")
    if text.endswith('"'):
        text += " "
    rows = textwrap.wrap(text, max(20, WIDTH - len(indent) - 6), break_long_words=False)
    if len(rows) == 1:
        return [f'{indent}"""{rows[0]}"""']
    return [f'{indent}"""{rows[0]}', *(indent + r for r in rows[1:]), f'{indent}"""']


def file_patch(path: str, source: str, insertions: list[tuple[int, list[str]]]) -> str:
    """A unified diff that puts lines in front of the given lines (from 1)."""
    end = "\r\n" if "\r\n" in source else "\n"
    old = source.splitlines(keepends=True)
    new = list(old)
    for line, rows in sorted(insertions, key=lambda x: -x[0]):
        new[line - 1 : line - 1] = [r + end for r in rows]
    return "".join(difflib.unified_diff(old, new, f"a/{path}", f"b/{path}", n=3))


def render(insertions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, patch): insertions (path, line, lines), files (path, source). A file meets its
    insertions, which its own size bounds, in one row."""
    todo = insertions.groupBy("path").agg(F.collect_list(F.struct("line", "lines")).alias("todo"))

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            made = [file_patch(r["path"], r["source"], [(x["line"], x["lines"]) for x in r["todo"]]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["path"] for r in rows], pa.string()), pa.array(made, pa.string())], ["path", "patch"])

    return files.select("path", "source").join(todo, "path").mapInArrow(run, "path string, patch string")
