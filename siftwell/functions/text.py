"""Column expressions over text: tokens, names, sentences, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII identifiers, runs of CJK ideographs, runs of decimal digits of any script.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[\x{4e00}-\x{9fff}]+|\p{Nd}+"
CJK = r"[\x{4e00}-\x{9fff}]"
MARKER = "Documented intent:"


def tokens(c: Column) -> Column:
    """array<string>: lower-case tokens in order; a CJK run longer than one character is
    followed by its overlapping pairs. Null text has no tokens."""
    raw = F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), F.lower)
    pairs = F.flatten(
        F.transform(
            raw,
            lambda w: F.when(
                w.rlike("^" + CJK) & (F.length(w) > 1),
                F.concat(F.array(w), F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))),
            ).otherwise(F.array(w)),
        )
    )
    found = F.when(c.rlike(CJK), pairs).otherwise(raw)
    return F.coalesce(found, F.expr("cast(array() as array<string>)"))


def humanized(name: Column) -> Column:
    """Words of an identifier, lower-case, single-spaced; ``anonymous unit`` if none."""
    words = F.lower(F.translate(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "_", " "))
    flat = F.trim(F.regexp_replace(words, r"\s+", " "))
    return F.when(flat == "", F.lit("anonymous unit")).otherwise(flat)


def sentence(language: Column, kind: Column, name: Column, signature: Column, comment: Column | None = None) -> Column:
    """What a declaration without a parser of its own is described by."""
    text = F.concat(F.lit("This "), language, F.lit(" "), kind, F.lit(" "), humanized(name), F.lit(". Declared as: "), signature)
    if comment is None:
        return text
    return F.when(F.coalesce(comment, F.lit("")) == "", text).otherwise(F.concat(text, F.lit(f" {MARKER} "), comment))


def source_half(c: Column) -> Column:
    """What stands before the first CJK character, right-trimmed; the whole if nothing."""
    head = F.regexp_replace(F.regexp_extract(c, rf"^((?s:.*?))(?:{CJK}|$)", 1), r"\s+$", "")
    return F.when(head == "", c).otherwise(head)


def source_key(c: Column) -> Column:
    """16 hex digits that change with the source."""
    return F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 16)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def excerpt(c: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive), stripped of outer white space."""
    part = F.array_join(F.slice(lines(c), start, F.greatest(F.lit(0), end - start + 1)), "\n")
    return F.regexp_replace(part, r"^\s+|\s+$", "")


def is_prose(line: Column) -> Column:
    """A comment line that reads as words and not as code or a rule."""
    bare = F.trim(line)
    return (bare != "") & bare.rlike("[A-Za-z]") & ~bare.rlike(r"^[-=*#~_/\\+ ]+$") & ~bare.rlike(r"[;{}]$")


def module_stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot is no extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(base.rlike(r"^.+\.[^.]*$") & ~base.rlike(r"^\.[^.]*$"), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base)


def clamp_int(raw: Column, default: int, low: int, high: int) -> Column:
    """raw (double) as a bounded integer; NaN and null become the default."""
    held = F.least(F.greatest(raw, F.lit(float(low))), F.lit(float(high)))
    return F.when(raw.isNull() | F.isnan(raw), F.lit(default)).otherwise(held.cast("long")).cast("long")


def wrapped(c: Column, width: int) -> Column:
    """array<string>: words filled greedily into lines of at most width characters."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def step(acc, w):
        fits = F.length(acc["now"]) + 1 + F.length(w) <= width
        return (
            F.when(acc["now"] == "", F.struct(acc["done"].alias("done"), w.alias("now")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["now"], w).alias("now")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), w.alias("now")))
        )

    return F.aggregate(words, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))


def glob_regex(pattern: str) -> str:
    """A relative glob, matched from the right at a path boundary: ``*`` and ``?`` stay
    within one segment."""
    import re

    absolute = pattern.startswith("/")
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    body = "/".join("".join("[^/]*" if ch == "*" else "[^/]" if ch == "?" else re.escape(ch) for ch in p) for p in parts)
    return f"^/{body}$" if absolute else f"(?:^|/){body}$"


def visible_description(description: Column, source: Column) -> Column:
    """The description without its documented half where the source shows that anyway."""
    gap = rf" {MARKER} "
    at = F.instr(description, gap)
    own = F.substring(description, F.lit(1), at - 1)
    half = F.regexp_replace(F.trim(F.substring(description, at + len(gap), F.lit(1 << 30))), r"\s+", " ")
    flat = F.regexp_replace(source, r"\s+", " ")
    bare = F.regexp_replace(half, r"\.$", "")
    shown = (at > 0) & (bare != "") & F.contains(flat, bare)
    return F.when(shown, own).otherwise(description)
