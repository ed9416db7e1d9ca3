"""Personal data: four base patterns, and contextual extraction bootstrapped from them.

1. One pass finds the base spans of every whole text, and each span's occurrences in
   lexical patterns (two words before; one before and one after; two after, with the
   identifier's place open). Words end at white space and at the punctuation of JSON,
   URLs and markup. Outside the base spans, maximal runs of digits and separators
   (spaces and brackets included) and strings with an @, of any length and within any
   token, are candidates and give occurrences of unknown kind. A run of several words
   also gives its beginnings and endings at spaces, as it may hold a number too many;
   these can be promoted but don't count against a pattern. The pass's table, without
   the texts, is written to the shared folder.
2. Spark scores the pattern-instance graph: a pattern's confidence for a kind is its
   distinct instances of that kind over all its distinct instances plus one. A
   candidate is promoted if patterns of at least ``least_conf`` and ``least_seeds``
   instances give a noisy-or of at least ``least_conf``. Promoted instances count as
   instances of their kind in the next round, and stay promoted; rounds go on until one
   promotes nothing new.
3. Spans of promoted instances join the base spans, the outermost where they nest.

Random contexts are shared by all kinds and stay below the bar; what is found is what
labels such as "card no" or "reach me at" introduce.

Cases: null text counts as empty; no text or no find gives zero counts, the digest of
the empty string and no spans; repeated rows give repeated rows with equal spans; long
texts, words and runs are read whole (a word of over 40 characters stands in a pattern by
its digest); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces_of

KINDS = ("email", "ip", "card", "phone")
MARKS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")
#: Promoted spans are broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 50_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\s\"'`{}()\[\]<>:;,=&?/|]+")
#: Digits with separators between them, not within a word; a full stop only inside a number.
_RUN = re.compile(r"(?<![\w@])(?:\+\(?|\(\+?)?[0-9](?:(?:[\x20\u00a0()/-]|\.(?=[0-9(])|(?<=[0-9])\+(?=[0-9]))*[0-9])*(?![\w@])")
_PART = re.compile(r"[^\x20\u00a0]+")
#: Beyond so many digits a run of several words is more than one number.
MOST_DIGITS = 19
_TRIM = "\"'`.,;:!?()[]{}<>*#$%&=|~"

#: Kind of an occurrence that doesn't count against its patterns, less its shape.
WEAK = -12

OCC = "array<struct<pattern:string,instance:string,kind:int,s:int,e:int>>"
SCAN = f"doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans array<struct<s:int,k:int,e:int>>, occ {OCC}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost non-overlapping matches of the pattern, but in linear time: a
    local part can only end at an @, and begins where its run of characters does."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    return out


def find(text: str) -> list[tuple[int, int, int]]:
    """Base spans (start, kind, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = re.sub("[^0-9]", "", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _likely_kind(word: str) -> int:
    """The kind whose shape an uncovered word or run has, -1 for none: the shape gate
    that a promoted instance must pass."""
    digits = sum("0" <= c <= "9" for c in word)
    if "@" in word[1:-1]:
        return 0
    if digits >= 4 and word.count(".") == 3 and digits + 3 == len(word):
        return 1
    if digits >= 7 and digits + sum(c in "-+()./\x20\u00a0" for c in word) == len(word):
        return 3 if word[0] == "+" or digits < 12 else 2
    return -1


def _word(text: str, m) -> str:
    w = re.sub("[0-9]", "9", m.group().strip(_TRIM).lower())
    return w if len(w) <= 40 else f"{w[:16]}~{hashlib.blake2b(w.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def _of_run(text: str, s: int, e: int) -> list[tuple[int, int, int, bool]]:
    """Candidates of one run of digits and separators."""

    def trimmed(s: int, e: int) -> tuple[int, int]:
        while not "0" <= text[e - 1] <= "9":
            e -= 1
        while s < e and text[s] not in "+(0123456789" or text[s] == "(" and ")" not in text[s:e]:
            s += 1
        return s, e

    def digits(s: int, e: int) -> int:
        return len(_DIGIT.findall(text, s, e))

    parts = [trimmed(*m.span()) for m in _PART.finditer(text, s, e) if _DIGIT.search(m.group())]
    whole = trimmed(s, e)
    if len(parts) == 1:
        parts = [whole]
    # a word that is an identifier by itself makes the run around it the doubtful one
    long = any(digits(*p) >= 10 for p in parts)
    fits = digits(*whole) <= MOST_DIGITS
    found = {p: len(parts) == 1 or long or not fits for p in parts}
    if len(parts) > 1:
        if fits:
            found[whole] = not long
        for some, of in ((parts, lambda p: (parts[0][0], p[1])), (parts[::-1], lambda p: (p[0], parts[-1][1]))):
            n = 0
            for p in some:
                n += digits(*p)
                if n > MOST_DIGITS:
                    break
                found.setdefault(trimmed(*of(p)), False)
    kinds = {p: _likely_kind(text[p[0] : p[1]]) for p in found}
    return [(*p, kinds[p], sure) for p, sure in found.items() if kinds[p] >= 0]


def candidates(text: str, spans) -> list[tuple[int, int, int, bool]]:
    """(start, end, shape, whether it counts against a pattern) outside the base spans."""
    out: list[tuple[int, int, int, bool]] = []
    at = 0
    for s, _, e in [*sorted(spans), (len(text), 0, len(text))]:
        if at < s:
            for m in _RUN.finditer(text, at, s):
                out += _of_run(text, *m.span())
            if text.find("@", at, s) >= 0:
                for m in _TOKEN.finditer(text, at, s):
                    w = m.group().strip(_TRIM)
                    if "@" in w[1:-1]:
                        b = m.start() + m.group().index(w)
                        out.append((b, b + len(w), 0, True))
        at = max(at, e)
    return out


def occurrences(text: str, spans) -> list[tuple[str, str, int, int, int]]:
    """(pattern, instance, kind, start, end) of the spans and candidates; kind is
    -2 - shape for a candidate, WEAK - shape for one that doesn't count against."""
    out: list[tuple[str, str, int, int, int]] = []
    if not _DIGIT.search(text) and "@" not in text:
        return out
    todo = [(s, e, k) for s, k, e in spans] + [(s, e, (-2 if sure else WEAK) - k) for s, e, k, sure in candidates(text, spans)]
    if not todo:
        return out
    tokens = list(_TOKEN.finditer(text))
    starts, ends = [m.start() for m in tokens], [m.end() for m in tokens]
    for s, e, k in todo:
        a, b = bisect_right(ends, s), bisect_left(starts, e)
        before = [_word(text, t) for t in tokens[max(0, a - 2) : a]]
        after = [_word(text, t) for t in tokens[b : b + 2]]
        inst = text[s:e].lower()
        ctx = []
        if len(before) == 2:
            ctx.append(f"{before[0]} {before[1]} _")
        if before and after:
            ctx.append(f"{before[-1]} _ {after[0]}")
        if len(after) == 2:
            ctx.append(f"_ {after[0]} {after[1]}")
        out += [(c, inst, k, s, e) for c in ctx]
    return out


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCAN of every row: base spans, counts, digest and occurrences. One pass."""
    occ_type = pa.list_(pa.struct([("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32())]))
    span_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for b in pieces_of(batches, 2):
            n: list[list[int]] = [[], [], [], []]
            sha, spans, occ = [], [], []
            for text in b.column(2).to_pylist():
                text = text or ""
                got = find(text)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in got))
                sha.append(hashlib.sha256(written(got).encode()).hexdigest())
                spans.append([{"s": s, "k": k, "e": e} for s, k, e in got])
                occ.append([{"pattern": p, "instance": i, "kind": k, "s": s, "e": e} for p, i, k, s, e in occurrences(text, got)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in n), pa.array(sha, pa.string()), pa.array(spans, span_type), pa.array(occ, occ_type)],
                ["doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "occ"],
            )

    narrow = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"),
        F.col(text_col).cast("string").alias("text"),
    )
    return narrow.mapInArrow(run, SCAN)


def _shape(kind):
    return F.when(kind <= WEAK, WEAK - kind).otherwise(-2 - kind)


def promoted(scan: DataFrame, least_seeds: int = 5, least_conf: float = 0.9) -> DataFrame:
    """(instance, shape, kind) of candidates that the pattern graph supports."""
    occ = scan.select(F.explode("occ").alias("o")).select("o.pattern", "o.instance", "o.kind")
    edges = durable(occ.distinct())
    seeds = edges.where("kind >= 0").select("pattern", "instance", "kind")
    unknown = edges.where("kind < 0").groupBy("pattern", "instance", _shape(F.col("kind")).alias("shape")).agg(F.max(F.col("kind") > WEAK).alias("sure"))
    won, n_won = None, 0
    while True:
        labelled = seeds.select("pattern", "instance", "kind")
        known = unknown.where("sure")
        rest = known
        if won is not None:
            labelled = labelled.unionByName(known.join(won, ["instance", "shape"]).select("pattern", "instance", "kind"))
            rest = known.join(won, ["instance", "shape"], "left_anti")
        counted = labelled.unionByName(rest.select("pattern", "instance", F.lit(-1).alias("kind")))
        # candidates of any shape count against a pattern
        per = counted.groupBy("pattern").agg(
            F.count("*").alias("all"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n{k}") for k in range(len(KINDS))]
        )
        best = per.select("pattern", "all", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n{k}").alias("n")) for k in range(len(KINDS))])).alias("b"))
        best = best.select("pattern", F.col("b.kind").alias("kind"), F.col("b.n").alias("n"), (F.col("b.n") / (F.col("all") + 1)).alias("conf"))
        good = best.where((F.col("n") >= least_seeds) & (F.col("conf") >= least_conf))
        scores = (
            unknown.join(good, (unknown["pattern"] == good["pattern"]) & (unknown["shape"] == good["kind"]))
            .groupBy("instance", "shape", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))))).alias("p"))
        )
        now = scores.where(F.col("p") >= least_conf).select("instance", "shape", "kind")
        won = durable(now if won is None else won.unionByName(now).distinct())
        before, n_won = n_won, won.count()
        if n_won == before:
            return won


def extra_spans(scan: DataFrame, won: DataFrame) -> DataFrame:
    """(doc_id, th, extra): spans of promoted instances, per distinct document text."""
    occ = scan.select("doc_id", "th", F.explode("occ").alias("o")).where("o.kind < 0")
    at = occ.select("doc_id", "th", F.col("o.instance").alias("instance"), _shape(F.col("o.kind")).alias("shape"), "o.s", "o.e").distinct()
    w = Window.partitionBy("doc_id", "th").orderBy("s", F.col("e").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        at.join(won, ["instance", "shape"])
        .withColumn("reach", F.max("e").over(w))
        .where("reach is null or e > reach")
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("s"), F.col("kind").alias("k"), F.col("e")))).alias("extra"))
    )


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra."""
    scan = durable(scanned(df, id_col, text_col))
    extra = extra_spans(scan, promoted(scan))
    # named apart: both sides come from one table, whose columns a join can't tell apart
    extra = extra.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "extra")
    joined = scan.drop("occ").join(extra, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    names = F.array(*[F.lit(k) for k in KINDS])
    full = F.array_sort(F.array_union("spans", F.coalesce(F.col("extra"), F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)"))))
    text = F.array_join(F.transform(full, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return joined.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"),
        F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_extra"),
    )


def masked(text: str, spans) -> str:
    """text with each stretch that spans cover replaced by the mark of the kind that
    begins first; overlapping spans are one stretch."""
    out, done = [], 0
    stretch = None
    for s, k, e in [*spans, (len(text) + 1, -1, 0)]:
        if stretch and s >= stretch[1]:
            out += [text[done : stretch[0]], MARKS[stretch[2]]]
            done = stretch[1]
            stretch = None
        if k >= 0:
            stretch = (s, e, k) if stretch is None else (stretch[0], max(stretch[1], e), stretch[2])
    out.append(text[done:])
    return "".join(out)


def redact(df: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """df (with doc_id, text, n_chars) with its personal data masked in text and
    n_chars counted anew; all other columns stay. Rows without a find are unchanged."""
    names = df.schema.names
    schema = df.schema
    th = F.xxhash64(F.coalesce(df["text"], F.lit("")))
    if extra is None:
        scan = durable(scanned(df))
        extra = extra_spans(scan, promoted(scan))
    extra = durable(extra.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("extra").alias("_extra")))
    few = extra.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = F.broadcast(extra) if few else extra
    joined = df.join(right, df["doc_id"].eqNullSafe(extra["_id"]) & (th == extra["_th"]), "left").select(*[df[c] for c in names], extra["_extra"])
    text_at, n_at = names.index("text"), names.index("n_chars")

    def run(batches):
        for b in pieces_of(batches, text_at):
            texts, counts = b.column(text_at).to_pylist(), b.column(n_at).to_pylist()
            for i, (text, more) in enumerate(zip(texts, b.column(len(names)).to_pylist(), strict=True)):
                spans = find(text) if text else []
                if more:
                    spans = sorted({*spans, *((x["s"], x["k"], x["e"]) for x in more)})
                if spans:
                    texts[i] = masked(text, spans)
                    counts[i] = len(texts[i])
            cols = list(b.columns)[: len(names)]
            cols[text_at], cols[n_at] = pa.array(texts, pa.string()), pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(run, schema)
