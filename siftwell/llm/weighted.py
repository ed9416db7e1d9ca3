"""Document fingerprints by consistent weighted sampling, in SQL functions alone.

A document's terms are its words at white space, weighted by how often they occur.
For sample k and a term, r and c are drawn from Gamma(2, 1) and b from [0, 1) by a
hash of (term, k) alone. With weight w, t = floor(ln w / r + b) and
a = c exp(-r (t - b + 1)); the term with the least a gives the sample (term, t). Two
documents agree in a sample with a probability equal to their generalised Jaccard
similarity, sum of min weights over sum of max weights.

Draws come by the inverse of the distribution, tabled at ``CELLS`` + 1 points and linear
between them (ln c, in the lowest cell, where it falls steeply, by its series); tests
compare collision rates with exact similarities. A term of weight 1, as most are, has
t = 0, so nothing of it depends on the text.

Terms are exploded where the text lies: texts are dealt by doc_id once, and counting,
sampling and the minimum per sample all have keys below that one, so none of them
moves a row. What the edited text takes from the next document travels as that
document's prefix. The next document is found on ids alone, in ranges that the data
give, and between ranges by their first ids. Fingerprints move as bytes, not as digits.

Cases: null text counts as empty; a text without words has the fingerprint of 0
samples, an empty string, which is like another empty one (1.0) and unlike all others
(0.0); of repeated ids, each row has the next larger id as its next document, and of
that document's rows the smallest prefix and the smallest fingerprint; a table with one id has the
document itself as the next one; a null doc_id has no next document and is compared
with the empty text; further columns are ignored; a long text's terms are rows, never
one array of draws.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, shuffle_width

SAMPLES = 64
#: Hex digits per sample, and samples drawn together in one row.
WIDTH, TOGETHER = 6, 4
#: Bits of a draw, and cells of the tables.
BITS, CELLS = 21, 1024


def gamma_quantile(u: float) -> float:
    """x with 1 - (1 + x) exp(-x) = u."""
    lo, hi = 0.0, 64.0
    for _ in range(80):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if -math.expm1(-x) - x * math.exp(-x) < u else (lo, x)
    return (lo + hi) / 2


#: Quantiles at the cells' borders; the last cell ends half a cell short of infinity.
QUANTILES = [gamma_quantile(min(i / CELLS, 1 - 0.5 / CELLS)) for i in range(CELLS + 1)]
LOGS = [0.0, *(math.log(x) for x in QUANTILES[1:])]


def _uniform(h, at: int):
    """A number of BITS bits from a hash."""
    return F.shiftrightunsigned(h, BITS * at).bitwiseAND((1 << BITS) - 1)


def _tabled(values: list[float], u):
    """The tabled function at u of BITS bits, linear within a cell."""
    table, step = F.lit(np.array(values)), (1 << BITS) // CELLS
    cell = F.shiftright(u, BITS - 10).cast("int")
    part = (u.bitwiseAND(step - 1).cast("double") + 0.5) * (1.0 / step)
    return F.get(table, cell) + part * F.get(F.lit(np.diff(values)), cell)


def _log_c(u):
    """ln of the quantile; of a small one by sqrt(2 u) (1 + y/3 + 11/72 y**2), y = sqrt(2 u)."""
    y = F.sqrt((u.cast("double") + 0.5) * (2.0 / (1 << BITS)))
    return F.when(u < (1 << BITS) // CELLS, F.log(y * (1 + y * (1 / 3 + y * (11 / 72))))).otherwise(_tabled(LOGS, u))


def _code(log_a, sample):
    """Ordered by ln a in steps of 2**-24 (39 bits), then by the sample's own 24 bits. ln a
    lies above -(ln w + r) and so far within the range."""
    return F.shiftleft(((log_a + 8192) * (1 << 24)).cast("long"), 24).bitwiseOR(sample)


def _own(term, t):
    return F.xxhash64(term, t).bitwiseAND((1 << 24) - 1)


def _least(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """keys, g, and for each side e of 0 and 1 the least codes c{e}_0.. of the samples
    g * TOGETHER + 0..; terms: keys, term, lw0 and lw1 (ln of its weight in either text,
    null where it is absent). A row is made per group of samples, not per sample, and a
    term that both texts hold is drawn once."""
    js = range(TOGETHER)
    kept = [*keys, "g", "term", "lw0", "lw1", "own"]
    k = terms.select(*keys, "term", "lw0", "lw1", _own(F.col("term"), F.lit(0).cast("long")).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(samples // TOGETHER - 1))).alias("g"))
    k = k.select(*kept, *[F.xxhash64("term", F.col("g") * TOGETHER + j).alias(f"h{j}") for j in js])
    drawn = []
    for j in js:
        h = F.col(f"h{j}")
        drawn += [_tabled(QUANTILES, _uniform(h, 0)).alias(f"r{j}"), _log_c(_uniform(h, 1)).alias(f"l{j}"), ((_uniform(h, 2).cast("double") + 0.5) * (1.0 / (1 << BITS))).alias(f"b{j}")]
    k = k.select(*kept, *drawn)
    # t = 0 at weight 1
    k = k.select(*kept, *[f"{x}{j}" for j in js for x in "rlb"], *[_code(F.col(f"l{j}") - F.col(f"r{j}") * (1 - F.col(f"b{j}")), F.col("own")).alias(f"o{j}") for j in js])
    codes = []
    for j in js:
        r, lc, b = (F.col(f"{x}{j}") for x in "rlb")
        for e in (0, 1):
            lw = F.col(f"lw{e}")
            t = F.floor(lw / r + b)
            codes.append(F.min(F.when(lw == 0, F.col(f"o{j}")).when(lw > 0, _code(lc - r * (t - b + 1), _own(F.col("term"), t)))).alias(f"c{e}_{j}"))
    return k.groupBy(*keys, "g").agg(*codes)


def sampled(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys, print and edited_print (binary): WIDTH / 2 bytes per sample. terms as in
    _least. The keys' rows must already lie together for this not to shuffle."""
    least = _least(terms, keys, samples)
    digits = lambda e, j: F.lpad(F.hex(F.col(f"c{e}_{j}").bitwiseAND((1 << 24) - 1)), WIDTH, "0")
    parts = [F.concat_ws("", *[digits(e, j) for j in range(TOGETHER)]).alias(f"s{e}") for e in (0, 1)]
    got = least.select(*keys, "g", *parts).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", "s0", "s1"))).alias("all"))
    whole = lambda name: F.unhex(F.array_join(F.col(f"all.{name}"), ""))
    return got.select(*keys, whole("s0").alias("print"), whole("s1").alias("edited_print"))


def likeness(a, b):
    """The share of equal samples of two binary fingerprint columns."""
    size = WIDTH // 2
    places = F.sequence(F.lit(1), F.lit(SAMPLES * size), F.lit(size))
    same = F.aggregate(places, F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(size)) == F.substring(b, i, F.lit(size))).cast("int"))
    empty = [F.octet_length(x) == 0 for x in (a, b)]
    return F.when(empty[0] & empty[1], F.lit(1.0)).when(empty[0] | empty[1], F.lit(0.0)).otherwise(same / F.lit(float(SAMPLES)))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of every distinct id, the last one's next being the first."""
    known = ids.where("doc_id is not null").select("doc_id").distinct()
    parts = shuffle_width(ids.sparkSession)
    # ranges of equal size, whatever gaps the ids have; written once, as their borders vary
    ranged = durable(known.repartitionByRange(parts, "doc_id").select("doc_id", F.spark_partition_id().alias("range")))
    # a row per range
    first = ranged.groupBy("range").agg(F.min("doc_id").alias("first_id")).coalesce(1)
    after = first.select("range", F.coalesce(F.lead("first_id").over(Window.orderBy("range")), F.min("first_id").over(Window.partitionBy())).alias("after"))
    w = Window.partitionBy("range").orderBy("doc_id")
    return ranged.join(F.broadcast(after), "range").select("doc_id", F.coalesce(F.lead("doc_id").over(w), "after").alias("next_id"))


def with_edits(df: DataFrame, follow: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """dk, th, copy (which tell each row from all others, whoever computes them), doc_id,
    text and edited; partitioned by dk. Each text moves once, and a quarter of it to the
    document in front."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # one exchange serves both uses below, so nothing is filtered or pruned in front of it
    docs = docs.select(F.coalesce("doc_id", F.xxhash64("text")).alias("dk"), "doc_id", "text").repartition("dk")
    takes = F.floor(F.length("text") / 4).cast("int")
    # how much of the next document each document takes, told to that document
    asks = df.select(F.col(id_col).cast("long").alias("doc_id"), F.floor(F.length(text) / 4).cast("int").alias("m")).distinct().join(follow, "doc_id")
    asks = asks.groupBy(F.col("next_id").alias("dk")).agg(F.collect_set(F.struct(F.col("doc_id").alias("asker"), "m")).alias("asks"))
    given = docs.join(asks, "dk").select(F.explode(F.when(F.col("doc_id").isNotNull(), F.col("asks"))).alias("ask"), "text")
    heads = given.select(F.col("ask.asker").alias("dk"), F.col("ask.m").alias("m"), F.expr("substring(text, 1, ask.m)").alias("head")).repartition("dk")
    # of a repeated next document, the smallest text
    heads = heads.groupBy("dk", "m").agg(F.min("head").alias("head")).groupBy("dk").agg(F.map_from_entries(F.collect_list(F.struct("m", "head"))).alias("heads"))
    numbered = docs.withColumn("th", F.xxhash64("text")).withColumn("copy", F.row_number().over(Window.partitionBy("dk", "th").orderBy("doc_id")))
    joined = numbered.join(heads, "dk", "left").withColumn("m", takes)
    head = F.when(F.col("doc_id").isNotNull(), F.try_element_at("heads", F.col("m")))
    edited = F.concat(F.expr("substring(text, 1, length(text) - m)"), F.coalesce(head, F.lit("")))
    return joined.select("dk", "th", "copy", "doc_id", "text", edited.alias("edited"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    follow = durable(next_ids(df.select(F.col(id_col).cast("long").alias("doc_id"))))
    rows = with_edits(df, follow, id_col, text_col)
    key = ["dk", "th", "copy"]
    both = rows.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("x")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("x")))).alias("y"))
    # a text without words keeps one row with a null term
    words = both.select(*key, F.col("y.e").alias("e"), F.explode_outer(F.array_remove(F.split("y.x", r"\s+"), "")).alias("word"))
    terms = words.select(*key, "e", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term")).groupBy(*key, "term")
    terms = terms.agg(F.count(F.when(F.col("e") == 0, 1)).alias("w0"), F.count(F.when(F.col("e") == 1, 1)).alias("w1"))
    lw = [F.when(F.col("term").isNotNull() & (F.col(f"w{e}") > 0), F.log(F.col(f"w{e}").cast("double"))).alias(f"lw{e}") for e in (0, 1)]
    prints = sampled(terms.select(*key, "term", *lw), key)
    sha = F.unhex(F.sha2(F.encode("edited", "UTF-8"), 256))
    facts = rows.select(*key, "doc_id", F.length("text").cast("long").alias("n_chars"), sha.alias("edited_sha256"))
    full = durable(facts.join(prints, key).drop(*key))
    after = full.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("print").alias("next_print"))
    seen = follow.join(after, "next_id").select(F.col("doc_id").alias("_id"), "next_print")
    out = full.join(seen, full["doc_id"] == F.col("_id"), "left")
    digits = lambda name: F.lower(F.hex(F.col(name)))
    return out.select(
        "doc_id", "n_chars", digits("edited_sha256").alias("edited_sha256"),
        digits("print").alias("fingerprint"), digits("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.coalesce("next_print", F.unhex(F.lit("")))).alias("near_next"),
    )
