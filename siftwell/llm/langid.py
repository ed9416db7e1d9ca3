"""Language identification by prediction by partial matching.

For each language a context tree of bytes up to ``order`` is counted. Symbol
probabilities are n/(N+T) and escapes T/(N+T) for a context seen N times with T
distinct symbols; what escapes from the empty context costs 8 bits. Statistics are
frozen after training, so the exact code length of a byte depends only on the
``order`` bytes in front of it: all costs are tabled once per gram and language,
and a text is scored by table lookups over its bytes, longest context first, each
miss paying the escape and going one order down.

Training uses at most ``rows_per_language`` labelled rows per language (those with
the smallest hash of doc_id), whole texts; only gram counts reach the driver, which
that bound also bounds. A language with many rows is first cut to hashes so small that about
``SPARE`` times as many remain, so no task ranks all rows of a language. Prediction reads
every whole text, in one pass.

The score is the posterior under equal priors if the text's bits per byte were those of
``EVIDENCE`` bytes: the whole text's own posterior is 1 for any text of some length, and
says nothing of how mixed or foreign it is.

Cases: null text, or text without a letter, is ``und`` with score 0; so is every
text when nothing is labelled. Ties go to the smaller language name. A very long text is
scored in blocks, with the bytes before each as its context, so its length is exact.
Repeated rows give repeated rows; an empty table gives none; further columns, whatever
their names, are ignored (label keeps them).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of

ORDER = 3
PAD = b"\n" * ORDER
BLOCK = 1 << 18
#: Bytes that a score counts as evidence, and rows kept to rank for each that is learned from.
EVIDENCE, SPARE = 4, 4
#: Languages whose numbers of rows the driver looks at.
MOST_LANGS = 10_000
_WORDY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _WORDY.finditer(text))


def grams(data: np.ndarray) -> np.ndarray:
    """The ORDER+1 bytes that end at each byte from the ORDER-th on, as one uint32."""
    d = data.astype(np.uint32)
    return (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]


class Table:
    """uint32 keys to row numbers: a hash table with linear probing, read in bulk."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint32)
        self.rows = np.full(1 << bits, -1, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(todo):
            free = self.rows[at] < 0
            self.rows[at[free]] = todo[free]  # the last of several wins, the others go on
            won = self.rows[at] == todo
            self.keys[at[won]] = keys[todo[won]]
            at, todo = (at[~won] + 1) & self.mask, todo[~won]
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        row = self.rows[at]
        row[self.keys[at] != keys] = -1
        miss = np.flatnonzero((row < 0) & (self.rows[at] >= 0))
        for p in range(1, self.probes):
            if not len(miss):
                break
            slot = (at[miss] + p) & self.mask
            got = self.rows[slot]
            hit = (got >= 0) & (self.keys[slot] == keys[miss])
            row[miss[hit]] = got[hit]
            miss = miss[(got >= 0) & ~hit]
        return row


@dataclass
class Model:
    langs: list[str]
    gram_keys: list[np.ndarray]  # by order: sorted grams of order+1 bytes
    gram_cost: list[np.ndarray]  # by order: (langs, grams) bits
    ctx_keys: list[np.ndarray]
    ctx_escape: list[np.ndarray]  # by order: (langs, contexts) bits, 0 where not seen

    @classmethod
    def fit(cls, langs: list[str], lang_of: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
        """From counts of whole grams: (index of language, gram, count)."""
        n_l = len(langs)
        m = cls(langs, [], [], [], [])
        below: tuple[np.ndarray, np.ndarray] | None = None
        for order in range(ORDER + 1):
            key = gram if order == 3 else gram & np.uint32((1 << (8 * (order + 1))) - 1)
            keys, at = np.unique(key, return_inverse=True)
            n = np.zeros((n_l, len(keys)))
            np.add.at(n, (lang_of, at), count)
            ctx, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((n_l, len(ctx))), np.zeros((n_l, len(ctx)))
            for i in range(n_l):
                total[i] = np.bincount(of, n[i], len(ctx))
                kinds[i] = np.bincount(of, n[i] > 0, len(ctx))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(n / (total + kinds)[:, of])
            if below is None:
                less = np.full((n_l, len(keys)), 8.0)
            else:
                less = below[1][:, np.searchsorted(below[0], keys & np.uint32((1 << (8 * order)) - 1))]
            cost = np.where(n > 0, own, escape[:, of] + less)
            m.gram_keys.append(keys)
            m.gram_cost.append(cost.astype(np.float32))
            m.ctx_keys.append(ctx)
            m.ctx_escape.append(escape.astype(np.float32))
            below = (keys, cost)
        return m


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.top = Table(model.gram_keys[ORDER])

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """(langs, positions) bits of the last byte of each gram."""
        m = self.m
        row = self.top.find(gram)
        miss = np.flatnonzero(row < 0)
        out = m.gram_cost[ORDER][:, np.maximum(row, 0)]
        if len(miss):
            out[:, miss] = self._lower(gram[miss])
        return out

    def _lower(self, gram: np.ndarray) -> np.ndarray:
        m = self.m
        out = np.zeros((len(m.langs), len(gram)), np.float32)
        left = np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            key = gram[left] if order == 3 else gram[left] & np.uint32((1 << (8 * (order + 1))) - 1)
            keys = m.gram_keys[order]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            out[:, left[hit]] += m.gram_cost[order][:, at[hit]]
            left, ctx = left[~hit], key[~hit] >> 8
            if not len(left):
                return out
            c = m.ctx_keys[order]
            at = np.minimum(np.searchsorted(c, ctx), len(c) - 1)
            seen = c[at] == ctx
            out[:, left[seen]] += m.ctx_escape[order][:, at[seen]]
        out[:, left] += 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """(texts, langs) exact code lengths."""
        total = np.zeros((len(texts), len(self.m.langs)))
        parts: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not parts:
                return
            data = np.frombuffer(b"".join(p for _, p in parts), np.uint8)
            cost = self.costs(grams(data))
            ends = np.cumsum([len(p) for _, p in parts])
            cuts = np.empty(2 * len(parts), np.int64)  # grams of a part, then those across its end
            cuts[0::2] = ends - [len(p) for _, p in parts]
            cuts[1::2] = ends - ORDER
            cuts = np.minimum(cuts, cost.shape[1])
            padded = np.concatenate([cost, np.zeros((cost.shape[0], 1), cost.dtype)], axis=1)
            sums = np.add.reduceat(padded, cuts, axis=1, dtype=np.float64)[:, 0::2]
            np.add.at(total, [i for i, _ in parts], sums.T)
            parts.clear()
            size = 0

        for i, t in enumerate(texts):
            t = PAD + t
            for at in range(0, len(t) - ORDER, BLOCK):
                parts.append((i, t[at : at + BLOCK + ORDER]))
                size += len(parts[-1][1])
                if size >= BLOCK:
                    flush()
        flush()
        return total


def held_out(id_col: str = "doc_id"):
    """Documents that training leaves out: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, rows_per_language: int = 400) -> Model:
    """df: doc_id, text, lang. Learns from rows with text and lang that aren't held out."""
    known = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    hashed = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    large = known.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > SPARE * rows_per_language).limit(MOST_LANGS + 1).collect()
    if 0 < len(large) <= MOST_LANGS:
        # of n hashes in [-2**63, 2**63), about SPARE * rows_per_language lie below this
        tops = [(r["lang"], int(SPARE * rows_per_language / r["n"] * (1 << 64)) - (1 << 63)) for r in large]
        top = F.broadcast(df.sparkSession.createDataFrame(tops, "lang string, top long"))
        hashed = hashed.join(top, "lang", "left").where("top is null or h < top")
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = hashed.select("doc_id", "lang", F.row_number().over(w).alias("rn")).where(F.col("rn") <= rows_per_language)
    ids = ids.select("doc_id").distinct()
    sample = known.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")

    def count(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = np.frombuffer(PAD + text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(data) > ORDER:
                    g, n = np.unique(grams(data), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "gram", "n"],
                    )

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = got["lang"].to_pylist()
    langs = sorted(set(names))
    number = {x: i for i, x in enumerate(langs)}
    at = np.array([number[x] for x in names], np.int64)
    return Model.fit(langs, at, got["gram"].to_numpy().astype(np.uint32), got["n"].to_numpy().astype(float))


def predict(df: DataFrame, model: Model) -> DataFrame:
    """df with lang_pred (a learned name, or ``und``) and score, the posterior of that
    language by bits per byte. Reads doc_id and text; keeps doc_id and held_out."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value.langs else None
        for b in pieces_of(batches, 2):
            texts = [x or "" for x in b.column(2).to_pylist()]
            pred, score = identify(texts, scorer)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    narrow = df.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(texts: list[str], scorer: Scorer | None) -> tuple[list[str], list[float]]:
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if scorer is None:
        return pred, score
    use = [i for i, t in enumerate(texts) if has_letter(t)]
    data = [texts[i].encode("utf-8", "surrogatepass") for i in use]
    for i, row, raw in zip(use, scorer.bits(data), data, strict=True):
        best = int(row.argmin())
        pred[i] = scorer.m.langs[best]
        score[i] = float(1 / np.exp2((row.min() - row) * EVIDENCE / max(EVIDENCE, len(raw))).sum())
    return pred, score


def label(df: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of df whose language is recognised with a posterior of ``least`` or
    more, with lang replaced by it; ``und`` rows go. All other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.schema
    text_at, lang_at = schema.names.index("text"), schema.names.index("lang")

    def run(batches):
        scorer = Scorer(shared.value) if shared.value.langs else None
        for b in pieces_of(batches, text_at):
            pred, score = identify([x or "" for x in b.column(text_at).to_pylist()], scorer)
            cols = list(b.columns)
            cols[lang_at] = pa.array(pred, pa.string())
            keep = pa.array([p != "und" and s >= least for p, s in zip(pred, score, strict=True)])
            yield pa.RecordBatch.from_arrays(cols, schema.names).filter(keep)

    return df.mapInArrow(run, schema)
