"""Packing of token sequences: shortest-pack-first over the length histogram.

1. One pass tokenises every whole text, adds the end id, and cuts it into pieces
   of ``limit`` ids and one rest. Only (doc_id, start, length, crc32, doc_tokens)
   goes on; that table is written to the shared folder.
2. The histogram of rest lengths, at most ``limit`` rows, goes to the driver.
   There, lengths are placed longest first. Each piece goes to the shortest open pack,
   which is the one with the most room, and opens a new one where even that has too
   little. Packs of equal room are one count, so a step moves as many pieces as there
   are such packs, and the work is bounded by the number of lengths and patterns and
   not by the number of documents.
3. Each piece gets a rank among its length and joins its place by that rank. Ranks
   are counted within (length, salt) with the salts' totals summed in front, so
   a length that a third of all documents share isn't one task's work.

Cases: null text counts as empty and is one end id; repeated rows are packed each
by itself; an empty table gives an empty result; an end id of its own never stands
alone in a piece unless the text's ids fill their pieces exactly; a long text is
tokenised whole and cut by ids alone; further columns, whatever their names, are
never read.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, pieces_of

END_TEXT = "<|endoftext|>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SALTS = 256


PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBES = ["", " a  b\n\n c\t", "don't we'LL 1234,5 x²", "naïve Straße 漢字テスト 🙂👍🏽", "\u00a0\u3000 ​\ufeff", "\x00\x7f\r\n", "a" * 300, "é́ ½ ﬁ"]


def _plain(spec: dict) -> bool:
    """Whether a tokenizers file is byte-level BPE and nothing else, with ranks in the
    order of its ids, so that ranks alone give the same ids."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    odd = spec.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if odd or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or pre.get("use_regex") is False:
        return False
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return all(x < y for x, y in zip(made, made[1:], strict=False))


@lru_cache(maxsize=1)
def byte_tokenizer(path: str):
    """A function from a text to the ids that tokenizers gives it. Where the file is plain
    byte-level BPE and both give equal ids for PROBES, its vocabulary is run by tiktoken,
    which takes a third of the time; a text that holds a special token's string, or that
    tiktoken refuses, and any other file, go through tokenizers itself."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec["added_tokens"]]

    def exact(text: str) -> np.ndarray:
        nonlocal slow
        slow = slow or Tokenizer.from_file(path)
        return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    if not _plain(spec):
        return exact
    chars = _byte_chars()
    ranks = {bytes(chars[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    if any(fast.encode_ordinary(x) != exact(x).tolist() for x in PROBES):
        return exact
    slow = None  # rarely needed again, and large

    def ids(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return np.asarray(fast.encode_ordinary(text), dtype="<u4")
            except BaseException as e:  # pyo3 panics don't derive from Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return exact(text)

    return ids


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(df: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Step 1: PIECES of every row of df. One pass, no shuffle."""
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        encode = byte_tokenizer(tokenizer)
        for b in pieces_of(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text or ""), end])
                n, raw = len(ids), ids.tobytes()
                for at in range(0, n, limit):
                    to = min(n, at + limit)
                    for c, v in zip(out, (key, at, to - at, zlib.crc32(raw[4 * at : 4 * to]), n), strict=True):
                        c.append(v)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Shortest-pack-first by counts. Rows (length, first rank, end rank, first
    sequence, offset): the pieces of a length with a rank in [first, end) lie at
    offset in the sequences from first on, one each.

    Open packs are kept as blocks (first sequence, count) by the room they have left.
    A length's pieces go to the packs with the most room, one each, again and again; where
    none has room enough, new packs open, as many as its pieces fill."""
    out: list[tuple[int, int, int, int, int]] = []
    blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []  # a heap of rooms, the most first
    sequences = 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if not blocks[room]:
                heapq.heappush(rooms, -room)
            blocks[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        total = left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room >= length:
                first, n = blocks[room].pop()
                if not blocks[room]:
                    heapq.heappop(rooms)
            else:
                room, first, n = limit, sequences, max(1, left // (limit // length))
                sequences += n
            take = min(n, left)
            # untouched packs stay the shortest until each has got one
            free(room, first + take, n - take)
            out.append((length, total - left, total - left + take, first, limit - room))
            left -= take
            free(room - length, first, take)
    return out


def pack(df: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES with sequence_id, offset and padded_to: the length to which a sequence
    is filled up, its own total where that is a power of two, else limit."""
    cut = durable(pieces(df, tokenizer, limit, end_id, id_col, text_col))
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int")
    counts = durable(cut.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n")))
    # at most limit rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(histogram, limit)
    by_length: dict[int, list] = defaultdict(list)
    totals: list[tuple[int, int, int]] = []  # first sequence, packs, tokens put at or behind
    for length, lo, hi, first, offset in places:
        by_length[length].append((lo, hi, first, offset))
        totals.append((first, hi - lo, offset + length))
    packed = {k: np.array(sorted(v), dtype="<i8") for k, v in by_length.items()}
    tops = _tops(totals)

    def run(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            seq, off = np.empty(len(length), "<i8"), np.empty(len(length), "<i8")
            for v in np.unique(length):
                at = np.flatnonzero(length == v)
                t = packed[int(v)]
                row = np.searchsorted(t[:, 0], rank[at], "right") - 1
                seq[at] = t[row, 2] + rank[at] - t[row, 0]
                off[at] = t[row, 3]
            total = tops[1][np.searchsorted(tops[0], seq, "right") - 1]
            pad = np.where(total & (total - 1) == 0, total, limit)
            keep = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(seq), pa.array(off), pa.array(pad, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"],
            )

    before = counts.select(
        "length", "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    ranked = cut.withColumn("salt", salt).withColumn(
        "in_salt", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    )
    joined = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_salt"))
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(
        run, PIECES + ", sequence_id long, offset long, padded_to long"
    )


def _tops(totals: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence bounds and, for each stretch between them, the tokens of a sequence."""
    cuts = sorted({x for first, n, _ in totals for x in (first, first + n)}) or [0]
    bounds = np.array(cuts, dtype="<i8")
    most = np.zeros(len(bounds), dtype="<i8")
    for first, n, top in totals:
        lo, hi = np.searchsorted(bounds, [first, first + n])
        np.maximum(most[lo:hi], top, out=most[lo:hi])
    return bounds, most


def crc32_of(ids: list[int]) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
