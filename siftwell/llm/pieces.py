"""SentencePiece encoding and decoding through a distinct-chunk table.

A marked chunk is a run of whitespace markers (U+2581) with the marker-free text
after it. If no piece of the vocabulary has a marker behind another character, and the
model's normaliser only puts a marker in front and for each space, no merge can join two
chunks, so the ids of a text are the ids of its chunks in order.

1. A pass counts chunks; each task sends those that it meets ``LOCAL_LEAST`` times or
   more, pre-aggregated.
2. The ``table_rows`` most frequent short ones are the table. Spark segments each once,
   and the table, whose size that number bounds, is broadcast.
3. A second pass joins ids to each text by position. Chunks beyond the table are segmented
   where they stand, once per slice of about 1 MB: a shuffle of their positions would move
   more than the texts' own size, and most of them occur once anyway.

A model for which the condition does not hold is encoded text by text.

Cases: null text counts as empty; an empty text has no ids, n_tokens 0 and the
digest of the empty string; repeated rows give repeated rows; a very long text is one
slice, and a chunk of any length is segmented whole; an empty table gives an empty
result; other input columns are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, pieces_of

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of the table, the longest chunk in it, and what a task must count to propose one.
TABLE_ROWS, TABLE_CHARS, LOCAL_LEAST = 1 << 17, 48, 3
#: Distinct chunks that a task counts before it sends them.
COUNTED = 200_000


def _fields(data: bytes) -> dict[int, list]:
    """Values of a protocol buffer's message by field number: ints, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            value = data[at : at + size]
            at += size
        out.setdefault(tag >> 3, []).append(value)
    return out


def marks_only(proto: bytes) -> bool:
    """Whether a model's normaliser changes nothing but to put a marker in front of a text
    and in place of each space. Fixed field numbers of the model format: normalizer_spec 3 with
    precompiled_charsmap 2, add_dummy_prefix 3, remove_extra_whitespaces 4,
    escape_whitespaces 5; trainer_spec 2 with treat_whitespace_as_suffix 24."""
    model = _fields(proto)
    rules = _fields(b"".join(model.get(3, [])))
    training = _fields(b"".join(model.get(2, [])))
    last = lambda of, k, unset: of.get(k, [unset])[-1]
    return not last(rules, 2, b"") and bool(last(rules, 3, 1)) and not last(rules, 4, 1) and bool(last(rules, 5, 1)) and not last(training, 24, 0)


class ChunkTable(dict):
    """marked chunk -> (ids as decimal text, decoded text, or None where it equals
    the chunk with its markers as spaces)."""

    def __init__(self, model: str):
        import sentencepiece

        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        # a piece that decodes to a letter, in front of a chunk that is decoded alone
        self.guard = pieces.index(MARK + "a") if MARK + "a" in pieces else None
        self.splits = self.guard is not None and not any(MARK in p.lstrip(MARK) for p in pieces) and marks_only(self.sp.serialized_model_proto())

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text without the first marker of each."""
        s = text.replace(MARK, " ")
        if "  " not in s and not s.startswith(" "):
            return s.split(" ")
        return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(MARK + s.replace(" ", MARK))]

    def segmented(self, new: list[str]) -> dict[str, tuple[str, str | None]]:
        """The entries of chunks."""
        out: dict[str, tuple[str, str | None]] = {}
        ids = self.sp.encode(new, num_threads=1)
        back = self.sp.decode([[self.guard, *i] for i in ids], num_threads=1)
        for c, i, text in zip(new, ids, back, strict=True):
            got = text[1:]  # behind the guard's own letter
            # a marker alone; as a text, "" has no ids
            out[c] = (",".join(map(str, i)) if c else str(self.sp.piece_to_id(MARK)), None if not c or got == " " + c else got)
        return out

    def ids_text(self, chunks: list[str], more: dict) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a text's chunks."""
        known = self.get
        got = [known(c) or more[c] for c in chunks]
        ids = ",".join([x[0] for x in got])
        if any([x[1] is not None for x in got]):
            text = "".join([" " + c if x[1] is None else x[1] for c, x in zip(chunks, got, strict=True)])
        else:
            text = " " + " ".join(chunks)
        return ids, text[1:]


@lru_cache(maxsize=1)
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode_texts(texts: list[str], t: ChunkTable) -> list[tuple[str, str]]:
    """(ids joined by commas, decoded text) of each text."""
    if not t.splits:
        ids = t.sp.encode(texts, num_threads=1)
        return [(",".join(map(str, i)), t.sp.decode(i)) for i in ids]
    parts = [t.chunks(x) if x else [] for x in texts]
    more = t.segmented([c for c in set().union(*parts) if c not in t])
    return [t.ids_text(p, more) if p else ("", "") for p in parts]


def frequent(texts: DataFrame, model: str, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(chunk, ids, decoded): the table_rows most frequent chunks, each segmented once.
    texts: text."""

    def count(batches):
        t = chunk_table(model)
        seen: Counter = Counter()

        def told():
            kept = [(c, n) for c, n in seen.items() if n >= LOCAL_LEAST and len(c) <= TABLE_CHARS]
            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["chunk", "n"])

        for b in pieces_of(batches, 0):
            for text in b.column(0).to_pylist():
                if text and t.splits:
                    seen.update(t.chunks(text))
            if len(seen) > COUNTED:
                yield from told()
        yield from told()

    def segment(batches):
        t = chunk_table(model)
        for b in batches:
            got = t.segmented(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), *(pa.array([x[k] for x in got.values()], pa.string()) for k in (0, 1))], ["chunk", "ids", "decoded"])

    counted = texts.mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    top = durable(counted.orderBy(F.col("n").desc(), "chunk").limit(table_rows).select("chunk"))
    return top.repartition(max(1, min(64, table_rows // 4096)), "chunk").mapInArrow(segment, "chunk string, ids string, decoded string")


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
           table_rows: int = TABLE_ROWS, with_ids: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with
    with_ids, ids (array<int>) and decoded (string). No text is shuffled."""
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most table_rows short rows
    got = frequent(narrow.select("text"), model, table_rows).toArrow()
    table = {c: (i, d) for c, i, d in zip(*(got[k].to_pylist() for k in ("chunk", "ids", "decoded")), strict=True)}
    shared = df.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        sha = hashlib.sha256
        t = chunk_table(model)
        if t.keys() != shared.value.keys():
            t.clear()
            t.update(shared.value)
        for b in pieces_of(batches, 1, size=1 << 20):
            got = encode_texts([x or "" for x in b.column(1).to_pylist()], t)
            cols = [
                b.column(0),
                pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in got], pa.int64()),
                pa.array([sha(ids.encode()).hexdigest() for ids, _ in got], pa.string()),
                pa.array([sha(x.encode()).hexdigest() for _, x in got], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array([[int(i) for i in ids.split(",")] if ids else [] for ids, _ in got], pa.list_(pa.int32())))
                cols.append(pa.array([x for _, x in got], pa.string()))
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return narrow.mapInArrow(run, schema)
