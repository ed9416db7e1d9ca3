"""Secret scanning with a worklist of decoded layers.

Base spans of the text itself come from three patterns. Then a worklist unwraps
encodings: %XX runs and \\uXXXX-style escapes are decoded in place for the whole
layer; each base64 run opens a layer of its own if it decodes to text or to a
compressed stream (gzip, zlib, bzip2, xz, zstandard), which is unpacked. Runs wrapped in
lines of one width are joined. A run that gives neither may have something glued to
it: all four alignments are decoded, and what is printable or a stream in them is taken.
Every new layer is scanned by the same patterns and goes back on the worklist until nothing
new appears. Each layer carries, for every character, the span of the original text it
came from, so finds are reported in the code points of the document. A set of layers
already seen, by text and places, stops cycles; equal runs at two places are two
layers. What was packed is unwrapped once per distinct content and reported at each of
its runs: any part of it depends on the whole run, so that is its span.

Unpacked content of any size is read as a stream in windows of ``WINDOW`` characters that
overlap by half, each a layer in memory, so there is no limit to it; only an encoded run
of over half a window inside of unpacked content of over a window is seen in parts.

Cases: null text counts as empty; an empty or clean text has zero counts, the
digest of the empty string and an empty span list; repeated rows give repeated rows;
a long text is scanned whole; a stream that breaks off is scanned as far as it goes;
further columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from array import array
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

KINDS = ("assign", "access", "hex")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long"
#: Characters of unpacked content in memory at once, and bytes unpacked in one go.
WINDOW, CHUNK = 1 << 22, 1 << 20

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# whole runs: a run that is too short fails from each of its later starts as well
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
#: Runs of base64, one or more lines.
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{2,})?(?:={1,2}|(?:%3[Dd]){1,2})?")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_STANDARD = str.maketrans("-_", "+/")
#: What a stretch of decoded bytes must be to count as text, and streams' first bytes.
_PRINTABLE = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc3-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){8,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns in one layer, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


class Layer:
    """A text with, per character, where it begins and ends in the document; None
    for the document itself."""

    __slots__ = ("begin", "end", "text")

    def __init__(self, text: str, begin: array | None = None, end: array | None = None):
        self.text, self.begin, self.end = text, begin, end

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Of a non-empty stretch of the layer, in the document."""
        if self.begin is None:
            return start, end
        return min(self.begin[start:end]), max(self.end[start:end])

    def key(self) -> bytes:
        """Tells the layer from all others of the document, by text and places."""
        h = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16)
        for places in (self.begin, self.end):
            h.update(places.tobytes())
        return h.digest()


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match that decodes replaced, character by character."""
    out: list[str] = []
    begin, end = array("q"), array("q")
    done, changed = 0, False

    def keep(lo: int, hi: int) -> None:
        out.append(layer.text[lo:hi])
        begin.extend(range(lo, hi) if layer.begin is None else layer.begin[lo:hi])
        end.extend(range(lo + 1, hi + 1) if layer.end is None else layer.end[lo:hi])

    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        changed = True
        keep(done, m.start())
        for ch, lo, hi in got:
            a, b = layer.span(m.start() + lo, m.start() + hi)
            out.append(ch)
            begin.append(a)
            end.append(b)
        done = m.end()
    if not changed:
        return None
    keep(done, len(layer.text))
    return Layer("".join(out), begin, end)


def _bytes_to_chars(data: bytes, width: int) -> list[tuple[str, int, int]] | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for ch in text:
        n = len(ch.encode("utf-8"))
        out.append((ch, at * width, (at + n) * width))
        at += n
    return out


def _percent(run: str):
    return _bytes_to_chars(bytes.fromhex(run.replace("%", "")), 3)


def _escape(run: str):
    if run.startswith("\\x"):
        return _bytes_to_chars(bytes.fromhex(run.replace("\\x", "")), 4)
    if run.startswith("\\u") and run[2] != "{":
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        out, i = [], 0
        while i < len(units):
            pair = i + 1 < len(units) and 0xD800 <= units[i] < 0xDC00 <= units[i + 1] < 0xE000
            code = 0x10000 + ((units[i] - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else units[i]
            if 0xD800 <= code < 0xE000:
                return None
            out.append((chr(code), 6 * i, 6 * (i + 1 + pair)))
            i += 1 + pair
        return out
    digits = run[3:-1] if run[:3] in ("\\u{", "&#x", "&#X") else run[2:] if run[0] == "\\" else run[2:-1]
    code = int(digits, 10 if run[:2] == "&#" and run[2] not in "xX" else 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(run))]


def _members(data: bytes):
    """The content of the compressed streams that data begins with, in chunks."""
    while data:
        if data[:2] == b"\x1f\x8b" or data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
            d = zlib.decompressobj(47)
            while not d.eof:
                out = d.decompress(data, CHUNK)
                yield out
                data = d.unconsumed_tail
                if not out and not data:
                    break
            data = d.unused_data
        elif data[:3] == b"BZh" or data[:6] == b"\xfd7zXZ\x00":
            d = bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor(memlimit=1 << 28)
            while not d.eof:
                out = d.decompress(data, CHUNK)
                yield out
                data = b""
                if not out and d.needs_input:
                    break
            data = d.unused_data if d.eof else b""
        elif data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            d = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
            for at in range(0, len(data), 1 << 16):
                yield d.decompress(data[at : at + (1 << 16)])
                if d.eof:
                    break
            data = d.unused_data + data[at + (1 << 16) :] if d.eof else b""
        else:
            return


def _chunks(data: bytes):
    """What _members gives, up to where it breaks off."""
    try:
        yield from _members(data)
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError, MemoryError):
        return
    except Exception as e:  # zstandard's own error class
        if type(e).__name__ != "ZstdError":
            raise


def _unpacked(data: bytes):
    """The content of a compressed stream and of those right behind it as text, in
    windows; none where data is no stream."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    held, told = "", False
    for chunk in _chunks(data):
        held += decoder.decode(chunk)
        while len(held) >= WINDOW:
            yield held[:WINDOW]
            held, told = held[WINDOW // 2 :], True
    if held and not (told and len(held) <= WINDOW // 2):
        yield held


def _odd(text: str) -> bool:
    return sum(not (c.isprintable() or c in "\t\r\n") for c in text) * 20 > len(text)


def _texty(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if text and not _odd(text) else None


def _is_stream(data: bytes) -> bool:
    """Whether data unpacks to anything. What it holds may begin as no text at all, and a
    block of bzip2 or xz may be long, so neither data nor content is cut for this."""
    return _MAGIC.match(data) is not None and any(_chunks(data))


def _decoded(flat: str, start: int) -> bytes:
    n = (len(flat) - start) // 4 * 4
    rest = len(flat) - start - n
    end = start + n + (rest if rest > 1 else 0)
    return base64.b64decode(flat[start:end].translate(_STANDARD) + "=" * (-(end - start) % 4))


def _run(flat: str):
    """What a run of base64 holds: (first byte's place in sixths of a character, text) and
    (place, packed bytes); places are bits behind the run's begin."""
    if len(flat) % 4 != 1:
        data = _decoded(flat, 0)
        text = _texty(data)
        if text is not None:  # two letters may begin zlib and a text
            return [(0, text)], [(0, data)] if _is_stream(data) else []
        m = _MAGIC.match(data)
        if m and len(m.group()) > 2 and _is_stream(data):
            return [], [(0, data)]
    texts, packed = [], []
    for start in range(4):
        data = _decoded(flat, start)
        for m in _MAGIC.finditer(data):
            # two bytes alone are no evidence of zlib but where a run may begin
            at = start + m.start() * 8 // 6
            if (len(m.group()) > 2 or m.start() == 0 or m.start() % 3 == 0 and flat[at - 1] in "-_/") and _is_stream(data[m.start() :]):
                packed.append((start * 6 + m.start() * 8, data[m.start() :]))
        texts += [(start * 6 + m.start() * 8, t) for m in _PRINTABLE.finditer(data) if (t := _texty(m.group()))]
    return texts, packed


def _base64(layer: Layer) -> tuple[list[Layer], list[tuple[int, int, bytes]]]:
    out, unpacked = [], []
    for m in _B64.finditer(layer.text):
        lines = [x.span() for x in _LINE.finditer(layer.text, m.start(), m.end() if "%" not in m.group() else m.start() + m.group().index("%"))]
        widths = [e - s for s, e in lines]
        wrapped = len(lines) > 1 and len(set(widths[:-1])) == 1 and widths[-1] <= widths[0]
        found = False
        for part in ([lines] if wrapped else []) + [[x] for x in lines if x[1] - x[0] >= 16]:
            if found and len(part) == 1 and wrapped:
                break  # the joined lines gave something
            at = [i for s, e in part for i in range(s, e)] if len(part) > 1 else range(*part[0])
            flat = "".join(layer.text[s:e] for s, e in part)
            texts, packed = _run(flat)
            found = found or bool(texts or packed)
            end = m.end() if part[-1] == lines[-1] else part[-1][1]
            for bit, data in packed:
                unpacked.append((*layer.span(at[bit // 6], end), data))
            for bit, text in texts:
                begin, ends, j = array("q"), array("q"), bit
                for ch in text:
                    n = 8 * len(ch.encode("utf-8"))
                    lo, hi = layer.span(at[j // 6], at[min((j + n - 1) // 6, len(at) - 1)] + 1)
                    begin.append(lo)
                    ends.append(hi)
                    j += n
                out.append(Layer(text, begin, ends))
    return out, unpacked


def _unwrapped(layer: Layer) -> tuple[list[Layer], list[tuple[int, int, bytes]]]:
    """Layers that keep places within the document, and (start, end, bytes) of packed
    runs."""
    new, packed = _base64(layer)
    if "%" in layer.text:
        new.append(_rewritten(layer, _PERCENT, _percent))
    if "\\" in layer.text or "&#" in layer.text:
        new.append(_rewritten(layer, _ESCAPE, _escape))
    return [x for x in new if x is not None], packed


def _kinds_inside(data: bytes) -> frozenset[int]:
    """The kinds found in what was packed and in all layers below it. They have the span
    of the packed run, whatever their place in it, so contents alone tell layers apart."""
    kinds: set[int] = set()
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    seen = {digest(data)}
    streams = [_unpacked(data)]
    while streams:
        window = next(streams[-1], None)
        if window is None:
            streams.pop()
            continue
        work = [window]
        while work:
            text = work.pop()
            kinds.update(k for _, k, _ in find(text))
            new, packed = _unwrapped(Layer(text))
            for child in new:
                key = digest(child.text.encode("utf-8", "surrogatepass"))
                if key not in seen:
                    seen.add(key)
                    work.append(child.text)
            for _, _, inner in packed:
                if (key := digest(inner)) not in seen:
                    seen.add(key)
                    streams.append(_unpacked(inner))
        if len(kinds) == len(KINDS):
            break
    return frozenset(kinds)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each sorted (start, kind, end) in code points."""
    base = find(text)
    found = set(base)
    seen = set()
    inside: dict[bytes, frozenset[int]] = {}
    work = deque([Layer(text)])
    while work:
        new, packed = _unwrapped(work.popleft())
        for a, b, data in packed:
            key = hashlib.blake2b(data, digest_size=16).digest()
            if key not in inside:
                inside[key] = _kinds_inside(data)
            found.update((a, k, b) for k in inside[key])
        for child in new:
            key = child.key()
            if key in seen:
                continue
            seen.add(key)
            for s, k, e in find(child.text):
                a, b = child.span(s, e)
                found.add((a, k, b))
            work.append(child)
    return base, sorted(found)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row of df: counts and digest of the base spans, and all spans.
    One pass, no shuffle."""

    def run(batches):
        for b in pieces_of(batches, 1):
            cols: list[list] = [[] for _ in range(6)]
            for text in b.column(1).to_pylist():
                base, full = scan(text or "")
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                cols[4].append(written(full))
                cols[5].append(len(full) - len(base))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"],
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA)
