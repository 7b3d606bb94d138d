"""Secret scans: base patterns on the text, then a worklist of decoded layers until nothing new appears.

Layers are made from percent-escapes, Unicode escapes, base64 and compressed data inside a layer; each
is scanned again and its findings are mapped to places in the original text. Escapes are decoded token by
token and, all kinds together, in place in the whole layer: a key or a sign beside them may stand in clear.
A content that was seen before in the same text is not opened again, so cycles end.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustframe.llm.common import byte_slices, prepare, widened

KINDS = ("assign", "access", "hex")
# The three base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that are parted only by line breaks (also as \\r and \\n in a string) and indentation.
GAP = re.compile(r"[ \t]*+(?:[\r\n]|\\[rn])(?:[ \t\r\n]|\\[rn])*+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{GAP.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
LEAST_RUN = 16
#: Where compressed data may begin: gzip, zlib, bz2, xz, zstd.
MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
ANY_ESCAPE = re.compile(rf"{PERCENT.pattern}|{ESCAPE.pattern}")
TOKEN_END = re.compile(r"[\s<>]")
LAYOUT = str.maketrans("", "", "\t\r\n")
#: Starts of what a pattern or a decoder could use, beside runs of LEAST_RUN letters.
NAMES, SIGNS = (b"passw", b"secret", b"token", b"apikey", b"api_key"), re.compile(rb"%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]|&#[0-9xX]")
IN_RUN = bytes(1 if chr(i).isalnum() and i < 128 or chr(i) in "+/_-" else 0 for i in range(256))
BROKEN_RUN = re.compile(rb"(?:[A-Za-z0-9+/_-](?:\s|\\[rn])*+){16}")
#: ASCII text in UTF-16, of either byte order.
WIDE = re.compile(rb"(?:[\x09-\x7E]\0){8}")
#: Inflated data is scanned to its end in pieces of this size that share LAPPED bytes, or the whole of a run without
#: other characters that stands at the cut, up to a piece's size.
#: A decoder gets FED bytes at first, then twice as many each time up to MOST_FED.
PIECE, LAPPED, FED, MOST_FED = 8 << 20, 1 << 20, 64, 1 << 16
NO_RUN = bytes(0 if chr(i).isalnum() and i < 128 or chr(i) in "+/_-=%\\&#;\r\n\t " else 1 for i in range(256))
SLICE = 8 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of one layer."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _token(text: str, start: int, end: int) -> tuple[int, int]:
    """The run without white space or angle brackets around a match."""
    while start and not (text[start - 1].isspace() or text[start - 1] in "<>"):
        start -= 1
    stop = TOKEN_END.search(text, end)
    return start, stop.start() if stop else len(text)


def _decoded(text: str, start: int, end: int, pattern: re.Pattern, chars) -> tuple[str, np.ndarray, np.ndarray]:
    """text[start:end] with its escapes decoded in place, with the start and end of each character in ``text``."""
    out, a, b, at = [], [], [], start
    for run in pattern.finditer(text, start, end):
        plain = np.arange(at, run.start())
        decoded, x, y = zip(*chars(run.group(), run.start()))
        out += text[at:run.start()], "".join(decoded)
        a += plain, np.array(x)
        b += plain + 1, np.array(y)
        at = run.end()
    plain = np.arange(at, end)
    return "".join(out) + text[at:end], np.concatenate([*a, plain]), np.concatenate([*b, plain + 1])


def _escaped(text: str, pattern: re.Pattern, chars) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Tokens with escapes, decoded."""
    done = 0
    for m in pattern.finditer(text):
        if m.start() < done:
            continue
        start, end = _token(text, m.start(), m.end())
        start, done = max(start, done), end
        yield _decoded(text, start, end, pattern, chars)


def _percent_chars(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    data = bytes.fromhex(run.replace("%", ""))
    try:
        decoded = data.decode()
        sizes = [len(c.encode()) for c in decoded]
    except UnicodeDecodeError:
        decoded, sizes = data.decode("latin-1"), [1] * len(data)
    for char, n in zip(decoded, sizes):
        yield char, at, at + 3 * n
        at += 3 * n


def _escape_chars(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    for m in ONE_ESCAPE.finditer(run):
        u, x, decimal, h = m.groups()
        code = int(decimal) if decimal else int(u or x or h, 16)
        yield chr(code) if code < 0x110000 else "�", at + m.start(), at + m.end()


def _any_chars(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    return _percent_chars(run, at) if run[0] == "%" else _escape_chars(run, at)


def _decoder(data: bytes):
    if data[:3] == b"\x1f\x8b\x08":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd" and zstandard:
        return zstandard.ZstdDecompressor().decompressobj()
    return None


class Inflater:
    """The inflated pieces of all members that begin at the start of ``source``, up to the first error; ``taken``
    bytes were read, ``dry`` says that the source ended inside a member, ``good`` of them are whole members."""

    def __init__(self, source: Iterator[bytes]):
        self.source, self.held, self.taken, self.dry, self.good = iter(source), b"", 0, False, 0

    def _more(self) -> bool:
        block = next(self.source, None)
        self.held += block or b""
        return block is not None

    def __iter__(self) -> Iterator[bytes]:
        while True:
            while len(self.held) < 6 and self._more():
                pass
            if (decoder := _decoder(self.held)) is None:
                return
            try:
                yield from self._member(decoder)
            except BROKEN:
                return
            self.good = self.good if self.dry else self.taken
            while not self.held.strip(b"\0") and self._more():         # members may be padded
                pass
            if self.dry or not self.held:
                return
            self.held = self.held.lstrip(b"\0")

    def _member(self, decoder) -> Iterator[bytes]:
        at, full, fed = 0, False, FED
        while not decoder.eof:
            if at >= len(self.held) and not full:
                self.held, at = b"", 0
                if not self._more():
                    self.dry = True
                    return
                continue
            block = b"" if full and not isinstance(decoder, zlib_object) else self.held[at:at + fed]
            fed = min(2 * fed, MOST_FED)
            if isinstance(decoder, zlib_object):
                out = decoder.decompress(block, LAPPED)
                used = len(block) - len(decoder.unconsumed_tail)
                full = len(out) == LAPPED
            elif hasattr(decoder, "needs_input"):
                out = decoder.decompress(block, LAPPED)
                used, full = len(block), not (decoder.needs_input or decoder.eof)
            else:
                out, used = decoder.decompress(block), len(block)
            if decoder.eof:
                used -= len(decoder.unused_data)
            at += used
            self.taken += used
            if out:
                yield out
        self.held = self.held[at:]


zlib_object = type(zlib.decompressobj())
#: How the libraries say that data only looks compressed.
BROKEN = (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError)
try:
    import zstandard
    BROKEN += (zstandard.ZstdError,)
except ImportError:
    zstandard = None


def _pieces(source: Iterator[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, bytes, last) of overlapping pieces."""
    held, at = bytearray(), 0
    for block in source:
        held += block
        if len(held) >= 2 * PIECE:
            piece = bytes(held)
            yield at, piece, False
            left = len(piece) - 1 - piece.translate(NO_RUN).rfind(1)
            keep = max(LAPPED, left) if left < PIECE else LAPPED
            del held[:len(piece) - keep]
            at += len(piece) - keep
    if held:
        yield at, bytes(held), True


def _after(source: Iterator[bytes], n: int) -> Iterator[bytes]:
    for block in source:
        if n < len(block):
            yield block[n:]
        n = max(0, n - len(block))


def _blocks(data: bytes, at: int) -> Iterator[bytes]:
    return (data[i:i + (1 << 16)] for i in range(at, len(data), 1 << 16))


def _opened(source, seen: set, original, whole: list) -> Iterator[tuple[str, int, int]]:
    """Readings of all that is compressed in the bytes that ``source()`` gives, at any depth, with the place and end
    of the outermost data; the parts of the source that inflate without an error are put into ``whole``.

    Layers wait in a worklist as the means to inflate them again, so neither the depth nor the number of layers is
    held in memory or on the stack; a content that was met before (``seen``, kept for the whole text) at the same
    place of the text, which ``original(start, end)`` gives, is not opened again."""
    work = [(source, None)]
    while work:
        source, place = work.pop()
        done = 0
        for at, piece, last in _pieces(source()):
            pos, clean = 0, []
            while match := MAGIC.search(piece, max(pos, done - at)):
                hit = match.start()
                start, pos = at + hit, hit + 1
                make = lambda piece=piece, hit=hit: Inflater(_blocks(piece, hit))
                flow, size, digest = _measured(make)
                if not last and (flow.dry or flow.taken == len(piece) - hit):          # goes on behind this piece
                    make = lambda source=source, start=start: Inflater(_after(source(), start))
                    flow, size, digest = _measured(make)
                if not size:
                    continue
                if flow.good > 6:
                    done = max(done, start + flow.good)
                    clean.append((hit, hit + flow.good))
                a, b = place or (start, start + flow.taken)
                if (key := (digest, *original(a, b))) not in seen:
                    seen.add(key)
                    work.append((make, (a, b)))
            if place is None:
                whole += [(at + a, at + b) for a, b in clean]
            else:
                for _, part in _between(piece, clean):
                    for chars, _, _ in _readings(part):
                        yield chars, *place


def _between(data: bytes, parts: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """The data around ``parts``: what inflates whole is read in its inflated form alone."""
    at = 0
    for a, b in [*parts, (len(data), len(data))]:
        if a > at:
            yield at, data[at:a] if at or a < len(data) else data
        at = max(at, b)


def _measured(make) -> tuple[Inflater, int, bytes]:
    """A flow that was read to its end, the number of its bytes and their digest."""
    flow, size, digest = make(), 0, hashlib.sha256()
    for block in flow:
        digest.update(block)
        size += len(block)
    return flow, size, digest.digest()


def _usable(data: bytes) -> bool:
    """Whether a pattern or a decoder could find anything in bytes that may be anything else."""
    lower = data.lower()
    if any(name in lower for name in NAMES) or b"AKIA" in data or SIGNS.search(data):
        return True
    if b"\\n" in data or b"\\r" in data:
        return bool(BROKEN_RUN.search(data))
    return bytes([1]) * LEAST_RUN in data.translate(IN_RUN, b" \t\r\n\f\v")


def _wide(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """UTF-16 readings of bytes that hold such ASCII text: at even and at odd places, which is both byte orders for
    all that a pattern or decoder knows."""
    if (bytes(8) in data[::2] or bytes(8) in data[1::2]) and WIDE.search(data):
        for skip in (0, 1):
            even = data[skip:skip + (len(data) - skip) // 2 * 2]
            units = np.frombuffer(even, "<u2")
            at = skip + 2 * np.arange(len(units))
            yield units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at, at + 2


def _utf8_sizes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def _readings(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Readings of a decoded layer, with the start and end byte of each character: UTF-8, else latin-1 (no byte is
    lost), and UTF-16 beside it. Left out are layers that are no readable text and hold no run that a pattern or a
    decoder could use."""
    try:
        text, clear = data.decode(), True
        sizes = np.ones(len(data), np.int64) if data.isascii() else _utf8_sizes(text)
    except UnicodeDecodeError:
        text, clear, sizes = data.decode("latin-1"), False, np.ones(len(data), np.int64)
    if text and (_usable(data) or clear and text.translate(LAYOUT).isprintable()):
        ends = np.cumsum(sizes)
        yield text, ends - sizes, ends
    yield from _wide(data)


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 runs of one line and runs joined over line ends, with the place of each character and the end."""
    for m in BASE64.finditer(text):
        run = m.group().rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run)), m.end()
    for m in WRAPPED.finditer(text):
        last, parts, places, at = m.end() - m.group().count("="), [], [], m.start()
        for start, end in [*(g.span() for g in GAP.finditer(text, m.start(), last)), (last, last)]:
            parts.append(text[at:start])
            places.append(np.arange(at, start))
            at = end
        if len(run := "".join(parts)) >= LEAST_RUN:
            yield run, np.concatenate(places), m.end()


def _unpacked(text: str, seen: set, original) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Base64 runs, decoded from each of the four places where a group of four letters can begin (so a prefix that is
    joined to the payload shifts nothing), and what is compressed in them."""
    for run, place, end in _runs(text):
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            letters = run[skip:len(run) - ((len(run) - skip) % 4 == 1)]
            data = base64.b64decode(letters + "=" * (-len(letters) % 4))
            whole: list[tuple[int, int]] = []
            for chars, _, _ in _opened(lambda data=data: iter([data]), seen, lambda *_: original(place[0], end), whole):
                yield chars, np.broadcast_to(place[0], len(chars)), np.broadcast_to(end, len(chars))
            for at, part in _between(data, whole):
                for chars, x, y in _readings(part):
                    yield chars, place[skip + (x + at) * 4 // 3], place[skip - (-(y + at) * 4 // 3) - 1] + 1


def _raw_percent(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    for i, byte in enumerate(bytes.fromhex(run.replace("%", ""))):
        yield chr(byte), at + 3 * i, at + 3 * i + 3


def _raw_plus(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    return iter([(" ", at, at + 1)]) if run == "+" else _raw_percent(run, at)


def _raw_escapes(run: str, at: int) -> Iterator[tuple[str, int, int]]:
    return iter([(SHORT[run[1]], at, at + 2)]) if run[1:] in SHORT else _escape_chars(run, at)


def _escaped_bytes(text: str, seen: set, original) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """What is compressed in the byte form of a layer's escapes (a URL may write a space as a plus sign)."""
    for sign, needed, pattern, chars in BYTE_FORMS:
        if needed in text and sign.search(text):
            layer, a, b = _decoded(text, 0, len(text), pattern, chars)
            data = layer.encode("latin-1", "replace")
            own = lambda start, end: original(a[start], b[min(end, len(b)) - 1])
            for inner, start, end in _opened(lambda data=data: iter([data]), seen, own, []):
                yield inner, np.broadcast_to(a[start], len(inner)), np.broadcast_to(b[min(end, len(b)) - 1], len(inner))


SHORT = dict(zip("abfnrtv0\\'\"/", "\a\b\f\n\r\t\v\0\\'\"/"))
#: Escapes that no text of printable ASCII needs, the pattern of all, and their bytes.
BYTE_FORMS = (
    (re.compile("%[019A-Fa-f8]"), "%", PERCENT, _raw_percent),
    (re.compile("%[019A-Fa-f8]"), "+", re.compile(rf"{PERCENT.pattern}|\+"), _raw_plus),
    (re.compile(r"\\x[0189A-Fa-f]|\\u00[0189A-Fa-f]|&#"), "", re.compile(rf"{ESCAPE.pattern}|\\[abfnrtv0\\'\"/]"), _raw_escapes))


def children(text: str, seen: set, original) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    if "%" in text:
        yield from _escaped(text, PERCENT, _percent_chars)
    if "\\" in text or "&#" in text:
        yield from _escaped(text, ESCAPE, _escape_chars)
    if ANY_ESCAPE.search(text):
        yield _decoded(text, 0, len(text), ANY_ESCAPE, _any_chars)
        yield from _escaped_bytes(text, seen, original)
    yield from _unpacked(text, seen, original)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans (start, kind, end) in the text, and the number of decoded layers."""
    def key(layer: str, start: int, end: int) -> tuple[bytes, int, int]:
        return hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), int(start), int(end)

    base = base_spans(text)
    found, layers, seen, opened = set(base), 0, {key(text, 0, len(text))}, set()
    work = [(text, children(text, opened, lambda start, end: (int(start), int(end))), None, None)]     # one path of layers at a time is held
    while work:
        above, rest, a, b = work[-1]
        if (child := next(rest, None)) is None:
            work.pop()
            continue
        layer, x, y = child
        if layer == above and len(work) > 1:
            continue
        if a is not None:
            x, y = a[x], b[y - 1]
        if (own := key(layer, x[0], y[-1])) in seen:
            continue
        seen.add(own)
        layers += 1
        found.update((int(x[i]), kind, int(y[j - 1])) for i, kind, j in base_spans(layer))
        inside = lambda start, end, x=x, y=y: (int(x[start]), int(y[end - 1]))
        work.append((layer, children(layer, opened, inside), x, y))
    return base, sorted(found), layers


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scanned(keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in byte_slices(texts, SLICE):
                rows = [scan(t) for t in texts[a:b]]
                counts = np.zeros((3, b - a), np.int64)
                for i, (base, _, _) in enumerate(rows):
                    for _, kind, _ in base:
                        counts[kind, i] += 1
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keep), *(pa.array(c) for c in counts),
                     pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _, _ in rows]),
                     pa.array([_joined(every) for _, every, _ in rows]), pa.array([n for _, _, n in rows], pa.int64())],
                    [*keep, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"])
    return run


def secrets(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, base_sha256 (base spans), spans (all) and n_layers per row.

    Spans are kind:start:end in code points of the whole text, by start, then kind, then end. A finding in
    a decoded layer has the place of the characters it was decoded from (of the whole run, if
    compressed). Null and empty texts have no spans; repeated rows get equal results.
    """
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    return rows.mapInArrow(_scanned(keep), widened(docs, keep, "n_assign long, n_access long, n_hex long, "
                                                        "base_sha256 string, spans string, n_layers long"))
