"""Secret scans that unwrap nested encodings with a worklist."""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import as_bytes, column, small

# The patterns of the contract, over bytes; their order is the order of kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_MARKS = (b"passw", b"secret", b"token", b"api")

# Encoded stretches that may hold another layer.
UNICODE = re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|[\x21-\x5B\x5D-\x7E])++")
#: The shortest base secret, an assignment of 12 bytes, takes 16 characters of base64 without any padding.
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: The same wrapped: lines of nothing else follow, of which the last may be the first word of a line.
WRAPPED = re.compile(rb"[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
LINE = re.compile(rb"[A-Za-z0-9+/_-]++")
HEX_DIGITS = frozenset(b"0123456789abcdefABCDEF")
ESCAPE = re.compile(rb"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
ESCAPES = re.compile(rb"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})++")
PERCENT_RUN = re.compile(rb"[A-Za-z0-9_.~+/=:&?%-]++")
PERCENTS = re.compile(rb"(?:%[0-9A-Fa-f]{2})++")
URL_SAFE = bytes.maketrans(b"-_", b"+/")
#: A compressed layer is unpacked in pieces of so many bytes, and one of more than LAYER bytes is scanned in parts that
#: share OVERLAP bytes with the next, so that a small text that unpacks to a very large one doesn't fill the memory.
PIECE, LAYER, OVERLAP = 1 << 20, 64 << 20, 1 << 20
CONTROLS = bytes(x for x in range(32) if x not in (9, 10, 13))
#: Escapes inside escapes are unwrapped layer by layer so many times, and what is nested deeper at once.
STEPS = 32


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds in bytes, leftmost and without overlaps in each kind."""
    out = []
    lower = text.lower()
    if any(x in lower for x in ASSIGN_MARKS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if b"AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def opener(head: bytes):
    """A new decompressor for a gzip, zlib, bzip2 or xz stream that begins so; None for anything else."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if head[:6] == b"\xfd7zXZ\0" else None


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of all streams that stand one after another, in pieces; it ends where they break off."""
    left, pieces = b"", (x[at : at + PIECE] for x in pieces for at in range(0, len(x), PIECE))
    while True:
        # Zero bytes may pad the end of a stream.
        while len(left := left.lstrip(b"\0")) < 6 and (more := next(pieces, None)) is not None:
            left += more
        if not left or (stream := opener(left)) is None:
            return
        try:
            while not stream.eof:
                out = stream.decompress(left, PIECE)
                if out:
                    yield out
                if stream.eof:
                    break
                left = getattr(stream, "unconsumed_tail", b"")
                if not left and not out and (left := next(pieces, b"")) == b"":
                    return
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            return
        left = stream.unused_data


def inflate(data: bytes) -> Iterator[bytes] | None:
    """The innermost content of nested gzip, zlib, bzip2 and xz streams in pieces of LAYER bytes; None if data is none."""
    content, heads = iter([data]), set()
    head, content = taken(content, LAYER)
    while opener(head) is not None:
        key = hashlib.blake2b(head, digest_size=16).digest()
        # A stream that holds itself has no innermost content.
        if key in heads:
            return None
        heads.add(key)
        head, content = taken(inflated(chain([head], content) if len(head) >= LAYER else iter([head])), LAYER)
    return chain([head], content) if heads and head else None


def taken(pieces: Iterator[bytes], size: int) -> tuple[bytes, Iterator[bytes]]:
    """The first pieces up to about size bytes, and the rest."""
    out, n = [], 0
    for piece in pieces:
        out.append(piece)
        n += len(piece)
        if n >= size:
            break
    return b"".join(out), pieces


def parts(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Content in parts of about LAYER bytes, each with the end of the one before it."""
    end, pieces = b"", iter(pieces)
    while True:
        part, pieces = taken(pieces, LAYER)
        if not part:
            return
        part = end + part
        yield part
        end = part[-OVERLAP:]
        # The next part begins after a line or word, where there is one, so that it doesn't begin inside an encoded stretch.
        if m := re.search(rb"\s", end):
            end = end[m.end() :]


def is_text(pieces: Iterator[bytes]) -> bool:
    """UTF-8 of which few characters are control characters."""
    decoder, size, controls = codecs.getincrementaldecoder("utf-8")(), 0, 0
    try:
        for piece in pieces:
            decoder.decode(piece)
            size += len(piece)
            controls += len(piece) - len(piece.translate(None, CONTROLS))
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        return False
    return controls * 20 <= size


def unwrapped(layer: bytes, deep: bool = False) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, content, whether it was escaped) of stretches of a layer that unwrap to something else; escapes down
    to the last one inside them if deep."""
    if b"%" in layer:
        for m in PERCENT_RUN.finditer(layer):
            if b"%" in m[0] and (plain := unescaped(m[0]) if deep else unquote_to_bytes(m[0])) != m[0]:
                yield *m.span(), plain, True
    if b"\\u" in layer or b"\\x" in layer:
        for m in UNICODE.finditer(layer):
            if b"\\" in m[0] and (plain := unescaped(m[0]) if deep else unescape(m[0])) != m[0]:
                yield *m.span(), plain, True
    for start, end, plain in unwrapped_base64(layer, alone=True):
        yield start, end, plain, False


def unescaped(data: bytes) -> bytes:
    """Data whose percent, \\u and \\x escapes are decoded until none is left, also those that decoding makes.

    Escapes never overlap, so their order doesn't matter: bytes go on a stack, and an escape is decoded as soon as its last
    byte is there.
    """
    out = bytearray()
    pending = list(reversed(data))
    while pending:
        out.append(pending.pop())
        if out[-1] not in HEX_DIGITS:
            continue
        for size, mark in ((3, b"%"), (4, b"\\x"), (6, b"\\u")):
            if out[-size : -size + len(mark)] == mark and len(out) >= size and all(x in HEX_DIGITS for x in out[len(mark) - size :]):
                code = int(out[len(mark) - size :], 16)
                del out[-size:]
                pending += reversed(bytes([code]) if size == 3 else chr(code).encode("utf-8", "replace"))
                break
    return bytes(out)


def unwrapped_base64(layer: bytes, alone: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of base64 stretches: single lines, and lines joined.

    If alone, content is any bytes, and comes in parts if it is more than LAYER bytes; else it is text up to that size.
    """
    spans = [m.span() for m in BASE64.finditer(layer)]
    if b"\n" in layer:
        for m in WRAPPED.finditer(layer):
            spans += joined_lines([x.span() for x in LINE.finditer(layer, *m.span())], m.end())
    # The longest stretch of a content counts: a compressed stream without its check sum already gives the same.
    last: tuple[int, bytes] | None = None
    for start, end in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        for plain in decoded(layer[start:end], alone):
            if (start, plain) != last:
                last = start, plain
                yield start, end, plain


def joined_lines(lines: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """Stretches of several lines that may be one payload: all lines, and those of one width with a shorter last one.

    The line before them may end in the payload's first, shorter part, and the last one may be a word that follows it.
    """
    out = {(lines[0][0], end), (lines[0][0], lines[-2][1])}
    first = 0
    for k in range(1, len(lines) + 1):
        width, this = lines[first][1] - lines[first][0], lines[k][1] - lines[k][0] if k < len(lines) else -1
        if this == width:
            continue
        # Lines first..k-1 have one width; a shorter one may close them, a shorter one may come before them.
        for a in {first, max(first - 1, 0)}:
            for z in (k, k + 1) if 0 <= this < width else (k,):
                if z - a > 1:
                    out.add((lines[a][0], end if z == len(lines) else lines[z - 1][1]))
        first = k
    return sorted(x for x in out if x[1] > lines[0][1])


def decoded(stretch: bytes, alone: bool) -> Iterator[bytes]:
    """What a stretch of base64 holds, whose lines may be wrapped: whole, or in parts if it unpacks to LAYER bytes or more.
    If not alone, only text, and only whole."""
    data = b"".join(stretch.split()).rstrip(b"=").translate(URL_SAFE)
    if HEX.fullmatch(data):
        return
    try:
        plain = base64.b64decode(data + b"=" * (-len(data) % 4))
    except (binascii.Error, ValueError):
        return
    head, rest = taken(iter([plain]) if opener(plain) is None else inflate(plain) or iter([plain]), LAYER)
    if len(head) < LAYER:
        if alone or is_text([head]):
            yield head
    elif alone:
        yield from parts(chain([head], rest))


def escapes(layer: bytes, deep: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, content) of the escapes alone, without the characters around them; with those that their last bytes
    make if deep."""
    if deep:
        for start, end, plain, escaped in unwrapped(layer, deep):
            if escaped:
                yield start, end, plain
        return
    if b"%" in layer:
        for m in PERCENTS.finditer(layer):
            yield *m.span(), unquote_to_bytes(m[0])
    if b"\\u" in layer or b"\\x" in layer:
        for m in ESCAPES.finditer(layer):
            yield *m.span(), unescape(m[0])


def unescape(data: bytes) -> bytes:
    r"""\uXXXX (surrogate pairs joined) and \xXX as characters."""
    text = ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)).encode("utf-8", "surrogatepass"), data)
    return text.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode("utf-8")


class Layer:
    """Bytes of a layer and where each part of them stands in the text.

    Part k begins at starts[k] of the layer and comes from places[k], (start, end, whether it was decoded), of the text.
    """

    def __init__(self, data: bytes, starts: list[int], places: list[tuple[int, int, bool]]):
        self.data, self.starts, self.places = data, starts, places

    def place(self, start: int, end: int) -> tuple[int, int]:
        """The stretch of the text that holds a stretch of the layer; a decoded part counts whole."""
        a, z = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        low, high = self.places[a], self.places[z]
        return low[0] if low[2] else low[0] + start - self.starts[a], high[1] if high[2] else high[0] + end - self.starts[z]

    def replaced(self, stretches: Iterator[tuple[int, int, bytes]]) -> Layer | None:
        """The layer with its stretches decoded in place, of those that overlap the first and longest; None if it has none."""
        out, starts, places, at, size = [], [], [], 0, 0
        for start, end, plain in [*sorted(stretches, key=lambda x: (x[0], -x[1])), (len(self.data), len(self.data) + 1, b"")]:
            if start < at:
                continue
            k = bisect_right(self.starts, at) - 1
            while at < start:
                stop = min(start, self.starts[k + 1] if k + 1 < len(self.starts) else start)
                low, high, whole = self.places[k]
                starts.append(size)
                places.append((low, high, True) if whole else (low + at - self.starts[k], low + stop - self.starts[k], False))
                out.append(self.data[at:stop])
                size, at, k = size + stop - at, stop, k + 1
            if plain:
                starts.append(size)
                places.append((*self.place(start, end), True))
                out.append(plain)
                size += len(plain)
            at = end
        return Layer(b"".join(out), starts, places) if any(x[2] for x in places) else None


def all_spans(text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans of a text, and those of layers inside it, mapped to the stretch of the text that holds them.

    Each decoded stretch is a layer, placed where its outermost stretch stands. So is a whole layer with all its escapes,
    or all its base64, decoded in place: that finds secrets of which only parts are encoded. Their spans reach from the
    first to the last encoded or plain part, and count unless spans of the kind cover them already.

    The worklist ends as each content is unwrapped once (a set of digests finds cycles) and layers shrink or are new. After
    STEPS layers of escapes in each other those that are left are decoded at once, in time that grows with the text; only
    the layers between are not rescanned then.
    """
    base = base_spans(text)
    deep: set[tuple[int, int, str]] = set()
    across: set[tuple[int, int, str]] = set()
    root = Layer(text, [0], [(0, len(text), False)])
    seen = {hashlib.blake2b(text, digest_size=16).digest()}

    def inner(layer: Layer, found: set[tuple[int, int, str]], steps: int) -> Iterator[tuple[Layer, bytes, set[tuple[int, int, str]], int]]:
        """New layers of a layer, what tells equal ones of other places apart, where their spans go, and after how many
        layers of escapes they come."""
        some = False
        for start, end, plain, escaped in unwrapped(layer.data, steps >= STEPS):
            some = True
            where = layer.place(start, end)
            if plain:
                yield Layer(plain, [0], [(*where, True)]), b"@%d:%d" % where, found, steps + escaped
        lone = len(layer.places) == 1 and layer.places[0][2]
        for stretches, step in ((escapes(layer.data, steps >= STEPS), 1), (unwrapped_base64(layer.data), 0)) if some else ():
            if (whole := layer.replaced(stretches)) is not None:
                yield whole, b"@%d:%d" % layer.places[0][:2] if lone else b"", across if layer is root else found, steps + step

    work = [inner(root, deep, 0)]
    while work:
        if (new := next(work[-1], None)) is None:
            work.pop()
            continue
        layer, place, found, steps = new
        key = hashlib.blake2b(layer.data + place, digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            found.update((*layer.place(a, b), kind) for a, b, kind in base_spans(layer.data))
            work.append(inner(layer, found, steps))
    return base, sorted((deep | uncovered(across, [*base, *deep])).difference(base), key=order)


def uncovered(spans: set[tuple[int, int, str]], others: list[tuple[int, int, str]]) -> set[tuple[int, int, str]]:
    """The longest of spans that no others of their kind cover."""
    out = set()
    for kind in KINDS:
        known = merged([x for x in others if x[2] == kind])
        low = [x[0] for x in known]
        reach = -1
        for a, b, _ in sorted((x for x in spans if x[2] == kind), key=lambda x: (x[0], -x[1])):
            k = bisect_right(low, a) - 1
            if b > reach and (k < 0 or known[k][1] < b):
                out.add((a, b, kind))
                reach = b
    return out


def order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def to_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets as code points."""
    if text.isascii():
        return spans
    at = {0: 0}
    last = 0
    for x in sorted({x for span in spans for x in span[:2]}):
        at[x] = at[last] + len(text[last:x].decode("utf-8", "replace"))
        last = x
    return [(at[a], at[b], kind) for a, b, kind in spans]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=order))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets of each whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans, redacted.

    The counts and the digest are of the base spans; spans also has those found in decoded layers (percent escapes, \\u
    and \\x escapes, base64, which may be wrapped in lines, and gzip, zlib, bzip2 or xz inside it), placed at the outermost
    encoded stretch; of a secret that is encoded in part, the span covers its plain parts too. Base64 counts from 16
    characters in a line; what it holds is scanned as bytes, text or not. redacted is the text with every span replaced by [SECRET].

    A null text counts as empty (redacted stays null); a null doc_id stays null; repeated rows are scanned each for
    itself; other columns are ignored. Nothing is shuffled. Compressed layers are read to their end, through all members and
    nested streams; one of more than 64 MiB in parts that overlap by 1 MiB at most.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, lists, texts = [], [], []
            for text in column(batch, "text"):
                raw = text or b""
                base, deep = all_spans(raw)
                points = to_points(raw, base + deep)
                for kind in KINDS:
                    counts[kind].append(sum(x[2] == kind for x in base))
                digests.append(hashlib.sha256(joined(points[: len(base)]).encode()).hexdigest())
                lists.append(joined(points))
                texts.append(text if not points else redact(raw, base + deep))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[kind], pa.int64()) for kind in KINDS), pa.array(digests, pa.string()), pa.array(lists, pa.string()), pa.array(texts, pa.binary())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"],
            )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted binary")
    return found.withColumn("redacted", F.col("redacted").cast("string"))


def with_redacted_texts(docs: DataFrame) -> DataFrame:
    """The rows of docs with every span of scan_secrets in text replaced by [SECRET]; n_chars, if there, follows.

    Null and empty texts, and rows without secrets, stay as they are, whatever their id and other columns; repeated rows
    change alike; an empty table gives no rows.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            names = batch.schema.names
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns["text"].cast(pa.binary()).to_pylist()
            changed = {k: redact(x, spans) for k, x in enumerate(texts) if x and (spans := [y for z in all_spans(x) for y in z])}
            if changed:
                columns["text"] = pa.array([changed.get(k, x) for k, x in enumerate(texts)], pa.binary()).cast(pa.string()).cast(columns["text"].type)
                if "n_chars" in columns:
                    sizes = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(changed[k].decode("utf-8", "replace")) if k in changed else x for k, x in enumerate(sizes)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(rewrite, docs.schema)


def redact(text: bytes, spans: list[tuple[int, int, str]], mark: bytes = b"[SECRET]") -> bytes:
    out, at = [], 0
    for a, b in merged(spans):
        out += [text[at:a], mark]
        at = b
    return b"".join([*out, text[at:]])


def merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
