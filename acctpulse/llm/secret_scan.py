"""Secret scans that unwrap encodings first.

A worklist starts with the text. Each layer is searched for secrets and for
encodings: URL escapes and Unicode escapes are undone in place, base64 runs and
what is compressed inside them become layers of their own. New layers join the
list until nothing new turns up; a layer whose content was met at the same place
before is not opened again, so cycles end. Every layer keeps, per character, the
part of the text that it came from, so findings are spans of the text.

A base64 run may go on over lines of one width, and may follow other letters of
its alphabet, so all four alignments are tried. Its bytes are searched for
compressed streams wherever they start, those of what comes out as well, until
none is left; streams that follow each other directly make one layer. Bytes are
read as UTF-8 or UTF-16 where they are that, else one character a byte.

One map over the rows; nothing is shuffled. A task holds one piece of texts and
the layers of one text.

Defined results: a null or empty text has no spans; rows that repeat are scanned
one by one. A layer that expands beyond MAX_LAYER bytes is not opened and is
counted in ``sc_refused``, so a decompression bomb cannot exhaust a task and
does not go unnoticed.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from acctpulse.llm.batches import map_texts

#: The patterns and least lengths of the kinds, in their order.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"[0-9a-f]{32,}")
#: Shortest base64 run that is tried; it can hold 15 bytes.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
NEXT_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?=[ \t]*\r?$)", re.M)
#: How compressed streams start: gzip, bzip2, zstandard, zlib.
STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};")
MAX_LAYER = 1 << 26

Span = tuple[str, int, int]


def find(text: str) -> list[Span]:
    """Secrets as they stand in the text, leftmost and without overlap within a kind, sorted by start and kind."""
    found: list[tuple[int, int, Span]] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, ("assign", *m.span())) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, ("access", *m.span())) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, ("hex", *m.span())) for m in HEX.finditer(text)]
    return [s for _, _, s in sorted(found)]


class Refused(Exception):
    """A layer would be too large."""


def _from_percent(m: re.Match) -> list[tuple[str, int, int]]:
    """Characters of a run of percent escapes with their offsets; bytes that are no UTF-8 stay as they are."""
    raw = bytes.fromhex(m[0].replace("%", ""))
    out, at = [], 0
    for c in raw.decode("utf-8", "surrogateescape"):
        if 0xDC80 <= ord(c) <= 0xDCFF:
            out += [(x, 3 * at + k, 3 * at + k + 1) for k, x in enumerate(m[0][3 * at : 3 * at + 3])]
            at += 1
        else:
            n = len(c.encode())
            out.append((c, 3 * at, 3 * (at + n)))
            at += n
    return out


def _from_escape(m: re.Match) -> list[tuple[str, int, int]]:
    s = m[0]
    if s.startswith("\\u") and s[2] != "{":
        units = [int(s[i + 2 : i + 6], 16) for i in range(0, len(s), 6)]
        out, i = [], 0
        while i < len(units):
            u = units[i]
            pair = 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            point = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00 if pair else u
            out.append(("�" if 0xD800 <= point < 0xE000 else chr(point), 6 * i, 6 * (i + 1 + pair)))
            i += 1 + pair
        return out
    digits, radix = (s[2:-1], 10) if s[:2] == "&#" else (s[3:-1] if s[:3] == "\\u{" else s[2:], 16)
    if s[:3].lower() == "&#x":
        digits, radix = s[3:-1], 16
    point = int(digits, radix)
    ok = point < 0x110000 and not 0xD800 <= point < 0xE000
    return [(chr(point) if ok else "�", 0, len(s))]


def _in_place(text: str, pattern: re.Pattern, undo: Callable) -> tuple[str, np.ndarray, np.ndarray] | None:
    """The text with every match undone, and the start and end in it of each new character."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        parts.append(text[at : m.start()])
        starts.append(np.arange(at, m.start()))
        ends.append(np.arange(at, m.start()) + 1)
        new = undo(m)
        parts.append("".join(c for c, _, _ in new))
        starts.append(np.array([m.start() + a for _, a, _ in new], np.int64))
        ends.append(np.array([m.start() + b for _, _, b in new], np.int64))
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at, len(text)) + 1)
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def _stream(data: memoryview) -> tuple[bytes, int] | None:
    """What the compressed stream at the start of the bytes holds and its length, or None if there is none."""
    try:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            engine = zstandard.ZstdDecompressor().decompressobj()
            with zstandard.ZstdDecompressor().stream_reader(data) as r:
                out, more = r.read(MAX_LAYER), r.read(1)
            if not more:
                engine.decompress(data)
            left = len(engine.unused_data)
        elif data[:3] == b"BZh":
            engine = bz2.BZ2Decompressor()
            out = engine.decompress(data, MAX_LAYER)
            more, left = not engine.eof and not engine.needs_input, len(engine.unused_data)
        else:
            engine = zlib.decompressobj(zlib.MAX_WBITS | 32)
            out = engine.decompress(data, MAX_LAYER)
            more, left = engine.unconsumed_tail, len(engine.unused_data)
            # Two bytes are a weak sign, so such a stream has to come to its end.
            if data[0] == 0x78 and not engine.eof and not more:
                return None
    except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
        return None
    if more:
        raise Refused
    return (out, len(data) - left) if out else None


def _streams(data: bytes) -> tuple[list[bytes], int]:
    """The contents of all compressed streams in the bytes, and how many were refused."""
    out: list[bytes] = []
    at, end, refused, view = 0, -1, 0, memoryview(data)
    while m := STREAM.search(data, at):
        at = m.start()
        try:
            got = _stream(view[at:])
        except Refused:
            got, refused = None, refused + 1
        if got is None:
            at += 1
            continue
        if at == end and len(out[-1]) + len(got[0]) <= MAX_LAYER:
            out[-1] += got[0]
        else:
            out.append(got[0])
        end = at = at + max(got[1], 1)
    return out, refused


def _decoded(data: bytes) -> tuple[str, np.ndarray, bool]:
    """The bytes as text, the bytes of each character, and whether they are text at all."""
    codes, half = ["utf-8"], len(data) // 4
    if data[:2] == b"\xff\xfe" or data[1::2].count(0) > half:
        codes.append("utf-16-le")
    if data[:2] == b"\xfe\xff" or data[::2].count(0) > half:
        codes.append("utf-16-be")
    for code in codes:
        try:
            text = data.decode(code)
        except UnicodeDecodeError:
            continue
        odd = sum(not (c.isprintable() or c in "\n\r\t\ufeff") for c in text)
        if text and odd * 20 <= len(text):
            return text, np.array([len(c.encode(code)) for c in text]), True
    # Zeros between characters are left out, so wide characters among other bytes are read too.
    kept = np.flatnonzero(np.frombuffer(data, np.uint8)) if data.count(0) > half else np.arange(len(data))
    text = bytes(data[i] for i in kept).decode("latin-1") if len(kept) < len(data) else data.decode("latin-1")
    width = np.diff(kept, append=len(data))
    width[:1] += kept[:1]
    return text, width, False


def _runs(content: str) -> list[tuple[str, np.ndarray]]:
    """Base64 runs and the place of each character: single ones, and those that go on over lines of one width."""
    out, upto = [], 0
    for m in BASE64.finditer(content):
        out.append((m[0], np.arange(*m.span())))
        if m.start() < upto:
            continue
        parts, places, width = [m[0]], [out[-1][1]], len(m[0])
        upto = m.end()
        while not parts[-1].endswith("=") and len(parts[-1]) == width and (n := NEXT_LINE.match(content, upto)) and len(n[1]) <= width:
            parts.append(n[1])
            places.append(np.arange(*n.span(1)))
            upto = n.end()
        if len(parts) > 1:
            out.append(("".join(parts), np.concatenate(places)))
    return out


def _base64(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _layers(run: str) -> tuple[list[tuple[str, int, np.ndarray | None]], int]:
    """Texts in a base64 run: (text, first character of the run that counts, bytes per character or None if compressed)."""
    out, refused = [], 0
    for skip in range(4):
        data = _base64(run[skip:])
        work: list[tuple[bytes, bool]] = [(data, True)]
        met, sure = {hashlib.blake2b(data).digest()}, False
        while work:
            data, plain = work.pop()
            inner, lost = _streams(data)
            refused += lost
            for x in inner:
                if (h := hashlib.blake2b(x).digest()) not in met:
                    met.add(h)
                    work.append((x, False))
            text, width, is_text = _decoded(data)
            sure = sure or is_text or bool(inner)
            if is_text or BASE64.search(text) or find(text):
                out.append((text, skip, width if plain else None))
        if sure:
            break
    return out, refused


def scan(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans; all spans, those of unwrapped layers mapped to the text; number of layers that were refused."""
    base = find(text)
    spans, refused = set(base), 0
    seen: set[tuple[bytes, int, int]] = set()
    work: list[tuple[str, np.ndarray | None, np.ndarray | None]] = [(text, None, None)]

    def put(content: str, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(content):
            key = (hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(starts.min()), int(ends.max()))
            if key not in seen:
                seen.add(key)
                work.append((content, starts, ends))

    while work:
        content, starts, ends = work.pop()
        if starts is not None:
            spans.update((k, int(starts[a:b].min()), int(ends[a:b].max())) for k, a, b in find(content))
        for sign, pattern, undo in (("%", PERCENT, _from_percent), ("\\", ESCAPE, _from_escape), ("&#", ESCAPE, _from_escape)):
            if sign in content and (new := _in_place(content, pattern, undo)) and new[0] != content:
                a, b = (new[1], new[2]) if starts is None else (starts[new[1]], ends[new[2] - 1])
                put(new[0], a, b)
        for run, places in _runs(content):
            layers, lost = _layers(run)
            refused += lost
            first, last = (places, places + 1) if starts is None else (starts[places], ends[places])
            for layer, skip, width in layers:
                if width is None:
                    a, b = np.full(len(layer), first.min()), np.full(len(layer), last.max())
                else:
                    upto = np.cumsum(width)
                    a = first[skip + (upto - width) * 4 // 3]
                    b = last[np.minimum(skip + -(-upto * 4 // 3), len(run)) - 1]
                put(layer, a, b)
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, order, refused


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_rows(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (all, if not given) with counts per kind, base digest, all spans and their number, layers refused."""
    fields = "sc_assign long, sc_access long, sc_hex long, sc_base string, sc_spans string, sc_found long, sc_refused long"

    def rows(texts: list[str]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for t in texts:
            base, spans, refused = scan(t)
            kinds = [k for k, _, _ in base]
            digest = hashlib.sha256(told(base).encode()).hexdigest()
            for column, x in zip(out, (*map(kinds.count, KINDS), digest, told(spans), len(spans), refused)):
                column.append(x)
        return out

    return map_texts(docs, docs.columns if keep is None else keep, fields, lambda: rows, text)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret, wrapped ones included, replaced by a mark; overlapping spans make one."""
    out, at = [], 0
    for _, a, b in sorted(scan(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of every row, the text redacted (null: null)."""
    from pyspark.sql import functions as F

    done = map_texts(docs, docs.columns, "sc_text string", lambda: lambda texts: [[redact(t) for t in texts]], text)
    return done.withColumn(text, F.when(F.col(text).isNotNull(), F.col("sc_text"))).drop("sc_text")
