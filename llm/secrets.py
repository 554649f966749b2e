r"""Secrets in texts and in what the texts encode.

Each text is the first layer of a worklist. A layer is scanned for the three base kinds; then every
encoded run in it (percent escapes, with + as a blank too, \u, \U and \x escapes, base64 of UTF-8 or UTF-16, and compressed
bytes within base64 or escapes: gzip, zlib of any window, raw deflate, bz2, xz, lzma) is decoded into a further layer, until no new layer appears. A layer with the content of one that it was
decoded from is scanned but not opened, which ends cycles; content that stands at several places is
reported at each. Every layer carries, for each of its characters, the span of the original text that
it came from, so a match is reported where its encoded form lies. Percent and backslash escapes are
mapped to the character, base64 to the group of four, a compressed layer to its run from its header on.

A base64 run is one of either alphabet, since both have the same values. Other characters of the
alphabet may stand before it, so it is read in all four steps, and each readable part of the bytes is a
layer (a part without matches or encoded runs is left out). A run wrapped over lines is read as a whole and line by line; lines
of under 20 characters count as wrapped if they are equally long. Bytes without a header of their own (raw deflate, zlib of a
smaller window) are only looked for where a run begins, and count if they end as they should.

A compressed run (of one or more members) is opened MAX_LAYER bytes at a time. A longer one is scanned
in windows that overlap by OVERLAP bytes, and by more where an encoded run would be cut: a window only
begins at a blank between two words of a line. Of decoded bytes every part that is UTF-8 text is read.

Defined results: a null text is empty and has no spans; repeated rows are scanned alike; bytes that
are not UTF-8 text are left out of a layer; ``n_layers`` counts different contents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents

MAX_LAYER = 4 << 20
OVERLAP = 1 << 16

# The base patterns and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

_HINT = re.compile(r"(?:%[0-9A-Fa-f]{2})|\\u\{[0-9A-Fa-f]|\\[uUx][0-9A-Fa-f]{2}|[A-Za-z0-9+/_-]{20}|(?<![^\n])[A-Za-z0-9+/_-]{4,19}\r?\n[A-Za-z0-9+/_-]{4,19}(?![^\r\n=])")
_ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Lines of a run and its last, shorter one.
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{20,}+)*+)(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)?={0,2}"
)
_WORDS_AFTER = re.compile(r"[ \t]+[^ \t\r\n]")
_IN_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: No shorter text holds a secret or an encoded one.
LEAST_TEXT = 15
_TEXT = re.compile(
    rb"(?:[\t\n\r\x20-\x7f]++|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})++"
)
_INNER_BLANK = re.compile(rb"[^\s][ \t][^\s]")
_PRINTED = re.compile(r"[!-~]+")
_BYTE = re.compile(r"(?:%|\\x)[08-9A-Fa-f][0-9A-Fa-f]")
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]|\x5d\x00\x00[\x00-\xff]{2}")
#: Characters of UTF-16 that are ASCII, in either byte order.
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){15,}+|(?:\x00[\t\n\r\x20-\x7e]){15,}+")
_FORM = re.compile(r"[^\s]*%[0-9A-Fa-f]{2}[^\s]*")
_SHORT_LINE = re.compile(r"[ \t]*([A-Za-z0-9+/_-]{4,19})(={0,2})[ \t]*\r?$")
#: Lines of one length that make a wrapped run, and least characters of any run.
LEAST_LINES, LEAST_RUN = 3, 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """A text with the original span of each of its characters; the first layer maps to itself."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (int(self.starts[start]), int(self.ends[end - 1]))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text) + 1, dtype=np.int64)
            return at[:-1], at[1:]
        return self.starts, self.ends


def _escape(run: str) -> tuple[str, list[int]] | None:
    """Decoded text of an escaped run, and how many characters of the run each decoded one takes."""
    if run.startswith(("\\u{", "\\U")):
        code = int(run[2:].strip("{}"), 16)
        return (chr(code), [len(run)]) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None
    if run.startswith("\\u"):
        units = [int(run[i + 2 : i + 6], 16) for i in range(0, len(run), 6)]
        text = b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "replace")
        return text, [12 if ord(c) > 0xFFFF else 6 for c in text]
    step = 3 if run[0] == "%" else 4
    raw = bytes(int(run[i + step - 2 : i + step], 16) for i in range(0, len(run), step))
    try:
        text = raw.decode("utf-8")
        return text, [step * len(c.encode("utf-8")) for c in text]
    except UnicodeDecodeError:
        return raw.decode("latin-1"), [step] * len(raw)


def unescaped(layer: Layer) -> Layer | None:
    """The layer with every percent, \\u and \\x escape decoded; None if it has none."""
    starts, ends = layer.bounds()
    parts, a, b, last = [], [], [], 0
    for m in _ESCAPED.finditer(layer.text):
        if (got := _escape(m.group())) is None:
            continue
        text, widths = got
        at = m.start() + np.concatenate([[0], np.cumsum(widths)])
        parts += [layer.text[last : m.start()], text]
        a += [starts[last : m.start()], starts[at[:-1]]]
        b += [ends[last : m.start()], ends[np.minimum(at[1:], m.end()) - 1]]
        last = m.end()
    if not parts:
        return None
    parts.append(layer.text[last:])
    return Layer("".join(parts), np.concatenate([*a, starts[last:]]), np.concatenate([*b, ends[last:]]))


def formed(layer: Layer) -> Layer | None:
    """The layer with + as a blank in words with percent escapes, as forms write it; None if there is none."""
    text = _FORM.sub(lambda m: m.group().replace("+", " "), layer.text)
    return None if text == layer.text else Layer(text, *layer.bounds())


def _opener(raw: bytes):
    """A decompressor for bytes that begin like a compressed run; None for others."""
    if raw[:3] == b"\x5d\x00\x00":
        return lzma.LZMADecompressor(format=lzma.FORMAT_ALONE, memlimit=128 << 20)
    if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=128 << 20)
    return None


def _begin(data: bytes) -> int:
    """Where the next window begins: at the last blank within a line that is OVERLAP bytes or more before the end."""
    end = max(0, len(data) - OVERLAP)
    while end > 0:
        start = max(0, end - OVERLAP)
        if found := [m.start() + 1 for m in _INNER_BLANK.finditer(data, start, end)]:
            return found[-1]
        end = start + 2 if start else 0
    return 0


def _texts(raw: bytes) -> Iterator[str]:
    """The parts of ``raw`` that are text and long enough for a secret."""
    for m in _TEXT.finditer(raw):
        if m.end() - m.start() >= LEAST_TEXT:
            yield m.group().decode("utf-8")


def _unpacked(raw: bytes) -> Iterator[str]:
    """Texts of a compressed run, window by window. Nothing if it is not compressed."""
    opener, held, data, size = _opener(raw), b"", raw, 0
    try:
        while opener:
            got = opener.decompress(data, MAX_LAYER)
            if opener.eof:
                data = opener.unused_data
                opener = _opener(data)
            else:
                data = getattr(opener, "unconsumed_tail", b"")
                if not got and not data:
                    break
            held, size = held + got, size + len(got)
            if opener and size >= MAX_LAYER:
                yield from _texts(held)
                held, size = held[_begin(held) :], 0
    except (zlib.error, OSError, EOFError, lzma.LZMAError):
        pass
    yield from _texts(held)


def _headless(raw: bytes) -> Iterator[str]:
    """Texts of bytes that are one whole zlib stream of a smaller window, or one whole raw deflate stream; what follows it must be short."""
    ways = [-15]
    if len(raw) > 2 and raw[0] & 15 == 8 and raw[0] < 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        ways.insert(0, 15)
    for bits in ways:
        opener, held, found, data = zlib.decompressobj(bits), b"", [], raw
        try:
            while not opener.eof and data:
                held += opener.decompress(data, MAX_LAYER)
                data = opener.unconsumed_tail
                if len(held) >= MAX_LAYER and not opener.eof:
                    found += _texts(held)
                    held = held[_begin(held) :]
        except zlib.error:
            continue
        if opener.eof and len(opener.unused_data) < 3:
            yield from found
            yield from _texts(held)
            return


def _escaped_bytes(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of each word whose percent or \\x escapes begin a compressed run."""
    for m in _PRINTED.finditer(text):
        if not _BYTE.search(m.group()):
            continue
        raw = re.sub(rb"(?:%|\\x)([0-9A-Fa-f]{2})", lambda x: bytes([int(x.group(1), 16)]), m.group().encode("ascii"))
        for packed in _PACKED.finditer(raw):
            yield m.start(), m.end(), raw[packed.start() :]


def _runs(text: str) -> Iterator[np.ndarray]:
    """The places of the characters of each base64 run, padding included."""
    for m in _BASE64.finditer(text):
        yield np.arange(m.start(), m.end())
    for m in _WRAPPED.finditer(text) if "\n" in text else ():
        # A shorter last line before other words may be a word itself, so the run is read without it too.
        unsure = m.end(1) < m.end() and text[m.end() - 1] != "=" and _WORDS_AFTER.match(text, m.end())
        for end in (m.end(1), m.end()) if unsure else (m.end(),):
            if "\n" in text[m.start() : end]:
                yield np.concatenate([np.arange(x.start(), x.end()) for x in _IN_RUN.finditer(text, m.start(), end)])


def _short_lines(text: str) -> Iterator[np.ndarray]:
    """The places of base64 runs wrapped at under 20 characters: LEAST_LINES lines or more of one length, and a shorter last one."""
    held, width, at = [], 0, 0

    def run() -> Iterator[np.ndarray]:
        if len(held) >= LEAST_LINES and sum(b - a for a, b in held) >= LEAST_RUN:
            yield np.concatenate([np.arange(a, b) for a, b in held])

    for line in text.split("\n"):
        m = _SHORT_LINE.match(line)
        size = m.end(1) - m.start(1) if m else 0
        place = (at + m.start(1), at + m.end(2)) if m else None
        if held and m and size == width and not m.group(2):
            held.append(place)
        else:
            if held and m and size <= width:  # the last line
                held.append(place)
                yield from run()
                held = []
            else:
                yield from run()
                held = [place] if m and not m.group(2) else []
                width = size
        at += len(line) + 1
    yield from run()


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """The layers that base64 runs of ``layer`` hold, compressed or not, and escaped words hold compressed."""
    starts, ends = layer.bounds()
    for a, b, raw in _escaped_bytes(layer.text) if ("%" in layer.text or "\\x" in layer.text) else ():
        for text in _unpacked(raw):
            yield Layer(text, np.full(len(text), starts[a]), np.full(len(text), ends[b - 1]))
    short = _short_lines(layer.text) if "\n" in layer.text else ()
    for at in itertools.chain(_runs(layer.text), short):
        whole = layer.text[at[0] : at[-1] + 1]
        if len(whole) > len(at):
            whole = "".join(_IN_RUN.findall(whole))
        whole = whole.rstrip("=").replace("-", "+").replace("_", "/")
        for step in range(4):
            run = whole[step:]
            if len(run) % 4 == 1:
                run = run[:-1]
            raw = base64.b64decode(run + "=" * (-len(run) % 4))
            for m in _TEXT.finditer(raw):
                if m.end() - m.start() < LEAST_TEXT:
                    continue
                text = m.group().decode("utf-8")
                if m.end() - m.start() < len(raw) and not base_spans(text) and not _HINT.search(text):
                    continue
                size = np.ones(len(text), np.int64) if text.isascii() else np.array([len(c.encode("utf-8")) for c in text], np.int64)
                stop = m.start() + np.cumsum(size)
                first, last = step + (stop - size) // 3 * 4, np.minimum(step + (stop - 1) // 3 * 4 + 4, len(at))
                yield Layer(text, starts[at[first]], ends[at[last - 1]])
            for m in _WIDE.finditer(raw):
                text = m.group()[m.group()[0] == 0 :: 2].decode("ascii")
                if base_spans(text) or _HINT.search(text):
                    stop = m.start() + 2 * np.arange(1, len(text) + 1)
                    first, last = step + (stop - 2) // 3 * 4, np.minimum(step + (stop - 1) // 3 * 4 + 4, len(at))
                    yield Layer(text, starts[at[first]], ends[at[last - 1]])
            if not _TEXT.match(raw) or len(_TEXT.match(raw).group()) < LEAST_TEXT:
                for text in _headless(raw):
                    yield Layer(text, np.full(len(text), starts[at[step]]), np.full(len(text), ends[at[-1]]))
            for m in _PACKED.finditer(raw):
                for text in _unpacked(raw[m.start() :]):
                    n = len(text)
                    yield Layer(text, np.full(n, starts[at[step + m.start() // 3 * 4]]), np.full(n, ends[at[-1]]))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base spans, all spans, different contents beside the text itself)."""
    base = base_spans(text)
    if not _HINT.search(text):
        return base, base, 0
    digest = lambda raw: hashlib.sha1(raw).digest()
    mark = digest(text.encode("utf-8", "replace"))
    spans, seen, work = set(base), set(), [(Layer(text), frozenset([mark]))]
    held = {mark: base}  # base spans by content
    while work:
        layer, above = work.pop()
        further = [unescaped(layer)] if ("%" in layer.text or "\\" in layer.text) else []
        if "%" in layer.text and "+" in layer.text and (form := formed(layer)):
            further.append(unescaped(form))
        for found in [*further, *unwrapped(layer)]:
            if found is None:
                continue
            mark = digest(found.text.encode("utf-8", "replace"))
            place = (mark, digest(found.starts.tobytes()), digest(found.ends.tobytes()))
            if place in seen:  # the same content from the same characters, by another way
                continue
            seen.add(place)
            if mark not in held:
                held[mark] = base_spans(found.text)
            for start, kind, end in held[mark]:
                a, b = found.origin(start, end)
                spans.add((a, kind, b))
            if mark not in above and _HINT.search(found.text):
                work.append((found, above | {mark}))
    return base, sorted(spans), len(held) - 1


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_RESULT = "n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long"


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base matches by kind, base_spans, spans, n_layers: one row for each row of ``docs``."""

    @F.pandas_udf(_RESULT)
    def found(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            base, spans, layers = scan(text or "")
            out.append((*(sum(k == n for _, k, _ in base) for n in range(3)), _joined(base), _joined(spans), layers))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers"])

    return docs.select("doc_id", found("text").alias("_f")).select("doc_id", "_f.*")


def op2_secrets(spark, sf_dir):
    found = secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_layers")
