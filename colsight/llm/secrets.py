"""Secrets in documents and in what is encoded inside them.

A document is the first layer. A worklist takes layers one by one: each is scanned for secrets, and what is encoded in
it becomes layers of their own unless a layer around has the same text: the whole layer with its URL, Unicode and HTML
escapes resolved, and each base64 run (also one wrapped over lines, at every alignment, since what stands before the data
may look like base64 too) as bytes, as UTF-16, or as the gzip members or zlib data it holds. The work ends when nothing
new comes out. What a layer holds is remembered by its text for the document, and every place where it stands maps that
to spans of its own. A layer knows how its characters stand in the one around it, so a finding, however deep, is given
as a span of the document: escapes map character by character where they are of equal size, base64 by its groups of
four, compressed data as a whole. Secrets are ASCII, so a decoded byte is a character, whatever the bytes around it.
Decompressed data arrives in pieces of at most PIECE bytes with an overlap, so memory stays bounded and nothing is cut
off.

Defined cases: null and empty texts have no spans; findings of one kind with the same span count once; each row is
scanned by itself, whatever its doc_id; texts of any length are scanned whole; an empty table gives an empty result.
Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsight.llm.common import table

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP = 1 << 20, 4_096
#: Shortest base64 run that is tried; the patterns name it too.
LEAST_BASE64 = 16

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "apikey", "api_key")
ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of one run, as encoders wrap it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+\r?\n[\x20\t]*+)+[A-Za-z0-9+/_-]++={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: What a layer without a secret or anything encoded does not have.
WORTH = re.compile(
    rb"AKIA|(?i:passw|secret|token|api_?key)|[0-9a-f]{16}|%[0-9A-Fa-f]{2}|\\[ux][0-9A-Fa-f]{2}|&#|[A-Za-z0-9+/_-]{16}"
)

Mapping = Callable[[int, int], tuple[int, int]]
Span = tuple[int, int, int]  # start, number of the kind, end


def scan(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap and hold their condition."""
    found = []
    if any(hint in text.lower() for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _unescaped(code: str) -> str:
    if code[0] == "%":
        return bytes.fromhex(code.replace("%", "")).decode("utf-8", "replace")
    if code[0] == "&":
        return html.unescape(code)
    if code[1] == "x":
        return chr(int(code[2:], 16))
    units = b"".join(int(code[k + 2 : k + 6], 16).to_bytes(2, "big") for k in range(0, len(code), 6))
    return units.decode("utf-16-be", "replace")


class Segments:
    """How the characters of a layer stand in the one around it: each of a segment takes `step` of them, or the whole
    segment stands for all its characters (step 0)."""

    def __init__(self) -> None:
        self.outs: list[int] = []
        self.parts: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, length: int, start: int, end: int, step: int) -> None:
        if length:
            self.outs.append(self.size)
            self.parts.append((start, end, step))
            self.size += length

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        k, m = bisect_right(self.outs, start) - 1, bisect_right(self.outs, end - 1) - 1
        (first, _, step), (last, until, size) = self.parts[k], self.parts[m]
        return first + (start - self.outs[k]) * step, last + (end - self.outs[m]) * size if size else until


def _escapes(text: str) -> Iterator[tuple[str, Mapping]]:
    """The whole layer with its escapes resolved."""
    if not ("%" in text or "\\" in text or "&#" in text):
        return
    out, place, last = [], Segments(), 0
    for m in ESCAPE.finditer(text):
        plain, decoded = text[last : m.start()], _unescaped(m[0])
        out += [plain, decoded]
        place.add(len(plain), last, m.start(), 1)
        even = decoded and len(m[0]) % len(decoded) == 0
        place.add(len(decoded), m.start(), m.end(), len(m[0]) // len(decoded) if even else 0)
        last = m.end()
    if last:
        out.append(text[last:])
        place.add(len(text) - last, last, len(text), 1)
        yield "".join(out), place


def _inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of gzip members or zlib data; what precedes an error or the end of broken data still counts."""
    engine, tail = zlib.decompressobj(47), b""
    while data:
        try:
            piece = engine.decompress(data, PIECE)
        except zlib.error:
            return
        if piece:
            yield tail + piece
            tail = piece[-OVERLAP:]
        if engine.eof:
            data, engine = engine.unused_data, zlib.decompressobj(47)
        elif not piece and not engine.unconsumed_tail:
            return
        else:
            data = engine.unconsumed_tail


def _base64(text: str) -> Iterator[tuple[str, Mapping]]:
    for m in BASE64.finditer(text):
        start = m.start()
        yield from _decoded(m[0].rstrip("="), lambda s, e, start=start: (start + s, start + e), m.end())
    for m in WRAPPED.finditer(text):
        place, run = Segments(), []
        for line in LINE.finditer(text, m.start(), m.end()):
            run.append(line[0])
            place.add(len(line[0]), line.start(), line.end(), 1)
        yield from _decoded("".join(run), place, m.end())


def _decoded(run: str, place: Mapping, until: int) -> Iterator[tuple[str, Mapping]]:
    """What a base64 run holds from each of its first four characters on."""
    digits = run.replace("-", "+").replace("_", "/")
    for skip in range(4):
        size = len(digits) - skip
        size -= size % 4 == 1
        if size < LEAST_BASE64 - 3:
            return
        data = base64.b64decode(digits[skip : skip + size] + "=" * (-size % 4))
        end = place(0, skip + size)[1]
        end = until if skip + size == len(digits) else end
        if data[:2] == b"\x1f\x8b" or (data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
            whole = place(skip, skip + size)[0], end
            for piece in _inflated(data):
                yield from ((held, lambda s, e, whole=whole: whole) for held, _, _ in _texts(piece))
        for held, first, step in _texts(data):

            def within(s: int, e: int, first: int = first, step: int = step, skip: int = skip, size: int = size, end: int = end) -> tuple[int, int]:
                a, b = first + s * step, first + (e - 1) * step + 1
                last = -(-b * 4 // 3)
                return place(skip + a * 4 // 3, skip + min(last, size))[0], end if last >= size else place(skip, skip + last)[1]

            yield held, within


def _texts(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Texts that bytes may be, if anything in them is worth a look, each with its first byte and the step from one
    character to the next."""
    for first, step in ((0, 1), (0, 2), (1, 2)):
        if step == 2 and 2 * data[1 - first :: 2].count(0) <= len(data) // 2:
            continue
        if WORTH.search(held := data[first::step]):
            yield held.decode("latin-1"), first, step


@dataclass
class Layer:
    """A layer in work: its findings so far, its encoded parts still to come, its place in the layer around it, and the
    outermost layer around it whose text came again within it."""

    text: str
    found: set[Span]
    parts: Iterator[tuple[str, Mapping]]
    place: Mapping | None
    again: int


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The spans of the text itself, and those of all layers; both sorted."""
    base = sorted(scan(text))
    known: dict[str, set[Span]] = {}
    around: dict[str, int] = {}
    work: list[Layer] = []

    def enter(layer: str, place: Mapping | None) -> None:
        around[layer] = len(work)
        work.append(Layer(layer, set(scan(layer)), chain(_escapes(layer), _base64(layer)), place, len(work)))

    def take(found: set[Span], place: Mapping) -> None:
        for start, kind, end in found:
            start, end = place(start, end)
            work[-1].found.add((start, kind, end))

    enter(text, None)
    while True:
        now = work[-1]
        for inner, within in now.parts:
            if inner in known:
                take(known[inner], within)
            elif inner in around:
                now.again = min(now.again, around[inner])
            elif inner:
                enter(inner, within)
                break
        else:
            work.pop()
            del around[now.text]
            if not work:
                return base, sorted(now.found)
            # With a part left out because of a layer around it, the findings are whole in that layer only.
            if now.again >= len(work):
                known[now.text] = now.found
            work[-1].again = min(work[-1].again, now.again)
            take(now.found, now.place)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, counts of base spans by kind, base and all spans as texts."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [find(text) if text else ([], []) for text in (v.as_py() for v in batch.column(1))]
            counts = [[sum(s[1] == kind for s in base) for base, _ in results] for kind in range(len(KINDS))]
            bases = [joined(base) for base, _ in results]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in bases], pa.string()),
                    pa.array([joined(s) for _, s in results], pa.string()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scanned, schema)


def op6_secret_layers(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents", ["doc_id", "text"]))
