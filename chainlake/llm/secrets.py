"""Secret scan: base patterns on the text, then a worklist of decoded layers, each scanned again and mapped back."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from chainlake.llm.common import record_batches, table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Encoded runs: percent escapes, backslash escapes, base64 of either alphabet on one line or wrapped. A run starts only
#: where its characters start and gives nothing back, so a scan takes time in proportion to the text.
_PLAIN = r"[A-Za-z0-9_.~+/=:;,?&@!$'()*-]"
_URL = re.compile(rf"(?<!{_PLAIN}){_PLAIN}*+(?:%[0-9A-Fa-f]{{2}}{_PLAIN}*+)++")
_ESCAPE = r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})"
_UNICODE = re.compile(rf"{_ESCAPE}(?:[A-Za-z0-9_.~+/=:;,\"'\x20-]*+{_ESCAPE})*+[A-Za-z0-9_.~+/=:;,\"'-]*+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{2,}+)++={0,2}")
_PERCENT_PIECE = re.compile(r"%[0-9A-Fa-f]{2}|.", re.DOTALL)
_ESCAPE_PIECE = re.compile(rf"{_ESCAPE}|.", re.DOTALL)
_SEPARATOR = re.compile(r"[+/_-]")
#: Where a gzip member or a zlib stream may start.
_HEADER = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]")
#: A compressed layer is expanded to its end, ``STEP`` bytes at once, and scanned in windows of at most ``WINDOW`` bytes.
#: Windows overlap by ``OVERLAP`` bytes and what of an unbroken run lies before them, up to half a window.
STEP = 1 << 20
WINDOW = 1 << 24
OVERLAP = 1 << 20
_OUTSIDE = re.compile(rb"[^A-Za-z0-9_.~+/=:;,?&@!$'()*%\\-]")

#: Where characters s to e of a layer stand: start and end in the outermost text, and a place inside compressed layers,
#: whose characters all stand at the run that holds them.
Place = Callable[[int, int], tuple[int, int, tuple]]
#: Start and end, in the layer above, of each character or byte of a decoded run.
Sources = Callable[[], tuple[np.ndarray, np.ndarray]]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping within a kind, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _texts(raw: bytes) -> list[tuple[str, Callable[[int, int], tuple[int, int]]]]:
    """Readings of ``raw``, each with the bytes that its characters s to e come from.

    UTF-8, or else Latin-1, which keeps what is ASCII; with zero bytes, UTF-16 of both orders and places. There a
    character stands at its low byte, so that two readings of one word give one place.
    """
    try:
        text = raw.decode("utf-8")
        out = [(text, lambda s, e: (len(text[:s].encode()), len(text[:e].encode())))]
    except UnicodeDecodeError:
        out = [(raw.decode("latin-1"), lambda s, e: (s, e))]
    if b"\0" in raw:
        for low, codec in enumerate(("utf-16-le", "utf-16-be")):
            for at in (0, 1):
                wide = raw[at:].decode(codec, "replace")
                unit = lambda i, wide=wide: len(wide[:i].encode("utf-16-le"))
                out.append((wide, lambda s, e, unit=unit, at=at, low=low: (at + unit(s) + low, min(at + unit(e) + low - 1, len(raw)))))
    return [x for x in out if x[0]]


def _lengths(pieces: list[str], start: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in pieces], np.int64)
    hi = start + np.cumsum(n)
    return hi - n, hi


def _unquoted(m: re.Match) -> tuple[bytes, Sources]:
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[0].encode("ascii"))
    return raw, lambda: _lengths(_PERCENT_PIECE.findall(m[0]), m.start())


def _unescaped(m: re.Match) -> tuple[str, Sources]:
    """Two escapes that are a surrogate pair are one character."""
    pieces = _ESCAPE_PIECE.findall(m[0])
    units = [chr(int(x[2:], 16)) if len(x) > 1 else x for x in pieces]
    out = "".join(units).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def sources() -> tuple[np.ndarray, np.ndarray]:
        lo, hi = _lengths(pieces, m.start())
        second = np.array([i > 0 and "\udc00" <= u <= "\udfff" and "\ud800" <= units[i - 1] <= "\udbff" for i, u in enumerate(units)])
        return lo[~second], hi[np.append(~second[1:], True)]

    return out, sources


def _from_base64(m: re.Match) -> Iterator[tuple[bytes, Sources]]:
    """Bytes of the run, and of its rest after a separator: once per place modulo 4, which holds what later ones of it hold."""
    run = m[0]
    body = "".join(run.split()).rstrip("=")
    starts = {0: 0}
    for x in _SEPARATOR.finditer(body, 0, max(0, len(body) - 16)):
        starts.setdefault(x.end() % 4, x.end())
        if len(starts) == 4:
            break
    body = body.replace("-", "+").replace("_", "/")
    for at in starts.values():
        part = body[at : len(body) - ((len(body) - at) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))

        def sources(at: int = at, n: int = len(raw)) -> tuple[np.ndarray, np.ndarray]:
            where = m.start() + np.flatnonzero([not c.isspace() for c in run]) if len(run) > len(body) + 2 else m.start() + np.arange(len(run))
            i = np.arange(n)
            first = at + 4 * (i // 3) + i % 3
            return where[first], where[first + 1] + 1

        yield raw, sources


def layers(text: str) -> Iterator[tuple[int, int, str | bytes, Sources]]:
    """(start, end, decoded, sources) of each encoded run of ``text``, decoded to text or bytes."""
    if "%" in text:
        for m in _URL.finditer(text):
            yield m.start(), m.end(), *_unquoted(m)
    if "\\" in text:
        for m in _UNICODE.finditer(text):
            out, sources = _unescaped(m)
            yield m.start(), m.end(), out, sources
            if _HEADER.search(raw := out.encode("latin-1", "replace")):
                yield m.start(), m.end(), raw, sources
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(text):
            for raw, sources in _from_base64(m):
                yield m.start(), m.end(), raw, sources


@dataclass(frozen=True)
class Finding:
    """A secret: its kind, its span in the text, the depth of its layer, its value.

    A decoded secret's span is that of the characters it was decoded from; in a compressed layer, that of the run.
    """

    kind: str
    start: int
    end: int
    depth: int
    value: str


class _Streams:
    """Compressed streams in bytes that come in blocks: each place with a header is tried, each stream expanded to its end."""

    def __init__(self, scan: _Scan, run: tuple[int, int, tuple], depth: int, above: tuple[bytes, ...] = ()):
        self.scan, self.run, self.depth, self.above = scan, run, depth, above
        self.edge = b""
        self.fed = 0
        self.open: list[tuple[object, _Expanded]] = []

    def feed(self, block: bytes) -> None:
        self.open = [(d, x) for d, x in self.open if self._expand(d, x, block)]
        data = self.edge + block
        for m in _HEADER.finditer(data):
            # A stream that expands to itself is not taken up again.
            if (head := data[m.start() : m.start() + 256]) not in self.above:
                d = zlib.decompressobj(31 if head[0] == 0x1F else 15)
                start, end, inner = self.run
                x = _Expanded(self.scan, (start, end, (*inner, self.fed - len(self.edge) + m.start())), self.depth, (*self.above, head))
                rest = memoryview(data)[m.start() :]
                # Most false headers fail in the first bytes.
                if self._expand(d, x, rest[:512]) and self._expand(d, x, rest[512:]):
                    self.open.append((d, x))
        self.fed += len(block)
        self.edge = data[-1:]

    def _expand(self, d, x: _Expanded, data) -> bool:
        """Whether the stream goes on after ``data``."""
        try:
            while True:
                out = d.decompress(data, STEP)
                if out:
                    x.feed(out)
                data = d.unconsumed_tail
                if d.eof or (not data and len(out) < STEP):
                    break
        except zlib.error:
            x.close()
            return False
        if d.eof:
            x.close()
        return not d.eof

    def close(self) -> None:
        for _, x in self.open:
            x.close()
        self.open = []


class _Expanded(_Streams):
    """What a stream expands to: scanned in windows, and searched for streams itself."""

    def __init__(self, *args):
        super().__init__(*args)
        self.held = bytearray()
        self.new = self.gone = 0

    def feed(self, block: bytes) -> None:
        self.held += block
        self.new += len(block)
        if len(self.held) >= WINDOW:
            self._scan(False)
            keep = len(self.held) - OVERLAP
            outside = next((i for i in range(keep, len(self.held) // 2, -1) if _OUTSIDE.match(self.held, i)), keep)
            del self.held[:outside]
            self.gone += outside
        super().feed(block)

    def _scan(self, last: bool) -> None:
        start, end, inner = self.run
        gone = self.gone

        def placed(to_bytes: Callable) -> Place:
            def place(s: int, e: int) -> tuple[int, int, tuple]:
                lo, hi = to_bytes(s, e)
                return start, end, (*inner, gone + lo, gone + hi)

            return place

        self.scan.take([(t, placed(b), self.depth, last) for t, b in _texts(bytes(self.held))])
        self.new = 0

    def close(self) -> None:
        if self.new:
            self._scan(True)
        self.held = bytearray()
        super().close()


class _Scan:
    """Findings of one text. A layer seen before in it at the same place is not taken up again, so encodings that lead
    back to themselves end."""

    def __init__(self):
        self.out: dict[tuple[int, int, tuple, str], Finding] = {}
        self.seen: set[tuple[bytes, int, int, tuple]] = set()

    def take(self, first: list[tuple[str, Place, int, bool]]) -> None:
        """Scan layers (text, place, depth, whether it ends there) and all that is encoded in them.

        What touches the end of a layer that goes on is left to the next window, which holds it whole.
        """
        work = deque(first)

        def add(layer: str, run: tuple[int, int, tuple], place: Place, depth: int) -> None:
            key = (xxhash.xxh3_128_digest(layer.encode("utf-8", "surrogatepass")), *run)
            if key not in self.seen:
                self.seen.add(key)
                work.append((layer, place, depth, True))

        while work:
            layer, place, depth, ends = work.popleft()
            for s, e, kind in base_spans(layer):
                if e == len(layer) and not ends and e - s < OVERLAP // 4:
                    continue
                start, end, inner = place(s, e)
                at = (start, end, inner, kind)
                if at not in self.out or depth < self.out[at].depth:
                    self.out[at] = Finding(kind, start, end, depth, layer[s:e])
            for s, e, decoded, sources in layers(layer):
                run = place(s, e)
                known: list = []

                def above(lo: int, hi: int, place=place, sources=sources, known=known) -> tuple[int, int, tuple]:
                    if not known:
                        known.extend(sources())
                    return place(int(known[0][lo]), int(known[1][max(lo, hi - 1)]))

                if isinstance(decoded, str):
                    add(decoded, run, above, depth + 1)
                    continue
                for t, to_bytes in _texts(decoded):
                    add(t, run, lambda lo, hi, above=above, to_bytes=to_bytes: above(*to_bytes(lo, hi)), depth + 1)
                streams = _Streams(self, run, depth + 1)
                streams.feed(decoded)
                streams.close()


def scan_text(text: str | None) -> list[Finding]:
    """All findings in ``text`` and in what is encoded or compressed in it, to any depth. NULL is empty.

    Compression counts with the encoding around it. Bytes that are no UTF-8 are read as Latin-1 and UTF-16. A secret that
    can be read in a text and in a decoding of it is one finding, of the lesser depth; two secrets of one run are two.
    """
    scan = _Scan()
    scan.take([(text or "", lambda s, e: (s, e, ()), 0, True)])
    return [f for _, f in sorted(scan.out.items(), key=lambda x: (x[0][0], KINDS.index(x[0][3]), x[0][1], x[0][2]))]


def findings(docs: DataFrame) -> DataFrame:
    """doc_id and findings (array of kind, start, end, depth, value) of every row's whole text.

    NULL and empty texts have none; repeated rows and rows with NULL doc_id are scanned each; findings are in the order of
    start, kind, end; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("value", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(one))])

    def f(c: dict[str, list]) -> dict[str, object]:
        return {"doc_id": c["doc_id"], "findings": [[vars(x) for x in scan_text(t)] for t in c["text"]]}

    return docs.select("doc_id", "text").mapInArrow(record_batches(f, schema), "doc_id long, findings array<struct<kind:string,start:long,end:long,depth:int,value:string>>")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans are the findings of depth 0, and a span that only a decoded layer has is an added one."""
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
    said = lambda found: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in found)

    def f(c: dict[str, list]) -> dict[str, object]:
        base = [[x for x in found if x["depth"] == 0] for found in c["findings"]]
        counts = {f"n_{k}": [sum(x["kind"] == k for x in b) for b in base] for k in KINDS}
        return {"doc_id": c["doc_id"], **counts, "base_sha256": [hashlib.sha256(said(b).encode()).hexdigest() for b in base], "spans": [said(x) for x in c["findings"]]}

    found = findings(table(spark, sf_dir, "documents"))
    return found.mapInArrow(record_batches(f, schema), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
