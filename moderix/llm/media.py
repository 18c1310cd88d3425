"""Media columns: pages as ordered sequences of texts and media references, resolved by digest.

``sequences`` parses HTML into an array of (pos, kind, text, ref, caption) in document order: ``text`` items hold
the text between media, ``media`` items the reference of an ``img``, ``video``, ``audio`` or ``source`` element (its
``src``) and as caption the ``figcaption`` of its figure, or else its ``alt``. ``resolve`` joins the references
``sha256:HEX`` with a media table by digest: each item keeps page, position and caption, an unknown digest stays
with null features. Only features, made once for each distinct payload, meet the references; payloads do not
travel to every page that shows them, so a payload that a third of all pages show costs no more than any other.

Stored form: 8-bit greyscale PNG, ``WIDTH`` samples a line, written and read here. ``png`` uses filter type 0;
``unpng`` reads all five types and checks every CRC.

Null and empty HTML give an empty array; a figure without a medium gives only its text; scripts and styles give nothing. Malformed
HTML never fails: a broken declaration is left out up to its ``>``, a caption ends with its figure at the latest, and what is open at the end is closed.
Repeated pages and payloads each count; a repeated digest among the payloads is one. Only the named columns are read, whatever else there is. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.llm import stages

WIDTH, UNIT, PAD = 64, 576, 255
MAGIC = b"\x89PNG\r\n\x1a\n"
ITEM = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def padded(data: bytes) -> bytes:
    """data and as many bytes 255 as make it a positive multiple of UNIT."""
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes, level: int = 1) -> bytes:
    """A payload of a multiple of WIDTH bytes as a greyscale image, one sample a byte."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(lines), WIDTH + 1), np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def unpng(stored: bytes) -> tuple[int, int, bytes]:
    """(width, height, samples) of an 8-bit greyscale image."""
    if stored[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("CRC")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit greyscale without interlacing")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if not raw[:, 0].any():
        return width, height, np.ascontiguousarray(raw[:, 1:]).tobytes()
    out = np.zeros((height + 1, width + 1), np.uint8)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:]
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y + 1, 1:] = line + out[y, 1:]
        else:
            for x in range(width):
                a, b, c = int(out[y + 1, x]), int(out[y, x + 1]), int(out[y, x])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                    guess = (a, b, c)[near.index(min(near))]
                out[y + 1, x + 1] = (int(line[x]) + guess) & 255
    return width, height, out[1:, 1:].tobytes()


class _Sequence(HTMLParser):
    """Items of one page in order."""

    MEDIA, HIDDEN = {"img", "video", "audio", "source"}, {"script", "style", "template", "noscript"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[int] = []
        self.caption: list[str] | None = None

    def put_text(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        self.words.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def end_caption(self) -> None:
        """Give an open caption to the media of its figure, or keep it as text where there are none."""
        if self.caption is None:
            return
        text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
        self.caption = None
        media = [x for x in self.items[self.figures[-1] :] if x["kind"] == "media"]
        for x in media:
            x["caption"] = text
        if not media:
            self.words.append(text)
            self.put_text()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no such section in HTML
            return self.rawdata.find(">", i) + 1 or -1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.MEDIA and (ref := dict(attrs).get("src")):
            self.put_text()
            self.items.append({"kind": "media", "text": None, "ref": ref, "caption": dict(attrs).get("alt")})
        elif tag == "figure":
            self.end_caption()
            self.put_text()
            self.figures.append(len(self.items))
        elif tag == "figcaption" and self.figures:
            self.end_caption()
            self.put_text()
            self.caption = []
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "td", "tr"):
            self.words.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_caption()
            self.put_text()
            self.figures.pop()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "td", "tr"):
            self.words.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parsed(html: str | None) -> list[dict]:
    page = _Sequence()
    page.feed(html or "")
    page.close()
    page.end_caption()
    page.put_text()
    return [{"pos": i, **x} for i, x in enumerate(page.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items) of every page."""
    kind = pages.select(id_col).schema[0].dataType.simpleString()
    item = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parsed(x) for x in b.column(1).to_pylist()], item)], [id_col, "items"])

    return pages.select(id_col, F.col(html_col).alias("html")).mapInArrow(stages.tidied(run), f"`{id_col}` {kind}, items {ITEM}")


def stored(payloads: DataFrame) -> DataFrame:
    """(digest, media) of (digest, payload): the distinct payloads in stored form, one row a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = [(d, p) for d, p in zip(b.column(0).slice(at, 500).to_pylist(), b.column(1).slice(at, 500).to_pylist(), strict=True) if d not in done]
                part = list(dict(part).items())
                if len(done) < 100_000:
                    done.update(d for d, _ in part)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.string()), pa.array([png(padded(p or b"")) for _, p in part], pa.binary())], ["digest", "media"])

    made = payloads.select("digest", "payload").mapInArrow(stages.tidied(run), "digest string, media binary")
    return made.groupBy("digest").agg(F.first("media").alias("media"))


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(media: DataFrame) -> DataFrame:
    """Read the stored bytes back and describe the samples; feature: image size, mean, deviation and entropy."""

    def one(stored: bytes) -> tuple:
        width, height, payload = unpng(stored)
        samples = np.frombuffer(payload, np.uint8)
        share = np.bincount(samples, minlength=256) / len(samples)
        mean = float(share @ np.arange(256))
        spread = float(share @ (np.arange(256) - mean) ** 2) ** 0.5
        seen = share[share > 0]
        said = f"png {width}x{height} mean={mean:.4f} sd={spread:.4f} bits={max(0.0, -float(seen @ np.log2(seen))):.4f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                got = list(zip(*(one(m) for m in b.column(1).slice(at, 500).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), *(pa.array(x) for x in got)], [x.split()[0] for x in FEATURES.split(", ")])

    return media.mapInArrow(stages.tidied(run), FEATURES)


def resolve(items: DataFrame, known: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, pos, caption, digest, features of the payload) of each media item, by digest join."""
    media = items.select(id_col, F.explode("items").alias("item")).filter("item.kind = 'media'")
    refs = media.select(id_col, "item.pos", "item.caption", F.regexp_replace("item.ref", "^sha256:", "").alias("digest"))
    return refs.join(known, "digest", "left")
