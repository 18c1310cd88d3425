"""Vectorised word hashing over Arrow string buffers.

The operators that count or compare words work on 64-bit hashes made straight from an
Arrow batch's UTF-8 buffer with numpy: no Python object is made per word. A word's hash is
a polynomial over its bytes modulo 2^64, finished with a bit mixer; n-word shingles combine
the word hashes of a window. Texts are taken whole, in pieces of about ``PIECE`` bytes that
end at document ends, so that memory is bounded by the piece or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; the input array is not changed."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(33))
        x = x * U(0xFF51AFD7ED558CCD)
        x ^= x >> U(33)
        x *= U(0xC4CEB9FE1A85EC53)
        x ^= x >> U(33)
    return x


#: One random odd number for each byte value.
BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE)) | U(1)
_powers = {"n": 0, "up": np.ones(0, U), "down": np.ones(0, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of the base and of its inverse; those for pieces of common length are kept between calls."""
    common = PIECE + PIECE // 4
    if n > common:
        return _made(n)
    if not _powers["n"]:
        up, down = _made(common)
        _powers.update(n=common, up=up, down=down)
    return _powers["up"], _powers["down"]


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, U(_STEP)), np.full(n, U(pow(_STEP, -1, 1 << 64)))
    up[0] = down[0] = U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _table(separators: bytes, keep: bytes | None) -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    if keep is not None:
        inside[:] = False
        inside[list(keep)] = True
    return inside


#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between ASCII white space, as ``[^\x20\x09-\x0D]+``.
SPACED = _table(b" \t\n\x0b\x0c\r", None)
#: Runs of letters and digits; every non-ASCII byte counts as a letter.
LETTERS = _table(b"", bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


@dataclass
class Words:
    """The words of some documents: per word its hash, place and document."""

    docs: slice  # rows of the batch
    data: np.ndarray  # folded bytes
    doc_start: np.ndarray  # byte offsets, one more than documents
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # index within docs
    first: np.ndarray  # index of each document's first word, one more than documents
    prefix: np.ndarray  # running polynomial sums, for hashes of parts of words

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of this piece."""
        with np.errstate(over="ignore"):
            raw = (self.prefix[end] - self.prefix[start]) * powers(len(self.data) + 1)[1][start]
            return mix(raw + U(_BASE) * (end - start).astype(U))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0, one more than rows) and bytes of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offs - offs[0], raw[offs[0] : offs[-1]]


def fold_latin(low: np.ndarray) -> np.ndarray:
    """ASCII is lower already; U+00C0-U+00DE (two bytes, C3 80-9E) go to U+00E0-U+00FE."""
    if len(low) > 1:
        upper = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def pieces(column: pa.Array, inside: np.ndarray = SPACED, latin: bool = False) -> Iterator[Words]:
    """The words of a string column, in pieces of whole documents of about PIECE bytes."""
    offs, raw = string_buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + PIECE, side="right")) - 1)
        yield words(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at], slice(at, to), inside, latin)
        at = to


def words(raw: np.ndarray, doc_start: np.ndarray, docs: slice, inside: np.ndarray, latin: bool) -> Words:
    data = LOWER[raw]
    if latin:
        data = fold_latin(data)
    n = len(data)
    mask = np.zeros(n + 1, bool)
    mask[:n] = inside[data]
    before = np.zeros(n + 1, bool)
    before[1:] = mask[:-1]
    before[doc_start[:-1]] = False
    start = np.flatnonzero(mask & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = mask[1:]
    cut = doc_start[1:] - 1
    after[cut[cut >= 0]] = False
    end = np.flatnonzero(mask & ~after) + 1
    up, down = powers(n + 1)
    prefix = np.zeros(n + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * up[:n], out=prefix[1:])
        h = mix((prefix[end] - prefix[start]) * down[start] + U(_BASE) * (end - start).astype(U))
    first = np.searchsorted(start, doc_start)
    doc = np.repeat(np.arange(len(doc_start) - 1), np.diff(first))
    return Words(docs, data, doc_start, h, start, end, doc, first, prefix)


def join_hash(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * U(_STEP) + more)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-word window in order; a document of 1 to n-1 words has one
    shingle, its whole sequence; one without words has none."""
    m = len(w.hash)
    count = np.diff(w.first)
    if m >= n:
        h = w.hash[: m - n + 1]
        for j in range(1, n):
            h = join_hash(h, w.hash[j : m - n + 1 + j])
        same = w.doc[: m - n + 1] == w.doc[n - 1 :]
        doc, h = w.doc[: m - n + 1][same], h[same]
    else:
        doc, h = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        s = w.hash[w.first[short]]
        for j in range(1, n - 1):
            more = count[short] > j
            s[more] = join_hash(s[more], w.hash[w.first[short][more] + j])
        s = mix(s + count[short].astype(U))
        doc, h = np.concatenate([doc, short]), np.concatenate([h, s])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    return doc, h


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hash): the sorted distinct shingles of each document, first[i]:first[i+1]."""
    doc, h = shingles(w, n)
    first = np.searchsorted(doc, np.arange(len(w.doc_start)))
    h = np.ascontiguousarray(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return np.searchsorted(doc, np.arange(len(w.doc_start))), h
