"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased; shingles are ``WORDS`` consecutive words (a shorter item is one
shingle). For an item of n words every window of n words of a document gets a 64-bit SimHash of its shingles. Two
fingerprints within ``RADIUS`` bits agree in one of ``BLOCKS`` blocks up to ``RADIUS // BLOCKS`` bits, so each item enters
the index under every block value within that distance: a look-up of a window's blocks finds every item within the
radius, without exception. Items are indexed by length, each block as lists of items by value, so a window meets only items of its own
length; windows are taken ``SLICE`` at a time and candidates ``AT_ONCE`` at a time, so a document that lists the whole benchmark needs no more
memory than any other of its length. Candidates within the radius are verified by weighted shingle similarity, the sum of
the lesser over the sum of the greater weights, where a shingle's weight is its count times its weight in the benchmark: 1 over
the number of items that hold it, 1 for any other shingle. A match is 0.8 or more.

A window without any shingle of its item has similarity 0, so windows are fingerprinted only around shingles
that occur in some item of their length; this drops no match. A document with fewer words than an item is one window as a whole, held against
the items of any greater length: shared shingles weigh little, so no bound on the length follows from 0.8. The index is broadcast: a benchmark whose index would pass ``LARGEST``
bytes is dealt out in several parts, each against all documents. Weights are counted once over the whole benchmark and are the
same in every part; those other than 1 go with each part, 16 bytes a shingle. The radius holds 99.9 of 100 windows at the least
similarity (the expected distance there is about 10 bits of 64); a test states the recall against brute force.

Result: one row for each (document, item) that match, with the best window: doc_id, item_id, start_word, n_words, similarity.
Null and empty texts and items match nothing; repeated rows are each reported; ties go to the first window. No items, no rows.
An item of fewer than WORDS words is one shingle and matches wherever a document has the same words in a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.llm import stages, textvec

WORDS, LEAST = 5, 0.8
BLOCKS, RADIUS = 8, 20
LARGEST = 64 << 20
#: Windows fingerprinted, and candidate pairs compared, at a time.
SLICE, AT_ONCE = 4096, 1 << 18


def near_values(bits: int, radius: int) -> np.ndarray:
    """All masks of up to ``radius`` of ``bits`` bits."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)], np.int64)


def bit_signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each hash."""
    raw = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 signed sums; zero counts as unset."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Shared:
    """Shingles that several items of the whole benchmark hold, by hash, and the number of those items."""

    hash: np.ndarray
    items: np.ndarray

    def weights(self, s: np.ndarray) -> np.ndarray:
        """The weight of each shingle: 1 over the number of items that hold it, 1 for any other."""
        out = np.ones(len(s))
        if len(self.hash) and len(s):
            at = np.minimum(np.searchsorted(self.hash, s), len(self.hash) - 1)
            hit = self.hash[at] == s
            out[hit] = 1 / self.items[at[hit]]
        return out


@dataclass
class Index:
    ids: np.ndarray
    words: np.ndarray  # length of each item in words
    prints: np.ndarray
    shingles: list[dict[int, int]]  # counts by hash
    shared: Shared
    known: np.ndarray  # sorted hashes of all shingles
    held_by: tuple[np.ndarray, np.ndarray]  # starts [known's place] and lengths of the items that hold it
    blocks: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: starts [block * values + value] and items' places


def shingle_run(w: textvec.Words, doc: int) -> tuple[np.ndarray, int]:
    """The shingles of one document in order and its number of words."""
    h = w.hash[w.first[doc] : w.first[doc + 1]]
    m = len(h)
    if m == 0:
        return np.zeros(0, np.uint64), 0
    n = min(WORDS, m)
    s = h[: m - n + 1]
    for j in range(1, n):
        s = textvec.join_hash(s, h[j : m - n + 1 + j])
    return (s if n == WORDS else textvec.mix(s + np.uint64(n))), m


def item_runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, words, shingles in order) of every text that has words."""
    for w in textvec.pieces(texts, textvec.LETTERS, latin=True):
        for d in range(len(w.doc_start) - 1):
            s, m = shingle_run(w, d)
            if m:
                yield w.docs.start + d, m, s


def shared_shingles(benchmark: DataFrame, text_col: str = "text") -> Shared:
    """The shingles that more than one row of the whole benchmark holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.unique(s) for _, _, s in item_runs(b.column(0))]
            if runs:
                s, k = np.unique(np.concatenate(runs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(k.astype(np.int64))], ["shingle", "k"])

    each = benchmark.select(F.col(text_col).cast("string")).mapInArrow(stages.tidied(count), "shingle long, k long")
    got = each.groupBy("shingle").agg(F.sum("k").alias("k")).filter("k > 1").toArrow()
    s, k = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(s.view(np.uint64))
    return Shared(s.view(np.uint64)[order], k[order])


def index_of(ids: np.ndarray, texts: pa.Array, shared: Shared) -> Index:
    got = [(ids[row], m, s) for row, m, s in item_runs(texts)]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for _, _, s in got)]))
    prints = np.array([fingerprints((bit_signs(s) * shared.weights(s).astype(np.float32)[:, None]).sum(axis=0)[None])[0] for _, _, s in got], np.uint64)
    shingles = [dict(zip(*(x.tolist() for x in np.unique(s, return_counts=True)), strict=True)) for _, _, s in got]
    length = np.array([x[1] for x in got], np.int64)
    blocks = {int(n): block_lists(np.flatnonzero(length == n), prints) for n in np.unique(length)}
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([np.searchsorted(known, s), np.full(len(s), m)], axis=1) for _, m, s in got)]), axis=0)
    held_by = np.searchsorted(pairs[:, 0], np.arange(len(known) + 1)), pairs[:, 1]
    return Index(np.array([x[0] for x in got], np.int64), length, prints, shingles, shared, known, held_by, blocks)


BITS = 64 // BLOCKS
VALUES = 1 << BITS


def block_values(fp: np.ndarray) -> np.ndarray:
    """[block, fingerprint]: the value of each block, told apart by block."""
    at = np.arange(BLOCKS, dtype=np.uint64)[:, None]
    return ((fp[None] >> at * np.uint64(BITS)) & np.uint64(VALUES - 1)).astype(np.int64) + at.astype(np.int64) * VALUES


def block_lists(items: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every block and value the items that have a value within the blocks' distance of it."""
    near = block_values(prints[items])[:, :, None] ^ near_values(BITS, RADIUS // BLOCKS)
    value, item = near.ravel(), np.broadcast_to(items[None, :, None], near.shape).ravel()
    order = np.argsort(value, kind="stable")
    return np.searchsorted(value[order], np.arange(BLOCKS * VALUES + 1)), item[order].astype(np.int32)


def lookup(index: Index, n: int, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in fp, item's place) of all items of n words within the radius."""
    starts, items = index.blocks[n]
    value = block_values(fp)
    many = (starts[value + 1] - starts[value]).sum(axis=0)
    done = np.cumsum(many)
    at = 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + AT_ONCE, side="right")))
        v = value[:, at:to].ravel()
        k = starts[v + 1] - starts[v]
        place = np.repeat(np.tile(np.arange(at, to), BLOCKS), k)
        found = items[np.repeat(starts[v] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        ok = np.bitwise_count(fp[place] ^ index.prints[found]) <= RADIUS
        key = np.unique(place[ok] * len(index.ids) + found[ok])
        if len(key):
            yield key // len(index.ids), key % len(index.ids)
        at = to


def short_matches(short: dict[int, dict[int, list[int]]], w: textvec.Words) -> dict[int, dict[int, tuple[float, int, int]]]:
    """By document and item's place the first window that equals an item of fewer than WORDS words."""
    out: dict[int, dict[int, tuple[float, int, int]]] = {}
    for n, items in short.items():
        doc, s = textvec.shingles(w, n)
        whole = np.diff(w.first)[doc] >= n
        doc, s = doc[whole], textvec.mix(s[whole] + np.uint64(n))
        start = np.arange(len(doc)) - np.searchsorted(doc, doc)
        at = np.flatnonzero(np.isin(s, np.array(list(items), np.uint64)))
        _, once = np.unique(np.stack([doc[at].astype(np.uint64), s[at]]), axis=1, return_index=True)
        for j in at[once].tolist():
            for i in items[int(s[j])]:
                out.setdefault(int(doc[j]), {})[i] = (1.0, int(start[j]), n)
    return out


def matches(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item's place, start word, words, similarity) of every match."""
    lengths = np.unique(index.words)
    short: dict[int, dict[int, list[int]]] = {n: defaultdict(list) for n in lengths[lengths < WORDS].tolist()}
    for i in np.flatnonzero(index.words < WORDS).tolist():
        for x in index.shingles[i]:
            short[int(index.words[i])][x].append(i)
    filter_bits = np.zeros(1 << 16, bool)
    filter_bits[(index.known & np.uint64(0xFFFF)).astype(np.int64)] = True
    for w in textvec.pieces(column, textvec.LETTERS, latin=True):
        doc, s = textvec.shingles(w, WORDS)
        maybe = np.flatnonzero(filter_bits[(s & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(index.known, s[maybe]), len(index.known) - 1)
        same = index.known[at] == s[maybe]
        hits, which = maybe[same], at[same]
        exact = short_matches(short, w)
        if not len(hits) and not exact:
            continue
        first = np.searchsorted(doc, np.arange(len(w.doc_start)))
        for d in sorted({*np.unique(doc[hits]).tolist(), *exact}):
            own = s[first[d] : first[d + 1]]
            words = int(w.first[d + 1] - w.first[d])
            a, z = np.searchsorted(hits, (first[d], first[d + 1]))
            k = index.held_by[0][which[a:z] + 1] - index.held_by[0][which[a:z]]
            place = np.repeat(hits[a:z] - first[d], k)
            held = index.held_by[1][np.repeat(index.held_by[0][which[a:z]] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            lengths = np.unique(held[held >= WORDS])
            weights = index.shared.weights(own).astype(np.float32)
            best: dict[int, tuple[float, int, int]] = exact.get(d, {})
            if len(lengths) and WORDS <= words < lengths[-1]:
                fp = fingerprints(np.round((bit_signs(own) * weights[:, None]).sum(axis=0, dtype=np.float64), 6)[None])
                for n in lengths[lengths > words].tolist():
                    for _, item in lookup(index, n, fp):
                        for i in item.tolist():
                            sim = similarity(index, own, i)
                            if sim >= LEAST:
                                best[i] = (sim, 0, words)
            for n in lengths[lengths <= words].tolist():
                n_sh, near = n - WORDS + 1, place[held == n]
                # starts of windows of n words that hold a hit
                touched = np.zeros(len(own) + 1, np.int64)
                np.add.at(touched, np.maximum(near - n_sh + 1, 0), 1)
                np.add.at(touched, np.minimum(near, len(own) - n_sh) + 1, -1)
                starts = np.flatnonzero(np.cumsum(touched[:-1])[: len(own) - n_sh + 1] > 0)
                for at in range(0, len(starts), SLICE):
                    some = starts[at : at + SLICE]
                    for group in np.split(some, np.flatnonzero(np.diff(some) > n_sh) + 1):
                        lo, hi = int(group[0]), int(group[-1]) + n_sh
                        run = np.zeros((hi - lo + 1, 64), np.float64)
                        np.cumsum(bit_signs(own[lo:hi]) * weights[lo:hi, None], axis=0, out=run[1:])
                        fp = fingerprints(np.round(run[group - lo + n_sh] - run[group - lo], 6))
                        for win, item in lookup(index, n, fp):
                            for g, i in zip(group[win].tolist(), item.tolist(), strict=True):
                                sim = similarity(index, own[g : g + n_sh], i)
                                if sim >= LEAST and (i not in best or sim > best[i][0]):
                                    best[i] = (sim, g, n)
            for i, (sim, g, n) in sorted(best.items()):
                yield w.docs.start + d, i, g, n, sim


def similarity(index: Index, window: np.ndarray, item: int) -> float:
    """Weighted Jaccard similarity of a window's and an item's shingles."""
    theirs = index.shingles[item]
    mine: dict[int, int] = defaultdict(int)
    for x in window.tolist():
        mine[x] += 1
    every = list(mine | theirs)
    weight = dict(zip(every, index.shared.weights(np.array(every, np.uint64)).tolist(), strict=True))
    low = sum(min(k, theirs.get(x, 0)) * weight[x] for x, k in mine.items())
    high = sum(max(k, theirs.get(x, 0)) * weight[x] for x, k in mine.items()) + sum(k * weight[x] for x, k in theirs.items() if x not in mine)
    return low / high if high else 0.0


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark's index in parts of bounded size."""
    per = BLOCKS * len(near_values(BITS, RADIUS // BLOCKS)) * 4  # bytes of the block lists for each item
    ids, texts, size = [], [], 0
    shared = shared_shingles(benchmark, text_col)
    for row in benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += per + 100 * (len(row[1]) // 4 + 1)
        if size > LARGEST:
            yield index_of(np.array(ids), pa.array(texts, pa.large_string()), shared)
            ids, texts, size = [], [], 0
    if ids:
        yield index_of(np.array(ids), pa.array(texts, pa.large_string()), shared)


SHAPE = "item_id long, start_word long, n_words long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, start_word, n_words, similarity) of every match; items without an id are left out."""
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = None
    for index in indexes(benchmark.filter("item_id is not null")):
        if not len(index.ids):
            continue
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                got = list(matches(held.value, b.column(1)))
                item = held.value.ids
                cols = [pa.array([item[x[1]] for x in got], pa.int64()), *(pa.array([x[k] for x in got], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64())))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in got], pa.int64())), *cols], [id_col, "item_id", "start_word", "n_words", "similarity"])

        part = docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(stages.tidied(run), f"`{id_col}` {kind}, {SHAPE}")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"`{id_col}` {kind}, {SHAPE}")


def _free_of(held: Broadcast) -> Callable[[F.Column], F.Column]:
    def kept(text: pa.Array) -> pa.Array:
        keep = np.ones(len(text), bool)
        keep[[x[0] for x in matches(held.value, text)]] = False
        return pa.array(keep)

    @F.arrow_udf("boolean")
    def free(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from stages.tidied(lambda xs: map(kept, xs))(texts)

    return free


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that match no item."""
    for index in indexes(benchmark.filter("item_id is not null")):
        if not len(index.ids):
            continue
        docs = docs.filter(_free_of(docs.sparkSession.sparkContext.broadcast(index))(F.col(f"`{text_col}`").cast("string")))
    return docs
