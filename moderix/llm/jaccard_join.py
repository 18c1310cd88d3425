"""N-gram Jaccard join: a size-aware heavy-light self-join of word-shingle sets.

Light sets (size up to a boundary) enumerate their fixed-size subsets: two sets whose intersection has to be
at least c share a subset of c elements, so one hash per c-subset finds the pair. Heavy sets scan inverted
lists: the elements of a set are ranked by a global order, rare ones first, and two sets that link share an
element among the first ``size - ceil(t * size) + 1`` of each. The boundary is the one of least estimated
cost, from the histogram of set sizes and the mean length of the lists. Every candidate is then verified
exactly on whole texts.

* Sets that are equal are one class: copies inside a task enter the lists once, those of several tasks are one node.
* The order comes from a count sketch of fixed size; any order is right, a good one makes lists short.
* Postings leave the task that makes them packed by range of keys: keys cut to 48 bits as differences, sets as numbers
  within the task, about 7 bytes a posting. A key that meets another by its cut costs a look, never a link.
* Lists of up to ``SHORT`` sets give all their pairs. In longer lists the members of a size band meet one
  hub first; after that only pairs whose ends are still in different components are tried, so a large
  group of near copies costs about one verification per member, and no link between components is lost.
* A key with many sets inside one task, or whose elements the sketch counts ``HOT`` times, leaves its task as single
  rows, so no task gathers a whole hot list.
* Texts that are shuffled travel compressed.
* Candidates are verified in blocks of about ``PER_BLOCK`` shingles, however many these are; pairs with a neighbour in common share a block, so that
  most texts are sent once.

Results: one row per input row; component_id is the least doc_id reachable by links. A null or empty text has
an empty set, links with nothing and is its own component. A null doc_id gives a null component. Rows that share a doc_id
and differ in their sets are nodes of their own (component_id is then the least doc_id among those that their set reaches);
equal rows are one node. An empty table gives no rows. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from moderix.llm import stages, textvec

SKETCH = 1 << 21
SHORT = 32
LOCAL = 256
#: Most subsets that a light set may have.
SUBSETS = 3000
#: A list key that the sketch counts this often goes out as single rows.
HOT = 20_000
#: Postings that a task packs at a time, and those of one range of keys, about.
FLUSH, PER_RANGE = 1_000_000, 500_000
#: Shingles of both ends of the candidate pairs that are verified in one block, about.
PER_BLOCK = 400_000
#: Rounds in which the members that a list's main component lacks try a few of its members each.
ROUNDS, HUBS = 1, 6
#: Bits of a set's parity sketch.
PARITY = 1024


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def least(self, size: int) -> int:
        """Fewest elements that a set of this size shares with any set that it links with."""
        return -(-self.num * size // self.den)

    def links(self, a: int, b: int, common: int) -> bool:
        return common > 0 and self.den * common >= self.num * (a + b - common)


@lru_cache(256)
def _left_out(size: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(size), k)), np.int64).reshape(-1, k)


def subset_count(size: int, t: Threshold) -> int:
    return sum(comb(size, k) for k in range(size - t.least(size) + 1))


def subset_keys(h: np.ndarray, t: Threshold) -> np.ndarray:
    """One key for each subset of every size from least(size) to size."""
    size, out = len(h), []
    with np.errstate(over="ignore"):
        e = textvec.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        total = e.sum(dtype=np.uint64)
        for k in range(size - t.least(size) + 1):
            gone = e[_left_out(size, k)].sum(axis=1, dtype=np.uint64) if k else np.zeros(1, np.uint64)
            out.append(textvec.mix(total - gone + np.uint64(size - k) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(out)


def list_keys(h: np.ndarray, level: np.ndarray, t: Threshold) -> np.ndarray:
    """The first elements of a set in the global order: by level, then by hash."""
    need = len(h) - t.least(len(h)) + 1
    rank = (level[(h & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    return h[np.argsort(rank, kind="stable")[:need]]


def parities(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each set the parity of its elements in each of PARITY cells, as 64-bit words. Two sketches differ in at most as
    many bits as the sets in elements, which bounds their similarity from above."""
    sets = len(first) - 1
    cell = np.repeat(np.arange(sets) * PARITY, np.diff(first)) + (h >> np.uint64(20)).astype(np.int64) % PARITY
    odd = (np.bincount(cell, minlength=sets * PARITY) & 1).astype(np.uint8).reshape(sets, PARITY)
    return np.packbits(odd, axis=1).view(np.int64)


def may_link(num: int, den: int) -> F.Column:
    """size, a_size, parity and a_parity allow a link: at most (1 - t) / (1 + t) of all elements may differ."""
    differ = F.aggregate(F.zip_with("parity", "a_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return differ * (den + num) <= (F.col("size") + F.col("a_size")) * (den - num)


def _sketch(docs: DataFrame, n: int, t: Threshold) -> tuple[np.ndarray, int, int]:
    """Levels of the count sketch (8 bits a counter, 2 MB), the boundary between light and heavy, and the number of postings, about."""
    sizes = 64

    def fill(b: pa.RecordBatch, own: np.ndarray) -> None:
        for w in textvec.pieces(b.column(0)):
            first, h = textvec.shingle_sets(w, n)
            at = (h & np.uint64(SKETCH - 1)).astype(np.int64)
            own[:SKETCH] += np.bincount(at, minlength=SKETCH).astype(np.uint32)
            own[SKETCH : SKETCH + sizes] += np.bincount(np.minimum(np.diff(first), sizes - 1), minlength=sizes).astype(np.uint32)

    got = stages.table_sum(docs.select("text"), fill, SKETCH + 64 * 64)
    counts, by_size = got[:SKETCH].astype(np.float64), got[SKETCH : SKETCH + sizes].astype(np.float64)
    total = max(1.0, counts.sum())
    scanned = max(1.0, ((counts**2).sum() - total * total / SKETCH) / total)
    best, boundary, light = None, 0, 0.0
    for x in range(sizes - 1):
        if x and subset_count(x, t) > SUBSETS:
            break
        light += by_size[x] * subset_count(x, t) if x else 0
        heavy = sum(by_size[s] * (s - t.least(s) + 1) * scanned for s in range(x + 1, sizes - 1))
        if best is None or light + heavy < best:
            best, boundary = light + heavy, x
    postings = sum(by_size[x] * subset_count(x, t) for x in range(1, boundary + 1)) + total * (1 - t.num / t.den) + by_size.sum()
    return _levels(counts), boundary, int(postings)


def _levels(counts: np.ndarray | int) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(1 + np.asarray(counts, np.float64)))).astype(np.uint8)


def squeezed(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes, without those that are all zero."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = np.flatnonzero(planes.any(axis=1))
    return bytes([int((1 << used).sum())]) + planes[used].tobytes()


def widened(blob: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """(the numbers that ``squeezed`` packed at this place, the place behind them)."""
    used = [k for k in range(8) if blob[at] >> k & 1]
    planes = np.zeros((n, 8), np.uint8)
    planes[:, used] = np.frombuffer(blob, np.uint8, n * len(used), at + 1).reshape(len(used), n).T
    return planes.view("<u8").ravel(), at + 1 + n * len(used)


def packed(key: np.ndarray, ref: np.ndarray, size: np.ndarray) -> bytes:
    """Postings in order of key (48 bits)."""
    ref = ref.astype(np.uint64)
    low = ref.min()
    step = np.diff(key, prepend=key[:1])
    return struct.pack("<QQQ", len(key), int(key[0]), int(low)) + squeezed(step) + squeezed(ref - low) + squeezed(size.astype(np.uint64))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, key, low = struct.unpack_from("<QQQ", blob)
    step, at = widened(blob, 24, n)
    ref, at = widened(blob, at, n)
    size, _ = widened(blob, at, n)
    return np.cumsum(step, dtype=np.uint64) + np.uint64(key), ref + np.uint64(low), size


SETS = "kind int, doc_id long, ref long, n_shingles long, s1 long, s2 long, parity array<long>, part long, blob binary, key long"
DOC, BLOB, SINGLE = 0, 1, 2


def _sets(docs: DataFrame, n: int, t: Threshold, level: np.ndarray, boundary: int, ranges: int) -> DataFrame:
    """Rows of kind DOC for every row of docs: doc_id, n_shingles, two halves of the set's digest; ref (task and number in it) and
    parity sketch are null in all but the first of a task's copies that have a doc_id. Rows of kind BLOB: packed postings of one range of keys.
    Rows of kind SINGLE: one posting (key, ref, n_shingles)."""
    held = docs.sparkSession.sparkContext.broadcast(level)
    hot = _levels(HOT)

    def batch(kind: int, rows: int, **cols: pa.Array) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "parity": pa.list_(pa.int64()), "blob": pa.binary()}
        names = [x.split()[0] for x in SETS.split(", ")]
        cols["kind"] = pa.array(np.full(rows, kind, np.int32))
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(rows, types.get(c, pa.int64())) for c in names], names)

    def blobs(posts: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        many = [len(x[0]) for x in posts]
        key = np.concatenate([x[0] for x in posts]) >> np.uint64(16)
        ref, size = (np.repeat(np.array([x[k] for x in posts], np.int64), many) for k in (1, 2))
        order = np.argsort(key, kind="stable")
        key, ref, size = key[order], ref[order], size[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[starts, len(key)])
        alone = np.repeat(length > LOCAL, length)
        if alone.any():
            yield batch(SINGLE, int(alone.sum()), key=pa.array(key[alone].astype(np.int64)), ref=pa.array(ref[alone]), n_shingles=pa.array(size[alone]))
            # a posting of size 0 tells other tasks' postings of the key that its list is long
            mark = starts[length > LOCAL]
            alone[mark], size[mark] = False, 0
        key, ref, size = key[~alone], ref[~alone], size[~alone]
        part = (key >> np.uint64(12)) * np.uint64(ranges) >> np.uint64(36)
        cuts = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(key)]
        made = [packed(key[a:z], ref[a:z], size[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        for a in range(0, len(made), 1000):
            b = made[a : a + 1000]
            yield batch(BLOB, len(b), part=pa.array(part[cuts[a : a + len(b)]].astype(np.int64)), blob=pa.array(b, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        seen: set[bytes] = set()
        posts: list[tuple[np.ndarray, int, int]] = []
        refs = amount = 0
        for b in batches:
            for w in textvec.pieces(b.column(1)):
                first, h = textvec.shingle_sets(w, n)
                bounds, sig, ref, new = first.tolist(), [], [], []
                ids = b.column(0).slice(w.docs.start, w.docs.stop - w.docs.start).cast(pa.int64())
                for i, (a, z, ok) in enumerate(zip(bounds[:-1], bounds[1:], ids.is_valid().to_pylist(), strict=True)):
                    own = h[a:z]
                    digest = digest_of(own)
                    sig.append(digest)
                    if z == a or not ok or digest in seen:
                        ref.append(None)
                        continue
                    if len(seen) < 200_000:
                        seen.add(digest)
                    ref.append(base + refs)
                    new.append(i)
                    made = [subset_keys(own, t)] if z - a <= boundary else []
                    if z - a > boundary or z - a >= t.least(boundary + 1):
                        listed = list_keys(own, held.value, t)
                        common = held.value[(listed & np.uint64(SKETCH - 1)).astype(np.int64)] >= hot
                        if common.any():
                            k = listed[common] >> np.uint64(16)
                            yield batch(SINGLE, len(k), key=pa.array(k.astype(np.int64)), ref=pa.array(np.full(len(k), base + refs)), n_shingles=pa.array(np.full(len(k), z - a)))
                        made.append(listed[~common])
                    posts.append((np.concatenate(made), base + refs, z - a))
                    amount += len(posts[-1][0])
                    refs += 1
                    if amount > FLUSH:
                        yield from blobs(posts)
                        posts, amount = [], 0
                halves = np.frombuffer(b"".join(sig), np.int64).reshape(-1, 2)
                sketch: list = [None] * len(sig)
                for at in range(0, len(new), 1000):
                    some = new[at : at + 1000]
                    own = np.concatenate([h[bounds[i] : bounds[i + 1]] for i in some])
                    for i, p in zip(some, parities(np.cumsum([0, *(bounds[i + 1] - bounds[i] for i in some)]), own), strict=True):
                        sketch[i] = p
                yield batch(DOC, len(sig), doc_id=ids, n_shingles=pa.array(np.diff(first).astype(np.int64)), s1=pa.array(np.ascontiguousarray(halves[:, 0])), s2=pa.array(np.ascontiguousarray(halves[:, 1])), ref=pa.array(ref, pa.int64()), parity=pa.array(sketch, pa.list_(pa.int64())))
        if amount:
            yield from blobs(posts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(stages.tidied(run), SETS)


def digest_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(sets: DataFrame) -> DataFrame:
    """(kind, key, ref, size, a, a_size): kind 0 pairs of short lists, kind 1 members of long ones."""
    shape = "kind int, key long, ref long, size long, a long, a_size long"
    names = [x.split()[0] for x in shape.split(", ")]

    def rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c.astype(np.int64)) for c in cols)], names)

    def pairs(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, ref, size = (np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True))
        order = np.lexsort((ref, key))
        key, ref, size = key[order], ref[order], size[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        length = np.diff(np.r_[starts, len(key)])
        marked = np.zeros(len(starts), bool)
        marked[np.searchsorted(starts, np.flatnonzero(size == 0), side="right") - 1] = True
        long = (length > SHORT) | marked
        at = np.repeat(long, length) & (size > 0)
        if at.any():
            yield rows(1, key[at], ref[at], size[at], ref[at], size[at])
        ok = ~long & (length > 1)
        s, n = starts[ok], length[ok]
        for d in range(1, SHORT):
            s, n = s[n > d], n[n > d]
            if not len(s):
                break
            u = np.repeat(s, n - d) + (np.arange((n - d).sum()) - np.repeat(np.cumsum(n - d) - (n - d), n - d))
            v = u + d
            yield rows(0, key[u], ref[v], size[v], ref[u], size[u])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, []
        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != part and got:
                    yield from pairs(got)
                    got = []
                part = p
                got.append(blob)
        if got:
            yield from pairs(got)

    # in order of range, so that a task holds the postings of one range at a time
    blobs = sets.filter(F.col("kind") == BLOB).select("part", "blob").repartition(stages.parallelism(sets.sparkSession), "part").sortWithinPartitions("part")
    single = sets.filter(F.col("kind") == SINGLE).selectExpr("1 kind", "key", "ref", "n_shingles size", "ref a", "n_shingles a_size")
    return blobs.mapInArrow(stages.tidied(meet), shape).unionByName(single)


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, t: Threshold, name: str) -> DataFrame:
    """Of the candidate (a, b, size) rows those that link, as stars within each block; size is that of both sets together.

    Pairs meet in blocks, to which the whole texts of both ends are sent. A pair goes by the least node next to either end, so that
    a group's texts go to one block; what would be more than a block by this goes by the pair's greater end as well.
    """
    spark = docs.sparkSession
    next_to = pairs.select(F.col("a").alias("x"), F.col("a").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"))).groupBy("x").agg(F.min("y").alias("y"))
    near_a, near_b = (next_to.select(F.col("x").alias(c), F.col("y").alias(f"{c}_next")) for c in "ab")
    routed = pairs.join(near_a, "a").join(near_b, "b").select("a", "b", "size", F.least("a_next", "b_next").alias("route"))
    routed = stages.written(routed, f"{name}-routed")
    per = routed.groupBy("route").agg(F.sum("size").alias("all")).withColumn("cuts", F.ceil(F.col("all") / PER_BLOCK))
    blocks = max(1, int((routed.agg(F.sum("size")).first()[0] or 0) // PER_BLOCK))
    cut = F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("b"), F.col("cuts"))).otherwise(0)
    placed = stages.written(routed.join(per, "route").select("a", "b", F.pmod(F.xxhash64("route", cut), F.lit(blocks)).alias("block")), f"{name}-blocks")
    needs = placed.select("block", F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "s1", "s2"), "node")
    needs = stages.written(needs, f"{name}-needs")
    bits = stages.member_bits(needs.select("doc_id"))
    texts = stages.only_members(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", bits)
    texts = texts.select("doc_id", stages.zipped(F.col("text")).alias("text"))
    found = needs.join(texts, "doc_id").select(F.col("block").alias("at"), "node", "s1", "s2", "text")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        for b in right.to_batches():
            node, s1, s2 = (b.column(k).to_pylist() for k in (1, 2, 3))
            for w in textvec.pieces(stages.texts_of(b.column(4))):
                first, h = textvec.shingle_sets(w, n)
                for i in range(len(first) - 1):
                    j, own = w.docs.start + i, h[first[i] : first[i + 1]]
                    if node[j] not in sets and digest_of(own) == struct.pack("<qq", s1[j], s2[j]):
                        sets[node[j]] = own.copy()
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(y, y)
            return x

        for a, b in zip(left.column(0).to_pylist(), left.column(1).to_pylist(), strict=True):
            if (ra := find(a)) != (rb := find(b)) and t.links(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b], assume_unique=True))):
                root[max(ra, rb)] = min(ra, rb)
        links = [(find(x), x) for x in root if find(x) != x]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    links = stages.written(placed.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(run, "a long, b long"), f"{name}-links")
    stages.dropped(routed, placed, needs)
    return links


def _linked(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): doc_id, n_shingles, s1, s2 of every row of (doc_id, text); s1, s2, component_id of every set."""
    t = Threshold(num, den)
    level, boundary, postings = _sketch(docs, n, t)
    ranges = max(4 * stages.parallelism(docs.sparkSession), postings // PER_RANGE)
    sets = stages.written(_sets(docs, n, t, level, boundary, ranges), "sets")
    rows = sets.filter(F.col("kind") == DOC)
    whole = rows.filter("doc_id is not null and n_shingles > 0")
    # a class's node is its least ref; refs of one class in several tasks are one node
    nodes = stages.written(whole.groupBy("s1", "s2").agg(F.min("ref").alias("node"), F.min("doc_id").alias("doc_id")), "nodes")
    refs = stages.written(rows.filter("ref is not null").select("ref", F.col("n_shingles").alias("size"), "s1", "s2", "parity").join(nodes.select("s1", "s2", "node"), ["s1", "s2"]).select("ref", "node", "size", "parity"), "refs")
    lists = stages.written(_lists(sets), "lists")
    near = (F.greatest("size", "a_size") * num <= F.least("size", "a_size") * den) & (F.col("a") != F.col("node"))
    # kind 1: a hub for each list and band of sizes; bands are as wide as sizes that may link
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(den / num)))
    long = lists.filter("kind = 1").select("key", "ref").join(refs.select("ref", "node", "size"), "ref").select("key", "node", "size", band.alias("band")).distinct()
    long = stages.written(long, "long")
    hubs = stages.written(long.groupBy("key", "band").agg(F.min(F.struct("node", "size")).alias("hub")), "hubs")
    stars = long.join(hubs, ["key", "band"]).select("node", "size", F.col("hub.node").alias("a"), F.col("hub.size").alias("a_size")).filter(near).select("a", F.col("node").alias("b")).distinct()
    met = lists.filter("kind = 0 and ref <> a").filter(F.greatest("size", "a_size") * num <= F.least("size", "a_size") * den).select("a", F.col("ref").alias("b")).distinct()
    side = {c: refs.select(F.col("ref").alias(c), F.col("node").alias(f"{c}_node"), F.col("size").alias("a_size" if c == "a" else "size"), F.col("parity").alias("a_parity" if c == "a" else "parity")) for c in "ab"}
    # nodes are refs themselves, so both kinds of pairs resolve alike
    pairs = met.unionByName(stars).join(side["a"], "a").join(side["b"], "b").filter("a_node <> b_node").filter(may_link(num, den))
    pairs = pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), (F.col("size") + F.col("a_size")).alias("size")).distinct()
    pairs = stages.written(pairs, "candidates")
    links = verified(docs, pairs, nodes, n, t, "first")
    stages.dropped(lists, pairs, hubs)
    labels = stages.components(links)
    for k in range(ROUNDS + 1):
        rest = _apart(long, labels, refs, near & may_link(num, den), None if k == ROUNDS else k)
        if rest is None:
            continue
        more = verified(docs, rest, nodes, n, t, f"rest{k}")
        if not more.isEmpty():
            labels = stages.components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    stages.dropped(long, refs)
    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stages.written(named.select("s1", "s2", "doc_id", "component"), "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "s1", "s2"), named.join(least, "component").select("s1", "s2", "component", "component_id")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (see the module's text)."""
    rows, classes = _linked(_columns(docs, id_col, text_col), n, num, den)
    linked = rows.filter("doc_id is not null and n_shingles > 0").join(classes, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that link to a kept one: of each component one row of least
    (id, set's digest) stays. Rows of one id whose texts do not link both stay. Rows without an id or without words all stay. Only rows
    that may go are shuffled."""
    rows, classes = _linked(_columns(docs, id_col, text_col), n, num, den)
    named = rows.filter("doc_id is not null and n_shingles > 0").groupBy("doc_id", "s1", "s2").agg(F.count("*").alias("k")).join(classes.select("s1", "s2", "component"), ["s1", "s2"])
    named = stages.written(named, "rows")
    first = named.groupBy("component").agg(F.min(F.struct("doc_id", "s1", "s2")).alias("first"))
    touched = named.join(first, "component").withColumn("stays", F.struct("doc_id", "s1", "s2") == F.col("first")).filter("k > 1 or not stays")
    touched = stages.written(touched.select(F.col("doc_id").alias("_id"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "stays"), "touched")
    bits = stages.member_bits(touched.select("_id"))
    maybe, sure = stages.only_members(docs, id_col, bits), stages.only_members(docs, id_col, bits, False)
    own = next(x for k in range(len(docs.columns) + 1) if (x := f"_set{k}") not in docs.columns)

    def digests(text: pa.Array) -> pa.Array:
        out = []
        for w in textvec.pieces(text):
            first, h = textvec.shingle_sets(w, n)
            out += [struct.unpack("<qq", digest_of(h[a:z])) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.array(out, pa.list_(pa.int64()))

    @F.arrow_udf("array<long>")
    def digest(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from stages.tidied(lambda xs: map(digests, xs))(texts)

    # only strings travel compressed: other types have no text of their own to go back to
    is_text = docs.schema[text_col].dataType == StringType()
    maybe = maybe.withColumn(own, digest(F.col(f"`{text_col}`").cast("string")))
    maybe = maybe.withColumn(text_col, stages.zipped(F.col(f"`{text_col}`"))) if is_text else maybe
    key = (F.col(f"`{id_col}`").cast("long") == touched["_id"]) & (F.array(touched["_s1"], touched["_s2"]) == F.col(own))
    safe = maybe.join(touched, key, "left_anti").drop(own)
    once = maybe.join(touched.filter("stays"), key, "left_semi").dropDuplicates([id_col, own]).drop(own)
    kept = safe.unionByName(once)
    return sure.unionByName(kept.withColumn(text_col, stages.unzipped(F.col(f"`{text_col}`"))) if is_text else kept)


def _apart(long: DataFrame, labels: DataFrame, refs: DataFrame, near: F.Column, turn: int | None) -> DataFrame | None:
    """Pairs (a, b, size of both) of members of a long list that are in different components: those outside of the list's
    largest component against a few members of it (``turn`` picks them), or at last, when turn is None,
    against the whole list. What a hub has united is not tried again; parity sketches rule out most of the rest. None if there are none."""
    named = long.join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    per = named.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("cs")).filter("cs > 1").select("key", F.col("top.c").alias("main"))
    per = stages.written(per, "mains")
    open_lists = stages.written(named.join(per, "key"), "open")
    parity = stages.only_members(refs.filter("ref = node"), "node", stages.member_bits(open_lists.select("node"))).select("node", "parity")
    parity = stages.written(parity, "parities")
    open_lists = open_lists.join(parity, "node")
    few = open_lists.filter("c <> main").select("key", "band", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("c").alias("a_c"), F.col("parity").alias("a_parity"))
    few = few.withColumn("band", F.explode(F.array(*(F.col("band") + F.lit(d) for d in (-1, 0, 1)))))
    others = open_lists.select("key", "band", "node", "size", "c", "parity")
    if turn is not None:
        # the least by a hash of the node alone are mostly the same in all lists of a group of near copies
        picked = [F.min(F.struct(F.xxhash64("node", F.lit(turn * HUBS + i)).alias("h"), "node", "size", "c", "parity")).alias(f"h{i}") for i in range(HUBS)]
        hubs = open_lists.filter("c = main").groupBy("key", "band").agg(*picked)
        others = stages.written(hubs.select("key", "band", F.explode(F.array_distinct(F.array(*(f"h{i}" for i in range(HUBS))))).alias("x")).select("key", "band", "x.node", "x.size", "x.c", "x.parity"), "tried")
    wanted = [others["key"] == few["key"], others["band"] == few["band"], F.col("c") != F.col("a_c"), near]
    met = others.join(few, reduce(lambda x, y: x & y, wanted))
    met = stages.written(met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), (F.col("size") + F.col("a_size")).alias("size")).distinct(), "apart")
    return None if met.isEmpty() else met
