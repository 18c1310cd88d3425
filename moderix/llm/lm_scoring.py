"""LM scoring: stupid-backoff scores of documents from n-gram counts of all documents.

For each word w behind its history h of up to ``order - 1`` words of the same document,
S(w | h) = c(h w) / c(h) if h is empty or c(h w) >= ``MIN_COUNT``, else ALPHA * S(w | h without its first word);
the count of the empty n-gram is the number of all words. A document's score is the sum of log S over its words.

Relational form: documents are dealt to chunks by a hash of id and text (a repeated id is no hot key), packed and compressed on the way. Every chunk explodes
its n-grams and sends each distinct one once, with its count, to the partition of the count table that holds its hash; there the counts are
summed and the totals are sent back to the chunks that asked, where they are joined to the exploded n-grams and summed per document. Sums
are made within a chunk before anything is shuffled, so a frequent n-gram is one row from each chunk. The n-grams travel
as sorted 64-bit hashes, packed by differences; no count is dropped or estimated. The numbers of chunks and of parts of the count
table follow the size of the input.

Words are runs of non-space characters, A-Z lower-cased. Null and empty texts have no words: score 0 and null mean. Rows
with the same id are scored one by one, each whole; repeated rows count as often as they are there. Null ids are an id like any other. An empty table gives
no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.llm import stages, textvec

ALPHA, MIN_COUNT, ORDER = 0.4, 2, 3
#: The key of the empty n-gram.
EMPTY = np.uint64(0x0123456789ABCDEF)
#: Bytes of text in a chunk and in a part of the count table, about, and the least and most bits that name a part.
CHUNK, PART, BITS = 12 << 20, 2 << 20, (10, 20)
#: Bytes of text that a task packs at a time.
PACK = 16 << 20


def grams(w: textvec.Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to order: (index of its last word, key) of every k-gram within a document."""
    out, h = [], w.hash
    n = len(h)
    for k in range(1, order + 1):
        last = np.arange(k - 1, n)
        if k > 1:
            h = textvec.join_hash(h[:-1], w.hash[k - 1 :]) if len(h) else h
            ok = w.doc[: n - k + 1] == w.doc[k - 1 :] if n >= k else np.zeros(0, bool)
            out.append((last[ok], textvec.mix(h[ok] + np.uint64(k))))
        else:
            out.append((last, textvec.mix(h + np.uint64(1))))
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as byte planes of their differences, without those that are all zero; only the highest plane is worth compressing."""
    d = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    head, rest = d[:1].tobytes(), planes[:, 1:]
    used = 8
    while used and not rest[used - 1].any():
        used -= 1
    top = squeezed(rest[used - 1].tobytes()) if used else b""
    return struct.pack("<BII", used, rest.shape[1], len(top)) + head + top + rest[: max(0, used - 1)].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    used, n, top = struct.unpack_from("<BII", blob)
    d = np.zeros((n + 1, 8), np.uint8)
    d[0] = np.frombuffer(blob, np.uint8, 8, 9)
    if used:
        d[1:, used - 1] = np.frombuffer(widened(blob[17 : 17 + top], n), np.uint8)
        d[1:, : used - 1] = np.frombuffer(blob, np.uint8, n * (used - 1), 17 + top).reshape(used - 1, n).T
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def widened(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, size, "zstd", asbytes=True)


def pack_counts(c: np.ndarray) -> bytes:
    width = 1 if c.max(initial=0) < 1 << 8 else 4 if c.max() < 1 << 32 else 8
    return struct.pack("<BI", width, len(c)) + squeezed(c.astype(f"<u{width}").tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BI", blob)
    return np.frombuffer(widened(blob[5:], n * width), f"<u{width}").astype(np.int64)


class Places:
    """Where hashes stand among sorted distinct ones that hold them: the first bits of a hash almost tell its place."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.uint64(64 - max(1, len(keys).bit_length()))
        self.start = np.searchsorted(keys, np.arange(1 << int(64 - self.bits), dtype=np.uint64) << self.bits).astype(np.int32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = self.start[(x >> self.bits).astype(np.int64)]
        off = np.flatnonzero(self.keys[at] != x)
        while len(off):
            at[off] += 1
            off = off[self.keys[at[off]] != x[off]]
        return at


def _dealt(docs: DataFrame, chunks: int, id_col: str, text_col: str) -> DataFrame:
    """(chunk, blob): documents as compressed Arrow streams of (id, text), by chunk."""
    shape = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # by values alone, so that a lost partition made anew in another order deals out the same
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by("chunk")
            held.clear()
            which = t.column("chunk").to_numpy()
            cuts = [*np.flatnonzero(np.r_[True, which[1:] != which[:-1]]).tolist(), len(which)]
            blobs = []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                sink = pa.BufferOutputStream()
                part = t.slice(a, z - a).select(["id", "text"])
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(part)
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(which[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "blob"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > PACK:
                yield flush()
                size = 0
        if held:
            yield flush()

    return shape.withColumn("chunk", chunk).mapInArrow(stages.tidied(run), "chunk int, blob binary")


def _rows(table: pa.Table) -> pa.Table:
    """(id, text) of a chunk's blobs."""
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in table.column("blob").to_pylist())


def _counted(texts: pa.ChunkedArray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of some texts and their counts."""
    parts, words = [], 0
    for w in textvec.pieces(texts):
        words += len(w.hash)
        parts += [key for _, key in grams(w, order)]
    keys = np.concatenate([*parts, np.full(1, EMPTY)])
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    count[np.searchsorted(keys, EMPTY)] = words
    return keys, count


def scored(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of every row."""
    spark = docs.sparkSession
    kind = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    size = stages.estimated_bytes(docs)
    chunks = max(stages.parallelism(spark), size // CHUNK)
    bits = min(max(BITS[0], (size // PART).bit_length()), BITS[1])
    held = _dealt(docs, chunks, id_col, text_col)

    def ask(table: pa.Table) -> pa.Table:
        keys, count = _counted(_rows(table).column("text"), order)
        cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(keys)]
        some = [i for i in range(1 << bits) if cuts[i + 1] > cuts[i]]
        return pa.table({
            "part": pa.array(some, pa.int32()),
            "chunk": pa.array([table.column("chunk")[0].as_py()] * len(some), pa.int32()),
            "keys": pa.array([pack(keys[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()),
            "counts": pa.array([pack_counts(count[cuts[i] : cuts[i + 1]]) for i in some], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in table.column("keys").to_pylist()]
        counts = [unpack_counts(x) for x in table.column("counts").to_pylist()]
        names, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, where, np.concatenate(counts))
        cuts = np.cumsum([0, *(len(k) for k in keys)])
        return pa.table({"chunk": table.column("chunk").cast(pa.int32()), "part": table.column("part").cast(pa.int32()), "total": pa.array([pack_counts(total[where[a:z]]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    def join(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = _rows(table)
        texts = table.column("text")
        keys, _ = _counted(texts, order)
        answers = answers.sort_by("part")
        total = np.concatenate([unpack_counts(x) for x in answers.column("total").to_pylist()])
        if len(total) != len(keys):
            raise RuntimeError("the count table's answers do not fit the chunk")
        words_of, score_of = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows)
        every, at = float(total[np.searchsorted(keys, EMPTY)]), Places(keys)
        for w in textvec.pieces(texts):
            n = len(w.hash)
            c = [np.full(n, every)]
            best = np.zeros(n)
            for k, (last, key) in enumerate(grams(w, order), 1):
                own = np.zeros(n)
                own[last] = total[at(key)]
                c.append(own)
                prior = c[k - 1] if k == 1 else np.r_[0.0, c[k - 1][:-1]]
                seen = np.zeros(n, bool)
                seen[last] = True
                use = seen & ((own >= min_count) | (k == 1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    best = np.where(use, np.log(own / prior), best + np.where(seen, np.log(alpha), 0.0))
            size = len(w.doc_start) - 1
            words_of[w.docs] = np.bincount(w.doc, minlength=size)
            score_of[w.docs] = np.bincount(w.doc, weights=best, minlength=size)
        return pa.table({id_col: table.column("id"), "n_words": pa.array(words_of), "log_score": pa.array(score_of)})

    asked = held.groupBy("chunk").applyInArrow(ask, "part int, chunk int, keys binary, counts binary")
    answered = asked.groupBy("part").applyInArrow(answer, "chunk int, part int, total binary")
    answered = answered.select(F.col("chunk").alias("to"), "part", "total")
    got = held.groupBy("chunk").cogroup(answered.groupBy("to")).applyInArrow(join, f"`{id_col}` {kind}, n_words long, log_score double")
    return got.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
