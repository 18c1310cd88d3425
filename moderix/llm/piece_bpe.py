"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder is a score-ordered agenda: all adjacent symbol pairs whose join is a piece wait in a heap by
score, then by place; the best valid one is merged and its new neighbours join the agenda. No piece holds a
space mark after another character, so a text falls apart before each run of space marks and the segments
can be encoded one by one; segments that were met before come from a bounded cache. Each segment that enters
the cache is checked, an Arrow batch at a time, against the sentencepiece library.

Null and empty texts have no ids and decode to the empty text. Texts are taken whole. Every row gives a row, repeated ones and those without an id too; an
empty table gives none; only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.llm import stages

SPACE = "▁"
#: Segments of up to ``SHORT`` characters in each of the two generations that a worker keeps, 200 bytes each, about; more only saves time. With
#: ``FEW`` or fewer a worker also drops them and the vocabulary when its task ends, for executors that have other work to hold.
CACHE, FEW, SHORT = 400_000, 100_000, 64
#: Places, a power of two, of the table that tells which segments were met before: only what comes again is kept, so the many that come once do not crowd out others.
MET = 1 << 22
#: Rows of an Arrow batch that are handled at a time.
BATCH = 200


class Mismatch(AssertionError):
    """The agenda and the library disagree."""


class PieceBpe:
    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        # 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        if trained.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError("a merge-type vocabulary with identity normalisation and a space prefix is needed")
        self.rank: dict[str, tuple[float, int]] = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
        self.fallback, self.unknown = bool(trained.byte_fallback), next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        if not self.fallback:
            raise ValueError("a vocabulary with byte fallback is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space mark after another character")
        # a line end is in no longer piece, so it parts the text as well
        if any("\n" in p and len(p) > 1 for p in self.rank):
            raise ValueError("a piece holds a line end and another character")
        self.segments = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        self.pack = "<u2" if len(proto.pieces) <= 1 << 16 else "<u4"
        self.decimal = np.array([f"{i}," for i in range(len(proto.pieces))], "S8")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.met, self.marks = bytearray(MET >> 3), 0
        self.limit = CACHE

    def agenda(self, segment: str) -> list[int]:
        """The ids of one segment."""
        get, push, pop = self.rank.get, heapq.heappush, heapq.heappop
        sym = list(segment)
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, both) for i, both in enumerate(map(str.__add__, sym, sym[1:])) if (r := get(both)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = pop(heap)
            if not sym[i] or (j := after[i]) >= n or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(more := both + sym[k])) is not None:
                    push(heap, (r[0], i, more))
            if (h := before[i]) >= 0 and (r := get(more := sym[h] + both)) is not None:
                push(heap, (r[0], h, more))
        out: list[int] = []
        for s in sym:
            if s:
                if (r := get(s)) is not None:
                    out.append(r[1])
                else:
                    out += [self.byte[b] for b in s.encode()]
        return out

    def _check(self, segments: list[str], ids: list[list[int]]) -> None:
        """Compare with the library, which puts its own space mark before a text: a segment with one is given
        without it, another behind a line end."""
        head = self.library.encode("\n")
        theirs = self.library.encode([s[1:] if s[0] == SPACE and len(s) > 1 else "\n" + s for s in segments], num_threads=1)
        for s, own, lib in zip(segments, ids, theirs, strict=True):
            if (own if s[0] == SPACE and len(s) > 1 else head + own) != lib:
                raise Mismatch(f"segment of {len(s)} characters")

    def _fill(self, new: list[str]) -> dict[str, bytes]:
        """Packed ids of split parts: a part stands for a space mark and itself, or for itself if it begins
        with a line end."""
        parts = [[p[0], p[1:]] if p[:1] == "\n" else [SPACE + p] for p in new]
        flat = [s for x in parts for s in x if s]
        made = [self.agenda(s) for s in flat]
        self._check(flat, made)
        ids = iter(made)
        return {p: np.array([i for s in x if s for i in next(ids)], self.pack).tobytes() for p, x in zip(new, parts, strict=True)}

    def _again(self, part: str) -> bool:
        """Was this segment, or another of its place, met before? It is from now on."""
        h = hash(part) & (MET - 1)
        bit = 1 << (h & 7)
        if self.met[h >> 3] & bit:
            return True
        self.met[h >> 3] |= bit
        self.marks += 1
        if self.marks > MET >> 2:
            self.met, self.marks = bytearray(MET >> 3), 0
        return False

    def _known(self, parts: set[str]) -> dict[str, bytes]:
        """A table that has all these parts. What a full generation leaves behind is there until the next is full."""
        missing = parts - self.cache.keys()
        made = {p: self.old[p] for p in missing if p in self.old}
        short = dict(made)
        if new := [p for p in missing if p not in made]:
            fresh = self._fill(new)
            made |= fresh
            short |= {p: x for p, x in fresh.items() if len(p) <= SHORT and self._again(p)}
        if len(self.cache) + len(short) > self.limit:
            got = {p: made[p] if p in made else self.cache[p] for p in parts}
            self.old, self.cache = self.cache, short if len(short) <= self.limit else {}
            return got
        self.cache.update(short)
        return self.cache if len(short) == len(made) else {p: made[p] if p in made else self.cache[p] for p in parts}

    def encode_batch(self, texts: list[str | None], whole_check: bool = False) -> list[np.ndarray]:
        """An array of ids for each text. whole_check also compares whole texts with the library."""
        split = [None if not t or "  " in t or SPACE in t or t[0] == " " else t.replace("\n", " \n").split(" ") for t in texts]
        out = []
        got = self._known({p for x in split if x for p in x})
        for text, parts in zip(texts, split, strict=True):
            if parts is not None:
                joined = b"".join([got[p] for p in parts])
            else:
                flat = self.segments((SPACE + text).replace(" ", SPACE)) if text else []
                made = {s: self.agenda(s) for s in flat}
                self._check(list(made), list(made.values()))
                joined = b"".join([np.array(made[s], self.pack).tobytes() for s in flat])
            out.append(np.frombuffer(joined, self.pack))
        if whole_check and any(a.tolist() != b for a, b in zip(out, self.library.encode([t or "" for t in texts], num_threads=1), strict=True)):
            raise Mismatch("whole text")
        return out

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode([x.tolist() for x in ids], num_threads=1) if ids else []

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.decimal[ids].tobytes().replace(b"\0", b"")[:-1]


@lru_cache(4)
def loaded(model: bytes) -> PieceBpe:
    """One encoder for each worker and vocabulary."""
    return PieceBpe(model)


def _run(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, give: Callable, cache: int = CACHE) -> DataFrame:
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(held.value)
        bpe.limit = cache
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), *give(bpe, part.column(1))], names)
        if cache <= FEW:
            loaded.cache_clear()

    key = docs.select(id_col).schema[0].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in schema.split(", "))]
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(stages.tidied(run), f"`{id_col}` {key}, {schema}")


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", whole_check: bool = False) -> DataFrame:
    """(id, ids array<int>) for each row; a null or empty text gives an empty array."""

    def give(bpe: PieceBpe, texts: pa.Array) -> list[pa.Array]:
        return [pa.array(bpe.encode_batch(texts.to_pylist(), whole_check), pa.list_(pa.int32()))]

    return _run(docs, model_path, id_col, text_col, "ids array<int>", give)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of ids, by the library's decode; null ids decode to the empty text."""

    def give(bpe: PieceBpe, ids: pa.Array) -> list[pa.Array]:
        return [pa.array(bpe.library.decode([x or [] for x in ids.to_pylist()], num_threads=1) if len(ids) else [], pa.string())]

    return _run(rows, model_path, id_col, ids_col, "text string", give)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def give(bpe: PieceBpe, texts: pa.Array) -> list[pa.Array]:
        ids = bpe.encode_batch(texts.to_pylist())
        back = bpe.decode_batch(ids)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(bpe.joined(x)) for x in ids]), pa.array([sha(x.encode()) for x in back])]

    return _run(docs, model_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", give, cache)
