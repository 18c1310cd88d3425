"""Token counts by offset-mapped attribution.

Each document is encoded once, whole, with a byte-level vocabulary (tokens in order cover the text's bytes, so running sums of
token lengths are the tokens' byte spans), and the spans are interval-joined with the spans of its sections: here
the fields of a row laid end to end, or the sections of one text. A token that crosses a boundary is allocated by an
explicit rule: ``first`` gives it to the section of its first byte, ``most`` to that with most of its bytes (the
earlier one if equal), ``share`` splits it by bytes.

Sections of a text are its paragraphs: they end behind each run of line ends, so they tile the text. Bytes that no
section covers count for none. Null and empty texts have no tokens and no sections; an empty section gets 0. Every row gives a row, repeated ones and those
without an id too; where two sections have equal parts of a token the earlier has it (``most``); an empty table gives no rows; only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderix.llm import stages

RULES = ("first", "most", "share")
BATCH = 500


@lru_cache(4)
def loaded(ranks: bytes, pattern: str) -> tuple:
    """The encoder and the byte length of each token, once for each worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    length = np.zeros(max(table.values()) + 1, np.int64)
    for token, i in table.items():
        length[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), length


def sections(data: bytes) -> np.ndarray:
    """The byte offsets at which paragraphs start, and the end; empty for no data."""
    if not data:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    line = raw == 10
    return np.r_[0, np.flatnonzero(line[:-1] & ~line[1:]) + 1, len(raw)]


def allocated(ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens (their end offsets; they tile from 0) in each of the sections between ``bounds``."""
    n = max(0, len(bounds) - 1)
    out = np.zeros(n)
    if not n or not len(ends):
        return out
    starts = np.r_[0, ends[:-1]]
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends, side="left") - 1
    whole = (first == last) & (first >= 0) & (first < n)
    out += np.bincount(first[whole], minlength=n)
    for i in np.flatnonzero(first != last).tolist():
        a, z = int(starts[i]), int(ends[i])
        if rule == "first":
            if 0 <= first[i] < n:
                out[first[i]] += 1
            continue
        over = {k: min(z, int(bounds[k + 1])) - max(a, int(bounds[k])) for k in range(max(0, int(first[i])), min(n - 1, int(last[i])) + 1)}
        over = {k: v for k, v in over.items() if v > 0}
        if rule == "share":
            for k, v in over.items():
                out[k] += v / (z - a)
        elif over:
            out[max(over, key=lambda k: (over[k], -k))] += 1
    return out


def counted(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(id, n_tokens, n_crossing, sections array<double>) of each row.

    One field: its sections are the paragraphs. Several: the fields laid end to end are encoded as one text and are the sections.
    """
    if rule not in RULES:
        raise ValueError(rule)
    with open(ranks_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, length = loaded(held.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                tokens, crossing, out = [], [], []
                for row in zip(*(part.column(i + 1).to_pylist() for i in range(len(fields))), strict=True):
                    row = [x or "" for x in row]
                    data = [x.encode() for x in row]
                    text = "".join(row)
                    bounds = sections(data[0]) if len(fields) == 1 else np.r_[0, np.cumsum([len(x) for x in data])]
                    ends = np.cumsum(length[np.array(encoder.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
                    inner = np.unique(bounds[1:-1])
                    tokens.append(len(ends))
                    crossing.append(len(inner) - int(np.isin(inner, ends).sum()))
                    out.append(allocated(ends, bounds, rule))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(crossing, pa.int64()), pa.array(out, pa.list_(pa.float64()))], [id_col, "n_tokens", "n_crossing", "sections"])

    cols = [F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(fields)]
    return docs.select(id_col, *cols).mapInArrow(stages.tidied(run), f"`{id_col}` {kind}, n_tokens long, n_crossing long, sections array<double>")
