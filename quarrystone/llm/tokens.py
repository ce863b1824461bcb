"""Corpus encoding with a public byte-level BPE vocabulary by forced-boundary splitting.

Two neighbouring bytes that stand side by side in no vocabulary token can never be merged, nor can anything
across them: between them is a certain cut. Texts are cut there and nowhere else, every fragment is encoded on
its own, and the ids are concatenated; the result equals the encoding of the whole text. Two kinds of certain
cut are not used, as there the pattern that splits text before merging looks across the cut: after white space
(its look-ahead) and before an apostrophe (contractions).

The cuts of a whole Arrow batch are found at once from the batch's byte buffer, and a fragment seen before in
the task (nearly always a word) takes its ids from a table, so the cost per text is that of a dictionary look-up
per word. Texts of any length are encoded whole. No shuffle takes place.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the vocabulary file of the default tokenizer lies; a parameter of every operator that encodes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fragments remembered by a task before its table is emptied (bounds memory, not results).
REMEMBERED = 200_000


class ForcedBoundaryEncoder:
    """Encodes UTF-8 buffers; made once per task from the bytes of a rank file."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            t = np.frombuffer(token, dtype=np.uint8)
            joined[t[:-1], t[1:]] = True
        joined[list(b"\t\n\v\f\r \x1c\x1d\x1e\x1f"), :] = True
        joined[:, ord("'")] = True
        joined[:, 0x80:0xC0] = True  # within a character
        self.certain = ~joined
        self.table: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Positions p with a certain cut between b[p - 1] and b[p]."""
        if len(b) < 2:
            return np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.certain[b[:-1], b[1:]]) + 1
        wide = at[b[at - 1] >= 0x80]
        if len(wide):
            x, y, z = b[wide - 1], b[wide - 2], np.where(wide >= 3, b[wide - 3], 0)
            space = ((y == 0xC2) & ((x == 0x85) | (x == 0xA0))) | ((z == 0xE1) & (y == 0x9A) & (x == 0x80))
            space |= (z == 0xE2) & (y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF))
            space |= ((z == 0xE2) & (y == 0x81) & (x == 0x9F)) | ((z == 0xE3) & (y == 0x80) & (x == 0x80))
            at = np.setdiff1d(at, wide[space], assume_unique=True)
        return at

    def encode(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a buffer one after the other, and where each text's ids begin (and the last
        end). ``bounds``: the same for the bytes."""
        b = np.frombuffer(data, dtype=np.uint8)
        edges = np.unique(np.concatenate([bounds, self.cuts(b)]))
        edges = edges[(edges >= bounds[0]) & (edges <= bounds[-1])]
        table, get = self.table, self.table.get
        if len(table) > REMEMBERED:
            table.clear()
        found = []
        starts = edges.tolist()
        for s, e in zip(starts, starts[1:]):
            piece = data[s:e]
            ids = get(piece)
            if ids is None:
                ids = tuple(self.encoding.encode_ordinary(piece.decode("utf-8")))
                if e - s <= 64:
                    table[piece] = ids
            found.append(ids)
        n = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        before = np.concatenate([[0], np.cumsum(n)])
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(before[-1]))
        return ids, before[np.searchsorted(edges, bounds)]


def _buffer(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes and text bounds of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (data.to_pybytes() if data else b""), offsets


def encode(
    df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, ids: bool = True
) -> DataFrame:
    """``keep`` columns of ``df``, then ``ids`` (array<int>) if wanted and ``n_tokens`` (bigint).

    Null and empty texts give an empty list and 0. No special tokens are added, and the strings of special
    tokens are ordinary text. Repeated rows give repeated results; columns not in ``keep`` are not read.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file: fixed size, under 1 MB

    fields = [df.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ForcedBoundaryEncoder(ranks.value)
        for batch in batches:
            column = batch.column("_text")
            step = max(1, int(len(column) * (4 << 20) / max(1, column.nbytes)))  # about 4 MB of text at a time
            for at in range(0, len(column), step):
                part = batch.slice(at, step)
                data, bounds = _buffer(part.column("_text").fill_null(""))
                values, offsets = encoder.encode(data, bounds)
                columns = [part.column(c) for c in keep]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)))
                columns.append(pa.array(np.diff(offsets)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    source = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"].alias("_text"))
    return source.mapInArrow(run, schema)
