"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Distinct pieces of a batch are bucketed by byte length; a bucket is a matrix of token ids, one
piece a row, padded with -1. In each round every row merges its leftmost pair of minimum rank, found
by a vectorised hash lookup, and closes the gap; rows without a mergeable pair leave the matrix.
Pieces over MATRIX_BYTES take a heap of pairs instead, which does the same merges in n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import by_slices
from .token_pieces import Cache, chunks, spelled

MATRIX_BYTES = 512
NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """Merged id by pair of ids: open addressing, looked up for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(len(pairs) * 2).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), 1
        for (a, b), merged in pairs.items():
            key = (a << 32) | b
            at, n = int(self._slot(np.array([key], np.int64))[0]), 1
            while self.keys[at] != -1:
                at, n = (at + 1) & (size - 1), n + 1
            self.keys[at], self.values[at], self.probes = key, merged, max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair, NONE where there is none (padding never merges)."""
        key = (left << 32) | right
        key[(left < 0) | (right < 0)] = -2
        at, mask = self._slot(key), (1 << self.bits) - 1
        out = np.full(key.shape, NONE, np.int64)
        open_ = np.flatnonzero(key.ravel() >= 0)
        flat_key, flat_at, flat_out = key.ravel(), at.ravel(), out.ravel()
        for _ in range(self.probes):
            if not len(open_):
                break
            found = self.keys[flat_at[open_]]
            hit = found == flat_key[open_]
            flat_out[open_[hit]] = self.values[flat_at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            flat_at[open_] = (flat_at[open_] + 1) & mask
        return flat_out.reshape(key.shape)


class Encoder:
    """Encodes pieces by the ranks of a vocabulary. Lives inside tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.ranks, self.pairs, self.table = ranks, pairs, PairTable(pairs)
        # the tokenisers' \s is the White_Space property
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache = Cache(lambda found: self._chunks(list(map(spelled, found))))

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        width = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        m = np.where(np.arange(width) < length[:, None], self.first[flat], -1)
        row, done = np.arange(len(pieces)), np.full((len(pieces), width), -1, np.int64)
        pair = self.table(m[:, :-1], m[:, 1:])
        end = np.full((len(pieces), 1), -1)
        while len(row):
            place = pair.argmin(1)  # the first of equal minima is the leftmost
            best = pair[np.arange(len(row)), place]
            go = best != NONE
            if not go.all():
                done[row[~go], : m.shape[1]] = m[~go]
                m, pair, row, place, best = m[go], pair[go], row[go], place[go], best[go]
                if not len(row):
                    break
            # close the gap: what stands right of the merged pair moves one place to the left
            at, right = np.arange(len(row)), np.arange(m.shape[1]) > place[:, None]
            m = np.where(right, np.concatenate([m[:, 1:], end[: len(row)]], 1), m)
            m[at, place] = best
            pair = np.where(right[:, :-1], np.concatenate([pair[:, 1:], np.full((len(row), 1), NONE)], 1), pair)
            length[row] -= 1
            m = m[:, : max(2, int(length[row].max()))]
            pair = pair[:, : m.shape[1] - 1]
            # only the pairs that touch the new token have changed
            inner = place + 1 < m.shape[1]
            pair[at[inner], place[inner]] = self.table(best[inner], m[at[inner], place[inner] + 1])
            inner = place > 0
            pair[at[inner], place[inner] - 1] = self.table(m[at[inner], place[inner] - 1], best[inner])
        flat_ids, counts = done[done >= 0].tolist(), (done >= 0).sum(1).tolist()
        out, k = [], 0
        for n in counts:
            out.append(flat_ids[k : k + n])
            k += n
        return out

    def _heap(self, piece: bytes) -> list[int]:
        """One long piece: pairs wait in a heap by (rank, place); a linked list joins what was merged."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wait = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(wait)
        while wait:
            r, i, a, b = heapq.heappop(wait)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := self.pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(wait, (q, i, r, ids[k]))
            if (h := before[i]) >= 0 and (q := self.pairs.get((ids[h], r))) is not None:
                heapq.heappush(wait, (q, h, ids[h], r))
        return [x for x in ids if x is not None]

    def pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. A piece that is a token is that token."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > MATRIX_BYTES:
                out[i] = self._heap(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length() if len(p) > 16 else len(p) + 100, []).append(i)
        for at in buckets.values():
            step = max(1, (1 << 19) // max(len(pieces[i]) for i in at))
            for k in range(0, len(at), step):
                for i, ids in zip(at[k : k + step], self._matrix([pieces[i] for i in at[k : k + step]])):
                    out[i] = ids
        return out

    def _chunks(self, found: list[str]) -> list[tuple[str, int, bytes]]:
        """For each chunk: its ids as text, their number, and the bytes they decode to."""
        split = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(c)] for c in found]
        distinct = list({p for s in split for p in s})
        ids = dict(zip(distinct, self.pieces(distinct)))
        out = []
        for s in split:
            all_ids = [i for p in s for i in ids[p]]
            out.append((" ".join(map(str, all_ids)), len(all_ids), b"".join(map(self.bytes_of.__getitem__, all_ids))))
        return out

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """For each text: ids as text, their number, the decoded bytes."""
        cut = [chunks(t) for t in texts]
        value = self.cache.of([c for c in cut if c]).__getitem__
        for text, c in zip(texts, cut):
            if c is None:
                yield self._chunks([text])[0]
            else:
                of = list(map(value, c))
                yield " ".join([x[0] for x in of]), sum([x[1] for x in of]), b"".join([x[2] for x in of])


@lru_cache(maxsize=2)
def encoder_of(ranks_path: str, pattern: str) -> Encoder:
    """One for each worker process: tasks that follow each other in it share the cache."""
    return Encoder(read_ranks(ranks_path), pattern)


def batches_of(texts: list[str], most_chars: int = 4_000_000) -> Iterator[list[str]]:
    """Slices of at most most_chars characters, or one text."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most_chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def digests(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256.

    Whole texts; null and empty texts have no ids. Repeated rows and null ids are kept as they are,
    an empty table gives an empty result, other columns are not read. The file of ranks must lie at
    the same path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks_path, pattern)
        for batch in by_slices(batches):
            rows = []
            for part in batches_of([t or "" for t in batch.column(1).to_pylist()]):
                rows += [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain).hexdigest()) for ids, n, plain in encoder.encode_batch(part)]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """Adds ``ids``, the token ids of each whole text, to the columns of ``docs``."""
    kept = docs.drop("ids")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(ranks_path, pattern)
        for pdf in frames:
            out = []
            for part in batches_of([t or "" for t in pdf[text_col]]):
                out += [[int(i) for i in ids.split()] for ids, _, _ in encoder.encode_batch(part)]
            yield pdf.assign(ids=out)

    return kept.mapInPandas(run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(tokens: DataFrame, ranks_path: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the bytes of each array of ids. Null gives null."""
    kept = tokens.drop("decoded")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {i: t for t, i in read_ranks(ranks_path).items()}
        for pdf in frames:
            yield pdf.assign(decoded=[None if ids is None else b"".join(of[int(i)] for i in ids) for ids in pdf[ids_col]])

    return kept.mapInPandas(run, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))
