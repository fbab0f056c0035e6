"""Token ids as flat binary files with 64-bit document offsets.

A set of files in one folder, for the documents in ascending id order:

* ``part-NNNNN.bin``: the ids of a partition's documents, little-endian unsigned 16- or 32-bit
  integers (16 where the vocabulary fits), nothing between documents;
* ``part-NNNNN.idx``: n + 1 little-endian 64-bit offsets in tokens, relative to the part;
* ``part-NNNNN.doc``: n little-endian 64-bit document ids.

Where a part begins in the whole sequence (its base) is the sum of the tokens of the parts before
it, so parts are written independently and bases come from one short list of totals. A task writes
under a name of its own and renames at the end: an attempt that runs again leaves the same files.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import batches_of
from .common import by_slices
from .token_pieces import Cache, chunks, spelled

PART_SCHEMA = "part int, docs long, tokens long"
_FLUSH = 8 << 20
#: Punctuation that is one piece after letters; an apostrophe may belong to the word.
_TAIL = "".join(c for c in string.punctuation if c != "'")
#: How a null id is stored.
NO_ID = -(1 << 63)


def _storage(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class LibraryEncoder:
    """Ids as bytes, by the tokenizers library with its own settings. Lives inside tasks; each distinct chunk is encoded once."""

    def __init__(self, tokenizer_path: str, dtype: str, limit: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        #: the library finds these anywhere in a text, whatever stands around them
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype(dtype)
        self.cache, self.pieces = Cache(self._encode_chunks, limit), Cache(self._encode_together, limit // 2)
        self.newline = self._encode(["\n"])[0]
        self.separator = int(np.frombuffer(self.newline, self.dtype)[0]) if len(self.newline) == self.dtype.itemsize else None

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, found: list[str]) -> list[bytes]:
        """Ids of each chunk. What stands after a word's letters is a piece of its own, so such chunks share their words' ids."""
        heads, tails = [], []
        for t in map(spelled, found):
            head = t.rstrip(_TAIL)
            split = len(head) < len(t) and head.lstrip(" ").isalpha()
            heads.append(head if split else t)
            tails.append(t[len(head) :] if split else "")
        of = self.pieces.of([[t for t in heads if t != "\n"], filter(None, tails)])
        return [self.newline if h == "\n" else of[h] + of[t] if t else of[h] for h, t in zip(heads, tails)]

    def _encode_together(self, plain: list[str], together: int = 256) -> list[bytes]:
        """Pieces without a newline in them, ``together`` a call: a newline between two is a token of its own, at which the ids are cut."""
        joined = ["\n".join(plain[k : k + together]) for k in range(0, len(plain), together)]
        out = []
        for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            data, width, at = ids.tobytes(), self.dtype.itemsize, 0
            for cut in (np.flatnonzero(ids == self.separator) * width).tolist():
                out.append(data[at:cut])
                at = cut + width
            out.append(data[at:])
        if len(out) != len(plain):
            raise ValueError("this vocabulary does not keep newlines apart")
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        cut = [None if any(a in t for a in self.added) else chunks(t) for t in texts]
        value = self.cache.of([c for c in cut if c]).__getitem__
        for text, c in zip(texts, cut):
            yield self._encode([text])[0] if c is None else b"".join(map(value, c))


@lru_cache(maxsize=2)
def _encoder(tokenizer_path: str, dtype: str) -> LibraryEncoder:
    """One for each worker process: tasks that follow each other in it share the cache."""
    return LibraryEncoder(tokenizer_path, dtype)


def write(docs: DataFrame, folder: str, tokenizer_path: str, *, end_id: int, vocabulary: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int, int]]:
    """Writes the files under ``folder`` (a URI all executors reach); gives (part, docs, tokens, base) of each part.

    Documents stand in ascending id order (null ids first, stored as the smallest 64-bit integer;
    rows with the same id in the order of their texts). Null and empty texts are the end id alone.
    Texts are encoded as the library does by default: an added token's string in a text is that token.
    An empty table gives no part; other columns are not read. Only the totals of the parts reach the driver.
    """
    dtype = dtype_of(vocabulary, end_id)
    end = np.array([end_id], dtype).tobytes()
    width = len(end)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), uuid.uuid4().hex
        storage, root = _storage(folder)
        storage.create_dir(root, recursive=True)
        encoder, out, held, size = None, None, [], 0
        ids, offsets = [], [0]
        for slice_ in by_slices(rows):
            if encoder is None:
                encoder, out = _encoder(tokenizer_path, dtype), storage.open_output_stream(f"{root}/_{own}.bin")
            ids += [NO_ID if i is None else i for i in slice_.column(0).to_pylist()]
            for batch in batches_of([t or "" for t in slice_.column(1).to_pylist()]):
                for data in encoder(batch):
                    held += [data, end]
                    size += len(data) + width
                    offsets.append(offsets[-1] + len(data) // width + 1)
                    if size >= _FLUSH:
                        out.write(b"".join(held))
                        held, size = [], 0
        if out is None:
            return
        out.write(b"".join(held))
        out.close()
        for kind, values in (("idx", offsets), ("doc", ids)):
            with storage.open_output_stream(f"{root}/_{own}.{kind}") as f:
                f.write(np.array(values, "<i8").tobytes())
        for kind in ("bin", "idx", "doc"):
            storage.move(f"{root}/_{own}.{kind}", f"{root}/part-{part:05d}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([offsets[-1]], pa.int64())], ["part", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    ordered = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "_text")
    parts = sorted(tuple(r) for r in ordered.mapInArrow(run, PART_SCHEMA).collect())  # one row for each partition
    bases = accumulate((t for _, _, t in parts), initial=0)
    return [(*p, base) for p, base in zip(parts, bases)]


def dtype_of(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def _open(storage, path: str, dtype: str) -> np.ndarray:
    """A memory map where the store is a local or mounted file system, else the bytes read."""
    if storage.type_name == "local":
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with storage.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], *, vocabulary: int, end_id: int, with_tokens: bool = False, batch_tokens: int = 2_000_000) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and tokens if asked.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, whatever the files' width.
    """
    dtype = dtype_of(vocabulary, end_id)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", tokens array<int>" if with_tokens else "")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, root = _storage(folder)
        for frame in frames:
            for part, base in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                tokens, offsets, ids = (_open(storage, f"{root}/part-{part:05d}.{kind}", t) for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                at = 0
                while at < len(ids):
                    to = min(len(ids), max(at + 1, int(np.searchsorted(offsets, offsets[at] + batch_tokens))))
                    slices = [np.asarray(tokens[offsets[i] : offsets[i + 1]]) for i in range(at, to)]
                    made = [pa.array(ids[at:to], mask=np.asarray(ids[at:to]) == NO_ID), pa.array(offsets[at:to] + base), pa.array(np.diff(offsets[at : to + 1])), pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in slices], pa.int64())]
                    if with_tokens:
                        made.append(pa.array([s.astype(np.int32) for s in slices], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(made, ["doc_id", "start", "n_tokens", "ids_crc32", "tokens"][: len(made)])
                    at = to

    table = spark.createDataFrame([(p, base) for p, _, _, base in parts], "part int, base long")
    return table.repartition(max(1, len(parts))).mapInArrow(run, schema)
