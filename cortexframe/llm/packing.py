"""Best-fit packing of tokenized documents with a bounded number of open bins.

A document becomes the ids of a byte-level BPE plus an end id. A longer one is cut into pieces of ``capacity`` tokens,
the first of which may be shorter. Each task packs a bounded number of pieces: a piece goes to the open bin with the
least free space that holds it, found in a bitset keyed by free space. When too many bins are open, the fullest closes.

A null text is an empty one: it is packed as the end id alone. Repeated rows are packed each on its own. An empty table
gives an empty result; only ``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import map_texts, text_slices

CAPACITY = 1024
OPEN_BINS = 1 << 16
#: About as many pieces as fill the open bins; longer streams close bins that small pieces could still fill.
PIECES_PER_TASK = 150_000
END_ID = 2

# Fixed value: the published pattern that cuts text before byte-level merges.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Longer runs of white space overflow the stack of the fast pattern engine.
LONG_SPACE = 100_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


class Encoder:
    """Ids of a byte-level BPE vocabulary file: its merges run in ``tiktoken``; texts that hold the string of a special
    token or a very long run of white space go to ``tokenizers`` itself."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        alphabet = _byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = None

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self.path)
            return self._full.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                cols = [[] for _ in range(6)]
                for at, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[start:start + n]
                        row = (at, k, start, n, zlib.crc32(own.tobytes()), own.astype(np.int32) if with_ids else None)
                        for c, v in zip(cols, row):
                            c.append(v)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [part.column("doc_id").take(pa.array(cols[0], pa.int32()))]
                arrays += [pa.array(c, t) for c, t in zip(cols[1:], kinds)][:5 if with_ids else 4]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 if with_ids else 5]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_texts(docs.select("doc_id", "text"), run, schema)


class BestFit:
    """Online best-fit over ``capacity`` with at most ``open_bins`` open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.bins = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def put(self, n: int) -> tuple[int, int]:
        """``(bin, offset)`` of a piece of ``n`` tokens."""
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.bins
            self.bins += 1
        left = free - n
        if left:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.open += 1
        return found, self.capacity - free


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = False, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset`` there.

    The pieces are stored once, so texts are tokenized once and the number of packing tasks follows from their count.
    A task packs its pieces from the longest to the shortest, so small pieces fill what is left, and equally long ones
    in hash order, so a task that runs again gives the same sequences.
    """
    from pyspark import TaskContext

    pieces = materialize(token_pieces(docs, path, capacity, end_id, with_ids))
    tasks = max(1, -(-pieces.count() // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32", "length")
    dealt = pieces.withColumn("_order", order).repartition(tasks, "_order")
    dealt = dealt.sortWithinPartitions(F.desc("length"), "_order", "doc_id", "piece", "ids_crc32").drop("_order")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        bins = BestFit(capacity, open_bins)
        for frame in frames:
            put = [bins.put(n) for n in frame["length"].tolist()]
            yield frame.assign(sequence_id=[base + b for b, _ in put], offset=[o for _, o in put])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInPandas(run, f"{schema}, sequence_id bigint, offset bigint")
