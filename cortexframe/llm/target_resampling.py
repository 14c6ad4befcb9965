"""Importance resampling towards a target text collection over hashed word n-grams.

Words are runs of letters, digits and non-ASCII signs after A-Z are lower-cased; features are all words and all pairs of
neighbouring words (joined by a space), and the bucket of a feature is the CRC-32 of its bytes modulo ``buckets``.

A stretch of text becomes words by an Aho-Corasick automaton over its distinct words, each bounded by a delimiter on both
sides. A word carries its CRC-32 and its length, so one scan emits the payloads in text order, and the payloads of two
neighbours compose to the CRC-32 of the pair: the first is advanced by the bytes of the second, as in a checksum of
concatenated files. No pair is ever built as text. Words of more than ``MAX_PATTERN`` bytes stay out of the automaton and
get their payload directly, so a single endless word costs no automaton of its size.

Bucket counts cover every row of both tables and are sums of one array per task. Each document is scored by the mean
gain of its features plus a Gumbel draw seeded by its id, and the best ``percent`` of the documents with at least
``min_words`` words are drawn.

Null and empty texts have no feature and weight 0. Repeated rows are scored each on its own and may be drawn together; rows
that agree in score and id take consecutive ranks in any order. A null id is drawn as the empty text and goes before
others in a tie. Very long texts are scanned in stretches of ``WORDS_PER_SCAN`` words. Empty tables count nothing; an empty
``docs`` gives an empty result. Only ``doc_id`` and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.chunks import sequence_index
from ..plans.materialize import materialize
from . import kernels as K
from .common import map_texts, text_slices

BUCKETS = 10_000
WORDS_PER_SCAN = 1 << 18
MAX_PATTERN = 256
_SHORT = 64  # lengths with a table of their own
_DELIMITER = 32

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = _WORD_BYTE[48:58] = _WORD_BYTE[97:123] = True


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What ``n`` zero bytes do to each byte of a CRC register: for n = 0 to 64, and for n = 1, 2, 4, ..."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    short = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(_SHORT):
        short.append((short[-1] >> 8) ^ step[short[-1] & 255])
    doubled = [short[1]]
    for _ in range(40):
        doubled.append(_through(doubled[-1], doubled[-1]))
    return np.stack(short), np.stack(doubled)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def advance(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after ``n`` zero bytes; ``advance(crc(a), len(b)) ^ crc(b)`` is the CRC-32 of ``a + b``."""
    short, doubled = _crc_tables()
    near = np.minimum(n, _SHORT)
    out = (
        short[near, 0, crc & 255] ^ short[near, 1, (crc >> 8) & 255]
        ^ short[near, 2, (crc >> 16) & 255] ^ short[near, 3, crc >> 24]
    )
    far = np.flatnonzero(n > _SHORT)
    for bit in range(int(n.max(initial=0)).bit_length() if len(far) else 0):
        own = far[((n[far] - _SHORT) >> bit) & 1 > 0]
        out[own] = _through(doubled[bit], out[own])
    return out


def payloads(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length in bytes of the words of ``padded``, whose other bytes are delimiters."""
    import ahocorasick

    size = ends - starts
    crc = np.zeros(len(starts), np.uint32)
    for lo in range(0, len(starts), WORDS_PER_SCAN):
        hi = min(lo + WORDS_PER_SCAN, len(starts))
        long = lo + np.flatnonzero(size[lo:hi] > MAX_PATTERN)
        stretch = padded[starts[lo] - 1:ends[hi - 1] + 1]
        for i in long.tolist():
            crc[i] = zlib.crc32(padded[starts[i]:ends[i]].tobytes())
        if len(long):
            stretch = stretch.copy()
            for i in long.tolist():
                stretch[starts[i] - starts[lo] + 1:ends[i] - starts[lo] + 1] = _DELIMITER
        raw = stretch.tobytes()
        automaton = ahocorasick.Automaton()
        for word in set(raw.split(b" ")):
            if word:
                automaton.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) | len(word) << 32)
        if not len(automaton):
            continue
        automaton.make_automaton()
        found = np.fromiter((p for _, p in automaton.iter(raw.decode("latin-1"))), np.int64)
        short = lo + np.flatnonzero(size[lo:hi] <= MAX_PATTERN)
        if len(found) != len(short) or (found >> 32 != size[short]).any():
            raise AssertionError("the automaton missed a word")
        crc[short] = (found & 0xFFFFFFFF).astype(np.uint32)
    return crc, size


def feature_buckets(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all pairs (by their first word), and the number of words before each text."""
    data, offsets = K.text_bytes(texts)
    data = K.lower_ascii(data)
    padded = np.insert(np.where(_WORD_BYTE[data], data, np.uint8(_DELIMITER)), offsets, np.uint8(_DELIMITER))
    solid = _WORD_BYTE[padded]
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1, np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    counts = np.searchsorted(starts, offsets + np.arange(len(offsets)))
    crc, size = payloads(padded, starts, ends)
    space = np.uint32(zlib.crc32(b" "))
    spaced = advance(crc[:-1], np.ones(max(0, len(crc) - 1), np.int64)) ^ space
    pairs = advance(spaced, size[1:]) ^ crc[1:]
    return (crc % np.uint32(buckets)).astype(np.int64), (pairs % np.uint32(buckets)).astype(np.int64), counts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows in each bucket: one array per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                one, two, counts = feature_buckets(part.column("text"), buckets)
                last = counts[1:][counts[1:] > counts[:-1]] - 1  # no pair crosses the end of a text
                inner = np.ones(len(one), bool)
                inner[last] = False
                n += np.bincount(one, minlength=buckets) + np.bincount(two[inner[:len(two)]], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    each = map_texts(texts.select("text"), run, "bucket bigint, n bigint")
    total = each.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # a row per bucket at most
    out = np.zeros(buckets, np.int64)
    out[total["bucket"].to_numpy(np.int64)] = total["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of each bucket's share in the target and in the corpus."""
    buckets, every, wanted = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (every + buckets) / ((s + 1.0) * (wanted + buckets))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` for every row: the floored mean gain of its features."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                one, two, counts = feature_buckets(part.column("text"), len(gain))
                first, last = counts[:-1], counts[1:]
                words = last - first
                sums = [np.concatenate((np.zeros(1, np.int64), np.cumsum(gain[at]))) for at in (one, two)]
                total = sums[0][last] - sums[0][first]
                several = words > 1
                total[several] += sums[1][last[several] - 1] - sums[1][first[several]]
                features = words + np.maximum(words - 1, 0)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, features, weight))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel draw that depends on the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null where a row is not drawn.

    Scores are integers in a narrow range, so a histogram of them (a row per score) gives the least drawn score, and only
    rows from there on are sorted, in range-partitioned chunks.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()))
    able = F.col("n_words") >= min_words
    counts = sorted(scored.filter(able).groupBy("score").count().collect(), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    least, above = None, 0
    for score, n in counts:
        if above >= wanted:
            break
        least, above = score, above + n
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("bigint")
    if least is None:
        return scored.select(*columns, none.alias("rank"))
    near = able & (F.col("score") >= least)
    ranked = sequence_index(scored.filter(near).withColumn("_down", -F.col("score")), [], ["_down", "doc_id", "_row"], "_place")
    rank = F.when(F.col("_place") < wanted, F.col("_place") + 1)
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.filter(~near).select(*columns, none.alias("rank")))
