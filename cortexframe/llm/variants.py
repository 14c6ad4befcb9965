"""Spelling variants: words that differ by one code point, found through pivotal bigrams.

Words are runs of letters of which at least ``min_length`` code points are left after the noise rule; A-Z are lower-cased. All
words that occur ``min_n`` times are grouped, whatever their number.

Bigrams are ordered from the rarest (over the distinct words; there are at most 90 x 90 of them). The prefix of a word
are its bigrams up to the third rarest, equals included. Three bigrams always hold two that do not overlap; dynamic
programming takes the disjoint pair with the least total frequency as the pivots. One edit leaves a pivot as it is,
so of two near words the one whose prefix ends at the rarer bigram has a pivot in the other one's prefix.

The position limit is used as an equality. An edit to the right of a pivot leaves all up to the pivot in place, one to
its left keeps all from there on at the same distance from the end. Of the other side, cut into ``PIECES``, all but one piece
stay as well. So a pivot meets a prefix bigram on a key that holds the bigram's place, everything on its quiet side, the
other pieces, and the shorter length. Keys of words that are not near are therefore rarely equal; every pair that
meets is verified. Near words of a word are at most its possible edits, so they can be collected.

Null texts have no words; a null id counts as the empty text. Repeated rows count each time. Ties for the form go
to the least word in code-point order. Very long texts are read whole. An empty table gives an empty result; only ``doc_id``
and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import drop_table, materialize
from . import kernels as K

MIN_LENGTH = 7
MIN_N = 2
#: A form occurs at least so many times as often as the word.
RATIO = 10
#: One in so many runs loses a code point (the query's noise rule).
NOISE = 31
#: Pieces of the side that holds the edit; all but one of them stay equal.
PIECES = 3
ROWS_PER_BATCH = 1 << 13
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_n: int = MIN_N, noise: int | None = NOISE) -> DataFrame:
    """``word, n`` of the words of all texts. With ``noise``, a run whose hash with its document's id is divisible by it
    loses one code point."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"([A-Za-zÀ-ÿ]{{{min_length},}})"), F.lit(1))
    words = docs.select("doc_id", F.explode(runs).alias("word"))
    words = words.select("doc_id", F.translate("word", _UPPER, _LOWER).alias("word"))
    if noise:
        name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        words = words.withColumn("_h", F.crc32(F.concat(name, F.lit(":"), "word").cast("binary")))
        at = F.pmod("_h", F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("_h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.col("n") >= min_n) & (F.length("word") >= min_length))


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """Words that hold each bigram; the alphabet bounds their number."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    found = words.select(F.explode(F.array_distinct(pairs)).alias("gram")).groupBy("gram").count()
    return {r["gram"]: r["count"] for r in found.collect()}


class GramOrder:
    """Rank (rarest first, then by code points) and frequency of bigrams, by the code points of both letters."""

    def __init__(self, counts: dict[str, int]):
        grams = sorted(counts, key=lambda g: (counts[g], g))
        self.rank = np.full((256, 256), len(grams), np.int32)
        self.weight = np.zeros((256, 256))
        for i, g in enumerate(grams):
            self.rank[ord(g[0]), ord(g[1])], self.weight[ord(g[0]), ord(g[1])] = i, counts[g]


def pivots(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two disjoint bigrams of least total weight in each row (infinite: not in the prefix).

    Dynamic programming over the places: the lightest bigram that ends before the current one starts is carried along.
    """
    rows = np.arange(len(weight))
    light = np.zeros(len(weight), np.int64)  # place of the lightest bigram up to two places back
    best = np.full(len(weight), np.inf)
    first, second = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
    for j in range(2, weight.shape[1]):
        lighter = weight[:, j - 2] < weight[rows, light]
        light[lighter] = j - 2
        total = weight[rows, light] + weight[:, j]
        better = total < best
        best[better], first[better], second[better] = total[better], light[better], j
    return first, second


def _chains(points: np.ndarray) -> np.ndarray:
    """Hash of the first ``j`` code points of each row in column ``j``."""
    out = np.empty((points.shape[0], points.shape[1] + 1), np.uint64)
    out[:, 0] = np.uint64(1)
    for j in range(points.shape[1]):
        out[:, j + 1] = K.mix(out[:, j] * np.uint64(3) + points[:, j])
    return out


def _keys(ahead: np.ndarray, back: np.ndarray, rows: np.ndarray, place: int, length: int) -> list[np.ndarray]:
    """Keys of the bigram at ``place`` of words of one length, one for each quiet side, shorter length and piece."""
    out = []
    for side, (quiet, other, known) in enumerate(((ahead, back, place + 2), (back, ahead, length - place))):
        for shorter in (length, length - 1):
            rest = shorter - known
            if rest < 0:
                continue
            cuts = [rest * k // PIECES for k in range(PIECES + 1)]
            for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi or hi == rest and piece == PIECES - 1:
                    tag = np.uint64(((shorter * 1024 + known) * 2 + side) * PIECES + piece)
                    out.append(K.mix(K.mix(quiet[rows, known + lo] + tag) ^ other[rows, rest - hi]))
    return out


def _points(words: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Code points of words, as one matrix for each length, with the places of its rows."""
    texts = words.to_pylist()
    size = np.array([len(t) for t in texts], np.int64)
    out = []
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        points = np.frombuffer("".join(texts[i] for i in at.tolist()).encode("latin-1"), np.uint8)
        out.append((length, at, points.reshape(-1, length)))
    return out


def _index_rows(batch: pa.RecordBatch, order: GramOrder, pivotal: bool) -> Iterator[pa.RecordBatch]:
    """One row per key of the pivots or of the prefix bigrams. ``first`` is the other pivot's place on rows of a second."""
    for length, at, points in _points(batch.column("word")):
        left, right = points[:, :-1], points[:, 1:]
        rank, weight = order.rank[left, right], order.weight[left, right]
        last = np.partition(rank, 2, axis=1)[:, 2]
        prefix = rank <= last[:, None]
        ahead, back = _chains(points.astype(np.uint64)), _chains(points[:, ::-1].astype(np.uint64))
        if pivotal:
            one, two = pivots(np.where(prefix, weight, np.inf))
            chosen = [(p, np.flatnonzero(one == p), False) for p in range(length - 1)]
            chosen += [(p, np.flatnonzero(two == p), True) for p in range(length - 1)]
        else:
            chosen = [(p, np.flatnonzero(prefix[:, p]), False) for p in range(length - 1)]
        keys, rows, first = [], [], []
        for place, own, second in chosen:
            if len(own):
                found = _keys(ahead, back, own, place, length)
                keys += found
                rows += [own] * len(found)
                first += [one[own] if second else np.full(len(own), -1)] * len(found)
        rows = np.concatenate(rows)
        took = pa.array(at[rows])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(keys).view(np.int64)), batch.column("word").take(took), batch.column("n").take(took),
                pa.array(last[rows].astype(np.int32)), pa.array(np.concatenate(first).astype(np.int32)),
            ],
            names=["key", "word", "n", "last", "first"],
        )


def _index(words: DataFrame, order: GramOrder, pivotal: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_PER_BATCH):
                yield from _index_rows(batch.slice(lo, ROWS_PER_BATCH), order, pivotal)

    return words.select("word", "n").mapInArrow(run, "key bigint, word string, n bigint, last int, first int")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, an, b, bn`` for near words in one of both orders; a pair may come more than once."""
    order = GramOrder(bigram_counts(words))
    s = _index(words, order, True).select("key", F.col("word").alias("a"), F.col("n").alias("an"), F.col("last").alias("al"), "first")
    r = _index(words, order, False).select("key", F.col("word").alias("b"), F.col("n").alias("bn"), F.col("last").alias("bl"))
    met = s.join(r, "key").filter(
        ((F.col("al") < F.col("bl")) | ((F.col("al") == F.col("bl")) & (F.col("a") < F.col("b"))))
        & (F.levenshtein("a", "b", 1) == 1)
    )
    # the pair was met by the first pivot already if one of its sides is quiet
    head, tail = F.col("first") + 2, F.length("a") - F.col("first")
    known = (F.left("a", head) == F.left("b", head)) | (F.right("a", tail) == F.right("b", tail))
    return met.filter((F.col("first") < 0) | ~known).select("a", "an", "b", "bn")


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, n_near, form, form_n`` of the words that have near words."""
    pairs = near_pairs(words)
    turned = F.struct(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn"))
    both = pairs.select(F.inline(F.array(F.struct("a", "an", "b", "bn"), turned)))
    near = both.groupBy("a", "an").agg(F.collect_set(F.struct((-F.col("bn")).alias("bn"), "b")).alias("_near"))
    best = F.array_min("_near")
    taken = -best["bn"] >= ratio * F.col("an")
    return near.select(
        F.col("a").alias("word"), F.size("_near").cast("bigint").alias("n_near"),
        F.when(taken, best["b"]).alias("form"), F.when(taken, -best["bn"]).alias("form_n"),
    )


def roots(found: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: the end of its chain of forms.

    A form is ``ratio`` times as frequent, so chains are short; each round doubles the steps taken.
    """
    now = materialize(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = spread_join(now, onward, ["root"], "word", "left")
        then = materialize(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if then.filter("_moved").limit(1).count() == 0:
            return then.drop("_moved")
        drop_table(now)
        now = materialize(then.drop("_moved"))
        drop_table(then)


def group(docs: DataFrame, min_length: int = MIN_LENGTH, min_n: int = MIN_N, ratio: int = RATIO, noise: int | None = NOISE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    if min_length < 4:
        raise ValueError("a word needs three bigrams")
    words = materialize(vocabulary(docs, min_length, min_n, noise))
    found = materialize(forms(words, ratio))
    out = words.join(found, "word", "left")
    out = spread_join(out, roots(found), ["word"], "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n",
    )
