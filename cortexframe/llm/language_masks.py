"""Language identification with n-gram filters that hold one bit for each language.

Words are maximal runs of letters (with their combining marks), lower-cased and bounded by a blank on both sides; the
n-grams are the runs of three and four code points that hold a blank at an end at most. Every language has a Bloom filter of
its n-grams. The filters are sliced by bit: a slot is a mask over the languages, so the ``PLACES`` slots of an n-gram,
combined by ``and``, name all languages that hold it. For each document the bits are counted per language, the hits that
a filter of this fill gives by chance are taken off, and the highest count decides (ties: the first language in order).

Counts come from all training rows. A language holds an n-gram that it has at least ``min_count`` times, with a rate of
at least ``least_share`` of the highest rate among the languages, and among its about ``grams_per_language`` most
frequent ones; that bounds the fill of the filters whatever the input. The filters take 8 MB for each 64 languages.

``lang_pred`` is ``und`` and the score 0 for null texts and texts without a letter, and for all rows when nothing was
learned. A text with letters but without hits gets the language with the most training rows and score 0. Otherwise the score
is the share of the best language in the corrected counts of the best two. Rows without ``lang`` are not learned;
repeated rows count as often as they occur and get equal predictions. Very long texts are read whole. Empty tables give an
empty result; only ``doc_id``, ``text`` and ``lang`` are read, so further columns may have any name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import bounded_collect
from ..plans.materialize import materialize
from . import kernels as K
from .common import map_texts, text_slices
from .nbsvm import held_out

SIZES = (3, 4)
SLOT_BITS = 20
PLACES = 3
GRAMS_PER_LANGUAGE = 50_000
MIN_COUNT = 2
LEAST_SHARE = 0.25
MAX_LANGUAGES = 1024
#: Pairs of language and n-gram that a training task holds before it hands out its counts.
HELD = 1 << 21
_STEPS = 8  # histogram steps for each doubling of a count
_BLANK = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, whether it is part of a word, and its lower case."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    word = letter | np.array([k == "M" for k in kinds])
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, word, lower


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams, the number of n-grams before each text, and whether a text has a letter."""
    letter, word, lower = _alphabet()
    data, offsets = K.text_bytes(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))[offsets]
    points = np.insert(points, first, np.uint32(_BLANK))  # a blank before each text and after the last
    place = first + np.arange(len(first))
    solid = word[points]
    kept = solid.copy()
    kept[1:] |= solid[:-1]  # the sign that ends a word stands for the blank
    kept[:-1] |= solid[1:]
    spoken = np.add.reduceat(letter[points], place[:-1]) > 0 if len(place) > 1 else np.zeros(0, bool)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))[place]
    solid = solid[kept]
    values = K.mix(np.where(solid, lower[points[kept]], np.uint32(_BLANK)).astype(np.uint64))
    hashes, starts = [], []
    for n in SIZES:
        if len(values) < n:
            continue
        inner = np.ones(len(values) - n + 1, bool)
        for k in range(1, n - 1):
            inner &= solid[k:len(values) - n + 1 + k]
        at = np.flatnonzero(inner)
        hashes.append(K.chain(values, n)[at])
        starts.append(at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(place), np.int64), spoken
    starts = np.concatenate(starts)
    order = np.argsort(starts, kind="stable")
    return np.concatenate(hashes)[order], np.searchsorted(starts[order], before), spoken


class _Counts:
    """Counts of (language, n-gram) pairs of a task, merged whenever many are waiting."""

    def __init__(self):
        self.waiting, self.size, self.held = [], 0, {}

    def add(self, language: int, hashes: np.ndarray) -> None:
        self.waiting.append((language, hashes))
        self.size += len(hashes)
        if self.size > HELD:
            self.merge()

    def merge(self) -> None:
        for language in {own for own, _ in self.waiting}:
            new, n = np.unique(np.concatenate([h for own, h in self.waiting if own == language]), return_counts=True)
            if language in self.held:
                old, m = self.held[language]
                new, inverse = np.unique(np.concatenate((old, new)), return_inverse=True)
                n = np.bincount(inverse, np.concatenate((m, n))).astype(np.int64)
            self.held[language] = new, n
        self.waiting, self.size = [], 0

    def full(self) -> bool:
        return sum(len(h) for h, _ in self.held.values()) > HELD

    def hand_out(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for language, (hashes, n) in sorted(self.held.items()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), language, np.int32)), pa.array(hashes.view(np.int64)), pa.array(n)],
                names=["language", "gram", "n"],
            )
        self.held = {}


def gram_counts(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``language, gram, n`` over all rows of ``(text, lang)``; ``language`` is the place in ``languages``."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                hashes, before, _ = grams(part.column("text"))
                for language, lo, hi in zip(part.column("lang").to_pylist(), before[:-1].tolist(), before[1:].tolist()):
                    counts.add(place[language], hashes[lo:hi])
                if counts.full():
                    yield from counts.hand_out()
        yield from counts.hand_out()

    each = map_texts(rows.select("text", "lang"), run, "language int, gram bigint, n bigint")
    return each.groupBy("language", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Learned languages, their sliced filters and the rate at which a filter holds a foreign n-gram."""

    def __init__(self, languages: list[str], slots: np.ndarray, default: int):
        self.languages, self.slots, self.default = languages, slots, default
        fill = [np.mean((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
        self.chance = np.array(fill) ** PLACES

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """One row of masks over the n-grams for each 64 languages."""
        size = np.uint64(self.slots.shape[1] - 1)
        out = self.slots[:, (hashes & size).astype(np.int64)]
        for k in range(1, PLACES):
            out &= self.slots[:, ((hashes >> np.uint64(k * SLOT_BITS)) & size).astype(np.int64)]
        return out

    def counts(self, hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Corrected number of n-grams of each text that each language holds."""
        masks = self.masks(hashes)
        out = np.zeros((len(before) - 1, len(self.languages)))
        for i in range(len(self.languages)):
            bit = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            summed = np.concatenate((np.zeros(1, np.int64), np.cumsum(bit)))
            hits = summed[before[1:]] - summed[before[:-1]]
            out[:, i] = (hits - np.diff(before) * self.chance[i]) / max(1e-9, 1 - self.chance[i])
        return np.maximum(out, 0)

    def decide(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        hashes, before, spoken = grams(texts)
        counts = self.counts(hashes, before)
        best = counts.argmax(axis=1)
        top = counts[np.arange(len(best)), best]
        counts[np.arange(len(best)), best] = 0
        none = (top <= 0) & spoken
        best[none] = self.default
        score = np.where(spoken & ~none, top / np.maximum(top + counts.max(axis=1), 1e-300), 0.0)
        return [self.languages[i] if s else UNKNOWN for i, s in zip(best.tolist(), spoken.tolist())], score


def train(docs: DataFrame, grams_per_language: int = GRAMS_PER_LANGUAGE, min_count: int = MIN_COUNT, least_share: float = LEAST_SHARE) -> Model | None:
    """Filters from the rows with a language that are not held out, or None without such a row."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    found = bounded_collect(rows.groupBy("lang").count(), MAX_LANGUAGES, "languages")
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    most = max(found, key=lambda r: (r["count"], r["lang"]))["lang"]
    counts = materialize(gram_counts(rows, languages))
    totals = {r["language"]: r["n"] for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    rate = F.col("n") / F.element_at(F.array(*[F.lit(float(totals.get(i, 1))) for i in range(len(languages))]), F.col("language") + 1)
    held = counts.filter(F.col("n") >= min_count).withColumn("rate", rate)
    highest = held.groupBy("gram").agg(F.max("rate").alias("highest"))
    held = held.join(highest, "gram").filter(F.col("rate") >= least_share * F.col("highest"))
    step = F.floor(F.log2("n") * _STEPS).cast("int")
    held = materialize(held.select("language", "gram", step.alias("step")))
    least = {}  # the steps of a language that fit into its filter, from the most frequent n-grams down
    for r in sorted(held.groupBy("language", "step").count().collect(), key=lambda r: -r["step"]):
        language, room = r["language"], least.get(r["language"], (None, grams_per_language, True))
        fits = room[2] and r["count"] <= room[1]
        least[language] = (r["step"] if fits else room[0], room[1] - r["count"], fits)
    cut = F.create_map(*[F.lit(x) for language, (step, _, _) in least.items() for x in (language, 1 << 20 if step is None else step)]) if least else None
    slots = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
    if cut is not None:
        kept = held.filter(F.col("step") >= cut[F.col("language")])
        places = F.array(*[F.shiftrightunsigned("gram", k * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for k in range(PLACES)])
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("language") % 64)
        rows = kept.select(F.floor(F.col("language") / 64).alias("row"), bit.alias("bit"), F.explode(places).alias("slot"))
        packed = rows.groupBy("row", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # a row per slot at most
        slots[packed.column("row").to_numpy(), packed.column("slot").to_numpy()] = packed.column("bits").to_numpy().view(np.uint64)
    return Model(languages, slots, languages.index(most))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    base = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        return base.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for each 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                languages, score = own.decide(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(languages, pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(base, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
