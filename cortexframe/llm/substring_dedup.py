"""Substring dedup: words covered by a window that also starts in a document with a smaller id.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Texts are cut into stretches by content (``anchors``), a stretch
whose gram occurs once in the corpus has no repeated window. The distinct other stretches are dealt to shards by gram.
Each shard builds a compressed FM-index of its stretches and streams the windows of its stretches through backward
search; the suffix interval of a window that matches in full gives the least document that holds it.

A null text has no words. A null ``doc_id`` counts as larger than any, so such a row loses words that a row with an id
holds, and no row loses words to it. Rows that repeat an id do not take words from each other. An empty table gives an
empty result; ``remove`` keeps further columns untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import spread_join
from ..plans.materialize import materialize
from . import anchors as A
from . import kernels as K
from .common import RepeatedGrams, heat_join, let, map_texts, row_key, split_words, text_slices
from .fm_index import FMIndex

WINDOW, GRAM = 13, 5
#: Stretches in one index.
SHARD = 10_000
#: A gram with more distinct stretches is dealt out by window.
HOT_GRAM = 20_000
_NO_ID = (1 << 63) - 1


def _cut(part: pa.RecordBatch, window: int, gram: int):
    data, offsets = K.text_bytes(part.column("text"))
    starts, ends, counts = K.words(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    grams = K.chain(hashes, gram)
    return (data, starts, ends), hashes, counts, grams, A.stretches(grams, counts, gram, window)


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Strings of the byte ranges."""
    size = end - start
    ends = np.cumsum(size)
    at = np.arange(int(size.sum())) + np.repeat(start - ends + size, size)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(data[at]))


def repeated_grams(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> RepeatedGrams:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                _, _, _, grams, s = _cut(part, window, gram)
                yield RepeatedGrams.partial(grams[s.anchor])

    return RepeatedGrams(map_texts(docs.select("text"), run, RepeatedGrams.SCHEMA))


def stretch_rows(docs: DataFrame, repeated: RepeatedGrams, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row_key, ord, gram, ca, cb, windows, words, at`` of the stretches whose gram is repeated.

    ``words`` is the stretch as text. Equal stretches of one text share a row, ``at`` lists the word where each begins.
    """
    shared = repeated.broadcast()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                raw, hashes, counts, grams, s = _cut(part, window, gram)
                own = shared.value.holds(grams[s.anchor])
                text, anchor, first, last = (x[own] for x in s)
                end = last + window
                ca, cb = (K.RangeHash(hashes, b)(first, end) for b in K.BASES)
                order = np.lexsort((first, cb, ca, text))
                text, first, end, ca, cb, anchor = (x[order] for x in (text, first, end, ca, cb, anchor))
                new = np.ones(len(order), bool)
                new[1:] = (text[1:] != text[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])
                heads = np.flatnonzero(new)
                bounds = np.append(heads, len(order))
                at = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(first - counts[text], pa.int32()))
                text, first, end, anchor = text[heads], first[heads], end[heads], anchor[heads]
                size = end - first
                words = _slices(raw[0], raw[1][first], raw[2][end - 1])
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_key").take(take), part.column("ord").take(take), pa.array(K.signed(grams[anchor])),
                     pa.array(K.signed(ca[heads])), pa.array(K.signed(cb[heads])), pa.array(size - window + 1, pa.int32()), words, at],
                    names=["row_key", "ord", "gram", "ca", "cb", "windows", "words", "at"],
                )

    base = docs.select(row_key().alias("row_key"), F.coalesce("doc_id", F.lit(_NO_ID)).cast("bigint").alias("ord"), "text")
    return map_texts(base, run, (
        "row_key struct<a:bigint,b:bigint>, ord bigint, gram bigint, ca bigint, cb bigint, windows int, "
        "words string, at array<int>"
    ))


def _search(window: int):
    """For one shard: the windows of each stretch that a smaller document than ``least`` holds, and that document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data, offsets = K.text_bytes(pa.array(frame["words"], pa.string()))
        begin, end, counts = K.words(data, offsets)
        symbols = K.signed(K.word_hashes(data, begin, end))
        ends, sizes = counts[1:], np.diff(counts)
        index = FMIndex(symbols, ends, window)
        starts = np.arange(len(symbols))
        starts = starts[starts + window <= np.repeat(ends, sizes)]
        codes = index.code(symbols)
        keys = K.RangeHash(symbols.view(np.uint64), K.BASES[0])(starts, starts + window)
        _, one, back = np.unique(keys, return_index=True, return_inverse=True)
        patterns = codes[starts[one][:, None] + np.arange(window)]
        lo, hi, matched = index.search(patterns)
        if not (matched == window).all():
            raise RuntimeError("the index lost one of its own windows")
        least = index.least(lo, hi, frame["least"].to_numpy(np.int64))[back]
        sequence = np.repeat(np.arange(len(frame)), sizes)[starts]
        lower = least < frame["least"].to_numpy(np.int64)[sequence]
        row, place = sequence[lower], (starts - (ends - sizes)[sequence])[lower]
        out = frame[["ca", "cb"]].iloc[row].reset_index(drop=True)
        return out.assign(window=frame["window"].to_numpy()[row] + place, least=least[lower]).astype({"window": "int32"})

    return run


def _shards(units: DataFrame, key: str, count: int, window: int) -> DataFrame:
    shard = F.pmod(F.xxhash64(key), F.lit(max(1, -(-count // SHARD))))
    dealt = units.withColumn("shard", shard).groupBy("shard")
    return dealt.applyInPandas(_search(window), "ca bigint, cb bigint, window int, least bigint")


def lower_windows(stretches: DataFrame, window: int = WINDOW) -> DataFrame:
    """``ca, cb, least, all, low``: per distinct stretch its least document, whether larger ones hold it, and the
    windows that a still smaller document holds in another stretch."""
    contents = materialize(stretches.groupBy("gram", "ca", "cb").agg(
        F.min("ord").alias("least"), (F.max("ord") > F.min("ord")).alias("all"), F.any_value("words").alias("words")
    ))
    hot = materialize(contents.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_GRAM).select("gram", F.lit(True).alias("hot")))
    marked = spread_join(contents, hot, ["gram"], F.col("ca"), "left")
    plain = marked.filter("hot is null").select("gram", "ca", "cb", "least", "words", F.lit(0).alias("window"))
    found = _shards(plain, "gram", contents.count(), window)
    if hot.limit(1).count():
        # equal windows of a hot gram are one unit of the index, whatever the number of stretches
        slices = let(split_words(F.col("words")), lambda w: F.transform(
            F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.array_join(F.slice(w, i, window), " ")
        ))
        parts = marked.filter("hot").select("ca", "cb", "least", F.posexplode(slices).alias("window", "words"))
        parts = parts.withColumns({"wa": F.xxhash64("words"), "wb": F.xxhash64(F.lit(1), "words")})
        parts = materialize(parts)
        units = materialize(parts.groupBy("wa", "wb").agg(F.min("least").alias("m"), F.any_value("words").alias("words")))
        alone = units.select(F.col("wa").alias("ca"), F.col("wb").alias("cb"), F.col("m").alias("least"), "words", F.lit(0).alias("window"), "wa")
        better = _shards(alone, "wa", units.count(), window).select(F.col("ca").alias("wa"), F.col("cb").alias("wb"), F.col("least").alias("m2"))
        units = units.drop("words").join(better, ["wa", "wb"], "left").select("wa", "wb", F.coalesce("m2", "m").alias("m"))
        back = heat_join(parts.drop("words"), units, ["wa", "wb"], F.xxhash64("ca", "window")).filter("m < least")
        found = found.unionByName(back.select("ca", "cb", "window", F.col("m").alias("least")))
    low = found.groupBy("ca", "cb").agg(F.collect_list("window").alias("low"))  # windows of one stretch: a few
    kept = contents.drop("words", "gram").join(low, ["ca", "cb"], "left").filter(F.col("all") | F.col("low").isNotNull())
    return materialize(kept)


def covered_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``row_key`` and the word spans (half-open, as ``lo, hi`` pairs) to remove."""
    repeated = repeated_grams(docs, window, gram)
    stretches = materialize(stretch_rows(docs, repeated, window, gram))
    lower = lower_windows(stretches, window)
    placed = heat_join(stretches.drop("words", "gram"), lower, ["ca", "cb"], F.col("row_key.a"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") + (window - 1)).alias("hi")))
    single = F.transform(F.coalesce("low", F.array().cast("array<int>")), lambda i: F.struct(i.alias("lo"), (i + window).alias("hi")))
    local = F.when(F.col("ord") > F.col("least"), whole).otherwise(single)
    spans = F.flatten(F.transform("at", lambda a: F.transform("_local", lambda s: F.array(a + s["lo"], a + s["hi"]))))
    rows = placed.withColumn("_local", local).filter(F.size("_local") > 0).select("row_key", F.flatten(spans).alias("spans"))
    return rows.groupBy("row_key").agg(merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"))


def merge_spans(flat: np.ndarray) -> np.ndarray:
    """Sorted disjoint ``lo, hi`` rows that cover the same places; touching spans become one."""
    spans = np.asarray(flat, np.int64).reshape(-1, 2)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.column_stack((spans[new, 0], reach[ends]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def merged_spans(spans: pd.Series) -> pd.Series:
    """``merge_spans`` of each row."""
    return spans.map(lambda x: merge_spans(x).reshape(-1).astype(np.int32))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """``_doc`` (all columns), ``n_words, n_removed, kept_sha256`` and, on demand, ``left``: the kept words."""
    spans = covered_words(docs, window, gram)
    keyed = docs.select(F.struct("*").alias("_doc"), "text", row_key().alias("row_key"))
    joined = spread_join(keyed, spans, ["row_key"], F.lit(0), "left", salts=1).select("_doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = [], [], [], []
                for text, flat in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    words, cut = (text or "").encode().split(), merge_spans(flat or [])
                    kept, at = [], 0
                    for lo, hi in cut.tolist():
                        kept += words[at:lo]
                        at = hi
                    left = b" ".join(kept + words[at:])
                    row = len(words), int((cut[:, 1] - cut[:, 0]).sum()), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None
                    for c, v in zip(rows, row):
                        c.append(v)
                kinds = pa.int64(), pa.int64(), pa.string(), pa.string()
                yield pa.RecordBatch.from_arrays(
                    [part.column("_doc"), *(pa.array(c, k) for c, k in zip(rows, kinds))],
                    names=["_doc", "n_words", "n_removed", "kept_sha256", "left"],
                )

    schema = f"_doc {joined.schema['_doc'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string, left string"
    return map_texts(joined, run, schema)


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    out = remove(docs.select("doc_id", "text"), window, with_text=False)
    return out.select("_doc.doc_id", "n_words", "n_removed", "kept_sha256")
