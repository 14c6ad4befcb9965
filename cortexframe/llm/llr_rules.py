"""Quality rules: fixed text rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Null and empty texts have no words and fail the base rules. A repeated row is judged like any other row; only the
needed columns are read, so further columns may have any name. An empty table gives an empty result; without trusted
rows every ratio is 0 and only the base rules decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import materialize
from .common import let, split_words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Size of the hashed multinomials; also bounds what the driver and the tasks hold of the model.
BUCKETS = 1 << 16
#: Target pseudo-count of a bucket; the raw pseudo-count is in proportion, so rare buckets say nothing.
SMOOTHING = 10.0
#: Rejected below this mean log ratio per n-gram.
THRESHOLD = -0.1


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words inside any ``n``-word window that occurs twice or more, from an array of word hashes."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]),
    )

    def covered(w: Column) -> Column:
        placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(placed, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))
        first = F.struct(F.lit(-n).alias("at"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            starts, first,
            lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(n), i - acc["at"])).alias("n")),
            lambda acc: acc["n"],
        )

    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(hashes) > n, found).otherwise(F.lit(0)).cast("bigint")


def text_stats(text: Column, ratios: list[float]) -> Column:
    """Struct of the base counts, ``base_failed`` and ``score``.

    Words and hashes are bound once per row, so the struct can be projected or filtered on without a second pass.
    """
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))

    def of_words(words: Column) -> Column:
        return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(
            F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
                (F.length(filled) - F.length(F.regexp_replace(filled, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                repeated_words(hashes).alias("n_repeat_words"),
                mean_log_ratio(hashes, ratios).alias("score"),
            ),
            lambda s: s.withField("base_failed", (s["n_words"] < MIN_WORDS) | (
                s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT
            )),
        ))

    return let(split_words(text), of_words)


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words and of all pairs of neighbouring words."""
    pairs = F.when(F.size(hashes) > 1, F.transform(
        F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))
    )).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.concat(hashes, pairs), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))


def fit_log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log ratio of the trusted to the raw multinomial for each bucket.

    ``trusted`` lists the ``doc_id`` of the target texts. Counts cover every row of ``docs``; tasks send one partial
    count per bucket. The result has ``buckets`` numbers whatever the size of the input.
    """
    marks = trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("_trusted", F.lit(1))
    marked = spread_join(docs.select("doc_id", "text"), marks, ["doc_id"], F.xxhash64("text"), "left")
    grams = marked.select(
        F.coalesce("_trusted", F.lit(0)).alias("_trusted"),
        F.transform(split_words(F.col("text")), lambda w: F.xxhash64(w)).alias("_hashes"),
    ).select("_trusted", F.explode(ngram_buckets(F.col("_hashes"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_trusted").alias("target"))
    rows = materialize(counts).collect()  # at most one row per bucket
    ratios, all_raw, all_target = [0.0] * buckets, sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    for r in rows if all_target else []:
        expected = r["raw"] * all_target / all_raw
        ratios[r["bucket"]] = math.log((r["target"] + SMOOTHING) / (expected + SMOOTHING))
    return ratios


def mean_log_ratio(hashes: Column, ratios: list[float]) -> Column:
    """Mean log ratio over the n-grams of a text; 0 without words. The ratios are one constant of the plan."""
    known = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = let(ngram_buckets(hashes, len(ratios)), lambda b: F.aggregate(
        b, F.lit(0.0), lambda acc, i: acc + F.get(known, i)
    ) / F.greatest(F.size(b), F.lit(1)))
    return F.coalesce(total, F.lit(0.0))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``score`` and ``kept`` for every row of ``docs``."""
    ratios = fit_log_ratios(docs, trusted, buckets)
    scored = docs.select("doc_id", text_stats(F.col("text"), ratios).alias("_s")).select("doc_id", "_s.*")
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score",
        (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"),
    )


def keep(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    ratios = fit_log_ratios(docs, trusted, buckets)
    passes = let(text_stats(F.col("text"), ratios), lambda s: ~s["base_failed"] & (s["score"] >= threshold))
    return docs.filter(passes)
