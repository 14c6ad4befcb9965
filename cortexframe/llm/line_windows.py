"""Line dedup with overlapping windows of three lines, with DataFrame functions only.

A window is three consecutive lines of a text that hold more than white space; lines without text do not count and
are never removed. Occurrences are ordered by ``doc_id`` (null last), row key and position. The first occurrence of a
window stays; the lines of every later one are covered, and the covered lines of a text are removed together.

Texts of fewer than three lines, empty and null texts stay as they are. Rows that agree in ``doc_id`` and ``text`` are
copies of one row and get the same result. An empty table gives an empty result; further columns are kept untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from .common import let, row_key

LINES = 3


def _windows(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    full = F.filter(lines, lambda p: p["x"].rlike(r"[^ \t\n\x0B\f\r]"))

    def hashed(p: Column) -> Column:
        def one(k: Column) -> Column:
            near = [F.get(p, k + j) for j in range(LINES)]
            return F.struct(
                F.xxhash64(*[n["x"] for n in near]).alias("a"),
                F.xxhash64(F.lit(1), *[n["x"] for n in reversed(near)]).alias("b"),
                F.array(*[n["i"] for n in near]).alias("lines"),
            )

        return F.when(F.size(p) >= LINES, F.transform(F.sequence(F.lit(0), F.size(p) - LINES), one))

    return let(full, hashed)


def covered_lines(docs: DataFrame) -> DataFrame:
    """``row_key`` and the sorted line numbers to remove, for the texts that lose lines.

    Windows are counted with partial sums, only repeated ones are kept, and the join back to the texts spreads a
    frequent window over many tasks.
    """
    placed = docs.select("doc_id", row_key().alias("row_key"), F.explode(_windows(F.col("text"))).alias("w")).select(
        F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.lines").alias("lines"), "row_key",
        F.struct(F.col("doc_id").isNull(), "doc_id", "row_key", F.col("w.lines")[0]).alias("at"),
    )
    firsts = placed.groupBy("a", "b").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    repeated = firsts.filter("first != last").select("a", "b", "first")
    later = spread_join(placed, repeated, ["a", "b"], "row_key").filter("at != first")
    return later.groupBy("row_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("cut"))


def remove_repeated(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with later windows taken out of ``text``, plus ``_n_lines`` and ``_n_removed``."""
    keyed = docs.select(F.struct("*").alias("_doc"), "text", row_key().alias("row_key"))
    joined = spread_join(keyed, covered_lines(docs), ["row_key"], F.lit(0), "left", salts=1)
    lines = F.split("text", "\n")
    left = let(lines, lambda x: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("cut")), lambda i: F.get(x, i)), "\n"
    ))
    return joined.select(
        F.col("_doc"), F.when(F.col("cut").isNull(), F.col("text")).otherwise(left).alias("_left"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("_n_lines"),
        F.coalesce(F.size("cut"), F.lit(0)).cast("bigint").alias("_n_removed"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the later windows removed; ``n_chars``, if there is such a column, follows the text."""
    out = remove_repeated(docs)
    new = {"text": F.col("_left"), "n_chars": F.when(F.col("_n_removed") > 0, F.length("_left").cast("bigint")).otherwise(F.col("_doc.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[
        new[c].alias(c) if new.get(c) is not None else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns
    ])
