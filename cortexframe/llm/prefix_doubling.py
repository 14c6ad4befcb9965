"""Suffix-array dedup by distributed prefix doubling: bytes covered by a long string that starts anywhere else too.

Texts are UTF-8 bytes (null: empty) and strings never cross texts. Suffixes are ranked at anchors only (``anchors``):
every window of ``length`` bytes holds exactly one, at a distance that equal windows share. The doubling runs on ranks:

1. The first rank of an anchor is its gram; Spark counts the grams, and anchors with a unique one drop out.
2. Stretches of windows with equal content become one row with a weight; a weight above one is repeated as a whole.
3. In each round the pair of an anchor, its rank and the hash of the bytes that double it, is grouped by Spark and
   ranked again, on both sides of the anchor. A unique pair ends that side and so bounds the windows still open.
4. The open windows are ranked in blocks of ``BLOCK`` starts by the bytes that all windows of a block share; a unique
   block drops out. The other blocks keep the bytes around the shared ones, and windows are told apart by those.

Repeated rows of the table are repeated strings and lose all windows. Null ids need no special case. An empty table
gives an empty result; ``remove`` keeps further columns untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join, spread_join
from ..plans.materialize import drop_table, materialize
from . import anchors as A
from . import kernels as K
from .common import RepeatedGrams, heat_join, map_texts, row_key, text_parts, text_slices
from .substring_dedup import merge_spans, merged_spans

LENGTH, GRAM, ONE_IN = 400, 32, 16
#: Windows that are ranked together before they are ranked alone.
BLOCK = 32
#: Bytes of text that a task works on at a time; longer texts are cut into overlapping parts.
PART = 1 << 18
#: Rows of one block that a task takes, and windows that it makes.
HOT, TASK_WINDOWS = 4_000, 500_000
_FAR = 1 << 30


def byte_grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` (a power of two) bytes from each place, by doubling."""
    out, factor, n = K.byte_values(data), K.BASES[0], 1
    while n < gram:
        out = out[:-n] * np.uint64(factor) + out[n:] if len(out) > n else out[:0]
        factor, n = factor * factor % (1 << 64), 2 * n
    return K.mix(out)


def _cut(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, one_in: int):
    grams = byte_grams(data, gram)
    return grams, A.stretches(grams, offsets, gram, length, one_in)


def repeated_grams(docs: DataFrame, length: int, gram: int, one_in: int) -> RepeatedGrams:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, _, _ in text_parts(batch.column("text"), PART, length - 1):
                grams, s = _cut(data, offsets, length, gram, one_in)
                yield RepeatedGrams.partial(grams[s.anchor])

    return RepeatedGrams(map_texts(docs.select("text"), run, RepeatedGrams.SCHEMA))


def rounds(gram: int, length: int) -> list[int]:
    """Lengths of the rounds: doublings of the gram from a quarter of the threshold on."""
    out, n = [], 2 * gram
    while n < length:
        if 4 * n >= length:
            out.append(n)
        n *= 2
    return out


def stretch_rows(docs: DataFrame, repeated: RepeatedGrams, length: int, gram: int, one_in: int) -> DataFrame:
    """``row_key, gram, ca, cb, windows, off, right, left, cores, at`` of the stretches whose gram is repeated.

    ``off`` is the distance from the first window to the anchor; ``right`` and ``left`` hash the bytes each round adds,
    null where the stretch ends; ``cores`` hashes what the windows of each block share, from the block of the last
    window on. Equal stretches of one text share a row, ``at`` lists where each begins.
    """
    shared = repeated.broadcast()
    lengths = rounds(gram, length)
    forth = list(zip([gram, *lengths], lengths))
    back = list(zip([0, *lengths], lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, owner, base in text_parts(batch.column("text"), PART, length - 1):
                grams, s = _cut(data, offsets, length, gram, one_in)
                own = shared.value.holds(grams[s.anchor])
                text, anchor, first, last = (x[own] for x in s)
                end = last + length
                values = K.byte_values(data)
                hashed = [K.RangeHash(values, b) for b in K.BASES]
                ca, cb = (h(first, end) for h in hashed)
                order = np.lexsort((first, cb, ca, text))
                text, anchor, first, last, end, ca, cb = (x[order] for x in (text, anchor, first, last, end, ca, cb))
                new = np.ones(len(order), bool)
                new[1:] = (text[1:] != text[:-1]) | (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])
                heads = np.flatnonzero(new)
                at = pa.ListArray.from_arrays(
                    pa.array(np.append(heads, len(order)), pa.int32()), pa.array(first - offsets[text] + base[text], pa.int32())
                )
                text, anchor, first, last, end, ca, cb = (x[heads] for x in (text, anchor, first, last, end, ca, cb))
                right = [(anchor + a, anchor + b) for a, b in forth]
                left = [(anchor - b, anchor - a) for a, b in back]
                pieces = []
                for ranges in (right, left):
                    cols, valid = [], []
                    for lo, hi in ranges:
                        inside = (lo >= first) & (hi <= end)
                        cols.append(hashed[0](np.where(inside, lo, 0), np.where(inside, hi, 0)))
                        valid.append(inside)
                    flat, mask = np.column_stack(cols).reshape(-1), np.column_stack(valid).reshape(-1)
                    pieces.append(pa.ListArray.from_arrays(
                        pa.array(np.arange(len(heads) + 1) * len(ranges), pa.int32()), pa.array(K.signed(flat), mask=~mask)
                    ))
                # blocks count from the anchor back, so equal windows are in blocks of equal number
                low, high = (anchor - last) // BLOCK, (anchor - first) // BLOCK
                count = high - low + 1
                bounds = np.concatenate(([0], np.cumsum(count)))
                block = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - low, count)
                core = np.repeat(anchor, count) - block * BLOCK
                cores = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(K.signed(hashed[1](core, core + length - BLOCK + 1)))
                )
                pieces.append(cores)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row_key").take(pa.array(owner[text])), pa.array(K.signed(grams[anchor])), pa.array(K.signed(ca)),
                     pa.array(K.signed(cb)), pa.array(last - first + 1, pa.int32()), pa.array(anchor - first, pa.int32()), *pieces, at],
                    names=["row_key", "gram", "ca", "cb", "windows", "off", "right", "left", "cores", "at"],
                )

    return map_texts(docs.select(row_key().alias("row_key"), "text"), run, (
        "row_key struct<a:bigint,b:bigint>, gram bigint, ca bigint, cb bigint, windows int, off int, "
        "right array<bigint>, left array<bigint>, cores array<bigint>, at array<int>"
    ))


def doubled(contents: DataFrame, gram: int, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """``id, right_bound, left_bound``: the least length found unique on each side of the anchor, far if none; and the
    stored tables it reads.

    The rank of a pair is its hash: ranks of different pairs that meet by chance keep windows open and lose none.
    """
    sides = [
        contents.select("id", F.lit(side).alias("side"), F.col("gram").alias("rank"), "weight", F.col(side).alias("pieces"))
        for side in ("right", "left")
    ]
    active, ended, stored = sides[0].unionByName(sides[1]), [], []
    for k, n in enumerate(rounds(gram, length)):
        now = active.withColumn("piece", F.get("pieces", F.lit(k))).filter("piece is not null")
        now = now.select("id", "side", F.xxhash64("side", "rank", "piece").alias("rank"), "weight", "pieces")
        ranks = now.groupBy("rank").agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
        ranks = materialize(ranks.filter("_w > 1").select("rank", "_n", F.lit(True).alias("more")))
        ranked = heat_join(now, ranks.drop("_n"), ["rank"], F.col("id"), "left", counts=ranks.select("rank", "_n"))
        ranked = materialize(ranked.select("id", "side", "rank", "weight", "more", F.when(F.col("more"), F.col("pieces")).alias("pieces")))
        stored.append(ranked)
        ended.append(ranked.filter("more is null").select("id", "side", F.lit(n).alias("bound")))
        active = ranked.filter("more").drop("more")
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    bounds = found.groupBy("id").agg(
        F.coalesce(F.min(F.when(F.col("side") == "right", F.col("bound"))), F.lit(_FAR)).alias("right_bound"),
        F.coalesce(F.min(F.when(F.col("side") == "left", F.col("bound"))), F.lit(_FAR)).alias("left_bound"),
    )
    return bounds, stored


def _compact(begin: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Neighbouring ranges (sorted by ``begin``) that lie within ``PART`` bytes or are one range, and add up to few bytes."""
    total = np.cumsum(end - begin)
    lo = 0
    while lo < len(begin):
        near = np.searchsorted(begin, begin[lo] + PART, "right")
        few = np.searchsorted(total, (total[lo - 1] if lo else 0) + 4 * PART, "right")
        hi = max(lo + 1, int(min(near, few)))
        yield slice(lo, hi)
        lo = hi


def edge_rows(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``id, lo, hi, far, core, core2, edge``: the wanted windows of a block in one row.

    ``wanted(row_key, id, at, lo, hi, off)`` names windows ``lo..hi``, all in one block, of the stretch that begins at
    ``at``. ``far`` is the distance of window ``lo`` to the anchor. ``edge`` holds the bytes of the windows without the
    core: those of window ``lo + i`` are the ``BLOCK - 1`` from place ``i`` on, parted by the core where ``far - i`` tells.
    """
    inner = length - BLOCK + 1
    lists = wanted.groupBy("row_key").agg(F.collect_list(F.struct("id", "at", "lo", "hi", "off")).alias("wanted"))
    texts = docs.select(row_key().alias("row_key"), "text")
    joined = spread_join(texts, lists, ["row_key"], F.lit(0), salts=1).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            lists = batch.column("wanted")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            ids = flat.field(0)
            at, lo, hi, off = (flat.field(i).to_numpy() for i in range(1, 5))
            begin, end = offsets[owner] + at + lo, offsets[owner] + at + hi + length
            core = offsets[owner] + at + off - (off - lo) // BLOCK * BLOCK
            order = np.argsort(begin, kind="stable")
            for own in _compact(begin[order], end[order]):
                own = order[own]
                first, last, mid = begin[own], end[own], core[own]
                left = first.min()  # each window holds the core
                values = K.byte_values(data[left:last.max()])
                cores = [K.RangeHash(values, b)(mid - left, mid - left + inner) for b in K.BASES]
                size = last - first - inner
                ends = np.cumsum(size)
                place = np.arange(int(ends[-1])) - np.repeat(ends - size - first, size)
                edge = data[np.where(place < np.repeat(mid, size), place, place + inner)]
                bounds = np.concatenate(([0], ends)).astype(np.int32)
                edges = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds), pa.py_buffer(edge)])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(own)), *(pa.array(x[own], pa.int32()) for x in (lo, hi, off - lo)),
                     *(pa.array(K.signed(c)) for c in cores), edges],
                    names=["id", "lo", "hi", "far", "core", "core2", "edge"],
                )

    return map_texts(joined, run, "id bigint, lo int, hi int, far int, core bigint, core2 bigint, edge binary")


def _windows(edges: DataFrame) -> DataFrame:
    """``id, window`` and the content of each window: ``core, core2, far, rest``."""
    one = edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hi") - F.col("lo"))))
    rest = F.substring("edge", F.col("i") + 1, F.lit(BLOCK - 1)).alias("rest")
    return one.select("id", (F.col("lo") + F.col("i")).alias("window"), "core", "core2", (F.col("far") - F.col("i")).alias("far"), rest)


def repeated_windows(edges: DataFrame) -> DataFrame:
    """``id, window`` of the windows with an id whose content another row holds too.

    Equal windows are in blocks of equal cores, so the blocks move and each task makes its windows. Cores of more than
    ``HOT`` rows are dealt out by window.
    """
    hot = edges.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT)
    hot = materialize(hot.select("core", F.lit(True).alias("hot")))
    marked = lookup_join(edges, hot, ["core"], "left")
    cold = marked.filter("hot is null").drop("hot")
    count = cold.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
    dealt = _windows(cold.repartition(count // TASK_WINDOWS + 1, "core"))
    same = Window.partitionBy("core", "core2", "far", "rest")
    found = dealt.withColumn("n", F.count(F.lit(1)).over(same)).filter("n > 1 and id is not null").select("id", "window")
    if hot.limit(1).count():
        keys = [F.xxhash64(F.lit(k), "core", "core2", "far", "rest").alias(c) for k, c in enumerate(("wa", "wb"))]
        windows = materialize(_windows(marked.filter("hot")).select("id", "window", *keys))
        ranks = materialize(windows.groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
        hits = heat_join(windows.filter("id is not null"), ranks.drop("_n"), ["wa", "wb"], F.hash("id", "window"), counts=ranks)
        found = found.unionByName(hits.select("id", "window"))
    return found


def covered_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, one_in: int = ONE_IN) -> DataFrame:
    """``row_key`` and the byte spans (half-open, as ``lo, hi`` pairs) to remove."""
    repeated = repeated_grams(docs, length, gram, one_in)
    rows = materialize(stretch_rows(docs, repeated, length, gram, one_in))
    contents = rows.groupBy("gram", "ca", "cb", "windows", "off").agg(
        F.sum(F.size("at")).alias("weight"), F.any_value("right").alias("right"), F.any_value("left").alias("left"),
        F.any_value("cores").alias("cores"), F.min(F.struct("row_key", F.col("at")[0].alias("at"))).alias("one"),
    )
    contents = materialize(contents.withColumn("id", F.monotonically_increasing_id()))
    open_grams = contents.filter("weight = 1").select("gram").distinct()
    bounds, passed = doubled(spread_join(contents, open_grams, ["gram"], F.col("id")), gram, length)
    single = contents.filter("weight = 1").join(bounds, "id", "left")
    lo = F.greatest(F.lit(0), F.col("off") - F.coalesce("left_bound", F.lit(_FAR)) + 1)
    hi = F.least(F.col("windows") - 1, F.col("off") - (length + 1) + F.coalesce("right_bound", F.lit(_FAR)))
    cols = ["gram", "id", "one", "windows", "off", "cores", "lo", "hi", "weight"]
    open_ = materialize(single.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi").select(*cols))
    for table in passed:  # their disk is needed below
        drop_table(table)
    # whole stretches that are repeated can hold single windows of others with the same gram
    reach = open_.groupBy("gram").agg(F.min(F.col("off") - F.col("hi")).alias("near"), F.max(F.col("off") - F.col("lo")).alias("far"))
    partners = spread_join(contents.filter("weight > 1"), reach, ["gram"], F.col("id")).withColumns({
        "lo": F.greatest(F.lit(0), F.col("off") - F.col("far")), "hi": F.least(F.col("windows") - 1, F.col("off") - F.col("near")),
    }).filter("lo <= hi").select(*cols)
    low = F.floor((F.col("off") - F.col("windows") + 1) / BLOCK)
    blocks = open_.unionByName(partners).select(
        "id", "one", "off", "lo", "hi", "weight", F.posexplode("cores").alias("b", "core"), low.alias("low")
    ).withColumn("b", (F.col("b") + F.col("low")).cast("int")).drop("low")
    # the windows of block b start BLOCK * b to BLOCK * b + BLOCK - 1 bytes in front of the anchor
    blocks = blocks.withColumns({
        "lo": F.greatest("lo", F.col("off") - (F.col("b") + 1) * BLOCK + 1), "hi": F.least("hi", F.col("off") - F.col("b") * BLOCK),
    }).filter("lo <= hi")
    blocks = materialize(blocks)
    again = blocks.groupBy("b", "core").agg(F.sum("weight").alias("_w"), F.min("weight").alias("_l"), F.count(F.lit(1)).alias("_n"))
    again = materialize(again.filter("_w > 1 and _l = 1").select("b", "core", "_n"))
    kept = heat_join(blocks, again.drop("_n"), ["b", "core"], F.col("id"), counts=again)
    one = F.when(F.col("weight") == 1, F.col("id")).alias("id")  # the others are repeated as a whole
    wanted = kept.select("one.row_key", one, "one.at", "lo", "hi", "off")
    edges = materialize(edge_rows(docs, wanted, length))
    drop_table(blocks)
    drop_table(open_)
    hits = repeated_windows(edges)
    of_content = hits.groupBy("id").agg(F.array_sort(F.collect_list("window")).alias("hit"))  # windows of one stretch
    found = contents.join(of_content, "id", "left").filter("weight > 1 or hit is not null").select("ca", "cb", "hit")
    placed = heat_join(rows.select("row_key", "ca", "cb", "windows", "at"), materialize(found), ["ca", "cb"], F.col("row_key.a"))
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("windows") + (length - 1)).alias("hi")))
    local = F.when(F.col("hit").isNull(), whole).otherwise(
        F.transform("hit", lambda i: F.struct(i.alias("lo"), (i + length).alias("hi")))
    )
    spans = F.flatten(F.flatten(F.transform("at", lambda a: F.transform("_local", lambda s: F.array(a + s["lo"], a + s["hi"])))))
    cut = placed.withColumn("_local", local).select("row_key", spans.alias("spans"))
    return cut.groupBy("row_key").agg(merged_spans(F.flatten(F.collect_list("spans"))).alias("spans"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, one_in: int = ONE_IN, with_text: bool = True) -> DataFrame:
    """``_doc`` (all columns), ``n_bytes, n_removed, n_spans, kept_sha256`` and, on demand, ``left``: the bytes kept."""
    spans = covered_bytes(docs, length, gram, one_in)
    keyed = docs.select(F.struct("*").alias("_doc"), "text", row_key().alias("row_key"))
    joined = spread_join(keyed, spans, ["row_key"], F.lit(0), "left", salts=1).select("_doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                rows = [], [], [], [], []
                for text, flat in zip(part.column("text").to_pylist(), part.column("spans")):
                    raw, cut = (text or "").encode(), merge_spans(flat.values.to_numpy() if flat.is_valid else [])
                    kept, at = [], 0
                    for lo, hi in cut.tolist():
                        kept.append(raw[at:lo])
                        at = hi
                    left = b"".join([*kept, raw[at:]])
                    row = len(raw), int((cut[:, 1] - cut[:, 0]).sum()), len(cut), hashlib.sha256(left).hexdigest(), left if with_text else None
                    for c, v in zip(rows, row):
                        c.append(v)
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [part.column("_doc"), *(pa.array(c, k) for c, k in zip(rows, kinds))],
                    names=["_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left"],
                )

    schema = f"_doc {joined.schema['_doc'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, left binary"
    return map_texts(joined, run, schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    out = remove(docs.select("doc_id", "text"), length, with_text=False)
    return out.select("_doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
