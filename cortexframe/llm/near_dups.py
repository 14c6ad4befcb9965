"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets and union-find grouping.

Texts are lower-cased (A-Z) and cut at white space; the set of a text is its distinct ``shingle``-word shingles, as
64-bit hashes. Texts with equal sets form a class. Two classes are linked when
``100 * intersection >= percent * union``; a group is a component of links.

Null and empty texts have an empty set and are alone. Rows with a null ``doc_id`` take part; a group of such rows only
has a null ``component_id``. Repeated rows share a class. An empty table gives an empty result; further columns are
kept untouched by ``dedup`` and not read by ``groups``.

Candidates: classes that share a band of the signature. With 32 bands of 4 ranks, a pair at similarity 0.8 is missed
with probability (1 - 0.8^4)^32 = 5e-8, at 0.85 with 6e-11. No bucket is cut:

1. In each bucket every member is checked against one member, the one with the most companions in all its buckets.
2. Members that this leaves outside the component of that one are checked against the whole component and against each
   other, in blocks of bounded size whose tasks hand out a spanning forest of the links instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import spread_join
from ..plans.materialize import materialize
from . import kernels as K
from .common import heat_join, map_texts, row_key, text_slices
from .components import components

BANDS, ROWS = 32, 4
BLOCK = 512


def _sets(part: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    data, offsets = K.text_bytes(part.column("text"))
    data = K.lower_ascii(data)
    starts, ends, counts = K.words(data, offsets)
    return K.shingle_sets(K.word_hashes(data, starts, ends), counts, shingle)


def _ids(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two order-free hashes of each set."""
    a = [int(s.sum(dtype=np.uint64) + np.uint64(len(s))) if len(s) else 0 for s in sets]
    b = [int(K.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    return tuple(pa.array(K.signed(np.array(x, np.uint64)), pa.int64()) for x in (a, b))


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, row_key, n_shingles, va, vb`` (the class) and one hash per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                sets = _sets(part, shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                sig = np.full((len(sets), bands * rows), np.uint64(0xFFFFFFFFFFFFFFFF))
                for lo, hi in _runs(sizes, 300_000):
                    if sizes[lo:hi].max() <= 300_000:
                        group = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                        sig[lo:hi] = K.superminhash(np.concatenate(sets[lo:hi]), group, hi - lo, bands * rows)
                    else:  # one very long text: the signature of a union is the least of the parts' signatures
                        for at in range(0, sizes[lo], 300_000):
                            piece = sets[lo][at:at + 300_000]
                            own = K.superminhash(piece, np.zeros(len(piece), np.int64), 1, bands * rows)
                            sig[lo] = np.minimum(sig[lo], own[0])
                key = np.zeros((len(sets), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for r in range(rows):
                    key = K.mix(key * np.uint64(3) + sig[:, r::rows])
                flat = pa.array(K.signed(np.ascontiguousarray(key)).reshape(-1), pa.int64())
                each = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), pa.array(sizes), *_ids(sets), each],
                    names=["doc_id", "row_key", "n_shingles", "va", "vb", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, row_key struct<a:bigint,b:bigint>, n_shingles bigint, va bigint, vb bigint, bands array<bigint>"
    return map_texts(docs.select("doc_id", row_key().alias("row_key"), "text"), run, schema)


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def class_sets(docs: DataFrame, row_keys: DataFrame, shingle: int) -> DataFrame:
    """``v, set`` of the rows named by ``row_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=2 << 20):
                sets = _sets(part, shingle)
                own = pa.array([K.signed(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*_ids(sets), own], names=["va", "vb", "set"])

    keyed = docs.select("text", row_key().alias("row_key"))
    texts = spread_join(keyed, row_keys, ["row_key"], F.lit(0), salts=1)  # one row per key, but for repeated rows
    found = map_texts(texts.select("text"), run, "va bigint, vb bigint, set array<bigint>")
    return found.groupBy(F.struct("va", "vb").alias("v")).agg(F.any_value("set").alias("set"))


def _spanning(percent: int):
    """For one block of ``left`` against one block of members: links that join different components."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left = frame[frame["side"] == 0].reset_index(drop=True)
        right = frame[frame["side"] == 1].reset_index(drop=True)
        keys = list(zip(right["va"], right["vb"]))
        sets = [np.asarray(s, np.int64) for s in right["set"]]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        values, codes = np.unique(flat, return_inverse=True)
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for key, c in zip([*keys, *zip(left["va"], left["vb"])], [*zip(right["ra_"], right["rb_"]), *zip(left["ra_"], left["rb_"])]):
            root[find(("v", *key))] = find(("c", *c))
        out = []
        for va, vb, own in zip(left["va"], left["vb"], left["set"]):
            mine = find(("v", va, vb))
            if all(find(("v", *k)) == mine for k in keys):
                continue
            own = np.asarray(own, np.int64)
            at = np.searchsorted(values, own)
            within = at < len(values)  # a set is in unsigned order, so the places left out are not its last ones
            at, named = at[within], own[within]
            hit = np.zeros(len(values), bool)
            hit[at[values[at] == named]] = True
            counts = np.concatenate(([0], np.cumsum(hit[codes])))
            shared = counts[ends[1:]] - counts[ends[:-1]]
            for i in np.flatnonzero(100 * shared >= percent * (sizes + len(own) - shared)).tolist():
                a, b = find(("v", va, vb)), find(("v", *keys[i]))
                if a != b:
                    root[a] = b
                    out.append((va, vb, *keys[i]))
        return pd.DataFrame(out, columns=["ua", "ub", "va", "vb"]).astype("int64")

    return run


def links(docs: DataFrame, base: DataFrame, shingle: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Component of every class that has a link: ``v, root``."""
    classes = base.filter("n_shingles > 0").groupBy("va", "vb").agg(
        F.min_by("bands", "row_key").alias("bands"), F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n"),
    )
    classes = classes.select(F.struct("va", "vb").alias("v"), "bands", "row_key", "n")
    rows = classes.select("v", "n", "row_key", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = materialize(heat_join(rows, shared, ["band"], F.col("v.va")))
    wanted = members.select("row_key").distinct()
    sets = materialize(class_sets(docs, wanted, shingle))

    mass = members.groupBy("v").agg(F.sum("size").alias("mass"))
    heads = members.join(mass, "v").groupBy("band").agg(F.max(F.struct("mass", "v", "n")).alias("h"))
    heads = materialize(heads.select("band", F.col("h.v").alias("u"), F.col("h.n").alias("un")))
    pairs = heat_join(members, heads, ["band"], F.col("v.va")).filter(
        (F.col("u") != F.col("v")) & (F.least("n", "un") * 100 >= F.greatest("n", "un") * percent)
    ).select("u", "v").distinct()
    pairs = materialize(pairs)
    heads_sets = sets.select(F.col("v").alias("u"), F.col("set").alias("su"))
    first = heat_join(pairs, sets, ["v"], F.col("u.va"))
    first = heat_join(first, heads_sets, ["u"], F.col("v.va"))
    common = F.size(F.array_intersect("su", "set"))
    linked = materialize(first.withColumn("i", common).filter(
        F.col("i") * 100 >= (F.size("su") + F.size("set") - F.col("i")) * percent
    ).select("u", "v"))
    roots = components(linked)

    # members outside the component of the head of one of their buckets
    known = members.select("v").distinct().join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
    known = materialize(known)
    hubs = heat_join(heads, known.select(F.col("v").alias("u"), F.col("root").alias("hub")), ["u"], F.col("band"))
    big = members.filter("size > 2").select("band", "v")
    outside = heat_join(big, hubs.select("band", "hub"), ["band"], F.col("v.va"))
    outside = outside.join(known, "v").filter("root != hub")
    outside = materialize(outside.select("hub", "v", "root").distinct())
    hot = outside.select("hub").distinct()
    inside = spread_join(known.withColumn("hub", F.col("root")), hot, ["hub"], F.col("v.va")).select("hub", "v", "root")
    right = inside.unionByName(outside)
    blocks = right.groupBy("hub").agg(F.count(F.lit(1)).alias("nr")).join(
        outside.groupBy("hub").agg(F.count(F.lit(1)).alias("nl")), "hub"
    ).select("hub", F.ceil(F.col("nr") / block).alias("rb"), F.ceil(F.col("nl") / block).alias("lb"))
    place = F.xxhash64("v")

    def dealt(side: int, df: DataFrame, own: str, other: str) -> DataFrame:
        put = spread_join(df, blocks, ["hub"], F.col("v.va")).select(
            "hub", "v", "root", F.lit(side).alias("side"), F.pmod(place, F.col(own)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other),
        )
        return put.select("hub", "v", "root", "side", "lb", "rb")

    work = dealt(0, outside, "lb", "rb").unionByName(dealt(1, right, "rb", "lb"))
    work = heat_join(materialize(work), sets, ["v"], F.xxhash64("hub", "lb", "rb")).select(
        "hub", "lb", "rb", "side", "v.va", "v.vb", F.col("root.va").alias("ra_"), F.col("root.vb").alias("rb_"), "set"
    )
    more = work.groupBy("hub", "lb", "rb").applyInPandas(_spanning(percent), "ua bigint, ub bigint, va bigint, vb bigint")
    more = more.select(F.struct(F.col("ua").alias("va"), F.col("ub").alias("vb")).alias("u"), F.struct("va", "vb").alias("v"))
    more = materialize(more)
    if more.limit(1).count() == 0:
        return roots
    tree = roots.filter("v != root").select(F.col("root").alias("u"), "v")
    return components(tree.unionByName(more))


def groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept`` and the ``row_key``."""
    base = materialize(signatures(docs, shingle))
    roots = links(docs, base, shingle, percent)
    classes = base.filter("n_shingles > 0").groupBy(F.struct("va", "vb").alias("v")).agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")
    ).join(roots, "v", "left")
    of_group = classes.filter("root is not null").groupBy("root").agg(F.min("least").alias("of_group"))
    shared = classes.filter("rows > 1 or root is not null").join(of_group, "root", "left")
    shared = shared.select("v.va", "v.vb", F.coalesce("of_group", "least").alias("component_id"), F.lit(True).alias("_in"))
    out = heat_join(base.drop("bands"), shared, ["va", "vb"], F.col("row_key.a"), "left")
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), "row_key",
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the least ``doc_id`` of their group; of repeated rows one stays."""
    found = materialize(groups(docs, shingle, percent))
    drop = found.filter("not kept").select("row_key", F.lit(0).alias("_keep"))
    repeated = found.filter("kept").groupBy("row_key").count().filter("count > 1").select("row_key", F.lit(1).alias("_keep"))
    marked = docs.select(F.struct("*").alias("_doc"), row_key().alias("row_key"))
    marked = spread_join(marked, drop.distinct().unionByName(repeated), ["row_key"], F.lit(0), "left", salts=1)
    once = marked.filter("_keep = 1").dropDuplicates(["row_key"])
    return marked.filter("_keep is null").unionByName(once).select("_doc.*")
