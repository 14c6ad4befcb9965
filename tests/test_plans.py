import numpy as np
import pytest
from pyspark.sql import functions as F

from series_helpers import collect_series
from cortexframe.plans import blocks, chunks, intervals, joins, quantiles, scan
from cortexframe.plans.materialize import materialize


def hot_table(spark, n=3000, seed=1):
    """A third of the rows on one key."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.34, "hot", np.char.add("k", rng.integers(0, 20, n).astype(str)))
    t = rng.permutation(n)
    return spark.createDataFrame([(str(k), int(a), int(a) % 7, float(a % 13)) for k, a in zip(keys, t)], "k string, t bigint, d bigint, v double")


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_sequence_index(spark, parts):
    df = hot_table(spark)
    got = chunks.sequence_index(df, ["k"], ["d", "t"], "pos", parts).toPandas()
    want = got.sort_values(["k", "d", "t"]).groupby("k").cumcount()
    assert (got.loc[want.index, "pos"] == want).all() and len(got) == 3000


@pytest.mark.parametrize("small", [True, False])
def test_sequence_index_counts_null_keys_on_without_a_window_over_the_rows(spark, monkeypatch, small):
    def running(*a, **kw):
        raise AssertionError("rows of several chunks are numbered while they are written")

    monkeypatch.setattr(chunks, "running", running)
    if not small:
        monkeypatch.setattr(chunks, "MAX_BROADCAST_BYTES", -1)
    df = spark.createDataFrame([(None if i % 3 else "k", (i * 37) % 500) for i in range(500)], "k string, t bigint").withColumn("_row", -F.col("t"))
    got = chunks.sequence_index(df, ["k"], ["t"], "pos", 7).collect()
    assert all(r["_row"] == -r["t"] for r in got)
    for k in (None, "k"):
        at = sorted((r["t"], r["pos"]) for r in got if r["k"] == k)
        assert [p for _, p in at] == list(range(len(at))) and len(at) in (167, 333)


@pytest.mark.parametrize("size", [1, 5, 64, 10_000])
def test_running_and_neighbour(spark, size):
    df = hot_table(spark)
    idx = chunks.sequence_index(df, ["k"], ["t"], "sample_idx", 3)
    c = chunks.signal_chunks(idx, size)
    r = chunks.running(c, ["k"], ["sample_idx"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1))}).toPandas()
    g = r.sort_values(["k", "sample_idx"])
    assert np.allclose(g["s"], g.groupby("k")["v"].cumsum())
    assert np.allclose(g["m"], g.groupby("k")["v"].cummax())
    assert (g["n"] == g.groupby("k").cumcount() + 1).all()
    before = chunks.running(c, ["k"], ["sample_idx"], {"n": ("count", F.lit(1))}, inclusive=False).toPandas()
    assert (before["n"] == before["sample_idx"]).all()
    for step in (-1, 1):
        nb = chunks.neighbour(c, ["k"], ["sample_idx"], ["v"], step, "x").select("k", "sample_idx", "v", F.col("x.v").alias("x")).toPandas()
        nb = nb.sort_values(["k", "sample_idx"])
        want = nb.groupby("k")["v"].shift(-step)
        assert np.allclose(nb["x"].fillna(-1), want.fillna(-1))


@pytest.mark.parametrize("size", [1, 2, 3, 17, 10_000])
def test_runs(spark, size):
    rng = np.random.default_rng(3)
    seqs = {"a": np.repeat(rng.integers(0, 3, 60), rng.integers(1, 9, 60)), "b": [1], "c": [2] * 40}
    rows = [(k, i, int(v)) for k, x in seqs.items() for i, v in enumerate(x)]
    df = chunks.signal_chunks(spark.createDataFrame(rows, "k string, sample_idx bigint, label bigint"), size)
    got = {}
    for r in chunks.runs(df, ["k"], "sample_idx", "label").collect():
        got.setdefault(r["k"], []).append((r["run_start"], r["run_end"], r["run_len"], r["label"], r["is_last"]))
    for k, x in seqs.items():
        want, start = [], 0
        for i in range(1, len(x) + 1):
            if i == len(x) or x[i] != x[start]:
                want.append((start, i - 1, i - start, int(x[start]), i == len(x)))
                start = i
        assert sorted(got[k]) == want


@pytest.mark.parametrize("small", [quantiles.SMALL_BUCKET, 0])
def test_exact_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_BUCKET", small)  # 0: down to the last bits
    df = hot_table(spark)
    found = quantiles.exact_quantiles(df, ["k"], "v", {"lo": 0.01, "mid": 0.5, "hi": 0.99})
    got = found.toPandas().set_index("k")
    for k, g in df.toPandas().groupby("k"):
        assert np.allclose(got.loc[k], np.quantile(g["v"], [0.01, 0.5, 0.99]), rtol=1e-15, atol=0)


def test_quantiles_of_odd_values(spark):
    rnd = np.random.default_rng(1)
    groups = {
        "ties": [2.0] * 500 + [1.0], "signs": rnd.standard_normal(401).tolist(), "one": [-0.0], "wide": (10.0 ** rnd.uniform(-300, 300, 333)).tolist(),
        "tiny": [5e-324, -5e-324, 1e-310, 0.0, -0.0], "ends": [float("inf"), 1.0, -float("inf"), 2.0], "near": (1 + np.arange(50) * 2.0**-52).tolist(),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.0, "m": 0.5, "z": 1.0}).toPandas().set_index("k")
    assert "none" not in got.index
    for k, vs in groups.items():
        middle = sorted(vs)[(len(vs) - 1) // 2:len(vs) // 2 + 1]
        assert got.loc[k].tolist() == [min(vs), middle[0] + (middle[-1] - middle[0]) * 0.5, max(vs)]
    whole = quantiles.exact_quantiles(df.filter("k = 'signs'"), [], "v", {"m": 0.5}).first()[0]
    assert whole == np.median(groups["signs"])
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).collect() == []


def test_ordered_bits_sort_like_doubles(spark):
    rnd = np.random.default_rng(2)
    bits = rnd.integers(0, 1 << 63, 4000, dtype=np.uint64) | (rnd.integers(0, 2, 4000).astype(np.uint64) << np.uint64(63))
    edges = np.array([0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 2.0, 1 - 2**-53, 1.7976931348623157e308, np.inf])
    powers = 2.0 ** np.arange(-1074, 1024)
    values = np.concatenate((bits.view(np.float64), edges, -edges, powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), -powers))
    values = values[~np.isnan(values)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    both = quantiles.ordered_bits(F.col("v"))
    rows = df.select("v", both.alias("code"), quantiles.from_ordered_bits(both).alias("again")).collect()
    want = np.abs(np.array([r["v"] for r in rows])).view(np.int64) * np.where(np.array([r["v"] for r in rows]) < 0, -1, 1)
    assert [r["code"] for r in rows] == want.tolist()
    assert all(r["again"] == r["v"] for r in rows)


def test_quantiles_neither_sort_nor_move_rows(spark):
    """The values are counted in the tasks that read them; only histograms are exchanged."""
    df = spark.range(200_000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"))
    stored = materialize(df.select("k", quantiles.ordered_bits(F.col("v")).alias("_code")))
    first = stored.groupBy("k", F.shiftright("_code", 48).alias("_at")).count()
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "rangepartitioning" not in plan and "Sort" not in plan
    out = quantiles.exact_quantiles(df, ["k"], "v", {"m": 0.5})
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()


def test_affine_scan(spark):
    rnd = np.random.default_rng(3)
    matrix = np.array([[0.9, 0.2], [-0.1, 0.95]])
    sizes = {"a": 1, "b": 2, "c": 37}
    vectors = {k: rnd.standard_normal((n, 2)) for k, n in sizes.items()}
    rows = [(k, i + 5, v.tolist()) for k, vs in vectors.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, i bigint, v array<double>")
    for backward in (False, True):
        got = {(r["k"], r["i"]): r["s"] for r in scan.affine_scan(df, ["k"], "i", "v", matrix, "s", backward).collect()}
        assert len(got) == len(rows)
        for k, vs in vectors.items():
            state = np.zeros(2)
            for i in range(len(vs))[::-1] if backward else range(len(vs)):
                assert np.allclose(got[k, i + 5], state, atol=1e-12)
                state = matrix @ state + vs[i]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_spread_join_keeps_every_row(spark, max_bytes):
    df = hot_table(spark)
    small = df.groupBy("k").agg(F.sum("v").alias("s"))
    got = joins.spread_join(df, small, ["k"], "t", max_bytes=max_bytes)
    assert got.count() == 3000
    assert got.filter("k = 'hot'").select("s").distinct().count() == 1


def merge_plain(pairs):
    out = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("parts", [None, 9])
def test_merge_intervals(spark, parts):
    rng = np.random.default_rng(5)
    data = {k: [(float(s), float(s + w)) for s, w in zip(rng.integers(0, 4000, n), rng.integers(0, 12, n))] for k, n in {"hot": 900, "b": 30}.items()}
    data["nested"] = [(0.0, 100.0), (1.0, 2.0), (100.0, 101.0), (101.5, 103.0), (0.0, 100.0)]
    df = spark.createDataFrame([(k, s, e) for k, x in data.items() for s, e in x], "k string, start double, end double")
    got = {}
    for r in intervals.merge_intervals(df, ["k"], parts=parts).collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    for k, x in data.items():
        assert sorted(got[k]) == merge_plain(x)


@pytest.mark.parametrize("size", [4, 64, 10_000])
def test_covered(spark, series, size):
    s = series({("a", "x"): np.arange(200), ("b", "x"): np.arange(50)})
    iv = spark.createDataFrame([("a", 3, 9), ("a", 8, 20), ("a", 60, 150), ("b", 49, 90), ("a", 5, 5)], "recording_id string, s bigint, e bigint")
    inside = intervals.covered(s, iv, ["recording_id"], "left_semi", size=size)
    got = {(r["recording_id"], r["sample_idx"]) for r in inside.collect()}
    want = {("a", i) for i in [*range(3, 20), *range(60, 150)]} | {("b", 49)}
    assert got == want
    assert intervals.covered(s, iv, ["recording_id"], "left_anti", size=size).count() == 250 - len(want)
    flags = intervals.covered(s, iv, ["recording_id"], "flag", size=size)
    assert flags.count() == 250 and flags.filter("inside").count() == len(want)


@pytest.mark.parametrize("size,before,after", [(7, 3, 5), (7, 20, 9), (100, 10, 0), (1, 2, 2)])
def test_halo(series, size, before, after):
    x = np.arange(53.0)
    b = blocks.with_halo(blocks.to_blocks(series({("a", "x"): x}), size), before, after, size).collect()
    assert len(b) == -(-53 // size)
    for r in b:
        s, own = r["start_sample"], min(size, 53 - r["start_sample"])
        lo, hi = max(0, s - before), min(53, s + own + after)
        assert r["samples"] == list(x[lo:hi])
        assert (r["n_left"], r["n_right"]) == (s - lo, hi - s - own)


def test_blocks_round_trip(series):
    x = np.random.default_rng(0).standard_normal(101)
    s = series({("a", "x"): x})
    assert np.array_equal(collect_series(blocks.to_samples(blocks.to_blocks(s, 13)), "a", "x"), x)
