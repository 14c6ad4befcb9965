import brute
import numpy as np
import pandas as pd
import pytest

from cortexframe.llm import kernels, near_dups, prefix_doubling, substring_dedup
from cortexframe.llm.components import components
from cortexframe.llm.fm_index import FMIndex


def test_superminhash_estimates_similarity():
    rnd = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for n in (20, 300, 2000):
            union = rnd.integers(0, 1 << 63, n, dtype=np.uint64)
            both = int(share * n)
            a, b = np.unique(union[: (n + both) // 2]), np.unique(np.concatenate((union[:both], union[(n + both) // 2:])))
            s = kernels.superminhash(np.concatenate((a, b)), np.repeat([0, 1], [len(a), len(b)]), 2, 128)
            errors.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
            split = kernels.superminhash(a[::2], np.zeros(len(a[::2]), np.int64), 1, 128)
            other = kernels.superminhash(a[1::2], np.zeros(len(a[1::2]), np.int64), 1, 128)
            assert (np.minimum(split, other) == s[0]).all()
    assert np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (300, 200), (200, 300)]
    edges += [(1000, 2000 + i) for i in range(300)]
    rows = components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    got = {r["v"]: r["root"] for r in rows}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {200: 200, 300: 200} | {i: 1000 for i in (1000, *range(2000, 2300))}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_groups_match_brute_force(docs, corpus, shingle, percent):
    want = sorted(zip([str(i) for i, _ in corpus], [len(brute.shingles(t, shingle)) for _, t in corpus],
                      [str(c) for c in brute.near_groups(corpus, shingle, percent)]))
    rows = near_dups.groups(docs, shingle, percent).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_members_far_from_the_head(spark, monkeypatch):
    """A dense group in which no member is close to all others, dealt out in very small blocks."""
    rnd = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(30):
        own = list(base)
        for at in rnd.choice(120, i % 4 + 1, replace=False):
            own[at] = f"x{rnd.integers(0, 4)}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(near_dups.links, "__defaults__", (3,))
    got = near_dups.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == list(zip(range(30), brute.near_groups(rows, 3, 85)))


def test_block_links_match_brute_force():
    """Left rows that are not in the right block, one of them with the largest value of all."""
    rnd = np.random.default_rng(8)
    base = np.unique(rnd.integers(0, 1 << 64, 100, dtype=np.uint64))
    top = np.uint64((1 << 63) - 1)  # the largest as a signed number
    strange = lambda n: rnd.integers(0, 1 << 64, n, dtype=np.uint64)
    left = [np.append(base[2:], top), np.append(base[5:], strange(3)), strange(90)]
    right = [np.append(base[:-k], strange(3)) for k in (1, 4, 20)] + [strange(50)]
    sets = [np.unique(s) for s in [*left, *right]]
    rows = [(int(i >= 3), i, i, i, i, kernels.signed(s)) for i, s in enumerate(sets)]
    frame = pd.DataFrame(rows, columns=["side", "va", "vb", "ra_", "rb_", "set"])
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    for i in range(3):
        got = near_dups._spanning(85)(frame[(frame["side"] == 1) | (frame["va"] == i)])
        assert sorted(got["va"]) == [j for j in range(3, 7) if near(sets[i], sets[j])]
    assert near(sets[0], sets[3]) and not near(sets[0], sets[5])


def test_near_dedup_keeps_one_row_of_each_group(docs, corpus, no_docs):
    out = near_dups.dedup(docs, 3, 85)
    assert out.columns == docs.columns
    groups = brute.near_groups(corpus, 3, 85)
    want = {(i, t) for (i, t), c in zip(corpus, groups) if i == c or not brute.shingles(t, 3)}
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(repr, want))
    assert near_dups.dedup(no_docs).count() == 0


def test_fm_index_finds_all_occurrences():
    rnd = np.random.default_rng(2)
    parts = [rnd.integers(-5, 5, n).astype(np.int64) for n in (1, 30, 200, 7, 64, 0, 90)]
    index = FMIndex(np.concatenate(parts), np.cumsum([len(p) for p in parts]), 6)
    patterns = rnd.integers(-6, 6, (200, 6)).astype(np.int64)
    patterns[:50] = [parts[2][i:i + 6] for i in range(50)]
    lo, hi, matched = index.search(index.code(patterns.reshape(-1)).reshape(200, 6))
    full = matched == 6
    rank = np.array([4, 2, 6, 0, 1, 5, 3])
    least = dict(zip(np.flatnonzero(full).tolist(), index.least(lo[full], hi[full], rank)))
    for q, (p, a, b, m) in enumerate(zip(patterns, lo, hi, matched)):
        spots = [(k, i) for k, x in enumerate(parts) for i in range(len(x) - 5) if (x[i:i + 6] == p).all()]
        longest = max((n for n in range(7) if n == 0 or any((x[i:i + n] == p[6 - n:]).all() for x in parts for i in range(len(x) - n + 1))))
        assert m == longest
        if m == 6:
            assert b - a == len(spots) and sorted(index.sequence[a:b]) == sorted(k for k, _ in spots)
            assert least[q] == min(rank[k] for k, _ in spots)


@pytest.mark.parametrize("shard,hot", [(40_000, 20_000), (7, 2)])
def test_substrings_match_brute_force(docs, corpus, monkeypatch, shard, hot):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "HOT_GRAM", hot)
    got = substring_dedup.remove(docs).select("_doc.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute.substrings(corpus)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(corpus, want))
    assert sum(w[1] > 0 for w in want) > 10


def test_bytes_match_brute_force(docs, corpus):
    got = prefix_doubling.remove(docs, length=40, gram=8, one_in=4).select("_doc.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute.byte_strings([t for _, t in corpus], 40)
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted((str(i), *w) for (i, _), w in zip(corpus, want))
    assert sum(w[2] > 1 for w in want) > 5


def test_substring_operators_on_no_rows(no_docs):
    assert substring_dedup.digest(no_docs).count() == 0
    assert prefix_doubling.digest(no_docs).count() == 0


def test_anchors_hold_every_window_once():
    from cortexframe.llm import anchors

    rnd = np.random.default_rng(1)
    sizes = np.array([0, 5, 12, 13, 200, 64, 300])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    units = rnd.integers(0, 3, offsets[-1]).astype(np.uint64)
    units[-300:] = 1
    grams = kernels.chain(kernels.mix(units), 4)
    for one_in in (1, 8):
        s = anchors.stretches(grams, offsets, 4, 13, one_in)
        count = np.zeros(offsets[-1], int)
        for a, b in zip(s.first, s.last):
            count[a:b + 1] += 1
        want = np.zeros(offsets[-1], int)
        for a, b in zip(offsets[:-1], offsets[1:]):
            want[a:max(a, b - 12)] = 1
        assert (count == want).all()
        assert ((s.first <= s.anchor) & (s.anchor + 4 <= s.last + 13)).all()
