import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cortexframe.llm import variants as va

RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASCII = str.maketrans(va._UPPER, va._LOWER)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows, min_length=7, min_n=2, ratio=10, noise=31):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(ASCII)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_n}
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_groups_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for alphabet, longest in (("ab", 9), ("abcé", 9), ("abcdefghijÀßÿ", 14)):
        base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(6, longest))) for _ in range(120)]
        for i in range(40):
            own = [w for w in rnd.choices(base, weights=[1 / (k + 1) ** 2 for k in range(len(base))], k=80)]
            for k in range(0, 80, 5):  # edits of all kinds at all places
                w = own[k]
                at = rnd.randint(0, len(w))
                own[k] = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice(alphabet) + w[at:], w[:at] + rnd.choice(alphabet) + w[at + 1:]])
            rows.append((len(rows), rnd.choice([" ", "1", ", "]).join(w.upper() if rnd.random() < 0.1 else w for w in own)))
    rows += [(None, rows[0][1]), (900, None), (901, ""), (902, "É" * 8 + " " + "é" * 8), rows[1], rows[1], (903, "x" * 500 + " " + "x" * 499)]
    rows += [(904 + i, "x" * 500 + " " + "x" * 499 + " aaaaaaaa aaaaaaa") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute(rows)
    assert sum(r[4] for r in want) > 500 and any(r[1] and r[1] != r[2] for r in want)
    assert result(va.group(docs)) == want
    assert result(va.group(docs, min_length=5, min_n=1, ratio=2, noise=None)) == brute(rows, 5, 1, 2, None)


def test_odd_tables(spark, docs, corpus, no_docs):
    assert result(va.group(docs)) == brute(corpus)
    assert va.group(no_docs).collect() == []
    with pytest.raises(ValueError):
        va.group(docs, min_length=3)


def test_chains_of_forms(spark):
    words = [("aaaaaaaaa", 1), ("aaaaaaaab", 10), ("aaaaaaabb", 100), ("aaaaaabbb", 1000), ("aaaaabbbb", 10000), ("zzzzzzz", 5)]
    found = va.forms(spark.createDataFrame(words, "word string, n bigint"))
    roots = {r["word"]: r["root"] for r in va.roots(found).collect()}
    assert roots == {w: "aaaaabbbb" for w, _ in words[:4]}


def test_pivots_are_the_lightest_disjoint_pair():
    rnd = np.random.default_rng(2)
    weight = rnd.integers(1, 20, (300, 9)).astype(float)
    weight[rnd.random(weight.shape) < 0.4] = np.inf
    weight[:, [1, 4]] = rnd.integers(1, 20, (300, 2))  # two disjoint ones at least
    one, two = va.pivots(weight)
    for row, i, j in zip(weight, one.tolist(), two.tolist()):
        assert j - i >= 2
        assert row[i] + row[j] == min(row[a] + row[b] for a in range(9) for b in range(a + 2, 9))


def test_one_key_for_every_near_pair():
    """Every pair of near words meets on a pivot of one and a prefix bigram of the other."""
    rnd = random.Random(8)
    words = list({"".join(rnd.choice("abc") for _ in range(rnd.randint(7, 9))) for _ in range(400)})
    counts = Counter(g for w in words for g in {w[i:i + 2] for i in range(len(w) - 1)})
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([1] * len(words))], names=["word", "n"])
    order = va.GramOrder(counts)
    sides = []
    for pivotal in (True, False):
        keys = {}
        for out in va._index_rows(batch, order, pivotal):
            for key, word, last in zip(out.column("key").to_pylist(), out.column("word").to_pylist(), out.column("last").to_pylist()):
                keys.setdefault(word, (last, set()))[1].add(key)
        sides.append(keys)
    for a, b in itertools.permutations(words, 2):
        if one_edit(a, b) and (sides[0][a][0], a) < (sides[0][b][0], b):
            assert sides[0][a][1] & sides[1][b][1]
