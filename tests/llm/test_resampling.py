import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from brute import lower
from cortexframe.llm import target_resampling as tr

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, buckets=10_000):
    ws = WORDS.findall(lower(text))
    runs = [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]
    return len(ws), [zlib.crc32(x.encode()) % buckets for x in runs]


def brute_draw(rows, target, percent, min_words, seed):
    """Sorted (doc_id as text, n_features, weight, score, rank)."""
    own = [buckets_of(t) for _, t in rows]
    s, t = Counter(b for _, bs in own for b in bs), Counter(b for x in target for b in buckets_of(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for (i, _), (n, bs) in zip(rows, own):
        weight = sum(map(gain, bs)) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(bs), weight, score])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = able[: percent * len(able) // 100]
    ranks = [(i, f, w, s, k + 1) for k, (i, _, f, w, s) in enumerate(drawn)]
    rest = [(i, f, w, s, None) for i, _, f, w, s in [r for r in out if r[1] < min_words] + able[len(drawn):]]
    return sorted(ranks + rest, key=repr)


def test_draw_equals_brute_force(spark, docs, corpus):
    target = [corpus[0][1], None, "", "word", corpus[40][1]]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, min_words in ((25, 20), (100, 1), (0, 20), (60, 5)):
        got = tr.draw(docs, table, percent=percent, min_words=min_words, seed=3).drop("n_words").collect()
        assert sorted(map(tuple, got), key=repr) == brute_draw(corpus, target, percent, min_words, 3)


def test_empty_tables(spark, docs, no_docs):
    nothing = spark.createDataFrame([], "text string")
    assert tr.draw(no_docs, nothing).collect() == []
    assert tr.draw(docs, nothing).count() == docs.count()


def test_crc_composes_at_any_length():
    rnd = random.Random(1)
    pairs = [(rnd.randbytes(rnd.randint(0, 9)), rnd.randbytes(n)) for n in (*range(70), 127, 128, 1000, 70001)]
    first = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    sizes = np.array([len(b) for _, b in pairs])
    both = tr.advance(first, sizes) ^ np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    assert both.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_long_words_and_long_texts(monkeypatch):
    monkeypatch.setattr(tr, "WORDS_PER_SCAN", 7)  # many stretches
    rnd = random.Random(2)
    texts = ["Ab " * 40, "x" * 100_000 + " y " + "é" * 300, "", None, "...", "a", " ".join(rnd.choice(["ab", "b", "a", "ba"]) for _ in range(500))]
    one, two, counts = tr.feature_buckets(pa.array(texts), 10_000)
    for k, text in enumerate(texts):
        n, want = buckets_of(text)
        lo, hi = counts[k], counts[k + 1]
        assert [*one[lo:hi], *two[lo:max(lo, hi - 1)]] == want and hi - lo == n


def test_a_hot_row_is_ranked_in_chunks(spark):
    rows = [(5, "one two three")] * 3000 + [(i, f"other {i} text") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = tr.draw(table, table.select("text"), percent=50, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1526)) and len(got) == 3050
