import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cortexframe.llm import language_masks as lm
from cortexframe.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    """All n-grams of a text, in the order of their first places."""
    words, now = [], ""
    for c in text or "":
        if unicodedata.category(c)[0] in "LM":
            now += c.lower() if c.isalpha() and len(c.lower()) == 1 else c
        else:
            words, now = words + [now], ""
    return Counter(
        f" {w} "[i:i + n] for w in [*words, now] if w for n in lm.SIZES for i in range(len(w) + 3 - n)
    )


def sample_texts():
    rnd = random.Random(4)
    letters = "abcçdeéÄß ,.\nñ1中文हि"
    return [None, "", "123 ?!", "a", "É", "Straße, İstanbul", "हिन्दी"] + [
        "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 80))) for _ in range(60)
    ]


def test_grams_are_those_of_the_words():
    texts = sample_texts()
    hashes, before, spoken = lm.grams(pa.array(texts, pa.string()))
    names = {}
    for k, text in enumerate(texts):
        want = brute_grams(text)
        own = Counter(hashes[before[k]:before[k + 1]].tolist())
        assert sorted(own.values()) == sorted(want.values())
        assert spoken[k] == any(c.isalpha() for c in text or "")
        alone = lm.grams(pa.array([text], pa.string()))[0]  # the place in the batch does not matter
        assert Counter(alone.tolist()) == own
        if len(want) == 1:
            names.setdefault(next(iter(own)), set()).add(next(iter(want)))
    assert all(len(v) == 1 for v in names.values())


def test_counts_come_from_the_filters():
    """Corrected popcounts equal those of exact sets up to the chance of the filters."""
    rnd = np.random.default_rng(3)
    held = [rnd.integers(1, 1 << 63, 40_000, dtype=np.uint64) for _ in range(70)]  # two masks of languages
    slots = np.zeros((2, 1 << lm.SLOT_BITS), np.uint64)
    for i, own in enumerate(held):
        for k in range(lm.PLACES):
            at = ((own >> np.uint64(k * lm.SLOT_BITS)) & np.uint64((1 << lm.SLOT_BITS) - 1)).astype(np.int64)
            slots[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
    model = lm.Model([str(i) for i in range(70)], slots, 0)
    text = np.concatenate((held[66][:300], held[2][:100], rnd.integers(1, 1 << 63, 1000, dtype=np.uint64)))
    counts = model.counts(text, np.array([0, 0, len(text)]))
    assert (counts[0] == 0).all() and counts[1].argmax() == 66
    assert abs(counts[1, 66] - 300) < 15 and abs(counts[1, 2] - 100) < 15 and counts[1, 5] < 15


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = {r["doc_id"]: r for r in lm.predict(docs, lm.train(docs)).collect()}
    known = docs.select("doc_id", "lang").collect()
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in known)
    away = [got[i]["lang_pred"] == x for i, x in known if got[i]["held_out"]]
    assert len(away) > 200 and np.mean(away) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "uno dos tres", "x" if i % 2 else "y") for i in range(60)]
    wrong = [(i, t, "z" if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, t, x in rows]
    schema = "doc_id bigint, text string, lang string"
    first, second = (spark.createDataFrame(r, schema) for r in (rows, wrong))
    a, b = lm.train(first), lm.train(second)
    assert a.languages == b.languages == ["x", "y"] and (a.slots == b.slots).all()
    got = lm.predict(first, a).collect()
    assert all(r["lang_pred"] == ("x" if r["doc_id"] % 2 else "y") for r in got)


def test_odd_rows(spark, docs, no_docs):
    """Clashing columns, null ids, null, empty and very long texts, no letters, no languages, ties."""
    model = lm.train(docs)
    got = lm.predict(docs, model).collect()
    assert len(got) == docs.count() and {r["lang_pred"] for r in got} == {"l", "und"}
    assert lm.predict(no_docs, model).collect() == [] and lm.train(no_docs) is None
    assert {(r["lang_pred"], r["score"]) for r in lm.predict(docs, None).collect()} == {("und", 0.0)}
    i, j, k = [n for n in range(1, 20) if zlib.crc32(str(n).encode()) % 3 != 1][:3]
    rows = [(i, "abab cdcd", "b"), (j, "abab cdcd", "a"), (40, "zzz", None), (50, "9 !", "a"), (k, "word " * 400_000, "c")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = lm.train(odd.unionAll(odd))
    best = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lm.predict(odd, learned).collect()}
    assert best[50] == ("und", 0.0) and best[k][0] == "c" and best[k][1] == pytest.approx(1.0)
    assert best[i] == best[j] and best[i][0] == "a" and best[40][1] == 0.0


def test_counts_do_not_depend_on_the_batches(monkeypatch):
    texts = pa.array([t for t in sample_texts() if t])
    whole = Counter(lm.grams(texts)[0].tolist())
    monkeypatch.setattr(lm, "HELD", 50)
    counts, seen = lm._Counts(), Counter()
    hashes, before, _ = lm.grams(texts)
    for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
        counts.add(0, hashes[lo:hi])
        if counts.full():
            for b in counts.hand_out():
                seen.update(dict(zip(b.column("gram").to_numpy().view(np.uint64).tolist(), b.column("n").to_pylist())))
    for b in counts.hand_out():
        seen.update(dict(zip(b.column("gram").to_numpy().view(np.uint64).tolist(), b.column("n").to_pylist())))
    assert seen == whole
