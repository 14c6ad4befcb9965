"""Texts that are cut into parts: equal results, bounded memory."""

import base64
import random
import tracemalloc

import pyarrow as pa
import pytest

from brute import byte_strings
from cortexframe.llm import kernels as K
from cortexframe.llm import prefix_doubling as pd_
from cortexframe.llm.common import text_parts


def test_parts_cover_every_window_once():
    texts = ["", None, "a" * 10, "b" * 95, "é" * 200, "c", "d" * 64, "e" * 1000]
    raw = [(t or "").encode() for t in texts]
    seen = [set() for _ in texts]
    for data, offsets, owner, base in text_parts(pa.array(texts, pa.string()), 64, 9):
        assert len(data) <= 2 * (64 + 9)
        for k, (o, b) in enumerate(zip(owner.tolist(), base.tolist())):
            part = data[offsets[k]:offsets[k + 1]].tobytes()
            assert raw[o][b:b + len(part)] == part
            own = {b + i for i in range(len(part) - 9)}
            assert not own & seen[o]
            seen[o] |= own
    assert [len(s) for s in seen] == [max(0, len(r) - 9) for r in raw]


@pytest.mark.parametrize("part", [500, 700, 1 << 18])
def test_repeats_across_parts(spark, monkeypatch, part):
    rnd = random.Random(part)
    passages = ["".join(rnd.choice("abcdef é") for _ in range(n)) for n in (390, 450, 1500, 401)]
    noise = lambda n: "".join(rnd.choice("ghijkl") for _ in range(n))
    rows = [(i, noise(rnd.randint(0, 900)) + rnd.choice(passages) + noise(rnd.randint(0, 900)) + rnd.choice(passages)) for i in range(14)]
    rows += [(50, "xy" * 1500), (51, "z" * 2500), (52, "".join(passages) * 2), (53, None), (54, "")]
    monkeypatch.setattr(pd_, "PART", part)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in pd_.digest(docs).collect()}
    assert got == {i: tuple(w) for (i, _), w in zip(rows, byte_strings([t for _, t in rows], 400))}


def _edged(seed, passages):
    """Texts of noise around a passage of 430 bytes, the same one in every ``passages``-th text, and copies of two of them."""
    rnd = random.Random(seed)
    noise = lambda n: "".join(rnd.choice("ghijkl") for _ in range(n))
    shared = ["".join(rnd.choice("abcdef ") for _ in range(430)) for _ in range(passages)]
    rows = [(i, noise(rnd.randint(200, 400)) + shared[i % passages] + noise(rnd.randint(200, 400))) for i in range(40)]
    return rows + [(100, rows[0][1]), (101, rows[1][1]), (102, "é" + rows[1][1])]


def test_open_windows_are_not_stored_one_by_one(spark, monkeypatch):
    rows = _edged(1, 4)
    stored, whole = [], pd_.materialize

    def counted(df):
        stored.append((out := whole(df)).count())
        return out

    monkeypatch.setattr(pd_, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in pd_.digest(docs).collect()}
    assert got == {i: tuple(w) for (i, _), w in zip(rows, byte_strings([t for _, t in rows], 400))}
    assert max(stored) < 40 * 31 / 4  # 40 texts hold 31 windows of a passage


@pytest.mark.parametrize("hot,windows", [(2, 500_000), (9, 40), (4_000, 40)])
def test_frequent_blocks_are_dealt_out_by_window(spark, monkeypatch, hot, windows):
    monkeypatch.setattr(pd_, "HOT", hot)
    monkeypatch.setattr(pd_, "TASK_WINDOWS", windows)
    rows = _edged(2, 3) + _edged(3, 30) + [(103, "xy" * 1500), (104, "z" * 900), (105, None), (106, ""), (None, "z" * 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in pd_.digest(docs).collect()]
    want = [(i, *w) for (i, _), w in zip(rows, byte_strings([t for _, t in rows], 400))]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_the_length_of_a_text_does_not_set_the_memory():
    rnd = random.Random(1)
    text = pa.array(["".join(rnd.choice("abcdefgh \n") for _ in range(100_000)) * 160])
    K.RangeHash(K.byte_values(K.text_bytes(text)[0][:10]), K.BASES[0])
    tracemalloc.start()
    for data, offsets, _, _ in text_parts(text, pd_.PART, pd_.LENGTH - 1):
        pd_._cut(data, offsets, pd_.LENGTH, pd_.GRAM, pd_.ONE_IN)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # 16 MB of text


def test_one_text_of_fifty_megabytes(spark):
    unique = base64.b64encode(random.Random(3).randbytes(37_500_000)).decode()
    docs = spark.createDataFrame([(1, unique + unique[:1000]), (2, unique[7000:7500])], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in pd_.digest(docs).collect()}
    assert got == {1: (2500, 3), 2: (500, 1)}
