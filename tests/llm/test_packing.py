import random
import zlib

import numpy as np
import pytest

from cortexframe.llm import packing
from cortexframe.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_encoder_agrees_with_tokenizers(corpus, reference_ids):
    rnd = random.Random(1)
    signs = "ab Z'sdre \n\t\r\x0b\u00a0\u3000éß中🙂١²½_-!<|>0123456789\u200d\u0301\x00"
    texts = [t for _, t in corpus] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    encode = packing.encoder(tokenizer_path())
    for t in texts:
        assert [*encode(t or ""), packing.END_ID] == reference_ids(t), repr(t)


def check_packed(rows, corpus, capacity, reference_ids):
    places = {}
    by_doc = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    want = {}
    for doc_id, text in corpus:
        ids = reference_ids(text)
        own = want.setdefault(doc_id, [])
        for k, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            own.append((k, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes())))
            assert n == capacity or k == 0
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(places)


@pytest.mark.parametrize("capacity,per_task", [(1024, 400_000), (64, 50)])
def test_packing(docs, corpus, reference_ids, capacity, per_task):
    rows = packing.pack(docs, tokenizer_path(), capacity=capacity, pieces_per_task=per_task).collect()
    n = check_packed(rows, corpus, capacity, reference_ids)
    least = -(-sum(r["length"] for r in rows) // capacity)
    assert n <= 1.02 * least + 1 if capacity == 1024 else n <= 1.25 * least + 2


def test_packed_ids_give_the_texts_back(docs, corpus, reference_ids):
    rows = packing.pack(docs, tokenizer_path(), capacity=128, with_ids=True).orderBy("doc_id", "piece").collect()
    for doc_id in (213, 10 + 7, 214):
        ids = [i for r in rows if r["doc_id"] == doc_id for i in r["ids"]]
        assert ids == reference_ids(dict(corpus)[doc_id])


def test_no_documents(no_docs):
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # bin 1, the fullest, has closed
    assert bins.put(3) == (0, 6) and bins.put(2) == (2, 8) and bins.put(3) == (3, 0)


def test_random_sizes_pack_tightly():
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 1024) for _ in range(30_000)]
    bins = packing.BestFit(1024, packing.OPEN_BINS)
    fill = {}
    for n in sizes:
        b, at = bins.put(n)
        assert fill.get(b, 0) == at
        fill[b] = at + n
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.03 * sum(sizes) / 1024


def test_long_white_space_and_any_id_type(spark):
    from decimal import Decimal

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    encode = packing.encoder(path)
    for text in (" " * 2_000_000 + "x", "a" + "\n" * 1_000_000 + "b c", "a" + " \t" * 99_999, " " * 99_999 + "y", "ab " * 70_000):
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids
    rows = [(Decimal("1.5"), " " * 1_200_000 + "x y", None), (None, "word", None), (Decimal("2"), None, 3)]
    docs = spark.createDataFrame(rows, "doc_id decimal(6,2), text string, piece int")
    got = packing.pack(docs, path).collect()
    assert {r["doc_id"] for r in got} == {Decimal("1.50"), Decimal("2.00"), None}
    ids = len(plain.encode(rows[0][1], add_special_tokens=False).ids) + 1
    assert sum(r["length"] for r in got if r["doc_id"] == Decimal("1.50")) == ids
