import hashlib

import brute
import pytest

from cortexframe.llm import decontaminate as D


@pytest.fixture(scope="module")
def items(spark, corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 30]
    rows = [(i, " ".join(texts[i].split()[5:5 + n])) for i, n in enumerate((10, 12, 9, 3, 30, 1))]
    rows += [(6, None), (7, "  .,- "), (8, rows[0][1].upper() + " tail"), (1, "another text of item one that nobody has at all"), (None, rows[4][1])]
    rows += [(9, " ".join(brute.test_words(texts[20])[:10] * 2)), (10, "aaaa " * 14)]
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_matches_brute_force(spark, docs, corpus, items, block_bytes):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.scan(docs, table, block_bytes=block_bytes).select("_doc.doc_id", "_doc.text", "n_words", "n_hit", "items", "items_sha256", "left").collect()
    assert len(rows) == len(corpus)
    hits = 0
    for r in rows:
        n, hit, found = brute.contamination(r["text"], items)
        ids = sorted(str(i) for i in found - {None})
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), ids), r["doc_id"]
        assert r["items_sha256"] == hashlib.sha256(",".join(ids).encode()).hexdigest()
        ws = brute.test_words(r["text"])
        if hit:
            assert brute.test_words(r["left"]) == [w for i, w in enumerate(ws) if i not in hit]
        else:
            assert r["left"] == r["text"]
        hits += bool(hit)
    assert hits > 5


def test_clean_drops_covered_documents(spark, docs, items, corpus):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    out = D.clean(docs, table, max_coverage=0.3)
    assert out.columns == docs.columns
    covered = 0
    for _, t in corpus:
        n, hit, _ = brute.contamination(t, items)
        covered += len(hit) > 0.3 * n
    assert covered and out.count() == len(corpus) - covered


def test_empty_tables(spark, docs, no_docs, items):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.digest(docs, none).filter("n_hit > 0 or n_items > 0 or contaminated").count() == 0
    assert D.digest(no_docs, spark.createDataFrame(items, none.schema)).count() == 0


def test_repeated_short_items_stay_small():
    """n items of one word and an item that repeats it: the automaton holds each short text once."""
    n = 2000
    own = D.ItemAutomaton([*((str(i), "yes") for i in range(n)), ("long", "yes " * n)])
    assert sum(len(ids) for at in own.short.values() for ids in at.values()) == n
    spans, found = own.matches([b"no", b"yes", b"yes"])
    assert spans == [1, 3] and len(found) == n
    spans, found = own.matches([b"yes"] * 12)
    assert spans == [0, 12] and len(found) == n + 1


def test_long_items_are_cut_without_losing_windows(spark):
    words = [f"w{i}" for i in range(500)]
    rows = [("long", " ".join(words)), ("long", " ".join(words)), ("short", "w1 w2 other"), ("huge", "v" * 3000)]
    parts = D.item_parts(spark.createDataFrame(rows, "item_id string, text string"), 10, 200).collect()
    held = [p["text"].split() for p in parts if p["item_id"] == "long"]
    assert len(held) > 10 and all(len(h) >= 10 for h in held)
    assert {tuple(h[i:i + 10]) for h in held for i in range(len(h) - 9)} == {tuple(words[i:i + 10]) for i in range(491)}
    docs = spark.createDataFrame([(i, " ".join(words[i:i + 10])) for i in range(0, 491, 10)] + [(900, "v" * 3000), (901, " ".join(words[:9]))], "doc_id bigint, text string")
    for block_bytes in (1 << 20, 1000):
        got = {r["doc_id"]: r["items"] for r in D.scan(docs, spark.createDataFrame(rows, "item_id string, text string"), block_bytes=block_bytes).select("_doc.doc_id", "items").collect()}
        assert got.pop(900) == ["huge"] and got.pop(901) == [] and set(map(tuple, got.values())) == {("long",)}
