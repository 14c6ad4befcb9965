import brute
import pytest

from cortexframe.llm import line_windows, llr_rules


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0, row["n_words"], round(row["score"], 9))


def test_rules_match_brute_force(spark, docs, corpus):
    trusted = set(range(10, 40)) | {105}
    marks = spark.createDataFrame([(i,) for i in [*trusted, 11, None, 999]], "doc_id bigint")
    got = sorted((r.asDict() for r in llr_rules.judge(docs, marks, threshold=-0.02, buckets=512).collect()), key=key)
    want = sorted(brute.quality(corpus, trusted, 512, llr_rules.SMOOTHING, -0.02), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g.pop("score") == pytest.approx(w.pop("score"), abs=1e-9)
        assert g == w
    assert 0 < sum(r["kept"] for r in want) < len(want)


def test_keep_returns_the_kept_rows_with_all_columns(spark, docs, corpus):
    marks = spark.createDataFrame([(i,) for i in range(10, 40)], "doc_id bigint")
    kept = llr_rules.keep(docs, marks, threshold=-0.02, buckets=512)
    assert kept.columns == docs.columns
    want = brute.quality(corpus, set(range(10, 40)), 512, llr_rules.SMOOTHING, -0.02)
    assert sorted(r["text"] for r in kept.select("text").collect()) == sorted(t for (_, t), w in zip(corpus, want) if w["kept"])


def test_rules_without_rows_or_trust(spark, docs, no_docs):
    nobody = spark.createDataFrame([], "doc_id bigint")
    assert llr_rules.judge(no_docs, nobody).count() == 0
    rows = llr_rules.judge(docs, nobody).collect()
    assert all(r["score"] == 0 and r["kept"] == (not r["base_failed"]) for r in rows)


def test_line_windows_match_brute_force(docs, corpus):
    unique = list(dict.fromkeys(corpus))
    left = dict(zip(unique, brute.line_windows(unique)))
    got = line_windows.remove_repeated(docs).select("_doc.doc_id", "_doc.text", "_left", "_n_removed").collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r["_left"] == left[r["doc_id"], r["text"]], r["doc_id"]
    assert sum(r["_n_removed"] for r in got) > 20


def test_line_dedup_keeps_columns(docs, no_docs):
    out = line_windows.dedup(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert out.filter("text is not null and n_chars != length(text)").count() == 0
    assert line_windows.dedup(no_docs).count() == 0
