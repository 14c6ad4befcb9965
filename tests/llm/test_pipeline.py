import brute
import pytest
from test_packing import check_packed, reference_ids  # noqa: F401

import corpus_pipeline
from cortexframe.llm import llr_rules
from cortexframe.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, SF, "documents")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{folder}/{name}")
        frames.append(spark.read.parquet(f"{folder}/{name}"))
    return frames


def rows_of(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.collect()))


def test_stages_match_brute_force(spark, steps, reference_ids):  # noqa: F811
    docs, kept, lines, near, clean, packed = steps
    for f in steps[1:5]:
        assert f.schema.simpleString() == docs.schema.simpleString()
    trusted = {r["doc_id"] for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    rows = rows_of(docs)
    judged = brute.quality(rows, trusted, llr_rules.BUCKETS, llr_rules.SMOOTHING, llr_rules.THRESHOLD)
    assert rows_of(kept) == [r for r, j in zip(rows, judged) if j["kept"]]
    rows = rows_of(kept)
    assert rows_of(lines) == sorted((i, t) for (i, _), t in zip(rows, brute.line_windows(rows)))
    rows = rows_of(lines)
    assert rows_of(near) == [r for r, c in zip(rows, brute.near_groups(rows, 5, 80)) if r[0] == c or not brute.shingles(r[1], 5)]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    left = {}
    for i, t in rows_of(near):
        n, hit, _ = brute.contamination(t, items)
        if len(hit) <= 0.5 * n:
            left[i] = [w for k, w in enumerate(brute.test_words(t)) if k not in hit]
    assert {i: brute.test_words(t) for i, t in rows_of(clean)} == left
    check_packed(packed.collect(), rows_of(clean), 1024, reference_ids)
    assert docs.count() > kept.count() > 0


def test_run_gives_the_last_stage(spark, steps):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == steps[-1].columns and out.count() == steps[-1].count()
