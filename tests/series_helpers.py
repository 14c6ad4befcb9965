"""Series and label tables of the core tests."""

import numpy as np


def collect_series(df, recording, channel):
    rows = df.filter((df.recording_id == recording) & (df.channel == channel)).orderBy("sample_idx").collect()
    return np.array([r["value"] for r in rows])


def collect_labels(spark, seqs):
    rows = [(r, i, int(v)) for r, x in seqs.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "recording_id string, sample_idx bigint, label bigint")
