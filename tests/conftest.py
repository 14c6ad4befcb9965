import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from cortexframe.session import local_session

    s = local_session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def series(spark):
    """Build long signals from ``{(recording, channel): array}``."""

    def make(data):
        rows = [(r, c, i, float(v)) for (r, c), x in data.items() for i, v in enumerate(x)]
        return spark.createDataFrame(rows, "recording_id string, channel string, sample_idx bigint, value double")

    return make
