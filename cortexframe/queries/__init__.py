"""All registered queries; importing this package fills ``QUERIES`` and ``ORACLES``."""

from . import (  # noqa: F401
    aggregates_q,
    archive_q,
    artifacts_q,
    channels_q,
    dataset_q,
    events_q,
    microstates_q,
    sequences_q,
    signals_q,
    spectra_q,
    stats_q,
    stimulation_q,
    windows_q,
)
from .registry import ORACLES, QUERIES  # noqa: F401
