"""Oracle SQL of recursive filters: one recursion step per sample and direction."""

from __future__ import annotations

from ..functions.statespace import butter_sos, state_filter


def _recursion(name: str, source: str, sections: list[tuple[float, ...]]) -> str:
    """CTE ``name(recording_id, channel, i, .., y)`` that runs the sections over the lists ``e`` of ``source``."""
    order = 2 * len(sections)
    steady = state_filter(tuple(map(tuple, sections))).steady
    states = [f"s{j}" for j in range(order)]
    outs = [f"y{k}" for k in range(len(sections))]
    first = ", ".join([f"{float(v)!r}::DOUBLE * e[1] AS {s}" for v, s in zip(steady, states)] + [f"0.0::DOUBLE AS {y}" for y in outs])
    step, into = [], "e[i + 1]"
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        low, high = states[2 * k], states[2 * k + 1]
        step.append((f"{b0!r}::DOUBLE * ({into}) + {low}", f"ny{k}"))
        step.append((f"{b1!r}::DOUBLE * ({into}) - {a1!r}::DOUBLE * ny{k} + {high}", f"n{low}"))
        step.append((f"{b2!r}::DOUBLE * ({into}) - {a2!r}::DOUBLE * ny{k}", f"n{high}"))
        into = f"ny{k}"
    inner = ", ".join(f"{e} AS {n}" for e, n in step)
    outer = ", ".join([f"n{s}" for s in states] + [f"n{y}" for y in outs])
    return f"""{name} AS (
  SELECT recording_id, channel, 0 AS i, {first} FROM {source}
  UNION ALL SELECT recording_id, channel, i + 1, {outer}
  FROM (SELECT f.recording_id, f.channel, i, {inner} FROM {name} f JOIN {source} USING (recording_id, channel) WHERE i < len(e)))"""


def filtfilt_sql(fs: float, order: int, band: tuple[float | None, float | None], name: str = "filtered", source: str = "signals") -> str:
    """CTEs that end in ``name(recording_id, channel, sample_idx, value)``; they need WITH RECURSIVE."""
    sections = butter_sos(order, band, fs)
    pad = 3 * (order * (1 if None in band else 2) + 1)
    last = f"y{len(sections) - 1}"
    return f"""{name}_xs AS (
  SELECT recording_id, channel, list(value ORDER BY sample_idx) AS x, count(*) AS n, least({pad}, count(*) - 1) AS m FROM {source} GROUP BY ALL),
{name}_ext AS (
  SELECT recording_id, channel, n, m, [2 * x[1] - x[k] for k in range(m + 1, 1, -1)] || x
    || [2 * x[n] - x[k] for k in range(n - 1, n - 1 - m, -1)] AS e FROM {name}_xs),
{_recursion(f"{name}_fwd", f"{name}_ext", sections)},
{name}_turned AS (SELECT recording_id, channel, list({last} ORDER BY i DESC) AS e FROM {name}_fwd WHERE i > 0 GROUP BY ALL),
{_recursion(f"{name}_bwd", f"{name}_turned", sections)},
{name} AS (
  SELECT recording_id, channel, n + m - i AS sample_idx, {last} AS value
  FROM {name}_bwd JOIN {name}_ext USING (recording_id, channel) WHERE i > m AND i <= m + n)"""
