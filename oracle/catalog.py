"""All expected results, by query name."""

from oracle import shared  # noqa: F401  (registers the shared views)
from oracle import calibration, compare, facts, logs, metrics, mining, scalars, selection, streaming


def expected() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in (logs, scalars, selection, compare, facts, metrics, calibration, mining, streaming):
        out.update(module.SQL)
    return out
