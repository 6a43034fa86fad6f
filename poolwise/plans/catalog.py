"""All named queries."""

from poolwise.plans import (  # noqa: F401
    calibration, compare, facts, logs, metrics, mining, scalars, selection, streaming)
from poolwise.plans.registry import QUERIES


def queries():
    return dict(QUERIES)
