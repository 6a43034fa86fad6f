import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from poolwise.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[*]", app="poolwise-tests", spark__sql__shuffle__partitions=8,
                            spark__driver__memory="6g", spark__ui__enabled="false",
                            spark__checkpoint__dir=tempfile.mkdtemp(prefix="poolwise-tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def pools(spark):
    """Builds (tasks, candidates) from rows of (task, idx, parseable, correct, solvable, score, score_b)."""
    def make(rows, tasks=None):
        candidates = spark.createDataFrame(
            [(t, i, p, c, s, a, b, None) for t, i, p, c, s, a, b in rows],
            "task_id long, cand_idx int, parseable boolean, correct boolean, solvable boolean, score double, "
            "score_b double, error string")
        ids = tasks if tasks is not None else sorted({r[0] for r in rows})
        return spark.createDataFrame([(t,) for t in ids], "task_id long"), candidates
    return make
