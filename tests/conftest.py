from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]


@pytest.fixture(scope="session")
def spark():
    from lossloom.session import build_session

    s = build_session("tests", cores=4, memory="6g")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
