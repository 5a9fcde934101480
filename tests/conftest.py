import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers


@pytest.fixture(scope="session")
def spark():
    from loomline.session import local_session

    session = local_session("tests", 4, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    found = Path("/root/testdata/sf0.001")
    if not found.is_dir():
        pytest.skip("no test tables here")
    return str(found)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows(frame) -> list[str]:
    """A pandas frame's rows as sorted text; numbers that are whole and nulls compare across types."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x.item() if hasattr(x, "item") else x

    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())
