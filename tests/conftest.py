import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def null_logic(spark):
    rows = [(1, 1, "a"), (2, None, "b"), (3, 0, None), (4, 2, "a%b"), (5, None, None), (6, 3, "A")]
    return spark.createDataFrame(rows, "id int, a int, b string")


@pytest.fixture
def plan(capsys):
    """Text of a DataFrame's formatted plan."""
    def text(df):
        capsys.readouterr()
        df.explain("formatted")
        return capsys.readouterr().out

    return text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
