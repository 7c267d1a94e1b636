import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pricewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def cell(spark):
    """Evaluate one expression over columns a, b, c given as literals."""

    def run(build, *values):
        names = ["a", "b", "c"][: len(values)]
        ddl = ", ".join(
            f"{n} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'string'}"
            for n, v in zip(names, values)
        )
        df = spark.createDataFrame([tuple(values)], ddl)
        return df.select(build(*[df[n] for n in names]).alias("x")).first()["x"]

    return run
