import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    import fixtures

    return fixtures.table(spark).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    import fixtures

    return fixtures.table(spark, [])
