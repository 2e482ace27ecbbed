import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpus import DOCS, awkward  # noqa: E402


@pytest.fixture(scope="session")
def awkward_rows():
    return awkward(random.Random(4))


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
