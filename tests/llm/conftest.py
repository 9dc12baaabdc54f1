import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import ODD  # noqa: E402


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above, with extra columns whose names clash with ones that operators make."""
    rows = [(*r, True, 1.5, "k", 7, "shadow") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean, size double, sha string, h long, TEXT string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
