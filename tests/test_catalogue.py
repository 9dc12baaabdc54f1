"""Every query of the catalogue against DuckDB on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

from datewright.plans import catalogue, files  # noqa: F401  (files adds its queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
        frame[c] = frame[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_oracle(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want))


def test_entry_imports_without_the_subpackage(spark, tmp_path):
    """The contract holds where the training-data folders have been deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(catalogue.__file__).resolve().parents[2]
    shutil.copytree(root / "datewright", tmp_path / "datewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(q) == set(e.oracle_sql()); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
