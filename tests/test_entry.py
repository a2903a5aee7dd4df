"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import parley.plans as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "[" + ",".join(map(text, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.mark.parametrize("name", sorted(plans.all_queries()))
def test_query(spark, duck, name):
    df = plans.all_queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(text, r)) for r in df.select(*cols).collect())
    if name in plans.all_sql():
        rel = duck.execute(plans.all_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    else:
        assert got


@pytest.mark.parametrize("gone", [("parley/llm", "tests/llm"), ("parley/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_training_data_subpackage(tmp_path, gone):
    """The rest goes on where the subpackage, or the pipeline, was deleted."""
    root = Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", *(Path(g).name for g in gone if "/" in g), *(g for g in gone if "/" not in g)))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'der' in q and set(s) <= set(q); print(*q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "pipeline" not in names and any(n.startswith("op") for n in names) == ("parley/llm" not in gone and (root / "parley/llm").is_dir())
