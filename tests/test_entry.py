"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
import shutil

from tests.conftest import ROOT


def test_every_operator_has_a_query():
    from pulseloom import catalog

    assert len(catalog.QUERIES) == 77
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "pulseloom", tmp_path / "pulseloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) == 77 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"})


def test_flagship(spark):
    from pulseloom import catalog

    rows = catalog.flagship(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["n"] >= 10 and 0 < r["n_records"] <= r["n"] for r in rows)
