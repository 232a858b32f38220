"""Every registered query of the main library against its SQL at the smallest size."""

import sys

import duckdb
import pytest

from lodestone import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, db, name, tmp_path):
    out = registry.QUERIES[name](spark, sf)
    out.write.parquet(f"{tmp_path}/out")
    have = f"'{tmp_path}/out/*.parquet'"
    if name not in registry.ORACLE:
        assert db.sql(f"SELECT count(*) FROM {have}").fetchall()[0][0] > 0
        return
    columns = ", ".join(f'"{c}"' for c in sorted(out.columns))
    db.execute(f"CREATE OR REPLACE TABLE expected AS {registry.ORACLE[name]}")
    for a, b in (("expected", have), (have, "expected")):
        assert db.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_entry_imports_without_the_optional_part(monkeypatch, tmp_path):
    """With the optional subpackage and the pipeline gone, the rest still imports and answers."""
    import shutil
    import subprocess
    from pathlib import Path

    repo = Path(registry.__file__).resolve().parent.parent
    for part in ("__spark_entry__.py", "lodestone"):
        source = repo / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
