"""Every query against its SQL on the smallest tables, and the entry module without the training-data subpackage."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from weftcorpus.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
here = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else float(v) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@here
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got or name in ("near_dup_pairs", "cross_corpus_near")
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['weftcorpus.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 80 and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, timeout=60).returncode == 0


def test_nothing_outside_imports_the_subpackage():
    for p in (ROOT / "weftcorpus").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "weftcorpus.llm" not in p.read_text(), p
