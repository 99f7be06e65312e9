"""Every query with SQL, against DuckDB at the smallest size; the others must run."""

from collections import Counter

import duckdb
import pytest

from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else repr(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(str(plain(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    sql = registry.oracle_sql().get(name)
    if sql:
        want = duck.execute("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()
        assert rows == Counter(str(plain(r)) for r in want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_works_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['tallyforge.llm'] = None; import __spark_entry__ as e; assert 'entity_scores_v1' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
