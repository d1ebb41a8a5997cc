"""Every registered query against its SQL on the driver's tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tastemap.plans import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(params=["sf0.001", "sf0.01", "sf0.1"])
def directory(request):
    path = DATA / request.param
    if not path.exists():
        pytest.skip(f"no tables in {path}")
    return str(path)


def by_sql(directory, sql):
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(
                f"CREATE VIEW {name} AS FROM '{directory}/{name}.parquet'"
            )
        return connection.sql(sql).to_arrow_table()


def types(table):
    return [(field.name, field.type) for field in table.schema]


def rows(table):
    return sorted(zip(*(column.to_pylist() for column in table.columns)))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_rows_as_sql(spark, directory, name):
    got = contract.queries()[name](spark, directory).toArrow()
    expected = by_sql(directory, contract.oracle_sql()[name])
    assert types(got) == types(expected)
    assert rows(got) == rows(expected)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_contract_without_the_optional_parts():
    """As if the subpackage and the pipeline had been deleted."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("tastemap.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as contract
from tastemap.plans import QUERIES
assert set(contract.queries()) == set(contract.oracle_sql()) == set(QUERIES)
"""
    root = Path(contract.__file__).parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["item_id", "users", "qty", "rank"]
    assert [row["rank"] for row in df.orderBy("rank").collect()] == list(range(1, 21))
