"""Registered queries against their SQL, and the entry module without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from betascape.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted((repr([plain(x) for x in r]) for r in frame.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SMALL).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_site_by_species_has_all_species(spark, duck):
    want = duck.sql("SELECT count(DISTINCT (l_suppkey, l_partkey)), sum(l_quantity) FROM lineitem").fetchall()[0]
    presence = registry.QUERIES["site_by_all_species"](spark, SMALL).toPandas()
    assert len(presence) == want[0] and presence.species.max() > 20
    total = registry.QUERIES["site_by_all_species_abundance"](spark, SMALL).toPandas()
    assert len(total) == want[0] and abs(total.n.sum() - float(want[1])) < 1e-6


def test_entry(spark):
    assert registry.entry(spark, SMALL).count() == 1


def test_the_rest_imports_without_the_subpackage():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("betascape.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert len(e.queries()) > 60 and not any(n.startswith("op") for n in e.queries()) and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
