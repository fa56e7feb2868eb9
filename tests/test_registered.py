"""Every registered query against its DuckDB counterpart on the smallest given tables."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from echofold.staging import staging_root
from verification.compare import connect, difference
from verification.oracle import SQL
from verification.queries import REGISTRY


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_counterpart_belongs_to_a_query():
    assert set(SQL) <= set(REGISTRY)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_matches_duckdb(spark, connection, sf_dir, name):
    assert difference(spark, connection, sf_dir, name) == ""


@pytest.mark.parametrize("missing", ["xxhash", "tokenizers", "echofold.llm"])
def test_the_core_registers_without_the_other_operators(missing):
    code = f"import sys, warnings; sys.modules[{missing!r}] = None; warnings.simplefilter('ignore'); " \
        "import __spark_entry__ as e; print(len(e.queries()), 'dup_file_sets' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    root = Path(__file__).resolve().parent.parent
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    n, has_core, consistent = said.stdout.split()
    assert int(n) >= len(REGISTRY) and has_core == consistent == "True", said.stderr


def test_tables_are_not_staged_on_a_machine_of_a_cluster():
    def session(master, warehouse, folder=None):
        settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": folder}
        conf = SimpleNamespace(get=lambda key, *default: settings[key])
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert staging_root(session("local[2]", "/w")) == "/w/echofold-staged"
    assert staging_root(session("yarn", "s3a://b/w/")) == "s3a://b/w/echofold-staged"
    assert staging_root(session("yarn", "file:/w", "hdfs://n/c")) == "hdfs://n/c/echofold-staged"
    for warehouse in ("file:/w", "/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging_root(session("yarn", warehouse))
