"""Each registered query of the ledger against its SQL."""

import subprocess
import sys
from pathlib import Path

import oracle
import pytest
from pyspark.sql import functions as F

from hearthledger.functions import text as T
from hearthledger.plans import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.tables(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert oracle.differences(got, duck.execute(queries.SQL[name]).df()) == ""


def test_pairs_are_one_to_one(spark, sf_dir):
    got = queries.QUERIES["transfer_pairing"](spark, sf_dir).toPandas()
    assert got["transfer_id"].is_unique and got["payment_id"].is_unique


def test_full_redaction_leaves_no_phone(spark, sf_dir):
    out = queries.QUERIES["redaction_full"](spark, sf_dir)
    assert out.where(F.col("redacted").rlike(T.REDACTIONS[4][1]) | F.col("redacted").rlike(T.TRAILING_REFERENCE)).count() == 0
    assert queries.QUERIES["redaction_counts"](spark, sf_dir).agg(F.sum("phone")).first()[0] > 0


def test_later_equal_rows_are_new_rows_too(spark, sf_dir):
    assert queries.QUERIES["dedupe_new_rows_numbered"](spark, sf_dir).where("occurrence_index > 0").count() > 0


def test_the_entry_point_is_imported_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
