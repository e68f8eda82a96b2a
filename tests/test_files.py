"""Import of files: sent twice, failed and mended, killed between rows and ledger."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthledger.streaming import files

SCHEMA = StructType().add("file_sha256", "string").add("n", "long").add("error", "string")


def reader(sent):
    """A row for each line with a number; the word `bad` is an error."""
    each = sent.select("file_sha256", F.explode(F.split(F.trim(F.col("content").cast("string")), "\n")).alias("t")).where("t <> ''")
    return each.select("file_sha256", F.col("t").try_cast("bigint").alias("n"), F.when(F.col("t") == "bad", "a bad line").alias("error"))


@pytest.fixture
def folders(tmp_path):
    out = {k: tmp_path / k for k in ("in", "out", "checkpoint")}
    out["in"].mkdir()
    return {k: str(v) for k, v in out.items()} | {"put": lambda name, text: (tmp_path / "in" / name).write_text(text)}


def run(spark, at, read=reader):
    files.import_files(spark, at["in"], at["out"], at["checkpoint"], read).awaitTermination()


def rows(spark, at):
    return sorted(r["n"] for r in files.imported(spark, at["out"], SCHEMA).collect())


def test_a_file_sent_again_is_a_no_op(spark, folders):
    folders["put"]("a", "1\n2\n")
    run(spark, folders)
    folders["put"]("again", "1\n2\n")
    folders["put"]("b", "3\n3\n")
    seen = []
    run(spark, folders, lambda sent: seen.append(sent.count()) or reader(sent))
    assert rows(spark, folders) == [1, 2, 3, 3] and sum(seen) == 1


def test_a_failed_file_is_read_anew(spark, folders):
    folders["put"]("a", "1\nbad\n")
    folders["put"]("b", "2\n")
    folders["put"]("c", "\n")
    run(spark, folders)
    assert rows(spark, folders) == [2]
    assert sorted(r["error"] for r in files.states(spark, folders["out"]).where("state = 'failed'").collect()) == ["a bad line", "no rows were found"]
    folders["put"]("a-again", "1\nbad\n")  # the reader has been mended meanwhile
    run(spark, folders, lambda sent: reader(sent).where("error is null"))
    assert rows(spark, folders) == [1, 2]


def test_a_batch_that_dies_between_rows_and_ledger_leaves_nothing_twice(spark, folders, monkeypatch):
    folders["put"]("a", "1\n")
    run(spark, folders)
    folders["put"]("b", "2\n2\n")
    path = files.states

    def dies(*args):
        monkeypatch.setattr(files, "states", path)
        return path(*args)

    monkeypatch.setattr(files, "states", dies)
    real = files.FAILED
    monkeypatch.setattr(files, "FAILED", object())  # the ledger's entries cannot be built
    with pytest.raises(Exception):
        run(spark, folders)
    monkeypatch.setattr(files, "FAILED", real)
    assert rows(spark, folders) == [1]  # what was written of b is not seen
    run(spark, folders)
    assert rows(spark, folders) == [1, 2, 2]
    run(spark, folders)
    assert rows(spark, folders) == [1, 2, 2] and files.ledger(spark, folders["out"]).count() == 2


def test_nothing_imported_yet(spark, folders):
    assert rows(spark, folders) == [] and files.states(spark, folders["out"]).count() == 0
