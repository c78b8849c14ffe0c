"""The keyed table: what it rewrites, what it holds, and what is left of a writer that is lost."""

import pytest
from pyspark.sql import functions as F

from kinloom.operators.keyed import KeyedTable
from kinloom.operators.upsert import upsert
from kinloom.session import shared_path


def rows(spark, ids, value):
    return spark.createDataFrame([(i, f"k{i % 3}" if i is not None else None, value, i) for i in ids], "id long, part string, value string, at long")


def table(spark, n=5000, file_rows=50):
    out = KeyedTable(spark, shared_path(spark, "keyed"), ["id", "part"], file_rows)
    out.create(rows(spark, range(n), "old"))
    return out


def test_a_clustered_batch_leaves_most_files(spark):
    t = table(spark)
    before = {r["file"] for r in t.files().collect()}
    assert len(before) >= 90
    done = t.put(rows(spark, range(1000, 1050), "new"), ["at"])
    after = {r["file"] for r in t.files().collect()}
    assert len(before & after) >= 0.9 * len(before) and done["untouched"] == len(before & after)
    assert t.read().where("value = 'new'").count() == 50 and t.read().count() == 5000
    # The version before it is as it was.
    assert t.read(0).where("value = 'new'").count() == 0


def test_puts_are_upserts(spark):
    t = table(spark, 300, 40)
    want = t.read()
    batches = [rows(spark, [7, 299, 300, 301], "a"), rows(spark, [7, 7, None], "b").unionByName(spark.createDataFrame([(7, "k9", None, 1)], "id long, part string, value string, at long")), rows(spark, [], "c"), rows(spark, range(0, 600, 5), "d")]
    for b in batches:
        t.put(b, ["at", "value"], fill=("value",))
        want = upsert(want, b, ["id", "part"], ["at", "value"], fill=("value",))
        want = spark.createDataFrame(want.collect(), want.schema)
    assert sorted(map(str, t.read().collect())) == sorted(map(str, want.collect()))
    # Every key is in one file, and no file is listed twice.
    assert t.files().agg(F.sum("n")).first()[0] == want.count() and t.files().select("file").distinct().count() == t.files().count()


def test_a_lost_writer_leaves_the_table(spark, monkeypatch):
    t = table(spark, 100, 20)
    monkeypatch.setattr(KeyedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.put(rows(spark, [1, 2], "new"), ["at"])
    monkeypatch.undo()
    assert t.versions() == [0] and t.read().where("value = 'new'").isEmpty() and t.read().count() == 100
    t.put(rows(spark, [1, 2], "new"), ["at"])
    assert t.read().where("value = 'new'").count() == 2


def test_a_version_is_written_once(spark):
    t = table(spark, 50, 20)
    with pytest.raises(RuntimeError):
        t._commit(0, t.files())
    with pytest.raises(ValueError):
        t.create(rows(spark, [1], "x"))
    with pytest.raises(ValueError):
        KeyedTable(spark, shared_path(spark, "none"), ["id"]).read()
