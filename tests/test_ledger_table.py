import pytest
from pyspark.sql import functions as F

from tallyloom.operators import ledger
from tallyloom.sources import commits, ledger_table, sinks


def _rows(spark, n=120):
    return spark.range(n).select(
        "id", F.when(F.col("id") % 40 > 0, F.date_add(F.lit("2024-01-05").cast("date"), (F.col("id") % 4 * 31).cast("int"))).alias("date"),
        F.lit("old").alias("notes"))


def _held(spark, root, number=None):
    return {r.id: (r.date and r.date.month, r.notes) for r in ledger_table.read(spark, root, number).collect()}


def _folders(spark, root):
    return {tuple(x) for x in commits.load(spark, root)[1]["folders"]}


def test_an_edit_rewrites_one_month(spark, tmp_path):
    root = str(tmp_path / "ledger")
    ledger_table.create(_rows(spark), root)
    before, held = _folders(spark, root), _held(spark, root)
    ids = spark.createDataFrame([(5,)], "id long")  # in February
    ledger_table.edit(spark, root, ids, lambda rows: rows.withColumn("notes", F.when(F.col("id") == 5, "new").otherwise(F.col("notes"))))
    after = _folders(spark, root)
    assert {m for m, _ in before - after} == {m for m, _ in after - before} == {"2024-02"}
    assert _held(spark, root) == held | {5: (2, "new")} and _held(spark, root, 1) == held
    ledger_table.edit(spark, root, ids, lambda rows: ledger.delete(rows, ids))
    held.pop(5)
    assert _held(spark, root) == held
    assert ledger_table.edit(spark, root, spark.createDataFrame([(999,)], "id long"), lambda rows: rows.limit(0)) == 3
    assert ledger_table.read(spark, root, months=["none"]).where("date is not null").count() == 0


def test_a_row_may_move_to_another_month(spark, tmp_path):
    root = str(tmp_path / "ledger")
    ledger_table.create(_rows(spark), root)
    ids = spark.createDataFrame([(5,)], "id long")
    ledger_table.edit(spark, root, ids, lambda rows: rows.withColumn(
        "date", F.when(F.col("id") == 5, F.lit("2024-03-09").cast("date")).otherwise(F.col("date"))))
    assert _held(spark, root)[5] == (3, "old") and len(_held(spark, root)) == 120
    assert len([m for m, _ in _folders(spark, root) if m == "2024-03"]) == 2
    ledger_table.compact(spark, root, most=1)
    assert len(_folders(spark, root)) == 5 and len(_held(spark, root)) == 120


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    ledger_table.create(_rows(spark), root)
    held = _held(spark, root)
    put = commits.commit

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(commits, "commit", dies)
    with pytest.raises(OSError):
        ledger_table.append(_rows(spark, 3), root)
    monkeypatch.setattr(commits, "commit", put)
    assert _held(spark, root) == held
    ledger_table.append(_rows(spark, 3).withColumn("id", F.col("id") + 500), root)
    ledger_table.vacuum(spark, root, keep=1)
    assert len(_held(spark, root)) == 123 and len(commits.listed(spark, f"{root}/data")) == 2
    assert commits.numbers(spark, root) == [2]


def test_the_second_of_two_writers_tries_again(spark, tmp_path):
    root = str(tmp_path / "ledger")
    ledger_table.create(_rows(spark), root)
    with pytest.raises(commits.Conflict):
        ledger_table.create(_rows(spark), root)
    ids, calls = spark.createDataFrame([(6,)], "id long"), []

    def change(rows):
        if not calls:  # another writer commits while this one works
            ledger_table.append(_rows(spark, 2).withColumn("id", F.col("id") + 700), root)
        calls.append(1)
        return ledger.delete(rows, ids)

    assert ledger_table.edit(spark, root, ids, change) == 3 and len(calls) == 2
    held = _held(spark, root)
    assert 6 not in held and {700, 701} <= held.keys() and len(held) == 121


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "out")
    with pytest.raises(ValueError):
        sinks.read_current(spark, root)
    sinks.publish(spark.range(3), root, "1")
    put = commits.commit

    def dies(*_):
        raise OSError("lost")

    monkeypatch.setattr(commits, "commit", dies)
    with pytest.raises(OSError):
        sinks.publish(spark.range(5), root, "1")
    monkeypatch.setattr(commits, "commit", put)
    assert sinks.read_current(spark, root).count() == 3
    sinks.publish(spark.range(5), root, "1")
    sinks.publish(spark.range(7), root, "2")
    assert sinks.read_current(spark, root).count() == 7
