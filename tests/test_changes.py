import datetime as dt
import os
from decimal import Decimal

import pytest

from tallyloom.sources import commits, files
from tallyloom.streaming import changes, jobs

KEYS = ["k"]


def put(spark, root, batch, rows):
    changes.write(spark.createDataFrame(rows, "k int, v string").coalesce(1), root, batch)


def state(spark, root, **options):
    return {r["k"]: r["v"] for r in changes.read(spark, root, KEYS, **options).collect()}


def test_snapshot_and_tail_equal_the_whole_history(spark, tmp_path):
    root, want = str(tmp_path), {}
    assert changes.read(spark, root, KEYS) is None
    for batch in range(7):
        rows = [(k, f"{k}@{batch}") for k in range(batch, batch + 3)]
        changes.compact(spark, root, KEYS, batch, 3, ["k"])
        put(spark, root, batch, rows)
        want.update(rows)
        assert state(spark, root) == want
    # Merged before batch 3 (0 to 2) and before batch 6 (3 to 5); the folders of merged batches are gone.
    assert changes.batches(spark, root) == [6] and commits.load(spark, root)[1]["upto"] == 5
    assert state(spark, root, before=6) == {k: f"{k}@{min(k, 5)}" for k in range(8)}
    assert changes.largest(spark, root, "k") == 8 and changes.largest(spark, root, "k", before=6) == 7


def test_asked_keys_read_their_folders_only(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, 0, [(k, str(k)) for k in range(500)])
    changes.compact(spark, root, KEYS, 1, 1)
    put(spark, root, 1, [(3, "new")])
    asked = spark.createDataFrame([(3,), (400,), (9999,)], "k int")
    found = changes.read(spark, root, KEYS, asked=asked)
    assert {r["k"]: r["v"] for r in found.collect()} == {3: "new", 400: "400"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


@pytest.mark.parametrize("step", ["commit", "tidy"])
def test_a_stop_inside_compaction_loses_nothing(spark, tmp_path, monkeypatch, step):
    root, want = str(tmp_path), {}
    for batch in range(3):
        rows = [(k, f"{k}@{batch}") for k in range(batch + 1)]
        put(spark, root, batch, rows)
        want.update(rows)

    def stop(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(*((commits, "commit") if step == "commit" else (changes, "tidy")), stop)
        with pytest.raises(OSError):
            changes.compact(spark, root, KEYS, 3, 2)
    assert state(spark, root) == want and len(changes.batches(spark, root)) == 3
    # The batch that was at work runs again, and so does the merge.
    changes.compact(spark, root, KEYS, 3, 1)
    put(spark, root, 3, [(0, "0@3")])
    put(spark, root, 3, [(0, "0@3")])
    assert state(spark, root) == {**want, 0: "0@3"} and state(spark, root, before=3) == want


def test_daily_totals_with_merges(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, kind string, amount decimal(18,2)"
    for hour, value in ((1, 1), (2, 10), (30, 100), (31, 1000)):
        spark.createDataFrame([(dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), "k", Decimal(value))], schema).coalesce(
            1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        jobs.run_updates(jobs.daily_totals(stream), out, str(tmp_path / "cp"), ["day_start", "kind"], compact_every=2)
    rows = sorted((r["day_start"].day, r["entries"], int(r["total"])) for r in jobs.read_latest(spark, out, ["day_start", "kind"]).collect())
    assert rows == [(1, 2, 11), (2, 2, 1100)]
    assert commits.load(spark, out)[0] >= 1 and len(changes.batches(spark, out)) <= 3


def test_ingest_with_merges(spark, tmp_path):
    src, out, names = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "suppliers")
    master = spark.createDataFrame(
        [(3, "Firm 1", "IT", ["IT"], None, ""), (4, "FIRM-1", "Other", ["Other"], "T", ""), (9, "Idle", "x", ["x"], None, "")],
        "arrival long, supplier_name string, category string, categories array<string>, transaction_type string, vat_number string")

    def arrive(*docs):
        rows = [(d, f"{d}.pdf", "cloud", 1, f'{{"Transactor": "Firm {f}", "Amount": 5}}') for d, f in docs]
        spark.createDataFrame(rows, files.EXTRACTION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(files.EXTRACTION_SCHEMA).parquet(src)
        jobs.ingest_replies(stream, out, master, str(tmp_path / "cp"), "2024-01-01", names, compact_every=1).awaitTermination()

    arrive((1, 1), (2, 2))
    arrive((1, 7), (3, 2))
    arrive((2, 8), (4, 1), (5, 5))
    rows = sorted((r["id"], r["transactor"], r["supplier_id"]) for r in spark.read.parquet(out).collect())
    # Every incoming row takes a number after the largest that a supplier holds, and a known supplier keeps its own: 9 + 2, 11 + 2.
    assert rows == [(1, "Firm 1", 3), (2, "Firm 2", 11), (3, "Firm 2", 11), (4, "Firm 1", 3), (5, "Firm 5", 13)]
    grown = {r["supplier_name"]: r for r in jobs.latest_master(spark, names, master).collect()}
    assert sorted(grown) == ["Firm 1", "Firm 2", "Firm 5", "Idle"]
    assert grown["Firm 1"]["categories"][:2] == ["IT", "Other"] and grown["Firm 1"]["transaction_type"] == "T"
    assert len({r["arrival"] for r in grown.values()}) == 4
    # The last batch wrote the suppliers that it names, and no others.
    assert {r["supplier_name"] for r in spark.read.parquet(f"{names}/batch=2").collect()} == {"Firm 1", "Firm 5"}
    assert not os.path.exists(f"{names}/batch=0")
