"""Jobs over arriving data. Every sink is idempotent per batch, so a restarted query repeats no row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators import extraction, ledger, reconcile
from tallyloom.operators import suppliers as supplier_ops
from tallyloom.operators.numbering import number_rows
from tallyloom.session import durable, scratch
from tallyloom.sources import commits, files
from tallyloom.streaming import changes


def daily_totals(stream: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Count and sum per type and day as data arrives. ``stream``: ts, kind, amount."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "kind")
        .agg(F.count("*").alias("entries"), F.sum("amount").alias("total"))
        .select(F.col("w.start").alias("day_start"), "kind", "entries", "total")
    )


def without_repeats(stream: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """Drops a reply that arrives again within the watermark. ``stream``: ts and the key columns."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def latest_master(spark: SparkSession, root: str, start: DataFrame) -> DataFrame:
    """The supplier master after the last batch, or ``start`` where no batch has written one."""
    master = changes.read(spark, root, ["name_key"])
    return start if master is None else master.drop("name_key")


def _last_id(spark: SparkSession, root: str, batch_id: int) -> int:
    """The largest id that earlier batches gave. Ids grow, so it stands in the last batch with rows."""
    known = changes.batches(spark, root)
    if not known:  # a ledger that no batch has written
        return files.invoices(spark, root).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    for batch in reversed([b for b in known if b < batch_id]):
        last = spark.read.parquet(f"{root}/batch={batch}").agg(F.max("id")).first()[0]
        if last is not None:
            return last
    return 0


def _grown(spark: SparkSession, found: DataFrame, root: str, start: DataFrame, batch_id: int) -> DataFrame:
    """The suppliers that a batch names, after the batch; only these are read, merged and written."""
    keys = ["name_key"]
    if not commits.numbers(spark, root):
        merged = supplier_ops.upsert(start, start.limit(0)).drop("is_new", "vat_filled")
        changes.snapshot(merged, root, keys, -1, ["arrival"])
    first = F.lit(changes.largest(spark, root, "arrival", batch_id) or 0).cast("long")
    numbered = number_rows(found.withColumnRenamed("arrival", "given"), "given", name="arrival", start=first).drop("given")
    named = durable(supplier_ops.keyed(numbered))
    touched = changes.read(spark, root, keys, batch_id, named).drop("name_key")
    grown = supplier_ops.upsert(touched, named.drop("name_key")).drop("is_new", "vat_filled")
    changes.write(grown, root, batch_id)
    return spark.read.schema(grown.schema).parquet(f"{root}/batch={batch_id}")


def ingest_replies(replies: DataFrame, ledger_root: str, suppliers: DataFrame, checkpoint: str, as_of: str,
                   supplier_root: str | None = None, compact_every: int = 16) -> StreamingQuery:
    """Replies to ledger rows and, with ``supplier_root``, to the supplier master.

    Each micro-batch overwrites its own folders. A document counts once: replies that arrive after a batch that put its
    document into the ledger add no row. The ids of those documents are kept beside the ledger. Of them and of the master a batch
    reads the folders that can hold its keys and the batches since the last merge, of the ledger its last batch.
    """
    seen_root = f"{ledger_root}/_documents"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for root, keys, peaks in ((seen_root, ["doc_id"], []), (supplier_root, ["name_key"], ["arrival"])):
            if root is not None:
                changes.compact(spark, root, keys, batch_id, compact_every, peaks)
        with scratch():
            # The micro-batch is read once; what it holds is written out, so that all later reads see the same rows.
            winners = durable(extraction.first_success(batch))
            seen = changes.read(spark, seen_root, ["doc_id"], batch_id, winners)
            if seen is not None:
                winners = durable(winners.join(seen.select("doc_id"), "doc_id", "left_anti"))
            changes.write(winners.select("doc_id"), seen_root, batch_id)
            recs = extraction.records(winners)
            master = suppliers
            if supplier_root is not None:
                found = extraction.supplier_rows(recs).drop("doc_id", "record_no")
                master = _grown(spark, found, supplier_root, suppliers, batch_id)
            incoming = extraction.invoice_rows(recs, as_of).withColumn("arrival", F.struct("doc_id", "record_no")).drop("conversion_error")
            rows = ledger.append(spark.createDataFrame([], files.INVOICE_SCHEMA), incoming, master, _last_id(spark, ledger_root, batch_id))
            changes.write(rows, ledger_root, batch_id)
    return replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_arrivals(transactions: DataFrame, invoices: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Matches arriving transactions with the ledger; each micro-batch overwrites its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # The match writes the micro-batch out and reads it from there, so that all reads see the same rows.
        with scratch():
            matched = reconcile.match_transactions(batch, invoices, **options)
            matched.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return transactions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_folder(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs an append-mode stream over everything that is there, into Parquet files."""
    (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())


def run_updates(stream: DataFrame, out: str, checkpoint: str, keys: list[str] | None = None, compact_every: int = 16) -> None:
    """Runs an aggregating stream over everything that is there; each batch adds the rows that it changed.

    State older than the watermark is dropped, and a repeated batch overwrites its own folder. With ``keys`` the batches are
    merged into a snapshot from time to time. :func:`read_latest` reads the result.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if keys:
            changes.compact(batch.sparkSession, out, keys, batch_id, compact_every)
        changes.write(batch, out, batch_id)
    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .outputMode("update").trigger(availableNow=True).start().awaitTermination())


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last row that any batch wrote for each key: the snapshot and the batches after it."""
    rows = changes.read(spark, out, keys)
    if rows is None:
        raise ValueError(f"no batch has written to {out}")
    return rows


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of its file."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def read_pieces(spark: SparkSession, rows: DataFrame, folder: str, pieces: int, *keys: str) -> DataFrame:
    """``rows`` written as so many pieces and streamed one piece a batch. Rows of one key are in one piece.

    A piece is as many files as the session runs tasks, so that no batch is read by few of them.
    """
    files_a_piece = spark.sparkContext.defaultParallelism
    rows.repartition(pieces * files_a_piece, *keys).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_piece).parquet(folder)
