from pyspark.sql import functions as F

from tallyloom.streaming import jobs


def test_a_piece_is_read_by_many_tasks_and_holds_its_keys_whole(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id % 1000 as doc_id", "id div 1000 as attempt")
    stream = jobs.read_pieces(spark, rows, str(tmp_path / "in"), 2, "doc_id")
    seen = []

    def look(batch, _):
        seen.append((batch.select(F.input_file_name()).distinct().count(), {r[0] for r in batch.select("doc_id").collect()}, batch.count()))
    stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert [files for files, _, _ in seen] == [cores, cores] and sum(n for _, _, n in seen) == 4000
    assert not seen[0][1] & seen[1][1]
