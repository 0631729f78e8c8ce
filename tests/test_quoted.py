import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import statements
from tallyloom.plans.registry import QUERIES
from tallyloom.sources import files, quoted

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _random_file(rnd, records):
    """Records of 1 to 6 cells; text of the cells in quotes where it has to be, and at times where it need not be."""
    out = []
    for _ in range(records):
        cells = []
        for _ in range(rnd.randint(1, 6)):
            cell = "".join(rnd.choice(["a", "b", " ", ",", '"', "\n", "1"]) for _ in range(rnd.choice([0, 1, 2, 5, 9, 30])))
            if rnd.random() < 0.5:
                cell = cell.replace(",", "").replace("\n", "")
            bare = not any(c in cell for c in ",\n") and not cell.startswith('"')
            cells.append(cell if bare and rnd.random() < 0.7 else '"' + cell.replace('"', '""') + '"')
        out.append(",".join(cells))
    return "\n".join(out) + "\n"


def _trimmed(cells):
    while cells and cells[-1] == "":
        cells = cells[:-1]
    return tuple(cells)


def _expected(text):
    rows = [[c.replace("\n", " ") for c in row] for row in csv.reader(io.StringIO(text, newline=""))]
    return [r for r in map(_trimmed, rows) if r]


def test_random_files_against_csv(spark, tmp_path, small_blocks):
    rnd = random.Random(3)
    texts = {f"f{i}.csv": _random_file(rnd, rnd.choice([1, 5, 40])) for i in range(12)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    assert files.physical_lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 40
    got = {}
    for row in quoted.records(spark, str(tmp_path)).orderBy("file", "line_no").collect():
        got.setdefault(row.file.rsplit("/", 1)[1], []).append(_trimmed(row.fields))
    for name, text in texts.items():
        assert [r for r in got.get(name, []) if r] == _expected(text)


def test_lines_equal_those_of_the_one_task_reader(spark, tmp_path, small_blocks):
    rnd = random.Random(8)
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_text(_random_file(rnd, 30))
    def found(lines):
        cells = lines.orderBy("file", "line_no").select("file", quoted.split_record(F.col("line")).alias("f")).collect()
        return [(r.file, _trimmed(r.f)) for r in cells if _trimmed(r.f)]
    assert found(quoted.statement_lines(spark, str(tmp_path))) == found(files.multiline_statements(spark, str(tmp_path)))


def test_statement_with_a_break_in_every_block(spark, tmp_path, small_blocks):
    rows = "".join(f'2024-01-02,"pay {i}\r\nto ""x, y""\n{"z" * 90}",{i}.00\r\n' for i in range(50))
    (tmp_path / "s.csv").write_bytes(("My bank\r\nDate,Description,Debit\r\n" + rows).encode())
    got = statements.standardise(quoted.statement_lines(spark, str(tmp_path))).orderBy("debit").collect()
    assert [(r.description, int(r.debit)) for r in got if r.debit] == [
        (f'pay {i} to "x, y" {"z" * 90}', i) for i in range(50) if i]


def test_a_quote_that_never_closes_leaves_lines(spark, tmp_path, small_blocks):
    (tmp_path / "s.csv").write_text('a,"b\nc",d\n\n"open,1\n' + "".join(f"line {i},x\n" for i in range(40)))
    (tmp_path / "empty.csv").write_text("")
    got = [r.fields for r in quoted.records(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [["a", "b c", "d"], ["\"open,1"], *[[f"line {i}", "x"] for i in range(40)]]


def test_very_long_and_very_wide_records(spark, tmp_path):
    text = ('say ""x"", ' * 100_000) + "\n" + "y" * 1_000_000
    (tmp_path / "s.csv").write_text(f'1,"{text}",2\n' + ",".join(['"a,b"'] * 20_000) + "\n")
    got = quoted.records(spark, str(tmp_path)).orderBy("line_no").collect()
    assert got[0].fields == ["1", text.replace('""', '"').replace("\n", " "), "2"] and got[1].fields == ["a,b"] * 20_000


def test_query_reads_back_what_was_written(spark):
    got = {r.doc_id: r for r in QUERIES["quoted_records"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs) and all(
        got[d.doc_id].text == (d.text or "").replace("\r\n", " ").replace("\r", " ").replace("\n", " ") and got[d.doc_id].n_cells == 4
        for d in docs)
