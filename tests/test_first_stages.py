from tallyloom.operators import extraction


def test_each_mode_takes_what_first_success_takes(spark):
    rows = [(d, "f.pdf", s, a, '{"Transactor": "A"}' if (d + i) % 3 else "nothing") for d in range(12)
            for i, (s, a) in enumerate([("local", 3), ("text", 2), ("cloud", 2), ("cloud", 1)])]
    x = spark.createDataFrame(rows, "doc_id long, file_name string, stage string, attempt int, response string")
    modes = ("auto", "cloud", "local")
    found = extraction.first_stages(x, modes)
    wanted = {(m, *r) for m in modes for r in extraction.first_success(x, m).select("doc_id", "stage", "attempt").collect()}
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
