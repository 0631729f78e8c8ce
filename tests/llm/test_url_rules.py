import random

from pyspark.sql import functions as F

from tallyloom.llm import url_rules


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def _judge(url, rules, otherwise="allow"):
    host, path = _parts(url)
    fits = [(-len(h + p), h + p, 0 if v == "block" else 1, v) for h, p, v in rules
            if url is not None and "://" in url and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best and best[1], best[3] if best else otherwise


def test_rules_against_brute_force(spark):
    rnd = random.Random(8)
    hosts = [".".join(rnd.choice(["a", "b", "www", "exa", "exam", "com"]) for _ in range(rnd.randint(1, 5))) for _ in range(120)]
    paths = ["", "/", "/en", "/en/", "/english/x", "/en/x/y", "/fr/", "/en/x", "/en#"]
    urls = [f"http://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=://x', '#t', '/z'])}" for _ in range(1500)]
    urls += [None, "", "no scheme", "://", "x://", "HTTP://WWW.Exa.COM/En/", "http://ÄB.com/en/", "a://b://c/", "http://a..b/en/", "\nhttp://a.b/en/\n?x"]
    rules = {(rnd.choice(hosts), rnd.choice(paths[:-1])): rnd.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()] + [(hosts[0], "/en/", "block"), (hosts[0], "/en/", "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    table = spark.createDataFrame(rules + [(None, "/", "block")], "host string, path string, verdict string")
    judged = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, table).collect()}
    for i, url in enumerate(urls):
        assert judged[i] == _judge(url, rules), url
    assert sum(r[2] is not None for r in judged.values()) > 200


def test_sweep_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        pages = spark.range(3000).select(
            F.col("id").alias("page_id"), F.format_string("https://h%d.site%d.net/p%d/%d", F.col("id") % 7, F.col("id") % 40, F.col("id") % 9, "id").alias("url"))
        rules = [("net", "/", "allow"), ("site3.net", "/p1/", "block"), ("site39.net", "/", "block"), ("h2.site39.net", "/p", "allow")]
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        for r in url_rules.judge(pages, table).collect():
            assert (r.host, r.path, r.rule, r.verdict) == _judge(r.url, rules)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_key_lies_in_several_ranges(spark, monkeypatch):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for key, value in zip(before, ("16", "false")):
        spark.conf.set(key, value)
    staged, tables = url_rules.common.staged, []

    def kept(df, name):
        tables.append(staged(df, name))
        return tables[-1]
    monkeypatch.setattr(url_rules.common, "staged", kept)
    try:
        pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("https://h%d.com/?q=%d", "id", "id").alias("url"))
        rules = [("com", "/", "allow"), ("h7.com", "/", "block"), ("h2999.com", "", "block")]
        table = spark.createDataFrame(rules, "host string, path string, verdict string")
        for r in url_rules.judge(pages, table).collect():
            assert (r.host, r.path, r.rule, r.verdict) == _judge(r.url, rules)
        held = tables[0].where("key = 'com#/' and kind = 1").groupBy("part").count().collect()
        assert len(held) >= 4 and max(r["count"] for r in held) < 1500
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_awkward_rows(spark):
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(
        [(1, "http://a.com/", "clash"), (1, "http://a.com/", "clash"), (None, None, None), (2, "http://a.com/" + "x" * 100_000, "")],
        "page_id long, url string, verdict string")
    rows = url_rules.judge(pages, rules).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in rows) == [(0, "allow"), (1, "block"), (1, "block"), (2, "block")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}
