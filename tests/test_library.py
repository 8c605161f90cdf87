"""Sources, sinks, streams and columns that no table reaches, on small inputs with known results."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import codecs, dates, text
from threadloom.operators import catalog, posts, rules, scan
from threadloom.sources import readers, sinks
from threadloom.streaming import ingest


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_files(spark, tmp_path):
    for path, size in (("a/one.tar.gz", 10), ("a/b/Two.jpg", 20), ("a/b/three.txt", 5), ("four.par2", 1)):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x" * size)
    rows = readers.files(spark, str(tmp_path))
    got = {r["name"]: r for r in rows.collect()}
    assert (got["one.tar.gz"]["stem"], got["one.tar.gz"]["extension"], got["one.tar.gz"]["type"], got["one.tar.gz"]["size"]) == ("one", ".tar.gz", "application/tar+gzip", 10)
    names = lambda **k: {r["name"] for r in readers.found(rows, str(tmp_path), **k).collect()}
    assert names(prefix=["t"]) == {"three.txt"} and names(prefix=["t"], any_case=True) == {"Two.jpg", "three.txt"}
    assert names(prefix=["o", "f"], suffix=[".gz"]) == {"one.tar.gz"} and names(regex=["^[a-z]+[.]par2$", "jpg"]) == {"four.par2", "Two.jpg"}
    assert names(min_depth=3) == {"Two.jpg", "three.txt"} and names(max_depth=1) == {"four.par2"}
    later = lambda n: F.max("modified").over(Window.partitionBy(F.lit(1))) + F.expr(f"INTERVAL {n} SECONDS")
    timed = rows.withColumn("now", later(100))
    assert readers.quiet(timed, 50, F.col("now")).count() == 4 and readers.quiet(timed, 100_000, F.col("now")).count() == 0
    assert sorted(r["size"] for r in readers.folder_sizes(rows).collect()) == [1, 10, 25]


def test_servers(spark):
    rows = readers.servers(spark, {"servers": [{"host": "b", "priority": 2}, {"host": "a", "secure": True}, {"host": "B "}, {}, {"host": "c", "port": 80, "priority": 1, "username": "u"}]}).collect()
    assert [tuple(r) for r in rows] == [("c", 80, False, "u", 1), ("a", 563, True, None, 2), ("b", 119, False, None, 2)]
    assert readers.servers(spark, {}).count() == 0


def test_manifest_texts_read_back(spark, tmp_path):
    files = spark.createDataFrame([(1, "p & q", 5, 'a "b" <c>', ["g.h"], [(1, 10, "x&y@z"), (2, 20, "w")]), (2, "p", 5, "s", ["g"], [])], "m int, poster string, date long, subject string, groups array<string>, segments array<struct<number:int,bytes:long,id:string>>")
    got = {r["m"]: r["xml"] for r in readers.manifest_texts(files, "m").collect()}
    assert got[2] is None and got[1].startswith('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE nzb PUBLIC')
    (tmp_path / "m.nzb").write_text(got[1])
    row = readers.manifest(spark, str(tmp_path / "m.nzb")).first()
    assert (row["poster"], row["subject"], [tuple(s) for s in row["segments"]]) == ("p & q", 'a "b" <c>', [(1, 10, "x&y@z"), (2, 20, "w")])
    twice = [(1, 1, "a"), (1, 1, "b")]
    more = files.unionByName(spark.createDataFrame([(3, "p", 5, "s", ["g"], twice), (4, None, 5, "s", ["g"], [(1, 1, "a")])], files.schema))
    assert {r["m"]: r["valid"] for r in readers.valid_files(more).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_publish_and_save(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.publish(spark.range(3), root)
    old = sinks.published(spark, root)
    sinks.publish(old.union(spark.range(3, 5)), root)
    assert old.count() == 3 and sinks.published(spark, root).count() == 5
    out = tmp_path / "files"
    out.mkdir()
    rows = sinks.save_contents(spark.createDataFrame([("../a.bin", b"\0\1"), ("b.bin", b"")], "name string, content binary"), str(out)).collect()
    assert (out / "a.bin").read_bytes() == b"\0\1" and (out / "b.bin").read_bytes() == b"" and sum(r["size"] for r in rows) == 2


def test_catalogue_schema(spark):
    names = sinks.create_catalogue(spark, "news_test")
    assert names == ["aliases", "groups", "settings", "tracks"] and sinks.create_catalogue(spark, "news_test", reset=True) == names
    assert spark.table("news_test.groups").count() == 0
    sinks.drop_catalogue(spark, "news_test")
    assert not spark.catalog.databaseExists("news_test")


def test_upserts_break_ties(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "c"), (1, 5, "b"), (2, 1, "x")], "k int, at int, v string")
    for f in (catalog.upsert, catalog.upsert_any):
        got = {tuple(map(tuple, f(rows.repartition(n), rows.limit(0), ["k"], "at").collect())) for n in (1, 3)}
        assert len({frozenset(g) for g in got}) == 1
    assert {r["v"] for r in catalog.upsert(rows, rows.limit(0), ["k"], "at").collect()} == {"c", "x"}
    clash = rows.withColumnRenamed("v", "_r")
    assert catalog.upsert(clash, clash.limit(0), ["k"], "at").columns == ["k", "at", "_r"]
    with_map = rows.withColumn("m", F.create_map("v", "k")).withColumnRenamed("v", "rank")
    assert catalog.upsert_any(with_map, with_map.limit(0), ["k"], "at").columns == ["k", "at", "rank", "m"]


def test_scan_bounds(spark):
    df = spark.createDataFrame([(n, dt.datetime(2020, 1, 1) + dt.timedelta(hours=n), "p", "g") for n in range(10, 20)], "article_no long, posted timestamp, poster string, group string")
    numbers = lambda d: [r["article_no"] for r in d.collect()]
    assert numbers(scan.xover(df, 12, 14, order="number")) == [12, 13, 14]
    assert numbers(scan.xover(df, 14, 12)) == numbers(scan.xover(df, 5, 12)) == numbers(scan.xover(df, 12, 25)) == numbers(scan.xover(df, 12, 13, group="h")) == []
    assert numbers(scan.xover(df, until=dt.datetime(2020, 1, 1, 11), order="poster")) == [10, 11]
    assert tuple(scan.seek(df, dt.datetime(2020, 1, 1, 15)).first()) == (15, 5) and tuple(scan.seek(df, dt.datetime(2021, 1, 1)).first()) == (10, 10)
    assert numbers(scan.page(df, 15, 2)) == [15, 16] and numbers(scan.page(df, 15, -2)) == [13, 14]
    with pytest.raises(ValueError):
        dates.within(F.col("posted"), dt.datetime(2021, 1, 1), dt.datetime(2020, 1, 1))


def test_rule_lists_from_rows(spark):
    lines = spark.createDataFrame([("SP-5 .* spam",), ("B>100 .*",), ("W<0 g",)], "value string")
    scores, white, black = rules.compiled(rules.parse_lines(lines).collect())
    assert (scores[0].score, scores[0].tests, black[0].tests, white[0].tests) == (-5, {"poster_regex": "spam"}, {"score_above": 100}, {"score_below": 0})
    for bad in ("SS .* x", "SS>5 .* x", "B .*"):
        with pytest.raises(ValueError):
            rules.compiled(rules.parse_lines(spark.createDataFrame([(bad,)], "value string")).collect())


@pytest.mark.parametrize(("given", "want"), [("////absolute//path//", "/absolute/path"), ("/", "/"), ("C:\\\\test\\\\", "C:\\test"), ("  /a/b/ ", "/a/b"), (None, None)])
def test_tidy_path(spark, given, want):
    assert one(spark, text.tidy_path, given) == want


def test_text_helpers(spark):
    assert one(spark, lambda c: text.hexdump(c), bytes(range(20)), "binary").split("\n") == ["00000000:  00 01 02 03 04 05 06 07  08 09 0a 0b 0c 0d 0e 0f  |................|", "00000010:  10 11 12 13" + " " * 37 + "  |....|"]
    assert one(spark, lambda c: text.hexdump(c), b"", "binary") == "" and one(spark, lambda c: text.hexdump(c), None, "binary") is None
    a, b = (one(spark, lambda c: text.seeded_text(c, 32), s) for s in ("s", "t"))
    assert len(a) == 32 and a.isalnum() and a != b and a == one(spark, lambda c: text.seeded_text(c, 32), "s")
    at = dt.datetime(2020, 3, 4, 5, 6, 7, 89)
    got = spark.createDataFrame([(at,)], "t timestamp").select(text.new_message_id(F.col("t"), F.lit(1), F.lit("host")).alias("x")).first()["x"]
    assert got[5:].startswith("7.59!7e434615@host") and len(got) == len("xxxxx7.59!7e434615@hostyyyyy")
    assert one(spark, lambda c: text.masked(c, {"a": "%{b}", "b": "$1"}), "x %{A} %{c}") == "x $1 %{c}"
    assert one(spark, text.message_id, " <a@b> ") == "a@b" and one(spark, text.message_id, "a b") is None
    assert one(spark, text.truth, "enabled") is True and one(spark, text.truth, "never") is False and one(spark, text.truth, "?") is None
    x = one(spark, text.url_parts, "http://h/p?A=1&b=%20x&a=2")
    assert x["qsd"] == {"a": "2", "b": "x"} and one(spark, text.url_parts, "http://h:99999999999/p") is None
    assert one(spark, text.crosspost_group, "host a:1 last") == "last" and one(spark, text.crosspost_group, "a:1") is None


def test_posts_helpers(spark):
    assert one(spark, posts.is_ascii, "a\tb") and not one(spark, posts.is_ascii, "é") and not one(spark, posts.is_ascii, "\x01")
    assert one(spark, lambda c: posts.nuked(F.create_map(c, F.lit("1"))), "x-removed-by") and not one(spark, lambda c: posts.nuked(F.create_map(c, F.lit("1"))), "Subject")
    assert one(spark, posts.response_classes, 435, "int") == ["denied", "no_article"] and one(spark, posts.succeeded, 340, "int") and not one(spark, posts.succeeded, 430, "int")
    assert [one(spark, lambda c: posts.placed(F.array(F.lit("a"), F.lit("b"), F.lit("c")), c), i, "int") for i in (0, 2, 9, -1, -3, -9)] == ["a", "c", "c", "c", "a", "a"]
    assert one(spark, lambda c: posts.bisect_left(F.array(F.lit(1), F.lit(3), F.lit(3), F.lit(5)), c), 3, "int") == 1


def test_yenc_parts(spark):
    data = bytes(range(256)) * 40
    half = codecs.yenc(data[:5000], "a b.bin", 1, 2, 0, len(data))
    told = codecs.unyenc_part(b"noise\r\n" + half)
    assert (told["name"], told["part"], told["parts"], told["begin"], told["finish"], told["size"], told["ok"], told["content"]) == ("a b.bin", 1, 2, 0, 5000, len(data), True, data[:5000])
    assert codecs.unyenc_part(half.replace(b"pcrc32=", b"pcrc32=0"))["ok"] is False and codecs.unyenc_part(b"none") is None
    rows = spark.createDataFrame([(half,), (None,), (b"x",)], "x binary").select(codecs.yenc_parts("x").alias("y")).collect()
    assert [r["y"]["begin"] for r in rows] == [0, None, None]


def lines_of(numbers, subject="a"):
    return "\n".join("\t".join([str(n), subject, "p", "1 Jan 2020 00:00:00 +0000", f"<{n}@x>", "", "1", "1", ""]) for n in numbers)


def test_ingest_stops_at_an_error_and_goes_on(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.txt").write_text(lines_of(range(10)))
    (tmp_path / "in/2.txt").write_text(lines_of(range(10, 20)))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), "g", "s1", files_per_trigger=1)
    good, calls = ingest.article_lines, []

    def failing(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return good(batch)

    monkeypatch.setattr(ingest, "article_lines", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    assert ingest.articles(spark, str(tmp_path / "t")).count() == 10
    run()
    rows = ingest.articles(spark, str(tmp_path / "t"), "g")
    assert rows.count() == 20 and ingest.articles(spark, str(tmp_path / "t"), "none").count() == 0
    marks = catalog.watermarks(rows, ["server", "group"]).collect()
    assert [tuple(m) for m in marks] == [("s1", "g", 0, 19, 20)]


def test_sliding_means_keep_their_state(spark, tmp_path):
    at = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=n)
    schema = "key string, at timestamp, value double"

    def run(begin, end):
        spark.createDataFrame([("k", at(n), float(n)) for n in range(begin, end)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.sliding_means(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run(0, 5)
    run(5, 8)
    got = [r["mean"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "ts timestamp, group string"
    at = lambda m: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=m)

    def run(*minutes):
        spark.createDataFrame([(at(m), "g") for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counts = ingest.windowed_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run(0, 10, 30, 200)
    run(15, 400)
    got = {(r["window"]["start"].hour, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (0, 3) in got and (3, 1) in got


def test_follow_states(spark, tmp_path):
    states = "id long, staged timestamp, posted timestamp, verified timestamp"
    t = lambda n: dt.datetime(2020, 1, n)
    sinks.publish(spark.createDataFrame([(1, t(1), None, None), (2, t(1), t(2), None)], states), str(tmp_path / "s"))
    schema = "id long, kind string, at timestamp"

    def run(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        ingest.follow_states(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "e")), str(tmp_path / "s"), str(tmp_path / "c"))
        return {r["id"]: (r["posted"], r["verified"]) for r in sinks.published(spark, str(tmp_path / "s")).collect()}

    assert run((1, "verified", t(3)), (2, "verified", t(4)), (2, "posted", t(9))) == {1: (None, None), 2: (t(2), t(4))}
    assert run((1, "posted", t(5)), (3, "staged", t(6)))[1] == (t(5), None)


def test_hexdump_any_length_and_width(spark):
    """Against a plain form; a long content takes time by its length."""

    def plain_dump(data, width):
        out = []
        for at in range(0, len(data), width):
            part = data[at : at + width]
            pairs = " ".join(f"{b:02x}" for b in part)
            body = f"{pairs[:24]} {pairs[24:]}" if len(pairs) > 24 else pairs
            out.append(f"{at:08x}:  {body[: width * 3]:<{width * 3}}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}|")
        return "\n".join(out)

    data = bytes(range(256)) * 2
    rows = [(n, data[n : 2 * n]) for n in range(41)]
    df = spark.createDataFrame(rows, "n int, x binary")
    for width in (4, 8, 9, 16, 20):
        for r in df.select("x", text.hexdump(F.col("x"), width).alias("y")).collect():
            assert r["y"] == plain_dump(bytes(r["x"]), width), (width, len(r["x"]))
    long = spark.range(1).select(F.expr("repeat('0123456789abcdef', 65536)").cast("binary").alias("x"))
    assert long.select(F.size(F.split(text.hexdump(F.col("x")), "\n")).alias("n")).first()["n"] == 65536


def test_crosspost_map_of_many_groups(spark):
    """The last of equal groups stays, in its place; many groups take time by their number, not its square."""
    given = "b:1 a:2 no b:3 c:x a:b:5 d:1z"
    assert one(spark, text.crosspost_map, given) == {"b": 3, "c": 0, "a": 5, "d": 0}
    assert one(spark, lambda c: F.map_keys(text.crosspost_map(c)), given) == ["b", "c", "a", "d"]
    assert one(spark, text.crosspost_map, "") == {} and one(spark, text.crosspost_map, None) is None
    many = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39999)), lambda i: F.concat(F.lit("g"), (i % 20000).cast("string"), F.lit(":"), i.cast("string"))), " ").alias("x"))
    m = many.select(text.crosspost_map(F.col("x")).alias("m")).select(F.size("m").alias("n"), F.element_at("m", "g7").alias("v")).first()
    assert tuple(m) == (20000, 20007)


def test_codec_columns_hold_one_buffer(spark):
    """Nulls, empty and odd values as before; beside the column itself no other values are held."""
    import tracemalloc

    rows = [(b"abc",), (None,), (b"",), (bytes(range(256)) * 9,)]
    df = spark.createDataFrame(rows, "x binary")
    for encode, decode, plain in ((codecs.yenc_encode, codecs.yenc_decode, codecs.yenc), (codecs.uu_encode, codecs.uu_decode, codecs.uu)):
        got = df.select(encode("x").alias("e"), decode(encode("x")).alias("d"), decode(F.col("x")).alias("n")).collect()
        assert [r["e"] for r in got] == [None if v is None else plain(v) for (v,) in rows] and [r["d"] for r in got] == [v for (v,) in rows]
        assert [r["n"] for r in got] == [None] * 4
    tracemalloc.start()
    made = codecs.column_of((bytes(1 << 16) for _ in range(512)), 512)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.nbytes > 32 << 20 and most < 44 << 20  # a list of the values and the column were 64 MB


def test_rules_by_table_move_no_articles(spark):
    """A frequent group's articles stay where they are or are dealt; both give the same scores."""
    rows = [("en", f"The {k}") for k in range(300)] + [("fr", "La"), ("fr", None), (None, "The"), ("xx", "The")]
    arts = spark.createDataFrame(rows, "group string, subject string").withColumn("text", F.col("subject"))
    table = spark.createDataFrame([("en", "The", 10), ("e.*", "the .*1", 2), ("(fr|es)", "La", 5)], "group_regex string, regex string, score int")
    want = {("en", f"The {k}"): 12 if "1" in str(k) else 10 for k in range(300)} | {("fr", "La"): 5, (None, "The"): 0, ("xx", "The"): 0}
    few, many = rules.by_table(arts, table), rules.by_table(arts, table, most=1)
    for got in (few, many):
        assert got.columns == ["group", "subject", "text", "score"]
        scores = {(r["group"], r["subject"]): r["score"] for r in got.collect()}
        assert scores.pop(("fr", None)) in (0, None) and scores == want
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group" in many._jdf.queryExecution().executedPlan().toString()
