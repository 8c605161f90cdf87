"""Every query with SQL against DuckDB on sf0.001, and golden cases of the functions."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.functions import codecs, text
from threadloom.operators import rules, search
from threadloom.plans import library  # noqa: F401
from threadloom.plans.catalogue import ORACLE_SQL, QUERIES
from threadloom.sources import readers

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    return sorted(tuple(str(r[c]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf)
    rows = [r.asDict() for r in got.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(rows, columns) == plain([dict(zip(columns, r, strict=True)) for r in want.fetchall()], columns)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "want"), [("1K", 1024), ("1KB", 1024), ("1Kb", 1000), ("0J", None), ("", None), (" 2 M ", 2 << 20), ("7", 7), (None, None)])
def test_size_bytes(spark, given, want):
    assert one(spark, text.size_bytes, given) == want


@pytest.mark.parametrize(("given", "want"), [(0, "0.00B"), (1024, "1.00KB"), (1024**4, "1.00TB"), (None, None)])
def test_size_text(spark, given, want):
    assert one(spark, text.size_text, given, "long") == want


@pytest.mark.parametrize(("given", "want"), [("a.b", "alt.binaries"), ("alt.b.sounds", "alt.b.sounds"), ("% &", None), ("A..B.s", "alt.binaries.sounds")])
def test_group(spark, given, want):
    assert one(spark, lambda c: text.normal_group(c, text.SHORTHAND), given) == want


@pytest.mark.parametrize(("given", "want"), [("test.tar.gz", ".tar.gz"), ("test.pdf.vol03+4.par2", ".pdf.vol03+4.par2"), ("test.part00.7z.vol03+4.par2", ".part00.7z.vol03+4.par2"), ("test", "")])
def test_extension(spark, given, want):
    assert one(spark, text.extension, given) == want


def test_subject(spark):
    x = one(spark, text.subject_parts, 'description [1/2] - "filename" yEnc (3/4)')
    assert tuple(x) == ("description", "filename", 1, 2, 3, 4, None)
    assert one(spark, text.subject_parts, "nothing of the kind") is None


def test_article_lines(spark):
    line = "\t".join(["12929673602", "subj", "Me <a@b>", "mercredi, 23 jul 2014 20:01:02 -0600", "<id@host>", "", "338850", "5363", "Xref: news a.b:1 c.d:2 e.f:x g.h:4"])
    r = readers.article_lines(spark.createDataFrame([(line,), ("",), ("short\tline",)], "value string")).collect()
    assert len(r) == 1 and r[0]["id"] == "id@host" and r[0]["article_no"] == 12929673602 and r[0]["posted"] == dt.datetime(2014, 7, 24, 2, 1, 2)
    assert (r[0]["size"], r[0]["lines"], r[0]["xgroups"]) == (338850, 5363, {"a.b": 1, "c.d": 2, "e.f": 0, "g.h": 4})
    assert r[0]["host"] == "news"


@pytest.mark.parametrize(("line", "want"), [("alt.binaries.l2g 0 0 y", (0, 0, 0, ["y"])), ("alt.binaries.l2g 400 12 y", (400, 12, 388, ["y"])), ("alt.binaries.l2g 400 40", (400, 40, 360, [])), ("alt.binaries.l2g 500 499 y", (500, 499, 0, ["y"])), ("a.b -1 2 y", None), ("a.b x y", None), ("", None)])
def test_group_lines(spark, line, want):
    rows = readers.group_lines(spark.createDataFrame([(line,)], "value string")).collect()
    assert (tuple(rows[0])[1:] if rows else None) == want


def test_headers(spark):
    block = "\nmessage-id: <1@x>\nmy-identifier: a\n\tb\nMy-Identifier: c\n\nbody: no"
    got = readers.headers(spark.createDataFrame([(1, block)], "id int, value string")).first()["headers"]
    assert got == {"Message-ID": "<1@x>", "X-My-Identifier": "a b,c"}


def test_manifest(spark, tmp_path):
    xml = '<?xml version="1.0"?><nzb xmlns="x"><file poster="p" date="1" subject="s"><groups><group>a.b</group></groups><segments><segment bytes="10">one</segment><segment bytes="-3">two</segment></segments></file></nzb>'
    (tmp_path / "a.nzb").write_text(xml)
    row = readers.manifest(spark, str(tmp_path / "a.nzb")).first()
    assert [tuple(s) for s in row["segments"]] == [(1, 10, "one"), (2, 0, "two")] and row["groups"] == ["a.b"]
    readers.write_manifest(readers.manifest(spark, str(tmp_path / "a.nzb")), str(tmp_path / "out"))
    assert [tuple(s) for s in readers.manifest(spark, str(tmp_path / "out")).first()["segments"]] == [(1, 10, "one"), (2, 0, "two")]


def test_rule_file(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("BS .* bad words",), ("SS=+10 alt\\.x good",), ("nonsense",)], "value string")
    got = [tuple(r) for r in rules.parse_lines(lines).collect()]
    assert got == [("B", "S", None, None, ".*", "bad words"), ("S", "S", "=", 10, "alt\\.x", "good")]
    with pytest.raises(ValueError):
        rules.Rule("", {"size_above": 1})


@pytest.mark.parametrize(("subject", "score", "kept"), [('"show.mkv" yEnc', 25, True), ('"a.mkv.001" y', 25, True), ('"x.jpg" y', 15, True), ("x.r07 y", 25, True), ('"x.par2" y', 10, True), ("run.exe now", 0, False), ("x.exe-notes", 0, True), *((f'"what.a.show.{e}" y', 0, False) for e in "exe pif application gadget msi msp com scr hta cpl msc jar bat vb vbs vbe js jse ws wsf ps1 ps1xml ps2 ps2xml psc1 psc2 msh msh1 msh1xml msh2 msh2xml scf lnk inf reg".split())])
def test_preset(spark, subject, score, kept):
    df = spark.createDataFrame([("alt.binaries.x", subject)], "group string, subject string")
    rows = rules.apply(df, rules.PRESET_SCORES, black=rules.PRESET_BLACK).collect()
    assert ([r["score"] for r in rows] == [score]) == kept


def test_search_parse():
    assert search.parse(["a", "-b", "%c", "-%d", "\\-e"]) == [("+", "subject", "a"), ("-", "subject", "b"), ("+", "poster", "c"), ("-", "poster", "d"), ("+", "subject", "-e")]


def test_codecs():
    data = bytes(range(256)) * 5
    assert codecs.unyenc(codecs.yenc(data)) == data and codecs.unuu(codecs.uu(data)) == data
    assert codecs.unyenc(codecs.yenc(data).replace(b"size=1280", b"size=9")) is None and codecs.unuu(b"no block") is None


def test_stream(spark, tmp_path):
    from threadloom.streaming import ingest

    (tmp_path / "in").mkdir()
    line = lambda n, s: "\t".join([str(n), s, "p", "1 Jan 2020 00:00:00 +0000", f"<{n}@x>", "", "1", "1", ""])
    (tmp_path / "in/1.txt").write_text("\n".join(line(n, "a") for n in range(100)))
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), "g")
    run()
    run()
    assert ingest.articles(spark, str(tmp_path / "t")).count() == 100
    (tmp_path / "in/2.txt").write_text("\n".join(line(n, "b") for n in range(50, 150)))
    run()
    got = ingest.articles(spark, str(tmp_path / "t"))
    assert got.count() == 150 and got.filter("subject = 'b'").count() == 100
