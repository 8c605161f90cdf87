"""Queries on names, posts, manifests, catalogues and states, with SQL or the values that are known to be right.

Tables stand for articles as in ``catalogue``: ``conversations`` are posts with their segments, ``events`` the index
by time, ``orders`` the posts with states, ``supplier`` the servers. Names of files occur in no table, so functions of
names run on given names; their SQL lists the results that are known for them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import codecs, dates, text
from threadloom.operators import catalog, posts, rules, scan
from threadloom.plans.catalogue import articles, query, table
from threadloom.sources import readers, sinks
from threadloom.streaming import ingest


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    return str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"


def known(columns: str, rows: list[tuple], kinds: str) -> str:
    """SQL of given rows with typed columns."""
    names = columns.split()
    typed = ", ".join(f'CAST("{n}" AS {k}) AS "{n}"' for n, k in zip(names, kinds.split(), strict=True))
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(f'"{n}"' for n in names)})"


#: Names with the extension and the type that are known for them.
NAMES = [
    ("test.tar.gz", ".tar.gz", "application/tar+gzip"), ("test.tgz", ".tgz", "application/tar+gzip"), ("test.tar.bz2", ".tar.bz2", "application/tar+bzip2"), ("test.tar.xz", ".tar.xz", "application/tar+xz"),
    ("b2d3.vol000+01.par2", ".vol000+01.par2", "application/x-par2"), ("b2d3.32", ".32", "application/octet-stream"), ("test.pdf.vol03+4.par2", ".pdf.vol03+4.par2", "application/x-par2"),
    ("test.tar.gz.vol03+4.par2", ".tar.gz.vol03+4.par2", "application/x-par2"), ("A.Great.File-We.All.Want.2017.pdf.par2", ".pdf.par2", "application/x-par2"), ("test.part00.7z", ".part00.7z", "application/x-7z-compressed"),
    ("test.part00.7z.vol03+4.par2", ".part00.7z.vol03+4.par2", "application/x-par2"), ("test", "", "application/octet-stream"), ("show.name.mkv", ".mkv", "video/x-matroska"), ("my.holiday.pics.jpg", ".jpg", "image/jpeg"),
    ("a.z01", ".z01", "application/zip"), ("a.r07", ".r07", "application/x-rar-compressed"), ("picture.JPEG", ".JPEG", "image/jpeg"), ("a.longer.name.test.nzb", ".nzb", "text/x-nzb"), ("x.bz2", ".bz2", "application/x-bzip2"),
    ("notes.nfo", ".nfo", "text/plain"), ("clip.mpeg", ".mpeg", "video/mpg"), ("setup.exe", ".exe", "application/x-dosexec"), ("page.shtml", "", "text/html"), ("tune.mp3", ".mp3", "audio/mpeg"),
]


def given(spark, rows: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


@query(known("name ext", [r[:2] for r in NAMES], "VARCHAR VARCHAR"))
def ext_from_name(spark, sf_dir):
    return given(spark, [r[:1] for r in NAMES], "name string").select("name", text.extension(F.col("name")).alias("ext"))


@query(known("name mime", [(r[0], r[2]) for r in NAMES], "VARCHAR VARCHAR"))
def mime_from_name(spark, sf_dir):
    return given(spark, [r[:1] for r in NAMES], "name string").select("name", text.type_of_name(F.col("name")).alias("mime"))


TYPE_EXTENSIONS = [("application/x-rar-compressed", ".rar"), ("application/tar+gzip", ".tar.gz"), ("image/jpeg", ".jpeg"), ("video/mpg", ".mpg"), ("application/octet-stream", ""), ("none/such", None)]


@query(known("mime ext", TYPE_EXTENSIONS, "VARCHAR VARCHAR"))
def ext_from_mime(spark, sf_dir):
    return given(spark, [r[:1] for r in TYPE_EXTENSIONS], "mime string").select("mime", text.extension_of_type(F.col("mime")).alias("ext"))


PARTED = [("a.part03.rar", "rar", 3, None), ("a.r12", "rar", 12, None), ("a.rar", "rar", None, None), ("a.part01.7z", "7z", 1, None), ("a.7z.002", "7z", 2, None), ("a.7z", "7z", None, None), ("a.vol03+4.par2", "par2", 3, 4), ("a.par2", "par2", None, None), ("a.txt", None, None, None)]


@query(known("name family part blocks", PARTED, "VARCHAR VARCHAR INTEGER INTEGER"))
def multipart_names(spark, sf_dir):
    return given(spark, [r[:1] for r in PARTED], "name string").select("name", text.part_of_name(F.col("name")).alias("x")).select("name", "x.family", "x.part", "x.blocks")


#: Subjects with description, name, index, count, part, parts, size.
SUBJECTS = [
    ('description [1/2] - "filename" yEnc (3/4)', "description", "filename", 1, 2, 3, 4, None), ('description - "filename" yEnc (1/2)', "description", "filename", None, None, 1, 2, None),
    ("description - filename yEnc (3/4)", "description", "filename", None, None, 3, 4, None), ('"description" - filename yEnc (5/6) 13450', "description", "filename", None, None, 5, 6, 13450),
    ('"description" - filename yEnc (/1)', "description", "filename", None, None, None, 1, None), ('"filename" yEnc (1/2)', None, "filename", None, None, 1, 2, None), ('"filename" yEnc (/2)', None, "filename", None, None, None, 2, None),
    ("filename yEnc (1/2)", None, "filename", None, None, 1, 2, None), ("filename yEnc (/2)", None, "filename", None, None, None, 2, None), ("no file here", None, None, None, None, None, None, None),
]


@query(known("subject descr fname index count part parts size", SUBJECTS, "VARCHAR VARCHAR VARCHAR INTEGER INTEGER INTEGER INTEGER BIGINT"))
def subject_golden(spark, sf_dir):
    return given(spark, [r[:1] for r in SUBJECTS], "subject string").select("subject", text.subject_parts(F.col("subject")).alias("x")).select("subject", "x.*")


#: Subjects, attached names and bases with the name that a file gets.
RESOLVED = [
    ('"my test file" - testfile.rar yEnc (1/1)', "file.rar", None, "file.rar"), ('"my test file" - testfile.rar yEnc (1/1)', "file.rar", "mytest", "mytest.rar"), ('"my test file" - testfile.jpeg yEnc (1/1)', "file.tmp", None, "testfile.jpeg"),
    ('"my test file" - testfile.jpeg yEnc (1/1)', "file.tmp", "", "testfile.jpeg"), ('"my test file" - testfile.jpeg yEnc (1/1)', "file.tmp", "mytest", "mytest.jpeg"), ("", "file.tmp", None, "file.tmp"), ("", "file.tmp", "abcd", "abcd.tmp"),
    ('"a garbage unparseable subject', "file.rar", None, "file.rar"), ('"a garbage unparseable subject', "file.tmp", None, "file.tmp"), ('"my greatest picture" - l2g.png yEnc (1/1)', "file.rar", None, "file.rar"), ("nothing", "nothing", None, None),
]


@query(known("subject attached base name", RESOLVED, "VARCHAR VARCHAR VARCHAR VARCHAR"))
def filename_resolve(spark, sf_dir):
    rows = given(spark, [r[:3] for r in RESOLVED], "subject string, attached string, base string")
    return rows.select("*", text.resolved_name(F.col("subject"), F.col("attached"), F.col("base")).alias("name"))


GROUPS = [("a.b", "alt.binaries"), ("ab", "alt.binaries"), ("abs", "alt.binaries.sounds"), ("alt.b.sounds", "alt.b.sounds"), ("a.binaries.sounds", "alt.binaries.sounds"), ("  alt.binaries.TEST  ", "alt.binaries.test"), ("% &  ", None), ("", None), ("a.b.p.e", "alt.binaries.pictures.erotica"), ("A.B.Test", "alt.binaries.test"), ("warez", "alt.binaries.warez")]


@query(known("given name", GROUPS, "VARCHAR VARCHAR"))
def group_shorthand(spark, sf_dir):
    return given(spark, [r[:1] for r in GROUPS], "given string").select("given", text.normal_group(F.col("given"), text.SHORTHAND).alias("name"))


@query("SELECT doc_id, lang || ',' || source AS groups FROM documents")
def group_list_split(spark, sf_dir):
    names = text.group_list(F.concat_ws(", ", "lang", "source", F.upper("lang"), F.lit("%&")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(names, ",").alias("groups"))


@query("SELECT r_regionkey, r_name FROM region WHERE contains(lower(r_name), 'asi') OR regexp_matches(r_name, '^A.*A$') ORDER BY r_name")
def group_filter(spark, sf_dir):
    return table(spark, sf_dir, "region").filter(catalog.named_like(["asi", ("regex", "^A.*A$")], "r_name")).select("r_regionkey", "r_name").orderBy("r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name")
def watched_listing(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumn("watch", F.col("c_mktsegment") == "BUILDING").filter("watch").select("c_custkey", "c_name").orderBy("c_name")


@query("SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber <> 2) AS kept, count(*) FILTER (WHERE l_linenumber NOT IN (2, 3)) AS bare FROM lineitem GROUP BY 1")
def manifest_mode(spark, sf_dir):
    name = F.when(F.col("l_linenumber") == 2, F.lit("a.vol00+1.PAR2")).when(F.col("l_linenumber") == 4, F.lit("noname")).otherwise(F.concat(F.lit("a.r"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", name.alias("name"), (F.col("l_linenumber") == 3).alias("attached"))
    kept = lambda mode: F.count(F.when(posts.wanted_by_mode(F.col("name"), F.col("attached"), mode), 1))
    return rows.groupBy("l_orderkey").agg(kept(posts.IGNORE_PARS).alias("kept"), kept(posts.IGNORE_PARS | posts.IGNORE_ATTACHED).alias("bare"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0")
def nuked_articles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    headers = F.when(F.col("toxic") == 1, F.create_map(F.lit("Subject"), F.lit("s"), F.lit("X-DMCA-Notice"), F.lit("y"))).otherwise(F.create_map(F.lit("Subject"), F.lit("s")))
    return rows.filter(~posts.nuked(headers)).select("doc_id")


@query("""SELECT o_orderkey, code, (code BETWEEN 200 AND 399) AS good, code IN (111,200,201,203,205,211,223,235,238,239,240,250,281,290) AS plain, CASE WHEN code IN (430, 435) THEN 1 ELSE 0 END AS gone
 FROM (SELECT o_orderkey, CAST([200, 211, 224, 340, 430, 435, 502][1 + o_orderkey % 7] AS INTEGER) AS code FROM orders)""")
def response_success(spark, sf_dir):
    code = F.get(F.lit([200, 211, 224, 340, 430, 435, 502]), (F.col("o_orderkey") % 7).cast("int")).cast("int")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))
    c = F.col("code")
    return rows.select("o_orderkey", "code", posts.succeeded(c).alias("good"), posts.succeeded(c, False).alias("plain"), F.array_contains(posts.response_classes(c), "no_article").cast("int").alias("gone"))


@query("SELECT conv_id, bool_and(length(text) > 0 AND role IN ('user', 'assistant', 'system')) AS valid, bool_or(role = 'assistant') AS answered, arg_min(role, turn) AS opens FROM conversations GROUP BY 1")
def post_validity(spark, sf_dir):
    part = F.struct("turn", (F.coalesce((F.length("text") > 0) & F.col("role").isin("user", "assistant", "system"), F.lit(False))).alias("valid"), "role")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("conv_id", posts.all_valid(F.col("parts")).alias("valid"), F.exists("parts", lambda p: p["role"] == "assistant").alias("answered"), F.get("parts", 0)["role"].alias("opens"))


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\t\\n\\r -~]') AS ascii FROM documents")
def ascii_articles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", posts.is_ascii(F.col("text")).alias("ascii"))


STATES = "SELECT o_orderkey, o_orderdate AS staged, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY END AS posted, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 DAY END AS verified FROM orders"


def states(spark, sf_dir) -> DataFrame:
    after = lambda ok, d: F.when(ok, F.col("o_orderdate") + F.expr(f"INTERVAL {d} DAY"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("staged"), after(F.col("o_orderstatus") != "O", 1).alias("posted"), after(F.col("o_orderstatus") == "F", 2).alias("verified"))


@query(f"SELECT o_orderkey, CASE WHEN posted IS NULL THEN 'post' WHEN verified IS NULL THEN 'verify' END AS todo FROM ({STATES})")
def pending_work(spark, sf_dir):
    return posts.pending(states(spark, sf_dir)).select("o_orderkey", "todo")


@query(f"""SELECT o_orderkey, staged, coalesce(posted, TIMESTAMP '2030-01-01 00:00:00') AS posted, verified IS NOT NULL OR (posted IS NOT NULL AND o_orderkey % 2 = 0) OR (posted IS NULL AND o_orderkey % 2 = 0) AS done FROM ({STATES})""")
def state_machine(spark, sf_dir):
    now = states(spark, sf_dir).withColumnRenamed("o_orderkey", "id")
    event = lambda kind, at, cond="true": now.filter(cond).select("id", F.lit(kind).alias("kind"), F.lit(at).cast("timestamp_ntz").alias("at"))
    events = event("posted", "2030-01-01 00:00:00").unionByName(event("posted", "2031-01-01 00:00:00")).unionByName(event("verified", "2030-01-02 00:00:00", "id % 2 = 0"))
    moved = posts.moved_on(posts.moved_on(now, events), events)  # a replay changes nothing
    return moved.select(F.col("id").alias("o_orderkey"), "staged", "posted", F.col("verified").isNotNull().alias("done"))


@query("SELECT o_orderkey, o_custkey, s.s_name FROM orders JOIN supplier s ON s.s_suppkey = 1 + o_custkey % 10 AND s.s_nationkey % 2 = o_orderkey % 2")
def two_key_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 10 + 1).alias("server"), (F.col("o_orderkey") % 2).alias("half"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("server"), (F.col("s_nationkey") % 2).alias("half"), "s_name")
    return o.join(s, ["server", "half"]).select("o_orderkey", "o_custkey", "s_name")


@query("""SELECT c_custkey, CASE WHEN count(found) = 0 THEN 'unknown' WHEN bool_or(found) THEN 'here' ELSE 'missing' END AS state FROM customer LEFT JOIN (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS found FROM orders WHERE o_totalprice > 400000) ON o_custkey = c_custkey GROUP BY 1""")
def stat_with_backups(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("found"))
    return catalog.stated(table(spark, sf_dir, "customer").select("c_custkey"), answers, "c_custkey")


@query("""SELECT conv_id AS file, turn AS number, CASE WHEN turn % 3 <> 1 THEN 1 WHEN turn % 2 = 1 THEN 2 END AS server, CASE WHEN turn % 3 <> 1 OR turn % 2 = 1 THEN substr(text, 1, 100) END AS content FROM conversations""")
def fetch_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("@", "conv_id", "turn"))
    wanted = c.select(F.col("conv_id").alias("file"), F.col("turn").alias("number"), "id")
    held = lambda server, cond: c.select("id", F.lit(server).alias("server"), F.lit(server).alias("priority"), F.when(cond, F.col("text")).alias("content"))
    stored = held(2, F.col("turn") % 2 == 1).unionByName(held(1, F.col("turn") % 3 != 1))
    return catalog.fetched(wanted, stored, 100).select("file", "number", "server", "content")


@query("SELECT doc_id, lpad(CAST(n_chars AS VARCHAR), 5, '0') || '/' || source || '/' || CASE WHEN doc_id % 2 = 0 THEN '00007' ELSE '/' END AS key FROM documents WHERE n_chars < 100000")
def content_order(spark, sf_dir):
    part = F.when(F.col("doc_id") % 2 == 0, F.lit(7))
    return table(spark, sf_dir, "documents").filter("n_chars < 100000").select("doc_id", posts.content_key(F.col("n_chars"), F.col("source"), part).alias("key"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY n ASC NULLS FIRST, o_orderpriority ASC, o_orderkey) AS pos FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 7 END AS n FROM orders WHERE o_orderkey <= 400) QUALIFY pos <= 100")
def post_sort(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").filter("o_orderkey <= 400").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 7).alias("sort_no"), F.col("o_orderpriority").alias("filename"))
    first = rows.orderBy(*posts.post_order(), "o_orderkey").limit(100)  # a top of the list
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*posts.post_order(), "o_orderkey")).cast("long").alias("pos"))


@query("SELECT doc_id, 'Subject: ' || n_chars || chr(13) || chr(10) || 'From: ' || source || chr(13) || chr(10) || 'X-Lang: ' || lang AS head FROM documents")
def header_print(spark, sf_dir):
    head = F.create_map(F.lit("X-Lang"), F.col("lang"), F.lit("From"), F.col("source"), F.lit("Subject"), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", posts.printed(head).alias("head"))


@query("SELECT arg_min(o_orderkey, o_orderkey) AS first_key, min(o_orderdate) AS first_date FROM orders WHERE o_orderstatus = 'P'")
def first_row(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    return rows.agg(F.min("o_orderkey").alias("first_key"), F.min("o_orderdate").alias("first_date"))


@query("SELECT conv_id, list_extract(list(role ORDER BY turn), CAST(least(count(*), 3) AS INTEGER)) AS third, arg_max(role, turn) AS last, CAST(count(*) FILTER (WHERE turn < 2) AS INTEGER) AS before FROM conversations GROUP BY 1")
def array_places(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    roles, turns = F.transform("x", lambda s: s["role"]), F.transform("x", lambda s: s["turn"])
    return rows.select("conv_id", posts.placed(roles, F.lit(2)).alias("third"), posts.placed(roles, F.lit(-1)).alias("last"), posts.bisect_left(turns, F.lit(2)).alias("before"))


@query("SELECT p_brand, CASE p_size % 3 WHEN 0 THEN 'application/x-rar-compressed' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS type, max(p_partkey) AS no FROM part GROUP BY 1, 2")
def last_by_type(spark, sf_dir):
    ending = F.when(F.col("p_size") % 3 == 0, ".rar").when(F.col("p_size") % 3 == 1, ".jpg").otherwise("")
    names = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("no"), F.concat(F.lit("f"), "p_partkey", ending).alias("name"))
    return posts.last_by_type(names, "p_brand").select("p_brand", "type", "no")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND lang <> 'fr'")
def membership(spark, sf_dir):
    groups = F.create_map(F.col("lang"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").filter(F.map_contains_key(groups, F.lit("en")) & F.col("lang").isin("en", "fr")).select("doc_id")


@query("SELECT doc_id, lang, md5(text) = md5(text || '') AND doc_id % 5 <> 0 AS intact FROM documents")
def checksum_gate(spark, sf_dir):
    told = F.sha1(F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("?")).otherwise(F.lit(""))))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", posts.intact(F.col("text"), told).alias("intact"))


@query("SELECT o_orderkey, CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS epoch, strftime(o_orderdate, '%Y-%m-%d %H:%M (%j)') AS told, CAST(1.5 AS DOUBLE) AS seconds FROM orders")
def date_scalars(spark, sf_dir):
    at = F.col("o_orderdate")
    later = dates.from_epoch(dates.to_epoch(at).cast("long") + 1) + F.expr("INTERVAL 500 MILLISECONDS")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.to_epoch(at).alias("epoch"), dates.formatted(at, "%Y-%m-%d %H:%M (%j)").alias("told"), dates.elapsed(at, later).alias("seconds"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 12:00:01'")
def date_bounds(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(dates.within(F.col("ts"), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12))).select("event_id")


def index(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("article_no"), F.col("ts").alias("posted"), F.col("user_id").cast("string").alias("poster"), F.col("event_type").alias("group"))


@query("SELECT event_id AS article_no FROM events WHERE event_id BETWEEN 50 AND 700 AND ts >= TIMESTAMP '2024-01-02 00:00:00' AND event_type = 'click' AND 50 >= (SELECT min(event_id) FROM events WHERE event_type = 'click') AND 700 <= (SELECT max(event_id) FROM events WHERE event_type = 'click')")
def xover_dates(spark, sf_dir):
    rows = scan.xover(index(spark, sf_dir), 50, 700, since=dt.datetime(2024, 1, 2), group="click")
    return rows.unionByName(scan.xover(index(spark, sf_dir), 700, 50)).unionByName(scan.xover(index(spark, sf_dir), 0, 1 << 40)).select("article_no")


@query("SELECT event_id AS article_no FROM events WHERE event_id < 400 ORDER BY event_id DESC LIMIT 25")
def previous_page(spark, sf_dir):
    return scan.page(index(spark, sf_dir), 400, -25).select("article_no")


@query("""SELECT event_id AS article_no, user_id || '' AS poster, 10 AS score, lpad(CAST(event_id AS VARCHAR), 10, '0') AS sort_key FROM events WHERE event_type <> 'error' OR event_id % 10 = 0""")
def stream_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = lambda no, subject: F.concat_ws("\t", no.cast("string"), subject, F.col("user_id").cast("string"), F.lit("1 Jan 2020 00:00:00 +0000"), F.concat(F.lit("<"), F.col("event_id").cast("string"), F.lit("@x>")), F.lit(""), F.lit("5"), F.lit("1"), F.concat(F.lit("Xref: h g:"), no.cast("string")))
    subject = F.concat("event_type", F.when(F.col("event_id") % 10 == 0, F.lit(" keep")).otherwise(F.lit("")))
    lines = e.select(line(F.col("event_id"), subject).alias("value")).unionByName(e.filter("event_id % 7 = 0").select(line(F.col("event_id"), subject).alias("value"))).unionByName(e.limit(1).select(F.lit("broken").alias("value")))
    scores, white, black = [rules.Rule("g.*", {"subject_regex": ".*"}, 10)], [rules.Rule("g.*", {"subject_ends": "keep"})], [rules.Rule("g.*", {"subject_starts": "error"})]
    return scan.decoded(lines, "g", scores, white, black).select("article_no", "poster", "score", "sort_key")


@query("SELECT o_orderpriority, o_orderkey, CAST(sum(1) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pos FROM orders")
def numbering_in_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey")
    return posts.running_total(rows, ["o_orderpriority"], ["o_orderkey"], F.lit(1).cast("long"), F.floor(F.col("o_orderkey") / 1000), "pos")


@query("SELECT c_nationkey, c_custkey % 4 AS server, min(c_custkey) AS low, max(c_custkey) AS high, count(*) AS count FROM customer GROUP BY ALL")
def marks_by_server(spark, sf_dir):
    return catalog.watermarks(table(spark, sf_dir, "customer").withColumn("server", F.col("c_custkey") % 4), ["c_nationkey", "server"], "c_custkey")


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 ELSE n_nationkey END AS count, n_regionkey = 1 AS watch FROM nation UNION ALL SELECT 'NEW' || n_nationkey, n_nationkey * 10, NULL FROM nation WHERE n_nationkey < 3""")
def group_catalogue_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("count"), (F.col("n_regionkey") == 1).alias("watch"))
    told = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("count")).unionByName(n.filter("n_nationkey < 3").select(F.concat(F.lit("NEW"), "n_nationkey").alias("name"), (F.col("n_nationkey") * 10).alias("count")))
    return catalog.changed(old, told, ["name"])


@query("""SELECT 'g' AS "group", n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'unset' WHEN n_nationkey % 3 = 1 THEN 'new' ELSE 'old' END AS value FROM nation""")
def settings_upsert(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.lit("g").alias("group"), F.col("n_name").alias("key"), (F.col("n_nationkey") % 3).alias("r"))
    pairs, changes = n.select("group", "key", F.lit("old").alias("value")), n.filter("r < 2").select("group", "key", F.when(F.col("r") == 1, F.lit("new")).alias("value"))
    return catalog.setting(n.select("group", "key", F.lit("unset").alias("default")), catalog.settled(pairs, changes))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM lineitem WHERE l_orderkey % 2 = 1 OR l_linenumber <= 2")
def children_replace(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    new = li.filter("l_linenumber <= 2").withColumn("version", F.lit("new"))
    return catalog.children_replaced(li.withColumn("version", F.lit("old")), new, "l_orderkey", li.filter("l_orderkey % 2 = 0").select("l_orderkey"))


@query("""SELECT role AS poster, 'f' || conv_id || '.bin' AS fname, CAST(count(*) + 1 AS INTEGER) AS parts, count(*) AS held, CAST(sum(length(text)) AS BIGINT) AS bytes, false AS complete FROM conversations GROUP BY role, conv_id""")
def manifests_from_articles(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("role", "conv_id")
    rows = c.select("role", "conv_id", "turn", F.length("text").cast("long").alias("size"), F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("turn")).alias("i"))
    subject = F.format_string('post %d - "f%d.bin" yEnc (%d/%d)', "conv_id", "conv_id", "i", F.col("n") + 1)
    arts = rows.select(F.concat_ws("@", "conv_id", "turn").alias("id"), F.col("role").alias("poster"), F.lit(dt.datetime(2020, 1, 1)).alias("posted"), subject.alias("subject"), "size", F.lit("g").alias("group"))
    twice = arts.unionByName(arts.withColumn("id", F.concat("id", F.lit("~")))).unionByName(arts.withColumn("subject", F.lit("chat only")))
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda acc, s: acc + s["bytes"])
    return posts.manifests(twice).select("poster", "fname", "parts", F.size("segments").cast("long").alias("held"), total.alias("bytes"), "complete")


@query("SELECT doc_id, md5(text) AS md5, 3 AS parts, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents WHERE octet_length(encode(text)) >= 3")
def yenc_multipart(spark, sf_dir):
    raw, n = F.encode(F.col("text"), "UTF-8"), F.octet_length("text")
    d = table(spark, sf_dir, "documents").filter(n >= 3).select("doc_id", raw.alias("raw"), n.cast("long").alias("n"))
    cut = d.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumns({"begin": F.floor((F.col("p") - 1) * F.col("n") / 3), "finish": F.floor(F.col("p") * F.col("n") / 3)})
    block = codecs.yenc_encode_part(F.substring("raw", F.col("begin").cast("int") + 1, (F.col("finish") - F.col("begin")).cast("int")), F.concat(F.lit("f"), "doc_id"), F.col("p"), F.lit(3), F.col("begin"), F.col("n"))
    back = cut.select("doc_id", codecs.yenc_parts(block).alias("x")).filter("x.ok").select("doc_id", "x.*")
    whole = back.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "content"))).alias("c"), F.count("*").cast("int").alias("parts"), F.max("size").alias("bytes"))
    content = F.aggregate("c", F.lit(b""), lambda acc, s: F.concat(acc, s["content"]))
    return whole.select("doc_id", F.md5(content).alias("md5"), "parts", "bytes")


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def encoder_chain(spark, sf_dir):
    raw = F.encode(F.col("text"), "UTF-8")
    there = codecs.chained(raw, [codecs.yenc_encode, codecs.uu_encode])
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(codecs.chained(there, [codecs.uu_decode, codecs.yenc_decode])).alias("md5"))


@query("SELECT conv_id, string_agg(rtrim(replace(text, chr(10), ' '), ' ' || chr(9)) || chr(13) || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY 1")
def ascii_body(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(" \t")).alias("line")))).alias("x"))
    return rows.select("conv_id", posts.ascii_body(F.transform("x", lambda s: s["line"])).alias("body"))


@query("SELECT doc_id, 'base/' || lang || '/x' AS path, '/a/b c' AS p1, '/d' AS p2 FROM documents")
def mask_and_paths(spark, sf_dir):
    masks = {"work": "%{base}/%{kind}", "base": "base", "kind": "LANG"}
    path = F.replace(text.masked(F.lit("%{WORK}/x"), masks), F.lit("LANG"), F.col("lang"))
    paths = text.path_list(F.concat(F.lit("//a//b c/, /d//, /a/b c")))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.get(paths, 0).alias("p1"), F.get(paths, 1).alias("p2"))


URLS = [
    ("http://user:pw@Host.org:8080/a//b/c.txt?X=1&y=a%20b", "http", "user", "pw", "Host.org", 8080, "/a/b/c.txt", "/a/b/", "c.txt", "http://user:pw@Host.org:8080/a/b/c.txt"), ("host", "http", None, None, "host", None, None, None, None, "http://host"),
    ("nntps://h.x/", "nntps", None, None, "h.x", None, "/", "/", None, "nntps://h.x/"), ("ftp://me@h:0/p", "ftp", "me", None, "h", None, "/p", "/", "p", "ftp://me@h/p"), ("", None, None, None, None, None, None, None, None, None),
]


@query(known("given schema user password host port fullpath path query url", URLS, "VARCHAR VARCHAR VARCHAR VARCHAR VARCHAR INTEGER VARCHAR VARCHAR VARCHAR VARCHAR").replace(" user ", ' "user" ').replace(" user,", ' "user",').replace("CAST(user", 'CAST("user"'))
def url_fields(spark, sf_dir):
    return given(spark, [r[:1] for r in URLS], "given string").select("given", text.url_parts(F.col("given")).alias("x")).select("given", "x.*").drop("qsd")


@query("SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM documents")
def bytes_running_total(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return posts.running_total(rows, ["lang"], ["doc_id"], F.col("n_chars"), F.floor(F.col("doc_id") / 1000)).select("doc_id", "total")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events")
def xover_by_time(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    return posts.running_total(rows, ["event_type"], ["ts", "event_id"], F.lit(1).cast("long"), F.date_trunc("DAY", "ts"), "pos").select("event_id", "pos")


@query("SELECT min(event_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-10 00:00:00') AS first_no, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS before FROM events")
def seek_by_date(spark, sf_dir):
    return scan.seek(index(spark, sf_dir), dt.datetime(2024, 1, 10))


HEX_SQL = "rtrim(regexp_replace(lower(hex(substr(text, 1, 16))), '(..)', '\\1 ', 'g'))"


@query(f"""SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 16.0) AS BIGINT) AS lines, '00000000:  ' || rpad(substr({HEX_SQL}, 1, 24) || ' ' || substr({HEX_SQL}, 25), 48, ' ') || '  |' || substr(text, 1, 16) || '|' AS head
 FROM documents WHERE regexp_matches(text, '^[ -~]{{16}}')""")
def hexdump_lines(spark, sf_dir):
    lines = F.split(text.hexdump(F.encode(F.col("text"), "UTF-8")), "\n")
    told = text.once(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), F.get(x, F.lit(0)).alias("head")))
    return table(spark, sf_dir, "documents").filter(F.col("text").rlike("^[ -~]{16}")).select("doc_id", told.alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN true WHEN n_chars % 3 = 1 THEN false END AS truth, lang || '|' || source AS items, 'a' || doc_id || '@h' AS id FROM documents")
def small_parsers(spark, sf_dir):
    word = F.get(F.lit(["Yes", "disabled", "perhaps"]), (F.col("n_chars") % 3).cast("int"))
    items = text.words_list(F.concat(F.lit("["), "lang", F.lit("; "), "source", F.lit(", "), "lang", F.lit("]")))
    return table(spark, sf_dir, "documents").select("doc_id", text.truth(word).alias("truth"), F.array_join(items, "|").alias("items"), text.message_id(F.concat(F.lit(" <a"), "doc_id", F.lit("@h> "))).alias("id"))


@query("SELECT doc_id, n_chars / 1024.0 >= 1 AS kilo, CASE WHEN n_chars < 1024 THEN n_chars || '.00B' END AS small FROM documents")
def size_text(spark, sf_dir):
    told = text.size_text(F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", told.rlike("^[0-9]+[.][0-9]{2}[KMGT]B$").alias("kilo"), F.when(F.col("n_chars") < 1024, told).alias("small"))


@query("SELECT doc_id, 'X-Doc-ID' AS k1, 'Message-ID' AS k2, text AS latin FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def header_keys_and_charset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"[^\x00-\x7F]"))
    key = lambda k: text.header_key(F.lit(k), readers.KNOWN_KEYS)
    return d.select("doc_id", key("doc-id").alias("k1"), key(" message-id").alias("k2"), text.from_charset(F.encode("text", "ISO-8859-1")).alias("latin"))


@query("SELECT 'doc' || doc_id AS doc, 'Subject' AS key, source AS value FROM documents UNION ALL SELECT 'doc' || doc_id, 'X-Lang', lang || ',' || lang FROM documents")
def header_blocks(spark, sf_dir):
    block = F.concat(F.lit("\r\n"), F.lit("subject: "), "source", F.lit("\r\nlang:  "), "lang", F.lit("\r\nX-Lang: "), "lang", F.lit("\r\n\r\nbody: no"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("doc"), block.alias("value"))
    return readers.headers(rows, "doc").select("doc", F.explode("headers").alias("key", "value"))


@query("""SELECT n_nationkey, lower(n_name) AS name, CAST(greatest(0, CASE WHEN n_nationkey * 3 - n_regionkey <= 1 THEN 0 ELSE n_nationkey * 3 - n_regionkey END) AS BIGINT) AS count, 'ym' AS flags FROM nation WHERE NOT contains(n_name, ' ')""")
def group_listing(spark, sf_dir):
    line = F.concat_ws(" ", "n_name", (F.col("n_nationkey") * 3).cast("string"), F.col("n_regionkey").cast("string"), F.lit("ym"))
    n = table(spark, sf_dir, "nation").filter(~F.col("n_name").contains(" "))
    got = readers.group_lines(n.select(line.alias("value")))
    return n.select("n_nationkey", F.lower("n_name").alias("group")).join(got, "group").select("n_nationkey", F.col("group").alias("name"), "count", F.array_join("flags", "").alias("flags"))


@query("SELECT r_regionkey, r_name, CASE r_regionkey % 2 WHEN 0 THEN 'image/png' ELSE 'application/zip' END AS by_content, 'application/zip' AS best FROM region WHERE r_regionkey % 2 = 1")
def type_from_content(spark, sf_dir):
    content = F.when(F.col("r_regionkey") % 2 == 0, F.unhex(F.lit("89504E470D0A"))).otherwise(F.unhex(F.lit("504B0304AA")))
    r = table(spark, sf_dir, "region").filter("r_regionkey % 2 = 1")
    return r.select("r_regionkey", "r_name", text.type_of_bytes(content).alias("by_content"), text.best_type(content, F.lit("x.png")).alias("best"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS score FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 <> 0")
def rule_file_lists(spark, sf_dir):
    lines = given(spark, [("# lists",), ("SP+2 .* even.*",), ("BS=0 .* three.*",), ("bad line",)], "value string")
    scores, white, black = rules.compiled(rules.parse_lines(lines).collect())  # rule files are a few lines
    d = articles(spark, sf_dir).select(F.col("article_no").alias("doc_id"), "group", F.when(F.col("article_no") % 3 == 0, "three").otherwise("x").alias("subject"), F.when(F.col("article_no") % 4 != 0, "even").otherwise("y").alias("poster"))
    return rules.apply(d, scores, white, black).select("doc_id", "score")


@query("SELECT n_name AS name, 'part ' || (n_nationkey % 3 + 1) || ' of 3: f' || (n_nationkey % 3) || '.bin (' || (n_nationkey % 3 + 1) || '.00KB of 6.00KB, first f0.bin) 2020-' || n_nationkey || ' x' AS title FROM nation")
def post_titles(spark, sf_dir):
    files = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("f"), i, F.lit(".bin")).alias("name"), ((i + 1) * 1024).cast("long").alias("size")))
    title = posts.titled("part {{index}} of {{count}}: {{filename}} ({{filesize}} of {{totalsize}}, first {{filename001}}{{none}}) %Y-{{key}} x", F.col("n_nationkey") % 3 + 1, files, F.lit(dt.datetime(2020, 5, 6)), {"key": F.col("n_nationkey")})
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), title.alias("title"))


@query("SELECT doc_id, '/' || lang || '/' || source || '/x' AS path FROM documents WHERE lang <> 'en' AND NOT (lang = 'fr' AND source = 'src1')")
def path_containment(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.lit(""), "lang", "source", F.lit("x")).alias("path"))
    return catalog.outside(paths, ["/en", "/fr/src1/", "/d"])


@query("SELECT doc_id, CAST(CASE WHEN n_chars % 100 > 50 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 + 1 < 3 THEN 10 ELSE 0 END + CASE WHEN starts_with(source, 'src1') AND suffix(source, '5') THEN 100 ELSE 0 END AS INTEGER) AS score FROM documents")
def rule_lines_and_crossposts(spark, sf_dir):
    groups = F.map_from_entries(F.transform(F.sequence(F.lit(0), (F.col("article_no") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("g"), i), i.cast("long"))))
    d = articles(spark, sf_dir).withColumns({"lines": F.col("size") % 100, "xgroups": groups})
    made = (rules.Rule(".*", {"lines_above": 50}, 1), rules.Rule(".*", {"crossposts_below": 3}, 10), rules.Rule(".*", {"poster_starts": "src1", "poster_ends": "5"}, 100), rules.Rule("none", {"crossposts_above": 0}, 1000))
    return rules.apply(d, made).select(F.col("article_no").alias("doc_id"), "score")


@query("""SELECT event_id AS article_no, event_type || CASE WHEN event_id % 5 = 0 THEN ' again' ELSE '' END AS subject, user_id || '' AS poster FROM events""")
def stream_ingest(spark, sf_dir):
    """Lines come in two files, some twice; the second run takes only what is new, and the newest row of an id stays."""
    root = sinks.scratch_dir(spark)
    line = lambda subject: F.concat_ws("\t", "event_id", subject, "user_id", F.lit("1 Jan 2020 00:00:00 +0000"), F.concat(F.lit("<"), "event_id", F.lit("@x>")), F.lit(""), F.lit("5"), F.lit("1"), F.lit("Xref: h"))
    e = table(spark, sf_dir, "events")
    run = lambda: ingest.ingest(spark, f"{root}/in", f"{root}/table", f"{root}/log", "g")
    e.select(line("event_type").alias("value")).write.mode("append").text(f"{root}/in")
    run()
    e.filter("event_id % 5 = 0").select(line(F.concat("event_type", F.lit(" again"))).alias("value")).write.mode("append").text(f"{root}/in")
    run()
    run()
    return ingest.articles(spark, f"{root}/table", "g").select("article_no", "subject", "poster")


@query("""SELECT event_type AS key, ts AS at, CAST(floor(avg(floor(value * 100)) OVER (PARTITION BY event_type ORDER BY ts, value ROWS 19 PRECEDING)) AS BIGINT) AS rate FROM events""")
def stream_sliding_mean(spark, sf_dir):
    root = sinks.scratch_dir(spark)
    kinds = table(spark, sf_dir, "events").schema
    samples = spark.readStream.schema(kinds).parquet(f"{sf_dir}/event*.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") * 100).cast("double").alias("value"))
    ingest.sliding_means(samples).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("key", F.col("at").cast("timestamp_ntz").alias("at"), F.floor("mean").alias("rate"))


@query(f"SELECT o_orderkey AS id, posted IS NOT NULL OR o_orderkey % 2 = 0 AS posted, verified IS NOT NULL OR o_orderkey % 2 = 0 AS verified FROM ({STATES})")
def stream_states(spark, sf_dir):
    root = sinks.scratch_dir(spark)
    now = states(spark, sf_dir).select(F.col("o_orderkey").alias("id"), *(F.col(c).cast("timestamp").alias(c) for c in ("staged", "posted", "verified")))
    sinks.publish(now, f"{root}/states")
    moved = now.filter("id % 2 = 0").select("id", F.explode(F.array(F.lit("posted"), F.lit("verified"))).alias("kind"), F.lit(dt.datetime(2030, 1, 1)).alias("at"))
    moved.write.parquet(f"{root}/events")
    ingest.follow_states(spark, spark.readStream.schema(moved.schema).parquet(f"{root}/events"), f"{root}/states", f"{root}/log")
    return sinks.published(spark, f"{root}/states").select("id", *(F.col(c).isNotNull().alias(c) for c in ("posted", "verified")))
