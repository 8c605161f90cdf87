"""Queries by name, each with the SQL that gives the same rows where SQL can.

Articles are the ``documents`` table: article_no is doc_id, subject the text, poster the source, group the
language. ``events`` are the time-ordered index, ``conversations`` the segmented posts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import codecs, text
from threadloom.operators import catalog, rules, search, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"doc_id": "article_no", "text": "subject", "source": "poster", "lang": "group", "n_chars": "size"}
    return table(spark, sf_dir, "documents").select(*(F.col(a).alias(b) for a, b in names.items()))


ART = "SELECT doc_id AS article_no, text AS subject, source AS poster, lang AS \"group\", n_chars AS size FROM documents"
SCORES = (rules.Rule("en.*", {"subject_regex": "The.*"}, 10), rules.Rule("(en|fr)", {"subject_starts": "La"}, 50), rules.Rule(".*", {"size_above": 2000}, 20), rules.Rule("de", {"subject_ends": "."}, -5), rules.Rule(".*", {"poster_regex": "src1[0-9]?$"}, 7))
SCORE_SQL = """(CASE WHEN regexp_matches("group", '^(?:en.*)') AND regexp_matches(subject, '^(?i:The)') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches("group", '^(?:(en|fr))') AND starts_with(subject, 'La') THEN 50 ELSE 0 END + CASE WHEN size > 2000 THEN 20 ELSE 0 END
 + CASE WHEN regexp_matches("group", '^(?:de)') AND suffix(subject, '.') THEN -5 ELSE 0 END + CASE WHEN regexp_matches(poster, '^(?i:src1[0-9]?$)') THEN 7 ELSE 0 END)"""
BLACK, WHITE = (rules.Rule(".*", {"size_above": 5000}), rules.Rule("es", {"subject_regex": ".*de"})), (rules.Rule(".*", {"score_above": 25}),)


@query(f"SELECT article_no, score FROM (SELECT *, CAST({SCORE_SQL} AS INTEGER) AS score FROM ({ART})) WHERE contains(subject, 'en') AND NOT contains(subject, 'zzz') AND score BETWEEN 10 AND 9999 ORDER BY score DESC, article_no")
def search_score_range(spark, sf_dir):
    scored = rules.apply(articles(spark, sf_dir), SCORES)
    return search.search(scored, ["en", "-zzz"], least=10).select("article_no", "score").orderBy(F.desc("score"), "article_no")


@query(f"SELECT article_no FROM ({ART}) WHERE contains(subject, 'tion') AND contains(subject, 'the')")
def search_include(spark, sf_dir):
    return articles(spark, sf_dir).filter(search.condition(["tion", "the"])).select("article_no")


@query(f"SELECT article_no FROM ({ART}) WHERE contains(subject, 'en') AND NOT contains(subject, 'the')")
def search_exclude(spark, sf_dir):
    return articles(spark, sf_dir).filter(search.condition(["en", "-the"])).select("article_no")


@query(f"SELECT article_no FROM ({ART}) WHERE contains(lower(subject), 'the') AND NOT contains(lower(subject), 'password')")
def search_ci(spark, sf_dir):
    return articles(spark, sf_dir).filter(search.condition(["THE", "-PassWord"], any_case=True)).select("article_no")


@query(f"SELECT article_no, poster FROM ({ART}) WHERE contains(poster, 'src1') AND NOT contains(poster, 'src10')")
def search_poster(spark, sf_dir):
    return articles(spark, sf_dir).filter(search.condition(["%src1", "-%src10"])).select("article_no", "poster")


@query(f"SELECT article_no, CAST({SCORE_SQL} AS INTEGER) AS score FROM ({ART})")
def rule_score(spark, sf_dir):
    return rules.apply(articles(spark, sf_dir), SCORES).select("article_no", "score")


@query(f"SELECT article_no FROM ({ART}) WHERE NOT (size > 5000 OR (regexp_matches(\"group\", '^(?:es)') AND regexp_matches(subject, '^(?i:[^\\n]*de)')))")
def rule_blacklist(spark, sf_dir):
    return rules.apply(articles(spark, sf_dir), black=BLACK).select("article_no")


@query(f"SELECT article_no, score FROM (SELECT *, CAST({SCORE_SQL} AS INTEGER) AS score FROM ({ART})) WHERE score > 25 OR NOT (size > 5000 OR (regexp_matches(\"group\", '^(?:es)') AND regexp_matches(subject, '^(?i:[^\\n]*de)')))")
def rule_whitelist_override(spark, sf_dir):
    return rules.apply(articles(spark, sf_dir), SCORES, WHITE, BLACK).select("article_no", "score")


@query(f"SELECT article_no FROM ({ART}) WHERE size > 500 AND size < 1500")
def rule_size(spark, sf_dir):
    keep = rules.Rule(".*", {"size_above": 500, "size_below": 1500})
    return articles(spark, sf_dir).filter(keep.holds()).select("article_no")


@query(f"SELECT article_no FROM ({ART}) WHERE (starts_with(subject, 'The ') OR suffix(subject, 'on.'))")
def rule_prefix_suffix(spark, sf_dir):
    return articles(spark, sf_dir).filter(rules.any_of((rules.Rule(".*", {"subject_starts": "The "}), rules.Rule(".*", {"subject_ends": "on."})))).select("article_no")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'")
def rule_date(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumns({"posted": F.col("ts"), "group": F.col("event_type")})
    return ev.filter(rules.Rule(".*", {"after": dt.datetime(2024, 1, 5), "before": dt.datetime(2024, 1, 20)}).holds()).select("event_id")


RULE_ROWS = [("en", "The", 10), ("(fr|es)", "La", 5), ("e.*", "A", 2)]


@query("""WITH r(g, x, s) AS (VALUES ('en','The',10),('(fr|es)','La',5),('e.*','A',2)) SELECT d.doc_id AS article_no, CAST(coalesce(sum(CASE WHEN regexp_matches(d.text, '^(?i:' || x || ')') THEN s ELSE 0 END), 0) AS INTEGER) AS score
 FROM documents d LEFT JOIN r ON regexp_matches(d.lang, '^(?:' || g || ')') GROUP BY 1""")
def rule_group_join(spark, sf_dir):
    table_of_rules = spark.createDataFrame(RULE_ROWS, "group_regex string, regex string, score int")
    return rules.by_table(articles(spark, sf_dir), table_of_rules).select("article_no", "score")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id BETWEEN 100 AND 300")
def xover_range(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_id").between(100, 300)).select("event_id", "event_type", "user_id")


@query("SELECT event_id, user_id, ts FROM events ORDER BY user_id, ts, event_id")
def xover_by_poster_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id")


@query("SELECT event_id, ts FROM events WHERE event_id >= 400 ORDER BY event_id LIMIT 50")
def keyset_page(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id >= 400").select("event_id", "ts").orderBy("event_id").limit(50)


@query('SELECT lang AS "group", min(doc_id) AS low, max(doc_id) AS high, count(*) AS count FROM documents GROUP BY 1')
def group_watermarks(spark, sf_dir):
    return catalog.watermarks(articles(spark, sf_dir))


ALIASES = [("cold", 0), ("cold", 3), ("warm", 1), ("warm", 2), ("all", 4), ("cold", 1)]
ALIAS_SQL = "(VALUES ('cold',0),('cold',3),('warm',1),('warm',2),('all',4),('cold',1)) a(name, group_id)"


def alias_table(spark):
    return spark.createDataFrame(ALIASES, "name string, group_id int")


def group_table(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("name"))


@query(f"SELECT g.r_name AS name FROM region g JOIN {ALIAS_SQL} ON g.r_regionkey = a.group_id WHERE a.name = 'cold'")
def alias_resolve(spark, sf_dir):
    a = alias_table(spark).filter("name = 'cold'").select("group_id")
    return group_table(spark, sf_dir).join(F.broadcast(a), "group_id").select("name")  # the literal alias rows


@query(f"SELECT a.name AS alias, g.r_name AS name FROM region g JOIN {ALIAS_SQL} ON g.r_regionkey = a.group_id ORDER BY 1, 2")
def alias_listing(spark, sf_dir):
    return group_table(spark, sf_dir).join(alias_table(spark).withColumnRenamed("name", "alias"), "group_id").select("alias", "name").orderBy("alias", "name")


@query(f"""WITH q(name) AS (VALUES ('ASIA'),('cold'),('none'),('europe')), g AS (SELECT r_regionkey AS id, r_name AS n FROM region)
 SELECT DISTINCT q.name, coalesce(x.id, a.group_id, l.id) AS group_id FROM q LEFT JOIN g x ON x.n = q.name LEFT JOIN {ALIAS_SQL} ON a.name = q.name LEFT JOIN g l ON lower(l.n) = lower(q.name) WHERE coalesce(x.id, a.group_id, l.id) IS NOT NULL""")
def resolve_cascade(spark, sf_dir):
    return catalog.resolve(spark.createDataFrame([("ASIA",), ("cold",), ("none",), ("europe",)], "name string"), group_table(spark, sf_dir), alias_table(spark))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def exists_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_anti(spark, sf_dir):
    return catalog.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def children_collect(spark, sf_dir):
    rows = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT conv_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS bytes FROM conversations GROUP BY 1")
def nzb_totals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(F.length("text").cast("long")).alias("bytes"))


@query("SELECT conv_id, md5(arg_min(text, turn)) AS gid FROM conversations GROUP BY 1")
def nzb_gid(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.min_by("text", "turn")).alias("gid"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS index, count(*) OVER (PARTITION BY conv_id) AS count FROM conversations")
def segment_number(spark, sf_dir):
    return segments.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"]).withColumn("index", F.col("index").cast("long"))


@query("SELECT conv_id, turn, turn - coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) - 1 AS gap FROM conversations")
def segment_gap(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") - F.coalesce(F.lag("turn").over(w), F.lit(-1)) - 1).alias("gap"))


@query("SELECT event_id, CAST(sum(CASE WHEN NOT (event_type IS NOT DISTINCT FROM prev) OR first THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w = 1 AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def change_groups(spark, sf_dir):
    return segments.change_groups(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "run")


@query("SELECT event_id, CAST(floor(avg(floor(value * 100)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 19 PRECEDING)) AS BIGINT) AS rate FROM events")
def rate_moving_avg(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.avg(F.floor(F.col("value") * 100)).over(w)).alias("rate"))


@query("SELECT doc_id, md5(text) AS key FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return catalog.upsert(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), ["key"], "doc_id")


@query("SELECT lang AS name FROM documents UNION SELECT source FROM documents")
def set_union(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("name")).distinct().union(d.select("source").distinct()).distinct()


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT DISTINCT source, lang FROM documents")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("SELECT doc_id, CAST(p AS INTEGER) AS part, CAST(greatest(1, ceil(length(text) / 2000.0)) AS INTEGER) AS parts, (p - 1) * 2000 AS begin, least(p * 2000, length(text)) AS finish, sha1(substr(text, CAST((p - 1) * 2000 + 1 AS BIGINT), 2000)) AS sha1 FROM documents, unnest(range(1, CAST(greatest(1, ceil(length(text) / 2000.0)) AS BIGINT) + 1)) t(p)")
def split_parts(spark, sf_dir):
    rows = segments.split(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2000)
    return rows.select("doc_id", "part", "parts", F.col("begin").cast("long").alias("begin"), F.col("finish").cast("long").alias("finish"), F.sha1("chunk").alias("sha1"))


@query("SELECT doc_id, md5(text) AS md5, true AS complete FROM documents")
def join_parts(spark, sf_dir):
    rows = segments.split(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 2000)
    return segments.join(rows, ["doc_id"]).select("doc_id", F.md5("content").alias("md5"), "complete")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS md5 FROM conversations GROUP BY 1")
def join_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform("x", lambda s: s["text"]), "\n")).alias("md5"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))


@query()
def content_crc32(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codecs.crc32_hex(F.col("text")).alias("crc32"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages")
def url_parts(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part(r"^([a-z]+)://").alias("scheme"), part(r"^[a-z]+://([^/?#]*)").alias("host"), part(r"\?([^#]*)").alias("query"))


@query("SELECT doc_id, n_chars * 1024 AS kib, n_chars * 1000 AS kb, CAST(NULL AS BIGINT) AS bad FROM documents")
def size_parse(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", text.size_bytes(F.concat(n, F.lit("KB"))).alias("kib"), text.size_bytes(F.concat(n, F.lit(" Kb"))).alias("kb"), text.size_bytes(F.concat(n, F.lit("J"))).alias("bad"))


@query("SELECT doc_id, CASE WHEN n_chars * 512 >= 1048576 THEN 'MB' WHEN n_chars * 512 >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM documents")
def size_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(text.size_text(F.col("n_chars") * 512), "[A-Z]+$", 0).alias("unit"))


@query("SELECT doc_id, CAST(CASE WHEN b < 104857600 THEN 5242880 WHEN b < 1073741824 THEN 15728640 WHEN b < 5368709120 THEN 52428800 WHEN b < 16106127360 THEN 104857600 WHEN b < 26843545600 THEN 209715200 ELSE 419430400 END AS BIGINT) AS part FROM (SELECT doc_id, n_chars * 3000000 AS b FROM documents)")
def split_size_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.split_size(F.col("n_chars") * 3000000).alias("part"))


@query("""SELECT doc_id, 'post ' || doc_id AS descr, 'f' || doc_id || '.bin' AS fname, 1 AS index, 2 AS count, 3 AS part, 4 AS parts, n_chars AS size FROM documents""")
def subject_parse(spark, sf_dir):
    s = F.format_string('post %d [1/2] - "f%d.bin" yEnc (3/4) %d', F.col("doc_id"), F.col("doc_id"), F.col("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", text.subject_parts(s).alias("x")).select("doc_id", "x.*")


@query("SELECT event_id, lower(event_type) || '.' || user_id AS name FROM events")
def group_normalise(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.normal_group(F.concat(F.upper("event_type"), F.lit("..%"), F.col("user_id").cast("string")), {}).alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def header_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.from_json("props", "map<string,bigint>"), "k").alias("k"))


@query("SELECT event_id, event_type AS \"group\", user_id AS number FROM events UNION ALL SELECT event_id, 'other', 0 FROM events")
def xref_map(spark, sf_dir):
    x = text.crosspost_map(F.concat(F.lit("x:1 other:zz "), F.col("event_type"), F.lit(":"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(F.map_filter(x, lambda k, v: k != "x")).alias("group", "number"))


@query("SELECT s_nationkey, arg_min(s_name, s_suppkey) AS s_name FROM supplier WHERE s_acctbal > 0 GROUP BY 1")
def server_failover(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("s_name"))
    return catalog.first_by_priority(rows, ["s_nationkey"], "s_suppkey", "s_name")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS staged, count(*) FILTER (WHERE o_orderstatus = 'P') AS posted, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified FROM orders GROUP BY 1")
def state_pending(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*(F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(n) for s, n in (("O", "staged"), ("P", "posted"), ("F", "verified"))))


@query("SELECT doc_id, substr(text, 1, 128) AS head FROM documents")
def prefix_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 128).alias("head"))


@query("SELECT doc_id, 'file ' || doc_id || ' of ' || lang AS name FROM documents")
def template_fill(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.filled(F.lit("file {{index}} of {{lang}}{{unknown}}"), {"index": F.col("doc_id"), "lang": F.col("lang")}).alias("name"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def yenc_round_trip(spark, sf_dir):
    raw = F.encode(F.col("text"), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(codecs.yenc_decode(codecs.yenc_encode(raw))).alias("md5"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def uu_round_trip(spark, sf_dir):
    raw = F.encode(F.col("text"), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(codecs.uu_decode(codecs.uu_encode(raw))).alias("md5"))
