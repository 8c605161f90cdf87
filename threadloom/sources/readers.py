"""Text and XML sources as typed DataFrames. Every parser works on a column ``value`` of lines or texts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import article_time, crosspost_group, crosspost_map, extension, header_key, stem, type_of_name

#: Header keys that keep their name.
KNOWN_KEYS = ("Subject", "From", "Date", "Message-ID", "References", "Lines", "Newsgroups", "Path", "Organization", "Xref", "Bytes", "Content-Type")
MANIFEST = "_poster string, _date bigint, _subject string, groups struct<group:array<string>>, segments struct<segment:array<struct<_VALUE:string,_bytes:string,_number:string>>>"


def article_lines(lines: DataFrame) -> DataFrame:
    """Index lines of nine tab-separated fields as articles; other lines give no row."""
    f = F.split("value", "\t")
    rows = lines.filter(F.size(f) >= 8).select(f.alias("f")).filter(F.get("f", 0).try_cast("long").isNotNull())
    xref = F.regexp_replace(F.coalesce(F.get("f", 8), F.lit("")), r"(?i)^xref:\s*", "")
    return rows.select(
        F.regexp_extract(F.get("f", 4), r"<?([^<>\s]+)>?", 1).alias("id"), F.get("f", 0).cast("long").alias("article_no"), F.get("f", 2).alias("poster"), article_time(F.get("f", 3)).alias("posted"),
        F.get("f", 1).alias("subject"), F.coalesce(F.get("f", 6).try_cast("long"), F.lit(0)).alias("size"), F.coalesce(F.get("f", 7).try_cast("int"), F.lit(-1)).alias("lines"),
        F.lit(0).alias("score"), crosspost_map(xref).alias("xgroups"), crosspost_group(xref).alias("host"),
    )


def group_lines(lines: DataFrame) -> DataFrame:
    """``group n1 n2 [flags]``: count is n1 - n2, and 0 where that is 1 or less."""
    pattern = r"^\s*([A-Za-z0-9._+-]*[A-Za-z][A-Za-z0-9._+-]*)\s+([0-9]+)\s+([0-9]+)(?:\s+([A-Za-z]+))?\s*$"
    p = lambda i: F.regexp_extract("value", pattern, i)
    rows = lines.filter(F.col("value").rlike(pattern)).select(F.lower(p(1)).alias("group"), p(2).cast("long").alias("low"), p(3).cast("long").alias("high"), F.filter(F.split(p(4), ""), lambda x: x != "").alias("flags"))
    gap = F.col("low") - F.col("high")
    return rows.withColumn("count", F.when(gap <= 1, F.lit(0)).otherwise(gap)).select("group", "low", "high", "count", "flags")


def headers(texts: DataFrame, key: str = "id") -> DataFrame:
    """Header blocks (columns key and value) as map<string,string>: continued lines are joined, values of
    equal keys are joined with a comma, the first blank line after a header ends the block."""
    block = F.regexp_extract(F.regexp_replace("value", r"^(?:[ \t]*\r?\n)+", ""), r"(?s)^(.*?)(?:\r?\n[ \t]*\r?\n|$)", 1)
    whole = F.regexp_replace(block, r"\r?\n[ \t]+", " ")
    rows = texts.select(key, F.posexplode(F.split(whole, r"\r?\n")).alias("at", "line")).filter(F.col("line").rlike(r"^[A-Za-z][A-Za-z0-9_-]*\s*:"))
    pair = rows.select(key, "at", header_key(F.regexp_extract("line", r"^([^:]+):", 1), KNOWN_KEYS).alias("name"), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1)).alias("text"))
    merged = pair.groupBy(key, "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), ",").alias("text"))
    return merged.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("headers"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """XML file manifests: a row per file with its segments; missing numbers follow the one before, bad sizes are 0."""
    raw = spark.read.format("xml").option("rowTag", "file").schema(MANIFEST).load(path)
    seg = F.transform("segments.segment", lambda s, i: F.struct(F.coalesce(s["_number"].try_cast("int"), (i + 1).cast("int")).alias("number"), F.greatest(F.coalesce(s["_bytes"].try_cast("long"), F.lit(0)), F.lit(0)).alias("bytes"), s["_VALUE"].alias("id")))
    return raw.select(F.col("_poster").alias("poster"), F.col("_date").alias("date"), F.col("_subject").alias("subject"), F.col("groups.group").alias("groups"), F.array_sort(seg).alias("segments"))


def valid_files(files: DataFrame) -> DataFrame:
    """``files`` of manifests with ``valid``: poster, subject and date are there, one group at least, and segments
    with ids, numbers from 1 and no number twice."""
    number = lambda s: s["number"]
    segments = (F.size("segments") > 0) & F.forall("segments", lambda s: (F.length(F.coalesce(s["id"], F.lit(""))) > 0) & (s["number"] >= 1)) & (F.size(F.array_distinct(F.transform("segments", number))) == F.size("segments"))
    told = F.col("poster").isNotNull() & F.col("subject").isNotNull() & F.col("date").isNotNull() & (F.size("groups") > 0)
    return files.withColumn("valid", F.coalesce(told & segments, F.lit(False)))


DOCTYPE = '<!DOCTYPE nzb PUBLIC "-//newzBin//DTD NZB 1.1//EN" "http://www.newzbin.com/DTD/nzb/nzb-1.1.dtd">'


def manifest_texts(files: DataFrame, by: str) -> DataFrame:
    """(``by``, xml): the text of a manifest of each value of ``by``, with declaration, document type and escapes. A
    manifest with a file without segments gives null. Files are in order of their subjects."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    text = lambda c: safe(F.coalesce(c.cast("string"), F.lit("")))
    groups = F.array_join(F.transform("groups", lambda g: F.concat(F.lit("<group>"), text(g), F.lit("</group>"))), "")
    segments = F.array_join(F.transform("segments", lambda s: F.concat(F.lit('<segment bytes="'), text(s["bytes"]), F.lit('" number="'), text(s["number"]), F.lit('">'), text(s["id"]), F.lit("</segment>"))), "")
    one = F.concat(F.lit('<file poster="'), text(F.col("poster")), F.lit('" date="'), text(F.col("date")), F.lit('" subject="'), text(F.col("subject")), F.lit('"><groups>'), groups, F.lit("</groups><segments>"), segments, F.lit("</segments></file>"))
    rows = files.select(by, "subject", one.alias("one"), (F.size("segments") > 0).alias("some"))
    whole = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("subject", "one"))).alias("rows"), F.bool_and("some").alias("some"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n{DOCTYPE}\n<nzb xmlns="http://www.newzbin.com/DTD/2003/nzb">'
    return whole.select(by, F.when(F.col("some"), F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["one"]), ""), F.lit("</nzb>"))).alias("xml"))


def write_manifest(files: DataFrame, path: str) -> None:
    rows = files.select(
        F.col("poster").alias("_poster"), F.col("date").alias("_date"), F.col("subject").alias("_subject"), F.struct(F.col("groups").alias("group")).alias("groups"),
        F.struct(F.transform("segments", lambda s: F.struct(s["id"].alias("_VALUE"), s["bytes"].alias("_bytes"), s["number"].alias("_number"))).alias("segment")).alias("segments"),
    )
    rows.write.format("xml").option("rowTag", "file").option("rootTag", "nzb").mode("overwrite").save(path)


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below a folder: path, folder, name, stem, extension, type, size, modified. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")
    return described(rows.withColumnsRenamed({"length": "size", "modificationTime": "modified"}))


def described(rows: DataFrame) -> DataFrame:
    """Rows (path, size, modified) with the parts of their path and the type by name."""
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return rows.select("path", folder.alias("folder"), name.alias("name"), stem(name).alias("stem"), extension(name).alias("extension"), type_of_name(name).alias("type"), "size", "modified")


def found(rows: DataFrame, root: str, regex: Sequence[str] = (), prefix: Sequence[str] = (), suffix: Sequence[str] = (), min_depth: int = 1, max_depth: int | None = None, any_case: bool = False) -> DataFrame:
    """Rows of ``files`` whose name passes one filter of every list that is given, at a depth below ``root`` (its own
    files have 1)."""
    name = F.lower("name") if any_case else F.col("name")
    low = lambda x: x.lower() if any_case else x
    lists = ([F.col("name").rlike(f"(?i){r}" if any_case else r) for r in regex], [name.startswith(low(p)) for p in prefix], [name.endswith(low(x)) for x in suffix])
    cond = reduce(and_, (reduce(or_, tests) for tests in lists if tests), F.lit(True))
    inside = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    depth = F.size(F.split(inside, "/"))
    return rows.filter(cond & (depth >= min_depth) & (depth <= max_depth if max_depth is not None else F.lit(True)))


def quiet(rows: DataFrame, seconds: int, now: Column | None = None) -> DataFrame:
    """Rows of ``files`` that have not changed for so long, the oldest first."""
    now = F.current_timestamp() if now is None else now
    return rows.filter(F.col("modified") <= now - F.make_interval(secs=F.lit(float(seconds)))).orderBy("modified", "path")


def folder_sizes(rows: DataFrame) -> DataFrame:
    """(folder, size, files): sums of the files right in each folder."""
    return rows.groupBy("folder").agg(F.sum("size").alias("size"), F.count("*").alias("files"))


def servers(spark: SparkSession, settings: Mapping) -> DataFrame:
    """(host, port, secure, username, priority) of the servers of a configuration, a mapping as its file is read: a host
    that comes again is left out, priorities that are not given follow the order, defaults fill what is missing."""
    rows, seen = [], set()
    for i, s in enumerate(settings.get("servers") or []):
        host = str(s.get("host") or "").strip().lower()
        if host and host not in seen:
            seen.add(host)
            secure = bool(s.get("secure", False))
            rows.append((host, int(s.get("port") or (563 if secure else 119)), secure, s.get("username"), int(s.get("priority") or i + 1)))
    return spark.createDataFrame(rows, "host string, port int, secure boolean, username string, priority int").orderBy("priority", "host")


def database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database by its JDBC address; the driver must be on Spark's class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
