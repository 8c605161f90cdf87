"""String, name and size functions as columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of size strings, in order.
UNITS = ("K", "M", "G", "T")
#: Total sizes below which content is split into parts of so many bytes.
SPLIT_STEPS = ((100 << 20, 5 << 20), (1 << 30, 15 << 20), (5 << 30, 50 << 20), (15 << 30, 100 << 20), (25 << 30, 200 << 20))
SPLIT_MOST = 400 << 20
#: What may end a name, in this order: part, extension, packing, recovery volume, recovery, number.
EXTENSION = r"(?i)((?:\.part[0-9]+)?(?:\.[0-9a-z]{2,4})?(?:\.(?:gz|bz2?|xz))?(?:\.vol[0-9]+(?:\+[0-9]+)?)?(?:\.par2?)?(?:\.[0-9]{2,3})?)\s*$"
#: Fixed values: (type, pattern of the ending, extension), the first that fits a name wins.
TYPES = (
    ("application/x-rar-compressed", "rar|r[0-9]{2}", ".rar"),
    ("application/zip", "zip|z[0-9]{2}", ".zip"),
    ("application/x-7z-compressed", r"part[0-9]+\.7z|7za?\.?[0-9]*", ".7z"),
    ("application/tar+bzip2", r"tar\.bz2|tbz2", ".tar.bz2"),
    ("application/tar+bzip", r"tar\.bz|tbz", ".tar.bz"),
    ("application/tar+xz", r"tar\.xz|txz", ".tar.xz"),
    ("application/tar+gzip", r"tar\.gz|tgz", ".tar.gz"),
    ("application/x-tar", "tar", ".tar"),
    ("application/x-gzip", "gz", ".gz"),
    ("application/x-bzip2", "bz2", ".bz2"),
    ("application/x+xz", "xz", ".xz"),
    ("application/x-bzip", "bz", ".bz"),
    ("application/x-lzh-compressed", "lza|lha", ".lza"),
    ("video/x-msvideo", "avi", ".avi"),
    ("video/x-matroska", "mkv", ".mkv"),
    ("video/mpg", "mpe|mpg2?|mpeg2?|mpa", ".mpg"),
    ("video/mp4", "mpe?g?4", ".mp4"),
    ("video/ogg", "ogg", ".ogg"),
    ("video/3gpp", "3gpp?", ".3gp"),
    ("video/3gpp2", "3g2", ".3g2"),
    ("video/mp2t", "ts", ".ts"),
    ("video/quicktime", "mov|qt", ".mov"),
    ("video/divx", "divx", ".divx"),
    ("video/webm", "webm", ".webm"),
    ("video/x-flv", "flv", ".flv"),
    ("video/x-m4v", "m4v", ".m4v"),
    ("video/x-mng", "mng", ".mng"),
    ("video/x-ms-asf", "asf|asx", ".asf"),
    ("video/x-ms-wmv", "wmv", ".wmv"),
    ("audio/midi", "midi?|kar", ".midi"),
    ("audio/mpeg", "mp3", ".mp3"),
    ("audio/x-wav", "wav", ".wav"),
    ("audio/oga", "oga", ".oga"),
    ("audio/x-m4a", "m4a", ".m4a"),
    ("audio/x-realaudio", "ram?", ".ra"),
    ("image/gif", "gif", ".gif"),
    ("image/jpeg", "jpe?g", ".jpeg"),
    ("image/png", "png", ".png"),
    ("image/tiff", "tiff?", ".tiff"),
    ("image/vnd.wap.wbmp", "wbmp", ".wbmp"),
    ("image/x-ms-bmp", "bmp", ".bmp"),
    ("image/x-quicktime", "qtif?", ".qti"),
    ("image/image/svg+xml", "svgz?", ".svg"),
    ("image/image/x-jng", "jng", ".jng"),
    ("image/image/x-icon", "ico", ".ico"),
    ("application/x-iso9660-image", "iso|img", ".iso"),
    ("application/x-par2", r"par2?(?:\.vol[0-9]+(?:\+[0-9]+)?)?", ".par"),
    ("text/plain", "txt|diz|nfo", ".txt"),
    ("application/rtf", "rtf", ".rtf"),
    ("application/msword", "doc", ".doc"),
    ("text/x-nzb", "nzb", ".nzb"),
    ("application/x-dosexec", "msi|bin|exe|com|scr|dll", ".exe"),
    ("application/vnd.debian.binary-package", "deb", ".deb"),
    ("application/x-redhat-package-manager", "d?rpm", ".rpm"),
    ("text/html", "s?html?", ".html"),
    ("application/x-shockwave-flash", "swf", ".swf"),
    ("application/x-sql", "sql", ".sql"),
    ("text/css", "css", ".css"),
    ("text/xml", "xml", ".xml"),
    ("application/x-perl", "pl", ".pl"),
    ("application/x-python", "py[oc]?", ".py"),
    ("application/javascript", "js", ".js"),
    ("application/atom+xml", "atom", ".atom"),
    ("application/rss+xml", "rss", ".rss"),
    ("application/java-archive", "jar|war|ear", ".jar"),
    ("application/pdf", "pdf", ".pdf"),
    ("application/epub+zip", "epub", ".epub"),
    ("application/x-mobipocket-ebook", "mobi|prc", ".mobi"),
    ("application/postscript", "e?ps|ai", ".ps"),
    ("application/x-x509-ca-cert", "crt|pem|der", ".crt"),
)
DEFAULT_TYPE = "application/octet-stream"


def size_bytes(text: Column) -> Column:
    """``10M`` or ``1 KB`` as bytes: units of 1024, with a small ``b`` of 1000; null if it is none."""
    parts = [F.regexp_extract(text, r"^\s*([0-9]+)\s*([KMGTkmgt]?)([Bb]?)\s*$", i) for i in (1, 2, 3)]
    base = F.when(parts[2] == "b", F.lit(1000)).otherwise(F.lit(1024)).cast("long")
    power = F.lit(1).cast("long")
    factor = F.lit(1).cast("long")
    for u in UNITS:
        power = power * base
        factor = F.when(F.upper(parts[1]) == u, power).otherwise(factor)
    return F.when(parts[0] != "", F.try_multiply(parts[0].try_cast("long"), factor))


def size_text(n: Column) -> Column:
    """Bytes with two decimals in the largest unit that is at least one; null stays null."""
    scaled = lambda k: F.format_string("%.2f", F.round(n / F.lit(float(1024**k)), 2))
    out = F.concat(scaled(0), F.lit("B"))
    for k, u in enumerate(UNITS, 1):
        out = F.when(n >= 1024**k, F.concat(scaled(k), F.lit(f"{u}B"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def split_size(total: Column) -> Column:
    out = F.lit(SPLIT_MOST).cast("long")
    for below, part in reversed(SPLIT_STEPS):
        out = F.when(total < below, F.lit(part).cast("long")).otherwise(out)
    return out


def extension(name: Column) -> Column:
    return F.regexp_extract(name, EXTENSION, 1)


def type_of_name(name: Column) -> Column:
    """Type by the ending of a name, default where none fits; null or empty names have none."""
    out = F.lit(DEFAULT_TYPE)
    for kind, ending, _ in reversed(TYPES):
        out = F.when(name.rlike(rf"(?i)\.(?:{ending})\s*$"), F.lit(kind)).otherwise(out)
    return F.when(F.trim(name) != "", out)


def extension_of_type(kind: Column) -> Column:
    """The usual extension of a type; empty for the default type, null for unknown ones."""
    table = {k: e for k, _, e in reversed(TYPES)} | {DEFAULT_TYPE: ""}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), kind)


#: (type, leading bytes in hex), for content.
MAGIC = (("image/jpeg", "FFD8FF"), ("image/png", "89504E47"), ("image/gif", "47494638"), ("application/zip", "504B0304"), ("application/pdf", "25504446"), ("application/gzip", "1F8B"), ("application/x-rar-compressed", "526172211A07"), ("application/x-7z-compressed", "377ABCAF271C"), ("application/x-par2", "50415232"))


def type_of_bytes(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(DEFAULT_TYPE)
    for kind, start in reversed(MAGIC):
        out = F.when(head.startswith(start), F.lit(kind)).otherwise(out)
    return out


def best_type(content: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(type_of_bytes(content), F.lit(DEFAULT_TYPE)), type_of_name(name))


#: A subject: description, its [index/count], name, mark, (part/parts), size; all but name and parts may be missing.
SUBJECT = (
    r"""(?i)^(?:(?:["'\s]*([^"'\[(]+)(?:["'\s-]+[\[(]?([0-9]+)/([0-9]+)[)\]]?)?)?["'\s-]+)?"""
    r"""([^"']+?)["'\s-]+yEnc\s+[\[(]?([0-9]+)?/([0-9]+)[\])]?(?:[+\s]+([0-9]+))?\s*$"""
)


def subject_parts(subject: Column) -> Column:
    """struct<descr, fname, index, count, part, parts, size> of a subject; null if it names no file in parts."""
    grab = lambda i: F.nullif(F.trim(F.regexp_extract(subject, SUBJECT, i)), F.lit(""))
    number = lambda i: grab(i).try_cast("long" if i == 7 else "int")
    descr = F.nullif(F.regexp_replace(F.regexp_extract(subject, SUBJECT, 1), r"[\s-]+$", ""), F.lit(""))
    return F.when(subject.rlike(SUBJECT), F.struct(descr.alias("descr"), grab(4).alias("fname"), *(number(i).alias(n) for n, i in (("index", 2), ("count", 3), ("part", 5), ("parts", 6), ("size", 7)))))


def stem(name: Column) -> Column:
    """A name without its extension."""
    return F.substr(name, F.lit(1), F.length(name) - F.length(extension(name)))


def resolved_name(subject: Column, attached: Column, base: Column | None = None) -> Column:
    """Name of a file from its subject and the name of what is attached. A name counts if its ending has a type: the
    attached one goes first for ending and stem, the subject's is used where the attached one has no type, and any
    ending is better than none. ``base`` overrides the stem. Null if no ending or no stem is found."""
    some = lambda c: F.nullif(c, F.lit(""))
    told = subject_parts(subject)["fname"]
    typed = lambda n: F.coalesce(type_of_name(n) != DEFAULT_TYPE, F.lit(False))
    by_subject = typed(told) & ~typed(attached)
    ours, other = F.when(by_subject, told).otherwise(attached), F.when(by_subject, attached).otherwise(told)
    ending = F.coalesce(some(extension(ours)), F.when(typed(told), some(extension(told))), some(extension(other)))
    return F.concat(F.coalesce(some(base) if base is not None else F.lit(None), some(stem(ours)), some(stem(other))), ending)


#: Names of parts of archives and of recovery volumes.
PARTS = {"rar": r"(?i)^.*?\.(?:(?:part|r)([0-9]+)(?:\.rar)?|rar)$", "7z": r"(?i)^.*?\.(?:part([0-9]+)\.7z|7za?\.?([0-9]+)?)$", "par2": r"(?i)^.*?\.(?:vol([0-9]+)\+([0-9]+)\.)?par2?$"}


def part_of_name(name: Column) -> Column:
    """struct<family, part, blocks> of an archive's or recovery file's name: part is null for a whole archive or a
    recovery index, blocks is of recovery volumes only. Null for other names."""
    number = lambda kind, i: F.regexp_extract(name, PARTS[kind], i).try_cast("int")
    row = lambda kind, part, blocks: F.struct(F.lit(kind).alias("family"), part.alias("part"), blocks.alias("blocks"))
    none = F.lit(None).cast("int")
    out = F.when(name.rlike(PARTS["rar"]), row("rar", number("rar", 1), none)).when(name.rlike(PARTS["7z"]), row("7z", F.coalesce(number("7z", 1), number("7z", 2)), none))
    return out.when(name.rlike(PARTS["par2"]), row("par2", number("par2", 1), number("par2", 2)))


def normal_group(name: Column, shorthand: Mapping[tuple[int, str], str]) -> Column:
    """Lower case, without foreign signs; parts are spelled out from the left until one is no shorthand."""
    clean = F.filter(F.split(F.lower(F.regexp_replace(name, "[^A-Za-z0-9.-]", "")), r"\.+"), lambda p: p != "")
    out, going = clean, F.lit(True)
    for depth in range(1 + max((d for d, _ in shorthand), default=-1)):
        part = F.coalesce(F.get(clean, depth), F.lit(""))
        long = F.lit(None).cast("string")
        for (d, short), full in shorthand.items():
            if d == depth:
                long = F.when(part == short, F.lit(full)).otherwise(long)
        going = going & long.isNotNull()
        out = F.when(going, F.transform(out, lambda p, i: F.when(i == depth, long).otherwise(p))).otherwise(out)  # noqa: B023
    return F.nullif(F.array_join(out, "."), F.lit(""))


#: Shorthand of group names by depth.
SHORTHAND = {
    (0, "a"): "alt", (0, "ab"): "alt.binaries", (0, "abp"): "alt.binaries.pictures", (0, "abpe"): "alt.binaries.pictures.erotica",
    (0, "abs"): "alt.binaries.sounds", (0, "abw"): "alt.binaries.warez", (0, "music"): "alt.binaries.music", (0, "multimedia"): "alt.binaries.multimedia",
    (0, "pictures"): "alt.binaries.pictures", (0, "sounds"): "alt.binaries.sounds", (0, "warez"): "alt.binaries.warez",
    (1, "b"): "binaries", (1, "bp"): "binaries.pictures", (1, "bpe"): "binaries.pictures.erotica", (1, "bs"): "binaries.sounds", (1, "bw"): "binaries.warez",
    (2, "p"): "pictures", (2, "w"): "warez", (2, "pe"): "pictures.erotica", (2, "s"): "sounds", (3, "e"): "erotica",
}


def group_list(text: Column, shorthand: Mapping[tuple[int, str], str] = SHORTHAND) -> Column:
    """Groups named in a text, normalised, each once, in order."""
    names = F.transform(F.split(text, "[^A-Za-z0-9.-]+"), lambda g: normal_group(g, shorthand))
    return F.array_distinct(F.filter(names, lambda g: g.isNotNull()))


def words_list(text: Column, parting: str = r"[\[\];,\s]+") -> Column:
    return F.array_distinct(F.filter(F.split(text, parting), lambda x: x != ""))


def truth(text: Column) -> Column:
    """Yes or no by the first two letters; null if it is neither."""
    t = F.lower(F.left(F.trim(text), F.lit(2)))
    return F.when(t.isin("ye", "y", "tr", "t", "on", "1", "en", "al"), True).when(t.isin("no", "n", "fa", "f", "of", "0", "di", "de", "ne"), False)


def header_key(key: Column, known: Sequence[str]) -> Column:
    """Title case by dash; ``Id`` and ``Crc`` at the end upper; ``X-`` before keys that are not known."""
    k = F.replace(F.initcap(F.replace(F.trim(key), F.lit("-"), F.lit(" "))), F.lit(" "), F.lit("-"))
    k = F.regexp_replace(F.regexp_replace(k, "-Id$", "-ID"), "-Crc$", "-CRC")
    return F.when(F.lower(k).isin([x.lower() for x in known]) | k.startswith("X-"), k).otherwise(F.concat(F.lit("X-"), k))


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """``{{key}}`` replaced by its value, unknown keys by nothing."""
    out = template
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value.cast("string"))
    return F.regexp_replace(out, r"\{\{[^}]*\}\}", "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` puts it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def crosspost_map(text: Column) -> Column:
    """``group:no group:no`` as a map; a number that is none counts as 0; the last of equal groups stays."""
    pairs = F.filter(F.split(text, r"\s+"), lambda x: x.contains(":"))

    def number(x: Column) -> Column:  # a cast that fails costs an exception, so texts without digits are told before
        return F.when(x.rlike("[0-9]"), F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))

    entries = F.transform(pairs, lambda x, i: F.struct(F.substring_index(x, ":", 1).alias("group"), i.alias("at"), number(F.substring_index(x, ":", -1)).alias("number")))

    def last(found: Column) -> Column:
        ordered = F.sort_array(found)  # equal groups side by side, the last of them at the end
        kept = once(ordered, lambda es: F.filter(es, lambda e, i: ~F.coalesce(F.get(es, i + 1)["group"] == e["group"], F.lit(False))))
        return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["at"].alias("at"), e["group"].alias("group"), e["number"].alias("number")))), lambda e: F.struct(e["group"].alias("group"), e["number"].alias("number")))

    def unique(found: Column) -> Column:
        groups = F.transform(found, lambda e: e["group"])
        plain = F.transform(found, lambda e: F.struct(e["group"].alias("group"), e["number"].alias("number")))
        return F.when(F.size(F.array_distinct(groups)) == F.size(found), plain).otherwise(last(found))

    return F.map_from_entries(once(entries, unique))


def crosspost_group(text: Column) -> Column:
    """The group that a cross-post text names: its last token without a colon; null if there is none."""
    bare = F.filter(F.split(text, r"\s+"), lambda x: (x != "") & ~x.contains(":"))
    return F.try_element_at(bare, F.lit(-1))


def article_time(text: Column) -> Column:
    """Time of a message date; a leading weekday of any language is dropped; what cannot be read is the epoch."""
    plain = F.regexp_replace(F.trim(text), r"^[^0-9]+,?\s*", "")
    tries = [F.try_to_timestamp(plain, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    lower = F.initcap(plain)
    tries += [F.try_to_timestamp(lower, F.lit("d MMM yyyy HH:mm:ss xx"))]
    return F.coalesce(*tries, F.timestamp_seconds(F.lit(0)))


def hexdump(content: Column, width: int = 16) -> Column:
    """Lines of offset, bytes in hex (a gap after the eighth) and signs, ``.`` for what does not print.

    Digits and signs of the whole content are made at once; a line only cuts them, by bytes, so time grows with the
    length."""
    pairs = [f"${k}" for k in range(1, width + 1)]
    full = " ".join(pairs[:8]) + " " + (" " + " ".join(pairs[8:]) if width > 8 else "")  # width * 3 signs
    n = F.ceil(F.octet_length(content) / F.lit(width))
    blank = F.lit(b"\x00" * width)  # fills the last line; cut off again there
    filled_up = F.concat(content, F.substring(blank, 1, (n * width - F.octet_length(content)).cast("int")))
    digits = F.regexp_replace(F.lower(F.hex(filled_up)), "(..)" * width, full).cast("binary")
    signs = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[^\x20-\x7e]", ".").cast("binary")

    def cut(raw: Column, at: Column, size: Column) -> Column:
        return F.substr(raw, (at + 1).cast("int"), size.cast("int")).cast("string")

    def lines(x: Column) -> Column:
        size = F.octet_length(x["signs"])

        def line(i: Column) -> Column:
            left = F.least(F.lit(width), size - i * width)
            # three signs a byte, and the gap once the ninth is there
            body = F.when(left == width, cut(x["digits"], i * width * 3, F.lit(width * 3))).otherwise(F.rpad(cut(x["digits"], i * width * 3, left * 3 + F.when(left > 8, 1).otherwise(0)), width * 3, " "))
            return F.concat(F.lpad(F.lower(F.hex(i * width)), 8, "0"), F.lit(":  "), body, F.lit("  |"), cut(x["signs"], i * width, F.lit(width)), F.lit("|"))

        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(size / F.lit(width)) - 1), line), "\n")

    return F.when(n > 0, once(F.struct(digits.alias("digits"), signs.alias("signs")), lines)).otherwise(F.when(content.isNotNull(), F.lit("")))


def tidy_path(path: Column) -> Column:
    """Without doubled and trailing slashes or backslashes; a lone root and the two of a network path stay."""
    p = F.regexp_replace(F.trim(path), "/{2,}", "/")
    p = F.regexp_replace(p, r"(?<=[^\\])\\{2,}", r"\\")
    return F.regexp_replace(p, r"(?<=[^:/\\])[\s/\\]+$", "")


def path_list(text: Column) -> Column:
    """Paths of a list parted by commas or bars, or by blanks before a path's beginning; tidy, each once."""
    marked = F.regexp_replace(text, r"[\s,|]+(?=/|\\\\|[A-Za-z]:[/\\])", "|")
    return F.array_distinct(F.filter(F.transform(F.split(marked, "[,|]+"), tidy_path), lambda p: p != ""))


def masked(text: Column, values: Mapping[str, str], depth: int = 5) -> Column:
    """``%{key}`` replaced by its value, in values as well, up to ``depth`` times; a value that names itself is left."""
    for _ in range(depth):
        for key, value in values.items():
            text = F.regexp_replace(text, rf"(?i)%\{{{re.escape(key)}\}}", value.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def url_parts(url: Column, schema: str = "http") -> Column:
    """struct<schema,user,password,host,port,fullpath,path,query,url,qsd>; null without a host or with a bad port.
    path is the folder and query the name after the last slash, as fullpath is cut; qsd are the pairs after ``?``."""
    pattern = r"^\s*(?:([A-Za-z0-9]{2,9})://)?(?:([^:@/?#\s]+)(?::([^@/?#\s]*))?@)?([^:@/?#\s]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.nullif(F.regexp_extract(url, pattern, i), F.lit(""))
    full = F.nullif(F.trim(F.regexp_replace(part(6), "/{2,}", "/")), F.lit(""))
    port = F.nullif(part(5).try_cast("int"), F.lit(0))
    scheme = F.coalesce(F.lower(part(1)), F.lit(schema))
    pairs = F.filter(F.split(F.coalesce(part(7), F.lit("")), "&"), lambda x: F.substring_index(x, "=", 1) != "")
    value = lambda x: F.coalesce(F.try_url_decode(F.when(x.contains("="), F.substr(x, F.instr(x, "=") + 1)).otherwise(F.lit(""))), F.lit(""))
    entries = F.transform(pairs, lambda x: F.struct(F.lower(F.substring_index(x, "=", 1)), F.trim(value(x))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["col1"] == e["col1"]))
    user = F.when(part(2).isNotNull(), F.concat(part(2), F.coalesce(F.concat(F.lit(":"), part(3)), F.lit("")), F.lit("@"))).otherwise(F.lit(""))
    whole = F.concat(scheme, F.lit("://"), user, part(4), F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")), F.coalesce(full, F.lit("")))
    fields = {"schema": scheme, "user": part(2), "password": part(3), "host": part(4), "port": port, "fullpath": full, "path": F.nullif(F.regexp_extract(full, "^(.*/)", 1), F.lit("")), "query": F.nullif(F.regexp_extract(full, "([^/]*)$", 1), F.lit("")), "url": whole, "qsd": F.map_from_entries(last)}
    return F.when(part(4).isNotNull() & (part(5).isNull() | part(5).try_cast("int").isNotNull()), F.struct(*(c.alias(n) for n, c in fields.items())))


def message_id(text: Column) -> Column:
    """The id between angle brackets, or bare; null if it is none."""
    return F.nullif(F.regexp_extract(text, r"^\s*<?\s*([^<>\s]+@[^<>\s]+|[^<>\s]+)\s*>?\s*$", 1), F.lit(""))


def new_message_id(at: Column, part: Column, host: Column) -> Column:
    """An id from a time, a part number and a host: hash of the time around its fields in hex."""
    key = F.sha1(F.date_format(at, "yyyyMMddHHmmssSSSSSS"))
    digits = lambda c: F.lower(F.hex(c.cast("long")))
    micros = F.unix_micros(at.cast("timestamp")) % 1_000_000
    return F.concat(F.left(key, F.lit(5)), digits(F.second(at)), F.lit("."), digits(micros), F.lit("!"), *(digits(c) for c in (F.year(at), F.month(at), F.day(at), F.minute(at), part)), digits(F.hour(at)), F.lit("@"), host, F.substr(key, F.lit(6), F.lit(5)))


def seeded_text(seed: Column, count: int = 16) -> Column:
    """Letters and digits that follow from a seed."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    one = lambda i: F.substr(F.lit(signs), (F.pmod(F.xxhash64(seed, i), F.lit(len(signs))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(count)), one), "")


def from_charset(content: Column, charset: str = "ISO-8859-1") -> Column:
    return F.decode(content, charset)
