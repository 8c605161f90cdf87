"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import avi, hnsw, jaccard_join, language_crf, mixing, packing, pii, quality_mil, secret_scan, url_filter
from threadloom.llm.common import read


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.entropy_mix(read(spark, sf_dir, "documents")))


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(read(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filter.with_host_path(read(spark, sf_dir, "pages").select("page_id", "url"))
    # the number that ends a path is that of the labelled document
    about = F.expr(r"try_cast(regexp_extract(path, '/([0-9]{1,18})(?:\\.html)?/?$', 1) as bigint)")
    bad = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).filter("bad is not null")
    outcomes = pages.select("host", about.alias("doc_id")).join(bad, "doc_id").select("host", "bad")
    return url_filter.url_filter(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.language_id(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.concat_and_cut(read(spark, sf_dir, "documents"), tokenizer_json())


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"))


def op10_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_column(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_hnsw, op3_url_filter, op4_language_crf, op5_secret_scan, op6_quality_mil, op7_packing, op8_pii, op9_jaccard_join, op10_avi)}


def _prior_sql(children: str, parent: str) -> str:
    """Counts of each parent and the strength of the beta prior of its children, by moments."""
    sums = f"SELECT {parent}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, count(*) AS kids, sum(n * n)::DOUBLE AS nn, sum(bad * bad / n)::DOUBLE AS kk, sum(bad)::DOUBLE / sum(n) AS m FROM {children} GROUP BY 1"
    spread = f"SELECT *, kk - bad * m - (kids - 1) * m * (1 - m) AS among, (n - nn / n - (kids - 1)) * m * (1 - m) AS room FROM ({sums})"
    return f"SELECT {parent}, n, bad, CASE WHEN rho <= 0.005 THEN 200 WHEN rho >= 0.5 THEN 1 ELSE (1 - rho) / rho END::DOUBLE AS strength FROM (SELECT *, CASE WHEN room > 0 THEN among / room ELSE 0 END AS rho FROM ({spread}))"


def _posterior_sql(children: str, parents: str, key: str) -> str:
    return f"SELECT c.*, c.bad + p.strength * p.a / (p.a + p.b) AS a, c.n - c.bad + p.strength * (1 - p.a / (p.a + p.b)) AS b FROM {children} c JOIN {parents} p USING ({key})"


def _site_sql(host: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({host}, '^[^@]*@', ''), ':[0-9]*$', ''), '[.]$', '')"


def _domain_sql(site: str) -> str:
    return f"CASE WHEN regexp_matches({site}, '{IP_SQL}') THEN {site} ELSE regexp_extract({site}, '{url_filter.DOMAIN}', 1) END"


def _suffix_sql(site: str) -> str:
    return f"CASE WHEN regexp_matches({site}, '{IP_SQL}') THEN 'ip' ELSE ltrim(regexp_extract({site}, '{url_filter.SUFFIX}', 1), '.') END"


IP_SQL = url_filter.IP
URL_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
judged AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY 1),
seen AS (SELECT host, bad FROM (SELECT {_site_sql('host')} AS host, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[.]html)?/?$', 1) AS BIGINT) AS doc_id FROM p) JOIN judged USING (doc_id) WHERE bad IS NOT NULL),
hosts AS (SELECT host, count(*) AS n, sum(bad) AS bad, {_domain_sql('host')} AS domain FROM seen GROUP BY 1),
domains AS (SELECT *, {_suffix_sql('domain')} AS suffix FROM ({_prior_sql('hosts', 'domain')})),
suffixes AS (SELECT *, 0 AS root FROM ({_prior_sql('domains', 'suffix')})),
roots AS (SELECT *, bad + 1 AS a, n - bad + 1 AS b FROM ({_prior_sql('suffixes', 'root')})),
of_suffix AS ({_posterior_sql('suffixes', 'roots', 'root')}),
of_domain AS ({_posterior_sql('domains', 'of_suffix', 'suffix')}),
of_host AS ({_posterior_sql('hosts', 'of_domain', 'domain')}),
posts AS (SELECT p.*, coalesce(h.a, d.a, s.a, r.a, 1) AS a, coalesce(h.b, d.b, s.b, r.b, 1) AS b FROM (SELECT *, {_site_sql('host')} AS site FROM p) p LEFT JOIN of_host h ON h.host = p.site LEFT JOIN of_domain d ON d.domain = {_domain_sql('p.site')} LEFT JOIN of_suffix s ON s.suffix = {_suffix_sql('p.site')} LEFT JOIN roots r ON true),
ruled AS (SELECT *, a / (a + b) AS m, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM posts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN m - sqrt(m * (1 - m) / (a + b + 1)) >= 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


#: Every pair that shares a shingle is counted, and links are followed from every document.
JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(v, o) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.o FROM r JOIN l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(o) AS low FROM r GROUP BY 1) c ON c.v = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": URL_SQL, "op9_jaccard_join": JACCARD_SQL}
