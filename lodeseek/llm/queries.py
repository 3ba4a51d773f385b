"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, ctw, decontaminate, fingerprint, line_dedup, ngram_join, quality, secret_scan, sp_codec, url_filter
from .common import table

URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op7_sp_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(table(spark, sf_dir, "documents"), check=True)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no repositories: an owner is a source, and what it has in one language a repository."""
    repo = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents"), repo=repo))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_fingerprint": op3_fingerprint,
    "op4_ngram_join": op4_ngram_join,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_sp_codec": op7_sp_codec,
    "op8_line_dedup": op8_line_dedup,
    "op9_ctw": op9_ctw,
    "op10_secret_scan": op10_secret_scan,
}
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The tables' pages have no canonical links or redirects, so the rules alone decide there.
_URL = """WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT page_id, {low} AS host, path FROM p), r(verdict, host, path, rule) AS (VALUES {rules}),
f AS (SELECT page_id, r.rule, r.verdict FROM q JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)),
b AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY 1)
SELECT q.page_id, q.host, q.path, b.rule, coalesce(b.verdict, 'allow') AS verdict, CASE WHEN b.rule IS NULL THEN 'default' ELSE 'rule' END AS reason FROM q LEFT JOIN b USING (page_id)""".format(
    low=_LOW.format("h"), rules=", ".join(f"('{v}', '{t.split('/', 1)[0]}', '/{t.split('/', 1)[1]}', '{t}')" for v, t in URL_RULES)
)

_LEAK = """WITH d AS (SELECT doc_id, regexp_extract_all({doc}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(10, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({item}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, k, k + m - 1), ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
dw AS (SELECT doc_id, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM wins) WHERE len(w) >= m)),
occ AS (SELECT doc_id, k, m, item FROM dw JOIN wins USING (m, t)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS pos FROM occ) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""".format(doc=_LOW.format("coalesce(text, '')"), item=_LOW.format("coalesce(text, '')"))

_NEAR = """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1""".format(low=_LOW.format("coalesce(text, '')"))

_CHAT = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
k AS (SELECT *, len(regexp_extract_all(text, '</?s>')) + len(regexp_extract_all(text, '\\[/?(?:INST|ASST|SYS|ROLE:)')) AS marks, CASE role WHEN 'system' THEN 3 ELSE 4 END AS tag FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(14 + 2 * tag + length(text) + CASE WHEN marks > 0 THEN 1 + marks + length(text) - length(replace(text, chr(92), '')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM k GROUP BY conv_id"""


def _span_sql(kind: str, ord_: int, pattern: str, group: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, source, lang, '{kind}' AS kind, {ord_} AS o, h, v, CAST(list_sum(list_transform(list_slice(g, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(hs, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS s
 FROM (SELECT doc_id, source, lang, hs, g, unnest(hs) AS h, unnest(vs) AS v, unnest(range(1, len(hs) + 1)) AS i FROM (SELECT doc_id, source, lang, regexp_extract_all(text, '{p}', 0) AS hs, regexp_extract_all(text, '{p}', {group}) AS vs, regexp_split_to_array(text, '{p}') AS g FROM t)) WHERE length(v) >= {least}"""


_SECRET = f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_span_sql(k, i, *x[:3]) for i, (k, *x) in enumerate(secret_scan.KINDS))}),
looks AS (SELECT *, s + length(h) AS e, length(v) >= {secret_scan.LEAST_CHARS} AND len(regexp_extract_all(v, '{secret_scan.GLUED}')) >= {secret_scan.LEAST_GLUED} AND list_aggregate(string_split(v, ''), 'entropy') >= {secret_scan.LEAST_BITS} AS l FROM m),
freq AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT source || '/' || lang) AS repos FROM looks WHERE l GROUP BY v),
marked AS (SELECT v, CASE WHEN owners = 1 AND repos <= {secret_scan.LIVE_REPOS} THEN 'live' WHEN owners >= {secret_scan.EXAMPLE_OWNERS} THEN 'example' END AS k FROM freq),
spans AS (SELECT doc_id, kind, o, s, e FROM looks WHERE kind <> 'opaque' UNION ALL SELECT DISTINCT doc_id, k, CASE k WHEN 'live' THEN 4 ELSE 5 END, e - length(v), e FROM looks JOIN marked USING (v) WHERE l AND k IS NOT NULL),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS x,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER (o < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""

ORACLE_SQL = {"op1_url_filter": _URL, "op2_decontaminate": _LEAK, "op4_ngram_join": _NEAR, "op5_chat_format": _CHAT, "op10_secret_scan": _SECRET}
