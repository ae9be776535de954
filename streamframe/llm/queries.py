"""The ten operators as registered queries: whole tables, production parameters, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, html_text, mixing, near_dup, packing, pii, quality, toxicity, url_filter
from .common import read


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file is; the operators take the path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))



QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(read(spark, sf_dir, "documents"))
    return quality.verdicts(book, quality.POLICIES[quality.PRODUCTION]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
    )


@query
def llm_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(read(spark, sf_dir, "documents"))
    return quality.ablation(book, quality.POLICIES[quality.PRODUCTION])


_LEDGER_SQL = r"""
w AS (
  SELECT rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
tri AS (
  SELECT rid, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) t, (VALUES (0), (1), (2)) AS o(k)
  WHERE n > 1 GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '^[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS n_alpha_words,
         len(list_filter(ws, lambda x: octet_length(encode(x)) > 40)) AS n_long_words,
         len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_bang_words
  FROM w LEFT JOIN rep USING (rid)),
ledger AS (
  SELECT *, ({bits})::BIGINT AS failed FROM m)
""".replace("{bits}", " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES)))
_MASK = quality.POLICIES[quality.PRODUCTION].mask

ORACLES["op1_quality_rules"] = f"""WITH {_LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {quality.mask_of(quality.BASE)}) <> 0 AS base_failed, (failed & {_MASK}) = 0 AS kept, failed
FROM ledger"""
ORACLES["llm_quality_ablation"] = f"""WITH {_LEDGER_SQL},
r(rule, bit) AS (VALUES {", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(quality.RULES) if r.name in quality.POLICIES[quality.PRODUCTION].rules)})
SELECT rule, count(*) FILTER ((failed & bit) <> 0) AS n_failed, count(*) FILTER ((failed & {_MASK}) = bit) AS n_only, count(*) AS n_docs
FROM ledger, r GROUP BY rule"""


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op2_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256({_LOWER}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {_LOWER})"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(read(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.join(read(spark, sf_dir, "documents")).drop("row")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.counted("base", k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed("base").cast("binary"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"),
        pii.counted("spans", "secret").alias("n_secret"), F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_chats(turns))


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{r.host}', '{r.path}', {str(r.allow).lower()})" for r in url_filter.RULES)
_FIT_SQL = "SELECT {0}.k, max_by(struct_pack(rule := r.h || r.p, allow := r.allow), length(r.h || r.p)) AS d FROM {0}, rules r WHERE ({0}.host = r.h OR ends_with({0}.host, '.' || r.h)) AND starts_with({0}.path, r.p) GROUP BY {0}.k"

ORACLES["op7_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '', '\'), '<</SYS>>|<<SYS>>|\[/ROLE\]|\[/INST\]|\[INST\]|\[ASST\]|\[ROLE\]|\[AS\]|</s>|<s>', 'x\0', 'g'))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 ELSE 17 + length(role) END AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
# A page's first canonical link and first refresh, as absolute addresses; nodes are host, path and query. Components are what the
# edges reach, by a recursive query; a component passes on an allow before a block.
_NODE_SQL = r"""CASE WHEN contains({0}, '://') AND regexp_extract(substr({0}, instr({0}, '://') + 3), '^[^/?#]*') <> '' THEN
    translate(regexp_extract(substr({0}, instr({0}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE WHEN regexp_extract(substr({0}, instr({0}, '://') + 3), '^[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(substr({0}, instr({0}, '://') + 3), '^[^/?#]*([^?#]*)', 1) END
    || regexp_extract({0}, '^[^?#]*(\?[^#]*)', 1) END"""
_LINK_SQL = r"""regexp_extract(list_filter(regexp_extract_all(html, '(?is)<{0}\b[^>]*>'), lambda x: regexp_matches(x, '(?is)\b{1}') AND regexp_matches(x, '(?is)\b{2}'))[1], '(?is)\b{2}', 1)"""
_Q, _VALUE = r"""["\x27]?""", r"""[^"\x27\s>]"""
_CANONICAL_SQL = _LINK_SQL.format("link", rf"rel\s*=\s*{_Q}canonical\b", rf"href\s*=\s*{_Q}({_VALUE}+)")
_REFRESH_SQL = _LINK_SQL.format("meta", rf"http-equiv\s*=\s*{_Q}refresh\b", rf"content\s*=\s*{_Q}[^\x22\x27>]*?url\s*=\s*{_Q}({_VALUE}+)")
ORACLES["op8_url_filters"] = rf"""
WITH RECURSIVE rules(h, p, allow) AS (VALUES {_RULES_SQL}),
x AS (
  SELECT row_number() OVER () AS k, page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
y AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM x),
z AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path, {_NODE_SQL.format("url")} AS node FROM y),
fit AS ({_FIT_SQL.format("z")}),
links AS (SELECT url, replace(link, '&amp;', '&') AS link FROM (SELECT url, unnest([{_CANONICAL_SQL}, {_REFRESH_SQL}]) AS link FROM pages) WHERE link <> ''),
whole AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^?#]*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^?#]*?://[^/?#]*)', 1) || link
    WHEN regexp_extract(url, '^([^?#]*?://[^?#]*/)', 1) = '' THEN regexp_extract(url, '^([^?#]*?://[^/?#]*)', 1) || '/' || link
    ELSE regexp_extract(url, '^([^?#]*?://[^?#]*/)', 1) || link END AS link FROM links),
edge AS (SELECT DISTINCT a, b FROM (SELECT {_NODE_SQL.format("url")} AS a, {_NODE_SQL.format("link")} AS b FROM whole) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(n, m) AS (SELECT a, a FROM both_ways UNION SELECT reach.n, both_ways.b FROM reach JOIN both_ways ON reach.m = both_ways.a),
member AS (SELECT m AS k, regexp_extract(m, '^[^/?#]*') AS host, regexp_extract(m, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT DISTINCT m FROM reach)),
member_fit AS ({_FIT_SQL.format("member")}),
passed AS (SELECT n AS node, bool_or(d.allow) AS passed FROM reach JOIN member_fit ON reach.m = member_fit.k GROUP BY n)
SELECT page_id, host, path, d.rule AS rule, CASE WHEN coalesce(d.allow, passed, true) THEN 'allow' ELSE 'block' END AS verdict
FROM z LEFT JOIN fit USING (k) LEFT JOIN passed USING (node)"""
