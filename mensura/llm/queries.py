"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ._tables import read
from .exact_dedup import exact_groups
from .fingerprints import edited_likeness
from .html_extract import extract
from .lang_id import languages
from .licenses import MARKS, RULES, SENTENCES, scan
from .mixing import mix
from .near_dedup import near_groups
from .prefix_trie import prefix_trie
from .sentencepiece_bpe import round_trip
from .sharding import assign
from .token_align import align
from .toxicity import score, train
from .url_filter import DOMAINS, SITES, judge
from .url_filter import RULES as URL_RULES


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"), width=3, percent=85)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocked = [(f"{site}.{domain}", "/") for site in SITES for domain in DOMAINS]
    return judge(read(spark, sf_dir, "pages"), URL_RULES, blocked)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return round_trip(read(spark, sf_dir, "documents"), Path(model).read_bytes())


def op11_token_align(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    if a is None or b is None:
        import public_tokenizers

        a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align(read(spark, sf_dir, "documents"), Path(a).read_text(encoding="utf-8"), Path(b).read_bytes())


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"), shards=40)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_licenses, op2_near_dedup, op3_mixing, op4_html_extract, op5_fingerprints, op6_toxicity, op7_exact_dedup, op8_url_filter, op9_language_id, op10_sentencepiece, op11_token_align, op12_sharding, op13_prefix_trie)}


def oracle_sql() -> dict:
    return {"op1_licenses": _op1(), "op7_exact_dedup": OP7, "op8_url_filter": _op8(), "op13_prefix_trie": OP13}


OP7 = r"""
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

#: crc32 by its bits; turns numbered, rebuilt and joined to prefixes; a node's descendants are those whose smallest member passes through it.
OP13 = r"""
WITH o AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
c AS (
    SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, _: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384::BIGINT) ELSE u // 2 END)) AS r
    FROM (SELECT DISTINCT conv_id FROM o)
),
h AS (SELECT conv_id, xor(r, 4294967295::BIGINT) % 4 AS h FROM c),
parts AS (
    SELECT conv_id, 1 AS part, pos, role, text FROM o JOIN h USING (conv_id) WHERE pos > h
    UNION ALL SELECT h.conv_id, 0, o.pos, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND o.pos <= h.h
),
turns AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM parts),
paths AS (
    SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
           list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS node
    FROM turns
    UNION ALL SELECT conv_id, 0, 0, [] FROM h
),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM paths GROUP BY ALL),
children AS (SELECT node[:-2] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
sums AS (
    SELECT p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * o.words)::BIGINT AS saved_tokens
    FROM own o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY ALL
),
lasts AS (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM lasts GROUP BY node)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM own o JOIN sums USING (node) LEFT JOIN ends USING (node) LEFT JOIN own p ON o.depth > 0 AND p.node = o.node[:-2]
"""


def _op1() -> str:
    """Sentences, identifiers and rules as in licenses.py; a step for each rule."""
    known = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    steps = []
    for k, (_, run) in enumerate(RULES):
        joined = "".join(f",{i}," for i in run)
        steps.append(f"s{k} AS (SELECT *, replace(r{k}, '{joined}', '|') AS r{k + 1} FROM {f's{k - 1}' if k else 'first'})")
    hit = ", ".join(f"CASE WHEN r{k} <> r{k + 1} THEN '{name}' END" for k, (name, _) in enumerate(RULES))
    return rf"""
WITH known AS (SELECT * FROM (VALUES {known}) t(s, i)),
parts AS (
    SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+')) AS s,
           generate_subscripts(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), 1) AS k
    FROM documents
),
marked AS (SELECT doc_id, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM parts WHERE regexp_matches(lower(s), '{MARKS}')),
found AS (
    SELECT doc_id, string_agg(i, ',' ORDER BY k) FILTER (i IS NOT NULL) AS ids, string_agg(',' || i || ',', '' ORDER BY k) FILTER (i IS NOT NULL) AS rest,
           count(*) FILTER (i IS NULL) AS unknown
    FROM marked LEFT JOIN known USING (s) GROUP BY doc_id
),
first AS (SELECT d.doc_id, coalesce(ids, '') AS ids, coalesce(rest, '') AS r0, coalesce(unknown, 0) AS unknown FROM documents d LEFT JOIN found f USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, ids AS sentence_ids,
       array_to_string([x FOR x, k IN [{hit}] IF x IS NOT NULL AND list_position([{hit}], x) = k], ',') AS licences,
       len(regexp_extract_all(r{len(RULES)}, ',[^,|]+,')) AS unmatched, unknown
FROM s{len(RULES) - 1}
"""


def _op8() -> str:
    rules = ", ".join(f"('{h}', '{d}', '{v}')" for h, d, v in URL_RULES)
    sites = ", ".join(f"'{site}.{domain}'" for site in SITES for domain in DOMAINS)
    return rf"""
WITH rules AS (SELECT * FROM (VALUES {rules}) t(h, p, v)),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '/.*$') AS path FROM rest),
best AS (
    SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN starts_with(path, '/') AND len(list_filter([{sites}], lambda s: host = s OR ends_with(host, '.' || s))) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""
