"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, pieces, url_lists
from .common import table
from .exact_dedup import exact_groups
from .filter_audit import audit
from .html_text import extract
from .licences import scan
from .media import media_columns
from .ngram_join import jaccard_components
from .prefix_trie import prefix_trie
from .token_store import token_ids
from .toxicity import toxicity
from .warc import warc_round_trip


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated block and allow list over the hosts and first path segments of pages, by MD5 of the pattern."""
    url = F.col("url")
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1)
    hosts = pages.select(F.concat(F.lit("d:"), url_lists.host(url)).alias("key"), F.lit("block").alias("kind"), F.lit(5).alias("part")).filter("key != 'd:'")
    prefixes = pages.filter(first != "").select(F.concat(F.lit("p:"), url_lists.host(url), F.lit("/"), first).alias("key"))
    both = [prefixes.select("key", F.lit(kind).alias("kind"), F.lit(part).alias("part")) for kind, part in (("block", 7), ("allow", 11))]
    h = F.conv(F.substring(F.md5(F.concat("kind", "key")), 1, 8), 16, 10).cast("long")
    all_ = hosts.unionByName(both[0]).unionByName(both[1]).distinct().withColumn("h", h).filter("h % part = 0")
    start = F.to_date(F.lit("2024-01-01"))
    turns = [("add", F.lit(True), F.col("h") % 200), ("remove", F.col("h") % 2 == 0, F.col("h") % 200 + 30 + F.col("h") % 60), ("add", F.col("h") % 4 == 0, F.col("h") % 200 + 120)]
    events = [all_.filter(when).select("key", "kind", F.lit(action).alias("action"), F.date_add(start, days.cast("int")).alias("day")) for action, when, days in turns]
    return events[0].unionByName(events[1]).unionByName(events[2])


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 365).cast("int")))
    return url_lists.judged(captures, list_entries(pages))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


#: Target weights of op3: shares of expected tokens by domain.
MIX = {"high": 0.9, "low": 0.1}


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), mixing.of_quality(table(spark, sf_dir, "labels")), MIX)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(table(spark, sf_dir, "documents"), pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_source_mixing": op3_source_mixing,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_url_filters": op7_url_filters,
    "op8_token_store": op8_token_store,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_media_columns": op10_media_columns,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_filter_audit": op12_filter_audit,
    "op13_license_scan": op13_license_scan,
}

ORACLES: dict[str, str] = {
    "op7_url_filters": r"""
WITH u AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS day,
                  rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1) AS seg,
                  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS parts FROM pages),
k AS (SELECT DISTINCT 'd:' || host AS key, 'block' AS kind, 5 AS part FROM u WHERE host <> ''
      UNION SELECT 'p:' || host || '/' || seg, 'block', 7 FROM u WHERE seg <> '' UNION SELECT 'p:' || host || '/' || seg, 'allow', 11 FROM u WHERE seg <> ''),
h AS (SELECT *, CAST('0x' || md5(kind || key)[1:8] AS BIGINT) AS h FROM k), e0 AS (SELECT * FROM h WHERE h % part = 0),
e AS (SELECT key, kind, 'add' AS action, DATE '2024-01-01' + CAST(h % 200 AS INTEGER) AS day FROM e0
      UNION ALL SELECT key, kind, 'remove', DATE '2024-01-01' + CAST(h % 200 + 30 + h % 60 AS INTEGER) FROM e0 WHERE h % 2 = 0
      UNION ALL SELECT key, kind, 'add', DATE '2024-01-01' + CAST(h % 200 + 120 AS INTEGER) FROM e0 WHERE h % 4 = 0),
d AS (SELECT key, kind, day, max(action) AS action FROM e GROUP BY ALL),
s AS (SELECT key, kind, action, day AS since, coalesce(lead(day) OVER (PARTITION BY key, kind ORDER BY day), DATE '9999-12-31') AS until FROM d),
c AS (SELECT page_id, day, unnest(list_distinct(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'd:' || array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(parts) + 1), lambda i: 'p:' || host || '/' || array_to_string(parts[1:i], '/'))))) AS key FROM u WHERE host <> ''),
m AS (SELECT page_id, count(*) AS n, max({'n': length(key), 'allow': kind = 'allow', 'key': key}) AS top
      FROM c JOIN s USING (key) WHERE s.action = 'add' AND since <= c.day AND c.day < until GROUP BY page_id)
SELECT u.page_id, host, u.day, coalesce(n, 0)::BIGINT AS n_active, coalesce(NOT top.allow, false) AS blocked, top.key AS pattern FROM u LEFT JOIN m USING (page_id)
""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
    # CRC-32 bit by bit over the decimal's characters; prefixes as lists of turns, their first conversations as names
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                 lambda s, x: list_reduce(list_concat([xor(s, x)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 6 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS own, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h
      UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
s AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS depth FROM r),
p AS (SELECT conv_id, depth, length(text) AS chars, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, depth = count(*) OVER (PARTITION BY conv_id) AS last FROM s
      UNION ALL SELECT conv_id, 0, 0, [], conv_id NOT IN (SELECT conv_id FROM s) FROM c),
w AS (SELECT conv_id AS member, depth, chars, last, min(conv_id) OVER (PARTITION BY depth, prefix) AS conv_id FROM p),
n AS (SELECT conv_id, depth, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, coalesce(string_agg(member, ',' ORDER BY member) FILTER (last), '') AS ends FROM w GROUP BY ALL),
up AS (SELECT DISTINCT w.conv_id, w.depth, u.conv_id AS parent_conv_id FROM w JOIN w u ON u.member = w.member AND u.depth = w.depth - 1),
ch AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (conv_id, depth)),
sub AS (SELECT a.conv_id, a.depth, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
        FROM f JOIN w a ON a.member = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN sub USING (conv_id, depth) LEFT JOIN up USING (conv_id, depth)
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-]+') AS words FROM d),
m AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS prior FROM o, range(1, 6) x(step)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (bit | prior) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
""",
}
