"""The operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm import bpe, chat_format, decontaminate, fill_middle, line_dedup, prefix_trie, quality_model, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which a window occurs in it."""
    return decontaminate.leaked_items(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that a document of smaller id has."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source taken out of every document."""
    done = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__n_lines").cast("long").alias("n_lines"),
                       F.col("__n_dropped").cast("long").alias("n_dropped"),
                       F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


ORACLE["op3_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT r, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
n AS (SELECT source, key, count(DISTINCT r) AS n_pages FROM k WHERE key <> '' GROUP BY source, key),
t AS (SELECT source, count(*) AS host_pages FROM d GROUP BY source),
bad AS (SELECT n.source, n.key FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
        WHERE n_pages >= {line_dedup.MIN_PAGES} AND n_pages > host_pages * CAST({line_dedup.RATIO} AS DOUBLE)),
m AS (SELECT k.r, k.pos, k.line, bad.key IS NOT NULL AS gone
      FROM k LEFT JOIN bad ON k.source IS NOT DISTINCT FROM bad.source AND k.key = bad.key)
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       md5(coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT gone), '')) AS kept_md5
FROM m JOIN d USING (r) GROUP BY d.r
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of every whole text through the multi-language byte-level vocabulary."""
    done = bpe.encode(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents, 4-word shingles, 4 bits."""
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of every document from stored prefix counts."""
    return token_counts.token_counts(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret candidate of every document, scored by the forest."""
    return secret_scan.scan(spark, _table(spark, sf_dir, "documents"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by trees learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, _table(spark, sf_dir, "labels")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every conversation from the perspective of each of its participants."""
    return chat_format.segments(_table(spark, sf_dir, "conversations"))


ORACLE["op9_chat_format"] = f"""
WITH s AS (SELECT DISTINCT conv_id, turn, coalesce(role, '{chat_format.UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM s WHERE role <> 'system'),
r AS (SELECT s.*, p.perspective, CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN role
      ELSE 'user name=' || role END AS speaker FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
g AS (SELECT *, '{chat_format.BEGIN}' || speaker || chr(10) AS head FROM r),
h AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM g),
o AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) AS char_end FROM h
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, speaker, segment, char_end - length(segment) AS char_start, char_end,
       CASE WHEN speaker = 'assistant' THEN char_end - length(segment) + length(head) END AS mask_start,
       CASE WHEN speaker = 'assistant' THEN char_end - 1 END AS mask_end FROM o
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base columns of every document and the verdict of the cascade."""
    return quality_rules.apply_rules(spark, _table(spark, sf_dir, "documents"))


ORACLE["op10_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT r, doc_id, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
      length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals,
      len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered FROM d),
win AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, sum(least(8, i - last)) AS n FROM
        (SELECT r, i, lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i) AS last FROM twice) GROUP BY r),
c AS (SELECT b.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM b LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words * 5 OR n_dup_lines * 10 > len(ls) * 5 OR word_chars < n_words * 2
            OR word_chars > n_words * 20 OR lettered * 10 < n_words * 5 OR capitals * 2 > word_chars) AS kept FROM f
"""


def op11_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equally many rows, equal texts together where shards can hold them."""
    done = sharding.balance(_table(spark, sf_dir, "documents"), 24)
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the conversations rebuilt with shared openings."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), shared_openings=True).drop("thi", "tlo")


ORACLE["op12_prefix_trie"] = r"""
WITH tab AS (SELECT list(list_reduce(list_concat([CAST(i AS BIGINT)], [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
said AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS m FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, m.r, m.x) AS ms FROM said GROUP BY conv_id),
h AS (SELECT conv_id, ms, conv_id - conv_id % 20 AS base,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
            lambda a, d: xor(a // 256, t[xor(a, d) % 256 + 1])), 4294967295) % 4 AS h FROM own, tab),
c AS (SELECT h.conv_id, list_concat(coalesce(b.ms[1 : h], []), h.ms[h + 1 :]) AS ms FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, ms[1 : d] AS k, len(ms) AS size FROM (SELECT *, unnest(range(len(ms) + 1)) AS d FROM c)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = d AS leaf,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '') AS ends,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].x, '[^ 	-
]+')) END AS words FROM p GROUP BY k, d),
up AS (SELECT k[1 : a] AS k, a AS d, n.d = a + 1 AS child, leaf, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM n) n),
s AS (SELECT k, d, count(*) FILTER (child) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM up GROUP BY k, d)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON n.d = s.d AND n.k = s.k LEFT JOIN n q ON q.d = n.d - 1 AND q.k = n.k[1 : n.d - 1]
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document, cut at lines; digests of the output and of the text rebuilt from it."""
    done = fill_middle.transform(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored("output", "form"), 256).alias("restored_sha256"))


ORACLE["op13_fill_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (len(ls) + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (len(ls) + 1) AS b,
      CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
      coalesce(array_to_string(ls[1 : least(a, b)], ''), '') AS p,
      coalesce(array_to_string(ls[least(a, b) + 1 : greatest(a, b)], ''), '') AS m,
      coalesce(array_to_string(ls[greatest(a, b) + 1 :], ''), '') AS x FROM h)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m
              ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""

for _query in (op1_decontaminate, op2_suffix_dedup, op3_line_dedup, op4_byte_bpe, op5_simhash, op6_token_counts, op7_secret_scan, op8_quality_trees, op9_chat_format, op10_quality_rules,
               op11_balanced_shards, op12_prefix_trie, op13_fill_middle):
    QUERIES[_query.__name__] = _query
