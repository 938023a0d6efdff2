"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..plans.registry import SETTINGS
from . import block_mixing, bpe_count, chunk_dedup, compression_toxicity, conversation_trie, fill_middle, golay_simhash, host_rules, jaccard_join, mincut_extract, pseudonyms, template_match, warc_zip
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The key of the pseudonyms. A deployment passes its own secret.
PSEUDONYM_KEY = "sessionlab"


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_warc_zip", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM g""")
def op1(spark, sf_dir):
    """Pages to WARC packages and back."""
    packages = warc_zip.write_packages(table(spark, sf_dir, "pages"), warc_zip.package_folder(spark))
    return warc_zip.read_records(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_mincut_text")
def op2(spark, sf_dir):
    return mincut_extract.extract(table(spark, sf_dir, "pages"))


@query("op3_chunk_dedup")
def op3(spark, sf_dir):
    return chunk_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


@query("op4_pseudonyms")
def op4(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@query("op5_golay_simhash")
def op5(spark, sf_dir):
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", golay_simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op6_template_decontamination")
def op6(spark, sf_dir):
    return template_match.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_compression_toxicity")
def op7(spark, sf_dir):
    return compression_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_host_rules", r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
wins AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM d WHERE len(ws) >= 8)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM (SELECT doc_id, p, unnest(range(0, 8)) AS k FROM again) GROUP BY doc_id),
c AS (SELECT d.doc_id, d.host, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN marked USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS host_docs, sum(base_failed::BIGINT)::BIGINT AS host_failed FROM b GROUP BY host),
tot AS (SELECT count(*) AS k, sum(host_docs) AS n, sum(host_failed)::DOUBLE / sum(host_docs) AS m FROM h),
v AS (SELECT any_value(m) AS m, sum(host_docs * (host_failed::DOUBLE / host_docs - m) ** 2) / any_value(n) - any_value(m * (1 - m) * k / n) AS between_hosts FROM h, tot),
s AS (SELECT m, CASE WHEN between_hosts > 0 THEN greatest(m * (1 - m) / between_hosts - 1, 1.0) END AS strength FROM v),
r AS (SELECT h.*, CASE WHEN strength IS NULL THEN m ELSE (host_failed + m * strength) / (host_docs + strength) END AS host_rate FROM h, s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.5 AS kept, b.host, round(host_rate, 6) AS host_rate
FROM b JOIN r ON b.host IS NOT DISTINCT FROM r.host""")
def op8(spark, sf_dir):
    found = host_rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", F.round("host_rate", 6).alias("host_rate"))


@query("op9_bpe_count")
def op9(spark, sf_dir):
    return bpe_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_block_mixing")
def op10(spark, sf_dir):
    return block_mixing.Mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op11_conversation_trie", r"""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, conv_id - conv_id % 20 AS base,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                 lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM c)),
r AS (SELECT k.conv_id, 0 AS part, pos, role, text FROM k JOIN c ON c.conv_id = k.base AND pos < h UNION ALL SELECT k.conv_id, 1, pos, role, text FROM k JOIN c ON c.conv_id = k.conv_id AND pos >= h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, md5(length(role) || ':' || role || text) AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, depth, words, md5(string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM o),
s AS (SELECT conv_id, depth, node, lag(node, 1, 'root') OVER (PARTITION BY conv_id ORDER BY depth) AS parent, words FROM p UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM k),
n AS (SELECT node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(depth) AS depth, any_value(parent) AS parent, any_value(words) AS words FROM s GROUP BY node),
kids AS (SELECT parent, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent),
ends AS (SELECT node, string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) AS ids FROM s JOIN (SELECT conv_id, max(depth) AS depth FROM s GROUP BY conv_id) l ON s.conv_id = l.conv_id AND s.depth = l.depth GROUP BY node),
up AS (SELECT a.node AS top, (kids.n IS NULL)::BIGINT AS leaf, (n.n_convs - 1) * n.words AS saved FROM n JOIN s a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN kids ON kids.parent = n.node),
t AS (SELECT top, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY top)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN t ON t.top = n.node LEFT JOIN kids ON kids.parent = n.node LEFT JOIN ends ON ends.node = n.node LEFT JOIN n o ON o.node = n.parent""")
def op11(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op12_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS b, array_to_string(u[j + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""")
def op12(spark, sf_dir):
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", F.col("cut1").alias("prefix_chars"), (F.col("cut2") - F.col("cut1")).alias("middle_chars"),
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op13_jaccard_join")
def op13(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
