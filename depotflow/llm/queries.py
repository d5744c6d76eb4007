"""The named queries of the operators, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from depotflow.llm import (
    chat,
    conversation_repair,
    curves,
    decontaminate,
    divergence,
    mixing,
    quality,
    shards,
    simhash,
    suffixes,
    surrogates,
    token_counts,
    token_files,
)
from depotflow.llm.common import stage

SHARDS = 24
TOKENIZER, END_ID = "word_bpe_49k.json", 2
TARGETS = {"plain": 0.95, "toxic": 0.04, "junk": 0.01}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def domains(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", mixing.label_domain().alias("domain"))


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_files.read_documents(token_files.write_tokens(docs, public_tokenizers.path(TOKENIZER), END_ID))


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text", F.crc32(text.cast("binary")).alias("text_crc32"))
    return shards.assign_shards(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    mixed = mixing.mix(docs, domains(spark, folder), TARGETS)
    parts = [F.get("posterior", k).alias(f"p_{name}") for k, name in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *parts, "rate", "copies")


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# A conversation whose texts hold what common templates use to mark turns.
TRICKY = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    return chat.digests(stage(chat.format_chats(turns.unionByName(tricky))))


CHAT_SQL = r"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), ordered AS (
    SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before FROM given
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
    SELECT *,
        length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS text_chars,
        length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) AS role_chars
    FROM ordered
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(text_chars + CASE WHEN before = role THEN length('<and>')
        ELSE role_chars + length('<turn><says>') + length('<end>') + 1 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, folder, "documents").select("doc_id", "text"), secret="corpus")


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), words=3, bits=2)


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return curves.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


COUNTED, TOKEN_LIMIT = "piece_bpe_32k.model", 4096


def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(COUNTED), TOKEN_LIMIT)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.damage_and_repair(table(spark, folder, "conversations"))


# The same repair as steps of an automaton over the rows, with every state's smallest cost and audit kept after each row.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
            lambda x: ord(x)::BIGINT) AS bytes
    FROM conversations
), given AS ( -- CRC-32, bit by bit
    SELECT conv_id, turn, role, text, xor(4294967295::BIGINT, list_reduce(bytes, lambda c, b:
        list_reduce(range(8), lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END, xor(c, b)),
        4294967295::BIGINT)) % 20 AS kind
    FROM keyed
), ids AS (
    SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), hit AS (
    SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
    FROM given JOIN ids ON given.conv_id IS NOT DISTINCT FROM ids.conv_id
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n,
        regexp_extract(text, '(?s).*([^\x20\x09-\x0D])', 1) AS last_char FROM hit
), judged AS (
    SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY n) AS before,
        CASE WHEN last_char = '' THEN 'blank'
            WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
            WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM numbered
), counted AS (
    SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n_rows,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY c
), inserted(p, q, cost, audit, made) AS (
    VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
        (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']), (3, 2, 2, 'I', ['user:']), (2, 3, 2, 'I', ['assistant:']),
        (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
), moves(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edits AS (
    SELECT c, n, p, p AS q, 3 AS cost, 'D' AS audit, []::VARCHAR[] AS made FROM judged, (VALUES (0), (1), (2), (3)) AS states(p)
    UNION ALL
    SELECT c, n, p, q, CAST(fault = 'truncated' AS INTEGER), 'K', [role || ':' || text] FROM judged JOIN moves USING (initial)
    WHERE fault IN ('', 'truncated')
    UNION ALL
    SELECT c, n, p, q, 2 + CAST(fault = 'truncated' AS INTEGER), 'R',
        [CASE moves.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
    FROM judged, moves WHERE fault IN ('', 'truncated') AND moves.initial <> 's'
), walked AS (
    SELECT c, CAST(0 AS BIGINT) AS n, 0 AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS made FROM counted
    UNION ALL
    SELECT * FROM (
        SELECT w.c, e.n, e.q, w.cost + i.cost + e.cost AS cost, w.audit || i.audit || e.audit AS audit,
            list_concat(list_concat(w.made, i.made), e.made) AS made
        FROM walked w JOIN inserted i ON i.p = w.q JOIN edits e ON e.c = w.c AND e.n = w.n + 1 AND e.p = i.q
        QUALIFY row_number() OVER (PARTITION BY w.c, e.q ORDER BY w.cost + i.cost + e.cost, w.audit || i.audit || e.audit) = 1
    )
), ended AS (
    SELECT w.c, w.cost + i.cost AS cost, w.audit || i.audit AS audit, list_concat(w.made, i.made) AS made
    FROM walked w JOIN counted USING (c) JOIN inserted i ON i.p = w.q WHERE w.n = n_rows AND i.q IN (0, 3)
    QUALIFY row_number() OVER (PARTITION BY w.c ORDER BY w.cost + i.cost, w.audit || i.audit) = 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
    sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counted USING (c) LEFT JOIN ended USING (c)
"""


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergences(table(spark, folder, "documents").select("text", "lang", "source"))


# The sum over every kept term for every pair, without the tree.
DIVERGENCE_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), said AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS total FROM said GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM said JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 2)::HUGEINT) // (g.n + 2 * l.v) AS p,
        1 + (1000000000 * (k.total + 2)::HUGEINT) // (l.n + 2 * l.v) AS q
    FROM sizes g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_surrogates": op7_surrogates,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_nearest": op10_nearest,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE = {"op5_chat_format": CHAT_SQL, "op12_conversation_repair": REPAIR_SQL, "op13_source_divergence": DIVERGENCE_SQL}
