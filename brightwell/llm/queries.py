"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from brightwell.llm import (chat, conversation_repair, decontaminate, exact_dedup, html_main, line_dedup, piece_bpe, quality,
                            ranked_search, simhash, substring_dedup, token_store, toxicity)
from brightwell.llm.shared import read_table, shared_folder

BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOXIC_FROM, QUALITY_FROM = 0.7, 0.3
NEAR_SHINGLE, NEAR_BITS = 3, 2


def remainder(divisor: int):
    """crc32 of doc_id as text modulo ``divisor``, as a condition's left side."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    token_store.write_tokens(read_table(spark, sf_dir, "documents"), folder, BYTE_BPE, end_id=0)
    return token_store.token_digests(token_store.read_tokens(spark, folder))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels, "toxic", remainder(3) != 1)
    return toxicity.score(documents, model).select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read_table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = r"'\\### Assistant: </turn> ok'"
    added = spark.sql(f"SELECT -7L AS conv_id, stack(2, 0L, 'user', {own}, 1L, 'assistant', {own}) AS (turn, role, text)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    folder = shared_folder(spark, "chat")
    chat.format_conversations(turns).write.parquet(folder)
    return chat.conversation_digests(spark.read.parquet(folder))


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    forest = quality.fit(documents, labels, "quality", remainder(5) != 0)
    return quality.score(documents, forest).select(
        "doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), NEAR_SHINGLE, NEAR_BITS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeated_windows(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    blocks = conversation_repair.repaired_blocks(conversation_repair.damaged(conversations))
    return conversation_repair.of_every_conversation(conversation_repair.summaries(blocks), conversations)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(read_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, read_table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_store, op2_toxicity, op3_html_main_text, op4_line_dedup, op5_decontamination,
                                   op6_chat_format, op7_piece_bpe, op8_quality, op9_simhash, op10_exact_dedup,
                                   op11_substring_dedup, op12_conversation_repair, op13_ranked_search)}

ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL = {
    "op4_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS place FROM split),
keyed AS (SELECT *, translate(trim(line, {BLANKS}), {ALPHABETS}) AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT l.*, (s.k IS NOT NULL AND l.doc_id > s.first) AS lost FROM keyed l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op5_decontamination": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHABETS}), {WORDS}) AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHABETS}), {WORDS}) AS a FROM benchmark),
runs AS (SELECT item_id, a[i + 1 : i + least(10, len(a))] AS g
         FROM (SELECT item_id, a, unnest(range(greatest(1, len(a) - 9))) AS i FROM b WHERE len(a) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM runs),
places AS (SELECT doc_id, i, n, a[i + 1 : i + n] AS g
           FROM (SELECT doc_id, a, unnest(range(len(a))) AS i FROM w), sizes WHERE i + n <= len(a)),
found AS (SELECT p.doc_id, p.i, p.n, r.item_id FROM places p JOIN runs r ON p.g = r.g),
hits AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1)
SELECT w.doc_id, len(a) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN hits h ON w.doc_id = h.doc_id LEFT JOIN named n ON w.doc_id = n.doc_id""",
    "op6_chat_format": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
bodies AS (SELECT *, CASE WHEN contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\b') OR contains(text, '\h')
        OR contains(text, '\e') THEN replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e') ELSE text END AS body
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || body || '</turn>') + 1) AS BIGINT) AS formatted_chars
FROM bodies GROUP BY conv_id""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
           FROM documents),
g AS (SELECT t, count(*) AS group_size, max(size) AS most FROM n GROUP BY t),
k AS (SELECT n.t, min(doc_id) AS keep_id FROM n JOIN g ON n.t = g.t AND size = most GROUP BY n.t)
SELECT n.doc_id, k.keep_id, g.group_size, n.doc_id = k.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t JOIN k ON n.t = k.t""",
    "op11_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
runs AS (SELECT doc_id, i, array_to_string(a[i + 1 : i + 50], ' ') AS g
         FROM (SELECT doc_id, a, unnest(range(len(a) - 49)) AS i FROM w WHERE len(a) >= 50)),
shared AS (SELECT g, min(doc_id) AS first FROM runs GROUP BY g HAVING min(doc_id) < max(doc_id)),
lost AS (SELECT DISTINCT r.doc_id, unnest(range(r.i, r.i + 50)) AS spot FROM runs r JOIN shared s ON r.g = s.g
         WHERE r.doc_id > s.first),
words AS (SELECT doc_id, unnest(a) AS word, unnest(range(len(a))) AS spot FROM w),
kept AS (SELECT x.doc_id, count(l.spot) AS n_removed, string_agg(word, ' ' ORDER BY x.spot) FILTER (WHERE l.spot IS NULL) AS t
         FROM words x LEFT JOIN lost l ON x.doc_id = l.doc_id AND x.spot = l.spot GROUP BY x.doc_id)
SELECT w.doc_id, len(a) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "op12_conversation_repair": r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS code FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
        CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
judged AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
        rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
graded AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
    FROM judged),
paths AS (
    SELECT conv_id, 0 AS i, count(*) AS n, {c: 0, a: '', t: ''} AS e0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS es,
        {c: 3, a: 'I', t: chr(10) || 'user:'} AS eu, {c: 6, a: 'II', t: chr(10) || 'user:' || chr(10) || 'assistant:'} AS ea
    FROM graded GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, n, e0, es, eu, list_min([ea, {c: eu.c + 3, a: eu.a || 'I', t: eu.t || chr(10) || 'assistant:'}]) FROM (
        SELECT conv_id, i, n, e0, es, ea, list_min(list_filter([eu, {c: e0.c + 3, a: e0.a || 'I', t: e0.t || chr(10) || 'user:'},
            {c: es.c + 3, a: es.a || 'I', t: es.t || chr(10) || 'user:'},
            {c: ea.c + 3, a: ea.a || 'I', t: ea.t || chr(10) || 'user:'}], lambda x: x.c IS NOT NULL)) AS eu FROM (
            SELECT p.conv_id, g.i::INTEGER AS i, n, {c: e0.c + 4, a: e0.a || 'D', t: e0.t} AS e0,
                list_min(list_filter([{c: es.c + 4, a: es.a || 'D', t: es.t},
                    {c: CASE WHEN ok AND r = 's' THEN e0.c + cut END, a: e0.a || 'K', t: e0.t || own}], lambda x: x.c IS NOT NULL)) AS es,
                list_min(list_filter([{c: eu.c + 4, a: eu.a || 'D', t: eu.t},
                    {c: CASE WHEN ok AND r = 'u' THEN e0.c + cut END, a: e0.a || 'K', t: e0.t || own},
                    {c: CASE WHEN ok AND r = 'u' THEN es.c + cut END, a: es.a || 'K', t: es.t || own},
                    {c: CASE WHEN ok AND r = 'u' THEN ea.c + cut END, a: ea.a || 'K', t: ea.t || own},
                    {c: CASE WHEN ok THEN e0.c + cut + 3 END, a: e0.a || 'R', t: e0.t || chr(10) || 'user:' || text},
                    {c: CASE WHEN ok THEN es.c + cut + 3 END, a: es.a || 'R', t: es.t || chr(10) || 'user:' || text},
                    {c: CASE WHEN ok THEN ea.c + cut + 3 END, a: ea.a || 'R', t: ea.t || chr(10) || 'user:' || text}],
                    lambda x: x.c IS NOT NULL)) AS eu,
                list_min(list_filter([{c: ea.c + 4, a: ea.a || 'D', t: ea.t},
                    {c: CASE WHEN ok AND r = 'a' THEN eu.c + cut END, a: eu.a || 'K', t: eu.t || own},
                    {c: CASE WHEN ok THEN eu.c + cut + 3 END, a: eu.a || 'R', t: eu.t || chr(10) || 'assistant:' || text}],
                    lambda x: x.c IS NOT NULL)) AS ea
            FROM paths p JOIN (SELECT conv_id, i, r, text, chr(10) || role || ':' || text AS own, fault NOT IN ('b', 'd') AS ok,
                CASE fault WHEN 't' THEN 3 ELSE 0 END AS cut FROM graded) g
            ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1))),
ends AS (SELECT conv_id, list_min([e0, ea]) AS best FROM paths WHERE i = n),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
        count(*) FILTER (WHERE fault = 't') AS truncated,
        count(*) FILTER (WHERE i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM graded GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_ranked_search": rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, {ALPHABETS}), {WORDS})) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS d, sum(n)::BIGINT AS l FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * d + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, d),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {ALPHABETS}), {WORDS})) AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * d) // l))))::BIGINT AS score
           FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50""",
}
