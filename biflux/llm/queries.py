"""The registered queries: every operator over its whole table, by contract; name -> (callable, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from biflux.llm import (
    bpe, chat_format, decontaminate, jaccard_join, lm_scoring, phrase_fingerprint, quality_classifier, quality_rules, sharding, substring_dedup,
    toxicity, turn_repair, vector_codes)
from biflux.llm.common import fold, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = toxicity.score(table(spark, sf_dir, "documents"), labels.where(fold(F.col("doc_id"), 4) != 2))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), doc_windows AS (
  SELECT row_no, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT row_no, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k)
), hits AS (
  SELECT row_no, i, k, item FROM doc_windows JOIN item_windows USING (k, win)
), hit_words AS (
  SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + k)) AS p FROM hits) GROUP BY row_no
), hit_items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row_no, item FROM hits) GROUP BY row_no
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (row_no) LEFT JOIN hit_items USING (row_no)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = bpe.read_ranks(lines)
    made = bpe.digest(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    made = chat_format.format_chats(turns).withColumn("read", chat_format.parse(F.col("formatted")))
    made = made.withColumn("learned", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    back = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(back, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    scored = quality_classifier.score(table(spark, sf_dir, "documents"), labels.where(fold(F.col("doc_id"), 5) != 0))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 7) == 2
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept", "carried")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    mended = turn_repair.digest(turn_repair.damage(turns), conversations=turns)
    return mended.withColumnRenamed("repaired", "repaired_sha256")


def op12_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.fingerprint(table(spark, sf_dir, "documents")).drop("carried")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"), carry=("label",))
    coded = vector_codes.with_group_error(coded, F.col("carried.label"))
    return coded.select(
        "vec_id", "code", "error", F.col("group_error").alias("label_error"), F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256"))


_OP6_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, (contains(text, '<|turn|>') OR contains(text, '<|end|>' || chr(10)) OR contains(text, '<|lit|>')) AS odd FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(text) + CASE WHEN odd THEN 5 * (length(text) - length(replace(text, '<|', '|'))) ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

# crc32 bit by bit: the register, then every byte and eight shifts (-1).
_OP11_SQL = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END), 4294967295) % 20 AS fault FROM src
), damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE fault WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS c, body = '' AS blank, body <> '' AND again AS duplicate,
    body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, body = '' OR again AS gone,
    CASE WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS cut,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed
), counts AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), steps AS (  -- least (cost, audit, lines) after i rows: at the start, after system, after user, after assistant
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS p0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS p1,
    {'c': 3, 'a': 'I', 't': chr(10) || 'user:'} AS p2, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS p3 FROM counts
  UNION ALL
  SELECT conv_id, i, p0, p1, p2, list_min(list_filter([p3, {'c': p2.c + 3, 'a': p2.a || 'I', 't': p2.t || chr(10) || 'assistant:'}], lambda x: x.c IS NOT NULL)) FROM (
    SELECT conv_id, i, p0, p1, list_min(list_filter([p2] || list_transform([p0, p1, p3], lambda p: {'c': p.c + 3, 'a': p.a || 'I', 't': p.t || chr(10) || 'user:'}),
      lambda x: x.c IS NOT NULL)) AS p2, p3 FROM (
      SELECT conv_id, i, list_min(list_filter([d0], lambda x: x.c IS NOT NULL)) AS p0,
        list_min(list_filter([d1, CASE WHEN NOT gone AND c = 's' THEN {'c': s0.c + cut, 'a': s0.a || 'K', 't': s0.t || line} END], lambda x: x.c IS NOT NULL)) AS p1,
        list_min(list_filter([d2] || CASE WHEN gone THEN [] ELSE list_transform([s0, s1, s3], lambda p: {'c': p.c + cut + CASE c WHEN 'u' THEN 0 ELSE 3 END,
          'a': p.a || CASE c WHEN 'u' THEN 'K' ELSE 'R' END, 't': p.t || CASE c WHEN 'u' THEN line ELSE chr(10) || 'user:' || text END}) END, lambda x: x.c IS NOT NULL)) AS p2,
        list_min(list_filter([d3, CASE WHEN NOT gone THEN {'c': s2.c + cut + CASE c WHEN 'a' THEN 0 ELSE 3 END, 'a': s2.a || CASE c WHEN 'a' THEN 'K' ELSE 'R' END,
          't': s2.t || CASE c WHEN 'a' THEN line ELSE chr(10) || 'assistant:' || text END} END], lambda x: x.c IS NOT NULL)) AS p3
      FROM (
        SELECT s.conv_id, j.i, j.c, j.gone, j.cut, j.text, chr(10) || j.role || ':' || j.text AS line, s.p0 AS s0, s.p1 AS s1, s.p2 AS s2, s.p3 AS s3,
          {'c': s.p0.c + 4, 'a': s.p0.a || 'D', 't': s.p0.t} AS d0, {'c': s.p1.c + 4, 'a': s.p1.a || 'D', 't': s.p1.t} AS d1,
          {'c': s.p2.c + 4, 'a': s.p2.a || 'D', 't': s.p2.t} AS d2, {'c': s.p3.c + 4, 'a': s.p3.a || 'D', 't': s.p3.t} AS d3
        FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.i = s.i + 1)))
), solved AS (
  SELECT s.conv_id, list_min(list_filter([p0, p3], lambda x: x.c IS NOT NULL)) AS p FROM steps s JOIN counts n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = n.n
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(p.c, 0)::BIGINT AS cost, coalesce(p.a, '') AS audit,
  sha256(coalesce(substr(p.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain rounds over all pairs of parts and entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT r, p, any_value(a) AS a, min({{'d': list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}}) AS m
  FROM cut JOIN book{k} USING (p) GROUP BY r, p
)""")
        if k < rounds:
            steps.append(f"""moved{k} AS MATERIALIZED (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS b FROM (
    SELECT p, m.e AS e, i, sum(a[i])::HUGEINT AS s, count(*) AS n FROM (SELECT p, m, a, unnest(range(1, len(a) + 1)) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e
), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(moved{k}.b, book{k}.b) AS b FROM book{k} LEFT JOIN moved{k} USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS a FROM (SELECT r, v, unnest(range({parts})) AS p FROM kept)
), book0 AS MATERIALIZED (SELECT p, r - 1 AS e, a AS b FROM cut WHERE r <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM kept JOIN near{rounds} USING (r) GROUP BY r, vec_id, label
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


QUERIES = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_sharding": (op2_sharding, None),
    "op3_decontamination": (op3_decontamination, _OP3_SQL),
    "op4_quality_rules": (op4_quality_rules, None),
    "op5_byte_bpe": (op5_byte_bpe, None),
    "op6_chat_format": (op6_chat_format, _OP6_SQL),
    "op7_quality_classifier": (op7_quality_classifier, None),
    "op8_suffix_dedup": (op8_suffix_dedup, None),
    "op9_jaccard_join": (op9_jaccard_join, None),
    "op10_lm_scoring": (op10_lm_scoring, None),
    "op11_turn_repair": (op11_turn_repair, _OP11_SQL),
    "op12_phrase_fingerprint": (op12_phrase_fingerprint, None),
    "op13_vector_codes": (op13_vector_codes, _op13_sql()),
}
