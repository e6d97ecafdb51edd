"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, lm_score, mixing, simhash_dedup, token_counts, toxicity
from .common import crc_mod, table

#: A conversation whose texts look like control strings.
CONTROL_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.Vocabulary.load(vocabulary))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "dropped_lines")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(crc_mod("doc_id", 4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.learn(docs, labels.where(crc_mod("doc_id", 5) != 0))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.col("hits"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    found = lm_score.lm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.chat_digest(chat_format.format_chat(turns.unionByName(extra)))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"), width=3, seed=42, budget=3)


def op11_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encoded and decoded again; ``vocabulary`` and ``pattern`` are those of the public byte-level tokenizer unless given."""
    import public_tokenizers

    spec = byte_bpe.ByteBpe.load(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    return byte_bpe.encoded_digests(table(spark, sf_dir, "documents"), spec)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), 50, label=label)


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_token_counts, op3_line_dedup, op4_language_id, op5_toxicity, op6_mixing, op7_lm_score, op8_decontamination, op9_chat_format, op10_simhash_dedup, op11_byte_bpe, op12_hard_negatives)}


_SPACES = r"[\x20\x09-\x0D]"


MIXING_SQL = r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, lang, lower(coalesce(text, '')) AS low,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
      FROM documents),
    m AS (
      SELECT doc_id, source, lang, n_tokens,
             CASE WHEN contains(low, '@') OR contains(low, '://') THEN 'contact'
                  WHEN contains(low, 'licen') OR contains(low, 'copyright') THEN 'legal'
                  WHEN regexp_matches(low, '[0-9]') THEN 'numeric' ELSE 'prose' END AS topic
      FROM d),
    c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM m GROUP BY ALL),
    s AS (SELECT source, sqrt(sum(t)) / sum(sqrt(sum(t))) OVER () AS goal FROM c GROUP BY source),
    l AS (SELECT lang, sqrt(sum(t)) / sum(sqrt(sum(t))) OVER () AS goal FROM c GROUP BY lang),
    k AS (SELECT topic, sqrt(sum(t)) / sum(sqrt(sum(t))) OVER () AS goal FROM c GROUP BY topic),
    g AS (SELECT c.*, s.goal AS gs, l.goal AS gl, k.goal AS gk
          FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source JOIN l ON c.lang IS NOT DISTINCT FROM l.lang JOIN k USING (topic)),
    f AS (
      SELECT 0 AS i, source, lang, topic, t, gs, gl, gk, t / sum(t) OVER () AS w FROM g
      UNION ALL
      SELECT i + 1, source, lang, topic, t, gs, gl, gk, w * gk / sum(w) OVER (PARTITION BY topic) FROM (
        SELECT * REPLACE (w * gl / sum(w) OVER (PARTITION BY lang) AS w) FROM (
          SELECT * REPLACE (w * gs / sum(w) OVER (PARTITION BY source) AS w) FROM f WHERE i < 50))),
    o AS (
      SELECT *, w / t AS r, 0.5 * sum(t) OVER () AS budget,
             sum(t) OVER b - t AS before, sum(w) OVER () - (sum(w) OVER b - w) AS rest
      FROM f WHERE i = 50
      WINDOW b AS (ORDER BY w / t DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT max(r) AS r, arg_max((budget - before) / rest, r) AS scale FROM o WHERE (budget - before) / rest * r <= 1),
    p AS (SELECT source, lang, topic, round(least(1.0, r * (SELECT scale FROM x)), 9) AS probability FROM o)
    SELECT m.doc_id, m.source, m.lang, m.topic, m.n_tokens, p.probability,
           CAST(('0x' || substr(md5('17:' || m.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 < p.probability AS sampled
    FROM m JOIN p ON m.source IS NOT DISTINCT FROM p.source AND m.lang IS NOT DISTINCT FROM p.lang AND m.topic = p.topic"""


def oracle_sql() -> dict:
    return {
        "op1_exact_dedup": f"""
            WITH d AS (
              SELECT doc_id, length(coalesce(text, '')) AS n,
                     sha256(regexp_replace(coalesce(text, ''), '{_SPACES}+', '', 'g')) AS text_sha256
              FROM documents)
            SELECT doc_id,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER w = 1 AS kept,
                   text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)""",
        "op6_mixing": MIXING_SQL,
        "op9_chat_format": """
            WITH turns AS (
              SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
              UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
            t AS (
              SELECT *, row_number() OVER w AS pos,
                     coalesce(lag(role) OVER w = role, false) AS same,
                     length(text) + length(regexp_replace(text, '[^\\\\<#]', '', 'g')) AS esc,
                     length(role) + length(regexp_replace(role, '[^\\\\<#:]', '', 'g')) AS role_esc
              FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
            SELECT conv_id,
                   count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
                   CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(esc + CASE WHEN same THEN 7 ELSE 14 + role_esc END) AS BIGINT) AS formatted_chars
            FROM t GROUP BY conv_id""",
        "op12_hard_negatives": """
            WITH v AS (
              SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                     list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
              FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (
              SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
              FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
            p AS (
              SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
            n AS (
              SELECT p.*, s.id AS negative_id, s.score AS negative_score,
                     row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
              FROM p JOIN s USING (anchor_id)
              WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
            SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    }
