"""The registered queries of the text operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import (
    binary_output, chat_format, decontamination, hard_negatives, html_extraction, jaccard_join, language_id, line_frequency, lm_scoring,
    mixing, piece_codec, spelling_variants, token_counts,
)
from linkloom.llm.common import scratch_path, table

CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_frequency.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_cut_lines", "n_cut_words", "kept"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(language_id.train_allowed(docs))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path("piece_bpe_32k.model")
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"), model)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = chat_format.format_conversations(rows, scratch_path(spark, "chat"))
    return chat_format.read_back(turns).select(
        F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score_texts(table(spark, sf_dir, "documents"), lm_scoring.learned_from(F.col("doc_id")))
    held_out = F.col("doc_id").isNotNull() & ~F.col("learned")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=moved)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.word_counts(table(spark, sf_dir, "documents"), slip=97))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_line_frequency, op2_language_id, op3_mixing, op4_jaccard_join, op5_token_counts, op6_html_extraction, op7_chat_format,
            op8_decontamination, op9_binary_output, op10_lm_scoring, op11_hard_negatives, op12_spelling_variants, op13_sentencepiece,
        )
    }


def sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force."""
    return {"op1_line_frequency": LINE_FREQUENCY_SQL, "op4_jaccard_join": JACCARD_SQL, "op11_hard_negatives": NEGATIVES_SQL}


LINE_FREQUENCY_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
base AS (
  SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols FROM w),
win AS (
  SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, g), (SELECT unnest(range(0, 5)) AS k)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, l FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
norm AS (
  SELECT doc_id, source, trim(regexp_replace(
           translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'),
           '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS l,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM lines),
often AS (
  SELECT source, l FROM (SELECT source, l, count(DISTINCT doc_id) AS docs FROM norm GROUP BY source, l) JOIN
    (SELECT source, count(*) AS all_docs FROM d GROUP BY source) USING (source)
  WHERE docs > 20 AND docs > all_docs * 0.01),
cut AS (SELECT doc_id, count(*) AS k, sum(n) AS n FROM norm JOIN often USING (source, l) GROUP BY doc_id),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(cut.k, 0) AS n_cut_lines, coalesce(cut.n, 0) AS n_cut_words
  FROM base LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       n_cut_lines::BIGINT AS n_cut_lines, n_cut_words::BIGINT AS n_cut_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_cut_words >= n_words * 0.5 AS kept
FROM r
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents
  UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.d WHERE reach.r < sym.b)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN reach ON reach.d = documents.doc_id
GROUP BY documents.doc_id, n.n
"""

NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS a, a.l AS al, b.vec_id AS b, b.l AS bl, list_dot_product(a.v, b.v)::BIGINT AS s
  FROM r a, r b WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, b, s FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE al = bl AND a <> b)
  WHERE k <= 5),
n AS (
  SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
  FROM p JOIN s ON s.a = p.a AND s.al <> s.bl AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s)
SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE k <= 5
"""
