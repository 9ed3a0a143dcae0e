"""One registered query per operator, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociq.llm.bpe import encode_documents
from lociq.llm.chat import chat_report
from lociq.llm.common import table
from lociq.llm.exact import exact_groups
from lociq.llm.lexical import rank_documents
from lociq.llm.main_text import extract_main_text
from lociq.llm.mixing import MOST, SEED, SHARE, WEIGHTS, Mix
from lociq.llm.ngram_join import near_duplicates
from lociq.llm.pieces import encode_pieces
from lociq.llm.quality import quality_report
from lociq.llm.repair import damaged, repair_report
from lociq.llm.secret_scan import scan
from lociq.llm.suffix_dedup import remove_repeats
from lociq.llm.url_rules import judge_urls


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents")).report()


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], conversations.schema)
    return chat_report(conversations.unionByName(extra))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_rules, op2_main_text, op3_bpe_round_trip, op4_suffix_dedup, op5_exact_dedup,
        op6_secret_scan, op7_source_mix, op8_chat_format, op9_ngram_join, op10_quality_rules,
        op11_conversation_repair, op12_lexical_search, op13_piece_round_trip,
    )
}

_OP5 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""

_OP7 = rf"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS source_size,
             ([{", ".join(map(str, WEIGHTS))}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT]::DOUBLE AS weight
      FROM d GROUP BY source),
r AS (SELECT *, {MOST}.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY {MOST}.0::DOUBLE * source_size / weight, source NULLS LAST) AS nth FROM w),
-- Sources in the order in which their targets stop; the level is that of the first one that does not.
l AS (SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ()) - (sum(cap) OVER (ORDER BY nth) - cap))
                / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY nth) - weight)) AS level FROM r),
v AS (SELECT level FROM l WHERE cap >= weight * level ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT level FROM v)), 0) AS target,
             ('0x' || substr(md5('{SEED}|' || coalesce('=' || source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS shift FROM l),
n AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY lpad(length(size::VARCHAR)::VARCHAR, 2, '0') || substr(size::VARCHAR, 1, 2), place, text) AS nth FROM d)
SELECT n.doc_id, n.size, t.source_size, t.target,
       n.size * CASE WHEN t.source_size > 0 THEN
         (floor(t.target / t.source_size * n.nth::DOUBLE + shift) - floor(t.target / t.source_size * (n.nth - 1)::DOUBLE + shift))::BIGINT ELSE 0 END AS taken
FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
"""

_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(role, '~', '~0'), '<|', '<~1|') AS erole, replace(replace(text, '~', '~0'), '<|', '<~1|') AS etext FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length(replace(erole, chr(10), '~2')) + 1 + length(etext) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM (SELECT *, row_number() OVER () AS item FROM benchmark)),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
m AS (SELECT row, doc_id, 10 + (90 * len(terms)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE n_terms > 0),
r AS (SELECT item, item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY item, item_id, row, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op5_exact_dedup": _OP5,
    "op7_source_mix": _OP7,
    "op8_chat_format": _OP8,
    "op12_lexical_search": _OP12,
}
