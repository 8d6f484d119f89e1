"""The contract queries op1 to op10 and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_extract, chat_format, decontaminate, minhash_dedup, quality, source_mix, token_tables, toxicity, url_rules, vantage_search
from .common import table

TOKENIZER = "byte_bpe_50k.json"
CONFLICT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.digest(token_tables.read(token_tables.write(table(spark, sf_dir, "documents"), tokenizer_path())))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{CONFLICT}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{CONFLICT}'")
    return chat_format.digest(chat_format.format_chats(rows.unionByName(planted)))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_extract.extract(table(spark, sf_dir, "pages"))


def op6_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_search.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = source_mix.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_tables, op2_chat_format, op3_minhash_dedup, op4_toxicity, op5_block_extract, op6_vantage_search, op7_url_rules, op8_decontaminate, op9_quality, op10_source_mix)}


def oracle_sql() -> dict[str, str]:
    control = r"</?s>|\[/?INST%?\]"
    esc = "replace(replace(replace({0}, '%', '%25'), '<', '%3C'), '[', '%5B')"
    chats = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '{CONFLICT}'), (-7, 1, 'assistant', '{CONFLICT}')),
p AS (SELECT *, regexp_matches(text, '{control}') AS bad FROM t),
f AS (SELECT *, '<s>' || {esc.format("role")} || CASE WHEN bad THEN '[INST%]' || {esc.format("text")} ELSE '[INST]' || text END || '[/INST]</s>' AS piece FROM p),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(piece)) AS n, count(*) FILTER (WHERE bad) AS e FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(n AS BIGINT) AS formatted_chars, e AS escaped_turns FROM g"""
    near = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda x, y: x + y) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
    rows = ", ".join(f"({len(r.text) if r.address else -1}, {r.verdict == 'block'}, '{r.text}', '{r.verdict}', '{r.pattern}')" for r in url_rules.ADDRESSES + url_rules.PATTERNS)
    urls = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k(size, block, text, verdict, pattern) AS (VALUES {rows}),
f AS (SELECT page_id, host, path, k.* FROM h LEFT JOIN k ON regexp_matches(host || path, k.pattern)),
a AS (SELECT page_id, host, path, max(CASE WHEN size >= 0 THEN {{'size': size, 'block': block, 'text': text, 'verdict': verdict}} END) AS best,
             min(CASE WHEN size < 0 THEN text END) AS hit FROM f GROUP BY ALL)
SELECT page_id, host, path, best.text AS rule, hit AS pattern, coalesce(best.verdict, CASE WHEN hit IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM a"""
    return {"op2_chat_format": chats, "op6_vantage_search": near, "op7_url_rules": urls}
