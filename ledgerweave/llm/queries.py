"""The queries of this subpackage, by name: each takes (spark, sf_dir) and runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, licences, packing, pii, recompression, repeats, resampling, sharding, simhash, toxicity, vectors
from .shared import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op3_pivot_distance_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"))


def op4_stable_projection_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_top_k(table(spark, sf_dir, "embeddings"))


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    joined = F.array_join("ids", " ").cast("binary")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = repeats.repeats_removed(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lookup_table_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.passages_removed(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_pii, op3_pivot_distance_top_k, op4_stable_projection_ann, op5_byte_level_bpe, op6_license_scan, op7_best_fit_packing, op8_suffix_array_dedup, op9_lookup_table_sharding, op10_toxicity, op11_source_divergence, op12_importance_resampling, op13_substring_recompression)
}

def _placement_sql() -> str:
    numbers = ", ".join(map(str, sharding.lookup_table(sharding.SHARDS)))
    return f"""SELECT doc_id, slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 3, '0') AS shard_name
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
JOIN (SELECT unnest(range({sharding.SLOTS})) AS slot, CAST(unnest([{numbers}]) AS INTEGER) AS shard) USING (slot)"""


def _resampling_sql() -> str:
    """CRC-32 byte by byte with its table, for each distinct word; the rest as the contract has it."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    table = "list_transform(range(256), lambda x: CAST(x AS BIGINT))"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: {step.format('x')})"
    words = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
    return f"""WITH tab AS (SELECT {table} AS t),
d AS (SELECT doc_id, unnest({words}) AS word FROM documents), b AS (SELECT unnest({words}) AS word FROM benchmark),
v AS (SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM (SELECT word FROM d UNION SELECT word FROM b)),
c AS (SELECT word, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM v, tab),
s AS (SELECT bucket, count(*) AS s FROM d JOIN c USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM b JOIN c USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN c USING (word) JOIN g USING (bucket) GROUP BY doc_id),
k AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM k WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r"""


#: DuckDB SQL for those queries that SQL can express: the whole scan for exact search, and placement by the same table, whose filling
#: tests/llm repeats slot by slot. The others are tested against brute force there.
ORACLE_SQL: dict[str, str] = {
    "op3_pivot_distance_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(embedding) > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.e, x.e) AS BIGINT) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, x.e) DESC, x.vec_id) AS rank FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id) WHERE rank <= 10""",
    "op9_lookup_table_sharding": _placement_sql(),
    "op11_source_divergence": r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, unnest(list_filter(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents),
g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
k AS (SELECT lang, term, count(*) AS number FROM d GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
c AS (SELECT lang, source, term, count(*) AS number FROM d JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, CAST(sum(number) AS BIGINT) AS n FROM k GROUP BY lang),
n AS (SELECT g.lang, g.source, CAST(coalesce(sum(number), 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.number, 0) AS number, 1 + (1000000000::HUGEINT * (coalesce(c.number, 0) + 5)) // (n.n + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.number + 5)) // (l.n + 5 * l.v) AS q
  FROM n JOIN l USING (lang) JOIN k ON k.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE number > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
    "op12_importance_resampling": _resampling_sql(),
    "op13_substring_recompression": r"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS word,
  generate_subscripts(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS pos FROM documents),
s AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS passage,
  pos + 19 <= max(pos) OVER (PARTITION BY doc_id) AS whole FROM w),
r AS (SELECT doc_id, word, pos, whole AND row_number() OVER (PARTITION BY passage, whole ORDER BY doc_id, pos) > 1 AS later FROM s),
c AS (SELECT doc_id, word, pos, coalesce(max(CASE WHEN later THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) > pos - 20, false) AS gone FROM r)
SELECT d.doc_id, count(c.pos) AS n_words, count(c.pos) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
}
