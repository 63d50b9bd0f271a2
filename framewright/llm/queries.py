"""Queries of the operators for training data, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.numbers import significant
from framewright.llm import batch_dedup, leakage, neighbours, paragraphs, quantile_sketch, shared_spans, tokenizer
from framewright.session import table


#: Fixed values of the test data: 16 x 16 bits, a threshold of 10 percent.
HASH_BITS, HASH_MOST, NEIGHBOURS = 256, 25, 5
QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
MEASURES = ("object_area", "object_aspect_ratio")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = quantile_sketch.by_scope(table(spark, d, "object_stats"), ["class_name"], "load_period", MEASURES, QUANTILES)
    return found.withColumn("estimate", significant(F.col("estimate")))


def p3_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """Whether each estimate over all periods keeps its bound against the exact order statistic of its rank."""
    stats = table(spark, d, "object_stats")
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("feature"), F.col(m).cast("double").alias("x")) for m in MEASURES]))
    values = stats.select("class_name", cells.alias("v")).select("class_name", "v.*").filter("x IS NOT NULL AND NOT isnan(x)")
    got = quantile_sketch.by_scope(stats, ["class_name"], "load_period", MEASURES, QUANTILES).filter("whole")
    return quantile_sketch.bounds_hold(values, got, ["class_name", "feature"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_hashes(table(spark, d, "image_hashes"), bits=HASH_BITS, most=HASH_MOST, k=NEIGHBOURS)


def p4_vectors(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest_vectors(table(spark, d, "embeddings"), size=64, k=10)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_dedup.repeats(table(spark, d, "image_hashes"), bits=HASH_BITS, most=HASH_MOST)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = tokenizer.decode(tokenizer.encode(docs.select("doc_id", "text")))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_spans.shared_share(docs, shared_spans.shared_spans(docs))


def p10_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs.paragraph_classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_bounds_hold, p4_found, p4_vectors, p5_found, p8_ids, p8_roundtrip, p9_found, p10_found, p10_share, p10_paragraphs)}

_BITS = """SELECT hash_id AS id, cache_name, batch_no, code FROM image_hashes JOIN (
SELECT id, string_agg((b::INT)::VARCHAR, '' ORDER BY i)::BIT AS code FROM (
SELECT hash_id AS id, unnest(hash) AS b, unnest(range(0, 256)) AS i FROM image_hashes WHERE len(hash) = 256) GROUP BY id) ON id = hash_id"""
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


def _runs(key: str, source: str) -> str:
    """Every 12 consecutive words of a table's texts."""
    return f"""SELECT {key}, array_to_string(w[i : i + 11], ' ') AS run FROM (
SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {source} WHERE text IS NOT NULL))"""


_SPANS = """WITH w AS (SELECT doc_id, i, substr(text, i + 1, 200) AS s FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
hit AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1)),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hit))
SELECT doc_id, min(i)::BIGINT AS span_start, max(i)::BIGINT + 200 AS span_end FROM runs GROUP BY doc_id, run"""

_PARAGRAPHS = f"""WITH RECURSIVE p AS (SELECT doc_id, (n - 1)::INT AS no, {_WORDS.replace('text', 'parts[n]')} AS w FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS parts FROM documents WHERE text IS NOT NULL))),
t AS (SELECT doc_id, no, w, dense_rank() OVER (ORDER BY w) AS id FROM p WHERE len(w) >= 5),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT DISTINCT id, w FROM t))),
c AS (SELECT id, count(*) AS n FROM s GROUP BY id),
m AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT x, y FROM m JOIN c ON c.id = x JOIN c AS e ON e.id = y WHERE 5 * k >= 4 * (c.n + e.n - k)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT id, id AS other FROM c UNION SELECT r.id, b.y FROM r JOIN b ON b.x = r.other),
f AS (SELECT r.id, min({{'a': t.doc_id, 'b': t.no}}) AS first FROM r JOIN t ON t.id = r.other GROUP BY r.id)
SELECT doc_id, no AS paragraph, first.a AS class_doc, first.b AS class_paragraph FROM t JOIN f USING (id)"""

_LOG_WIDTH = quantile_sketch._log_width(quantile_sketch.ERROR)
_SHIFT = quantile_sketch._shift(quantile_sketch.ERROR)
_KNOWN = "UNION ALL ".join(f"SELECT class_name, load_period, '{m}' AS feature, {m}::DOUBLE AS x FROM object_stats WHERE {m} IS NOT NULL AND lower({m}::VARCHAR) <> 'nan' " for m in MEASURES)
_SKETCH = f"""WITH b AS (SELECT class_name, load_period, feature, sign(x)::INT * CASE WHEN x = 0 THEN 0 WHEN abs(x) = 'infinity' THEN {3 * _SHIFT} ELSE ceil(ln(abs(x)) / {_LOG_WIDTH}) + {_SHIFT} END AS bucket FROM ({_KNOWN})),
s AS (SELECT class_name, load_period AS scope, false AS whole, feature, bucket, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT class_name, 'all', true, feature, bucket, count(*) FROM b GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY class_name, scope, whole, feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY class_name, scope, whole, feature) AS total FROM s),
e AS (SELECT class_name, scope, whole, feature, q AS quantile, total::BIGINT AS n, sign(bucket) * CASE WHEN bucket = 0 THEN 0 WHEN abs(bucket) = {3 * _SHIFT} THEN 'infinity'::DOUBLE
  ELSE 2 * exp((abs(bucket) - {_SHIFT}) * {_LOG_WIDTH}) / (1 + exp({_LOG_WIDTH})) END AS x
  FROM c, unnest({list(QUANTILES)}::DOUBLE[]) AS t(q) WHERE floor(q * (total - 1)) < upto AND floor(q * (total - 1)) >= upto - n)
SELECT class_name, scope, whole, feature, quantile, n, CAST(format('{{:.9e}}', x) AS DOUBLE) AS estimate, {quantile_sketch.ERROR}::DOUBLE AS relative_error FROM e"""

SQL = {
    "p3_percentiles": _SKETCH,
    "p10_paragraphs": _PARAGRAPHS,
    "p3_bounds_hold": " UNION ALL ".join(
        f"""SELECT class_name, '{m}' AS feature, q AS quantile, count(*) AS n, true AS ok
FROM object_stats, unnest({list(QUANTILES)}::DOUBLE[]) AS t(q) WHERE {m} IS NOT NULL AND lower({m}::VARCHAR) <> 'nan' GROUP BY class_name, q"""
        for m in MEASURES
    ),
    "p4_found": f"""WITH h AS ({_BITS}), near AS (SELECT a.id AS x, b.id AS y, bit_count(xor(a.code, b.code)) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.code, b.code)), b.id) AS n FROM h a JOIN h b ON a.id <> b.id AND bit_count(xor(a.code, b.code)) <= {HASH_MOST})
SELECT DISTINCT least(x, y) AS hash_a, greatest(x, y) AS hash_b FROM near WHERE n <= {NEIGHBOURS}""",
    "p5_found": f"""WITH RECURSIVE h AS ({_BITS}), c AS (SELECT *, row_number() OVER (ORDER BY batch_no, id) AS n FROM h WHERE batch_no > 0),
walk AS (SELECT 0::BIGINT AS n, (SELECT list({{'id': id, 'cache': cache_name, 'code': code}}) FROM h WHERE batch_no = 0) AS kept, NULL::BIGINT AS kept_id, NULL::BIGINT AS dup_id
UNION ALL SELECT w.n + 1, CASE WHEN hit IS NULL THEN list_append(w.kept, {{'id': c.id, 'cache': c.cache_name, 'code': c.code}}) ELSE w.kept END, hit, c.id
FROM walk w JOIN c ON c.n = w.n + 1, LATERAL (SELECT list_min(list_transform(list_filter(w.kept, lambda k: k.cache IS NOT DISTINCT FROM c.cache_name AND bit_count(xor(k.code, c.code)) <= {HASH_MOST}), lambda k: k.id)) AS hit))
SELECT kept_id, dup_id FROM walk WHERE kept_id IS NOT NULL""",
    "p9_found": f"""SELECT DISTINCT doc_id, item_id FROM ({_runs('doc_id', 'documents')}) JOIN ({_runs('item_id', 'eval_items')}) USING (run)""",
    "p10_found": _SPANS,
    "p10_share": f"""SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS shared_chars, coalesce(c.n, 0) / nullif(length(d.text), 0) AS share
FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS n FROM ({_SPANS}) GROUP BY doc_id) c USING (doc_id)""",
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}
