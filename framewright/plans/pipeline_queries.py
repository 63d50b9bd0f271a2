"""Queries of the general training-data operators (problems 1, 2, 6 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import changes, references, rejects, shred
from framewright.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(
        table(spark, d, "object_stats"),
        {"path": table(spark, d, "annotation_files"), "im_path": table(spark, d, "images")},
        id_col="row_id",
        at_col="loaded_at",
        keep=["load_period"],
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("row_id", "ref_field", "state")


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_summary(_orphans(spark, d), "load_period")


def _yolo(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_yolo(table(spark, d, "yolo_raw"), table(spark, d, "class_list"))


def _voc(spark: SparkSession, d: str) -> DataFrame:
    return rejects.parse_voc(table(spark, d, "voc_raw"), table(spark, d, "class_list"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_yolo(spark, d), "yolo_raw").unionByName(rejects.rejected(_voc(spark, d), "voc_raw"))


def p2_yolo_rejected(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(_yolo(spark, d), "yolo_raw")


def p2_yolo_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(_yolo(spark, d))


def p2_voc_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(_voc(spark, d)).select("rec_id", "filename", "width", "height", F.size("object").alias("objects"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    current = changes.current_versions(
        table(spark, d, "annotation_files"), "path", "mtime", order=["seen_at", "file_id"], deleted="deleted_at"
    )
    ledger = changes.processed_ledger(table(spark, d, "object_stats"), table(spark, d, "run_log"), "path", "mtime")
    return changes.changed_keys(current, ledger, "path", "mtime")


def p6_reread_from(spark: SparkSession, d: str) -> DataFrame:
    return changes.reread_from(table(spark, d, "run_log"))


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return shred.shred(table(spark, d, "voc_docs"), "ann_id", "annotation")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    flat = _tables(spark, d)
    return flat["object"].select("ann_id", "object_no", F.lit(0).alias("part_no")).unionByName(
        flat["part"].select("ann_id", "object_no", "part_no")
    )


def p7_annotations(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["annotation"]


def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["object"]


def p7_parts(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["part"]


def p7_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d)["bndbox"]


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_summary, p2_found, p2_yolo_rejected, p2_yolo_loaded, p2_voc_loaded, p6_found, p6_reread_from,
        p7_found, p7_annotations, p7_objects, p7_parts, p7_boxes,
    )
}

_ORPHANS = " UNION ALL ".join(
    f"""
SELECT r.row_id, '{ref}' AS ref_field, r.load_period,
  CASE WHEN count(t.path) = 0 THEN 'missing' WHEN bool_or(t.seen_at <= r.loaded_at) THEN 'deleted' ELSE 'late' END AS state
FROM object_stats r LEFT JOIN {target} t ON t.path = r.{ref}
WHERE r.{ref} IS NOT NULL
GROUP BY r.row_id, r.load_period
HAVING NOT coalesce(bool_or(t.seen_at <= r.loaded_at AND (t.deleted_at IS NULL OR t.deleted_at > r.loaded_at)), false)"""
    for ref, target in (("path", "annotation_files"), ("im_path", "images"))
)

_OBJECTS = """SELECT ann_id, i AS object_no, object[i] AS o
FROM (SELECT ann_id, object, unnest(range(1, len(object) + 1)) AS i FROM voc_docs) WHERE object[i] IS NOT NULL"""
_PARTS = f"""SELECT ann_id, object_no, i AS part_no, o.part[i] AS p
FROM (SELECT ann_id, object_no, o, unnest(range(1, len(o.part) + 1)) AS i FROM ({_OBJECTS})) WHERE o.part[i] IS NOT NULL"""
_BOX = ", ".join(f"b.{c} AS {c}" for c in ("xmin", "ymin", "xmax", "ymax"))

_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_FIELDS = r"""regexp_extract_all(trim(line, chr(32) || chr(9) || chr(13)), '(?:"[^"]*"|[^ \t"])+')"""
_YOLO_CHECKED = f"""SELECT line_id, f, CASE WHEN line IS NULL THEN 'columns' WHEN (length(line) - length(replace(line, '"', ''))) % 2 = 1 THEN 'quoting'
  WHEN len(f) <> 5 THEN 'columns'
  WHEN replace(f[1], '"', '') NOT IN (SELECT class_id FROM class_list UNION SELECT class_name FROM class_list)
    OR {' OR '.join(f"NOT (regexp_full_match(f[{i}], '{_NUMBER}') AND coalesce(TRY_CAST(f[{i}] AS DOUBLE) BETWEEN 0 AND 1, false))" for i in range(2, 6))} THEN 'value' END AS reason
FROM (SELECT line_id, line, {_FIELDS} AS f FROM yolo_raw)"""

SQL = {
    "p2_yolo_rejected": f"SELECT 'yolo_raw' AS raw_table, line_id AS rec_id, reason FROM ({_YOLO_CHECKED}) WHERE reason IS NOT NULL",
    "p2_yolo_loaded": f"""SELECT line_id AS rec_id, replace(f[1], '"', '') AS class, f[2]::DOUBLE AS x_center, f[3]::DOUBLE AS y_center, f[4]::DOUBLE AS width, f[5]::DOUBLE AS height
FROM ({_YOLO_CHECKED}) WHERE reason IS NULL""",
    "p1_found": f"SELECT row_id, ref_field, state FROM ({_ORPHANS})",
    "p1_summary": f"SELECT ref_field, load_period, state, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY ALL",
    "p6_found": """
WITH cur AS (SELECT path, mtime FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY seen_at DESC NULLS LAST, file_id DESC) AS n
    FROM annotation_files WHERE path IS NOT NULL) WHERE n = 1 AND deleted_at IS NULL),
known AS (SELECT DISTINCT path, mtime FROM (
    SELECT s.path, s.mtime, dense_rank() OVER (PARTITION BY s.path ORDER BY s.run_id DESC) AS n
    FROM object_stats s JOIN run_log r ON r.run_id = s.run_id AND r.status = 'success') WHERE n = 1)
SELECT c.path, CASE WHEN k.path IS NULL THEN 'new' ELSE 'changed' END AS change
FROM cur c LEFT JOIN known k ON k.path = c.path
WHERE k.path IS NULL OR c.mtime IS DISTINCT FROM k.mtime""",
    "p6_reread_from": """
WITH l AS (SELECT max(started_at) AS last FROM run_log WHERE status = 'success')
SELECT min(started_at) AS reread_from FROM run_log, l
WHERE started_at < last AND NOT (coalesce(status = 'success', false) AND coalesce(finished_at <= last, false))""",
    "p7_found": f"SELECT ann_id, object_no::INT AS object_no, 0 AS part_no FROM ({_OBJECTS}) UNION ALL SELECT ann_id, object_no::INT, part_no::INT FROM ({_PARTS})",
    "p7_annotations": """SELECT ann_id, path, filename, folder, size.width AS size_width, size.height AS size_height,
  size.depth AS size_depth, segmented, received_at FROM voc_docs""",
    "p7_objects": f"SELECT ann_id, object_no::INT AS object_no, o.name AS name, o.pose AS pose, o.truncated AS truncated, o.difficult AS difficult FROM ({_OBJECTS})",
    "p7_parts": f"SELECT ann_id, object_no::INT AS object_no, part_no::INT AS part_no, p.name AS name FROM ({_PARTS})",
    "p7_boxes": f"""SELECT 'object' AS parent, ann_id, object_no::INT AS object_no, NULL::INT AS part_no, {_BOX}
FROM (SELECT *, o.bndbox AS b FROM ({_OBJECTS})) WHERE b IS NOT NULL
UNION ALL SELECT 'part', ann_id, object_no::INT, part_no::INT, {_BOX} FROM (SELECT *, p.bndbox AS b FROM ({_PARTS})) WHERE b IS NOT NULL""",
}
