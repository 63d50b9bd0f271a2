"""Queries of the dataset operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import geometry, paths, raster
from framewright.functions.numbers import significant
from framewright.operators import cache_merge, convert, dedup, features, frames, projection, statistics
from framewright.session import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "object_stats")


def _sig(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: significant(F.col(c)) for c in columns})


def _s(x: str) -> str:
    """significant() in SQL."""
    return f"CAST(format('{{:.9e}}', {x}) AS DOUBLE)"


def _known(x: str) -> str:
    # by the text: isnan() is folded away where file statistics, which ignore NaN, have bounds
    return f"CASE WHEN lower({x}::VARCHAR) <> 'nan' THEN {x}::DOUBLE END"


#: The numeric features of the table (fixed names): sizes of the image, of the object, its place, its quality.
_FEATURES = ("im_width", "im_height", "im_depth", *statistics.NUMERIC, *statistics.BINARY)

def _long(features):
    return " UNION ALL ".join(f"SELECT class_name, '{f}' AS feature, {_known(f)} AS x FROM object_stats" for f in features)


_LONG = _long(statistics.NUMERIC)
_BOUNDS = f"""SELECT *, q3 - q1 AS iqr, greatest(q1 - 1.5 * (q3 - q1), 0) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
SELECT class_name, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM ({_LONG})
WHERE x IS NOT NULL AND class_name IS NOT NULL GROUP BY ALL)"""
_MARKS = f"""SELECT l.class_name, l.feature, CASE WHEN l.x < b.lower OR l.x > b.upper THEN 1 ELSE 0 END AS o
FROM ({_LONG}) l LEFT JOIN ({_BOUNDS}) b USING (class_name, feature)"""


# --- sources and paths -------------------------------------------------------
_NAME = "list_extract(string_split(path, '/'), -1)"


@query(f"SELECT path FROM images WHERE path IS NOT NULL AND (contains({_NAME}, '.jpg') OR contains({_NAME}, 'cam_')) GROUP BY path")
def scan_pattern(spark, d):
    """Paths whose name holds one of several patterns, each once."""
    return table(spark, d, "images").filter(paths.matches_any(F.col("path"), [".jpg", "cam_"])).select("path").distinct()


@query(f"""SELECT image_id, {_NAME} AS name, regexp_extract({_NAME}, '^(.+?)(\\.[^.]*)?$', 1) AS stem,
regexp_extract({_NAME}, '^.+?(\\.[^.]*)$', 1) AS suffix, lower(regexp_extract({_NAME}, '^.+?(\\.[^.]*)$', 1)) IN ('.jpg', '.jpeg', '.png') AS is_image FROM images""")
def path_parts(spark, d):
    p = F.col("path")
    return table(spark, d, "images").select(
        "image_id", paths.name(p).alias("name"), paths.stem(p).alias("stem"), paths.suffix(p).alias("suffix"), paths.has_extension(p, features.IMAGE_EXTENSIONS).alias("is_image")
    )


@query(f"""SELECT regexp_extract({_NAME}, '^(.+?)(\\.[^.]*)?$', 1) AS stem, max(path) AS im_path FROM images
WHERE path IS NOT NULL AND lower(regexp_extract({_NAME}, '^.+?(\\.[^.]*)$', 1)) IN ('.jpg', '.jpeg', '.png') GROUP BY 1""")
def image_lookup(spark, d):
    return features.image_lookup(table(spark, d, "images"))


@query("""SELECT path, left(regexp_replace(replace(path, ' ', '_'), '^\\.+|\\.+$', '', 'g'), 30) AS safe,
'cache_' || md5(path) || '_method_dhash_size_16.parquet' AS cache_file FROM images""")
def cache_name(spark, d):
    p = F.col("path")
    return table(spark, d, "images").select("path", paths.safe_name(p).alias("safe"), F.concat(F.lit("cache_"), F.md5(p.cast("binary")), F.lit("_method_dhash_size_16.parquet")).alias("cache_file"))


_AXES = ("x", "y", "w", "h")
# what the operator reads: blanks of any kind off both ends, five fields between runs of blanks and tabs, four finite numbers
_TRIMMED = r"regexp_replace(line, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_YOLO_FIELDS = r"^[^ \t]+([ \t]+[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?){4}\z"


@query(f"SELECT path, line, max(line_no) AS line_no, min(line_no) AS first_no FROM (SELECT path, {_TRIMMED} AS line, line_no FROM yolo_raw) WHERE line <> '' GROUP BY path, line")
def yolo_dup_lines(spark, d):
    """Lines of a file once each, with their first and last place."""
    return convert.distinct_lines(table(spark, d, "yolo_raw").select("path", F.col("line_no").alias("no"), "line"))


@query("SELECT class_name, max(class_id::INT) AS class_id FROM class_list WHERE class_name <> '' GROUP BY class_name")
def class_list(spark, d):
    rows = table(spark, d, "class_list").select(F.col("class_id").cast("int").alias("line_no"), F.col("class_name").alias("line"))
    return features.class_map(rows)


@query("SELECT class_name, (row_number() OVER (ORDER BY class_name) - 1)::INT AS class_id FROM (SELECT DISTINCT class_name FROM object_stats WHERE class_name IS NOT NULL)")
def class_ids(spark, d):
    return features.class_ids(_stats(spark, d))


@query("""SELECT s.row_id, coalesce(c.class_name, 'object_' || s.im_depth) AS class_name FROM object_stats s
LEFT JOIN class_list c ON c.class_id = CAST(s.im_depth AS VARCHAR) WHERE s.im_depth IS NOT NULL""")
def class_fallback(spark, d):
    """Names for ids (here the depth column stands for an id), unknown ids by their number."""
    ids = _stats(spark, d).filter("im_depth IS NOT NULL").select("row_id", F.col("im_depth").cast("string").alias("class_id"))
    return features.named_classes(ids, table(spark, d, "class_list")).select("row_id", "class_name")


_YOLO_READ = f"""SELECT * FROM (SELECT line_id, f[1] AS id, {', '.join(f"TRY_CAST(ltrim(f[{i + 2}], '+') AS DOUBLE) AS {a}" for i, a in enumerate(_AXES))}
FROM (SELECT line_id, string_split_regex({_TRIMMED}, '[ \t]+') AS f FROM yolo_raw WHERE regexp_matches({_TRIMMED}, '{_YOLO_FIELDS}')))
WHERE {' AND '.join(f"abs({a}) < 'infinity'::DOUBLE" for a in _AXES)}"""


@query(f"SELECT line_id, id AS class_id, x AS x_center, y AS y_center, w AS width, h AS height FROM ({_YOLO_READ})")
def yolo_parse(spark, d):
    """Fields of all lines that the operator reads."""
    return convert.yolo_boxes(table(spark, d, "yolo_raw"), keep=("line_id",))


@query()
def voc_parse(spark, d):
    """Records of the XML texts, as many objects as they hold."""
    from framewright.sources import voc

    doc = voc.parsed(table(spark, d, "voc_raw"), "body")
    return doc.select("doc_no", "doc.filename", "doc.size.width", "doc.size.height", F.size("doc.object").alias("objects"))


# --- features of objects -----------------------------------------------------
_INT = lambda x: f"CASE WHEN regexp_full_match(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '[+-]?[0-9]+') THEN TRY_CAST(regexp_replace({x}, '^\\s+|\\s+$', '', 'g') AS INT) END"
_VOC = f"""WITH o AS (SELECT ann_id, path, coalesce({_INT('size.width')}, 0) AS w, coalesce({_INT('size.height')}, 0) AS h,
  coalesce({_INT('size.depth')}, 0) AS dep, unnest(object) AS o FROM voc_docs),
b AS (SELECT ann_id, path, w, h, dep, o.name AS name, {', '.join(f"{_INT(f'o.bndbox.{c}')} AS {c}" for c in ('xmin', 'ymin', 'xmax', 'ymax'))} FROM o WHERE o IS NOT NULL AND w > 0 AND h > 0),
f AS (SELECT *, count(*) OVER (PARTITION BY ann_id) AS n,
  bool_and(xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL) OVER (PARTITION BY ann_id) AS whole FROM b),
g AS (SELECT *, least(floor((xmin + xmax) * 3 / (w * 2)), 2)::INT AS col, least(floor((ymin + ymax) * 3 / (h * 2)), 2)::INT AS row FROM f WHERE whole)
"""
_SECTORS = ", ".join(f"(row = {i} AND col = {k})::INT AS {c}" for i, names in enumerate(geometry.SECTORS) for k, c in enumerate(names))


def _voc(spark, d):
    return features.voc_features(table(spark, d, "voc_docs"), keep=("ann_id", "path"))


@query(_VOC + """SELECT ann_id, path, coalesce(name, 'unfilled') AS class_name, (xmax - xmin) AS object_width, (ymax - ymin) AS object_height,
CASE WHEN ymax > ymin THEN (xmax - xmin) / (ymax - ymin) ELSE 0 END AS object_aspect_ratio,
(xmax - xmin)::BIGINT * (ymax - ymin) AS object_area, ((xmax - xmin)::BIGINT * (ymax - ymin)) / (w::BIGINT * h) AS object_relative_area FROM g""")
def box_geometry(spark, d):
    return _voc(spark, d).select("ann_id", "path", "class_name", "object_width", "object_height", "object_aspect_ratio", "object_area", "object_relative_area")


@query(_VOC + f"SELECT ann_id, {_SECTORS} FROM g")
def box_sector(spark, d):
    return _voc(spark, d).select("ann_id", *geometry.SECTOR_COLUMNS)


@query(_VOC + """SELECT ann_id, (xmin < 5)::INT AS truncated_left, (xmax > w - 5)::INT AS truncated_right, (ymin < 5)::INT AS truncated_top,
(ymax > h - 5)::INT AS truncated_bottom, (xmin < 5 AND xmax > w - 5 AND ymin < 5 AND ymax > h - 5)::INT AS full_size FROM g""")
def box_truncation(spark, d):
    return _voc(spark, d).select("ann_id", *geometry.TRUNCATION_COLUMNS, "full_size")


@query(_VOC + "SELECT ann_id, w AS im_width, h AS im_height, dep AS im_depth, n::INT AS objects_count, (n > 1)::INT AS has_neighbors FROM g")
def box_neighbors(spark, d):
    return _voc(spark, d).select("ann_id", "im_width", "im_height", "im_depth", "objects_count", "has_neighbors")


@query(_VOC + f"""SELECT * FROM (SELECT ann_id, CASE WHEN NOT (coalesce({_INT('size.width')}, 0) > 0 AND coalesce({_INT('size.height')}, 0) > 0) THEN 'size'
WHEN len(list_filter(coalesce(object, []), lambda x: x IS NOT NULL)) = 0 THEN 'empty' WHEN ann_id IN (SELECT ann_id FROM f WHERE NOT whole) THEN 'box' END AS reason FROM voc_docs)
WHERE reason IS NOT NULL""")
def voc_broken(spark, d):
    """Records left out of the feature matrix, with the reason."""
    return features.broken_files(table(spark, d, "voc_docs"), keep=("ann_id",))


_DBL = lambda x: f"TRY_CAST(trim({x}) AS DOUBLE)"
_CONV = f"""WITH o AS (SELECT ann_id, {_DBL('size.width')} AS w, {_DBL('size.height')} AS h, unnest(object) AS o, generate_subscripts(object, 1) AS no FROM voc_docs),
b AS (SELECT ann_id, w, h, no, o.name AS class_name, {', '.join(f"{_DBL(f'o.bndbox.{c}')} AS {c}" for c in ('xmin', 'ymin', 'xmax', 'ymax'))}
  FROM o WHERE o IS NOT NULL AND w > 0 AND h > 0),
y AS (SELECT b.ann_id, b.no, c.class_id::INT AS class_id, greatest(least((xmin + xmax) / 2 / w, 1), 0) AS x_center, greatest(least((ymin + ymax) / 2 / h, 1), 0) AS y_center,
  greatest(least((xmax - xmin) / w, 1), 0) AS width, greatest(least((ymax - ymin) / h, 1), 0) AS height
  FROM b JOIN class_list c USING (class_name) WHERE xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL)
"""


def _yolo(spark, d):
    classes = table(spark, d, "class_list").select("class_name", F.col("class_id").cast("int").alias("class_id"))
    return convert.voc_to_yolo(table(spark, d, "voc_docs"), classes, keep=("ann_id",))


@query(_CONV + "SELECT ann_id, class_id, round(x_center, 12) AS x_center, round(y_center, 12) AS y_center, round(width, 12) AS width, round(height, 12) AS height FROM y")
def voc_to_yolo(spark, d):
    return _yolo(spark, d).select("ann_id", "class_id", *[F.round(c, 12).alias(c) for c in ("x_center", "y_center", "width", "height")])


def _six(x: str) -> str:
    """six_places() in SQL: engines differ in the text of a number that lies halfway."""
    whole, high = f"floor({x} * 1e6::DOUBLE)", f"({x} * 134217729::DOUBLE - ({x} * 134217729::DOUBLE - {x}))"
    beyond = f"(({x} * 1e6::DOUBLE - {whole}) - 0.5::DOUBLE + (({high} * 1e6::DOUBLE - {x} * 1e6::DOUBLE) + ({x} - {high}) * 1e6::DOUBLE))"
    return f"printf('%.6f', ({whole} + CASE WHEN {beyond} > 0 THEN 1 WHEN {beyond} < 0 THEN 0 ELSE {whole} % 2 END) / 1e6::DOUBLE)"


@query(_CONV + f"SELECT ann_id, class_id || ' ' || {_six('x_center')} || ' ' || {_six('y_center')} || ' ' || {_six('width')} || ' ' || {_six('height')} AS line FROM y")
def voc_to_yolo_lines(spark, d):
    """Lines as written to files."""
    return _yolo(spark, d).select("ann_id", "line")


@query(_CONV + f""", l AS (SELECT ann_id, no, class_id || ' ' || {_six('x_center')} || ' ' || {_six('y_center')} || ' ' || {_six('width')} || ' ' || {_six('height')} AS line FROM y),
t AS (SELECT ann_id, string_agg(line || chr(10), '' ORDER BY no) AS value FROM l GROUP BY ann_id)
SELECT 'ann_' || ann_id AS stem, coalesce(value, '') AS value FROM voc_docs LEFT JOIN t USING (ann_id) WHERE {_DBL('size.width')} > 0 AND {_DBL('size.height')} > 0""")
def yolo_file_texts(spark, d):
    """The text of each YOLO file, its lines in the order of the objects."""
    docs = table(spark, d, "voc_docs").withColumn("path", F.concat(F.lit("/x/ann_"), F.col("ann_id").cast("string"), F.lit(".xml")))
    classes = table(spark, d, "class_list").select("class_name", F.col("class_id").cast("int").alias("class_id"))
    return convert.yolo_files(convert.voc_to_yolo(docs, classes), convert.sized(docs))


_PIX = f"""WITH t AS ({_YOLO_READ}),
c AS (SELECT line_id, coalesce(class_name, 'object_' || id) AS class_name, TRY_CAST(round_even((x - w / 2) * 640, 0) AS INT) AS xmin, TRY_CAST(round_even((y - h / 2) * 480, 0) AS INT) AS ymin,
  TRY_CAST(round_even((x + w / 2) * 640, 0) AS INT) AS xmax, TRY_CAST(round_even((y + h / 2) * 480, 0) AS INT) AS ymax
  FROM t LEFT JOIN class_list ON class_id = id)
"""


@query(_PIX + "SELECT line_id, class_name, xmin, ymin, xmax, ymax, (xmin <= 0 OR ymin <= 0 OR xmax >= 640 OR ymax >= 480)::INT AS truncated FROM c WHERE xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL")
def yolo_to_pixels(spark, d):
    """Boxes of all lines in pixels of 640 x 480 images."""
    lines = table(spark, d, "yolo_raw").select(F.col("line_id").cast("string").alias("path"), "line")
    boxes = convert.yolo_boxes(lines)
    sizes = lines.select("path", F.lit(640).alias("im_width"), F.lit(480).alias("im_height"))
    return convert.to_pixels(boxes, sizes, table(spark, d, "class_list")).select(F.col("path").cast("bigint").alias("line_id"), "class_name", "xmin", "ymin", "xmax", "ymax", "truncated")


@query("WITH " + _PIX.removeprefix("WITH ") + f"""SELECT 'voc:yolo' AS direction, count(*) AS files, count(*) FILTER (WHERE {_DBL('size.width')} > 0 AND {_DBL('size.height')} > 0) AS converted FROM voc_docs
UNION ALL SELECT 'yolo:voc', (SELECT count(DISTINCT path) FROM yolo_raw), (SELECT count(DISTINCT path) FROM yolo_raw JOIN c USING (line_id)
WHERE xmin IS NOT NULL AND ymin IS NOT NULL AND xmax IS NOT NULL AND ymax IS NOT NULL)""")
def success_counts(spark, d):
    """Files of each direction of conversion and those that were converted: records with a size, texts with a box."""
    docs, lines = table(spark, d, "voc_docs"), table(spark, d, "yolo_raw").filter("path IS NOT NULL").select("path", "line")
    sizes = lines.select("path").distinct().select("path", F.lit(640).alias("im_width"), F.lit(480).alias("im_height"))
    pixels = convert.to_pixels(convert.yolo_boxes(lines), sizes, table(spark, d, "class_list"))
    there, back = convert.success_counts(docs, convert.sized(docs), "ann_id"), convert.success_counts(sizes, pixels, "path")
    return there.select(F.lit("voc:yolo").alias("direction"), "*").unionByName(back.select(F.lit("yolo:voc").alias("direction"), "*"))


@query(_VOC + "SELECT ann_id, coalesce(name, 'unfilled') AS class_name, xmin, ymin, xmax, ymax FROM g")
def voc_roundtrip(spark, d):
    """Pixel boxes written as XML texts and read back."""
    from framewright.sources import voc

    objects = F.filter("object", lambda o: o.isNotNull())
    boxes = table(spark, d, "voc_docs").join(_voc(spark, d).select("ann_id").distinct(), "ann_id", "left_semi").select(F.col("ann_id").cast("string").alias("path"), "size", F.explode(objects).alias("o"))
    pixels = boxes.select(
        "path", *[geometry.text_int(F.col(f"size.{c}")).alias(f"im_{c}") for c in ("width", "height")], F.coalesce("o.name", F.lit(geometry.NO_CLASS)).alias("class_name"),
        *[geometry.text_int(F.col(f"o.bndbox.{c}")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.lit(0).alias("truncated"),
    )
    back = voc.parsed(voc.to_text(convert.voc_records(pixels)), "value").select("path", F.explode("doc.object").alias("o"))
    return back.select(F.col("path").cast("bigint").alias("ann_id"), F.col("o.name").alias("class_name"), *[F.col(f"o.bndbox.{c}").cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# --- joins of annotations and images ----------------------------------------
_STEM = lambda c: f"regexp_extract(list_extract(string_split({c}, '/'), -1), '^(.+?)(\\.[^.]*)?$', 1)"
_LOOK = f"SELECT {_STEM('path')} AS stem, max(path) AS im_path FROM images WHERE path IS NOT NULL AND regexp_matches(lower(path), '\\.(jpg|jpeg|png)$') GROUP BY 1"


@query(f"SELECT DISTINCT path FROM annotation_files WHERE path IS NOT NULL AND {_STEM('path')} NOT IN (SELECT {_STEM('path')} FROM images WHERE path IS NOT NULL)")
def orphans(spark, d):
    return features.orphan_annotations(table(spark, d, "annotation_files"), table(spark, d, "images"))


@query(f"SELECT a.file_id, l.im_path FROM annotation_files a JOIN ({_LOOK}) l ON l.stem = {_STEM('a.path')}")
def annotation_join_inner(spark, d):
    return features.with_image(table(spark, d, "annotation_files"), features.image_lookup(table(spark, d, "images")), "inner").select("file_id", "im_path")


@query(f"SELECT a.file_id, l.im_path FROM annotation_files a LEFT JOIN ({_LOOK}) l ON l.stem = {_STEM('a.path')}")
def annotation_join_left(spark, d):
    return features.with_image(table(spark, d, "annotation_files"), features.image_lookup(table(spark, d, "images")), "left").select("file_id", "im_path")


# --- caches -------------------------------------------------------------------
_FILES = "SELECT DISTINCT path, mtime FROM annotation_files WHERE deleted_at IS NULL AND path IS NOT NULL"


def _files(spark, d):
    return table(spark, d, "annotation_files").filter("deleted_at IS NULL AND path IS NOT NULL").select("path", "mtime").distinct()


@query(f"SELECT f.path, f.mtime FROM ({_FILES}) f WHERE NOT EXISTS (SELECT 1 FROM object_stats s WHERE s.path = f.path AND s.mtime IS NOT DISTINCT FROM f.mtime)")
def cache_diff(spark, d):
    return cache_merge.to_update(_files(spark, d), _stats(spark, d))


@query(f"SELECT s.row_id FROM object_stats s WHERE EXISTS (SELECT 1 FROM ({_FILES}) f WHERE s.path = f.path AND s.mtime IS NOT DISTINCT FROM f.mtime)")
def cache_keep(spark, d):
    return cache_merge.still_valid(_stats(spark, d).select("row_id", "path", "mtime"), _files(spark, d)).select("row_id")


@query("""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'obsolete' ELSE 'kept' END AS status
FROM (SELECT DISTINCT path FROM images WHERE path IS NOT NULL) a FULL JOIN (SELECT DISTINCT path FROM image_hashes WHERE path IS NOT NULL) b ON a.path = b.path""")
def cache_reconcile(spark, d):
    return cache_merge.reconciled(table(spark, d, "images"), table(spark, d, "image_hashes"))


@query("SELECT path, hash_id, NULL::BIGINT AS image_id FROM image_hashes UNION ALL SELECT path, NULL, image_id FROM images")
def cache_concat(spark, d):
    return cache_merge.combined(table(spark, d, "image_hashes").select("path", "hash_id"), table(spark, d, "images").select("path", "image_id"))


# --- reports ------------------------------------------------------------------
@query("SELECT class_name, count(*) AS objects FROM object_stats WHERE class_name IS NOT NULL GROUP BY class_name")
def class_counts(spark, d):
    return statistics.class_counts(_stats(spark, d)).select("class_name", "objects")


@query(f"SELECT class_name, {_s('100.0 * count(*) / (SELECT count(*) FROM object_stats)')} AS share FROM object_stats WHERE class_name IS NOT NULL GROUP BY class_name")
def class_share(spark, d):
    return _sig(statistics.class_counts(_stats(spark, d)).select("class_name", "share"), "share")


@query(f"""SELECT count(*) AS images, {_s('avg(n)')} AS mean_objects, {_s('stddev_samp(n)')} AS std_objects, (SELECT count(*) FROM object_stats) AS objects
FROM (SELECT count(*) AS n FROM object_stats WHERE im_path IS NOT NULL GROUP BY im_path)""")
def density(spark, d):
    return _sig(statistics.density(_stats(spark, d)), "mean_objects", "std_objects")


@query("SELECT count(DISTINCT im_path) AS images FROM object_stats")
def images_total(spark, d):
    return _stats(spark, d).agg(F.count_distinct("im_path").alias("images"))


_B = ("q1", "q3", "iqr", "lower", "upper")


@query(f"SELECT class_name, feature, {', '.join(f'{_s(c)} AS {c}' for c in _B)} FROM ({_BOUNDS})")
def outlier_bounds(spark, d):
    return _sig(statistics.outlier_bounds(_stats(spark, d)), *_B)


_FLAG = lambda f: f"coalesce({_known('s.' + f)} < b{f}.lower OR {_known('s.' + f)} > b{f}.upper, false)::TINYINT"
_FLAGGED = f"SELECT s.row_id, {', '.join(f'{_FLAG(f)} AS outlier_{f}' for f in statistics.NUMERIC)} FROM object_stats s " + " ".join(
    f"LEFT JOIN (SELECT * FROM ({_BOUNDS}) WHERE feature = '{f}') b{f} ON b{f}.class_name = s.class_name" for f in statistics.NUMERIC
)


@query(_FLAGGED)
def outlier_flags(spark, d):
    marked = statistics.mark_outliers(_stats(spark, d).select("row_id", "class_name", *statistics.NUMERIC), statistics.NUMERIC)
    return marked.select("row_id", *[f"outlier_{f}" for f in statistics.NUMERIC])


@query(f"""WITH w AS (SELECT row_id, class_name, unnest([{', '.join(f"{{'feature': '{f}', 'x': {_known(f)}}}" for f in _FEATURES)}], recursive := true) FROM object_stats),
l AS (SELECT class_name, feature, x FROM w), b AS ({_BOUNDS.replace(_LONG, 'SELECT * FROM l')})
SELECT row_id, max(coalesce(w.x < b.lower OR w.x > b.upper, false)::INT)::TINYINT AS outlier_any FROM w LEFT JOIN b USING (class_name, feature) GROUP BY row_id""")
def outlier_any(spark, d):
    """Whether any numeric feature of a row is an outlier in its class."""
    return statistics.mark_outliers(_stats(spark, d)).select("row_id", "outlier_any")


@query(f"""SELECT class_name, feature, sum(o)::BIGINT AS outliers FROM ({_MARKS}) WHERE class_name IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, feature, sum(o)::BIGINT FROM ({_MARKS}) GROUP BY feature""")
def outlier_counts(spark, d):
    return statistics.outlier_counts(statistics.mark_outliers(_stats(spark, d).select("class_name", *statistics.NUMERIC), statistics.NUMERIC))


_D = ("mean", "std", "min", "q1", "median", "q3", "max")
_DESCRIBED = ", ".join(f"{_s(e)} AS {c}" for c, e in zip(_D, ("avg(x)", "stddev_samp(x)", "min(x)", "quantile_cont(x, 0.25)", "median(x)", "quantile_cont(x, 0.75)", "max(x)")))


@query(f"SELECT feature, count(x) AS n, {_DESCRIBED} FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY feature")
def describe_global(spark, d):
    return _sig(statistics.describe(_stats(spark, d), []), *_D)


@query(f"SELECT class_name, feature, count(x) AS n, {_DESCRIBED} FROM ({_LONG}) WHERE x IS NOT NULL AND class_name IS NOT NULL GROUP BY class_name, feature")
def describe_by_class(spark, d):
    return _sig(statistics.describe(_stats(spark, d), ["class_name"]), *_D)


@query(f"""SELECT feature, {_s('greatest(q1 - 1.5 * (q3 - q1), 0)')} AS lower, {_s('q3 + 1.5 * (q3 - q1)')} AS upper
FROM (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM ({_LONG}) WHERE x IS NOT NULL GROUP BY feature)""")
def sweet_spot(spark, d):
    return _sig(statistics.bounds(statistics.describe(_stats(spark, d), [])).select("feature", "lower", "upper"), "lower", "upper")


@query(" UNION ALL ".join(f"SELECT class_name, '{f}' AS flag, coalesce(sum({f}), 0)::BIGINT AS set_count, {_s(f'coalesce(sum({f}), 0) * 100.0 / count(*)')} AS share FROM object_stats WHERE class_name IS NOT NULL GROUP BY class_name" for f in statistics.BINARY))
def binary_sections(spark, d):
    return _sig(statistics.binary_shares(_stats(spark, d), ["class_name"]), "share")


@query(f"SELECT class_name, {', '.join(f'coalesce(sum({c}), 0)::BIGINT AS {c}' for c in geometry.SECTOR_COLUMNS)} FROM object_stats WHERE class_name IS NOT NULL GROUP BY class_name")
def spatial_grid(spark, d):
    grid = statistics.spatial_grid(_stats(spark, d))
    return grid.select("class_name", *[F.col("grid")[i][k].alias(c) for i, names in enumerate(geometry.SECTORS) for k, c in enumerate(names)])


@query("""SELECT s.row_id, c.class_no, s.class_name, 1 AS value FROM object_stats s JOIN (SELECT class_name, (row_number() OVER (ORDER BY class_name) - 1)::INT AS class_no
FROM (SELECT DISTINCT class_name FROM object_stats WHERE class_name IS NOT NULL)) c USING (class_name)""")
def one_hot(spark, d):
    """The ones of the class columns, each with the number of its column."""
    return statistics.one_hot_cells(_stats(spark, d), "row_id")


_K = {f: _known(f) for f in statistics.NUMERIC}
_PAIRS = [(a, b) for i, a in enumerate(statistics.NUMERIC) for b in statistics.NUMERIC[i + 1 :]]


def _places(df: DataFrame, c: str = "corr") -> DataFrame:
    return df.withColumn(c, F.round(c, 5) + 0.0)


@query(" UNION ALL ".join(f"SELECT class_name, '{a}' AS feature_a, '{b}' AS feature_b, round(r, 5) + 0.0 AS corr FROM (SELECT class_name, corr({_K[a]}, {_K[b]}) AS r FROM object_stats WHERE class_name IS NOT NULL GROUP BY class_name) WHERE r IS NOT NULL AND NOT isnan(r)" for a, b in _PAIRS))
def class_corr(spark, d):
    return _places(statistics.class_correlations(_stats(spark, d)))


@query(f"""SELECT class_name, feature, round(r, 5) + 0.0 AS corr FROM (
SELECT k.class_name, l.feature, corr((coalesce(l.class_name = k.class_name, false))::INT::DOUBLE, l.x) AS r
FROM ({_LONG}) l, (SELECT DISTINCT class_name FROM object_stats WHERE class_name IS NOT NULL) k WHERE l.x IS NOT NULL GROUP BY ALL) WHERE r IS NOT NULL AND NOT isnan(r)""")
def bias_matrix(spark, d):
    return _places(statistics.bias_matrix(_stats(spark, d)))


_P = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query(f"""WITH l AS (SELECT * FROM ({_LONG}) WHERE x IS NOT NULL AND class_name IS NOT NULL AND feature IN ('object_area', 'object_aspect_ratio')),
q AS (SELECT class_name, feature, quantile_cont(x, 0.25) AS q1, median(x) AS median, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY ALL)
SELECT class_name, feature, {', '.join(f'{_s(c)} AS {c}' for c in _P)} FROM (
SELECT class_name, feature, q1, median, q3, min(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_low, max(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_high
FROM l JOIN q USING (class_name, feature) GROUP BY ALL)""")
def box_plot_stats(spark, d):
    return _sig(statistics.box_plot(_stats(spark, d)), *_P)


_EDGES = [10.0**e for e in range(0, 10)]


@query(f"""SELECT class_name, bin, count(*) AS objects FROM (SELECT class_name, {' + '.join(f'(object_area >= {e})::INT' for e in _EDGES)} AS bin FROM object_stats
WHERE class_name IS NOT NULL AND object_area IS NOT NULL) GROUP BY ALL""")
def area_hist(spark, d):
    return statistics.histogram(_stats(spark, d), "object_area", _EDGES)


@query("""SELECT row_id, class_name FROM (SELECT row_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY md5(row_id || ':42'), row_id) AS n
FROM object_stats WHERE class_name IS NOT NULL) WHERE n <= 2000""")
def stratified_sample(spark, d):
    return statistics.stratified_sample(_stats(spark, d).select("row_id", "class_name"), "row_id")


_FILLED = {f: f"coalesce({_known(f)}, 0)" for f in _FEATURES}


@query(f"SELECT row_id, {', '.join(f'round(({_FILLED[f]} - m_{f}) / s_{f}, 5) + 0.0 AS {f}_z' for f in _FEATURES)} FROM object_stats, (SELECT {', '.join(f'avg({_FILLED[f]}) AS m_{f}, stddev_pop({_FILLED[f]}) AS s_{f}' for f in _FEATURES)} FROM object_stats)")
def standardize(spark, d):
    """All numeric features that vary; the SQL takes them all for varying."""
    df = _stats(spark, d)
    features = projection.numeric_features(df)
    z = projection.standardised(df.select("row_id", *features), features)
    return z.select("row_id", *[(F.round(c, 5) + 0.0).alias(c) for c in z.columns if c not in ("row_id", *features)])


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature FROM object_stats HAVING var_samp(coalesce({_known(f)}, 0)) > 0" for f in _FEATURES))
def variance_filter(spark, d):
    """The numeric features that vary."""
    df = _stats(spark, d)
    kept = projection.varying(df, projection.numeric_features(df))
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@query()
def pca_projection(spark, d):
    """Two main axes of the standardised features."""
    df = _stats(spark, d)
    return projection.projected(df, projection.numeric_features(df)).select("row_id", "class_name", "proj_x", "proj_y")


@query()
def manifold_sample(spark, d):
    """What the manifold chart shows: a stratified sample of the table in its two main axes."""
    df = _stats(spark, d)
    placed = projection.projected(df, projection.numeric_features(df)).select("row_id", "class_name", "proj_x", "proj_y")
    return statistics.stratified_sample(placed, "row_id")


@query()
def report_lines(spark, d):
    """The lines of the text report."""
    from framewright import report

    return report.report_rows(statistics.mark_outliers(_stats(spark, d)))


@query("SELECT path, count(*) AS listings FROM annotation_files GROUP BY path")
def poll_once(spark, d):
    """The listing read as a stream, once over what is there; each batch is kept under its number."""
    from framewright.streaming import poll

    return poll.read_once(spark, d, "annotation_files.parquet", table(spark, d, "annotation_files").schema).groupBy("path").agg(F.count(F.lit(1)).alias("listings"))


@query("""SELECT user_id, event_id, frame_id, (frame_id // 10)::BIGINT AS number FROM (
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_id FROM events) WHERE frame_id % 10 = 0""")
def frame_sampling(spark, d):
    """Events of a user as the frames of a video of 2.5 a second, one every 4 seconds."""
    videos = frames.numbered(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])
    return frames.sampled(videos.withColumn("fps", F.lit(2.5)), 4).select("user_id", "event_id", "frame_id", "number")


# --- hashes and pixels -----------------------------------------------------------
@query("""SELECT vec_id, i AS bit, embedding[(i // 7) * 8 + i % 7 + 2] > embedding[(i // 7) * 8 + i % 7 + 1] AS value
FROM (SELECT vec_id, embedding, unnest(range(0, 56)) AS i FROM embeddings)""")
def dhash_bits(spark, d):
    """Vectors of 64 numbers as 8 x 8 rasters: their difference bits."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(raster.raster_bits(F.col("embedding"), 8, 8)).alias("bit", "value")).withColumn("bit", F.col("bit").cast("bigint"))


_CELLS = "SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings"
_AT = lambda x, y: f"embedding[({y}) * 8 + ({x}) + 1]::DOUBLE"
_X, _Y = "(i % 8)", "(i // 8)"


@query(f"""SELECT vec_id, {_s('avg(v)')} AS brightness, {_s('stddev_pop(v)')} AS contrast, {_s('var_pop(lap)')} AS blur FROM (SELECT vec_id, {_AT(_X, _Y)} AS v,
{_AT(f'abs({_X} - 1)', _Y)} + {_AT(f'CASE WHEN {_X} = 7 THEN 6 ELSE {_X} + 1 END', _Y)} + {_AT(_X, f'abs({_Y} - 1)')} + {_AT(_X, f'CASE WHEN {_Y} = 7 THEN 6 ELSE {_Y} + 1 END')} - 4 * {_AT(_X, _Y)} AS lap
FROM ({_CELLS})) GROUP BY vec_id""")
def pixel_metrics(spark, d):
    return _sig(raster.small_raster_quality(table(spark, d, "embeddings"), "vec_id", "embedding", 8, 8), "brightness", "contrast", "blur")


_CODES = """SELECT string_agg((b::INT)::VARCHAR, '' ORDER BY i)::BIT AS h, id FROM (
SELECT id, unnest(hash) AS b, unnest(range(0, 256)) AS i FROM (SELECT hash, min(hash_id) AS id FROM image_hashes WHERE len(hash) = 256 GROUP BY hash)) GROUP BY id"""


@query(f"SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.h, b.h))::INT AS distance FROM ({_CODES}) a JOIN ({_CODES}) b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 25")
def hamming_pairs(spark, d):
    """Pairs of different hashes by their representatives; hamming_members has the rows of each."""
    return dedup.near_pairs(table(spark, d, "image_hashes"), bits=256, most=25)


@query("""SELECT hash_id, min(hash_id) OVER (PARTITION BY hash) AS representative FROM image_hashes
WHERE hash_id IS NOT NULL AND len(hash) = 256 AND len(list_filter(hash, lambda b: b IS NULL)) = 0""")
def hamming_members(spark, d):
    """Every usable row with the representative of its hash: rows of one stand 0 bits apart and share its pairs."""
    return dedup.members(table(spark, d, "image_hashes"), bits=256)


@query(f"""WITH RECURSIVE c AS (SELECT id, h, row_number() OVER (ORDER BY id) AS n FROM ({_CODES})),
walk AS (SELECT 0::BIGINT AS n, []::STRUCT(id BIGINT, h BIT)[] AS kept
UNION ALL SELECT w.n + 1, CASE WHEN len(list_filter(w.kept, lambda b: bit_count(xor(b.h, c.h)) <= 25)) > 0 THEN w.kept ELSE list_append(w.kept, {{'id': c.id, 'h': c.h}}) END
FROM walk w JOIN c ON c.n = w.n + 1)
SELECT hash_id FROM image_hashes WHERE len(hash) = 256 AND hash_id NOT IN (SELECT u.id FROM (SELECT unnest(kept) AS u FROM walk WHERE n = (SELECT max(n) FROM c)))""")
def dup_greedy(spark, d):
    return dedup.duplicates(table(spark, d, "image_hashes"), bits=256, most=25)
