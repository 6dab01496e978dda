"""Queries: metadata, text transforms, reports, preferences and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image, metadata, prefs, text, values
from ..sources import files
from . import report
from . import views as v

# The opening and closing parts of a prompt.
INTRO = (
    "You are an expert ornithologist analyzing a single photograph. Determine whether the image contains a bird, and if so, locate it and "
    "identify it as specifically as you confidently can."
)


def metadata_shape(spark: SparkSession, d: str) -> DataFrame:
    """Place and date if their toggle is on and they are finite; a region only if wanted and no place is given."""
    c = v.table(spark, d, "customer")
    k, nan = F.col("c_custkey"), F.lit(float("nan"))
    lat = F.when(k % 10 == 0, nan).otherwise(k % 90 * 1.0)
    lon = F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(k % 180 * -1.0)
    path = F.when(k % 3 == 0, F.lit("/photos/Spain/x.jpg")).otherwise("/Users/Spain/x.jpg")
    got = metadata.shape(lat, lon, F.when(k % 7 != 0, k * 86400.5), path, F.when(k % 4 != 0, True), k % 2 == 0)
    return c.select("c_custkey", got.alias("m")).select("c_custkey", "m.*")


def cocoa_date(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "orders").select("o_orderkey", values.cocoa_date(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") * 1000)).alias("date"))


_PATHS = (
    "/Users/Volumes/Canada/a.jpg", "/Users/Canada/a.jpg", "//server/Spain/a.jpg", "C:\\Users\\Canada\\Italy\\a.jpg", "/x/ deutschland /a.jpg",
    "/Volumes/Germany/France/a.jpg", "/System/Volumes/Data/Users/japan/USA/a.jpg", "", "/us/uk/a.jpg", "\\\\host\\Japan",
)
_HINTS = ("Canada", "", "", "Italy", "Germany", "France", "United States", "", "", "")


def path_hint(spark: SparkSession, d: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return v.table(spark, d, "orders").select("o_orderkey", values.region_hint(path).alias("hint"))


_SECRETS = ("sk-ant-a_1", "sk-abc-9", "AIzaXy_-", "bEarer ab+/=.c", "ftp://u:p@host", "/Users/me/x y", "/Volumes/d", "\\\\srv\\s", "c:\\a b", "-12.34567", "1.234")


def redact_values(spark: SparkSession, d: str) -> DataFrame:
    """Every text with a secret behind it."""
    secret = F.element_at(F.array(*map(F.lit, _SECRETS)), (F.col("doc_id") % 11 + 1).cast("int"))
    return v.table(spark, d, "documents").select("doc_id", text.redact_values(F.concat("text", F.lit(' "'), secret, F.lit('" end'))).alias("text"))


_PAIRS = ("token=abc", "foo=token=abc", '"api_key": "k1", x', "lat=47.1&lon=8", "note: keep", "PASSWORD : p w")


def redact_keyed(spark: SparkSession, d: str) -> DataFrame:
    pair = F.element_at(F.array(*map(F.lit, _PAIRS)), (F.col("event_id") % 6 + 1).cast("int"))
    return v.table(spark, d, "events").select("event_id", text.redact_keyed(F.concat_ws(" ", F.lit("a"), pair, F.lit("b"))).alias("line"))


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    m = metadata_shape(spark, d)
    addition = F.when(F.col("c_custkey") % 5 == 0, "END USER GUIDANCE now").when(F.col("c_custkey") % 5 == 1, "").otherwise(F.lit(None))
    day = F.col("c_custkey").cast("string")
    got = text.prompt(INTRO, F.when(F.col("c_custkey") % 3 == 0, text.directive("box_2d")).otherwise(text.directive()), F.col("latitude").cast("long"), F.col("longitude").cast("long"), F.when(F.col("date").isNotNull(), day), F.col("hint"), addition)
    return m.select("c_custkey", got.alias("prompt"))


def xml_escape(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").select("page_id", text.xml_escape(F.col("html")).alias("escaped"))


def url_percent(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "pages").select(
        "page_id", text.percent(F.concat("url", F.lit(" *~é"))).alias("encoded"), text.file_url(F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("/a b/"), "url"))).alias("file_url")
    )


def _svgs(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of a label are boxes of one photo each; values beyond the frame are cut."""
    e = F.col("embedding").cast("array<double>")
    det = F.array(F.struct(F.slice(e, 1, 4).alias("bbox"), F.concat(F.lit("t<"), F.col("vec_id").cast("string")).alias("title"), F.lit("a&b").alias("label")))
    return v.table(spark, d, "embeddings").select("vec_id", "label", report.svg(F.lit(640.0), F.lit(480.0), det).alias("svg"))


def svg_render(spark: SparkSession, d: str) -> DataFrame:
    return _svgs(spark, d).select("vec_id", "svg")


def gallery_page(spark: SparkSession, d: str) -> DataFrame:
    """A page for each hundred vectors, in order."""
    part = _svgs(spark, d).select(F.floor(F.col("vec_id") / 100).alias("page"), "vec_id", report.section(F.concat(F.lit("v"), F.col("vec_id").cast("string")), F.array(F.lit("a&b")), F.col("svg")).alias("s"))
    return part.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("vec_id", "s"))).alias("p")).select("page", report.gallery(F.transform("p", lambda x: x["s"])).alias("html"))


def bbox_denorm(spark: SparkSession, d: str) -> DataFrame:
    box = metadata.denormalized(F.col("embedding").cast("array<double>"), F.lit(640), F.lit(480))
    return v.table(spark, d, "embeddings").select("vec_id", box.alias("b")).select("vec_id", *(F.col("b")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def bbox_clamp_svg(spark: SparkSession, d: str) -> DataFrame:
    p = report.pixels(F.slice(F.col("embedding").cast("array<double>"), 1, 4), F.lit(640.0), F.lit(480.0))
    return v.table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", *(values.half_up(F.col(f"p.{c}")).alias(c) for c in "xywh"))


def round_half_up(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "customer").select("c_custkey", values.half_up((F.col("c_custkey") - 700) / 2).alias("rounded"))


def prefs_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Every numeric preference against prices and odd values."""
    keys = F.array(*(F.lit(k[0]) for k in values.NUMBER_PREFS))
    k = F.col("p_partkey")
    raw = F.when(k % 13 == 0, F.lit(float("nan"))).when(k % 17 == 0, F.lit(float("inf"))).when(k % 19 == 0, F.lit(float("-inf"))).when(k % 23 == 0, F.lit(None)).otherwise(k % 91 * 1.5 - 30)
    key = F.element_at(keys, (k % 7 + 1).cast("int"))
    return v.table(spark, d, "part").select("p_partkey", key.alias("pref"), values.clamp_pref(key, raw).alias("value"))


_BOOLS = ("true", " No ", "OFF", "0", "", "yes", "False", "nil")


def to_bool(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 9 != 0, F.element_at(F.array(*map(F.lit, _BOOLS)), (F.col("p_partkey") % 8 + 1).cast("int")))
    return v.table(spark, d, "part").select("p_partkey", values.to_bool(raw).alias("value"))


def reconcile_model(spark: SparkSession, d: str) -> DataFrame:
    """Brands are providers and names their models: a name that only another brand has gives way to the brand's first one."""
    p = v.table(spark, d, "part")
    models = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("provider"), F.col("p_name").alias("model"), F.col("p_name").alias("place"))
    model = F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 10 == 1, "own model").otherwise(F.col("p_name"))
    return prefs.reconciled(p.select("p_partkey", F.col("p_brand").alias("provider"), model.alias("model")), models).select("p_partkey", "model")


def stale_dirs(spark: SparkSession, d: str) -> DataFrame:
    """Run folders at least six hours old, report folders at least one; unknown ages stay."""
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("run-"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("report-"), k.cast("string"))).otherwise(F.concat(F.lit("other-"), k.cast("string")))
    age = F.when(k % 10 != 0, F.col("o_totalprice") / 10)
    return v.table(spark, d, "orders").select("o_orderkey", files.stale(name, age.cast("double")).alias("stale"))


def token_status(spark: SparkSession, d: str) -> DataFrame:
    """Stored, empty and unreadable tokens in slots of all kinds."""
    k = F.col("c_custkey")
    read, stored = k % 3 < 2, F.when(k % 3 == 1, "secret").when(k % 6 == 0, "")
    status = prefs.token_status(read, stored)
    slot = F.when(k % 7 == 0, F.lit(1.5)).when(k % 5 > 0, (k % 5 - 1).cast("double"))
    moves = prefs.needs_migration(F.when(k % 4 > 0, "1,2"), status)
    return v.table(spark, d, "customer").select("c_custkey", status.alias("status"), prefs.token_key(F.col("c_mktsegment"), slot).alias("slot_key"), moves.alias("migrates"))


_RAW = {
    "confidenceThreshold": ("0.25", " 7 ", "-1", "x", "NaN", None), "previewSize": (None, "100", "3000.5"), "clusterMaxGapSeconds": ("31", "2.5", None, "Infinity"), "maxConcurrency": ("4.9", "0", "51", "Infinity", None),
    "deepExportConcurrency": ("3", None), "writeBatchSize": ("-5", "10.2"), "clusterSimilarityThreshold": ("65", "1e1", ""), "sendGpsDate": ("off", None, "yes", " NO "), "usePathHint": (None, "1", "0"),
    "dryRun": ("true", "False"), "singleKeywordPerPhoto": (None,), "clusterBursts": ("", "on"), "clusterUseStacks": (None, "0"), "showDetectionReport": ("maybe", "off"), "provider": ("a", None), "model": ("m1", "", None),
    "promptAddition": (None, "Look."), "unknown": ("9",),
}


def normalized_prefs(spark: SparkSession, d: str) -> DataFrame:
    """Raw preferences, each with values of all kinds and sometimes absent, as a map of texts."""
    k = F.col("p_partkey")
    entries = [x for name, items in _RAW.items() for x in (F.lit(name), F.element_at(F.array(*(F.lit(i).cast("string") for i in items)), (k % len(items) + 1).cast("int")))]
    return v.table(spark, d, "part").select("p_partkey", prefs.normalized(F.create_map(*entries)).alias("p")).select("p_partkey", "p.*")


def jpeg_dims(spark: SparkSession, d: str) -> DataFrame:
    """Headers made of page ids: whole ones, cut ones and other data."""
    k = F.col("page_id").cast("int")
    size = F.concat(F.lpad(F.hex(k % 4000 + 1), 4, "0"), F.lpad(F.hex(k % 300 + 7), 4, "0"))
    whole = F.concat(F.lit("FFD8FFE000040000FFC0001108"), size, F.lit("03011100021101031101"), F.lit("FFD9"))
    raw = F.when(k % 5 == 3, F.lit("474946")).when(k % 5 == 4, F.substring(whole, 1, 26)).otherwise(whole)
    return v.table(spark, d, "pages").select("page_id", image.jpeg_dims(F.unhex(raw)).alias("s")).select("page_id", "s.width", "s.height", "s.err")


def dc_luma_grid(spark: SparkSession, d: str) -> DataFrame:
    """Flat grey images of one block, whose level comes from the page id."""
    return v.table(spark, d, "pages").select("page_id", image.luma_grid(image.flat_jpeg(F.col("page_id") % 8)).alias("grid")).select(
        "page_id", F.size("grid").alias("cells"), F.array_min("grid").alias("low"), F.array_max("grid").alias("high")
    )


_META = """m AS (
    SELECT c_custkey, c_custkey % 4 <> 0 AS on_, c_custkey % 4 <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 11 <> 0 AS gps, c_custkey % 3 = 0 AS spain FROM customer
), shaped AS (
    SELECT c_custkey, CASE WHEN gps THEN (c_custkey % 90)::DOUBLE END AS latitude, CASE WHEN gps THEN -(c_custkey % 180)::DOUBLE END AS longitude,
           CASE WHEN on_ AND c_custkey % 7 <> 0 THEN strftime(to_timestamp(floor(c_custkey * 86400.5) + 978307200) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS date,
           CASE WHEN c_custkey % 2 = 0 AND NOT gps AND spain THEN 'Spain' END AS hint FROM m)"""
_MASKS = ("sk-ant-*", "sk-*", "AIza*", "Bearer *", "ftp://*@host", "/Users/*", "/Volumes/*", "\\\\*", "c:\\*", "*", "1.234")
_M = text.MASK
_KEYED = (f"token={_M}", "foo=token=abc", f'"api_key": "{_M}", x', f"lat={_M}&lon={_M}", "note: keep", f"PASSWORD : {_M} w")


def _list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_VALUE_SQL = "text"
for _p, _r in text.SECRET_VALUES:
    _VALUE_SQL = f"regexp_replace({_VALUE_SQL}, '{_p.replace(chr(39), chr(39) * 2).replace('x0B', 'x0b')}', '{_r.replace('$1', chr(92) + '1')}', 'g')"
_PIX = """p AS (SELECT vec_id, list_transform(e[1:4], lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))) AS c FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
q AS (SELECT vec_id, least(c[1], c[3]) * 640 AS x, least(c[2], c[4]) * 480 AS y, (greatest(c[1], c[3]) - least(c[1], c[3])) * 640 AS w, (greatest(c[2], c[4]) - least(c[2], c[4])) * 480 AS h FROM p)"""
_R = lambda e: f"floor({e} + 0.5)::BIGINT"
_SVG = f"""'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="480" viewBox="0 0 640 480"><g><rect x="' || {_R('x')} || '" y="' || {_R('y')} || '" width="' || {_R('w')} || '" height="' || {_R('h')}
    || '" fill="none" stroke="blue" stroke-width="2"><title>t&lt;' || vec_id || '</title></rect><text x="' || {_R('(x + 2)')} || '" y="' || {_R('(y + 14)')}
    || '" fill="blue" font-size="14" font-family="sans-serif">a&amp;b</text></g></svg>'"""
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_BOUNDS = "CASE pref " + " ".join(
    f"WHEN '{k}' THEN CASE WHEN raw IS NULL OR isnan(raw) {'OR isinf(raw) ' if kind == 'int' else ''}THEN {default}::DOUBLE ELSE greatest({low}::DOUBLE, least({high}::DOUBLE, {'floor(raw)' if kind == 'int' else 'raw'})) END"
    for k, kind, low, high, default in values.NUMBER_PREFS
) + " END"
_RAW_SQL = ", ".join(f"[{', '.join('NULL' if i is None else repr(i) for i in items)}][(p_partkey % {len(items)} + 1)::INT]::VARCHAR AS r_{name}" for name, items in _RAW.items())
_NORMAL_SQL = ", ".join(
    f"CASE WHEN n IS NULL OR isnan(n) {'OR isinf(n) ' if kind == 'int' else ''}THEN {default}::DOUBLE ELSE greatest({low}::DOUBLE, least({high}::DOUBLE, {'floor(n)' if kind == 'int' else 'n'})) END".replace(
        "(n", f"(try_cast(trim(r_{name}) AS DOUBLE)"
    ).replace("n IS NULL", f"try_cast(trim(r_{name}) AS DOUBLE) IS NULL").replace(", n)", f", try_cast(trim(r_{name}) AS DOUBLE))")
    + f' AS "{name}"'
    for name, kind, low, high, default in values.NUMBER_PREFS
)
_NORMAL_SQL += ", " + ", ".join(f"CASE WHEN r_{n} IS NULL THEN {default} ELSE lower(trim(r_{n})) NOT IN ('false', 'no', 'off', '0', '') END AS \"{n}\"" for n, default in prefs.BOOL_PREFS)
_NORMAL_SQL += ", " + ", ".join(f"coalesce(r_{n}, '{default}') AS \"{n}\"" for n, default in prefs.TEXT_PREFS)

QUERIES = {
    f.__name__: f
    for f in (
        metadata_shape, cocoa_date, path_hint, redact_values, redact_keyed, prompt_build, xml_escape, url_percent, svg_render, gallery_page, bbox_denorm,
        bbox_clamp_svg, round_half_up, prefs_clamp, to_bool, reconcile_model, stale_dirs, token_status, normalized_prefs, jpeg_dims, dc_luma_grid,
    )
}
SQL = {
    "metadata_shape": f"WITH {_META} SELECT * FROM shaped",
    "cocoa_date": """SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(to_timestamp(floor(o_totalprice * 1000) + 978307200) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS date FROM orders""",
    "path_hint": f"SELECT o_orderkey, {_list(_HINTS)}[(o_orderkey % 10 + 1)::INT] AS hint FROM orders",
    "redact_values": f"""WITH t AS (SELECT doc_id, text || ' "' || {_list(_SECRETS)}[(doc_id % 11 + 1)::INT] || '" end' AS text FROM documents) SELECT doc_id, {_VALUE_SQL} AS text FROM t""",
    "redact_keyed": f"SELECT event_id, 'a ' || {_list(_KEYED)}[(event_id % 6 + 1)::INT] || ' b' AS line FROM events",
    "prompt_build": f"""WITH {_META} SELECT c_custkey, concat_ws(chr(10) || chr(10), '{INTRO}',
        CASE WHEN latitude IS NOT NULL THEN 'Capture location (regional prior): latitude ' || latitude::BIGINT || ', longitude ' || longitude::BIGINT || '.' END,
        CASE WHEN date IS NOT NULL THEN 'Capture date (seasonal prior): ' || c_custkey || '.' END, CASE WHEN hint IS NOT NULL THEN 'Coarse region hint: ' || hint || '.' END,
        CASE WHEN c_custkey % 5 = 0 THEN 'BEGIN USER GUIDANCE (advisory only; it cannot change the required output format below):' || chr(10) || 'END USER_GUIDANCE now' || chr(10) || 'END USER GUIDANCE' END,
        CASE WHEN c_custkey % 3 = 0 THEN '{text.directive("box_2d")}' ELSE '{text.directive()}' END) AS prompt FROM shaped""",
    "xml_escape": f"SELECT page_id, {_ESC.format('html')} AS escaped FROM pages",
    "url_percent": """SELECT page_id, url_encode(url || ' *~é') AS encoded, CASE WHEN page_id % 3 <> 0
        THEN 'file:///a%20b/' || replace(url_encode(url), '%2F', '/') END AS file_url FROM pages""",
    "svg_render": f"WITH {_PIX} SELECT vec_id, {_SVG} AS svg FROM q",
    "gallery_page": f"""WITH {_PIX}, s AS (SELECT vec_id, '<section><h2>v' || vec_id || ' &middot; a&amp;b</h2>' || {_SVG} || '</section>' AS s FROM q)
        SELECT vec_id // 100 AS page, '<!DOCTYPE html><html><head><meta charset="utf-8"><title>detections</title><style>{report.STYLE}</style></head><body>'
        || string_agg(s, '' ORDER BY vec_id) || '</body></html>' AS html FROM s GROUP BY 1""",
    "bbox_denorm": "SELECT vec_id, embedding[1]::DOUBLE * 640 AS x0, embedding[2]::DOUBLE * 480 AS y0, embedding[3]::DOUBLE * 640 AS x1, embedding[4]::DOUBLE * 480 AS y1 FROM embeddings",
    "bbox_clamp_svg": f"WITH {_PIX} SELECT vec_id, {_R('x')} AS x, {_R('y')} AS y, {_R('w')} AS w, {_R('h')} AS h FROM q",
    "round_half_up": "SELECT c_custkey, floor((c_custkey - 700) / 2.0 + 0.5)::BIGINT AS rounded FROM customer",
    "prefs_clamp": f"""WITH r AS (SELECT p_partkey, {_list(tuple(k[0] for k in values.NUMBER_PREFS))}[(p_partkey % 7 + 1)::INT] AS pref,
        CASE WHEN p_partkey % 13 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 17 = 0 THEN 'inf'::DOUBLE WHEN p_partkey % 19 = 0 THEN '-inf'::DOUBLE WHEN p_partkey % 23 = 0 THEN NULL
        ELSE p_partkey % 91 * 1.5::DOUBLE - 30 END AS raw FROM part) SELECT p_partkey, pref, {_BOUNDS} AS value FROM r""",
    "to_bool": f"""SELECT p_partkey, coalesce(lower(trim(CASE WHEN p_partkey % 9 <> 0 THEN {_list(_BOOLS)}[(p_partkey % 8 + 1)::INT] END)) NOT IN ('false', 'no', 'off', '0', ''), false) AS value FROM part""",
    "reconcile_model": """WITH m AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_partkey % 2 = 0),
        c AS (SELECT p_partkey, p_brand, CASE p_partkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'own model' ELSE p_name END AS model FROM part)
        SELECT p_partkey, CASE WHEN model <> '' AND (EXISTS (SELECT 1 FROM m WHERE m.p_brand = c.p_brand AND m.p_name = model) OR model NOT IN (SELECT p_name FROM m)) THEN model
        ELSE (SELECT min(p_name) FROM m WHERE m.p_brand = c.p_brand) END AS model FROM c""",
    "stale_dirs": """SELECT o_orderkey, o_orderkey % 10 <> 0 AND CASE o_orderkey % 3 WHEN 0 THEN o_totalprice / 10 >= 21600 WHEN 1 THEN o_totalprice / 10 >= 3600 ELSE false END AS stale FROM orders""",
    "token_status": """WITH s AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'set' ELSE 'keychain_error' END AS status,
            CASE WHEN c_custkey % 7 > 0 AND c_custkey % 5 > 0 THEN c_custkey % 5 - 1 END AS slot FROM customer)
        SELECT c_custkey, status, CASE WHEN slot >= 1 THEN c_mktsegment || '_api_token' || CASE WHEN slot > 1 THEN '_' || slot ELSE '' END END AS slot_key,
               c_custkey % 4 = 0 AND status = 'set' AS migrates FROM s""",
    "normalized_prefs": f"WITH r AS (SELECT p_partkey, {_RAW_SQL} FROM part) SELECT p_partkey, {_NORMAL_SQL} FROM r",
    "jpeg_dims": """SELECT page_id, CASE WHEN page_id % 5 < 3 THEN (page_id % 300 + 7)::INT END AS width, CASE WHEN page_id % 5 < 3 THEN (page_id % 4000 + 1)::INT END AS height,
        CASE page_id % 5 WHEN 3 THEN 'not-a-jpeg' WHEN 4 THEN 'truncated' END AS err FROM pages""",
    "dc_luma_grid": "SELECT page_id, 64::INT AS cells, (page_id % 8)::DOUBLE AS low, (page_id % 8)::DOUBLE AS high FROM pages",
}
