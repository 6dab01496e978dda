"""Queries: committed batches, report files, run state, the sweep of left-over folders, and images from a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import image
from ..functions.text import data_url
from ..sources import batches, files, state
from ..sources.shared import shared_path, stash
from . import report
from . import views as v
from .q_plan import _STATES, _states


def _applied(spark: SparkSession, d: str) -> str:
    """A target after six batches of labels, by photo: stored names, rendered ones of which some are refused, the same as a whole, and others.

    Then a batch id comes again with other names, and a batch whose names are all there.
    """
    target = shared_path(spark, "applied")
    named = v.labels(spark, d).filter("rendered IS NOT NULL").select("photo_key", F.col("rendered").alias("raw"), F.col("name").alias("stored"))
    named = stash(named.distinct(), "labels")
    part = lambda k, name: named.filter(F.col("photo_key") % 4 == k).select("photo_key", F.col(name).alias("name"))
    batches.apply(part(0, "stored"), target, "plain")
    batches.apply(part(1, "raw"), target, "raw")
    batches.apply(part(2, "raw"), target, "whole", whole=True)
    batches.apply(part(3, "stored"), target, "rest")
    batches.apply(part(2, "stored"), target, "rest")
    batches.apply(part(0, "stored"), target, "again")
    return target


def applied_names(spark: SparkSession, d: str) -> DataFrame:
    return batches.committed(spark, _applied(spark, d)).select("photo_key", "name", "batch")


def applied_log(spark: SparkSession, d: str) -> DataFrame:
    return batches.log(spark, _applied(spark, d)).select("batch", "status", "planned", "added", "errors", "failed")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """A vector is a photo of one detection."""
    e, k = F.col("embedding").cast("array<double>"), F.col("vec_id")
    common, scientific = F.when(k % 7 != 0, F.concat(F.lit("bird <"), F.col("label").cast("string"), F.lit(">"))), F.when(k % 3 != 0, F.concat(F.lit("Avis "), k.cast("string")))
    sure = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 5 != 0, (k % 201) / 200.0)
    title = report.detection_title(common, scientific, sure, F.when(k % 2 == 0, "genus"), F.when(k % 13 != 0, "a rank"))
    label = report.detection_label(F.when(k % 4 == 0, "").when(k % 4 == 1, "A & B"), common, scientific, F.lit(None).cast("string"))
    det = F.array(F.struct(F.slice(e, 1, 4).alias("bbox"), title.alias("title"), label.alias("label")))
    return v.table(spark, d, "embeddings").select(F.col("vec_id").alias("index"), label.alias("label"), report.svg(F.lit(640.0), F.lit(480.0), det).alias("svg"))


def report_files(spark: SparkSession, d: str) -> DataFrame:
    """The reports of all photos, written as files and read back."""
    folder = shared_path(spark, "report")
    report.write_reports(_reports(spark, d), folder)
    return files.read_files(spark, folder, pattern="report-*.svg").select("name", F.decode("content", "UTF-8").alias("svg"))


def gallery_files(spark: SparkSession, d: str) -> DataFrame:
    """A gallery for each hundred photos, written as a file and read back."""
    folder = shared_path(spark, "gallery")
    part = _reports(spark, d).select(F.floor(F.col("index") / 100).alias("page"), "index", report.section(F.concat(F.lit("v"), F.col("index").cast("string")), F.array("label"), F.col("svg")).alias("s"))
    pages = part.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("index", "s"))).alias("p"))
    html = F.encode(report.gallery(F.transform("p", lambda x: x["s"])), "UTF-8")
    files.write_files(pages.select(F.concat(F.lit("gallery-"), F.col("page").cast("string"), F.lit(".html")).alias("name"), html.alias("content")), folder)
    return files.read_files(spark, folder).select("name", F.decode("content", "UTF-8").alias("html"))


def run_state(spark: SparkSession, d: str) -> DataFrame:
    """What readers see before, between and after two saves, and when the state is cleared; the second reader reads after the second save."""
    folder, rows = shared_path(spark, "state"), _states(spark, d)
    seen = [state.load(spark, folder)]
    state.save(rows.filter("idx % 2 = 0"), folder)
    seen.append(state.load(spark, folder))
    state.save(rows.filter("idx % 3 = 0"), folder)
    seen.append(state.load(spark, folder))
    state.clear(spark, folder)
    seen.append(state.load(spark, folder))
    rows = reduce(DataFrame.unionByName, (x.withColumn("step", F.lit(i)) for i, x in enumerate(seen)))
    return rows.groupBy("step", "photo_id", "outcome").agg(F.count("*").alias("n"))


def swept_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders of suppliers' runs and reports, swept after half an hour, two hours and seven; a dry run at the end shows what has stayed."""
    root = shared_path(spark, "temp")
    k = F.col("s_suppkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("run-", "report-", "other-", "run-.", "Report-"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    s = v.table(spark, d, "supplier").select(F.concat(kind, k).alias("folder"), F.col("s_name").alias("note"))
    files.write_files(s.select(F.concat("folder", F.lit("/note.txt")).alias("name"), F.encode("note", "UTF-8").alias("content")), root)
    steps = []
    for hours in (0.5, 2.0, 7.0):
        now = F.current_timestamp() + F.make_dt_interval(mins=F.lit(int(hours * 60)))
        steps.append(stash(files.sweep(spark, root, ["run-5", "report-6"], now, dry_run=False), "swept").select("name", "stale", F.lit(hours).alias("hours")))
    left = files.sweep(spark, root, []).select("name", F.lit(None).cast("boolean").alias("stale"), F.lit(99.0).alias("hours"))
    return reduce(DataFrame.unionByName, [*steps, left])


_ERRORS = {
    "not-a-jpeg": "FFD8", "no-soi": "4749463839", "bad-marker": "FFD80012", "truncated": "FFD8FFE00040AA", "truncated-len": "FFD8FFE000", "bad-segment-length": "FFD8FFE0000100",
    "bad-sof-length": "FFD8FFC0000400", "sos-before-sof": "FFD8FFDA0008", "no-sof": "FFD8FFE0000400FFD9",
}
#: Bytes of a file that is read at most, in the query.
_CAP = 120


def loaded_images(spark: SparkSession, d: str) -> DataFrame:
    """Pages as images: some have bytes of their own, others a file in a folder, which may be missing, broken in every way, or too large."""
    k, folder = F.col("page_id"), shared_path(spark, "images")
    size = F.concat(F.lpad(F.hex(k % 4000 + 1), 4, "0"), F.lpad(F.hex(k % 300 + 7), 4, "0"))
    whole = F.concat(F.lit("FFD8FFE000040000FFC0001108"), size, F.lit("03011100021101031101"), F.lit("FFD9"))
    bad = F.element_at(F.array(*map(F.lit, _ERRORS.values())), (k % len(_ERRORS) + 1).cast("int"))
    pages = v.table(spark, d, "pages").select("page_id")
    made = F.unhex(F.when(k % 4 == 1, bad).when(k % 4 == 2, F.concat(whole, F.repeat(F.lit("00"), 100))).otherwise(whole))
    files.write_files(pages.filter("page_id % 5 > 0").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")).alias("name"), made.alias("content")), folder)
    read = files.read_files(spark, folder, most=_CAP).select("name", F.col("content").alias("file"))
    own = F.when(k % 10 == 0, F.unhex(F.lit("FFD8FFC00008080003000401FFD9"))).when(k % 10 == 1, F.unhex(F.lit("")))
    asked = pages.select("page_id", own.alias("own"), F.concat(F.lit("p"), k.cast("string"), F.lit(".jpg")).alias("name"))
    got = asked.join(read, "name", "left").select("page_id", image.inline(F.col("own"), F.col("file")).alias("data"))
    found = got.select("page_id", F.octet_length("data").alias("bytes"), F.md5(data_url(F.col("data"))).alias("url_md5"), F.when(F.col("data").isNotNull(), image.jpeg_dims(F.col("data"))).alias("s"))
    return found.select("page_id", "bytes", "url_md5", "s.width", "s.height", "s.err")


QUERIES = {f.__name__: f for f in (applied_names, applied_log, report_files, gallery_files, run_state, swept_folders, loaded_images)}

_SEEN = f"""{v.LAB}, named AS (
    SELECT DISTINCT photo_key, rendered AS raw, {v.WRITABLE.format("rendered")} AS stored FROM lab WHERE rendered IS NOT NULL
), offered AS (
    SELECT DISTINCT photo_key, ['plain', 'raw', 'whole', 'rest'][(photo_key % 4 + 1)::INT] AS batch, CASE WHEN photo_key % 4 IN (1, 2) THEN raw ELSE stored END AS name FROM named
), judged AS (
    SELECT *, trim(name) = '' OR contains(name, ',') OR regexp_matches(name, '\\?\\s*$') AS bad FROM offered
)"""
_E = "embedding::DOUBLE[]"
_TWO = "printf('%.2f', vec_id % 201 / 200.0::DOUBLE)"
_PHOTOS = f"""e AS (
    SELECT vec_id AS k, list_transform(({_E})[1:4], lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, x))) AS c,
           CASE WHEN vec_id % 7 <> 0 THEN 'bird <' || label || '>' END AS common, CASE WHEN vec_id % 3 <> 0 THEN 'Avis ' || vec_id END AS scientific,
           CASE WHEN vec_id % 11 = 0 OR vec_id % 5 = 0 THEN '?' ELSE {_TWO} END AS conf FROM embeddings
), t AS (
    SELECT *, coalesce(common, scientific, 'bird') || ' (' || coalesce(scientific, '?') || ')  conf=' || conf || '  rank='
           || coalesce(CASE WHEN k % 2 = 0 THEN 'genus' END, CASE WHEN k % 13 <> 0 THEN 'a rank' END, '?') AS title,
           CASE WHEN k % 4 = 1 THEN 'A & B' ELSE coalesce(common, scientific, 'bird') END AS label,
           least(c[1], c[3]) * 640 AS x, least(c[2], c[4]) * 480 AS y, (greatest(c[1], c[3]) - least(c[1], c[3])) * 640 AS w, (greatest(c[2], c[4]) - least(c[2], c[4])) * 480 AS h FROM e
), photos AS (
    SELECT k, {{esc_label}} AS label, '<svg xmlns="http://www.w3.org/2000/svg" width="640" height="480" viewBox="0 0 640 480"><g><rect x="' || {{x}} || '" y="' || {{y}} || '" width="' || {{w}} || '" height="' || {{h}}
        || '" fill="none" stroke="blue" stroke-width="2"><title>' || {{esc_title}} || '</title></rect><text x="' || {{x2}} || '" y="' || {{y14}}
        || '" fill="blue" font-size="14" font-family="sans-serif">' || {{esc_label}} || '</text></g></svg>' AS svg FROM t
)"""
_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_R = "floor({0} + 0.5)::BIGINT"
_PHOTOS = _PHOTOS.format(
    esc_label=_ESC.format("label"), esc_title=_ESC.format("title"), x2=_R.format("(x + 2)"), y14=_R.format("(y + 14)"), **{c: _R.format(c) for c in "xywh"}
)
_HEX = "CASE WHEN k % 4 = 1 THEN [" + ", ".join(f"'{h}'" for h in _ERRORS.values()) + f"][(k % {len(_ERRORS)} + 1)::INT] WHEN k % 4 = 2 THEN whole || repeat('00', 100) ELSE whole END"
SQL = {
    "applied_names": f"""WITH {_SEEN} SELECT photo_key, name, batch FROM judged WHERE NOT bad AND batch <> 'whole'""",
    "applied_log": f"""WITH {_SEEN},
        fail AS (SELECT batch, string_agg(j.q, ' | ' ORDER BY j.photo_key, j.name) AS failed FROM (
            SELECT batch, photo_key, name, '"' || name || '"' AS q FROM judged WHERE bad QUALIFY row_number() OVER (PARTITION BY batch ORDER BY photo_key, name) <= 15) j GROUP BY batch),
        n AS (SELECT batch, count(*) AS planned, count(*) FILTER (bad) AS errors FROM judged GROUP BY batch)
        SELECT n.batch, CASE WHEN errors > 0 THEN 'error' ELSE 'executed' END AS status, planned, CASE WHEN n.batch = 'whole' THEN 0 ELSE planned - errors END AS added, errors, failed
        FROM n LEFT JOIN fail ON fail.batch = n.batch""",
    "report_files": f"WITH {_PHOTOS} SELECT printf('report-%05d.svg', k) AS name, svg FROM photos",
    "gallery_files": f"""WITH {_PHOTOS} SELECT 'gallery-' || (k // 100) || '.html' AS name,
        '<!DOCTYPE html><html><head><meta charset="utf-8"><title>detections</title><style>{report.STYLE}</style></head><body>'
        || string_agg('<section><h2>v' || k || ' &middot; ' || label || '</h2>' || svg || '</section>', '' ORDER BY k) || '</body></html>' AS html FROM photos GROUP BY k // 100""",
    "run_state": f"""WITH {_STATES}, good AS (SELECT * FROM states WHERE photo_id <> '' AND outcome <> 'odd'),
        u AS (SELECT 1 AS step, photo_id, outcome FROM good WHERE idx % 2 = 0 UNION ALL SELECT 2, photo_id, outcome FROM good WHERE idx % 3 = 0)
        SELECT step::INT AS step, photo_id, outcome, count(*) AS n FROM u GROUP BY ALL""",
    "swept_folders": """WITH f AS (SELECT ['run-', 'report-', 'other-', 'run-.', 'Report-'][(s_suppkey % 5 + 1)::INT] || s_suppkey AS name, s_suppkey % 5 AS kind, s_suppkey IN (5, 6) AS own FROM supplier)
        SELECT name, false AS stale, 0.5::DOUBLE AS hours FROM f WHERE NOT own
        UNION ALL SELECT name, kind = 1, 2.0::DOUBLE FROM f WHERE NOT own
        UNION ALL SELECT name, kind = 0, 7.0::DOUBLE FROM f WHERE NOT own AND kind <> 1
        UNION ALL SELECT name, NULL, 99.0::DOUBLE FROM f WHERE own OR kind > 1""",
    "loaded_images": f"""WITH s AS (SELECT page_id AS k, 'FFD8FFE000040000FFC0001108' || lpad(to_hex(page_id % 4000 + 1), 4, '0') || lpad(to_hex(page_id % 300 + 7), 4, '0') || '03011100021101031101FFD9' AS whole FROM pages),
        f AS (SELECT k, CASE WHEN k % 5 > 0 AND k % 4 <> 2 THEN unhex({_HEX}) END AS file, CASE WHEN k % 10 = 0 THEN unhex('FFD8FFC00008080003000401FFD9') END AS own FROM s),
        b AS (SELECT k, coalesce(own, file) AS data, own IS NOT NULL AS inlined FROM f)
        SELECT k AS page_id, octet_length(data)::INT AS bytes, md5('data:image/jpeg;base64,' || base64(data)) AS url_md5,
               CASE WHEN inlined THEN 4 WHEN data IS NOT NULL AND k % 4 <> 1 THEN k % 300 + 7 END::INT AS width, CASE WHEN inlined THEN 3 WHEN data IS NOT NULL AND k % 4 <> 1 THEN k % 4000 + 1 END::INT AS height,
               CASE WHEN NOT inlined AND data IS NOT NULL AND k % 4 = 1 THEN [{", ".join(f"'{e}'" for e in _ERRORS)}][(k % {len(_ERRORS)} + 1)::INT] END AS err FROM b""",
}
