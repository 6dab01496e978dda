"""Queries: responses with several faults at once, told by walks through their JSON, and what dialects map them to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contract, fixtures
from ..operators.requests import TOOL
from . import views as v

_ALT = '{"common_name":"Finch","scientific_name":"Avis","confidence":0.4,"identified_rank":"family","rank_name":"Aves"%s}'
_OTHER = (
    _ALT.replace('"family"', '"realm"') % "", _ALT % ',"size":3', _ALT.replace("0.4", "-0.1") % "", _ALT.replace('"Aves"', '"nil"') % "", _ALT.replace('"confidence":0.4', '"confidence":null') % ',"note":null',
)
#: The pieces of a response, each chosen by its own share of the key, so that faults meet in all ways; the first of each are good.
_PIECES = {
    "conf": ("0.75", "1", "0", "null", "0.5", "1.5", "0.25", '"0.5"', "0.3", "-0.1", "0.9"),
    "rank": ('"genus"', '"species"', '"order"', '"class"', '"kingdom"', '"family"', "7", '"genus"', '"genus"', "null", '"genus"', '"genus"', '"genus"'),
    "name": ('"Robin"', '"Wren"', '"Jay"', '" "', '"Tit"', '"nil"', '"Rook"', "42", '"Kite"', '"Gull"', "null", '"Crow"', '"Coot"', '" x "', '"Duck"', '"Tern"', '"Smew"'),
    "extra": ("", "", "", ',"colour":"red"', "", ',"age":null', "", ',"zeal":1,"abba":2', ""),
    "alts": (
        "", f',"alternatives":[{_ALT % ""}]', ',"alternatives":null', ',"alternatives":[]', ',"alternatives":{}', f',"alternatives":[{_ALT % ""},null]', f',"alternatives":[{_OTHER[4]}]',
        f',"alternatives":[null,{_ALT % ""}]', f',"alternatives":{_ALT % ""}', ',"alternatives":["x"]', f',"alternatives":[{_ALT % ""},{_OTHER[0]},{_OTHER[1]}]', f',"alternatives":[{_OTHER[1]}]',
        f',"alternatives":[{_ALT % ""},{_OTHER[2]}]', f',"alternatives":[{_OTHER[3]}]', ',"alternatives":"none"', "", "", "", "",
    ),
    "box": ("[0.1,0.2,0.3,0.4]", "[0,0,1,1]", "[0.5,0.1,0.2,0.9]", "[0.1,0.2]", "[0.25,0.5,0.75,0.625]", "[0.1,0.9,0.3,0.4]", "[0.1,0.2,1.5,0.4]", "[0.1,0.2,null,0.4]", '["0.1",0.2,0.3,0.4]', "null", "{}", "[0.1,0.2,0.3,0.4,null]", "[0.2,0.2,0.4,0.4]"),
    "more": ("", "", ",null", "", ',"bird"', "", ",{}", "", ',null,{"bbox":[0,0,1,1]}', ""),
    "present": ("true", "true", "true", "true", "true", "false", "true", '"yes"', "true", "true", "null"),
    "top": ("", "", "", "", ',"note":1', "", ',"note":null', "", "", "", "", ',"b":1,"a":2'),
    "kind": ("good", "good", "good", "good", "good", "good", "good", "empty", "object", "text", "members", "fence"),
}
_SHARES = dict(zip(_PIECES, (1, 3, 2, 7, 5, 4, 9, 11, 13, 6)))


def _picked(k: Column, name: str) -> Column:
    items = _PIECES[name]
    return F.element_at(F.array(*map(F.lit, items)), (F.floor(k / _SHARES[name]) % len(items) + 1).cast("int"))


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = v.table(spark, d, "part").select("p_partkey", "p_brand", *(_picked(k, n).alias(n) for n in _PIECES))
    detection = F.concat(
        F.lit('{"bbox":'), "box", F.lit(',"common_name":'), "name", F.lit(',"scientific_name":"'), "p_brand", F.lit('","confidence":'), "conf",
        F.lit(',"identified_rank":'), "rank", F.lit(',"rank_name":"Aves"'), "extra", "alts", F.lit("}"),
    )
    two = F.when(k % 3 == 0, F.concat(detection, F.lit(","), F.replace(detection, F.lit('"Aves"'), F.lit('"B"')))).otherwise(detection)
    dets = F.when(F.col("kind") == "empty", "[]").when(F.col("kind") == "object", "{}").when(F.col("kind") == "members", detection).otherwise(F.concat(F.lit("["), two, "more", F.lit("]")))
    whole = F.concat(F.lit('{"bird_present":'), "present", F.lit(',"detections":'), dets, "top", F.lit("}"))
    return p.select("p_partkey", F.when(F.col("kind") == "text", F.lit("no bird here")).otherwise(whole).alias("json"), (F.col("kind") == "fence").alias("fenced"))


def response_faults(spark: SparkSession, d: str) -> DataFrame:
    return _faulty(spark, d).select("p_partkey", contract.response_error(F.col("json")).alias("err"), contract.repair(F.col("json")).alias("state"))


def _quoted(json: Column) -> Column:
    return F.replace(F.replace(json, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _mapped(rows: DataFrame) -> DataFrame:
    """The detections of the responses that rows (p_partkey, answer) are mapped to; a response without any is one row of nulls."""
    kind = "struct<bird_present:boolean,detections:array<struct<bbox:array<double>,common_name:string,confidence:double,identified_rank:string,alternatives:array<struct<rank_name:string>>>>>"
    got = rows.select("p_partkey", contract.finalize(F.col("answer")).alias("final")).select("p_partkey", F.from_json("final", kind).alias("r"))
    each = got.select("p_partkey", "r.bird_present", F.posexplode_outer("r.detections").alias("i", "x"))
    return each.select("p_partkey", "bird_present", (F.col("i") + 1).alias("det"), F.col("x.bbox")[0].alias("x_min"), "x.common_name", "x.confidence", F.col("x.identified_rank").alias("rank"), F.size("x.alternatives").alias("n_alternatives"))


def mapped_dialect_a(spark: SparkSession, d: str) -> DataFrame:
    """Answers as texts inside choices, some in a fence or with words around them, some refused or cut off."""
    k = F.col("p_partkey") % 9
    content = F.when(F.col("fenced"), F.concat(F.lit("```json "), "json", F.lit(" ```"))).when(k == 1, F.concat(F.lit("Here: "), "json", F.lit(" Good luck."))).otherwise(F.col("json"))
    reason = F.when(k == 2, '"length"').when(k == 3, '"content_filter"').when(k == 4, "null").otherwise('"stop"')
    refusal = F.when(k == 5, ',"refusal":"no"').when(k == 6, ',"refusal":null').otherwise("")
    body = F.concat(F.lit('{"choices":[{"finish_reason":'), reason, F.lit(',"message":{"content":"'), _quoted(content), F.lit('"'), refusal, F.lit("}}]}"))
    return _mapped(_faulty(spark, d).select("p_partkey", contract.dialect_a(body).alias("answer")))


def mapped_dialect_b(spark: SparkSession, d: str) -> DataFrame:
    """Answers as inputs of tool blocks, some behind another tool's, some of no tool, some cut off or refused."""
    k = F.col("p_partkey") % 8
    value = F.when(F.col("json").startswith("{"), F.col("json")).otherwise(F.concat(F.lit('"'), "json", F.lit('"')))
    block = lambda name, value: F.concat(F.lit('{"type":"tool_use","name":"'), name, F.lit('","input":'), value, F.lit("}"))
    blocks = F.when(k == 1, block(F.lit("other"), value)).when(k == 2, F.concat(block(F.lit("other"), F.lit("{}")), F.lit(","), block(F.lit(TOOL), value))).otherwise(block(F.lit(TOOL), value))
    stop = F.when(k == 3, "max_tokens").when(k == 4, "refusal").otherwise("tool_use")
    body = F.concat(F.lit('{"stop_reason":"'), stop, F.lit('","content":[{"type":"text","text":"x"},'), blocks, F.lit("]}"))
    return _mapped(_faulty(spark, d).select("p_partkey", contract.dialect_b(body, TOOL).alias("answer")))


def fixture_answers(spark: SparkSession, d: str) -> DataFrame:
    """A brand's first part gives its fixture, unless it is one of every fifth brand; parts ask for their own brand's, for the default one, and for none that is there."""
    p = v.table(spark, d, "part").select("p_partkey", "p_brand")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    made = _faulty(spark, d).join(first, "p_partkey").filter(~F.col("p_brand").endswith("5")).select(F.col("p_brand").alias("name"), F.col("json").alias("response"))
    given = made.unionByName(spark.createDataFrame([(fixtures.DEFAULT, contract.EMPTY)], "name string, response string"))
    k = F.col("p_partkey")
    items = p.select("p_partkey", F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("Brand#00")).otherwise(F.col("p_brand")).alias("name"))
    got = fixtures.identify(items, given)
    present = F.from_json("response", "struct<bird_present:boolean>")["bird_present"]
    return got.select("p_partkey", "name", present.alias("bird_present"), "error")


_IMAGES = {
    "kind": ("'bytes'", "'file'", "'bytes'", "'file'", "'url'", "NULL", "'bytes'"), "size": ("7", "1", "0", "NULL", "12", "9"), "path": ("'/a'", "''", "NULL", "'/b'", "' '"),
    "width": ("'640'", "'0'", "'-3'", "'NaN'", "'Infinity'", "NULL", "'0.5'", "'1024'", "'1'", "'2'", "'3'"),
    "height": ("'480'", "'-Infinity'", "'1'", "'2'", "'NaN'", "'0'", "'3'", "'4'", "'5'", "'6'", "'7'", "'8'", "NULL"), "there": ("true",) * 12 + ("false", "NULL"),
}


def image_faults(spark: SparkSession, d: str) -> DataFrame:
    """Images with every kind of fault, several at once; pieces are chosen as for responses."""
    kinds = {"kind": "string", "size": "int", "path": "string", "width": "double", "height": "double", "there": "boolean"}
    piece = lambda n, i: F.expr(f"element_at(array({', '.join(_IMAGES[n])}), int(page_id div {i + 1} % {len(_IMAGES[n])}) + 1)").cast(kinds[n])
    parts = {n: piece(n, i) for i, n in enumerate(_IMAGES)}
    return v.table(spark, d, "pages").select("page_id", contract.image_error(*parts.values()).alias("err"))


QUERIES = {f.__name__: f for f in (image_faults, fixture_answers, response_faults, mapped_dialect_a, mapped_dialect_b)}


def _one_of(name: str) -> str:
    items = ", ".join("'" + x.replace("'", "''") + "'" for x in _PIECES[name])
    return f"[{items}][(p_partkey // {_SHARES[name]} % {len(_PIECES[name])} + 1)::INT] AS {name}_"


_BUILT = f"""c AS (SELECT p_partkey, p_brand, {", ".join(map(_one_of, _PIECES))} FROM part), o AS (
    SELECT *, '{{"bbox":' || box_ || ',"common_name":' || name_ || ',"scientific_name":"' || p_brand || '","confidence":' || conf_ || ',"identified_rank":' || rank_ || ',"rank_name":"Aves"' || extra_ || alts_ || '}}' AS one FROM c
), b AS (
    SELECT p_partkey, kind_ = 'fence' AS fenced, CASE WHEN kind_ = 'text' THEN 'no bird here' ELSE '{{"bird_present":' || present_ || ',"detections":'
        || CASE kind_ WHEN 'empty' THEN '[]' WHEN 'object' THEN '{{}}' WHEN 'members' THEN one
                ELSE '[' || one || CASE WHEN p_partkey % 3 = 0 THEN ',' || replace(one, '"Aves"', '"B"') ELSE '' END || more_ || ']' END || top_ || '}}' END AS t FROM o
)"""


def _strangers(x: str, allowed: tuple[str, ...]) -> str:
    known = ", ".join(f"'{a}'" for a in allowed)
    return f"""list_min(list_filter(json_keys({x}), lambda k: k NOT IN ({known}) AND json_type({x}, '$."' || k || '"') <> 'NULL'))"""


def _says(x: str, key: str) -> str:
    return f"coalesce(json_type({x}, '$.{key}') = 'VARCHAR' AND trim({x} ->> '$.{key}') NOT IN ('', 'nil'), false)"


_NUMBER = "IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"


def _wrong_names(x: str, at: str, prefix: str) -> str:
    ranks = ", ".join(f"'{r}'" for r in contract.RANKS)
    return f"""WHEN NOT {_says(x, "common_name")} THEN '{prefix}common_name' || {at} WHEN NOT {_says(x, "scientific_name")} THEN '{prefix}scientific_name' || {at}
        WHEN coalesce(json_type({x}, '$.confidence'), 'NULL') <> 'NULL' AND NOT (json_type({x}, '$.confidence') {_NUMBER} AND try_cast({x} ->> '$.confidence' AS DOUBLE) BETWEEN 0 AND 1)
            THEN '{prefix}confidence-out-of-[0,1]' || {at}
        WHEN NOT coalesce(json_type({x}, '$.identified_rank') = 'VARCHAR' AND {x} ->> '$.identified_rank' IN ({ranks}), false) THEN '{prefix}bad-rank' || {at}
        WHEN NOT {_says(x, "rank_name")} THEN '{prefix}rank_name' || {at}"""


def _list(x: str, path: str) -> str:
    """Elements without nulls at the end; null if there is no array or it has other nulls; an object without members is an empty one."""
    items, kind = f"json_extract({x}, '{path}[*]')", f"json_type({x}, '{path}')"
    last = f"coalesce(list_max(list_transform(range(1, len({items}) + 1), lambda i: CASE WHEN json_type({items}[i]) <> 'NULL' THEN i END)), 0)"
    bare = f"len(list_filter(json_keys({x}, '{path}'), lambda k: json_type({x}, '{path}.\"' || k || '\"') <> 'NULL')) = 0"
    return f"""CASE WHEN {kind} = 'ARRAY' THEN CASE WHEN len(list_filter({items}[1:{last}], lambda e: json_type(e) = 'NULL')) = 0 THEN {items}[1:{last}] END
        WHEN {kind} = 'OBJECT' AND {bare} THEN []::JSON[] END"""


_WALK = f"""j AS (SELECT {{key}}, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM {{source}}), l AS (
    SELECT {{key}}, j, {_list("j", "$.detections")} AS dets FROM j
), d AS (
    SELECT {{key}}, unnest(dets) AS x, generate_subscripts(dets, 1) AS i FROM l
), s AS (
    SELECT *, {_list("x", "$.bbox")} AS box, {_list("x", "$.alternatives")} AS alts FROM d
), a AS (
    SELECT {{key}}, i, unnest(alts) AS y, generate_subscripts(alts, 1) AS k FROM s
), ae AS (
    SELECT {{key}}, i, arg_min(e, k) AS alt_error FROM (
        SELECT {{key}}, i, k, CASE WHEN json_type(y) <> 'OBJECT' THEN 'alternative-not-table@' || k
            WHEN {_strangers("y", contract.ALT_KEYS)} IS NOT NULL THEN 'unexpected-alt-key:' || {_strangers("y", contract.ALT_KEYS)} || '@' || k
            {_wrong_names("y", "'@' || k", "alt-")} END AS e FROM a) WHERE e IS NOT NULL GROUP BY ALL
), n AS (
    SELECT *, list_transform(box, lambda e: CASE WHEN json_type(e) {_NUMBER} THEN try_cast(e ->> '$' AS DOUBLE) END) AS v FROM s
), de AS (
    SELECT {{key}}, arg_min(e, i) AS det_error FROM (
        SELECT n.{{key}}, n.i, CASE WHEN json_type(x) <> 'OBJECT' THEN 'detection-not-table@' || n.i
            WHEN {_strangers("x", contract.DETECTION_KEYS)} IS NOT NULL THEN 'unexpected-detection-key:' || {_strangers("x", contract.DETECTION_KEYS)} || '@' || n.i
            WHEN coalesce(len(box) <> 4, true) THEN 'bbox-not-4@' || n.i
            WHEN len(list_filter(v, lambda q: coalesce(q BETWEEN 0 AND 1, false))) < 4 THEN 'bbox-out-of-[0,1]@' || n.i
            WHEN v[1] >= v[3] THEN 'bbox-xmin>xmax@' || n.i WHEN v[2] >= v[4] THEN 'bbox-ymin>ymax@' || n.i
            {_wrong_names("x", "'@' || n.i", "")}
            WHEN coalesce(json_type(x, '$.alternatives'), 'NULL') <> 'NULL' AND alts IS NULL THEN 'alternatives-not-array@' || n.i
            ELSE alt_error END AS e
        FROM n LEFT JOIN ae ON ae.{{key}} = n.{{key}} AND ae.i = n.i) WHERE e IS NOT NULL GROUP BY ALL
), w AS (
    SELECT l.{{key}}, j, coalesce(json_type(j, '$.bird_present') = 'BOOLEAN' AND j ->> '$.bird_present' = 'false', false) AS absent, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'resp-not-table'
        WHEN {_strangers("j", contract.TOP_KEYS)} IS NOT NULL THEN 'unexpected-top-key:' || {_strangers("j", contract.TOP_KEYS)}
        WHEN coalesce(json_type(j, '$.bird_present'), 'NULL') <> 'BOOLEAN' THEN 'bird_present-not-bool' WHEN dets IS NULL THEN 'detections-not-array'
        WHEN j ->> '$.bird_present' = 'false' AND len(dets) > 0 THEN 'bird_present-false-with-detections' ELSE det_error END AS err
    FROM l LEFT JOIN de ON de.{{key}} = l.{{key}}
)"""
_FINAL = """f AS (SELECT w.p_partkey, w.err IS NULL AS good, j ->> '$.bird_present' = 'true' AS present FROM w), g AS (
    SELECT f.p_partkey, good AND present AS bird_present, s.i, s.x, s.alts, s.box FROM f LEFT JOIN s ON s.p_partkey = f.p_partkey AND good
) SELECT p_partkey, bird_present, i::INT AS det, (box[1] ->> '$')::DOUBLE AS x_min, x ->> '$.common_name' AS common_name, (x ->> '$.confidence')::DOUBLE AS confidence,
    x ->> '$.identified_rank' AS rank, len(alts)::INT AS n_alternatives FROM g"""
_CHOSEN = ", ".join(f"[{', '.join(items)}][(page_id // {i + 1} % {len(items)} + 1)::INT]{'::DOUBLE' if n in ('width', 'height') else ''} AS {n}" for i, (n, items) in enumerate(_IMAGES.items()))
SQL = {
    "image_faults": f"""WITH i AS (SELECT page_id, {_CHOSEN} FROM pages) SELECT page_id, CASE WHEN NOT coalesce(there, false) THEN 'image-not-table'
        WHEN kind = 'bytes' AND coalesce(size, 0) = 0 THEN 'bytes-missing-data' WHEN kind = 'file' AND coalesce(path, '') = '' THEN 'file-missing-path'
        WHEN coalesce(kind, '') NOT IN ('bytes', 'file') THEN 'bad-kind' WHEN NOT coalesce(isfinite(width) AND width > 0, false) THEN 'bad-width'
        WHEN NOT coalesce(isfinite(height) AND height > 0, false) THEN 'bad-height' END AS err FROM i""",
    "fixture_answers": f"""WITH {_BUILT}, {_WALK.format(key="p_partkey", source="b")}, m AS (SELECT p_brand, min(p_partkey) AS p_partkey FROM part WHERE p_brand NOT LIKE '%5' GROUP BY p_brand),
        x AS (SELECT p_brand AS name, w.err, w.j ->> '$.bird_present' = 'true' AS present FROM m JOIN w ON w.p_partkey = m.p_partkey),
        i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Brand#00' ELSE p_brand END AS name FROM part)
        SELECT i.p_partkey, i.name, CASE WHEN x.name IS NULL THEN false WHEN err IS NULL THEN present END AS bird_present,
               CASE WHEN err IS NOT NULL THEN 'fixture-failed-validation:' || x.name || ':' || err END AS error FROM i LEFT JOIN x ON x.name = i.name""",
    "response_faults": f"""WITH {_BUILT}, {_WALK.format(key="p_partkey", source="b")}
        SELECT p_partkey, err, CASE WHEN err IS NULL THEN 'valid' WHEN err = 'bird_present-false-with-detections' OR err = 'detections-not-array' AND absent THEN 'repaired' ELSE 'degraded' END AS state FROM w""",
    "mapped_dialect_a": f"""WITH {_BUILT}, m AS (SELECT p_partkey, CASE WHEN p_partkey % 9 NOT IN (2, 3, 5) AND t LIKE '{{%' THEN t END AS t FROM b), {_WALK.format(key="p_partkey", source="m")}, {_FINAL}""",
    "mapped_dialect_b": f"""WITH {_BUILT}, m AS (SELECT p_partkey, CASE WHEN p_partkey % 8 NOT IN (1, 3, 4) AND t LIKE '{{%' THEN t END AS t FROM b), {_WALK.format(key="p_partkey", source="m")}, {_FINAL}""",
}
