"""Checks of images, boxes and model responses against a closed schema, and the response dialects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, nonempty, salvage
from ..functions.values import finite, unit

RANKS = ("species", "genus", "family", "order", "class")
TOP_KEYS = ("bird_present", "detections")
ALT_KEYS = ("common_name", "scientific_name", "confidence", "identified_rank", "rank_name")
DETECTION_KEYS = (*ALT_KEYS, "bbox", "alternatives")

CONTRADICTION = "bird_present-false-with-detections"
EMPTY = '{"bird_present":false,"detections":[]}'


def image_error(kind: Column, size: Column, path: Column, width: Column, height: Column, there: Column | None = None) -> Column:
    """The first thing that is wrong with an image, or null. ``size`` is the number of its bytes, ``there`` whether there is one at all."""
    missing = F.lit(False) if there is None else ~F.coalesce(there, F.lit(False))
    return (
        F.when(missing, "image-not-table")
        .when((kind == "bytes") & (F.coalesce(size, F.lit(0)) == 0), "bytes-missing-data")
        .when((kind == "file") & (F.coalesce(path, F.lit("")) == ""), "file-missing-path")
        .when(~F.coalesce(kind.isin("bytes", "file"), F.lit(False)), "bad-kind")
        .when(~(finite(width) & (width > 0)), "bad-width")
        .when(~(finite(height) & (height > 0)), "bad-height")
    )


def bbox_error(b: Column) -> Column:
    """The first thing that is wrong with a box [x_min, y_min, x_max, y_max], or null."""
    return (
        F.when(b.isNull() | (F.size(b) != 4) | F.exists(b, lambda x: x.isNull()), "bbox-not-4")
        .when(~F.forall(b, lambda x: F.coalesce(unit(x), F.lit(False))), "bbox-out-of-[0,1]")
        .when(b[0] >= b[2], "bbox-xmin>xmax")
        .when(b[1] >= b[3], "bbox-ymin>ymax")
    )


def _fields(x: Column) -> Column:
    """The members of a JSON object whose values are not null; null if it is no object."""
    return F.map_filter(F.try_variant_get(x, "$", "map<string,variant>"), lambda _, v: ~F.is_variant_null(v))


def _elements(x: Column, fields: Column) -> Column:
    """The elements of a JSON array without nulls at its end; null if it is no array or has other nulls. An object without members is an empty array."""

    def trimmed(items: Column) -> Column:
        last = F.array_max(F.transform(items, lambda e, i: F.when(~F.is_variant_null(e), i + 1).otherwise(0)))
        return let(F.slice(items, F.lit(1), F.coalesce(last, F.lit(0))), lambda k: F.when(~F.exists(k, F.is_variant_null), k))

    return F.coalesce(let(F.try_variant_get(x, "$", "array<variant>"), trimmed), F.when(F.size(fields) == 0, F.array().cast("array<variant>")))


def _is(x: Column, *kinds: str) -> Column:
    """Whether a value is there and of one of the kinds."""
    return F.coalesce(F.substring_index(F.schema_of_variant(x), "(", 1).isin(*kinds), F.lit(False))


def _text(x: Column) -> Column:
    """A text that says something; null for all else."""
    return F.when(_is(x, "STRING"), nonempty(F.try_variant_get(x, "$", "string")))


def _number(x: Column) -> Column:
    return F.when(_is(x, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(x, "$", "double"))


def _in_unit(x: Column) -> Column:
    return F.coalesce(unit(_number(x)), F.lit(False))


def _at(text: str | Column, at: Column) -> Column:
    return F.concat(F.lit(text) if isinstance(text, str) else text, at)


def _stranger(fields: Column, allowed: tuple[str, ...]) -> Column:
    """The first name, in their order, that is not allowed."""
    return F.array_min(F.array_except(F.map_keys(fields), F.array(*map(F.lit, allowed))))


def _first(items: Column, check) -> Column:
    """The first error that ``check`` finds in an element and its number; elements behind it are not looked at."""
    numbered = F.transform(items, lambda e, i: F.struct(e.alias("e"), F.concat(F.lit("@"), (i + 1).cast("string")).alias("at")))
    return F.aggregate(numbered, F.lit(None).cast("string"), lambda found, x: F.coalesce(found, check(x["e"], x["at"])))


def _box_error(x: Column) -> Column:
    def check(items: Column) -> Column:
        return F.when(F.coalesce(F.size(items) != 4, F.lit(True)), "bbox-not-4").when(~F.forall(items, _in_unit), "bbox-out-of-[0,1]").otherwise(
            let(F.transform(items, _number), bbox_error)
        )

    return let(_elements(x, _fields(x)), check)


def _names_error(m: Column, at: Column, prefix: str) -> Column:
    """The first wrong field of those that detections and alternatives share."""
    return (
        F.when(_text(m["common_name"]).isNull(), _at(f"{prefix}common_name", at))
        .when(_text(m["scientific_name"]).isNull(), _at(f"{prefix}scientific_name", at))
        .when(m["confidence"].isNotNull() & ~_in_unit(m["confidence"]), _at(f"{prefix}confidence-out-of-[0,1]", at))
        .when(~(_is(m["identified_rank"], "STRING") & F.try_variant_get(m["identified_rank"], "$", "string").isin(*RANKS)), _at(f"{prefix}bad-rank", at))
        .when(_text(m["rank_name"]).isNull(), _at(f"{prefix}rank_name", at))
    )


def _alternative_error(x: Column, at: Column) -> Column:
    def check(m: Column) -> Column:
        return let(
            _stranger(m, ALT_KEYS),
            lambda s: F.when(m.isNull(), _at("alternative-not-table", at)).when(s.isNotNull(), F.concat(F.lit("unexpected-alt-key:"), s, at)).otherwise(_names_error(m, at, "alt-")),
        )

    return let(_fields(x), check)


def _detection_error(x: Column, at: Column) -> Column:
    def alternatives_error(m: Column) -> Column:
        alts = lambda a: F.when(a.isNull(), _at("alternatives-not-array", at)).otherwise(_first(a, _alternative_error))
        return F.when(m["alternatives"].isNotNull(), let(_elements(m["alternatives"], _fields(m["alternatives"])), alts))

    def check(m: Column) -> Column:
        s = _stranger(m, DETECTION_KEYS)
        inner = F.coalesce(_at(_box_error(m["bbox"]), at), _names_error(m, at, ""), alternatives_error(m))
        return F.when(m.isNull(), _at("detection-not-table", at)).otherwise(let(s, lambda s: F.when(s.isNotNull(), F.concat(F.lit("unexpected-detection-key:"), s, at)).otherwise(inner)))

    return let(_fields(x), check)


def _judged(json: Column, body) -> Column:
    """``body(error, present)`` of a response in JSON, which is parsed once and walked until the first error."""

    def check(m: Column) -> Column:
        present = F.when(_is(m["bird_present"], "BOOLEAN"), F.try_variant_get(m["bird_present"], "$", "boolean"))
        parts = F.struct(_stranger(m, TOP_KEYS).alias("s"), present.alias("present"), _elements(m["detections"], _fields(m["detections"])).alias("dets"))

        def found(p: Column) -> Column:
            return (
                F.when(m.isNull(), "resp-not-table")
                .when(p["s"].isNotNull(), F.concat(F.lit("unexpected-top-key:"), p["s"]))
                .when(p["present"].isNull(), "bird_present-not-bool")
                .when(p["dets"].isNull(), "detections-not-array")
                .when(~p["present"] & (F.size(p["dets"]) > 0), CONTRADICTION)
                .otherwise(_first(p["dets"], _detection_error))
            )

        return let(parts, lambda p: let(F.struct(found(p).alias("e"), p["present"].alias("present")), lambda q: body(q["e"], q["present"])))

    return let(_fields(F.try_parse_json(json)), check)


def response_error(json: Column) -> Column:
    """The first thing that is wrong with a response in JSON, in document order, or null.

    Keys with null values count as absent; of keys that are not allowed the first by name is told; a text with a
    key twice in one object is no table.
    """
    return _judged(json, lambda e, _: e)


def repair(json: Column) -> Column:
    """valid, repaired (detections of an absent bird, of whatever kind, are dropped) or degraded."""

    def judge(e: Column, present: Column) -> Column:
        dropped = (e == CONTRADICTION) | ((e == "detections-not-array") & ~F.coalesce(present, F.lit(True)))
        return F.when(json.isNotNull() & e.isNull(), "valid").when(dropped, "repaired").otherwise("degraded")

    return _judged(json, judge)


def _items(json: Column, path: str) -> Column:
    """The elements of a JSON array as texts, without nulls at its end; null if it is no array or has other nulls. An empty object is an empty array."""

    def trimmed(items: Column) -> Column:
        kept = F.slice(items, F.lit(1), F.coalesce(F.array_max(F.transform(items, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0))), F.lit(0)))
        return let(kept, lambda k: F.when(~F.exists(k, lambda x: x.isNull()), k))

    def read(raw: Column) -> Column:
        parsed = F.when(F.substring(raw, 1, 1) == "[", F.from_json(raw, "array<string>"))
        return F.when(raw.rlike(r"^\{\s*\}$"), F.array().cast("array<string>")).otherwise(let(parsed, trimmed))

    return let(F.get_json_object(json, path), read)


def _setter(members: Column, name: str):
    """Gives the members with a JSON value under a name, or as they are for null."""
    return lambda v: F.when(v.isNull(), members).otherwise(F.map_concat(members, F.create_map(F.lit(name), F.parse_json(v))))


def _object(raw: Column, without: tuple[str, ...] = (), **put: Column) -> Column:
    """A JSON object without null values and some keys, with others set to JSON values (null: left out)."""
    gone = [*without, *put]
    kept = F.map_filter(F.from_json(raw, "map<string,variant>"), lambda k, v: ~F.is_variant_null(v) & (~k.isin(*gone) if gone else F.lit(True)))
    for name, value in put.items():
        kept = let(value, _setter(kept, name))
    return F.to_json(kept)


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def finalize(json: Column, state: Column | None = None) -> Column:
    """A valid response without null values; a repaired or degraded one is the empty response. ``state`` is what ``repair`` gave, where that is known."""
    detection = lambda d: _object(d, alternatives=_array(F.transform(_items(d, "$.alternatives"), lambda a: _object(a))))
    whole = _object(json, detections=_array(F.transform(_items(json, "$.detections"), detection)))
    return F.when((repair(json) if state is None else state) == "valid", whole).otherwise(F.lit(EMPTY))


def box_reorder(b: Column) -> Column:
    """[ymin, xmin, ymax, xmax] in whole thousandths to [x_min, y_min, x_max, y_max]; null for any other."""

    def moved(b: Column) -> Column:
        good = (F.size(b) == 4) & F.forall(b, lambda x: F.coalesce(finite(x) & x.between(0, 1000) & (x == F.floor(x)), F.lit(False)))
        return F.when(good, F.array(b[1] / 1000, b[0] / 1000, b[3] / 1000, b[2] / 1000))

    return let(b, moved)


def dialect_a(body: Column) -> Column:
    """JSON of the answer in a body with choices; null where it was refused, cut off or is not there."""
    reason = F.get_json_object(body, "$.choices[0].finish_reason")
    refused = F.get_json_object(body, "$.choices[0].message.refusal").isNotNull() | F.coalesce(reason.isin("length", "content_filter"), F.lit(False))
    content = F.get_json_object(body, "$.choices[0].message.content")
    return F.when(~refused, F.when(F.json_object_keys(content).isNotNull(), content).otherwise(salvage(content)))


def dialect_b(body: Column, tool: str) -> Column:
    """Input of the first tool block of a name; null where the answer was refused or cut off, or the input is a text."""
    stop = F.coalesce(F.get_json_object(body, "$.stop_reason").isin("max_tokens", "refusal"), F.lit(False))
    blocks = F.filter(
        _items(body, "$.content"),
        lambda b: (F.get_json_object(b, "$.type") == "tool_use") & (F.get_json_object(b, "$.name") == tool) & (F.substring(F.get_json_object(b, "$.input"), 1, 1) == "{"),
    )
    return F.when(~stop, F.get_json_object(F.get(blocks, F.lit(0)), "$.input"))


def boxes_in_place(json: Column) -> Column:
    """Detections with ``box_2d`` get a ``bbox`` in its stead; those without a good one are dropped. Detections that are no list are left to the check."""
    box = lambda d: box_reorder(F.from_json(F.get_json_object(d, "$.box_2d"), "array<double>"))

    def placed(raw: Column) -> Column:
        moved = F.transform(F.from_json(raw, "array<string>"), lambda d: let(box(d), lambda b: F.when(b.isNotNull(), _object(d, ("box_2d",), bbox=F.to_json(b)))))
        nothing = (F.substring(raw, 1, 1) == "{") | (raw.isNull() & F.array_contains(F.json_object_keys(json), "detections"))
        return F.when(nothing, "[]").when(F.substring(raw, 1, 1) == "[", _array(F.filter(moved, lambda d: d.isNotNull())))

    return let(let(F.get_json_object(json, "$.detections"), placed), lambda n: F.when(n.isNull(), json).otherwise(_object(json, detections=n)))


def dialect_c(body: Column) -> Column:
    """The joined texts of the first candidate, with boxes in our form; null where it was blocked or did not end by itself."""
    blocked = F.get_json_object(body, "$.promptFeedback.blockReason").isNotNull()
    reason = F.coalesce(F.get_json_object(body, "$.candidates[0].finishReason"), F.lit("STOP"))
    bad = reason.isin("MAX_TOKENS", "SAFETY", "RECITATION", "PROHIBITED_CONTENT")
    texts = F.transform(_items(body, "$.candidates[0].content.parts"), lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.lit("")))
    answer = F.when(~blocked & ~bad, let(F.array_join(texts, ""), lambda joined: F.when(F.json_object_keys(joined).isNotNull(), joined).otherwise(salvage(joined))))
    return let(answer, boxes_in_place)
