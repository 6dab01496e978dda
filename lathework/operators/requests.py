"""Bodies of requests to models in three dialects, as JSON texts, and the dialects by name."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .contract import ALT_KEYS, RANKS, TOP_KEYS, dialect_a, dialect_b, dialect_c

# What the dialects call the answer, and their limits.
TOOL = "report_bird_identification"
TOOL_SAYS = "Report whether the image contains a bird and identify each bird."
SCHEMA_NAME = "bird_identification"
MAX_TOKENS = 2048
JPEG = "image/jpeg"


def answer_schema(box: str, coordinate: str, confidence: dict, closed: bool) -> dict:
    """JSON Schema of an answer. ``closed`` schemas forbid further keys."""
    text, lock = {"type": "string"}, {"additionalProperties": False} if closed else {}
    names = dict.fromkeys(ALT_KEYS, text) | {"confidence": confidence, "identified_rank": text | {"enum": list(RANKS)}}

    def record(properties: dict, required: tuple[str, ...]) -> dict:
        return {"type": "object", "required": list(required), "properties": properties} | lock

    def rows(of: dict) -> dict:
        return {"type": "array", "items": of}

    detection = {box: rows({"type": coordinate})} | names | {"alternatives": rows(record(names, ALT_KEYS))}
    return record({"bird_present": {"type": "boolean"}, "detections": rows(record(detection, (box, *ALT_KEYS, "alternatives")))}, TOP_KEYS)


SCHEMA_A = answer_schema("bbox", "number", {"type": ["number", "null"]}, True)
SCHEMA_B = answer_schema("bbox", "number", {"anyOf": [{"type": "number"}, {"type": "null"}]}, True)
SCHEMA_C = answer_schema("box_2d", "integer", {"type": "number"}, False)


def _schema(schema: dict) -> Column:
    return F.parse_json(F.lit(json.dumps(schema)))


def _some(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def _user(prompt: Column, image: Column) -> Column:
    """Two content parts of one user message; the parts differ in their fields, so each is a variant."""
    parts = F.array(F.to_variant_object(_some(type=F.lit("text"), text=prompt)), image)
    return F.array(_some(role=F.lit("user"), content=parts))


def request_a(prompt: Column, url: Column, detail: Column, model: Column) -> Column:
    """A chat body with an image address; an empty detail is left out."""
    address = F.parse_json(F.to_json(_some(url=url, detail=F.when(detail != "", detail))))
    image = F.parse_json(F.to_json(_some(type=F.lit("image_url"), image_url=address)))
    form = _some(name=F.lit(SCHEMA_NAME), strict=F.lit(True), schema=_schema(SCHEMA_A))
    return F.to_json(_some(model=model, messages=_user(prompt, image), response_format=_some(type=F.lit("json_schema"), json_schema=form)))


def request_b(prompt: Column, content: Column, file_id: Column, model: Column) -> Column:
    """A message body that forces the tool; a file id wins over base64 content."""
    inline = F.to_json(_some(type=F.lit("base64"), media_type=F.lit(JPEG), data=content))
    filed = F.to_json(_some(type=F.lit("file"), file_id=file_id))
    image = F.to_variant_object(_some(type=F.lit("image"), source=F.parse_json(F.when(file_id != "", filed).otherwise(inline))))
    tool = _some(name=F.lit(TOOL), description=F.lit(TOOL_SAYS), strict=F.lit(True), input_schema=_schema(SCHEMA_B))
    choice = _some(type=F.lit("tool"), name=F.lit(TOOL))
    return F.to_json(_some(model=model, max_tokens=F.lit(MAX_TOKENS), tool_choice=choice, tools=F.array(tool), messages=_user(prompt, image)))


def request_c(prompt: Column, content: Column, file_uri: Column) -> Column:
    """A content body with a response schema; a file address wins over base64 content. The model is part of the address."""
    inline = F.to_json(_some(inline_data=_some(mime_type=F.lit(JPEG), data=content)))
    filed = F.to_json(_some(file_data=_some(mime_type=F.lit(JPEG), file_uri=file_uri)))
    parts = F.array(F.to_variant_object(_some(text=prompt)), F.parse_json(F.when(file_uri != "", filed).otherwise(inline)))
    config = _some(responseMimeType=F.lit("application/json"), responseSchema=_schema(SCHEMA_C))
    return F.to_json(_some(contents=F.array(_some(parts=parts)), generationConfig=config))


#: How the answer is read from a body, by dialect.
DIALECTS: dict[str, Callable[[Column], Column]] = {"a": dialect_a, "b": lambda body: dialect_b(body, TOOL), "c": dialect_c}


def answer(dialect: Column, body: Column) -> Column:
    """(answer, error): the answer of a body by the dialect its row names; a missing or unknown name is an error."""
    got = F.lit(None).cast("string")
    for name, read in DIALECTS.items():
        got = F.when(dialect == name, read(body)).otherwise(got)
    unknown = F.when(~dialect.isin(*DIALECTS), F.concat(F.lit("provider-not-implemented:"), dialect))
    return _some(answer=got, error=F.when(dialect.isNull(), "no-provider-name").otherwise(unknown))
