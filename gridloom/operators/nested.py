"""Nested JSON records to flat, linked tables.

Each record's text is parsed as a stream, one top-level item at a time, into
triples (path, ordinals, kind, value). Triples are grouped by their repeated
ancestor and each group is pivoted into one table, keyed by the record, and the
positions of all repeated ancestors (positions count from 0, null items count).

Path syntax: object fields joined by '.', list items marked by '[]'; the item
`3` of field `points` of the wall `1` has path `[].points[]` and ordinals [1, 3].
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "column_name string, path string, ordinals array<int>, kind string, value string"
#: Triples in one Arrow batch on the way out, so that a large record is handed on in parts.
OUT_ROWS = 32_768
WHOLE_CHARS = 1_000_000


class Num(str):
    """The text of a JSON number, kept as written."""

    __slots__ = ()


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


_SCAN = json.JSONDecoder(parse_float=Num, parse_int=Num, parse_constant=_no_constant).scan_once
_BLANK = re.compile(r"[ \t\n\r]*").match
_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))').match


def _deep_value(text: str, at: int):
    """One JSON value from `at` on, without recursion, for texts nested deeper
    than the C scanner goes. Returns (value, end)."""
    stack: list[tuple[object, str | None]] = []
    box: object = None
    key: str | None = None
    want = "value"  # value, first (value or ]), key, first_key (key or }), after
    while True:
        m = _TOKEN(text, at)
        if not m:
            raise ValueError(f"no token at {at}")
        at = m.end()
        sign, string, number, word = m.groups()
        done = False
        value: object = None
        if want in ("key", "first_key"):
            if string is not None:
                key = json.loads(string)
                m = _TOKEN(text, at)
                if not m or m.group(1) != ":":
                    raise ValueError("':' expected")
                at, want = m.end(), "value"
                continue
            if sign == "}" and want == "first_key":
                value, done = box, True
                box, key = stack.pop()
            else:
                raise ValueError("key expected")
        elif want == "after":
            if sign == ",":
                want = "key" if isinstance(box, dict) else "value"
                continue
            if sign == ("}" if isinstance(box, dict) else "]"):
                value, done = box, True
                box, key = stack.pop()
            else:
                raise ValueError("',' or an end expected")
        elif sign == "[" or sign == "{":
            stack.append((box, key))
            box, key, want = ([], None, "first") if sign == "[" else ({}, None, "first_key")
            continue
        elif sign == "]" and want == "first":
            value, done = box, True
            box, key = stack.pop()
        elif string is not None:
            value, done = json.loads(string), True
        elif number is not None:
            value, done = Num(number), True
        elif word is not None:
            value, done = {"true": True, "false": False, "null": None}[word], True
        if not done:
            raise ValueError(f"unexpected {sign!r}")
        if box is None and not stack:
            return value, at
        if isinstance(box, dict):
            box[key] = value
        else:
            box.append(value)
        want = "after"


def _value(text: str, at: int):
    try:
        return _SCAN(text, at)
    except StopIteration:
        raise ValueError("value expected") from None
    except RecursionError:
        return _deep_value(text, at)


def stream_items(text: str) -> Iterator[object]:
    """The items of the top-level list one by one, or a single other value as a
    list of one. Raises ValueError where the text isn't one complete JSON value."""
    at = _BLANK(text, 0).end()
    if text[at : at + 1] != "[":
        value, at = _value(text, at)
        yield value
    else:
        at = _BLANK(text, at + 1).end()
        if text[at : at + 1] == "]":
            at += 1
        else:
            while True:
                value, at = _value(text, at)
                yield value
                at = _BLANK(text, at).end()
                mark = text[at : at + 1]
                at = _BLANK(text, at + 1).end()
                if mark == "]":
                    break
                if mark != ",":
                    raise ValueError("',' or ']' expected")
    if _BLANK(text, at).end() != len(text):
        raise ValueError("text after the value")


def _plain(text: str) -> str:
    """Lone surrogates, which JSON escapes may name, can't be stored: U+FFFD."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _leaf(value: object) -> tuple[str, str | None]:
    if value is None:
        return "null", None
    if isinstance(value, Num):
        return "number", str(value)
    if isinstance(value, str):
        return "string", _plain(value)
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    return ("object", None) if isinstance(value, dict) else ("array", None)


def first_place(owner: dict, places: Iterable[Sequence[str]]) -> object:
    """The value of the first place that is present and not null."""
    for place in places:
        value: object = owner
        for step in place:
            value = value.get(step) if isinstance(value, dict) else None
        if value is not None:
            return value
    return None


@lru_cache(64)
def _ways(keep: frozenset[str]) -> frozenset[str]:
    """All paths on the way to the kept ones, these included."""
    out = set()
    for p in keep:
        for i in range(1, len(p) + 1):
            if i == len(p) or p[i] == "." or p[i : i + 2] == "[]":
                out.add(p[:i])
    return frozenset(out)


def item_triples(item: object, ordinal: int, aliases: Mapping[str, Sequence[Sequence[str]]], keep: frozenset[str] | None) -> Iterator[tuple]:
    """Depth first, without recursion, however deep. `aliases` names values that have several
    places; they come under their own name and before the raw fields. Without
    `keep` every path comes out, with it only the named ones, and only their ancestors are walked."""
    todo: list[tuple[str, tuple[int, ...], object]] = [("[]", (ordinal,), item)]
    ways = None if keep is None else _ways(keep)
    while todo:
        path, ords, value = todo.pop()
        if keep is None or path in keep:
            yield (path, ords, *_leaf(value))
        if isinstance(value, dict):
            own = []
            if path == "[]":
                own = [(name, first_place(value, places)) for name, places in aliases.items()]
                own = [(k, v) for k, v in own if v is not None]
            fields = [*own, *((k, v) for k, v in value.items() if k not in aliases or path != "[]")]
            for k, v in reversed(fields):
                below = f"{path}.{_plain(k)}"
                if ways is None or below in ways:
                    todo.append((below, ords, v))
        elif isinstance(value, list):
            below = f"{path}[]"
            if ways is None or below in ways:
                for i in range(len(value) - 1, -1, -1):
                    todo.append((below, (*ords, i), value[i]))


def to_triples(
    df: DataFrame,
    id_col: str,
    columns: Mapping[str, Mapping[str, Sequence[Sequence[str]]]],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """(id, column_name, path, ordinals, kind, value) of the JSON texts in the
    named columns, which map to their aliases.

    A null text and one that isn't complete valid JSON give no triples; the
    record's other columns still do. All levels come out, however deep. Extra columns of `df` aren't read. One narrow stage."""
    kept = None if keep is None else frozenset(keep)
    names = list(columns)
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        schema = None
        for batch in batches:
            ids = batch.column(0)
            schema = pa.schema([("id", ids.type), ("column_name", pa.string()), ("path", pa.string()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())])
            for c, name in enumerate(names, 1):
                texts = batch.column(c)
                for i in range(batch.num_rows):
                    text = texts[i].as_py()
                    if text is None:
                        continue
                    try:  # all of a small text at once; a large one is read twice, so that it is never held as objects
                        if len(text) <= WHOLE_CHARS:
                            items: Iterable[object] = list(stream_items(text))
                        else:
                            for _ in stream_items(text):
                                pass
                            items = stream_items(text)
                    except ValueError:
                        continue
                    rid = ids[i].as_py()
                    for k, item in enumerate(items):
                        for t in item_triples(item, k, columns[name], kept):
                            out.append((rid, name, *t))
                            if len(out) >= OUT_ROWS:
                                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    got = df.select(F.col(id_col).alias("id"), *names).mapInArrow(run, f"id {id_type}, {TRIPLES}")
    return got.withColumnRenamed("id", id_col) if id_col != "id" else got


def pivot_group(triples: DataFrame, id_col: str, depth: int, fields: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """One row for each repeated ancestor of `depth` positions: the record, the
    column, pos_1..pos_depth and each named field (an aggregate-free expression over a
    triple that is null for the triples that aren't the field's).

    Partial aggregation does most of it before the shuffle: a record's triples
    leave the parser together."""
    pos = [F.col("ordinals")[i].alias(f"pos_{i + 1}") for i in range(depth)]
    rows = triples.where(F.size("ordinals") >= depth)
    if where is not None:
        rows = rows.where(where)
    picked = rows.select(id_col, "column_name", *pos, *[e.alias(n) for n, e in fields.items()])
    return picked.groupBy(id_col, "column_name", *[f"pos_{i + 1}" for i in range(depth)]).agg(*[F.max(n).alias(n) for n in fields])


#: The alternative places of a wall's points and a space's ring, in order.
WALL_PLACES = {"point": (("points",), ("geometry", "points")), "related_space": (("related_spaces",),)}
SPACE_PLACES = {"point": (("polygon",), ("boundary",), ("geometry", "boundary")), "related_wall": (("related_walls",),), "neighbor": (("neighbors",),)}
MODEL_COLUMNS = {"walls": WALL_PLACES, "spaces": SPACE_PLACES}
CHILD_KINDS = ("point", "related_space", "related_wall", "neighbor")


def _owner_kind() -> Column:
    return F.when(F.col("column_name") == "walls", F.lit("wall")).otherwise(F.lit("space"))


def model_children(models: DataFrame) -> DataFrame:
    """record_id, owner_kind, owner_ord, child_kind, child_ord of every non-null
    item in a list of a wall or space: the item triples, pivoted per child."""
    triples = to_triples(models, "record_id", MODEL_COLUMNS, keep=[f"[].{k}[]" for k in CHILD_KINDS])
    group = triples.withColumn("child_kind", F.regexp_extract("path", r"^\[\]\.(\w+)\[\]$", 1))
    keys = ["record_id", _owner_kind().alias("owner_kind"), F.col("ordinals")[0].alias("owner_ord"), "child_kind", F.col("ordinals")[1].alias("child_ord")]
    return (
        group.where(F.col("kind") != "null")
        .select(*keys)
        .groupBy("record_id", "owner_kind", "owner_ord", "child_kind", "child_ord")
        .agg(F.count(F.lit(1)).alias("n"))
        .drop("n")
    )


def model_owners(models: DataFrame) -> DataFrame:
    """One row for each wall and space that is an object, with its scalar fields."""
    names = ("uuid", "type", "thickness", "area", "area_raw", "edge_id")
    triples = to_triples(models, "record_id", MODEL_COLUMNS, keep=["[]", *(f"[].{n}" for n in names)])
    scalar = F.col("kind").isin("string", "number", "boolean")
    fields = {"kind": F.when(F.col("path") == "[]", F.col("kind"))} | {n: F.when((F.col("path") == f"[].{n}") & scalar, F.col("value")) for n in names}
    wide = pivot_group(triples, "record_id", 1, fields)
    return wide.where(F.col("kind") == "object").select("record_id", _owner_kind().alias("owner_kind"), F.col("pos_1").alias("owner_ord"), *names)


def model_points(models: DataFrame) -> DataFrame:
    """One row for each non-null point with its coordinates, given as a list or an
    object; a coordinate that is absent or no number is null."""
    triples = to_triples(models, "record_id", MODEL_COLUMNS, keep=["[].point[]", "[].point[][]", "[].point[].x", "[].point[].y", "[].point[].z"])
    def axis(name: str, k: int) -> Column:
        here = (F.col("path") == f"[].point[].{name}") | ((F.col("path") == "[].point[][]") & (F.get("ordinals", F.lit(2)) == k))
        return F.when(here & (F.col("kind") == "number"), F.col("value").try_cast("double"))
    fields = {"kind": F.when((F.col("path") == "[].point[]") & (F.col("kind") != "null"), F.col("kind")), "x": axis("x", 0), "y": axis("y", 1), "z": axis("z", 2)}
    wide = pivot_group(triples, "record_id", 2, fields)
    return wide.where(F.col("kind").isNotNull()).select("record_id", _owner_kind().alias("owner_kind"), F.col("pos_1").alias("owner_ord"), F.col("pos_2").alias("child_ord"), "x", "y", "z")


REFERENCE_KINDS = ("related_space", "related_wall", "neighbor")


def _scalar(path: str) -> Column:
    return F.when((F.col("path") == path) & F.col("kind").isin("string", "number", "boolean"), F.col("value"))


def model_references(models: DataFrame) -> DataFrame:
    """One row for each non-null item of a list of references, with its value. The items
    are those of model_children; one that is itself a list or an object has a null value."""
    triples = to_triples(models, "record_id", MODEL_COLUMNS, keep=[f"[].{k}[]" for k in REFERENCE_KINDS])
    group = triples.where(F.col("kind") != "null").select("record_id", _owner_kind().alias("owner_kind"), F.col("ordinals")[0].alias("owner_ord"), F.regexp_extract("path", r"^\[\]\.(\w+)\[\]$", 1).alias("child_kind"), F.col("ordinals")[1].alias("child_ord"), "value")
    return group.groupBy("record_id", "owner_kind", "owner_ord", "child_kind", "child_ord").agg(F.max("value").alias("value"))


def _group(models: DataFrame, path: str, depth: int, fields: Mapping[str, Column], more: Sequence[str] = ()) -> DataFrame:
    """One row for each non-null item of the repeated group at `path`."""
    triples = to_triples(models, "record_id", MODEL_COLUMNS, keep=[path, *more])
    wide = pivot_group(triples, "record_id", depth, {"_kind": F.when(F.col("path") == path, F.col("kind"))} | dict(fields))
    return wide.where(F.col("_kind") != "null").withColumn("owner_kind", _owner_kind()).withColumnRenamed("pos_1", "owner_ord")


def model_ancestry(models: DataFrame) -> DataFrame:
    """One row for each non-null block name in an owner's source.ancestry."""
    path = "[].source.ancestry[]"
    return _group(models, path, 2, {"value": _scalar(path)}).select("record_id", "owner_kind", "owner_ord", F.col("pos_2").alias("child_ord"), "value")


def model_finishes(models: DataFrame) -> DataFrame:
    """One row for each non-null item of an owner's tags.finish; one that is no object has null fields."""
    path = "[].tags.finish[]"
    fields = {n: _scalar(f"{path}.{n}") for n in ("mat", "layer")}
    return _group(models, path, 2, fields, [f"{path}.{n}" for n in fields]).select("record_id", "owner_kind", "owner_ord", F.col("pos_2").alias("child_ord"), *fields)


def model_holes(models: DataFrame) -> DataFrame:
    """One row for each non-null point of each ring in an owner's geometry.holes."""
    path = "[].geometry.holes[][]"
    def axis(name: str, k: int) -> Column:
        here = (F.col("path") == f"{path}.{name}") | ((F.col("path") == f"{path}[]") & (F.get("ordinals", F.lit(3)) == k))
        return F.when(here & (F.col("kind") == "number"), F.col("value").try_cast("double"))
    fields = {n: axis(n, k) for k, n in enumerate("xyz")}
    return _group(models, path, 3, fields, [f"{path}[]", *(f"{path}.{n}" for n in fields)]).select("record_id", "owner_kind", "owner_ord", F.col("pos_2").alias("hole_ord"), F.col("pos_3").alias("child_ord"), *fields)


#: Scalar fields one level below an owner.
DETAILS = {"source_layer": "source.layer", "source_block": "source.block", "tags_use": "tags.use", "geometry_length": "geometry.length"}


def model_details(models: DataFrame) -> DataFrame:
    """One row for each wall and space that is an object, with the scalar fields of its own objects."""
    fields = {n: _scalar(f"[].{p}") for n, p in DETAILS.items()}
    triples = to_triples(models, "record_id", MODEL_COLUMNS, keep=["[]", *(f"[].{p}" for p in DETAILS.values())])
    wide = pivot_group(triples, "record_id", 1, {"_kind": F.when(F.col("path") == "[]", F.col("kind"))} | fields)
    return wide.where(F.col("_kind") == "object").select("record_id", _owner_kind().alias("owner_kind"), F.col("pos_1").alias("owner_ord"), *fields)
