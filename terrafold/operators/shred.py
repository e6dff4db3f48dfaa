"""Nested JSON documents as an adjacency table, and entity tables joined and pivoted from it.

Shredding gives one row per value: node, parent, label, ordinal and scalar. Nodes are numbered within their document, so
no numbering across tasks is needed. A row also names the labels on its way from the root (``path``, with ``[]`` for an
element of a list) and the ordinals of the lists it lies in (``at``), which say what kind of thing a node is and which
one of its kind. Entity tables join container nodes with their scalar children on (document, parent) and pivot the labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.session import stored

#: Rows, and characters of paths, after which an Arrow batch is handed on.
BATCH_ROWS, BATCH_CHARS = 20_000, 16_000_000

SHRED_SCHEMA = "doc_id long, node long, parent long, label string, ordinal int, kind string, scalar string, path string, at string"


class _Number(str):
    """A number kept as it was written."""


def _not_json(text: str) -> None:
    raise ValueError(text)


_decode = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_not_json).decode
_SPACE, _NUMBER, _WORDS = re.compile(r"[ \t\n\r]*"), re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII), {"true": True, "false": False, "null": None}


def parse_deep(text: str) -> Any:
    """The value of a JSON text of any depth of nesting, without recursion; ValueError if it is none."""
    top: list = []
    stack: list[tuple[Any, str | None]] = [(top, None)]  # open containers, with the key that waits for its value
    i, want = 0, "value"
    while True:
        i = _SPACE.match(text, i).end()
        c = text[i : i + 1]
        if want == "value":
            box, key = stack[-1]
            if c == "{":
                new: Any = {}
            elif c == "[":
                new = []
            elif c == '"':
                new, i = scanstring(text, i + 1, True)
            elif m := _NUMBER.match(text, i):
                new, i = _Number(m.group()), m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, i)), None)
                if word is None:
                    raise ValueError("no value")
                new, i = _WORDS[word], i + len(word)
            if isinstance(box, dict):
                box[key] = new
            else:
                box.append(new)
            if c and c in "{[":
                i = _SPACE.match(text, i + 1).end()
                if text[i : i + 1] == ("}" if c == "{" else "]"):
                    i += 1
                    want = "next"
                else:
                    stack.append((new, None))
                    want = "key" if c == "{" else "value"
            else:
                want = "next"
        elif want == "key":
            if c != '"':
                raise ValueError("no key")
            key, i = scanstring(text, i + 1, True)
            i = _SPACE.match(text, i).end()
            if text[i : i + 1] != ":":
                raise ValueError("no colon")
            i += 1
            stack[-1] = (stack[-1][0], key)
            want = "value"
        else:
            box = stack[-1][0]
            if box is top:
                if c:
                    raise ValueError("text goes on")
                return top[0]
            if c == ",":
                want = "key" if isinstance(box, dict) else "value"
            elif c == ("}" if isinstance(box, dict) else "]"):
                stack.pop()
            else:
                raise ValueError("no end")
            i += 1


def parse(text: str | None) -> tuple[bool, Any]:
    """(valid, value). NaN and Infinity are no JSON; of repeated members the last counts."""
    if text is None:
        return False, None
    try:
        return True, _decode(text)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, parse_deep(text)
    except ValueError:
        return False, None


def _clean(text: str) -> str:
    if text.isascii():
        return text
    try:
        text.encode()
        return text
    except UnicodeEncodeError:  # lone surrogates can't be stored as UTF-8
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


_KINDS = {dict: "object", list: "array", _Number: "number", str: "string", bool: "boolean", type(None): "null"}


def shred_value(value: Any, wanted: dict[str, bool] | None = None, pattern: re.Pattern | None = None) -> Iterator[tuple]:
    """Adjacency rows (without doc_id) of one parsed document, parents before their children.

    A string that is itself a JSON object or array is shredded in its place; its text stays as the node's scalar. With
    ``pattern`` only rows whose path it matches come out; ``wanted`` remembers what was found of paths.
    """
    count = 0
    step: dict[tuple[str, str], str] = {}  # paths repeat, so each is made once
    todo: list[tuple] = [(value, None, None, None, "", "")]
    while todo:
        v, parent, label, ordinal, path, at = todo.pop()
        scalar, kind = None, _KINDS[type(v)]
        if kind == "string":
            scalar = _clean(v)
            if v.lstrip()[:1] in ("{", "["):
                ok, inner = parse(v)
                if ok:
                    v, kind = inner, _KINDS[type(inner)]
        elif kind == "number":
            scalar = v
        elif kind == "boolean":
            scalar = "true" if v else "false"
        node = count
        count += 1
        if pattern is None:
            yield node, parent, label, ordinal, kind, scalar, path, at
        else:
            keep = wanted.get(path)
            if keep is None:
                keep = wanted[path] = bool(pattern.search(path))
            if keep:
                yield node, parent, label, ordinal, kind, scalar, path, at
        if kind == "object":
            for i, (k, x) in enumerate(v.items()):
                way = step.get((path, k))
                if way is None:
                    name = _clean(k).replace("~", "~0").replace("/", "~1").replace("[]", "~2")
                    way = step[path, k] = f"{path}/{name}" if path else name
                todo.append((x, node, _clean(k), i, way, at))
        elif kind == "array":
            way = f"{path}[]"
            before = f"{at}." if at else ""
            todo.extend((x, node, None, i, way, f"{before}{i}") for i, x in enumerate(v))


def shred(docs: DataFrame, key: str = "page_id", body: str = "body", paths: str | None = None) -> DataFrame:
    """(doc_id, node, parent, label, ordinal, kind, scalar, path, at): one row per JSON value of every valid body.

    The root is node 0 and has no parent; elements of lists have an ordinal and no label. In paths a label's ``/`` is
    ``~1``, its ``~`` ``~0`` and its ``[]`` ``~2``. Null bodies and texts that are not JSON give no rows; depth is not
    bounded. Other columns of ``docs`` are ignored. With ``paths`` only rows whose path holds a match of that pattern
    come out, numbered as in the whole table; the pattern is tried once for each path that a task meets.
    """
    pattern = re.compile(paths) if paths else None
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = [f.split(" ")[0] for f in SHRED_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        wanted: dict[str, bool] = {}
        chars = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held.clear()
            return batch

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ok, value = parse(text)
                if len(wanted) > BATCH_ROWS:
                    wanted.clear()
                for row in shred_value(value, wanted, pattern) if ok else ():
                    held.append((doc, *row))
                    chars += len(row[6]) + len(row[7])
                    if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield flush()
                        chars = 0
        if held:
            yield flush()

    return docs.select(F.col(key).cast("long"), F.col(body).cast("string")).mapInArrow(run, SHRED_SCHEMA)


#: The way from the root to a place.
PLACE = r"^results\[\](?:/related_places/children\[\])*"


#: Paths of the rows that ``places`` and ``place_items`` read.
PLACE_PATHS = PLACE + "(?:/fsq_id|/name)?$"
ITEM_PATHS = PLACE + r"(?:/(?:location|website|rating)(?:\[\])?(?:/(?:address|formatted_address|url|value))?|/geocodes(?:\[\]|/[^/\[\]]+)(?:/(?:latitude|longitude|lat|lng|lon|type))?)?$"


def with_children(containers: DataFrame, scalars: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """Container nodes joined with their scalar children and pivoted: columns ``keep``, doc_id, node and one for each label.

    ``containers`` and ``scalars`` are rows of the adjacency table. Containers without such children come out with nulls.
    """
    child = scalars.where(F.col("label").isin(labels) & F.col("scalar").isNotNull()).select(F.col("doc_id").alias("c_doc"), "parent", F.col("label").alias("c_label"), F.col("scalar").alias("c_scalar"))
    met = containers.select("doc_id", "node", *keep).join(child, (F.col("doc_id") == F.col("c_doc")) & (F.col("node") == F.col("parent")), "left")
    return met.groupBy("doc_id", "node").agg(*(F.first(k).alias(k) for k in keep), *(F.max(F.when(F.col("c_label") == x, F.col("c_scalar"))).alias(x) for x in labels))


def places(nodes: DataFrame) -> DataFrame:
    """(page_id, place_path, parent_path, fsq_id, name): every place object; parent_path is null for those in results."""
    some = nodes.where(F.regexp_like("path", F.lit(PLACE_PATHS)))
    some = stored(some.select("doc_id", "node", "parent", "label", "kind", "scalar", "path", "at"))
    place = some.where((F.col("kind") == "object") & F.endswith("path", F.lit("[]")))
    rows = with_children(place, some, ["fsq_id", "name"], ["at"])
    parent = F.nullif(F.regexp_extract("at", r"^(.*)\.\d+$", 1), F.lit(""))
    return rows.select(F.col("doc_id").alias("page_id"), F.col("at").alias("place_path"), parent.alias("parent_path"), "fsq_id", "name")


#: Members of the containers of items, by what they are.
_COORDINATES = {"lat": ("latitude", "lat"), "lon": ("longitude", "lng", "lon")}


def _number(text: Column, whole: bool) -> Column:
    """The number that a text is, or the first in it, with a decimal point; null if none."""
    body = r"([+-]?\d+(?:[.,]\d+)?(?:[eE][+-]?\d+)?)"
    found = F.regexp_extract(F.trim(text), f"^{body}$" if whole else body, 1)
    return F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit("."))


def place_items(nodes: DataFrame) -> DataFrame:
    """(page_id, place_path, item_kind, item_key, lat, lon): addresses, geocodes, websites and ratings of all places.

    Each row is linked to its place by page_id and place_path. A location, geocode, website or rating counts in any
    JSON type: as an object, as a list of such, as a text holding either, or as a bare text or number. Objects among the
    containers (places, locations, geocodes, lists of them) are joined with their scalar children; what a scalar means
    follows from its container's path and its own label.
    """
    # only the few rows that can matter are stored and shuffled
    container = F.col("kind").isin("object", "array")
    some = nodes.where(F.regexp_like("path", F.lit(ITEM_PATHS)) & (container | F.col("kind").isin("string", "number")))
    some = stored(some.select("doc_id", "node", "parent", "label", "scalar", "path", "at", container.alias("is_container")))
    c = some.where("is_container").select("doc_id", "node", F.col("label").alias("c_label"))
    # what follows the place's own path tells what a scalar is
    s = some.where("NOT is_container").select("doc_id", F.col("parent").alias("node"), "label", "scalar", F.regexp_replace("path", PLACE + "/?", "").alias("rest"), "at")
    met = c.join(s, ["doc_id", "node"])
    # one more list lies between the place and what is an element of a list
    listed = F.contains("rest", F.lit("[]"))
    met = met.withColumn("place_path", F.when(listed, F.regexp_extract("at", r"^(.*)\.\d+$", 1)).otherwise(F.col("at")))

    # members of one object are pivoted into one row
    of_object = F.contains("rest", F.lit("/")) & ~F.regexp_like("rest", F.lit("^(?:website|rating)"))

    def member(*labels: str) -> Column:
        return F.max(F.when(F.col("label").isin(*labels), F.col("scalar")))

    objects = met.where(of_object).groupBy("doc_id", "node").agg(
        F.first("place_path").alias("place_path"), F.first("c_label").alias("c_label"), F.first("rest").alias("rest"),
        member("address").alias("address"), member("formatted_address").alias("formatted"), member("type").alias("type"),
        *(F.max(F.when(F.col("label").isin(*labels), _number(F.col("scalar"), True).try_cast("double"))).alias(n) for n, labels in _COORDINATES.items()),
    )
    geocode = F.startswith("rest", F.lit("geocodes"))
    told = F.coalesce(F.nullif("address", F.lit("")), F.nullif("formatted", F.lit("")))
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    blank = F.lit(None).cast("double")
    from_objects = objects.select(
        F.col("doc_id").alias("page_id"), "place_path", F.when(geocode, "geocode").otherwise("address").alias("item_kind"),
        F.when(geocode, F.when(placed, F.coalesce("type", "c_label"))).otherwise(told).alias("item_key"), F.when(geocode, F.col("lat")).alias("lat"), F.when(geocode, F.col("lon")).alias("lon"),
    )
    rated = F.round(_number(F.col("scalar"), False).try_cast("decimal(36,12)"), 1).cast("decimal(30,1)").cast("string")
    kind = F.regexp_extract("rest", "^[a-z]+", 0)
    key = F.when(kind == "location", F.nullif("scalar", F.lit(""))).when(kind == "website", F.when(F.trim("scalar") != "", F.col("scalar"))).otherwise(F.when(F.regexp_like("scalar", F.lit(r"\d")), rated))
    alone = met.where(~of_object).select(F.col("doc_id").alias("page_id"), "place_path", F.when(kind == "location", "address").otherwise(kind).alias("item_kind"), key.alias("item_key"), blank.alias("lat"), blank.alias("lon"))
    return from_objects.unionByName(alone).where("item_key IS NOT NULL")
