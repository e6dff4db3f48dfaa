import json
import re
from decimal import ROUND_HALF_UP, Decimal

import duckdb

from terrafold.operators import shred


def items_by_walk(body):
    """The items of a body by a plain walk."""
    def loads(v):
        if isinstance(v, str) and v.lstrip()[:1] in ("{", "["):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def number(v):
        v = loads(v)
        if isinstance(v, bool) or v is None:
            return None
        m = re.fullmatch(r"\s*([+-]?\d+(?:[.,]\d+)?)\s*", str(v)) if isinstance(v, (int, float, str)) else None
        return m and float(m[1].replace(",", "."))

    out = set()

    def place(p, path):
        loc = loads(p.get("location"))
        for x in loc if isinstance(loc, list) else [loc]:
            x = loads(x)
            if isinstance(x, dict) and (x.get("address") or x.get("formatted_address")):
                out.add((path, "address", x.get("address") or x["formatted_address"]))
            elif isinstance(x, str) and x:
                out.add((path, "address", x))
        geo = loads(p.get("geocodes"))
        pairs = geo.items() if isinstance(geo, dict) else [(g.get("type"), g) for g in geo if isinstance(g, dict)] if isinstance(geo, list) else []
        for name, g in pairs:
            g = loads(g)
            if isinstance(g, dict) and number(g.get("latitude", g.get("lat"))) is not None and number(g.get("longitude", g.get("lng"))) is not None:
                out.add((path, "geocode", name))
        web = loads(p.get("website"))
        for w in web if isinstance(web, list) else [web]:
            w = w.get("url") if isinstance(w, dict) else w
            if isinstance(w, str) and w.strip():
                out.add((path, "website", w))
        r = loads(p.get("rating"))
        r = r.get("value") if isinstance(r, dict) else r
        m = re.search(r"[+-]?\d+(?:[.,]\d+)?", str(r)) if isinstance(r, (int, float, str)) and not isinstance(r, bool) else None
        if m:
            out.add((path, "rating", str(Decimal(m[0].replace(",", ".")).quantize(Decimal("0.1"), ROUND_HALF_UP))))
        kids = loads(p.get("related_places"))
        kids = loads(kids.get("children")) if isinstance(kids, dict) else None
        for i, k in enumerate(kids if isinstance(kids, list) else []):
            if isinstance(loads(k), dict):
                place(loads(k), f"{path}.{i}")

    try:
        body = json.loads(body)
    except (TypeError, ValueError):
        return out
    results = loads(body.get("results")) if isinstance(body, dict) else None
    for i, p in enumerate(results if isinstance(results, list) else []):
        if isinstance(loads(p), dict):
            place(loads(p), str(i))
    return out


def spark_items(spark, rows):
    docs = spark.createDataFrame(rows, "page_id long, body string, node string, label string")
    few, whole = ({(r.page_id, r.place_path, r.item_kind, r.item_key) for r in shred.place_items(shred.shred(docs, paths=p)).collect()} for p in (shred.ITEM_PATHS, None))
    assert few == whole
    return whole


def test_all_pages_against_a_walk(spark):
    rows = duckdb.sql("SELECT page_id, body FROM '/root/testdata/sf0.01/place_pages.parquet'").fetchall()
    want = {(i, *x) for i, b in rows for x in items_by_walk(b)}
    assert len(want) > 2000
    assert spark_items(spark, [(i, b, "x", "y") for i, b in rows]) == want


def test_odd_bodies(spark):
    bodies = [
        None, "", "null", "[]", "7", "{", '{"results": null}', '{"results": {"a": 1}}', '{"results": [null, 3, [], {"rating": 8.45, "website": [" ", "http://x", {"url": "http://y"}]}]}',
        '{"results": [{"rating": NaN}]}', '{"results": [{"rating": "9,04 of 10", "website": "\\ud800", "location": "Main St 1"}]}',
        '{"results": [{"geocodes": {"a/b~c": {"latitude": "1", "longitude": "2"}, "x": {"latitude": 1}}, "location": [{"address": "", "formatted_address": "F"}]}]}',
        '{"results": [{"related_places": {"children": [{"related_places": {"children": [{"rating": 1}]}}, 5, {"rating": -1.25}]}}]}',
        "[" * 5000 + "]" * 5000, '{"results": [' + "[" * 1500 + "]" * 1500 + "]}", '{"results": [{"rating": 1, "rating": 2}]}',
        '{"results": [{"website": "http://deep", "x": ' + "[" * 5000 + "]" * 5000 + ', "rating": 7}]}', '{"results": {"0": {"rating": 1}}}',
        '{"results": [' + '{"related_places": {"children": [' * 60 + '{"rating": 3}' + "]}}" * 60 + "]}",
    ]
    got = spark_items(spark, [(i, b, "n", "l") for i, b in enumerate(bodies)])
    assert got == {
        (8, "3", "rating", "8.5"), (8, "3", "website", "http://x"), (8, "3", "website", "http://y"), (10, "0", "rating", "9.0"), (10, "0", "website", "�"), (10, "0", "address", "Main St 1"),
        (11, "0", "geocode", "a/b~c"), (11, "0", "address", "F"), (12, "0.0.0", "rating", "1.0"), (12, "0.2", "rating", "-1.3"), (15, "0", "rating", "2.0"),
        (16, "0", "website", "http://deep"), (16, "0", "rating", "7.0"), (18, "0" + ".0" * 60, "rating", "3.0"),
    }


def test_adjacency_restores_the_document(spark):
    doc = {"a": [1, {"b": None, "c": [True, "x"]}], "d/e": {}, "f": "[1, 2"}
    rows = shred.shred(spark.createDataFrame([(1, json.dumps(doc))], "page_id long, body string")).collect()
    kids = {}
    for r in rows:
        if r.parent is not None:
            kids.setdefault(r.parent, []).append(r)
    assert {r.path for r in rows} == {"", "a", "a[]", "a[]/b", "a[]/c", "a[]/c[]", "d~1e", "f"} and {r.at for r in rows if r.path == "a[]/c[]"} == {"1.0", "1.1"}

    def build(r):
        children = sorted(kids.get(r.node, []), key=lambda x: x.ordinal)
        if r.kind == "object":
            return {c.label: build(c) for c in children}
        if r.kind == "array":
            return [build(c) for c in children]
        return {"null": None, "boolean": r.scalar == "true", "number": r.scalar and r.kind == "number" and float(r.scalar), "string": r.scalar}[r.kind]

    assert build(next(r for r in rows if r.parent is None)) == doc


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, body string")
    assert shred.shred(df).count() == 0 and shred.places(shred.shred(df)).count() == 0


def test_deep_texts_parse_like_others():
    for text in ('{"a": [1, -2.5e3, {"b": "x\\ny", "c": null}], "d": {}, "e": [], "f": [true, false]}', "[]", "7", '"x"', " { } "):
        assert shred.parse_deep(text) == shred.parse(text)[1]
    for text in ("", "{", "[1,]", '{"a" 1}', '{"a":}', "[1 2]", "01", "nul", '{"a":1}}', "NaN", "[1", '"x', "{1: 2}", "[,]", '{"a": 1,}'):
        assert shred.parse(text) == (False, None)
        try:
            shred.parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)
    deep = shred.parse("[" * 200_000 + "1" + "]" * 200_000)[1]
    n = 0
    while isinstance(deep, list):
        deep, n = deep[0], n + 1
    assert n == 200_000 and deep == "1"
