import json
import xml.etree.ElementTree as ET

import pytest

from corpusloom.functions import markup
from corpusloom.operators import nested

XML = b"""<release id="1"><title>One &amp; two</title><tracks><track n='1'><title>A</title><credit><name>x</name></credit></track><track><title>B</title>
<subtracks><track><title>C</title><note lang="en"/></track></subtracks></track></tracks><!-- <label><name>no</name></label> --><alias>p</alias><alias>q</alias><empty/><mixed>text <b>bold</b> tail</mixed></release>"""
JSON = {"id": 1, "title": None, "parts": [{"title": "a", "credits": [{"name": "n", "roles": ["r", "s"]}]}, {"title": "b", "parts": [{"x": True}]}], "publisher": {"name": "p", "address": {}}, "grid": [[1, {"k": 2.5}]], "note": '{"a": 1}'}


def xml_nodes(data):
    out = []

    def walk(e, path, parent):
        if len(e) and parent is not None:
            out.append((parent, path))
        seen = {}
        for c in e:
            seen[c.tag] = seen.get(c.tag, 0) + 1
            walk(c, f"{'' if path == '/' else path}/{c.tag}[{seen[c.tag]}]", path)

    walk(ET.fromstring(data), "/", None)
    return out


def json_nodes(value):
    out = []

    def walk(v, path, parent):
        if isinstance(v, dict):
            if parent is not None:
                out.append((parent, path))
            for k, w in v.items():
                step = f"{'' if path == '/' else path}/{k}"
                items(w, step, path) if isinstance(w, list) else walk(w, f"{step}[1]", path)

    def items(v, step, parent):
        for k, w in enumerate(v, 1):
            items(w, f"{step}[{k}]", parent) if isinstance(w, list) else walk(w, f"{step}[{k}]", parent)

    walk(value, "/", None)
    return out


def test_nodes_equal_brute_force(spark):
    deep = b"<r>" + b"<a>" * 2000 + b"<b/>" + b"</a>" * 2000 + b"</r>"
    rows = [(1, XML, "xml"), (2, json.dumps(JSON).encode(), "json"), (3, b"<r><a>", "xml"), (4, b'{"a": ', "json"), (5, None, "xml"), (None, XML, "xml"), (6, b"", "xml"), (7, b"[]", "json"), (8, b'[{"a": {}}, 3]', "json"), (9, b"<r/>", "xml"), (10, XML, "txt"), (11, b"\xef\xbb\xbf{}", "json"), (12, deep, "xml"), (13, b"\xff", "json")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "index bigint, bytes binary, form string, node_path string, ordinal int")
    layout = nested.layout_of(df)
    t = nested.triples(df, layout).persist()
    got = {}
    for r in nested.nodes(nested.tables(t, layout)).collect():
        got.setdefault(r["index"], []).append((r["parent_path"], r["node_path"]))
    assert sorted(got[1]) == sorted(xml_nodes(XML)) and sorted(got[2]) == sorted(json_nodes(JSON)) and len(got[12]) == 2000
    assert set(got) == {1, 2, 8, 12}
    assert nested.triples(df.limit(0)).count() == 0 == nested.nodes(nested.tables(t.limit(0), layout)).count()


def test_flat_tables_keep_links_and_values(spark):
    df = spark.createDataFrame([(1, XML, "xml"), (2, json.dumps(JSON).encode(), "json")], "index bigint, bytes binary, form string")
    layout = nested.layout_of(df)
    # a track within a track is of the same table; what stands once below a row is part of it
    assert layout.repeated == {"release/tracks/track", "record/parts", "record/parts/credits", "record/grid"}
    t = nested.triples(df, layout).persist()
    tracks = {r["node_path"]: r for r in nested.flat_table(t, "release/tracks/track", ["title", "@n", "credit/name", "subtracks/x"]).collect()}
    assert {p: (r["parent_path"], r["title"], r["@n"], r["credit/name"], r["ordinal"]) for p, r in tracks.items()} == {
        "/tracks[1]/track[1]": ("/", "A", "1", "x", 1),
        "/tracks[1]/track[2]": ("/", "B", None, None, 2),
        "/tracks[1]/track[2]/subtracks[1]/track[1]": ("/tracks[1]/track[2]", "C", None, None, 1),
    }
    root = nested.flat_table(t, "release", ["title", "@id", "mixed/b", "mixed/#text"]).first()
    assert tuple(root) == (1, None, "/", 1, "One & two", "1", "bold", "text  tail")
    assert [(r["ordinal"], r["value"]) for r in nested.repeated_values(t, "release", "alias").orderBy("ordinal").collect()] == [(1, "p"), (2, "q")]
    assert [r["value"] for r in nested.repeated_values(t, "record/parts/credits", "roles").orderBy("ordinal").collect()] == ["r", "s"]
    assert {r["title"] for r in nested.flat_table(t, "record/parts", ["title"]).collect()} == {"a", "b", None}
    assert nested.flat_table(t, "nothing", []).count() == 0
    assert nested.flat_table(t, "record", ["id", "title", "note", "publisher/name"]).first().asDict() == {"index": 2, "parent_path": None, "node_path": "/", "ordinal": 1, "id": "1", "title": None, "note": '{"a": 1}', "publisher/name": "p"}


def rebuilt(whole, layout, limit):
    """index, row, name, ordinal, value of all that the pivoted tables hold."""
    columns = [c for c in whole.columns if c not in ("table", "index", "parent_path", "node_path", "ordinal", "nodes", "more", "value")]
    plain = sorted({n for own in layout.columns().values() for n, many in own.items() if not many})[:limit]
    names = dict(zip(columns, plain, strict=True))
    out = set()
    for r in whole.collect():
        if r["node_path"] is None:
            out.add((r["index"], r["parent_path"], r["table"].rpartition("/")[2], r["ordinal"], r["value"]))
        else:
            out |= {(r["index"], r["node_path"], names[c], None, r[c]) for c in columns if r[c] is not None}
            out |= {(r["index"], r["node_path"], m["name"], None, m["value"]) for m in (r["more"] if "more" in whole.columns else None) or [] if m["value"] is not None}
    return out


def test_all_tables_hold_all_values(spark, monkeypatch):
    clash = b"<r><Title>t</Title><value>v</value><title>u</title></r>"
    rows = [(1, XML, "xml"), (2, json.dumps(JSON).encode(), "json"), (3, clash, "xml"), (4, b'{"cells": [["p"], ["q"]], "a/b": {"c~": [{"d": 1}, {"d": 2}]}}', "json"), (5, b"[[1, 2], {}]", "json")]
    df = spark.createDataFrame(rows, "index bigint, bytes binary, form string")
    for columns, paths in ((2000, 100_000), (3, 100_000), (2000, 2)):  # all known; columns beyond the limit; a layout beyond it
        monkeypatch.setattr(nested, "MAX_COLUMNS", columns)
        monkeypatch.setattr(nested, "MAX_LAYOUT", paths)
        layout = nested.layout_of(df)
        t = nested.triples(df, layout).persist()
        values = t.where("kind = 'value' and value is not null").collect()
        whole = nested.tables(t, layout).persist()
        nodes = {(r["index"], r["parent_path"], r["node_path"]) for r in nested.nodes(whole).collect()}
        assert nodes == {(r["index"], r["parent_path"], r["node_path"]) for r in t.where("kind = 'node' and parent_path is not null").collect()}
        if layout.repeated is None:
            held = sorted((r["index"], r["node_path"], m["name"], m["ordinal"], m["value"]) for r in whole.collect() for m in r["more"] if m["value"] is not None)
            assert paths == 2 and held == sorted((r["index"], r["row_path"], r["name"], r["ordinal"], r["value"]) for r in values)
        else:
            several = {(table, name) for table, name, many in nested.layout_rows(layout) if many}
            want = {(r["index"], r["row_path"], r["name"].rpartition("/")[2] if (r["table"], r["name"]) in several else r["name"], r["ordinal"] if (r["table"], r["name"]) in several else None, r["value"]) for r in values}
            assert rebuilt(whole, layout, columns) == want and ("record", "cells") in several and ("more" in whole.columns) == (columns == 3)
    assert "title_2" not in nested.tables(t.limit(0), nested.Layout(frozenset(), (("r", "title", False),))).columns


def test_json_of_any_depth(spark):
    depth = 12_000
    deep = '{"a": ' * depth + "1" + "}" * depth
    with pytest.raises(RecursionError):
        json.loads(deep, object_pairs_hook=dict)
    record = nested._Record(nested.Layout(frozenset({"record/a"})))
    assert nested.read_json(deep.encode(), record) and sum(r[5] == "node" for r in record.rows) == depth
    assert not nested.read_json(deep[:-1].encode(), nested._Record(None)) and markup.is_json(deep.encode()) and not markup.is_json(deep[:-1].encode())
    df = spark.createDataFrame([(1, deep.replace("1", '{"b": [true, {"c": null}]}').encode(), "json")], "index bigint, bytes binary, form string")
    got = nested.triples(df).where("kind = 'node'").selectExpr("count(*)", "max(length(node_path))").first()
    assert tuple(got) == (depth + 2, 5 * depth + len("/b[2]"))


class Pairs(list):
    pass


def from_events(text):
    """The value that the events tell."""
    done, stack, names = [], [], []
    for kind, own in markup.json_events(text):
        if kind == markup.NAME:
            names[-1] = own
            continue
        if kind in (markup.OBJECT, markup.ARRAY):
            stack.append(Pairs() if kind == markup.OBJECT else [])
            names.append(None)
            continue
        value = own if kind == markup.SCALAR else stack.pop()
        if kind != markup.SCALAR:
            names.pop()
        (stack[-1] if stack else done).append((names[-1], value) if stack and isinstance(stack[-1], Pairs) else value)
    return done[0]


def test_json_events_equal_json_loads():
    good = [json.dumps(JSON), " [ ] ", "{}", '{"a":{},"a":[]}', "[1, -2.5e3, NaN, -Infinity, true]", '"\\u00e9\\n"', "null", "[[[]],{}]", json.dumps(JSON, indent=2)]
    bad = ["", "[", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", '{"a":1]', "[1}", "1 2", "{1:2}", '"a', '["\n"]', "tru", "[,]", '{"a":}', "01", "\u00a0[]"]

    def strings(v):
        if isinstance(v, Pairs):
            return Pairs((k, strings(w)) for k, w in v)
        return [strings(w) for w in v] if isinstance(v, list) else v

    keep = {"parse_float": str, "parse_int": str, "parse_constant": str}
    for text in good:
        want = strings(json.loads(text, object_pairs_hook=Pairs, **keep))
        assert repr(from_events(text)).replace("'true'", "True") == repr(want), text
    for text in bad:
        with pytest.raises(ValueError):
            from_events(text)
        with pytest.raises(ValueError):
            json.loads(text)
