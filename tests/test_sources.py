import json

import pytest

from factlake.sources import caps_text, facts_json


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_dictionary_layers(spark, tmp_path):
    d = tmp_path / "caps"
    write(d / "std", "# head\n\n std::a = BI # why\nx#y=S\nstd::a=B\n")
    write(d / "zoo", "std::a=\nq=M")
    write(d / "seed", "std::a=U\n")
    entries = caps_text.read(spark, str(d))
    found = {(r.layer, r.line): (r.key, r.mask) for r in entries.collect()}
    assert found == {("std", 3): ("std::a", 6), ("std", 4): ("x#y", 32), ("std", 5): ("std::a", 2), ("zoo", 1): ("std::a", 0), ("zoo", 2): ("q", 8), ("seed", 1): ("std::a", 128)}
    assert {r.key: r.mask for r in caps_text.merged(entries).collect()} == {"std::a": 0, "x#y": 32, "q": 8}
    assert {r.key: r.mask for r in caps_text.merged_layers(entries, ["seed", "std", "none"]).collect()} == {"std::a": 2, "x#y": 32}
    assert {r.key: r.mask for r in caps_text.merged(caps_text.excluding(entries, ["zoo", "seed"])).collect()} == {"std::a": 2, "x#y": 32}
    assert caps_text.read(spark, str(tmp_path / "none")).count() == 0


def test_dictionary_errors(spark, tmp_path):
    write(tmp_path / "d" / "seed", "a=B\nno sign\nb=XY\n")
    rows = {r.line: r.error for r in caps_text.read(spark, str(tmp_path / "d"), strict=False).collect()}
    assert rows == {1: None, 2: "missing = in: no sign", 3: "invalid capability in: XY"}
    with pytest.raises(Exception, match="seed line 2"):
        caps_text.read(spark, str(tmp_path / "d")).collect()


def test_dictionary_text(spark, tmp_path):
    masks = spark.createDataFrame([("b", 3), ("a::c", 0)], "key string, mask int")
    caps_text.write(masks, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))) == "a::c=\nb=AB # Async Blocking\n"
    caps_text.write(masks.limit(0), str(tmp_path / "none"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "none").glob("part*"))) == "\n"


def behavior(*calls, **flags):
    return {"calls": list(calls)} | dict.fromkeys(facts_json.REQUIRED, False) | flags


def test_callgraph(spark, tmp_path):
    write(tmp_path / "one" / "a.json", json.dumps({"a::f": behavior("a::g", "a::h"), "a::g": behavior(has_async=True)}))
    write(tmp_path / "one" / "b.json", json.dumps({"a::f": behavior("a::i", is_unsafe_fn=True, is_test=True)}))
    graph = facts_json.read_callgraph(spark, str(tmp_path / "one"))
    fn, edge = facts_json.merged(graph)
    assert {(r.def_path, r.has_async, r.is_unsafe_fn, r.is_test, r.is_port_method) for r in fn.collect()} == {("a::f", False, True, True, False), ("a::g", True, False, False, False)}
    assert {tuple(r) for r in edge.collect()} == {("a::f", "a::g"), ("a::f", "a::h"), ("a::f", "a::i")}
    write(tmp_path / "two" / "a.json", json.dumps({"a::g": behavior()}))
    both = facts_json.replaced(graph, facts_json.read_callgraph(spark, str(tmp_path / "two")))
    assert {(r.def_path, r.has_async) for r in facts_json.merged(both)[0].collect()} == {("a::f", False), ("a::g", False)}
    facts_json.write_callgraph(fn, edge, str(tmp_path / "out"))
    again = facts_json.read_callgraph(spark, str(tmp_path / "out"))
    assert {r.def_path: r.calls for r in again.collect()} == {"a::f": ["a::g", "a::h", "a::i"], "a::g": []}
    back_fn, back_edge = facts_json.merged(again)
    assert sorted(map(str, back_fn.collect())) == sorted(map(str, fn.collect())) and sorted(map(str, back_edge.collect())) == sorted(map(str, edge.collect()))
    for f in (tmp_path / "out").rglob("part*"):
        json.loads(f.read_text())  # each file is one object
    odd = spark.createDataFrame([('x::"q\\\\ü@a::T', *[False] * 6)], "def_path string, " + ", ".join(f"{x} boolean" for x in facts_json.REQUIRED))
    facts_json.write_callgraph(odd, edge.limit(0), str(tmp_path / "odd"))
    assert facts_json.read_callgraph(spark, str(tmp_path / "odd")).first().def_path == odd.first().def_path


def test_cached_callgraphs(spark, tmp_path):
    one, two, bad = (str(tmp_path / x) for x in ("one", "two", "bad"))
    write(tmp_path / "one" / "a.json", json.dumps({"f": behavior("g"), "g": behavior("h", has_async=True)}))
    write(tmp_path / "one" / "b.json", json.dumps({"f": behavior("i")}))
    write(tmp_path / "two" / "c.json", json.dumps({"f": behavior("z", is_test=True)}))
    write(tmp_path / "bad" / "a.json", json.dumps({"k": behavior("l")}))
    write(tmp_path / "bad" / "b.json", "{no")
    shown = lambda graph: ({(r.def_path, r.has_async, r.is_test) for r in graph[0].collect()}, {tuple(r) for r in graph[1].collect()})
    assert shown(facts_json.read_cached(spark, one, two)) == ({("f", False, True), ("g", True, False)}, {("f", "z"), ("g", "h")})
    assert shown(facts_json.read_cached(spark, one, bad)) == ({("f", False, False), ("g", True, False)}, {("f", "g"), ("f", "i"), ("g", "h")})
    assert shown(facts_json.read_cached(spark, bad, str(tmp_path / "none"))) == (set(), set())


def test_callgraph_errors(spark, tmp_path):
    write(tmp_path / "x.json", '{"a": {"calls": []}}')
    with pytest.raises(Exception, match="missing field"):
        facts_json.read_callgraph(spark, str(tmp_path / "x.json")).collect()
    write(tmp_path / "y.json", "{nothing")
    with pytest.raises(Exception, match="no call graph"):
        facts_json.read_callgraph(spark, str(tmp_path / "y.json")).collect()
    write(tmp_path / "z.json", '{"a": ' + json.dumps(behavior("b")) + ', "a": ' + json.dumps(behavior("c")) + "}")
    assert [r.calls for r in facts_json.read_callgraph(spark, str(tmp_path / "z.json")).collect()] == [["c"]]


def test_report_files(spark, tmp_path):
    write(tmp_path / "r" / "a.json", json.dumps([{"name": "f", "caps": "BQ", "lines": 3, "is_test": False, "allows_dead_code": True, "more": 1}]))
    assert [tuple(r) for r in facts_json.read_report(spark, str(tmp_path / "r")).collect()] == [("f", 2, 3, False, True)]
    rows = [("a", "f", "B", 3, False, True), ("a", "g", "", 1, True, False), ("b", 'h"', "QS", 2, False, False), ("a", "f", "B", 3, False, True)]
    entries = spark.createDataFrame(rows, "crate string, name string, caps string, lines long, is_test boolean, allows_dead_code boolean").repartition(2)
    facts_json.write_report(entries, str(tmp_path / "w"))
    got = sorted(tuple(r) for r in facts_json.read_report(spark, str(tmp_path / "w")).collect())
    assert got == sorted((n, {"B": 2, "": 0, "QS": 32}[c], l, t, d) for _, n, c, l, t, d in rows)
    assert all(isinstance(json.loads(f.read_text()), list) for f in (tmp_path / "w").rglob("part*"))
    write(tmp_path / "l" / "a.json", '{"name": "f", "caps": "S", "lines": 1, "is_test": false, "allows_dead_code": false}\n\n{"name": "g", "caps": "", "lines": 2, "is_test": true, "allows_dead_code": false}\n')
    assert sorted(r.name for r in facts_json.read_report(spark, str(tmp_path / "l")).collect()) == ["f", "g"]
    write(tmp_path / "x" / "a.json", "[{no")
    with pytest.raises(Exception, match="(?i)malformed"):
        facts_json.read_report(spark, str(tmp_path / "x")).collect()
    assert facts_json.crate_name("my-app") == "my_app"
    with pytest.raises(ValueError):
        facts_json.crate_name("")


def test_white_space_and_folders(spark, tmp_path):
    write(tmp_path / "d" / "seed", "a\t=\tAB\t# x\n\u00a0b\u2003=\x0cS \r\n\t# no\n")
    write(tmp_path / "d" / "deps", "a=U\n")
    rows = {r.key: (r["mask"], r.error) for r in caps_text.read(spark, str(tmp_path / "d" / "seed")).collect()}
    assert rows == {"a": (3, None), "b": (32, None)}
    assert {r.key: r["mask"] for r in caps_text.merged(caps_text.read_excluding(spark, str(tmp_path / "d"), ["deps"])).collect()} == {"a": 3, "b": 32}
    assert caps_text.read_excluding(spark, str(tmp_path / "d" / "seed"), ["deps"]).count() == 0


def test_where_the_dictionary_is(spark, tmp_path):
    write(tmp_path / "project" / "caps" / "seed", "a=B\n")
    write(tmp_path / "tool" / "caps" / "seed", "a=S\n")
    project, tool, own = (str(tmp_path / x) for x in ("project", "tool/caps", "project/caps/seed"))
    assert caps_text.resolved_path(spark, own, project, tool) == own
    assert caps_text.resolved_path(spark, str(tmp_path / "none"), project, tool) == f"{project}/caps"
    assert caps_text.resolved_path(spark, None, str(tmp_path / "other"), tool) == tool
    assert caps_text.resolved_path(spark, None, str(tmp_path / "other"), None) is None


def test_results_are_written_twice(spark, tmp_path):
    masks = spark.createDataFrame([("b", 2), ("a", 0)], "key string, mask int")
    assert [r.line for r in caps_text.write_result(masks, str(tmp_path / "default")).collect()] == ["a=", "b=B # Blocking"]
    assert caps_text.write_result(masks, str(tmp_path / "default"), str(tmp_path / "more")) is None
    for name in ("default", "more"):
        assert {(r.key, r["mask"]) for r in caps_text.read(spark, str(tmp_path / name)).where("key IS NOT NULL").collect()} == {("b", 2), ("a", 0)}
