import pytest

from factlake.functions import caps
from factlake.operators import check, rename, report, why
from factlake.plans import facts as bridge


def entries(spark, rows):
    return spark.createDataFrame(rows, "name string, mask int, lines long, is_test boolean, allows_dead_code boolean")


def test_report(spark):
    e = entries(spark, [("a", 0, 10, False, False), ("b", 3, 10, False, False), ("c", 16, 20, False, False), ("d", 4, 60, False, False), ("t", 4, 99, True, False), ("x", 4, 99, False, True)])
    rows = [tuple(r) for r in report.report(e).orderBy("position").collect()]
    assert rows == [("I(IO)", 1, 60, 600, 18, 1), ("(ok)", 3, 40, 400, 12, 2), ("(good)", 2, 20, 200, 6, 3), ("P(Port)", 1, 20, 200, 6, 4), ("(pure)", 1, 10, 100, 3, 5), ("A(Async)", 1, 10, 100, 3, 6), ("B(Blocking)", 1, 10, 100, 3, 7)]
    text = [r.line for r in report.report_text(e).orderBy("position").collect()]
    assert text[:5] == ["Capability Report", "-" * 60, "Total: 4 functions, 100 lines", "-" * 60, "  I(IO)            1 fns     60 lines   60.0% |" + "█" * 18 + "░" * 12 + "|"]


def test_empty_report(spark):
    for rows in ([], [("a", 0, 0, False, False)]):
        assert report.report(entries(spark, rows)).count() == 0
        assert [r.line for r in report.report_text(entries(spark, rows)).orderBy("position").collect()][-1] == "(no rvs_ functions found)"


def test_fn_entries(spark):
    fn = spark.createDataFrame([("rvs_f_B", "{\n a();\n // b\n}", False, "dead_code"), ("g", "{}", False, None)], "name string, body_snippet string, is_test boolean, allows string")
    assert [tuple(r) for r in report.fn_entries(fn).collect()] == [("rvs_f_B", 2, "B", 1, False, True)]


def test_annotate(spark):
    fn = spark.createDataFrame([("a::go", False, False), ("a::m::go", False, False), ("a::main", False, False), ("a::T", False, False), ("a::t", True, False), ("a::rvs_x", False, False), ("b::go", False, False), ("a::skip", False, False), ("a::n::skip", False, True)], "def_path string, is_test boolean, is_trait_impl boolean")
    masks = fn.selectExpr("def_path", "IF(def_path = 'a::go', 3, 0) AS mask")
    assert [tuple(r) for r in rename.annotate_plan(fn, masks, "a").collect()] == [("go", "rvs_go_AB")]


def test_strip_and_sites(spark):
    site = spark.createDataFrame([("rvs_go_AB", False), ("rvs_go_AB", True), ("plain", False), ("plain", True)], "name string, is_in_trait_impl boolean")
    assert [tuple(r) for r in rename.strip_plan(site).collect()] == [("rvs_go_AB", "go")]
    assert [tuple(r) for r in rename.eligible_sites(site).collect()] == [("plain", False)]


def test_edits(spark):
    source = spark.createDataFrame([("a", "let go = go();"), ("b", "same")], "file string, text string")
    edit = spark.createDataFrame([("a", 4, 6, "rvs_go"), ("a", 9, 11, "rvs_go"), ("a", 12, 99, "no")], "file string, start int, end int, insert string")
    assert {tuple(r) for r in rename.apply_edits(source, edit).collect()} == {("a", "let rvs_go = rvs_go();"), ("b", "same")}


def test_why(spark):
    fn = spark.createDataFrame([("c::f", False), ("c::ff", False), ("p::run@T", False)], "def_path string, is_port_method boolean")
    edge = spark.createDataFrame([("c::f", "x"), ("c::f", "T::run"), ("c::f", "s"), ("c::f", "c::ff")], "caller string, callee string")
    inferred = spark.createDataFrame([("c::f", 6), ("c::ff", 0), ("p::run@T", 4)], "def_path string, mask int")
    seed = spark.createDataFrame([("s", 2)], "key string, mask int")
    lines = [r.line for r in why.why("c::f", fn, edge, inferred, seed).collect()]
    assert lines == ["c::f = BI (Blocking IO)", "", "  callees:", "    T::run: I (IO)", "    c::ff: (pure)", "    s: B (Blocking)", "    x: (unknown)"]
    assert [r.line for r in why.why("c::ff", fn, edge, inferred, seed).collect()] == ["c::ff (pure)", "", "  (no callees)"]
    assert [r.line for r in why.why("c::", fn, edge, inferred, seed).collect()] == ["Exact match not found. Did you mean:", "  c::f = BI", "  c::ff (pure)"]
    with pytest.raises(ValueError, match="not found"):
        why.why("zzz", fn, edge, inferred, seed)


def test_all_lints_fire_and_levels(spark, sf_dir):
    make = bridge.maker(spark, sf_dir)
    facts = check.Facts.of(lambda name: make(bridge.FACTS[name]))
    found = {r["lint"]: r["count"] for r in check.diagnostics(facts).groupBy("lint").count().collect()}
    assert set(check.LINTS) - set(found) <= {"duplicate_test"} and len(check.LINTS) == 39  # too few parts for equal names
    assert sum(level == "deny" for level, _ in check.LINTS.values()) == 4
    assert check.has_failed(check.diagnostics(facts, ["stub_macro"])) and not check.has_failed(check.diagnostics(facts, ["into_impl"]))


def test_strict_tests(spark):
    fn = spark.createDataFrame([("c", "f", "x", "free", False, 1, 0), ("c", "g", "x", "free", False, 2, 0), ("c", "h", "t", "free", True, 3, 0)], "crate string, file string, name string, kind string, is_test boolean, lo_line int, lo_col int")

    class Only:
        pass

    facts = Only()
    facts.fn, facts.snapshot = fn, spark.createDataFrame([("t",)], "name string")
    assert {r.message for r in check.duplicate_test(facts).collect()} == {"duplicate test 'x'"}
    assert check.duplicate_test(facts, strict_tests=True).count() == 0
    assert [r.message for r in check.missing_test_output(facts).collect()] == ["test 'x' missing test_out/x.out"]


def test_unknown_is_not_pure(spark):
    df = spark.createDataFrame([(None,), (0,)], "m int")
    assert [r[0] for r in df.select(why.shown(df["m"])).collect()] == ["(unknown)", "(pure)"]
    assert [r[0] for r in df.select(caps.letters("m")).collect()] == [None, ""]


def test_edits_like_one_after_the_other(spark):
    import random

    from factlake.operators import rename

    rng = random.Random(4)
    files = [(f"f{i}", "".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    edits = [(f, a := rng.randint(0, 28), a + rng.randint(0, 6), rng.choice(["", "X", "YYY"])) for f, _ in files for _ in range(rng.randint(0, 6))]
    ties = {(f, a, b) for f, a, b, _ in edits}
    once = [next(e for e in edits if e[:3] == k) for k in sorted(ties)]
    want = {}
    for f, text in files:
        for a, b, x in sorted(((a, b, x) for g, a, b, x in once if g == f), key=lambda e: (-e[0], -e[1])):
            text = text[:a] + x + text[b:] if b <= len(text) else text
        want[f] = text
    got = rename.apply_edits(spark.createDataFrame(files, "file string, text string"), spark.createDataFrame(once, "file string, start int, end int, insert string"))
    assert {r.file: r.text for r in got.collect()} == want


def test_sites_in_several_ranges(spark):
    from factlake.operators import rename

    sites = spark.createDataFrame([("a", 5), ("a", 5), ("a", 50), ("b", 5)], "file string, lo int")
    ranges = spark.createDataFrame([("a", 0, 9, "impl X for Y"), ("a", 3, 7, "impl X for Z"), ("b", 0, 9, "impl Y")], "file string, lo int, hi int, label string")
    assert sorted(map(tuple, rename.in_trait_impl(sites, ranges).collect())) == [("a", 5, True), ("a", 5, True), ("a", 50, False), ("b", 5, False)]


def test_manifest_lints(spark):
    from factlake.operators import rename

    plain = '[package]\nname = "t"\n\n[dependencies]\n'
    text, n = rename.inject_lints(plain)
    assert n == rename.wanted_table(spark).count() == 40 and "[lints.clippy]" in text and 'manual_ok_err = "allow"' in text
    assert rename.inject_lints(text) == (text, 0)
    own, n = rename.inject_lints('[lints.clippy]\npanic = "deny"\ntodo = "warn"\n\n[dependencies]\nx = "1"\n')
    import tomllib

    found = tomllib.loads(own)
    assert n == 38 and found["lints"]["clippy"]["panic"] == "deny" and found["dependencies"] == {"x": "1"}
    for odd in ("not toml [", "lints = 3\n", "[lints]\nclippy = 1\n"):
        assert rename.inject_lints(odd) == (odd, 0)


def test_lints_read_their_own_tables_only(spark, sf_dir):
    from factlake.plans import queries

    plan = queries.queries()["lint_deny_warnings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "nation.parquet" in plan and not any(f"{t}.parquet" in plan for t in ("lineitem", "part", "customer", "supplier"))
