"""Queries of the engine over the facts of plans.facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import caps
from factlake.operators import check, infer, rename, report, why
from factlake.plans import facts as f
from factlake.plans.lineage import delete_at_exit, new_path
from factlake.sources import caps_text, facts_json, rust_text

Query = Callable[[SparkSession, str], DataFrame]


def _facts(spark: SparkSession, sf_dir: str, keep: bool = False) -> check.Facts:
    make = f.maker(spark, sf_dir, keep)
    return check.Facts.of(lambda name: make(f.FACTS[name]))


def _lint(name: str) -> Query:
    return lambda spark, sf_dir: check.lint(_facts(spark, sf_dir), name)


def _fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.maker(spark, sf_dir)(f.FN)


def parse_suffix(spark, sf_dir):
    return _fn(spark, sf_dir).select("k", "name", caps.parsed_mask("name").alias("mask"), caps.raw_suffix("name").alias("raw"), caps.letters(caps.parsed_mask("name")).alias("caps"))


def strip_name(spark, sf_dir):
    return _fn(spark, sf_dir).select("k", caps.base_name("name").alias("base"), caps.base_name("def_path").alias("path_base"))


def unknown_letters(spark, sf_dir):
    return _fn(spark, sf_dir).select("k", caps.unknown_letters("name").alias("unknown"))


def suffix_order(spark, sf_dir):
    raw = caps.raw_suffix("name")
    return _fn(spark, sf_dir).where(raw != "").select("k", caps.sorted_letters(raw).alias("sorted"), (caps.sorted_letters(raw) == raw).alias("in_order"), caps.first_repeated(raw).alias("repeated"))


def valid_test_name(spark, sf_dir):
    return _fn(spark, sf_dir).where("is_test").select("k", caps.is_test_name("name").alias("valid"))


def caps_algebra(spark, sf_dir):
    """Set algebra on pairs of masks: the part's size and the supplier of its order lines."""
    make = f.maker(spark, sf_dir)
    pairs = make("SELECT DISTINCT CAST((l_partkey * 37) % 256 AS INT) AS a, CAST((l_suppkey * 91) % 256 AS INT) AS b FROM {lineitem}")
    return pairs.select("a", "b", caps.can_call("a", "b").alias("can_call"), caps.missing_for("a", "b").alias("missing"), caps.is_subset("a", F.col("b")).alias("subset"), caps.display("a").alias("shown"), caps.described("b").alias("described"), caps.size("a").cast("int").alias("n"), caps.is_subset("a", caps.GOOD).alias("good"), caps.is_subset("a", caps.OK).alias("ok"))


_LAYER = "SELECT CASE WHEN c_custkey % 6 = 0 THEN 'std' WHEN c_custkey % 6 = 1 THEN 'deps' WHEN c_custkey % 6 = 2 THEN 'seed' WHEN c_custkey % 6 = 3 THEN 'suppress' WHEN c_custkey % 6 = 4 THEN 'ext' ELSE 'zoo' END AS layer, CAST(c_custkey AS INT) AS line, 'k::f' || CAST(c_nationkey * 3 + c_custkey % 3 AS STRING) AS key, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'ABI' WHEN c_custkey % 4 = 2 THEN 'S' ELSE 'UT' END AS caps_text FROM {customer}"


def caps_layer_merge(spark, sf_dir):
    return caps_text.merged(f.maker(spark, sf_dir)(_LAYER))


def caps_chosen_layers(spark, sf_dir):
    return caps_text.merged_layers(f.maker(spark, sf_dir)(_LAYER), ["ext", "seed", "nowhere"])


def caps_excluding_layers(spark, sf_dir):
    return caps_text.merged(caps_text.excluding(f.maker(spark, sf_dir)(_LAYER), ["deps", "ext"]))


def caps_lines(spark, sf_dir):
    return caps_text.formatted(caps_text.merged(f.maker(spark, sf_dir)(_LAYER)))


def caps_text_parse(spark, sf_dir):
    """Dictionary lines made of customers, with comments and errors."""
    sql = "SELECT CAST(c_custkey AS INT) AS line, CASE WHEN c_custkey % 7 = 0 THEN '# note' WHEN c_custkey % 7 = 1 THEN '  ' WHEN c_custkey % 7 = 2 THEN 'no sign' WHEN c_custkey % 7 = 3 THEN ' a::b#c = AB # why' WHEN c_custkey % 7 = 4 THEN 'x=AQ' ELSE 'f::g' || CAST(c_custkey AS STRING) || '=' || 'SB=' END AS text FROM {customer}"
    return caps_text.parsed(f.maker(spark, sf_dir)(sql)).select("line", "key", "mask", "error")


def _entries(spark, sf_dir) -> DataFrame:
    fn = _fn(spark, sf_dir).withColumn("mask", caps.parsed_mask("name")).where("mask IS NOT NULL")
    dead = F.coalesce(F.arrays_overlap(F.split("allows", ","), F.array(F.lit("dead_code"), F.lit("unused"))), F.lit(False))
    return fn.select("name", "mask", "lines", "is_test", dead.alias("allows_dead_code"))


def report_by_capability(spark, sf_dir):
    return report.report(_entries(spark, sf_dir))


def report_totals(spark, sf_dir):
    return report.totals(_entries(spark, sf_dir))


def report_text(spark, sf_dir):
    return report.report_text(_entries(spark, sf_dir))


def signature_caps(spark, sf_dir):
    fn = _fn(spark, sf_dir).withColumn("has_async", F.col("is_async"))
    return fn.select("k", caps.signature_mask().alias("mask"))


def _graph(spark, sf_dir, edges: str) -> DataFrame:
    make = f.maker(spark, sf_dir)
    node = make(f.NODE)
    flags = {"has_async": 1, "is_unsafe_fn": 128, "has_mut_param": 8}
    fn = node.select("def_path", *((F.col("own").bitwiseAND(b) != 0).alias(k) for k, b in flags.items()), *(F.lit(False).alias(k) for k in ("has_static_ref", "has_static_mut_ref", "has_thread_local_ref", "is_port_method")))
    # masks that no flag gives (B, I, S, T) come from leaves with a seed
    leaf = node.where(F.col("own").bitwiseAND(118) != 0).select(F.concat(F.lit("leaf"), F.col("own")).alias("key"), F.col("own").alias("mask")).distinct()
    extra = node.where(F.col("own").bitwiseAND(118) != 0).select(F.col("def_path").alias("caller"), F.concat(F.lit("leaf"), F.col("own")).alias("callee"))
    out = infer.infer(fn, make(edges).union(extra), leaf)
    return out.where(~F.col("def_path").startswith("leaf"))


def infer_closure(spark, sf_dir):
    return _graph(spark, sf_dir, f.ACYCLIC)


def infer_closure_cyclic(spark, sf_dir):
    return _graph(spark, sf_dir, f.CYCLIC)


def _impl(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    make = f.maker(spark, sf_dir)
    fn = make(f.IMPL)
    for flag in ("has_async", "has_static_mut_ref", "has_thread_local_ref"):
        fn = fn.withColumn(flag, F.lit(False))
    return fn, make(f.VOTING), make(f.SEED)


def impl_vote(spark, sf_dir):
    fn, _, _ = _impl(spark, sf_dir)
    return infer.impl_votes(fn, infer.signature_caps(fn))


def trait_aliases(spark, sf_dir):
    fn, _, _ = _impl(spark, sf_dir)
    return infer.trait_aliases(fn, infer.signature_caps(fn))


def infer_with_vote(spark, sf_dir):
    return infer.infer(*_impl(spark, sf_dir))


def _external(spark, sf_dir) -> DataFrame:
    fn, edge, seed = _impl(spark, sf_dir)
    more = f.maker(spark, sf_dir)("SELECT 'v::s' || CAST(s_suppkey AS STRING) AS caller, 'x::u' || CAST(s_suppkey % 9 AS STRING) AS callee FROM {supplier}")
    return infer.direct_external(fn, edge.union(more), seed, infer.signature_caps(fn), "v")


def direct_external_deps(spark, sf_dir):
    return infer.direct_deps(_external(spark, sf_dir))


def unknown_callee_report(spark, sf_dir):
    return infer.unknown_callees(_external(spark, sf_dir))


_STD_FN = "SELECT 'std::io::f' || CAST(s_suppkey AS STRING) AS def_path, s_suppkey % 4 = 0 AS is_unsafe_fn, s_suppkey % 6 = 0 AS has_static_ref FROM {supplier} UNION ALL SELECT 'shop::g' || CAST(n_nationkey AS STRING), false, false FROM {nation}"
_STD_EDGE = "SELECT DISTINCT 'std::io::f' || CAST(l_suppkey AS STRING) AS caller, CASE WHEN l_partkey % 3 = 0 THEN 'std::io::f' || CAST(l_partkey % 200 AS STRING) WHEN l_partkey % 3 = 1 THEN 'sys::k' || CAST(l_partkey % 40 AS STRING) ELSE 'shop::g' || CAST(l_partkey % 30 AS STRING) END AS callee FROM {lineitem}"
_STD_SEED = "SELECT 'sys::k' || CAST(p_partkey AS STRING) AS key, CAST(6 AS INT) AS mask FROM {part}"


def _std(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    make = f.maker(spark, sf_dir)
    fn = make(_STD_FN)
    for flag in ("has_async", "has_mut_param", "has_static_mut_ref", "has_thread_local_ref", "is_port_method"):
        fn = fn.withColumn(flag, F.lit(False))
    return infer.infer_std(fn, make(_STD_EDGE), make(_STD_SEED), "shop")


def infer_std(spark, sf_dir):
    return _std(spark, sf_dir)[0]


def unknown_std_callees(spark, sf_dir):
    return _std(spark, sf_dir)[1]


def rename_plan(spark, sf_dir):
    fn = _fn(spark, sf_dir)
    return rename.annotate_plan(fn, fn.select("def_path", (F.col("k") * 7 % 256).cast("int").alias("mask")), "shop")


def strip_plan(spark, sf_dir):
    return rename.strip_plan(_fn(spark, sf_dir))


def eligible_sites(spark, sf_dir):
    return rename.eligible_sites(_fn(spark, sf_dir).withColumn("is_in_trait_impl", F.col("is_trait_impl"))).select("k", "name")


_RANGES = "SELECT 'src/f' || CAST(s_suppkey % 7 AS STRING) || '.rs' AS file, CAST(s_suppkey * 150 AS INT) AS lo, CAST(s_suppkey * 150 + 60 AS INT) AS hi, CASE WHEN s_suppkey % 2 = 0 THEN 'impl A for B' ELSE 'impl A' END AS label FROM {supplier}"


def sites_in_trait_impl(spark, sf_dir):
    site = _fn(spark, sf_dir).select("k", "file", F.col("lo_line").alias("lo"))
    return rename.in_trait_impl(site, f.maker(spark, sf_dir)(_RANGES)).select("k", "is_in_trait_impl")


def local_files(spark, sf_dir):
    return rename.local_files(f.maker(spark, sf_dir)("SELECT CASE WHEN s_suppkey % 3 = 0 THEN '/w/src/f' WHEN s_suppkey % 3 = 1 THEN '/w2/src/f' ELSE '/w' END || CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE CAST(s_suppkey AS STRING) END AS file FROM {supplier}"), "/w/")


def wanted_lints(spark, sf_dir):
    make = f.maker(spark, sf_dir)
    return rename.wanted_lints(make("SELECT n_name AS name, 'warn' AS level FROM {nation}"), make("SELECT n_name AS name FROM {nation} WHERE n_nationkey % 3 = 0"))


def port_traits(spark, sf_dir):
    return check.port_traits(f.maker(spark, sf_dir)("SELECT c_name || CASE WHEN c_custkey % 4 = 0 THEN 'Repository' WHEN c_custkey % 4 = 1 THEN 'HttpClient' WHEN c_custkey % 4 = 2 THEN 'Clients' ELSE '' END AS name FROM {customer}"))


def why_callees(spark, sf_dir):
    fn, edge, seed = _impl(spark, sf_dir)
    known = infer.signature_caps(fn)
    return why.callees("v::s7", fn, edge, known, seed)


def why_candidates(spark, sf_dir):
    fn, _, _ = _impl(spark, sf_dir)
    return why.candidates("p1", fn, infer.signature_caps(fn))


def effective_lines(spark, sf_dir):
    """Documents as bodies, with line comments, strings that hold slashes, and block comments over lines among their lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def line(x, i):
        kinds = {1: '/* note */ "// text" ', 2: "// ", 3: "/* ", 4: "*/ "}
        out = x
        for k, before in kinds.items():
            out = F.when(i % 5 == k, F.concat(F.lit(before), x)).otherwise(out)
        return out

    return docs.select("doc_id", caps.effective_lines(F.concat(F.lit("{\n"), F.array_join(F.transform(F.split("text", "\n"), line), "\n"), F.lit("\n}"))).alias("lines"))


def all_diagnostics(spark, sf_dir):
    """Counts of every lint, from one plan over all facts, which are written first as many rules read each."""
    return check.diagnostics(_facts(spark, sf_dir, keep=True)).groupBy("lint", "level").agg(F.count("*").alias("n"))


def failed(spark, sf_dir):
    """Whether a run fails, for each crate attribute's file and over all: any diagnostic of level deny."""
    return check.failed(check.diagnostics(_facts(spark, sf_dir), ["call_violation", "deny_warnings", "stub_macro"]))


def report_empty(spark, sf_dir):
    return report.report_text(_entries(spark, sf_dir).where("lines < 0"))


def _folder(spark: SparkSession, name: str, write: Callable[[str], None]) -> str:
    """A folder of its own, written and removed when the driver ends."""
    path = new_path(spark, name)
    write(path)
    delete_at_exit(spark, path)
    return path


def report_round_trip(spark, sf_dir):
    """Report entries as JSON files of several crates, read back."""
    fn = _fn(spark, sf_dir).withColumn("mask", caps.parsed_mask("name")).where("mask IS NOT NULL")
    dead = F.coalesce(F.arrays_overlap(F.split("allows", ","), F.array(F.lit("dead_code"), F.lit("unused"))), F.lit(False))
    entries = fn.select(F.concat(F.lit("crate_"), F.col("k") % 3).alias("crate"), "name", caps.letters("mask").alias("caps"), "lines", "is_test", dead.alias("allows_dead_code"))
    return facts_json.read_report(spark, _folder(spark, "report", lambda path: facts_json.write_report(entries, path)))


def _graphs(spark, sf_dir) -> tuple[str, str]:
    """Two folders of call graphs: of implementations and suppliers, and of suppliers alone with another flag and fewer calls."""
    make = f.maker(spark, sf_dir)
    fn = make(f.IMPL)
    for flag in ("has_async", "has_static_mut_ref", "has_thread_local_ref", "is_trait_impl", "is_test"):
        fn = fn.withColumn(flag, F.lit(False))
    edge = make(f.VOTING)
    own = fn.where("def_path LIKE 'v::s%'").withColumn("has_async", F.lit(True))
    more = own.select(F.col("def_path").alias("caller"), F.lit("w::more").alias("callee"))
    first = _folder(spark, "graph", lambda path: facts_json.write_callgraph(fn, edge, path))
    return first, _folder(spark, "graph", lambda path: facts_json.write_callgraph(own, more, path))


def _shown_graph(fn: DataFrame, edge: DataFrame) -> DataFrame:
    calls = edge.groupBy(F.col("caller").alias("def_path")).agg(F.count("*").alias("n_calls"), F.min("callee").alias("first_call"))
    return fn.join(calls, "def_path", "left").select("def_path", "has_async", "is_unsafe_fn", "is_port_method", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), "first_call")


def callgraph_merge(spark, sf_dir):
    """Call graphs of two folders as JSON files, read back and merged: calls united, flags or-ed."""
    first, second = (facts_json.read_callgraph(spark, x) for x in _graphs(spark, sf_dir))
    return _shown_graph(*facts_json.merged(first.unionByName(second)))


def callgraph_cached(spark, sf_dir):
    """The same folders as caches: functions of the second replace those of the first."""
    return _shown_graph(*facts_json.read_cached(spark, *_graphs(spark, sf_dir)))


def caps_tabs(spark, sf_dir):
    """Dictionary lines with white space of all kinds around keys and letters."""
    sql = "SELECT CAST(c_custkey AS INT) AS line, CASE WHEN c_custkey % 4 = 0 THEN chr(9) || 'a' || CAST(c_custkey AS STRING) || chr(9) || '=' || chr(9) || 'AB' || chr(13) WHEN c_custkey % 4 = 1 THEN ' b' || CAST(c_custkey AS STRING) || ' =S' || chr(9) || '# B' WHEN c_custkey % 4 = 2 THEN chr(9) || '# x=A' ELSE 'c=' || chr(12) END AS text FROM {customer}"
    return caps_text.parsed(f.maker(spark, sf_dir)(sql)).select("line", "key", "mask", "error")


def caps_file(spark, sf_dir):
    """A merged dictionary written as text and read back from its folder."""
    masks = caps_text.merged(f.maker(spark, sf_dir)(_LAYER))
    return caps_text.read(spark, _folder(spark, "caps", lambda path: caps_text.write(masks, path))).select("key", "mask")


def apply_edits(spark, sf_dir):
    """Documents after three edits each; those that reach over a text's end are passed over."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    edits = F.array(*(F.struct(F.lit(at).alias("start"), F.lit(at + 3).alias("end"), F.lit(x).alias("insert")) for at, x in ((0, "<zero>"), (40, "<one>"), (900, "<two>"))))
    return rename.apply_edits(docs, docs.select("file", F.inline(edits)))


def why_text(spark, sf_dir):
    fn, edge, seed = _impl(spark, sf_dir)
    return why.why("v::s7", fn, edge, infer.signature_caps(fn), seed)


def sql_functions(spark, sf_dir):
    """The SQL functions, asked from SQL."""
    caps.register(spark)
    fn = _fn(spark, sf_dir)
    return spark.sql("SELECT k, caps_suffix(name) AS suffix, caps_parse(caps_suffix(name)) AS mask, caps_format(CAST(k % 256 AS INT)) AS letters, missing_caps(CAST(k % 256 AS INT), 127) AS missing, can_call(CAST(k % 256 AS INT), 100) AS can_call, caps_subset(CAST(k % 256 AS INT), 59) AS subset FROM {fn}", fn=fn)


# A source file for each supplier: a function with flags by its number, one it calls, a static, a type and an impl.
_SOURCE = """SELECT '/w/src/m' || CAST(s_suppkey AS STRING) || '.rs' AS file, s_suppkey AS s,
    'use std::fs;' || chr(10) || CASE WHEN s_suppkey % 4 = 0 THEN 'static mut ' ELSE 'static ' END || 'S' || CAST(s_suppkey AS STRING) || ': u32 = 1;' || chr(10)
    || '/// Says it.' || chr(10) || 'pub ' || CASE WHEN s_suppkey % 2 = 0 THEN 'async ' ELSE '' END || 'fn rvs_f' || CAST(s_suppkey AS STRING) || '_B(a: ' || CASE WHEN s_suppkey % 3 = 0 THEN '&mut u32' WHEN s_suppkey % 3 = 1 THEN '&String' ELSE 'u8' END
    || ', b: Order) -> Result<(), Vec<Error>> {{' || chr(10) || '    debug_assert!(' || CASE WHEN s_suppkey % 5 = 0 THEN 'a' ELSE 'c' END || ' > 0);' || chr(10)
    || '    help' || CAST(s_suppkey AS STRING) || '(S' || CAST(s_suppkey + 1 AS STRING) || ').ok();' || chr(10) || '}}' || chr(10)
    || 'fn help' || CAST(s_suppkey AS STRING) || '() {{}}' || chr(10) || 'struct T {{ x: &String, y: Vec<u8> }}' || chr(10)
    || 'impl T {{ fn new(&self) {{ rvs_f' || CAST(s_suppkey AS STRING) || '_B(1, 2) }} }}' || chr(10) AS text FROM {supplier}"""


def _sources(spark, sf_dir) -> DataFrame:
    return rust_text.extract(f.maker(spark, sf_dir)(_SOURCE))


def source_functions(spark, sf_dir):
    facts = rust_text.as_facts(_sources(spark, sf_dir), "app")
    return facts.fn.select("file", "def_path", "name", "kind", "is_pub", "is_async", "has_mut_param", "doc", "ret_ty", "ret_ok", "ret_errs", "lo_line")


def source_params(spark, sf_dir):
    return rust_text.as_facts(_sources(spark, sf_dir), "app").param.select("fn", "pat", "ty", "ty_last_ident", "is_ref", "is_mut")


def source_graph(spark, sf_dir):
    """The call graph of sources: each function's flags and its callees."""
    fn, edge = rust_text.call_graph(rust_text.as_facts(_sources(spark, sf_dir), "app"))
    return fn.join(edge, fn["def_path"] == edge["caller"], "left").select("def_path", "has_async", "has_mut_param", "has_static_ref", "has_static_mut_ref", "callee")


def source_diagnostics(spark, sf_dir):
    """What some lints say about sources."""
    facts = rust_text.as_facts(_sources(spark, sf_dir), "app")
    names = ["static_ref", "missing_debug_assert", "missing_async", "missing_mutable", "borrowed_param", "consumed_arg_on_error", "error_swallow", "missing_debug_derive", "empty_fn", "call_violation"]
    return check.diagnostics(facts, names).groupBy("lint", "message").agg(F.count("*").alias("n"))


def source_renames(spark, sf_dir):
    """Sources after every prefixed function has lost prefix and suffix."""
    sources = f.maker(spark, sf_dir)(_SOURCE)
    facts = rust_text.as_facts(rust_text.extract(sources), "app")
    return rename.apply_edits(sources, rust_text.rewrite(sources, rename.strip_plan(facts.fn)))


def queries() -> dict[str, Query]:
    own = [parse_suffix, strip_name, unknown_letters, suffix_order, valid_test_name, caps_algebra, caps_layer_merge, caps_chosen_layers, caps_excluding_layers, caps_lines, caps_text_parse, report_by_capability, report_totals, report_text, signature_caps, infer_closure, infer_closure_cyclic, impl_vote, trait_aliases, infer_with_vote, direct_external_deps, unknown_callee_report, infer_std, unknown_std_callees, rename_plan, strip_plan, eligible_sites, sites_in_trait_impl, local_files, wanted_lints, port_traits, why_callees, why_candidates, effective_lines, all_diagnostics]
    own += [failed, report_empty, report_round_trip, callgraph_merge, callgraph_cached, caps_tabs, caps_file, apply_edits, why_text, sql_functions, source_functions, source_params, source_graph, source_diagnostics, source_renames]
    return {q.__name__: q for q in own} | {f"lint_{name}": _lint(name) for name in check.LINTS} | {"call_violation": _lint("call_violation")}
