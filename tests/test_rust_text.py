from factlake.operators import rename
from factlake.sources import rust_text

TEXT = """use std::{fs, io::prelude::*, io::{self, Read as R}};
use a::b::*;

/// Says it.
/// # Safety
/// None.
#[allow(non_snake_case, dead_code)]
pub unsafe fn rvs_go_U(x: &mut u32, s: &str) -> u32 { // TODO "
    debug_assert!(*x > 0);
    let y = fs::read(s).ok(); /* fn no() {} */
    "fn text() {";
    'c'; helper::<u8>(y)
}
#[derive(Debug, Clone)]
pub struct S<'a> { a: &'a str }
enum MyError { #[x] Unknown, Other(u8), Io { a: u8 } }
impl<T> std::ops::Deref for S<'_> { fn deref(&self) -> &str { todo!() } }
trait Repo { fn need(&self); fn have(&self) {} }
mod tests { #[test] fn test_20260101_x() { rvs_go_U(1) } }
async fn only(v: u8) { debug_assert!(v > 0); }
"""


def test_scan():
    found = rust_text.scan(TEXT)
    assert [(u["path"], u["is_glob"]) for u in found["use_item"]] == [("std::fs", False), ("std::io::prelude", True), ("std::io::self", False), ("std::io::Read", False), ("a::b", True)]
    fn = {f["name"]: f for f in found["fn"]}
    assert list(fn) == ["rvs_go_U", "deref", "need", "have", "test_20260101_x", "only"]
    go = fn["rvs_go_U"]
    assert (go["is_pub"], go["is_unsafe_fn"], go["has_mut_param"], go["allows"], go["allows_non_snake_case"], go["doc"], go["lo_line"]) == (True, True, True, "non_snake_case,dead_code", True, "Says it.\n# Safety\nNone.", 8)
    assert go["body_snippet"].startswith("{ // TODO") and go["body_snippet"].endswith("}") and "deref" not in go["snippet"]
    assert (fn["deref"]["is_trait_impl"], fn["deref"]["is_stub"], fn["deref"]["kind"]) == (True, True, "impl")
    assert (fn["need"]["kind"], fn["need"]["has_body"], fn["have"]["kind"], fn["have"]["is_empty"]) == ("trait_required", False, "trait_provided", True)
    assert fn["test_20260101_x"]["is_test"] and fn["only"]["is_async"] and fn["only"]["only_asserts"]
    assert [(t["kind"], t["name"], t["has_debug"]) for t in found["type_item"]] == [("struct", "S", True), ("enum", "MyError", False)]
    assert [v["variant"] for v in found["variant"]] == ["Unknown", "Other", "Io"]
    assert [i["trait_name"] for i in found["impl_item"]] == ["Deref"]
    assert [(c["caller"], c["site_kind"], c["src_path"], c["method_ident"]) for c in found["call"]] == [("rvs_go_U", "call", "fs::read", None), ("rvs_go_U", "method", None, "ok"), ("rvs_go_U", "call", "helper", None), ("tests::test_20260101_x", "call", "rvs_go_U", None)]


def test_tables_and_rewrite(spark):
    files = spark.createDataFrame([("a.rs", TEXT), ("b.rs", None), ("c.rs", "fn broken( {{{")], "file string, text string")
    found = rust_text.extract(files)
    assert {(r.file, r.name) for r in rust_text.facts(found, "fn").collect()} >= {("a.rs", "rvs_go_U"), ("a.rs", "only")}
    assert rust_text.facts(found, "type_item").count() == 2
    plan = spark.createDataFrame([("rvs_go_U", "go"), ("only", "rvs_only_A")], "old_name string, new_name string")
    source = files.where("file = 'a.rs'")
    text = rename.apply_edits(source, rust_text.rewrite(source, plan)).first().text
    assert text == TEXT.replace("rvs_go_U", "go").replace("async fn only", "async fn rvs_only_A")


def test_lints_from_text(spark, tmp_path):
    from factlake.operators import check

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text(TEXT + "\nfn rvs_calls() { let _ = rvs_go_U(1); rvs_io_BI(); }\nfn rvs_io_BI() {}\n")
    facts = rust_text.as_facts(rust_text.read(spark, str(tmp_path)), "app")
    found = {(r.lint, r.message) for r in check.diagnostics(facts).collect()}
    assert found >= {
        ("call_violation", "{} → rvs_io_BI missing B(Blocking), I(IO)"),
        ("empty_fn", "empty function body"),
        ("missing_mutable", "&mut param but suffix lacks M"),
        ("error_swallow", ".ok() swallows errors"),
        ("catch_all_error", "catch-all variant 'Unknown' in MyError"),
        ("deref_polymorphism", "impl Deref — use composition instead of Deref polymorphism"),
        ("wildcard_import", "wildcard import: a::b::*"),
        ("dead_code", "rvs_ function marked #[allow(dead_code/unused)]"),
        ("missing_debug_derive", "type 'MyError' missing #[derive(Debug)]"),
        ("non_rvs_fn", "'only' missing rvs_ prefix"),
    }
    assert ("wildcard_import", "wildcard import: std::io::prelude::*") not in found and not any(m.endswith("missing /// # Safety") for _, m in found)


SHAPES = """#![deny(warnings, unused)]
#![allow(dead_code)]
use std::fmt;
static TABLE: [u8; 2] = [1, 2];
static mut COUNT: u32 = 0;
thread_local! { static LOCAL: Cell<u32> = Cell::new(0); }
#[derive(Debug)] pub struct Pair<'a> { pub name: &'a String, pub(crate) list: &mut Vec<u8>, n: (u8, u8) }
#[derive(Debug)] struct Tuple(pub &'static Vec<u8>, [u8; 4]);
pub trait OrderRepository { fn get(&self) -> u8; fn put(&mut self, x: u8) {} }
impl OrderRepository for Pair<'_> { fn get(&self) -> u8 { 1 } }
impl<T: fmt::Debug> Pair<'_> { pub fn rvs_size(&self, mut n: u32, (a, b): (u8, u8)) -> u32 { n } }
mod inner { pub mod deep { pub fn rvs_go_B(f: f64, s: &'static str) { debug_assert_eq!(f, s.len() as f64); rvs_go_B(1.0, "x"); } } }
pub fn rvs_validate_name(name: String, at: Option<&str>) -> Result<(), Failure<Reason>> { if (at == name) { return Ok(()) } unsafe { COUNT += 1 }; let f = &rvs_size_of; helper::<u8>(TABLE[0]) }
fn rvs_local(v: Box<dyn Fn(u8) -> u8>, w: &Box<u8>) -> Result<u8, (Reason, String)> where u8: Copy { LOCAL.with(|x| x.get()); todo(TABLE) }
fn helper<T>(t: T) {}
fn rvs_size_of() {}
"""


def test_shapes():
    found = rust_text.scan(SHAPES)
    get = lambda table, *names: [tuple(r[n] for n in names) for r in found[table]]
    assert get("crate_attr", "name", "args", "lo_line") == [("deny", "warnings,unused", 1), ("allow", "dead_code", 2)]
    assert get("static_item", "name", "is_mut", "is_thread_local") == [("TABLE", False, False), ("COUNT", True, False), ("LOCAL", False, True)]
    assert get("field", "type_name", "ty_last_ident", "is_ref", "is_mut") == [("Pair", "String", True, False), ("Pair", "Vec", True, True), ("Pair", None, False, False), ("Tuple", "Vec", True, False), ("Tuple", None, False, False)]
    paths = [p for (p,) in get("fn", "path")]
    assert paths == ["OrderRepository::get", "OrderRepository::put", "get@OrderRepository", "Pair::rvs_size", "inner::deep::rvs_go_B", "rvs_validate_name", "rvs_local", "helper", "rvs_size_of"]
    assert [p for p, port in get("fn", "path", "is_port_method") if port] == paths[:3]
    params = {(f, p): (t, l, r, m) for f, p, t, l, r, m in get("param", "fn", "pat", "ty", "ty_last_ident", "is_ref", "is_mut")}
    assert params["Pair::rvs_size", "n"] == ("u32", "u32", False, False) and params["Pair::rvs_size", None] == ("(u8, u8)", None, False, False)
    assert params["inner::deep::rvs_go_B", "s"] == ("&str", "str", True, False) and params["rvs_validate_name", "at"][:2] == ("Option", "Option")
    assert params["rvs_local", "v"][:2] == ("Box", "Box") and params["rvs_local", "w"] == ("&Box", "Box", True, False)
    returned = {p: x for p, *x in get("fn", "path", "ret_ty", "ret_ok", "ret_errs")}
    assert returned["rvs_validate_name"] == ["Result", "()", "Failure,Reason"] and returned["rvs_local"] == ["Result", "u8", ""] and returned["helper"] == [None, None, None]
    assert get("assert_ident", "fn", "ident") == [("inner::deep::rvs_go_B", x) for x in ("as", "f", "f64", "len", "s")]
    assert {(f, i) for f, i in get("body_ident", "fn", "ident")} == {("rvs_validate_name", "COUNT"), ("rvs_validate_name", "TABLE"), ("rvs_local", "LOCAL"), ("rvs_local", "TABLE")}
    calls = {(c, k, p or m) for c, k, p, m in get("call", "caller", "site_kind", "src_path", "method_ident")}
    assert calls >= {("rvs_validate_name", "call", "helper"), ("rvs_validate_name", "addr_of", "rvs_size_of"), ("rvs_local", "method", "with"), ("inner::deep::rvs_go_B", "call", "rvs_go_B")}
    assert not any(name in ("if", "return", "while") for _, _, name in calls)


def read(spark, tmp_path, **files):
    from factlake.operators import check

    for name, text in files.items():
        path = tmp_path / "src" / f"{name.replace('__', '/')}.rs"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    facts = rust_text.as_facts(rust_text.read(spark, str(tmp_path)), "app")
    return facts, check


def test_lints_on_shapes(spark, tmp_path):
    facts, check = read(spark, tmp_path, lib=SHAPES)
    found = {(r.lint, r.message) for r in check.diagnostics(facts).collect()}
    assert found >= {
        ("static_ref", "static ref requires {S, U} but fn has {} (missing S(SideEffect))"),
        ("static_ref", "static ref requires {S, T} but fn has {} (missing S(SideEffect), T(ThreadLocal))"),
        ("missing_debug_assert", "param 'n' missing debug_assert!"),
        ("borrowed_param", "&Box — use &T instead"),
        ("borrowed_param", "&String field — use &str instead"),
        ("deny_warnings", "#![deny(warnings)] — use named lints instead"),
        ("validate_returns_unit", "rvs_validate_name: validate returning Result<(),E> — use TryFrom returning Result<T,E>"),
        ("consumed_arg_on_error", "owned param 'name' consumed but not preserved in error type of rvs_validate_name"),
        ("missing_thread_local", "reads thread_local! but suffix lacks T"),
        ("missing_side_effect", "reads static but suffix lacks S"),
    }
    assert ("missing_debug_assert", "param 'f' missing debug_assert!") not in found


def test_equal_names_stay_apart(spark, tmp_path):
    other = "fn rvs_x() { }\n"
    facts, check = read(spark, tmp_path, lib="mod a;", a__mod="fn rvs_x() { rvs_y_B(); }\nfn rvs_y_B() {}\n", a__b=other, c=other)
    rows = check.lint(facts, "call_violation").collect()
    assert [(r.file.rpartition("/src/")[2], r.lo_line, r.message) for r in rows] == [("a/mod.rs", 1, "{} → rvs_y_B missing B(Blocking)")]
    assert {r.def_path for r in facts.fn.collect()} == {"app::a::rvs_x", "app::a::rvs_y_B", "app::a::b::rvs_x", "app::c::rvs_x"}


def test_inference_from_text(spark, tmp_path):
    from factlake.operators import infer

    facts, _ = read(spark, tmp_path, lib=SHAPES, io="pub fn run() { inner::deep::rvs_go_B(1.0, X); crate::rvs_validate_name(s, None) }")
    fn, edge = rust_text.call_graph(facts)
    masks = {r.def_path: r["mask"] for r in infer.infer(fn, edge, spark.createDataFrame([("app::helper", 2)], "key string, mask int")).collect()}
    assert masks["app::rvs_validate_name"] == 32 | 128 | 2 and masks["app::rvs_local"] == 32 | 64 and masks["app::io::run"] == 32 | 2
    assert masks["app::OrderRepository::get"] == 16


def test_long_sources_are_read_in_linear_time():
    import time

    def seconds(n):
        t = time.thread_time()
        assert len(rust_text.scan("/// Doc.\nfn f(a: u8) { g(a) }\n" * n)["fn"]) == n
        return time.thread_time() - t

    assert seconds(8000) < 24 * max(seconds(1000), 0.05)
