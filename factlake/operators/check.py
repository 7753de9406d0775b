"""Call checks and the lints over program facts: every one a filter, join or anti-join that gives diagnostics.

Facts (columns beyond these are ignored):
  fn: crate, file, def_path, name, kind (free, impl, trait_provided, trait_required), is_trait_impl, is_port_method, is_test,
      is_pub, is_async, is_unsafe_fn, has_mut_param, has_body, is_stub, is_empty, only_asserts, allows (names of allow and expect
      attributes, comma between), allows_non_snake_case, doc, ret_ty, ret_ok, ret_errs (type names, comma between), snippet,
      lo_line, lo_col
  call: caller, site_kind (call, method, addr_of), res_kind (Fn, AssocFn, Variant or null), callee_def_path, src_path,
      method_ident, lo_line, lo_col
  param: fn, pat, ty, ty_last_ident, is_ref, is_mut, lo_line, lo_col
  static_ref: fn, is_mut, is_thread_local, lo_line, lo_col         assert_ident: fn, ident
  use_item: file, path (segments, :: between), is_glob, lo_line, lo_col
  type_item: file, kind, name, has_debug, attrs (comma between), lo_line, lo_col
  field: type_name, file, ty_last_ident, is_ref, is_mut, lo_line, lo_col
  variant: type_name, file, variant, lo_line, lo_col
  impl_item: file, trait_name, lo_line, lo_col                      crate_attr: crate, file, name, args, lo_line, lo_col
  caps: key, mask                                                   snapshot: name
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions import caps

# Fixed values of the rules.
SPAWNERS = [
    "tokio::runtime::spawn",
    "tokio::task::spawn",
    "tokio::task::spawn_blocking",
    "tokio::task::spawn_local",
    "std::thread::functions::spawn",
    "std::thread::builder::spawn",
    "std::thread::builder::spawn_unchecked",
    "std::thread::lifecycle::spawn_unchecked",
    "async_std::task::spawn",
    "async_std::task::spawn_blocking",
    "smol::spawn",
]
REFLECTION = ["std::any::type_name", "std::any::type_id", "core::any::Any::type_id"]
SWALLOWING = ["ok", "unwrap_or_default"]
CATCH_ALL = ["Unknown", "Other", "UnknownError", "OtherError"]
VALIDATING = ["validate", "check", "verify"]
BORROWED = {"String": "&str", "Vec": "&[T]", "Box": "&T"}
BANNED = ["anyhow", "eyre", "color_eyre"]
NUMERIC = ["i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64"]
PORT_SUFFIXES = ["Repository", "Client"]
UNPREFIXED = ["main", "new", "go", "wblk"]


class Facts:
    """The fact tables by name, as attributes. With of(), each is made when a rule first asks for it, so that a rule's plan has
    its own tables only."""

    NAMES = ("fn", "call", "param", "static_ref", "assert_ident", "use_item", "type_item", "field", "variant", "impl_item", "crate_attr", "caps", "snapshot")

    def __init__(self, make: Callable[[str], DataFrame] | None = None, **tables: DataFrame):
        self._make, self._tables = make, tables

    @classmethod
    def of(cls, make: Callable[[str], DataFrame]) -> "Facts":
        return cls(make)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Facts.NAMES:
            raise AttributeError(name)
        if name not in self._tables:
            if self._make is None:
                raise AttributeError(f"no table {name}")
            self._tables[name] = self._make(name)
        return self._tables[name]


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _rows(df: DataFrame, message: Column) -> DataFrame:
    return df.select("file", "lo_line", "lo_col", message.alias("message"))


def _has_name(listed: str, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(listed, ","), F.array(*map(F.lit, names))), F.lit(False))


def _judged(facts: Facts) -> DataFrame:
    """All functions with their declared mask (port methods have P as well), written suffix, and whether they are checked."""
    own = caps.parsed_mask("name")
    fn = facts.fn.withColumn("mask", F.when(F.col("is_port_method"), caps.insert(own, "P")).otherwise(own)).withColumn("suffix", caps.raw_suffix("name"))
    kind = F.col("kind").isin("free", "trait_provided") | (F.col("kind") == "impl") & (~F.col("is_trait_impl") | F.col("is_port_method"))
    return fn.withColumn("checked", kind & F.col("mask").isNotNull())


def _checked(facts: Facts) -> DataFrame:
    return _judged(facts).where("checked")


def _bodies(facts: Facts) -> DataFrame:
    return _checked(facts).where("has_body AND NOT is_stub")


def port_traits(traits: DataFrame) -> DataFrame:
    """Rows of traits (name, ...) that are ports, by the end of their name."""
    return traits.where(reduce(lambda a, b: a | b, (F.col("name").endswith(s) for s in PORT_SUFFIXES)))


def call_edges(facts: Facts) -> DataFrame:
    """Each resolved call of a checked function: its own mask, and the mask that the callee's name, its def path or its source
    path has, whichever comes first. callee_mask NULL: unknown. by_name: the name decided.

    The dictionary is one equi-join on each path; Spark broadcasts it while it is small.
    """
    fn = _bodies(facts).select(F.col("def_path").alias("caller"), "file", F.col("mask").alias("caller_mask"))
    call = facts.call.where("site_kind IN ('call', 'method') AND res_kind IN ('Fn', 'AssocFn', 'Variant')")
    source = F.when(F.col("site_kind") == "method", F.col("method_ident")).otherwise(F.col("src_path"))
    call = call.select("caller", "callee_def_path", source.alias("src_path"), "lo_line", "lo_col")
    one = facts.caps.select(F.col("key").alias("callee_def_path"), F.col("mask").alias("by_def"))
    two = facts.caps.select(F.col("key").alias("src_path"), F.col("mask").alias("by_src"))
    named = caps.parsed_mask(caps.last_segment("callee_def_path"))
    out = call.join(fn, "caller").join(one, "callee_def_path", "left").join(two, "src_path", "left").withColumn("named", named)
    mask, by_name = F.coalesce("named", "by_def", "by_src").alias("callee_mask"), F.col("named").isNotNull().alias("by_name")
    return out.select("caller", "file", "caller_mask", "callee_def_path", "src_path", mask, by_name, "lo_line", "lo_col")


def _callee(edge_source: Column, path: Column) -> Column:
    return F.when(edge_source.isNull() | (edge_source == path), path).otherwise(_text(edge_source, " (", path, ")"))


def call_violation(facts: Facts) -> DataFrame:
    e = call_edges(facts).where(F.col("callee_mask").isNotNull() & ~caps.can_call("caller_mask", "callee_mask"))
    missing = caps.described(caps.missing_for("caller_mask", "callee_mask"))
    looked_up = _text(_callee(F.col("src_path"), F.col("callee_def_path")), " (", caps.display("callee_mask"), ")")
    shown = F.when(F.col("by_name"), caps.last_segment("callee_def_path")).otherwise(looked_up)
    return _rows(e, _text(caps.display("caller_mask"), " → ", shown, " missing ", missing))


def unknown_callee(facts: Facts) -> DataFrame:
    e = call_edges(facts).where("callee_mask IS NULL")
    same = F.col("src_path").isNull() | (F.col("src_path") == F.col("callee_def_path"))
    shown = F.when(same, _text("'", F.col("callee_def_path"), "'")).otherwise(_text("'", F.col("src_path"), "' (", F.col("callee_def_path"), ")"))
    return _rows(e, _text(shown, " not in capsmap"))


def _static_needs(facts: Facts) -> DataFrame:
    """Prefixed functions with a body that touch statics: what that needs, over all their references."""
    need = F.when(F.col("is_thread_local"), caps.mask_of("ST")).when(F.col("is_mut"), caps.mask_of("SU")).otherwise(caps.mask_of("S"))
    needs = facts.static_ref.groupBy(F.col("fn").alias("def_path")).agg(F.bit_or(need).alias("need"))
    return _bodies(facts).join(needs, "def_path")


def static_ref(facts: Facts) -> DataFrame:
    missing = caps.missing_for("mask", "need")
    hit = _static_needs(facts).where(missing != 0)
    return _rows(hit, _text("static ref requires ", caps.display("need"), " but fn has ", caps.display("mask"), " (missing ", caps.described(missing), ")"))


def missing_side_effect(facts: Facts) -> DataFrame:
    return _rows(_static_needs(facts).where(caps.contains("need", "S") & ~caps.contains("mask", "S")), F.lit("reads static but suffix lacks S"))


def missing_thread_local(facts: Facts) -> DataFrame:
    return _rows(_static_needs(facts).where(caps.contains("need", "T") & ~caps.contains("mask", "T")), F.lit("reads thread_local! but suffix lacks T"))


def _params(facts: Facts, fn: DataFrame) -> DataFrame:
    own = fn.select(F.col("def_path").alias("fn"), "file", "name", "ret_ty", "ret_ok", "ret_errs")
    return facts.param.join(own, "fn")


def missing_debug_assert(facts: Facts) -> DataFrame:
    hit = _params(facts, _bodies(facts)).where(F.col("ty").isin(NUMERIC) & F.col("pat").isNotNull())
    seen = facts.assert_ident.select("fn", F.col("ident").alias("pat")).distinct()
    return _rows(hit.join(seen, ["fn", "pat"], "left_anti"), _text("param '", F.col("pat"), "' missing debug_assert!"))


def _calls(facts: Facts, fn: DataFrame) -> DataFrame:
    return facts.call.join(fn.select(F.col("def_path").alias("caller"), "file", "is_test"), "caller")


def spawn_warning(facts: Facts) -> DataFrame:
    path = F.coalesce("callee_def_path", F.when(F.col("res_kind").isNull(), F.col("src_path")))
    hit = _calls(facts, _checked(facts)).where(path.isin(SPAWNERS) & ~F.col("is_test") & F.col("site_kind").isin("call", "method"))
    return _rows(hit, _text("spawn: ", path, F.when(F.col("site_kind") == "call", " — use structured concurrency").otherwise("")))


def reflection_usage(facts: Facts) -> DataFrame:
    path = F.coalesce("callee_def_path", F.when(F.col("res_kind").isNull(), F.col("src_path")))
    hit = _calls(facts, _checked(facts)).where(path.isin(REFLECTION) & F.col("site_kind").isin("call", "method"))
    return _rows(hit, F.lit("reflection — use trait dispatch instead"))


def catch_unwind(facts: Facts) -> DataFrame:
    name = F.when(F.col("site_kind") == "method", F.col("method_ident")).otherwise(caps.last_segment("callee_def_path"))
    return _rows(_calls(facts, _checked(facts)).where(name == "catch_unwind"), F.lit("catch_unwind — fix panic source instead"))


def error_swallow(facts: Facts) -> DataFrame:
    hit = _calls(facts, _checked(facts)).where(F.col("method_ident").isin(SWALLOWING) & (F.col("site_kind") == "method"))
    return _rows(hit, _text(".", F.col("method_ident"), "() swallows errors"))


def banned_import(facts: Facts) -> DataFrame:
    part = facts.use_item.select("file", "lo_line", "lo_col", F.explode(F.split("path", "::")).alias("segment"))
    return _rows(part.where(F.col("segment").isin(BANNED)), _text("banned import: ", F.col("segment")))


def wildcard_import(facts: Facts) -> DataFrame:
    hit = facts.use_item.where(F.col("is_glob") & (caps.last_segment("path") != "prelude") & (F.col("path") != "super"))
    return _rows(hit, _text("wildcard import: ", F.col("path"), "::*"))


def missing_debug_derive(facts: Facts) -> DataFrame:
    return _rows(facts.type_item.where("NOT has_debug"), _text("type '", F.col("name"), "' missing #[derive(Debug)]"))


def borrowed_param(facts: Facts) -> DataFrame:
    def message(what: str) -> Column:
        better = F.element_at(F.create_map(*(F.lit(x) for kv in BORROWED.items() for x in kv)), F.col("ty_last_ident"))
        return _text("&", F.col("ty_last_ident"), f"{what} — use ", better, " instead")

    plain = F.col("is_ref") & ~F.col("is_mut") & F.col("ty_last_ident").isin(*BORROWED)
    return _rows(_params(facts, _bodies(facts)).where(plain), message("")).union(_rows(facts.field.where(plain), message(" field")))


def into_impl(facts: Facts) -> DataFrame:
    return _rows(facts.impl_item.where("trait_name = 'Into'"), F.lit("impl Into — implement From instead (Into is auto-provided)"))


def deref_polymorphism(facts: Facts) -> DataFrame:
    return _rows(facts.impl_item.where("trait_name = 'Deref'"), F.lit("impl Deref — use composition instead of Deref polymorphism"))


def deny_warnings(facts: Facts) -> DataFrame:
    return _rows(facts.crate_attr.where((F.col("name") == "deny") & _has_name("args", "warnings")), F.lit("#![deny(warnings)] — use named lints instead"))


def catch_all_error(facts: Facts) -> DataFrame:
    enum = facts.type_item.where((F.col("kind") == "enum") & (F.col("name").contains("Error") | _has_name("attrs", "error")))
    names = enum.select(F.col("name").alias("type_name"), "file").distinct()
    hit = facts.variant.where(F.col("variant").isin(CATCH_ALL)).join(names, ["type_name", "file"], "left_semi")
    return _rows(hit, _text("catch-all variant '", F.col("variant"), "' in ", F.col("type_name")))


def consumed_arg_on_error(facts: Facts) -> DataFrame:
    owned = ~F.col("is_ref") & F.col("ty_last_ident").isNotNull()
    unit = (F.col("ret_ty") == "Result") & (F.col("ret_ok").isNull() | (F.col("ret_ok") == "()"))
    kept = F.coalesce(F.array_contains(F.split("ret_errs", ","), F.col("ty_last_ident")), F.lit(False))
    hit = _params(facts, _bodies(facts)).where(owned & unit & ~kept)
    return _rows(hit, _text("owned param '", F.col("pat"), "' consumed but not preserved in error type of ", F.col("name")))


def _tests(facts: Facts, strict: bool) -> DataFrame:
    """Functions whose names count as test names: all free functions, and test methods; with strict, tests only."""
    return facts.fn.where(F.col("is_test") if strict else F.col("is_test") | (F.col("kind") == "free"))


def missing_test_output(facts: Facts, strict_tests: bool = False) -> DataFrame:
    order = Window.partitionBy("crate", "name").orderBy("file", "lo_line", "lo_col")
    first = _tests(facts, strict_tests).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    hit = first.join(facts.snapshot.select("name").distinct(), "name", "left_anti")
    return _rows(hit, _text("test '", F.col("name"), "' missing test_out/", F.col("name"), ".out"))


def duplicate_test(facts: Facts, strict_tests: bool = False) -> DataFrame:
    tests = _tests(facts, strict_tests)
    twice = tests.groupBy("crate", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return _rows(tests.join(twice, ["crate", "name"]), _text("duplicate test '", F.col("name"), "'"))


def _untested(level: str, of: int) -> Callable[[Facts], DataFrame]:
    def run(facts: Facts) -> DataFrame:
        tests = facts.fn.where("is_test").select(F.col("def_path").alias("caller"))
        called = F.coalesce(caps.last_segment("callee_def_path"), F.col("method_ident"))
        called = facts.call.join(tests, "caller", "left_semi").select(called.alias("name")).where(F.col("name").startswith("rvs_")).distinct()
        fn = _checked(facts).where(caps.is_subset("mask", of) & ~F.col("is_test") & ~_has_name("allows", "dead_code", "unused"))
        return _rows(fn.join(called, "name", "left_anti"), _text(f"{level} fn '", F.col("name"), "' not called by any test"))

    return run


@dataclass(frozen=True)
class FnRule:
    """A rule that looks at one function: whether it is for checked functions only, when it holds, and what it says."""

    checked: bool
    holds: Callable[[], Column]
    says: Callable[[], Column]

    def __call__(self, facts: Facts) -> DataFrame:
        fn = _checked(facts) if self.checked else _judged(facts)
        return _rows(fn.where(self.holds()), self.says())


def _lacks(flag: str, letter: str, message: str) -> FnRule:
    return FnRule(True, lambda: F.col(flag) & ~caps.contains("mask", letter), lambda: F.lit(message))


def _has_todo() -> Column:
    def marked(line: Column) -> Column:
        line = F.regexp_replace(line, r"^\s+", "")
        low = F.lower(line)
        return (line.startswith("//") | line.startswith("/*")) & (low.contains("todo") | low.contains("fixme"))

    return (F.col("kind") == "free") & F.coalesce(F.exists(F.split("snippet", "\n"), marked), F.lit(False))


def _is_inherent() -> Column:
    return (F.col("kind") == "impl") & ~F.col("is_trait_impl")


def _lacks_safety_doc() -> Column:
    has = F.exists(F.split("doc", "\n"), lambda x: F.trim(x).startswith("# Safety"))
    return F.col("is_unsafe_fn") & ((F.col("kind") == "free") | _is_inherent() & F.col("is_pub")) & ~F.coalesce(has, F.lit(False))


def _validates() -> Column:
    first = F.lower(F.substring_index(caps.base_name("name"), "_", 1))
    return F.expr("has_body AND NOT is_stub") & first.isin(VALIDATING) & (F.col("ret_ty") == "Result") & (F.col("ret_ok") == "()")


def _is_unprefixed() -> Column:
    own = (F.col("kind") == "free") | _is_inherent()
    return F.col("mask").isNull() & ~F.col("is_test") & ~F.col("name").isin(UNPREFIXED) & own & F.col("name").rlike("^[a-z]")


def _lacks_doc() -> Column:
    own = (F.col("kind") == "free") | _is_inherent()
    return F.col("is_pub") & F.col("name").startswith("rvs_") & ~F.col("is_test") & F.col("doc").isNull() & own


def _unknown_letters() -> Column:
    return F.array_join(F.filter(F.split(caps.unknown_letters("name"), ""), lambda x: x != ""), ", ")


# The texts of diagnostics, here and above, are fixed values.
#: Rules that one scan of fn answers together.
FN_RULES: dict[str, FnRule] = {
    "stub_macro": FnRule(True, lambda: F.expr("has_body AND is_stub"), lambda: F.lit("stub: todo!()/unimplemented!()")),
    "empty_fn": FnRule(
        True,
        lambda: F.expr("has_body AND NOT is_stub AND (is_empty OR only_asserts)"),
        lambda: F.when(F.col("is_empty"), "empty function body").otherwise("function body contains only debug_assert!"),
    ),
    "missing_allow": FnRule(
        True,
        lambda: F.expr("suffix <> '' AND NOT allows_non_snake_case"),
        lambda: F.lit("uppercase suffix without #[allow(non_snake_case)]"),
    ),
    "non_rvs_fn": FnRule(False, _is_unprefixed, lambda: _text("'", F.col("name"), "' missing rvs_ prefix")),
    "missing_mutable": _lacks("has_mut_param", "M", "&mut param but suffix lacks M"),
    "missing_async": _lacks("is_async", "A", "async but suffix lacks A"),
    "missing_unsafe": _lacks("is_unsafe_fn", "U", "unsafe code but suffix lacks U"),
    "non_alphabetical_suffix": FnRule(True, lambda: F.col("suffix") != caps.sorted_letters("suffix"), lambda: F.lit("suffix not alphabetical")),
    "duplicate_suffix": FnRule(True, lambda: caps.first_repeated("suffix").isNotNull(), lambda: _text("duplicate '", caps.first_repeated("suffix"), "'")),
    "unknown_suffix_letter": FnRule(True, lambda: caps.unknown_letters("name") != "", lambda: _text("unknown letters: ", _unknown_letters())),
    "dead_code": FnRule(True, lambda: _has_name("allows", "dead_code", "unused"), lambda: F.lit("rvs_ function marked #[allow(dead_code/unused)]")),
    "test_name_format": FnRule(
        False,
        lambda: F.col("is_test") & ~caps.is_test_name("name"),
        lambda: _text("test '", F.col("name"), "' not test_YYYYMMDD_name"),
    ),
    "missing_doc": FnRule(False, _lacks_doc, lambda: _text("pub fn '", F.col("name"), "' missing /// doc comment")),
    "missing_safety_doc": FnRule(False, _lacks_safety_doc, lambda: F.lit("unsafe fn missing /// # Safety")),
    "validate_returns_unit": FnRule(True, _validates, lambda: _text(F.col("name"), ": validate returning Result<(),E> — use TryFrom returning Result<T,E>")),
    "todo_comment": FnRule(False, _has_todo, lambda: F.lit("TODO/FIXME comment found")),
}

#: Lint id: level and rule.
LINTS: dict[str, tuple[str, Callable[[Facts], DataFrame]]] = {
    "call_violation": ("deny", call_violation),
    "static_ref": ("deny", static_ref),
    "stub_macro": ("deny", FN_RULES["stub_macro"]),
    "empty_fn": ("deny", FN_RULES["empty_fn"]),
    "missing_debug_assert": ("warn", missing_debug_assert),
    "missing_allow": ("warn", FN_RULES["missing_allow"]),
    "non_rvs_fn": ("warn", FN_RULES["non_rvs_fn"]),
    "unknown_callee": ("warn", unknown_callee),
    "missing_mutable": ("warn", FN_RULES["missing_mutable"]),
    "missing_async": ("warn", FN_RULES["missing_async"]),
    "missing_unsafe": ("warn", FN_RULES["missing_unsafe"]),
    "missing_side_effect": ("warn", missing_side_effect),
    "missing_thread_local": ("warn", missing_thread_local),
    "non_alphabetical_suffix": ("warn", FN_RULES["non_alphabetical_suffix"]),
    "duplicate_suffix": ("warn", FN_RULES["duplicate_suffix"]),
    "unknown_suffix_letter": ("warn", FN_RULES["unknown_suffix_letter"]),
    "spawn_warning": ("warn", spawn_warning),
    "dead_code": ("warn", FN_RULES["dead_code"]),
    "test_name_format": ("warn", FN_RULES["test_name_format"]),
    "banned_import": ("warn", banned_import),
    "missing_debug_derive": ("warn", missing_debug_derive),
    "error_swallow": ("warn", error_swallow),
    "catch_unwind": ("warn", catch_unwind),
    "reflection_usage": ("warn", reflection_usage),
    "borrowed_param": ("warn", borrowed_param),
    "into_impl": ("warn", into_impl),
    "deref_polymorphism": ("warn", deref_polymorphism),
    "deny_warnings": ("warn", deny_warnings),
    "wildcard_import": ("warn", wildcard_import),
    "missing_doc": ("warn", FN_RULES["missing_doc"]),
    "missing_safety_doc": ("warn", FN_RULES["missing_safety_doc"]),
    "catch_all_error": ("warn", catch_all_error),
    "validate_returns_unit": ("warn", FN_RULES["validate_returns_unit"]),
    "consumed_arg_on_error": ("warn", consumed_arg_on_error),
    "todo_comment": ("warn", FN_RULES["todo_comment"]),
    "missing_test_output": ("warn", missing_test_output),
    "duplicate_test": ("warn", duplicate_test),
    "untested_good_fn": ("warn", _untested("good", caps.GOOD)),
    "untested_ok_fn": ("warn", _untested("ok", caps.OK)),
}


def lint(facts: Facts, name: str) -> DataFrame:
    """(lint, level, file, lo_line, lo_col, message) of one lint."""
    level, rule = LINTS[name]
    return rule(facts).select(F.lit(name).alias("lint"), F.lit(level).alias("level"), "file", "lo_line", "lo_col", "message")


def fn_diagnostics(facts: Facts, names: list[str]) -> DataFrame:
    """What the rules of FN_RULES with these names say, from one scan of fn."""
    found = []
    for n in names:
        rule, level = FN_RULES[n], LINTS[n][0]
        holds = F.col("checked") & rule.holds() if rule.checked else rule.holds()
        found.append(F.when(holds, F.struct(F.lit(n).alias("lint"), F.lit(level).alias("level"), rule.says().alias("message"))))
    out = _judged(facts).select("file", "lo_line", "lo_col", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return out.select("lint", "level", "file", "lo_line", "lo_col", "message")


def diagnostics(facts: Facts, names: list[str] | None = None) -> DataFrame:
    """All lints as one table. Rules about single functions share a scan; the others are plans of their own."""
    names = list(names or LINTS)
    shared = [n for n in names if n in FN_RULES]
    tables = [lint(facts, n) for n in names if n not in FN_RULES]
    return reduce(DataFrame.unionByName, ([fn_diagnostics(facts, shared)] if shared else []) + tables)


def failed(diagnostic: DataFrame) -> DataFrame:
    """(failed, n_deny, n_warn), one row: a run fails where any diagnostic denies."""
    deny = F.count_if(F.col("level") == "deny")
    return diagnostic.agg((deny > 0).alias("failed"), deny.alias("n_deny"), F.count_if(F.col("level") == "warn").alias("n_warn"))


def has_failed(diagnostic: DataFrame) -> bool:
    """Whether any diagnostic denies."""
    return not diagnostic.where("level = 'deny'").isEmpty()
