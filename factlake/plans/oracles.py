"""The queries of plans.queries as SQL that DuckDB runs over the same tables."""

from __future__ import annotations

from factlake.functions.caps import BIT, CAPABILITIES
from factlake.operators import check
from factlake.plans import facts as f
from factlake.plans import queries as q

_P = "118"  # what callees pass on


def _shown(m: str) -> str:
    parts = ", ".join(f"CASE WHEN ({m} & {b}) <> 0 THEN '{x}' END" for x, b in BIT.items())
    return f"('{{' || concat_ws(', ', {parts}) || '}}')"


def _described(m: str) -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN ({m} & {BIT[x]}) <> 0 THEN '{x}({d})' END" for x, d in CAPABILITIES) + ")"


def _names(m: str) -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN ({m} & {BIT[x]}) <> 0 THEN '{d}' END" for x, d in CAPABILITIES) + ")"


def _suffix(n: str) -> str:
    return f"CASE WHEN starts_with({n}, 'rvs_') THEN regexp_extract({n}, '^rvs_(?:.*)_([A-Z]+)$', 1) END"


def _last(p: str) -> str:
    return f"regexp_extract({p}, '([^:]*)$', 1)"


def _own(p: str) -> str:
    return f"CASE WHEN starts_with({p}, 'rvs_') THEN {p} WHEN starts_with({_last(p)}, 'rvs_') THEN {_last(p)} END"


def _mask(p: str) -> str:
    """Declared mask of a name or path."""
    s = _suffix(f"({_own(p)})")
    return f"CASE WHEN ({_own(p)}) IS NOT NULL THEN {f.parsed(f'({s})')} END"


def _base(p: str) -> str:
    o = f"({_own(p)})"
    return f"CASE WHEN {o} IS NULL THEN NULL WHEN ({_suffix(o)}) = '' THEN substr({o}, 5) ELSE substr({o}, 5, length({o}) - 5 - length({_suffix(o)})) END"


def _t(name: str) -> str:
    return f"({f.plain(f.FACTS[name])})"


FN = f"({f.plain(f.FN)})"
_CHECKED = f"""(SELECT *, CAST(CASE WHEN is_port_method THEN pm | 16 ELSE pm END AS INT) AS mask FROM (SELECT *, {_mask('name')} AS pm, {_suffix('name')} AS suffix FROM {FN} a
    WHERE kind = 'free' OR kind = 'trait_provided' OR (kind = 'impl' AND (NOT is_trait_impl OR is_port_method))) b WHERE pm IS NOT NULL)"""
_BODIES = f"(SELECT * FROM {_CHECKED} c WHERE has_body AND NOT is_stub)"
_EDGES = f"""(SELECT c.caller, b.file, b.mask AS caller_mask, c.callee_def_path, c.src, {_mask(_last('c.callee_def_path'))} AS named, d.mask AS by_def, e.mask AS by_src, c.lo_line, c.lo_col
    FROM (SELECT *, CASE WHEN site_kind = 'method' THEN method_ident ELSE src_path END AS src FROM {_t('call')} x WHERE site_kind IN ('call', 'method') AND res_kind IN ('Fn', 'AssocFn', 'Variant')) c
    JOIN {_BODIES} b ON b.def_path = c.caller LEFT JOIN {_t('caps')} d ON d.key = c.callee_def_path LEFT JOIN {_t('caps')} e ON e.key = c.src)"""
_NEEDS = f"""(SELECT b.*, n.need FROM {_BODIES} b JOIN (SELECT fn, bit_or(CASE WHEN is_thread_local THEN 96 WHEN is_mut THEN 160 ELSE 32 END) AS need FROM {_t('static_ref')} s GROUP BY fn) n ON n.fn = b.def_path)"""
_CALLS = f"(SELECT c.*, k.file, k.is_test FROM {_t('call')} c JOIN {_CHECKED} k ON k.def_path = c.caller)"
_PARAMS = f"(SELECT p.*, k.file, k.name, k.ret_ty, k.ret_ok, k.ret_errs, k.def_path FROM {_t('param')} p JOIN {_BODIES} k ON k.def_path = p.fn)"
_TESTS = f"(SELECT * FROM {FN} a WHERE is_test OR kind = 'free')"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _has(listed: str, *names: str) -> str:
    return "coalesce(" + " OR ".join(f"list_contains(string_split({listed}, ','), '{n}')" for n in names) + ", false)"


def _untested(level: str, allowed: int) -> tuple[str, str]:
    called = f"SELECT regexp_extract(c.callee_def_path, '([^:]*)$', 1) FROM {_t('call')} c JOIN {FN} t ON t.def_path = c.caller WHERE t.is_test AND c.callee_def_path IS NOT NULL"
    return f"{_CHECKED} a WHERE (mask & ~{allowed}) = 0 AND NOT is_test AND NOT {_has('allows', 'dead_code', 'unused')} AND name NOT IN ({called})", f"'{level} fn ''' || name || ''' not called by any test'"


_MISS = f"(callee_mask & {_P} & ~caller_mask)"
_KNOWN = f"(SELECT *, coalesce(named, by_def, by_src) AS callee_mask FROM {_EDGES} e)"
_BETTER = "CASE ty_last_ident WHEN 'String' THEN '&str' WHEN 'Vec' THEN '&[T]' ELSE '&T' END"
_BORROWED = "is_ref AND NOT is_mut AND ty_last_ident IN ('String', 'Vec', 'Box')"
_PATH = "coalesce(callee_def_path, CASE WHEN res_kind IS NULL THEN src_path END)"
_LINE = r"regexp_matches(lower(snippet), '(?m)^\s*(//|/\*).*(todo|fixme)')"

#: Lint: FROM ... WHERE, and message.
_LINTS = {
    "call_violation": (f"{_KNOWN} a WHERE callee_mask IS NOT NULL AND {_MISS} <> 0", f"{_shown('caller_mask')} || ' → ' || CASE WHEN named IS NOT NULL THEN {_last('callee_def_path')} ELSE CASE WHEN src IS NULL OR src = callee_def_path THEN callee_def_path ELSE src || ' (' || callee_def_path || ')' END || ' (' || {_shown('callee_mask')} || ')' END || ' missing ' || {_described(_MISS)}"),
    "unknown_callee": (f"{_KNOWN} a WHERE callee_mask IS NULL", "CASE WHEN src IS NULL OR src = callee_def_path THEN '''' || callee_def_path || '''' ELSE '''' || src || ''' (' || callee_def_path || ')' END || ' not in capsmap'"),
    "static_ref": (f"{_NEEDS} a WHERE (need & {_P} & ~mask) <> 0", f"'static ref requires ' || {_shown('need')} || ' but fn has ' || {_shown('mask')} || ' (missing ' || {_described(f'(need & {_P} & ~mask)')} || ')'"),
    "missing_side_effect": (f"{_NEEDS} a WHERE (need & 32) <> 0 AND (mask & 32) = 0", "'reads static but suffix lacks S'"),
    "missing_thread_local": (f"{_NEEDS} a WHERE (need & 64) <> 0 AND (mask & 64) = 0", "'reads thread_local! but suffix lacks T'"),
    "stub_macro": (f"{_CHECKED} a WHERE has_body AND is_stub", "'stub: todo!()/unimplemented!()'"),
    "empty_fn": (f"{_CHECKED} a WHERE has_body AND NOT is_stub AND (is_empty OR only_asserts)", "CASE WHEN is_empty THEN 'empty function body' ELSE 'function body contains only debug_assert!' END"),
    "missing_debug_assert": (f"{_PARAMS} a WHERE ty IN {_in(check.NUMERIC)} AND pat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_t('assert_ident')} i WHERE i.fn = a.fn AND i.ident = a.pat)", "'param ''' || pat || ''' missing debug_assert!'"),
    "missing_allow": (f"{_CHECKED} a WHERE suffix <> '' AND NOT allows_non_snake_case", "'uppercase suffix without #[allow(non_snake_case)]'"),
    "non_rvs_fn": (f"{FN} a WHERE NOT starts_with(name, 'rvs_') AND NOT is_test AND name NOT IN {_in(check.UNPREFIXED)} AND kind IN ('free', 'impl') AND NOT is_trait_impl AND regexp_matches(name, '^[a-z]')", "'''' || name || ''' missing rvs_ prefix'"),
    "missing_mutable": (f"{_CHECKED} a WHERE has_mut_param AND (mask & 8) = 0", "'&mut param but suffix lacks M'"),
    "missing_async": (f"{_CHECKED} a WHERE is_async AND (mask & 1) = 0", "'async but suffix lacks A'"),
    "missing_unsafe": (f"{_CHECKED} a WHERE is_unsafe_fn AND (mask & 128) = 0", "'unsafe code but suffix lacks U'"),
    "non_alphabetical_suffix": (f"{_CHECKED} a WHERE suffix <> array_to_string(list_sort(string_split(suffix, '')), '')", "'suffix not alphabetical'"),
    "duplicate_suffix": (f"(SELECT *, list_filter(range(2, length(suffix) + 1), lambda i: contains(substr(suffix, 1, i - 1), substr(suffix, i, 1))) AS places FROM {_CHECKED} b) a WHERE len(places) > 0", "'duplicate ''' || substr(suffix, places[1], 1) || ''''"),
    "unknown_suffix_letter": (f"(SELECT *, regexp_replace(suffix, '[ABIMPSTU]', '', 'g') AS u FROM {_CHECKED} b) a WHERE u <> ''", "'unknown letters: ' || array_to_string(list_filter(string_split(u, ''), lambda x, i: list_position(string_split(u, ''), x) = i), ', ')"),
    "spawn_warning": (f"{_CALLS} a WHERE {_PATH} IN {_in(check.SPAWNERS)} AND NOT is_test AND site_kind IN ('call', 'method')", f"'spawn: ' || {_PATH} || CASE WHEN site_kind = 'call' THEN ' — use structured concurrency' ELSE '' END"),
    "reflection_usage": (f"{_CALLS} a WHERE {_PATH} IN {_in(check.REFLECTION)} AND site_kind IN ('call', 'method')", "'reflection — use trait dispatch instead'"),
    "catch_unwind": (f"{_CALLS} a WHERE CASE WHEN site_kind = 'method' THEN method_ident ELSE {_last('callee_def_path')} END = 'catch_unwind'", "'catch_unwind — fix panic source instead'"),
    "error_swallow": (f"{_CALLS} a WHERE method_ident IN {_in(check.SWALLOWING)} AND site_kind = 'method'", "'.' || method_ident || '() swallows errors'"),
    "dead_code": (f"{_CHECKED} a WHERE {_has('allows', 'dead_code', 'unused')}", "'rvs_ function marked #[allow(dead_code/unused)]'"),
    "test_name_format": (f"{FN} a WHERE is_test AND NOT regexp_matches(name, '^test_[0-9]{{8}}_[A-Za-z0-9_]+$')", "'test ''' || name || ''' not test_YYYYMMDD_name'"),
    "banned_import": (f"(SELECT file, lo_line, lo_col, unnest(string_split(path, '::')) AS seg FROM {_t('use_item')} u) a WHERE seg IN {_in(check.BANNED)}", "'banned import: ' || seg"),
    "wildcard_import": (f"{_t('use_item')} a WHERE is_glob AND NOT (path = 'prelude' OR path LIKE '%::prelude') AND path <> 'super'", "'wildcard import: ' || path || '::*'"),
    "missing_debug_derive": (f"{_t('type_item')} a WHERE NOT has_debug", "'type ''' || name || ''' missing #[derive(Debug)]'"),
    "borrowed_param": (f"(SELECT file, lo_line, lo_col, '' AS what, ty_last_ident FROM {_PARAMS} p WHERE {_BORROWED} UNION ALL SELECT file, lo_line, lo_col, ' field', ty_last_ident FROM {_t('field')} g WHERE {_BORROWED}) a WHERE true", f"'&' || ty_last_ident || what || ' — use ' || {_BETTER} || ' instead'"),
    "into_impl": (f"{_t('impl_item')} a WHERE trait_name = 'Into'", "'impl Into — implement From instead (Into is auto-provided)'"),
    "deref_polymorphism": (f"{_t('impl_item')} a WHERE trait_name = 'Deref'", "'impl Deref — use composition instead of Deref polymorphism'"),
    "deny_warnings": (f"{_t('crate_attr')} a WHERE name = 'deny' AND {_has('args', 'warnings')}", "'#![deny(warnings)] — use named lints instead'"),
    "missing_doc": (f"{FN} a WHERE is_pub AND starts_with(name, 'rvs_') AND NOT is_test AND doc IS NULL AND (kind = 'free' OR (kind = 'impl' AND NOT is_trait_impl))", "'pub fn ''' || name || ''' missing /// doc comment'"),
    "missing_safety_doc": (f"{FN} a WHERE is_unsafe_fn AND (kind = 'free' OR (kind = 'impl' AND NOT is_trait_impl AND is_pub)) AND NOT coalesce(regexp_matches(doc, '(?m)^ *# Safety'), false)", "'unsafe fn missing /// # Safety'"),
    "catch_all_error": (f"{_t('variant')} a WHERE variant IN {_in(check.CATCH_ALL)} AND type_name IN (SELECT name FROM {_t('type_item')} y WHERE kind = 'enum' AND (contains(name, 'Error') OR {_has('attrs', 'error')}))", "'catch-all variant ''' || variant || ''' in ' || type_name"),
    "validate_returns_unit": (f"{_BODIES} a WHERE lower(string_split({_base('name')}, '_')[1]) IN {_in(check.VALIDATING)} AND ret_ty = 'Result' AND ret_ok = '()'", "name || ': validate returning Result<(),E> — use TryFrom returning Result<T,E>'"),
    "consumed_arg_on_error": (f"{_PARAMS} a WHERE NOT is_ref AND ty_last_ident IS NOT NULL AND ret_ty = 'Result' AND (ret_ok IS NULL OR ret_ok = '()') AND NOT coalesce(list_contains(string_split(ret_errs, ','), ty_last_ident), false)", "'owned param ''' || pat || ''' consumed but not preserved in error type of ' || name"),
    "todo_comment": (f"{FN} a WHERE kind = 'free' AND {_LINE}", "'TODO/FIXME comment found'"),
    "missing_test_output": (f"(SELECT *, row_number() OVER (PARTITION BY crate, name ORDER BY file, lo_line, lo_col) AS nth FROM {_TESTS} b) a WHERE nth = 1 AND name NOT IN (SELECT name FROM {_t('snapshot')} s)", "'test ''' || name || ''' missing test_out/' || name || '.out'"),
    "duplicate_test": (f"(SELECT *, count(*) OVER (PARTITION BY crate, name) AS n FROM {_TESTS} b) a WHERE n > 1", "'duplicate test ''' || name || ''''"),
    "untested_good_fn": _untested("good", 11),
    "untested_ok_fn": _untested("ok", 27),
}


def _lint(name: str) -> str:
    source, message = _LINTS[name]
    return f"SELECT '{name}' AS lint, '{check.LINTS[name][0]}' AS level, file, lo_line, lo_col, {message} AS message FROM {source}"


_ENTRIES = f"(SELECT name, mask, lines FROM (SELECT *, {_mask('name')} AS mask FROM {FN} a) b WHERE mask IS NOT NULL AND NOT is_test AND NOT {_has('allows', 'dead_code', 'unused')})"
_ROWS = [("(ok)", "(mask & ~27) = 0", True), ("(good)", "(mask & ~11) = 0", True), ("(pure)", "mask = 0", True)] + [(f"{x}({d})", f"(mask & {BIT[x]}) <> 0", False) for x, d in CAPABILITIES]
_REPORT = " UNION ALL ".join(f"SELECT '{l}' AS label, count(*) AS fn_count, CAST(coalesce(sum(lines), 0) AS BIGINT) AS line_count, {k} AS ord, {str(a).lower()} AS always FROM {_ENTRIES} e WHERE {w}" for k, (l, w, a) in enumerate(_ROWS))
_TOTAL = f"(SELECT CAST(coalesce(sum(lines), 0) AS BIGINT) FROM {_ENTRIES} e)"
_REPORTED = f"""SELECT label, fn_count, line_count, CAST(round(line_count / {_TOTAL}::DOUBLE * 1000) AS BIGINT) AS pct, CAST(round(line_count / {_TOTAL}::DOUBLE * 30) AS INT) AS bar_len,
    CAST(row_number() OVER (ORDER BY line_count DESC, ord) AS INT) AS position FROM ({_REPORT}) r WHERE always OR fn_count > 0"""
_TEXT = f"""SELECT CAST(0 AS INT) AS position, 'Capability Report' AS line UNION ALL SELECT 1, repeat('-', 60) UNION ALL SELECT 3, repeat('-', 60)
    UNION ALL SELECT 2, 'Total: ' || (SELECT count(*) FROM {_ENTRIES} e) || ' functions, ' || {_TOTAL} || ' lines'
    UNION ALL SELECT position + 4, '  ' || rpad(label, greatest(12, length(label))::INT, ' ') || ' ' || lpad(fn_count::VARCHAR, greatest(5, length(fn_count::VARCHAR))::INT, ' ') || ' fns ' || lpad(line_count::VARCHAR, greatest(6, length(line_count::VARCHAR))::INT, ' ') || ' lines '
        || lpad((pct // 10)::VARCHAR || '.' || (pct % 10)::VARCHAR, 6, ' ') || '% |' || repeat('█', bar_len) || repeat('░', 30 - bar_len) || '|' FROM ({_REPORTED}) x"""


def _merge(where: str, order: str) -> str:
    return f"SELECT key, {f.parsed('caps_text')} AS mask FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order} DESC, layer DESC, line DESC) AS nth FROM ({f.plain(q._LAYER)}) e WHERE {where}) m WHERE nth = 1"


_PRIORITY = "CASE layer WHEN 'std' THEN 0 WHEN 'deps' THEN 1 WHEN 'seed' THEN 2 WHEN 'suppress' THEN 3 WHEN 'ext' THEN 4 ELSE 5 END"


def _closure(edges: str) -> str:
    bits = " UNION ALL ".join(f"SELECT {b} AS b" for b in BIT.values())
    return f"""WITH RECURSIVE node AS ({f.plain(f.NODE)}), edge AS ({f.plain(edges)}), bits AS ({bits}),
    reach(def_path, b) AS (SELECT n.def_path, bits.b FROM node n JOIN bits ON (n.own & bits.b) <> 0
        UNION SELECT e.caller, r.b FROM reach r JOIN edge e ON e.callee = r.def_path WHERE (r.b & {_P}) <> 0)
    SELECT n.def_path, CAST(coalesce(bit_or(r.b), 0) AS INT) AS mask FROM node n LEFT JOIN reach r ON r.def_path = n.def_path GROUP BY n.def_path"""


_SIG = "CAST(CASE WHEN is_port_method THEN 16 ELSE (CASE WHEN is_unsafe_fn THEN 128 ELSE 0 END) + (CASE WHEN has_mut_param THEN 8 ELSE 0 END) + (CASE WHEN has_static_ref THEN 32 ELSE 0 END) END AS INT)"
_IMPL = f"(SELECT *, {_SIG} AS sig, CASE WHEN contains(def_path, '@') THEN 'run@' || substr(def_path, strpos(def_path, '@') + 1) END AS group_key FROM ({f.plain(f.IMPL)}) i)"


def _votes(source: str, mask: str = "mask") -> str:
    bits = " + ".join(f"CASE WHEN 2 * count(*) FILTER (({mask} & {b}) <> 0) >= count({mask}) THEN {b} ELSE 0 END" for x, b in BIT.items() if x not in "AU")
    return f"SELECT group_key, CAST(CASE WHEN bool_or(is_port_method) THEN 16 ELSE {bits} END AS INT) AS mask FROM {source} WHERE group_key IS NOT NULL GROUP BY group_key"


_CALLEE_GROUP = "'run@' || substr(callee, 1, length(callee) - 5)"


def _rounds(n: int) -> str:
    """Rounds of the fixpoint, one after the other; the graph is shallower than that."""
    out = [f"impl AS {_IMPL}, edge AS (SELECT DISTINCT * FROM ({f.plain(f.VOTING)}) v), r0 AS (SELECT def_path, group_key, is_port_method, sig AS mask FROM impl UNION ALL SELECT key, NULL, false, mask FROM ({f.plain(f.SEED)}) s)"]
    for k in range(n):
        out.append(f"v{k} AS ({_votes(f'r{k}')})")
        passed = f"SELECT e.caller, s.mask FROM edge e JOIN r{k} s ON s.def_path = e.callee UNION ALL SELECT e.caller, v.mask FROM edge e JOIN v{k} v ON v.group_key = {_CALLEE_GROUP} WHERE NOT contains(callee, '@') AND callee LIKE '%::run'"
        out.append(f"g{k} AS (SELECT caller, bit_or(mask & {_P}) AS m FROM ({passed}) p GROUP BY caller)")
        out.append(f"r{k + 1} AS (SELECT r.def_path, r.group_key, r.is_port_method, CASE WHEN r.is_port_method OR r.def_path LIKE 'w::%' THEN r.mask ELSE r.mask | coalesce(g.m, 0) END AS mask FROM r{k} r LEFT JOIN g{k} g ON g.caller = r.def_path)")
    return f"WITH {', '.join(out)} SELECT def_path, CAST(mask AS INT) AS mask FROM r{n}"


_MORE = "SELECT 'v::s' || CAST(s_suppkey AS STRING) AS caller, 'x::u' || CAST(s_suppkey % 9 AS STRING) AS callee FROM supplier"
_EXTERNAL = f"""(SELECT o.callee, o.caller, coalesce(i.sig, v.mask) AS mask FROM (SELECT DISTINCT * FROM ({f.plain(f.VOTING)} UNION ALL {_MORE}) e WHERE starts_with(caller, 'v::') AND NOT starts_with(callee, 'v::') AND callee NOT IN (SELECT key FROM ({f.plain(f.SEED)}) s)) o
    LEFT JOIN {_IMPL} i ON i.def_path = o.callee LEFT JOIN ({_votes(_IMPL, 'sig')}) v ON v.group_key = {_CALLEE_GROUP} AND o.callee LIKE '%::run')"""
_UNKNOWN = f"""SELECT callee, array_to_string(list_sort(list(caller))[1:3], ', ') AS callers, count(*) AS n_callers,
    '  ' || callee || '=' || chr(10) || array_to_string(list_transform(list_sort(list(caller))[1:3], lambda x: '    called by: ' || x || chr(10)), '') || CASE WHEN count(*) > 3 THEN '    ... and ' || (count(*) - 3) || ' more' || chr(10) ELSE '' END AS text
    FROM {_EXTERNAL} x WHERE mask IS NULL GROUP BY callee"""
_STD = f"""WITH RECURSIVE fn AS (SELECT def_path, (CASE WHEN is_unsafe_fn THEN 128 ELSE 0 END) + (CASE WHEN has_static_ref THEN 32 ELSE 0 END) AS own FROM ({f.plain(q._STD_FN)}) n), seed AS ({f.plain(q._STD_SEED)}), edge AS ({f.plain(q._STD_EDGE)}),
    start AS (SELECT def_path, own FROM fn UNION ALL SELECT key, mask FROM seed WHERE key IN (SELECT callee FROM edge)), bits AS ({" UNION ALL ".join(f"SELECT {b} AS b" for b in BIT.values())}),
    reach(def_path, b) AS (SELECT s.def_path, bits.b FROM start s JOIN bits ON (s.own & bits.b) <> 0 UNION SELECT e.caller, r.b FROM reach r JOIN edge e ON e.callee = r.def_path WHERE (r.b & {_P}) <> 0)
    """
_SITES = f"SELECT k, EXISTS (SELECT 1 FROM ({f.plain(q._RANGES)}) r WHERE r.file = a.file AND a.lo_line BETWEEN r.lo AND r.hi AND contains(r.label, ' for ')) AS is_in_trait_impl FROM {FN} a"
_RENAME = f"""SELECT old_name, max('rvs_' || old_name || CASE WHEN m = 0 THEN '' ELSE '_' || {f.letters('m')} END) AS new_name FROM (SELECT *, {_last('def_path')} AS old_name, CAST(k * 7 % 256 AS INT) AS m FROM {FN} a) b
    WHERE NOT starts_with(old_name, 'rvs_') AND NOT regexp_matches(old_name, '^[A-Z]') AND NOT is_test AND NOT is_trait_impl GROUP BY old_name"""
_WHY = f"""SELECT callee, CAST(mask AS INT) AS mask, CASE WHEN mask IS NULL THEN '(unknown)' WHEN mask = 0 THEN '(pure)' ELSE {f.letters('mask')} || ' (' || {_names('mask')} || ')' END AS text FROM (
    SELECT e.callee, coalesce(i.sig, s.mask, v.mask) AS mask FROM (SELECT DISTINCT callee FROM ({f.plain(f.VOTING)}) x WHERE caller = 'v::s7') e LEFT JOIN {_IMPL} i ON i.def_path = e.callee LEFT JOIN ({f.plain(f.SEED)}) s ON s.key = e.callee
    LEFT JOIN ({_votes(_IMPL, 'sig')}) v ON v.group_key = {_CALLEE_GROUP} AND e.callee LIKE '%::run') y"""
_PAIRS = "(SELECT DISTINCT CAST((l_partkey * 37) % 256 AS INT) AS a, CAST((l_suppkey * 91) % 256 AS INT) AS b FROM lineitem)"

# Lines one after the other, whether a block comment is open going from one to the next.
_LINES = r"""WITH RECURSIVE d AS (SELECT doc_id, list_concat(list_concat(['{'], list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 5 WHEN 1 THEN '/* note */ "// text" ' WHEN 2 THEN '// ' WHEN 3 THEN '/* ' WHEN 4 THEN '*/ ' ELSE '' END || x)), ['}']) AS l FROM documents),
step(doc_id, i, is_open, n) AS (SELECT doc_id, 0, false, 0 FROM documents UNION ALL SELECT doc_id, i + 1, CASE WHEN skip THEN is_open WHEN stays THEN true ELSE contains(regexp_replace(after, '"(?:\\.|[^"\\])*"?|/\*.*?\*/|//.*', '', 'g'), '/*') END,
        n + CASE WHEN NOT skip AND NOT stays AND regexp_matches(regexp_replace(after, '("(?:\\.|[^"\\])*"?)|/\*.*?\*/|//.*|/\*.*', '\1', 'g'), '\S') THEN 1 ELSE 0 END
    FROM (SELECT *, x IN ('', '{', '}') AS skip, is_open AND NOT contains(x, '*/') AS stays, CASE WHEN is_open THEN regexp_replace(x, '^.*?\*/', '') ELSE x END AS after
        FROM (SELECT s.*, regexp_replace(l[i + 1], '^\s+|\s+$', '', 'g') AS x FROM step s JOIN d USING (doc_id) WHERE i < len(l)) a) b)
SELECT doc_id, CAST(max(n) AS BIGINT) AS lines FROM step GROUP BY doc_id"""

_DENIED = " UNION ALL ".join(f"SELECT level FROM ({_lint(n)}) d{k}" for k, n in enumerate(("call_violation", "deny_warnings", "stub_macro")))
# Two graphs: implementations with their calls, and suppliers alone, async, with one call.
_CALLS_OF = f"(SELECT caller, count(*) AS n, min(callee) AS least FROM (SELECT DISTINCT * FROM ({f.plain(f.VOTING)}) v) e GROUP BY caller)"
_GRAPH = f"""SELECT i.def_path, is_supplier AS has_async, is_unsafe_fn, is_port_method, {{calls}} AS n_calls, {{least}} AS first_call
    FROM (SELECT *, starts_with(def_path, 'v::s') AS is_supplier FROM {_IMPL} x) i LEFT JOIN {_CALLS_OF} c ON c.caller = i.def_path"""
_ARG = "CASE s_suppkey % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
_ID = "CAST(s_suppkey AS STRING)"
_MOD = f"'app::m' || {_ID} || '::'"
_IS_MUT = "(s_suppkey + 1) % 4 = 0"  # of the next one's static, which the function reads; the last one reads none
_READS = "s_suppkey + 1 IN (SELECT s_suppkey FROM supplier)"


def _says(lint: str, message: str, where: str = "true") -> str:
    return f"SELECT '{lint}' AS lint, {message} AS message FROM supplier WHERE {where}"


_SAID = " UNION ALL ".join([
    _says("static_ref", f"'static ref requires ' || CASE WHEN {_IS_MUT} THEN '{{S, U}}' ELSE '{{S}}' END || ' but fn has {{B}} (missing S(SideEffect))'", _READS),
    _says("missing_debug_assert", "'param ''a'' missing debug_assert!'", "s_suppkey % 3 = 2 AND s_suppkey % 5 <> 0"),
    _says("missing_async", "'async but suffix lacks A'", "s_suppkey % 2 = 0"),
    _says("missing_mutable", "'&mut param but suffix lacks M'", "s_suppkey % 3 = 0"),
    _says("borrowed_param", "'&String — use &str instead'", "s_suppkey % 3 = 1"),
    _says("borrowed_param", "'&String field — use &str instead'"),
    _says("consumed_arg_on_error", f"'owned param ''b'' consumed but not preserved in error type of rvs_f' || {_ID} || '_B'"),
    _says("consumed_arg_on_error", f"'owned param ''a'' consumed but not preserved in error type of rvs_f' || {_ID} || '_B'", "s_suppkey % 3 = 2"),
    _says("error_swallow", "'.ok() swallows errors'"),
    _says("missing_debug_derive", "'type ''T'' missing #[derive(Debug)]'"),
])

SQL = {
    "failed": f"SELECT count(*) FILTER (level = 'deny') > 0 AS failed, count(*) FILTER (level = 'deny') AS n_deny, count(*) FILTER (level = 'warn') AS n_warn FROM ({_DENIED}) d",
    "report_empty": "SELECT CAST(0 AS INT) AS position, 'Capability Report' AS line UNION ALL SELECT 1, repeat('-', 60) UNION ALL SELECT 2, 'Total: 0 functions, 0 lines' UNION ALL SELECT 3, repeat('-', 60) UNION ALL SELECT 4, '(no rvs_ functions found)'",
    "report_round_trip": f"SELECT name, mask, lines, is_test, {_has('allows', 'dead_code', 'unused')} AS allows_dead_code FROM (SELECT *, {_mask('name')} AS mask FROM {FN} a) b WHERE mask IS NOT NULL",
    "callgraph_merge": _GRAPH.format(calls="coalesce(c.n, 0) + CASE WHEN is_supplier THEN 1 ELSE 0 END", least="CASE WHEN is_supplier THEN least(coalesce(c.least, 'w::more'), 'w::more') ELSE c.least END"),
    "callgraph_cached": _GRAPH.format(calls="CASE WHEN is_supplier THEN 1 ELSE coalesce(c.n, 0) END", least="CASE WHEN is_supplier THEN 'w::more' ELSE c.least END"),
    "caps_tabs": "SELECT CAST(c_custkey AS INT) AS line, CASE c_custkey % 4 WHEN 0 THEN 'a' || c_custkey WHEN 1 THEN 'b' || c_custkey ELSE 'c' END AS key, CAST(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 32 ELSE 0 END AS INT) AS mask, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey % 4 <> 2",
    "caps_file": _merge("true", _PRIORITY),
    "apply_edits": "SELECT CAST(doc_id AS VARCHAR) AS file, CASE WHEN length(t) < 3 THEN t ELSE '<zero>' || CASE WHEN length(t) < 43 THEN t[4:] ELSE t[4:40] || '<one>' || CASE WHEN length(t) < 903 THEN t[44:] ELSE t[44:900] || '<two>' || t[904:] END END END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d",
    "why_text": f"SELECT CAST(0 AS INT) AS position, 'v::s7 (pure)' AS line FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 1, '' FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 2, '  callees:' FROM supplier WHERE s_suppkey = 7 UNION ALL SELECT 3, '    ' || callee || ': ' || text FROM ({_WHY}) w",
    "sql_functions": f"SELECT k, {_suffix('name')} AS suffix, {f.parsed('(' + _suffix('name') + ')')} AS mask, {f.letters('(k % 256)')} AS letters, CAST(127 & {_P} & ~(k % 256) AS INT) AS missing, (100 & {_P} & ~(k % 256)) = 0 AS can_call, ((k % 256) & ~59) = 0 AS subset FROM {FN} a",
    "source_functions": f"""SELECT '/w/src/m' || {_ID} || '.rs' AS file, {_MOD} || CASE i WHEN 0 THEN 'rvs_f' || {_ID} || '_B' WHEN 1 THEN 'help' || {_ID} ELSE 'T::new' END AS def_path,
        CASE i WHEN 0 THEN 'rvs_f' || {_ID} || '_B' WHEN 1 THEN 'help' || {_ID} ELSE 'new' END AS name, CASE i WHEN 2 THEN 'impl' ELSE 'free' END AS kind, i = 0 AS is_pub, i = 0 AND s_suppkey % 2 = 0 AS is_async, i = 0 AND s_suppkey % 3 = 0 AS has_mut_param,
        CASE i WHEN 0 THEN 'Says it.' END AS doc, CASE i WHEN 0 THEN 'Result' END AS ret_ty, CASE i WHEN 0 THEN '()' END AS ret_ok, CASE i WHEN 0 THEN 'Error,Vec' END AS ret_errs, CAST(CASE i WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 10 END AS INT) AS lo_line
        FROM supplier, (SELECT unnest([0, 1, 2]) AS i) n""",
    "source_params": f"""SELECT {_MOD} || 'rvs_f' || {_ID} || '_B' AS fn, 'a' AS pat, {_ARG.format("'&u32'", "'&String'", "'u8'")} AS ty, {_ARG.format("'u32'", "'String'", "'u8'")} AS ty_last_ident, s_suppkey % 3 < 2 AS is_ref, s_suppkey % 3 = 0 AS is_mut FROM supplier
        UNION ALL SELECT {_MOD} || 'rvs_f' || {_ID} || '_B', 'b', 'Order', 'Order', false, false FROM supplier""",
    "source_graph": f"""SELECT {_MOD} || 'rvs_f' || {_ID} || '_B' AS def_path, s_suppkey % 2 = 0 AS has_async, s_suppkey % 3 = 0 AS has_mut_param, {_READS} AND NOT {_IS_MUT} AS has_static_ref, {_READS} AND {_IS_MUT} AS has_static_mut_ref, {_MOD} || 'help' || {_ID} AS callee FROM supplier
        UNION ALL SELECT {_MOD} || 'help' || {_ID}, false, false, false, false, NULL FROM supplier UNION ALL SELECT {_MOD} || 'T::new', false, false, false, false, {_MOD} || 'rvs_f' || {_ID} || '_B' FROM supplier""",
    "source_diagnostics": f"SELECT lint, message, count(*) AS n FROM ({_SAID}) s GROUP BY lint, message",
    "source_renames": f"SELECT file, replace(text, 'rvs_f' || s || '_B', 'f' || s) AS text FROM ({f.plain(q._SOURCE)}) x",
    "parse_suffix": f"SELECT k, name, {_mask('name')} AS mask, {_suffix('name')} AS raw, CASE WHEN ({_own('name')}) IS NOT NULL THEN {f.letters('(' + _mask('name') + ')')} END AS caps FROM {FN} a",
    "strip_name": f"SELECT k, {_base('name')} AS base, {_base('def_path')} AS path_base FROM {FN} a",
    "unknown_letters": f"SELECT k, CASE WHEN s IS NULL THEN NULL ELSE array_to_string(list_filter(string_split(u, ''), lambda x, i: list_position(string_split(u, ''), x) = i), '') END AS unknown FROM (SELECT k, {_suffix('name')} AS s, regexp_replace({_suffix('name')}, '[ABIMPSTU]', '', 'g') AS u FROM {FN} a) b",
    "suffix_order": f"SELECT k, o AS sorted, o = s AS in_order, CASE WHEN len(places) > 0 THEN substr(s, places[1], 1) END AS repeated FROM (SELECT k, s, array_to_string(list_sort(string_split(s, '')), '') AS o, list_filter(range(2, length(s) + 1), lambda i: contains(substr(s, 1, i - 1), substr(s, i, 1))) AS places FROM (SELECT k, {_suffix('name')} AS s FROM {FN} a) b WHERE s <> '') c",
    "valid_test_name": f"SELECT k, regexp_matches(name, '^test_[0-9]{{8}}_[A-Za-z0-9_]+$') AS valid FROM {FN} a WHERE is_test",
    "caps_algebra": f"SELECT a, b, (b & {_P} & ~a) = 0 AS can_call, b & {_P} & ~a AS missing, (a & ~b) = 0 AS subset, {_shown('a')} AS shown, {_described('b')} AS described, CAST(bit_count(a) AS INT) AS n, (a & ~11) = 0 AS good, (a & ~27) = 0 AS ok FROM {_PAIRS} p",
    "caps_layer_merge": _merge("true", _PRIORITY),
    "caps_chosen_layers": _merge("layer IN ('ext', 'seed')", "CASE layer WHEN 'ext' THEN 0 ELSE 1 END"),
    "caps_excluding_layers": _merge("layer NOT IN ('deps', 'ext')", _PRIORITY),
    "caps_lines": f"SELECT key || '=' || CASE WHEN mask = 0 THEN '' ELSE {f.letters('mask')} || ' # ' || {_names('mask')} END AS line FROM ({_merge('true', _PRIORITY)}) x",
    "caps_text_parse": "SELECT CAST(c_custkey AS INT) AS line, CASE WHEN c_custkey % 7 = 2 THEN NULL WHEN c_custkey % 7 = 3 THEN 'a::b#c' WHEN c_custkey % 7 = 4 THEN 'x' ELSE 'f::g' || c_custkey END AS key, CASE WHEN c_custkey % 7 = 3 THEN CAST(3 AS INT) END AS mask, CASE WHEN c_custkey % 7 = 2 THEN 'missing = in: no sign' WHEN c_custkey % 7 = 4 THEN 'invalid capability in: AQ' WHEN c_custkey % 7 > 4 THEN 'invalid capability in: SB=' END AS error FROM customer WHERE c_custkey % 7 > 1",
    "report_by_capability": _REPORTED,
    "report_totals": f"SELECT count(*) AS fn_count, {_TOTAL} AS line_count FROM {_ENTRIES} e",
    "report_text": _TEXT,
    "signature_caps": f"SELECT k, CAST(CASE WHEN is_port_method THEN 16 ELSE (CASE WHEN is_async THEN 1 ELSE 0 END) | (CASE WHEN is_unsafe_fn THEN 128 ELSE 0 END) | (CASE WHEN has_mut_param THEN 8 ELSE 0 END) | (CASE WHEN has_static_mut_ref THEN 160 WHEN has_static_ref THEN 32 ELSE 0 END) | (CASE WHEN has_thread_local_ref THEN 96 ELSE 0 END) END AS INT) AS mask FROM {FN} a",
    "infer_closure": _closure(f.ACYCLIC),
    "infer_closure_cyclic": _closure(f.CYCLIC),
    "impl_vote": _votes(_IMPL, "sig"),
    "trait_aliases": f"SELECT DISTINCT 't::' || substr(group_key, 8) || '::run' AS key, mask FROM ({_votes(_IMPL, 'sig')}) v",
    "infer_with_vote": _rounds(6),
    "direct_external_deps": f"SELECT DISTINCT callee AS key, CAST(mask AS INT) AS mask FROM {_EXTERNAL} x WHERE mask IS NOT NULL",
    "unknown_callee_report": _UNKNOWN,
    "infer_std": _STD + "SELECT s.def_path AS key, CAST(coalesce(bit_or(r.b), 0) AS INT) AS mask FROM start s LEFT JOIN reach r ON r.def_path = s.def_path WHERE starts_with(s.def_path, 'std::') GROUP BY s.def_path",
    "unknown_std_callees": _STD + "SELECT DISTINCT callee, caller FROM edge WHERE callee NOT IN (SELECT def_path FROM start) AND callee NOT IN (SELECT key FROM seed)",
    "rename_plan": _RENAME,
    "strip_plan": f"SELECT DISTINCT name AS old_name, {_base('name')} AS new_name FROM {FN} a WHERE starts_with(name, 'rvs_')",
    "eligible_sites": f"SELECT k, name FROM {FN} a WHERE NOT starts_with(name, 'rvs_') AND NOT is_trait_impl",
    "sites_in_trait_impl": _SITES,
    "local_files": "SELECT CASE WHEN s_suppkey % 3 = 0 THEN '/w/src/f' || s_suppkey ELSE '/w' END AS file FROM supplier WHERE s_suppkey % 3 <> 1",
    "wanted_lints": "SELECT n_name AS name, 'warn' AS level FROM nation WHERE n_nationkey % 3 <> 0",
    "port_traits": "SELECT c_name || CASE WHEN c_custkey % 4 = 0 THEN 'Repository' ELSE 'HttpClient' END AS name FROM customer WHERE c_custkey % 4 < 2",
    "why_callees": _WHY,
    "why_candidates": f"SELECT def_path, def_path || CASE WHEN sig = 0 THEN ' (pure)' ELSE ' = ' || {f.letters('sig')} END AS text FROM (SELECT * FROM {_IMPL} i WHERE contains(def_path, 'p1') ORDER BY def_path LIMIT 10) x",
    "effective_lines": _LINES,
    "all_diagnostics": "SELECT lint, level, count(*) AS n FROM (" + " UNION ALL ".join(_lint(n) for n in _LINTS) + ") d GROUP BY lint, level",
} | {f"lint_{n}": _lint(n) for n in _LINTS} | {"call_violation": _lint("call_violation")}
