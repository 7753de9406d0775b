"""Program facts made from the star-schema tables, in SQL that Spark and DuckDB both run.

Names in braces are tables. A part is a function, an order line a call, a supplier a callee.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlake.functions.caps import BIT
from factlake.plans.lineage import settled


def letters(mask: str) -> str:
    """SQL for the letters of a mask."""
    return "(" + " || ".join(f"CASE WHEN ({mask} & {b}) <> 0 THEN '{x}' ELSE '' END" for x, b in BIT.items()) + ")"


def parsed(text: str) -> str:
    """SQL for the mask of letters."""
    return "CAST(" + " + ".join(f"CASE WHEN {text} LIKE '%{x}%' THEN {b} ELSE 0 END" for x, b in BIT.items()) + " AS INT)"


_SIZED = "SELECT p_partkey AS k, p_size AS size, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN ((p_size * 37) % 256) & 27 ELSE (p_size * 37) % 256 END AS bits FROM {part}"
_NAMED = f"""SELECT k, size, bits, CASE
    WHEN k % 11 = 0 THEN 'plain_fn' || CAST(k % 50 AS STRING)
    WHEN k % 11 = 1 THEN CASE WHEN k % 2 = 0 THEN 'test_20260101_t' ELSE 'test_x' END || CAST(k % 400 AS STRING)
    WHEN k % 11 = 2 THEN 'rvs_check_f' || CAST(k AS STRING) || CASE WHEN bits <> 0 THEN '_' || {letters('bits')} ELSE '' END
    WHEN k % 13 = 5 THEN 'rvs_f' || CAST(k AS STRING) || '_' || {letters('bits')} || 'XZX'
    WHEN k % 13 = 6 THEN 'rvs_f' || CAST(k AS STRING) || '_MB'
    WHEN k % 13 = 7 THEN 'rvs_f' || CAST(k AS STRING) || '_BBM'
    ELSE 'rvs_f' || CAST(k AS STRING) || CASE WHEN bits <> 0 THEN '_' || {letters('bits')} ELSE '' END END AS name FROM ({_SIZED}) s"""

FN = f"""SELECT k, 'shop' AS crate, 'src/f' || CAST(k % 7 AS STRING) || '.rs' AS file, name,
    'shop::m' || CAST(k % 5 AS STRING) || '::' || name || CASE WHEN k % 19 = 3 THEN '@shop::Tr' || CAST(k % 4 AS STRING) ELSE '' END AS def_path,
    CASE WHEN k % 19 = 3 OR k % 4 = 0 THEN 'impl' WHEN k % 17 = 1 THEN 'trait_provided' ELSE 'free' END AS kind,
    k % 19 = 3 AS is_trait_impl, k % 23 = 5 AS is_port_method, k % 11 = 1 AS is_test, k % 2 = 0 AS is_pub, k % 5 = 0 AS is_async,
    k % 8 = 1 AS is_unsafe_fn, k % 6 = 1 AS has_mut_param, k % 29 <> 0 AS has_body, k % 31 = 0 AS is_stub, k % 37 = 0 AS is_empty, k % 41 = 0 AS only_asserts,
    CASE WHEN k % 25 = 0 THEN 'dead_code' WHEN k % 25 = 1 THEN 'unused,clippy' WHEN k % 25 = 2 THEN 'clippy' END AS allows,
    k % 3 = 0 AS allows_non_snake_case,
    CASE WHEN k % 4 = 1 THEN 'Says what it does.' WHEN k % 4 = 2 THEN 'Unsafe.' || chr(10) || ' # Safety' || chr(10) || 'None.' END AS doc,
    CASE WHEN k % 10 < 4 THEN 'Result' WHEN k % 10 = 5 THEN 'Option' END AS ret_ty,
    CASE WHEN k % 10 < 2 THEN '()' WHEN k % 10 = 2 THEN 'u64' END AS ret_ok,
    CASE WHEN k % 20 < 4 THEN 'Error,Order' WHEN k % 20 < 14 THEN 'Error' END AS ret_errs,
    'fn ' || name || '() {{{{' || chr(10) || CASE WHEN k % 14 = 0 THEN '  // TODO later' WHEN k % 14 = 1 THEN '  /* FixMe */' WHEN k % 14 = 2 THEN '  let todo = 1;' ELSE '  work();' END || chr(10) || '}}}}' AS snippet,
    CAST(k * 10 AS INT) AS lo_line, CAST(k % 9 AS INT) AS lo_col, CAST(size AS BIGINT) AS lines,
    k % 7 = 1 AS has_static_ref, k % 21 = 1 AS has_static_mut_ref, k % 15 = 1 AS has_thread_local_ref
    FROM ({_NAMED}) n"""

_CALL = """SELECT DISTINCT l_partkey AS k, l_suppkey AS s, l_linenumber AS n FROM {lineitem}"""
CALL = f"""SELECT f.def_path AS caller, CASE WHEN s % 5 = 1 THEN 'method' WHEN s % 9 = 2 THEN 'addr_of' ELSE 'call' END AS site_kind,
    CASE WHEN s % 16 = 15 THEN CAST(NULL AS STRING) WHEN s % 5 = 1 THEN 'AssocFn' WHEN s % 7 = 3 THEN 'Variant' ELSE 'Fn' END AS res_kind,
    CASE WHEN s % 4 = 0 THEN 'shop::s::rvs_s' || CAST(s AS STRING) || CASE WHEN s % 12 = 0 THEN '' ELSE '_' || {letters('(s % 256)')} || 'B' END
         WHEN s % 4 = 1 THEN 'std::s' || CAST(s AS STRING)
         WHEN s % 4 = 2 THEN CASE WHEN n = 1 THEN 'std::any::type_id' WHEN n = 2 THEN 'tokio::task::spawn' WHEN n = 3 THEN 'std::panic::catch_unwind' ELSE 'ext::e' || CAST(s AS STRING) END
         ELSE 'ext::g' || CAST(s AS STRING) END AS callee_def_path,
    CASE WHEN s % 6 = 1 THEN 'ext::g' || CAST(s AS STRING) WHEN s % 6 = 5 THEN 'g' || CAST(s AS STRING) END AS src_path,
    CASE WHEN s % 5 = 1 THEN CASE WHEN n = 1 THEN 'ok' WHEN n = 2 THEN 'unwrap_or_default' WHEN n = 3 THEN 'catch_unwind' ELSE 'm' || CAST(s AS STRING) END END AS method_ident,
    CAST(f.lo_line + n AS INT) AS lo_line, CAST(s % 80 AS INT) AS lo_col
    FROM ({_CALL}) c JOIN ({FN}) f ON f.k = c.k
    UNION ALL SELECT t.def_path, 'call', 'Fn', 'shop::m' || CAST((t.k + 3) % 5 AS STRING) || '::' || u.name, CAST(NULL AS STRING), CAST(NULL AS STRING), t.lo_line, 0
    FROM ({FN}) t JOIN ({FN}) u ON u.k = t.k + 3 WHERE t.is_test"""

PARAM = f"""SELECT def_path AS fn, CASE WHEN p.i = 1 THEN 'a' WHEN p.i = 2 THEN 'b' END AS pat,
    CASE WHEN (k + p.i) % 4 = 0 THEN 'u32' WHEN (k + p.i) % 4 = 1 THEN '&String' WHEN (k + p.i) % 4 = 2 THEN 'Order' ELSE '&mut Vec' END AS ty,
    CASE WHEN (k + p.i) % 4 = 0 THEN 'u32' WHEN (k + p.i) % 4 = 1 THEN CASE WHEN k % 3 = 0 THEN 'Box' ELSE 'String' END WHEN (k + p.i) % 4 = 2 THEN 'Order' ELSE 'Vec' END AS ty_last_ident,
    (k + p.i) % 4 IN (1, 3) AS is_ref, (k + p.i) % 4 = 3 AS is_mut, CAST(lo_line AS INT) AS lo_line, CAST(p.i AS INT) AS lo_col
    FROM ({FN}) f CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) p"""

FACTS = {
    "fn": FN,
    "call": CALL,
    "param": PARAM,
    "static_ref": f"SELECT def_path AS fn, k % 21 = 1 AS is_mut, k % 15 = 1 AS is_thread_local, lo_line, lo_col FROM ({FN}) f WHERE k % 7 = 1 OR k % 15 = 1",
    "assert_ident": f"SELECT def_path AS fn, 'a' AS ident FROM ({FN}) f WHERE k % 8 < 4",
    "use_item": "SELECT 'src/u' || CAST(s_suppkey % 5 AS STRING) || '.rs' AS file, CASE WHEN s_suppkey % 6 = 0 THEN 'anyhow::eyre' WHEN s_suppkey % 6 = 1 THEN 'a::prelude' WHEN s_suppkey % 6 = 2 THEN 'super' WHEN s_suppkey % 6 = 3 THEN 'color_eyre::x' ELSE 'a::b' || CAST(s_suppkey AS STRING) END AS path, s_suppkey % 4 <> 0 AS is_glob, CAST(s_suppkey AS INT) AS lo_line, 1 AS lo_col FROM {supplier}",
    "type_item": "SELECT 'src/t.rs' AS file, CASE WHEN c_custkey % 2 = 0 THEN 'enum' ELSE 'struct' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'Error' ELSE 'Kind' END || CAST(c_custkey AS STRING) AS name, c_custkey % 3 = 0 AS has_debug, CASE WHEN c_custkey % 10 = 2 THEN 'serde,error' WHEN c_custkey % 10 = 4 THEN 'serde' END AS attrs, CAST(c_custkey AS INT) AS lo_line, 0 AS lo_col FROM {customer}",
    "field": "SELECT 'Kind' || CAST(c_custkey AS STRING) AS type_name, 'src/t.rs' AS file, CASE WHEN c_custkey % 3 = 0 THEN 'String' WHEN c_custkey % 3 = 1 THEN 'Vec' ELSE 'Other' END AS ty_last_ident, c_custkey % 5 <> 0 AS is_ref, c_custkey % 7 = 0 AS is_mut, CAST(c_custkey AS INT) AS lo_line, 4 AS lo_col FROM {customer} WHERE c_custkey % 2 = 1",
    "variant": "SELECT CASE WHEN c_custkey % 4 = 0 THEN 'Error' ELSE 'Kind' END || CAST(c_custkey AS STRING) AS type_name, 'src/t.rs' AS file, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' WHEN c_custkey % 5 = 2 THEN 'OtherError' ELSE 'Io' END AS variant, CAST(c_custkey AS INT) AS lo_line, 8 AS lo_col FROM {customer} WHERE c_custkey % 2 = 0",
    "impl_item": "SELECT 'src/i.rs' AS file, CASE WHEN s_suppkey % 5 = 0 THEN 'Into' WHEN s_suppkey % 5 = 1 THEN 'Deref' ELSE 'Clone' END AS trait_name, CAST(s_suppkey AS INT) AS lo_line, 0 AS lo_col FROM {supplier}",
    "crate_attr": "SELECT n_name AS crate, 'src/lib.rs' AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'deny' ELSE 'warn' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'unused,warnings' ELSE 'unused' END AS args, CAST(n_nationkey AS INT) AS lo_line, 0 AS lo_col FROM {nation}",
    "caps": f"SELECT 'std::s' || CAST(s_suppkey AS STRING) AS key, CAST((s_suppkey * 7) % 256 AS INT) AS mask FROM {{supplier}} WHERE s_suppkey % 3 <> 0 UNION ALL SELECT 'ext::g' || CAST(s_suppkey AS STRING), CAST((s_suppkey * 11) % 256 AS INT) FROM {{supplier}} WHERE s_suppkey % 2 = 1",
    "snapshot": f"SELECT DISTINCT name FROM ({FN}) f WHERE k % 5 < 3",
}
# Call graphs for inference: parts call suppliers, suppliers nations, nations regions; the cyclic one adds the way back.
NODE = """SELECT 'p' || CAST(p_partkey AS STRING) AS def_path, CAST(CASE WHEN p_size % 10 = 0 THEN 4 WHEN p_size % 10 = 1 THEN 128 ELSE 0 END AS INT) AS own FROM {part}
    UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), CAST(CASE WHEN s_suppkey % 7 = 0 THEN 32 ELSE 0 END AS INT) FROM {supplier}
    UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), CAST(CASE WHEN n_nationkey % 5 = 0 THEN 10 ELSE 0 END AS INT) FROM {nation}
    UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), CAST(CASE WHEN r_regionkey % 2 = 0 THEN 64 ELSE 2 END AS INT) FROM {region}"""
ACYCLIC = """SELECT DISTINCT 'p' || CAST(l_partkey AS STRING) AS caller, 's' || CAST(l_suppkey AS STRING) AS callee FROM {lineitem}
    UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING) FROM {supplier}
    UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM {nation}"""
CYCLIC = ACYCLIC + """ UNION ALL SELECT DISTINCT 's' || CAST(l_suppkey AS STRING), 'p' || CAST(l_partkey AS STRING) FROM {lineitem}
    UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'r' || CAST(r_regionkey AS STRING) FROM {region}"""
# Votes: parts implement their brand's trait, suppliers call through it, parts call nations.
IMPL = """SELECT 'v::p' || CAST(p_partkey AS STRING) || '::run@t::' || p_brand AS def_path, p_partkey % 997 = 3 AS is_port_method, p_size % 2 = 0 AS is_unsafe_fn, p_size % 3 = 0 AS has_mut_param, p_size % 5 = 0 AS has_static_ref FROM {part}
    UNION ALL SELECT 'v::s' || CAST(s_suppkey AS STRING), false, false, false, false FROM {supplier}
    UNION ALL SELECT 'v::n' || CAST(n_nationkey AS STRING), false, false, false, false FROM {nation}"""
VOTING = """SELECT DISTINCT 'v::s' || CAST(l_suppkey AS STRING) AS caller, 't::' || p_brand || '::run' AS callee FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
    UNION ALL SELECT 'v::p' || CAST(p_partkey AS STRING) || '::run@t::' || p_brand, 'v::n' || CAST(p_partkey % 25 AS STRING) FROM {part}
    UNION ALL SELECT 'v::n' || CAST(n_nationkey AS STRING), 'w::r' || CAST(n_regionkey AS STRING) FROM {nation}"""
SEED = "SELECT 'w::r' || CAST(r_regionkey AS STRING) AS key, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 68 ELSE 2 END AS INT) AS mask FROM {region}"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")


def maker(spark: SparkSession, sf_dir: str, keep: bool = False) -> Callable[[str], DataFrame]:
    """SQL in the form above, to its DataFrame over the tables in sf_dir. With keep, each is written once, for plans that read
    it many times; without, filters and columns of the query reach the files."""

    def make(sql: str) -> DataFrame:
        if sql not in made:
            used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
            made[sql] = settled(spark.sql(sql, **used), "facts") if keep else spark.sql(sql, **used)
        return made[sql]

    made: dict[str, DataFrame] = {}
    return make


def plain(sql: str) -> str:
    """The same SQL over tables of these names."""
    return sql.format(**{t: t for t in TABLES})
