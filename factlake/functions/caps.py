"""Capability sets as INT bitmasks: Column builders and SQL functions.

A set is one integer, so that unions, differences and subset tests are bit operations inside generated code. NULL is
"unknown", 0 is "pure": never coalesce one into the other before that difference has been used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters in order, their names. Bits follow the order of the letters.
CAPABILITIES = [("A", "Async"), ("B", "Blocking"), ("I", "IO"), ("M", "Mutable"), ("P", "Port"), ("S", "SideEffect"), ("T", "ThreadLocal"), ("U", "Unsafe")]
LETTERS = "".join(letter for letter, _ in CAPABILITIES)
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}


def mask_of(letters: str) -> int:
    """Mask of letters on the driver, for constants."""
    return sum(BIT[x] for x in set(letters))


#: Capabilities that a caller need not hold for its callees, and those that pass from callee to caller.
SIGNATURE, PASSED = mask_of("AMU"), mask_of("BIPST")
GOOD, OK = mask_of("ABM"), mask_of("ABMP")
#: Capabilities that interface implementations vote on.
VOTED = mask_of("BIMPST")
_NAME = r"^rvs_(?:.*)_([A-Z]+)$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(x: Column, body) -> Column:
    """body(x) with x computed once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def dimension(spark: SparkSession) -> DataFrame:
    """capability(letter, bit, description): the eight rows."""
    return spark.createDataFrame([(x, BIT[x], d) for x, d in CAPABILITIES], "letter string, bit int, description string")


def parse_letters(text: Column | str) -> Column:
    """Mask of the known letters in text; unknown ones are passed over, repeats count once. NULL stays NULL."""
    def bits(t: Column) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.contains(t, F.lit(x)), b).otherwise(0) for x, b in BIT.items()))

    return _let(_col(text), lambda t: F.when(t.isNotNull(), bits(t)))


def is_valid(text: Column | str) -> Column:
    """Whether text has known letters only; "" is the empty set."""
    return _col(text).rlike(f"^[{LETTERS}]*$")


def parse_strict(text: Column | str) -> Column:
    """Mask of text, or an error for a letter that is unknown."""
    text = _col(text)
    stop = F.raise_error(F.concat(F.lit("invalid capability in: "), text)).cast("int")
    return F.when(text.isNull(), F.lit(None).cast("int")).when(is_valid(text), parse_letters(text)).otherwise(stop)


def letters(mask: Column | str) -> Column:
    """Letters of a mask in order; "" for the empty set."""
    mask = _col(mask)
    return F.when(mask.isNotNull(), F.concat(*(F.when(mask.bitwiseAND(b) != 0, x).otherwise("") for x, b in BIT.items())))


def _listed(mask: Column, show) -> Column:
    return F.filter(F.array(*(F.when(mask.bitwiseAND(BIT[x]) != 0, show(x, d)) for x, d in CAPABILITIES)), lambda x: x.isNotNull())


def display(mask: Column | str) -> Column:
    """{A, B}; {} for the empty set."""
    return F.concat(F.lit("{"), F.array_join(_listed(_col(mask), lambda x, _: F.lit(x)), ", "), F.lit("}"))


def described(mask: Column | str) -> Column:
    """A(Async), B(Blocking)"""
    return F.array_join(_listed(_col(mask), lambda x, d: F.lit(f"{x}({d})")), ", ")


def names(mask: Column | str, separator: str = " ") -> Column:
    """Async Blocking"""
    return F.array_join(_listed(_col(mask), lambda _, d: F.lit(d)), separator)


def missing_for(caller: Column | str, callee: Column | str) -> Column:
    """What the callee needs and the caller lacks; signature capabilities aside."""
    return _col(callee).bitwiseAND(PASSED).bitwiseAND(F.bitwise_not(_col(caller)))


def can_call(caller: Column | str, callee: Column | str) -> Column:
    return missing_for(caller, callee) == 0


def is_subset(mask: Column | str, of: Column | int) -> Column:
    """All eight letters count."""
    of = F.lit(of) if isinstance(of, int) else of
    return _col(mask).bitwiseAND(F.bitwise_not(of)) == 0


def contains(mask: Column | str, letter: str) -> Column:
    return _col(mask).bitwiseAND(BIT[letter]) != 0


def size(mask: Column | str) -> Column:
    return F.bit_count(_col(mask))


def insert(mask: Column | str, letter: str) -> Column:
    return _col(mask).bitwiseOR(BIT[letter])


def last_segment(path: Column | str) -> Column:
    return F.substring_index(_col(path), "::", -1)


def prefixed(name: Column | str) -> Column:
    """The part of a name that is parsed: the whole if it has the prefix, else its last path segment if that has it; else NULL."""
    return _let(_col(name), lambda n: F.when(n.startswith("rvs_"), n).when(last_segment(n).startswith("rvs_"), last_segment(n)))


def raw_suffix(name: Column | str) -> Column:
    """Suffix letters as written, "" if there are none; NULL without the prefix. Paths are not looked into."""
    return _let(_col(name), lambda n: F.when(n.startswith("rvs_"), F.regexp_extract(n, _NAME, 1)))


def parsed_mask(name: Column | str) -> Column:
    """Capabilities that a name or path declares; NULL if it has no prefix."""
    return parse_letters(raw_suffix(prefixed(name)))


def base_name(name: Column | str) -> Column:
    """Name without prefix and suffix; NULL if it has no prefix."""
    def base(own: Column) -> Column:
        suffix, rest = F.regexp_extract(own, _NAME, 1), F.substring(own, F.lit(5), F.length(own))
        return F.when(suffix == "", rest).otherwise(F.substring(rest, F.lit(1), F.length(rest) - F.length(suffix) - 1))

    return _let(prefixed(name), base)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda x: x != "")


def unknown_letters(name: Column | str) -> Column:
    """Suffix letters that are no capability, each once in order of appearance, as one string."""
    return F.array_join(F.array_distinct(F.filter(_characters(raw_suffix(name)), lambda x: ~x.isin(*LETTERS))), "")


def sorted_letters(text: Column | str) -> Column:
    return F.array_join(F.array_sort(_characters(_col(text))), "")


def first_repeated(text: Column | str) -> Column:
    """First letter that has stood before; NULL if none."""
    return _let(_characters(_col(text)), lambda x: F.get(F.filter(x, lambda y, i: F.array_position(x, y) <= i), F.lit(0)))


def is_test_name(name: Column | str) -> Column:
    return _col(name).rlike("^test_[0-9]{8}_[A-Za-z0-9_]+$")


def signature_mask() -> Column:
    """Capabilities that a function's facts show: a port method has exactly P."""
    def bit(flag: str, have: str) -> Column:
        return F.when(F.col(flag), mask_of(have)).otherwise(0)

    static = F.when(F.col("has_static_mut_ref"), mask_of("SU")).when(F.col("has_static_ref"), mask_of("S")).otherwise(0)
    parts = [bit("has_async", "A"), bit("is_unsafe_fn", "U"), bit("has_mut_param", "M"), static, bit("has_thread_local_ref", "ST")]
    return F.when(F.col("is_port_method"), BIT["P"]).otherwise(reduce(lambda a, b: a.bitwiseOR(b), parts))


def effective_lines(block: Column | str) -> Column:
    """Lines of a block's text that hold code: strings are code; comments, blank lines and lone braces are not.

    A fold over the lines carries whether a block comment is open; within a line, regular expressions take strings and
    comments in their order.
    """
    text = r'"(?:\\.?|[^"\\])*"?'
    remove = rf"({text})|/\*.*?\*/|//.*|/\*.*"
    opens = rf'^(?:{text}|/\*.*?\*/|/(?![/*])|[^"/])*+/\*(?!.*\*/)'

    def step(state: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
        after = F.when(state["open"], F.regexp_replace(line, r"^.*?\*/", "")).otherwise(line)
        closed = ~state["open"] | line.contains("*/")
        skip = line.isin("", "{", "}")
        code = closed & (F.regexp_replace(F.regexp_replace(after, remove, "$1"), r"\s+", "") != "")
        return F.struct(
            F.when(skip, state["open"]).when(closed, after.rlike(opens)).otherwise(True).alias("open"),
            (state["n"] + F.when(~skip & code, 1).otherwise(0)).alias("n"),
        )

    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"))
    return F.coalesce(F.aggregate(F.split(_col(block), "\n"), start, step, lambda s: s["n"]), F.lit(0)).cast("long")


# SQL functions of the same meaning; their bodies are inlined into plans.
_SQL = {
    "caps_parse(t STRING) RETURNS INT": " | ".join(f"IF(contains(t, '{x}'), {b}, 0)" for x, b in BIT.items()),
    "caps_format(m INT) RETURNS STRING": " || ".join(f"IF((m & {b}) <> 0, '{x}', '')" for x, b in BIT.items()),
    "missing_caps(a INT, b INT) RETURNS INT": f"b & {PASSED} & ~a",
    "can_call(a INT, b INT) RETURNS BOOLEAN": f"(b & {PASSED} & ~a) = 0",
    "caps_subset(a INT, b INT) RETURNS BOOLEAN": "(a & ~b) = 0",
    "caps_suffix(n STRING) RETURNS STRING": f"IF(startswith(n, 'rvs_'), regexp_extract(n, '{_NAME}', 1), NULL)",
}


def register(spark: SparkSession) -> None:
    """Make the functions above known to spark.sql as temporary functions."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
