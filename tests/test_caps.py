import itertools

import pytest
from pyspark.sql import functions as F

from factlake.functions import caps


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_letters_and_masks(spark):
    assert [caps.BIT[x] for x in "ABIMPSTU"] == [1, 2, 4, 8, 16, 32, 64, 128]
    assert (caps.SIGNATURE, caps.PASSED, caps.GOOD, caps.OK) == (137, 118, 11, 27)
    assert [tuple(r) for r in caps.dimension(spark).collect()][3] == ("M", 8, "Mutable")
    sets = ["".join(c) for n in range(9) for c in itertools.combinations("ABIMPSTU", n)]
    df = spark.createDataFrame([(s,) for s in sets], "s string").select("s", caps.parse_letters("s").alias("m"))
    assert all(r.s == r.t and r.m == caps.mask_of(r.s) and r.n == len(r.s) for r in df.select("s", "m", caps.letters("m").alias("t"), caps.size("m").alias("n")).collect())


def test_parsing_letters(spark):
    assert values(spark, caps.parse_letters, ["BBA", "", "aB", "XQ", None]) == [3, 0, 2, 0, None]
    assert values(spark, caps.is_valid, ["AB", "", "AX", "ab"]) == [True, True, False, False]
    assert values(spark, caps.parse_strict, ["UA", "", None]) == [129, 0, None]
    with pytest.raises(Exception, match="invalid capability"):
        values(spark, caps.parse_strict, ["AZ"])


def test_names(spark):
    names = ["rvs_write_db_ABI", "rvs_E", "rvs_", "rvs__AB", "rvs_x_Ab", "main", "a::rvs_go_S", "rvs_a::b_S", None]
    assert values(spark, caps.parsed_mask, names) == [7, 0, 0, 3, 0, None, 32, 32, None]
    assert values(spark, caps.base_name, names) == ["write_db", "E", "", "", "x_Ab", None, "go", "a::b", None]
    assert values(spark, caps.raw_suffix, names) == ["ABI", "", "", "AB", "", None, None, "S", None]
    assert values(spark, caps.unknown_letters, ["rvs_f_XAZX", "rvs_f_P", "f_X"]) == ["XZ", "", None]
    assert values(spark, caps.sorted_letters, ["MB", "AB", ""]) == ["BM", "AB", ""]
    assert values(spark, caps.first_repeated, ["ABCB", "AA", "AB", ""]) == ["B", "A", None, None]
    tests = ["test_20260101_a", "test_2026_a", "test_20260101_", "test_20260101_a-b", "test_20260101_a_B9"]
    assert values(spark, caps.is_test_name, tests) == [True, False, False, False, True]


def test_algebra(spark):
    df = spark.createDataFrame([(a, b) for a in range(256) for b in (0, 1, 8, 16, 118, 137, 255)], "a int, b int")
    for r in df.select("a", "b", caps.can_call("a", "b").alias("c"), caps.missing_for("a", "b").alias("m"), caps.is_subset("a", F.col("b")).alias("s")).collect():
        assert (r.c, r.m, r.s) == ((r.b & 118 & ~r.a) == 0, r.b & 118 & ~r.a, (r.a & ~r.b) == 0)
    one = spark.createDataFrame([(19,), (0,)], "m int").select(caps.display("m"), caps.described("m"), caps.names("m")).collect()
    assert [tuple(r) for r in one] == [("{A, B, P}", "A(Async), B(Blocking), P(Port)", "Async Blocking Port"), ("{}", "", "")]


def test_sql_functions(spark):
    caps.register(spark)
    row = spark.sql("SELECT caps_parse('BA'), caps_format(130), missing_caps(0, 255), can_call(0, 137), can_call(0, 16), caps_subset(8, 11), caps_suffix('rvs_a_BI'), caps_suffix('b')").first()
    assert list(row) == [3, "BU", 118, True, False, True, "BI", None]


FLAGS = ["has_async", "is_unsafe_fn", "has_mut_param", "has_static_ref", "has_static_mut_ref", "has_thread_local_ref", "is_port_method"]


def test_signature(spark):
    rows = list(itertools.product([False, True], repeat=len(FLAGS)))
    df = spark.createDataFrame(rows, ", ".join(f"{f} boolean" for f in FLAGS))
    for r in df.select("*", caps.signature_mask().alias("m")).collect():
        want = set("A" * r.has_async + "U" * r.is_unsafe_fn + "M" * r.has_mut_param + ("SU" if r.has_static_mut_ref else "S" * r.has_static_ref) + "ST" * r.has_thread_local_ref)
        assert r.m == (16 if r.is_port_method else caps.mask_of("".join(want)))


def plain_lines(block):
    """Character by character, as the rule says."""
    n, inside = 0, False
    for raw in block.split("\n"):
        line = raw.strip()
        if line in ("", "{", "}"):
            continue
        i, code = 0, False
        while i < len(line):
            two = line[i : i + 2]
            if inside:
                inside = two != "*/"
                i += 1 if inside else 2
            elif two == "/*":
                inside, i = True, i + 2
            elif line[i] == '"':
                code, i = True, i + 1
                while i < len(line):
                    if line[i] == "\\":
                        i += 2
                    elif line[i] == '"':
                        i += 1
                        break
                    else:
                        i += 1
            elif two == "//":
                break
            else:
                code = code or not line[i].isspace()
                i += 1
        n += code
    return n


def test_effective_lines(spark):
    import random

    rng = random.Random(3)
    blocks = ["{\n}\n", '{ let a = "// no"; }', "a /* b\n c */ d\n// e", "/* a */ b", "/* x\n{\ny */", 'x "a\\', "", "a /* b // c\nd */ e", '"/*" /* "\n*/ a']
    blocks += ["".join(rng.choice(["a", '"', "\\", "/*", "*/", "//", " ", "\n", "{", "}", "/", "*"]) for _ in range(rng.randint(0, 24))) for _ in range(3000)]
    got = values(spark, caps.effective_lines, blocks)
    assert [(b, g) for b, g in zip(blocks, got, strict=True) if g != plain_lines(b)] == []
    assert values(spark, caps.effective_lines, [None]) == [0]
