import random

import pytest

from factlake.operators import infer

FLAGS = ["has_async", "is_unsafe_fn", "has_mut_param", "has_static_ref", "has_static_mut_ref", "has_thread_local_ref", "is_port_method"]
BITS = {"has_async": 1, "is_unsafe_fn": 128, "has_mut_param": 8, "has_static_ref": 32, "has_static_mut_ref": 160, "has_thread_local_ref": 96}


def facts(spark, fns):
    rows = [(k, *(f in v for f in FLAGS)) for k, v in fns.items()]
    return spark.createDataFrame(rows, "def_path string, " + ", ".join(f"{f} boolean" for f in FLAGS))


def edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "caller string, callee string")


def seeds(spark, seed):
    return spark.createDataFrame(list(seed.items()), "key string, mask int")


def own(flags):
    if "is_port_method" in flags:
        return 16
    out = 0
    for f in flags:
        out |= BITS[f]
    return out


def group(path):
    head, at, trait = path.partition("@")
    return head.rsplit("::", 1)[-1] + "@" + trait if at else None


def plain_vote(wanted, fns, known):
    members = [k for k in fns if group(k) == wanted]
    if not members:
        return None
    if any("is_port_method" in fns[k] for k in members):
        return 16
    have = [known[k] for k in members if known.get(k) is not None]
    return sum(b for b in (2, 4, 8, 16, 32, 64) if 2 * sum(bool(m & b) for m in have) >= len(have)) if have else None


def plain(fns, pairs, seed):
    state = {k: seed.get(k, own(v)) for k, v in fns.items()} | {c: seed[c] for _, c in pairs if c in seed and c not in fns}
    moved = True
    while moved:
        moved = False
        for a, c in pairs:
            if a not in state or a in seed or "is_port_method" in fns.get(a, ()):
                continue
            m = state.get(c)
            if m is None and "@" not in c and "::" in c:
                scope, name = c.rsplit("::", 1)
                m = plain_vote(f"{name}@{scope}", fns, state)
            new = state[a] | (m or 0) & 118
            moved |= new != state[a]
            state[a] = new
    return state


def check(spark, fns, pairs, seed):
    got = {r.def_path: r.mask for r in infer.infer(facts(spark, fns), edges(spark, pairs), seeds(spark, seed)).collect()}
    assert got == plain(fns, pairs, seed)


def test_signature_and_empty(spark):
    check(spark, {}, [], {})
    check(spark, {"f": (), "g": ("has_async", "has_static_ref"), "h": ("is_port_method", "has_async")}, [], {})


def test_cycles_seeds_and_long_chain(spark):
    check(spark, {"a": (), "b": ()}, [("a", "a"), ("a", "b"), ("b", "a")], {})
    check(spark, {"a": (), "b": ("has_static_ref",)}, [("a", "b"), ("a", "x")], {"x": 4 | 8, "b": 0})
    chain = {f"f{i:02d}": () for i in range(24)}
    check(spark, chain, [(f"f{i:02d}", f"f{i + 1:02d}") for i in range(23)] + [("f23", "leaf")], {"leaf": 255})
    short = infer.infer(facts(spark, chain), edges(spark, [(f"f{i:02d}", f"f{i + 1:02d}") for i in range(23)] + [("f23", "leaf")]), seeds(spark, {"leaf": 2}), max_rounds=3)
    assert {r.def_path for r in short.where("mask = 2").collect()} == {"leaf", "f23", "f22", "f21"}


def test_votes(spark):
    impls = {"p::run@t::T": ("has_static_ref",), "q::run@t::T": ("has_mut_param",), "r::run@u::T": ("is_port_method",), "c": ()}
    check(spark, impls, [("c", "t::T::run"), ("c", "u::T::run")], {})
    three = {"p::run@T": ("has_mut_param",), "q::run@T": (), "r::run@T": (), "c": ()}
    check(spark, three, [("c", "T::run"), ("c", "T::run@x"), ("q::run@T", "io")], {"io": 4})
    votes = {r.group_key: r.mask for r in infer.impl_votes(facts(spark, impls), infer.signature_caps(facts(spark, impls))).collect()}
    assert votes == {"run@t::T": 40, "run@u::T": 16}
    aliases = {r.key: r.mask for r in infer.trait_aliases(facts(spark, impls), infer.signature_caps(facts(spark, impls))).collect()}
    assert aliases == {"t::T::run": 40, "u::T::run": 16}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"m{i}::f" for i in range(12)] + [f"m{i}::go@t::T{i % 3}" for i in range(9)]
    fns = {n: tuple(f for f in FLAGS if rng.random() < (0.03 if f == "is_port_method" else 0.12)) for n in names}
    callees = names + [f"t::T{i}::go" for i in range(4)] + ["x::a", "x::b"]
    pairs = {(rng.choice(names), rng.choice(callees)) for _ in range(40)}
    check(spark, fns, sorted(pairs), {"x::a": rng.randrange(256), names[rng.randrange(12)]: rng.randrange(256)})


def test_external(spark):
    fns = {"c::f": (), "d::g": ("has_static_ref",), "e::run@t::T": ("has_static_ref",)}
    fn = facts(spark, fns)
    pairs = [("c::f", "d::g"), ("c::f", "t::T::run"), ("c::f", "s::s"), ("c::f", "c::f"), ("d::g", "z::z")] + [(f"c::h{i}", "u::u") for i in range(5)]
    out = infer.direct_external(fn, edges(spark, pairs), seeds(spark, {"s::s": 1}), infer.signature_caps(fn), "c")
    assert {(r.callee, r.caller, r.mask) for r in out.collect()} == {("d::g", "c::f", 32), ("t::T::run", "c::f", 32)} | {("u::u", f"c::h{i}", None) for i in range(5)}
    assert {tuple(r) for r in infer.direct_deps(out).collect()} == {("d::g", 32), ("t::T::run", 32)}
    row = infer.unknown_callees(out).first()
    assert (row.callers, row.n_callers) == ("c::h0, c::h1, c::h2", 5)
    assert row.text == "  u::u=\n    called by: c::h0\n    called by: c::h1\n    called by: c::h2\n    ... and 2 more\n"


def test_std(spark):
    fns = {"std::a::read@std::io::Read": ("has_static_ref",), "std::b": (), "core::c": (), "app::m": ()}
    pairs = [("std::b", "std::io::Read::read"), ("core::c", "sys::x"), ("core::c", "sys::y"), ("app::m", "sys::z")]
    known, unknown = infer.infer_std(facts(spark, fns), edges(spark, pairs), seeds(spark, {"std::io::Read::read": 2, "sys::x": 4}), "app")
    assert {r.key: r.mask for r in known.collect()} == {"std::a::read@std::io::Read": 32, "std::b": 32, "core::c": 4, "std::io::Read::read": 32}
    assert {tuple(r) for r in unknown.collect()} == {("sys::y", "core::c")}
