"""Facts that the text of Rust sources shows by itself, without names resolved or types known.

One file is one row in and out of Python; files are independent, so nothing is shuffled. Every column is the one of
operators.check. A function's path is that of its modules, with its type before its name in an inherent impl, and with @ and
the trait, as written, after it in the impl of a trait. What a table can't know from text alone stays null: what a method
belongs to, and paths into other crates. as_facts() resolves what names decide: calls of the crate's own functions and its
statics.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^\\'])'|'[A-Za-z_]\w*|[A-Za-z_]\w*|::|->|=>|[0-9][\w.]*|\S", re.S
)
_CLOSE = {"(": ")", "[": "]", "{": "}"}
# Ends of the names of port traits.
PORT_SUFFIXES = ("Repository", "Client")
_PLACE = "lo_line int, lo_col int"
_TABLES = {
    "fn": "path string, name string, kind string, is_pub boolean, is_async boolean, is_unsafe_fn boolean, is_test boolean, is_trait_impl boolean,"
    " is_port_method boolean, has_mut_param boolean, has_body boolean, is_stub boolean, is_empty boolean, only_asserts boolean, allows string,"
    " allows_non_snake_case boolean, doc string, ret_ty string, ret_ok string, ret_errs string, snippet string, body_snippet string, start int",
    "param": "fn string, pat string, ty string, ty_last_ident string, is_ref boolean, is_mut boolean",
    "call": "caller string, site_kind string, src_path string, method_ident string",
    "body_ident": "fn string, ident string",
    "assert_ident": "fn string, ident string",
    "static_item": "name string, is_mut boolean, is_thread_local boolean",
    "use_item": "path string, is_glob boolean",
    "type_item": "kind string, name string, has_debug boolean, attrs string",
    "field": "type_name string, ty_last_ident string, is_ref boolean, is_mut boolean",
    "variant": "type_name string, variant string",
    "impl_item": "trait_name string",
    "crate_attr": "name string, args string",
}


def _struct(columns: str) -> str:
    return "array<struct<" + f"{columns}, {_PLACE}".replace(", ", ",").replace(" ", ":") + ">>"


SCHEMA = "file string, " + ", ".join(f"{name} {_struct(columns)}" for name, columns in _TABLES.items())
_KEYWORDS = frozenset("if while match return for in loop else let mut ref move break unsafe async await as dyn impl fn where const static use".split())
_ASSERTS = ("debug_assert", "debug_assert_eq", "debug_assert_ne")


class _Source:
    def __init__(self, text: str):
        self.text = text
        self.all = [(m[0], m.start()) for m in _TOKEN.finditer(text)]
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.doc_lines = [(at, t[3:].strip()) for t, at in self.all if t.startswith("///") and not t.startswith("////")]
        self.tokens = [(t, at) for t, at in self.all if not t.startswith(("//", "/*"))]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, (t, _) in enumerate(self.tokens):
            if t in _CLOSE:
                stack.append(i)
            elif t in ")]}" and stack and _CLOSE[self.tokens[stack[-1]][0]] == t:
                self.match[stack.pop()] = i

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def t(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def end(self, i: int) -> int:
        t, at = self.tokens[i]
        return at + len(t)

    def docs(self, at: int, before: int) -> str | None:
        """Doc comments between two places."""
        lo, hi = (bisect.bisect_left(self.doc_lines, (x, "")) for x in (before, at))
        return "\n".join(x for _, x in self.doc_lines[lo:hi]) if lo < hi else None

    def parts(self, i: int, stop: int) -> list[tuple[int, int]]:
        """Tokens from i to stop, cut at commas outside of any bracket."""
        out, begin, angles = [], i, 0
        while i < stop:
            t = self.t(i)
            if t in _CLOSE and i in self.match:
                i = self.match[i]
            elif t in "<>":
                angles = max(0, angles + (1 if t == "<" else -1))
            elif t == "," and not angles:
                out.append((begin, i))
                begin = i + 1
            i += 1
        return [(a, b) for a, b in [*out, (begin, stop)] if a < b]


class _Type:
    """A type as text shows it: its name, its last identifier, whether it is a reference, and its arguments."""

    def __init__(self, s: _Source, i: int, stop: int):
        self.name, self.last, self.is_ref, self.is_mut, self.args, self.inner = "_", None, False, False, [], None
        if s.t(i) in ("&", "&&") and i < stop:
            k = i + 1
            k += s.t(k).startswith("'")
            self.is_ref, self.is_mut = True, s.t(k) == "mut"
            self.inner = _Type(s, k + self.is_mut, stop)
            self.name, self.last = f"&{self.inner.name}", self.inner.last
        elif s.t(i) == "(" and s.match.get(i) == stop - 1:
            parts = [_Type(s, a, b) for a, b in s.parts(i + 1, stop - 1)]
            self.name = "(" + ", ".join(x.name for x in parts) + ")"
        else:
            self._path(s, i, stop)

    def _path(self, s: _Source, i: int, stop: int) -> None:
        names: list[str] = []
        while i < stop:
            t = s.t(i)
            if t.isidentifier() and t not in ("dyn", "impl", "fn", "unsafe", "extern", "const", "mut", "for"):
                names.append(t)
                self.args = []
            elif t == "<" and names:
                depth, k = 1, i + 1
                while k < stop and depth:
                    depth += (s.t(k) == "<") - (s.t(k) == ">")
                    k += 1
                self.args = [_Type(s, a, b) for a, b in s.parts(i + 1, k - 1) if not s.t(a).startswith("'")]
                i = k - 1
            elif t != "::":
                return
            i += 1
        if names:
            self.name, self.last = "::".join(names), names[-1]

    def idents(self) -> set[str]:
        if self.inner:
            return self.inner.idents()
        return ({self.last} if self.last else set()).union(*(x.idents() for x in self.args))


def _attributes(s: _Source, i: int) -> tuple[int, list[str]]:
    """First token after attributes at i, and each one's text."""
    out = []
    while s.t(i) == "#" and s.t(i + 1) in ("[", "!"):
        k = i + 1 + (s.t(i + 1) == "!")
        if k not in s.match:
            break
        out.append(" ".join(s.t(j) for j in range(k + 1, s.match[k])))
        i = s.match[k] + 1
    return i, out


def _uses(s: _Source, i: int, stop: int, head: list[str], out: list[tuple]) -> int:
    """Paths of a use tree at i; the token after it."""
    path = list(head)
    while i < stop:
        t = s.t(i)
        if t == "{":
            k, close = i + 1, s.match.get(i, stop)
            while k < close:
                k = _uses(s, k, close, path, out)
                k += s.t(k) == ","
            return close + 1
        if t == "*":
            out.append((path, True, i))
            return i + 1
        if t == ",":
            break
        if t == "as":
            i += 2
            continue
        if t != "::":
            path = [*path, t]
        i += 1
    if path != head:
        out.append((path, False, max(i - 1, 0)))
    return i


class _Scan:
    """The facts of one source file, by table."""

    def __init__(self, text: str):
        self.s = _Source(text)
        self.out: dict[str, list[dict]] = {k: [] for k in _TABLES}
        i = 0
        while self.s.t(i) == "#" and self.s.t(i + 1) == "!" and i + 2 in self.s.match:
            end = self.s.match[i + 2]
            names = [t for t in (self.s.t(j) for j in range(i + 3, end)) if t.isidentifier()]
            if names:
                self._add("crate_attr", i, name=names[0], args=",".join(names[1:]))
            i = end + 1
        self.items(i, len(self.s.tokens), "free", [], None, False, False)

    def _add(self, table: str, token: int, **values) -> None:
        at = self.s.tokens[token][1]
        line, col = self.s.place(at)
        self.out[table].append(values | {"lo_line": line, "lo_col": col})

    def items(self, i: int, stop: int, kind: str, scope: list[str], trait: str | None, port: bool, allows: bool) -> None:
        """Items from token i on. scope: modules and type around; trait: of the impl around; allows: whether non_snake_case is."""
        s = self.s
        last = s.end(i - 1) if i else 0
        while i < stop:
            begin = i
            i, attrs = _attributes(s, i)
            names = {x.split(" ")[0] for x in attrs}
            listed = [n for x in attrs if x.split(" ")[0] in ("allow", "expect") for n in re.findall(r"[A-Za-z_]\w*", x)[1:]]
            start = i
            pub = s.t(i) == "pub"
            i += pub
            if pub and s.t(i) == "(" and i in s.match:
                i = s.match[i] + 1
            words = set()
            while s.t(i) in ("const", "async", "unsafe", "extern", "default") and s.t(i + 1) not in ("", "{", ":") or s.t(i).startswith('"'):
                if s.t(i) == "const" and s.t(i + 1) not in ("fn", "async", "unsafe", "extern"):
                    break
                words.add(s.t(i))
                i += 1
            t = s.t(i)
            if t == "fn":
                own = {"is_pub": pub, "is_async": "async" in words, "is_unsafe_fn": "unsafe" in words, "is_test": "test" in names}
                own |= {"is_trait_impl": trait is not None, "is_port_method": port, "allows": ",".join(listed) or None}
                own |= {"allows_non_snake_case": allows or "non_snake_case" in listed, "doc": s.docs(s.tokens[start][1], last)}
                i = self.function(i, start, stop, kind, scope, trait, own)
            elif t == "use":
                semi = next((k for k in range(i, stop) if s.t(k) == ";"), stop)
                found: list[tuple] = []
                _uses(s, i + 1, semi, [], found)
                for path, is_glob, token in found:
                    self._add("use_item", token, path="::".join(path), is_glob=is_glob)
                i = semi + 1
            elif t in ("struct", "enum", "union") and s.t(i + 1).isidentifier():
                i = self.type_item(i, start, stop, attrs, names)
            elif t in ("impl", "trait", "mod"):
                i = self.group(i, start, stop, scope, allows or "non_snake_case" in listed)
            elif t == "static":
                k = i + 1 + (s.t(i + 1) == "mut")
                self._add("static_item", start, name=s.t(k), is_mut=k > i + 1, is_thread_local="thread_local" in names)
                i = self._past(i, stop, begin)
            elif t == "thread_local" and s.t(i + 1) == "!" and i + 2 in s.match:
                end = s.match[i + 2]
                for k in range(i + 3, end):
                    if s.t(k) == "static":
                        self._add("static_item", k, name=s.t(k + 1), is_mut=False, is_thread_local=True)
                i = end + 1
            else:
                i = self._past(i, stop, begin)
            last = s.end(min(i, len(s.tokens)) - 1) if i else 0

    def _past(self, k: int, stop: int, begin: int) -> int:
        """First token after an item of another kind."""
        s = self.s
        while k < stop and s.t(k) not in (";", "{", "}"):
            k = s.match.get(k, k) + 1 if s.t(k) in "([" else k + 1
        return max(s.match.get(k, k) + 1, begin + 1)

    def group(self, i: int, start: int, stop: int, scope: list[str], allows: bool) -> int:
        """impl, trait or mod at i."""
        s, t, k = self.s, self.s.t(i), i + 1
        while k < stop and s.t(k) not in ("{", ";"):
            k += 1
        head, depth = [], 0  # identifiers outside of angle brackets
        for j in range(i + 1, k):
            depth += (s.t(j) == "<") - (s.t(j) == ">")
            if depth == 0 and (s.t(j).isidentifier() or s.t(j) == ":"):
                head.append(s.t(j))
        head = head[: head.index("where")] if "where" in head else head
        trait, port, kind, inner = None, False, "free", scope
        if t == "impl":
            kind = "impl"
            if "for" in head:
                path = [x for x in head[: head.index("for")] if x not in ("const", "unsafe", ":")]
                trait = "::".join(path)
                port = bool(path) and path[-1].endswith(PORT_SUFFIXES)
                if path:
                    self._add("impl_item", start, trait_name=path[-1])
            elif head:
                inner = [*scope, head[-1]]
        elif head:
            inner = [*scope, head[0]]
            if t == "trait":
                kind, port = "trait_provided", head[0].endswith(PORT_SUFFIXES)
        if k in s.match:
            self.items(k + 1, s.match[k], kind, inner, trait, port, allows)
        return s.match.get(k, k) + 1

    def type_item(self, i: int, start: int, stop: int, attrs: list[str], names: set[str]) -> int:
        s, t, name = self.s, self.s.t(i), self.s.t(i + 1)
        derives = {n for x in attrs if x.startswith("derive") for n in re.findall(r"\w+", x)}
        if t != "union":
            self._add("type_item", start, kind=t, name=name, has_debug="Debug" in derives, attrs=",".join(sorted(names)))
        k = i + 2
        while k < stop and s.t(k) not in ("{", ";", "("):
            k += 1
        if k in s.match:
            for a, b in s.parts(k + 1, s.match[k]):
                a, _ = _attributes(s, a)
                if t == "enum" and a < b and s.t(a).isidentifier():
                    self._add("variant", a, type_name=name, variant=s.t(a))
                elif t == "struct":
                    self.field(a, b, name, s.t(k) == "{")
        k = s.match.get(k, k)
        return k + 1 + (s.t(k + 1) == ";" and s.t(k) == ")")

    def field(self, a: int, b: int, name: str, named: bool) -> None:
        s = self.s
        if s.t(a) == "pub":
            a = s.match[a + 1] + 1 if s.t(a + 1) == "(" and a + 1 in s.match and (named or s.match[a + 1] + 1 < b) else a + 1
        begin = a + 2 if named and s.t(a + 1) == ":" else a
        if begin < b:
            ty = _Type(s, begin, b)
            self._add("field", begin, type_name=name, ty_last_ident=ty.last, is_ref=ty.is_ref, is_mut=ty.is_mut)

    def function(self, i: int, start: int, stop: int, kind: str, scope: list[str], trait: str | None, own: dict) -> int:
        s, name, k = self.s, self.s.t(i + 1), i + 2
        while k < stop and s.t(k) not in ("(", ";", "{"):
            k += 1
        close = s.match.get(k, k)
        path = "::".join([*scope, name]) + (f"@{trait}" if trait else "")
        params = [_attributes(s, a)[0:1] + (b,) for a, b in s.parts(k + 1, close)]
        tokens = [s.t(j) for j in range(k + 1, close)]
        has_mut = any(tokens[j] == "mut" and "&" in (tokens[j - 1], tokens[j - 2] if tokens[j - 1].startswith("'") else "") for j in range(1, len(tokens)))
        b = close
        while b < stop and s.t(b) not in ("{", ";"):
            b += 1
        body_end = s.match.get(b)
        has_body = s.t(b) == "{" and body_end is not None
        inside = [s.t(j) for j in range(b + 1, body_end)] if has_body else []
        macros = {inside[j] for j in range(len(inside) - 1) if inside[j + 1] == "!"}
        end = s.end(body_end) if has_body else s.end(min(b, len(s.tokens) - 1))
        statements = [x for x in re.split(r";", "".join(x + " " for x in inside)) if x.strip()]
        asserts = bool(statements) and all(x.split()[0].startswith("debug_assert") for x in statements)
        own |= self._returned(close + 1, b)
        own |= {"kind": "trait_required" if kind == "trait_provided" and not has_body else kind, "has_mut_param": has_mut, "has_body": has_body}
        own |= {"is_stub": bool({"todo", "unimplemented"} & macros), "is_empty": has_body and not inside, "only_asserts": asserts}
        own |= {"snippet": s.text[s.tokens[start][1] : end], "body_snippet": s.text[s.tokens[b][1] : end] if has_body else None}
        self._add("fn", start, path=path, name=name, start=s.tokens[i + 1][1] if i + 1 < len(s.tokens) else 0, **own)
        for a, e in params:
            colon = next((j for j in range(a, e) if s.t(j) == ":"), None)
            if colon is not None and colon + 1 < e and "self" not in (s.t(j) for j in range(a, colon)):
                pattern = [x for x in (s.t(j) for j in range(a, colon)) if x not in ("mut", "ref")]
                ty = _Type(s, colon + 1, e)
                pat = pattern[0] if len(pattern) == 1 and pattern[0].isidentifier() and pattern != ["_"] else None
                self._add("param", a, fn=path, pat=pat, ty=ty.name, ty_last_ident=ty.last, is_ref=ty.is_ref, is_mut=ty.is_mut)
        if not has_body:
            return b + 1
        self.body(b + 1, body_end, path)
        return body_end + 1

    def _returned(self, i: int, stop: int) -> dict:
        """What a function returns, and the parts of a Result."""
        s = self.s
        if s.t(i) != "->":
            return {"ret_ty": None, "ret_ok": None, "ret_errs": None}
        end = next((k for k in range(i, stop) if s.t(k) == "where"), stop)
        ty = _Type(s, i + 1, end)
        errors = ",".join(sorted(ty.args[1].idents())) if len(ty.args) > 1 else None
        return {"ret_ty": ty.last, "ret_ok": ty.args[0].name if ty.args else None, "ret_errs": errors}

    def body(self, i: int, stop: int, path: str) -> None:
        """Calls, functions whose address is taken, names of statics, and names in debug assertions."""
        s = self.s
        for j in range(i, stop):
            t, after, before = s.t(j), s.t(j + 1), s.t(j - 1)
            if not t.isidentifier() or t in _KEYWORDS:
                continue
            if re.fullmatch(r"[A-Z][A-Z0-9_]*", t) and after not in ("(", "::", "!"):
                self._add("body_ident", j, fn=path, ident=t)
            if t in _ASSERTS and after == "!" and j + 2 in s.match:
                for x in sorted({x for x in (s.t(k) for k in range(j + 3, s.match[j + 2])) if x.isidentifier()}):
                    self._add("assert_ident", j, fn=path, ident=x)
            called = j + 1
            if after == "::" and s.t(j + 2) == "<":  # f::<T>(...)
                depth, called = 1, j + 3
                while called < stop and depth:
                    depth += (s.t(called) == "<") - (s.t(called) == ">")
                    called += 1
            if s.t(called) == "(" and before == ".":
                self._add("call", j, caller=path, site_kind="method", src_path=None, method_ident=t)
            elif s.t(called) == "(" and before != "fn" or after not in ("::", "(", "!", ".", "<", "[", "{", ":"):
                names, p = [t], j
                while s.t(p - 1) == "::" and s.t(p - 2).isidentifier():
                    names.insert(0, s.t(p - 2))
                    p -= 2
                if s.t(called) == "(" or s.t(p - 1) == "&":
                    self._add("call", p, caller=path, site_kind="call" if s.t(called) == "(" else "addr_of", src_path="::".join(names), method_ident=None)


def scan(text: str) -> dict[str, list[dict]]:
    """The facts of one source file, by table."""
    return _Scan(text).out


def extract(files: DataFrame) -> DataFrame:
    """(file, a column for each table) of files (file, text); null text has no facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"file": f} | scan(t or "") for f, t in zip(b.column("file").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))
    return files.select("file", "text").mapInArrow(run, SCHEMA)


def facts(extracted: DataFrame, name: str) -> DataFrame:
    """One fact table of extract's result, a row per fact."""
    return extracted.select("file", F.inline(name))


def read(spark, path: str) -> DataFrame:
    """Facts of all .rs files under path."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.rs")
    return extract(files.select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def rewrite(source: DataFrame, plan: DataFrame) -> DataFrame:
    """Edits (file, start, end, insert) that put new names for old ones wherever the old stands as a whole identifier.

    By text only, so equal names of different things are renamed together. Identifiers meet the plan in a join.
    """
    words = source.select("file", "text").mapInArrow(_identifiers, "file string, start int, end int, old_name string")
    return words.join(plan, "old_name").select("file", "start", "end", F.col("new_name").alias("insert"))


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        files = zip(b.column("file").to_pylist(), b.column("text").to_pylist(), strict=True)
        rows = [(f, at, at + len(w), w) for f, t in files for w, at in _Source(t or "").tokens if w.isidentifier()]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["file", "start", "end", "old_name"])


def module_of(file):
    """The module path of a source file under src, with :: before it; "" for lib.rs, main.rs and files elsewhere."""
    inner = F.regexp_extract(file, r"(?:^|/)src/(.*)\.rs$", 1)
    inner = F.regexp_replace(inner, r"(^|/)(mod|lib|main)$", "")
    return F.when(inner == "", "").otherwise(F.concat(F.lit("::"), F.replace(inner, F.lit("/"), F.lit("::"))))


def as_facts(extracted: DataFrame, crate: str, caps: DataFrame | None = None, snapshot: DataFrame | None = None):
    """operators.check.Facts of what text shows, for the sources of one crate.

    A function's path is the crate, the file's module and its path in the file, so that equal names in different places stay
    apart. A call, or a path whose address is taken, is resolved where one function of the crate alone has that name; other
    calls of names with the prefix keep the path that is written, and all others are unresolved. Names in capitals that a
    static of the crate has are references to it.
    """
    from factlake.operators.check import Facts

    spark = extracted.sparkSession
    names = {name: facts(extracted, name) for name in _TABLES}

    def whole(column: str):
        return F.concat(F.lit(crate), module_of("file"), F.lit("::"), F.col(column))

    fn = names["fn"].select("*", F.lit(crate).alias("crate"), whole("path").alias("def_path"))
    alone = fn.where(~F.col("path").contains("@")).groupBy("name").agg(F.min("def_path").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    called = F.substring_index("src_path", "::", -1)
    call = names["call"].withColumn("caller", whole("caller")).withColumn("called", called).join(alone.withColumnRenamed("name", "called"), "called", "left")
    prefixed = (F.col("site_kind") == "call") & F.col("called").startswith("rvs_")
    path = F.coalesce("only", F.when(prefixed, F.col("src_path")))
    call = call.where("site_kind <> 'addr_of' OR only IS NOT NULL")
    kind = F.when(path.isNotNull(), "Fn").alias("res_kind")
    call = call.select("caller", "site_kind", kind, path.alias("callee_def_path"), "src_path", "method_ident", "lo_line", "lo_col")
    statics = names["static_item"].groupBy("name").agg(F.bool_or("is_mut").alias("is_mut"), F.bool_or("is_thread_local").alias("is_thread_local"))
    refs = names["body_ident"].withColumn("fn", whole("fn")).join(statics, F.col("ident") == F.col("name"))
    tables = {k: names[k] for k in ("use_item", "type_item", "field", "variant", "impl_item")}
    tables |= {
        "fn": fn,
        "call": call,
        "param": names["param"].withColumn("fn", whole("fn")).drop("file"),
        "assert_ident": names["assert_ident"].select(whole("fn").alias("fn"), "ident"),
        "static_ref": refs.select("fn", "is_mut", "is_thread_local", "lo_line", "lo_col"),
        "crate_attr": names["crate_attr"].withColumn("crate", F.lit(crate)),
        "caps": caps if caps is not None else spark.createDataFrame([], "key string, mask int"),
        "snapshot": snapshot if snapshot is not None else spark.createDataFrame([], "name string"),
    }
    return Facts(**tables)


def call_graph(facts) -> tuple[DataFrame, DataFrame]:
    """fn (def_path, the flags of operators.infer) and edge (caller, callee) of as_facts' tables, for inference."""
    touched = {"_static": ~F.col("is_mut"), "_mut": F.col("is_mut"), "_local": F.col("is_thread_local")}
    refs = facts.static_ref.groupBy(F.col("fn").alias("def_path")).agg(*(F.bool_or(x).alias(y) for y, x in touched.items()))
    own = {"has_async": "is_async"} | {x: x for x in ("is_unsafe_fn", "has_mut_param", "is_port_method", "is_trait_impl", "is_test")}
    fn = facts.fn.groupBy("def_path").agg(*(F.bool_or(x).alias(y) for y, x in own.items()))
    flags = {"_static": "has_static_ref", "_mut": "has_static_mut_ref", "_local": "has_thread_local_ref"}
    fn = fn.join(refs, "def_path", "left").select(*fn.columns, *(F.coalesce(x, F.lit(False)).alias(y) for x, y in flags.items()))
    edge = facts.call.where("callee_def_path IS NOT NULL").select("caller", F.col("callee_def_path").alias("callee")).distinct()
    return fn, edge
