"""DuckDB SQL for the queries that SQL can express; the others are tested against plain versions in tests/llm."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


#: Classes over all pairs of texts that share a shingle.
OP1 = f"""WITH RECURSIVE words AS ({_words('documents', 'doc_id')}), n AS (SELECT count(*) AS total FROM documents),
shingle AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
tf AS (SELECT doc_id, s, count(*) AS tf FROM shingle GROUP BY doc_id, s),
df AS (SELECT s, count(*) AS df FROM tf GROUP BY s),
weight AS (SELECT t.doc_id, t.s, t.tf * (0.75 + 0.25 * greatest(0, least(1, ln(n.total / d.df::DOUBLE) / ln(256)))) AS w FROM tf t JOIN df d USING (s), n),
size AS (SELECT doc_id, sum(w) AS w FROM weight GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS w FROM weight a JOIN weight b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM meet JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE meet.w / (x.w + y.w - meet.w) >= 0.8),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.b, r.c FROM reach r JOIN step s ON s.a = r.doc_id WHERE r.c < s.b)
SELECT doc_id, min(c) AS class_id, doc_id = min(c) AS kept FROM reach GROUP BY doc_id"""

OP3 = f"""WITH words AS ({_words('documents', 'doc_id')}), item AS ({_words('benchmark', 'item_id')}),
pattern AS (SELECT DISTINCT item_id, p, len(p) AS m FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w] ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS p FROM item) x),
place AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM pattern) y WHERE len(w) >= m),
hit AS (SELECT doc_id, i, q.m, item_id FROM place q JOIN pattern p ON p.m = q.m AND p.p = w[i:i + q.m - 1]),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) z GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hit) z GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, coalesce(f.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)"""


def _op4() -> str:
    from factlake.llm import cleaning as q

    def symbols(x: str, characters: str) -> str:
        return f"(length({x}) - length(translate({x}, '{characters}', '')))"

    boilerplate = q._BOILERPLATE.replace("'", "''")
    ends = q._ENDS.replace("'", "''")
    end = "rtrim(right(rtrim(x, ' '), 4), ' ')"
    navigation = f"({symbols('x', q._SEPARATORS)} >= {q._MANY} AND {symbols('x', q._SEPARATORS)} * 4 >= {symbols('x', ' ')})"
    stays = f"NOT {navigation} AND {symbols('x', q._MARKS)} * 10 <= length(x) AND (regexp_matches({end}, '{ends}') OR (length(x) >= {q.LONG_LINE} AND {symbols('x', q._STOPS)} * {q.LONG_LINE} >= length(x))) AND len(regexp_extract_all(x, '{boilerplate}')) * {q.LONG_LINE} < greatest(length(x), {q.LONG_LINE})"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d) x),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) y WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM again) z GROUP BY doc_id),
kept AS (SELECT *, list_filter(l, lambda x: {stays}) AS s FROM d),
num AS (SELECT doc_id, len(w)::BIGINT AS n_words, (length(t) - {symbols('t', '_').replace("'_'", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)")})::BIGINT AS word_chars, {symbols('t', '#*$%&|<>')}::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, (len(l) - len(s))::BIGINT AS n_lines_removed,
    coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS before, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS after FROM kept LEFT JOIN cover c USING (doc_id)),
bad AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM num)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, base_failed, NOT base_failed AND after >= before * 0.5 AS kept FROM bad"""


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::INT >> {15 - 5 * k}) & 31) + 1, 1)" for g in range(8) for k in range(4))
OP5 = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m"""

#: A repeated run of five words is the union of the repeated runs in it that no line could leave at one end: those are at
#: most five lines, so all of them can be named. This is another way than the operator's.
OP8 = r"""WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
numbered AS (SELECT doc_id, r, l[r] AS x, CASE WHEN regexp_matches(l[r], '\S') THEN sum(CASE WHEN regexp_matches(l[r], '\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r) - 1 END AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS r FROM raw) y),
line AS (SELECT doc_id, pos, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS x, len(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '\s+')) AS n FROM numbered WHERE pos IS NOT NULL),
total AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS t FROM line),
reach AS (SELECT a.doc_id, a.pos, b.pos AS last FROM total a JOIN total b ON b.doc_id = a.doc_id AND b.pos >= a.pos AND b.pos < a.pos + 5 AND b.t - a.t + a.n >= 5 AND (b.t - b.n - a.t + a.n < 5 OR b.t - a.t < 5)),
run AS (SELECT r.doc_id, r.pos, r.last, string_agg(b.x, chr(10) ORDER BY b.pos) AS s FROM reach r JOIN line b ON b.doc_id = r.doc_id AND b.pos BETWEEN r.pos AND r.last GROUP BY r.doc_id, r.pos, r.last),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS nth FROM run) z WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos::BIGINT, last::BIGINT + 1)) AS pos FROM later),
rest AS (SELECT n.doc_id, count(n.pos) AS n_lines, count(g.pos) AS n_removed, CASE WHEN count(n.pos) = count(g.pos) AND count(g.pos) > 0 THEN '' ELSE coalesce(string_agg(n.x, chr(10) ORDER BY n.r) FILTER (g.pos IS NULL), '') END AS text FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.pos = n.pos GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN r.text END AS text FROM documents d LEFT JOIN rest r USING (doc_id)"""

SQL: dict[str, str] = {"op1_near_dedup": OP1, "op3_decontaminate": OP3, "op4_quality_rules": _op4(), "op5_warc_revisits": OP5, "op8_line_dedup": OP8}
