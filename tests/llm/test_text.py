import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from factlake.llm import cleaning, common, decontaminate, language, lines, near_dedup

SCHEMA = "doc_id long, text string, n_words string, kept string, node string"
ODD = [None, "", " ", "\n\n", "!!!", "x", "a b c d", "é ü 中 文 ß", "x" * 50_000, "w " * 20_000]


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "clash", None, "clash") for i, t in enumerate(texts)], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_word_kernel():
    rng = random.Random(0)
    texts = ["".join(rng.choice(["A", "z", "9", " ", "-", "\0", "é", "中", "\n"]) for _ in range(rng.randint(0, 40))).encode() for _ in range(500)]
    for _, part in common.chunks(texts, 300):
        buf, starts, ends, hashes, first = common.words_of(part)
        want = [WORD.findall(t.lower()) for t in part]
        words = [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        assert words == [w for t in want for w in t] and np.diff(first).tolist() == [len(t) for t in want]
        assert len(set(hashes.tolist())) == len(set(words))


def shingles(text):
    w = WORD.findall((text or "").encode().lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else [])


def plain_classes(texts):
    """Classes by comparing all pairs."""
    s = [shingles(t) for t in texts]
    df = Counter(k for x in s for k in x)
    w = [{k: n * (0.75 + 0.25 * max(0, min(1, math.log(len(texts) / df[k]) / math.log(256)))) for k, n in x.items()} for x in s]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = sum(min(w[a][k], w[b][k]) for k in w[a].keys() & w[b].keys())
            if both and both / (sum(w[a].values()) + sum(w[b].values()) - both) >= 0.8:
                label = [label[b] if x == label[a] else x for x in label]
    least = {}
    for i, x in enumerate(label):
        least.setdefault(x, i)
    return [least[x] for x in label]


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = sentence(rng, 1)
    return " ".join(w)


def test_near_duplicates(spark):
    rng = random.Random(5)
    base = [sentence(rng, 120) for _ in range(6)]
    texts = [*ODD, *ODD[1:], *base, *base[:3], *(edited(rng, b, k) for b in base for k in (0, 1, 2, 3, 8))]
    hot = sentence(rng, 100)
    texts += [edited(rng, hot, rng.randint(0, 3)) for _ in range(60)] + [hot.upper()] * 5
    rows = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(plain_classes(texts)))
    kept = Counter(r.class_id for r in rows if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.class_id for r in rows}


def test_near_duplicates_rest(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "")], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert sum(r.kept for r in rows) == 3
    out = near_dedup.deduplicated(df.withColumn("lang", near_dedup.F.lit("en")))
    assert out.columns == ["doc_id", "text", "lang"] and sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, [near_dedup_row(None, text), near_dedup_row(None, None), near_dedup_row(2, "")]))


def near_dedup_row(doc_id, text):
    from pyspark.sql import Row

    return Row(doc_id=doc_id, text=text)


def test_components(spark):
    rng = random.Random(6)
    pairs = [(f"{a:03d}", f"{b:03d}") for a, b in [(i, i + 1) for i in range(40)] + [(rng.randrange(50, 90), rng.randrange(50, 90)) for _ in range(30)] if a < b]
    df = spark.createDataFrame([(a.encode(), b.encode()) for a, b in pairs], "a binary, b binary")
    label = {x: x for p in pairs for x in p}
    for _ in pairs:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {bytes(r.node).decode(): bytes(r.comp).decode() for r in near_dedup.components(df).collect()} == label


def agreement(s):
    return (s[0] == s[1]).mean()


UNWEIGHTED = near_dedup.Weights(np.empty(0, np.uint64), np.empty(0), 1.0)


def test_sketch_estimates():
    rng = random.Random(7)
    text = sentence(rng, 300)
    part = [text.encode(), edited(rng, text, 6).encode(), sentence(rng, 300).encode(), b"", b"one two"]
    s, some = near_dedup.sketches(part, UNWEIGHTED, 5)
    assert some.tolist() == [True, True, True, False, True]
    assert abs(agreement(s) - near_dedup.weighted_jaccard(part[0], part[1], UNWEIGHTED, 5)) < 0.12 and (s[0] == s[2]).mean() < 0.03


def repeating(rng, shared, tf, own):
    """Two texts with about so many common shingles, each tf times, and own ones."""
    passage = sentence(rng, shared)
    return [" ".join([passage] * tf + [sentence(rng, own)]) for _ in range(2)]


def test_samples_agree_as_the_weighted_jaccard():
    rng = random.Random(21)
    off = []
    for shared, tf, own in [(5, 60, 20), (30, 20, 60), (100, 3, 60), (60, 1, 12), (30, 20, 400)] * 12:
        part = [x.encode() for x in repeating(rng, shared, tf, own)]
        _, shingle, _ = near_dedup.document_shingles(part, 5)
        keys = np.unique(shingle)[::2]  # half of the shingles weigh less
        w = near_dedup.Weights(keys, np.linspace(0, 0.9, len(keys)), 1.0)
        off.append(agreement(near_dedup.sketches(part, w, 5)[0]) - near_dedup.weighted_jaccard(*part, w, 5))
    assert np.abs(off).max() < 0.17 and abs(np.mean(off)) < 0.02


def test_sketches_of_repeated_passages(spark):
    rng = random.Random(13)
    pairs = [repeating(rng, shared, tf, own) for shared, tf, own in [(30, 20, 60)] * 5 + [(5, 60, 20)] * 5 + [(100, 3, 30)] * 5 + [(30, 20, 400)] * 5]
    texts = [t for p in pairs for t in p]
    want = plain_classes(texts)
    assert [want[i] == want[i + 1] for i in range(0, 40, 2)] == [True] * 15 + [False] * 5
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()} == dict(enumerate(want))


def test_noted_weights_are_those_of_the_table(spark, monkeypatch):
    """Where the table of frequent shingles is too large to broadcast whole, nothing changes."""
    rng = random.Random(15)
    passage = sentence(rng, 60)
    texts = [*ODD, *(f"{passage} {sentence(rng, k)}" for k in (3, 5, 8, 11, 14, 17)), *(edited(rng, passage, 1) for _ in range(10))]
    whole = near_dedup.near_duplicates(documents(spark, texts)).collect()
    monkeypatch.setattr(near_dedup, "TABLE_BYTES", 400)
    assert sorted(map(str, near_dedup.near_duplicates(documents(spark, texts)).collect())) == sorted(map(str, whole))
    assert {r.doc_id: r.class_id for r in whole} == dict(enumerate(plain_classes(texts)))


def test_verified_pairs_grow_with_the_group(spark, monkeypatch):
    """Texts that are near, but mostly under the threshold: no bucket becomes all pairs."""
    seen = []
    verified = near_dedup._verified

    def counted(pairs, *rest):
        seen[-1] += pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    for n in (100, 200, 400):
        rng = random.Random(n)
        base = sentence(rng, 400)
        seen.append(0)
        near_dedup.near_duplicates(documents(spark, [edited(rng, base, 6) for _ in range(n)])).collect()
    assert seen[2] < 2.6 * seen[1] and seen[1] < 2.6 * seen[0] and seen[2] < 400 * 2 * near_dedup.BANDS


@pytest.mark.parametrize("columns", [near_dedup.COLUMNS, 7])
def test_overlaps_are_those_of_pairs(monkeypatch, columns):
    monkeypatch.setattr(near_dedup, "COLUMNS", columns)
    rng = random.Random(31)
    base = sentence(rng, 60)
    texts = [*(edited(rng, base, k) for k in range(9)), *repeating(rng, 5, 30, 20), *repeating(rng, 20, 3, 9), "a b", "a b", "", sentence(rng, 50)] * 2
    texts += [sentence(rng, 20) for _ in range(60)]
    part = [x.encode() for x in texts]
    _, shingle, _ = near_dedup.document_shingles(part, 5)
    keys = np.unique(shingle)[::2]
    w = near_dedup.Weights(keys, np.linspace(0, 0.9, len(keys)), 1.0)
    every = np.arange(len(part))
    for left, right in ((every, every), (every[::3], every[1::3]), (every[:1], every[1:])):
        both, total = near_dedup.overlaps(part, left, right, w, 5)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                union = total[a] + total[b] - both[i, j]
                assert a == b or abs((both[i, j] / union if union else 0) - near_dedup.weighted_jaccard(part[a], part[b], w, 5)) < 1e-12


def close_texts():
    """60 texts whose pairs lie about the threshold: which of them are linked decides the classes."""
    rng = random.Random(1)
    base = sentence(rng, 400)
    return [edited(rng, base, 5) for _ in range(60)]


@pytest.mark.parametrize(("rounds", "block", "bytes_"), [(2, 1024, 1 << 21), (0, 7, 1 << 21), (0, 1024, 3000)])
def test_all_pairs_of_a_bucket_are_compared(spark, monkeypatch, rounds, block, bytes_):
    """A bucket's links are all found, however few rounds there are and however its members are cut into blocks."""
    texts = close_texts()
    for name, value in (("ROUNDS", rounds), ("BLOCK", block), ("BLOCK_BYTES", bytes_)):
        monkeypatch.setattr(near_dedup, name, value)
    want = dict(enumerate(plain_classes(texts)))
    assert len(set(want.values())) == 15
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()} == want


@pytest.mark.parametrize("group", [near_dedup.GROUP, 2])
def test_pairs_that_share_no_bucket_are_found(spark, monkeypatch, group):
    """With bands so long that samples bring no two texts together, the classes are still those of all pairs."""
    rng = random.Random(33)
    base = [sentence(rng, n) for n in (5, 9, 60, 150, 400)]
    texts = [*ODD, *base, *(edited(rng, b, k) for b in base for k in (1, 1, 2, 3, 5, 8)), *(x for _ in range(4) for x in repeating(rng, 30, 5, 40))]
    texts += [f"{base[2]} {sentence(rng, k)}" for k in (2, 7, 12, 18, 40)] + close_texts()
    for name, value in (("BANDS", 2), ("ROWS", 72), ("ROUNDS", 0), ("GROUP", group)):
        monkeypatch.setattr(near_dedup, name, value)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(spark, texts)).collect()} == dict(enumerate(plain_classes(texts)))


def test_similar_texts_have_a_key_in_common():
    rng = random.Random(34)
    base = sentence(rng, 100)
    part = [x.encode() for x in [*(edited(rng, base, k % 5) for k in range(40)), *repeating(rng, 10, 20, 30), *repeating(rng, 60, 1, 9), "a b", "", "a b c d e f"]]
    doc, shingle, tf = near_dedup.document_shingles(part, 5)
    keys = np.unique(shingle)[::2]
    w = near_dedup.Weights(keys, np.linspace(0, 0.9, len(keys)), 1.0)
    key, share, n, weight, rest = near_dedup.prefixes(len(part), doc, shingle, w.of(shingle, tf), np.arange(256, dtype=np.uint8), 0.8)
    cuts = np.concatenate([[0], np.cumsum(n)])
    own = [dict(zip(key[i:j].tolist(), share[i:j].tolist(), strict=True)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    similar = 0
    for a in range(len(part)):
        assert abs(sum(own[a].values()) + rest[a] - weight[a]) < 1e-6 and (rest[a] < 0.8 * weight[a] or not part[a])
        for b in range(a):
            both = sum(min(own[a][k], own[b][k]) for k in own[a].keys() & own[b].keys())
            j = near_dedup.weighted_jaccard(part[a], part[b], w, 5)
            assert both + max(rest[a], rest[b]) >= j / (1 + j) * (weight[a] + weight[b]) - 1e-6
            similar += j >= 0.8
            assert j < 0.8 or both
    assert similar > 50


def test_neighbours_over_tasks(spark):
    rng = random.Random(16)
    rows = [(rng.randrange(3), bytes([rng.randrange(4)]), f"n{i:03d}".encode(), bytes([65 + rng.randrange(2)])) for i in range(150)]
    df = spark.createDataFrame(rows, "band long, place binary, node binary, comp binary").repartition(5)
    order = sorted(rows)
    want = {(x[2], y[2]) for x, y in zip(order, order[1:]) if x[0] == y[0] and x[3] != y[3]}
    assert {(bytes(r.a), bytes(r.b)) for r in near_dedup.neighbours(df).collect()} == want and want


def shuffled_bytes(spark, make):
    """What make() writes to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    out = make()
    return sum(n for k, n in total().items() if k not in before), out


def test_texts_that_are_not_compared_are_not_shuffled(spark):
    rng = random.Random(67)
    texts = [" ".join(f"{rng.getrandbits(10000):x}" for _ in range(12)) for _ in range(300)]
    texts += texts[:2] * 40 + [f"{x} end" for x in texts[2:4]]
    moved, rows = shuffled_bytes(spark, lambda: near_dedup.near_duplicates(documents(spark, texts)).collect())
    want = {**{i: i for i in range(300)}, **{300 + i: i % 2 for i in range(80)}, 380: 2, 381: 3}
    assert {r.doc_id: r.class_id for r in rows} == want
    assert moved < 0.3 * sum(map(len, texts))


@pytest.mark.parametrize("limit", [1 << 13, 16 << 20])
def test_the_filter_lets_all_chosen_rows_through(spark, monkeypatch, limit):
    monkeypatch.setattr(near_dedup, "FILTER_BYTES", limit)
    rows = spark.createDataFrame([(i if i % 5 else None, f"t{i}", "x") for i in range(20000)], "doc_id long, name string, text string")
    chosen = rows.where("pmod(hash(name), 4) = 0").selectExpr("doc_id AS i", "name AS k")
    n = chosen.count()
    got = near_dedup.among(rows, ["name", "doc_id"], chosen, ["k", "i"], n)
    assert n == got.where("pmod(hash(name), 4) = 0").count() <= got.count() <= (n + 200 if limit > 1 << 16 else 14000)
    assert near_dedup.among(rows, ["name"], chosen.limit(0), ["k"], 0).count() == 0


def test_columns_of_other_names_stay(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 5, "y"), (2, "a b c d e f", "x", 6, "z")], "doc_id long, text string, _own string, _id long, node string")
    assert [tuple(r) for r in near_dedup.deduplicated(df).collect()] == [(1, "a b c d e f", "x", 5, "y")]


def plain_contamination(text, items):
    def words(x):
        return WORD.findall((x or "").encode().lower())

    w, hit, found = words(text), set(), set()
    for i, x in items:
        p = words(x)
        for k in range(max(1, len(p) - 9) if p else 0):
            window = p[k : k + 10]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [4_000_000, 30])
def test_decontamination(spark, monkeypatch, block_words):
    rng = random.Random(8)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    items = [(i, " ".join(rng.choice(["a", "b"]) for _ in range(n))) for i, n in enumerate([14, 12, 10, 7, 3])] + [(5, sentence(rng, 30)), (6, None), (7, "..."), (10, "Zebra"), (None, "zz")]
    items.append((11, items[0][1].upper()))
    texts = [*ODD[:8], *(" ".join(rng.choice(["a", "b", "c"]) for _ in range(60)) for _ in range(20)), "x, " + items[5][1].replace(" ", "-- "), "zebra zz ZEBRA"]
    texts += texts[-2:]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_contaminated(documents(spark, texts), bench).collect()}
    assert rows == {i: plain_contamination(t, [x for x in items if x[0] is not None]) for i, t in enumerate(texts)}
    clean = decontaminate.decontaminated(documents(spark, texts), bench)
    assert clean.schema.simpleString() == documents(spark, []).schema.simpleString()
    assert {r.doc_id for r in clean.collect()} == {i for i, r in rows.items() if not r[4]}


@pytest.mark.parametrize("block_words", [4_000_000, 1])
def test_decontamination_by_items_without_id(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    bench = spark.createDataFrame([(None, "zz"), (1, "zebra"), (None, "zebra"), (None, "a b")], "item_id long, text string")
    docs = documents(spark, ["zebra zz ZEBRA", "a b zz", "clean", "zebra"])
    rows = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_contaminated(docs, bench, unnamed=True).collect()}
    none, one = (hashlib.sha256(x).hexdigest() for x in (b"", b"1"))
    assert rows == {0: (3, 1, one, True), 1: (3, 0, none, True), 2: (0, 0, none, False), 3: (1, 1, one, True)}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench, unnamed=True).collect()] == [2]


def test_decontamination_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.find_contaminated(documents(spark, ["a b"]), none).collect()] == [False]
    assert decontaminate.find_contaminated(documents(spark, []), none).count() == 0


def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, covered = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            covered.update((k, k + 1, k + 2))
    own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(own) - len(set(own)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark):
    rng = random.Random(9)
    texts = [*ODD, *(" ".join(rng.choice(["a", "b", "c", "d|", "é\n", "#"]) for _ in range(rng.randint(0, 120))) for _ in range(80)), "𝒳 \x85  x " * 20]
    rows = {r.doc_id: tuple(r)[1:6] + (r.base_failed,) for r in cleaning.judged(documents(spark, texts)).collect()}
    assert rows == {i: plain_base(t) for i, t in enumerate(texts)}
    assert cleaning.judged(documents(spark, [])).count() == 0


def test_line_rules(spark):
    rng = random.Random(10)
    prose = "\n".join(sentence(rng, 20).capitalize() + "." for _ in range(4))
    menu = "\n".join("Home | News | Sport | About us" for _ in range(20)) + "\n" + prose
    long_ = " ".join(sentence(rng, 20).capitalize() + "." for _ in range(9))
    notice = "All rights reserved. " + " ".join(f"We use cookies, see the privacy policy of {sentence(rng, 6)}." for _ in range(5))
    texts = [prose, menu, prose + "\nHome | News | Sport | About\nAll rights reserved.\nno end here", f"{long_} and so on", f"{prose}\n{prose}\n{prose}\n{notice}", f"{prose}\n{prose}\n{prose}\n{sentence(rng, 70)}", f"{long_} Read more."]
    rows = cleaning.judged(documents(spark, texts)).orderBy("doc_id").collect()
    thrice = "\n".join([prose] * 3)
    assert len(long_) > 300 < len(notice)
    assert [(r.n_lines_removed, r.text) for r in rows] == [(0, prose), (20, prose), (3, prose), (0, texts[3]), (1, thrice), (1, thrice), (0, texts[6])]
    assert [r.kept for r in rows[:4]] == [True, False, True, True]


def plain_maximal_runs(docs, least):
    """Removed lines: from each place the longest run that also begins earlier, if it has `least` words."""
    places = [([x.strip() for x in (text or "").split("\n") if x.strip()], i) for i, text in docs]
    gone = defaultdict(set)
    for j, (b, i) in enumerate(places):
        for q in range(len(b)):
            for k, (a, _) in enumerate(places[: j + 1]):
                for p in range(q if k == j else len(a)):
                    n = 0
                    while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                        n += 1
                    if sum(len(x.split()) for x in b[q : q + n]) >= least:
                        gone[i].update(range(q, q + n))
    return gone


@pytest.mark.parametrize("least", [1, 5, 9])
def test_line_dedup(spark, least):
    rng = random.Random(14)
    pool = [sentence(rng, n) for n in (1, 1, 1, 2, 2, 3, 6, 12)]
    texts = [*ODD, *("\n".join(rng.choice([*pool, "", " ", sentence(rng, 3)]) for _ in range(rng.randint(0, 14))) for _ in range(60))]
    long_ = [rng.choice(pool[3:]) for _ in range(23)]
    texts += [*texts[-3:], f"{pool[7]}\n{pool[3]}\nother", f"{pool[7]}\n{pool[3]}", "\n".join(long_), "\n".join([pool[0], *long_[2:], *long_[:4]]), "\n".join([pool[1]] * 21)]
    texts += ["alpha beta gamma delta epsilon\nx\nfirst one of all", "alpha beta gamma delta epsilon\nx\nsecond one", "a1 b1 c1\nd1 e1 f1\nq\nA", "a1 b1 c1\nd1 e1 f1\nq\nB"]
    gone = plain_maximal_runs(enumerate(texts), least)
    assert least != 5 or [gone[i] for i in range(len(texts) - 4, len(texts))] == [set(), {0, 1}, set(), {0, 1, 2}]
    for r in lines.deduplicate_lines(documents(spark, texts), least).collect():
        own = [x for x in (texts[r.doc_id] or "").split("\n") if x.strip()]
        left = [x for k, x in enumerate(own) if k not in gone[r.doc_id]]
        assert (r.n_lines, r.n_removed) == (len(own), len(gone[r.doc_id]))
        assert (r.text is None) == (texts[r.doc_id] is None) and [x for x in (r.text or "").split("\n") if x.strip()] == left


def test_suffix_levels_are_suffix_arrays(spark):
    rng = random.Random(12)
    seqs = {f"d{i}": [rng.choice("abc") for _ in range(rng.randint(1, 9))] for i in range(8)}
    df = spark.createDataFrame([(int(d[1:]), d.encode(), p, x.encode()) for d, s in seqs.items() for p, x in enumerate(s)], "doc_id long, doc binary, pos int, line binary")
    whole = ["".join(s) for s in seqs.values()]
    longest = max(n for i, a in enumerate(whole) for n in range(1, 10) for p in range(len(a) - n + 1) if any(a[p : p + n] in b for b in whole[:i] + whole[i + 1 :]) or a.find(a[p : p + n], p + 1) >= 0)
    levels = lines.suffix_levels(df)
    assert len(levels) == longest.bit_length()
    for k, level in enumerate(levels):
        width = 1 << k
        runs = {(d, p): "".join(s[p : p + width]) for d, s in seqs.items() for p in range(len(s) - width + 1)}
        n = Counter(runs.values())
        rows = {(bytes(r.doc).decode(), r.pos): r["rank"] for r in level.collect()}
        assert set(rows) == {k for k, x in runs.items() if n[x] > 1}
        order = sorted({runs[k] for k in rows})
        ranks = {x: {r for k, r in rows.items() if runs[k] == x} for x in order}
        assert all(len(r) == 1 for r in ranks.values()) and [min(ranks[x]) for x in order] == sorted(min(r) for r in ranks.values())


def test_longest_common_prefixes(spark):
    rng = random.Random(17)
    seqs = [[rng.choice("ab") for _ in range(rng.randint(0, 19))] for _ in range(12)]
    seqs += [seqs[3], seqs[4][3:], ["z"] * 13]
    df = spark.createDataFrame([(i, b"%d" % i, p, x.encode()) for i, s in enumerate(seqs) for p, x in enumerate(s)], "doc_id long, doc binary, pos int, line binary")
    at = [(i, p) for i, s in enumerate(seqs) for p in range(len(s))]

    def common(x, y):
        n = 0
        for a, b in zip(seqs[x[0]][x[1] :], seqs[y[0]][y[1] :]):
            if a != b:
                break
            n += 1
        return n

    want = {x: max((common(x, y) for y in at[:k]), default=0) for k, x in enumerate(at)}
    rows = lines.repeated_runs(df).collect()
    assert {(r.doc_id, r.pos): r.n for r in rows} == {k: n for k, n in want.items() if n} and len(rows) == sum(n > 0 for n in want.values())


def test_line_dedup_rest(spark):
    clash = spark.createDataFrame([(1, "a b c d e f", 77, 5), (2, "a b c d e f\ng", 78, 6), (3, "a b c d e f", 1, 1)], "doc_id long, text string, n_lines long, _text long")
    assert sorted(map(tuple, lines.without_copied_lines(clash).collect())) == [(1, "a b c d e f", 77, 5), (2, "g", 78, 6)]
    assert lines.deduplicate_lines(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in lines.deduplicate_lines(df).collect()) == [(0, "g h i j k l"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "")]


@pytest.mark.parametrize("languages", [512, 3])
def test_language(spark, sf_dir, monkeypatch, languages):
    monkeypatch.setattr(language, "LANGUAGES", languages)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(docs.where(~language.is_held_out()))
    rows = language.identify(docs.where(language.is_held_out()), model, ["lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    odd = language.identify(documents(spark, [*ODD, "123 ..² ½"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [True] * 5 + [False] * 5 + [True] and odd[0].score == 0.0
    nothing = language.train(docs.limit(0))
    assert [r.lang_pred for r in language.identify(documents(spark, ["abc"]), nothing).collect()] == ["und"]
    clash = spark.createDataFrame([("abc", 7, "x")], "text string, score int, lang_pred string")
    assert [tuple(r) for r in language.judged(clash, model).select("_row.*").collect()] == [("abc", 7, "x")]


def plain_grams(text):
    """Counts of hashed n-grams by the definition: 1 to 3 letters or edges of words, none over the space between words."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not any(ch.isalpha() for w in words for ch in w):
        return Counter()
    grams = [g for w in words for n in (1, 2, 3) for t in [f" {w} " if n > 1 else w] for g in (t[k : k + n] for k in range(len(t) - n + 1))]

    def bucket(g):
        h = 0
        for ch in g:
            h = (h * 0x100000001B3 + ord(ch)) % 2**64
        h = (h + (len(g) << 40)) % 2**64
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        h = (h ^ h >> 27) * 0x94D049BB133111EB % 2**64
        return (h ^ h >> 31) % 2**14

    return Counter(map(bucket, grams))


@pytest.mark.parametrize("languages", [512, 2])
def test_language_is_naive_bayes(spark, monkeypatch, languages):
    """Predictions and posteriors against sums over counts by hand."""
    monkeypatch.setattr(language, "LANGUAGES", languages)
    rng = random.Random(18)
    names = {"aa": "abcde é", "bb": "cdefg ", "cc": "efgha ", "dd": "hiöjk ", "ee": "abkjh "}
    docs = [("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", " 12 ", "_x"]), rng.choice([lang, lang, None])) for lang, letters in names.items() for _ in range(12)]
    docs += [(None, "aa"), ("1 2", "bb"), ("ßSS İ", "cc")]
    counts, rows = defaultdict(Counter), Counter()
    for text, lang in docs:
        if lang and (grams := plain_grams(text)):
            counts[lang] += grams
            rows[lang] += 1
    model = language.train(spark.createDataFrame(docs, "text string, lang string").repartition(5))
    assert model.languages == sorted(rows) and model.rows == [rows[k] for k in sorted(rows)]
    asked = ["".join(rng.choice("abcdefghijköé ") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "7"]
    got = language.identify(documents(spark, asked), model).orderBy("doc_id").collect()
    for text, r in zip(asked, got, strict=True):
        grams = plain_grams(text)
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        log = {k: math.log(rows[k] / sum(rows.values())) + sum(n * math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * 2**14)) for g, n in grams.items()) for k in rows}
        best = max(log, key=log.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(x - log[best]) for x in log.values())) < 1e-3
