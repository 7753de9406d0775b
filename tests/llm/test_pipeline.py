import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_text import close_texts, edited, plain_classes, plain_contamination, plain_grams, plain_maximal_runs
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from factlake.llm import common, decontaminate, near_dedup, oracles, queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "...", None, "s", 3), (90003, "", None, None, None)], docs.schema)
    docs = common.scratch(docs.union(odd), "documents")
    names, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.scratch(stage(spark, docs, sf_dir), name)
        kept[name] = (before, docs)
        if name != "pack":
            assert docs.columns == names
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept["language"][0]) - ids(kept["language"][1]) >= {90001, 90002, 90003}
    classes = near_dedup.near_duplicates(kept["near_dedup"][0]).collect()
    assert ids(kept["near_dedup"][1]) == {r.doc_id for r in classes if r.kept}
    bad = decontaminate.find_contaminated(kept["decontaminate"][0], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    assert ids(kept["decontaminate"][0]) - ids(kept["decontaminate"][1]) == ids(bad) != set()
    assert ids(docs) == ids(kept["decontaminate"][1])


def test_near_dedup_stage_keeps_one_of_each_class(spark):
    texts = close_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()} == set(plain_classes(texts))


def test_registered():
    names = set(__spark_entry__.queries())
    assert names >= set(queries.queries()) | {"pipeline"} and sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cursor = duck.execute(oracles.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    rows = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted((tuple(r[n] for n in order) for r in df.collect()), key=repr) == sorted((tuple(r[n] for n in order) for r in rows), key=repr)


def plain_pipeline(docs, items):
    """Pieces (doc_id, piece, start, length, crc) of the pipeline, stage by stage, by the plain versions of its operators."""
    counts, rows = defaultdict(Counter), Counter()
    for i, text, lang in docs:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1 and (grams := plain_grams(text)):
            counts[lang] += grams
            rows[lang] += 1
    kept = []
    for i, text, _ in docs:
        grams = plain_grams(text)
        log = {k: math.log(rows[k] / sum(rows.values())) + sum(n * math.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * 2**14)) for g, n in grams.items()) for k in rows}
        if grams and 1 / sum(math.exp(x - max(log.values())) for x in log.values()) >= 0.5:
            kept.append((i, text))
    gone, cut = plain_maximal_runs(kept, 5), []
    for i, text in kept:
        at, left = 0, []
        for x in text.split("\n"):
            at += bool(x.strip())
            if not (x.strip() and at - 1 in gone[i]):
                left.append(x)
        if not gone[i] or any(x.strip() for x in left):
            cut.append((i, "\n".join(left)))
    classes = plain_classes([text for _, text in cut])
    least = [x for k, x in enumerate(cut) if classes[k] == k]
    clean = [x for x in least if not plain_contamination(x[1], items)[1]]
    t, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, text in clean:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            out.add((i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())))
    return out, [len(kept), len(cut), len(least), len(clean)]


def test_pipeline_against_plain_versions(spark, tmp_path):
    rng = random.Random(20)
    letters = {"aa": "abcdefg", "bb": "defghij"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    items = [(1, line("aa", 14)), (None, line("bb", 4)), (3, None)]
    shared = [line("aa", 12), line("aa", 2), line("bb", 9)]
    docs = []
    for lang in letters:
        docs += [("\n".join(line(lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))), lang) for _ in range(12)]
        docs += [(f"{line(lang, 20)}\n{shared[0]}\n{shared[1]}\n{line(lang, 9)}", rng.choice([lang, None])) for _ in range(3)]
        docs += [(f"{line(lang, 30)} {items[0][1]} {word(lang)}", lang), (f"{line(lang, 30)} {items[1][1]}", lang), (shared[2], lang), (shared[2], lang)]
    base = line("aa", 100)
    docs += [(edited(rng, base, k), "aa") for k in (0, 1, 2, 3, 12)] + [(base, "bb"), (None, "aa"), ("", None), ("1 2 3 4 5 6", "aa"), (line("bb", 6000), "bb")]
    rng.shuffle(docs)
    docs = [(i, *x) for i, x in enumerate(docs)]
    frame = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, sizes = plain_pipeline(docs, items)
    assert len(docs) > sizes[0] > sizes[1] > sizes[2] > sizes[3] > 20
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found} == want and len(found) == len(want)
    at = Counter()
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096
