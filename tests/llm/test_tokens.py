import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factlake.llm import packing, token_counts, token_files, tokens

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a  b", " a", "a ", "it's 'll x", "é é", "ß ﬁ ² ½ ٣", "<|endoftext|>", "a<|endoftext|> b", "<| x", "x" * 300, "…—’", "\x85   x", "中文 text", "a.\nB, c!\n\nd", "1st 22nd_3", "Ωσς İ"]


def documents(spark, texts, extra="lang string"):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_is_the_library(path):
    rng, t = random.Random(1), Tokenizer.from_file(path)
    alphabet = list("aeTé²½ \n '.,st3_٣́ßﬁ中—’İ\t\r") + ["'s", "the ", "<|endoftext|>", "<|"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens.encoder(path).encoded(texts) == want
    if path == BYTE:
        memory = tokens.counter(path)
        assert [tokens.counted(x, memory) for x in texts] == [len(w) // 4 for w in want]


def test_counts(spark):
    df = documents(spark, [None, "", "The word", "über", "The word"])
    rows = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, BYTE, 1).collect()}
    t = Tokenizer.from_file(BYTE)
    assert rows == {i: (len((x or "").encode()), n := len(t.encode(x or "").ids), n > 1) for i, x in enumerate([None, "", "The word", "über", "The word"])}
    assert token_counts.token_counts(df.limit(0), BYTE).count() == 0


def best_bins(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1 :])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_fullest_is_subset_sum():
    rng = random.Random(2)
    for _ in range(300):
        room, counts = rng.randint(0, 30), {x: rng.randint(1, 3) for x in rng.sample(range(1, 20), rng.randint(0, 5))}
        found = packing.fullest(room, sorted(counts, reverse=True), counts)
        assert all(found.count(x) <= counts[x] for x in found)
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= room}
        assert sum(found) == max(sums)


def test_combinations_use_everything_once():
    rng = random.Random(3)
    over = 0
    for _ in range(60):
        lengths = sorted((rng.randint(1, 12) for _ in range(rng.randint(0, 8))), reverse=True)
        histogram = {x: lengths.count(x) for x in lengths}
        found = packing.combinations(histogram, 12)
        used = defaultdict(int)
        for copies, times in found:
            assert sum(x * k for x, k in copies.items()) <= 12
            for x, k in copies.items():
                used[x] += k * times
        assert dict(used) == histogram
        over += sum(n for _, n in found) - best_bins(lengths, 12)
    assert over <= 1


def check_packing(spark, texts, capacity):
    rows = packing.pack_documents(documents(spark, texts), WORD, 1, capacity).collect()
    t, by_doc, by_sequence = Tokenizer.from_file(WORD), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        cut = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        assert sorted(by_doc[i]) == [(k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(cut)]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), rows


def test_packing(spark):
    rng = random.Random(4)
    texts = [None, "", "same words", "same words", *ODD] + [" ".join(rng.choice(["a", "bc", "def"]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    bins, rows = check_packing(spark, texts, 64)
    assert bins <= 1 + -(-sum(r.length for r in rows) // 64)
    assert packing.pack_documents(documents(spark, []), WORD).count() == 0
    assert check_packing(spark, ["x"] * 300, 7)[0] == 100


def test_packing_of_equal_rows(spark, monkeypatch):
    """One length and one row, many times: they are dealt to groups all the same."""
    monkeypatch.setattr(packing, "GROUP", 1)
    rows = packing.pack_documents(spark.createDataFrame([(None, "x y")] * 99, "doc_id long, text string"), WORD, 1, 7).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 99 and {r.length for r in rows} == {3} and len({r.sequence_id for r in rows}) == 50


def test_perfect_hash():
    for n in (1, 2, 3, 50, 2000):
        keys = [(i * 7, 0) for i in range(n)]
        seed, numbers, slots, hashes = token_files.perfect_hash(keys)
        assert sorted(slots) == list(range(n))
        table = np.zeros(n, token_files._SLOT)
        table["print"][slots], table["record"][slots] = np.array(hashes, np.uint64) >> np.uint64(32), range(n)
        assert [token_files.find(k, seed, numbers, table) for k in keys] == [(0, i) for i in range(n)]
        assert sum(token_files.find((-i - 1, 1), seed, numbers, table) is not None for i in range(500)) == 0


@pytest.mark.parametrize("shard_ids", [1 << 22, 2])
def test_token_files(spark, tmp_path, monkeypatch, shard_ids):
    texts = [None, *ODD, "last"]
    df = documents(spark, texts).union(spark.createDataFrame([(3, "again", "x"), (3, "again", "x"), (None, "no id", None)], "doc_id long, text string, lang string"))
    monkeypatch.setattr(token_files, "SHARD_IDS", shard_ids)
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(df, path, BYTE, 2, 50_257)
    t, start, want = Tokenizer.from_file(BYTE), 0, []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = token_files.checksums(token_files.read_tokens(spark, path, token_files.keys_of(df))).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    absent = spark.createDataFrame([(3, 1), (3, 9), (777, 0)], "doc_id long, copy long")
    assert [(r.doc_id, r.copy) for r in token_files.look_up(spark, path, absent).collect()] == [(3, 1)]


def test_token_files_of_one_key(spark, tmp_path, monkeypatch):
    """Rows of one doc_id, more than a task has, and rows without one: all are numbered through."""
    monkeypatch.setattr(token_files, "SHARD_RECORDS", 7)
    rows = [(5, f"text {i}") for i in range(150)] + [(None, "no id")] * 90 + [(4, "a"), (6, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = f"file://{tmp_path}/k"
    token_files.write_tokens(df, path, BYTE, 2, 50_257)
    found = token_files.read_tokens(spark, path, token_files.keys_of(df)).collect()
    assert sorted((r.doc_id or 0, r.copy) for r in found) == [*((0, i) for i in range(90)), (4, 0), *((5, i) for i in range(150)), (6, 0)]
    order = sorted(found, key=lambda r: (r.doc_id or 0, r.copy))
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    t = Tokenizer.from_file(BYTE)
    assert sorted(t.decode(np.frombuffer(r.ids, "<u4")[:-1].tolist()) for r in found) == sorted(x for _, x in rows)
    assert spark.read.parquet(f"{path}/manifest").agg({"n_records": "max"}).first()[0] <= 7


def test_token_files_empty(spark, tmp_path):
    df = documents(spark, [])
    token_files.write_tokens(df, f"file://{tmp_path}/e", BYTE, 2)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/e", token_files.keys_of(df)).count() == 0
