"""Token ids, packing and record files: exact round trips and plain versions."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docspark.llm import arrays, packing, records, tokens
from docspark.llm.queries import tokenizer
from docspark.session import shared_dir

ODD = [
    "", " ", "a  b \n\n c", " x", "it's I'll don't-x 3.5a.b", "<|endoftext|> ok", "ñ  x", "a\tb\r\n c", "x" * 5000, "日本 語 text", "é é", "A B",
    " é", "À É", "a×.b ÷, x", "l'été's é're", "…“q” — r", "a  b", "\n\na", "a \n", "1 2  3", "é a", "🙂 🙂🙂 .x",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder, got = tokens.Encoder(tokenizer(name), remembered=500), []
    for part in arrays.pieces_of(iter([pa.record_batch([pa.array(texts)], ["text"])]), "text", 50_000):
        ids, n = encoder.encode(*arrays.flat(part.column(0)))
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    whole = Tokenizer.from_file(tokenizer(name))
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_strings_give_the_ids_of_the_library(name):
    rng = random.Random(11)
    signs = [*"aIiZsd.,'%(-_<|>! \n\t\r0729", "İ", "ı", "é", "É", "ñ", "ß", "×", "÷", "ſ", "ǅ", "Σ", "ς", "日", "語", "\u0307", "\u0301", "🙂", "“", "\u00a0", "\u3000",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "I\u0307", "K", "ﬁ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 14))) for _ in range(100_000)]
    encoder, got = tokens.Encoder(tokenizer(name)), []
    for part in arrays.pieces_of(iter([pa.record_batch([pa.array(texts)], ["text"])]), "text", 200_000):
        ids, n = encoder.encode(*arrays.flat(part.column(0)))
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    want = [e.ids for e in Tokenizer.from_file(tokenizer(name)).encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(1, 2048) == [(0, 1)]
    assert packing.cut(2049, 2048) == [(0, 1), (1, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(50, 50, 2500), (50, 4, 2500), (50, 50, 900)])
def test_best_fit_holds_every_capacity(rule, limits):
    rng = random.Random(1)
    capacity, docs, cost = limits
    lengths = [(n, rng.randrange(1, 40)) for n in range(1, min(capacity, int(cost**0.5)) + 1)]
    runs, bins = packing.best_fit(lengths, capacity, docs, cost, rule)
    content, placed = {}, {n: [] for n, _ in lengths}
    for n, first, items, at, each, offset in runs:
        for j in range(items):
            content.setdefault(at + j // each, []).append((offset + j % each * n, n))
            placed[n].append(first + j)
    assert all(sorted(placed[n]) == list(range(c)) for n, c in lengths)
    assert set(content) == set(range(bins))
    for places in content.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity and len(places) <= docs and sum(n * n for _, n in places) <= cost
    if docs == capacity and cost == capacity**2 and rule == "norm":
        left = []  # plain best fit of one item after another
        for n in sorted((n for n, c in lengths for _ in range(c)), reverse=True):
            fits = [i for i, r in enumerate(left) if r >= n]
            if fits:
                left[min(fits, key=left.__getitem__)] -= n
            else:
                left.append(capacity - n)
        assert bins <= 1.01 * len(left) + 1


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 5000)], "doc_id long, text string")
    got = packing.pack(docs, tokenizer("byte_bpe_50k.json"), max_docs=2).collect()
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert all(len(x) <= 2 and sum(r.length for r in x) <= 2048 for x in by_sequence.values())
    assert packing.pack(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0
    small = packing.pack(docs, tokenizer("byte_bpe_50k.json"), max_cost=100 * 100).collect()
    assert max(r.length for r in small) == 100
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer("byte_bpe_50k.json"), capacity=0)
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer("byte_bpe_50k.json"), rule="other")


def test_frames():
    payloads = [b"", b"x", bytes(range(256)) * 50]
    data = b"".join(map(records.frame, payloads))
    at = 0
    for p in payloads:
        got, at = records.unframe(data, at)
        assert bytes(got) == p
    assert at == len(data)
    for i in (0, 5, 9, 13, len(data) - 1):
        damaged = bytearray(data)
        damaged[i] ^= 1
        with pytest.raises(Exception):  # noqa: B017
            at = 0
            while at < len(damaged):
                _, at = records.unframe(bytes(damaged), at)


def test_records_round_trip(spark):
    rows = [(5, "b c"), (None, "first"), (2, None), (9, "x " * 20_000), (2, "again"), (-3, ""), (5, "b c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    folder = f"{shared_dir(spark)}/records"
    path = tokenizer("word_bpe_49k.json")
    got = records.read_records(records.write_records(docs, path, folder), folder).orderBy("start").collect()
    whole = Tokenizer.from_file(path)
    assert [r.doc_id for r in got] == [None, -3, 2, 2, 5, 5, 9]
    at = 0
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(r.ids, np.uint32).tobytes()) and len(r.ids) == r.n_tokens
        at += r.n_tokens
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(tuple(whole.encode(t or "", add_special_tokens=False).ids + [2]) for _, t in rows)
    empty = f"{shared_dir(spark)}/records"
    assert records.read_records(records.write_records(docs.limit(0), path, empty), empty).count() == 0
    with pytest.raises(ValueError):
        records.write_records(docs.withColumn("doc_id", docs.doc_id.cast("string")), path, folder)
