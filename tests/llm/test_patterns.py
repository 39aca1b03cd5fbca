"""Periodic runs, collocations and pattern packing against plain versions."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import collocations, patterns, periods, queries

BYTE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark, tmp_path, rows, schema):
    """A folder with `documents`, as queries read it."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# 11


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), max_size=5), times=st.integers(1, 12), deepest=st.sampled_from([None, 1, 3, 17]))
def test_runs_of_random_words(texts, times, deepest):
    texts = [w[:9] * times + w for w in texts]
    for w, got in zip(texts, periods._several(texts, 6, 4, deepest), strict=True):
        if got is None:
            assert deepest is not None
            continue
        expected = brute.runs(w, 6, 4)
        assert list(map(tuple, got[0].T.tolist())) == expected
        gone = {i for s, size, q in expected for i in range(s + q, s + size)}
        assert got[1] == [x for i, x in enumerate(w) if i not in gone]


def test_runs_by_other_limits():
    w = [b"%d" % (k % 7) for k in range(40)] + [b"x"] * 5
    for least, exponent in ((2, 2), (6, 3), (14, 2)):
        got = next(periods._several([w], least, exponent))[0]
        assert list(map(tuple, got.T.tolist())) == brute.runs(w, least, exponent)


def periodic_rows():
    r = random.Random(3)
    rows = []
    for k in range(160):
        w = [r.choice(["ab", "é", "x", "Wort", "🎉"]) for _ in range(r.randint(0, 90))]
        rows.append((k, r.choice([" ", "\n", " \t", "\x0b"]).join(w)))
    # ids whose words the contract makes periodic, long texts among them
    ids = [k for k in range(200, 2000) if zlib.crc32(str(k).encode()) % 10 == 0][:40]
    rows += [(k, " ".join(f"w{r.randrange(400)}" for _ in range(r.randint(1, 900)))) for k in ids]
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "a " * 3000), (5005, ("p q r s t " * 70) + "u " + ("p q r s t " * 70)), (5006, "a\x1cb " * 8), (3, "again " * 9), (3, "again " * 9)]
    return rows


def test_periods_query(spark, tmp_path):
    rows = periodic_rows()
    frame = queries.op11_periods(spark, table(spark, tmp_path, rows, "doc_id long, text string"))
    assert dict(frame.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    got = sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in frame.collect()), key=str)
    assert got == sorted(((k, *brute.periods(k, t)) for k, t in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_texts_that_go_on_are_refined_together(spark, monkeypatch):
    monkeypatch.setattr(periods, "BATCH", 300)
    monkeypatch.setattr(periods, "SHALLOW", 4)
    rows = [(k, t) for k, t in periodic_rows() if k < 5000]
    found = {}
    for r in _here(rows):
        found.setdefault(r[0], []).append(r[1:])
    for k, t in rows:
        assert (len(brute.words(t)), brute.runs(brute.words(t), 6, 4)) in found[k]


def _here(rows):
    """The function of find_runs over one batch, without Spark."""
    import pyarrow as pa

    held = {}

    class Frame:
        class Field:
            from pyspark.sql import types as T

            dataType = T.LongType()

        schema = {"doc_id": Field}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            held["run"] = run

    import unittest.mock

    with unittest.mock.patch.object(periods, "F"):
        periods.find_runs(Frame())
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([None if t is None else t.encode() for _, t in rows], pa.binary())], ["doc_id", "text"])
    for out in held["run"](iter([batch.slice(0, 50), batch.slice(50)])):
        for r in out.to_pylist():
            yield r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]]


# 12


def spoken(seed=4, n=300):
    r = random.Random(seed)
    fixed = ["new york city hall", "ad hoc", "a a a a a", "to be or not to be", "Ünit test é"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 8)):
            parts.append(r.choice(fixed) if r.random() < 0.5 else " ".join(r.choice(["the", "of", "x", "y", "THE"]) for _ in range(r.randint(1, 6))))
            parts.append(r.choice([" ", ". ", ",", "\n", ";", "\t", "!?", "\x0b"]))
        rows.append((r.choice(["en", "de", None, "und", ""]), "".join(parts)))
    return [*rows, ("en", None), ("en", ""), ("fr", " ,.;"), ("en", "a\x1cb a\x1cb"), *[("de", "ad hoc")] * 40]


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, small, monkeypatch):
    rows = spoken()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, shard int, phrase string").repartition(4)
    if small:
        # many shards, batches that are cut, and filters that are full of false hits
        shards = collocations.shards
        monkeypatch.setattr(collocations, "shards", lambda d: shards(d, 64))
        filled = collocations.bit_filter
        monkeypatch.setattr(collocations, "bit_filter", lambda x: filled(x) | np.uint8(0xAA))
    got = sorted(map(tuple, collocations.collocations(docs, least=12).collect()))
    expected = brute.collocations(rows, 12)
    assert got == expected
    assert len({r[0] for r in got}) >= 4 and max(len(r[2].split()) for r in got) == 5


def test_bitmaps_in_small_batches(monkeypatch):
    r = np.random.default_rng(2)
    tokens = r.integers(0, 6, 2000).astype(np.int32)
    starts = r.random(2000) < 0.2
    starts[0] = True
    maps = collocations.Bitmaps(np.where(starts, ~tokens, tokens), np.ones(6, bool))
    phrase, word, block, bits = maps.extend(maps.word, maps.block, maps.bits)
    found = {}
    for p, w, n in zip(phrase.tolist(), word.tolist(), np.bitwise_count(bits).tolist(), strict=True):
        found[p, w] = found.get((p, w), 0) + n
    expected = {}
    for k in range(1, 2000):
        if not starts[k]:
            pair = int(tokens[k - 1]), int(tokens[k])
            expected[pair] = expected.get(pair, 0) + 1
    assert found == expected


def test_top_of_each_language(spark):
    rows = spoken()
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=12, longest=3, top=2).collect()))
    assert got == brute.collocations(rows, 12, 3, 2)


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    big = 10**13
    every = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)], "lang string, phrase string, k int, f long")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (every, spark.createDataFrame([("en", 9 * big)], "lang string, n long")))
    (r,) = collocations.collocations(every).collect()
    assert r.score == 1000 * (big - 2) * 9 * big // (big * (big - 1))


def test_no_documents(spark, empty, nulls):
    assert collocations.collocations(empty).count() == 0
    assert periods.find_runs(empty).count() == 0
    assert patterns.pack_few(empty, BYTE).count() == 0
    assert sorted((r.doc_id for r in periods.find_runs(nulls).collect()), key=str) == [5, 5, 6, 6, None, None]
    assert sorted((r.doc_id for r in patterns.pack_few(nulls, BYTE).collect()), key=str) == [5, 5, 6, 6, None, None]


# 13


def checked(rows, got, longest):
    """All that op13 promises of its rows; returns the number of sequences."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = False
    expected = []
    for k, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        rest = len(ids) % longest if len(ids) > longest else len(ids)
        starts = [*([0] if rest else []), *range(rest, len(ids), longest)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected.append((k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(expected, key=str) == sorted((tuple(r)[:5] for r in got), key=str)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= longest
    return len(held)


@pytest.mark.parametrize("longest", [64, 2048, 50])
def test_packing_into_few(spark, docs, rows, longest):
    got = patterns.pack_few(docs, BYTE, {"<|endoftext|>": 50256}, 0, longest, digest=True).collect()
    n = checked(rows, got, longest)
    lengths = [r.length for r in got]
    assert n <= sum(lengths) / longest * 1.05 + 2 + sum(x > longest / 2 for x in lengths) * 0.1


def test_packing_query(spark, tmp_path, rows):
    frame = queries.op13_pattern_packing(spark, table(spark, tmp_path, rows, "doc_id long, text string"))
    assert [c for c, _ in frame.dtypes] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    checked(rows, frame.collect(), 2048)


def test_numbers_in_many_groups(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(patterns, "GROUP", 5)
    checked(rows, patterns.pack_few(docs, BYTE, {"<|endoftext|>": 50256}, 0, 64, digest=True).collect(), 64)


def test_sequences_hold_their_pieces(spark, docs):
    packed = patterns.pack_few(docs, BYTE, None, 0, 128)
    ids = {(r.sequence_id, r.offset): bytes(r.ids) for r in packed.collect()}
    for r in patterns.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(ids[r.sequence_id, b] for b in r.bounds) and len(r.ids) == 4 * r.n_tokens


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 512), max_size=200), longest=st.sampled_from([512, 600]))
def test_plans_place_every_piece(lengths, longest):
    histogram = np.bincount(lengths, minlength=longest + 1)
    made = patterns.plan(histogram, longest)
    number, held = {}, {}
    for size in lengths:
        k = number[size] = number.get(size, -1) + 1
        sequence, offset = made.place(np.array([size]), np.array([k]))
        held.setdefault(int(sequence[0]), []).append((int(offset[0]), size))
    assert len(held) == made.sequences
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= longest


def test_few_sequences_for_many_pieces():
    r = np.random.default_rng(0)
    for lengths in (np.clip(r.lognormal(6.3, 0.9, 200000).astype(int), 1, 2048), r.integers(1, 2048, 200000), r.integers(1, 300, 20000), np.full(5000, 700)):
        histogram = np.bincount(lengths, minlength=2049)
        least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert patterns.plan(histogram, 2048).sequences <= max(1.002 * least + 1, -(-len(lengths) // 2) if lengths.min() > 682 else 0)
    assert patterns.fit(patterns.patterns(np.array([64, 192])), np.bincount([64, 192] * 50, minlength=257)).tolist() == pytest.approx([50])


def test_texts_are_numbered_a_few_at_once(spark):
    from corpusloom.llm import lattice

    n = 2 * lattice.ROWS + 7
    docs = spark.createDataFrame([(k, f"A w{k} a") for k in range(n)], "doc_id long, text string").coalesce(1)
    rows = lattice.number_words(docs).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows if r.words is not None) == [(k, 4) for k in range(n)]
    assert {r.word: r.train for r in rows if r.word is not None} == {"a": sum(2 for k in range(n) if lattice.in_training(k)), **{f"w{k}": int(lattice.in_training(k)) for k in range(n)}}
