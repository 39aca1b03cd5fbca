"""Every operator against its plain version."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.llm import bpe, chat, components, fingerprints, lattice, neardup, prefilter, quality, sharding, substrings, tokenize
from corpusloom.llm.words import hash_words, text_chunks

SPECIAL = {"<|endoftext|>": 50256}
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


# words


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet="aAbé \n\t\x0b\x1c ", max_size=30), min_size=1, max_size=6), lower=st.booleans())
def test_word_hashes_name_words(texts, lower):
    import pyarrow as pa

    seen = {}
    for at, data, bounds in text_chunks(pa.array(["x", *texts]).slice(1)):
        hashes, starts, ends, words = hash_words(data, bounds, lower)
        for k in range(len(bounds) - 1):
            expected = [w.encode() for w in brute.words(texts[at + k], lower)]
            a, b = words[k], words[k + 1]
            found = [data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b], strict=True)]
            assert [f.lower() if lower else f for f in found] == expected
            for h, w in zip(hashes[a:b].tolist(), expected, strict=True):
                assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


# 1


def test_quality(docs, rows):
    got = by_id(quality.score_quality(docs))
    for k, t in rows:
        n, chars, symbols, dups, repeated = brute.quality(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and not r.rejected_by)


def test_quality_rejects_and_keeps(spark):
    good = "this is the text of a page that it was written for and with the words of people " * 1
    rows = [(1, good), (2, " ".join(f"{w}###" for w in good.split())), (3, " ".join(f"QX{k}!!" for k in range(80))), (4, " ".join(f"w{k // 3}" for k in range(60)))]
    got = by_id(quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: r.kept for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False}


# 2

ODD = [
    "", " ", "\x1ca b\x1c", "İSTANBUL ΟΔΟΣ don't I'M é", "<|endoftext|>x <|startoftext|>", "ab" * 3000, "é" * 2000 + " x", "thethe" * 900, "a" * 1500,
    "  x", "x ́y", "\n\n foo\n\nbar  ", "日本語テキスト🎉🎉", "a\r\n b\t\tc", "...!!!???" * 100, "12345 ½²", "a\x00b c", "a b \n c", "a <|endoftext|> b",
]


@pytest.fixture(scope="module")
def libraries():
    from tokenizers import Tokenizer

    out = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}
    for t in out.values():
        t.no_padding()
        t.no_truncation()
    return out


def test_encoding_is_the_librarys(docs, rows, libraries):
    library = libraries["word_bpe_49k.json"]
    got = by_id(tokenize.encode_digests(docs, WORD))
    plain = by_id(tokenize.encode_decode(docs, WORD))
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, "<u4").tobytes()
        assert (plain[k].ids, plain[k].decoded) == (raw, text)
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_odd_texts_encode_alike(libraries):
    word, byte = bpe.WordBpe(WORD), bpe.ByteBpe(BYTE, SPECIAL)
    for t in ODD:
        assert np.frombuffer(word.encode(t), "<u4").tolist() == libraries["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids, t[:40]
        assert np.frombuffer(byte.encode(t), "<u4").tolist() == libraries["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, t[:40]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbe'st 1é\n\t.ΣIİ\x1c　́")), max_size=60))
def test_any_text_encodes_alike(libraries, t):
    if not hasattr(test_any_text_encodes_alike, "made"):
        test_any_text_encodes_alike.made = bpe.WordBpe(WORD), bpe.ByteBpe(BYTE, SPECIAL)
    word, byte = test_any_text_encodes_alike.made
    assert np.frombuffer(word.encode(t), "<u4").tolist() == libraries["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids
    assert np.frombuffer(byte.encode(t), "<u4").tolist() == libraries["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_lookahead_is_sufficient(seed):
    """On random merge lists no boundary with enough text after it ever changes."""
    r = random.Random(seed)
    symbols, merges = ["a", "b", "c"], []
    for _ in range(r.randint(1, 9)):
        a, b = r.choice(symbols), r.choice(symbols)
        if (a, b) not in merges and a + b not in symbols:
            merges.append((a, b))
            symbols.append(a + b)
    ranks = {m: k for k, m in enumerate(merges)}
    ahead = bpe.sufficient_lookahead(merges)
    text = "".join(r.choice("abc") for _ in range(40))
    edges = lambda t: set(np.cumsum([len(x) for x in brute.merge(t, ranks)]).tolist())
    whole = edges(text)
    for cut in range(1, len(text)):
        settled = range(1, max(1, cut - ahead + 1))
        assert {e for e in edges(text[:cut]) if e in settled} == {e for e in whole if e in settled}


def test_long_words_stream_in_constant_memory():
    word = bpe.WordBpe(WORD)
    r = random.Random(3)
    text = "".join(r.choice("abcdefghij") for _ in range(20_000))
    parts = list(word.stream_word(text))
    assert len(parts) > 20 and max(map(len, parts)) < 4 * (bpe.FEED + word.lookahead + 64)


def test_incremental_decoding_of_bytes():
    names = {k: c for k, c in enumerate(bpe.byte_letters())}
    raw = "aé🎉\n日".encode() + b"\xff\xc3"
    decoder = bpe.TextDecoder(names, None)
    out = "".join(decoder.feed(np.array([b], "<u4")) for b in raw) + decoder.feed(np.array([], "<u4"), final=True)
    assert out == raw.decode(errors="replace")


# 3


def test_sharding(docs, rows):
    got = by_id(sharding.shard_documents(docs, 24))
    for k, t in rows:
        assert (got[k].size, got[k].text_crc32) == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        assert got[k].grown_shard in (got[k].shard, 24)
    for s in range(24):
        slots = sorted(r.slot for r in got.values() if r.shard == s)
        assert slots == list(range(len(slots)))


def test_weighted_shards_move_little(spark):
    keys = spark.range(6000)
    two = {r.id: r.shard for r in sharding.assign(keys, F.col("id"), [1.0, 3.0]).collect()}
    assert 0.72 < sum(two.values()) / 6000 < 0.78
    less = {r.id: r.shard for r in sharding.assign(keys, F.col("id"), [1.0, 2.0]).collect()}
    assert all(less[k] == 0 for k in two if less[k] != two[k])


# 4


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "User", "a:b", "", "\\x"]), st.text(alphabet="a\\#<: \n/turn>é", max_size=20)), max_size=4))
def test_template_is_reversible(turns):
    assert chat.read_turns("".join(chat.format_turn(r, t) for r, t in turns)) == turns


def talks():
    r = random.Random(5)
    out = []
    for conv in range(60):
        first = r.choice(["hello", "hi", "### Assistant: x </turn>\n"])
        for turn in range(r.randint(1, 6)):
            out.append((conv, turn, "user" if turn % 2 == 0 else "assistant", first if turn == 0 else r.choice(["a", "b\\", "<c>", None, "é"])))
    out += [(100, 3, "user", "tie"), (100, 3, "assistant", "tie"), (100, 1, None, "x"), (None, 0, "user", "null id")]
    return out


@pytest.mark.parametrize("piece", [1, 4, 256])
def test_chat(spark, piece):
    table = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_conversations(table, piece).collect()}
    expected = brute.conversations(talks())
    assert set(got) == set(expected)
    for k, turns in expected.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        plain = "".join(chat.format_turn(r, t) for r, t in turns)
        r = got[k]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(plain))


@pytest.mark.parametrize("piece", [1, 4, 256])
def test_tree(spark, piece):
    table = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    walks = chat.paths(table).cache()
    nodes, leaves = chat.prefix_tree(walks, piece)
    nodes = nodes.collect()
    prefixes = {k for w in walks.collect() for k in w["keys"]}
    assert sorted(n.node for n in nodes) == sorted(prefixes)  # each shared turn once
    pieces = {}
    for n in sorted(nodes, key=lambda n: n.begin):
        assert n.begin == len(pieces.get(n.piece, ""))
        assert n.position == sum(a.end - a.begin for a in n.attends)
        pieces[n.piece] = pieces.get(n.piece, "") + n.text
    at = {n.node: n for n in nodes}
    for n in nodes:
        above, node = [], n
        while node.parent:
            node = at[node.parent]
            above.insert(0, node.text)
        assert "".join(pieces[a.piece][a.begin : a.end] for a in n.attends) == "".join(above)
    assert leaves.count() == walks.select("leaf").distinct().count()


# 5


def test_packing(docs, rows, libraries):
    pieces = {}
    for r in tokenize.pack(docs, BYTE, SPECIAL, longest=64).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    digests = {(r.doc_id, r.start): r for r in tokenize.pack_digests(docs, BYTE, SPECIAL, longest=64).collect()}
    sequences = [p.sequence_id for v in pieces.values() for p in v]
    assert len(set(sequences)) == len(sequences)
    for k, t in rows:
        ids = [*libraries["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[k], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids
        for p in own:
            assert p.length & (p.length - 1) == 0 and p.length == 1 << p.bucket <= 64 and p.offset == 0 and p.doc_tokens == len(ids)
            assert digests[k, p.start].ids_crc32 == zlib.crc32(p.ids)


@given(st.integers(0, 5000), st.sampled_from([1, 8, 1024]))
def test_binary_pieces(n, longest):
    pieces = list(tokenize.binary_pieces(n, longest))
    assert sum(s for _, s in pieces) == n and [a for a, _ in pieces] == [sum(s for _, s in pieces[:k]) for k in range(len(pieces))]
    rest = [s for _, s in pieces if s < longest]
    assert len(set(rest)) == len(rest)


# 6


@pytest.mark.parametrize("percent", [85, 80, 30])
def test_near_duplicates(docs, rows, percent):
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(docs, percent, depth=1 if percent < 50 else 3).collect()}
    assert got == brute.components(dict(rows), percent)


def test_crowded_regions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 4)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    r = random.Random(2)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()}
    assert got == {k: v[1] for k, v in brute.components(dict(rows), 80).items()}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (101, 100), (200, 150), (200, 160)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 150: 150, 160: 150, 200: 150}


# 7


@pytest.mark.parametrize("rule", tokenize.RULES)
def test_token_counts(docs, rows, libraries, rule):
    got = {}
    for r in tokenize.count_tokens(docs, BYTE, SPECIAL, rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t in rows:
        ids = libraries["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids
        assert {r.doc_tokens for r in got[k]} == {len(ids)}
        assert sum(r.n_tokens for r in got[k]) == len(ids)


@given(st.lists(st.integers(1, 5), max_size=20), st.lists(st.integers(1, 9), min_size=1, max_size=6), st.sampled_from(tokenize.RULES))
def test_attribution(widths, sections, rule):
    ends = np.cumsum(sections)
    starts = ends - sections
    counts, crossing = tokenize.attribute(np.array(widths, np.int64), starts, ends, rule)
    expected, over = [0] * len(sections), [0] * len(sections)
    at = 0
    for w in widths:
        shares = [max(0, min(at + w, e) - max(at, s)) for s, e in zip(starts, ends, strict=True)]
        touched = [k for k, x in enumerate(shares) if x]
        if touched:
            k = touched[0] if rule == "first" else touched[-1] if rule == "last" else shares.index(max(shares))
            expected[k] += 1
            over[k] += shares[k] < w
        at += w
    assert (counts.tolist(), crossing.tolist()) == (expected, over)


# 8


@pytest.mark.parametrize(("size", "batches"), [(50, 1), (12, 3), (3, 2)])
def test_substrings(docs, rows, size, batches):
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs, size, batches).collect()}
    assert got == brute.repeats(dict(rows), size)


def test_substring_texts(docs, rows):
    expected = brute.repeats(dict(rows), 20)
    got = by_id(substrings.deduplicate(docs, 20, 2))
    for k, t in rows:
        n, gone, digest = expected[k]
        assert (k in got) == (n == 0 or gone < n)
        if k in got:
            assert hashlib.sha256(" ".join(brute.words(got[k].text)).encode()).hexdigest() == digest
            assert gone or got[k].text == t
            assert got[k].n_chars == len(got[k].text or "")


def test_runs_are_merged_by_level_and_the_index_opened_again(spark, docs, rows):
    index = substrings.FingerprintIndex(spark, 10, fan=2)
    folder, past, got = index.folder, None, {}
    parts = [docs.filter((F.col("doc_id") > 15 * k) & (F.col("doc_id") <= 15 * k + 15) if k else F.col("doc_id") <= 15) for k in range(4)]
    for k, part in enumerate(parts):
        past = part if past is None else past.unionByName(part)
        index = substrings.FingerprintIndex.open(spark, folder) if k else index
        with runtime.Scratch(spark) as scratch:
            _, whole, proved = index.add(part, past, scratch)
            got |= {r.doc_id: "whole" for r in whole.collect()} | {r.doc_id: r.proved for r in proved.collect()}
        for kind, runs in index.levels.items():
            assert [level for level, _ in runs] == [b for b in (2, 1, 0) if k + 1 >> b & 1]
            for run in index.runs(kind):
                with index.merging():
                    plan = run.hint("merge").join(run, substrings.KEYS[kind])._jdf.queryExecution().executedPlan().toString()
                    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan, run.inputFiles()
    texts = dict(rows)
    expected = brute.repeats({k: t for k, t in rows if k <= 60}, 10)
    for k, (n, gone, _) in expected.items():
        words = (texts[k] or "").encode().split()
        assert (n if got.get(k) == "whole" else int(substrings.cover(words, got.get(k, []), 10).sum())) == gone
    index.drop()


def test_quality_keeps_columns_with_the_names_of_measures(spark):
    text = "the quick brown fox jumps over the lazy dog and of course it runs to the river"
    rows = spark.createDataFrame([(1, text, 7, "mine", 3), (2, "x", 8, "yours", 4)], "doc_id long, text string, n_words int, kept string, _at int")
    assert [tuple(r) for r in quality.keep_good(rows).collect()] == [(1, text, 7, "mine", 3)]


def test_buckets(spark, docs, tmp_path):
    packed = tokenize.pack(docs, BYTE)
    tokenize.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert sorted((r.sequence_id, r.length) for r in back.collect()) == sorted((r.sequence_id, r.length) for r in packed.collect())
    assert back.filter("length != pow(2, bucket)").count() == 0
    for part in tokenize.bucketed(packed).select("bucket", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("m", "bucket"))).alias("b")).collect():
        found = [x.bucket for x in part.b]
        assert found == sorted(found)


def test_crowded_anchors(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", 1)
    monkeypatch.setattr(substrings, "AT_ONCE", 16)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs, 12, 2).collect()}
    assert got == brute.repeats(dict(rows), 12)


def test_a_hash_that_two_windows_share_removes_nothing():
    words = b"a b c d e f".split()
    wrong = {"start": 0, "n": 2, "proof": hashlib.sha256(b"a b x y").digest()}
    right = {"start": 2, "n": 1, "proof": substrings.proof([b"z", *words], 3, 1, 3)}
    assert substrings.cover(words, [wrong, right], 3).tolist() == [False, False, True, True, True, False]


def test_prefilter_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k if k % 7 else None, 1, 2, 3) for k in range(50)], "doc_id long, _p int, w int, b int")
    ids = spark.createDataFrame([(k,) for k in range(10)], "i long")
    maybe, never = prefilter.apart(rows, "doc_id", ids, "i")
    assert maybe.columns == never.columns == rows.columns
    assert {r.doc_id for r in maybe.collect()} == set(range(10)) - {0, 7} and never.count() == 42



# 9


def test_fingerprint_edits(docs, rows):
    got = by_id(fingerprints.fingerprint_edits(docs))
    order = sorted(((k, t or "") for k, t in rows), reverse=True)
    for at, (k, t) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        edited = fingerprints.edit(t, following)
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - brute.jaccard(t, edited)) < 0.2 and abs(r.near_next - brute.jaccard(t, following)) < 0.2
    plain = by_id(fingerprints.fingerprint_documents(docs))
    assert {k: r.fingerprint for k, r in plain.items()} == {k: r.fingerprint for k, r in got.items()}
    texts = {}
    for k, t in rows:
        assert texts.setdefault(t or "", got[k].fingerprint) == got[k].fingerprint


def test_likeness_is_unbiased():
    r = np.random.default_rng(1)
    for true in (0.1, 0.5, 0.9):
        found = []
        for _ in range(60):
            pool = r.integers(0, 2**63, 400, dtype=np.uint64)
            n = round(2 * 300 * true / (1 + true)) // 2 * 2
            a, b = np.unique(np.concatenate([pool[:n], r.integers(0, 2**63, 300 - n, dtype=np.uint64)]) << np.uint64(1)), np.unique(np.concatenate([pool[:n], r.integers(0, 2**63, 300 - n, dtype=np.uint64)]) << np.uint64(1))
            found.append(fingerprints.likeness(fingerprints.bins_of(a), fingerprints.bins_of(b)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(found)) < 0.02
    bins = fingerprints.bins_of(np.sort(r.integers(0, 2**63, 30, dtype=np.uint64)))
    assert (fingerprints.unpack(fingerprints.pack(bins)) == bins).all()


# 10


@pytest.mark.parametrize("block", [300, 1 << 24])
def test_language_model(docs, rows, block):
    got = by_id(lattice.score_documents(docs, PIECE, block))
    scores = brute.lattice_scores(dict(rows), PIECE, lattice.SMOOTHING)
    for k, expected in brute.base_scores(dict(rows)).items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[:4]
        assert math.isclose(r.base_score, expected[4], rel_tol=1e-9)
        assert math.isclose(r.score, scores[k], rel_tol=1e-9)


def test_language_model_learns_words(spark):
    said = [(k, "xqzv wkjy " * (k + 1)) for k in range(40)]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    got = [r for r in lattice.score_documents(docs, PIECE).collect() if r.held_out]
    assert got and all(r.score > r.base_score - 0.1 * r.n_tokens for r in got)
    # no training texts at all: pieces alone
    alone = by_id(lattice.score_documents(spark.createDataFrame([(k, "xq") for k in range(40) if brute.held_out(k)], "doc_id long, text string"), PIECE))
    assert all(r.train_tokens == 0 and r.n_known == 0 and -30 < r.score < 0 for r in alone.values())


def test_whole_words_and_escape_are_a_distribution():
    counts = {"a": 5, "b": 2, None: 3}
    lattice_of = {"a": 0.3, "b": 0.1, "c": 0.2, None: 0.4}
    n, v = sum(counts.values()), len(counts)
    assert math.isclose(sum(math.exp(lattice.with_whole(math.log(p), counts.get(w, 0), n, v)) for w, p in lattice_of.items()), 1.0)


def test_marginal_sums_all_segmentations():
    weights = {"▁a": 0.1, "a": 0.2, "b": 0.05, "ab": 0.1, "▁": 0.02, "▁ab": 0.03, "ba": 0.04}
    found = lattice.Lattice({p: math.log(w) for p, w in weights.items()}, [math.log(0.001)] * 256)
    for word in ("a", "ab", "abab", "é", "bé", "abba"):
        expected = brute.segmentations("▁" + word, weights, lambda c: 0.001 ** len(c.encode()))
        assert math.isclose(found.marginal(word), math.log(expected), rel_tol=1e-9)
