"""Empty tables, nulls, repeated rows and extra columns."""

import random

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import chat, fingerprints, lattice, neardup, quality, sharding, substrings, tokenize

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
OPERATORS = {
    "quality": lambda d: quality.score_quality(d),
    "bpe": lambda d: tokenize.encode_digests(d, WORD),
    "sharding": lambda d: sharding.shard_documents(d),
    "packing": lambda d: tokenize.pack_digests(d, BYTE),
    "near": lambda d: neardup.near_duplicates(d),
    "counts": lambda d: tokenize.count_tokens(d, BYTE),
    "substrings": lambda d: substrings.remove_repeats(d, 5, 2),
    "deduplicate": lambda d: substrings.deduplicate(d, 5, 2),
    "fingerprints": lambda d: fingerprints.fingerprint_edits(d),
    "lattice": lambda d: lattice.score_documents(d, PIECE),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeats(nulls, name):
    got = OPERATORS[name](nulls).collect()
    ids = [r.doc_id for r in got]
    if name not in ("packing", "counts", "deduplicate"):
        assert sorted(ids, key=str) == [5, 5, 6, 6, None, None]
    else:
        assert set(ids) == {5, 6, None}


def test_null_rows_of_near_duplicates(nulls):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(nulls).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (6, 2, 6, True), (None, 0, None, True), (None, 2, 5, False)], key=str)


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats_of_an_id_with_shared_passages(spark, batches):
    import brute

    passage = " ".join(f"p{k}" for k in range(20))
    later = " ".join(f"q{k}" for k in range(20))
    rows = [(0, f"begin {passage} end"), (1, f"first {later} text")]
    long, short, spread = " ".join(f"c{k}" for k in range(60)) + f" {passage} tail", f"{passage} other words", f"{passage}\n\tother words"
    rows += [(5, t) for t in (long, long, long, short, spread, spread, later, "x y z")] + [(9, f"{later} and {passage}")] * 2
    # each row against the smaller ids alone, as if no other row had its id
    expected = sorted((k, *brute.repeats({n: x for n, (i, x) in enumerate(rows) if i < k} | {99: t}, 10)[99]) for k, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in substrings.remove_repeats(docs, 10, batches).collect()) == expected
    texts = sorted((r.doc_id, r.text) for r in substrings.deduplicate(docs, 10, batches).collect())
    assert texts == sorted([rows[0], rows[1], *[(5, long.replace(passage + " ", ""))] * 3, *[(5, "other words")] * 3, (5, "x y z"), *[(9, "and ")] * 2])


def test_all_pairs_of_a_full_depth_region_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 4)
    sig = neardup.signature(neardup.np.arange(50, dtype=neardup.np.uint64)).tobytes()
    found = {}
    for r in neardup.regions(spark.createDataFrame([(k, sig) for k in range(30)], "cls long, sig binary"), 3, 0.8).collect():
        found.setdefault(r.region, set()).add(r.cls)
    met = {(a, b) for x in found.values() for a in x for b in x if a < b}
    assert met == {(a, b) for b in range(30) for a in range(b)}


def test_ids_with_two_near_texts_stay_in_regions_of_their_own(spark):
    rows = []
    for k in range(2000):
        w = [f"a{k}x{n}" for n in range(60)]
        rows += [(k, " ".join(w)), (k, " ".join([*w[:-1], "other"]))]
    sketches = neardup.sketch(spark.createDataFrame(rows, "doc_id long, text string"))
    classes = sketches.select(F.xxhash64("digest").alias("cls"), "sig")
    sizes = [r["count"] for r in neardup.regions(classes, 3, 0.8).groupBy("region").count().collect()]
    assert sizes and max(sizes) == 2


@pytest.mark.parametrize(("percent", "crowd"), [(80, 50), (85, 16384)])
def test_no_link_is_lost_in_crowded_regions(spark, monkeypatch, crowd, percent):
    """One template in 200 variants, so that most pairs are near the limit; regions in blocks, or in the deep forest."""
    monkeypatch.setattr(neardup, "REGION", 16)
    monkeypatch.setattr(neardup, "CROWD", crowd)
    r = random.Random(5)
    rows = []
    for k in range(200):
        w = [f"w{n}" for n in range(150)]
        for _ in range(1 + k % 3):
            w[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows.append((k, " ".join(w)))
    sets = {k: set(zip(*(t.split()[n:] for n in range(5)), strict=False)) for k, t in rows}
    linked = {(a, b) for b in sets for a in range(b) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = neardup.sketch(docs).select("doc_id", F.xxhash64("digest").alias("cls"), "sig")
    found = {}
    for x in neardup.regions(classes.select("cls", "sig"), 3, percent / 100).join(classes, "cls").select("region", "doc_id").collect():
        found.setdefault(x.region, set()).add(x.doc_id)
    assert linked and max(map(len, found.values())) <= 48
    assert linked <= {(a, b) for x in found.values() for a in x for b in x if a < b}
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs, percent).collect()}
    assert got == {k: v[1] for k, v in brute.components(dict(rows), percent).items()}


def test_names_of_its_own_in_quality_and_sharding(spark):
    rows = spark.createDataFrame([(1, "a b c", 7, 8, 9)], "doc_id long, text string, _words long, _lines long, _best long")
    scored = quality.score_quality(rows).first()
    assert (scored["_words"], scored["_lines"], scored.n_words) == (7, 8, 3)
    dealt = sharding.assign(rows, F.col("doc_id"), [1.0, 1.0], 1.0).first()
    assert dealt["_best"] == 9 and dealt.shard in (0, 1) and dealt.grown_shard in (dealt.shard, 2)


def test_pipeline_stages_on_an_empty_table(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0, name


def test_empty_conversations(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_null_and_repeated_ids_in_the_pipelines_near_dedup(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(20)) for x in "abcd")
    rows = [(1, a), (1, a), (1, a.upper()), (None, a), (2, a), (2, b), (None, c), (None, c), (None, d), (3, None), (3, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text and r.text.lower()) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, c), (None, d), (3, None), (3, None)], key=str)


def test_pipeline(spark, docs, rows):
    import brute
    from corpusloom.runtime import materialise

    now, texts = docs, dict(rows)
    kept = {k for k, t in rows if (lambda q: q[0] >= 10 and 100 * q[4] <= 20 * q[0])(brute.quality(t))}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.collect()}
        now = materialise(stage(spark, now, ""), name)
        if name == "packing":
            assert {r.doc_id for r in now.collect()} == set(before)
            break
        after = {r.doc_id: r.text for r in now.collect()}
        assert now.columns == list(corpus_pipeline.COLUMNS)
        if name == "quality_rules":
            assert set(after) <= kept and all(after[k] == texts[k] for k in after)
        elif name == "near_dedup":
            assert set(after) == {k for k, v in brute.components(before, 80).items() if v[2]}
        else:
            gone = brute.repeats(before, 50)
            assert set(after) == {k for k in before if gone[k][1] < gone[k][0] or not gone[k][0]}
