"""Operators with state, sources and sinks on small tables."""

import datetime
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import runtime
from corpusloom.plans.queries import QUERIES
from corpusloom.operators import audit, chatting, crawl, dedupe, generation, sampling, training
from corpusloom.sources import files, web
from corpusloom.streaming.accumulate import accumulate_stream


def test_first_wins_is_idempotent(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "k int, q string")
    once = dedupe.first_wins(rows, F.col("q"), F.col("k"))
    assert sorted(r.k for r in once.collect()) == [1, 2]
    assert sorted(r.k for r in dedupe.first_wins(once, F.col("q"), F.col("k")).collect()) == [1, 2]


def test_flag_repeats_keeps_all(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None), (5, None)], "k int, q string")
    assert {r.k: r.duplicate for r in dedupe.flag_repeats(rows, F.col("q"), [F.col("k")]).collect()} == {1: False, 3: True, 2: False, 4: False, 5: True}


def queue_crawl(seeds, links, most):
    visited, queue = [], list(seeds)
    while queue and len(visited) < most:
        now = queue.pop(0)
        if now in visited:
            continue
        visited.append(now)
        queue += [x for x in links.get(now, []) if x not in visited and x not in queue]
    return visited


def test_breadth_first_is_a_queue(spark):
    links = {n: [(n * k + 1) % 40 for k in (2, 3, 5)] for n in range(40)}
    edges = spark.createDataFrame([(n, t, r) for n, ts in links.items() for r, t in enumerate(ts)], "source long, target long, rank long")
    seeds = spark.createDataFrame([(5, 0), (9, 1), (5, 2)], "node long, rank long")
    for most in (1, 7, 25, 100):
        got = [r.node for r in crawl.breadth_first(seeds, edges, most).orderBy("place").collect()]
        assert got == queue_crawl([5, 9, 5], links, most)


def payload(*turns):
    return {"messages": [{"role": r, "content": c} for r, c in turns]}


def test_prepare_retries_and_dedupes(spark):
    good = payload(("user", "What is  it"), ("assistant", "Alpha beta are described there"))
    pages = spark.createDataFrame([("a", "alpha beta gamma " * 20), ("b", "alpha beta")], "page string, content string")
    responses = spark.createDataFrame(
        [
            ("a", 1, "no json"),
            ("a", 2, json.dumps({"items": [good, {"messages": 5}, 7]})),
            ("a", 3, json.dumps([good, good])),
            ("b", 1, "```json\n" + json.dumps([payload(("user", " what is it "), ("assistant", "Alpha beta are described there"))]) + "\n```"),
        ],
        "page string, attempt int, response string",
    )
    got = generation.prepare(pages, responses).collect()
    assert [(r.page, r.attempt, r.item) for r in got] == [("a", 2, 0)]
    seen = spark.createDataFrame([("what is it",)], "question string")
    # the other key keeps inner white space, so page a's question is new there
    assert [(r.page, r.attempt) for r in generation.augment(responses, seen).collect()] == [("a", 2)]


def test_generate_turns_failures_into_null(spark):
    prompts = spark.createDataFrame([("a", "x"), ("b", "boom")], "page string, prompt string")

    def model(prompt):
        if prompt == "boom":
            raise RuntimeError
        return prompt * 2

    got = {r.page: (r.response, r.error) for r in generation.generate(prompts, lambda p: f" {model(p)}\n", 1).collect()}
    assert got == {"a": ("xx", None), "b": (None, "RuntimeError: ")}


def test_checkpoints(spark):
    def latest(*names):
        return training.latest_checkpoint(spark.createDataFrame([(n,) for n in names], "name string")).first().checkpoint

    assert latest("0000200_a.safetensors", "z.safetensors") == "0000200_a.safetensors"
    assert latest("a.npz", "b.safetensors", "c.txt") == "b.safetensors"
    assert latest("x") is None


def test_export_plan_stops(spark):
    steps = spark.createDataFrame([("validate", 0, True, True, True), ("merge", 1, True, False, False), ("convert", 2, True, False, True)], "step string, position int, required boolean, exists boolean, tool_exists boolean")
    assert [r.action for r in training.export_plan(steps).orderBy("position").collect()] == ["skip", "stop", "stop"]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/about-us.txt").write_text("  Hello\n ")
    (tmp_path / "in/x.md").write_text("no")
    assert [(r.page, r.content) for r in files.text_pages(spark, str(tmp_path / "in")).collect()] == [("about us", "Hello")]
    lines = tmp_path / "l.jsonl"
    lines.write_text(json.dumps(payload(("user", " Hi "), ("assistant", "x"))) + "\n\nbroken\n")
    assert [r.question for r in files.existing_questions(spark, str(lines)).collect()] == ["hi"]
    try:
        files.json_lines(spark, str(lines)).select("value").collect()
        raise AssertionError("a malformed line must fail")
    except Exception as e:  # noqa: BLE001
        assert "not JSON" in str(e)
    rows = spark.createDataFrame([("train", "é"), ("valid", "b")], "split string, text string")
    files.write_json_lines(rows, str(tmp_path / "out"), ["split"])
    assert sorted((r.split, r.text) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("train", "é"), ("valid", "b")]
    records = spark.createDataFrame([("https://h/a", "T", "body", "a.txt")], "url string, title string, content string, text_file string")
    files.write_pages(crawl.page_file(records), str(tmp_path / "pages"))
    assert (tmp_path / "pages/a.txt").read_bytes() == b"T\nURL: https://h/a\n\nbody\n"


def test_odd_file_names_and_collisions(spark, tmp_path):
    rows = [("a b.txt", "1\n"), ("c%é.txt", "é\n"), ("x.txt", "1\n"), ("x.txt", "2\n")]
    files.write_pages(spark.createDataFrame(rows, "text_file string, value string"), str(tmp_path / "p"))
    assert {p.name: p.read_text() for p in (tmp_path / "p").glob("*.txt")} == {"a b.txt": "1\n", "c%é.txt": "é\n", "x.txt": "2\n"}


def test_strict_and_tolerant_files(spark, tmp_path):
    assert files.existing_questions(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert files.missing_inputs(spark, {"chat": str(tmp_path / "none"), "folder": str(tmp_path)}) == [f"missing chat: {tmp_path / 'none'}"]
    path = tmp_path / "b.jsonl"
    path.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.line for r in files.json_lines(spark, str(path)).orderBy("position").collect()] == ['{"a": 1}', '{"a": 2}']
    with pytest.raises(Exception, match="not JSON"):
        files.json_lines(spark, str(path), blank="error").select("value").collect()
    assert files.too_few(spark.range(49)) and not files.too_few(spark.range(50))


def test_ascii_lines_and_array(spark, tmp_path):
    rows = spark.createDataFrame([("train", 'é "\U0001f600" \n'), ("valid", "plain"), ("valid", None)], "split string, text string")
    files.write_json_lines(rows, str(tmp_path / "o"), ["split"], ascii_only=True)
    lines = [line for p in (tmp_path / "o").rglob("part-*.txt") for line in p.read_text().splitlines()]
    assert sorted(lines) == sorted([json.dumps({"text": 'é "\U0001f600" \n'}, separators=(",", ":")), '{"text":"plain"}', '{"text":null}'])
    records = spark.createDataFrame([(2, "b"), (1, "é")], "k int, t string")
    value = files.json_array(records, ["k"]).first().value
    assert json.loads(value) == [{"k": 1, "t": "é"}, {"k": 2, "t": "b"}] and "é" in value and "\n" in value
    assert [r.k for r in files.preview(records, ["k"], 1).collect()] == [1]


def test_crawl_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    long = "word " * 30

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            pages = {"/": f'<title>Home</title><main>{long}<a href="/b#x">b</a><a href="a/">a</a><a href="/lost">l</a><a href="http://other/">o</a></main>', "/a": f"<main>{long}a</main>", "/b": "<main>short</main>"}
            found = pages.get(self.path)
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write((found or "none").encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    seeds = web.seed_table(spark, [base, "http://127.0.0.1:1/x"])
    got = [(r.url.removeprefix(base), r.level, r.skip_reason, r.title, r.text_file) for r in crawl.crawl(seeds, web.http(timeout=5)).orderBy("place").collect()]
    server.shutdown()
    assert got == [("/", 0, None, "Home", "home.txt"), ("http://127.0.0.1:1/x", 0, "request failed", None, None), ("/a", 1, None, f"{base}/a", "a.txt"), ("/b", 1, "too short", None, None), ("/lost", 1, "status", None, None)]


def test_crawl_edges(spark):
    none = spark.createDataFrame([], "url string, error string, status int, content_type string, html string")
    assert crawl.crawl(spark.createDataFrame([], "url string, rank int"), web.archive(none)).count() == 0
    got = crawl.crawl(web.seed_table(spark, ["http://a/x", "http://a/x/"]), web.archive(none)).collect()
    assert [(r.url, r.skip_reason) for r in got] == [("http://a/x", "request failed")]


def test_split_keeps_repeated_keys_together(spark):
    rows = spark.createDataFrame([(k % 4,) for k in range(8)], "k int")
    got = sampling.split_exact(rows, "k", 0.5).collect()
    assert len(got) == 8 and len({(r.k, r.split) for r in got}) == 4


def test_compat_mix_draws_and_shuffles_from_one_state(spark):
    import random

    website = [f"w{k}" for k in range(30)]
    chat = [f"c{k}" for k in range(10)]
    state = random.Random(42)
    expected = sorted(website) + state.sample(sorted(chat), 5)
    state.shuffle(expected)
    both = [spark.createDataFrame([(k,) for k in side], "key string") for side in (website, chat)]
    got = training.mix(*both, "key", mode="compat").orderBy("place").collect()
    assert [r.key for r in got] == expected


def test_mix_needs_both_sides(spark):
    good = spark.createDataFrame([("a", 1, [("user", "q"), ("assistant", "a")])], "key string, k int, messages array<struct<role:string,content:string>>")
    with pytest.raises(ValueError, match="chat"):
        training.mix_datasets(good, None, good.limit(0), "key", "k")


def test_manifests(spark):
    words = [r.argument for r in training.trainer_manifest(spark, "m", "d", "o", "cp", batch_size=1).orderBy("position").collect()]
    assert words == ["--train", "--model", "m", "--data", "d", "--adapter-path", "o", "--batch-size", "1", "--resume-adapter-file", "cp"]
    inputs = spark.createDataFrame([(0, "model", "/m", False, "train first"), (1, "tool", "/t", True, ""), (2, "folder", "/f", False, "make it")], "position int, name string, path string, exists boolean, remedy string")
    assert [r.error for r in training.input_errors(inputs).orderBy("position").collect()] == ["missing model: /m. train first", "missing folder: /f. make it"]
    assert training.serving_row(spark, "tuned", "/m").first().temperature == 0.7


def test_audit_with_a_sites_own_phrase(spark):
    rows = spark.createDataFrame([(1, "q", "As the Acme page says, yes.")], "k int, question string, answer string")
    found = audit.audit(rows, ["k"], (*audit.PHRASES, "acme page")).first().issues
    assert [(i.issue, i.fix) for i in found] == [("bad phrase", "Remove 'acme page'")]


def test_stop_strings_end_an_answer(spark):
    rows = [(1, k, json.dumps({"message": {"content": c}, "done": False})) for k, c in enumerate(["a ", "b user: c", " d"])] + [(1, 3, "  "), (2, 0, '{"done": true}')]
    got = chatting.accumulate(chatting.stream_chunks(spark.createDataFrame(rows, "request_id int, seq int, line string"), ["user:", "User:"]))
    assert {r.request_id: r.response for r in got.collect()} == {1: "a b ", 2: ""}


def test_sessions(spark):
    rows = [(1, k, s) for k, s in enumerate(["a", " CLEAR ", "b", "", "Quit", "c"])]
    got = chatting.sessions(spark.createDataFrame(rows, "u int, k int, s string"), "u", "k", "s").orderBy("k").collect()
    assert [(r.s, r.session) for r in got] == [("a", 0), ("b", 1)]


def test_stream_accumulates_over_batches(spark, tmp_path):
    ddl = "request_id long, seq long, content string, done boolean"
    parts = [[(1, 1, "b", False), (2, 0, "x", True)], [(1, 0, "a", False)], [(1, 2, "c", True), (2, 1, "y", True)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(str(tmp_path / f"src/{k}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src/*"))
    q = accumulate_stream(stream).writeStream.format("memory").queryName("answers").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("answers").collect()) == [(1, "abc"), (2, "x")]
    batch = spark.createDataFrame([r for p in parts for r in p], ddl)
    assert sorted(tuple(r) for r in chatting.accumulate(batch).collect()) == [(1, "abc"), (2, "x")]


def test_stream_forgets_old_requests(spark, tmp_path):
    ddl = "request_id long, seq long, content string, done boolean, at timestamp"
    day = datetime.datetime(2024, 1, 1)
    parts = [[(1, 0, "a", True, 0), (2, 0, "x", False, 0)], [(3, 0, "c", True, 60)], [(4, 0, "d", True, 120)]]
    for k, part in enumerate(parts):
        rows = [(*r[:4], day + datetime.timedelta(minutes=r[4])) for r in part]
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / f"src/{k}"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src/*"))
    q = accumulate_stream(stream, "at").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("kept").collect()) == [(1, "a"), (3, "c"), (4, "d")]
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_crawl_order_walks_sparse_links_to_the_end(spark, sf_dir, monkeypatch):
    from corpusloom.plans import fixtures, queries

    chain = [(k, k + 1, 0) for k in range(7, 27)]
    monkeypatch.setattr(fixtures, "edges", lambda *_: spark.createDataFrame(chain, "source long, target long, rank long"))
    got = {r.page_id: r.level for r in queries.crawl_order(spark, sf_dir).collect()}
    assert got == {0: 0} | {k: k - 7 for k in range(7, 28)}


def test_repeated_keys_in_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1,"a":2}\n{"a":NaN}\n\n{"a":3}\n')
    for strict in (True, False):
        got = files.json_lines(spark, str(tmp_path / "x.jsonl"), strict).select(F.try_variant_get("value", "$.a", "int").alias("a")).collect()
        assert [r.a for r in got] == [2, None, 3]


def test_each_page_is_parsed_once(spark, sf_dir):
    for name in ("page_text", "page_records", "tolerant_questions"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


def test_empty_keys_go(spark):
    rows = spark.createDataFrame([("", 1), (None, 2), ("a", 3), ("a", 4)], "q string, k int")
    assert [r.k for r in dedupe.first_wins(rows, F.col("q"), F.col("k")).collect()] == [3]


def test_ordinals_in_small_stretches(spark):
    import random

    r = random.Random(1)
    rows = [(r.randrange(60), k) for k in range(300)]
    got = runtime.ordinals(spark.createDataFrame(rows, "p long, k long").repartition(5), "p", [F.col("k").desc()], "at", width=3)
    expected = sorted(rows, key=lambda x: (x[0], -x[1]))
    assert [(x.p, x.k) for x in got.orderBy("at").collect()] == expected
    assert [x.at for x in got.orderBy("at").collect()] == list(range(300))
    assert runtime.ordinals(spark.createDataFrame([], "p long"), "p", [], "at").count() == 0


def test_unseen_is_an_anti_join(spark, monkeypatch):
    rows, seen = spark.range(100).selectExpr("id k"), spark.range(0, 100, 3).selectExpr("id s")
    for bits in (64, 1 << 24):
        monkeypatch.setattr(runtime, "SEEN_BITS", bits)
        assert sorted(r.k for r in runtime.unseen(rows, "k", seen, "s").collect()) == [k for k in range(100) if k % 3]


def test_walk_without_a_limit_has_no_global_window(spark, tmp_path, caplog):
    links = {k: [(k * m + 1) % 500 for m in (2, 3, 4)] for k in range(500)}
    edges = spark.createDataFrame([(s, t, k) for s, ts in links.items() for k, t in enumerate(ts)], "source long, target long, rank int")
    seeds = spark.createDataFrame([(5, 0), (9, 1)], "node long, rank int")
    got = [r.node for r in crawl.breadth_first(seeds, edges, None).orderBy("place").collect()]
    assert got == queue_crawl([5, 9], links, 10**6)


def test_walk_goes_on_behind_its_last_level(spark, tmp_path):
    edges = spark.createDataFrame([(k, k + 1, 0) for k in range(6)], "source long, target long, rank int")
    seeds = spark.createDataFrame([(0, 0)], "node long, rank int")
    crawl.breadth_first(seeds, edges, None, levels=2, path=str(tmp_path / "w"))
    # links of levels that are written aren't read again: here they have gone
    later = edges.filter("source >= 2")
    assert [r.node for r in crawl.breadth_first(seeds, later, None, path=str(tmp_path / "w")).orderBy("place").collect()] == list(range(7))


def test_hosts_in_parallel_and_at_a_pace(spark):
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append((self.server.server_port, time.monotonic(), self.path))
            self.send_response(200)
            self.send_header("Content-Type", "text/html")
            self.end_headers()
            self.wfile.write(b"<p>x</p>")

        def log_message(self, *_):
            pass

    servers = [ThreadingHTTPServer(("127.0.0.1", 0), Handler) for _ in range(2)]
    for server in servers:
        threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = [(f"http://127.0.0.1:{s.server_port}/{k}",) for s in servers for k in range(4)]
    for tasks in (1, 16):
        calls.clear()
        began = time.monotonic()
        got = web.http(delay=0.4, tasks=tasks)(spark.createDataFrame(rows, "url string")).collect()
        assert sorted(r.url for r in got if r.status == 200) == sorted(u for (u,) in rows)
        assert sorted(c[2] for c in calls) == sorted(f"/{k}" for k in range(4) for _ in servers)
        for server in servers:
            at = sorted(t for port, t, _ in calls if port == server.server_port)
            assert all(b - a >= 0.39 for a, b in zip(at, at[1:], strict=False))
        # each server's three pauses pass at the same time as the other's
        assert max(t for _, t, _ in calls) - min(t for _, t, _ in calls) < 2.4 or time.monotonic() - began > 10
    for server in servers:
        server.shutdown()


def test_of_equal_names_the_last_page_stays(spark, tmp_path):
    rows = [("x.txt", "zzz first", 0), ("x.txt", "aaa second", 7), ("y.txt", "y\n", 3)]
    files.write_pages(spark.createDataFrame(rows, "text_file string, value string, place int").repartition(3), str(tmp_path / "p"))
    assert {p.name: p.read_text() for p in (tmp_path / "p").iterdir()} == {"x.txt": "aaa second", "y.txt": "y\n"}
    records = spark.createDataFrame([("https://h/a", "T", "old", "a.txt", 1), ("https://h/a", "T", "new", "a.txt", 4)], "url string, title string, content string, text_file string, place int")
    files.write_pages(crawl.page_file(records), f"file:{tmp_path}/q")
    assert (tmp_path / "q/a.txt").read_text() == "T\nURL: https://h/a\n\nnew\n"


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(f"{k}.txt", f"{k}") for k in range(8)], "text_file string, value string")
    bad = rows.withColumn("value", F.when(F.col("text_file") == "5.txt", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        files.write_pages(bad.repartition(8), str(tmp_path / "p"))
    bad = rows.unionAll(spark.createDataFrame([("no/such/folder/x.txt", "x")], rows.schema))
    with pytest.raises(Exception):  # noqa: B017
        files.write_pages(bad, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists() or not list((tmp_path / "p").iterdir())


def test_stop_strings_over_chunks(spark):
    cases = {1: ["hello ST", "OP more"], 2: ["ab", "c", "", "d"], 3: ["STO", "PX"], 4: ["x", "STOP"], 5: ["a ST", "O"], 6: ["S", "T", "O", "P"], 7: [], 8: ["e", "N", "D", "STOP"]}
    rows = [(i, k, json.dumps({"message": {"content": c}, "done": False})) for i, cs in cases.items() for k, c in enumerate(cs)]
    lines = spark.createDataFrame(rows, "request_id long, seq long, line string")
    chunks = chatting.stream_chunks(lines, ["STOP", "END"])
    got = {r.request_id: r.response for r in chatting.accumulate(chunks).collect()}
    assert got == {1: "hello ", 2: "abcd", 3: "", 4: "x", 5: "a STO", 6: "", 8: "eNDSTOP".partition("STOP")[0]}
    assert [(r.seq, r.content, r.done) for r in chunks.filter("request_id = 1").collect()] == [(0, "hello ", True)]


def test_a_token_cap_comes_before_stop_strings(spark):
    rows = [(1, k, json.dumps({"message": {"content": c}})) for k, c in enumerate(["a", " S", "TOP"])]
    lines = spark.createDataFrame(rows, "request_id long, seq long, line string")
    assert chatting.accumulate(chatting.stream_chunks(lines, ["STOP"], most=2)).first().response == "a S"


@settings(max_examples=300, deadline=None)
@given(stops=st.lists(st.text("abc", min_size=1, max_size=4), max_size=4), chunks=st.lists(st.text("abcd", max_size=6), max_size=8))
def test_what_is_held_back(stops, chunks):
    from corpusloom.streaming.answers import StopStrings

    automaton, held, out, ended = StopStrings(stops), "", "", False
    for c in chunks:
        if ended:
            break
        safe, held, ended = automaton.read(held, c)
        out += safe
        assert len(held) <= 2 * max(map(len, stops), default=0)
    if not ended:
        out += automaton.finish(held)
    whole = "".join(chunks)
    found = [whole.find(s) for s in stops if s in whole]
    assert out == (whole[: min(found)] if found else whole)


def test_stream_of_lines_holds_back_stop_strings(spark, tmp_path):
    from corpusloom.runtime import configured
    from corpusloom.streaming.answers import STORE, stream_answers

    folder = tmp_path / "in"
    folder.mkdir()
    said = {1: ["hello ST", "OP more", "!"], 2: ["a", " user", " b"], 3: ["x ", "us", "er: y"], 4: ["late"]}
    line = lambda i, k, done=False: json.dumps({"request_id": i, "seq": k, "line": json.dumps({"message": {"content": said[i][k]}, "done": done})})
    batches = [[line(1, 0), line(2, 1), line(3, 0)], [line(2, 0), line(3, 2), line(1, 1), line(1, 1)], [line(2, 2, True), line(3, 1), line(1, 2, True)], [line(4, 0), line(1, 2)]]
    stops = ["STOP", "user:"]
    schema = "request_id long, seq long, line string"
    with configured(spark, STORE | {"spark.sql.shuffle.partitions": "2"}):
        answers = stream_answers(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), stops)
        for k, rows in enumerate(batches):  # a query of one batch each, that goes on from the last one's state
            (folder / f"{k}.json").write_text("\n".join(rows))
            q = answers.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
            try:
                assert q.awaitTermination(60)
            finally:
                q.stop()
    got = {}
    for r in spark.read.schema("request_id long, piece long, content string, done boolean").json(str(tmp_path / "out")).orderBy("request_id", "piece").collect():
        got.setdefault(r.request_id, []).append((r.content, r.done))
    assert {k: "".join(c for c, _ in v) for k, v in got.items()} == {1: "hello ", 2: "a user b", 3: "x ", 4: "late"}
    assert got[1][0] == ("hello ", False)  # given on before the stop string has ended
    assert [v[-1][1] for _, v in sorted(got.items())] == [True, True, True, False]
    batch = chatting.accumulate(chatting.stream_chunks(spark.read.schema(schema).json(str(folder)).dropDuplicates(["request_id", "seq"]), stops))
    assert {r.request_id: r.response for r in batch.collect()} == {k: "".join(c for c, _ in v) for k, v in got.items()}


def asker(log, dies=None):
    """A model that notes its calls in files, is never good for page c, and for b at the second attempt."""

    def model(prompt, attempt):
        import os
        import uuid

        if dies and os.path.exists(dies) and prompt == "p e":
            os._exit(1)
        open(f"{log}/{prompt[2]}-{attempt}-{uuid.uuid4().hex}", "w").close()
        if prompt == "p d" and attempt == 1:
            raise ValueError("no answer")
        return "good" if prompt in ("p a", "p e") or (prompt in ("p b", "p d") and attempt == 2) else "bad"

    return model


def test_asking_until_accepted(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    prompts = spark.createDataFrame([(p, f"p {p}") for p in "abcde"] + [("a", "p a"), ("z", None)], "page string, prompt string")
    accept = lambda r: r.filter("response = 'good'")
    for _ in range(2):  # a second run asks nothing
        responses, good = generation.ask(prompts, asker(str(log)), accept, path=str(tmp_path / "asked"), parts=2, at_once=3)
        assert sorted((r.page, r.attempt) for r in good.collect()) == [("a", 1), ("b", 2), ("d", 2), ("e", 1)]
        assert sorted((r.page, r.attempt, r.response, r.error) for r in responses.filter("page in ('c', 'd')").collect()) == [("c", 1, "bad", None), ("c", 2, "bad", None), ("c", 3, "bad", None), ("d", 1, None, "ValueError: no answer"), ("d", 2, "good", None)]
        assert sorted(p.name[:3] for p in log.iterdir()) == ["a-1", "b-1", "b-2", "c-1", "c-2", "c-3", "d-1", "d-2", "e-1"]


def test_asking_goes_on_after_a_lost_job(spark, tmp_path):
    log, dies = tmp_path / "log", tmp_path / "dies"
    log.mkdir()
    dies.touch()
    prompts = spark.createDataFrame([(p, f"p {p}") for p in "abcde"], "page string, prompt string")
    accept = lambda r: r.filter("response = 'good'")
    with pytest.raises(Exception):  # noqa: B017
        generation.ask(prompts, asker(str(log), str(dies)), accept, path=str(tmp_path / "asked"), parts=16)
    before = {p.parent.name for p in (tmp_path / "asked").glob("asked-1-*/_SUCCESS")}
    kept = {r.page for x in before for r in spark.read.parquet(str(tmp_path / "asked" / x)).collect()}
    dies.unlink()
    for p in log.iterdir():
        p.unlink()
    _, good = generation.ask(prompts, asker(str(log), str(dies)), accept, path=str(tmp_path / "asked"), parts=16)
    assert sorted(r.page for r in good.collect()) == ["a", "b", "d", "e"]
    again = [p.name[:3] for p in log.iterdir()]
    assert not {f"{p}-1" for p in kept} & set(again) and len(again) == len(set(again))


def test_no_pages_to_ask(spark):
    none = spark.createDataFrame([], "page string, prompt string")
    responses, good = generation.ask(none, asker("/nowhere"), lambda r: r)
    assert responses.count() == 0 and good.count() == 0


def test_preparing_pages_with_a_model(spark):
    content = "The museum of clocks in Ravensburg opened in 1954 and shows four hundred clocks from nine countries. " * 3
    item = {"messages": [{"role": "user", "content": "When did the museum of clocks open?"}, {"role": "assistant", "content": "The museum of clocks in Ravensburg opened in 1954."}]}

    def model(prompt, attempt):
        return "sorry" if attempt == 1 else f"Here: {json.dumps({'items': [item]})}"

    pages = spark.createDataFrame([("one", content), ("two", content), ("short", "too short")], "page string, content string")
    got = generation.prepare_pages(pages, model).collect()
    assert [(r.page, r.item, r.messages[1].content) for r in got] == [("one", 0, item["messages"][1]["content"])]


def test_stop_strings_in_an_answer_of_many_chunks(spark):
    # work that grows with the square of an answer's chunks would take minutes here
    n = 30_000
    lines = spark.range(n).select(F.lit(1).alias("request_id"), F.col("id").alias("seq"), F.to_json(F.struct(F.struct(F.when(F.col("id") == n - 5, "xSTO").when(F.col("id") == n - 4, "Py").otherwise(F.when(F.col("id") % 3 == 0, "").otherwise("é")).alias("content")).alias("message"), (F.col("id") == n - 2).alias("done"))).alias("line"))
    began = time.monotonic()
    found = chatting.accumulate(chatting.stream_chunks(lines, ["STOP", "never"])).collect()
    assert time.monotonic() - began < 60
    assert [tuple(r) for r in found] == [(1, "é" * sum(k % 3 != 0 for k in range(n - 5)) + "x")]
    whole = chatting.accumulate(chatting.stream_chunks(lines, ["never"])).first().response
    assert whole.endswith("STOPy" + "".join("" if k % 3 == 0 else "é" for k in (n - 3, n - 2))) and "never" not in whole


def plan_lines(frame, name):
    return [x for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if name in x]


def test_preparation_makes_items_once(spark, sf_dir):
    assert len(plan_lines(QUERIES["prepare_samples"](spark, sf_dir), "ArrowEvalPython")) == 1


def test_first_attempt_with_valid_items(spark):
    rows = spark.createDataFrame([("a", 1, 0, False), ("a", 2, 0, True), ("a", 2, 1, True), ("a", 3, 0, True), ("b", 1, 0, None), ("c", 1, 0, True)], "page string, attempt int, item int, ok boolean")
    assert sorted(tuple(r) for r in generation.first_valid(rows, F.col("ok"), "page").select("page", "attempt", "item").collect()) == [("a", 2, 0), ("a", 2, 1), ("c", 1, 0)]


def test_prompts_need_no_regex_over_whole_texts(spark):
    from corpusloom.functions import text

    rows = spark.createDataFrame([("p", "x" * 300)], "page string, content string")
    assert all("regexp" not in x for x in plan_lines(generation.primary_prompts(rows), "Filter"))
    spaces = "".join(map(chr, (k for k in range(0xD800) if chr(k).isspace())))
    cases = [f"{spaces}a{spaces}b​{spaces}", spaces, "", " " * 9000 + "a" + "\n " * 9000 + "b " * 4000, "a　　" * 5000, "x" * 3499 + "   y", "ab" * 6000, " " * 7000, "a" + " " * 6999 + "b"]
    found = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c string").orderBy("k").select(text.strip(F.col("c")).alias("s"), text.simplify(F.col("c")).alias("m")).collect()
    import re

    assert [r.s for r in found] == [c.strip() for c in cases]
    assert [r.m for r in found] == [re.sub(r"\s+", " ", c)[:3500].strip() for c in cases]


def test_threads_ask_each_prompt_once(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("page"), F.concat(F.lit(" p"), "id").alias("prompt")).coalesce(1)

    def model(prompt):
        if prompt.endswith("7"):
            raise ValueError(prompt)
        return prompt

    found = {r.page: (r.response, r.error) for r in generation.generate(rows, model, 1, at_once=4).collect()}
    assert found == {str(k): (None, f"ValueError:  p{k}") if k % 10 == 7 else (f"p{k}", None) for k in range(50)}
