"""One query for each base operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import conversations, payloads, text, times, urls
from corpusloom.functions import html as html_functions
from corpusloom.operators import audit, chatting, crawl, dedupe, events, generation, keystore, rollups, sampling, training
from corpusloom.plans import fixtures
from corpusloom.sources import files, web
from corpusloom.plans.fixtures import table
from corpusloom.runtime import materialise

#: Hosts that the domain query allows.
DOMAINS = ("spam-farm.example.org", "ththre.example.com", "therha.example.com")
#: Pages that the crawl query begins at, fewer than ten; of every fixture there are more pages.
SEEDS = (0, 7, 13, 20, 26, 31, 37, 42, 46)
#: Strings that end an answer in the query of stop strings.
STOPS = ("er the", "tion ", "e a", "en d")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# URLs


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@query
def url_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.skipped(F.col("url")).alias("skipped"))


@query
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.netloc(F.col("url")).alias("netloc"), urls.same_domain(F.col("url"), DOMAINS).alias("same_domain"))


@query
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"))


# pages


@query
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.extract(table(spark, sf_dir, "pages")).select("page_id", "title")


@query
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = crawl.extract(table(spark, sf_dir, "pages")).filter(F.length("text") >= crawl.MIN_CHARS)
    return kept.select("page_id", F.length("text").cast("long").alias("n_chars"), F.size("lines").cast("long").alias("n_lines"), "text")


@query
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = crawl.extract(table(spark, sf_dir, "pages")).select("page_id", F.posexplode("lines").alias("line_no", "line"))
    return lines.select("page_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With navigation kept, since all links of these pages are in it."""
    noise = [s for s in html_functions.NOISE if s != "nav"]
    found = crawl.links(crawl.extract(table(spark, sf_dir, "pages"), noise), None, key="page_id")
    return found.select("page_id", "link", F.col("rank").cast("long").alias("rank"))


@query
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_records(crawl.extract(table(spark, sf_dir, "pages"))).select("url", "title", F.length("content").cast("long").alias("n_chars"), "text_file")


@query
def crawl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses made from pages: every fifth failed, seventh not found, ninth no HTML."""
    p = F.col("page_id")
    made = crawl.extract(table(spark, sf_dir, "pages")).select(
        "page_id",
        F.when(p % 5 == 4, F.lit("timeout")).alias("error"),
        F.when(p % 7 == 6, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(p % 9 == 8, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        "text",
    )
    return crawl.skip_reason(made).select("page_id", "skip_reason")


@query
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(0, 0), (7, 1)], "node long, rank long")
    found = crawl.breadth_first(seeds, fixtures.edges(spark, sf_dir), most=None)
    return found.select(F.col("node").alias("page_id"), F.col("level").cast("long").alias("level"), F.col("place").cast("long").alias("place"))


@query
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl from seeds to records over an archive of responses; failed pages count and give no links."""
    seeds = web.seed_table(spark, [f"http://site.test/p/{k}/?x#y" for k in (*SEEDS, *SEEDS[:2])])
    found = crawl.crawl(seeds, web.archive(fixtures.archive(spark, sf_dir)), ["site.test"], most=None)
    return found.select("url", F.col("level").cast("long").alias("level"), F.col("place").cast("long").alias("place"), "skip_reason", "title", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("n_chars"), "text_file")


@query
def page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.page_name(F.concat(urls.slug(F.col("url")), F.lit(".txt"))).alias("page"))


# text


@query
def doc_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.simplify(F.col("text")).alias("simple"))


@query
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join("t", " ").alias("tokens"))


@query
def doc_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("n_words"))


@query
def doc_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", text.clean_lines(F.col("text")).alias("l"))
    return lines.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.array_join("l", "\n").alias("text"))


@query
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns against the document with the conversation's number."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), text.tokens(text.simplify(F.col("text"))).alias("source"))
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return said.join(source, "conv_id").select("conv_id", "turn", text.overlap(text.tokens(F.col("text")), F.col("source")).cast("long").alias("score"))


@query
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_score(spark, sf_dir).filter("score >= 2").select("conv_id", "turn")


# conversations


def _with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), text.tokens(text.simplify(F.col("text"))).alias("source"))
    return fixtures.samples(spark, sf_dir).join(source, "conv_id", "left").withColumn("source", F.coalesce("source", F.array().cast("array<string>")))


@query
def conv_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_source(spark, sf_dir).select("conv_id", conversations.reject_reason(F.col("messages"), F.col("source")).alias("reason"))


@query
def conv_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_reject_reasons(spark, sf_dir).select("conv_id", F.col("reason").isNull().alias("valid"))


def _flat(rows: DataFrame) -> DataFrame:
    kept = rows.filter("m is not null").select("conv_id", F.posexplode("m").alias("k", "x"))
    return kept.select("conv_id", F.col("k").cast("long").alias("k"), "x.role", "x.content")


@query
def conv_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fixtures.samples(spark, sf_dir).select("conv_id", conversations.structural(F.col("messages")).alias("m")))


@query
def conv_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(fixtures.samples(spark, sf_dir).select("conv_id", conversations.loose(F.col("messages")).alias("m")))


@query
def question_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = conversations.question_key(F.col("messages"), collapsed=True)
    return dedupe.first_wins(fixtures.pair_samples(spark, sf_dir), key, F.col("doc_id"), F.col("k")).select("doc_id", "k")


@query
def question_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of odd documents whose question no even document has, first wins."""
    rows = fixtures.pair_samples(spark, sf_dir)
    key = conversations.question_key(F.col("messages"), collapsed=False)
    seen = generation.seen_questions(rows.filter("doc_id % 2 = 0"))
    return dedupe.first_wins(dedupe.not_seen(rows.filter("doc_id % 2 = 1"), key, seen, "question"), key, F.col("doc_id"), F.col("k")).select("doc_id", "k")


@query
def question_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_dedupe over documents that come in three batches, by ranges of doc_id, with the keys of earlier ones in a store."""
    rows = fixtures.pair_samples(spark, sf_dir)
    key = conversations.question_key(F.col("messages"), collapsed=True)
    cuts = sorted({int(c) for c in table(spark, sf_dir, "documents").approxQuantile("doc_id", [1 / 3, 2 / 3], 0.01)})
    store, out = keystore.KeyStore(spark, fan=2), []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        batch = rows if low is None else rows.filter(F.col("doc_id") > low)
        batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
        out.append(store.admit(str(k), batch, key, F.col("doc_id"), F.col("k")).select("doc_id", "k"))
    return reduce(DataFrame.unionAll, out)


@query
def conversation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.dedupe_conversations(fixtures.pair_samples(spark, sf_dir), "doc_id", "k").select("doc_id", "k")


# mixing and splitting


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    website = training.dedupe_conversations(fixtures.pair_samples(spark, sf_dir), "doc_id", "k").select(F.format_string("w%d-%d", "doc_id", "k").alias("key"), "messages")
    chat = training.dedupe_conversations(fixtures.samples(spark, sf_dir), "conv_id").select(F.format_string("c%d", "conv_id").alias("key"), "messages")
    return website, chat


@query
def mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    website, chat = _sides(spark, sf_dir)
    counts = website.agg(F.count("*").alias("website")).join(chat.agg(F.count("*").alias("chat")))
    target = F.least(F.greatest(F.lit(1.0), F.bround(F.col("website") * F.lit(sampling.CHAT_WEIGHT) / F.lit(sampling.WEBSITE_WEIGHT))), F.col("chat")).cast("long")
    return counts.withColumn("sampled", target)


@query
def mix_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    website, chat = _sides(spark, sf_dir)
    return training.mix(website, chat, "key").select("key", "place")


@query
def mix_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of even documents as the base, all pairs as augmented samples, conversations as chat."""
    rows = fixtures.pair_samples(spark, sf_dir).withColumn("key", F.format_string("w%d-%d", "doc_id", "k"))
    chat = fixtures.samples(spark, sf_dir).select(F.format_string("c%d", "conv_id").alias("key"), F.col("conv_id").alias("doc_id"), F.lit(0).cast("long").alias("k"), "messages")
    return training.mix_datasets(rows.filter("doc_id % 2 = 0"), rows, chat, "key", "doc_id", "k").select("side", "key", "place")


@query
def mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.mix_report(mix_datasets(spark, sf_dir))


@query
def train_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.convert(fixtures.samples(spark, sf_dir), "conv_id")


@query
def train_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The converted rows as ASCII lines of JSON, and what they read back as."""
    lines = train_convert(spark, sf_dir).select("conv_id", files.ascii_json(train_convert(spark, sf_dir), "text").alias("line"))
    read = files.parse_lines(lines)
    return read.select("conv_id", F.rlike("line", F.lit("^[\\x00-\\x7f]*$")).alias("ascii"), F.try_variant_get("value", "$.text", "string").alias("text"))


@query
def train_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.samples(spark, sf_dir).select("conv_id", training.chat_text(F.col("messages")).alias("text"))


@query
def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_exact(fixtures.samples(spark, sf_dir).select("conv_id"), "conv_id").select("conv_id", "split")


# audit


@query
def audit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = audit.audit(fixtures.pairs(spark, sf_dir), ["doc_id", "k"])
    each = audited.select("doc_id", "k", "duplicate", F.posexplode("issues").alias("at", "x"))
    return each.select("doc_id", "k", "duplicate", F.col("at").cast("long").alias("issue_no"), "x.issue", "x.fix")


@query
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.audit(fixtures.pairs(spark, sf_dir), ["doc_id", "k"]))


@query
def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit from raw lines of JSON, read strictly; rows of another shape are invalid."""
    lines = files.parse_lines(fixtures.sample_lines(spark, sf_dir), blank="error")
    audited = audit.audit(audit.positional(lines).select("conv_id", "question", "answer"), ["conv_id"])
    return audited.select("conv_id", "invalid", "duplicate", F.size("issues").cast("long").alias("n_issues"))


@query
def tolerant_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions of lines that may be malformed: every fifth is cut, every eleventh blank."""
    c = F.col("conv_id")
    lines = fixtures.samples(spark, sf_dir).select("conv_id", F.to_json(F.struct("messages")).alias("line"))
    lines = lines.withColumn("line", F.when(c % 11 == 0, F.lit("  ")).when(c % 5 == 0, F.expr("left(line, length(line) - 2)")).otherwise(F.col("line")))
    return generation.seen_questions(files.samples(files.parse_lines(lines, strict=False)))


# generation


@query
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the second message's content of each line is a string; null where there is none."""
    value = F.try_variant_get(files.payloads.strict_json(F.col("line")), "$.messages[1].content", "variant")
    return fixtures.sample_lines(spark, sf_dir).select("conv_id", F.when(value.isNotNull(), files.payloads.is_string(value)).alias("string"))


@query
def generation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page"))
    responses = fixtures.payloads(spark, sf_dir).select(F.col("conv_id").cast("string").alias("page"), F.lit(1).alias("attempt"), "response")
    return generation.progress(pages, responses, augment_samples(spark, sf_dir))


@query
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.payloads(spark, sf_dir).select("conv_id", payloads.salvage(F.col("response")).alias("found"))
    return found.select("conv_id", "found", payloads.strict_json(F.col("found")).isNotNull().alias("valid"))


@query
def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and their messages; the bare lists of two objects are salvaged as what isn't JSON, so they give none."""
    rows = fixtures.payloads(spark, sf_dir).select(F.col("conv_id").alias("page"), F.lit(1).alias("attempt"), "response")
    each = generation.items_of(rows).select("page", "item", F.posexplode("messages").alias("k", "m"))
    return each.select(F.col("page").alias("conv_id"), F.col("item").cast("long").alias("item"), F.col("k").cast("long").alias("k"), "m.role", "m.content")


@query
def prompt_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id")).alias("page"), F.col("text").alias("content"))
    return generation.primary_prompts(pages)


@query
def prompt_banlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id")).alias("page"), F.col("text").alias("content"))
    return generation.additional_prompts(pages, generation.seen_questions(fixtures.pair_samples(spark, sf_dir)))


@query
def first_valid_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as attempts: the first with an odd number of code points is the first valid one."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "attempt")
    return generation.first_valid(rows, F.length("text") % 2 == 1, "conv_id").select("conv_id", "attempt")


@query
def prepare_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of preparation: salvage, parse, unwrap, strict validation with relaxed limits, first question wins."""
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page"), F.col("text").alias("content"))
    responses = fixtures.payloads(spark, sf_dir).select(F.col("conv_id").cast("string").alias("page"), F.lit(1).alias("attempt"), "response")
    return generation.prepare(pages, responses, most=400, shared=1).select("page", F.col("item").cast("long").alias("item"))


@query
def augment_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = fixtures.payloads(spark, sf_dir).select(F.col("conv_id").cast("string").alias("page"), F.lit(1).alias("attempt"), "response")
    return generation.augment(responses, generation.seen_questions(fixtures.samples(spark, sf_dir).filter("conv_id % 8 = 0"))).select("page", F.col("item").cast("long").alias("item"))


def drawn_answer(prompt: str, attempt: int) -> str:
    """What a model might say, drawn by the page's name and the attempt: an error, no JSON, an item that isn't valid, or a good one."""
    import hashlib
    import re

    page = re.search(r"Page: (.*)", prompt)[1]
    drawn = int(hashlib.md5(f"{page}:{attempt}".encode()).hexdigest()[0], 16)
    if drawn < 4:
        raise ValueError("no answer")
    if drawn < 7:
        return "Sorry."
    return '{"items": [{"messages": [{"role": "user", "content": "Which page?"}, {"role": "assistant", "content": "%s"}]}]}' % ("" if drawn < 10 else f"It is {page}.")


@query
def generation_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages asked until an answer has a valid sample, three times at most: their attempts, errors, and the one accepted (0: none)."""
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id")).alias("page"), F.col("text").alias("content"))

    def accept(responses: DataFrame) -> DataFrame:
        return generation.items_of(responses).filter(conversations.structural(F.col("messages")).isNotNull())

    responses, good = generation.ask(generation.primary_prompts(pages), drawn_answer, accept, parts=2, at_once=4)
    each = responses.groupBy("page").agg(F.count("*").alias("attempts"), F.count("error").alias("errors"))
    return each.join(good.select("page", F.col("attempt").cast("long").alias("accepted")), "page", "left").select("page", "attempts", "errors", F.coalesce("accepted", F.lit(0).cast("long")).alias("accepted"))


# chat


@query
def chat_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatting.accumulate(fixtures.chunks(spark, sf_dir))


@query
def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chatting.contexts(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", F.array_join(F.transform("context", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("context"))


@query
def chat_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    return chatting.compare(prompts, ["tuned", "base"])


@query
def chat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as streamed lines of JSON, with a token cap of 20, read and put together."""
    lines = fixtures.chunks(spark, sf_dir).select("request_id", "seq", F.to_json(F.struct(F.struct("content").alias("message"), "done")).alias("line"))
    return chatting.accumulate(chatting.stream_chunks(lines, most=20))


@query
def chat_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn as streamed lines of three characters, ended by stop strings that lie over them."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")
    cut = turns.select("request_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(.{1,3})"), F.lit(1))).alias("seq", "content"))
    lines = cut.select("request_id", F.col("seq").cast("long").alias("seq"), F.to_json(F.struct(F.struct("content").alias("message"))).alias("line"))
    return chatting.accumulate(chatting.stream_chunks(lines, STOPS))


@query
def chat_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models over each conversation's prompts: one repeats the prompt's length, one fails at every third turn."""
    prompts = chatting.compare(table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt")), ["tuned", "base"])
    fails = (F.col("model") == "base") & (F.col("turn") % 3 == 0)
    answers = prompts.withColumns({"response": F.when(~fails, F.length("prompt").cast("string")), "error": F.when(fails, F.lit("down"))})
    both = chatting.histories(answers, "conv_id", "turn", ["tuned", "base"])
    columns = [f(m) for m in ("tuned", "base") for f in (lambda m: F.col(f"{m}.response").alias(f"{m}_response"), lambda m: F.col(f"{m}.status").alias(f"{m}_status"), lambda m: F.size(f"{m}.history").cast("long").alias(f"{m}_history"))]
    return both.select("conv_id", "turn", *columns)


@query
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as inputs; turn 2 of every third conversation is ' Clear ', turn 5 of every fifth 'EXIT'."""
    c, t = F.col("conv_id"), F.col("turn")
    said = F.when((c % 3 == 0) & (t == 2), F.lit(" Clear ")).when((c % 5 == 0) & (t == 5), F.lit("EXIT")).when((c % 4 == 0) & (t == 1), F.lit(" \t ")).otherwise(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))
    return chatting.sessions(rows, "conv_id", "turn", "said")


# events and rollups


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, in which events are at most 12 hours apart."""
    rows = table(spark, sf_dir, "events").withColumn("thousandths", F.round(F.col("value") * 1000).cast("long"))
    found = events.sessions(rows, "user_id", "ts", "12 hours", ["thousandths"])
    return found.select("user_id", times.micros(F.col("start")).alias("start"), times.micros(F.col("last")).alias("last"), "events", "thousandths")


@query
def event_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last click of its user until then; -1 where there is none."""
    rows = table(spark, sf_dir, "events")
    found = events.as_of(rows.filter("event_type = 'purchase'"), rows.filter("event_type = 'click'"), "user_id", "ts", "click", ["event_id"])
    return found.select("event_id", F.coalesce("click.event_id", F.lit(-1).cast("long")).alias("click_id"), F.col("click.value").alias("click_value"))


@query
def event_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error with the purchases of all users at most 20 minutes before and 40 after it."""
    rows = table(spark, sf_dir, "events")
    found = events.within(rows.filter("event_type = 'error'"), rows.filter("event_type = 'purchase'").select("event_id", "ts"), "ts", 1200, 2400)
    return found.select("event_id", F.col("other.event_id").alias("purchase_id"))


@query
def lineitem_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year -1 stands for all years."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").cast("long").alias("year"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    found = rollups.cube(rows, ["l_returnflag", "l_linestatus", "year"], ["quantity", "cents"])
    return found.select("l_returnflag", "l_linestatus", F.coalesce("year", F.lit(-1).cast("long")).alias("year"), F.col("level").cast("long").alias("level"), F.col("rows").alias("n_rows"), "quantity", "cents")


@query
def lineitem_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and the median price of a year, from sketches kept per day, beside exact counts: 4 % and a rank of 3 % are the bounds."""
    rows = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_partkey", "l_extendedprice")
    days = materialise(rollups.day_sketches(rows, "l_shipdate", "l_partkey", "l_extendedprice"), "days")
    found = rollups.merged(days, F.year("day"), "year")
    exact = rows.groupBy(F.year("l_shipdate").alias("year")).agg(F.countDistinct("l_partkey").alias("parts"))
    year = F.year("l_shipdate").alias("year")
    upto = rows.select(year, "l_extendedprice").join(found.select("year", "quantile"), "year").groupBy("year").agg((F.count_if(F.col("l_extendedprice") <= F.col("quantile")) / F.count("l_extendedprice")).alias("rank"))
    both = found.join(exact, "year").join(upto, "year")
    return both.select(F.col("year").cast("long").alias("year"), "n", "parts", (F.abs(F.col("distinct") - F.col("parts")) <= 0.04 * F.col("parts")).alias("parts_close"), (F.abs(F.col("rank") - 0.5) <= 0.03).alias("median_close"))
