"""Prompts for a model, its responses as samples, and retries."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import conversations, payloads, text
from corpusloom.operators import dedupe
from corpusloom.runtime import once, table_path, unseen, written

MIN_CHARS, ATTEMPTS, BANNED, ITEMS = 200, 3, 30, 8
#: The shape of the exchange (fixed value).
_SHAPE = '{"items": [{"messages": [{"role": "user", "content": "..."}, {"role": "assistant", "content": "..."}]}]}'
#: Own wording; {page}, {content}, {banned} and {items} are filled in.
PRIMARY = f"""Write grounded training data from one page of a website.

Page: {{page}}

Make {{items}} items: 4 factual questions with answers, 2 conversational ones, 2 conversations of 4 messages.
Use the page's facts only; answer in 1 to 3 plain sentences; never mention the page or the text.
Answer with one JSON object of this shape:
{_SHAPE}

Content:
{{content}}
"""
ADDITIONAL = f"""Write more grounded training data from one page of a website.

Page: {{page}}

Make {{items}} new items, unlike these questions:
{{banned}}
Use the page's facts only; answer in 1 to 3 plain sentences.
Answer with one JSON object of this shape:
{_SHAPE}

Content:
{{content}}
"""


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its {names} filled in from columns, each once and without looking into the values."""
    parts, rest = [], template
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if at is None:
            parts.append(F.lit(rest))
            break
        parts += [F.lit(rest[: at[0]]), values[at[1]].cast("string")]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*parts)


def primary_prompts(pages: DataFrame, template: str = PRIMARY, least: int = MIN_CHARS) -> DataFrame:
    """page, prompt for pages (page, content) with enough text."""
    kept = pages.filter(F.length(text.strip(F.col("content"))) >= least)
    values = {"page": F.col("page"), "content": text.simplify(text.strip(F.col("content"))), "items": F.lit(ITEMS)}
    return kept.select("page", fill(template, values).alias("prompt"))


def banned_list(questions: DataFrame, most: int = BANNED) -> DataFrame:
    """One row: the first questions in code point order, a line each."""
    first = questions.select("question").distinct().orderBy("question").limit(most)
    return first.agg(F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list("question")), lambda q: F.concat(F.lit("- "), q)), "\n"), F.lit("")).alias("banned"))


def additional_prompts(pages: DataFrame, questions: DataFrame, template: str = ADDITIONAL) -> DataFrame:
    """page, prompt for all pages, each with the same list of questions not to repeat (one row, so it is broadcast)."""
    values = {"page": F.col("page"), "content": text.simplify(text.strip(F.col("content"))), "items": F.lit(ITEMS), "banned": F.col("banned")}
    return pages.join(F.broadcast(banned_list(questions))).select("page", fill(template, values).alias("prompt"))


def generate(prompts: DataFrame, model: Callable[[str], str], attempt: int, at_once: int = 1) -> DataFrame:
    """page, attempt, response, error: `model` called once for each prompt, in the tasks, `at_once` calls at a time in each.

    The response is stripped; an exception is a null response and its text the error.
    """

    def call(prompt: str) -> tuple[str | None, str | None]:
        try:
            return model(prompt).strip(), None
        except Exception as e:  # noqa: BLE001  any failure of a model is a failed attempt
            return None, f"{type(e).__name__}: {e}"

    def count_up(asked: list[str]) -> Callable[[], tuple[int, str] | None]:
        numbers = itertools.count()

        def take() -> tuple[int, str] | None:
            k = next(numbers)
            return (k, asked[k]) if k < len(asked) else None

        return take

    def answer(take: Callable[[], tuple[int, str] | None], said: list) -> None:
        while (now := take()) is not None:
            said[now[0]] = call(now[1])

    def run(frames: Iterator) -> Iterator:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                said: list = [None] * len(frame)
                # threads take one prompt after another from a common iterator, without a future for each
                todo = count_up(frame["prompt"].tolist())
                list(pool.map(lambda _, todo=todo, said=said: answer(todo, said), range(at_once)))
                yield frame.assign(attempt=attempt, response=[r for r, _ in said], error=[e for _, e in said])[["page", "attempt", "response", "error"]]

    return prompts.select("page", "prompt").mapInPandas(run, "page string, attempt int, response string, error string")


def ask(prompts: DataFrame, model: Callable[[str, int], str], accept: Callable[[DataFrame], DataFrame], path: str | None = None, attempts: int = ATTEMPTS, parts: int = 1, at_once: int = 1, delay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Asks for every page until an attempt is accepted, `attempts` times at most; returns all responses, and the pages accepted.

    prompts: page, prompt (of several rows of a page one is asked; a null prompt is not). model(prompt, attempt) is called in the
    tasks (see generate). accept turns responses (page, attempt, response, error) into a table whose column page has
    those that were good enough, for instance first_valid() items. The second and later attempts ask only pages that no
    earlier one has had accepted, after `delay` seconds; they end when there are none.

    Returns (page, attempt, response, error) and (page, attempt), the attempt being the accepted one.

    With `path`, a folder that stays, work goes on where it ended: an attempt is written in `parts` parts, each dealt a share
    of the pages by hash, and a part that is written isn't asked again. So a job that dies repeats the calls of one part at most.
    Executors that are lost repeat their tasks' calls.
    """
    spark = prompts.sparkSession
    folder = path or table_path(spark, "asked")
    # dealt by page over the cores, so that slow calls are spread whatever files the prompts lie in
    dealt = prompts.filter("prompt is not null").repartition(max(parts, spark.sparkContext.defaultParallelism), "page")
    whole = once(dealt.groupBy("page").agg(F.min("prompt").alias("prompt")), f"{folder}/prompts")
    pages, asked, good = whole.count(), [], []
    for k in range(1, attempts + 1):
        left = whole
        if good:
            done = reduce(DataFrame.unionAll, good).select(F.col("page").alias("_page"))
            if done.count() >= pages:
                break
            left = unseen(whole, "page", done, "_page")
            if not written(spark, f"{folder}/asked-{k}-0"):
                time.sleep(delay)
        now = []
        for part in range(parts):
            share = left.filter(F.pmod(F.xxhash64("page"), F.lit(parts)) == part)
            now.append(once(generate(share, partial(_attempt, model, k), k, at_once), f"{folder}/asked-{k}-{part}"))
        asked += now
        good.append(once(accept(reduce(DataFrame.unionAll, now)).select("page").distinct().withColumn("attempt", F.lit(k)), f"{folder}/good-{k}"))
    return reduce(DataFrame.unionAll, asked), reduce(DataFrame.unionAll, good)


def _attempt(model: Callable[[str, int], str], attempt: int, prompt: str) -> str:
    return model(prompt, attempt)


def prepare_pages(pages: DataFrame, model: Callable[[str, int], str], path: str | None = None, patterns: Sequence[str] = conversations.BAD_PATTERNS, least: int = 4, most: int = 45, shared: int = 2, **how) -> DataFrame:
    """The whole of preparation from pages (page, content): prompts, asking until a grounded sample is there, first question wins.

    page, item, messages; `how` goes to ask(). A page that no attempt gave a valid sample for gives none.
    """
    responses, _ = ask(primary_prompts(pages), model, lambda r: _grounded(pages, r, patterns, least, most, shared), path, **how)
    return prepare(pages, responses, patterns, least, most, shared)


def progress(pages: DataFrame, responses: DataFrame, accepted: DataFrame) -> DataFrame:
    """page, attempts, items, accepted for every page: its tries, the items in them, and those that stayed; zeros where there is none."""
    tried = responses.groupBy("page").agg(F.count_distinct("attempt").alias("attempts"))
    made = items_of(responses).groupBy("page").agg(F.count("*").alias("items"))
    kept = accepted.groupBy("page").agg(F.count("*").alias("accepted"))
    out = pages.select("page").distinct()
    for part in (tried, made, kept):
        out = out.join(part, "page", "left")
    return out.na.fill(0, ["attempts", "items", "accepted"])


def items_of(responses: DataFrame) -> DataFrame:
    """The responses' items, exploded: page, attempt, item (its place), messages (null where they aren't well-formed)."""
    values = responses.select("page", "attempt", F.explode(F.array(payloads.strict_json(payloads.salvage(F.col("response"))))).alias("_v"))
    each = values.select("page", "attempt", F.posexplode(payloads.unwrap(F.col("_v"))).alias("item", "_x"))
    return each.select("page", "attempt", "item", payloads.messages(F.col("_x")).alias("messages"))


def first_valid(items: DataFrame, valid: Column, *keys: str) -> DataFrame:
    """Of each page (keys), the valid items of the first attempt that has any."""
    good = items.withColumn("_ok", F.coalesce(valid, F.lit(False))).filter("_ok").drop("_ok")
    # a window over a page's few items: a join with their first attempts would make and judge all items twice
    first = F.min("attempt").over(Window.partitionBy(*keys))
    return good.withColumn("_first", first).filter("attempt = _first").drop("_first")


def prepare(pages: DataFrame, responses: DataFrame, patterns: Sequence[str] = conversations.BAD_PATTERNS, least: int = 4, most: int = 45, shared: int = 2) -> DataFrame:
    """Strictly valid samples, first question wins: page, item, messages.

    pages: page, content; responses: page, attempt, response. Grounding looks at the simplified page.
    """
    good = _grounded(pages, responses, patterns, least, most, shared)
    return dedupe.first_wins(good.drop("_source"), conversations.question_key(F.col("messages"), collapsed=True), F.col("page"), F.col("item"))


def _grounded(pages: DataFrame, responses: DataFrame, patterns: Sequence[str], least: int, most: int, shared: int) -> DataFrame:
    """The valid items of each page's first attempt that has any."""
    source = pages.select("page", text.tokens(text.simplify(text.strip(F.col("content")))).alias("_source"))
    joined = items_of(responses).join(source, "page")
    return first_valid(joined, conversations.reject_reason(F.col("messages"), F.col("_source"), patterns, least, most, shared).isNull(), "page")


def augment(responses: DataFrame, seen: DataFrame) -> DataFrame:
    """Structurally valid samples whose question isn't among seen (question), first wins."""
    found = items_of(responses).withColumn("messages", conversations.structural(F.col("messages")))
    good = first_valid(found, F.col("messages").isNotNull(), "page")
    key = conversations.question_key(F.col("messages"), collapsed=False)
    return dedupe.first_wins(dedupe.not_seen(good, key, seen, "question"), key, F.col("page"), F.col("item"))


def seen_questions(samples: DataFrame) -> DataFrame:
    """question: the keys of samples (messages) that the user begins."""
    first = F.get(F.col("messages"), 0)
    return samples.filter(F.coalesce(first["role"] == "user", F.lit(False))).select(conversations.question_key(F.col("messages"), collapsed=False).alias("question")).filter("question is not null").distinct()
