"""Link extraction and breadth-first traversal of a link graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import html, text, urls
from corpusloom.runtime import materialise, once, ordinals, table_path, unseen

MIN_CHARS = 80
MAX_PAGES = 100


def extract(pages: DataFrame, noise: Sequence[str] = html.NOISE, main: Sequence[str] = html.MAIN) -> DataFrame:
    """Adds title (the URL where there is none), lines, text and hrefs to pages (url, html).

    Parts and lines come through generators, below which no filter on them is pushed: each page is parsed once.
    """
    parts = pages.select("*", F.explode(F.array(html.page_parts(F.col("html"), noise, main))).alias("_p"))
    out = parts.select("*", F.explode(F.array(text.clean_lines(F.col("_p.text")))).alias("lines"))
    return out.withColumns({"title": F.coalesce("_p.title", "url"), "text": F.array_join("lines", "\n"), "hrefs": F.col("_p.hrefs")}).drop("_p")


def page_records(extracted: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """url, title, content, text_file of pages with enough text; pages with the same slug share a file name."""
    return extracted.filter(F.length("text") >= least).select("url", "title", F.col("text").alias("content"), F.concat(urls.slug(F.col("url")), F.lit(".txt")).alias("text_file"))


def page_file(record: DataFrame) -> DataFrame:
    """text_file and its value: title, URL, an empty line, the text; and the place in the crawl, where records have one."""
    return record.select(*[c for c in ("place",) if c in record.columns], "text_file", F.concat("title", F.lit("\nURL: "), "url", F.lit("\n\n"), "content", F.lit("\n")).alias("value"))


def links(extracted: DataFrame, domains: Sequence[str] | None = None, patterns: Sequence[str] = urls.SKIP_PATTERNS, key: str = "url") -> DataFrame:
    """key, link, rank: the distinct links of each page that may be followed, in code point order.

    domains None: links on the page's own host.
    """
    each = extracted.select(*dict.fromkeys([key, "url"]), F.explode(html.resolve(F.col("url"), F.col("hrefs"))).alias("_full"))
    # through a generator, so that the filters read the normal form and don't each compute it
    found = each.select(*dict.fromkeys([key, "url"]), F.explode(F.array(urls.normalize(F.col("_full")))).alias("link"))
    host = urls.netloc(F.col("link"))
    allowed = host.isin(*domains, "") if domains is not None else host.isin("") | (host == urls.netloc(F.col("url")))
    kept = found.filter(F.col("link").isNotNull() & allowed & ~urls.skipped(F.col("link"), patterns)).select(key, "link").distinct()
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("link")) - 1)


def skip_reason(responses: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Adds why a response (error, status, content_type, text) isn't kept, the first reason; null where it is."""
    return responses.withColumn(
        "skip_reason",
        F.when(F.col("error").isNotNull(), F.lit("request failed"))
        .when(~F.coalesce(F.col("status") == 200, F.lit(False)), F.lit("status"))
        .when(~F.contains(F.coalesce("content_type", F.lit("")), F.lit("text/html")), F.lit("content type"))
        .when(F.length(F.coalesce("text", F.lit(""))) < least, F.lit("too short")),
    )


Fetch = Callable[[DataFrame], DataFrame]


def crawl(seeds: DataFrame, fetch: Fetch, domains: Sequence[str] | None = None, most: int | None = MAX_PAGES, least: int = MIN_CHARS, noise: Sequence[str] = html.NOISE, path: str | None = None) -> DataFrame:
    """The whole crawl: url, level, place, skip_reason, title, content, text_file for every page that is visited.

    seeds: url, rank; they are normalised but neither skipped by pattern nor by domain. fetch turns a
    table of url into its responses (url, error, status, content_type, html), see sources.web. Pages that fail
    or are filtered out (skip_reason, see there) count as visited and give no links; content and text_file are
    null for them. The order is that of a first-in first-out queue, a level of it at a time; `most` (None: no limit)
    bounds the pages. Every level is written, so a lost executor repeats no request of an earlier
    level; with `path`, a folder that stays, a crawl that has ended early goes on behind its last whole level.
    """
    spark = seeds.sparkSession
    folder = path or table_path(spark, "crawl")
    levels, n, base, level = [], 0, 0, 0
    order = seeds.select(urls.normalize(F.col("url")).alias("url"), F.struct(F.lit(0).cast("long").alias("place"), F.col("rank").cast("long").alias("rank")).alias("o"))
    while True:
        first = order.groupBy("url").agg(F.min("o").alias("o"))
        if levels:
            first = unseen(first, "url", _all(levels, "url"), "url")
        frontier = once(_placed(first, "url", base, n, most), f"{folder}/frontier-{level}")
        if not (more := frontier.count()):
            break
        pages = skip_reason(extract(fetch(frontier.select("url")), noise), least).withColumnRenamed("url", "_url")
        pages = frontier.join(pages, F.col("url") == F.col("_url"), "left").select("url", F.lit(level).alias("level"), "place", F.when(F.col("_url").isNull(), "request failed").otherwise(F.col("skip_reason")).alias("skip_reason"), "title", "text", "hrefs")
        pages = once(pages, f"{folder}/visited-{level}")
        levels.append(pages)
        base, n = n, n + more
        if most is not None and n >= most:
            break
        order = links(pages.filter("skip_reason is null"), domains, key="place").select(F.col("link").alias("url"), F.struct("place", F.col("rank").cast("long").alias("rank")).alias("o"))
        level += 1
    kept = F.col("skip_reason").isNull()
    columns = ["url", "level", "place", "skip_reason", F.when(kept, F.col("title")).alias("title"), F.when(kept, F.col("text")).alias("content"), F.when(kept, F.concat(urls.slug(F.col("url")), F.lit(".txt"))).alias("text_file")]
    empty = "url string, level int, place long, skip_reason string, title string, content string, text_file string"
    return _all(levels).select(*columns) if levels else spark.createDataFrame([], empty)


def _all(levels: list[DataFrame], *columns: str) -> DataFrame:
    """All levels as one scan of their folders."""
    paths = [p for x in levels for p in x.inputFiles()]
    return levels[0].sparkSession.read.schema(levels[0].schema).parquet(*paths).select(*columns or ["*"])


def _placed(first: DataFrame, key: str, base: int, n: int, most: int | None) -> DataFrame:
    """key, place: a level's nodes (key, o) in the order of the queue, from place n on; parents' places begin at base."""
    first = materialise(first.withColumn("_parent", F.col("o.place") - base), "first")
    placed = ordinals(first, "_parent", [F.col("o.rank"), F.col(key)], "place").select(key, (F.col("place") + n).alias("place"))
    return placed if most is None else placed.filter(F.col("place") < most)


def breadth_first(seeds: DataFrame, edges: DataFrame, most: int | None = MAX_PAGES, levels: int | None = None, path: str | None = None) -> DataFrame:
    """node, level, place in the order of a first-in first-out crawl, at most `most` nodes (None: all that are reached).

    seeds: node, rank; edges: source, target, rank. Nodes of a level come in the order of (their first parent's
    place, rank of the link), which is the queue's order, so one join per level visits the same nodes in the
    same order as a queue. Places come from counts of stretches of parents (see runtime.ordinals), and nodes that
    can't have been visited skip the join with those that have (runtime.unseen), so a level's work follows its
    links. Every level is written; with `path`, a folder that stays, a walk that has ended early goes on behind its last level.
    """
    spark = seeds.sparkSession
    folder = path or table_path(spark, "walk")
    first = seeds.groupBy("node").agg(F.min(F.struct(F.lit(0).cast("long").alias("place"), F.col("rank").cast("long").alias("rank"))).alias("o"))
    found, n, base, level = [], 0, 0, 0
    while True:
        frontier = once(_placed(first, "node", base, n, most).withColumn("level", F.lit(level)), f"{folder}/level-{level}")
        if not (more := frontier.count()):
            break
        found.append(frontier)
        base, n = n, n + more
        if (most is not None and n >= most) or level == levels:
            break
        reached = edges.join(frontier, F.col("source") == F.col("node")).select(F.col("target").alias("node"), F.struct("place", F.col("rank").cast("long").alias("rank")).alias("o"))
        first = unseen(reached.groupBy("node").agg(F.min("o").alias("o")), "node", _all(found, "node"), "node")
        level += 1
    return _all(found, "node", "level", "place") if found else spark.createDataFrame([], seeds.select("node", F.lit(0).alias("level"), F.lit(0).cast("long").alias("place")).schema)
