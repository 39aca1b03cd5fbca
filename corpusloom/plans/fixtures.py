"""Views of the driver's tables in the shapes that the base operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages of conversations, by turn."""
    turns = table(spark, sf_dir, "conversations")
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, k, question, answer: lines 2k-1 and 2k of documents where neither is empty."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    each = lines.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("l") / 2)).cast("int")), lambda k: F.struct(k.cast("long").alias("k"), F.get("l", 2 * k - 2).alias("q"), F.get("l", 2 * k - 1).alias("a")))).alias("x"))
    return each.select("doc_id", "x.k", F.col("x.q").alias("question"), F.col("x.a").alias("answer")).filter("question <> '' and answer <> ''")


def pair_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs() as conversations of two messages: doc_id, k, messages."""
    q = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    a = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))
    return pairs(spark, sf_dir).select("doc_id", "k", F.array(q, a).alias("messages"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, response: conversations as a model might return them, in four wrappings by conv_id."""
    turns = table(spark, sf_dir, "conversations")
    name = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    one = F.concat(F.lit('{"role": "'), "role", F.lit('", "content": "'), name(F.col("text")), F.lit('"}'))
    item = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("m")))).alias("t"))
    body = F.concat(F.lit('{"messages": ['), F.array_join(F.transform("t", lambda x: x["m"]), ", "), F.lit("]}"))
    whole = F.concat(F.lit('{"items": ['), body, F.lit("]}"))
    kind = F.col("conv_id") % 4
    wrapped = F.when(kind == 0, whole).when(kind == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" Done."))).otherwise(F.concat(F.lit("["), body, F.lit(", "), body, F.lit("]")))
    return item.select("conv_id", wrapped.alias("response"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, seq, content, done: the words of each assistant turn; every seventh request is done a word early."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    words = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.posexplode(F.split("text", " ")).alias("seq", "w"), F.size(F.split("text", " ")).alias("n"))
    last = F.when(F.col("request_id") % 7 == 0, F.col("n") - 2).otherwise(F.col("n") - 1)
    return words.select("request_id", F.col("seq").cast("long").alias("seq"), F.when(F.col("seq") == 0, F.col("w")).otherwise(F.concat(F.lit(" "), "w")).alias("content"), (F.col("seq") == last).alias("done"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, error, status, content_type, html: a site whose page n links to pages (k n + 1) mod N for k from 2 to 4.

    Every fifth page fails, every seventh isn't found, every ninth is no HTML, and some are too short.
    """
    pages = table(spark, sf_dir, "pages").select("page_id")
    n, p = pages.count(), F.col("page_id")
    anchors = F.array_join(F.transform(F.array(*[F.lit(k) for k in (2, 3, 4)]), lambda k: F.concat(F.lit('<a href="/p/'), F.pmod(p * k + 1, F.lit(n)).cast("string"), F.lit('/?q=1#top">go</a>'))), " ")
    body = F.concat(F.lit("<p>Page "), p.cast("string"), F.lit("</p><p>"), F.expr("repeat('lorem ipsum ', 1 + cast(page_id % 11 as int))"), F.lit("</p>"))
    html = F.concat(F.lit("<html><head><title> Page "), p.cast("string"), F.lit(' </title></head><body><nav><a href="/p/0">home</a></nav><main>'), body, anchors, F.lit("</main></body></html>"))
    return pages.select(
        F.concat(F.lit("http://site.test/p/"), p.cast("string")).alias("url"),
        F.when(p % 5 == 4, F.lit("timeout")).alias("error"),
        F.when(p % 7 == 6, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(p % 9 == 8, F.lit("application/pdf")).otherwise(F.lit("text/html; charset=utf-8")).alias("content_type"),
        html.alias("html"),
    )


def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, line: conversations as JSON lines; of every seven one each isn't a list, is too short, is a bare list, or holds a number."""
    messages = F.col("messages")
    whole = F.to_json(F.struct("messages"))
    kind = F.col("conv_id") % 7
    line = (
        F.when(kind == 0, F.lit('{"messages": 5}'))
        .when(kind == 1, F.to_json(F.struct(F.slice(messages, 1, 1).alias("messages"))))
        .when(kind == 2, F.to_json(messages))
        .when(kind == 3, F.lit('{"messages": [{"content": "q"}, {"content": 7}]}'))
        .otherwise(whole)
    )
    return samples(spark, sf_dir).select("conv_id", line.alias("line"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, rank: page n links to pages (k n + 1) mod N for k from 2 to 4."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    n = pages.count()
    each = pages.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4))))
    return each.select(F.col("page_id").alias("source"), F.pmod(F.col("page_id") * F.col("k") + 1, F.lit(n)).alias("target"), (F.col("k") - 2).alias("rank"))
