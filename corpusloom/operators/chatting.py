"""Chat histories, streamed answers, sessions and comparisons as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import NOT_WS, strip

SYSTEM = "You are a helpful assistant. Answer questions accurately based on your knowledge."


def accumulate(chunks: DataFrame) -> DataFrame:
    """request_id, response: the contents of a request's chunks in order of seq, up to the first that is done.

    chunks: request_id, seq, content, done. Null contents count as empty; a request is one answer, held in one row.
    """
    ordered = chunks.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))).alias("c"), F.min(F.when(F.col("done"), F.col("seq"))).alias("last"))
    kept = F.filter("c", lambda x: F.col("last").isNull() | (x["seq"] <= F.col("last")))
    return ordered.select("request_id", F.array_join(F.transform(kept, lambda x: x["content"]), "").alias("response"))


def contexts(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """conv_id, turn, context for each user turn: the system message, then all turns up to it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    history = turns.filter("role <> 'system'").withColumn("_h", F.collect_list(F.struct("role", F.col("text").alias("content"))).over(w))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return history.filter("role = 'user'").select("conv_id", "turn", F.concat(first, "_h").alias("context"))


def stream_chunks(lines: DataFrame, stop: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """request_id, seq, content, done of a model's streamed lines (request_id, seq, line: one JSON object each).

    Blank lines and objects without a message's content give no text; a line that isn't JSON is an error of the query.
    With `most`, chunks beyond that many of a request are dropped and the last one kept is done. With
    stop strings, the answer ends before the first place where one stands, also over several chunks: the chunk in which it
    begins is cut there and done, later ones go, and so do chunks behind one that is done. An answer is one row while it is looked through.
    """
    read = lines.filter(F.rlike("line", F.lit(NOT_WS))).withColumn("_v", F.parse_json("line"))
    content = F.coalesce(F.try_variant_get("_v", "$.message.content", "string"), F.lit(""))
    done = F.coalesce(F.try_variant_get("_v", "$.done", "boolean"), F.lit(False))
    out = read.select("request_id", "seq", content.alias("content"), done.alias("done"))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("request_id").orderBy("seq"))
        out = out.withColumn("_n", nth).filter(F.col("_n") <= most).withColumn("done", F.col("done") | (F.col("_n") == most)).drop("_n")
    if stop:
        whole = out.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("seq", "content", "done"))).alias("_c"), F.min(F.when(F.col("done"), F.col("seq"))).alias("_last"))
        kept = F.filter("_c", lambda x: F.col("_last").isNull() | (x["seq"] <= F.col("_last")))
        # through generators, so that the chunks that stay, their text and the place are each made once an answer
        whole = whole.select("request_id", F.explode(F.array(kept)).alias("_c"))
        whole = whole.select("request_id", "_c", F.explode(F.array(F.array_join(F.transform("_c", lambda x: x["content"]), ""))).alias("_text"))
        at = [F.nullif(F.instr("_text", s), F.lit(0)) for s in dict.fromkeys(stop) if s]
        whole = whole.select("request_id", "_c", F.explode(F.array(F.least(*at, F.lit(None).cast("int"), F.lit(None).cast("int")) - 1)).alias("_at"))
        # n chunks end at the place or before it, the last of them at `to`; the next one is cut, later ones go.
        # An empty chunk at the very place, before the one in which the stop string begins, ends nothing
        zero = F.struct(F.lit(0).alias("all"), F.lit(0).alias("n"), F.lit(0).alias("to"))

        def step(a: Column, x: Column) -> Column:
            total = a["all"] + F.length(x["content"])
            inside = total <= F.col("_at")
            return F.struct(total.alias("all"), F.when(inside, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(inside, total).otherwise(a["to"]).alias("to"))

        whole = whole.select("request_id", "_c", "_at", F.explode(F.array(F.when(F.col("_at").isNotNull(), F.aggregate("_c", zero, step)))).alias("_a"))
        each = whole.select("request_id", "_at", "_a", F.posexplode(F.when(F.col("_at").isNull(), F.col("_c")).otherwise(F.slice("_c", F.lit(1), F.col("_a.n") + 1))).alias("_k", "_x"))
        ends = F.coalesce(F.col("_k") == F.col("_a.n"), F.lit(False))
        content = F.when(ends, F.substring("_x.content", F.lit(1), F.col("_at") - F.col("_a.to"))).otherwise(F.col("_x.content"))
        out = each.select("request_id", "_x.seq", content.alias("content"), (F.col("_x.done") | ends).alias("done"))
    return out


def histories(answers: DataFrame, key: str, seq: str, models: list[str]) -> DataFrame:
    """key, seq, prompt and a column for each model: its answer and its own history up to it.

    answers: key, seq, prompt, model, response, error. A model that failed has its error as
    the answer's status, not as its text, and the failed exchange isn't part of its later history.
    """
    before = Window.partitionBy(key, "model").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("error").isNull(), F.struct("prompt", "response"))
    own = answers.withColumn("history", F.collect_list(said).over(before))
    status = F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status")
    return own.groupBy(key, seq, "prompt").pivot("model", models).agg(F.first(F.struct("response", status, "error", "history")))


def compare(prompts: DataFrame, models: list[str]) -> DataFrame:
    """Every prompt once for each of a few given models: adds model."""
    return prompts.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def sessions(inputs: DataFrame, key: str, seq: str, said: str) -> DataFrame:
    """Inputs that a chat loop would answer, with their session.

    Blank inputs are ignored, everything from the first quit or exit on isn't
    read, and clear begins a new session; commands count whatever their case.
    """
    plain = inputs.withColumn("_s", strip(F.col(said))).filter("_s <> ''").withColumn("_c", F.lower("_s"))
    before = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    marked = plain.withColumn("_quit", F.max(F.col("_c").isin("quit", "exit").cast("int")).over(before)).withColumn("session", F.sum((F.col("_c") == "clear").cast("int")).over(before))
    return marked.filter("_quit = 0 and _c <> 'clear'").select(*[c for c in inputs.columns if c != said], F.col("_s").alias(said), F.col("session").cast("long"))
