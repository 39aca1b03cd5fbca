"""Mixing datasets, chat text for training, checkpoints and step manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import conversations, text
from corpusloom.operators import dedupe, sampling
from corpusloom.runtime import materialise

SYSTEM = "You are a helpful AI assistant. Answer questions accurately and stay grounded in the information given."


def dedupe_conversations(samples: DataFrame, *order: str) -> DataFrame:
    """Loosely valid samples in normal form, the first of equals (case apart) kept; samples: messages and order columns."""
    normal = samples.withColumn("messages", conversations.loose(F.col("messages"))).filter("messages is not null")
    return dedupe.first_wins(normal, conversations.conversation_key(F.col("messages")), *[F.col(c) for c in order])


def mix(website: DataFrame, chat: DataFrame, key: str, seed: int = sampling.SEED, mode: str = "hash") -> DataFrame:
    """All website rows and an exact-size sample of chat rows, with place, the order of a seeded shuffle.

    Both have the same columns, with `key` unique over both. No deduplication between them.
    place is the hash of the shuffle (string), or in mode "compat" the number (long) that Python's random
    module gives, drawn after the sample from the same state.
    """
    # each side is counted, ranked and read
    website, chat = materialise(website, "website"), materialise(chat, "chat")
    if mode == "compat":
        return sampling.mix_compat(website, chat, key, seed)
    target = sampling.mix_target(website.count(), chat.count())
    both = website.unionByName(sampling.sample_exact(chat, key, target, seed, mode))
    return both.withColumn("place", sampling.order_hash(F.col(key), seed + 1))


def mix_datasets(base: DataFrame, augmented: DataFrame | None, chat: DataFrame, key: str, *order: str, seed: int = sampling.SEED, mode: str = "hash") -> DataFrame:
    """The whole mix: side ("website" or "chat"), key, messages, place.

    base, augmented (if there is any) and chat: messages, `key`, and the columns that order them. The
    base comes before the augmented samples, so of equal ones the base's stays. An empty side is an error.
    """
    columns = list(dict.fromkeys([key, "messages", *order]))
    website = base.select(*columns, F.lit(0).alias("_rank"))
    if augmented is not None:
        website = website.unionByName(augmented.select(*columns, F.lit(1).alias("_rank")))
    website = materialise(dedupe_conversations(website, "_rank", *order).select(F.lit("website").alias("side"), key, "messages"), "website")
    chat = materialise(dedupe_conversations(chat.select(*columns), *order).select(F.lit("chat").alias("side"), key, "messages"), "chat")
    for side, name in ((website, "website"), (chat, "chat")):
        if side.isEmpty():
            raise ValueError(f"no valid {name} samples")
    return mix(website, chat, key, seed, mode)


def mix_report(mixed: DataFrame) -> DataFrame:
    """One row: website, chat, total of a mix."""
    return mixed.agg(F.count_if(F.col("side") == "website").alias("website"), F.count_if(F.col("side") == "chat").alias("chat"), F.count("*").alias("total"))


def convert(samples: DataFrame, key: str, system: str | None = None, fraction: float = sampling.TRAIN_SPLIT, seed: int = sampling.SEED, mode: str = "hash") -> DataFrame:
    """key, text, split of samples (messages): the training text of each, dealt exactly to 'train' and 'valid'.

    write_json_lines(converted.select("split", "text"), path, ["split"], ascii_only=True) writes the two files.
    """
    text_of = samples.select(key, chat_text(F.col("messages"), system or SYSTEM).alias("text"))
    return sampling.split_exact(text_of, key, fraction, seed, mode).select(key, "text", "split")


def chat_text(messages: Column, system: str = SYSTEM) -> Column:
    """The training text: a system block, a block for each message, and an open block for the assistant."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), text.strip(m["content"]), F.lit("<|im_end|>\n")))
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n"), F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


def latest_checkpoint(files: DataFrame, name: str = "name") -> DataFrame:
    """One row, checkpoint: of adapter files the last numbered one, else the last; null for none."""
    kept = files.filter(F.col(name).rlike("\\.(safetensors|npz)$"))
    numbered = F.max(F.when(F.col(name).rlike("^[0-9]{6}"), F.col(name)))
    return kept.agg(F.coalesce(numbered, F.max(name)).alias("checkpoint"))


def input_errors(inputs: DataFrame) -> DataFrame:
    """position, error for every input (position, name, path, exists, remedy) that is missing: all of them, not the first alone."""
    return inputs.filter(~F.coalesce("exists", F.lit(False))).select("position", F.concat(F.lit("missing "), "name", F.lit(": "), "path", F.lit(". "), "remedy").alias("error"))


def retried(attempts: DataFrame, most: int = 3) -> DataFrame:
    """step, attempts, succeeded: of each step's attempts (step, attempt from 1, exit_code, timed_out) those up to the first success, `most` at most."""
    tried = attempts.filter(F.col("attempt") <= most)
    good = (F.col("exit_code") == 0) & ~F.coalesce("timed_out", F.lit(False))
    first = F.min(F.when(good, F.col("attempt")))
    return tried.groupBy("step").agg(F.coalesce(first, F.max("attempt")).cast("long").alias("attempts"), first.isNotNull().alias("succeeded"))


def export_outcome(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """step, position, action, status, clean_up of an export's steps, in a fail-fast run.

    planned: export_plan() with clean_on_failure; runs: retried(). A step that was to run has succeeded or failed;
    a failed one leaves its output to be deleted if clean_on_failure says so; after a failed required
    step nothing runs. An optional step that is skipped, or fails, is a success for those that follow.
    """
    done = planned.join(runs.select("step", "succeeded"), "step", "left")
    ran = F.when(F.col("action") == "skip", "skipped").when(F.col("action") == "stop", "not run").when(F.coalesce("succeeded", F.lit(False)), "succeeded").otherwise("failed")
    done = done.withColumn("status", ran)
    broke = done.filter("status = 'failed' and required").agg(F.min("position").alias("_broke"))
    late = F.col("position") > F.coalesce("_broke", F.lit(1 << 30))
    status = F.when(late & (F.col("status") != "skipped"), "not run").otherwise(F.col("status"))
    done = done.join(F.broadcast(broke)).withColumn("status", status)
    return done.select("step", "position", "action", "status", ((F.col("status") == "failed") & F.coalesce("clean_on_failure", F.lit(False))).alias("clean_up"))


def trainer_manifest(spark: SparkSession, model: str, data: str, output: str, checkpoint: str | None = None, **options) -> DataFrame:
    """position, argument: the trainer's arguments, the options in their order, and a checkpoint to go on from if there is one."""
    given = {"model": model, "data": data, "adapter-path": output} | {k.replace("_", "-"): v for k, v in options.items()}
    if checkpoint:
        given["resume-adapter-file"] = checkpoint
    words = ["--train"] + [w for k, v in given.items() for w in (f"--{k}", str(v))]
    return spark.createDataFrame(list(enumerate(words)), "position int, argument string")


def serving_row(spark: SparkSession, name: str, source: str, system: str = SYSTEM, temperature: float = 0.7) -> DataFrame:
    """One row of what serves a model: name, source, system, temperature."""
    return spark.createDataFrame([(name, source, system, temperature)], "name string, source string, system string, temperature double")


def export_plan(artifacts: DataFrame) -> DataFrame:
    """For each step (step, position, required, path, exists, tool_exists) what a fail-fast run does: skip, run or stop.

    A step whose output exists is skipped; a required step without its tool stops it and all
    that follow; an optional one without its tool is skipped.
    """
    action = F.when(F.col("exists"), F.lit("skip")).when(F.col("tool_exists"), F.lit("run")).when(~F.col("required"), F.lit("skip")).otherwise(F.lit("stop"))
    planned = artifacts.withColumn("action", action)
    stop = planned.filter("action = 'stop'").agg(F.min("position").alias("_stop"))
    return planned.join(F.broadcast(stop)).withColumn("action", F.when(F.col("position") > F.coalesce("_stop", F.lit(1 << 30)), F.lit("stop")).otherwise(F.col("action"))).drop("_stop")
