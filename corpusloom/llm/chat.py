"""Chat formatting over a prefix tree of conversations.

Template: a turn is written as

    ### Role: text </turn>

with a line feed after it. Inside texts (and roles) a backslash is put before every
backslash, before '#' and before '<', so no control string can begin in a text, and
dropping those backslashes gives the text back.

Tree: a node is a turn after given turns; conversations that share their first
turns share nodes. A node with over PIECE different conversations below it
is a piece of its own (trunk); below the trunk a piece is a subtree of at most
PIECE conversations. A piece is the depth-first stretch of its nodes' texts, each
node once. Units (tokens) are code points of the formatted text. A unit's position id counts the units of its
ancestors first, so it is what it would be in its conversation alone. Its attention
reaches the ancestors' intervals, given as (piece, begin, end), and its own node up to itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow import map_rows
from corpusloom.runtime import materialise

OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
#: Different conversations under one piece.
PIECE = 256
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMES = {v: k for k, v in ROLES.items()}
_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:]+|\\.)*): ((?:[^\\#<]+|\\.)*) </turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str) -> str:
    """A role's name in the template; one without a name there stands as it is, escaped so that it is no other's name."""
    if role in ROLES:
        return ROLES[role]
    escaped = escape(role).replace(":", "\\:")
    return "\\" + escaped if escaped in NAMES else escaped


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{_role(role)}{SEP}{escape(text)}{CLOSE}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; the opposite of format_turn."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"not a turn at {at}")
        name = found[1]
        out.append((NAMES.get(name) or unescape(name), unescape(found[2])))
        at = found.end()
    return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order; a conversation is one record, as a text is.

    Turns are ordered by turn, then role, then text; null roles and texts count as empty, null turns come first.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id and, in order of turns, the nodes it passes: keys (each names all turns so far) and texts."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, turns in rows:
            chain, keys, texts = hashlib.sha256(), [], []
            for t in turns:
                formatted = format_turn(t["role"], t["text"])
                chain.update(formatted.encode())  # a formatted turn ends itself, so the chain is unambiguous
                keys.append(chain.hexdigest()[:32])
                texts.append(formatted)
            yield conv, keys[-1], keys, texts

    return map_rows(turns_of(conversations).select("conv_id", "turns"), run, "conv_id long, leaf string, keys array<string>, texts array<string>")


INTERVALS = "array<struct<piece:string,begin:long,end:long>>"
NODES = f"piece string, node string, parent string, depth int, begin long, length long, position long, attends {INTERVALS}, loss boolean, text string"


def prefix_tree(walks: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of the tree of paths(); walks is read several times, so it should be materialised.

    nodes, one for each distinct prefix of turns: piece, node, parent, depth
    (from 0), begin (in the piece), length, position (units of its ancestors),
    attends (ancestors' intervals, touching ones merged), loss (assistant), text.
    leaves, one for each distinct conversation: leaf, spans (all its intervals, in order).
    """
    distinct = walks.groupBy("leaf").agg(F.min(F.struct("conv_id", "keys", "texts")).alias("x")).select("leaf", "x.keys", "x.texts")
    distinct = materialise(distinct, "walks")
    below = distinct.select(F.explode("keys").alias("node")).groupBy("node").count().filter(F.col("count") > piece).select("node")
    trunk = distinct.select("leaf", F.explode("keys").alias("node")).join(below, "node").groupBy("leaf").agg(F.count("*").cast("int").alias("trunk"))
    # the trunk of a path is its beginning: no node has more conversations below it than its parent
    placed = distinct.join(trunk, "leaf", "left").withColumn("trunk", F.coalesce("trunk", F.lit(0)))
    placed = placed.withColumn("root", F.coalesce(F.get("keys", F.col("trunk")), F.col("leaf")))
    dealt = placed.repartition("root").sortWithinPartitions("root", F.array_join("keys", ""))

    def emit(rows: Iterator[tuple]) -> Iterator[tuple]:
        """Depth first: rows come in the order of their paths, so a node is new where it leaves the path before."""
        piece_of, stack, at, seen = None, [], 0, set()
        for leaf, keys, texts, trunk, root in rows:
            if root != piece_of:
                piece_of, stack, at, seen = root, [], 0, set()
            spans, position = [], 0
            for depth, (key, text) in enumerate(zip(keys, texts, strict=True)):
                size, parent = len(text), keys[depth - 1] if depth else None
                if depth < trunk:
                    begin, own, new = 0, key, key not in seen  # every piece below a trunk node gives it; the rows are equal
                    seen.add(key)
                else:
                    local = depth - trunk
                    new = local >= len(stack) or stack[local][0] != key
                    if new:
                        del stack[local:]
                        stack.append((key, at))
                        at += size
                    own, begin = root, stack[local][1]
                if new:
                    yield own, key, parent, depth, begin, size, position, merged(spans), text.startswith(f"{OPEN}Assistant{SEP}"), text, None, None
                spans.append((own, begin, begin + size))
                position += size
            yield None, None, None, None, None, None, None, None, None, None, leaf, merged(spans)

    def merged(spans: list[tuple]) -> list[dict]:
        out: list[list] = []
        for own, begin, end in spans:
            if out and out[-1][0] == own and out[-1][2] == begin:
                out[-1][2] = end
            else:
                out.append([own, begin, end])
        return [{"piece": p, "begin": b, "end": e} for p, b, e in out]

    rows = materialise(map_rows(dealt.select("leaf", "keys", "texts", "trunk", "root"), emit, f"{NODES}, leaf string, spans {INTERVALS}"), "tree")
    nodes = rows.filter("node is not null").drop("leaf", "spans")
    return nodes.dropDuplicates(["node"]), rows.filter("leaf is not null").select("leaf", "spans")


def formatted(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaf and its formatted text, read back from the pieces through the conversation's intervals."""
    pieces = nodes.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("p")).select("piece", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("stretch"))
    wanted = leaves.select("leaf", F.posexplode("spans").alias("k", "span")).select("leaf", "k", "span.piece", "span.begin", "span.end")
    parts = wanted.join(pieces, "piece").select("leaf", F.struct("k", F.substring("stretch", F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")).alias("text")).alias("part"))
    return parts.groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"]), "").alias("formatted"))


def format_conversations(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for every conversation.

    All but conv_id is read back from the tree's pieces. The loss mask covers the
    texts of assistant turns, not their marks. An empty table gives no row; null
    conv_ids form one conversation.
    """
    walks = materialise(paths(conversations), "paths")
    nodes, leaves = prefix_tree(walks, piece)

    def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
        for leaf, text in rows:
            turns, loss = hashlib.sha256(), hashlib.sha256()
            found, chars = read_turns(text), 0
            for role, said in found:
                turns.update(f"{role}\n{said}\n".encode())
                if role == "assistant":
                    loss.update(said.encode())
                    chars += len(said)
            yield leaf, len(found), turns.hexdigest(), chars, loss.hexdigest(), len(text)

    digests = map_rows(formatted(nodes, leaves), digest, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return walks.select("conv_id", "leaf").join(digests, "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
