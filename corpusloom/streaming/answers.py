"""Streamed answers, given on as soon as no stop string can reach into them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.operators.chatting import stream_chunks

#: Milliseconds after which the state of a request that hasn't been touched goes.
PATIENCE = 600_000
#: State with a time to live needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class StopStrings:
    """An automaton over stop strings: the longest end of what was read that begins one of them.

    Its states are the strings' beginnings. Reading a text costs one step a character, whatever the number of strings.
    """

    def __init__(self, stops: Sequence[str]):
        self.stops = [s for s in dict.fromkeys(stops) if s]
        self.next: list[dict[str, int]] = [{}]
        self.depth, self.fail, self.ends = [0], [0], [0]
        for s in self.stops:
            at = 0
            for k, c in enumerate(s):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.depth.append(k + 1)
                    self.fail.append(0)
                    self.ends.append(0)
                at = self.next[at][c]
            self.ends[at] = len(s)
        queue = list(self.next[0].values())
        for at in queue:
            for c, to in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                # the longest stop string that ends here: the one that begins first
                self.ends[to] = max(self.ends[to], self.ends[self.fail[to]])
                queue.append(to)

    def read(self, held: str, text: str) -> tuple[str, str, bool]:
        """(what may be given on, what is held back, whether a stop string has ended the answer), for text behind what was held back.

        The answer ends before the stop string that begins first. One that has ended may lie inside a longer one that
        begins earlier, so the automaton reads on while such a one is still open.
        """
        whole, at, cut = held + text, 0, None
        for k, c in enumerate(whole):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            if self.ends[at]:
                begin = k + 1 - self.ends[at]
                cut = begin if cut is None else min(cut, begin)
            if cut is not None and k + 1 - self.depth[at] >= cut:
                return whole[:cut], "", True
        safe = len(whole) - self.depth[at]
        if cut is not None:  # decided once the open one has ended or failed
            return whole[: min(cut, safe)], whole[min(cut, safe) :], False
        return whole[:safe], whole[safe:], False

    def finish(self, held: str) -> str:
        """What of the text held back belongs to an answer that has ended."""
        found = [held.find(s) for s in self.stops if s in held]
        return held[: min(found)] if found else held


class _Answers(StatefulProcessor):
    """State of a request: the number of its next chunk, chunks that came too early, the text held back, and whether it has ended."""

    def __init__(self, stops: Sequence[str], patience: int):
        self.stops, self.patience = list(stops), patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.automaton = StopStrings(self.stops)
        self.now = handle.getValueState("now", "next long, pieces long, held string, ended boolean", self.patience)
        self.early = handle.getMapState("early", "seq long", "content string, done boolean", self.patience)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        wanted, pieces, held, ended = self.now.get() if self.now.exists() else (0, 0, "", False)
        came = sorted((int(s), c or "", bool(d)) for frame in rows for s, c, d in zip(frame["seq"], frame["content"], frame["done"], strict=True))
        if ended:
            return
        for seq, content, done in came:
            if seq >= wanted:
                self.early.updateValue((seq,), (content, done))
        out = []
        while not ended and self.early.containsKey((wanted,)):
            content, done = self.early.getValue((wanted,))
            self.early.removeKey((wanted,))
            wanted += 1
            safe, held, ended = self.automaton.read(held, content)
            if done and not ended:
                safe, held, ended = safe + self.automaton.finish(held), "", True
            out.append(safe)
        if ended:
            self.early.clear()
        self.now.update((wanted, pieces + bool("".join(out) or ended), held, ended))
        if "".join(out) or ended:
            yield pd.DataFrame({"request_id": [key[0]], "piece": [pieces], "content": ["".join(out)], "done": [ended]})

    def close(self) -> None:
        pass


def stream_answers(lines: DataFrame, stop: Sequence[str] = (), patience: int = PATIENCE) -> DataFrame:
    """request_id, piece (from 0), content, done of a stream of lines (request_id, seq from 0 without gaps, line): see stream_chunks.

    A piece is given on as soon as it can't be part of a stop string; "hello ST", "OP more" give "hello " and the end.
    An answer's pieces together are what the batch form accumulates. Chunks may come in any order and several times; those behind
    the first that is done, or behind a stop string, are ignored. Every line of a request counts, so blank ones take no
    number of their own. The state of a request goes `patience` milliseconds after its last change, whether it has ended
    or not; that a request has ended is remembered as long. The session needs STORE. Since Spark looks for state that has
    run out in batches without data, such a query is never idle: stop it, or run it one batch at a time.
    """
    chunks = stream_chunks(lines)
    return chunks.groupBy("request_id").transformWithStateInPandas(_Answers(stop, patience), "request_id long, piece long, content string, done boolean", "Append", "ProcessingTime")
