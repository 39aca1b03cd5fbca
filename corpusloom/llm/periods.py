"""Stretches of words that repeat with a period, by refining classes of equal factors.

At level q two positions are in one class if the q words from there are equal. Level 1 is
the words; each level refines the one before (Crochemore): a class splits by the class of the position
behind, and of the parts of a split class all but the largest, its smaller halves, split their predecessors
at the next level. So a position is moved O(log n) times in all.

Every class is also a list of its positions in order. Neighbours in a list at distance q, at level q, begin a square:
2 q words with period q. Where another member lies between two members at distance q, the q words
repeat with a smaller period, so neighbours give each run under its smallest period only. Squares at
consecutive positions are one run.

Texts of a batch are refined together, level by level, on arrays; a text's end is a class of its own, so no factor
crosses texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.arrow import schema_of

#: Words that are refined together; a longer text is refined on its own.
BATCH = 1 << 19
#: Texts that aren't done at this level are gathered and refined again, so that many of them share the later levels.
SHALLOW = 64
#: Up to this level squares are looked for among all positions, from there on in lists by distance.
SWEPT = 16


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(begin - np.cumsum(count) + count, count)


class Refinement:
    """Classes of positions by equal factors of growing length, with each class's positions linked in order."""

    def __init__(self, first: np.ndarray):
        """first: each position's class at level 1, numbers from 0 without gaps."""
        n = len(first)
        self.cls = first.astype(np.int64)
        self.at = np.argsort(first, kind="stable")  # positions, class by class
        self.where = np.empty(n, np.int64)
        self.where[self.at] = np.arange(n)
        count = np.bincount(first)
        # a split makes one class at most for each position beyond the first of its class
        self.begin, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.size[: len(count)] = count
        self.begin[: len(count)] = np.cumsum(count) - count
        self.classes = len(count)
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        same = self.cls[self.at[1:]] == self.cls[self.at[:-1]]
        self.next[self.at[:-1][same]] = self.at[1:][same]
        self.prev[self.at[1:][same]] = self.at[:-1][same]
        self.mark = np.zeros(n, bool)

    def split(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Refines by one level. small: the positions of the smaller parts of the last level's splits.

        Returns the positions of the smaller parts of this level's splits, and the positions whose neighbour has changed.
        """
        none = np.zeros(0, np.int64)
        moved = np.sort(small[small > 0] - 1)
        moved = moved[self.size[self.cls[moved]] > 1]
        if not len(moved):
            return none, none
        old = self.cls[moved]
        key = old * (self.classes + 1) + self.cls[moved + 1]
        order = np.argsort(key, kind="stable")
        moved, old, key = moved[order], old[order], key[order]
        # parts: positions of one class whose successors are of one class; parents: the classes they are taken from
        part = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        part_size = np.diff(np.append(part, len(key)))
        part_old = old[part]
        parent = np.flatnonzero(np.concatenate([[True], part_old[1:] != part_old[:-1]]))
        whose = np.repeat(np.arange(len(parent)), np.diff(np.append(parent, len(part))))
        parent_old = part_old[parent]
        taken = np.add.reduceat(part_size, parent)
        left = self.size[parent_old] - taken
        tail = self.begin[parent_old] + left
        # each parent's stretch of `at`: what stays first, then the parts in order
        place = _spans(tail, taken)
        self.mark[moved] = True
        there = self.at[place]
        evicted = there[~self.mark[there]]
        was = self.where[moved]
        free = was[was < np.repeat(tail, taken)]
        self.at[free], self.where[evicted] = evicted, free
        self.at[place], self.where[moved] = moved, place
        self.mark[moved] = False
        # the largest part: of a parent of which nothing stays, it keeps the parent's number
        most = np.maximum.reduceat(part_size, parent)
        is_most = part_size == most[whose]
        rank = np.cumsum(is_most)
        largest = is_most & (rank - (rank[parent] - is_most[parent])[whose] == 1)
        keeps = largest & (left[whose] == 0)
        fresh = ~keeps
        number = part_old.copy()
        number[fresh] = self.classes + np.arange(int(fresh.sum()))
        self.classes += int(fresh.sum())
        self.begin[number], self.size[number] = place[part], part_size
        rest = np.flatnonzero(left > 0)
        self.size[parent_old[rest]] = left[rest]
        goes = np.repeat(fresh, part_size)
        gone, label = moved[goes], np.repeat(number, part_size)[goes]
        if not len(gone):
            return none, none
        self.cls[gone] = label
        # out of the old lists, a chain of neighbours at a time
        chain = np.lexsort((gone, old[goes]))
        chained = gone[chain]
        head = np.concatenate([[True], self.next[chained[:-1]] != chained[1:]])
        last = np.append(head[1:], True)
        before, behind = self.prev[chained[head]], self.next[chained[last]]
        self.next[before[before >= 0]] = behind[before >= 0]
        self.prev[behind[behind >= 0]] = before[behind >= 0]
        # into lists of their own
        same = label[1:] == label[:-1]
        self.next[gone], self.prev[gone] = -1, -1
        self.next[gone[:-1][same]] = gone[1:][same]
        self.prev[gone[1:][same]] = gone[:-1][same]
        # all but the largest of each split's parts
        rest_is_largest = left >= most
        small_parts = np.flatnonzero(~largest | rest_is_largest[whose])
        others = np.flatnonzero(~rest_is_largest & (left > 0))
        out = np.concatenate([moved[_spans(part[small_parts], part_size[small_parts])], self.at[_spans(self.begin[parent_old[others]], left[others])]])
        return out, np.concatenate([gone, before[before >= 0]])


def runs_of(first: np.ndarray, ends: np.ndarray, least: int, exponent: int, deepest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """start, length, period of all runs of length >= max(least, exponent x period), as three rows by start, then period.

    first: classes of level 1; ends: for each position the length of its text, without the end position. After level
    `deepest` it stops; besides the runs it returns a position at least of each text that may have more.
    """
    work = Refinement(first)
    out = []
    top = int(ends.max(initial=0)) // exponent
    small, level = np.arange(len(first)), 1
    waiting: dict[int, list[np.ndarray]] = {}

    def wait(at: np.ndarray, beyond: int) -> None:
        far = work.next[at] - at
        at, far = at[far > beyond], far[far > beyond]
        some = far * exponent <= ends[at]
        at, far = at[some], far[some]
        if len(at):
            order = np.argsort(far, kind="stable")
            at, far = at[order], far[order]
            cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(at)], strict=True):
                waiting.setdefault(int(far[a]), []).append(at[a:b])

    while level <= top and (deepest is None or level <= deepest):
        if level <= SWEPT:
            at = np.flatnonzero(work.next - np.arange(len(first)) == level)
        elif found := waiting.pop(level, None):
            at = np.unique(np.concatenate(found))
            at = at[work.next[at] - at == level]
        else:
            at = np.zeros(0, np.int64)
        if len(at):
            cut = np.flatnonzero(np.diff(at) > 1)
            start, stop = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
            length = stop - start + 2 * level
            ok = length >= max(least, exponent * level)
            out.append(np.stack([start[ok], length[ok], np.full(ok.sum(), level)]))
        if level == SWEPT:
            wait(np.flatnonzero(work.next >= 0), level)
        if level > SWEPT and not waiting and not len(small):
            break
        small, changed = work.split(small)
        level += 1
        small = small[ends[small] >= exponent * level]  # a shorter text has no run of this period any more
        if level > SWEPT and len(changed):
            wait(changed, level - 1)
    found = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
    more = np.concatenate([small, *(x for k, held in waiting.items() if k >= level for x in held)]) if level <= top else np.zeros(0, np.int64)
    return found[:, np.lexsort((found[2], found[0]))], more


def _several(texts: list[list[bytes]], least: int, exponent: int, deepest: int | None = None) -> Iterator[tuple[np.ndarray, list[bytes]] | None]:
    """For each text (a list of words): its runs, and the words without what repeats a run's first period; None if it isn't done at `deepest`."""
    numbers: list[int] = []
    bounds = [0]
    base = 0
    for words in texts:
        known: dict[bytes, int] = {}
        numbers += [base + known.setdefault(w, len(known)) for w in words]
        numbers.append(base + len(known))  # the end
        base += len(known) + 1
        bounds.append(len(numbers))
    sizes = np.diff(bounds)
    found, more = runs_of(np.array(numbers, np.int64), np.repeat(sizes - 1, sizes), least, exponent, deepest)
    cuts = np.searchsorted(found[0], bounds)
    open_texts = set((np.searchsorted(bounds, more, "right") - 1).tolist())
    for k, words in enumerate(texts):
        if k in open_texts:
            yield None
            continue
        own = found[:, cuts[k] : cuts[k + 1]].copy()
        own[0] -= bounds[k]
        if own.shape[1]:
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, own[0] + own[2], 1)
            np.add.at(depth, own[0] + own[1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
        yield own, words


class _Pool:
    """Texts that wait for each other."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.texts, self.words = [], [], 0

    def add(self, key, words: list[bytes]) -> None:
        self.keys.append(key)
        self.texts.append(words)
        self.words += len(words)

    def full(self, more: list[bytes]) -> bool:
        return bool(self.texts) and self.words + len(more) > BATCH


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (array of start, length, period by start and period), collapsed, for every row of docs.

    Words are runs of bytes other than the six ASCII white-space bytes, numbered from 0. A run is a
    stretch with smallest period q and length >= max(least, exponent * q) that no neighbouring word extends. collapsed
    is the text's words, joined by single spaces, without those behind the first period of a run that holds them.

    A null or empty text has no words and no runs, its collapsed text is ''. Repeated rows and null keys are rows
    like others; other columns are ignored. Every text is refined as a whole, in one task, with
    memory in proportion to its words; there is no shuffle. Rows come in another order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, later = _Pool(), _Pool()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (t.as_py() or b"").split()
                if held.full(words):
                    yield rows(held, SHALLOW, later)
                held.add(k, words)
                if later.full([]):
                    yield rows(later, None, later)
        yield rows(held, SHALLOW, later)
        yield rows(later, None, later)

    arrow = to_arrow_schema(schema_of(f"k {docs.schema[key].dataType.simpleString()}")).field(0).type

    def rows(pool: _Pool, deepest: int | None, later: _Pool) -> pa.RecordBatch:
        done = []
        for k, words, found in zip(pool.keys, pool.texts, list(_several(pool.texts, least, exponent, deepest)), strict=True):
            if found is None:
                later.add(k, words)
            else:
                done.append((k, len(words), found[0], b" ".join(found[1])))
        pool.clear()
        flat = np.concatenate([np.zeros((3, 0), np.int64), *(x[2] for x in done)], 1)
        offsets = np.cumsum([0, *(x[2].shape[1] for x in done)]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(row) for row in flat], ["start", "length", "period"])
        columns = [pa.array([x[0] for x in done], arrow), pa.array([x[1] for x in done], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array([x[3] for x in done], pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, [key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary").alias(text)).mapInArrow(run, schema_of(f"{key} {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text; the texts of a tenth of the keys are made periodic, as the query's contract has it.

    With h the CRC-32 of the key in decimal and g = floor(h / 10): if h ends in 0, each word i >= a = g mod n
    becomes word a + (i - a) mod p, p = 1 + floor((n - a) / (3 + g mod 8)), and words are joined by spaces.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))

    def edited(words: Column) -> Column:
        n = F.size(words)
        g = F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        head = F.slice(words, F.lit(1), a)
        cycle = F.slice(words, a + 1, p)
        times = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(cycle, times)), F.lit(1), n - a)
        return F.array_join(F.concat(head, tail), " ")

    # one value, one pass: the words are bound to a name by a transform over an array of them
    words = F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"))
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, edited(w))), 1)
    return docs.select(key, F.when((h % 10 == 0) & F.col(text).isNotNull(), F.coalesce(changed, F.col(text))).otherwise(F.col(text)).alias(text))
