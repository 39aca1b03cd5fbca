"""Byte-pair encoding of whole texts with the vocabularies of public tokenizers.

Streaming: a merge list has a sufficient lookahead, a number of symbols after a
boundary that settles whether a merge ever crosses it. Symbols are therefore
held only until that many have followed; what lies before a settled boundary is
emitted and forgotten, so the memory of an encoder doesn't grow with the text.

Which rule can be disturbed from the right: a rule (x, z) at rank t needs z
whole at rank t. A rule (y, w) of lower rank can take the end of z away, if y
stands on the right edge of z's own derivation and y isn't yet joined to its
left when that rule is due. Ranks fall along such a chain, so the longest one,
counted in symbols, is found in one pass over the rules.
"""

from __future__ import annotations

import base64
import codecs
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
import tiktoken

#: Code points with the Unicode property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Code points that str.split() takes for white space though they don't have that property.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
_RUNS = re.compile(f"[^{WHITE}]+")
#: Text that is given to the encoder at once.
FEED = 512
#: Stands for a pair that no rule joins; larger than any rule.
NO_RULE = 1 << 60
ID_MASK = (1 << 20) - 1


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def sufficient_lookahead(merges: list[tuple[str, str]], length: Callable[[str], int] = len) -> int:
    """Symbols after a boundary that always settle it, for this merge list (see above)."""
    made = {a + b: (rank, b) for rank, (a, b) in reversed(list(enumerate(merges)))}
    ranks: dict[str, list[int]] = {}
    best: dict[str, list[int]] = {}
    longest = 0
    for rank, (x, z) in enumerate(merges):
        need, part, until = 0, z, rank
        while True:
            if at := bisect_left(ranks.get(part, []), until):
                need = max(need, best[part][at - 1])
            if part not in made:
                break
            until, part = min(until, made[part][0]), made[part][1]
        need += length(z)
        ranks.setdefault(x, []).append(rank)
        best.setdefault(x, []).append(max(need, best[x][-1] if best.get(x) else 0))
        longest = max(longest, need)
    return longest


class Cache(dict):
    """A bounded memory of results in two generations; the older one is dropped when the younger is full."""

    def __init__(self, make: Callable, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self.put(key, out)
        return out

    def put(self, key, out) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = out


class WordBpe:
    """The tokenizer of word_bpe_49k.json: lower case, white space dropped, word ends marked.

    encode() gives the ids of a whole text as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str, cache: int = 1 << 18):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        vocab = self.vocab
        #: For a pair of ids, the rank of its rule and the id that it makes, in one number.
        self.rules = {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.lookahead = sufficient_lookahead(merges, lambda s: len(s.removesuffix(self.end)) if s != self.end else 1) + 1
        letters = byte_letters()
        #: The id of each byte inside a word, and from that the id of the byte as a word's last.
        self.first = [vocab[c] for c in letters]
        self.last = {vocab[c]: vocab[c + self.end] for c in letters}
        self.widths = {k: len(t.removesuffix(self.end)) for t, k in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in self.vocab.items()} | {v: k for k, v in self.special.items()}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.words = Cache(lambda w: b"".join(self.stream_word(w)), cache)
        self.runs = Cache(self.encode_run, cache)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merges by rank, the leftmost first, until no rule applies."""
        get = self.rules.get
        found = [get(a << 20 | b, NO_RULE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while found:
            rule = min(found)
            if rule == NO_RULE:
                break
            at = found.index(rule)
            symbols[at] = made = rule & ID_MASK
            del symbols[at + 1], found[at]
            if at:
                found[at - 1] = get(symbols[at - 1] << 20 | made, NO_RULE)
            if at < len(found):
                found[at] = get(made << 20 | symbols[at + 1], NO_RULE)
        return symbols

    def stream_word(self, word: str) -> Iterator[bytes]:
        """The ids of one pre-token, emitted as soon as they are stable.

        Holds at most FEED characters, the lookahead and one token at a time.
        """
        held: list[int] = []
        count, first = len(word), self.first
        for at in range(0, count, FEED):
            held += [first[b] for b in word[at : at + FEED].encode()]
            if at + FEED >= count:
                held[-1] = self.last[held[-1]]
                yield np.array(self.merge(held), "<u4").tobytes() if len(held) > 16 else b"".join([k.to_bytes(4, "little") for k in self.merge(held)])
                return
            settled, done, out, used = len(held) - self.lookahead, 0, [], 0
            merged = self.merge(held.copy())
            for k in merged:
                used += self.widths[k]
                if used > settled:
                    break
                done = used
                out.append(k)
            yield np.array(out, "<u4").tobytes()
            held = held[done:]

    def encode_run(self, run: str) -> bytes:
        """A run without white space: normalised, cut into pre-tokens, each of them encoded."""
        import unicodedata

        plain = run if run.isascii() else unicodedata.normalize("NFC", run).replace("Σ", "σ")
        words = self.words
        return b"".join([words[w] if len(w) <= 64 else b"".join(self.stream_word(w)) for w in self.pieces(plain.lower())])

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" not in text:
            return self.encode_plain(text)
        return b"".join([self.special[p].to_bytes(4, "little") if p in self.special else self.encode_plain(p) for p in self.split(text)])

    def encode_plain(self, text: str) -> bytes:
        runs = self.runs
        found = _RUNS.findall(text) if _NOT_WHITE.search(text) else text.split()
        return b"".join([runs[r] if len(r) <= 64 else self.encode_run(r) for r in found])

    def decoder(self) -> "TextDecoder":
        return TextDecoder(self.names, " ")


class TextDecoder:
    """Ids to text, a piece at a time.

    With a separator the tokens' own spellings are joined by it, which is what a
    tokenizer without a decoder section does. Without one (separator None) the spellings
    stand for bytes: they pass an incremental UTF-8 machine that holds an
    unfinished character, so the pieces may be cut anywhere.
    """

    def __init__(self, names: dict[int, str], separator: str | None):
        self.names, self.separator, self.begun = names, separator, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes = {c: b for b, c in enumerate(byte_letters())}

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        names = self.names
        if self.separator is None:
            back = self.bytes
            raw = b"".join(bytes([back[c] for c in names[k]]) if all(c in back for c in names[k]) else names[k].encode() for k in ids.tolist())
            return self.state.decode(raw, final)
        out = self.separator.join([names[k] for k in ids.tolist() if k in names])
        if not out:
            return ""
        out = self.separator + out if self.begun else out
        self.begun = True
        return out


class ByteBpe:
    """The tokenizer of byte_bpe_50k: byte level, white space kept, nothing normalised.

    A white-space character after another character always begins a new pre-token,
    so a text is cut there and every chunk is encoded on its own, from a bounded cache.
    """

    #: A white-space character, then a space: there the plain cut at spaces doesn't hold.
    ODD = re.compile(f"[{WHITE}] ")
    CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+$")

    def __init__(self, path: str, special: dict[str, int] | None = None, cache: int = 1 << 18):
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.special = special or {}
        self.plain = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        for token, k in ranks.items():
            self.sizes[k] = len(token)
        for token, k in self.special.items():
            self.sizes[k] = len(token.encode())
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        self.chunks = Cache(self.encode_chunk, cache)

    def encode_chunk(self, chunk: str) -> bytes:
        return np.array(self.plain.encode_ordinary(chunk), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text (null: empty) as little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.split is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        return b"".join([self.special[p].to_bytes(4, "little") if p in self.special else self.encode_plain(p) for p in self.split(text)])

    def encode_plain(self, text: str) -> bytes:
        if not text:
            return b""
        if text[0] == " " or "  " in text or "\n " in text or self.ODD.search(text):
            chunks = self.CHUNKS.findall(text)
        else:
            chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.CHUNKS.findall(text)
        known, old = self.chunks, self.chunks.old
        found = list(map(known.get, chunks))
        if None in found:
            lacking = [k for k, x in enumerate(found) if x is None]
            asked = []
            for k in lacking:
                if (out := old.get(chunks[k])) is None:
                    asked.append(k)
                else:
                    found[k] = out
                    known.put(chunks[k], out)
            for k, out in zip(asked, self.encode_chunks([chunks[k] for k in asked]), strict=True):
                found[k] = out
                if len(out) <= 64:
                    known.put(chunks[k], out)
        return b"".join(found)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Many chunks of one text in one call: each begins with white space and ends before it, so they don't mix."""
        if not chunks:
            return []
        ids = np.array(self.plain.encode_ordinary("".join(chunks)), "<u4")
        ends = np.cumsum([len(c) if c.isascii() else len(c.encode()) for c in chunks])
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, "right").tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
