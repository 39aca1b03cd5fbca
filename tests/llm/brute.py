"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def quality(text):
    w = words(text)
    fives = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {q for k in range(len(w) - 4) if fives[tuple(w[k : k + 5])] > 1 for q in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def shingle_set(text, size=5):
    w = words(text, lower=True)
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(docs, percent):
    sets = {k: shingle_set(t) for k, t in docs.items()}
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in docs}


def repeats(docs, size):
    first = {}
    for k in sorted(docs):
        w = words(docs[k])
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), k)
    out = {}
    for k, t in docs.items():
        w = words(t)
        gone = {q for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < k for q in range(s, s + size)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(docs):
    counts = Counter()
    for k, t in docs.items():
        if not held_out(k):
            counts.update([*words(t, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    out = {}
    for k, t in docs.items():
        tokens = [*words(t, lower=True), None]
        out[k] = (held_out(k), len(tokens), sum(counts[x] > 0 for x in tokens), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens))
    return out


def segmentations(word, pieces, spelt):
    """The sum over all segmentations of a marked word, by trying each."""
    if not word:
        return 1.0
    total = spelt(word[0]) * segmentations(word[1:], pieces, spelt)
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            total += pieces[word[:k]] * segmentations(word[k:], pieces, spelt)
    return total


def lattice_scores(docs, path, smoothing):
    """log10 of each text's marginal: each word whole, by its training count, or by an escape into every segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    counts = Counter()
    for k, t in docs.items():
        if not held_out(k):
            counts.update([*words(t, lower=True), None])
    used = Counter(i for w, c in counts.items() if w is not None for i in model.encode(w) for _ in range(c))
    size = model.get_piece_size()
    total = sum(used.values()) + counts[None] + smoothing * (size + 1)
    weight = {model.id_to_piece(i): (used[i] + smoothing) / total for i in range(size)}
    pieces = {p: w for p, w in weight.items() if not (p.startswith("<0x") or p in ("<unk>", "<s>", "</s>"))}
    longest = max(map(len, pieces))
    n, v = sum(counts.values()), len(counts)

    def inside(word):
        # sums over suffixes, by multiplication; scaled, so that long words don't underflow
        word, scale = "▁" + word, 0
        sums = {len(word): 1.0}
        for i in reversed(range(len(word))):
            spelt = math.prod(weight[f"<0x{b:02X}>"] for b in word[i].encode())
            sums[i] = spelt * sums[i + 1] + sum(pieces[word[i:j]] * sums[j] for j in range(i + 1, min(len(word), i + longest) + 1) if word[i:j] in pieces)
            if sums[i] < 1e-100:
                sums = {j: x * 1e100 for j, x in sums.items()}
                scale -= 100
        return math.log10(sums[0]) + scale

    def of(token):
        spelt = math.log10((counts[None] + smoothing) / total) if token is None else inside(token)
        escaped = math.log10(v / (n + v)) + spelt
        return math.log10(counts[token] / (n + v) + 10**escaped) if counts[token] else escaped

    return {k: sum(of(x) for x in [*words(t, lower=True), None]) for k, t in docs.items()}


def merge(symbols, ranks):
    """Byte-pair merging, one pair at a time, the lowest rank and then the leftmost first."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p], k) for k, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
        if not found:
            return symbols
        _, k = min(found)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def conversations(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn, role or "", text or ""))
    return {k: [(r, t) for _, r, t in sorted(v)] for k, v in out.items()}


def contract_words(doc_id, text):
    """The words that op11 looks at."""
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w, least, exponent):
    """(start, length, period) of all runs, by trying every period at every place."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periods(doc_id, text):
    """op11's row."""
    w = contract_words(doc_id, text)
    found = runs(w, 6, 4)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    said = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def collocations(rows, least, longest=5, top=2000):
    """op12's rows for (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {x: a for x, a in counts.items() if len(x) > 1 and a >= least}
        ranked = []
        for x, a in some.items():
            if any(b >= a and len(y) > len(x) and any(y[i : i + len(x)] == x for i in range(len(y))) for y, b in some.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[x[:k]] * counts[x[k:]]), k) for k in range(1, len(x)))
            ranked.append((-score, -a, " ".join(x).encode(), counts[x[:k]], counts[x[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)
