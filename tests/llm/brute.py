"""Slow, plain versions of the operators, written from their contracts."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import xxhash


def line_dedup(docs):
    keyed = [(d, [(x, x.strip(" \t\n\v\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for x in (t or "").split("\n")]) for d, t in docs]
    held = defaultdict(set)
    for d, lines in keyed:
        for _, k in lines:
            if len(k) >= 10 and d is not None:
                held[k].add(d)
    out = []
    for d, lines in keyed:
        kept = [x for x, k in lines if len(k) < 10 or d is None or len(held[k]) < 2 or min(held[k]) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    votes = Counter()
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(sh))


def simhash(docs):
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(docs)]


def repeats(docs, length=400):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(hashlib.blake2b(t[i : i + length], digest_size=16).digest() for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, texts, strict=True):
        on = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] > 1:
                on[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", on))
        kept = bytes(c for c, x in zip(t, on, strict=True) if not x)
        out.append((d, len(t), sum(on), spans, hashlib.sha256(kept).hexdigest()))
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def decontaminate(docs, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        ws = bench_words(t)
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1) if ws else ():
            windows[tuple(ws[k : k + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        ws = bench_words(t)
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if w := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    own |= {str(i) for i in w if i is not None}
        out.append((d, len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return out


def toxicity(text, bias, weights):
    """A model's score by its definition: words and their beginnings of four to six letters, each counted once."""
    have = set()
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        have |= {w} | {w[:n] + "*" for n in (4, 5, 6) if len(w) > n}
    z = bias + sum(weights.get(f, 0.0) for f in have)
    return 1 / (1 + 2.718281828459045 ** -max(-500, min(500, z)))


def language(text, raw, level, piece):
    """The language whose dictionary makes the pieces of a text smallest; dictionaries are not precomputed here."""
    import zstandard

    clean = re.sub(r"\s+", " ", "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())).strip()
    if not any(c.isalpha() for c in clean) or not raw:
        return "und"
    sizes = []
    for lang in raw:
        d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((sum(len(c.compress(clean[i : i + piece].encode())) for i in range(0, len(clean), piece)), lang))
    return min(sizes)[1]


def allocation(leaves, weights, budget, epochs, levels, other):
    """Water-filling by its definition.  leaves: (domain, lang, source) -> tokens."""

    def fill(budget, kids):
        """kids: name -> (capacity, weight)"""
        out, todo = {}, dict(kids)
        while todo:
            w = sum(x for _, x in todo.values())
            full = {k: c for k, (c, x) in todo.items() if c * w <= budget * x}
            if not full:
                return out | {k: int(budget / w * x) for k, (_, x) in todo.items()}
            out |= full
            budget -= sum(full.values())
            todo = {k: v for k, v in todo.items() if k not in full}
        return out

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        caps = Counter()
        for leaf, t in leaves.items():
            if leaf[:depth] == prefix:
                caps[leaf[depth]] += t * epochs
        got = fill(budget, {k: (c, weights.get(levels[depth], {}).get(k, other)) for k, c in caps.items()})
        out = {}
        for k, b in got.items():
            out |= down((*prefix, k), b)
        return out

    return down((), budget)


def mix(docs, weights, levels, other, epochs, seed):
    """doc_id -> passes, for docs of (doc_id, text, lang, source); domains as the engine's default has them."""
    domain = {**dict.fromkeys("0123", "web"), **dict.fromkeys("456", "books"), **dict.fromkeys("789", "code")}
    tokens = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _, _ in docs}
    leaf = {d: (domain[s[-1]], lang, s) for d, _, lang, s in docs}
    leaves = Counter()
    for d, n in tokens.items():
        leaves[leaf[d]] += n
    out = {}
    for at, given in allocation(leaves, weights, sum(leaves.values()), epochs, levels, other).items():
        if not leaves[at]:
            continue
        passes, left = divmod(given, leaves[at])
        run = 0
        for d in sorted((d for d in leaf if leaf[d] == at), key=lambda d: hashlib.md5(f"{seed}:{passes}:{d}".encode()).hexdigest()):
            run += tokens[d]
            if passes + (run <= left):
                out[d] = passes + (run <= left)
    return out
