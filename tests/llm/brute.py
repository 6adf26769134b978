"""Plain Python statements of what the operators return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_sets(docs):
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def jaccard(docs):
    sets = shingle_sets(docs)
    at = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            at[x].add(i)
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = set()
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j > i).items():
            if 100 * n >= 80 * len(s | sets[j]):
                links.add((i, j))
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {(i, len(s), find(i)) for i, s in sets.items()}, links


def repeated_words(docs, n=20):
    seen, out = set(), set()
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            x = tuple(w[j : j + n])
            if x in seen:
                gone[j : j + n] = [True] * n
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def repeated_bytes(docs, n=400):
    docs = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(hash(b[j : j + n]) for _, b in docs for j in range(len(b) - n + 1))
    out = set()
    for i, b in docs:
        gone = [False] * len(b)
        end = 0
        for j in range(len(b) - n + 1):
            if count[hash(b[j : j + n])] > 1:
                for k in range(max(j, end), j + n):
                    gone[k] = True
                end = j + n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.add((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def token_pieces(docs, tokenizer, cap=2048):
    out = set()
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % cap + 1
        edges = [0, *range(first, len(ids) + 1, cap)]
        for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            out.add((i, p, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))))
    return out
