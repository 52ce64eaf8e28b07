"""Plain versions of the text operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard_classes(rows):
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    inverse = defaultdict(list)
    for k, x in sets.items():
        for g in x:
            inverse[g].append(k)
    u = Union(sets)
    for k, x in sets.items():
        for j, n in Counter(j for g in x for j in inverse[g] if j > k).items():
            if 100 * n >= 80 * (len(x) + len(sets[j]) - n):
                u.join(k, j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[u.find(k)] = min(least.get(u.find(k), i), i)
    return sorted((i, len(sets[k]), least[u.find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows))


def removed(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def line_drops(rows, most=2, least=24):
    occ = []
    for i, t in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate((t or "").split("\n")):
            x = line.encode().strip(b" \t\n\x0b\x0c\r")
            if len(x) >= least:
                occ.append((i, n, x))
    texts = sorted({x for *_, x in occ})
    u = Union(texts)
    for k, a in enumerate(texts):
        for b in texts[k + 1 :]:
            if abs(len(a) - len(b)) <= most and edits(a, b) <= most:
                u.join(a, b)
    first, drop = set(), defaultdict(set)
    for i, n, x in occ:
        c = u.find(x)
        if c in first:
            drop[i].add(n)
        first.add(c)
    return {i: "\n".join(line for n, line in enumerate(t.split("\n")) if n not in drop[i]) if t is not None else None for i, t in rows}


def main_words(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    c = Counter(grams)
    covered = {j for k, g in enumerate(grams) if c[g] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
