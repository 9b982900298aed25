"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


def alnum_words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = PLAIN.findall((text or "").translate(LOWER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near(rows, k=3, percent=85):
    """(id, shingles, component, kept) for rows (id, text) of distinct ids."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for x, (i, s) in enumerate(sets):
        common = {}
        for g in s:
            for y in holders.setdefault(g, []):
                common[y] = common.get(y, 0) + 1
            holders[g].append(x)
        for y, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[y][1]) - c):
                a, b = root(i), root(sets[y][0])
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def contamination(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = alnum_words(t)
        d = min(window, len(w))
        for k in range(len(w) - d + 1 if i is not None and d else 0):
            wins.setdefault(tuple(w[k:k + d]), set()).add(str(i))
    sizes, out = {len(x) for x in wins}, []
    for i, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for d in sizes:
            for k in range(len(w) - d + 1):
                if s := wins.get(tuple(w[k:k + d])):
                    hit.update(range(k, k + d))
                    found |= s
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def line_runs(rows, run=3, long_words=30):
    """(id, lines, deleted, text) for rows (id, text), given once each."""
    seen, out = set(), []
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [n for n, x in enumerate(lines) if x.strip(" \t\r\f\x0b")]
        gone = set()
        for p in range(len(full)):
            windows = [[full[p]]] if len(re.findall(r"[^ \t\r\f\x0b]+", lines[full[p]])) >= long_words else []
            windows += [full[p:p + run]] if p + run <= len(full) and full[p:p + run] not in windows else []
            for w in windows:
                key = (len(w), *[lines[n] for n in w])
                gone.update(w if key in seen else [])
                seen.add(key)
        out.append((i, len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return out


def phrase_places(text, phrases):
    """(words, places, first, last, labels)."""
    w, at, labels = alnum_words(text), [], set()
    for label, phrase in phrases:
        p = phrase.split()
        here = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
