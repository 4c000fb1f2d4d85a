"""The operators' results worked out plainly."""

import re

FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(texts, n, num=80, den=100):
    """{id: smallest id reachable} of {id: text}."""
    sets, root = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def nearest_edits(item, text):
    """Least edit distance of item to any part of text."""
    row, best = list(range(len(item) + 1)), len(item)
    for w in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i - 1] + (x != w), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best
