"""Plain restatements of the operators on small rows."""

import random
import re

UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(UPPER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(docs):
    """docs: [(id, text)] -> {id: (shingles, least id reachable)}; ids are unique."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed(docs, least):
    """docs in order [(id, text)] -> {id: (bytes, removed, spans, kept)}."""
    seen, out = set(), {}
    for d, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            window = data[i : i + least]
            if window in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(window)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone) if not g))
    return out


def edits_inside(item, text):
    """Least word edits between ``item`` and any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        new = [i]
        for j, other in enumerate(text, 1):
            new.append(min(row[j - 1] + (word != other), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{min(int(rng.expovariate(1 / 60)), vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.4:
            w[at] = f"x{rng.randrange(1000)}"
        elif kind < 0.7 and len(w) > 1:
            del w[at]
        else:
            w.insert(at, f"y{rng.randrange(1000)}")
    return " ".join(w)
