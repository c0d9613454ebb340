"""Plain versions of the operators, over lists of rows."""

import collections
import hashlib
import itertools
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SOLID = re.compile("[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=ALNUM, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def shingles(text):
    w = words(text, SOLID)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows, percent):
    """Id to (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    common = collections.Counter(p for ids in by.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def leaks(rows, items, size=10):
    """Per row: words, hit word places and item ids."""
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k:k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), hit, sorted(found)))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def personal(text):
    return [(k, m.start(), m.end()) for k in PII for m in re.finditer(PII[k], text or "") if _holds(k, m.group())]


def quality(text):
    text = text or ""
    w = words(text, SOLID, lower=False)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if SOLID.search(line):
            dup += line in lines
            lines.add(line)
    seen = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeat = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), len(w) < 50 or 100 * len(repeat) > 50 * len(w)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def licences(text):
    w = words(text)
    found = [(i, label) for p, label in PHRASES.items() for n in [len(p.split())] for i in range(len(w) - n + 1) if w[i:i + n] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
