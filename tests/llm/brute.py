"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])


def components(docs):
    """{id: (shingles, component)} of rows (id, text)."""
    sets = [(i, frozenset(shingles(words(t)))) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y) or x and x == y:
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def contaminated(docs, items):
    own = {i: words(t) for i, t in items}
    df = Counter(x for w in own.values() for x in set(shingles(w)))

    def weight(xs):
        return sum(1 + math.log(len(items) / max(1, df.get(x, 1))) for x in xs)

    out = {}
    for d, t in docs:
        w = words(t)
        for i, v in own.items():
            n, best = min(len(v), len(w)), 0.0
            for a in range(len(w) - n + 1 if n else 0):
                x, y = set(shingles(w[a : a + n])), set(shingles(v))
                common = weight(x & y)
                best = max(best, common / (weight(x) + weight(y) - common))
            if best >= 0.75 - 1e-12:
                out[d, i] = round(best, 9)
    return out


_STRIP = " \t\n\v\f\r"


def kept_lines(docs, chars=40, least=5):
    held = {}
    for k, (i, t) in enumerate(docs):
        for line in (t or "").split("\n"):
            key = lower(line.strip(_STRIP))
            if len(key) >= chars:
                held.setdefault(key, {})[k] = i
    lost = {key: max(x.values()) for key, x in held.items() if len(x) >= least}
    out = []
    for i, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (lower(x.strip(_STRIP)) in lost and i < lost[lower(x.strip(_STRIP))])]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out)


PII = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text):
    out = []
    for k, pattern in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)
