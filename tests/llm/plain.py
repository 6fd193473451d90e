"""Brute-force versions of the numbered operators, in plain Python over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def order(i):
    return (1, 0) if i is None else (0, i)


def language_model(rows, top=3, alpha=0.4, exclude_own=True):
    docs = [(i, PLAIN.findall(lower(t))) for i, t in rows]
    all_, own = Counter(), []
    for _, w in docs:
        c = Counter(tuple(w[p : p + k]) for k in range(1, top + 1) for p in range(len(w) - k + 1))
        own.append(c)
        all_ += c
    total = sum(len(w) for _, w in docs)
    out = []
    for (i, w), mine in zip(docs, own, strict=True):
        count = lambda g: all_[g] - (mine[g] if exclude_own else 0)  # noqa: B023, E731
        score, backed = 0.0, 0
        for p in range(len(w)):
            steps = 0
            for k in range(min(top, p + 1), 0, -1):
                g = tuple(w[p - k + 1 : p + 1])
                if k > 1 and count(g) > 0:
                    score += math.log(count(g) / count(g[:-1])) + steps * math.log(alpha)
                    break
                if k == 1:
                    score += math.log((count(g) or alpha) / max(1, total - (len(w) if exclude_own else 0))) + steps * math.log(alpha)
                    break
                steps += 1
            backed += steps > 0
        out.append((i, len(w), backed, round(score, 6)))
    return out


def near_duplicates(rows, pct=80, k=5):
    sets = []
    for _, t in rows:
        w = PLAIN.findall(lower(t))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= pct * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[find(x)].append(rows[x][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[x][0], len(sets[x]), least[find(x)]) for x in range(len(rows))]


def repeats(rows, size=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - size + 1):
            first[b[s : s + size]] = min(first.get(b[s : s + size], order(i)), order(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < order(i):
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def quality(text):
    words = PLAIN.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if PLAIN.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def quality_rules(rows):
    """rows: id, host, text. -> id, counts, base_failed, kept."""
    base = [(i, h, *quality(t)) for i, h, t in rows]
    failed = [b[2] < 20 or 100 * b[6] > 30 * b[2] for b in base]
    hosts = defaultdict(list)
    for b, f in zip(base, failed, strict=True):
        hosts[b[1]].append(f)
    rates = [Fraction(sum(f), len(f)) for f in hosts.values()]
    mean = sum(failed) / len(failed)
    middle = sum(rates) / len(rates)
    var = float(sum((r - middle) ** 2 for r in rates) / len(rates))
    weight = min(max(mean * (1 - mean) / var - 1, 0.0), 1e6) if var > 0 else 1e6
    rate = {h: (sum(f) + mean * weight) / (len(f) + weight) for h, f in hosts.items()}
    return [(b[0], *b[2:], f, not f and rate[b[1]] <= 0.5) for b, f in zip(base, failed, strict=True)]


def decontaminate(rows, items, size=13):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (g := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[g]
        out.append((i, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def longest_runs(rows, items, size=13):
    """Per row: words and first place of the longest run that stands in an item too, a window or a whole shorter item at least."""
    split = [ALNUM.findall(lower(t)) for _, t in items]
    starts = defaultdict(list)
    for w in split:
        for j in range(len(w) if len(w) >= size else min(1, len(w))):
            starts[w[j]].append((w, j))
    out = []
    for i, t in rows:
        d = ALNUM.findall(lower(t))
        best = (0, None)
        for p in range(len(d)):
            for w, j in starts.get(d[p], ()):
                k = 0
                while j + k < len(w) and p + k < len(d) and w[j + k] == d[p + k]:
                    k += 1
                if k >= min(size, len(w)) and k > best[0]:
                    best = (k, p)
        out.append((i, *best))
    return out


def longest_matches(rows, items):
    """(item, place) -> length of the longest run of words that a document has too."""
    docs = [ALNUM.findall(lower(t)) for _, t in rows]
    out = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for p in range(len(w)):
            best = 0
            for d in docs:
                for q in range(len(d)):
                    k = 0
                    while p + k < len(w) and q + k < len(d) and w[p + k] == d[q + k]:
                        k += 1
                    best = max(best, k)
            if best:
                out[i, p] = best
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def line_dedup(rows, min_chars=20):
    """Rows with distinct ids; null ids come first."""
    key = lambda i: (0, 0) if i is None else (1, i)
    first = {}
    for i, t in rows:
        for p, x in enumerate(t.split("\n") if t is not None else []):
            if PLAIN.search(x):
                first[x] = min(first.get(x, (key(i), p)), (key(i), p))
    long = [x for x in first if len(x) >= min_chars]
    near = {x for x in long if any(first[y] < first[x] and x != y and one_edit(x, y) for y in long)}
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for p, x in enumerate(lines) if not PLAIN.search(x) or (first[x] == (key(i), p) and x not in near)]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def filter_audit(rows, labels):
    """rows: id, part, text; labels: id, quality, toxic. Every order is applied to the documents one filter after the other."""
    from itertools import permutations

    docs = []
    ids = defaultdict(list)
    for i, _, t in rows:
        if i is not None:
            ids[t or ""].append(i)
    for i, part, t in rows:
        t = t or ""
        w = PLAIN.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and min(ids[t]) < i}
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    orders = ["".join(p) for p in permutations("ABCDE")]
    out, removed_by = [], Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in orders:
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                redundant = sum(d[1][f] for d in mine) - len(gone)
                left = [d for d in left if not d[1][f]]
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in mine)
                removed_by[part, f] += len(gone)
                out.append([part, order, step, len(left), len(gone), redundant, only, sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return [(*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out]


def url_parts(url, rules):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    raw = re.match("[^/?#]*", rest)[0]
    host, path = lower(raw), re.match("[^?#]*", rest[len(raw) :])[0]
    fits = [(h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))
