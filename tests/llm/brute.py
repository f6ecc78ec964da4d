"""Plain versions of the operators, for small tables."""

from collections import Counter, defaultdict
from hashlib import sha256


def suffix_dedup(rows, window):
    texts = [(d, (t or "").encode()) for d, t in rows]
    times = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if times[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def passage_dedup(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    key = lambda d: -(2**63) if d is None else d
    for d, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, 2**63), key(d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def near_groups(rows, size=5, share=75):
    def shingles(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = low.encode().split()
        return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            by[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= share * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least[root(i)], d == least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def repair(rows):
    """Conversation id to the contract's values, for rows (conv, turn, role, text) after damage, in order."""
    import re

    goes = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    fill = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = {}
    for conv, own in by.items():
        seen, faults = set(), []
        for _, role, text in own:
            end = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", []), 3: (0, "", [])}
        for k in reversed(range(-1, len(own))):
            for _ in range(3):
                for s, (role, t) in fill.items():
                    if t in best:
                        best[s] = min(best.get(s, (10**9,)), (best[t][0] + 3, "I" + best[t][1], [f"{role}:", *best[t][2]]))
            if k < 0:
                break
            _, role, text = own[k]
            more, now = 3 * (faults[k] == "truncated"), {}
            for s in range(4):
                ways = [(best[s][0] + 4, "D" + best[s][1], best[s][2])]
                if faults[k] not in ("blank", "duplicate"):
                    name, t = fill[s]
                    ways.append((best[t][0] + 3 + more, "R" + best[t][1], [f"{name}:{text}", *best[t][2]]))
                    if role[:1] in goes[s]:
                        t = goes[s][role[:1]]
                        ways.append((best[t][0] + more, "K" + best[t][1], [f"{role}:{text}", *best[t][2]]))
                now[s] = min(ways)
            best = now
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = best[0]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(lines).encode()).hexdigest())
    return out
