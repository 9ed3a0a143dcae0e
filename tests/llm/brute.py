"""Plain versions of the operators' results, for small tables."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def repeats(docs, length=200):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of (id, text) pairs."""
    bodies = [(t or "").encode() for _, t in docs]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (doc, _), b in zip(docs, bodies):
        gone, until = [], 0
        for i in range(len(b)):
            if i <= len(b) - length and seen[b[i : i + length]] > 1:
                until = i + length
            gone.append(i < until)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingle_set(text, n=4):
    words = WORD.findall((text or "").translate(SMALL))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def near_groups(docs, percent=85):
    """``doc_id, n_shingles, component_id`` of (id, text) pairs, all pairs compared."""
    sets = [shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(d, len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def base_statistics(text):
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = text or ""
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def _either(word):
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEY = "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = re.compile(KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    """``(start, kind, end)`` of the three fixed kinds."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def listed(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


def damage(rows):
    """Rows after the damage of the conversation query, by conversation; dropped ones are gone."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        mine = out.setdefault(conv, [])
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        role = "user" if fate == 4 else role
        mine += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def repaired(turns):
    """``gaps .. repaired_sha256`` of one conversation's rows (turn, role, text), by trying every edit."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    numbers = [t for t, _, _ in turns if t is not None]
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    # Least (cost, audit) with its lines for each role string's state; inserts come before a row.
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    def better(table, state, option):
        if state not in table or option[:2] < table[state][:2]:
            table[state] = option

    def with_inserts(table):
        full = dict(table)
        for _ in range(3):
            for state, (cost, audit, lines) in list(full.items()):
                for x in "ua":
                    if (state, x) in step:
                        better(full, step[state, x], (cost + 2, audit + "I", [*lines, names[x] + ":"]))
        return full

    best = {"": (0, "", [])}
    for (_, role, text), fault in zip(turns, faults):
        new = {}
        # Every number of inserts, not the cheapest alone: their letters decide ties.
        options = [(s, v) for s, v in best.items()]
        for _ in range(3):
            options += [(step[s, x], (v[0] + 2, v[1] + "I", [*v[2], names[x] + ":"])) for s, v in options for x in "ua" if (s, x) in step]
        for state, (cost, audit, lines) in options:
            better(new, state, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] == "" or (state, role[:1]) in step:
                better(new, step.get((state, role[:1]), state), (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
            for x in "ua":
                if (state, x) in step:
                    better(new, step[state, x], (cost + 2 + more, audit + "R", [*lines, f"{names[x]}:{text}"]))
        best = new
    ended = with_inserts(best)
    cost, audit, lines = min((ended[s] for s in ("", "a") if s in ended), key=lambda v: v[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """``item_id, rank, doc_id, score``: every document scored for every item."""
    bags = [(d, collections.Counter(TERM.findall((t or "").translate(SMALL)))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(TERM.findall((text or "").translate(SMALL)))
                if t in bag
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return out
