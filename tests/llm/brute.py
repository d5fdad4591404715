"""Plain single-machine versions of the operators, as slow as they are simple."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def components(docs, size, percent):
    """(doc_id, set size, smallest linked doc_id), sorted."""
    sets = []
    for _, text in docs:
        w = WORD.findall(lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in enumerate(sets):
        for e in own:
            holders[e].append(i)
    shared = collections.Counter((b, a) for h in holders.values() for n, a in enumerate(h) for b in h[:n])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    best = {}
    for i, (doc, _) in enumerate(docs):
        best[root(i)] = min(best.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), best[root(i)] if sets[i] else doc) for i, (doc, _) in enumerate(docs))


def repeats(docs, n):
    """By doc_id, the words in later places of repeated windows that no first place holds, and those of first places."""
    texts = collections.defaultdict(list)
    for doc, text in docs:
        texts[text or ""].append(doc)
    places, words = collections.defaultdict(list), {}
    for text, ids in texts.items():
        found = [(lower(m.group()), m.start(), m.end()) for m in WORD.finditer(text)]
        words.update((doc, found) for doc in ids)
        for i in range(len(found) - n + 1):
            places[tuple(x[0] for x in found[i : i + n])].append((min(ids), i))
    out = {doc: (set(), set()) for doc, _ in docs}
    for where in places.values():
        for doc, i in where if len(where) > 1 else ():
            out[doc][(doc, i) == min(where)].update(range(i, i + n))
    for ids in texts.values():
        for doc in ids:
            whole = range(len(words[doc])) if len(words[doc]) >= n else ()
            out[doc] = (out[doc][0] - out[doc][1], out[doc][1]) if doc == min(ids) else (set(whole), set())
    return out, words


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    def valid(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {
            "email": lambda: True,
            "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 8 <= len(digits) <= 15,
        }[kind]()

    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def spans_text(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
