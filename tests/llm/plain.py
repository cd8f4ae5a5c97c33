"""Plain single-process versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict


def shingle_sets(texts, size):
    out = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        runs = {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}
        out.append(runs if len(words) >= size else ({tuple(words)} if words else set()))
    return out


def components(ids, texts, size, percent):
    sets, parent = shingle_sets(texts, size), {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, own in enumerate(sets):
        both = Counter(j for s in own for j in holders[s])
        for s in own:
            holders[s].append(k)
        for j, n in both.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = root(ids[k]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, [len(s) for s in sets]


def repeats(texts, length):
    """(bytes, removed, spans, checksum of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(d, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def sentences(text):
    """Pieces of a text, each a sentence and the white space after it."""
    return [m for m in re.findall(r"(?s).*?(?:[.!?](?=[ \t-\r]|$)|\n|$)[ \t-\r]*", text or "") if m]


def span_removal(ids, texts, least, words):
    """Texts without sentences of spans that stand before, by identifier and place; sentences without a word belong to none."""
    places, spans = [], defaultdict(list)
    for doc, text in zip(ids, texts):
        pieces = sentences(text)
        spoken = [i for i, p in enumerate(pieces) if p.split()]
        found = set()
        for a in range(len(spoken)):
            for b in range(a + least - 1, len(spoken)):
                if sum(len(pieces[i].split()) for i in spoken[a:b + 1]) >= words:
                    found.add((a, b))
                    break
        for b in range(len(spoken)):
            for a in range(b - least + 1, -1, -1):
                if sum(len(pieces[i].split()) for i in spoken[a:b + 1]) >= words:
                    found.add((a, b))
                    break
        for a, b in found:
            spans[tuple(" ".join(pieces[spoken[a]:][:0] + [pieces[i] for i in spoken[a:b + 1]]).split())].append((doc, spoken[a], spoken[b]))
        places.append(pieces)
    gone = defaultdict(set)
    for held in spans.values():
        for doc, a, b in sorted(held)[1:]:
            gone[doc].update(range(a, b + 1))
    return ["".join(p for i, p in enumerate(pieces) if i not in gone[doc]) for doc, pieces in zip(ids, places)]
