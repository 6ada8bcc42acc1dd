"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


class Groups:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def substring_dedup(docs, window=13):
    """{doc_id: (n_words, n_removed, kept_sha256)} of {doc_id: text}."""
    own = {i: words(t) for i, t in docs.items()}
    first = {}
    for i in sorted(own):
        for at in range(len(own[i]) - window + 1):
            first.setdefault(tuple(own[i][at : at + window]), i)
    out = {}
    for i, w in own.items():
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < i:
                gone |= set(range(at, at + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def jaccard_join(docs, k=5):
    """{doc_id: (n_shingles, component_id)} of {doc_id: text}."""
    sets = {}
    for i, t in docs.items():
        w = words((t or "").translate(FOLD))
        sets[i] = ({tuple(w)} if w else set()) if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    held, groups = defaultdict(set), Groups(docs)
    for i, s in sets.items():
        for x in s:
            held[x].add(i)
    for i, s in sets.items():
        for j in {j for x in s for j in held[x] if j > i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}
