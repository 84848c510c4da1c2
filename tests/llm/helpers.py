"""Plain versions of what the operators do, for small inputs."""

import collections
import re

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGE_TEXTS = [None, "", "***", "a b", "A  b!", "\U0001f600 é", "x " * 3000, "word" * 5000]


def words(text):
    return RX.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(text, k=5):
    w = words(text)
    return collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else collections.Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def groups(docs, similarity=0.8):
    """Least id of each document's group, by comparing all pairs (doc_id -> text)."""
    bags = {i: b for i, t in docs.items() if (b := bag(t))}
    parent = {i: i for i in docs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = collections.defaultdict(set)
    for i in sorted(bags):
        near = collections.Counter()
        for s, n in bags[i].items():
            for j in inverted[s]:
                near[j] += min(n, bags[j][s])
            inverted[s].add(i)
        for j, shared in near.items():
            if shared / (sum(bags[i].values()) + sum(bags[j].values()) - shared) >= similarity - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in docs}
