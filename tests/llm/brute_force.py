"""Plain versions of operators for the tests."""

import re


def brute_similar(texts, least=0.8, width=5):
    """Root of each id over all pairs whose sets of five-word shingles have a Jaccard similarity of least or more."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in texts}
