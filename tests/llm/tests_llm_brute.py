"""Plain versions of what the operators compute."""

import numpy as np


def windows_removed(units, window, counts):
    """Which units lie in a window that occurs more than once."""
    gone = np.zeros(len(units) + 1, dtype=int)
    for i in range(len(units) - window + 1):
        if counts[bytes(units[i : i + window]) if isinstance(units, bytes) else tuple(units[i : i + window])] > 1:
            gone[i] += 1
            gone[i + window] -= 1
    return np.cumsum(gone)[:-1] > 0


def shingles(text, k=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_classes(sets):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group
