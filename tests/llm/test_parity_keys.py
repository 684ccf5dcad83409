"""Keys and cells of the parity join: what a linked pair shares, how buckets grow, packed cells against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

from scenaria.llm import parity_join as P


@pytest.mark.parametrize("percent,size", [(80, 4), (80, 9), (80, 30), (80, 120), (80, 500), (80, 5000), (90, 9), (90, 40), (90, 800)])
def test_linked_pairs_at_the_threshold_share_a_key(percent, size):
    rng = np.random.default_rng(size)
    most = P.most_apart(2 * size, percent)
    for _ in range(60):
        common = rng.integers(0, 2**63, size - most // 2, dtype=np.uint64)
        a = np.sort(np.concatenate([common, rng.integers(0, 2**63, most // 2, dtype=np.uint64)]))
        b = np.sort(np.concatenate([common, rng.integers(0, 2**63, most - most // 2, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both):
            continue
        keys, at = P._keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert set(keys[:at[1]].tolist()) & set(keys[at[1]:].tolist())


def test_large_sets_have_few_keys_and_unlinked_ones_share_none():
    rng = np.random.default_rng(1)
    for n in (2000, 4000):
        sets = [np.sort(rng.integers(0, 2**63, 30, dtype=np.uint64)) for _ in range(n)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        keys, _ = P._keys(np.concatenate(sets), at, 80)
        assert len(np.unique(keys)) == len(keys)
    for low, _, blocks in P.bands(80, 10**5):
        deals, kept = P.keyed(low, blocks, 80)
        assert deals * kept <= 120


def test_packed_cells_find_all_near_pairs():
    rng = random.Random(2)
    rows, want = [], set()
    for bucket in range(40):
        n = rng.choice([3, 5, 40])
        base = np.array([rng.getrandbits(63) for _ in range(P.WORDS)], np.int64)
        nodes = []
        for _ in range(n):
            s = base.copy()
            for _ in range(rng.randrange(30)):
                s[rng.randrange(P.WORDS)] ^= 1 << rng.randrange(63)
            nodes.append((rng.getrandbits(62), rng.randrange(4), rng.randrange(40, 60), s))
        chunks = rng.choice([1, 3])
        for i, (node, root, size, s) in enumerate(nodes):
            for other in range(chunks):
                c = node % chunks
                rows.append((bucket, min(c, other), max(c, other), c, node, root, size, s))
            for node2, root2, size2, s2 in nodes[:i]:
                if root != root2 and int(np.bitwise_count((s ^ s2).view(np.uint64)).sum()) <= P.most_apart(size + size2, 80):
                    want.add((min(node, node2), max(node, node2)))
    rng.shuffle(rows)
    out = P._cells(80)(pd.DataFrame(rows, columns=["bucket", "low", "high", "chunk", "node", "root", "n_shingles", "held"]))
    assert set(map(tuple, out.to_numpy().tolist())) == want and want
