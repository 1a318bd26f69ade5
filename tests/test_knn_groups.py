"""Many queries and vectors: groups of one place, ruled out together."""

import numpy as np
import pytest

from skein.operators.knn import _shards, _TopK

N_Q, N_V, DIM, K = 4200, 6000, 12, 4


def _clustered(n, seed, away=0.0):
    rng = np.random.default_rng(seed)
    centers = np.random.default_rng(1).normal(size=(6, DIM)) * 4 + away
    return (centers[rng.integers(0, 6, n)] + rng.normal(size=(n, DIM)) * 0.3).astype(np.float32)


def _found(top):
    r = top.result()
    got = sorted(zip(*[c.to_pylist() for c in (r.column(0), r.column(3), r.column(1))]))
    return [(q, v) for q, _, v in got]


def _nearest(q, q_ids, v, v_ids, own):
    out = []
    for i in range(len(q)):
        key = np.round(np.square(q[i].astype(float) - v.astype(float)).sum(1), 9)
        if own:
            key[v_ids == q_ids[i]] = np.inf
        out += [(q_ids[i], v_ids[j]) for j in np.lexsort((v_ids, key))[:K]]
    return out


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("away", [0.0, 500.0])
def test_groups_give_the_nearest_and_rule_out_places(away, own):
    v, q = _clustered(N_V, 2, away), _clustered(N_Q, 3, away)
    v[3000:3020] = v[7]                                     # ties, in both pieces below
    q[:2100] = v[:2100]
    v[10], q[4000] = 0, 0                                   # far from all others
    v_ids = np.array([f"v{(i * 7) % N_V:04d}" for i in range(N_V)], dtype=object)
    q_ids = np.array([v_ids[i] if i < 2100 else f"q{i}" for i in range(N_Q)], dtype=object)
    top = _TopK(q_ids, q, K, own, 9)
    top.add_all(v_ids[:4500], v[:4500])
    top.add_all(v_ids[4500:], v[4500:])                     # too few for groups
    some = np.r_[0:60, 2990:3025, 4000, 4100:4150]
    want = _nearest(q[some], q_ids[some], v, v_ids, own)
    asked = set(q_ids[some])
    assert sorted(x for x in _found(top) if x[0] in asked) == sorted(want)
    # of the first piece, little is met but the own place
    assert top.pairs < N_Q * (4500 * 0.5 + 1500)


def test_groups_leave_out_what_has_no_distance():
    v, q = _clustered(5000, 4), _clustered(4500, 5)
    q[3], v[9] = np.nan, np.inf
    ids = np.arange(5000)
    top = _TopK(ids[:4500], q, K, False, 9)
    top.add_all(ids, v)
    plain = _TopK(ids[:4500], q, K, False, 9)
    for s in range(0, 5000, 1000):                          # too few for groups
        plain.add_all(ids[s:s + 1000], v[s:s + 1000])
    assert _found(top) == _found(plain) and len(_found(top)) == 4499 * K


def test_equal_vectors_fill_many_groups():
    v = np.ones((5000, DIM), np.float32)
    ids = np.arange(5000)[::-1].copy()
    top = _TopK(np.arange(4096), v[:4096] * 2, K, False, 9)
    top.add_all(ids, v)
    assert _found(top) == [(i, j) for i in range(4096) for j in range(K)]


def test_queries_are_copied_to_few_shards():
    # 7 blocks of 131 072 queries, 3.5 million vectors: 27 shards before
    assert _shards(3_500_000, 7, 12) == 8
    assert _shards(3_500_000, 200, 12) == 1                 # blocks enough for all cores
    assert _shards(1000, 1, 8) == 8 and _shards(10 ** 6, 1, 8) == 32
