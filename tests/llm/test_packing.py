import random

import numpy as np
import pytest

from tallyforge.llm.packing import nnls, pack, patterns, plan, token_counts


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "id long, tokens long, container int")
    return pack(df, item_id="id", size="tokens", capacity=capacity).collect()


def check(rows, sizes, capacity):
    used, pieces = {}, {}
    for r in rows:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
        pieces.setdefault(r["id"], []).append((r["piece"], r["size"]))
    assert all(u <= capacity for u in used.values())
    for i, s in enumerate(sizes):
        s = max(0, s or 0)
        own = sorted(pieces[i])
        assert sum(n for _, n in own) == s and [p for p, _ in own] == list(range(max(1, -(-s // capacity))))
        assert all(n == capacity for _, n in own[:-1])
    assert len(pieces) == len(sizes)
    return len([u for u in used.values() if u])


@pytest.mark.parametrize("capacity", [1, 10, 2048, 5000])
def test_everything_fits(spark, capacity):
    r = random.Random(capacity)
    sizes = [0, None, -4, 1, capacity, capacity + 1, 3 * capacity] + [r.randrange(1, capacity + 2) for _ in range(300)] + [capacity // 3 + 1] * 200
    check(packed(spark, sizes, capacity), sizes, capacity)


def test_little_space_is_lost(spark):
    r = random.Random(1)
    sizes = [min(2048, int(r.lognormvariate(5.5, 0.9)) + 1) for _ in range(6000)]
    n = check(packed(spark, sizes, 2048), sizes, 2048)
    assert sum(sizes) / (n * 2048) > 0.98


def test_empty(spark):
    assert packed(spark, [], 10) == []
    with pytest.raises(ValueError):
        packed(spark, [1], 0)


def test_plan_uses_up_the_histogram():
    rng = np.random.default_rng(0)
    for capacity in (1, 5, 64):
        counts = rng.integers(0, 50, capacity + 1)
        left = counts.copy()
        left[0] = 0
        for kind, n in plan(counts):
            assert sum(s * k for s, k in kind) <= capacity
            for s, k in kind:
                left[s] -= k * n
        assert not left.any()


def test_nnls_reaches_an_exact_solution():
    columns = patterns(8, 3, np.ones(9, dtype=bool))
    x = np.arange(len(columns), dtype=float)
    target = np.zeros(9)
    for c, n in zip(columns, x):
        for s in c:
            target[s] += n
    target[0] = 0
    got = nnls(columns, target, np.ones(9), rounds=5000)
    back = np.zeros(9)
    for c, n in zip(columns, got):
        for s in c:
            back[s] += n
    assert np.abs(back - target)[1:].max() < 1e-3 * target.max() and (got >= 0).all()


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "word " * 20000)], "id int, text string")
    assert {r["id"]: r["tokens"] for r in token_counts(df, doc_id="id", text="text", vocabulary=path).collect()} == {1: 2, 2: 0, 3: 0, 4: 20001}
