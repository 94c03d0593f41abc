"""Large buckets of near-duplicate search, split by rare samples."""

import numpy as np
import pytest

from mediatables.llm import minhash


def _boilerplate(n, shared, own, seed=3):
    """Texts that share ``shared`` words in a row; of every ten, two more are near copies of the first."""
    rng = np.random.default_rng(seed)
    common = [f"c{x}" for x in rng.integers(0, 10**6, shared)]
    texts = []
    for k in range(n):
        words = texts[k - k % 10].split() if k % 10 in (3, 7) else [*common, *(f"u{k}x{x}" for x in rng.integers(0, 10**6, own))]
        if k % 10 in (3, 7):
            words[shared + own // 2] = f"changed{k}"
        texts.append(" ".join(words))
    return texts


def _components(texts, percent):
    sets = [set(zip(*(t.split()[j:] for j in range(5)))) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return dict(enumerate(label))


@pytest.mark.parametrize(("shared", "percent"), [(110, 85), (140, 80)])
def test_large_buckets_equal_brute_force(spark, monkeypatch, shared, percent):
    texts, ran = _boilerplate(120, shared, 160 - shared), []
    split = minhash._split
    monkeypatch.setattr(minhash, "_split", lambda *args: ran.append(1) or split(*args))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=percent, block=9).collect()}
    assert got == _components(texts, percent) and ran
    assert len(set(got.values())) > 1


def test_first_samples_meet(spark):
    """Sets that agree in as many samples as the margin asks share a first one, whatever the order."""
    rng = np.random.default_rng(11)
    most = minhash.first_samples(0.85)
    for _ in range(50):
        order = rng.permutation(4 * minhash.SAMPLES)
        both = rng.choice(4 * minhash.SAMPLES, minhash.SAMPLES, replace=False)
        other = np.concatenate((both[most - 1 :], np.setdiff1d(np.arange(4 * minhash.SAMPLES), both)[: most - 1]))
        first = [set(sorted(x, key=lambda v: order[v])[:most]) for x in (both, other)]
        assert first[0] & first[1]
    assert minhash.split_loss(0.85) < 1e-7 and minhash.split_loss(0.8) < 1e-6
