"""SuperMinHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
from helpers import ODD, documents, prose, rows

from kinelane.llm import minhash
from kinelane.llm.minhash import SLOTS, _draw, near_duplicate_sets, shingle_set, signatures


def _set(text, size=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def _expected(ids, texts, percent=80):
    sets = [_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), c := least.get(find(i)), d == c) for i, (d, s) in enumerate(zip(ids, sets, strict=True))), key=repr)


def _got(df, **kw):
    return rows(near_duplicate_sets(df, **kw), "doc_id", "n_shingles", "component_id", "kept")


def _changed(text, share, seed):
    own = random.Random(seed)
    return " ".join(w if own.random() > share else w + str(own.randint(0, 9)) for w in text.split())


def _family(seed, words, copies, share):
    """Copies of one text with words changed; similarities lie on both sides of the limit."""
    base = prose(seed, words)
    return [base] + [_changed(base, share, 1000 * seed + k) for k in range(copies)]


def test_every_permutation_is_one():
    """Without the early end, every element offers each rank once to each slot."""
    for element in np.random.default_rng(0).integers(1, 1 << 63, 5, dtype=np.uint64):
        out = np.full((1, SLOTS), np.iinfo(np.uint64).max, np.uint64)
        _draw(np.array([element]), np.zeros(1, np.int64), out)
        assert sorted((out[0] >> np.uint64(40)).tolist()) == list(range(SLOTS))


def test_signature_is_the_least_offer_and_estimates_similarity(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 7, 60, 900)]
    whole = signatures(sets)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    assert (signatures(sets) == whole).all()
    for own, signature in zip(sets, whole, strict=True):
        single = np.min([signatures([own[k : k + 1]])[0] for k in range(len(own))], axis=0)
        assert (single == signature).all()
    error = []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        x, y = signatures([np.concatenate([common, a]), np.concatenate([common, b])])
        error.append((x == y).mean() - 0.8)
    assert abs(np.mean(error)) < 0.015 and np.std(error) < 0.8 * np.sqrt(0.8 * 0.2 / SLOTS)


def test_sets():
    for text in [*ODD, prose(3, 200), "One TWO one two one", "É é É é"]:
        assert len(shingle_set(text or "", 2)) == len(_set(text))


@pytest.mark.parametrize("fruitful, tile, together", [(0.1, 256, 500_000), (2.0, 4, 15)])
def test_near_duplicates(spark, monkeypatch, fruitful, tile, together):
    """All rounds, or one round and tiles for the rest, and trees of all links or of parts of them: the same groups."""
    monkeypatch.setattr(minhash, "TOGETHER", together)
    monkeypatch.setattr(minhash, "FRUITFUL", fruitful)
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = [*ODD, *_family(1, 90, 40, 0.04), *_family(2, 60, 30, 0.05), *_family(3, 25, 15, 0.06), *[prose(i, 100) for i in range(20, 40)]]
    chain = prose(50, 60).split()
    texts += [" ".join(chain[k : k + 55]) for k in range(6)] + ["a b", "A b", "b a", "one", "ONE", texts[25]]
    ids = list(range(900, 900 + len(texts)))
    random.Random(7).shuffle(ids)
    want = _expected(ids, texts)
    groups = [c for _, n, c, _ in want if n > 20]
    assert 30 < len(set(groups)) < 90 and max(map(groups.count, groups)) > 10
    assert _got(documents(spark, texts, ids)) == want


def test_null_ids_repeated_rows_and_no_rows(spark):
    texts = ["a b c d", "a b c d", "A B C D", "x y z", None, "", "x y z"]
    ids = [None, 4, 4, None, None, 7, None]
    assert _got(documents(spark, texts, ids)) == sorted(
        [(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (None, 2, None, True), (None, 2, None, True), (None, 0, None, True), (7, 0, 7, True)], key=repr
    )
    assert near_duplicate_sets(documents(spark, texts, ids).limit(0)).count() == 0
    assert _got(documents(spark, ["p q r", "s t u"], [1, 2])) == [(1, 2, 1, True), (2, 2, 2, True)]
