"""Near-duplicates, repeated byte strings and earlier passages against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import ODD, documents, prose, rows

from kinelane.llm import repeats, simhash
from kinelane.llm.components import components
from kinelane.llm.passages import LAST, cover_for, remove_earlier_passages
from kinelane.llm.repeats import remove_repeats
from kinelane.llm.simhash import LENGTH, anchors, fingerprint, forest, near_duplicates, near_links, replicas
from kinelane.llm.suffixes import suffix_array


def _print(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones += np.array([h >> k & 1 for k in range(64)])
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles)) if shingles else 0


def _groups(prints, distance):
    """Least index reachable, by index."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints_of_any_text(monkeypatch):
    monkeypatch.setattr(simhash, "SEGMENT", 50)
    monkeypatch.setattr(simhash, "COUNTED", 7)
    for text in [*[t or "" for t in ODD], prose(1, 300), "UPPER Über Case " * 30]:
        assert fingerprint(text) == _print(text)


def test_covering_code():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << LENGTH, 40, dtype=np.uint64)
    index, code = anchors(words, 1)
    for i, w in enumerate(words):
        own = code[index == i]
        assert len(set(own.tolist())) == len(own) in (1, 16)
        assert (np.bitwise_count(own ^ w) <= 2).all() and (np.bitwise_count(own ^ w) <= 1).sum() == 1
    for bits in ([3], [3, 40], [1, 2, 63], [0, 33, 34]):
        other = words[:1].copy()
        for b in bits:
            other ^= np.uint64(1 << b)
        meet = set(replicas(words[:1], 3)["key"].tolist()) & set(replicas(other, 3)["key"].tolist())
        assert meet


@pytest.mark.parametrize("tile", [20_000, 12])
def test_links_of_prints(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0}
    for p in list(prints)[:30]:  # chains and dense groups
        for _ in range(12):
            for _ in range(rng.randint(1, 3)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(a)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = near_links(spark.createDataFrame(signed, "print long"), 3, 2)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(links).collect()}
    want = _groups(prints, 3)
    for i, p in enumerate(prints):
        for j in range(i):
            assert (want[i] == want[j]) == (got.get(p, p) == got.get(prints[j], prints[j]))


def test_forest_reaches_what_steps_reach():
    rng = np.random.default_rng(1)
    members = np.unique(rng.integers(0, 1 << 8, 90).astype(np.uint64) * np.uint64(0x0101010101))
    links = forest(members, 5)
    root = {int(m): int(m) for m in members}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(b)] = find(a)
    want = _groups([int(m) for m in members], 5)
    assert len({find(int(m)) for m in members}) == len(set(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    base = [prose(i, 120) for i in range(20)]
    near = [b + " extra" for b in base[:10]] + [b.replace("the", "THE") for b in base[10:]]
    texts = [*ODD, *base, *near, *base[:3]]
    ids = list(range(500, 500 + len(texts)))
    got = rows(near_duplicates(documents(spark, texts, ids)), "doc_id", "fingerprint", "component_id")
    prints = [_print(t) for t in texts]
    roots = _groups(prints, 3)
    assert got == [(i, f"{p:016x}", ids[r]) for i, p, r in zip(ids, prints, roots, strict=True)]


def test_near_duplicates_null_repeated_and_no_rows(spark):
    df = documents(spark, ["a b c d", "a b c d", "a b c d"], [None, 4, 4])
    assert [r[1] for r in rows(near_duplicates(df), "doc_id", "component_id")] == [4, 4, 4]
    assert near_duplicates(df.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(2)

    def check(text, limit):
        places, same = suffix_array(np.frombuffer(text, np.uint8), limit)
        assert sorted(places.tolist()) == list(range(len(text)))
        order = sorted(range(len(text)), key=lambda i: text[i : i + limit])
        assert [text[i : i + limit] for i in places] == [text[i : i + limit] for i in order]
        for k in range(1, len(text)):
            a, b, n = int(places[k - 1]), int(places[k]), 0
            while n < limit and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert same[k] == n

    for _ in range(400):
        letters = rng.choice([b"a", b"ab", b"abc", b"abcdefghij"])
        check(bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))), rng.choice([3, 5, 10, 100]))
    base = bytes(rng.choice(b"abcd ") for _ in range(300))
    for _ in range(10):
        check(b"".join(base[rng.randint(0, 100) : rng.randint(150, 300)] + b"\xfe" for _ in range(5)), 40)


def _repeats(texts, width):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - width + 1):
            if count[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        yield len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(repeats, "LANE_BYTES", 8_000)
    passage = prose(99, 60)
    texts = [*ODD, "ab" * 400, "ab" * 300, "x" * 500, *[prose(i, 80) for i in range(12)], *[prose(i, 30) + passage[i:] + prose(i + 50, 20) for i in range(8)]]
    texts += [texts[-1], passage[:110], passage[3:104], prose(5, 80)[7:]]
    got = rows(remove_repeats(documents(spark, texts), 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(((i, *r) for i, r in enumerate(_repeats(texts, 100))), key=repr)


def test_repeats_sorts_stay_small(monkeypatch):
    sizes, sort = [], repeats.repeated_starts

    def counted(texts, starts, width):
        sizes.append(sum(map(len, texts)))
        return sort(texts, starts, width)

    monkeypatch.setattr(repeats, "repeated_starts", counted)
    rng = np.random.default_rng(3)
    texts, keys = [], []
    for key in range(2_500):  # two different stretches an anchor, of which every fifth pair shares a window
        a, b = rng.integers(97, 123, 450, np.uint8).tobytes(), rng.integers(97, 123, 450, np.uint8).tobytes()
        texts += [a, a[7:407] + b"#" * 50 if key % 5 == 0 else b]
        keys += [key, key]
    n = len(texts)
    entries = {"key": np.array(keys, np.uint64), "row": np.arange(n), "at": np.zeros(n, np.int32), "starts": np.full(n, 51, np.int32), "whole": np.arange(n, dtype=np.uint64)}
    found = set()
    for part in repeats._judge(entries, texts.__getitem__, 400):
        for row, at, run in zip(part["row"].tolist(), part["at"].tolist(), part["starts"].tolist(), strict=True):
            found |= {(row, at + i) for i in range(run)}
    assert found == {(row + k, 7 * (1 - k)) for row in range(0, n, 10) for k in (0, 1)}
    assert sum(sizes) > 2_000_000 and max(sizes) <= 500_000


def test_repeats_handed_on_in_small_parts(spark, monkeypatch):
    passage = prose(7, 60)
    texts = [*[prose(i, 30) + passage for i in range(20)], *[prose(0, 200) + prose(i, 20) for i in range(5)]]
    want = sorted(((i, *r) for i, r in enumerate(_repeats(texts, 100))), key=repr)
    for name, value in {"HOT": 4, "HELD_WINDOWS": 200, "HELD_BYTES": 2_000, "SORTED": 1_000, "SHARD_BYTES": 5_000}.items():
        monkeypatch.setattr(repeats, name, value)
    assert rows(remove_repeats(documents(spark, texts), 100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_repeats_null_ids_texts_and_no_rows(spark):
    df = documents(spark, ["é" * 90, "é" * 90, "short"], [None, None, 3])
    found = remove_repeats(df, 100, texts=True)
    assert rows(found, "doc_id", "n_removed", "kept") == sorted([(None, 180, ""), (None, 180, ""), (3, 0, "short")], key=repr)
    assert remove_repeats(df.limit(0), 100).count() == 0


def test_cover():
    for width in (5, 8, 20, 50):
        period, cover = cover_for(width)
        assert period < width
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert cover_for(50)[0] == 31 and len(cover_for(50)[1]) == 6


def _earlier(texts, ids, width):
    words = [(t or "").encode().split() for t in texts]
    order = [LAST if i is None else i for i in ids]
    least = {}
    for w, d in zip(words, order, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, LAST), d)
    for w, d in zip(words, order, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < d:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        yield len(w), sum(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("width", [50, 12])
def test_passages(spark, width):
    passage = prose(98, 90)
    texts = [*ODD, *[prose(i, 150) for i in range(8)], *[prose(i + 20, 3 * i) + " " + passage + " " + prose(i + 60, 11) for i in range(9)]]
    texts += [texts[-1], " ".join(passage.split()[5:60]), "one " * 200, "one " * 120, prose(3, 150).replace(" ", "\n")]
    ids = [1000 - i for i in range(len(texts))]
    ids[-3], ids[-1] = None, ids[-2]
    got = rows(remove_earlier_passages(documents(spark, texts, ids), width), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(((d, *r) for d, r in zip(ids, _earlier(texts, ids, width), strict=True)), key=repr)


def test_passages_no_rows(spark):
    assert remove_earlier_passages(documents(spark, ["a"]).limit(0)).count() == 0
