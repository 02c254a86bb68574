"""Counts, codec and packing against the libraries on whole texts."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, documents, prose, rows

from kinelane.llm.packing import OpenBins, best_fit, plan
from kinelane.llm.piece_codec import codec, digests, encode_pieces
from kinelane.llm.queries import vocabulary
from kinelane.llm.token_counts import count_tokens, load_pieces, whole_words

MODEL = vocabulary("piece_bpe_32k.model")
TEXTS = [*ODD, *[prose(i, 40 * i) for i in range(12)], "long " * 60_000]


@pytest.fixture(scope="module")
def library():
    return load_pieces(MODEL)


def test_whole_words_are_proven(library):
    words = whole_words(library)
    assert len(words) > 10_000
    some = list(words)[::500]
    assert all(len(library.encode(w)) == 1 for w in some)


def test_counts(spark, library):
    got = rows(count_tokens(documents(spark, TEXTS), MODEL, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in enumerate(TEXTS)]
    assert got == sorted(want, key=repr)


def test_counts_of_null_ids_and_no_rows(spark):
    df = documents(spark, ["a b", "a b"], [None, None])
    assert rows(count_tokens(df, MODEL), "doc_id", "n_tokens") == [(None, 2), (None, 2)]
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_codec(spark, library):
    got = encode_pieces(documents(spark, TEXTS), MODEL, derive=digests, columns="n_tokens long, ids_sha256 string, decoded_sha256 string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_spans_point_at_the_original_bytes(spark):
    own = codec(MODEL)
    for text, e in zip([t or "" for t in TEXTS], own.encode([t or "" for t in TEXTS]), strict=True):
        raw = text.encode()
        assert list(e.begins[1:]) == list(e.ends[:-1]) if len(e.ids) else True
        assert b"".join(raw[a:b] for a, b in zip(e.begins.tolist(), e.ends.tolist(), strict=True)) == raw
        for i, a, b in list(zip(e.ids.tolist(), e.begins.tolist(), e.ends.tolist(), strict=True))[1:50]:
            if not own.model.is_byte(i):
                assert raw[a:b].decode().replace(" ", "▁") == own.model.id_to_piece(i)


def test_compiled_map_by_longest_prefix():
    """Against the library's own normaliser, whose compiled map comes with it."""
    import sentencepiece

    from kinelane.llm.char_map import Normaliser, normaliser_of

    try:
        theirs = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
        blob = theirs.serialized_model_proto()
    except (AttributeError, RuntimeError):
        pytest.skip("this build has no normaliser of its own")
    import tempfile

    with tempfile.NamedTemporaryFile(suffix=".model") as file:
        file.write(blob)
        file.flush()
        own = normaliser_of(file.name)
    assert isinstance(own, Normaliser)
    if not own.nodes:
        pytest.skip("no compiled map in the serialised normaliser")
    for text in ["ﬁne　ＡＢＣ①", "  two  spaces ", "Å é ㌀ x", "ｶﾞ plain"]:
        made, starts = own(text.encode())
        assert made.decode() == theirs.normalize(text)
        assert len(starts) == len(made) + 1 and starts[-1] == len(text.encode())
        assert (np.diff(starts) >= 0).all()


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    df = documents(spark, TEXTS)
    got = best_fit(df, vocabulary("byte_bpe_50k.json"), capacity=64, end_id=2).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length <= 64 and zlib.crc32(part.tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, whole in ids.items():
        found = sorted(by_doc[i])
        assert [p for p, _, _ in found] == list(range(len(found)))
        assert sum(n for _, _, n in found) == len(whole)
        assert all(n == 64 for _, _, n in found[1:]) and (len(found) == 1) == (len(whole) <= 64)
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by_sequence) == _plain([r.length for r in got], 64)


def _plain(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    import bisect

    rooms, made = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        if k == len(rooms):
            made += 1
            room = capacity
        else:
            room = rooms.pop(k)
        if room > n:
            bisect.insort(rooms, room - n)
    return made


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity = int(rng.integers(2, 40))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 200)))
        counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
        runs = plan(counts, capacity)
        fill = defaultdict(int)
        placed = defaultdict(int)
        for r in runs:
            assert r.rank == placed[r.length]
            placed[r.length] += r.bins * r.each
            for k in range(r.bins):
                assert fill[r.sequence + k] == r.offset
                fill[r.sequence + k] += r.each * r.length
        assert dict(placed) == counts and all(v <= capacity for v in fill.values())
        assert len(fill) == _plain(lengths.tolist(), capacity)
        assert sorted(fill) == list(range(len(fill)))


def test_tightest_open_bin():
    bins = OpenBins(10)
    assert bins.tightest(1) is None
    bins.put(4, 0, 1)
    bins.put(9, 1, 1)
    assert [bins.tightest(n) for n in (1, 4, 5, 9, 10)] == [4, 4, 9, 9, None]


def test_packing_no_rows(spark):
    assert best_fit(documents(spark, ["a"]).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
