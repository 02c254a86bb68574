"""Alignment of two tokenisers against their libraries on whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from helpers import ODD, documents, prose, rows
from tokenizers import Tokenizer

from kinelane.llm import alignment
from kinelane.llm.alignment import align_tokenisers

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _ends(parts):
    at, out = 0, []
    for p in parts:
        at += len(p)
        out.append(at)
    return out


def _aligned(text, a, b):
    """Groups as (A ids, B ids), by whole texts."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    if not text:
        return []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_parts = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in a_ids]
    b_parts = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_parts) != (" " + text).encode() or b"".join(b_parts) != (" " + text).encode():
        return []
    a_ends, b_ends, low, out = _ends(a_parts), _ends(b_parts), 0, []
    for cut in sorted(set(a_ends) & set(b_ends)):
        out.append(tuple([i for i, e in zip(ids, ends, strict=True) if low < e <= cut] for ids, ends in ((a_ids, a_ends), (b_ids, b_ends))))
        low = cut
    return out


def _expected(ids, texts):
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    found = [_aligned(t, a, b) for t in texts]
    links = [Counter((x, y) for g in f for x in g[0] for y in g[1]) for f in found]
    count = Counter(pair for own in links for pair in own)
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    for doc, groups, own in zip(ids, found, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(written.encode()).hexdigest() if groups else "",
        )


def _texts():
    own = random.Random(1)
    mixed = ["".join(own.choice("ab \n.'é漢😀▁s1 <") for _ in range(60)) for _ in range(60)]
    texts = [*ODD, *[prose(i, 60) for i in range(20)], *mixed, "x" * 500 + "é漢" * 50, "<|endoftext|>", "a <s>b</s> <unk>"]
    return texts + texts[:30] + [prose(3, 60)] * 12


@pytest.mark.parametrize("frequent, listed, remembered", [(1_000_000, 4096, 64), (40, 1, 5), (0, 4096, 64)])
def test_alignment(spark, monkeypatch, frequent, listed, remembered):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "LISTED", listed)
    monkeypatch.setattr(alignment, "REMEMBERED", remembered)
    texts = _texts()
    ids = list(range(70, 70 + len(texts)))
    assert rows(align_tokenisers(documents(spark, texts, ids), BYTES, PIECES), *COLUMNS) == sorted(_expected(ids, texts), key=repr)


def test_null_ids_repeated_rows_and_no_rows(spark):
    texts, ids = ["a b", "a b", None, "c"], [None, 4, None, 4]
    assert rows(align_tokenisers(documents(spark, texts, ids), BYTES, PIECES), *COLUMNS) == sorted(_expected(ids, texts), key=repr)
    assert align_tokenisers(documents(spark, texts, ids).limit(0), BYTES, PIECES).count() == 0
    assert rows(align_tokenisers(documents(spark, [None, ""], [1, 2]), BYTES, PIECES), "doc_id", "n_a") == [(1, 0), (2, 0)]
