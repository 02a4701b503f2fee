import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import cases
from sharelode.llm import packing, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = cases.documents(9) + [(i, f"some words of document {i} " * (i % 40)) for i in range(3000, 3100)]


def ids_of(text):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return library.encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, rows):
    """Every id once, sequences without gaps, full but for lengths that are powers of two."""
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(doc_id, []).append(ids_of(text))
    total = sum(len(i) for ids in by_text.values() for i in ids)
    assert sum(p.length for p in pieces) == total
    for sequence, own in itertools.groupby(sorted(pieces, key=lambda p: (p.sequence_id, p.offset)), lambda p: p.sequence_id):
        at = 0
        for p in own:
            assert p.offset == at and p.length > 0
            at += p.length
            assert any(len(ids) == p.doc_tokens
                       and zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                       for ids in by_text[p.doc_id])
        assert at <= packing.LENGTH and at & (at - 1) == 0
    starts = {}
    for p in pieces:
        starts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
    for (doc_id, n), own in starts.items():
        times = sum(len(ids) == n for ids in by_text[doc_id])
        assert sum(length for _, length in own) == n * times


def test_pieces(spark):
    check(packing.packed(cases.frame(spark, ROWS), PATH).collect(), ROWS)


def test_empty_table(spark):
    assert packing.packed(cases.frame(spark, []), PATH).count() == 0


def test_ids_are_the_library_s():
    texts = ["It's we'll !!'s don't 12345 á É́ Σας ÀÉÖ×÷ª ﬁ  x y \x1cq <|endoftext|> 日本語 😀 ǅ İ",
             "", " \n", "x" * 300, "a-b_c@d.e ##%% ''''s 'S 'LL", "\x00\x01 \x7f ​"] + [t or "" for _, t in ROWS]
    found = word_bpe.WordBpe(PATH).encode(texts)
    assert [np.frombuffer(f, "<u2").tolist() + [1] for f in found] == [ids_of(t) for t in texts]


def test_neighbours_on_the_curve_are_neighbours():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert_keys(points, bits)
        assert sorted(keys.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
