"""Literals of added tokens in a text give the ids that the library gives for them by default."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import cases
from sharelode.llm import packing, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LITERALS = ["<|startoftext|>", "<|endoftext|>"]
TEXTS = [
    "hi <|endoftext|> there <|startoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|>", "<<|endoftext|>>",
    "<|ENDOFTEXT|> <|endoftext| >", "it<|endoftext|>'s", "日本<|startoftext|>語 é<|endoftext|>é x", "\n<|endoftext|>\n ",
    "e<|endoftext|>́a", "ΑΣ<|endoftext|> ΑΣ", "<|<|endoftext|>endoftext|>", "plain words", "", "\n", " \n x",
]
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_ids_are_the_library_s_by_default():
    rng = random.Random(4)
    pieces = [*LITERALS, " ", "\n", "a", "Word", "'s", "<|", "|>", "é", "́", "日本", "7"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(60)]
    assert len(library(TEXTS[0])) == 4
    bpe = word_bpe.load(PATH)
    for _ in range(2):  # the second time from memory
        assert [np.frombuffer(f, "<u2").tolist() for f in bpe.encode(texts)] == [library(t) for t in texts]


def test_ids_after_the_memory_was_cleared(monkeypatch):
    monkeypatch.setattr(word_bpe, "MEMO_PARTS", 0)
    bpe = word_bpe.WordBpe(PATH, encode_special_tokens=False)
    for text in TEXTS:
        assert np.frombuffer(bpe.encode([text])[0], "<u2").tolist() == library(text)


def test_added_tokens_of_another_kind_are_an_error(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["added_tokens"][0]["normalized"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    with pytest.raises(ValueError):
        word_bpe.load(str(path))


def test_pieces(spark):
    found = packing.packed(cases.frame(spark, list(enumerate(TEXTS))), PATH).collect()
    for doc_id, text in enumerate(TEXTS):
        ids = library(text) + [packing.END]
        own = sorted((p for p in found if p.doc_id == doc_id), key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
