import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strayline.llm import bpe_dp

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe_dp.Bpe(open(PATH).read())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(st.sampled_from(" \n\t\r'sdtm.,!é漢😀0٣²\x1c\x85　ab"), max_size=30)))
def test_ids_are_the_library_s(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", "<|endoftext|><|endoftext|>", "  \n  x", "a\t \nb", " ", "", "aaaa" * 50, "\U0001dfff՘a1"])
def test_odd_texts(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_letters_of_all_planes():
    for c in [*range(0x3000), *range(0x3000, 0x110000, 97)]:
        if not 0xD800 <= c <= 0xDFFF:
            text = f"a{chr(c)}a {chr(c)}1"
            assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids, hex(c)


def test_tokens_encode_as_themselves():
    for i in range(0, 50_000, 211):
        assert OWN.piece(OWN.token[i]) == [i]


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe_dp, "CACHE", 3)
    own = bpe_dp.Bpe(open(PATH).read())
    text = "the cat sat on the mat and the dog sat on the cat " * 3
    assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_tables(edges, nothing, documents):
    for docs in (edges, documents):
        found = bpe_dp.digests(docs, PATH).toPandas()
        rows = docs.select("text").toPandas()["text"].fillna("")
        expected = []
        for t in rows:
            ids = LIBRARY.encode(t, add_special_tokens=False).ids
            back = LIBRARY.decode(ids, skip_special_tokens=False)
            expected.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(zip(found["n_tokens"], found["ids_sha256"], found["decoded_sha256"])) == sorted(expected)
    assert bpe_dp.digests(nothing, PATH).count() == 0


def test_encode_then_decode_is_the_text(documents):
    ids = bpe_dp.encode(documents, PATH)
    back = {r.doc_id: r.text for r in bpe_dp.decode(ids, PATH).collect()}
    assert back == {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
