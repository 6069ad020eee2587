import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import tokens

PATH = tokens.default_tokenizer()
WHOLE = Tokenizer.from_file(PATH)


def ids(texts):
    enc = tokens.encoder(PATH)
    return [np.frombuffer(b, enc.kind).tolist() for b in enc.encode(texts)]


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def test_separable_and_corpus():
    assert tokens.encoder(PATH).separable
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    assert ids(texts) == [whole(t) for t in texts]


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "a\x1cb", "a\u0085b c", "It's THEY'LL 'sx", "x<|endoftext|>y <|startoftext|>", "éa ́b", "İSTANBUL ΣΑΣ ς", "1234 a1b2", "wow!!! end.) (x", "ªº µ ß ÿ Ā", "日本語 text", "\x00 \x0b\x0c\t\r\n.", "a" * 5000, '"quoted." *b* #c $d'])
def test_special_cases(text):
    assert ids([text]) == [whole(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.,!'sabÉé1<|>")), max_size=60))
def test_any_text(text):
    assert ids([text]) == [whole(text)]


def test_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    enc = tokens.Encoder(PATH)
    for text in ("one two three four five.", "Five one, six seven", "two two eight"):
        assert np.frombuffer(enc.encode([text])[0], enc.kind).tolist() == whole(text)
