"""Special strings in texts, whole and in other letter case, give what the library gives."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm.tokens import Encoder

TEXTS = ["<|ENDOFTEXT|>", "a <|endoftext|> b", "x<|EndOfText|>.", "<|endoftext|>!", "foo<|startoftext|> bar", "Foo.Bar, BAZ!!! it's", "a<|endoftext|", "<|EndOfText|> <|endoftext|>"]


@pytest.mark.parametrize("name,spaces_lead", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_special_strings(name, spaces_lead):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [np.frombuffer(x, "<u4").tolist() for x in Encoder(path, spaces_lead).ids(TEXTS)] == want
