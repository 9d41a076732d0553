import numpy as np
import pytest

from ledger_analytics.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "plain words", "<|endoftext|>", "x<|endoftext|><|endoftext|>y é日", "<|endoftext", ""]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, n = tokens.Encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), off)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 220, 50256, 275]
