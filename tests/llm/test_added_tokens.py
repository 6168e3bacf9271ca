"""Texts that hold the literal of an added token, against the tokenizer as it is given."""

import zlib

import numpy as np
import pyarrow as pa

from citeloom.llm import tokens
from tests.llm.test_dedup import frame

LITERAL = [
    (1, "end <|endoftext|> x"), (2, "<|endoftext|>"), (3, "plain words"), (4, "a<|endoftext|>b\n\n <|endoftext|>"),
    (5, ""), (6, None), (7, "<|endoftext|> first"), (8, "x  <|endoftext|>  y"),
]


def test_added_tokens_have_their_own_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    plain = [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in LITERAL]
    assert plain[0] == [437, 220, 50256, 2124]
    encoder = tokens.Encoder(tokens.tokenizer_path())
    ids, sizes = encoder.column(pa.array([t or "" for _, t in LITERAL]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == plain
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.round_trip(frame(spark, LITERAL)).collect()}
    assert got == {
        k: (len(ids) + 1, zlib.crc32(np.array([*ids, tokens.END_ID], "<u4").tobytes()))
        for (k, _), ids in zip(LITERAL, plain, strict=True)
    }
