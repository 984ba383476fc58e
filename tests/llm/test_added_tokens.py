"""An added token's string within a text is that token, as the tokenizers library has it by its own settings."""

import zlib

import numpy as np
import pytest
from helpers import documents

from quern.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def test_added_tokens_of_documents(spark):
    library = tokenizers.Tokenizer.from_file(packing.byte_bpe())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>\n a", "<|endoftext |> it's", "plain"]
    rows = {r["doc_id"]: r for r in packing.pack(documents(spark, texts), packing.byte_bpe(), with_ids=True).collect() if r["start"] == 0 and r["length"] == r["doc_tokens"]}
    assert rows[0]["ids"] == [31373, 220, 50256, 995, 0]
    for i, text in enumerate(texts):
        want = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert rows[i]["ids"] == want and rows[i]["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
