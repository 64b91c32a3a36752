"""New words merged side by side, against the tokenizers library."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer as Library

from sievekit.llm import bpe
from sievekit.llm.queries import tokenizer_path


def texts() -> list[str | None]:
    rng = random.Random(5)
    letters = "etaoinshrdluéßñçü日本 \n\t'.,0123456789"
    words = ["".join(rng.choices(letters[:17], k=rng.choice([1, 2, 7, 8, 9, 12, 13, 40, 64, 65, 72, 73, 127, 128, 129, 300]))) for _ in range(300)]
    made = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(120)] + ["".join(rng.choices(letters, k=200)) for _ in range(60)]
    return [*made, None, "", "a", " ", "aaaa" * 32, "aaaa" * 33, "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "\x00\x1f", *made[:20]]


def expected(rows: list[str | None]) -> list[bytes]:
    library = Library.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in rows]


@pytest.mark.parametrize(("kept", "together"), [(bpe.CACHE, bpe.TOGETHER), (50, 300), (0, 1)])
def test_ids_do_not_depend_on_the_word_table_or_the_groups(monkeypatch, kept, together):
    monkeypatch.setattr(bpe, "TOGETHER", together)
    t, rows = bpe.Tokenizer(tokenizer_path(), kept), texts()
    want = expected(rows)
    assert t.encode_all(rows) == want
    assert t.encode_all(rows) == want  # known words, or those of the older generation
    assert all(len(w) <= 64 for w in [*t.cache, *t.older])
    assert [t.encode(x) for x in rows[-40:]] == want[-40:]
    assert t.encode_all([]) == []
