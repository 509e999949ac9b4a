"""New words go to the tokenizers library in runs."""

import random

import numpy as np
import public_tokenizers

from tests.llm.test_operators import library, library_ids
from warraq.llm import token_planes


def test_new_words_are_seen_in_runs(monkeypatch):
    tokenizer, draw = library(), random.Random(5)
    pieces = ["a", "Wort", "éà", "don't", "x.", "12", "$$", "\n", "\n\n", " ", " ", " ", "  ", "\t", "᠎", "\x01", "\x01q", "\x00", "\x1c", "\U0001f600", "Ġb", "Ċ", "<|endoftext|>", "z" * 70]
    texts = ["", "\n", "a\n", "\na b", "a\nb\nc d", *("".join(draw.choices(pieces, k=draw.randrange(40))) for _ in range(2_000)), *(" ".join(draw.choices(["ab", "c.", "d\nE", "f\n"], k=30)) for _ in range(200))]
    expected = [np.array(library_ids(tokenizer, x), "<u4").tobytes() for x in texts]
    for run in (1, 3, 256):
        monkeypatch.setattr(token_planes, "RUN", run)
        assert token_planes.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), f"runs{run}").encode(texts) == expected
    words = {f"w{k}x" for k in range(5_000)} | {f"\x01n{k}" for k in range(500)}
    sizes = []

    class Seen:
        def encode_batch_fast(self, batch, add_special_tokens):
            sizes.append(len(batch))
            return tokenizer.encode_batch_fast(batch, add_special_tokens=add_special_tokens)

    encoder = token_planes.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "sizes")
    encoder.tokenizer = Seen()
    encoder.encode([" ".join(sorted(words - {x for x in words if x[0] == "\x01"})) + "".join("\n" + x[1:] for x in sorted(words) if x[0] == "\x01")])
    assert sum(sizes) <= 5_500 // 256 + 3


def test_words_of_the_last_texts_stay_known(monkeypatch):
    monkeypatch.setattr(token_planes, "CACHE_BYTES", 10_000)
    tokenizer, asked = library(), []

    class Seen:
        def encode_batch_fast(self, batch, add_special_tokens):
            asked.extend(batch)
            return tokenizer.encode_batch_fast(batch, add_special_tokens=add_special_tokens)

    encoder = token_planes.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), "last")
    encoder.tokenizer = Seen()
    for sign in "abc":
        text = " ".join(f"{sign}{k}" for k in range(200))
        expected, seen = np.array(library_ids(tokenizer, text), "<u4").tobytes(), []
        for _ in range(2):
            asked.clear()
            assert encoder.encode([text, "", text]) == [expected, b"", expected]
            seen.append(len(asked))
        assert seen == [2, 0] and encoder.known.size <= 10_000
