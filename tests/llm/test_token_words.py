"""Words of letters go to the tokenizer's model alone, with the ids of the whole texts."""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumenfold.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Watched:
    """A tokenizer that notes what it is asked to encode."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.asked = tokenizer, []

    def encode(self, text, **options):
        self.asked.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_of_letters_skip_the_rest_of_the_tokenizer():
    texts = ["Straße naïve ĳsselmeer Ǆungla ǆ À ÿ ɏ", "a bc, 12th don't x_y ŉ µm ªº × ÷ ɐ Жук 漢字 été", "", "one\ntwo three.", "<|endoftext|> word<|endoftext|>word"]
    texts += ["".join(map(chr, np.random.default_rng(k).integers(0xA1, 0x250, 12))) + " zhqwx" * k for k in range(200)]
    encoder = tokens.Encoder(PATH)
    encoder.tokenizer = Watched(plain := encoder.tokenizer)
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)]
    assert got == [[*plain.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]
    asked = "\n".join(encoder.tokenizer.asked)
    assert "Straße" not in asked and "zhqwx" not in asked and "12th" in asked


def test_other_tokenizers_see_every_word(tmp_path):
    state = json.loads(Tokenizer.from_file(PATH).to_str())
    lower = tmp_path / "lower.json"
    lower.write_text(json.dumps(state | {"normalizer": {"type": "Lowercase"}}))
    named = tmp_path / "named.json"
    named.write_text(json.dumps(state | {"added_tokens": [*state["added_tokens"], state["added_tokens"][0] | {"id": 50257, "content": "special"}]}))
    for path in map(str, (lower, named)):
        encoder, plain = tokens.Encoder(path), Tokenizer.from_file(path)
        assert encoder.model is None
        for text in ("Upper Case", "a specialist word"):
            assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, tokens.END_ID]
