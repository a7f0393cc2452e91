"""Words and marks that the token writer puts together, against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siftwell.llm import wavelet


def test_marked_words_are_put_together():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = wavelet.ChunkTokenizer(path), Tokenizer.from_file(path)
    asked = []
    own._alone = lambda texts, alone=own._alone: asked.extend(texts) or alone(texts)
    r = random.Random(1)
    letters = "abAB éÉßÿ×÷Àİıµªºñ.,,.!#'<|>()[]\\`_-^~ 12\t\n ́中"
    texts = ["((Qwértyx###", "don't 'tis! <|x|>"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    assert own.encode_batch(texts[:1]) == [np.array(library.encode(texts[0], add_special_tokens=False).ids, own.kind).tobytes()]
    assert sorted(asked) == ["###", "(("] and "qwértyx" in own.memo  # the library never sees the chunk as a whole
    want = [np.array(e.ids, own.kind).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode_batch(texts) == want
