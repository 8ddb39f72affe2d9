"""Token ids of texts beyond Latin letters come from the speculative encoder."""

import random

import pyarrow as pa

from tillroll.llm import spec_bpe
from tillroll.llm.common import tokenizer_json

SCRIPTS = ["абвгдежзиклмнопрстуЯЁЙ", "αβγδεζηθικλμνξοπρσςΣΩάϊ", "日本語中文字漢字かなカナ。、", "אבגדהוזח", "ابتثجحخ٣٤",
           "हिन्दीकाम", "ก็ไทย", "한국어가나다", "“”‘’—–…•", "😀👍🏽🇫🇷‍", "éä̧ͅﬁẞİſÅ", "　  \x00\x01\u0085",
           "abc'll 've 12½²"]


def test_other_scripts_need_no_library_merging():
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer_json())
    rng = random.Random(12)
    texts = []
    for _ in range(4000):
        letters = "".join(rng.sample(SCRIPTS, rng.choice([1, 1, 2]))) + rng.choice(["", " ", "-'"])
        texts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
    texts += ["<|endoftext|>", "я<|startoftext|>日本<|endoftext|><|endoftext|>x", "<|ENDOFTEXT|>я", "<|endoftext", "語" * 700, ""]
    coder = spec_bpe.SpeculativeCoder(tokenizer_json())
    coder.tokenizer = None  # nothing may be encoded by the library
    for _ in range(2):  # the second time from the cache
        flat, offs = coder.encode(pa.array(texts))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == want
    assert coder.words.proposed > 4000
