import random

import pytest
import sentencepiece
from lodestone.llm import sentencepiece_codec as sc


@pytest.fixture(scope="module")
def both():
    model = sc.default_model()
    return sc.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)


ODD = [" ", "  ", "▁", " ▁ ", "a" * 400, " " * 90, "\n\n\t", "x  y   z    ", "\U0001f600é中", "<s> </s> <unk> <0x41>", "é", "\x00a\x00", "﻿", "⁇", "A.B.C...", " 一" * 50, "퟿￿"]


def samples():
    rng = random.Random(5)
    yield from ODD
    words = "the of and enst ation eaué über  ## $$$ http://x.y 1234 {} 中文 \U0001f601 ▁ \n \t".split(" ")
    for _ in range(400):
        yield "".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(40)))
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x2FFF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(30)))
    for _ in range(300):
        yield "".join(rng.choice("ainterso  ") for _ in range(rng.randrange(60)))


def test_encode_and_decode_as_the_library(both):
    codec, lib = both
    for text in samples():
        want = lib.encode(text, add_eos=True)
        assert codec.encode(text) == want, repr(text)
        assert codec.decode(want) == lib.decode(want), repr(text)


def test_decode_broken_bytes(both):
    codec, lib = both
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(3, 400) for _ in range(rng.randrange(12))]
        assert codec.decode(ids) == lib.decode(ids), ids


def test_rows(spark, both):
    _, lib = both
    texts = [*samples(), None, "", "dup", "dup"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r for r in sc.codec_table(docs, sc.default_model()).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids"], got[i]["decoded"]) == (len(ids), " ".join(map(str, ids)), lib.decode(ids)), repr(t)
    assert sc.codec_table(docs.limit(0), sc.default_model()).count() == 0


def test_counts_with_small_memories(both, monkeypatch):
    """The number of ids is the library's whatever is forgotten, and a part that is in every text is not forgotten."""
    codec, lib = both
    monkeypatch.setattr(sc, "MEMO", 40)
    monkeypatch.setattr(sc, "PAIRS", 60)
    own = sc.Encoder(codec)
    for text in samples():
        assert own.count(text) == len(lib.encode(text)) + 1, repr(text)
    asked = []
    for name in ("part", "size"):
        monkeypatch.setattr(codec, name, lambda part, f=getattr(codec, name): asked.append(part) or f(part))
    own = sc.Encoder(codec)
    for k in range(300):
        assert own.count(f"the w{k}") == len(lib.encode(f"the w{k}")) + 1
    assert asked.count("\u2581the") == 1 and len(asked) >= 300
