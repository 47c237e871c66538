import random

import pytest

from anchorline.llm import tokenizer

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    return tokenizer.Bpe(tokenizer.vocabulary_path())


@pytest.fixture(scope="module")
def reference():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


FIXED = ["", " ", "\n\n", "a", "Hello, world!", "it's we'll DON'T", "<|endoftext|>", "日本語のテキスト、そして。", "Привет  мир\t\t!", "x" * 5000, " " * 3000 + "a", "ab" * 3000, "​ 　", "👍🏽 ok", "1234567890" * 50, "\x00\x1c\x85", "ﬁ ｆｕｌｌ", "é"]


@pytest.mark.parametrize("text", FIXED)
def test_same_as_reference(bpe, reference, text):
    ids = bpe.encode(text)
    assert ids == reference(text) and bpe.decode(ids) == text


def test_random_texts(bpe, reference):
    r = random.Random(1)
    alphabets = ["abcde ", "etaoin shrdlu'.,", "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, range(0x400, 0x460))) + " ", "".join(map(chr, range(0x3040, 0x30FF))), " \t\n\r  "]
    for _ in range(1500):
        text = "".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(0, 60)))
        ids = bpe.encode(text)
        assert ids == reference(text) and bpe.decode(ids) == text


def test_frames(spark, reference):
    texts = [*FIXED, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumnRenamed("doc_id", "ids_of").repartition(3)
    got = {r.ids_of: r.ids for r in tokenizer.encode(df, "text", ["ids_of"]).collect()}
    assert all(got[i] == (reference(t) if t else []) for i, t in enumerate(texts))
    counts = {r.ids_of: r.tokens for r in tokenizer.encode(df, "text", ["ids_of"], count_only=True).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = tokenizer.decode(tokenizer.encode(df, "text", ["ids_of"]), "ids", ["ids_of"])
    assert {r.ids_of: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert tokenizer.encode(df.limit(0), "text", ["ids_of"]).count() == 0


def test_memory_of_pieces_is_bounded(monkeypatch, bpe, reference):
    monkeypatch.setattr(tokenizer, "REMEMBER", 10)
    text = " ".join(f"word{i}" for i in range(200))
    assert bpe.encode(text) == reference(text) and len(bpe.remembered) <= 10 or bpe.remembered


def test_another_vocabulary(spark):
    own = tokenizer.Bpe(P.path("byte_bpe_multi_50k.tiktoken"))
    assert own.decode(own.encode("Ärger мир 日本")) == "Ärger мир 日本"
