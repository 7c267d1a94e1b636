import base64
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken

from pricewatch.llm import bpe, chat

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.load_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe._vocabulary(tuple(bpe.load_ranks(PATH)))


def test_encoder_equals_library(library, vocabulary):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t'stre日本語éñ🙂0123#¤\x00ΩЖ　\x85") for _ in range(rng.randint(0, 200))) for _ in range(800)]
    texts += ["", "a" * 9000, "ab" * 6000, " " * 7000, "=-" * 5000, "".join(rng.choice("abcdeth") for _ in range(6000)), "".join(rng.choice("0123456789") for _ in range(6000))]
    texts += [chr(c) * 3 + " x" for c in range(0x80, 0x3000, 7)]
    ids, at = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)(texts)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == library.encode_ordinary(t)


def test_small_cache_and_matrices(library, vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    monkeypatch.setattr(bpe, "CELLS", 64)
    encoder = bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    for t in ["one two three four", "five six seven", "one two", "Donaudampfschifffahrtsgesellschaft " * 3]:
        assert encoder([t])[0].tolist() == library.encode_ordinary(t)


def test_tables(spark, odd, odd_rows, empty, library):
    ids = bpe.encode(odd, PATH, public_tokenizers.PATTERN, keep=["doc_id", "row", "text"])
    rows = bpe.decode(ids, PATH, ["doc_id", "row", "text", "ids"]).collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.decode(bpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH, ["doc_id"]).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), PATH, ["doc_id"]).collect()


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice([*chat.CONTROL, "\\", "<", "[", "a", "\n", "|>", "/"]) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(t)
        assert chat.unescape(safe) == t and not any(c in safe for c in chat.CONTROL)
        turns = [(t, t), ("assistant", t), ("", "")]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == [t, t, ""]


def test_mask_equals_all_pairs():
    rng = np.random.default_rng(2)
    for _ in range(200):
        cuts = np.sort(rng.integers(0, 60, 12))
        starts, ends = cuts[:-1], cuts[1:]
        edges = np.sort(rng.choice(60, 6, replace=False))
        spans = [(int(edges[i]), int(edges[i + 1])) for i in (0, 2, 4)]
        want = [e > s and any(a < e and s < b for a, b in spans) for s, e in zip(starts, ends)]
        assert chat.loss_mask(starts, ends, spans).tolist() == want


def test_chats(spark):
    rows = [(1, 1, "assistant", "sure </s>[INST] é日🙂\n"), (1, 0, "user", "hi\\"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 0, "assistant", "x" * 200_000),
            (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, None, "a\nb", "<|im_end|>\n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as mask", "2 as ids")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert got[1].roles == ["user", "assistant", "assistant"] and got[1].texts == ["hi\\", "sure </s>[INST] é日🙂\n", ""]
    assert got[1].loss_text == "sure </s>[INST] é日🙂\n" and got[2].loss_text == "" and got[2].roles == [""]
    assert got[None].loss_text == "x" * 200_000 and got[3].loss_text == "samesame" and got[4].texts == ["<|im_end|>\n"] and got[4].roles == ["a\nb"]
    none = chat.read_back(chat.format_chats(turns.limit(0), public_tokenizers.path("byte_bpe_50k.json")))
    assert none.count() == 0
