import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafold.llm import encode

PATH = f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken"
ENC = encode.encoder(PATH)
SAMPLES = ["", " ", "a", "Hello  world \n\n next", "it's they're 'll 'd  x", "  \t\n ", "漢字かな交じり文。" * 5, "😀👩‍👩‍👧 é ​", "<|endoftext|> x", "12345 6789.0", "\x00\x1c\x1d a\x1c b", "a" * 300]


@pytest.mark.parametrize("leaf", [2, 3, 5, 17, 64])
def test_tree_equals_whole(leaf):
    r = random.Random(leaf)
    words = ["the", " tower", "'s", "\n", "  ", "Ünï", "漢", "12", "!?", "\x1c", " \t", "aaaa", "don't"]
    for text in [*SAMPLES, *("".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(40))]:
        assert ENC.encode(text, leaf).tolist() == ENC.core.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80), st.integers(2, 9))
def test_any_text_round_trips(text, leaf):
    ids = ENC.encode(text, leaf)
    assert ids.tolist() == ENC.core.encode_ordinary(text) and ENC.decode(ids) == text


def test_against_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in encode.encode_column(spark.createDataFrame(rows), leaf=40).collect()}
    want = t.encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    assert len(got) == len(rows) and all(got[r.doc_id] == w.ids for r, w in zip(rows, want, strict=True))


def test_column(spark):
    df = spark.createDataFrame([(1, None, [5]), (2, "", None), (3, "hi there " * 20000, [1]), (3, "x", None), (None, "y", None)], "doc_id long, text string, ids array<int>")
    rows = encode.encode_column(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[1] == [[]] and by[2] == [[]] and sorted(map(len, by[3])) == [1, 40001] and by[None] == [ENC.core.encode_ordinary("y")]
    assert encode.encode_column(df.limit(0)).collect() == []
    assert {r.n_tokens for r in encode.token_counts(df, ["doc_id"]).collect()} == {0, 1, 40001}


def test_long_texts_are_encoded_by_many_tasks(spark):
    r = random.Random(8)
    texts = [
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "a" * 2500, "漢字かな交じり文" * 120, " " * 700 + "x", "word and word, " * 90, "'" * 300 + "s" * 300,
        "".join(r.choice(["ab", "'s ", "12", "漢", "  ", "\n"]) for _ in range(900)), "ACGT" * 400, "short", "", None,
    ]
    df = spark.createDataFrame([(i % 9, t, i) for i, t in enumerate(texts)], "doc_id long, text string, uid long")
    got = sorted((x.doc_id, x.ids) for x in encode.encode_column(df, spread=120, far_leaf=64).collect())
    assert got == sorted((i % 9, ENC.core.encode_ordinary(t or "")) for i, t in enumerate(texts))
    back = encode.decode_column(encode.encode_column(df.where("uid >= 0 AND text IS NOT NULL"), spread=120, far_leaf=64)).collect()
    assert sorted((x.doc_id, x.text) for x in back) == sorted((i % 9, t) for i, t in enumerate(texts) if t is not None)


def test_a_window_grows_until_tokens_stay():
    r = random.Random(2)
    for alphabet in ("a", "ab", "the", "漢字"):
        text = "".join(r.choice(alphabet) for _ in range(4000))
        pieces = [ENC.piece(text[i : i + 500], i > 0, i < 3500) for i in range(0, 4000, 500)]
        while len(pieces) > 1:
            pieces = [ENC.join(a, b, True) for a, b in zip(pieces[::2], pieces[1::2], strict=True)]
        assert pieces[0].ids.tolist() == ENC.core.encode_ordinary(text) and pieces[0].single
