"""Token encoding."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import encode as E

PATH = E.rank_path()


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip_and_second_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = E.encode_text(text, PATH)
    assert E.decode_ids(ids, PATH) == text
    assert ids == library().encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 1!\n\t'sé日本。　x-"), max_size=200), st.integers(1, 40))
def test_pieces_change_no_ids(text, size):
    parts = list(E.pieces(text, size))
    assert "".join(parts) == text
    whole = E.load_encoding(PATH).encode_ordinary(text)
    assert [i for p in parts for i in E.load_encoding(PATH).encode_ordinary(p)] == whole


def test_operator(spark):
    texts = [(1, "hello world", "a"), (2, "", "b"), (3, None, "c"), (4, "  \n ", "d"), (5, "<|endoftext|>", "e"), (6, "語" * 50_000 + " word 12" * 9_000, "f"), (6, "x", "g"), (6, "x", "g")]
    df = spark.createDataFrame(texts, "doc_id BIGINT, text STRING, ids STRING")
    rows = E.encode_texts(df, "doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in rows}
    assert len(rows) == 8 and got[2] == [] and got[3] == [] and len(got[4]) > 0 and 50256 not in got[5]
    long = next(r.ids for r in rows if r.doc_id == 6 and len(r.ids) > 10)
    assert long == E.load_encoding(PATH).encode_ordinary(texts[5][1])
    back = {r.doc_id: r.text for r in E.decode_all(E.encode_texts(df.where("doc_id < 6"), "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {1: "hello world", 2: "", 3: "", 4: "  \n ", 5: "<|endoftext|>"}
    assert E.encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_cut_lists_decode():
    ids = E.encode_text("日", PATH)
    assert "�" in E.decode_ids(ids[:1], PATH) and E.decode_ids(None, PATH) == ""


def test_missing_rank_file():
    with pytest.raises(FileNotFoundError):
        E.load_encoding("/nowhere/ranks.tiktoken")
