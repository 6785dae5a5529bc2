import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm.tokens import encoder

LATIN = st.text(st.characters(max_codepoint=0x24F, blacklist_categories=("Cs",)), max_size=200)
ANY = st.text(st.characters(blacklist_categories=("Cs",)), max_size=60)


def slow(text):
    return encoder().slow.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(LATIN, ANY))
def test_same_ids(text):
    assert encoder().encode(text).tolist() == slow(text)


def test_special_tokens_and_documents(sf):
    text = "a <|endoftext|> b"
    assert 50256 in encoder().encode(text).tolist() == slow(text)
    assert 50256 not in encoder().plain(text).tolist()
    for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist():
        assert encoder().encode(t or "").tolist() == slow(t or "")
