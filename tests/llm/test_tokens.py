import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from clickfeat.llm.tokens import token_ids, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def same(texts):
    want = [x.ids for x in tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in token_ids(pa.array(texts, pa.string()), PATH)] == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("'stmdrevl aZ\n\t 09., \u0085é\x1c 中", max_size=30)), max_size=8))
def test_ids_equal_the_library(texts):
    same(texts)


def test_cases():
    same(["they're 'they ''s I'll  'll\n\n", None, "", " ", "  a", "a  ", "'re", " 're", "'", "x'", "'v", "don't'd",
          "<|endoftext|>", "\r\n a\t\tb 　c", "12 345a6 é'être", "'ſ", "a͸b", "中文 mixed", "x" * 3000, "l'"])
    same([])
