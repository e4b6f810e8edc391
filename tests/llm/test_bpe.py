import hashlib
import json

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm.bpe import Encoder, encode, encode_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "  \n", "Hello  World's “don't” 123 été <|endoftext|> naïve ABCdef\nfoo_bar!!", "<|endoftext|><|startoftext|>x", "aaaa aaaaaaa hahaha", "a\x1cb\x1f c\x85d\xa0e", "ΟΔΟΣ İ J̌ é", "x" * 3000, "'s 'll''re'VE !'s <|end"]


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return Encoder(PATH), t


def same(both, texts):
    e, t = both
    for text, (ids, decoded) in zip(texts, e.encode_batch(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), repr(text)
        assert decoded == t.decode(want, skip_special_tokens=False), repr(text)


def test_texts(both):
    same(both, [x or "" for x in TEXTS])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), st.text(alphabet="abthe 's\n12", max_size=60)), max_size=5))
def test_any_text(both, texts):
    same(both, texts)


def test_every_character(both):
    e, t = both
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = []
    for a in range(0, len(every), 20000):
        part = [f"a{c}b" for c in every[a : a + 20000]]
        want = t.encode_batch(part, add_special_tokens=False)
        odd += [p[1:-1] for p, (ids, _), w in zip(part, e.encode_batch(part), want, strict=True) if ids != " ".join(map(str, w.ids))]
    assert not odd, [hex(ord(c)) for c in odd][:20]


#: Specials as they stand and in other cases, next to letters, marks, blanks and combining marks.
NEAR_SPECIALS = st.lists(st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|endoftext", "|>", "<|", "a", "É", "İ", "_İ?", "\u0301", "?", " ", "\n", "1", "字", "\U00010d50", "\U00011935\U00011930", "😀!"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(NEAR_SPECIALS, max_size=4))
def test_specials(both, texts):
    same(both, texts)


def test_other_settings_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"][0]["type"] = "NFKC"
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        Encoder(str(other))


def test_real_documents(both):
    same(both, [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()])


def test_frames(spark, both):
    _, t = both
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(TEXTS)] + [(None, "a b", "c")] * 2, "doc_id long, text string, ids string")
    got = encode_digests(docs, PATH).collect()
    whole = {r.doc_id: r for r in encode(docs, PATH).collect()}
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = TEXTS[r.doc_id] or "" if r.doc_id is not None else "a b"
        want = t.encode(text, add_special_tokens=False).ids
        assert whole[r.doc_id].ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(whole[r.doc_id].decoded.encode()).hexdigest()
    assert encode_digests(docs.limit(0), PATH).count() == 0
