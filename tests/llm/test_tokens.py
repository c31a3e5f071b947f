import hashlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import documents, empty, odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vakanz.llm import bpe, tokens, vocab

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "", "Hello, wörld's don't 123\n\tfoo <|endoftext|> Bar<|startoftext|>x ΑΣ İ ß é 你好 😀", "a" * 3000, "aab" * 999, "<|endoftext|>" * 3,
    "\x1c\x85  à \U0001f9d1‍ x͸y 𤋮", "' 's'T''LL ½²٣",
]


COUNTER = tokens.Counter(PATH, tokens.whole_words(PATH))


def agree(text):
    encoded = LIBRARY.encode(text, add_special_tokens=False)
    own = bpe.encoder(PATH)
    ids = own.encode(text, bpe.array("i"))
    assert list(ids) == encoded.ids
    assert COUNTER.count(text) == len(encoded.ids)
    assert bpe.decoder(PATH).decode(np.array(ids, np.int32)) == LIBRARY.decode(encoded.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_texts_agree_with_the_library(text):
    agree(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("abest'lr é19-<|>", max_size=60))
def test_any_text_agrees_with_the_library(text):
    agree(text)


def test_word_classes_agree_with_the_library_for_code_points():
    vocabulary = vocab.read(PATH)
    for point in [*range(0x500), *range(0x2000, 0x2100), *range(0xFA60, 0xFAE0), *range(0x500, 0x110000, 97)]:
        if not 0xD800 <= point < 0xE000:
            text = f"a{chr(point)}!"
            parts = LIBRARY.pre_tokenizer.pre_tokenize_str(LIBRARY.normalizer.normalize_str(text))
            own = ["".join(vocab.BYTE_CHARACTERS[b] for b in w.encode()) for w in vocabulary.words(text)]
            assert own == [w for w, _ in parts], hex(point)


def test_both_ways_to_merge_agree():
    vocabulary = vocab.read(PATH)
    for word in ("internationalisation", "zzzzzzzzzz", "thethethethe" * 20):
        assert vocabulary._scanned(vocab.symbols(word)) == vocabulary._heaped(vocab.symbols(word))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(vocab, "REMEMBER_WORDS", 5)
    memory = vocab.Memory(len, {"known": 5})
    for i in range(100):
        assert memory[f"w{i}"] == len(f"w{i}")
        assert memory["w0"] == 2
        assert len(memory) <= 6 and len(memory.old) <= 6
    assert memory["known"] == 5


def test_tables(spark):
    docs = documents(spark, odd_rows() + [(20 + i, t) for i, t in enumerate(TEXTS)])
    rows = docs.select("doc_id", "text").collect()
    expected = sorted(
        (r.doc_id or -1, len((r.text or "").encode()), len(ids), len(ids) > 2048)
        for r in rows for ids in [LIBRARY.encode(r.text or "", add_special_tokens=False).ids]
    )
    found = tokens.token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = sorted(
        (r.doc_id or -1, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))
        for r in rows for ids in [LIBRARY.encode(r.text or "", add_special_tokens=False).ids]
    )
    found = bpe.encoded_digests(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == expected
    assert tokens.token_counts(empty(docs), PATH).count() == 0
    assert bpe.encoded_digests(empty(docs), PATH).count() == 0


def test_null_ids_decode_to_an_empty_text(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in bpe.with_decoded(rows, PATH).collect()] == ["", ""]
