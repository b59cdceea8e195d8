import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatloom.llm import sentencepiece_codec, simple8b, token_counts, token_files
from chatloom.llm.pieces import Memo
from tests.llm.conftest import ODD

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "e", " ", "  ", "▁", "\n", "\t", "é", "é", "汉", "🤣", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "...", "the", " of", "ing", "'s",
        "\x00", "\x1c", "\x85", "\xa0", "ſ", "A", "ZZ", "=====", "Σ", "İ", " ́", "1", "23", ".,"]


def mixtures(n=3_000, seed=1):
    draw = random.Random(seed)
    return ["", " ", "▁", "\n", "a" * 2_000, "ab " * 500] + ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_agenda_gives_the_library_s_ids():
    codec, library = sentencepiece_codec.Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in mixtures():
        assert codec.ids(library.normalize(text)) == library.encode(text) + [library.eos_id()]
    codec.check()
    assert not codec.wrong and not codec.fresh


def test_a_wrong_segment_is_told():
    codec = sentencepiece_codec.Codec(PIECES)
    text = codec.model.library.normalize("strange words")
    codec.ids(text)
    codec.parts["▁strange"] = (5, 6)
    assert not codec.check()
    assert set(codec.wrong) == {"▁strange"} and not codec.agrees(text)
    assert codec.ids(text) == codec.model.library.encode("strange words") + [codec.end]  # the library's, from now on


def test_encoding_of_odd_rows(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for doc_id, text, _ in ODD:
        ids = library.encode(text or "") + [library.eos_id()]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), True))
    found = sentencepiece_codec.encoding_summary(odd, PIECES)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert sentencepiece_codec.encoding_summary(none, PIECES).count() == 0
    encoded = sentencepiece_codec.encode_texts(odd, PIECES)
    texts = {r.doc_id: r.text for r in sentencepiece_codec.decode_ids(encoded, PIECES).collect()}
    assert texts == {d: (t or "").replace("▁", " ") for d, t, _ in ODD}


def test_counts_are_the_libraries():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = mixtures(seed=2)
    assert token_counts.piece_counter(PIECES)(texts) == [len(library.encode(t)) for t in texts]
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert token_counts.rank_counter(RANKS, public_tokenizers.PATTERN)(texts) == [len(encoding.encode_ordinary(t)) for t in texts]


def test_counts_of_odd_rows(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.token_counts(odd, PIECES, 4096).collect()
    want = [(d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, _ in ODD]
    assert sorted(map(tuple, found), key=str) == sorted([(*w, w[2] > 4096) for w in want], key=str)
    assert token_counts.token_counts(none, PIECES, 4096).count() == 0


def test_memo_is_bounded_and_keeps_what_is_used():
    asked = []
    memo = Memo(lambda k: asked.append(k) or k, 10)
    for k in range(100):
        assert memo[k] == k and memo["often"] == "often" and len(memo) + len(memo.old) <= 10
    assert asked.count("often") == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**20), st.integers(0, 2**64 - 1)), max_size=3_000))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    assert (simple8b.unpack(*simple8b.pack(values), len(values)) == values).all()


@pytest.mark.parametrize("n", [0, 1, 1_023, 1_024, 1_025, 5_000])
def test_simple8b_blocks_and_runs(n):
    draw = np.random.default_rng(n)
    for high in (1, 2, 50_000, 2**60, 2**63):
        values = draw.integers(0, high, n, dtype=np.uint64)
        values[draw.random(n) < 0.4] = 0
        words, exceptions, offsets, _ = packed = simple8b.pack(values)
        assert (simple8b.unpack(*packed, n) == values).all() and len(offsets) == -(-n // simple8b.BLOCK) + 1
        assert len(exceptions) == int((values >> np.uint64(60) > 0).sum())
    assert len(simple8b.pack(np.zeros(1_024))[0]) <= 10


def test_words_are_encoded_as_whole_texts_are():
    library, encode = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS, limit=2_000)
    texts = mixtures(seed=3)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encode(pa.array(texts[at : at + 100]), 1)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def test_token_files_of_odd_rows(spark, odd, none, tmp_path):
    library = Tokenizer.from_file(WORDS)
    files = token_files.write_token_files(odd, WORDS, 1, str(tmp_path / "ids"), file_ids=500)
    assert files.count() > 1
    want, start = [], 0
    for doc_id, text, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.read_token_files(files).collect()), key=lambda r: r[1]) == want
    assert token_files.token_file_round_trip(none, WORDS).count() == 0
    with open(files.first().path, "rb") as whole:
        broken = tmp_path / "broken.s8b"
        broken.write_bytes(whole.read()[:-3])
    with pytest.raises(ValueError):
        token_files.read_ids(str(broken))
