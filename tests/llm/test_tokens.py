import json
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarrylens.llm import bpe_codec, token_counts

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab \n\t\r  é你▁\x1c\x85　​'sS'll 1²३_-.,!?\0🙂 the in ingtion"
ODD = ["", "\n", " \n ", "<|endoftext|>x <|endoftext|>", "a" * 5000, " " * 5000, "Thing" * 2000, "▁", "  x", "x  ", "don't we'll I'D", "\U0001F9D1‍\U0001F680"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(1500)] + ["".join(r.choice(["<|endoftext|>", "the ", "re", "\n"]) for _ in range(9)) for _ in range(50)]


def test_codec_equals_the_library(texts):
    library, codec = Tokenizer.from_file(BPE), bpe_codec.Codec(BPE)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert codec.encode_all(texts) == want
    assert [codec.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    assert 0 < codec.merged_words < codec.proposed_words  # both ways are used


def test_codec_forgets_and_still_agrees(texts, monkeypatch):
    monkeypatch.setattr(bpe_codec, "KEPT_WORDS", 50)
    monkeypatch.setattr(bpe_codec, "KEPT_PAIRS", 40)
    library, codec = Tokenizer.from_file(BPE), bpe_codec.Codec(BPE)
    got = [x for i in range(0, len(texts), 40) for x in codec.encode_all(texts[i : i + 40])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_decoding_of_broken_ids():
    library, codec = Tokenizer.from_file(BPE), bpe_codec.Codec(BPE)
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 6))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert codec.decode([10**6, -1]) == ""


@pytest.mark.parametrize(
    ("part", "value", "told"),
    [
        ("normalizer", {"type": "NFC"}, "normaliser"), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}, "split"), ("pre_tokenizer", None, "split"),
        ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}, "split"), ("decoder", None, "decoder"), ("model.ignore_merges", True, "ignore_merges"),
        ("model.dropout", 0.1, "dropout"), ("model.end_of_word_suffix", "</w>", "suffix"), ("added.lstrip", True, "white space"), ("added.single_word", True, "whole words"), ("added.normalized", True, "normalised"),
    ],
)
def test_files_that_cannot_be_followed(tmp_path, part, value, told):
    spec = json.load(open(BPE))
    where, _, key = part.rpartition(".")
    ({"": spec, "model": spec["model"], "added": spec["added_tokens"][0]}[where])[key] = value
    (tmp_path / "odd.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match=told):
        bpe_codec.Codec(str(tmp_path / "odd.json"))


def test_decoding_of_frames(spark):
    rows = [(1, [464, None, 3797], "a"), (2, None, "b"), (3, [], "c"), (3, [], "c"), (4, [10**6, -1, 464], None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>, decoded string")
    library = Tokenizer.from_file(BPE)
    got = bpe_codec.decode(df, BPE)
    assert got.columns == df.columns
    word = library.decode([464], skip_special_tokens=False)
    assert sorted((r.doc_id, r.decoded) for r in got.collect()) == [(1, library.decode([464, 3797], skip_special_tokens=False)), (2, None), (3, ""), (3, ""), (4, word)]
    assert bpe_codec.decode(df.limit(0), BPE).count() == 0


def test_counts_equal_the_library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    whole = token_counts.prove(PIECE)
    counter = token_counts.Counter(PIECE, whole)
    assert counter.count_all(texts) == [len(x) for x in model.encode(texts, num_threads=1)]
    assert len(whole) > 30_000
    assert all(len(model.encode(t[1:])) == 1 for t in list(whole)[:500] if t[0] == " " and len(t) > 1)


def test_frames(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(BPE)
    rows = odd_docs.select("doc_id", "text").collect()
    got = bpe_codec.encode(odd_docs, BPE, decoded=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]))
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in rows]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=key) == sorted(want, key=key)
    again = bpe_codec.decode(bpe_codec.encode(odd_docs, BPE), BPE).collect()
    assert sorted(r.decoded for r in again) == sorted(r.text or "" for r in rows)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    counts = token_counts.token_counts(odd_docs, PIECE, limit=100).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(model.encode(r.text or "")), n > 100) for r in rows), key=str)
    assert sorted((tuple(r) for r in counts), key=str) == want
    assert bpe_codec.encode(no_docs, BPE).count() == token_counts.token_counts(no_docs, PIECE).count() == 0


def test_words_taken_together_are_as_one_by_one():
    codec = bpe_codec.Codec(BPE)
    r = random.Random(4)
    words = [b"", b"the"] + ["".join(r.choice(LETTERS) for _ in range(r.choice([1, 3, 9, 30]))).encode() for _ in range(600)] + [b"aaaaaaa", b" " * 20]
    for together, alone in ((codec.merge_all, codec.merge), (lambda x: codec._by_size(x, codec._matched, codec.propose), codec.propose)):
        flat, counts = together(words)
        want = [alone(w) for w in words]
        assert counts.tolist() == list(map(len, want)) and flat.tolist() == [t for x in want for t in x]
        assert [len(x) for x in together([])] == [0, 0]


def test_latin_texts_are_split_as_all_others(texts):
    latin = [t for t in texts if not bpe_codec._NOT_LATIN.search(t)] + ["²½ x¼ \x85\xa0\xa0y\x1c z 's's ß'llǅɂ"]
    assert len(latin) > 50 and [bpe_codec.LATIN_WORDS.findall(t) for t in latin] == [bpe_codec.WORDS.findall(t) for t in latin]
