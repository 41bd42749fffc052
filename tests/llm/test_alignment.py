import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarrylens.llm import alignment, bpe_codec

from .test_tokens import LETTERS, ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHITES = "ab \n\t \u2003\u3000\u1680\x85\r\x1c\u2028."


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    out = [*ODD, "<s>x</s> <unk>", "<0x41> <0x0A>", "a\t b", "a\t\t  b", "a \t", "a\t \n", "\t", " ", "  ", "é", "▁x"]
    out += ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 60))) for _ in range(500)]
    out += ["".join(r.choice(WHITES) for _ in range(r.randint(0, 12))) for _ in range(1500)]
    return out + [" ".join(r.choice(["the", "ation", "naïve", "Straße,", "e-mail", "(x)", "1234", "l'an.", "a!?b", "x;", "u.s.,", "don't", "Ab#c"]) for _ in range(30)) for _ in range(20)]


def brute(texts):
    """By the libraries, token by token: a list of (n_a, n_b, n_groups, links, digest) and the pairs' counts."""
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    letters = bpe_codec._byte_letters()
    out, counts = [], collections.Counter()
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in b)]
        want = (" " + text).encode() if text else None
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            out.append((0, 0, 0, [], ""))
            continue
        spans = []
        for sizes in (map(len, a_bytes), map(len, b_bytes)):
            at, mine = 0, []
            for n in sizes:
                mine.append((at, at + n))
                at += n
            spans.append(mine)
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, lo = [], 0
        for hi in cuts:
            sides = [",".join(str(i) for i, (x, y) in zip(ids, s, strict=True) if lo <= x and y <= hi) for ids, s in zip((a, b), spans, strict=True)]
            groups.append("|".join(sides))
            lo = hi
        links = [(i, j) for i, (p, q) in zip(a, spans[0], strict=True) for j, (x, y) in zip(b, spans[1], strict=True) if p < y and x < q]
        counts.update(links)
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, counts


def rows_of(texts):
    found, counts = brute(texts)
    highest = collections.Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return [(n_a, n_b, g, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest) for n_a, n_b, g, links, digest in found], counts


def test_units_are_taken_apart_alone(texts):
    """Each unit by itself gives what both libraries give of the whole text."""
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    c = alignment.Aligner(A, B)
    for t in texts:
        units = c.units.findall(" " + t)
        assert "".join(units) == " " + t
        if t and "▁" not in t:
            assert [i for u in c._a_ids(units) for i in u] == library.encode(" " + t, add_special_tokens=False).ids
            assert [i for u in c._b_ids(units) for i in u] == model.encode(t)


@pytest.mark.parametrize("block", [300, 6 << 20])
def test_align_by_brute_force(spark, texts, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "KEPT_UNITS", 40 if block == 300 else 200_000)
    some = [t for t in texts if len(t) < 3000]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(some)], "doc_id long, text string, block long, groups string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align(docs, A, B).collect()}
    want, counts = rows_of(some)
    assert [got[i] for i in range(len(some))] == want
    if block != 300:
        pairs = {(r.a, r.b): r.links for r in alignment.pair_links(docs, A, B).collect()}
        assert pairs == dict(counts)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    want, _ = rows_of([(r.text or "") if len(r.text or "") < 50_000 else "" for r in rows])
    got = alignment.align(odd_docs, A, B).collect()
    assert len(got) == len(rows)
    sizes = sorted(((r.doc_id, n[0], n[1], n[2]) for r, n in zip(rows, want, strict=True) if len(r.text or "") < 50_000), key=str)
    long = {r.doc_id for r in rows if len(r.text or "") >= 50_000}
    assert sorted((tuple(r[:4]) for r in got if r[0] not in long), key=str) == sizes
    assert all(r.n_links >= max(r.n_a, r.n_b) > 0 for r in got if r[0] in long)
    assert {tuple(r[1:]) for r in got if r[0] in (60, 61)} == {(0, 0, 0, 0, 0, 0, "")}
    assert alignment.align(no_docs, A, B).count() == 0 and alignment.pair_links(no_docs, A, B).count() == 0


def test_documents_count_once(spark):
    docs = spark.createDataFrame([(1, "the the the"), (2, "the")], "doc_id long, text string")
    (r,) = alignment.pair_links(docs, A, B).collect()
    assert (r.links, r.document_links, r.groups) == (4, 2, 1)
