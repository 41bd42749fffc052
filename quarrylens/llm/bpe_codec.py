"""Byte-level BPE encoding and decoding by speculation and verification."""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pre-tokens of the vocabulary's family; \s as Unicode's White_Space alone.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: A worker keeps the tokens of at most so many words, and forgets them all when there are more.
KEPT_WORDS, KEPT_PAIRS, LONG_WORD, SHORT_WORD = 150_000, 1_000_000, 48, 24
#: Texts are cut to words in pieces of about so many bytes: words, and lists of them, take many times the room of a text.
WORDS_OF_BYTES = 256 << 10


def _latin_words() -> tuple[re.Pattern, re.Pattern]:
    """WORDS for texts of Latin letters alone, whose classes are short enough to be written out, which takes half the time;
    and what finds a character that it is not for."""
    below = "".join(map(chr, range(0x250)))
    letters, digits, spaces = ("".join(map(re.escape, regex.findall(rf"\p{{{c}}}", below))) for c in ("L", "N", "White_Space"))
    return re.compile(f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digits}]+| ?[^{spaces}{letters}{digits}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"), re.compile("[^\0-\u024f]")


LATIN_WORDS, _NOT_LATIN = _latin_words()


def words_of(text: str) -> list[str]:
    return (WORDS if _NOT_LATIN.search(text) else LATIN_WORDS).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible ones for themselves, the others from 256 up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def refused(spec: dict) -> list[str]:
    """What a tokenizer file asks for that Codec does not do, so that its ids would be others than the library's."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    found = ["a normaliser"] if spec.get("normalizer") is not None else []
    if model.get("type", "BPE") != "BPE":
        found.append(f"a model of type {model['type']}")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        found.append("words that are not split as byte-level BPE without a leading space does")
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        found.append("a decoder that is not byte-level")
    found += [f"the model's {k}" for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd = [x["content"] for x in spec["added_tokens"] if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")]
    if odd:
        found.append(f"added tokens that take white space, only whole words or normalised text: {odd[:5]}")
    letters = set(_byte_letters())
    if missing := letters - model["vocab"].keys():
        found.append(f"a vocabulary without {len(missing)} of the bytes")
    return found


def _at(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in a sorted table that ends with one larger than any, and whether they are there."""
    at = np.searchsorted(table, codes)
    return at, table[at] == codes


class Codec:
    """Greedy longest match proposes a word's tokens. A proposal holds if each of its tokens encodes as itself and
    every two neighbours, encoded together, come out as these two: a token sequence with only such pairs is the one that
    merging gives. Pairs are tested at once, as codes in a sorted array, and each distinct pair is merged just once.
    Words whose proposal fails are merged exactly. A file that asks for anything else is refused.

    Many short words are matched and merged together, a token or a merge of each in a round; long ones one by one."""

    def __init__(self, path: str):
        with open(path) as file:
            spec = json.load(file)
        if found := refused(spec):
            raise ValueError(f"{path} can't be followed: it has {'; '.join(found)}")
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.ids = {as_bytes(s): i for s, i in vocab.items()}
        self.size = max(chain(vocab.values(), self.special.values())) + 1
        self.bytes = [b""] * self.size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.table = pa.array(self.bytes, pa.binary())
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] * self.size + vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        codes = np.array(sorted(self.ranks), np.int64)
        self.codes, self.code_ranks = np.append(codes, 1 << 62), np.array([*map(self.ranks.__getitem__, codes.tolist()), 0], np.int32)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.longest = max(map(len, self.ids))
        self._grow_tree()
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pairs, self.fits = np.array([1 << 62]), np.zeros(1, bool)
        self.alone = np.full(self.size, -1, np.int8)
        self.merged_words = self.proposed_words = 0
        self._forget()

    def _forget(self) -> None:
        """No word is known any more. words: a known word's number; flat, starts: the tokens by that number."""
        self.words = {s: n for n, s in enumerate(self.special)}
        self.flat, self.starts = np.array([*self.special.values()], np.int32), np.arange(len(self.special) + 1)

    def _grow_tree(self) -> None:
        """The vocabulary as a tree of bytes: edges has node * 256 + byte, sorted, child the node there, token a node's or -1."""
        names = [*self.ids]
        ids, sizes = np.array([*self.ids.values()], np.int32), np.array([*map(len, names)])
        flat, begin = np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes
        node, edges, token, n = np.zeros(len(names), np.int64), [], [np.array([-1], np.int32)], 1
        for depth in range(self.longest):
            on = np.flatnonzero(sizes > depth)
            here, back = np.unique(node[on] * 256 + flat[begin[on] + depth], return_inverse=True)
            node[on] = n + back
            edges.append(here)
            token.append(np.full(len(here), -1, np.int32))
            ends = on[sizes[on] == depth + 1]
            token[-1][node[ends] - n] = ids[ends]
            n += len(here)
        edges = np.concatenate(edges)
        order = np.argsort(edges)
        self.edges, self.child, self.token = np.append(edges[order], 1 << 62), np.append(order + 1, 0), np.concatenate(token)

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, in n log n steps."""
        tokens = self.single[np.frombuffer(word, np.uint8)].tolist()
        n, size, ranks, made = len(tokens), self.size, self.ranks, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := ranks.get(tokens[i] * size + tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            new = int(made[rank])
            tokens[i], tokens[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(new * size + tokens[k])) is not None:
                    heapq.heappush(heap, (r, i, new, tokens[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get(tokens[h] * size + new)) is not None:
                heapq.heappush(heap, (r, h, tokens[h], new))
        return [t for t in tokens if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            end = min(n, at + self.longest)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def _by_size(self, words: list[bytes], together, alone) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and how many each has: short words' by together(bytes, sizes), the others' by alone(word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(sizes > SHORT_WORD).tolist()
        if not long:
            return together(np.frombuffer(b"".join(words), np.uint8), sizes)
        short = np.flatnonzero(sizes <= SHORT_WORD)
        flat, counts = together(np.frombuffer(b"".join([words[i] for i in short.tolist()]), np.uint8), sizes[short])
        found = [alone(words[i]) for i in long]
        owner = np.concatenate([np.repeat(short, counts), np.repeat(long, [len(x) for x in found])])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([flat, np.fromiter(chain.from_iterable(found), np.int32)])[order], np.bincount(owner, minlength=len(words))

    def _matched(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """propose() of many words: each round steps down the tree for the next token of every word."""
        ends = np.cumsum(sizes)
        at, words = ends - sizes, np.flatnonzero(sizes)
        owners, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(words):
            begin, end = at[words], ends[words]
            best, size = np.full(len(words), -1, np.int32), np.zeros(len(words), np.int64)
            on, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
            while len(on):
                edge, there = _at(self.edges, node * 256 + flat[begin[on] + depth])
                on, node, depth = on[there], self.child[edge[there]], depth + 1
                token = self.token[node]
                whole = token >= 0
                best[on[whole]], size[on[whole]] = token[whole], depth
                more = begin[on] + depth < end[on]
                on, node = on[more], node[more]
            owners.append(words)
            tokens.append(best)
            at[words] += size
            words = words[begin + size < end]
        owner = np.concatenate(owners)
        return np.concatenate(tokens)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges' ranks of these pairs, or the number of merges."""
        at, there = _at(self.codes, left.astype(np.int64) * self.size + right)
        return np.where(there, self.code_ranks[at], len(self.made)).astype(np.int32)

    def _merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words: each round merges the leftmost pair of lowest rank in every word that has one."""
        tokens, owner, never = self.single[flat], np.repeat(np.arange(len(sizes)), sizes), len(self.made)
        rank = np.full(len(tokens), never, np.int32)  # of each token with the next one of its word
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        rank[inner] = self._rank(tokens[inner], tokens[inner + 1])
        owners, out = [], []
        while len(tokens):
            new = np.diff(owner, prepend=-1) > 0
            first = np.flatnonzero(new)
            best = np.minimum.reduceat(rank, first)[np.cumsum(new) - 1]
            over = best == never
            owners.append(owner[over])
            out.append(tokens[over])
            if over.any():
                tokens, owner, rank, best = tokens[~over], owner[~over], rank[~over], best[~over]
            at = np.flatnonzero(rank == best)
            at = at[np.diff(owner[at], prepend=-1) > 0]  # one for each word
            tokens[at] = self.made[rank[at]]
            left = np.ones(len(tokens), bool)
            left[at + 1] = False
            tokens, owner, rank = tokens[left], owner[left], rank[left]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                rank[i] = never
                i = i[i + 1 < len(tokens)]
                i = i[owner[i] == owner[i + 1]]
                rank[i] = self._rank(tokens[i], tokens[i + 1])
        owner = np.concatenate([np.zeros(0, np.int64), *owners])
        return np.concatenate([np.zeros(0, np.int32), *out])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(sizes))

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._by_size(words, self._merged, self.merge)

    def _alone(self, tokens: np.ndarray) -> np.ndarray:
        new = np.unique(tokens[self.alone[tokens] < 0])
        if len(new):
            flat, counts = self.merge_all([self.bytes[t] for t in new.tolist()])
            self.alone[new] = (counts == 1) & (flat[np.cumsum(counts) - counts] == new)
        return self.alone[tokens] == 1

    def _fit(self, codes: np.ndarray) -> np.ndarray:
        """Whether the pairs of these codes are compatible."""
        distinct = np.unique(codes)
        new = distinct[~_at(self.pairs, distinct)[1]]
        if len(new):
            left, right = np.divmod(new, self.size)
            flat, counts = self.merge_all([self.bytes[a] + self.bytes[b] for a, b in zip(left.tolist(), right.tolist(), strict=True)])
            at = np.cumsum(counts) - counts
            fits = (counts == 2) & (flat[at] == left) & (flat[at + counts - 1] == right)
            if len(self.pairs) + len(new) > KEPT_PAIRS:
                keep = np.isin(self.pairs, distinct)
                keep[-1] = True
                self.pairs, self.fits = self.pairs[keep], self.fits[keep]
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, at, new), np.insert(self.fits, at, fits)
        return self.fits[np.searchsorted(self.pairs, codes)]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, and how many each has."""
        raw = [w.encode() for w in words]
        flat, counts = self._by_size(raw, self._matched, self.propose)
        owner = np.repeat(np.arange(len(words)), counts)
        bad = np.zeros(len(words), bool)
        bad[owner[~self._alone(flat)]] = True
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        if len(inner):
            bad[owner[inner[~self._fit(flat[inner].astype(np.int64) * self.size + flat[inner + 1])]]] = True
        self.proposed_words += len(words)
        self.merged_words += int(bad.sum())
        if bad.any():
            which = np.flatnonzero(bad)
            again, n = self.merge_all([raw[i] for i in which.tolist()])
            good = ~bad[owner]
            owner = np.concatenate([owner[good], np.repeat(which, n)])
            flat = np.concatenate([flat[good], again])[np.argsort(owner, kind="stable")]
            counts[which] = n
        return flat, counts

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        split = [self._pretokens(t) for t in texts]
        here = set().union(*split)
        new = here.difference(self.words)
        if len(self.words) + len(new) > KEPT_WORDS or len(self.flat) > 16 * KEPT_WORDS:
            self._forget()
            new = here.difference(self.words)
        if fresh := list(new):
            flat, counts = self.encode_words(fresh)
            self.words.update(zip(fresh, range(len(self.starts) - 1, len(self.starts) - 1 + len(fresh)), strict=True))
            self.flat, self.starts = np.concatenate([self.flat, flat]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        found = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int64)
        for w in fresh:
            if len(w) > LONG_WORD:
                del self.words[w]
        begin = self.starts[found]
        sizes = self.starts[found + 1] - begin
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.diff(np.append(0, ends)[last], prepend=0)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        ids, counts = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def _pretokens(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return words_of(text)
        out: list[str] = []
        for part in self.split.split(text):
            out += [part] if part in self.special else words_of(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Ids outside of the vocabulary give nothing; bytes that are no UTF-8 give the replacement character."""
        table, size = self.bytes, self.size
        return b"".join([table[i] for i in ids if 0 <= i < size]).decode(errors="replace")

    def decode_flat(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """decode() of texts of so many ids each, all of the vocabulary."""
        found = self.table.take(pa.array(ids))
        joined, ends = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(ids) + 1]
        cuts = ends[np.append(0, np.cumsum(counts))]
        data = joined.to_pybytes() if joined else b""
        return pa.array([data[a:b].decode(errors="replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


def codec(path: str) -> Codec:
    """The worker's codec of that file."""
    return common.model(("codec", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ids array<int> and, if asked for, what they decode to.

    A row out for each row in, in one narrow pass. Null and empty texts have no ids; repeated rows are repeated; an
    empty table gives an empty one; other columns are not read. Texts are never cut, whatever their length."""

    def make():
        c = Codec(path)  # for this task alone: a worker that kept it would stand beside later stages

        def f(piece: pa.RecordBatch):
            ids, counts = c.encode_flat(common.decoded(common.column(piece, "t")))
            out = [common.column(piece, "k"), pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), ids)]
            return [*out, c.decode_flat(ids, counts)] if decoded else out

        return f

    src = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = common.over_batches(src, make, f"k {kind}, ids array<int>" + ", decoded string" * decoded, "t", piece_bytes=WORDS_OF_BYTES)
    return out.withColumnRenamed("k", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded, and keeps every row and column. Null ids give null, an empty list gives an empty text, null members and ids
    outside of the vocabulary give nothing; repeated rows are repeated; an empty table gives an empty one; a column named decoded
    is replaced."""

    @F.pandas_udf("string")
    def decoded(ids):  # noqa: ANN001
        c = codec(path)
        return ids.map(lambda x: None if x is None else c.decode([int(i) for i in x if i is not None and i == i]))  # a null among numbers is NaN here

    return encoded.withColumn("decoded", decoded(ids_col))


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
