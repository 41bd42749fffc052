"""Personal data: exact patterns, and a linear-chain CRF over word shapes that adds what they miss."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
STATES = ("other", *KINDS)
FEATURES = 4096
#: Words this near to a digit, an @ or a bracketed "at" belong to a chain; all others are "other".
REACH = 3
#: Words whose features are made at once, and words (with padding) that are decoded together; chains are never cut.
FEATURE_WORDS, DECODE_WORDS = 4096, 1 << 16
#: An email in more words, or a span of more characters, isn't valid.
SPAN_WORDS, SPAN_CHARS = 19, 320

_EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_BRACKETED_AT = re.compile(r"[A-Za-z0-9][(\[]at[)\]]")
_WRITTEN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)+")
_BRACKETED_DOT = re.compile(r"\[\.\]|\(\.\)|\[dot\]|\(dot\)")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    d = digits.lstrip("0")
    return len(d) < 4 and int(d or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, leftmost and non-overlapping within a kind; sorted by start, then kind.

    Written so that no text costs more than a few scans: an email is found from its @ and reaches left to the end of the
    last match at most; an address starts where a run of digits starts."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        last = 0
        for m in _EMAIL_END.finditer(text):
            start = at = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(_byte(p) for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def _shape(word: str) -> str:
    """d for digits, x for letters, signs as they are; runs are cut to four."""
    out = []
    for c in word:
        s = "d" if c.isdigit() else "x" if c.isalpha() else c
        if not (len(out) >= 4 and s == out[-1] == out[-2] == out[-3] == out[-4]):
            out.append(s)
    return "".join(out)


def _features(words: list[str]) -> list[list[int]]:
    """Numbers of the features that fire at each word: its shape, its neighbours' shapes, its digits, its signs."""
    shapes = [_shape(w) for w in words]
    padded = ["^", *shapes, "$"]
    out = []
    for i, w in enumerate(words):
        n = sum(c.isdigit() for c in w)
        before, here, after = padded[i : i + 3]
        named = (
            "bias", f"s={here}", f"p={before}|{here}", f"n={here}|{after}", f"b={before}|{here}|{after}", f"d={min(n, 17)}", f"a={'@' in w}{n > 0}",
            f"t={w.strip('()[]').lower() if len(w) < 6 and w[-1:] in ')]' else '-'}", f"x={after}{before}", f"e={w[0]}{w[-1]}", f"h={w.count('-')},{w.count('.')}",
            f"i={_BRACKETED_AT.search(w) is not None}{len(_BRACKETED_DOT.findall(w))}{n > 0}",
        )
        out.append([crc32(x.encode()) % FEATURES for x in named])
    return out


def labelled_table(rows: int = 1500, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The small labelled table: lines of invented words with one or two entities or look-alikes, each word with its state.

    Entities come in the forms that the patterns know and in those they don't: phone numbers without a plus, emails
    with a bracketed at and dot, addresses with bracketed dots, cards with dots. Look-alikes are dates, times, prices, versions, serial numbers, hexadecimal strings and
    words with signs; they are "other"."""
    r = random.Random(seed)
    syllables = "ba co de fi gu ha jo ki lu me no pa qui ro se ti un ver wo zen the and of der la que".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        d = num(r.choice([14, 15, 15]))
        full = next(d + c for c in "0123456789" if luhn(d + c))
        fours = [full[i : i + 4] for i in range(0, len(full), 4)]
        return r.choice([[full], fours, ["-".join(fours)], [".".join(fours)]])

    def made():
        a, b, c = num(3), num(3), num(4)
        kind = r.randrange(17)
        if kind == 0:
            return [f"{word()}.{num(2)}@{word()}{num(1)}.{word()}.com"], 1
        if kind == 1:
            return [f"{word()}@{word()}.org"], 1
        if kind in (2, 12, 13):
            return [word(), *r.choice([["(at)"], ["[at]"]]), word(), *r.choice([["(dot)"], ["[dot]"]]), r.choice(["com", "org", "net"])], 1
        if kind == 3:
            return [".".join(str(r.randint(0, 255)) for _ in range(4))], 2
        if kind in (4, 5):
            return card(), 3
        if kind == 6:
            return [f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], 4
        if kind == 7:
            return [f"({a})", f"{b}-{c}"], 4
        if kind == 8:
            return [f"{a}-{b}-{c}"], 4
        if kind == 9:
            return [f"+{r.randint(1, 99)}-{a}-{b}-{c}"], 4
        if kind == 10:
            return [f"{a}.{b}.{c}"], 4
        if kind in (14, 15):
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("[at]", "."), ("(at)", ".")])
            return [f"{word()}{r.choice(['', '.' + word(), num(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"], 1
        if kind == 16:
            return [r.choice(["[.]", "(.)", "[dot]", "(dot)"]).join(str(r.randint(0, 255)) for _ in range(4))], 2
        return [a, b, c], 4

    def alike():
        return [r.choice([
            f"{r.randint(1990, 2030)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"${num(2)}.{num(2)}", f"v{num(1)}.{num(1)}.{num(2)}", num(r.randint(1, 9)), num(r.randint(20, 30)),
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40]))), f'"{word()}{num(3)}"', f"{num(2)}/{num(2)}/{num(4)}", f"{word()}###", f"{word()}$$$", f"#{num(4)}", f"{num(4)}-{num(4)}", f"{word()}{num(2)}", f"@{word()}", f"{num(1)}.{num(3)}", f"{num(2)}.{num(4)}", f"{word()}:", f"{num(4)}.{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}%",
        ])]

    table = []
    for _ in range(rows):
        words, states = [], []
        for _ in range(r.randint(1, 2)):
            plain = [word() for _ in range(r.randint(1, 4))]
            words, states = words + plain, states + [0] * len(plain)
            got, state = made() if r.random() < 0.6 else (alike(), 0)
            if r.random() < 0.2:
                got[-1] += r.choice(".,;")
            words, states = words + got, states + [state] * len(got)
        plain = [word() for _ in range(r.randint(0, 3))]
        table.append((words + plain, states + [0] * len(plain)))
    return table


@dataclass
class Model:
    """emit: feature x state; move: state x state."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        return self.emit[np.array(features, np.int64)].sum(1)

    def chain_scores(self, words: list[str]) -> np.ndarray:
        """scores() of a whole chain, its features made in steps: they look no further than a word to either side."""
        out = []
        for at in range(0, len(words), FEATURE_WORDS):
            before = at > 0
            some = _features(words[at - before : at + FEATURE_WORDS + 1])[before:]
            out.append(self.scores(some[:FEATURE_WORDS]))
        return np.concatenate(out)

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over many chains at once, those of like length together; a long chain goes alone, and whole."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted((i for i in range(len(chains)) if len(chains[i])), key=lambda i: -len(chains[i]))
        at = 0
        while at < len(order):
            mine = order[at : at + max(1, DECODE_WORDS // len(chains[order[at]]))]
            at += len(mine)
            size = np.array([len(chains[i]) for i in mine])
            u = np.zeros((len(mine), size.max(), len(STATES)))
            for j, i in enumerate(mine):
                u[j, : size[j]] = chains[i]
            best, back = u[:, 0], np.zeros(u.shape, np.int8)
            final = best.copy()
            for t in range(1, u.shape[1]):
                step = best[:, :, None] + self.move[None]
                back[:, t] = step.argmax(1)
                best = step.max(1) + u[:, t]
                final[size > t] = best[size > t]
            path = np.zeros(u.shape[:2], np.int64)
            rows = np.arange(len(mine))
            state = final.argmax(1)
            for t in range(u.shape[1] - 1, -1, -1):
                ended = t < size
                path[ended, t] = state[ended]
                inner = ended & (t > 0)
                state = np.where(inner, back[rows, t, state], state)
            for j, i in enumerate(mine):
                out[i] = path[j, : size[j]]
        return out


def train(table: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Maximum likelihood with Adam; forward and backward run over all rows of one length at once."""
    groups: dict[int, list] = {}
    for words, states in table:
        groups.setdefault(len(words), []).append((_features(words), states))
    data = [(np.array([f for f, _ in g], np.int64), np.array([s for _, s in g], np.int64)) for g in groups.values()]
    k = len(STATES)
    emit, move = np.zeros((FEATURES, k)), np.zeros((k, k))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    total = sum(len(s) for _, s in data)
    logsum = lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    for n in range(1, rounds + 1):
        grads = [decay * emit, decay * move]
        for f, s in data:
            u = emit[f].sum(2)
            a, b = [u[:, 0]], [np.zeros_like(u[:, 0])]
            for t in range(1, u.shape[1]):
                a.append(logsum(a[-1][:, :, None] + move[None], 1) + u[:, t])
                b.append(logsum(move[None] + (u[:, -t] + b[-1])[:, None, :], 2))
            a, b = np.stack(a, 1), np.stack(b[::-1], 1)
            z = logsum(a[:, -1], 1)
            p = np.exp(a + b - z[:, None, None])
            p[np.arange(len(s))[:, None], np.arange(s.shape[1])[None], s] -= 1
            np.add.at(grads[0], f.reshape(-1), np.repeat(p.reshape(-1, k), f.shape[2], 0) / total)
            if u.shape[1] > 1:
                pair = np.exp(a[:, :-1, :, None] + move + (u[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
                np.add.at(pair, (s[:, :-1].ravel(), s[:, 1:].ravel()), -1)
                grads[1] += pair / total
        for p, g, m in zip((emit, move), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p -= rate * (m[0] / (1 - 0.9**n)) / (np.sqrt(m[1] / (1 - 0.999**n)) + 1e-8)
    return Model(emit, move)


def _valid(kind: str, text: str) -> bool:
    """What a span must be to be added, whatever the model says."""
    d = _digits(text)
    if kind == "email":
        return len(text) <= 320 and _WRITTEN_EMAIL.fullmatch(text) is not None
    if kind == "ip":  # one with plain dots is found by its pattern
        parts = _BRACKETED_DOT.split(text)
        return len(parts) == 4 and all(p == _digits(p) != "" and _byte(p) for p in parts)
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9\x20.-]", text)
    return 10 <= len(d) <= 15 and not re.search(r"[^0-9\x20().+-]", text) and re.search(r"[^0-9]", text) is not None and len(text) <= 30 and "\x20\x20" not in text


def _chains(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) of each stretch around the triggers, however long."""
    if not _TRIGGER.search(text):
        return []
    out: list[list[tuple[int, int]]] = []
    base = 0
    for line in text.split("\n"):
        if _TRIGGER.search(line):
            words = [(m.start(), m.end()) for m in _WORD.finditer(line)]
            near = np.zeros(len(words), bool)
            for i, (a, b) in enumerate(words):
                if _TRIGGER.search(line, a, b):
                    near[max(0, i - REACH) : i + REACH + 1] = True
            edges = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
            for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out.append([(a + base, b + base) for a, b in words[lo:hi]])
        base += len(line) + 1
    return out


def find_all(texts: list[str], model: Model) -> list[list[tuple[int, int, str, bool]]]:
    """All spans of each text: (start, end, kind, base?). Added ones overlap no other: a stretch of neighbouring words of one
    state, parted by words of base spans and after commas, is one span if it is valid; of an email's stretch the leftmost longest
    valid parts are."""
    out, owners, chains, words = [], [], [], []
    for i, text in enumerate(texts):
        out.append([(s, e, k, True) for s, e, k in base_spans(text)])
        for chain in _chains(text):
            owners.append(i)
            words.append(chain)
            chains.append(model.chain_scores([text[a:b] for a, b in chain]))
    added: list[list[tuple[int, int, str, bool]]] = [[] for _ in texts]
    starts, ends = ([np.sort(np.array([x[side] for x in spans], np.int64)) for spans in out] for side in (0, 1))
    for i, chain, path in zip(owners, words, model.decode(chains), strict=True):
        text, at = texts[i], 0
        edges = np.array(chain)
        taken = (np.searchsorted(starts[i], edges[:, 1]) > np.searchsorted(ends[i], edges[:, 0], "right")).tolist()
        while at < len(path):
            end = at + 1
            while end < len(path) and path[end] == path[at] and not taken[end] and text[chain[end - 1][1] - 1] not in ",;":
                end += 1
            if not path[at] or taken[at]:
                at = end
                continue
            kind = STATES[path[at]]
            while at < end:
                for stop in range(min(end, at + SPAN_WORDS), at, -1) if kind == "email" else (end,):
                    a, b = chain[at][0], chain[stop - 1][1]
                    while b > a and text[b - 1] in ".,;:!?\"'":
                        b -= 1
                    while a < b and text[a] in "\"'":
                        a += 1
                    if b - a <= SPAN_CHARS and _valid(kind, text[a:b]):
                        added[i].append((a, b, kind, False))
                        at = stop - 1
                        break
                at = at + 1 if kind == "email" else end
    for spans, more in zip(out, added, strict=True):  # chains are apart, and so are the spans of one
        spans += more
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans array<struct<kind, start, end, base>>, by start and then kind; start and end in code points.

    base spans are what the patterns give; the CRF adds others that pass its kind's checks and overlap none. One narrow pass
    over whole texts; the model is a table of fixed size, sent to the workers. Null and empty texts have no spans; repeated
    rows are repeated; an empty table gives an empty one; other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(labelled_table()))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def make():
        def f(piece: pa.RecordBatch):
            found = find_all(common.decoded(common.column(piece, "t")), sent.value)
            return [common.column(piece, "k"), pa.array([[{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in x] for x in found], pa.list_(span))]

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    out = common.over_batches(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), make, f"k {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>", "t")
    return out.withColumnRenamed("k", id_col)


def redact(docs: DataFrame, model: Model | None = None, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; null stays null, all other columns pass through. Bytes that
    are not UTF-8 are read as U+FFFD. Repeated rows are repeated, an empty table gives an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model or train(labelled_table()))

    @F.pandas_udf("string")
    def redacted(texts):  # noqa: ANN001
        out = []
        texts = [None if t is None else bytes(t).decode(errors="replace") for t in texts]
        for text, spans in zip(texts, find_all([t or "" for t in texts], sent.value), strict=True):
            at, parts = 0, []
            for s, e, k, _ in spans:
                if s >= at:
                    parts += [text[at:s], f"[{k}]"]
                at = max(at, e)
            out.append(None if text is None else "".join(parts) + text[at:])
        import pandas as pd

        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, redacted(F.col(f"`{text_col}`").cast("binary")))


def op2(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"), every)
