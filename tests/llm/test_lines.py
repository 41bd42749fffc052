import collections
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import common, line_dedup, quality_rules

WS = " \t\n\x0b\x0c\r"


def key_of(line):
    return line.strip(WS).encode().translate(common.LOWER).decode()


@pytest.mark.parametrize("least_hot", [1000, 5])
def test_line_dedup_by_brute_force(odd_docs, no_docs, monkeypatch, least_hot):
    monkeypatch.setattr(common, "LEAST_HOT", least_hot)
    rows = odd_docs.select("doc_id", "text").collect()
    held = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key_of(line)) >= 20:
                held[key_of(line)].add(-1 if r.doc_id is None else r.doc_id)
    shared = {k: max(v) for k, v in held.items() if len(v) >= 3}
    want = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in shared or shared[key_of(x)] == (-1 if r.doc_id is None else r.doc_id)]
        want.append((r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    out = line_dedup.dedup_lines(odd_docs)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=str) == sorted(want, key=str)
    assert out.columns == [*odd_docs.columns, "n_lines", "n_dropped"] and any(w[3] for w in want)
    assert line_dedup.dedup_lines(no_docs).count() == 0
    again = line_dedup.dedup_lines(out)  # columns of the same names are replaced
    assert again.columns == out.columns and again.count() == out.count()


def brute_base(text):
    words = [w for w in "".join(c if c not in WS else " " for c in text).split(" ") if w]
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(WS):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(covered)


def test_base_counts_by_brute_force():
    r = random.Random(5)
    texts = ["", " ", "a", "é ü\x0bx"] + ["".join(r.choice(["a ", "b ", "c\n", "é# ", "\t", "a b c d a b c d "]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    got = quality_rules.base_counts([t.encode() for t in texts])
    assert [tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [brute_base(t) for t in texts]
    assert all(len(v) == 0 for v in quality_rules.base_counts([]).values())


def test_frequent_lines_of_a_host(spark, odd_docs, no_docs):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    menu = " ".join(f"menu{j}" for j in range(25))
    rows = [(i, f"{menu}\n{body(i)}", "a") for i in range(10)] + [(100 + i, f"{menu.upper()}\nonly {i}", "a") for i in range(3)] + [(200, f"{menu}\nother host", "b")]
    rows += [(300 + i, body(999), "a") for i in range(20)]  # copies are documents: each of their lines is frequent
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    out, frequent = quality_rules.verdicts(docs, F.col("host"), min_docs=5, host_share=0.1)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i in range(10)) and not any(kept[100 + i] for i in range(3)) and kept[200] and not any(kept[300 + i] for i in range(20))
    assert {r.n for r in frequent.collect()} == {13, 20}
    texts = {r.doc_id: r.text for r in quality_rules.clean(docs, "host", min_docs=5, host_share=0.1).collect()}
    assert texts[0] == body(0) and texts[200].startswith("menu0") and 100 not in texts and len(texts) == 11
    out, _ = quality_rules.verdicts(odd_docs, F.col("source"))
    rows = odd_docs.select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=str) == sorted(((r.doc_id, *(b := brute_base(r.text or "")), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in rows), key=str)
    assert quality_rules.verdicts(no_docs, F.col("source"))[0].count() == 0


@pytest.mark.parametrize(("least_hot", "share"), [(1000, 0.0), (3, 0.15)])
def test_verdicts_by_brute_force(spark, monkeypatch, least_hot, share):
    monkeypatch.setattr(common, "LEAST_HOT", least_hot)
    r = random.Random(11)
    line = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(r.randint(1, 12)))
    shared, rows = [line() for _ in range(8)], []
    for i in range(300):
        own = [r.choice(shared).upper() if r.random() < 0.5 else r.choice(shared) for _ in range(r.randint(0, 4))] + [line() for _ in range(r.randint(0, 3))]
        r.shuffle(own)
        rows.append((i, "\n".join(own), r.choice(["a", "a", "b", None])))
    rows += [(400 + i, rows[3][1] + "\n" + rows[5][1] + "\nits own line of a page copied often", r.choice(["a", "b"])) for i in range(60)]
    rows += [(500 + i, "", "a") for i in range(30)] + [(600, None, "b"), (601, " \n\t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string").repartition(4)
    holders, size = collections.defaultdict(list), collections.Counter(h for _, _, h in rows)
    for i, t, h in rows:
        for k in {key_of(x) for x in (t or "").split("\n")} - {""}:
            holders[h, k].append((i, t))
    most = {h: max(8, share * n) for h, n in size.items()}
    frequent = {x for x, v in holders.items() if len(v) > most[x[0]]}
    want = {}
    for i, t, h in rows:
        n, left = brute_base(t or "")[0], [x for x in (t or "").split("\n") if (h, key_of(x)) not in frequent]
        base, words = brute_base(t or ""), sum(len(x.split()) for x in left)
        failed = n < 6 or 100 * base[4] > 30 * n
        want[i] = (failed, words, not failed and words >= 5 and words >= 0.3 * n)
    out, found = quality_rules.verdicts(docs, F.col("host"), min_docs=8, host_share=share, min_words=6)
    assert {x.doc_id: (x.base_failed, x.n_words_left, x.kept) for x in out.collect()} == want
    assert sorted((str(x.fh), x.n) for x in found.collect()) == sorted((str(h), len(holders[h, k])) for h, k in frequent)
    depleted = [i for i, w in want.items() if not w[0] and not w[2]]
    assert depleted and frequent and any(w[2] for w in want.values())
    texts = {x.doc_id: x.text for x in quality_rules.clean(docs, "host", min_docs=8, host_share=share, min_words=6).collect()}
    assert texts == {i: "\n".join(x for x in t.split("\n") if (h, key_of(x)) not in frequent) for i, t, h in rows if want[i][2]}
