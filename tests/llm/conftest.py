import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, columns named like results."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    line = "This line is held by many documents of the table."
    rows = []
    for i in range(60):
        text = "\n".join(" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 6)))
        if i % 4 == 0:
            text += f"\n  {line.upper() if i % 8 else line}\t\n"
        rows.append((i, text, "en" if i % 3 else None, f"src{i % 5}" if i % 7 else None, len(text), i, "x", "y"))
    rows += [(60, None, "en", "src0", None, None, None, None), (61, "", "en", "src0", 0, 1, "", ""), (62, " \n\t ", "en", "src0", 4, 1, "", ""), (None, "a null id " + line, None, None, 5, 1, "", ""), (63, "word " * 30_000, "de", "src1", 1, 1, "", ""), (64, "x" * 60_000, "de", "src1", 1, 1, "", "")]
    rows += [rows[8], rows[8], (9, "another text of id nine\n" + line, "en", "src2", 3, 1, "", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, ids string, epoch string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
