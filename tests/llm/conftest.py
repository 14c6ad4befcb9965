import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

CLASHING = "_doc string, row_key string, spans string, score double, band int, v string, ord int, _s int, items string"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) rows: random words, shared passages, copies, edits, periodic, empty, null and very long texts."""
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdeéüß") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    make = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [make(40), make(25), make(13)]
    lines = ["\n".join(" ".join(make(6)) for _ in range(k)) for k in (3, 4, 5)]
    rows = []
    for i in range(60):
        body = make(rnd.randint(1, 120))
        for p in passages:
            if rnd.random() < 0.4:
                at = rnd.randint(0, len(body))
                body[at:at] = p
        text = " ".join(body)
        if rnd.random() < 0.5:
            text += "\n" + rnd.choice(lines) + "\n" + rnd.choice(lines)
        rows.append((i + 10, text))
    base = make(200)
    for i in range(12):  # near copies around one text
        own = list(base)
        for _ in range(i % 5):
            own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
        rows.append((100 + i, " ".join(own)))
    rows += [
        (200, None), (201, ""), (202, " \t\n \x0b"), (203, "word"), (204, "two words"), (None, rows[0][1]), (None, None),
        (205, "was " * 300), (206, "aaaa" * 200), (207, "a.b! " * 100), (208, rows[3][1]), (209, rows[3][1].upper()),
        (3, rows[5][1]), (210, "x　y z " * 30), (211, "A\nB\nC\nA\nB\nC\nD"), (212, "A\n\nB\n \nC\nA\r\nB\nC"),
        (213, " ".join(make(4000))), (214, "<|endoftext|> between 🙂 words's\n\n  end"), (10, rows[0][1]), (10, "other text of id ten"),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    schema = f"lang string, text string, doc_id bigint, n_chars bigint, {CLASHING}"
    rows = [("l", t, i, None if t is None else len(t), "x", "y", "z", 0.5, 1, "v", 2, 3, "i") for i, t in corpus]
    return spark.createDataFrame(rows, schema).repartition(3, "text").persist()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
