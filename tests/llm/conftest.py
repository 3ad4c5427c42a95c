import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, row string, _words int"


def corpus(seed: int = 5, n: int = 60) -> list[tuple]:
    """Invented documents with copies, near copies, shared passages, junk, nulls and long texts; columns that clash with working names."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "tor", "e", "lis", "Qu", "é", "mo"]) for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["the", "of", "and"] * 15
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, texts = line(60), [None, "", " \n\t ", "one", "a b c", "<|endoftext|> x", "🫨 wow ² it's we'll"]
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.15:
            texts.append(rng.choice(texts[7:] or ["copy me please " * 20]))
        elif kind < 0.3 and len(texts) > 10:
            parts = (texts[-1] or "x").split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
        elif kind < 0.45:
            texts.append(f"{line(30)} {passage} {line(20)}")
        elif kind < 0.5:
            texts.append("### " * 40)
        else:
            texts.append("\n".join(line(rng.randint(5, 20)) for _ in range(rng.randint(1, 9))))
    texts.append(line(4000))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k], "en", "s", len(texts[k] or ""), 1, "r", 2) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def items(spark, rows):
    long = [r for r in rows if r[1] and len(r[1].split()) > 60][0][1].split()
    texts = [" ".join(long[3:30]), " ".join(long[3:30]), "a b c", None, "", " ".join(long[40:45])]
    return spark.createDataFrame([(10 + i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, n_words string")
