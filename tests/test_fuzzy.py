import random

import numpy as np
import pytest

from gradewell.operators import dedupe, likeness

LETTERS = "abcdefghijklmnopqrst"


def plain_ratio(a, b):
    """The classic table of longest common subsequences."""
    if a is None or b is None:
        return 0
    if a == b:
        return 100
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return round(200 * row[-1] / (len(a) + len(b)))


def edited(rng, text, k):
    out = list(text)
    for _ in range(k):
        at = rng.randrange(len(out) + 1)
        if out and rng.random() < 0.5:
            out.pop(min(at, len(out) - 1))
        else:
            out.insert(at, rng.choice(LETTERS))
    return "".join(out)


def texts(rng, n, low=0, high=90):
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(low, high))) for _ in range(n)]
    return out + [edited(rng, rng.choice(out), rng.randint(0, 12)) for _ in range(n // 2)]


def test_many_pairs_equal_one_by_one():
    rng = random.Random(1)
    a = [[t] for t in [*texts(rng, 12), None, "", "é🫨", "x" * 63, "x" * 64, "x" * 65, "y" * 700, "xy" * 400]]
    i, j = np.divmod(np.arange(len(a) ** 2), len(a))
    whole = likeness.ratios(a, a, i, j, 0)[0]
    assert [int(r) for r in whole] == [plain_ratio(a[p][0], a[q][0]) for p, q in zip(i, j, strict=True)]
    part = likeness.ratios(a, a, i, j, 70)[0]
    assert [r if r >= 70 else None for r in part] == [r if r >= 70 else None for r in whole]


@pytest.mark.parametrize("low", [70, 82, 85, 90, 95, 100])
def test_like_texts_share_a_piece(low):
    rng, met = random.Random(low), 0
    for _ in range(400):
        a = "".join(rng.choice(LETTERS[: rng.choice([2, 20])]) for _ in range(rng.randint(0, 60)))
        n, m = sorted((a, edited(rng, a, rng.randint(0, len(a) // 2 + 1))), key=len)
        if plain_ratio(n, m) >= low:
            met += 1
            assert set(likeness.window_keys(n, low)) & set(likeness.piece_keys(m, low)), (n, m)
    assert met > 20


@pytest.mark.parametrize("how", ["pieces", "blocks"])
def test_links_equal_the_double_loop(spark, monkeypatch, how):
    monkeypatch.setattr(dedupe, "BLOCK", 16)
    rng = random.Random(3)
    rows = [(i, t, rng.randrange(2)) for i, t in enumerate([*texts(rng, 90), None, "", None, "same", "same"])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "row_id long, q string, y int")
    classes = {}
    for i, t, y in sorted(rows):
        classes.setdefault((t, y), i)
    want = sorted((min(a, b), max(a, b), plain_ratio(s, t)) for (s, y), a in classes.items() for (t, z), b in classes.items() if a < b and y == z and plain_ratio(s, t) > 84)
    got = sorted((r.a, r.b, int(r.ratio)) for r in dedupe.fuzzy_links(df, ["q"], 84, by=["y"], how=how).collect())
    assert got == want and len(want) > 10


@pytest.mark.parametrize("how", ["pieces", "blocks"])
def test_mean_of_columns(spark, monkeypatch, how):
    monkeypatch.setattr(dedupe, "BLOCK", 16)
    rng = random.Random(4)
    own, few = texts(rng, 40, 5, 50), ["north", "south", "", None, "a long answer", "a longer answer"]
    rows = [(i, t, rng.choice(few), rng.choice(few)) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "row_id long, q string, a string, b string")
    mean = lambda x, y: sum(plain_ratio(p, q) for p, q in zip(x[1:], y[1:], strict=True)) / 3
    want = sorted((x[0], y[0], round(mean(x, y), 6)) for x in rows for y in rows if x[0] < y[0] and 60 <= mean(x, y) < 99)
    got = sorted((r.a, r.b, round(r.ratio, 6)) for r in dedupe.fuzzy_links(df, ["q", "a", "b"], 60, strict=False, high=99, how=how).collect())
    assert got == want and len(want) > 5


def test_unrelated_texts_are_hardly_compared(spark):
    """Twice the texts, each with one edited copy: the pairs compared grow with the texts, where all pairs grow fourfold."""
    compared = []
    for n in (300, 600):
        rng = random.Random(n)
        own = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(40, 80))) for _ in range(n)]
        rows = list(enumerate(own + [edited(rng, t, 4) for t in own]))
        df = spark.createDataFrame(rows, "row_id long, q string")
        pairs = dedupe.piece_pairs(dedupe._classes(df, ["q"], (), "row_id"), 85).select("a", "b").collect()
        assert {(i, i + n) for i in range(n) if rows[i][1] != rows[n + i][1]} <= {(p.a, p.b) for p in pairs}
        compared.append(len(pairs))
    assert compared[0] < 400 and compared[1] < 2.5 * compared[0]


def test_way_is_chosen_by_work(spark, monkeypatch):
    """Both ways give the same; pieces are taken where blocks would compare more than pieces make meet."""
    rng, asked = random.Random(6), []
    monkeypatch.setattr(dedupe, "FEW_PAIRS", 100)
    pieces = dedupe._by_pieces
    monkeypatch.setattr(dedupe, "_by_pieces", lambda *a: asked.append(1) or pieces(*a))
    apart = spark.createDataFrame(list(enumerate(texts(rng, 80, 40, 80))), "row_id long, q string")
    frequent = spark.createDataFrame([(i, "a" * (60 + i)) for i in range(120)], "row_id long, q string")
    links = lambda df, how=None: sorted(map(tuple, dedupe.fuzzy_links(df, ["q"], 88, how=how).collect()))
    monkeypatch.setattr(dedupe, "DEARER", 0.1)
    assert links(apart) == links(apart, "blocks") and len(asked) == 1
    monkeypatch.setattr(dedupe, "DEARER", 8)
    assert links(frequent) == links(frequent, "pieces") and len(asked) == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "row_id long, q string")
    for how in ("pieces", "blocks", None):
        assert dedupe.fuzzy_links(df, ["q"], 90, how=how).collect() == []
