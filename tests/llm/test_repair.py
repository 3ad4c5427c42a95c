import hashlib
import heapq
import random
import zlib

import pytest

from gradewell.llm import _grammar, conversation_repair
from gradewell.llm._grammar import ALPHABET, Grammar, Path, apart, text_of
from gradewell.llm.conversation_repair import Repair, op11_conversation_repair

SPACE = " \t\n\x0b\x0c\r"
ENDS = ("su", "ua", "au")


def least(rows):
    """Cheapest edits of (initial, may stay, truncated) rows: shortest path over rows and roles said so far, audits compared as texts."""
    heap, seen = [(0, "", 0, "")], set()
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(rows) and state in ("", "a"):
            return cost, audit
        for c in "ua":
            if c in step[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, c))
        if at < len(rows):
            initial, stays, cut = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if stays:
                if initial in step[state]:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, initial))
                for c in "ua":
                    if c in step[state]:
                        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, c))


def by_hand(rows):
    """What is reported of one conversation's rows (turn, role, text), and its repaired rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        end = text.strip(SPACE)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        marks.append((role[:1], fault not in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = least(marks)
    out, at = [], 0
    for letter in audit:
        if letter == "K":
            out.append((rows[at][1], rows[at][2]))
        elif letter in "RI":
            out.append(("assistant" if out and out[-1][0][:1] == "u" else "user", rows[at][2] if letter == "R" else ""))
        at += letter != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    counts["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ENDS for a, b in zip(rows, rows[1:], strict=False))
    return counts | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()}, out


def damage(rows):
    out, one = [], lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        k, role, text = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20, one(role), one(text)
        text = "" if k == 1 else text.translate({ord(c): None for c in ".!?"}) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def conversations(seed, n):
    rng, out = random.Random(seed), []
    says = ["yes.", "no", "ok!", "", " \t", "why?", "so . ", "é…", None, "line\nline."]
    for conv in range(n):
        turn = rng.choice([0, 0, 5, None])
        for _ in range(rng.choice([1, 2, 4, 9, 30])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "agent"])
            out.append((conv, turn, role, rng.choice(says) if rng.random() < 0.5 else f"{rng.random()}{rng.choice(['.', '', '?'])}"))
            turn = rng.choice([turn, None if turn is None else turn + 1, None if turn is None else turn + 1, rng.randint(0, 40)])
    return [*out, (None, 1, "user", "null id."), (None, 2, "assistant", "here.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def held(got, rows, ids):
    by = {}
    for conv, *r in rows:
        by.setdefault(conv, []).append(r)
    want = {i: by_hand(by.get(i, []))[0] for i in ids}
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in want[r.conv_id]} == want[r.conv_id], r


def test_query_equals_plain_search(spark, tmp_path):
    rows = conversations(1, 120) + [(1000 + i, 0, "user", "alone.") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    held(got, damage(rows), {r[0] for r in rows})
    assert sum(r.cost for r in got) > 100 and any(r.audit == "" and r.blank + r.duplicate == 0 for r in got)


def test_conversations_of_many_strings(spark, monkeypatch):
    monkeypatch.setattr(conversation_repair, "SYMBOLS", 3)
    monkeypatch.setattr(conversation_repair, "BYTES", 40)
    rows = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in conversations(2, 40)] + [(7, 900, "user", "again.")] * 50 + [(8, t, "user", "at every turn.") for t in range(60)]
    repair = Repair(spark.createDataFrame(rows, SCHEMA).repartition(4))
    held(repair.report().collect(), rows, {r[0] for r in rows})
    spoken = {}
    for r in sorted(repair.turns().collect(), key=lambda r: (r.part, r.no, r.k)):
        spoken.setdefault(r.conv_id, []).append((r.role, r.text))
    by = {}
    for conv, *r in rows:
        by.setdefault(conv, []).append(r)
    assert spoken == {i: out for i, v in by.items() if (out := by_hand(v)[1])}


def test_edge_tables(spark):
    clash = f"{SCHEMA}, n string, symbol int, least int, part int"
    assert Repair(spark.createDataFrame([], clash)).report().collect() == []
    rows = [(1, None, "user", None), (1, None, "user", "x " * 300_000 + "end."), (2, 2**62, "assistant", "a."), (2, -(2**62), "user", "b.")]
    got = Repair(spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], clash)).report().collect()
    held(got, [(c, t, r, x or " ") for c, t, r, x in rows], {1, 2})
    other = spark.createDataFrame([("k", 1, "user", "a?"), ("k", 2, "assistant", "b.")], "thread string, at int, who string, says string")
    (r,) = Repair(other, "thread", "at", "who", "says").report().collect()
    assert (r.conv_id, r.audit, r.cost) == ("k", "KK", 0)


@pytest.mark.parametrize("cut", [1, 3, 50])
def test_grammar_changes_no_result(cut):
    rng = random.Random(cut)
    for _ in range(150):
        symbols = "".join(rng.choice(ALPHABET[:8] + "ua" * 4 + "bd") for _ in range(rng.randint(1, 40)))
        grammar = Grammar()
        for _ in range(rng.randint(0, 4)):
            grammar = grammar.with_round(apart([p for p, _ in grammar.pairs(symbols).most_common()], 4))
        parts, path = [symbols[i : i + cut] for i in range(0, len(symbols), cut)], Path()
        for p in parts:
            path.add(grammar.of_text(p))
        ways, _, last = path.ways()
        cells = [grammar.of_text(p)[i][j] for p, (i, j) in zip(parts, ways, strict=True)]
        want = least([(s.lower(), s not in "bd", s.isupper()) for s in symbols])
        assert (sum(c for c, _ in cells) + 3 * len(last), "".join(text_of(r) for _, r in cells) + last) == want


def test_rules_are_made_once_and_shared(monkeypatch):
    made, times = [], _grammar.times
    monkeypatch.setattr(_grammar, "times", lambda a, b: made.append(1) or times(a, b))
    grammar = Grammar()
    for _ in range(8):
        grammar = grammar.with_round(apart([p for p, _ in grammar.pairs("ua" * 128).most_common()], 4))
    assert len(grammar.parse("ua" * 128)) == 1
    made.clear()
    for _ in range(5):
        grammar.of_text("ua" * 128)
    assert len(made) == sum(map(len, grammar.rounds)) == 8
