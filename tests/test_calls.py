import json

import pytest
from pyspark.sql import functions as F

from gradewell.functions import structured
from gradewell.sources import providers as P

KEYS = "question_set string, model_id string, row_id long, prompt string"


def prompts(spark, n, models=("m",)):
    return spark.createDataFrame([("s", m, i, f"{m}:{i}") for m in models for i in range(n)], KEYS).repartition(5)


def test_rate_is_never_above_the_limit(spark):
    """The service notes when it is asked; a lane gets its share of the rate in any minute, with retries counted."""
    clock = P.Rehearsal()

    def provider(model, prompt):
        seen.setdefault(prompt, []).append(clock.now())
        if prompt.endswith("3") and len(seen[prompt]) < 3:
            raise P.RateLimited("busy", after=7)
        return json.dumps(seen.pop(prompt))

    seen = {}
    limits = {"m": P.Limit(30, lanes=2, burst=2), "slow": P.Limit(6, pause=15)}
    out = P.answer(prompts(spark, 40, ("m", "slow", "free")), provider, limits=limits, clock=clock)
    lanes = {}
    for r in out.withColumn("lane", F.spark_partition_id()).collect():
        assert r.success and r.attempts == (3 if str(r.row_id).endswith("3") else 1)
        lanes.setdefault((r.model_id, r.lane), []).extend(json.loads(r.resps))
    assert len([x for x in lanes if x[0] == "m"]) == 2 and len([x for x in lanes if x[0] == "slow"]) == 1
    for (model, _), times in lanes.items():
        times.sort()
        most = {"m": 15 + 2, "slow": 6 + 1, "free": 10**9}[model]
        assert all(sum(t <= u < t + 60 for u in times) <= most for t in times)
    slow = next(v for k, v in lanes.items() if k[0] == "slow")
    assert min(b - a for a, b in zip(slow, slow[1:], strict=False)) >= 7


def test_kinds_of_failure():
    clock, asked = P.Rehearsal(), []

    def provider(model, prompt):
        asked.append(clock.now())
        raise {"r": P.Refused("never"), "t": TimeoutError("late"), "l": P.RateLimited("busy", after=5), "f": KeyError("x")}[prompt]

    retry = P.Retry(attempts=4, first=1, factor=3, longest=6)
    got = {}
    for p in "rtlf":
        got[p] = P.call(provider, "m", p, retry, clock)
    assert {k: (v["outcome"], v["attempts"], v["success"], v["resps"]) for k, v in got.items()} == {"r": ("refused", 1, False, ""), "t": ("timed_out", 4, False, ""), "l": ("rate_limited", 4, False, ""), "f": ("failed", 4, False, "")}
    assert got["f"]["error"] == "KeyError: 'x'"
    waits = [b - a for a, b in zip(asked[1:5], asked[2:5], strict=False)]
    assert waits == [1, 3, 6] and [b - a for a, b in zip(asked[5:9], asked[6:9], strict=False)] == [5, 5, 6]


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    """What a written part holds is never asked again, however the run ends."""
    log, path = tmp_path / "log", str(tmp_path / "cache")
    log.mkdir()
    wanted = prompts(spark, 60, ("a", "1"))

    def provider_of(stop):
        def provider(model, prompt):
            n = len(list(log.iterdir()))
            if stop and n >= stop:
                raise KeyboardInterrupt
            (log / f"{prompt.replace(':', '-')}.{n}").write_text("")
            return f"B {prompt}"

        return provider

    with pytest.raises(Exception):  # noqa: B017 - the task dies
        P.answer_into(wanted, provider_of(50), path, part_rows=20)
    kept = {(r.model_id, r.row_id) for r in P.answers(spark, path).collect()}
    assert 20 <= len(kept) < 60
    before = {f.name for f in log.iterdir()}
    out = P.answer_into(wanted, provider_of(None), path, part_rows=20).collect()
    assert sorted((r.model_id, r.row_id, r.resps) for r in out) == sorted((m, i, f"B {m}:{i}") for m in ("a", "1") for i in range(60))
    asked = [tuple(f.name.split(".")[0].split("-")) for f in log.iterdir() if f.name not in before]
    assert not {(m, int(i)) for m, i in asked} & kept and len(asked) == 120 - len(kept)
    # all is there: nothing is asked
    assert P.answer_into(wanted, provider_of(1), path).count() == 120


def test_failures_are_asked_again_on_demand(spark, tmp_path):
    path, wanted = str(tmp_path / "cache"), prompts(spark, 6)

    def down(model, prompt):
        if prompt.endswith(("1", "2")):
            raise TimeoutError
        return "A"

    once = P.Retry(attempts=1)
    P.answer_into(wanted, down, path, retry=once)
    assert P.answer_into(wanted, lambda m, p: "B", path, retry=once).where("not success").count() == 2
    out = P.answer_into(wanted, lambda m, p: "B", path, retry=once, again=["timed_out"]).collect()
    assert sorted((r.row_id, r.resps) for r in out) == [(0, "A"), (1, "B"), (2, "B"), (3, "A"), (4, "A"), (5, "A")]
    assert P.answer(prompts(spark, 0), down).collect() == []


def test_structured_answers(spark):
    whole = {"question_spanish": "¿q?", "choices_spanish": dict(zip("ABCD", "abcd", strict=True)), "question_english": "q", "choices_english": dict(zip("ABCD", "wxyz", strict=True)), "more": 1}
    no_b = whole | {"choices_english": {"A": "w", "C": "", "D": "z"}}
    rows = [json.dumps(whole), f"```json\n{json.dumps(whole)}\n```", json.dumps(no_b), json.dumps(whole)[:-5], json.dumps(whole | {"choices_spanish": [1]}), None, "", "} nothing {", json.dumps({"question_spanish": " "})]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "reply long, said string, answered string")
    read = structured.read_answers(df, "said")
    got = {r.reply: r.reasons for r in read.collect()}
    assert got[0] == got[1] == [] and got[2] == ["missing choices_english.B", "empty choices_english.C"] and got[4] == ["wrong type"]
    assert got[3] == got[5] == got[6] == got[7] == ["not JSON"] and got[8][0] == "empty question_spanish" and len(got[8]) == 10
    good, quarantine = structured.parted(read)
    assert {r.reply: r.choices_english.D for r in good.collect()} == {0: "z", 1: "z"} and quarantine.count() == 7 and "answered" in quarantine.columns
