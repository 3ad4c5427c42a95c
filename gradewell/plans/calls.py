"""Queries of calls to model services and of structured answers, with their SQL. The service is a rehearsal: it fails by rule, and its clock passes by waiting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.functions import structured
from gradewell.plans.catalog import query, questions, read
from gradewell.sources import providers


class Rehearsed:
    """Refuses every seventh prompt, is too busy twice for every fifth, and never answers every eleventh in time."""

    def __init__(self):
        self.asked: dict[str, int] = {}

    def __call__(self, model: str, prompt: str) -> str:
        n, times = int(prompt), self.asked.get(prompt, 0) + 1
        self.asked[prompt] = times
        if n % 7 == 0:
            raise providers.Refused("no")
        if n % 11 == 0:
            raise TimeoutError("late")
        if n % 5 == 0 and times <= 2:
            raise providers.RateLimited("busy", after=30)
        return f"{'ABCD'[n % 4]}. {model}"


@query("a15_calls", """SELECT 'm' || (p_size % 3) AS model_id, p_partkey AS row_id, CASE WHEN p_partkey % 7 = 0 THEN 'refused' WHEN p_partkey % 11 = 0 THEN 'timed_out' ELSE 'answered' END AS outcome,
 CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 11 = 0 THEN 4 WHEN p_partkey % 5 = 0 THEN 3 ELSE 1 END AS attempts,
 CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN '' ELSE substring('ABCD', CAST(p_partkey % 4 + 1 AS INTEGER), 1) || '. m' || (p_size % 3) END AS resps FROM part""")
def _(spark, d):
    prompts = questions(spark, d).select(F.lit("s").alias("question_set"), F.concat(F.lit("m"), (F.col("p_size") % 3).cast("string")).alias("model_id"), "row_id", F.col("row_id").cast("string").alias("prompt"))
    limits = {"m0": providers.Limit(60, lanes=2), "m1": providers.Limit(30, burst=3, pause=5)}
    out = providers.answer(prompts, Rehearsed(), limits=limits, retry=providers.Retry(attempts=4), clock=providers.Rehearsal())
    return out.select("model_id", "row_id", "outcome", "attempts", "resps")


A16 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS l FROM documents),
c AS (SELECT doc_id, t, l, json_object('A', t, 'B', l, 'C', CASE doc_id % 7 WHEN 4 THEN ' ' ELSE 'c' END, 'D', 'd') AS ch FROM d),
o AS (SELECT doc_id, CAST(CASE doc_id % 7 WHEN 3 THEN json_object('question_spanish', t, 'choices_spanish', 'A', 'question_english', l, 'choices_english', ch)
  WHEN 5 THEN json_object('question_spanish', t, 'choices_spanish', ch, 'choices_english', ch) ELSE json_object('question_spanish', t, 'choices_spanish', ch, 'question_english', l, 'choices_english', ch) END AS VARCHAR) AS j FROM c),
a AS (SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN left(j, length(j) - 9) WHEN 2 THEN 'Here it is:' || chr(10) || j || chr(10) || 'Done.' WHEN 6 THEN 'I cannot do that.' ELSE j END AS x FROM o),
p AS (SELECT doc_id, regexp_extract(x, '(?s)\\{.*\\}') AS j FROM a),
v AS (SELECT doc_id, CASE WHEN json_valid(j) THEN j END AS j FROM p),
f AS (SELECT doc_id, j, unnest(['question_spanish', 'choices_spanish.A', 'choices_spanish.B', 'choices_spanish.C', 'choices_spanish.D', 'question_english', 'choices_english.A', 'choices_english.B', 'choices_english.C', 'choices_english.D']) AS path, unnest(range(10)) AS k FROM v),
w AS (SELECT doc_id, j, path, k, json_extract_string(j, '$.' || path) AS value FROM f),
b AS (SELECT doc_id, CASE WHEN any_value(j) IS NULL THEN 'not JSON' WHEN json_type(any_value(j), '$.choices_spanish') <> 'OBJECT' THEN 'wrong type' ELSE string_agg(CASE WHEN value IS NULL THEN 'missing ' || path WHEN trim(value, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty ' || path END, '; ' ORDER BY k) END AS reasons,
  max(value) FILTER (path = 'question_spanish') AS question, max(value) FILTER (path = 'choices_english.A') AS first FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(reasons, '') AS reasons, CASE WHEN reasons IS NULL THEN sha256(question) END AS question, CASE WHEN reasons IS NULL THEN sha256(first) END AS first_choice FROM b
"""


@query("a16_structured_answers", A16)
def _(spark, d):
    # answers that hold the whole texts: sound ones, cut, wrapped, of a wrong type, without a field, with an empty one, and none
    t, lang, kind = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id") % 7
    choices = F.struct(t.alias("A"), lang.alias("B"), F.when(kind == 4, " ").otherwise("c").alias("C"), F.lit("d").alias("D"))
    named = lambda **fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    whole = named(question_spanish=t, choices_spanish=choices, question_english=lang, choices_english=choices)
    said = F.when(kind == 3, named(question_spanish=t, choices_spanish=F.lit("A"), question_english=lang, choices_english=choices)).when(kind == 5, named(question_spanish=t, choices_spanish=choices, choices_english=choices)).otherwise(whole)
    wrapped = F.when(kind == 1, F.left(said, F.length(said) - 9)).when(kind == 2, F.concat(F.lit("Here it is:\n"), said, F.lit("\nDone."))).when(kind == 6, "I cannot do that.").otherwise(said)
    found = structured.read_answers(read(spark, d, "documents").select("doc_id", wrapped.alias("said")), "said")
    good, quarantine = structured.parted(found)
    good = good.select("doc_id", F.lit("").alias("reasons"), F.sha2("question_spanish", 256).alias("question"), F.sha2("choices_english.A", 256).alias("first_choice"))
    return good.unionByName(quarantine.select("doc_id", F.array_join("reasons", "; ").alias("reasons")), allowMissingColumns=True)
