"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gradewell.llm.license_scan import ALL, CONTAINED
from gradewell.llm.quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens FROM t),
s AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars,
  length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\N')) AS role_chars FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens THEN 12 + role_chars + 1 + 11 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT *, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((CAST(('0x' || substr(d, CAST((k // 4) * 5 + 1 AS BIGINT), 5)) AS INTEGER)) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM s
"""


def _rules() -> str:
    out = []
    for r in RULES:
        bounds = [f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None)
        out.append(f"(n_words < {r.min_words} OR ({' AND '.join(bounds)}))")
    return " AND ".join(out)


QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  greatest(len(ws), 1) AS nw, greatest(len(ls), 1) AS nl, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs,
  len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in sorted(set(STOP_WORDS)))}))) AS stops,
  len(list_filter(ls, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•'))) AS bullets, len(list_filter(ls, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS ends FROM w LEFT JOIN c USING (doc_id)),
q AS (SELECT *, word_chars / nw AS mean_word_length, n_symbols / nw AS symbol_ratio, bangs / nw AS bang_ratio, stops / nw AS stop_word_ratio,
  n_dup_lines / nl AS duplicate_line_ratio, bullets / nl AS bullet_line_ratio, ends / nl AS ellipsis_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM q
"""

LEAKS = rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS ws FROM documents),
dw AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


#: The patterns of the secret rules, each with the words in either case spelled out; a match is marked, and its place is what stands before the mark.
_SECRET = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 0, 0),
    ("github", "gh[opsru]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)
_MARKED = " UNION ALL ".join(
    rf"SELECT doc_id, {i} AS place, '{kind}' AS kind, {least} AS least, {group} AS g, string_split(regexp_replace(t, '{pattern}', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM d"
    for i, (kind, pattern, group, least) in enumerate(_SECRET)
)
_GROUP = _SECRET[0][1]
SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({_MARKED}),
c AS (SELECT doc_id, place, kind, least, g, parts, unnest(range(2, len(parts) + 1)) AS k FROM p WHERE len(parts) > 1),
m AS (SELECT doc_id, place, kind, least, g, split_part(parts[k], chr(57345), 1) AS s, CAST(list_sum(list_transform(parts[1:k - 1], lambda x: length(replace(x, chr(57345), '')))) AS BIGINT) AS a FROM c),
f AS (SELECT doc_id, place, kind, a, a || ':' || (a + length(s)) AS span FROM m WHERE CASE WHEN g = 2 THEN length(regexp_extract(s, '{_GROUP}', 2)) ELSE length(s) END >= least),
n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || span, ',' ORDER BY a, place) FILTER (place < 3) AS base, string_agg(kind || ':' || span, ',' ORDER BY a, place) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (doc_id)
"""

def _repair() -> str:
    """Rows of each conversation go through a list of four cells in order; a cell is the cost in six digits, the audit, a mark that sorts first, and the repaired rows."""
    crc_bit = "CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: {crc_bit})), 4294967295)"

    def grown(cell: str, cost: int | str, letter: str, row: str = "NULL") -> str:
        said = f"split_part({cell}, chr(1), 2) || CASE WHEN {row} IS NULL THEN '' ELSE chr(10) || {row} END" if row != "NULL" else f"split_part({cell}, chr(1), 2)"
        return f"lpad(CAST(CAST(left({cell}, 6) AS INT) + {cost} AS VARCHAR), 6, '0') || substr(split_part({cell}, chr(1), 1), 7) || '{letter}' || chr(1) || {said}"

    def inserted(v: str) -> str:
        """Inserts after which u, then ua, then aua have been said."""
        u = lambda c: grown(c, 3, "I", "'user:'")
        a = lambda c: grown(c, 3, "I", "'assistant:'")
        return f"list_transform([{v}], lambda q: [q[1], q[2], least(q[3], {u('q[1]')}, {u('q[2]')}, {u('q[4]')}), q[4]])", f"lambda q: [q[1], q[2], q[3], least(q[4], {a('q[3]')})]", f"lambda q: [q[1], q[2], least(q[3], {u('q[4]')}), q[4]]"

    def closed(v: str) -> str:
        first, second, third = inserted(v)
        return f"list_transform(list_transform({first}, {second}), {third})[1]"

    keep = lambda c, kind: f"CASE WHEN r.kind = '{kind}' AND r.stays THEN {grown(c, 'r.cut', 'K', 'r.line')} END"
    name = lambda c, who: f"CASE WHEN r.stays THEN {grown(c, '3 + r.cut', 'R', f"('{who}:' || r.text)")} END"
    drop = lambda c: grown(c, 4, "D")
    step = f"""list_transform([{closed("acc")}], lambda v: [{drop("v[1]")}, least({drop("v[2]")}, {keep("v[1]", "s")}),
      least({drop("v[3]")}, {", ".join(f(f"v[{i}]", w) for i in (1, 2, 4) for f, w in ((keep, "u"), (name, "user")))}),
      least({drop("v[4]")}, {keep("v[3]", "a")}, {name("v[3]", "assistant")})])[1]"""
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {crc} % 20 AS f FROM c),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM h),
o AS (SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
l AS (SELECT conv_id, pos, {{'kind': left(role, 1), 'stays': fault NOT IN ('blank', 'duplicate'), 'cut': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'line': role || ':' || text, 'text': text}} AS r FROM m),
g AS (SELECT conv_id, greatest(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY conv_id),
p(conv_id, pos, acc) AS (SELECT conv_id, 0::BIGINT, ['000000' || chr(1), NULL, NULL, NULL] FROM g UNION ALL SELECT p.conv_id, l.pos, {step} FROM p JOIN l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.pos = p.pos + 1),
e AS (SELECT conv_id, pos, {closed("acc")} AS v FROM p), b AS (SELECT conv_id, pos, least(v[1], v[4]) AS best FROM e)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 6) AS BIGINT), 0) AS cost,
  coalesce(substr(split_part(best, chr(1), 1), 7), '') AS audit, sha256(coalesce(substr(split_part(best, chr(1), 2), 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.pos = g.n
"""


def _licenses() -> str:
    """The share of each template's five-word shingles in every window of its class, counted without bands."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in ALL.items())
    words = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x01-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH t AS (SELECT license_id, {words.format("notice")} AS ws FROM (VALUES {rows}) AS v(license_id, notice)),
z AS (SELECT license_id, ws, len(ws) AS n, CAST(pow(2, greatest(floor(log2(len(ws) - 1)) - 3, 0)) AS BIGINT) AS step FROM t WHERE len(ws) >= 5),
c AS (SELECT license_id, ws, CAST(ceil(n / step) * step AS BIGINT) AS class FROM z),
g AS (SELECT DISTINCT license_id, class, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS k FROM c)),
s AS (SELECT license_id, count(*) AS size FROM g GROUP BY 1),
d AS (SELECT doc_id, {words.format("text")} AS ws FROM documents),
o AS (SELECT doc_id, k - 1 AS i, array_to_string(ws[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS k FROM d WHERE len(ws) >= 5)),
h AS (SELECT doc_id, license_id, class, g, i, i // class AS w FROM o JOIN g USING (g)),
b AS (SELECT doc_id, license_id, class, g, i, w FROM h UNION SELECT doc_id, license_id, class, g, i, w - 1 FROM h WHERE w > 0 AND i <= (w + 1) * class - 5),
f AS (SELECT doc_id, license_id, class, w, count(DISTINCT g) AS found FROM b GROUP BY ALL)
SELECT doc_id, license_id, max(found / size) AS containment, count(*) AS n_windows, min(w * class) AS first_word FROM f JOIN s USING (license_id) WHERE found / size >= {CONTAINED} GROUP BY doc_id, license_id
"""


#: Every 100 bytes of every text by their digest; all but the first place of each are covered, and what covers touches is one run.
REPEATS = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, md5_number(hex(b[s + 1:s + 100])) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS s FROM d)),
c AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
g AS (SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL AS opens FROM c),
i AS (SELECT doc_id, s, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM g),
r AS (SELECT doc_id, k, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY ALL),
n AS (SELECT doc_id, k, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
t AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last FROM n GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS kept FROM n JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[last + 1:octet_length(b)]))) END AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN p USING (doc_id)
"""


SQL = {"op8_suffix_dedup": REPEATS, "op10_license_scan": _licenses(), "op11_conversation_repair": _repair(), "op12_secret_scan": SECRETS, "op2_chat_format": CHAT, "op3_warc": WARC, "op5_quality_rules": QUALITY, "op6_decontaminate": LEAKS, "op7_minhash_dedup": NEAR}
