"""Archives, conversations, induced sorting, and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest

from gradewell.llm import chat_format, induced_sort, warc
from gradewell.llm._store import fresh_path


def test_archives_read_back(spark):
    rows = [(3, None, "same"), (1, "u\r\nx", "same"), (2, "u", None), (4, "u", ""), (5, "u", "WARC/1.0\r\n\r\n" * 3), (6, "u", "é" * 50_000), (7, "u", "x" * 2_000_000)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, value string").repartition(2)
    path = fresh_path(spark, "t")
    warc.write(df, path, file_bytes=1 << 16)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert {k: (r.kind, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    assert bytes(got[5].payload).decode() == rows[4][2] and got[6].payload_bytes == 100_000
    empty = fresh_path(spark, "t")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_a_damaged_record_is_the_only_one_lost(spark, tmp_path):
    """Two flipped bytes of a written archive cost the record that they hit, and the gap is its member."""
    df = spark.range(250).selectExpr("id as page_id", "'u' as url", "concat('page ', id, repeat(sha2(string(id), 256), 20)) as html").coalesce(1)
    path = str(tmp_path / "w")
    warc.write(df, path)
    (file,) = [f for f in (tmp_path / "w").rglob("part-*")]
    data = bytearray(file.read_bytes())
    assert gzip.decompress(bytes(data)).count(b"WARC/1.0") == 250  # an ordinary reader sees all members
    members = [r for r in warc.salvage(bytes(data))]
    hit = members[62]
    at = (hit["start"] + hit["end"]) // 2
    data[at] ^= 0xFF
    data[at + 1] ^= 0xFF
    got = list(warc.salvage(bytes(data)))
    assert {r["page_id"] for r in got if r["kind"] != "gap"} == set(range(250)) - {hit["page_id"]}
    assert [(r["start"], r["end"]) for r in got if r["kind"] == "gap"] == [(hit["start"], hit["end"])]


def test_rows_without_an_id_and_repeated_rows(spark):
    rows = [(None, "u", "a"), (None, "u", "b"), (None, "u", "b"), (4, "u", "a"), (2, "u", "a"), (2, "u", "a"), (2, "u", "c"), (9, "u", "c")]
    path = fresh_path(spark, "t")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = sorted(((r.page_id, bytes(r.payload).decode(), r.kind, r.refers_to) for r in warc.read(spark, path).collect()), key=str)
    assert got == sorted([(None, "", "revisit", 2), (None, "b", "response", None), (None, "b", "response", None), (4, "", "revisit", 2), (2, "a", "response", None), (2, "a", "response", None), (2, "c", "response", None), (9, "", "revisit", 2)], key=str)


def test_a_hot_payload_is_dealt_over_tasks(spark, monkeypatch):
    from gradewell.llm import _store

    monkeypatch.setattr(_store, "HOT", 10)
    df = spark.range(300).selectExpr("id as page_id", "'u' as url", "if(id % 3 = 0, concat('x', id), 'hot') as html")
    path = fresh_path(spark, "t")
    warc.write(df, path)
    got = {r.page_id: (r.kind, r.refers_to) for r in warc.read(spark, path).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1) for i in range(300)}


@pytest.mark.parametrize("before", [100, 4_000, 5_000, 200_000])
def test_salvage_after_any_length_of_junk(before):
    junk = bytes(random.Random(before).randrange(256) for _ in range(before))
    for parts in ([gzip.compress(r) for r in archive()], archive(), [gzip.compress(r) if i % 2 else r for i, r in enumerate(archive())]):
        got = list(warc.salvage(junk + b"".join(parts)))
        assert [r["page_id"] for r in got if r["kind"] != "gap"] == list(range(8)) and [r["end"] - r["start"] for r in got if r["kind"] == "gap"] == [before]


def test_salvage_of_many_version_lines_is_linear():
    import time

    began = time.perf_counter()
    got = list(warc.salvage(b"WARC/1.0\r\n" * 200_000 + b"".join(archive())))
    assert sum(r["kind"] == "response" for r in got) == 8 and time.perf_counter() - began < 20


def archive(n=8):
    out = []
    for i in range(n):
        body = f"payload {i}".encode() * 5
        import base64

        digest = base64.b32encode(hashlib.sha1(body).digest())
        out.append(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, digest, len(body), body))
    return out


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_skips_damage_only(packed):
    records = archive()
    parts = [gzip.compress(r) for r in records] if packed else records
    sound = list(warc.salvage(b"".join(parts)))
    assert [r["page_id"] for r in sound] == list(range(8))
    broken = list(parts)
    broken[3] = broken[3][:20] + b"\0\0\0" + broken[3][23:]
    broken[5] = broken[5][: len(broken[5]) // 2]
    got = list(warc.salvage(b"junk" + b"".join(broken)))
    assert [r["page_id"] for r in got if r["kind"] != "gap"] == [0, 1, 2, 4, 6, 7]
    gaps = [r for r in got if r["kind"] == "gap"]
    assert len(gaps) == 3 and all(r["reason"] and r["end"] > r["start"] for r in gaps)


def test_damage_in_a_long_member_keeps_what_stands_before():
    data = bytearray(gzip.compress(b"".join(archive(2000)), 1))
    data[len(data) // 2] ^= 0xFF
    got = list(warc.salvage(bytes(data)))
    assert any(r["kind"] == "gap" for r in got) and sum(r["kind"] == "response" for r in got) > 200


def test_conversations_round_trip(spark):
    rng = random.Random(2)
    bits = ["a", "\\", "<|", "<\\|", "|>", "<|im_end|>", "<|im_start|>", "<|turn|>", "\n", "assistant", "é", "<", "\\N"]
    text = lambda: rng.choice([None, "", *["".join(rng.choice(bits) for _ in range(rng.randint(1, 8))) for _ in range(6)]])
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "ro\nle<|"]), text(), "x") for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(99, t, "assistant", f"t{t}", "x") for t in range(300)] + [(100, 0, "user", "b", "x"), (100, 0, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, t string").repartition(3)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((t, role or "", x or "") for c, t, role, x, _ in rows if c == conv)
        r = got[conv]
        assert [(x.role, x.text) for x in r.turns] == [(role, x) for _, role, x in own]
        loss = [r.formatted[s.start : s.end].replace("<\\|", "<|").replace("\\\\", "\\") for s in r.loss_spans]
        assert loss == [x for _, role, x in own if role == "assistant"]
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def suffixes(text, most):
    want = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    common = [0]
    for a, b in zip(want, want[1:]):
        k = 0
        while k < most and a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        common.append(k)
    return want, common


def induced(text, most, memory):
    pos, lcp = [], []
    induced_sort.sort(np.array(text, dtype=np.uint32), lambda p, c: (pos.extend(p.tolist()), lcp.extend(c.tolist())), most, memory)
    return pos, lcp


def test_induced_sorting(monkeypatch):
    rng = random.Random(2)
    for i in range(240):
        monkeypatch.setattr(induced_sort, "BLOCK", rng.choice([1, 2, 3, 16, 1 << 17]))
        monkeypatch.setattr(induced_sort, "FAN", rng.choice([2, 3, 8]))
        text = [rng.randint(1, rng.choice([1, 2, 3, 6, 40])) for _ in range(rng.randint(0, 40 if i % 4 else 300))] + [0]
        if i % 5 == 0:
            text = text[:-1] * 3 + [0]
        most = rng.choice([1, 3, 50])
        assert induced(text, most, rng.choice([1, 200, 1 << 20])) == suffixes(text, most)


def test_induced_sorting_of_narrow_symbols():
    """Common prefixes are compared eight bytes at once: they end where they end, at the bound, and at the end of the text."""
    rng = random.Random(6)
    for _ in range(60):
        text = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        text = [*text, 4, *text[: rng.randint(0, len(text))], 0]
        most, got = rng.choice([1, 3, 4, 7, 500]), ([], [])
        induced_sort.sort(np.array(text, dtype=np.uint16), lambda p, c: (got[0].extend(p.tolist()), got[1].extend(c.tolist())), most)
        assert got == suffixes(text, most)


def test_induced_sorting_of_many_symbols_in_little_memory(monkeypatch):
    """Over 4,096 symbols, and over 4,096 names in the recursion, with queues and arrays of a few kilobytes: files hold the rest."""
    rng = random.Random(6)
    names, kept = [], induced_sort._order
    monkeypatch.setattr(induced_sort, "_order", lambda x, *a: (names.append(int(x.max()) + 1), kept(x, *a))[1])
    many = [rng.randint(1, 9000) for _ in range(16_000)] + [0]
    words = [[rng.randint(2, 90) for _ in range(rng.randint(3, 9))] + [1] for _ in range(5500)]
    few = [c for _ in range(6000) for c in rng.choice(words)] + [0]
    for text in (many, few):
        assert induced(text, 40, 1 << 12) == suffixes(text, 40)
    assert max(names) > 4096


def plain_pipeline(rows, items):
    """The pipeline in plain Python: doc_id and text of what the first four stages leave."""
    from test_documents import ALNUM, WORD, Counter, low, plain_components

    from gradewell.llm.quality_rules import STOP_WORDS

    def good(text):
        w = WORD.findall(text or "")
        times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) < 10 or 100 * len(hit) > 20 * len(w):
            return False
        lines = [x for x in text.split("\n") if WORD.search(x)]
        n, m = len(w), max(1, len(lines))
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        checks = [
            (20, 2.5 <= sum(map(len, w)) / n <= 12), (0, symbols / n <= 0.1), (20, text.count("!") / n <= 0.3), (50, sum(x.lower() in STOP_WORDS for x in w) / n >= 0.05),
            (50, (len(lines) - len(set(lines))) / m <= 0.5), (50, sum(x.lstrip(" ")[:1] in ("-", "*", "•") for x in lines) / m <= 0.9), (50, sum(x.endswith(("...", "…")) for x in lines) / m <= 0.3),
        ]
        return all(n < least or ok for least, ok in checks)

    rows = [(d, t) for d, t in rows if good(t)]
    component = {d: c for d, (_, c) in plain_components(rows, k=5).items()}
    rows = sorted({(d, t) for d, t in rows if component[d] == d})
    seen, left = set(), []
    for doc, text in rows:
        body = text.encode()
        cover = bytearray(len(body))
        for i in range(len(body) - 99):
            if body[i : i + 100] in seen:
                cover[i : i + 100] = b"\1" * 100
            seen.add(body[i : i + 100])
        at, kept = 0, []
        for c in text:
            n = len(c.encode())
            if not all(cover[at : at + n]):
                kept.append(c)
            at += n
        if kept:
            left.append((doc, "".join(kept)))
    windows = set()
    for text in items:
        w = low(text, ALNUM)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if w else 0)}
    sizes = {len(k) for k in windows}
    return {d: t for d, t in left if not any(tuple(w[k : k + n]) in windows for w in [low(t, ALNUM)] for n in sizes for k in range(len(w) - n + 1))}


def test_pipeline_equals_plain_python(spark, rows, items, tmp_path):
    """Nulls, empty and long texts, repeated rows, copies, near copies, shared passages, benchmark leaks; columns that clash with working names."""
    import zlib

    import corpus_pipeline
    from test_documents import library

    schema = "doc_id long, text string, lang string, source string, n_chars long, _words string, component string"
    twice = [r for r in rows if r[1] and len(r[1]) > 300][:6]
    leak = next(r.text for r in items.collect() if r.text and len(r.text.split()) > 12)
    more = [(1000, "".join(f"word{i} of the " for i in range(40)), "en", "s", 1, "", ""), (1001, "the beginning of it and then " + leak + " and the end of it", "en", "s", 1, "", "")]
    every = [(*r[:5], "w", "c") for r in [*rows, *twice]] + [more[0], *more]
    full = spark.createDataFrame(every, schema).repartition(4)
    full.write.parquet(str(tmp_path / "documents.parquet"))
    items.select("item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = plain_pipeline([(r[0], r[1]) for r in every], [r.text for r in items.collect()])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), full.schema)
        assert docs.columns == full.columns, name
    assert {r.doc_id: r.text for r in docs.collect()} == want and docs.count() == len(want) < len(rows)
    assert 1000 in want and 1001 not in want and all(r.n_chars == len(r.text) for r in docs.where("doc_id < 1000").collect())
    tok, pieces = library(), {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(p.doc_id, []).append(p)
    assert set(pieces) == set(want)
    for doc, own in pieces.items():
        ids = [*tok.encode(want[doc], add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    # empty tables
    empty = tmp_path / "empty"
    spark.createDataFrame([], schema).write.parquet(str(empty / "documents.parquet"))
    items.limit(0).select("item_id", "text").write.parquet(str(empty / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
