"""Operators on documents against plain Python on a small corpus with every edge case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradewell.llm import _store, decontaminate, induced_sort, license_scan, lm_scoring, minhash, packing, quality_rules, suffix_dedup, token_counts

WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text, word=WORD):
    return word.findall((text or "").translate(LOWER))


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality_counts(docs, no_docs, rows):
    got = by_id(quality_rules.judge(docs.select("doc_id", "text")))
    for doc, text, *_ in rows:
        w = WORD.findall(text or "")
        times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if times[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(no_docs.select("doc_id", "text")).count() == 0
    clash = docs.selectExpr("doc_id", "text", "1 as _text", "2 as _lines", "3 as _row", "4 as _order", "5 as _hashes", "6 as _words")
    assert {r.doc_id: (r.kept, r._text, r._row) for r in quality_rules.judge(clash).collect()} == {d: (r.kept, 1, 3) for d, r in got.items()}
    kept = quality_rules.quality_stage(docs.sparkSession, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_decontamination(docs, no_docs, items, rows):
    windows = {}
    for r in items.collect():
        w = low(r.text, ALNUM)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(r.item_id))
    got = by_id(decontaminate.match(docs, items))
    assert any(r.n_hit for r in got.values())
    for doc, text, *_ in rows:
        w, hit, found = low(text, ALNUM), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        assert (got[doc].n_words, got[doc].n_hit, got[doc]["items"]) == (len(w), len(hit), sorted(found))
    assert decontaminate.match(no_docs, items).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.match(docs, items.limit(0)).collect())


def plain_components(rows, k=4, percent=80):
    sets = {}
    for doc, text, *_ in rows:
        w = low(text)
        sets[doc] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_duplicates(spark, docs, no_docs, rows):
    got = by_id(minhash.near_duplicates(docs))
    want = plain_components(rows)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows)
    assert minhash.near_duplicates(no_docs).count() == 0
    again = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "x y", "", "", 0, 0, "", 0)], docs.schema))
    assert minhash.near_duplicates(again).count() == len(rows) + 6


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Hundreds of variants that share most shingles but seldom reach the threshold with each other: blocks must find each link."""
    import random

    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(80)] = f"v{rng.randrange(60)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(_store, "HOT", 20)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = by_id(minhash.near_duplicates(df))
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == plain_components(rows)


def test_a_bucket_of_thousands_of_classes_costs_rows_for_its_strangers_only(spark):
    """3,000 near copies and 40 strangers in one bucket: members of the large component do not meet each other."""
    members = spark.range(3040).select(F.lit(7).cast("long").alias("band"), F.col("id").alias("doc"), F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id")).cast("long").alias("component"), F.lit(0).alias("w"))
    dealt = minhash._meetings(members, "band")
    pairs = dealt.groupBy("meeting").agg(F.count_if(F.col("component") == 0).alias("own"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in pairs) < 3 * 3040 + 40 * len(pairs) and all(r.n > r.own for r in pairs)
    seen = dealt.where("component = 0").select("doc").distinct().count()
    assert seen == 3000 and len(pairs) == 1 + 12


def test_near_duplicate_stage_takes_five_words_and_one_row_of_a_document(spark):
    words = [f"w{i}" for i in range(120)]
    edited = [*words]
    for i in (20, 50, 80):
        edited[i] = "x"  # of 117 four-word shingles 105 stay (0.81 similar), of 116 five-word ones 101 (0.77)
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (2, " ".join(edited)), (3, " ".join(words))]
    left = minhash.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


def plain_repeats(rows, match=100):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows):
        body = (text or "").encode()
        cover = bytearray(len(body))
        for i in range(len(body) - match + 1):
            s = body[i : i + match]
            if s in seen:
                cover[i : i + match] = b"\1" * match
            seen.add(s)
        out[doc] = (len(body), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(x for x, c in zip(body, cover) if not c)).hexdigest())
    return out


def test_suffix_dedup(docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD", 40)
    got = by_id(suffix_dedup.remove_repeats(docs, memory=1 << 10))
    want = plain_repeats(rows)
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert any(w[1] for w in want.values())
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    text = rows[-1][1] or "x"
    nameless = docs.sparkSession.createDataFrame([(None, "z" * 300, "", "", 0, 0, "", 0), (None, text, "", "", 0, 0, "", 0)], docs.schema)
    both = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs.unionByName(nameless)).collect() if r.doc_id is not None}
    assert both == {d: w[1] for d, w in want.items()}
    left = suffix_dedup.repeat_stage(docs.sparkSession, docs, "")
    assert left.columns == docs.columns and all(r.text is None or r.n_chars == len(r.text) for r in left.collect())


def test_repeated_rows_do_not_repeat_each_other(spark, docs, rows):
    """Rows with the same doc_id and text, in one slice and in several, lose what one of them would lose."""
    more = spark.createDataFrame([(900, "a line that stands nowhere else, " + "".join(f"{i}-" for i in range(90)), "", "", 0, 0, "", 0)], docs.schema)
    once = docs.unionByName(more)
    want = plain_repeats([tuple(r) for r in once.collect()])
    for again in (once.unionByName(once), once.unionByName(once).coalesce(1)):
        got = suffix_dedup.remove_repeats(again).collect()
        assert len(got) == 2 * len(want)
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)
    left = suffix_dedup.repeat_stage(spark, more.unionByName(more), "").collect()
    assert [r.text for r in left] == [more.first().text] * 2


def test_one_id_with_two_texts_and_repeated_rows_with_spans(spark):
    """Whatever the partitions: one of the texts stands for the document, rows are as many as before, and n_removed never exceeds n_bytes."""
    long = "".join(f"{i}, " for i in range(90))
    rows = [(1, long), (2, "begin " + long + " end"), (2, "begin " + long + " end"), (3, "short"), (3, long + "x"), (3, "é" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = set()
    for n in (1, 5):
        got = suffix_dedup.remove_repeats(df.repartition(n)).collect()
        assert len(got) == len(rows) and all(r.n_removed <= r.n_bytes for r in got)
        assert sorted(r.n_removed for r in got if r.doc_id == 2)[0] == len(long)
        seen.add(tuple(sorted(map(tuple, got))))
        left = suffix_dedup.repeat_stage(spark, df.repartition(n), "").collect()
        assert sorted(r.text for r in left if r.doc_id < 3) == sorted([long, "begin  end", "begin  end"])
        near = minhash.near_duplicates(df.repartition(n)).collect()
        assert len(near) == len(rows) and {r.component_id for r in near if r.doc_id == 3} in ({3}, {1})
        seen.add(tuple(sorted(map(tuple, near))))
    assert len(seen) == 2


def test_a_crowded_anchor_is_split_until_shards_are_bounded(spark, monkeypatch):
    """A line in many documents of different text: no shard has more than PARTS * HOT regions of its anchors, and repeats are exact."""
    import random

    rng = random.Random(8)
    junk = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    lines = [junk(30), junk(96), junk(150)]
    rows = [(i, junk(rng.randint(80, 160)) + lines[i % 3] + junk(rng.randint(80, 160))) for i in range(150)]
    rows += [(200 + i, junk(10) + rows[i][1][20:]) for i in range(9)]
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    most, dealt = [], suffix_dedup._bytes

    def watched(*args):
        pieces = dealt(*args)
        most.append(pieces.groupBy("shard").count().agg(F.max("count")).first()[0] or 0)
        return pieces

    monkeypatch.setattr(suffix_dedup, "_bytes", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = by_id(suffix_dedup.remove_repeats(df))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == plain_repeats(rows)
    assert most and max(most) <= 8 * suffix_dedup.HOT


def test_windows_that_cannot_be_alike_are_not_sorted(monkeypatch):
    """Regions that share an anchor and not the bytes around it stay out of the suffix sort, and what it finds is all there is."""
    rng = random.Random(4)
    junk = lambda n: "".join(rng.choice("abcdefghij klm") for _ in range(n))
    phrase, passage = junk(60), junk(130)
    rows = [(i, junk(150) + (passage if i % 20 == 0 else phrase) + junk(150)) for i in range(60)]
    raw = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
    off = np.cumsum([0] + [len(t) for _, t in rows])
    doc, start, windows, place, anchor, _ = suffix_dedup.regions_of(raw, off)
    _, kind, times = np.unique(anchor, return_inverse=True, return_counts=True)
    x = np.flatnonzero(times[kind] > 1)
    bodies = [raw[off[doc[i]] + start[i] : off[doc[i]] + start[i] + windows[i] + 99].tobytes() for i in x]
    columns = [np.zeros(len(x), dtype=np.int64), doc[x], start[x], windows[x] * 256 + place[x]]
    shard = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bodies, pa.binary())], names=["shard", "doc", "start", "shape", "body"])
    sizes, sort = [], induced_sort.sort
    monkeypatch.setattr(induced_sort, "sort", lambda text, *args: (sizes.append(len(text)), sort(text, *args)))
    cover = {d: set() for d, _ in rows}
    # in two batches, as Spark may hand them over
    for found in suffix_dedup._of_shard([shard.slice(0, 7), shard.slice(7)], 100, 1 << 20):
        for d, a, b in zip(*(c.to_pylist() for c in found.columns), strict=True):
            cover[d] |= set(range(a, b))
    assert {d: len(c) for d, c in cover.items()} == {d: w[1] for d, w in plain_repeats(rows).items()}
    assert sum(map(len, bodies)) > 5_000 and sum(sizes) < 2_000, (sum(map(len, bodies)), sizes)
    assert not list(suffix_dedup._of_shard([shard.slice(0, 1)], 100, 1 << 20)) and len(sizes) == 1


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def test_token_counts_at_every_prefix(docs, no_docs, rows):
    tok = library()
    count = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    got = by_id(token_counts.count_tokens(docs, limit=7, prefixes=True))
    for doc, text, *_ in rows:
        text, r = text or "", got[doc]
        assert (r.n_bytes, r.n_tokens, len(r.prefix_tokens)) == (len(text.encode()), count(text), len(text) + 1)
        step = 1 if len(text) < 300 else 97
        assert all(r.prefix_tokens[i] == count(text[:i]) for i in range(0, len(text) + 1, step))
        assert count(text[: r.cut_chars]) <= 7 and (r.cut_chars == len(text) or count(text[: r.cut_chars + 1]) > 7)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_special_strings_in_long_texts():
    """Texts of special strings, cut anywhere, as the library counts them; a long one takes seconds."""
    import random
    import time

    import numpy as np

    from gradewell.llm import _bpe

    tok, rng = library(), random.Random(3)
    bpe = _bpe.load(token_counts.default_vocabulary(), "counts")
    mark = bpe.special[0]
    bits = [mark, mark[:-1], mark[1:], mark[:3], " ", "  ", "a", "it's", "\n", "é", "<|"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(60)] + [mark, mark * 3, mark[: len(mark) // 2]]
    for halves in (texts, [mark[:5], mark[5:]]):  # neighbours that make a special string together are no special string
        off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in halves])])
        for t, own in zip(halves, token_counts.prefix_counts(bpe, np.frombuffer("".join(halves).encode(), dtype=np.uint8), off)):
            assert own.tolist() == [len(tok.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    long = mark + "some words of a text, " * 45_000 + mark
    began = time.perf_counter()
    own = token_counts.prefix_counts(bpe, np.frombuffer(long.encode(), dtype=np.uint8), np.array([0, len(long)]))[0]
    assert time.perf_counter() - began < 20
    for i in (3, 14, 500, 20_000, len(long) - 2, len(long)):
        assert own[i] == len(tok.encode(long[:i], add_special_tokens=False).ids)


def test_packing_round_trip(docs, no_docs, rows):
    tok = library()
    pieces = packing.pack(docs, window=64, open_windows=4).collect()
    texts, windows = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        texts.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    for doc, text, *_ in rows:
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(texts[doc], key=lambda p: p.start)
        ids = b"".join(bytes(p.ids) for p in own)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want
        assert all(p.doc_tokens == len(want) for p in own)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64
    assert sum(p.length for p in pieces) > 0.9 * 64 * len(windows)
    assert packing.pack(no_docs).count() == 0
    r = packing.digest(packing.pack(docs)).first()
    assert r.ids_crc32 >= 0


def test_language_scores(docs, no_docs, rows):
    got = by_id(lm_scoring.score_texts(docs))
    train, words = Counter(), {}
    for doc, text, *_ in rows:
        words[doc] = [*low(text), "\n"]
        if zlib.crc32(str(doc).encode()) % 10:
            train.update(words[doc])
    n, v = sum(train.values()), len(train)
    for doc, w in words.items():
        r = got[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert r.score < 0 and r.bits_per_byte > 0
    held = [r for r in got.values() if r.held_out]
    # a few dozen texts teach little; on the test tables held-out texts score better than the base
    assert held and sum(r.score for r in held) > 1.5 * sum(r.base_score for r in held)
    assert lm_scoring.score_texts(no_docs).count() == 0


def test_every_token_is_mixed_in_its_context(spark):
    """Known words in their usual order are likelier than the same words in another one, and so are repeats within a text; bytes are the text's own."""
    line = "red fox ran over blue hill while old crow sang near deep lake"
    turned = " ".join(reversed(line.split()))
    fresh = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = {i: line for i in range(400)} | {fresh[0]: line, fresh[1]: turned, fresh[2]: turned.replace(" ", "   "), fresh[3]: "zq1vx " * 2, fresh[4]: "zq1vx wk7pd"}
    got = by_id(lm_scoring.score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)))
    usual, other, wide, again, apart = (got[i] for i in fresh[:5])
    assert usual.n_known == other.n_known == usual.n_tokens and usual.base_score == pytest.approx(other.base_score)
    assert usual.score > other.score + 3
    assert wide.score == pytest.approx(other.score) and wide.bits_per_byte == pytest.approx(-wide.score * math.log2(10) / len(texts[fresh[2]]))
    assert again.score > apart.score


def small_model(texts, rounds=3):
    import numpy as np

    from gradewell.llm import _mixing
    from gradewell.llm._words import Words

    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h, n = np.unique(Words(raw, off).hash, return_counts=True)
    codes = _mixing.Codes(h[n > 1], n[n > 1], int((n == 1).sum()), len(texts), np.bincount(raw, minlength=256))
    model, counts = _mixing.Model(), _mixing.no_counts()
    coded = _mixing.encode(codes, raw, off)
    for _ in range(rounds):
        _mixing.learn(coded, counts, model.weights, model.cells)
    model.logits = _mixing.logits_of(counts)
    return codes, model, coded


def test_scores_are_a_distribution():
    """After any words, the probabilities of all next symbols sum to one: codes are complete, and a bit splits its probability."""
    import numpy as np

    from gradewell.llm import _mixing

    codes, model, _ = small_model(["the cat of the dog the cat", "of the cat zebra", "", "quagga of"])  # three words: their last class has no unused code
    for code in (codes.length.tolist() + [codes.escape[1], codes.end[1]], codes.byte_length.tolist()):
        assert sum(2.0**-k for k in code) == 1
    value = np.append(codes.value, [codes.escape[0], codes.end[0]]).astype(np.uint32)
    length = np.append(codes.length, [codes.escape[1], codes.end[1]]).astype(np.uint8)
    n = len(value)
    for kind, value, length in ((0, value, length), (1, codes.byte_value, codes.byte_length)):
        n = len(value)
        none, context = np.zeros(n, dtype=np.uint8), np.arange(_mixing.N, dtype=np.uint32)[:, None] * np.uint32(77) + np.zeros(n, dtype=np.uint32)
        one = _mixing.Symbols(kind, value, length, context, np.full(n, value[0], dtype=np.uint32), np.full(n, length[0], dtype=np.uint8), none + np.uint8(3), np.arange(n))
        empty = _mixing.Symbols(1 - kind, *(x[..., :0] for x in (value, length, context, value, length, none, none)))
        coded = _mixing.Coded(None, None, (one, empty) if kind == 0 else (empty, one))
        assert np.exp(_mixing.score(model, coded, n)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_equal_a_plain_mixer():
    """Score of each text, bit by bit in plain Python: slots, gates, weights, refinement."""
    from gradewell.llm import _mixing as m

    texts = ["the cat of the dog the cat", "of the cat zebra", "", "dog of dog of the quagga"]
    codes, model, coded = small_model(texts)
    got = m.score(model, coded, len(texts))
    want = [0.0] * len(texts)
    for x in coded.parts:
        for i in range(len(x.value)):
            value, length = int(x.value[i]), int(x.length[i])
            for b in range(length):
                node, bit = (1 << b) | value >> (length - b), value >> (length - b - 1) & 1
                known = []
                for k in range(m.N):
                    slot = ((int(x.context[k, i]) ^ ((node * int(m.ONE) + x.kind) & 0xFFFFFFFF)) * int(m.TWO) & 0xFFFFFFFF) >> (32 - m.BITS)
                    known.append(float(model.logits[k, node if k == 0 and x.kind == 0 and b < m.BITS else slot]))
                size, sign, state = int(x.guess_length[i]), 0.0, int(x.guess_length[i] > 0)
                if size > b and (1 << b) | int(x.guess[i]) >> (size - b) == node:
                    sign, state = (1.0 if int(x.guess[i]) >> (size - b - 1) & 1 else -1.0), int(x.state[i])
                place = min(b, m.PLACES - 1)
                gate = ((x.kind * m.PLACES + place) * 4 + 2 * (known[2] != 0) + (known[1] != 0)) * m.STATES + state
                t = sum(float(w) * v for w, v in zip(model.weights[gate], [*known, sign, 0.1]))
                t = max(-m.SPREAD, min(m.SPREAD, t))
                at = (t + m.SPREAD) * (m.CELLS - 1) / (2 * m.SPREAD)
                low = min(int(at), m.CELLS - 2)
                near = lambda c: (model.cells[1, x.kind, place, c] + 20 / (1 + math.exp(m.SPREAD - c * 2 * m.SPREAD / (m.CELLS - 1)))) / (model.cells[:, x.kind, place, c].sum() + 20)  # noqa: E731, B023
                q = near(low) * (1 - at + low) + near(low + 1) * (at - low)
                p = 0.5 * (1 / (1 + math.exp(-t)) + q)
                want[int(x.text[i])] += math.log(p if bit else 1 - p)
    assert got == pytest.approx(want, rel=1e-4)


def test_final_logs_are_made_once_for_many_slices(spark, tmp_path, monkeypatch):
    """A task that scores several slices of text tables the final logarithms once, and scores are those of a table for each slice."""
    import numpy as np

    from gradewell.llm import _mixing as m

    texts = ["the cat of the dog the cat", "of the cat zebra", "", "dog of dog of the quagga"]
    _, model, coded = small_model(texts)
    want, final = m.score(model, coded, len(texts)), m.final_logs(model)
    made = []
    monkeypatch.setattr(m, "final_logs", lambda own: made.append(own) or final)
    assert np.array_equal(m.score(model, coded, len(texts), final), want) and not made
    # one task of ten slices at least, in a worker that writes down what it makes
    monkeypatch.undo()
    path = str(tmp_path / "made")

    def run(batches):
        from gradewell.llm import _mixing as own

        table = own.final_logs

        def noted(of):
            with open(path, "a") as f:
                f.write("x")
            return table(of)

        own.final_logs = noted
        try:
            yield from score(batches)
        finally:
            own.final_logs = table

    score = None
    real = type(spark.range(1)).mapInArrow

    def wrapped(self, func, schema, *args, **kwargs):
        nonlocal score
        if "rare array" not in schema:
            return real(self, func, schema, *args, **kwargs)
        score = func
        return real(self, run, schema, *args, **kwargs)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", wrapped)
    long = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("the cat of "), F.col("id").cast("string"), F.lit(" dogs ")), 80_000).alias("text")).coalesce(1)
    got = lm_scoring.score_texts(long).collect()
    assert len(got) == 12 and all(r.score < 0 for r in got)
    assert open(path).read() == "x"  # before: one for each slice


def test_every_block_is_learnt(monkeypatch):
    """Weights, refinement and counts after several blocks of words and of letters equal those of plain Python."""
    import numpy as np

    from gradewell.llm import _mixing as m

    monkeypatch.setattr(m, "BLOCK", 16)
    rare = "zebra quagga okapi gnu ibex tapir bongo nyala".split()
    _, model, coded = small_model([f"the cat of the dog of the {w} runs" for w in rare] + [""], rounds=1)
    assert [-(-len(x.value) // 16) for x in coded.parts] == [6, 3]
    counts, weights, cells = {}, m.Model().weights.astype(float), np.zeros_like(model.cells)
    for x in coded.parts:
        for start in range(0, len(x.value), 16):
            block = range(start, min(start + 16, len(x.value)))
            seen = []
            for b in range(int(x.length[block.start : block.stop].max())):
                moves = {}
                for i in (i for i in block if x.length[i] > b):
                    value, length = int(x.value[i]), int(x.length[i])
                    node, bit = (1 << b) | value >> (length - b), value >> (length - b - 1) & 1
                    known = []
                    for k in range(m.N):
                        slot = ((int(x.context[k, i]) ^ ((node * int(m.ONE) + x.kind) & 0xFFFFFFFF)) * int(m.TWO) & 0xFFFFFFFF) >> (32 - m.BITS)
                        slot = node if k == 0 and x.kind == 0 and b < m.BITS else slot
                        zero, one = counts.get((k, slot, 0), 0), counts.get((k, slot, 1), 0)
                        known.append(math.log((one + 0.4) / (zero + 0.4)))
                        seen.append((k, slot, bit))
                    size, sign, state = int(x.guess_length[i]), 0.0, int(x.guess_length[i] > 0)
                    if size > b and (1 << b) | int(x.guess[i]) >> (size - b) == node:
                        sign, state = (1.0 if int(x.guess[i]) >> (size - b - 1) & 1 else -1.0), int(x.state[i])
                    gate = ((x.kind * m.PLACES + min(b, m.PLACES - 1)) * 4 + 2 * (known[2] != 0) + (known[1] != 0)) * m.STATES + state
                    inputs = np.array([*known, sign, 0.1])
                    t = max(-m.SPREAD, min(m.SPREAD, float(weights[gate] @ inputs)))
                    p = 1 / (1 + math.exp(-t))
                    pull, bend = moves.setdefault(gate, (np.zeros(m.K), np.zeros(m.K)))
                    pull += (bit - p) * inputs
                    bend += p * (1 - p) * inputs**2
                    cells[bit, x.kind, min(b, m.PLACES - 1), int((t + m.SPREAD) * (m.CELLS - 1) / (2 * m.SPREAD) + 0.5)] += 1
                for gate, (pull, bend) in moves.items():
                    weights[gate] += 0.3 * pull / (bend + 8)
            for key in seen:
                counts[key] = counts.get(key, 0) + 1
    assert np.allclose(model.weights, weights, atol=2e-5) and np.abs(model.cells - cells).sum() <= 4
    moved = (np.abs(model.weights - m.Model().weights).sum(1) > 0).reshape(2, -1).any(1)
    assert moved.all()  # gates of words and of letters


def test_logits_of_a_block_are_made_once_a_slot(monkeypatch):
    """A block of more bits than slots takes one logarithm a slot, and learns what it learns with one for each bit."""
    import numpy as np

    from gradewell.llm import _mixing as m

    rng = np.random.default_rng(7)
    text = " ".join(f"w{i}" for i in (20_000 * rng.random(90_000) ** 2).astype(int).tolist() + list(range(20_000)) * 2)
    made, log, models = [0], np.log, []

    def counted(x, *args, **kwargs):
        made[0] += np.size(x)
        return log(x, *args, **kwargs)

    for sparse in (m.SPARSE, 0):
        monkeypatch.setattr(m, "SPARSE", sparse)
        monkeypatch.setattr(m, "logits_of", lambda counts: counts.copy())
        made[0] = 0
        monkeypatch.setattr(np, "log", counted)
        _, model, coded = small_model([text], rounds=1)
        monkeypatch.setattr(np, "log", log)
        bits, blocks = sum(int(x.length.sum()) for x in coded.parts), sum(1 for _ in m._blocks(coded))
        models.append((model, made[0], bits, blocks))
    (one, few, bits, blocks), (other, many, *_) = models
    assert bits > blocks * (1 << m.BITS) and few == m.N * blocks * (1 << m.BITS) and many == m.N * bits  # before: one for each bit
    assert np.array_equal(one.logits, other.logits) and np.array_equal(one.weights, other.weights) and np.array_equal(one.cells, other.cells)


def test_coded_words_are_found_among_like_hashes():
    """Words whose hashes share their upper bits are told apart, and those beyond either end have no code."""
    import numpy as np

    from gradewell.llm import _mixing as m

    hashes = np.array([0, 5, 6, 7, 8, 1 << 40, (1 << 63) + 1, (1 << 63) + 2, (1 << 64) - 2], dtype=np.uint64)
    codes = m.Codes(hashes[::-1].copy(), np.arange(2, 11), 1, 1, np.zeros(256, dtype=np.int64))
    asked = np.array([*hashes.tolist(), 1, 9, 1 << 41, 1 << 63, (1 << 63) + 3, (1 << 64) - 3, (1 << 64) - 1], dtype=np.uint64)
    assert codes.find(asked).tolist() == [*range(9), *[-1] * 7]
    assert codes.find(asked[:0]).tolist() == [] and m.Codes(hashes[:0], np.zeros(0, dtype=np.int64), 1, 1, np.zeros(256, dtype=np.int64)).find(asked).tolist() == [-1] * 16


def test_sums_of_many_training_tasks(spark, monkeypatch):
    """Counts in two rounds equal those of one round, whatever the number of tasks."""
    import numpy as np

    texts = [(i, f"the cat number {i % 7} of the {'dog' * (i % 3 + 1)} runs") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(9)
    models = []
    for wide in (16, 2):
        monkeypatch.setattr(lm_scoring, "WIDE", wide)
        known = df.select("text")
        codes = lm_scoring.codes_of(lm_scoring.counted(known))[0]
        models.append(lm_scoring.train(known, codes))
    assert np.array_equal(models[0].logits, models[1].logits) and np.allclose(models[0].weights, models[1].weights) and np.allclose(models[0].cells, models[1].cells)


def test_columns_named_like_measures(spark):
    df = spark.createDataFrame([(1, "some words here", 7, "x")], "doc_id long, text string, n_words int, kept string")
    (r,) = quality_rules.judge(df).collect()
    assert (r.doc_id, r.n_words, r.base_failed, r.kept) == (1, 3, True, False)
    assert quality_rules.judge(df.select("text").withColumnRenamed("text", "kept"), "kept").first().n_words == 3


def test_memo_is_bounded_in_bytes(monkeypatch):
    """Many long texts without spaces, and many different words: what is remembered stays small, and counts are right."""
    import numpy as np

    from gradewell.llm import _bpe

    bpe = _bpe.Bpe(token_counts.default_vocabulary())
    monkeypatch.setattr(bpe, "BYTES", 1 << 18)
    tok, rng = library(), random.Random(1)
    for i in range(60):
        text = "".join(rng.choice("abcdefghij") for _ in range(20_000)) + "".join(f" w{i}x{k}" for k in range(300))
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ids = list(packing.token_ids(bpe, raw, np.array([0, len(raw)])))
        if i % 20 == 0:
            assert np.frombuffer(ids[0], dtype="<u4").tolist()[:-1] == tok.encode(text, add_special_tokens=False).ids
        held = sum(len(k) + len(v) for k, v in bpe.memo.items())
        assert held <= bpe.held <= (1 << 18) + 300 * 300 and max(map(len, bpe.memo)) <= bpe.KEPT


def test_words_of_equal_polynomials_differ():
    """Two strings of which any polynomial hash modulo 2^64 is equal stay apart in word hashes, shingles and token ids."""
    import numpy as np

    from gradewell.llm import _bpe
    from gradewell.llm._words import Words, bytes_hash

    for n in (1024, 2048, 4096):
        x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        y = x.translate(str.maketrans("ab", "ba"))
        raw = np.frombuffer(f"{x} {y}".encode(), dtype=np.uint8)
        w = Words(raw, np.array([0, len(raw)]))
        assert w.hash[0] != w.hash[1] and len(set(w.shingles(1, False)[0].tolist())) == 2
        bpe = _bpe.load(token_counts.default_vocabulary(), "ids")
        own = list(packing.token_ids(bpe, np.frombuffer((x + y).encode(), dtype=np.uint8), np.array([0, n, 2 * n])))
        tok = library()
        assert [np.frombuffer(i, dtype="<u4").tolist()[:-1] for i in own] == [tok.encode(s, add_special_tokens=False).ids for s in (x, y)]
    # spans of every length up to the long ones, wherever they lie
    base = np.frombuffer(b"xyz" * 400, dtype=np.uint8)
    size = np.arange(0, 600)
    assert (bytes_hash(base, np.full(600, 0), size) == bytes_hash(base, np.full(600, 3), size + 3)).all()
    assert len(set(bytes_hash(base, np.full(600, 0), size).tolist())) == 600


def test_license_scan(spark, docs, no_docs):
    known = license_scan.registry(spark)
    texts = ["x " * 30 + license_scan.TEMPLATES["mit-text"].upper() + " y" * 50, license_scan.TEMPLATES["gpl-3.0"], "licensed under the moon", None, "", license_scan.TEMPLATES["apache-2.0"] * 3]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, least string")
    got = {(r.doc_id, r.license_id) for r in license_scan.scan(df, known).collect()}
    assert {(0, "mit-text"), (1, "gpl-3.0"), (5, "apache-2.0")} == got
    assert license_scan.scan(no_docs, known).count() == 0 and license_scan.scan(docs, known.limit(0)).count() == 0


def test_license_scan_equals_exact_containment(spark):
    """Whole, edited and cut notices anywhere in texts: the scan finds what counting the shingles of every window finds."""
    import random

    rng = random.Random(12)
    junk = lambda n: " ".join(rng.choice(["alpha", "of", "the", "software", "license", "to", "any"]) for _ in range(n))
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.translate(LOWER))
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    texts = []
    for i in range(250):
        w = words(rng.choice(list(license_scan.TEMPLATES.values())))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = "edited"
        if i % 5 == 0:
            w = w[: max(5, int(len(w) * rng.random()))]
        texts.append(f"{junk(rng.randint(0, 40))} {' '.join(w)} {junk(rng.randint(0, 40))}")
    want = {}
    for name, notice in license_scan.TEMPLATES.items():
        n, own = len(words(notice)), set(grams(words(notice)))
        step = 2 ** max(math.floor(math.log2(n - 1)) - 3, 0)
        size = math.ceil(n / step) * step
        for doc, t in enumerate(texts):
            g = grams(words(t))
            best = max((len(own & set(g[k : k + 2 * size - 4])) / len(own) for k in range(0, len(g), size)), default=0)
            if best >= license_scan.CONTAINED:
                want[doc, name] = best
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.license_id): r.containment for r in license_scan.scan(df, license_scan.registry(spark)).collect()}
    assert len(want) > 100 and got == pytest.approx(want)


def test_license_scan_of_whole_texts(spark):
    """Templates from a table, whole licenses and one of thousands of words, some of their words changed: the same as counting every window's shingles."""
    rng = random.Random(11)
    words = lambda text: [w for w in re.sub(r"[\x01-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ", text.translate(LOWER)).split(" ") if w]
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(3000))
    notices = license_scan.WHOLE | {"long": long, "tiny": "too short", "none": None}
    known = license_scan.registry_of(spark.createDataFrame(list(notices.items()), "name string, body string"), "name", "body")
    texts = []
    for name in [*license_scan.WHOLE, "long"]:
        for rate in (0, 0.02, 0.06):
            own = [w if rng.random() >= rate else f"other{rng.randrange(99)}" for w in words(notices[name])]
            texts.append(" ".join([f"x{rng.randrange(50)}" for _ in range(rng.randrange(700))] + own + [f"y{rng.randrange(50)}" for _ in range(rng.randrange(300))]))
    texts.append(" ".join(words(long)[:2000]))
    shingles = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    sizes = {r.license_id: r["class"] for r in known.collect()}
    want = {}
    for i, t in enumerate(texts):
        own = shingles(words(t))
        for name in sizes:
            c, wanted = sizes[name], set(shingles(words(notices[name])))
            best = max(len(wanted & set(own[at : at + 2 * c - 4])) / len(wanted) for at in range(0, max(1, len(own)), c))
            if best >= license_scan.CONTAINED:
                want[i, name] = best
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.license_id): r.containment for r in license_scan.scan(df, known).collect()}
    assert got == pytest.approx(want) and sizes["long"] >= 3000 and (len(texts) - 4, "long") in got and len(want) >= 2 * len(license_scan.WHOLE)


def test_license_scan_misses_no_short_notice(spark):
    """200 notices of one shingle at each place of 6,000 different texts: bands alone miss some."""
    notices = {f"n{k}": " ".join(f"n{k}{c}" for c in "abcde") for k in range(200)}
    others = lambda sign, n: F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit(sign), F.xxhash64("id", i)))
    notice = F.concat_ws(" ", *[F.concat(F.lit("n"), F.col("id") % 200, F.lit(c)) for c in "abcde"])
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", others("x", F.col("id") % 17), notice, others("y", F.lit(20))).alias("text"))
    got = license_scan.scan(df, license_scan.registry(spark, notices)).select("doc_id", "license_id").collect()
    assert {(r.doc_id, r.license_id) for r in got} == {(i, f"n{i % 200}") for i in range(6000)}


def test_license_scan_by_join(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MOST_SHINGLES", 3)
    df = spark.createDataFrame([(1, "a b " + license_scan.TEMPLATES["mit-short"])], "doc_id long, text string")
    assert [r.license_id for r in license_scan.scan(df, license_scan.registry(spark)).collect()] == ["mit-short"]


def test_all_rows_of_one_text(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same words in each of these texts " * 8).alias("text"))
    assert minhash.near_duplicates(df).where("kept").count() == 1
    removed = by_id(suffix_dedup.remove_repeats(df))
    assert all(removed[i].n_removed == removed[i].n_bytes for i in range(1, 400)) and removed[0].n_removed < removed[0].n_bytes
