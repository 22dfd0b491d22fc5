from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, corpus
from turnflow.llm import suffix_dedup as S


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((r[0], r[1]) for r in rows):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out[i] = (len(b), len(b) - len(kept), len(re.findall(rb"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_equals_brute_force(spark, hot):
    rows = corpus(60)
    assert result(S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), hot=hot)) == brute(rows)


def test_crowded_anchor(spark):
    """One short passage in many contexts, with a group that has to flow through the first step in parts."""
    rows = [(i, f"{i:05d}" * 30 + "the common passage that stands in all of these texts and is long enough to have anchors of its own, 0123456789" + f"{i * 7:05d}" * 30) for i in range(300)]
    rows += [(1000 + i, "y" * 150 + "the common passage that stands in all of these texts") for i in range(3)]
    for hot in (2, 5000):
        assert result(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), hot=hot)) == brute(rows)


COPIED = "the one text that a great many documents hold, copied from end to end, with nothing of its own before it; 0123456789 and so on, "


def test_copies_over_batches(spark):
    """Copies meet in blocks: each loses all of the text, and no group grows with their number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        largest = []
        for n in (400, 1600):
            rows = [(i, COPIED + f"{i * 7919:09d}" * 15) for i in range(n)]
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
            texts, found = S.judged_segments(df, hot=S.HOT, block=8)
            found = found.filter(f"kind != {S.REPEAT}")
            largest.append(found.filter(f"kind in ({S.HEAD}, {S.EQUAL})").groupBy("a").count().agg({"count": "max"}).first()[0])
            assert found.filter(f"kind = {S.EQUAL}").count() > n // 20  # a copy from each batch
            assert result(S.remove_repeats(df, block=8)) == brute(rows)
            assert result(S.remove_repeats(df, hot=1, block=2)) == brute(rows)
        assert largest[0] == largest[1] <= 8
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segments_that_differ(spark, monkeypatch):
    """A segment that isn't as the first of its block is told, and then all of its anchor's are compared."""
    rows = [(S.HEAD, 1, 9, 1, b"x" * 100), (S.EQUAL, 1, 9, 2, b"x" * 100), (S.EQUAL, 1, 9, 3, b"y" * 100), (S.SHARED, 2, 9, 4, b"y" * 100)]
    kind, a, b, k, string = zip(*rows, strict=True)
    span = [int(S.pack(0, 1, 20))] * 4
    batch = pa.record_batch([pa.array(kind, pa.int32()), pa.array(a), pa.array(b), pa.array(k), pa.array([0] * 4), pa.array(span), pa.array(string)], S.CUT)
    for most in (1, 15_000):
        out = pa.Table.from_batches(S.sort_strings(100, most)([batch.slice(i, 1) for i in range(4)]))
        assert sorted(zip(out.column("kind").to_pylist(), out.column("k").to_pylist(), strict=True)) == [(S.REPEAT, 2), (S.DIFFERENT, 3)]

    rows = corpus(60)
    real, calls = S.compared, []

    def doubted(strings, length):
        calls.append(1)
        told = real(strings, length)
        return told.withColumn("kind", F.lit(S.DIFFERENT)) if len(calls) == 1 else told

    monkeypatch.setattr(S, "compared", doubted)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(S.remove_repeats(df)) == brute(rows) and len(calls) == 2


def test_odd_tables(spark):
    schema = "doc_id long, text string, kept string, k long"
    assert S.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    text = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(5))[:260]
    rows = [(None, text, "a", 1), (1, text, "b", 2), (2, text[:99], None, None), (3, None, None, None), (4, "t" + text, "c", 3), (4, "t" + text, "c", 3)]
    got = S.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 260), (2, 0), (3, 0), (4, 260), (4, 260)]


def test_texts_of_one_id(spark):
    """Texts of one id are documents of their own: what repeats in one of them is cut from it alone."""
    r = random.Random(6)
    part = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b, c = part(300), part(300), part(400)
    rows = [(1, a), (2, b + a), (2, c), (2, c), (3, c + b)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.kept_sha256) for x in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 300, 0, sha(a)), (2, 600, 300, sha(b)), (2, 400, 0, sha(c)), (2, 400, 0, sha(c)), (3, 700, 700, sha(""))])


def test_hashes_that_collide(monkeypatch):
    """Equal hashes of different segments are found out by their bytes."""
    r = random.Random(7)
    texts = ["".join(r.choice("ab") for _ in range(150)) for _ in range(6)]
    real = S.segments

    def clash(data, at, length=100, gram=24):
        text, start, count, offset, a, h, check = real(data, at, length, gram)
        return text, start, count, 0 * offset, 0 * a, 0 * h, 0 * check

    monkeypatch.setattr(S, "segments", clash)
    batch = pa.record_batch([pa.array(range(6)), pa.array([0] * 6), pa.array(texts)], ["k", "t", "text"])
    out = pa.Table.from_batches(S.cut_segments(100, 24)([batch]))
    assert all(x >= 0 for x in out.column("span").to_pylist())  # none is taken for a repeat


def test_segments_cover_every_position_once():
    r = np.random.default_rng(0)
    data = r.integers(97, 100, 5000).astype(np.uint8)
    at = np.array([0, 50, 1050, 1050, 1149, 5000])
    text, start, count, offset, a, h, check = S.segments(data, at)
    for i in range(len(at) - 1):
        mine = text == i
        places = np.concatenate([np.arange(s, s + c) for s, c in zip(start[mine], count[mine], strict=True)]) if mine.any() else np.zeros(0)
        assert places.tolist() == list(range(max(0, at[i + 1] - at[i] - 99)))


def test_merge_sort_and_collisions(monkeypatch):
    r = np.random.default_rng(1)
    strings = [bytes(r.integers(97, 99, 110).astype(np.uint8)) for _ in range(40)] + [b"a" * 110] * 5
    data = np.frombuffer(b"".join(strings), np.uint8)
    suffix = np.arange(45) * 110
    bucket = np.arange(45) % 4
    order = S.merge_sorted(data, S.Prefixes(data), suffix, bucket, 100)
    want = sorted(range(45), key=lambda i: (bucket[i], strings[i][:100], i))
    assert order.tolist() == want
    span = S.pack(np.zeros(45, np.int64), np.full(45, 11), 20)
    keys, ids = np.zeros(45, np.int64), np.arange(45)
    right = S.repeats(strings, keys, ids, 0 * ids, span, 100)
    seen, want = set(), []
    for s in strings:
        for o in range(11):
            want.append((o, s[o : o + 100]) in seen)
            seen.add((o, s[o : o + 100]))
    assert right.tolist() == want
    monkeypatch.setattr(S.Prefixes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))  # all collide
    assert S.repeats(strings, keys, ids, 0 * ids, span, 100).tolist() == want
