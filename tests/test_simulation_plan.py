"""How the simulation is dealt out: by its cost, with the pools in use, sent or grouped, to the same draws."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnflow import queries as Q
from turnflow.constants import BUCKETS
from turnflow.operators import simulate as M

NAMES = [b[0] for b in BUCKETS]


@pytest.fixture(scope="module")
def world(spark):
    """Many routes with pools, and paths over a few of them."""
    r = random.Random(5)
    codes = [f"C{i:02d}" for i in range(30)]
    pool = lambda: [r.randint(-5, 90) for _ in range(r.randint(1, 9))]
    edges = spark.createDataFrame([(o, d, b, r.random() < 0.3, pool()) for o in codes for d in codes if o != d for b in NAMES if r.random() < 0.9], "origin string, dest string, bucket string, is_fallback boolean, arr_delay_samples array<int>")
    nodes = spark.createDataFrame([(a, b, False, pool()) for a in codes for b in NAMES], "airport string, bucket string, is_fallback boolean, dep_delay_samples array<int>")
    over = lambda s: spark.createDataFrame([(b, pool()) for b in NAMES], f"bucket string, {s} array<int>")
    few = codes[:6]
    paths = [(k, [few[0], few[1], *[r.choice(few) for _ in range(r.randint(0, 5))]] if k % 3 else [r.choice(few) for _ in range(r.randint(1, 4))], float(r.randint(-3, 80))) for k in range(150)]
    return spark.createDataFrame(paths, "path_id long, path array<string>, start_delay double"), nodes, edges, over("dep_delay_samples"), over("arr_delay_samples"), few


def stops(df):
    return {r.path_id: r.stops for r in df.collect()}


@pytest.mark.parametrize("keep", ["draws", "turns", "percentiles"])
def test_sent_and_grouped_pools_agree(world, keep):
    *tables, _ = world
    want = stops(M.simulate_paths(*tables, 40, keep))
    assert sum(len(s or []) for s in want.values()) > 300
    for legs in (1, 50, 10_000):  # the hot first leg in many parts, in some, and whole
        assert stops(M.simulate_paths(*tables, 40, keep, sent_bytes=0, group_legs=legs)) == want


def test_only_pools_in_use_are_sent(spark, world, monkeypatch):
    paths, nodes, edges, net_n, net_e, few = world
    sent = []
    real = M.keyed_pools
    monkeypatch.setattr(M, "keyed_pools", lambda rows, keys: sent.append(real(rows, keys)) or sent[-1])
    M.simulate_paths(paths, nodes, edges, net_n, net_e, 8).count()
    routes, airports = sent
    used = {(o, d) for r in paths.collect() for o, d in zip(r.path, r.path[1:], strict=False)}
    inner = {c for r in paths.collect() for c in r.path[1:-1]}
    assert len(used) < 40 and set(routes) == {k for k in used if k[0] != k[1]} and {k[0] for k in airports} == inner
    assert edges.select("origin", "dest").distinct().count() > 800


def test_pools_over_the_bound_are_grouped(world, monkeypatch):
    """The switch counts the bytes of the pools in use."""
    *tables, _ = world
    calls = []
    real = M.grouped_walk
    monkeypatch.setattr(M, "grouped_walk", lambda *a: calls.append(1) or real(*a))
    M.simulate_paths(*tables, 4, sent_bytes=100_000)
    assert not calls
    M.simulate_paths(*tables, 4, sent_bytes=2_000)
    assert calls


def test_work_is_dealt_by_cost(spark, sf_dir):
    """Few bytes, much work: still in two parts a core, and in more where draws and hops call for them."""
    work = spark.range(2000).select(F.array(F.lit("A"), F.col("id").cast("string"), F.lit("B")).alias("path"), F.lit(0).alias("bucket_no"), F.col("id").alias("number")).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    held = lambda df: [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    parts = held(M.dealt(work, 2000))
    assert len(parts) == 2 * cores and max(parts) < 1.5 * min(parts)
    assert len(held(M.dealt(work, 2000, per_task=200_000))) == 40
    assert len(held(M.dealt(work.limit(3), 2000))) == 3 and held(M.dealt(work.limit(0), 2000)) == []
    tables = Q.Tables(spark, sf_dir)
    rotations = tables.rotations.select("path", F.lit(0).alias("bucket_no"), F.lit(1).alias("number"))
    assert len(held(M.dealt(rotations, 2000))) >= cores


@pytest.mark.parametrize("sent", [0, 100])
def test_requests_of_one_id(spark, sent):
    paths = spark.createDataFrame([(1, ["A", "X", "X"]), (1, ["A", "B"]), (1, ["Y", "A", "X"]), (2, []), (2, ["A", "B"]), (None, ["Z", "A"])], "path_id long, path array<string>")
    known = spark.createDataFrame([("A",), ("B",), ("B",)], "airport string")
    got = sorted((r.path_id or 0, r.path, r.unknown_codes, r.is_valid) for r in M.validate_path(paths, known, sent).collect())
    assert got == [(0, ["Z", "A"], ["Z"], False), (1, ["A", "B"], [], True), (1, ["A", "X", "X"], ["X"], False), (1, ["Y", "A", "X"], ["X", "Y"], False), (2, [], [], False), (2, ["A", "B"], [], True)]


def test_summaries_are_made_once_for_each_path(spark, sf_dir, tmp_path):
    """Of 20 times the requests for the same paths as many stops come out, each as of the first copy, and hardly more is stored."""
    copies, step = 20, 14_400  # after so many keys paths and start delays come again
    for t in ("events", "nation", "region"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf_dir}/{t}.parquet")
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    keys.crossJoin(spark.range(copies)).select((F.col("c_custkey") + step * F.col("id")).alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))

    def told(name, folder):
        """Rows, and the bytes that were stored for them."""
        before = set(getattr(spark, "_turnflow_stored", []))
        rows = [r.asDict() for r in Q.QUERIES[name](spark, str(folder)).collect()]
        return rows, sum(f.stat().st_size for path in set(spark._turnflow_stored) - before for f in Path(path).rglob("*.parquet"))

    for name in ("summarize_stops", "fan_table", "fallback_hops"):
        (few, small), (many, large) = told(name, sf_dir), told(name, tmp_path)
        key = lambda rows: sorted(repr(sorted({**r, "path_id": r["path_id"] % step}.items())) for r in rows if name != "fan_table" or r["hop"])
        assert few and key(many) == sorted(key(few) * copies)
        assert large < 2 * small


def test_summary_of_draws_and_of_percentiles(world):
    """The same stops from the draws as from what the walk made of them, those of requests for one path included; stops with a missing draw are left out of both."""
    paths, nodes, edges, net_n, net_e, _ = world
    asked = paths.union(paths.withColumn("path_id", F.col("path_id") + 1000))
    over = [d.filter("bucket != '60_plus'") for d in (net_n, net_e)]
    key = lambda keep: sorted(map(repr, M.summarize_stops(M.simulate_paths(asked, nodes, edges, *over, 40, keep)).collect()))
    assert len(key("draws")) > 400 and key("percentiles") == key("draws")
