"""The path and replay queries beside plain Python, over all customers and with all draws."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from turnflow import queries as Q
from turnflow.constants import BUCKETS
from turnflow.functions.numbers import PRIME, ROUNDS
from turnflow.operators import distributions as D


def customers(duck):
    code = lambda i: f"N{i % 24:02d}"
    return {c: ([code(c), code(c // 24), code(c * 5 + 1)], float(c * 13 % 75)) for (c,) in duck.execute("SELECT c_custkey FROM customer").fetchall()}


def test_every_customer_asks(spark, sf_dir, duck):
    want = customers(duck)
    assert len(want) > 40
    got = {r.path_id: r.path for r in Q.QUERIES["parse_path"](spark, sf_dir).collect()}
    assert got == {c: ",".join(path) for c, (path, _) in want.items()}
    known = {r.airport for r in Q.Tables(spark, sf_dir).node_dist.select("airport").collect()}
    valid = {r.path_id: r.is_valid for r in Q.QUERIES["validate_path"](spark, sf_dir).collect()}
    assert valid == {c: set(path) <= known for c, (path, _) in want.items()}


class Brute:
    """The simulation from its definition, with as many draws as the reference takes."""

    DRAWS = 2000

    def __init__(self, t):
        legs = t.stored_propagation
        self.edges = self.pools(t.edge_dist, ("origin", "dest"), "arr_delay_samples")
        self.nodes = self.pools(t.node_dist, ("airport",), "dep_delay_samples")
        self.over_edges = {r.bucket: r.arr_delay_samples or [] for r in D.network_edge_dist(legs).collect()}
        self.over_nodes = {r.bucket: r.dep_delay_samples or [] for r in D.network_node_dist(legs).collect()}
        self.known = {k[0] for k in self.nodes}

    @staticmethod
    def pools(dist, keys, samples):
        out = {}
        for r in dist.collect():
            out.setdefault(tuple(r[k] for k in keys), {})[r.bucket] = (r[samples] or [], r.is_fallback)
        return out

    @staticmethod
    def bucket(x):
        return next((b for b, low, high in BUCKETS if (low is None or x >= low) and (high is None or x <= high)), None)

    @classmethod
    def number(cls, number, hop, step):
        v = (np.arange(cls.DRAWS, dtype=np.int64) * 1000003 + (number * 7919 + hop * 613 + step * 31) % PRIME) % PRIME
        for m, s in ROUNDS:
            v = ((v ^ (v >> s)) * m) % PRIME
        return v.tolist()

    def resample(self, draws, own, network, numbers):
        out, fallback, thin = [], False, False
        for x, u in zip(draws, numbers, strict=True):
            b = None if x is None else self.bucket(x)
            pool, blended = own.get(b, ([], False))
            fallback |= x is not None and not pool
            thin |= bool(pool) and blended
            pool = pool or network.get(b, [])
            out.append(pool[u % len(pool)] if pool else None)
        return out, fallback, thin

    def stops(self, path, start):
        number = int(hashlib.md5(f"{'-'.join(path)}|{self.bucket(start)}".encode()).hexdigest()[:13], 16) % PRIME
        draws = [start] * self.DRAWS
        for hop in range(1, len(path)):
            draws, fallback, thin = self.resample(draws, self.edges.get((path[hop - 1], path[hop]), {}), self.over_edges, self.number(number, hop, 0))
            yield hop, path[hop], path[hop - 1], draws, fallback, thin
            if hop + 1 < len(path):
                draws, _, _ = self.resample(draws, self.nodes.get((path[hop],), {}), self.over_nodes, self.number(number, hop, 1))


@pytest.fixture(scope="module")
def brute(spark, sf_dir):
    return Brute(Q.Tables(spark, sf_dir))


def test_simulated_paths(spark, sf_dir, duck, brute):
    want = {}
    for c, (path, start) in customers(duck).items():
        if set(path) <= brute.known:
            for hop, to, origin, draws, *flags in brute.stops(path, start):
                want[c, hop] = (to, origin, ",".join(map(str, draws)), *flags)
    got = {(r.path_id, r.hop): (r.airport, r.origin, r.draws, r.used_route_fallback, r.used_thin_pool) for r in Q.QUERIES["simulate_paths"](spark, sf_dir).collect()}
    assert want and got == want
    first = {r.path_id: (r.draws, r.used_route_fallback) for r in Q.QUERIES["edge_step"](spark, sf_dir).collect()}
    assert first == {c: (x[2], x[3]) for (c, hop), x in want.items() if hop == 1}
    turned = Q.QUERIES["node_step"](spark, sf_dir).collect()
    assert len(turned) == len(first) and all(len(r.draws.split(",")) == Brute.DRAWS for r in turned)
