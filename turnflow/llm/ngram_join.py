"""N-gram Jaccard self-join by vertical partitioning, and the groups that its links form.

1. N-grams are counted over all documents: those early in the hash order, and those that are frequent in a batch.
   The global order puts the rare ones first, by hash, then the frequent ones from rare to common: a passage that
   many documents share comes last.
2. Documents with equal sets become one class. Each class is indexed under the prefix of its set in the global order
   that two sets of the wanted similarity must share an n-gram of.
3. Classes that meet in a prefix and fit by size are candidates. Few that meet are paired with each other, and
   a pair stays only if its prefixes have as many n-grams in common as its sizes call for; of many that meet, some are
   compared with all others, then those found to belong to them, and so on until no two of different groups are left
   untested: groups come out whole, without all pairs inside a group of near copies.
4. The n-grams of candidates are cut at pivots of the hash order into vertical fragments. Each fragment counts its
   part of a pair's overlap on its own, and the parts are summed per pair and compared with the exact limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import small, stored, table
from turnflow.llm.components import components

WIDTH, PERCENT = 4, 85
#: Up to so many classes under an n-gram are paired with each other at once.
FEW = 24
#: N-grams of more documents than that are frequent: the most frequent so many of them, which bounds what is sent.
FREQUENT = 2_000_000
#: They are counted if so many documents of a batch have them, and in any case in the part of the hash order that
#: prefixes mostly end in.
IN_BATCH = 16
#: Members under a crowded n-gram meet in blocks of about so many.
BLOCK = 1024
#: log2 of the number of fragments.
FRAGMENT_BITS = 3
#: Stands for a null doc_id, behind all others.
NO_ID = 2**63 - 1


def sets_of(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct hashes of the word n-grams) of each text. Fewer words than `width` make one n-gram."""
    raw, at = A.arena(texts)
    for first, end, data, offsets in A.pieces(raw, at, 1 << 18):
        starts, ends, before = A.word_spans(data, offsets)
        words = A.word_hashes(data, starts, ends, A.LOWER_VALUES)
        grams = A.window_hashes(words, width)
        for i in range(end - first):
            lo, hi = before[i], before[i + 1]
            if hi - lo >= width:
                x = np.sort(grams[lo : hi - width + 1])
                yield first + i, x[np.append(True, x[1:] != x[:-1])]
            elif hi > lo:
                yield first + i, A.window_hashes(words[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo)
            else:
                yield first + i, np.zeros(0, np.uint64)


def count_grams(width: int, percent: int, in_batch: int) -> Callable:
    """Batches of (text) to (gram, count) of the n-grams in the first part of the hash order, 1.3 times a prefix's, and
    of those that `in_batch` documents of the batch have."""
    early = np.uint64(min(2**64 - 1, int(2**64 * 1.3 * (100 - percent) / 100)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            every = np.sort(np.concatenate([s for _, s in sets_of(batch.column("text"), width)]))
            edge = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.append(edge, len(every)))
            told = np.flatnonzero((count >= in_batch) | (every[edge] < early))
            for i in range(0, len(told), 200_000):
                j = told[i : i + 200_000]
                yield pa.record_batch([pa.array(every[edge[j]].view(np.int64)), pa.array(count[j].astype(np.int32))], ["gram", "count"])

    return run


def prefix_length(n: int, percent: int) -> int:
    """So many first n-grams of a set of n: two sets of the similarity share one of them."""
    return n + (-percent * n) // 100 + 1


def index_rows(width: int, percent: int, frequent) -> Callable:
    """Batches of (id, k, text) to (id, k, n, h1, h2, rare, last, prefix); of equal sets in a batch one has its prefix. rare:
    its n-grams that aren't frequent; last: the place of the prefix's last n-gram in the global order, as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rank = frequent.value
        by_rank = np.empty_like(grams)
        by_rank[rank] = grams
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            n, h1, h2, rare, ends, prefix = [], [], [], [], [], []
            for _, s in sets_of(batch.column("text"), width):
                n.append(len(s))
                one, two = int(A.mix(s).sum()) if len(s) else 0, int(A.mix(s ^ np.uint64(A.BASE)).sum()) if len(s) else 0
                h1.append(one)
                h2.append(two)
                if len(s) and (one, two) not in seen:
                    seen.add((one, two))
                    at = np.searchsorted(grams, s)
                    often = np.zeros(len(s), bool)
                    if len(grams):
                        at = np.minimum(at, len(grams) - 1)
                        often = grams[at] == s
                    ranks = np.sort(rank[at[often]])
                    rest, size = s[~often], prefix_length(len(s), percent)
                    rare.append(len(rest))
                    ends.append(int(rest[size - 1] >> np.uint64(2)) if size <= len(rest) else 2**62 + int(ranks[size - 1 - len(rest)]))
                    prefix.append(np.concatenate((rest, by_rank[ranks]))[:size].view(np.int64))
                else:
                    rare.append(0)
                    ends.append(0)
                    prefix.append(None)
            sign = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column("id"), batch.column("k"), pa.array(n, pa.int32()), sign(h1), sign(h2), pa.array(rare, pa.int32()), pa.array(ends, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "k", "n", "h1", "h2", "rare", "last", "prefix"])

    return run


PAIR, MEMBER = 0, 1


def meet(percent: int, few: int) -> Callable:
    """Rows (gram, k, n, place), all of a gram together, to PAIR rows (a, b, times) of the classes under grams with
    few, times they meet, and MEMBER rows (gram, k, n, place) of the others."""
    names = ["kind", "a", "b", "n", "place"]

    def settle(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        gram, k, n, place = cols
        if len(gram) < 2:
            return
        edge = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.repeat(np.diff(np.append(edge, len(gram))), np.diff(np.append(edge, len(gram))))
        some = np.flatnonzero((size > 1) & (size <= few))
        if len(some):
            g, x, m, s = gram[some], k[some], n[some].astype(np.int64), size[some]
            a, b = [], []
            for d in range(1, int(s.max())):
                i = np.flatnonzero(g[d:] == g[:-d])
                i = i[(100 * np.minimum(m[i], m[i + d]) >= percent * np.maximum(m[i], m[i + d])) & (x[i] != x[i + d])]
                a.append(np.minimum(x[i], x[i + d]))
                b.append(np.maximum(x[i], x[i + d]))
            a, b = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
            z = np.zeros(len(new), np.int32)
            yield pa.record_batch([pa.array(z + PAIR), pa.array(a[new]), pa.array(b[new]), pa.array(np.diff(np.append(new, len(a))).astype(np.int32)), pa.array(z)], names)
        many = np.flatnonzero(size > few)
        if len(many):
            yield pa.record_batch([pa.array(np.full(len(many), MEMBER, np.int32)), pa.array(gram[many]), pa.array(k[many]), pa.array(n[many]), pa.array(place[many])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        flowing = None  # a gram that has gone out as one with many already
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "k", "n", "place")]
            if held is not None:
                cols = [np.concatenate((x, y)) for x, y in zip(held, cols, strict=True)]
            if flowing is not None:
                upto = int(np.searchsorted(cols[0], flowing, side="right"))
                yield pa.record_batch([pa.array(np.full(upto, MEMBER, np.int32)), *[pa.array(c[:upto]) for c in cols]], names)
                cols = [c[upto:] for c in cols]
                if not len(cols[0]):
                    held = None
                    continue
                flowing = None
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            yield from settle([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
            if len(held[0]) > max(few, 20_000):
                flowing = held[0][-1]
                yield pa.record_batch([pa.array(np.full(len(held[0]), MEMBER, np.int32)), *[pa.array(c) for c in held]], names)
                held = None
        if held is not None:
            yield from settle(held)

    return run


def fragments_of(width: int, bits: int) -> Callable:
    """Batches of (k, text) to (k, f, part): the set's hashes between the pivots f and f + 1 of the hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = (np.arange(1, 2**bits, dtype=np.uint64)) << np.uint64(64 - bits)
        for batch in batches:
            ids = batch.column("k").to_numpy(zero_copy_only=False)
            k, f, part = [], [], []
            for i, s in sets_of(batch.column("text"), width):
                for j, piece in enumerate(np.split(s, np.searchsorted(s, pivots))):
                    if len(piece):
                        k.append(ids[i])
                        f.append(j)
                        part.append(piece.tobytes())
            for i in range(0, len(k), 20_000):
                j = slice(i, i + 20_000)
                yield pa.record_batch([pa.array(k[j], pa.int64()), pa.array(f[j], pa.int32()), pa.array(part[j], pa.binary())], ["k", "f", "part"])

    return run


def count_parts() -> Callable:
    """Rows (a, f, salt, b, part), those of an (a, f, salt) together with b = a first, to (a, b, shared). Rows that repeat
    a part stand side by side and count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            a, f, salt, b, is_own = (batch.column(c).to_pylist() for c in ("a", "f", "salt", "b", "other"))
            parts = batch.column("part")
            out_a, out_b, out_n = [], [], []
            for i in range(batch.num_rows):
                key = (a[i], f[i], salt[i])
                part = np.frombuffer(parts[i].as_buffer(), np.uint64)
                if not is_own[i]:
                    now, mine = key, part.copy()
                elif key == now and len(mine) and (key, b[i]) != last:
                    last = key, b[i]
                    at = np.minimum(np.searchsorted(mine, part), len(mine) - 1)
                    shared = int(np.count_nonzero(mine[at] == part))
                    if shared:
                        out_a.append(a[i])
                        out_b.append(b[i])
                        out_n.append(shared)
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int32())], ["a", "b", "shared"])

    return run


def could_reach(times: Column, percent: int) -> Column:
    """Whether two sets can be similar enough if their prefixes meet `times` under grams with few. Behind the prefix that
    ends first, its set has n - p n-grams, and all that the two share before its end is shared by both prefixes: what they
    share there, plus n - p, must reach the overlap that the sizes call for. Meetings under crowded n-grams aren't
    counted and taken for granted."""
    behind_first = F.when(F.col("last_a") < F.col("last_b"), F.col("behind_a")).when(F.col("last_a") > F.col("last_b"), F.col("behind_b")).otherwise(F.greatest("behind_a", "behind_b"))
    most = F.least(times + F.least("crowded_a", "crowded_b") + behind_first, F.col("n_a"), F.col("n_b"))
    return 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)


def side_of(known: DataFrame, x: str) -> DataFrame:
    """The columns of one end of a pair: k is named `x`, all others end in it."""
    return known.select(*[F.col(c).alias(x if c == "k" else f"{c}_{x}") for c in known.columns])


def worth_counting(met: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough."""
    known = known.drop("rare")
    both = met.groupBy("a", "b").agg(F.sum("n").alias("times")).join(side_of(known, "a"), "a").join(side_of(known, "b"), "b")
    return both.filter(could_reach(F.col("times"), percent)).select("a", "b")


def linked(pairs: DataFrame, parts: DataFrame, sizes: DataFrame, percent: int, per_salt: int = 500) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. A class with many partners is sent to several tasks, each
    with some of them."""
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("tasks"))
    salted = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("salt"))
    others = salted.join(parts, salted.b == parts.k).select("a", "f", "salt", "b", F.lit(1).alias("other"), "part")
    own = tasks.join(parts, tasks.a == parts.k).select("a", "f", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"), F.col("a").alias("b"), F.lit(0).alias("other"), "part")
    dealt = others.union(own).repartition("a", "f", "salt").sortWithinPartitions("a", "f", "salt", "other", "b")
    overlap = dealt.mapInArrow(count_parts(), "a long, b long, shared int").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    na, nb = sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), sizes.select(F.col("k").alias("b"), F.col("n").alias("nb"))
    whole = overlap.join(na, "a").join(nb, "b")
    return whole.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def asked(state: DataFrame, seeds: int) -> DataFrame:
    """The members that aren't tested yet of grams whose open members belong to several groups, with now (tested in this
    round), main (the group with the most open members), n_open and n_rest (open members, those outside the main group).

    Tested now: members that hang together with tested ones, and of the rest the one with the fewest rare n-grams in
    each of `seeds` hash classes. Only counts and minima are taken per gram, so no task gathers a gram's members.
    """
    by_group = stored(state.groupBy("gram", "component").agg(F.count(F.when(~F.col("done"), 1)).alias("open"), F.max("done").alias("reached")).filter("open > 0"), "gram-groups")
    largest = F.max(F.struct("open", "component")).alias("largest")
    by_gram = by_group.groupBy("gram").agg(F.count("*").alias("groups"), F.sum("open").alias("n_open"), largest).filter("groups > 1")
    by_gram = stored(by_gram.select("gram", "n_open", F.col("largest.component").alias("main"), (F.col("n_open") - F.col("largest.open")).alias("n_rest")), "gram-totals")
    near = small(by_group.filter("reached").select("gram", "component", "reached"), 500_000)
    open_ = state.filter(~F.col("done")).join(small(by_gram, 500_000), "gram").join(near, ["gram", "component"], "left")
    open_ = stored(open_.withColumn("reached", F.coalesce("reached", F.lit(False))), "gram-open")
    first = open_.filter(~F.col("reached")).groupBy("gram", F.pmod(F.xxhash64("k"), F.lit(seeds)).alias("_class")).agg(F.min(F.struct("rare", "k")).alias("_first"))
    seed = first.select("gram", F.col("_first.k").alias("k"), F.lit(True).alias("seed"))
    chosen = open_.join(seed, ["gram", "k"], "left")
    return stored(chosen.withColumn("now", F.col("reached") | F.col("seed").isNotNull()).drop("reached", "seed", "done"), "gram-asked")


def crossing(these: DataFrame, those: DataFrame, n_these: Column, n_those: Column, block: int) -> DataFrame:
    """The pairs of these and those under one gram that belong to different groups. Either side is cut into blocks of
    about `block` members, and a task of the join meets one block of each."""
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    cut = lambda n: F.pmod(F.xxhash64("k"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    a = side_of(these.withColumn("i", cut(n_these)).withColumn("j", every(n_those)), "a")
    b = side_of(those.withColumn("j", cut(n_those)).withColumn("i", every(n_these)), "b")
    return a.join(b, (a.gram_a == b.gram_b) & (a.i_a == b.i_b) & (a.j_a == b.j_b) & (a.component_a != b.component_b))


def next_pairs(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Of the members asked: the pairs (a, b) of those tested now with all of other groups that can be similar enough.

    Two members of different groups aren't both of the main one. So members outside it that are tested now meet all, and
    those of the main group meet the others alone, however many copies the main group holds. A pair that met under
    a gram with few was judged there, so that the bound takes no such meeting for granted.
    """
    of_main = F.col("component") == F.col("main")
    rest, main = members.filter(F.col("now") & ~of_main), members.filter(F.col("now") & of_main)
    outer = crossing(rest, members, F.col("n_rest"), F.col("n_open"), block)
    outer = outer.filter(~F.col("now_b") | (F.col("component_b") == F.col("main_b")) | (F.col("a") < F.col("b")))
    inner = crossing(members.filter(~F.col("now") & ~of_main), main, F.col("n_rest"), F.col("n_open"), block)
    both = outer.union(inner.select(*outer.columns))
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))  # if this gram is the first in common
    fits = 100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)
    return both.filter(fits & could_reach(F.lit(0), percent)).select("a", "b").distinct()


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: components of the components that they join."""
    of = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    joined = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    again = stored(components(stored(joined.filter("a <> b"), "gram-joins")), "gram-merged").select(F.col("node").alias("component"), F.col("component").alias("_c"))
    moved = label.join(again, "component", "left").select("node", F.coalesce("_c", "component").alias("component"))
    fresh = again.select(F.col("component").alias("node"), F.col("_c").alias("component")).join(label.select("node"), "node", "left_anti")
    return stored(moved.union(fresh), "gram-labels")


def text_key() -> list[Column]:
    """id and text without nulls, and the key of a text of an id: an id on several texts has a set for each."""
    id_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [id_.alias("id"), text.alias("text"), F.xxhash64(id_, text).alias("k")]


def labelled_texts(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, few: int = FEW, frequent: int = FREQUENT, in_batch: int = IN_BATCH, bits: int = FRAGMENT_BITS, block: int = BLOCK) -> DataFrame:
    """(id, k, n, rep, c, component) of every row of docs: its text's key, its set's size, class and group, and the group's least id.

    Rows without n-grams are alone, with a null rep and c.
    """
    spark = docs.sparkSession
    texts = docs.select(*text_key())
    counts = texts.select("text").mapInArrow(count_grams(width, percent, in_batch), "gram long, count int").groupBy("gram").agg(F.sum("count").alias("count"))
    crowded = stored(counts.filter(F.col("count") > few), "gram-counts")
    often = crowded.orderBy(F.desc("count"), "gram").limit(frequent).toPandas()
    grams = often["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    by_count = np.lexsort((grams[order], often["count"].to_numpy(np.int64)[order]))
    rank = np.empty(len(grams), np.int32)
    rank[by_count] = np.arange(len(grams), dtype=np.int32)
    known = spark.sparkContext.broadcast((grams[order], rank))

    rows = stored(texts.select("id", "k", "text").mapInArrow(index_rows(width, percent, known), "id long, k long, n int, h1 long, h2 long, rare int, last long, prefix array<long>"), "gram-sets")
    # a class: the key of its least document, and the one whose prefix stands for it
    holder = F.min(F.when(F.col("prefix").isNotNull(), F.struct("k", "rare", "last"))).alias("holder")
    classes = rows.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "k")).alias("least"), holder)
    classes = stored(classes.select("h1", "h2", "n", F.col("least.id").alias("id"), F.col("least.k").alias("rep"), F.col("holder.k").alias("holder"), "holder.rare", "holder.last"), "gram-classes")
    # prefixes hold the rare n-grams first. Frequent ones are counted before they meet, so that crowded ones never do
    held = rows.filter("prefix IS NOT NULL").select("k", "h1", "h2", "rare", "prefix")
    own = classes.select("h1", "h2", "n", "rep", F.col("holder").alias("k"))

    def placed(part: DataFrame) -> DataFrame:
        one = part.dropDuplicates(["k", "h1", "h2"]).join(own, ["k", "h1", "h2"])
        return one.select("rep", "n", "first", F.posexplode("prefix").alias("place", "gram")).select("gram", F.col("rep").alias("k"), "n", (F.col("place") + F.col("first")).alias("place"))

    often_ = placed(held.filter(F.size("prefix") > F.col("rare")).withColumn("prefix", F.expr("slice(prefix, rare + 1, size(prefix) - rare)")).withColumn("first", F.col("rare")))
    often_ = stored(often_, "gram-frequent")
    seldom = placed(held.withColumn("prefix", F.expr("slice(prefix, 1, rare)")).withColumn("first", F.lit(0)))
    full = small(stored(often_.groupBy("gram").count().filter(F.col("count") > few).select("gram"), "gram-crowded"), frequent)
    ready = seldom.union(often_.join(full, "gram", "left_anti"))
    met = stored(ready.repartition("gram").sortWithinPartitions("gram").mapInArrow(meet(percent, few), "kind int, a long, b long, n int, place int"), "gram-meetings")

    facts = classes.groupBy(F.col("rep").alias("k")).agg(F.max("n").alias("n"), F.max("rare").alias("rare"), F.max("last").alias("last"))
    members = met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("gram"), F.col("b").alias("k"), "place")
    members = stored(members.union(often_.join(full, "gram", "left_semi").select("gram", "k", "place")), "gram-crowds")
    crowded = members.groupBy("k").agg(F.count("*").alias("crowded"))
    behind = F.ceil(F.lit(percent) * F.col("n") / 100).cast("long") - 1
    known = facts.join(crowded, "k", "left").select("k", "n", "rare", "last", F.coalesce("crowded", F.lit(0)).alias("crowded"), behind.alias("behind"))
    members = stored(members.join(known, "k"), "gram-members")
    pairs = stored(worth_counting(met.filter(F.col("kind") == PAIR), known, percent), "gram-pairs")
    sizes = facts.select("k", "n")
    needed = stored(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).union(members.select("k")).distinct(), "gram-candidates")
    wanted = texts.select("k", "text").join(small(needed, 2_000_000), "k", "left_semi")
    parts = stored(wanted.mapInArrow(fragments_of(width, bits), "k long, f int, part binary"), "gram-fragments")

    member_of = rows.filter("n > 0").select("id", "k", "n", "h1", "h2").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"])
    member_of = stored(member_of.select("id", "k", "n", "rep"), "gram-class-members")
    # the classes of an id on several texts hang together; no id is none
    several = member_of.filter(F.col("id") != NO_ID).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("id", "a")
    same_id = member_of.join(several, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    links = stored(linked(pairs, parts, sizes, percent).union(same_id), "gram-links")
    if members.limit(1).count():
        done = None
        seeds = 4
        label = components(links)
        while True:
            state = members.join(label.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
            state = state.withColumn("done", F.lit(False)) if done is None else state.join(done.withColumn("done", F.lit(True)), ["gram", "k"], "left").fillna(False, subset=["done"])
            step = asked(state, seeds)
            tested = step.filter("now").select("gram", "k")
            if not tested.limit(1).count():
                break
            label = merged(label, linked(stored(next_pairs(step, percent, block), "gram-pairs"), parts, sizes, percent))
            done = tested if done is None else done.union(tested)
            seeds *= 16
    else:
        label = components(links)

    named = classes.select("rep", "id").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "id", F.coalesce("component", "rep").alias("c"))
    least = stored(named.groupBy("c").agg(F.min("id").alias("component")), "gram-least")
    joined = member_of.join(named.join(small(least, 2_000_000), "c").select("rep", "c", "component"), "rep").select("id", "k", "n", "rep", "c", "component")
    none = F.lit(None).cast("long")
    return joined.union(rows.filter("n = 0").select("id", "k", "n", none, none, F.col("id")))


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two documents link if the Jaccard similarity of their sets of lower-cased word n-grams is at least `percent` in a
    hundred; component_id is the least doc_id that links reach. Fewer words than `width` make one n-gram; without
    words, or with a null text, a document links with none. Texts are taken whole, however long. A null doc_id counts as greater
    than all others; rows without id are documents of their own, and component_id is null where none of a group has one. Rows
    that repeat a doc_id with its text count once; an id on several texts is in one group with all that each links to. Other
    columns of docs aren't read.
    """
    clean = lambda c: F.nullif(c, F.lit(NO_ID))
    return labelled_texts(docs, width, percent, **options).select(clean("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), clean("component").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """One document of each group: the one with the least doc_id, and of rows without id the one with the least key of its
    text. Where that id stands on several texts, one row of each different set stays; rows that repeat a document go. Documents
    without words are copies of none. All columns stay, whatever their names; of rows that differ in other columns
    than id and text the one with the greatest hash of them stays.
    """
    found = stored(labelled_texts(docs, width, percent, **options), "gram-labels-of-texts")
    first = F.when(F.col("id") != NO_ID, F.col("rep"))
    kept = found.filter("c IS NOT NULL AND id = component").groupBy("c", first.alias("first")).agg(F.min("k").alias("k")).select("k")
    gone = stored(found.filter("c IS NOT NULL").select("k").distinct().join(kept, "k", "left_anti"), "gram-gone")
    twice = stored(found.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k").join(gone, "k", "left_anti"), "gram-twice")
    plain = [F.col(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), text_key()[2], F.xxhash64(*plain).alias("rest"))
    once = rows.join(small(gone.union(twice), 2_000_000), "k", "left_anti").select("row.*")
    again = rows.join(small(twice, 2_000_000), "k", "left_semi").groupBy("k").agg(F.max_by("row", "rest").alias("row")).select("row.*")
    return once.union(again)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 2)) AS i)
  UNION ALL SELECT doc_id, concat(len(w), '|', array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 3
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
