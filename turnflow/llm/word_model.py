"""Perplexity of documents under a modified Kneser-Ney model of word pairs that never saw the document's own fold.

Contexts are the words before themselves, by their own hash of WORD_BITS bits like the words after them: no two contexts share
counts. Documents are dealt into two folds by the least hash of their word triples, so that copies and most near copies
fall into the same one; each fold is scored by the counts of the other.

1. Frequent words are found in a first pass (at most 2 x FREQUENT, of them 2 x HOT common ones). They get small numbers, so that
   they take little room; other words keep their hashes.
2. Each task writes the distinct pairs of its documents with their counts as sorted, difference-coded arrays, cut into buckets
   by word. A bucket has all pairs of its words, and so their continuation counts. It says what it saw of counts of
   counts, of frequent words and of common contexts, and tells each bucket of step 3 the continuation counts of
   the words that occur there: bare numbers in the order of the words, as both sides know which words those are.
3. The pairs go out again, now by context and with the documents that hold them. A bucket has all pairs of its contexts, and
   so their sums; with the continuation counts from step 2 it scores each pair and sends back one number per
   document. Sums of a task's documents meet again by task.

Common words are spread over all buckets by the other word of the pair, with their sums from step 2. Only what is known of
frequent words is sent to all tasks, at most 2 x FREQUENT of them whatever the vocabulary; pairs and documents never are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import stored

#: Bits of a word's hash; the numbers of frequent words are below PLAIN, where the others' begin.
WORD_BITS = 40
PLAIN = 1 << 20
#: A word of more than one in HOT of all words is spread over the buckets, one of more than one in FREQUENT gets a small number;
#: a task tells of those of one in 4 HOT of its own, and of one in 4 FREQUENT if it has SOME of them.
HOT = 256
FREQUENT = 262144
SOME = 8
#: A task's documents are coded together up to so many words.
TOGETHER = 1_250_000
#: Bits of a number in which a pair and its document are sorted together if they fit.
NUMBER = 63
#: The buckets' sums of a language are added up in so many parts.
PARTS = 16
ZSTD = pa.Codec("zstd")


def varints(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes of seven bits each, the last of a number below 128."""
    x = np.asarray(x, np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(7, 64, 7):
        more = x >= np.uint64(1) << np.uint64(k)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max()) if len(x) else 0):
        i = np.flatnonzero(size > k)
        out[at[i] + k] = ((x[i] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[i] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    end = np.flatnonzero(raw < 128)
    at = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    size = end - at + 1
    out = np.zeros(len(end), np.uint64)
    for k in range(int(size.max()) if len(end) else 0):
        i = np.flatnonzero(size > k)
        out[i] |= (raw[at[i] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64)


def packed(*streams: np.ndarray) -> bytes:
    """Arrays of whole numbers as one compressed blob."""
    parts = [varints(s) for s in streams]
    head = varints(np.array([len(streams), *map(len, parts)]))
    plain = bytes([len(head)]) + head + b"".join(parts)
    return len(plain).to_bytes(4, "little") + ZSTD.compress(plain, asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    plain = ZSTD.decompress(blob[4:], int.from_bytes(blob[:4], "little"), asbytes=True)
    n, *sizes = from_varints(plain[1 : 1 + plain[0]]).tolist()
    ends = np.cumsum([1 + plain[0], *sizes]).tolist()
    return [from_varints(plain[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def differences(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """x, ascending between the marks `new`, as differences; whole where a run starts."""
    out = x.copy()
    out[1:] -= np.where(new[1:], 0, x[:-1])
    return out


def undone(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(x)
    begin = np.flatnonzero(new)
    base = np.concatenate(([0], total[begin[1:] - 1]))
    return total - np.repeat(base, np.diff(np.append(begin, len(x))))


def bits_of(x: np.ndarray, width: int) -> bytes:
    """The lowest bits of all numbers, then the next ones, and so on."""
    return b"".join(np.packbits(((x >> k) & 1).astype(np.uint8)).tobytes() for k in range(width))


def from_bits(data: bytes, n: int, width: int) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros(n, np.int32)
    for k in range(width):
        out |= np.unpackbits(flat[k], count=n).astype(np.int32) << k
    return out


def coded(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places of the texts in the batch, fold of each, and for each pair of neighbouring words: text, context, word)."""
    lang = batch.column("l").to_numpy(zero_copy_only=False).view(np.uint64)
    raw, at = A.arena(batch.column("text"))
    held, n = [], 0

    def given() -> tuple:
        out = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return out

    for first, end, data, offsets in A.pieces(raw, at, 1 << 20):
        starts, ends, before = A.word_spans(data, offsets)
        doc = np.repeat(np.arange(end - first), np.diff(before))
        plain = A.word_hashes(data, starts, ends)
        triples = A.window_hashes(plain, 3)
        least = np.full(end - first, 2**64 - 1, np.uint64)
        inside = doc[: len(triples)] == doc[2:]
        np.minimum.at(least, doc[: len(triples)][inside], triples[inside])
        own = (A.mix(plain + lang[first:end][doc]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        next_ = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else np.zeros(0, np.int64)
        held.append((np.arange(first, end), (A.mix(least) & np.uint64(1)).astype(np.int64), (doc[next_] + first).astype(np.int32), own[next_], own[next_ + 1]))
        n += len(next_)
        if n > TOGETHER:
            yield given()
            n = 0
    if held:
        yield given()


def common_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (l, text) to (word, count) of each batch's frequent words; word -1 stands for all."""
    for batch in batches:
        for _, _, _, _, word in coded(batch):
            own, count = np.unique(word, return_counts=True)
            some = (count * 4 * HOT >= len(word)) | (count >= SOME) & (count * 4 * FREQUENT >= len(word))
            yield pa.record_batch([pa.array(np.append(own[some], -1)), pa.array(np.append(count[some], len(word)))], ["word", "count"])


class Frequent:
    """Frequent words by their hashes, the most frequent first; their places are their numbers. The first `hot` are common."""

    def __init__(self, words: np.ndarray, hot: int):
        self.hot, self.n = hot, len(words)
        self.number = np.argsort(words)
        self.sorted = words[self.number]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        if not self.n:
            return words + PLAIN
        i = np.minimum(np.searchsorted(self.sorted, words), self.n - 1)
        return np.where(self.sorted[i] == words, self.number[i], words + PLAIN)


def bucket_of(major: np.ndarray, minor: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    """By the major word of the pair, and of common ones by the minor too."""
    key = A.mix(major.astype(np.uint64) + np.where(major < hot, A.mix(minor.astype(np.uint64) + np.uint64(1)), np.uint64(0)))
    return (key % np.uint64(buckets)).astype(np.int64)


def pairs_of(sent, buckets: int, with_docs: bool) -> Callable:
    """Batches of (row, also, l, text) to (bucket, l, chunk, blob). Without documents a blob has words, contexts and counts in
    either fold; with them contexts, words and the documents' places in the chunk, among those of their language. A bucket below 0 has the chunk's documents: (row, also, pairs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, known = TaskContext.get().partitionId(), 0, sent.value
        for batch in batches:
            row, also, lang = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "also", "l"))
            for places, fold, doc, context, word in coded(batch):
                chunk, nth = (part << 32) | nth, nth + 1
                out = []
                tongues, which = np.unique(lang[places], return_inverse=True)
                there = np.lexsort((fold, which))  # the documents by language, those of fold 0 first
                rank = np.empty(len(places), np.int64)
                rank[there] = np.arange(len(places))
                place = rank[doc - places[0]]
                tongue, fold = which[there], fold[there]
                if with_docs:
                    n = np.bincount(place, minlength=len(places))
                    back = places[there]
                    out.append((-1 - chunk % buckets, 0, b"D" + bytes(7) + np.stack((row[back], also[back], n)).astype(np.int64).tobytes()))
                first = np.append(True, doc[1:] != doc[:-1])[: len(doc)]  # the other contexts are the words of the pairs before
                own, at = np.unique(np.concatenate((word, context[first])), return_inverse=True)
                own = known.numbers(own)
                order = np.argsort(own)
                own, place_of = own[order], np.empty(len(own), np.int32)
                place_of[order] = np.arange(len(own), dtype=np.int32)
                at = place_of[at]
                after, before = at[: len(word)], np.empty(len(word), np.int32)
                before[1:] = after[:-1]
                before[first] = at[len(word) :]
                del word, context, first, at, order, place_of
                major, minor = (before, after) if with_docs else (after, before)
                bits, width = len(own).bit_length(), len(places).bit_length()
                if 2 * bits + width <= NUMBER:
                    key = major.astype(np.int64) << (bits + width)
                    key |= minor.astype(np.int64) << width
                    key |= place
                    del doc, before, after, major, minor, place
                    key.sort()
                    major, minor, place = key >> (bits + width), (key >> width) & ((1 << bits) - 1), (key & ((1 << width) - 1)).astype(np.int32)
                    del key
                else:
                    order = np.lexsort((place, minor, major))
                    major, minor, place = major[order], minor[order], place[order].astype(np.int32)
                    del doc, before, after, order
                group = bucket_of(own, own, 0, buckets)[major]
                common = slice(0, np.searchsorted(major, np.searchsorted(own, known.hot)))
                group[common] = bucket_of(own[major[common]], own[minor[common]], known.hot, buckets)
                group += tongue[place] * buckets
                group = group.astype(np.uint16) if len(tongues) * buckets < 65536 else group
                pair = major.astype(np.int64) << 32
                pair |= minor
                del major, minor
                order = np.argsort(group, kind="stable")
                group = group[order]
                pair = pair[order]
                place = place[order]
                del order
                edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
                for lo, hi in zip(edges.tolist(), np.append(edges[1:], len(group)).tolist(), strict=True):
                    spoken = int(group[lo]) // buckets
                    base, end = np.searchsorted(tongue, (spoken, spoken + 1)).tolist()
                    zeros = int((fold[base:end] == 0).sum())
                    p, d = pair[lo:hi], place[lo:hi] - base
                    new = np.append(True, p[1:] != p[:-1])
                    mine = p[new]
                    fresh = np.append(True, mine[1:] >> 32 != mine[:-1] >> 32)  # a new major word
                    words = own[mine[fresh] >> 32]
                    sizes = np.diff(np.append(np.flatnonzero(fresh), len(mine)))
                    ahead = np.zeros(len(words), bool)
                    ahead[0] = True
                    shape = (differences(words, ahead), sizes, differences(own[mine & 0xFFFFFFFF], fresh))
                    at = np.flatnonzero(new)
                    if with_docs:
                        once = new | np.append(True, d[1:] != d[:-1])
                        where = np.flatnonzero(once)
                        per_pair = np.add.reduceat(once.astype(np.int64), at)
                        count = np.diff(np.append(where, len(p)))
                        width = max(1, (end - base - 1).bit_length())
                        body = packed(*shape, per_pair, count, np.array([base, zeros, end - base, width]))
                        blob = len(body).to_bytes(4, "little") + body + bits_of(d[where], width)
                    else:
                        zero = np.add.reduceat((d < zeros).astype(np.int64), at)
                        blob = packed(*shape, zero, np.diff(np.append(at, len(p))) - zero)
                    out.append((int(group[lo]) % buckets, int(tongues[spoken]), blob))
                for i in range(0, len(out), 512):
                    some = out[i : i + 512]
                    yield pa.record_batch([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([chunk] * len(some), pa.int64()), pa.array([x[2] for x in some], pa.binary())], ["bucket", "l", "chunk", "blob"])

    return run


class Pairs:
    """The distinct pairs of a bucket from the shapes of its blobs, in order: majors and minors are the words, major and minor
    each pair's places in them, at the places of the blobs' pairs in all of this."""

    def __init__(self, shapes: list[list[np.ndarray]], counts: list[np.ndarray]):
        minors = []
        for _, sizes, minor in shapes:
            fresh = np.zeros(len(minor), bool)
            fresh[np.cumsum(sizes) - sizes] = True
            minors.append(undone(minor, fresh))
        self.majors, major = np.unique(np.concatenate([np.cumsum(x[0]) for x in shapes]), return_inverse=True)
        self.minors, minor = np.unique(np.concatenate(minors), return_inverse=True)
        pair = (np.repeat(major, np.concatenate([x[1] for x in shapes])) << 32) | minor
        order = np.argsort(pair)
        pair = pair[order]
        new = np.append(True, pair[1:] != pair[:-1])
        edge = np.flatnonzero(new)
        self.at = np.empty(len(pair), np.int64)
        self.at[order] = np.cumsum(new) - 1
        self.major, self.minor = pair[edge] >> 32, pair[edge] & 0xFFFFFFFF
        self.counts = [np.add.reduceat(c[order], edge) for c in counts]


def each_bucket(settle: Callable) -> Callable:
    """Rows in order of (bucket, l), those of one together, to settle(bucket, l, chunks, blobs) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, blobs = None, [], []
        for batch in batches:
            for b, tongue, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "l", "chunk", "blob")), strict=True):
                if (b, tongue) != now and blobs:
                    yield from settle(*now, chunks, blobs)
                    chunks, blobs = [], []
                now = b, tongue
                chunks.append(chunk)
                blobs.append(blob)
        if blobs:
            yield from settle(*now, chunks, blobs)

    return run


STATS = [f"{c}{f}" for f in (0, 1) for c in ("total", "n1_", "n2_", "n3_", "n4_", "many")]
#: What a row of the sums is about: a common context, all pairs of a language, its words that aren't frequent, a frequent word.
CONTEXT, PAIRS, WORDS, COMMON = 0, 1, 2, 3


def stat_rows(count: np.ndarray, key: np.ndarray, keys: int) -> list[np.ndarray]:
    """By key: the sum of the counts and how many are 1, 2, 3, 4 and over 2."""
    of = lambda x: np.bincount(key, x, keys).astype(np.int64)
    return [of(count), *[of(count == k) for k in (1, 2, 3, 4)], of(count > 2)]


def tell(sent, buckets: int) -> Callable:
    """What a bucket saw, as rows (bucket, l, chunk, blob). Those of a bucket below 0 are of kind, key, STATS, in PARTS parts; the
    others have the continuation counts in either fold of the words that the bucket of step 3 shares with this one, in
    order, and -1 - this bucket as their chunk."""

    def settle(bucket: int, tongue: int, _: list, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        parts = [unpacked(b) for b in blobs]
        p = Pairs([x[:3] for x in parts], [np.concatenate([x[3 + f] for x in parts]) for f in (0, 1)])
        after = [np.bincount(p.major, c > 0, len(p.majors)).astype(np.int64) for c in p.counts]
        hot, often = np.searchsorted(p.minors, known.hot), np.searchsorted(p.majors, known.n)
        common = p.minor < hot
        zero = np.zeros(1, np.int64)
        rows = [(PAIRS, zero, [s for c in p.counts for s in stat_rows(c, np.zeros(len(c), np.int64), 1)])]
        rows.append((WORDS, zero, [s for c in after for s in stat_rows(c[often:], np.zeros(len(c) - often, np.int64), 1)]))
        if hot:
            rows.append((CONTEXT, p.minors[:hot], [s for c in p.counts for s in stat_rows(c[common], p.minor[common], hot)]))
        if often:
            rows.append((COMMON, p.majors[:often], [s for c in after for s in (c[:often], *[np.zeros(often, np.int64)] * 5)]))
        kind, key = (np.concatenate(x) for x in zip(*[(np.full(len(k), kind), k) for kind, k, _ in rows], strict=True))
        stats = [np.concatenate(x) for x in zip(*[r[2] for r in rows], strict=True)]
        part = np.where(kind == COMMON, key % PARTS, 0)
        out = [(-1 - int(x), 0, packed(*[c[part == x] for c in (kind, key, *stats)])) for x in np.unique(part)]
        rare = np.flatnonzero(p.major >= often)
        there = bucket_of(p.minors[p.minor[rare]], p.majors[p.major[rare]], known.hot, buckets)
        there, word = np.divmod(np.unique(there * len(p.majors) + p.major[rare]), len(p.majors))
        for which in np.split(np.arange(len(there)), np.flatnonzero(np.diff(there)) + 1) if len(there) else []:
            out.append((int(there[which[0]]), -1 - bucket, packed(*[c[word[which]] for c in after])))
        for i in range(0, len(out), 512):
            some = out[i : i + 512]
            yield pa.record_batch([pa.array([x[0] for x in some], pa.int64()), pa.array([tongue] * len(some), pa.int64()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.binary())], ["bucket", "l", "chunk", "blob"])

    return each_bucket(settle)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (l, bucket, blob) of `tell`, those of an (l, bucket) together, to their sums (l, kind, key, STATS)."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    now = None

    def settle() -> pa.RecordBatch:
        rows = np.array(list(sums.values())).reshape(-1, len(STATS)).T
        kind, key = zip(*sums, strict=True)
        return pa.record_batch([pa.array([now[0]] * len(sums), pa.int64()), pa.array(kind, pa.int32()), pa.array(key, pa.int64()), *[pa.array(r) for r in rows]], ["l", "kind", "key", *STATS])

    for batch in batches:
        for tongue, part, blob in zip(*(batch.column(c).to_pylist() for c in ("l", "bucket", "blob")), strict=True):
            if (tongue, part) != now and sums:
                yield settle()
                sums.clear()
            now = tongue, part
            kind, key, *stats = unpacked(blob)
            for name, row in zip(zip(kind.tolist(), key.tolist(), strict=True), np.stack(stats, axis=1), strict=True):
                sums[name] = sums[name] + row if name in sums else row
    if sums:
        yield settle()


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    cut = [max(0.1, min(k - 0.1, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] and n[k] else 0.5 + 0.25 * (k - 1) for k in (1, 2, 3)]
    return np.array([0.0, *cut])


class Side:
    """One language's sums of one fold: the discounts, and the continuation probability from a count."""

    def __init__(self, rows: list, fold: int):
        counts = {kind: np.zeros(6, np.int64) for kind in (PAIRS, WORDS)}
        for r in rows:
            own = r[3 + 6 * fold : 9 + 6 * fold]
            if r[1] in counts:
                counts[r[1]] += np.array(own)
            elif r[1] == COMMON:
                n = own[0]
                counts[WORDS] += np.array([n, n == 1, n == 2, n == 3, n == 4, n > 2])
        self.off = discounts(counts[PAIRS][1:5].tolist())
        self.low = discounts(counts[WORDS][1:5].tolist())
        total, n1, n2, _, _, many = counts[WORDS].tolist()
        self.words = total
        self.held = self.low[1] * n1 + self.low[2] * n2 + self.low[3] * many
        self.flat = 1 / (n1 + n2 + many + 1)

    def after(self, n: np.ndarray) -> np.ndarray:
        """The continuation probability of words seen after so many contexts."""
        if not self.words:
            return np.full(len(n), self.flat)
        return (n - self.low[np.minimum(n, 3)]) / self.words + self.held / self.words * self.flat

    def chance(self, count: np.ndarray, sums: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Of pairs seen so often, from the `stat_rows` of their contexts and from the chances of the words alone."""
        total = sums[0][context]
        weight = self.off[1] * sums[1] + self.off[2] * sums[2] + self.off[3] * sums[5]
        known = np.maximum(total, 1)
        return np.where(total > 0, (count - self.off[np.minimum(count, 3)]) / known + weight[context] / known * lower, lower)


class Model:
    """What all tasks get: the sides of each language, and by fold the continuation counts of frequent words and the sums of common contexts."""

    def __init__(self, rows: list[tuple], known: Frequent):
        self.hot, self.often = known.hot, known.n
        self.after = np.zeros((2, known.n), np.int64)
        self.sums = np.zeros((2, 6, known.hot), np.int64)
        by_tongue: dict[int, list] = {}
        for r in rows:
            by_tongue.setdefault(r[0], []).append(r)
            for f in (0, 1):
                if r[1] == COMMON:
                    self.after[f, r[2]] = r[3 + 6 * f]
                elif r[1] == CONTEXT:
                    self.sums[f, :, r[2]] = r[3 + 6 * f : 9 + 6 * f]
        self.sides = {tongue: (Side(rows, 0), Side(rows, 1)) for tongue, rows in by_tongue.items()}


def continuations(words: np.ndarray, model: Model, told: dict[int, bytes], buckets: int) -> np.ndarray:
    """The continuation counts of these words in either fold: those of frequent words from the model, the others' from what the
    buckets of step 2 told, each in the order of its words."""
    often = int(np.searchsorted(words, model.often))
    out = np.zeros((2, len(words)), np.int64)
    out[:, :often] = model.after[:, words[:often]]
    whose = bucket_of(words[often:], words[often:], 0, buckets)
    order = np.argsort(whose, kind="stable")
    for i in np.split(order, np.flatnonzero(np.diff(whose[order])) + 1) if len(order) else []:
        counts = unpacked(told.get(int(whose[i[0]]), packed(i[:0], i[:0])))
        if len(counts[0]) != len(i):
            raise RuntimeError("documents changed while they were read")
        out[:, often + i] = counts
    return out


def score(sent, buckets: int) -> Callable:
    """Rows of pairs with documents, and of continuation counts, to (chunk, blob): the sums of log-probabilities by place in the chunk."""

    def settle(bucket: int, tongue: int, chunks: list[int], blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        if bucket < 0:
            yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "blob"])
            return
        model = sent.value
        told = {-1 - c: b for c, b in zip(chunks, blobs, strict=True) if c < 0}
        shapes, folds, per_pairs, counts, whom, in_fold, spans = [], [], [], [], [], [], []
        for blob in (b for c, b in zip(chunks, blobs, strict=True) if c >= 0):
            end = 4 + int.from_bytes(blob[:4], "little")
            *shape, per_pair, count, (base, zeros, n, width) = unpacked(blob[4:end])
            place = from_bits(blob[end:], len(count), int(width))
            at = np.cumsum(per_pair) - per_pair
            shapes.append(shape)
            folds.append([np.add.reduceat(np.where(x, count, 0), at) for x in (place < zeros, place >= zeros)])
            per_pairs.append(per_pair)
            counts.append(count)
            whom.append(place)
            in_fold.append(place >= zeros)
            spans.append((int(base), int(n)))
        p = Pairs(shapes, [np.concatenate([x[f] for x in folds]) for f in (0, 1)])
        hot = int(np.searchsorted(p.majors, model.hot))
        after = continuations(p.minors, model, told, buckets)
        logs = []
        for f, side in enumerate(model.sides[tongue]):
            sums = np.stack(stat_rows(p.counts[f], p.major, len(p.majors)))
            sums[:, :hot] = model.sums[f][:, p.majors[:hot]]
            logs.append(np.log(side.chance(p.counts[f], sums, p.major, side.after(after[f])[p.minor])))
        i = np.repeat(p.at, np.concatenate(per_pairs))
        told = np.concatenate(counts) * np.where(np.concatenate(in_fold), logs[0][i], logs[1][i])  # by the counts of the other fold
        ends = np.cumsum([0, *[len(w) for w in whom]]).tolist()
        for k, (chunk, (base, n)) in enumerate(zip([c for c in chunks if c >= 0], spans, strict=True)):
            sums = np.bincount(whom[k], told[ends[k] : ends[k + 1]], n)
            some = np.flatnonzero(sums)
            few = 2 * len(some) < n
            where = packed(differences(some, np.arange(len(some)) == 0)) if few else b""
            blob = b"S" + base.to_bytes(4, "little") + len(where).to_bytes(4, "little") + where + (sums[some] if few else sums).astype(np.float32).tobytes()
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], ["chunk", "blob"])

    return each_bucket(settle)


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, blob), those of a chunk together, to (row, also, log_sum, n) of its documents."""

    def settle(blobs: list[bytes]) -> pa.RecordBatch:
        told = next(b for b in blobs if b[:1] == b"D")
        row, also, n = np.frombuffer(told, np.int64, offset=8).reshape(3, -1)
        total = np.zeros(len(row))
        for b in blobs:
            if b[:1] != b"D":
                base, end = int.from_bytes(b[1:5], "little"), 9 + int.from_bytes(b[5:9], "little")
                sums = np.frombuffer(b, np.float32, offset=end)
                if end > 9:
                    total[base + np.cumsum(unpacked(b[9:end])[0])] += sums
                else:
                    total[base : base + len(sums)] += sums
        some = n > 0
        return pa.record_batch([pa.array(row[some]), pa.array(also[some]), pa.array(total[some]), pa.array(n[some])], ["row", "also", "log_sum", "n"])

    now, held = None, []
    for batch in batches:
        for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if chunk != now and held:
                yield settle(held)
                held = []
            now = chunk
            held.append(blob)
    if held:
        yield settle(held)


def log_means(texts: DataFrame, buckets: int | None = None) -> DataFrame:
    """(row, also, log_mean) from (row, also, l, text): the mean log-probability of a word after its context under the
    other fold's model, l the language as a number. Texts of fewer than two words have no row; rows of equal row and also
    are one text and have one mean, but each counts in the model."""
    spark = texts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = texts.select("l", "text").mapInArrow(common_words, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))
    seen = stored(seen, "words-common")
    every = seen.filter("word = -1").select("count").first()
    every = every[0] if every else 0
    often = seen.filter((F.col("word") >= 0) & (F.col("count") * 2 * FREQUENT >= every)).collect()  # 2 x FREQUENT of them at most
    often = sorted((-r["count"], r.word) for r in often)
    known = Frequent(np.array([w for _, w in often], np.int64), sum(-n * 2 * HOT >= every for n, _ in often))
    words = spark.sparkContext.broadcast(known)

    schema = "bucket long, l long, chunk long, blob binary"
    dealt = lambda rows: rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "l")
    told = stored(dealt(texts.mapInArrow(pairs_of(words, buckets, False), schema)).mapInArrow(tell(words, buckets), schema), "words-told")
    sums = told.filter("bucket < 0").select("l", "bucket", "blob").repartition("l", "bucket").sortWithinPartitions("l", "bucket")
    sums = sums.mapInArrow(add_up, f"l long, kind int, key long, {', '.join(f'{c} long' for c in STATS)}").collect()  # the frequent words', the common contexts', two of each language
    sent = spark.sparkContext.broadcast(Model([tuple(r) for r in sums], known))
    pairs = texts.mapInArrow(pairs_of(words, buckets, True), schema).unionAll(told.filter("bucket >= 0"))
    sums = dealt(pairs).mapInArrow(score(sent, buckets), "chunk long, blob binary").repartition("chunk").sortWithinPartitions("chunk")
    per_row = sums.mapInArrow(gather, "row long, also long, log_sum double, n long")
    return per_row.groupBy("row", "also").agg((F.sum("log_sum") / F.sum("n")).alias("log_mean"))
