"""Removal of repeated byte strings by a sparse, hash-compared suffix sort.

A position is a repeat if the `length` bytes from it also start somewhere earlier (smaller doc_id, or earlier in the
same document). Every such string holds an anchor: of its GRAM-byte strings the one with the least hash, leftmost
first, which depends on nothing but the string. Neighbouring positions mostly share their anchor, so a document falls
into segments, about two in a hundred bytes, and equal strings lie in segments with equal anchor hashes.

1. Segments go by anchor hash to their task, which streams them. A batch of documents sends one copy of each, compared byte by byte, so that no
   string is sent more often than there are batches. An anchor with one segment alone has no repeats.
2. The others' bytes are fetched. Segments of equal hashes are compared as bytes in a tree: up to BLOCK of them with the first of their block, those first
   ones up to BLOCK at a time with theirs, and so on, so that no group grows with the number of copies. Only the very first has new
   strings. The suffixes of the different ones under an anchor, the ends of repeats, are
   sorted: a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes.
   Neighbours that agree in all bytes are verified byte by byte; the first of each class stays, the rest are repeats.
   An anchor with more than HOT different segments would gather too much: its strings go by their own hash instead.
   Should a segment differ from one of its hashes, all segments of its anchor are compared as bytes.
3. Spans go back to their documents, which are cut and digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import small, stored, table

LENGTH = 100
GRAM = 24
HOT = 2048
#: So many segments of equal hashes are compared with the first of them in one group.
BLOCK = 64
CHECK_BASE = 0xD6E8FEB86659FD93
#: Stands for a null doc_id, before all others.
NO_ID = -(2**63)
#: A span packs where it starts, how many positions it has, where its anchor is, and check bits.
START, COUNT, OFFSET, CHECK = 28, 21, 14, 14


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    return A.powers(n, base)


def powers(n: int, base: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(size, base)[:n]


class Prefixes:
    """Prefix polynomial hashes of a byte array: the hash of any substring in constant time."""

    def __init__(self, data: np.ndarray, base: int = A.BASE):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(A.VALUES[data] * powers(n, base), out=self.sums[1:])
        self.back = powers(n + 1, A.inverse(base))

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def segments(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Segments of texts in a row: (text, first position in it, positions, anchor's place after the first,
    anchor hash, hash of all bytes, check)."""
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    places = len(data) - length + 1
    sizes = np.maximum(np.diff(at) - length + 1, 0)
    if places <= 0 or not sizes.sum():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    prefix = Prefixes(data)
    grams = A.mix(prefix.of(np.arange(len(data) - gram + 1), gram))
    low = np.uint64((1 << int(len(grams)).bit_length()) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: places], least[width - step :][: places])
    anchor = (least[:places] & low).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    first_of = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    place = np.arange(len(text)) - np.repeat(first_of - at[:-1], sizes)
    own = anchor[place]
    new = np.ones(len(place), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(place)))
    start, text, own = place[begin], text[begin], own[begin]
    whole = prefix.of(start, count - 1 + length)
    second = Prefixes(data, CHECK_BASE).of(start, count - 1 + length)
    check = (A.mix(second) >> np.uint64(64 - CHECK)).astype(np.int64)
    return text, start - at[text], count, own - start, grams[own], A.mix(whole + count.astype(np.uint64)), check


def pack(start: np.ndarray, count: np.ndarray, offset: np.ndarray | int = 0, check: np.ndarray | int = 0) -> np.ndarray:
    return (start << START) | (count << COUNT) | (offset << OFFSET) | check


def unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return span >> START, (span >> COUNT) & 127, (span >> OFFSET) & 127, span & (2**CHECK - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_in_batch(keys: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Which rows are the first with their key; rows that differ in `same` count as different."""
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    equal = keys[order[1:]] == keys[order[:-1]]
    for s in same:
        equal &= s[order[1:]] == s[order[:-1]]
    first[order[1:]] = ~equal
    return first


def cut_segments(length: int, gram: int) -> Callable:
    """Batches of (k, t, text) to rows (a, h, k, t, span). A span of which it is known in the batch, by its bytes, that it
    repeats an earlier one is negative (bits inverted) and has any a and h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, also = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t"))
            order = np.lexsort((also, ids))
            raw, at = A.arena(batch.column("text").take(pa.array(order)))
            ids, also = ids[order], also[order]
            parts = [[] for _ in range(6)]
            for first, _, data, offsets in A.pieces(raw, at, 1 << 18):
                text, start, count, offset, a, h, check = segments(data, offsets, length, gram)
                for to, x in zip(parts, (a, h, ids[text + first], also[text + first], pack(start, count, offset, check), at[text + first] + start), strict=True):
                    to.append(x)
            if not parts[0]:
                continue
            a, h, k, t, span, place = (np.concatenate(p) for p in parts)
            new = _first_in_batch(h, a, span & (2**CHECK - 1))
            lead = _lead(h, new)
            whole, sizes = raw.tobytes(), unpack(span)[1] - 1 + length
            again = np.flatnonzero(~new)
            first = lead[again]
            wrong = [n != m or whole[x : x + n] != whole[y : y + m] for x, y, n, m in zip(place[again].tolist(), place[first].tolist(), sizes[again].tolist(), sizes[first].tolist(), strict=True)]  # by their bytes
            new[again] = wrong
            other = new | (k != k[lead]) | (t != t[lead]) | (span != span[lead])
            a, h, k, t, span, new = (x[other] for x in (a, h, k, t, span, new))
            repeat = ~new
            a[repeat] = A.mix(k[repeat].view(np.uint64))
            h[repeat] = 0
            span[repeat] = ~span[repeat]
            for i in range(0, len(a), 200_000):
                j = slice(i, i + 200_000)
                yield pa.record_batch([_signed(a[j]), _signed(h[j]), pa.array(k[j]), pa.array(t[j]), pa.array(span[j])], ["a", "h", "k", "t", "span"])

    return run


def _lead(keys: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each row the first with its key."""
    order = np.argsort(keys, kind="stable")
    out = np.empty(len(keys), np.int64)
    out[order] = order[np.flatnonzero(new[order])[np.cumsum(new[order]) - 1]] if len(keys) else order
    return out


def _itself(keys: np.ndarray, new: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which rows that aren't the first with their key stand at the first's own place: rows of a repeated document."""
    lead = _lead(keys, new)
    same = ~new
    for x in place:
        same &= x == x[lead]
    return same


#: What the first step says of a span: a repeat, to be sorted by anchor, to be sorted by string, the first of a block of equal hashes, to be
#: compared with that. The second step says REPEAT, or DIFFERENT of one that isn't as the first of its block.
REPEAT, SHARED, CROWDED, HEAD, EQUAL, DIFFERENT = range(6)
FOUND = "kind int, a long, b long, k long, t long, span long"
JUDGED = [f.split()[0] for f in FOUND.split(", ")]


def judge_segments(hot: int, block: int = BLOCK) -> Callable:
    """Rows in ascending (a, h, k, t, span), all rows of an a together, to rows FOUND: those known as repeats, and those whose bytes are to be compared under
    a, b being their anchor. Of an anchor it holds up to hot segments, whatever the number of rows."""

    def out(kind: int, key: np.ndarray, rows: list[np.ndarray]) -> pa.RecordBatch:
        a, _, k, t, span = rows
        return pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), *map(pa.array, (key, a, k, t, span))], names=JUDGED)

    def key(rows: list[np.ndarray], unit: int, nth: np.ndarray) -> np.ndarray:
        own = A.mix(A.mix(rows[1].view(np.uint64)) ^ rows[0].view(np.uint64))
        return A.mix(own + A.mix(np.full(len(own), unit, np.uint64)) + nth.astype(np.uint64)).view(np.int64)

    def tree(rows: list[np.ndarray], place: np.ndarray, first: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows that have equal hashes with an earlier one: their places after it, from 1, and that one for each."""
        unit = 1
        while len(place) and unit <= place.max():
            nth, low = place // (unit * block), place % (unit * block)
            for kind, which in ((EQUAL, (place % unit == 0) & (low != 0)), (HEAD, low == 0)):
                some = [x[which] for x in rows]
                yield out(kind, key(some, unit, nth[which]), some)
            some = [x[place == unit] for x in first]
            yield out(HEAD, key(some, unit, np.zeros(len(some[0]), np.int64)), some)
            unit *= block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n = None, 0  # the first row of the last hash, and how many followed it
        held = [np.zeros(0, np.int64)] * 5  # the different segments of the last anchor
        crowded = None  # an anchor whose segments went out as crowded already
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "h", "k", "t", "span")]
            known = rows[4] < 0
            if known.any():
                some = [x[known] for x in rows]
                yield out(REPEAT, some[0], [*some[:4], ~some[4]])
                rows = [x[~known] for x in rows]
            if not len(rows[0]):
                continue
            old = 0 if head is None else 1
            if old:
                rows = [np.append(x, y) for x, y in zip(head, rows, strict=True)]
            a, h, k, t, span = rows
            new = np.append(True, (a[1:] != a[:-1]) | (h[1:] != h[:-1]))
            begin = np.flatnonzero(new)
            run_ = np.cumsum(new) - 1
            of = begin[run_]
            itself = ~new & (k == k[of]) & (t == t[of]) & (span == span[of])
            check = span & (2**CHECK - 1)
            follow = ~new & ~itself & (check == check[of])
            count = np.cumsum(follow)
            place = count - count[of] + np.where(run_ == 0, n, 0)
            yield from tree([x[follow] for x in rows], place[follow], [x[of[follow]] for x in rows])
            last = begin[-1]
            n = int(count[-1] - count[last]) + (n if last == 0 else 0)
            head = [x[last : last + 1] for x in rows]
            lead = ~itself & ~follow
            lead[:old] = False
            held = [np.concatenate((x, y[lead])) for x, y in zip(held, rows, strict=True)]
            if not len(held[0]):
                continue
            a = held[0]
            group = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
            size = np.bincount(group)[group]
            done = a != a[-1]
            many = (size > hot) | (a == crowded if crowded is not None else False)
            some = [x[many] for x in held]
            yield out(CROWDED, some[0], some)
            some = [x[done & ~many & (size > 1)] for x in held]
            yield out(SHARED, some[0], some)
            crowded = a[-1] if many[-1] else crowded
            held = [x[~done & ~many] for x in held]
        some = held if len(held[0]) > 1 else [x[:0] for x in held]
        yield out(SHARED, some[0], some)

    return run


STRINGS = f"{FOUND}, string binary"
CUT = [*JUDGED, "string"]


def cut_strings(length: int) -> Callable:
    """Batches of (k, t, text, found: list of (kind, a, b, span)) to rows STRINGS to be compared; a null
    string marks a span that is known to repeat an earlier one of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, also = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t"))
            order = np.lexsort((also, ids))
            batch = batch.take(pa.array(order))
            ids, also = ids[order], also[order]
            raw, at = A.arena(batch.column("text"))
            found = batch.column("found")
            row = np.repeat(np.arange(len(found)), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            flat = found.flatten()
            kind, a, b, span = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            start, count, _, _ = unpack(span)
            begin, end = at[row] + start, at[row] + start + count - 1 + length
            fits = end <= at[row + 1]
            plain = np.flatnonzero((kind != CROWDED) & fits)
            whole = raw.tobytes()
            for i in range(0, len(plain), 50_000):
                j = plain[i : i + 50_000]
                strings = [whole[x:y] for x, y in zip(begin[j].tolist(), end[j].tolist(), strict=True)]
                yield pa.record_batch([pa.array(kind[j]), pa.array(a[j]), pa.array(b[j]), pa.array(ids[row[j]]), pa.array(also[row[j]]), pa.array(span[j]), pa.array(strings, pa.binary())], CUT)
            crowd = np.flatnonzero((kind == CROWDED) & fits)
            if len(crowd):
                # the strings one by one, in order of (k, start), by their own hash
                crowd = crowd[np.lexsort((start[crowd], row[crowd]))]
                n = count[crowd]
                each = np.repeat(crowd, n)
                nth = np.arange(len(each)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                own = start[each] + nth
                hashes = np.empty(len(each), np.uint64)
                for r in np.unique(row[each]):
                    here = row[each] == r if len(each) < 1000 else slice(*np.searchsorted(row[each], [r, r + 1]))
                    hashes[here] = A.mix(Prefixes(raw[at[r] : at[r + 1]]).of(own[here], length))
                new = _first_in_batch(hashes)
                lead, where = _lead(hashes, new), at[row[each]] + own
                again = np.flatnonzero(~new)
                new[again] = [whole[x : x + length] != whole[y : y + length] for x, y in zip(where[again].tolist(), where[lead[again]].tolist(), strict=True)]  # by their bytes
                other = new | (ids[row[each]] != ids[row[each[lead]]]) | (also[row[each]] != also[row[each[lead]]]) | (own != own[lead])
                each, own, hashes, new, where = each[other], own[other], hashes[other], new[other], where[other]
                for i in range(0, len(each), 50_000):
                    j = slice(i, i + 50_000)
                    strings = [whole[x : x + length] if f else None for x, f in zip(where[j].tolist(), new[j].tolist(), strict=True)]
                    one = pack(own[j], np.ones(len(own[j]), np.int64))
                    yield pa.record_batch([pa.array(kind[each[j]]), _signed(hashes[j]), pa.array(b[each[j]]), pa.array(ids[row[each[j]]]), pa.array(also[row[each[j]]]), pa.array(one), pa.array(strings, pa.binary())], CUT)

    return run


def common_extension(prefix: Prefixes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """How many bytes, `length` at most, the suffixes at x and y have in common: a binary search over hashes."""
    out = np.full(len(x), length, np.int64)
    differ = np.flatnonzero(prefix.of(x, length) != prefix.of(y, length))
    if len(differ):
        x, y = x[differ], y[differ]
        low, high = np.zeros(len(differ), np.int64), np.full(len(differ), length - 1, np.int64)
        for _ in range(int(length).bit_length()):
            half = (low + high + 1) // 2
            same = prefix.of(x, half) == prefix.of(y, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        out[differ] = low
    return out


def merge_sorted(data: np.ndarray, prefix: Prefixes, suffix: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """An order of suffixes by bucket, then by their first `length` bytes; equal ones keep their order.

    A bottom-up mergesort of all buckets at once: a suffix's place in the merged run is its place in its own run
    plus the number of smaller ones in the other, found by binary search with hashed comparisons.
    """
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(edges, len(bucket)))
    base, size = np.repeat(edges, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < (sizes.max() if len(sizes) else 0):
        live = np.flatnonzero(size > width)
        nth = live - base[live]
        run = nth // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width
        low = np.minimum(other, size[live])
        high = np.minimum(other + width, size[live])
        begin = low.copy()
        me = suffix[order[live]]
        for _ in range(int(width).bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            half = (low[open_] + high[open_]) // 2
            them = suffix[order[base[live[open_]] + half]]
            mine = me[open_]
            same = common_extension(prefix, them, mine, length)
            whole = same == length
            at = np.where(whole, 0, same)
            smaller = np.where(whole, ~left[open_], data[them + at] < data[mine + at])
            low[open_] = np.where(smaller, half + 1, low[open_])
            high[open_] = np.where(smaller, high[open_], half)
        place = base[live] + np.minimum(run, np.where(left, run, run - 1)) * width + (nth - run * width) + (low - begin)
        moved = order[live]
        order[place] = moved
        width *= 2
    return order


def repeats(strings: list[bytes], key: np.ndarray, k: np.ndarray, t: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """For every position of every string, in turn, whether an equal one among those of the same key is earlier."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings), np.uint8)
    at = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    start, count, offset, _ = unpack(span)
    each = np.repeat(np.arange(len(strings)), count)
    nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    suffix = at[each] + nth
    # equal strings have their anchor at the same place
    group = np.unique(key, return_inverse=True)[1]
    bucket = group[each] * 256 + (offset[each] - nth + 128)
    ranked = np.lexsort((start[each] + nth, t[each], k[each]))
    prefix = Prefixes(data)
    order = ranked[merge_sorted(data, prefix, suffix[ranked], bucket[ranked], length)]
    same = np.zeros(len(order), bool)
    same[1:] = (bucket[order[1:]] == bucket[order[:-1]]) & (prefix.of(suffix[order[1:]], length) == prefix.of(suffix[order[:-1]], length))
    wrong = False
    alike = np.flatnonzero(same)
    for i in range(0, len(alike), 20_000):
        j = alike[i : i + 20_000]
        x, y = suffix[order[j]], suffix[order[j - 1]]
        wrong |= bool((data[x[:, None] + np.arange(length)] != data[y[:, None] + np.arange(length)]).any())
    out = np.zeros(len(order), bool)
    if wrong:  # a collision: these few by their bytes
        seen: set[tuple[int, bytes]] = set()
        for i in ranked:
            word = (int(bucket[i]), data[suffix[i] : suffix[i] + length].tobytes())
            out[i] = word in seen
            seen.add(word)
        return out
    out[order] = same
    return out


def sort_strings(length: int, most: int = 15_000) -> Callable:
    """Rows STRINGS in ascending (a, k, t, span), all rows of an a together, to rows (kind, b, k, t, span) of repeats, and of those
    that differ from the first of their block."""
    names = ["kind", "b", "k", "t", "span"]

    def firsts(held: list[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
        """What is known of all rows but the first ones with their string, and those."""
        rows = pa.Table.from_batches(held)
        order = np.lexsort([rows.column(c).to_numpy() for c in ("kind", "span", "t", "k", "a")])
        again = [rows.column(c).to_numpy()[order] for c in ("span", "t", "k", "a")]
        new = np.append(True, np.any([x[1:] != x[:-1] for x in again], axis=0))  # a repeated document's once
        rows = rows.take(pa.array(order[new])).combine_chunks()
        # of equal strings the first stands for all; the others repeat it with all their positions
        seen: set[tuple[int, bytes]] = set()
        kind = rows.column("kind").to_numpy().copy()
        for i, name in enumerate(zip(rows.column("a").to_pylist(), rows.column("string").to_pylist(), strict=True)):
            if name in seen:
                kind[i] = REPEAT
            elif kind[i] == EQUAL:
                kind[i] = DIFFERENT
            else:
                seen.add(name)
        settled = (kind == REPEAT) | (kind == DIFFERENT)
        told = rows.filter(pa.array(settled))
        kept = rows.filter(pa.array(~settled)).combine_chunks()
        left = pa.RecordBatch.from_arrays([kept.column(c).combine_chunks() for c in CUT], names=CUT)
        return [pa.RecordBatch.from_arrays([pa.array(kind[settled]), *[told.column(c).combine_chunks() for c in names[1:]]], names=names)], left

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, left = firsts(held)
        yield from told
        key = left.column("a").to_numpy(zero_copy_only=False)
        kind = left.column("kind").to_numpy(zero_copy_only=False)
        alone = np.unique(key, return_counts=True)
        some = np.flatnonzero(np.isin(key, alone[0][alone[1] > 1]) & (kind != HEAD))
        if not len(some):
            return
        left = left.take(pa.array(some))
        key, b, k, t, span = (left.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "k", "t", "span"))
        again = repeats(left.column("string").to_pylist(), key, k, t, span, length)
        start, count, _, _ = unpack(span)
        each = np.repeat(np.arange(len(span)), count)
        own = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        hit = np.flatnonzero(again)
        run = np.ones(len(hit), bool)
        run[1:] = (hit[1:] != hit[:-1] + 1) | (each[hit[1:]] != each[hit[:-1]])
        begin = np.flatnonzero(run)
        many = np.diff(np.append(begin, len(hit)))
        whose = each[hit[begin]]
        yield pa.record_batch([pa.array(np.full(len(whose), REPEAT, np.int32)), *[pa.array(x) for x in (b[whose], k[whose], t[whose], pack(own[hit[begin]], many))]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, bound = 0, most
        for batch in batches:
            known = batch.column("string").is_null().to_numpy(zero_copy_only=False)
            if known.any():
                some = batch.filter(pa.array(known))
                yield pa.record_batch([pa.array(np.full(some.num_rows, REPEAT, np.int32)), *[some.column(c) for c in names[1:]]], names=names)
                batch = batch.filter(pa.array(~known))
            while batch.num_rows:
                a = batch.column("a").to_numpy(zero_copy_only=False)
                # whole groups only: up to the last change of a, here or where the batch meets what is held
                change = np.flatnonzero(a[1:] != a[:-1]) + 1
                if held and held[-1].column("a")[-1].as_py() != a[0]:
                    change = np.append(0, change)
                if n + len(a) < most or not len(change):
                    held.append(batch)
                    n += len(a)
                    if n > bound:  # a group of very many rows is held by its different strings alone
                        told, left = firsts(held)
                        yield from told
                        held, n = [left], left.num_rows
                        bound = max(most, 2 * n)
                    break
                fit = change[change <= max(most - n, 0)]
                cut = int(fit[-1] if len(fit) else change[0])
                held.append(batch.slice(0, cut))
                if any(h.num_rows for h in held):
                    yield from answer([h for h in held if h.num_rows])
                held, n, bound, batch = [], 0, most, batch.slice(cut)
        held = [h for h in held if h.num_rows]
        if held:
            yield from answer(held)

    return run


def cut_out(length: int) -> Callable:
    """Batches of (k, t, text, spans) to the digest of what is left of each text, and to the text itself if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = A.arena(batch.column("text"))
            lists = batch.column("spans")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            out = [[], [], [], [], []]
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]]
                kept, removed, runs = text, 0, 0
                if sizes[i]:
                    start, count, _, _ = unpack(flat[ends[i] - sizes[i] : ends[i]])
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], (start + count - 1 + length)[order]
                    stop = np.minimum(np.maximum.accumulate(stop), len(text))
                    start = np.minimum(start, len(text))
                    new = np.append(True, start[1:] > stop[:-1])
                    begin, finish = start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(stop) - 1)]
                    runs, removed = int((finish > begin).sum()), int((finish - begin).sum())
                    edges = np.stack((np.append(0, finish), np.append(begin, len(text))), axis=1)
                    kept = np.concatenate([text[x:y] for x, y in edges.tolist()]) if removed else text
                left = kept.tobytes()
                for to, x in zip(out, (len(text), removed, runs, hashlib.sha256(left).hexdigest(), left), strict=True):
                    to.append(x)
            yield pa.record_batch(
                [batch.column("k"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3]), pa.array(out[4], pa.binary())],
                ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def segment_strings(texts: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes of rows FOUND, as rows STRINGS; those of one a are compared together."""
    lists = found.groupBy("k", "t").agg(F.collect_list(F.struct("kind", "a", "b", "span")).alias("found"))
    return texts.join(lists, ["k", "t"]).mapInArrow(cut_strings(length), STRINGS)


def compared(strings: DataFrame, length: int) -> DataFrame:
    dealt = strings.repartition("a").sortWithinPartitions("a", "k", "t", "span")
    return stored(dealt.mapInArrow(sort_strings(length), "kind int, b long, k long, t long, span long"), "segments-compared")


def judged_segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(k, t, text) of docs, t telling texts of one id apart, and rows FOUND of their segments, stored."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    several = texts.groupBy("k").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).filter("x < y").select("k", F.lit(True).alias("several"))
    texts = texts.join(small(stored(several, "segments-ids"), 1_000_000), "k", "left").select("k", F.when(F.col("several"), digest).otherwise(F.lit(0)).alias("t"), "text")
    cut = texts.mapInArrow(cut_segments(length, gram), "a long, h long, k long, t long, span long")
    dealt = cut.repartition("a").sortWithinPartitions("a", "h", "k", "t", "span")
    return texts, stored(dealt.mapInArrow(judge_segments(hot, block), FOUND), "segments")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(k, t, text) of docs, and the (k, t, span) of all positions that repeat an earlier string."""
    texts, first = judged_segments(docs, length, gram, hot, block)
    open_ = first.filter(F.col("kind") != REPEAT)
    told = compared(segment_strings(texts, open_, length), length)
    spans = first.unionByName(told, allowMissingColumns=True).filter(F.col("kind") == REPEAT).select("k", "t", "span")
    odd = told.filter(F.col("kind") == DIFFERENT).select("b").distinct()
    if not odd.isEmpty():  # hashes that collide: all segments of these anchors meet
        all_ = open_.join(odd, "b").select(F.lit(SHARED).alias("kind"), F.col("b").alias("a"), "b", "k", "t", "span").distinct()
        spans = spans.union(compared(segment_strings(texts, all_, length), length).select("k", "t", "span"))
    return texts, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; they can break inside a character).

    Null and empty texts have 0 bytes. A null doc_id comes before all others. Rows that repeat a doc_id with its
    text are one document: each gets that document's result. Different texts of one id are documents of their own, in order of a
    hash of the text, and each loses its own spans alone. Texts shorter than `length` stay whole. Texts are read whole;
    `length` is at most 127 + gram - 1, a text at most 2^34 bytes. Other columns of docs aren't read.
    """
    texts, spans = repeated_spans(docs, length, gram, hot, block)
    per_doc = spans.groupBy("k", "t").agg(F.collect_set("span").alias("spans"))
    done = texts.join(per_doc, ["k", "t"], "left").mapInArrow(cut_out(length), "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Strings are compared by their MD5; texts are cut into pieces first, as long texts are slow to take parts of.
ORACLE = r"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (
  SELECT doc_id, o, substr(h, 2 * o + 1, 598) AS piece, length(h) // 2 - o AS rest FROM h, LATERAL (SELECT unnest(range(0, length(h) // 2 - 99, 200)) AS o)
), p AS (
  SELECT doc_id, o + j AS i, row_number() OVER (PARTITION BY md5_number(substr(piece, 2 * j - 1, 200)) ORDER BY doc_id, o + j) > 1 AS again
  FROM b, LATERAL (SELECT unnest(range(1, least(200, rest - 99) + 1)) AS j)
), c AS (
  SELECT doc_id, i AS x, coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) AS before FROM p WHERE again
), g AS (
  SELECT doc_id, x, sum(CASE WHEN x > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x) AS span FROM c
), s AS (
  SELECT doc_id, span, min(x) AS f, max(x) + 99 AS t FROM g GROUP BY doc_id, span
), k AS (
  SELECT doc_id, count(*) AS n_spans, sum(t - f + 1) AS n_removed FROM s GROUP BY doc_id
), e AS (
  SELECT doc_id, span, f, t, lag(t, 1, 0) OVER (PARTITION BY doc_id ORDER BY f) AS since, lead(f) OVER (PARTITION BY doc_id ORDER BY f) AS next FROM s
), o AS (
  SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (f - since - 1)) || CASE WHEN next IS NULL THEN substr(h, 2 * t + 1) ELSE '' END, '' ORDER BY f) AS kept FROM e JOIN h USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id) LEFT JOIN o USING (doc_id)
"""
