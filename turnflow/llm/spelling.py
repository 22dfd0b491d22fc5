"""Spelling variants: words of a corpus that differ by one code point, and the commonest word of each such family.

Two words that differ by one code point agree on the first half of either or on its second half. So a word is looked up twice, among the
words that share its first half and, read backwards, among those that share its second: in a minimal acyclic automaton of
these, whose paths are numbered in the order of the words (a perfect hash), it follows the half exactly and completes with one error.

Words are dealt by direction and half; a task builds an automaton for many halves together. Words that share a half with
too many others are dealt again by all of the word but one place, which leaves groups of a bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import small, stored, table

#: Letters of the words, at least LEAST of them; words are counted from OFTEN occurrences on.
RUN = re.compile(r"[A-Za-zÀ-ÿ]{5,}")
LEAST, OFTEN = 5, 3
#: One in so many runs of letters has lost one, by the hash of document and run.
LOST = 97
#: Words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Words under one half above which they are dealt by all but one place; words of one automaton; words that are walked at once.
MOST, TOGETHER, BLOCK = 50_000, 50_000, 8192
#: Longer words are compared with those of their own half directly.
LONG = 256


def read_words(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document, with a letter lost here and there."""
    low = (text or "").encode().lower().decode()  # of bytes, only A-Z have a lower case
    prefix = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(low)).items():
        h = crc32(run.encode(), prefix)
        if h % LOST == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to words with counts, to be added up."""
    total: Counter = Counter()
    rows = lambda: pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            total.update(read_words(doc_id, text.as_py()))
            if len(total) >= COUNTED:
                yield rows()
                total.clear()
    yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that occur often enough."""
    read = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return read.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


class Automaton:
    """The minimal acyclic automaton of words in order, with the number of each word along its path.

    States are the distinct right sides of the words' beginnings, found by a 64-bit hash of what follows.
    """

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """codes: a row of letters from 1 on for each word, ascending, padded by 0."""
        n, wide = codes.shape
        shared = np.zeros(n, np.int64)
        if n > 1:
            differ = codes[1:] != codes[:-1]
            shared[1:] = differ.argmax(axis=1)
        levels, first = [np.zeros(1, np.int64)], 1  # the words that begin a new path at each depth
        label, parent, level_at = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [0]
        for depth in range(1, wide + 1):
            new = np.flatnonzero((shared < depth) & (sizes >= depth))
            if not len(new):
                break
            up = np.searchsorted(levels[-1], new, side="right") - 1 if depth > 1 else np.zeros(len(new), np.int64)
            label.append(codes[new, depth - 1].astype(np.int64))
            parent.append(level_at[-1] + up)
            level_at.append(first)
            levels.append(new)
            first += len(new)
        label, parent = np.concatenate(label), np.concatenate(parent)
        final = np.zeros(first, np.int64)
        for depth, (at, new) in enumerate(zip(level_at, levels, strict=True)):
            final[at : at + len(new)] = sizes[new] == depth if depth else 0
        # What follows each beginning, from the ends inwards: a hash of it and how many words there are.
        sides, below = final.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), final.copy()
        for depth in range(len(levels) - 1, 0, -1):
            at = slice(level_at[depth], level_at[depth] + len(levels[depth]))
            np.add.at(sides, parent[at], A.mix(sides[at] + label[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1)))
            np.add.at(below, parent[at], below[at])
        _, one, state = np.unique(sides, return_index=True, return_inverse=True)
        state = state.reshape(-1) + 1  # 0: no state
        count = len(one) + 1
        # A step's number: the words that end before it, at the state itself or on its steps of lesser letters.
        before = np.cumsum(below) - below
        leads = np.ones(first, bool)
        leads[2:] = parent[2:] != parent[1:-1]
        lead = np.maximum.accumulate(np.where(leads, np.arange(first), 0))
        skip = before - before[lead] + final[parent]
        letters = int(codes.max(initial=0)) + 1
        self.next, self.skip = np.zeros((count, letters), np.int32), np.zeros((count, letters), np.int32)
        child = np.arange(1, first)
        self.next[state[parent[child]], label[child]] = state[child]
        self.skip[state[parent[child]], label[child]] = skip[child]
        self.final = np.zeros(count, bool)
        self.final[state[one]] = final[one] > 0
        self.root = int(state[0])
        steps = np.nonzero(self.next)
        self.letter = steps[1]
        self.first = np.searchsorted(steps[0], np.arange(count + 1))

    def near(self, codes: np.ndarray, sizes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words with a padded row each, which agree with some words on `exact` letters: pairs of row and number of a word
        that agrees on these too and differs by one letter after them."""
        n = len(codes)
        state, number = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        for depth in range(int(exact.max(initial=0))):
            on = np.flatnonzero(exact > depth)
            c = codes[on, depth]
            number[on] += self.skip[state[on], c]
            state[on] = self.next[state[on], c]
        row, place = np.arange(n), exact.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            rest = place < sizes[row]
            c = codes[row, np.minimum(place, codes.shape[1] - 1)]
            c = np.where(rest, c, 0)
            degree = self.first[state + 1] - self.first[state]
            of = np.repeat(np.arange(len(row)), degree)
            letter = self.letter[np.arange(len(of)) - np.repeat(np.cumsum(degree) - degree, degree) + np.repeat(self.first[state], degree)]
            wrong = letter != c[of]  # an inserted letter equal to the next one can as well stand after it
            of, letter = of[wrong], letter[wrong]
            to, add = self.next[state[of], letter], self.skip[state[of], letter]
            replaced = rest[of]
            found.append(
                self.completed(
                    codes, sizes,
                    np.concatenate([row[of], row[of][replaced], row[rest]]),
                    np.concatenate([place[of], place[of][replaced] + 1, place[rest] + 1]),
                    np.concatenate([to, to[replaced], state[rest]]),
                    np.concatenate([number[of] + add, (number[of] + add)[replaced], number[rest]]),
                )
            )
            row, place, state, number, c = row[rest], place[rest] + 1, state[rest], number[rest], c[rest]
            number = number + self.skip[state, c]
            state = self.next[state, c].astype(np.int64)
            alive = state > 0
            row, place, state, number = row[alive], place[alive], state[alive], number[alive]
        row, number = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        both = np.unique(row << 32 | number)
        return both >> 32, both & 0xFFFFFFFF

    def completed(self, codes: np.ndarray, sizes: np.ndarray, row: np.ndarray, place: np.ndarray, state: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that reach the end of a word with the rest of their row, without a further error."""
        rows, numbers = [], []
        while len(row):
            over = place >= sizes[row]
            ends = over & self.final[state]
            rows.append(row[ends])
            numbers.append(number[ends])
            row, place, state, number = row[~over], place[~over], state[~over], number[~over]
            c = codes[row, place]
            number = number + self.skip[state, c]
            state = self.next[state, c]
            alive = state > 0
            row, place, state, number = row[alive], place[alive] + 1, state[alive], number[alive]
        return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*numbers, np.zeros(0, np.int64)])


def differ_by_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = len(commonprefix([a, b]))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:])


def padded(forms: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of letter numbers for each word, and the lengths."""
    sizes = np.array([len(f) for f in forms], np.int64)
    out = np.zeros((len(forms), int(sizes.max(initial=0)) + 1), np.uint8)
    flat = letters[np.frombuffer("".join(forms).encode("latin-1"), np.uint8)]
    row = np.repeat(np.arange(len(forms)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


#: A row: backward or not, the group, the word, its count, whether it asks, how many letters must agree, and, if dealt by place, the length of who asks.
Row = tuple[bool, str, str, int, bool, int, int]


def counted_pair(asks: str, other: str, backward: bool, exact: int, by_place: int) -> bool:
    """Whether a pair found here counts here: backward, if it isn't found forward too; by place, if the words part at that place."""
    if backward and asks[: len(asks) // 2] == other[: len(asks) // 2]:
        return False
    if not by_place:
        return True
    a, b = (asks[::-1], other[::-1]) if backward else (asks, other)
    return min(len(commonprefix([a, b])), len(a) - 1) == exact


def answered(rows: list[Row]) -> Iterator[tuple[str, int, int, int | None, str | None]]:
    """For each row that asks: word, n, how many near words it finds, and the most frequent of these, ties by code points, with its count."""
    backward = rows[0][0]
    form = lambda w: w[::-1] if backward else w
    counts = {form(w): n for _, _, w, n, _, _, _ in rows if len(w) <= LONG}
    forms = sorted(counts)
    asking = [r for r in rows if r[4] and len(r[2]) <= LONG]
    if forms and asking:
        letters = np.zeros(256, np.uint8)
        used = np.unique(np.frombuffer("".join(forms).encode("latin-1"), np.uint8))
        letters[used] = np.arange(1, len(used) + 1)
        automaton = Automaton(*padded(forms, letters))
        for lo in range(0, len(asking), BLOCK):
            some = asking[lo : lo + BLOCK]
            codes, sizes = padded([form(r[2]) for r in some], letters)
            at, number = automaton.near(codes, sizes, np.array([r[5] for r in some], np.int64))
            near: list[list[str]] = [[] for _ in some]
            for k, i in zip(at.tolist(), number.tolist(), strict=True):
                near[k].append(form(forms[i]))
            for (_, _, w, n, _, exact, by_place), found in zip(some, near, strict=True):
                yield best(w, n, [(counts[form(d)], d) for d in found if counted_pair(w, d, backward, exact, by_place)])
    groups: dict[str, list[Row]] = {}
    for r in rows:
        if len(r[2]) >= LONG:
            groups.setdefault(r[1], []).append(r)
    for group in groups.values():
        for _, _, w, n, asks, exact, by_place in group:
            if asks and len(w) > LONG:
                near = [(m, d) for _, _, d, m, _, _, _ in group if differ_by_one(w, d) and counted_pair(w, d, backward, exact, by_place)]
                yield best(w, n, near)
            elif asks and len(w) == LONG:  # the automaton has no longer words
                near = [(m, d) for _, _, d, m, _, _, _ in group if len(d) > LONG and differ_by_one(w, d) and counted_pair(w, d, backward, exact, by_place)]
                yield best(w, n, near)


def best(word: str, n: int, near: list[tuple[int, str]]) -> tuple[str, int, int, int | None, str | None]:
    m, d = min(((-m, d) for m, d in near), default=(None, None))
    return word, n, len(near), None if m is None else -m, d


def answer_rows(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows, sorted by direction and group, to answers."""
    waiting: list[Row] = []

    def out() -> pa.RecordBatch:
        done = list(answered(waiting))
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate(types)], ["word", "n", "n_near", "best_n", "best"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("backward", "group", "word", "n", "asks", "exact", "by_place")), strict=True):
            if waiting and (row[0] != waiting[-1][0] or len(waiting) >= together and row[1] != waiting[-1][1]):
                yield out()
                waiting = []
            waiting.append(row)
    if waiting:
        yield out()


def halves(words: DataFrame) -> DataFrame:
    """Each word in both directions under every half by which a word of its length, or one more or less, may ask; n is its count."""
    size = F.length("word")
    half = lambda backward, k: F.struct(F.lit(backward).alias("backward"), F.floor((size + k) / 2).cast("int").alias("exact"))
    places = F.array_distinct(F.array(half(False, -1), half(False, 0), half(False, 1), half(True, 0), half(True, 1), half(True, 2)))
    out = words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.backward", "p.exact")
    form = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    asks = F.col("exact") == F.floor((size + F.col("backward").cast("int")) / 2)
    return out.withColumns({"form": form, "asks": asks, "half": F.substr(form, F.lit(1), F.col("exact"))})


def by_places(rows: DataFrame) -> DataFrame:
    """Rows under halves with too many words, dealt by the length of who asks and all letters but those about one place."""
    size = F.length("word")
    shortest = 2 * F.col("exact") - F.col("backward").cast("int")
    lengths = F.filter(F.array(shortest, shortest + 1), lambda q: F.abs(q - size) <= 1)
    rows = rows.withColumn("by_place", F.explode(lengths)).withColumn("at", F.explode(F.sequence(F.col("exact"), F.col("by_place") - 1)))
    tail = F.col("by_place") - 1 - F.col("at")
    rest = F.concat_ws(" ", "by_place", "at", F.substr("form", F.lit(1), F.col("at")), F.substr(F.col("form"), size - tail + 1, tail))
    return rows.select("backward", rest.alias("group"), "word", "n", (F.col("asks") & (size == F.col("by_place"))).alias("asks"), F.col("at").alias("exact"), "by_place")


def near_words(words: DataFrame, most: int = MOST, together: int = TOGETHER) -> DataFrame:
    """word, n, n_near, best (struct of -n and word of the most frequent near word, or null) for a stored table of word and n."""
    rows = halves(words)
    key = ["backward", "exact", "half"]
    crowded = stored(rows.groupBy(*key).agg(F.count("*").alias("held")).filter(F.col("held") > most).select(*key), "spelling-crowded")
    listed = small(crowded, 1_000_000)
    some = rows.join(listed, key, "left_anti")
    plain = some.select("backward", F.concat_ws(" ", "exact", "half").alias("group"), "word", "n", "asks", "exact", F.lit(0).alias("by_place"))
    dealt = plain.unionByName(by_places(rows.join(listed, key, "left_semi"))).repartition("backward", "group").sortWithinPartitions("backward", "group")
    answers = dealt.mapInArrow(lambda batches: answer_rows(batches, together), "word string, n long, n_near long, best_n long, best string")
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    return answers.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for a stored table of word and form (not null): the end of each word's chain of forms. Each round doubles the steps
    taken, and counts double along a chain, so a dozen rounds would do for any corpus."""
    steps = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("open").alias("_open"))
        going = steps.filter("open").join(ahead, "root", "left")
        going = going.select("word", F.coalesce("further", "root").alias("root"), (F.col("further").isNotNull() & F.col("_open")).alias("open"))
        steps = stored(going.unionByName(steps.filter("NOT open")), "spelling-roots")
        if not steps.filter("open").limit(1).count():
            return steps.select("word", "root")


def variants(docs: DataFrame, most: int = MOST, together: int = TOGETHER) -> DataFrame:
    """word, form, root, n, n_near, form_n.

    Null and empty texts have no words, a null doc_id is hashed as an empty one. Texts are read whole, and words of any length count. Of equally frequent
    near words the first by code points is the form. Repeated rows count each. Other columns of docs aren't read.
    """
    words = stored(vocabulary(docs), "spelling-words")
    near = near_words(words, most, together)
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best"))
    found = stored(near.withColumn("_form", form).select("word", "n", "n_near", F.col("_form.word").alias("form"), (-F.col("_form.less")).alias("form_n")), "spelling-near")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
