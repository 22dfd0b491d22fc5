"""Toxicity by a counterfactual-regularised linear classifier over the words and stems of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import stored, table

#: log2 of the number of hashed word features.
BITS = 20
#: The classifier is fitted on at most so many labelled rows, those with the least hash of their id.
FIT_ROWS = 8_000
#: And on so many features of them together at most, in the same order: what the driver gets is bounded in bytes too.
FIT_FEATURES = 20_000_000
CUT = 0.7
#: The score is moved so that `CUT` lies where held-out labels are told apart best, by models of so many folds; a text without telling words stays
#: this much, as a logit, under it.
FOLDS, UNDER = 3, 0.5
#: Weight of the penalty on score changes between a sentence and itself with another term of the same group.
PAIRING = 2.0
SHRINK = 5e-4
STEPS = 200
#: Groups of identity terms that are neutral by themselves.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "heterosexual"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male"),
    ("american", "mexican", "chinese", "indian", "german", "french", "russian", "turkish"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("deaf", "blind", "disabled", "autistic"),
    ("christ", "musulman", "juif", "chrétien", "hindou"),
    ("frau", "mann"),
    ("femme", "homme"),
    ("mujer", "hombre"),
)
TRIM = np.zeros(256, bool)
TRIM[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Words also count under their first bytes, so that forms of one stem teach each other.
STEMS = (6, 9)


def trimmed_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end without outer ASCII punctuation, and the number of words before each text."""
    starts, ends, before = A.word_spans(raw, at)
    starts, ends = starts.copy(), ends.copy()
    for edge, step, look in ((ends, -1, -1), (starts, 1, 0)):
        left = np.flatnonzero(ends - starts > 1)
        while len(left):
            left = left[TRIM[raw[edge[left] + look]] & (ends[left] - starts[left] > 1)]
            edge[left] += step
    return starts, ends, before


def hash_of(term: str) -> np.uint64:
    raw = np.frombuffer(term.encode(), np.uint8)
    return A.word_hashes(raw, np.array([0]), np.array([len(raw)]), A.LOWER_VALUES)[0]


def hashes_of(groups: Sequence[Sequence[str]]) -> np.ndarray:
    """The ascending word hashes of all terms."""
    return np.array(sorted({hash_of(t) for g in groups for t in g}), np.uint64)


TERMS = hashes_of(IDENTITY)


def text_features(raw: np.ndarray, at: np.ndarray, bits: int = BITS, terms: np.ndarray = TERMS) -> Iterator[np.ndarray]:
    """The distinct hashed features of each text: its words, ASCII letters in lower case, the stems of its longer
    words, and the stems that two different words of it have. An identity term is a word and has no stem: nothing but
    its own feature tells which term it is, so swapping two terms swaps two features and leaves all others."""
    starts, ends, before = trimmed_words(raw, at)
    shift = np.uint64(64 - bits)
    words = A.word_hashes(raw, starts, ends, A.LOWER_VALUES)
    plain = np.ones(len(words), bool)
    if len(terms):
        plain = terms[np.minimum(np.searchsorted(terms, words), len(terms) - 1)] != words
    stems = []
    for k in STEMS:
        long = (ends - starts > k) & plain
        stem = np.zeros(len(words), np.uint64)
        stem[long] = A.mix(A.word_hashes(raw, starts[long], starts[long] + k, A.LOWER_VALUES) + np.uint64(k)) | np.uint64(1)
        stems.append(stem)
    for i in range(len(at) - 1):
        own, first = np.unique(words[before[i] : before[i + 1]], return_index=True)
        parts = [own]
        for stem in stems:
            some = np.sort(stem[before[i] + first])
            some = some[np.searchsorted(some, 1) :]
            edge = np.append(True, some[1:] != some[:-1])[: len(some)]
            again = some[1:][some[1:] == some[:-1]]
            parts += [some[edge], A.mix(again)]
        yield np.unique((np.concatenate(parts) >> shift).astype(np.int32))


def term_feature(term: str, bits: int = BITS) -> int:
    return int(hash_of(term) >> np.uint64(64 - bits))


def swaps(features: np.ndarray, groups: Sequence[Sequence[int]]) -> list[tuple[list[int], list[int]]]:
    """What each swap of the identity terms of a text (its distinct features) adds to and takes from it. The terms have
    no other features, so these are all that the text with the other terms would have and not have."""
    own = set(features.tolist())
    out = []
    for group in groups:
        there = [g for g in group if g in own]
        for k in range(1, len(group)) if there else ():
            turned = [group[(group.index(g) + k) % len(group)] for g in there]
            out.append(([t for t in turned if t not in own], [g for g in there if g not in turned]))
    return out


def gather(bits: int, terms: np.ndarray) -> Callable:
    """Batches of (mark, label, text) to (mark, label, features: the distinct ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = A.arena(batch.column("text"))
            out = []
            for _, _, data, offsets in A.pieces(raw, at, 1 << 18):
                out += text_features(data, offsets, bits, terms)
            yield pa.record_batch([batch.column("mark"), batch.column("label"), pa.array(out, pa.list_(pa.int32()))], ["mark", "label", "features"])

    return run


class Model:
    """Weights of the hashed features, and a constant."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights, constant

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features].sum() + self.constant, -30, 30))))


def fit(labels: np.ndarray, rows: list[np.ndarray], bits: int = BITS, pairing: float = PAIRING, shrink: float = SHRINK, steps: int = STEPS, identity: Sequence[Sequence[str]] = IDENTITY) -> Model:
    """Logistic regression by proximal gradient descent with momentum, an L1 penalty, and the squared change of the
    score under every swap of identity terms as a further penalty."""
    n = len(labels)
    weights = np.zeros(1 << bits, np.float32)
    positive = float(np.sum(labels)) if n else 0.0
    constant = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not n or positive in (0.0, float(n)):
        return Model(weights, constant)
    groups = [[term_feature(t, bits) for t in g] for g in identity]
    counts = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if counts.sum() else np.zeros(0, np.int32)
    used, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    # a word of one document or two teaches its document only; identity terms stay, to be held down
    keep = (often >= 3) | np.isin(used, [f for g in groups for f in g])
    row = np.repeat(np.arange(n), counts)[keep[column]]
    column = (np.cumsum(keep) - 1)[column[keep[column]]]
    used = used[keep]
    place = {int(f): i for i, f in enumerate(used)}
    delta_row, delta_col, delta_sign, n_deltas = [], [], [], 0
    for r in rows:
        for plus, minus in swaps(r, groups):
            cells = [(place[f], s) for fs, s in ((plus, 1.0), (minus, -1.0)) for f in fs if f in place]
            if cells:
                delta_row += [n_deltas] * len(cells)
                delta_col += [c for c, _ in cells]
                delta_sign += [s for _, s in cells]
                n_deltas += 1
    delta_row, delta_col, delta_sign = np.array(delta_row, np.int64), np.array(delta_col, np.int64), np.array(delta_sign)
    m = len(used)
    w = np.zeros(m)
    velocity, second = np.zeros(m), np.zeros(m)
    y = labels.astype(float)
    # both classes weigh half: the score is then shifted back by the prior
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (n - positive))
    c = 0.0
    rate = 0.1
    for step in range(1, steps + 1):
        z = np.bincount(row, w[column], n) + c
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(column, error[row], m)
        if n_deltas:
            change = np.bincount(delta_row, delta_sign * w[delta_col], n_deltas)
            grad += 2 * pairing / n_deltas * np.bincount(delta_col, delta_sign * change[delta_row], m)
        velocity = 0.9 * velocity + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        scale = rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
        w = w - scale * velocity / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * shrink, 0)
        c -= error.sum()
    weights[used] = w
    z = np.bincount(row, w[column], n)
    for _ in range(25):  # the constant for the labels as they are
        p = 1 / (1 + np.exp(-np.clip(z + c, -30, 30)))
        c -= (p - y).sum() / max((p * (1 - p)).sum(), 1e-3) * 0.5
    return Model(weights, float(np.clip(c, -30, 30)))


def turning_point(labels: np.ndarray, rows: list[np.ndarray], least: float, cut: float = CUT, folds: int = FOLDS, **options) -> tuple[float, float] | None:
    """The logit from which on calling a text toxic is best, by the F measure on rows that each fold's model hasn't seen, but over `least`; and
    the slope from 1 to 4 of the likeliest chances that are `cut` there. None if a label has too few rows. rows are in an order in which neighbours are alike."""
    y = np.asarray(labels, float)
    if min(y.sum(), len(y) - y.sum()) < 10 * folds:
        return None
    seen, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        own = np.flatnonzero(fold != k)
        model = fit(labels[own], [rows[i] for i in own], **options)
        for i in np.flatnonzero(fold == k):
            seen[i] = model.weights[rows[i]].sum() + model.constant
    order = np.argsort(-seen, kind="stable")
    z, hits = seen[order], np.cumsum(y[order])
    measure = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    measure[:-1][z[:-1] == z[1:]] = 0.0  # equal logits stay together
    best = int(measure.argmax())
    turn = max(least, float(z[best] + z[min(best + 1, len(z) - 1)]) / 2)
    slopes = np.linspace(1, 4, 61)
    chances = slopes[:, None] * (seen - turn) + np.log(cut / (1 - cut))
    return turn, float(slopes[(np.logaddexp(0, chances) - y * chances).sum(axis=1).argmin()])


def score_rows(bits: int, terms: np.ndarray, sent) -> Callable:
    """Batches of (doc_id, text) to (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            raw, at = A.arena(batch.column("text"))
            scores = []
            for _, _, data, offsets in A.pieces(raw, at, 1 << 18):
                scores += [model.score(f) for f in text_features(data, offsets, bits, terms)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, bits: int = BITS, cut: float = CUT, fit_features: int = FIT_FEATURES, identity: Sequence[Sequence[str]] = IDENTITY, **options) -> DataFrame:
    """doc_id, score, predicted of every document, learnt from `labelled` (doc_id, label 0 or 1).

    At most `fit_rows` labelled rows with `fit_features` features together are used, those with the least hash of their
    id; ids that are labelled twice have their greatest label, ids on several texts their greatest text, null labels and
    ids are left out. The score is calibrated on folds of these rows: `cut` is where labels that a fold's model hasn't seen are told apart best. Every text is scored whole, however long, by its own words alone, so ties, repeated rows and ids on
    several texts change nothing. Empty and null texts have the score of a text without telling words. Without labels of
    both kinds every document gets the labels' share, smoothed. Other columns of docs aren't read.
    """
    spark = docs.sparkSession
    terms = hashes_of(identity)
    some = labelled.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).withColumnRenamed("doc_id", "_d")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    train = texts.join(F.broadcast(some), F.col("doc_id") == F.col("_d")).groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))
    train = train.select(F.xxhash64("doc_id").alias("mark"), "label", "text")
    rows = stored(train.mapInArrow(gather(bits, terms), "mark long, label int, features array<int>"), "toxic-sample")
    upto = rows.select("mark", F.sum(F.size("features")).over(Window.orderBy("mark")).alias("upto"))  # of `fit_rows` rows at most
    last = upto.filter(F.col("upto") <= fit_features).agg(F.max("mark")).first()[0]
    rows = rows.filter(F.col("mark") <= last if last is not None else F.lit(False)).orderBy("mark").toArrow()
    labels = rows.column("label").to_numpy().astype(np.int8)
    lists = rows.column("features").combine_chunks()
    ends = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    order = np.lexsort((np.diff(ends), labels)) if len(labels) else []
    own = [values[ends[i] : ends[i + 1]] for i in order]
    model = fit(labels[order], own, bits, identity=identity, **options)
    found = turning_point(labels[order], own, model.constant + UNDER, cut, bits=bits, identity=identity, **options)
    if found is not None:
        turn, slope = found
        model = Model(model.weights * np.float32(slope), slope * (model.constant - turn) + float(np.log(cut / (1 - cut))))
    sent = spark.sparkContext.broadcast(model)
    kinds = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(score_rows(bits, terms, sent), f"doc_id {kinds}, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, sf_dir, "labels").filter(~fold()).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "score", "predicted")
