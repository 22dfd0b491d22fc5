"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import stored, table

#: At most so many labelled rows, and as many without label, are used for the fit: those with the least hash of their id.
FIT_ROWS = 12_000
POOL_ROWS = 12_000
ROUNDS = 5
#: The share of the pool that each view labels for the other in a round, of either kind in proportion.
SHARE = 0.05
#: How sure a view must be of a pseudo-label.
SURE = 0.95
CUT = 0.5

TEXT = ("log_words", "symbols", "upper", "digits", "punctuation", "marks", "word_length", "long_words", "one_char_words", "repeated", "distinct", "dup_lines", "line_words", "bars", "non_ascii", "ends", "doubled")
META = ("log_chars", "chars_per_byte", *(f"source_{i}" for i in range(16)), *(f"lang_{i}" for i in range(8)))
CLASSES = np.zeros(256, np.uint8)
CLASSES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
CLASSES[list(b"0123456789")] = 2
CLASSES[list(b".,;:'\"()-")] = 3
CLASSES[list(b"!?")] = 4
CLASSES[list(b"#*$%&<>@^~_=+\\{}[]")] = 5
CLASSES[list(b"|")] = 6


def text_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The features TEXT of each text; zeros for one without words."""
    starts, ends, before = A.word_spans(data, at)
    words = A.word_hashes(data, starts, ends, A.LOWER_VALUES)
    windows = A.window_hashes(words, 3)
    lengths = (ends - starts).astype(np.float64)
    kinds = CLASSES[data]
    sums = [np.concatenate(([0], np.cumsum(kinds == k))) for k in range(1, 7)]
    high = np.concatenate(([0], np.cumsum(data >= 0xC0)))
    letters = np.concatenate(([0], np.cumsum(~A.SPACE[data])))
    whole = data.tobytes()
    out = np.zeros((len(at) - 1, len(TEXT)))
    for i in range(len(out)):
        lo, hi = before[i], before[i + 1]
        n = hi - lo
        if not n:
            continue
        b, e = at[i], at[i + 1]
        size = max(int(letters[e] - letters[b]), 1)
        upper, digits, points, marks, symbols, bars = (float(s[e] - s[b]) / size for s in sums)
        own = np.sort(windows[lo : hi - 2]) if n > 2 else windows[:0]
        again = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
        lines = [x for x in whole[b:e].split(b"\n") if x.strip()]
        size_of = lengths[lo:hi]
        own_words = np.sort(words[lo:hi])
        distinct = (1 + np.count_nonzero(own_words[1:] != own_words[:-1])) / n
        last = kinds[ends[lo:hi] - 1]
        out[i] = (
            np.log1p(n), symbols, upper, digits, points, marks, size_of.mean(), (size_of > 20).mean(), (size_of == 1).mean(), again, distinct * np.log1p(n) / 5,
            1 - len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), bars, float(high[e] - high[b]) / size, float(np.isin(last, (4, 5, 6)).mean()),
            float((words[lo + 1 : hi] == words[lo : hi - 1]).mean()) if n > 1 else 0.0,
        )
    return out


def meta_view(source: list, lang: list, chars: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The features META: length, bytes per character, and source and language as hashed indicators."""
    out = np.zeros((len(source), len(META)))
    out[:, 0] = np.log1p(np.maximum(chars, 0))
    out[:, 1] = np.where(size > 0, chars / np.maximum(size, 1), 1.0)

    def slot(x, n: int) -> int:
        raw = np.frombuffer(repr(x).encode(), np.uint8)
        return int(A.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(n))

    for column, n, first in ((source, 16, 2), (lang, 8, 18)):
        known = {x: slot(x, n) for x in set(column)}
        out[np.arange(len(column)), [first + known[x] for x in column]] = 1.0
    return out


class Logistic:
    """Logistic regression on standardised features, their squares and an indicator of each extreme, with L2."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float = 1e-3, steps: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._spread(x)
        beta = np.zeros(z.shape[1])
        total = weight.sum()
        for _ in range(steps):  # Newton
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            grad = z.T @ ((p - y) * weight) / total + shrink * beta
            curve = (z * (p * (1 - p) * weight + 1e-6)[:, None]).T @ z / total + shrink * np.eye(len(beta))
            step = np.linalg.solve(curve, grad)
            beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-4:
                break
        self.beta = beta
        self.slope, self.shift = 1.0, 0.0

    def _spread(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.concatenate((np.ones((len(z), 1)), z, z**2 / 4, np.maximum(z - 1, 0)), axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._spread(x) @ self.beta

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fits slope and shift of the score to labels that the fit has not seen."""
        if len(y) < 20 or y.min() == y.max():
            return
        r = np.clip(self.raw(x), -30, 30)
        unit = r.std() + 1e-6
        r = r / unit
        a, b = float(unit), 0.0
        n1 = y.sum()
        target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * r + b, -30, 30)))
            g = np.array([((p - target) * r).sum() + 1e-2 * a, (p - target).sum()])
            w = p * (1 - p) + 1e-6
            h = np.array([[(w * r * r).sum() + 1e-2, (w * r).sum()], [(w * r).sum(), w.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            d *= min(1.0, 0.5 / (np.abs(d).max() + 1e-12))  # far from the optimum Newton's steps overshoot
            a, b = a - d[0], b - d[1]
            if np.abs(d).max() < 1e-6:
                break
        if a > 0:
            self.slope, self.shift = float(a / unit), float(b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * self.raw(x) + self.shift, -12, 12)


class CoTrained:
    """Two views and the prior; score combines their log-odds."""

    def __init__(self, text: Logistic | None, meta: Logistic | None, prior: float):
        self.text, self.meta, self.prior = text, meta, prior

    def score(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        base = float(np.log(self.prior / (1 - self.prior)))
        one = self.text.logit(t) if self.text else np.full(len(t), base)
        two = self.meta.logit(m) if self.meta else np.full(len(m), base)
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return chance(one), chance(two), chance(one + two - base)


def cotrain(t: np.ndarray, m: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE) -> CoTrained:
    """y: 1, 0, or -1 for the pool without labels. A fifth of the labelled rows is kept for the calibration and tells which round's views
    are the best together, by their mean log loss (the first of equals). A view's label for the other must be sure both as a chance and as what the
    view adds to the share of that label, so that one that knows nothing but the shares teaches nothing."""
    known = np.flatnonzero(y >= 0)
    prior = float((np.sum(y[known]) + 1) / (len(known) + 2))
    if len(known) < 10 or y[known].min() == y[known].max():
        return CoTrained(None, None, prior)
    hold, learn = known[4::5], np.setdiff1d(known, known[4::5])
    if y[learn].min() == y[learn].max():
        return CoTrained(None, None, prior)
    base = float(np.log(prior / (1 - prior)))
    pool = np.flatnonzero(y < 0)
    views = (t, m)
    own = [dict(zip(learn.tolist(), y[learn].tolist(), strict=True)) for _ in views]
    best_of_all, least = None, np.inf
    for turn in range(rounds + 1):
        models = []
        for x, labels in zip(views, own, strict=True):
            rows = np.fromiter(labels, np.int64, len(labels))
            want = np.array([labels[r] for r in rows.tolist()], float)
            model = Logistic(x[rows], want, np.where(np.isin(rows, pool), 0.5, 1.0))
            model.calibrate(x[hold], y[hold].astype(float))
            models.append(model)
        both = CoTrained(*models, prior)
        p = np.clip(both.score(t[hold], m[hold])[2], 1e-6, 1 - 1e-6)
        loss = float(-np.log(np.where(y[hold] == 1, p, 1 - p)).mean())
        if loss < least - 1e-9:
            best_of_all, least = both, loss
        if turn == rounds or not len(pool):
            break
        for k, model in enumerate(models):
            other = own[1 - k]
            left = np.array([r for r in pool.tolist() if r not in other], np.int64)
            if not len(left):
                continue
            z = model.logit(views[k][left])
            for label, sign, part in ((1, 1.0, prior), (0, -1.0, 1 - prior)):
                chance = 1 / (1 + np.exp(-sign * np.where(sign * base > 0, z - base, z)))  # the less of the two
                best = np.argsort(-chance, kind="stable")[: max(1, int(share * part * len(pool)))]
                other.update((int(left[i]), label) for i in best if chance[i] >= sure)
    return best_of_all


def view_rows() -> Callable:
    """Batches of (label, text, lang, source, n_chars) to (label, t, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, m = views_of(batch)
            yield pa.record_batch([batch.column("label"), pa.array(list(t), pa.list_(pa.float64())), pa.array(list(m), pa.list_(pa.float64()))], ["label", "t", "m"])

    return run


def views_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, at = A.arena(batch.column("text"))
    parts = [text_view(data, offsets) for _, _, data, offsets in A.pieces(raw, at, 1 << 18)]
    chars = batch.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    return (np.concatenate(parts) if parts else np.zeros((0, len(TEXT)))), meta_view(batch.column("source").to_pylist(), batch.column("lang").to_pylist(), chars, np.diff(at))


def scorer(sent):
    """A column function of (text, lang, source, n_chars) to struct(p_text, p_meta, score)."""

    @F.arrow_udf("p_text double, p_meta double, score double")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        t, m = views_of(pa.record_batch([text, lang, source, n_chars], ["text", "lang", "source", "n_chars"]))
        return pa.StructArray.from_arrays([pa.array(s) for s in sent.value.score(t, m)], ["p_text", "p_meta", "score"])

    return score


def _inputs(docs: DataFrame) -> list:
    """text, lang, source and n_chars of docs in their types; what isn't there is null, n_chars the text's length."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return [text.alias("text"), named("lang").alias("lang"), named("source").alias("source"), (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length(text).cast("long")).alias("n_chars")]


def fitted(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS, **options) -> CoTrained:
    """The classifier, learnt from `labelled` (doc_id, label 0 or 1) and a pool of documents without label.

    Both samples are bounded, by `fit_rows` and `pool_rows`, and chosen by the least hash of the id; ids that are
    labelled twice have their greatest label. Nulls: no text is an empty one, no n_chars is 0, no source and no
    language are values of their own; null labels and ids teach nothing.
    """
    truth = labelled.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    truth = stored(truth.withColumnRenamed("doc_id", "_d"), "quality-labels")
    order = [F.xxhash64("_d"), F.col("_d")]
    chosen = truth.orderBy(*order).limit(fit_rows)
    ids = docs.select(F.col("doc_id").alias("_d")).filter("_d IS NOT NULL").distinct().join(truth.select("_d"), "_d", "left_anti")
    pool = ids.orderBy(*order).limit(pool_rows).withColumn("label", F.lit(-1))
    inputs = docs.select(F.col("doc_id").alias("_d"), *_inputs(docs))
    sample = inputs.join(F.broadcast(chosen.union(pool)), "_d").select("label", "text", "lang", "source", "n_chars")
    rows = stored(sample.mapInArrow(view_rows(), "label int, t array<double>, m array<double>"), "quality-sample").toArrow()
    y = rows.column("label").to_numpy().astype(int)
    t = np.array(rows.column("t").to_pylist(), float).reshape(len(y), len(TEXT))
    m = np.array(rows.column("m").to_pylist(), float).reshape(len(y), len(META))
    # one order whatever the partitions
    fixed = np.random.default_rng(8).permutation(np.lexsort((*t.T, *m.T, y))) if len(y) else np.zeros(0, np.int64)
    return cotrain(t[fixed], m[fixed], y[fixed], **options)


def quality_scores(docs: DataFrame, labelled: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """doc_id, p_text, p_meta, score (chance of label 1) and kept (score >= cut) of every document; see `fitted`.

    Without labels of both kinds, or with fewer than 10, every document has the smoothed share of label 1 as its
    score. Repeated rows get equal rows, each row of an id on several texts the score of its own. Texts are read whole,
    however long. Other columns of docs aren't read.
    """
    score = scorer(docs.sparkSession.sparkContext.broadcast(fitted(docs, labelled, **options)))
    scored = docs.select("doc_id", score(*_inputs(docs)).alias("_s")).select("doc_id", "_s.p_text", "_s.p_meta", "_s.score")
    return scored.withColumn("kept", F.col("score") >= cut)


def good_documents(docs: DataFrame, labelled: DataFrame, cut: float = CUT, **options) -> DataFrame:
    """The rows of docs whose score reaches `cut`, each judged alone, without a shuffle; all columns stay, whatever their names.

    Null and empty texts are judged by what is left of them; repeated rows stay or go together; a score of just `cut` stays; an empty
    table gives an empty one.
    """
    score = scorer(docs.sparkSession.sparkContext.broadcast(fitted(docs, labelled, **options)))
    return docs.filter(score(*_inputs(docs))["score"] >= cut)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality_scores(table(spark, sf_dir, "documents"), labels)
