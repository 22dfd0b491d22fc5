"""Quality rules: simple counts, and bands of perplexity under a modified Kneser-Ney model of the corpus itself.

The model and its scores are in `word_model`: Spark counts word pairs over all documents, by language, in sorted arrays of
hashes, and scores each half of the documents by the other half's counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm import arena as A
from turnflow.llm.common import small, stored, table
from turnflow.llm.word_model import log_means

#: How far the bands reach below the first and above the third quartile, in interquartile ranges. The lower one is wide: near copies whose others
#: fell into the other fold are far below the quartile, whatever their quality.
FENCES = (6.0, 1.5)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def text_counts(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    starts, ends, before = A.word_spans(data, at)
    words = A.word_hashes(data, starts, ends)
    windows = A.window_hashes(words, 3)
    first_bytes = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~A.SPACE[data])))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    whole = data.tobytes()
    out = []
    for i in range(len(at) - 1):
        lo, hi = before[i], before[i + 1]
        repeated = 0
        if hi - lo > 3:
            w = windows[lo : hi - 2]
            order = np.argsort(w, kind="stable")
            same = w[order[1:]] == w[order[:-1]]
            if same.any():
                twice = np.zeros(len(w) + 3, np.int32)
                hit = np.union1d(order[1:][same], order[:-1][same])
                twice[hit] += 1
                np.subtract.at(twice, hit + 3, 1)
                repeated = int((np.cumsum(twice) > 0).sum())
        text = whole[at[i] : at[i + 1]]
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        out.append((int(hi - lo), int(first_bytes[at[i + 1]] - first_bytes[at[i]]), int(symbols[at[i + 1]] - symbols[at[i]]), len(lines) - len(set(lines)), repeated))
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(scored: DataFrame, fences: tuple[float, float]) -> DataFrame:
    """The verdicts on measured documents, by the base rules and the bands."""
    scored = scored.withColumn("log_perplexity", F.round(-F.col("log_mean"), 3)).drop("log_mean")
    q = scored.filter("log_perplexity IS NOT NULL").groupBy("lang").agg(F.percentile("log_perplexity", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    span = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01))
    bands = stored(q.select("lang", (F.col("q")[0] - fences[0] * span).alias("band_low"), (F.col("q")[1] + fences[1] * span).alias("band_high")), "quality-bands")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("log_perplexity").between(F.col("band_low"), F.col("band_high"))
    return scored.join(small(bands, 100_000), "lang", "left").select(
        "doc_id", "lang", *COUNTS, failed.alias("base_failed"), "log_perplexity", "band_low", "band_high", (~failed & F.coalesce(inside, F.lit(True))).alias("kept")
    )


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, lang, row, also, text) to their counts."""
    for batch in batches:
        raw, at = A.arena(batch.column("text"))
        rows = [r for _, _, data, offsets in A.pieces(raw, at, 1 << 18) for r in text_counts(data, offsets)]
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
        yield pa.record_batch([*[batch.column(c) for c in ("doc_id", "lang", "row", "also")], *counts], ["doc_id", "lang", "row", "also", *COUNTS])


def word_quality(docs: DataFrame, fences: tuple[float, float] = FENCES, buckets: int | None = None) -> DataFrame:
    """doc_id, lang, the counts, base_failed, log_perplexity (of a word), band_low, band_high, kept.

    A document is rejected if it fails the base rules (under 50 words, or over half of its words in repeated 3-word
    windows) or its log-perplexity under the other fold's model of its language is outside the language's band: `fences`
    interquartile ranges beyond the quartiles, below and above, over all of its documents, and on an edge it is kept. Null and empty languages are
    one, a language of their own. Texts of fewer than two words, empty and null ones have no perplexity and fail for their
    words alone. Texts are read whole, however long. Repeated rows count each and get equal results; each text of an id has its
    own. Other columns of docs aren't read.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumns({"row": F.xxhash64("text", "lang"), "also": F.xxhash64(F.lit("also"), "doc_id", "text"), "l": F.xxhash64("lang")})
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = texts.select("doc_id", "lang", "row", "also", "text").mapInArrow(count_rows, f"doc_id {kind}, lang string, row long, also long, {', '.join(f'{c} long' for c in COUNTS)}")
    means = log_means(texts.select("row", "also", "l", "text"), buckets)
    return judged(stored(counted.join(means, ["row", "also"], "left").drop("row", "also"), "quality"), fences)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_quality(table(spark, sf_dir, "documents"))
