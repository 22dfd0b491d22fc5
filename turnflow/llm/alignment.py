"""Cross-tokenizer alignment: which tokens of one tokenizer cover which of another, counted over the corpus.

1. Tasks encode each text twice, Arrow batch by batch, and merge the two rows of cumulative token ends. Ends that both have close a group; each
   distinct end closes one link, the overlap of one token of either side. A chunk of documents gives its documents' links,
   as numbers of the chunk's id pairs, and its pairs with the documents that hold them.
2. Spark adds up the pairs of all chunks, takes each id's maximum on either side and joins both back to the chunks' pairs.
3. A chunk's pairs meet its documents again, and each document sums over its links.

What is shuffled are a chunk's distinct pairs, not the documents' links, so a pair that nearly all documents hold is a row for each
chunk and no more. No task holds more than a chunk or, where that is longer, one document's distinct pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm.common import stored, table
from turnflow.llm.word_model import from_varints, varints

FOLDER = "/opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how byte-level tokenizers cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of white space from which on the faster encoder's search would run out of stack.
BLANK = 200_000
BLANKS = re.compile(rf"\s{{{BLANK}}}")
#: Bytes of text that are encoded together, and that share one list of id pairs.
PIECE, CHUNK = 1 << 20, 16 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


Encoder = tuple[Callable[[list[str]], Iterable[list[int]]], list[bytes]]


@lru_cache(2)
def byte_level(path: str) -> Encoder:
    """Encodes space + text, without special tokens; and the bytes of each id.

    Where the file's merges stand in the order of their ids, merging by rank gives the same ids several times faster.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    table = [b""] * size
    for token, k in vocab.items():
        table[k] = token.encode() if token in added else bytes(letters[c] for c in token)
    merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    merged = [vocab[m.replace(" ", "")] for m in merges]
    pre = spec["pre_tokenizer"] or {}
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    ranked = merged == sorted(set(merged)) and len(merged) + 256 == len(vocab.keys() - added.keys()) and not spec["normalizer"]
    if ranked and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
        import tiktoken

        ranks = {table[k]: k for t, k in vocab.items() if t not in added}
        by_rank = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        alike = lambda t: whole.encode(t, add_special_tokens=False).ids if len(t) > BLANK and BLANKS.search(t) else by_rank.encode_ordinary(t)
        return (lambda texts: (alike(f" {t}") for t in texts)), table
    return (lambda texts: (e.ids for e in whole.encode_batch([f" {t}" for t in texts], add_special_tokens=False))), table


@lru_cache(2)
def pieces(path: str) -> Encoder:
    """Encodes a text, to which the model adds a space; and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        table.append(bytes([int(piece[3:5], 16)]) if model.is_byte(k) else b"" if model.is_control(k) else piece.replace("▁", " ").encode())
    return (lambda texts: model.encode(texts, num_threads=1)), table


def digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal text of 0 .. n-1, in rows with room for one byte more, and its lengths."""
    texts = np.arange(n).astype("S")
    wide = texts.dtype.itemsize
    out = np.zeros((n, wide + 1), np.uint8)
    out[:, :wide] = texts.view(np.uint8).reshape(n, wide)
    return out, (out > 0).sum(axis=1)


def slices(text: str, most: int = PIECE) -> list[str]:
    """A text cut at single spaces between other characters into parts of about `most` code points. No token of either kind has
    a space after its start, so the parts' tokens, with the space put back before each, are the text's."""
    out, start = [], 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at >= 0 and (at + 1 >= len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


class Aligner:
    """Both tokenizers, and the merge of their token ends."""

    def __init__(self, folder: str, first: str, second: str):
        self.a, self.a_bytes = byte_level(os.path.join(folder, first))
        self.b, self.b_bytes = pieces(os.path.join(folder, second))
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.digits, self.n_digits = digits(max(len(self.a_bytes), len(self.b_bytes)))
        self.cuts = not any(b" " in x.lstrip(b" ") for x in [*self.a_bytes, *self.b_bytes])

    def parts(self, text: str) -> list[str]:
        return slices(text) if self.cuts else [text]

    def ids(self, texts: list[str]) -> tuple[list[array], list[array], np.ndarray]:
        """The ids of each part, and which parts' tokens spell it; the others have none."""
        a, b, spelt = [], [], np.ones(len(texts), bool)
        for k, (x, y, t) in enumerate(zip(self.a(texts), self.b(texts), texts, strict=True)):
            want = b" " + t.encode()
            spelt[k] = b"".join(map(self.a_bytes.__getitem__, x)) == want == b"".join(map(self.b_bytes.__getitem__, y))
            a.append(array("i", x if spelt[k] else ()))
            b.append(array("i", y if spelt[k] else ()))
        return a, b, spelt

    def merge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[memoryview], np.ndarray]:
        """For each part: tokens of A and of B, groups, whether it is spelt, its groups as text; and of all links in a row the id pair."""
        a, b, spelt = self.ids(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        a, b = (np.frombuffer(b"".join(x.tobytes() for x in ids), np.int32) for ids in (a, b))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        both = np.concatenate([end_a, end_b])
        order = np.argsort(both, kind="stable")  # two sorted rows: merged in one pass
        of_a = order < len(a)
        ends = both[order]
        second = np.zeros(len(ends), bool)  # the B token that ends where the A token before it does
        second[1:] = ends[1:] == ends[:-1]
        group = np.cumsum(second) - second
        seen_a = np.cumsum(of_a) - of_a
        first = np.flatnonzero(~second)
        pair = a[seen_a[first]].astype(np.int64) * len(self.b_bytes) + b[first - seen_a[first]]
        group_a, group_b = group[of_a], group[~of_a]
        n = int(second.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        n_groups = np.diff(np.concatenate(([0], np.cumsum(second)))[np.concatenate(([0], np.cumsum(n_a + n_b)))])
        # The groups' text: tokens of A, then of B, each with the mark that follows it.
        ids = np.zeros(len(ends), np.int32)
        marks = np.zeros(len(ends), np.uint8)
        for side, groups, before, mark in ((a, group_a, np.cumsum(in_b) - in_b, b"|"), (b, group_b, np.cumsum(in_a), b";")):
            at = np.arange(len(side)) + before[groups]
            ids[at] = side
            last = np.ones(len(side), bool)
            last[:-1] = groups[1:] != groups[:-1]
            marks[at] = np.where(last, mark[0], ord(","))
        rows, sizes = self.digits[ids], self.n_digits[ids]
        rows[np.arange(len(ids)), sizes] = marks
        text = memoryview(rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes())
        at = np.concatenate(([0], np.cumsum(sizes + 1)))[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        return n_a, n_b, n_groups, spelt, [text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], pair


def runs(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return keys[new], np.add.reduceat(times, np.flatnonzero(new)) if len(keys) else times


class Chunk:
    """The documents of a chunk, as they come in parts."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.ids, self.rows, self.shas, self.links, self.bytes = [], [], [], [], 0

    def open(self, doc_id: int | None) -> None:
        self.ids.append(doc_id)
        self.rows.append([0, 0, 0, True])
        self.shas.append(None)

    def add(self, docs: list[int], texts: list[str]) -> None:
        """Parts of documents, in the order of both."""
        n_a, n_b, n_groups, spelt, groups, pair = self.aligner.merge(texts)
        links = n_a + n_b - n_groups
        for k, d in enumerate(docs):
            row = self.rows[d]
            row[:] = row[0] + int(n_a[k]), row[1] + int(n_b[k]), row[2] + int(n_groups[k]), row[3] and bool(spelt[k])
            if self.shas[d] is None:
                self.shas[d] = hashlib.sha256(groups[k][:-1])
            else:
                self.shas[d].update(b";")
                self.shas[d].update(groups[k][:-1])
        keys = np.repeat(np.array(docs, np.uint64), links) << np.uint64(32) | pair.astype(np.uint64)
        keys.sort()
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.links.append((keys[new], np.diff(np.append(new, len(keys)))))

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """The pairs with how many of the documents hold them, then the documents with their links."""
        bad = np.array([not r[3] for r in self.rows], bool)
        keys, times = (np.concatenate([x[k] for x in self.links] or [np.zeros(0, t)]) for k, t in ((0, np.uint64), (1, np.int64)))
        keys, times = runs(keys, times)
        keep = ~bad[(keys >> np.uint64(32)).astype(np.int64)]
        keys, times = keys[keep], times[keep]
        doc = (keys >> np.uint64(32)).astype(np.int64)
        pairs, place, held = np.unique(keys & np.uint64(0xFFFFFFFF), return_inverse=True, return_counts=True)
        n_b = len(self.aligner.b_bytes)
        names = [f.name for f in SCHEMA]
        for lo in range(0, len(pairs), 1 << 16):
            some = pairs[lo : lo + (1 << 16)].astype(np.int64)
            own = {"chunk": np.full(len(some), number), "pair": np.arange(lo, lo + len(some), dtype=np.int32), "a": (some // n_b).astype(np.int32), "b": (some % n_b).astype(np.int32), "held": held[lo : lo + (1 << 16)]}
            yield pa.record_batch([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(some), f.type) for f in SCHEMA], names)
        starts = np.searchsorted(doc, np.arange(len(self.ids) + 1))
        steps = place.astype(np.int64).reshape(-1)
        steps[1:] -= np.where(doc[1:] == doc[:-1], steps[:-1].copy(), 0)
        size = lambda x: np.concatenate(([0], np.cumsum(1 + sum((x >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28)))))[starts]
        blob = lambda x: [v for d in [varints(x)] for at in [size(x)] for v in (d[p:q] for p, q in zip(at[:-1], at[1:], strict=True))]
        shas = ["" if not ok or not a or h is None else h.hexdigest() for (a, _, _, ok), h in zip(self.rows, self.shas, strict=True)]
        counts = [[r[k] if r[3] else 0 for r in self.rows] for k in range(3)]
        own = {"chunk": np.full(len(self.ids), number), "doc_id": self.ids, "n_a": counts[0], "n_b": counts[1], "n_groups": counts[2], "groups_sha256": shas, "links": blob(steps), "times": blob(times)}
        whole = pa.record_batch([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(self.ids), f.type) for f in SCHEMA], names)
        yield from (whole.slice(lo, 1000) for lo in range(0, len(self.ids), 1000))


SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("pair", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("held", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups")] + [("groups_sha256", pa.string()), ("links", pa.binary()), ("times", pa.binary())]
)
STORED = "chunk long, pair int, a int, b int, held long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, times binary"


def encoded(batches: Iterator[pa.RecordBatch], folder: str, first: str, second: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to chunks."""
    aligner = Aligner(folder, first, second)
    number = TaskContext.get().partitionId() << 32
    chunk, docs, texts, waiting = Chunk(aligner), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            chunk.open(doc_id)
            for part in aligner.parts(text.as_py() or ""):
                if part or text.as_py():
                    docs.append(len(chunk.ids) - 1)
                    texts.append(part)
                    waiting += len(part.encode()) + 1
                if waiting >= PIECE:
                    chunk.add(docs, texts)
                    chunk.bytes += waiting
                    docs, texts, waiting = [], [], 0
            if chunk.bytes >= chunk_bytes:
                if docs:
                    chunk.add(docs, texts)
                docs, texts, waiting = [], [], 0
                yield from chunk.batches(number)
                chunk, number = Chunk(aligner), number + 1
    if docs:
        chunk.add(docs, texts)
    yield from chunk.batches(number)


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"


def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links, from the corpus's counts of the chunk's pairs."""
    at = pairs["pair"].to_numpy()
    count, best_a, best_b = (np.zeros(len(at), np.int64) for _ in range(3))
    for out, name in ((count, "n"), (best_a, "best_a"), (best_b, "best_b")):
        out[at] = pairs[name].to_numpy()
    places, times, owner = [], [], []
    for k, (x, y) in enumerate(zip(docs["links"].to_pylist(), docs["times"].to_pylist(), strict=True)):
        if x:
            places.append(np.cumsum(from_varints(x)))
            times.append(from_varints(y))
            owner.append(np.full(len(places[-1]), k))
    place, times, owner = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (places, times, owner))
    edges = np.searchsorted(owner, np.arange(len(docs) + 1))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
    sums = {"n_links": total(times), "n_best": total(times * best_a[place]), "n_best_b": total(times * best_b[place]), "count_sum": total(times * count[place])}
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.table([pa.array(sums[c]) if c in sums else docs[c] for c in names], names)


def align(docs: DataFrame, folder: str = FOLDER, first: str = BYTE_LEVEL, second: str = PIECES, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b (the same by B ids), count_sum, groups_sha256.

    `folder` must hold both vocabulary files on every executor. Null and empty texts, and those that either tokenizer doesn't spell
    byte for byte (U+2581 is a space to the second), have no tokens: zeros and ''. Texts are read whole; long ones are encoded in parts cut where both
    tokenizers begin a token. Each row is a document of its own, repeated and null ids included; on equal counts
    all pairs of an id are best. Other columns of docs aren't read.
    """
    kept = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = stored(kept.mapInArrow(lambda batches: encoded(batches, folder, first, second, chunk_bytes), STORED), "alignment")
    pairs = found.filter("pair IS NOT NULL").select("chunk", "pair", "a", "b", "held")
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("held").alias("n")), "alignment-pairs")
    # One row for each id of a vocabulary file at most.
    top = lambda side: F.broadcast(counts.groupBy(side).agg(F.max("n").alias(f"top_{side}")))
    best = lambda side: (F.col("n") == F.col(f"top_{side}")).cast("int").alias(f"best_{side}")
    ranked = counts.join(top("a"), "a").join(top("b"), "b").select("a", "b", "n", best("a"), best("b"))
    back = pairs.join(ranked, ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "pair", "n", "best_a", "best_b")
    rows = found.filter("links IS NOT NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times")
    return rows.groupBy("chunk").cogroup(back.groupBy("of_chunk")).applyInArrow(summed, OUT)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
