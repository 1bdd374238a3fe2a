"""Quality rules: base counts, and a classifier of words and characters trained on labelled rows.

Method: logistic regression on hashed word unigrams and bigrams and character (byte) n-grams, each family's counts
divided by their sum. It is fitted on FIT_ROWS labelled documents of at most FIT_BYTES bytes (those whose hashed id is
least; both bounds are parameters), four fifths of them; the others calibrate its score to a probability by Platt's
method. Where these four fifths have one kind only, all are fitted on and the score is the log-odds. Documents are scored in Arrow batches against a fixed threshold.

Base: fewer than 20 words, or more than 30 % of the words in eight-word windows that the text has twice or more.

Edge cases: a null text has no words, so the base fails; rows with a null label or doc_id train nothing; with labels
of one kind only there is nothing to learn and the base alone decides; a label for a repeated doc_id uses the least
text under that id; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import fresh, prepare
from tessera.llm.kernels import BASE, U64, Spans, byte_keys, gram_hashes, mix, repeated, shifted, sums_at, text_bytes, words

FIT_ROWS, FIT_BYTES = 3000, 32768
#: A document stays if it is good with this probability at least.
THRESHOLD = 0.5
MIN_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
BITS, CHARS = 17, (2, 4)
#: Bytes of text worked on at once.
SLICE = 1 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def slices(batch: pa.RecordBatch, at_text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about size bytes of text; a longer text makes a part of its own."""
    _, offsets = text_bytes(batch.column(at_text))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, spans: Spans) -> Words:
    start, end, row = words(data, offsets)
    return Words(start, end, row, spans.hash(start, end))


def base_counts(data: np.ndarray, offsets: np.ndarray, w: Words, spans: Spans) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    n = len(offsets) - 1
    salt = mix(np.arange(n, dtype=U64) + U64(77))
    blank_free = np.zeros(len(data) + 1, np.int32)
    np.add.at(blank_free, w.start, 1)
    np.add.at(blank_free, w.end, -1)
    inside = np.cumsum(blank_free[:-1]) > 0
    # lines: from a row's start or a line feed to the next one
    feeds = np.flatnonzero(data == 0x0A)
    opens = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    closes = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    line_row = np.searchsorted(np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, feeds, "right") - 1])), np.arange(n + 1))
    line_row = np.repeat(np.arange(n), np.diff(line_row))
    word_at = np.searchsorted(w.start, opens)
    has_word = np.searchsorted(w.start, closes) > word_at
    key = mix(spans.hash(opens, closes) ^ salt[line_row])[has_word]
    of = line_row[has_word]
    unique, first = np.unique(key, return_index=True)
    lines = np.bincount(of, minlength=n) - np.bincount(of[first], minlength=n)
    # eight-word windows
    eight = gram_hashes(w.hash, WINDOW)[: max(0, len(w.hash) - WINDOW + 1)] if len(w.hash) >= WINDOW else np.zeros(0, U64)
    whole = w.row[: len(eight)] == w.row[WINDOW - 1 :] if len(eight) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    at = at[repeated(mix(eight[at] ^ salt[w.row[at]]))]
    cover = np.zeros(len(w.hash) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": np.bincount(w.row, minlength=n),
        "word_chars": sums_at(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": sums_at(_SYMBOLS[data], offsets),
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(w.row[covered], minlength=n),
    }


def families(data: np.ndarray, offsets: np.ndarray, w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of features: the row and the hashed place of each occurrence."""
    mask = U64((1 << BITS) - 1)
    pair = mix(w.hash * U64(BASE) + shifted(w.hash, 1))
    two = np.flatnonzero(w.row[:-1] == w.row[1:]) if len(w.row) else np.zeros(0, np.int64)
    out = [(w.row, (w.hash & mask).astype(np.int64)), (w.row[two], (pair[two] & mask).astype(np.int64))]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for size in CHARS:
        if len(data) >= size:
            gram = gram_hashes(byte_keys(5)[data], size)[: len(data) - size + 1]
            whole = row[: len(gram)] == row[size - 1 :]
            out.append((row[: len(gram)][whole], (gram[whole] & mask).astype(np.int64)))
        else:
            out.append((row[:0], row[:0]))
    return [(r, place + i * (1 << BITS)) for i, (r, place) in enumerate(out)]


@dataclass
class Model:
    """Weights over all families, a bias, and the line that makes a score a log-odds; None where nothing was learnt."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
        n = len(offsets) - 1
        score = np.full(n, self.bias)
        for row, place in families(data, offsets, w):
            size = np.maximum(1, np.bincount(row, minlength=n))
            score += np.bincount(row, self.weights[place], minlength=n) / size
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -60, 60)))


def fit(texts: list[str], good: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-6, batch: int = 2) -> Model | None:
    """Train on four fifths of the rows, a few blocks of them a step, and calibrate on the rest."""
    if not len(texts) or good.min() == good.max():
        return None
    # features in blocks of documents, so that a step's temporaries stay small
    blocks = []
    for low in range(0, len(texts), 128):
        part = [t.encode() for t in texts[low : low + 128]]
        data, offsets = np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)])
        rows, places, values = [], [], []
        for row, place in families(data, offsets, find_words(data, offsets, Spans(data, 3))):
            size = np.bincount(row, minlength=len(part))
            unique, count = np.unique(row * (4 << BITS) + place, return_counts=True)
            rows.append((unique // (4 << BITS)).astype(np.int32))
            places.append((unique % (4 << BITS)).astype(np.int32))
            values.append((count / size[rows[-1]]).astype(np.float32))
        blocks.append((low, len(part), np.concatenate(rows), np.concatenate(places), np.concatenate(values)))
    held = np.arange(len(texts)) % 5 == 4
    if good[~held].min() == good[~held].max():
        held[:] = False
    weights, bias = np.zeros(4 << BITS), 0.0
    squares, bias_squares = np.full(len(weights), 1e-6), 1e-6
    # both kinds weigh the same
    weigh = np.where(good == 1, 0.5 / max(1, good[~held].sum()), 0.5 / max(1, (1 - good[~held]).sum())) * ~held

    def scores() -> np.ndarray:
        return bias + np.concatenate([np.bincount(row, value * weights[place], minlength=n) for _, n, row, place, value in blocks])

    rng, order = np.random.Generator(np.random.PCG64(9)), []
    for _ in range(steps):
        if len(order) < batch:
            order = [*rng.permutation(len(blocks)), *order]
        some, order = [blocks[k] for k in order[:batch]], order[batch:]
        grad, shift = decay * weights, 0.0
        for low, n, row, place, value in some:
            score = bias + np.bincount(row, value * weights[place], minlength=n)
            gap = (1 / (1 + np.exp(-np.clip(score, -60, 60))) - good[low : low + n]) * weigh[low : low + n] * (len(blocks) / len(some))
            grad += np.bincount(place, value * gap[row], minlength=len(weights))
            shift += gap.sum()
        squares += grad**2
        weights -= rate * grad / np.sqrt(squares)
        bias_squares += shift**2
        bias -= rate * shift / np.sqrt(bias_squares)
    score = scores()
    slope, shift = platt(score[held], good[held])
    return Model(weights.astype(np.float32), bias, slope, shift)


def platt(score: np.ndarray, good: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the log-odds by Newton's method, with Platt's softened targets."""
    if not len(score) or good.min() == good.max():
        return 1.0, 0.0
    yes, no = good.sum(), len(good) - good.sum()
    target = np.where(good == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([score, np.ones(len(score))], 1)
    line = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -60, 60)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        line = line - np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (line - [1, 0])), -2, 2)
    return max(float(line[0]), 1e-3), float(line[1])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model | None:
    """Fit on the labelled documents with the least hashed ids."""
    marked = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("good")).filter("i is not null and good in (0, 1)")
    chosen = marked.groupBy("i").agg(F.max("good").alias("good")).orderBy(F.xxhash64("i"), "i").limit(rows)
    small = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(F.octet_length("t") <= size)
    found = small.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("t").alias("t"), F.max("good").alias("good")).toArrow().sort_by("i")
    good = found.column("good").to_numpy().astype(float)
    return fit(found.column("t").to_pylist(), good) if len(good) else None


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs, then the base counts, base_failed, probability (null without a model) and kept."""
    prepare(docs.sparkSession)
    names = fresh(docs, *COUNTS, "base_failed", "probability", "kept")
    at_text = docs.columns.index(text)
    kinds = [*[T.LongType()] * len(COUNTS), T.BooleanType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)], *[T.StructField(f"d{i}", k) for i, k in enumerate(kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at_text):
                data, offsets = text_bytes(batch.column(at_text))
                spans = Spans(data, 3)
                w = find_words(data, offsets, spans)
                found = base_counts(data, offsets, w, spans)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])
                good = model.probability(data, offsets, w) if model else None
                stays = ~failed & (good >= threshold) if model else ~failed
                extra = [*[pa.array(found[c].astype(np.int64)) for c in COUNTS], pa.array(failed), pa.array(good, pa.float64()) if model else pa.nulls(batch.num_rows, pa.float64()), pa.array(stays)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[f"c{i}" for i in range(batch.num_columns)] + [f"d{i}" for i in range(len(extra))])

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, schema).toDF(*docs.columns, *names)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and the verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prepare(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", *COUNTS, "base_failed", "kept", "probability")
