"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. In a chunk, learned filters of WIDTH bytes slide over
all positions; their outputs are max-pooled over windows, and of a filter's windows the mean and the maximum are kept
(where they are equal in all filters the text repeats itself). A hidden layer combines a chunk's values, its units are
pooled over the chunks by maximum and mean, and one logistic unit gives the probability.

The model is fitted on at most TRAIN_DOCS labelled documents (those of the smallest hashes of their id), on the whole text
of each; that is all the driver gets. Fitting and scoring go through a long text in blocks of chunks.

Definitions. A null or empty text is one chunk without bytes and has a score like any other. NUL characters are bytes like
others: where a text ends is known from its length. Without labelled rows all scores are 0.5. Labels that are null are not
used. Repeated rows are scored alike; a null id is held in (its text has no checksum). No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns

#: WINDOW is a power of two: maxima are taken by halves.
WIDTH, WINDOW, WINDOWS = 5, 32, 8
SPOTS = WINDOW * WINDOWS
CHUNK, STRIDE = SPOTS + WIDTH - 1, SPOTS - WINDOW
FILTERS, HIDDEN = 16, 16
#: What stands after a text's last byte.
END = 256
TRAIN_DOCS, EPOCHS, RATE = 3000, 14, 0.01
#: Chunks that are looked at together, for a bound on memory.
BLOCK = 128


def starts(n: int) -> int:
    """The number of chunks of n bytes."""
    return 1 if n <= CHUNK else 1 + -(-(n - CHUNK) // STRIDE)


def chunks(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Chunks first to last - 1 of a text. They begin STRIDE bytes apart, but the last one ends where the text ends."""
    n = starts(len(data))
    last = n if last is None else last
    if n == 1:
        out = np.full((1, CHUNK), END, np.uint16)
        out[0, : len(data)] = np.frombuffer(data, np.uint8)
        return out
    at = np.minimum(np.arange(first, last) * STRIDE, len(data) - CHUNK)
    every = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8)[at[0] : at[-1] + CHUNK], CHUNK)
    return every[at - at[0]].astype(np.uint16)


@dataclass
class Model:
    table: np.ndarray  # WIDTH x 257 x FILTERS: a filter's weight for each byte, or the end, at each place
    bias: np.ndarray
    mix: np.ndarray  # 2 FILTERS x HIDDEN
    mix_bias: np.ndarray
    out: np.ndarray  # 2 HIDDEN
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.table, self.bias, self.mix, self.mix_bias, self.out, self.out_bias]


def new_model(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    f = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Model(f(0.3, WIDTH, END + 1, FILTERS), np.zeros(FILTERS, np.float32), f((2 * FILTERS) ** -0.5, 2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), f(0.2, 2 * HIDDEN), np.zeros(1, np.float32))


def chunk_values(m: Model, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """(values of each chunk, what their gradient needs). A window counts if the text reaches into it."""
    z = np.take(m.table[0], x[:, :SPOTS], axis=0, mode="clip")
    part = np.empty_like(z)
    for j in range(1, WIDTH):
        z += np.take(m.table[j], x[:, j : j + SPOTS], axis=0, out=part, mode="clip")
    z = z.reshape(len(x), WINDOWS, WINDOW, FILTERS)
    top = z
    while top.shape[2] > 1:
        half = top.shape[2] // 2
        top = np.maximum(top[:, :, :half], top[:, :, half:])
    pooled = np.maximum(top[:, :, 0] + m.bias, 0)
    count = np.clip(-(-(x != END).sum(1) // WINDOW), 1, WINDOWS)
    pooled *= (np.arange(WINDOWS) < count[:, None])[:, :, None]
    return np.concatenate([pooled.sum(1) / count[:, None], pooled.max(1)], 1).astype(np.float32), (z, pooled, count)


def pooled_logits(m: Model, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The logit of each document; first: where each one's chunks begin."""
    h = np.maximum(values @ m.mix + m.mix_bias, 0)
    number = np.diff([*first, len(h)])
    top, mean = np.maximum.reduceat(h, first), np.add.reduceat(h, first) / number[:, None]
    both = np.concatenate([top, mean], 1)
    return both @ m.out + m.out_bias[0], (h, number, top, both)


def filter_gradients(x: np.ndarray, needs: tuple, d_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the table and the bias, from the gradient of the chunks' values."""
    z, pooled, count = needs
    peak = pooled.max(1, keepdims=True)
    is_peak = (pooled == peak) & (pooled > 0)
    d_pool = d_values[:, None, :FILTERS] / count[:, None, None] + is_peak / np.maximum(is_peak.sum(1, keepdims=True), 1) * d_values[:, None, FILTERS:]
    d_pool = d_pool * (pooled > 0)
    row, window, unit = np.nonzero(d_pool)
    spot, g = window * WINDOW + z.argmax(2)[row, window, unit], d_pool[row, window, unit]
    at = [x[row, spot + j].astype(np.intp) * FILTERS + unit for j in range(WIDTH)]
    d_table = np.stack([np.bincount(a, g, (END + 1) * FILTERS).reshape(END + 1, FILTERS) for a in at])
    return d_table.astype(np.float32), d_pool.sum((0, 1))


def gradients(m: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, block: int = 8 * BLOCK) -> list[np.ndarray]:
    """Of the mean loss. More chunks than a block are gone through twice, so that only their values are held."""
    cuts = range(0, len(x), block)
    found = [chunk_values(m, x[k : k + block]) for k in cuts] if len(cuts) == 1 else [(chunk_values(m, x[k : k + block])[0], None) for k in cuts]
    values = np.concatenate([v for v, _ in found])
    logit, (h, number, top, both) = pooled_logits(m, values, first)
    d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
    d_both = d[:, None] * m.out
    of = np.repeat(np.arange(len(first)), number)
    is_top = h == top[of]
    d_h = is_top / np.maximum(np.add.reduceat(is_top, first, dtype=np.int32), 1)[of] * d_both[of, :HIDDEN] + d_both[of, HIDDEN:] / number[of, None]
    d_h = (d_h * (h > 0)).astype(np.float32)
    d_values = d_h @ m.mix.T
    d_table, d_bias = np.zeros_like(m.table), np.zeros_like(m.bias)
    for k, (_, needs) in zip(cuts, found, strict=True):
        part = x[k : k + block]
        t, b = filter_gradients(part, needs or chunk_values(m, part)[1], d_values[k : k + block])
        d_table += t
        d_bias += b
    return [d_table, d_bias, values.T @ d_h, d_h.sum(0), both.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model | None:
    """Adam over batches of 32 documents."""
    if not len(y):
        return None
    m, rng, step = new_model(), np.random.default_rng(seed), 0
    m.out_bias[:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    first, second = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) ** 0.5
        for batch in np.array_split(rng.permutation(len(y)), -(-len(y) // 32)):
            step += 1
            at = np.cumsum([0, *(starts(len(texts[i])) for i in batch[:-1])])
            for p, g, a, b in zip(m.params(), gradients(m, np.concatenate([chunks(texts[i]) for i in batch]), at, y[batch]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)
    return m


def score(m: Model | None, data: list[bytes]) -> np.ndarray:
    """The probability of each text. Short texts are taken together, long ones block by block."""
    if m is None:
        return np.full(len(data), 0.5)
    tops, means = np.zeros((len(data), HIDDEN)), np.zeros((len(data), HIDDEN))
    held: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if held:
            values, _ = chunk_values(m, np.concatenate([c for _, c in held]))
            h, at = np.maximum(values @ m.mix + m.mix_bias, 0), 0
            for i, c in held:
                part = h[at : at + len(c)]
                at += len(c)
                tops[i] = np.maximum(tops[i], part.max(0))
                means[i] += part.sum(0, dtype=np.float64)
            held.clear()

    size = 0
    for i, text in enumerate(data):
        n = starts(len(text))
        for k in range(0, n, BLOCK):
            held.append((i, chunks(text, k, min(n, k + BLOCK))))
            size += len(held[-1][1])
            if size >= BLOCK:
                flush()
                size = 0
    flush()
    number = np.array([starts(len(t)) for t in data], float)
    logit = np.concatenate([tops, means / np.maximum(number, 1)[:, None]], 1) @ m.out + m.out_bias[0]
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...); rows that are held out are not looked at.

    The driver gets TRAIN_DOCS rows at most, whatever ids repeat; their texts are its memory.
    """
    known = own_columns(labels, "doc_id", "quality").where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAIN_DOCS)
    # at most TRAIN_DOCS rows, so the broadcast is bounded
    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", F.col("quality").cast("int"), "text")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "text").limit(TRAIN_DOCS).collect()
    return fit([_bytes(r.text) for r in rows], np.array([r.quality for r in rows], np.float32))


def _scored(m: Model | None, extra: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([np.zeros(0), *(score(m, [_bytes(t.as_py()) for t in batch.column(extra).slice(k, 256)]) for k in range(0, batch.num_rows, 256))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array(found, pa.float64())], [*batch.schema.names[:extra], "score"])

    return run


def quality(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score, a row for each row of docs. No shuffle; the model is some 90 KB."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_scored(model, len(keep)), f"{kinds}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
