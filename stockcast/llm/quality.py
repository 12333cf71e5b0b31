"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, and learned filters slide over overlapping chunks that cover
the whole text. Each filter is max-pooled over a chunk; a text is described by
the largest, mean and smallest pooled value of each filter over its chunks, which
a logistic layer combines into one probability.

The network is fitted on the driver on a bounded sample of labelled rows: at most
``rows`` per class (by default ``ROWS``), chosen by a hash, whatever the length of
their texts. A text of more than ``fit_chunks`` chunks (``FIT_CHUNKS``) is learned
from that many, spread evenly from its first byte to its last. A label is used
only if crc32(doc_id as text) mod 5 is not 0; the bias is then set to the classes'
true ratio. Scoring takes every text whole, in slices of chunks, in one Arrow pass
without a shuffle.

Defined cases: null and empty texts are one chunk of padding and get that score;
unlabelled rows, labels without document, null labels and documents with labels
of both classes are not learned from; no label of some class gives the constant
score of the other (0.5 without any); repeated rows get equal scores, very long
texts one score from all their chunks; an empty table gives an empty result;
other columns, whatever their names, are carried and never looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stockcast.llm.common import carried, whole

ROWS = 900
FIT_CHUNKS = 48
CHUNK, STEP, WIDTH = 512, 448, 8
FILTERS, DIMS = 16, 4
EPOCHS, BATCH, RATE = 12, 32, 0.02
SLICE = 1024
THRESHOLD = 0.3


class Network(NamedTuple):
    embed: np.ndarray   # 256 x DIMS
    conv: np.ndarray    # WIDTH * DIMS x FILTERS
    conv_bias: np.ndarray
    out: np.ndarray     # 3 * FILTERS
    bias: np.ndarray    # 1


def chunks(text: bytes) -> np.ndarray:
    """Rows of CHUNK bytes, STEP apart, the last one ending with the text; short texts are padded with zeros."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= CHUNK:
        return np.pad(raw, (0, CHUNK - len(raw)))[None, :]
    starts = np.append(np.arange(0, len(raw) - CHUNK, STEP), len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


def windows(net: Network, rows: np.ndarray) -> np.ndarray:
    """(chunk, place, WIDTH * DIMS) embedded bytes under each place of a filter."""
    e = net.embed[rows]
    return np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(rows), CHUNK - WIDTH + 1, WIDTH * DIMS)


def pooled(net: Network, rows: np.ndarray) -> np.ndarray:
    """(chunk, FILTERS): each filter's largest value."""
    parts = [(windows(net, rows[at:at + 64]) @ net.conv).max(axis=1) for at in range(0, len(rows), 64)]
    return np.concatenate(parts) + net.conv_bias


def combined(net: Network, p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Probability per text from its chunks' pooled values; ``ends``: where each text's chunks end."""
    starts = np.concatenate([[0], ends[:-1]])
    feature = np.hstack([np.maximum.reduceat(p, starts), np.add.reduceat(p, starts) / (ends - starts)[:, None], np.minimum.reduceat(p, starts)])
    z = feature @ net.out + net.bias[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_all(net: Network, texts: list[bytes]) -> np.ndarray:
    out, rows, counts = [], [], []

    def flush() -> None:
        if counts:
            out.append(combined(net, pooled(net, np.concatenate(rows)), np.cumsum(counts)))
            rows.clear()
            counts.clear()

    for text in texts:
        cut = chunks(text)
        if len(cut) > SLICE:  # a long text alone, slice by slice
            flush()
            p = np.concatenate([pooled(net, cut[at:at + SLICE]) for at in range(0, len(cut), SLICE)])
            out.append(combined(net, p, np.array([len(cut)])))
            continue
        rows.append(cut)
        counts.append(len(cut))
        if sum(counts) >= SLICE:
            flush()
    flush()
    return np.concatenate(out) if out else np.empty(0)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Network:
    return fit_cut([chunks(t) for t in texts], labels, seed)


def fit_cut(cut: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Network:
    """Adam on the log loss of texts given as chunks; a maximum's gradient goes to the place it came from."""
    rng = np.random.default_rng(seed)
    net = Network(*(x.astype(np.float32) for x in (
        rng.normal(0, 0.5, (256, DIMS)), rng.normal(0, 0.3, (WIDTH * DIMS, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 3 * FILTERS), np.zeros(1))))
    first, second = ([np.zeros_like(x) for x in net] for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(cut))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            grads = gradients(net, [cut[i] for i in chosen], labels[chosen])
            step += 1
            for x, g, m, s in zip(net, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def gradients(net: Network, cut: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    rows, counts = np.concatenate(cut), np.array([len(c) for c in cut])
    ends = np.cumsum(counts)
    starts, owner = ends - counts, np.repeat(np.arange(len(cut)), counts)
    values, places = [], []
    for a in range(0, len(rows), 64):
        s = windows(net, rows[a:a + 64]) @ net.conv
        places.append(s.argmax(axis=1))
        values.append(s.max(axis=1))
    p, place = np.concatenate(values) + net.conv_bias, np.concatenate(places)
    top, low = np.maximum.reduceat(p, starts), np.minimum.reduceat(p, starts)
    feature = np.hstack([top, np.add.reduceat(p, starts) / counts[:, None], low])
    z = feature @ net.out + net.bias[0]
    dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(cut)).astype(np.float32)
    d_out = feature.T @ dz + 1e-4 * net.out
    d_feature = dz[:, None] * net.out[None, :]
    d_top, d_mean, d_low = np.split(d_feature, 3, axis=1)
    at_top, at_low = p == top[owner], p == low[owner]
    share = lambda hit: hit / np.add.reduceat(hit.astype(np.float32), starts)[owner]  # noqa: E731  ties share it
    d_p = d_mean[owner] / counts[owner][:, None] + d_top[owner] * share(at_top) + d_low[owner] * share(at_low)
    d_conv, d_embed = np.zeros_like(net.conv), np.zeros_like(net.embed)
    chunk = np.arange(len(rows))
    for f in range(FILTERS):
        under = rows[chunk[:, None], place[:, f][:, None] + np.arange(WIDTH)]  # chunk x WIDTH bytes
        e = net.embed[under].reshape(len(rows), -1)
        d_conv[:, f] = e.T @ d_p[:, f]
        np.add.at(d_embed, under, (d_p[:, f][:, None] * net.conv[:, f][None, :]).reshape(len(rows), WIDTH, DIMS))
    return [d_embed, d_conv, d_p.sum(axis=0), d_out, np.array([dz.sum()], np.float32)]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def spread(text: Column, fit_chunks: int) -> Column:
    """Pieces of a text to learn from: the text itself, or ``fit_chunks`` of CHUNK bytes from its first to its last."""
    room = F.length(text).cast("long") - CHUNK
    start = lambda k: F.floor(room * k / (fit_chunks - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(fit_chunks - 1)), lambda k: F.substr(text, start(k), F.lit(CHUNK)))
    return F.when(room <= STEP * (fit_chunks - 1), F.array(text)).otherwise(pieces)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    rows: int = ROWS, fit_chunks: int = FIT_CHUNKS,
) -> Network:
    """Fit on at most ``rows`` labelled rows per class, none of them held out, and ``fit_chunks`` (2 at least) chunks of each.

    So the driver holds at most ``2 * rows * fit_chunks * CHUNK`` bytes of text.
    All labels count for the classes' ratio; documents with labels of both
    classes count for none.
    """
    marks = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)").filter(~held_out("i"))
    known = marks.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").select("i", "y")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = Network(*(np.zeros(s, np.float32) for s in ((256, DIMS), (WIDTH * DIMS, FILTERS), FILTERS, 3 * FILTERS, 1)))
    if len(totals) < 2:
        none.bias[0] = {0: -30.0, 1: 30.0}[next(iter(totals))] if totals else 0.0
        return none
    order = F.xxhash64("i")
    # a few candidates more, as some have no document; at most 4 * rows identifiers
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, "i").limit(2 * rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("i"), F.encode(whole(text_col), "UTF-8").alias("t"))
    found = texts.join(F.broadcast(chosen), "i").select("i", spread(F.col("t"), fit_chunks).alias("pieces"), "y")
    sample = [found.filter(F.col("y") == y).orderBy(order, "i", "pieces").limit(rows).toArrow() for y in (0, 1)]
    if not all(t.num_rows for t in sample):
        none.bias[0] = np.log(totals[1] / totals[0])
        return none
    cut = [np.concatenate([chunks(piece) for piece in pieces]) for t in sample for pieces in t.column("pieces").to_pylist()]
    y = np.concatenate([np.full(t.num_rows, k, np.float32) for k, t in enumerate(sample)])
    net = fit_cut(cut, y)
    net.bias[0] += np.log(totals[1] / totals[0]) - np.log(sample[1].num_rows / sample[0].num_rows)
    return net


def scorer(net: Network) -> Callable[[pa.Array], pa.Array]:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(score_all(net, [x or b"" for x in texts.cast(pa.binary()).to_pylist()]).astype(np.float64))

    return of


def scores(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) per row; only the text is looked at for the score."""
    udf = F.arrow_udf(scorer(net), "double")
    return docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), udf(F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    udf = F.arrow_udf(scorer(net), "double")
    return docs.select(carried(docs).alias("row"), udf(F.col(text_col)).alias("score")).filter(F.col("score") >= threshold).select("row.*")
