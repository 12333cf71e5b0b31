"""The classifier against a plain forward pass, numeric gradients, long texts, ties of labels and awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockcast.llm import quality


def some_net(seed: int, kind=np.float64) -> quality.Network:
    rng = np.random.default_rng(seed)
    shapes = ((256, quality.DIMS), (quality.WIDTH * quality.DIMS, quality.FILTERS), quality.FILTERS, 3 * quality.FILTERS, 1)
    return quality.Network(*(rng.normal(0, 0.4, shape).astype(kind) for shape in shapes))


def some_texts(seed: int) -> list[bytes]:
    rng = np.random.default_rng(seed)
    return [b"", b"x", *(rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (7, 511, 512, 513, 960, 961, 2000))]


def plain_score(net: quality.Network, text: bytes) -> float:
    """The definition, place by place."""
    size, step, width = quality.CHUNK, quality.STEP, quality.WIDTH
    padded = text + bytes(max(0, size - len(text)))
    starts = [*range(0, len(padded) - size, step), len(padded) - size]
    best = []
    for start in starts:
        chunk = padded[start:start + size]
        values = [
            [sum(float(net.embed[chunk[at + w], d] * net.conv[w * quality.DIMS + d, f]) for w in range(width) for d in range(quality.DIMS)) for f in range(2)]
            for at in range(size - width + 1)
        ]
        best.append([max(v[f] for v in values) + net.conv_bias[f] for f in range(2)])
    z = net.bias[0]
    for f in range(2):
        of = [b[f] for b in best]
        z += max(of) * net.out[f] + sum(of) / len(of) * net.out[quality.FILTERS + f] + min(of) * net.out[2 * quality.FILTERS + f]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_forward_pass():
    net = some_net(3)
    net.out.reshape(3, quality.FILTERS)[:, 2:] = 0  # two filters, as the plain pass is slow
    texts = some_texts(5)[:7]
    assert np.allclose(quality.score_all(net, texts), [plain_score(net, t) for t in texts], atol=1e-9)


def loss(net: quality.Network, cut: list[np.ndarray], labels: np.ndarray) -> float:
    p = np.concatenate([quality.combined(net, quality.pooled(net, c), np.array([len(c)])) for c in cut])
    return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + 0.5e-4 * float(net.out @ net.out)


@pytest.mark.parametrize("part", range(5))
def test_gradients_equal_differences(part):
    net, cut = some_net(7), [quality.chunks(t) for t in some_texts(11)]
    labels = np.array([1, 0] * 5, float)[:len(cut)]
    found = quality.gradients(net, cut, labels)[part].ravel()
    flat = net[part].ravel()  # a view
    rng = np.random.default_rng(part)
    for k in set(rng.integers(0, len(flat), 12).tolist()) | {0}:
        kept, wide = flat[k], 1e-5
        flat[k] = kept + wide
        up = loss(net, cut, labels)
        flat[k] = kept - wide
        down = loss(net, cut, labels)
        flat[k] = kept
        assert found[k] == pytest.approx((up - down) / (2 * wide), rel=1e-3, abs=2e-6)


def test_long_texts_are_learned_from_first_byte_to_last(spark):
    sizes = [0, 10, 512, 513, 512 + 448 * 3, 512 + 448 * 3 + 1, 5000, 60_000]
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes]
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, t binary")
    found = {r["i"]: [bytes(p) for p in r["p"]] for r in rows.select("i", quality.spread(F.col("t"), 4).alias("p")).collect()}
    for i, text in enumerate(texts):
        if len(quality.chunks(text)) <= 4:
            assert found[i] == [text]
            continue
        assert len(found[i]) == 4 and all(len(p) == quality.CHUNK for p in found[i])
        assert text.startswith(found[i][0]) and text.endswith(found[i][-1])
        places = [text.index(p) for p in found[i]]
        assert max(np.diff(places)) - min(np.diff(places)) <= 1


def test_documents_that_are_all_long_are_learned_from(spark):
    docs = spark.createDataFrame(
        [(i, ("a fine sentence of good words. " if i % 2 else "zz## buy!! %%$$ now ") * 1600) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    net = quality.train(docs, labels)
    found = {r["id"]: r["predicted"] for r in quality.scores(docs, net).collect()}
    assert all(found[i] == i % 2 for i in found)


def test_documents_with_labels_of_both_classes_count_for_none(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "##!! ") * 30) for i in range(40)], "doc_id long, text string")
    fair = [(i, i % 2) for i in range(40)]
    both = [(i, y) for i in range(0, 40, 4) for y in (0, 1)]
    other = [(i, y) for i, y in fair if i % 4]
    nets = [
        quality.train(docs, spark.createDataFrame(rows, "doc_id long, quality int").repartition(parts))
        for rows, parts in ((other, 3), (other + both, 1), (both[::-1] + other + other, 5))
    ]
    for net in nets[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(net, nets[0]))


def test_keep_good_on_awkward_tables(spark):
    net = quality.fit([b"good text here " * 80, b"bad%%% junk### " * 80] * 8, np.array([1, 0] * 8, np.float32))
    schema = "doc_id long, text string, score string, row int, id double, predicted array<int>"
    rows = [(1, "good text here " * 9, "s", None, 1.5, [1]), (1, "good text here " * 9, "s", None, 1.5, [1]),
            (None, None, None, None, None, None), (2, "", "t", 3, None, []), (3, "bad%%% junk### " * 5000, None, 4, 2.0, None)]
    docs = spark.createDataFrame(rows, schema)
    empty_score = float(quality.score_all(net, [b""])[0])
    kept = quality.keep_good(docs, net)
    assert kept.schema == docs.schema
    found = [tuple(r) for r in kept.collect()]
    assert found.count(rows[0]) == 2 and rows[4] not in found
    assert (rows[2] in found) == (rows[3] in found) == (empty_score >= quality.THRESHOLD)
    assert quality.keep_good(spark.createDataFrame([], schema), net).collect() == []
