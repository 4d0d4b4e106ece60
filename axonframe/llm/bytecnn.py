"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded; filters of ``WIDTH`` bytes run over them. A text is cut into chunks of
``CHUNK`` positions that overlap by a filter's width, so every window of the whole text is seen
once and the memory of a task does not follow the text's length. Each filter is max-pooled within a
chunk; the mean and the largest of the chunk maxima go into one logistic output.

The network learns from at most ``TRAIN_ROWS`` labelled rows that have a document, those with the
smallest hashes of doc_id, and from the whole text of each; the fit takes place in one task, over a sample of that fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .scratch import Scratch
from .textkernel import text_blocks

EMBED, WIDTH, FILTERS, CHUNK = 6, 6, 24, 256
#: Labelled rows to learn from, at most.
TRAIN_ROWS = 2000
#: Texts of a training step at most, and chunks, about; a longer text is a step of its own.
EPOCHS, BATCH, STEP_CHUNKS, RATE = 12, 64, 512, 0.01
#: Weight of the short passages that each training text also gives.
SHORT = np.float32(1.0)
THRESHOLD = 0.7


def start(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return {"embed": draw(0.5, 256, EMBED), "filters": draw(1 / np.sqrt(WIDTH * EMBED), WIDTH * EMBED, FILTERS), "shift": np.zeros(FILTERS, np.float32), "out": draw(0.1, 2 * FILTERS), "bias": np.zeros(1, np.float32)}


def _windows(embedded: np.ndarray) -> np.ndarray:
    """Each window of WIDTH positions of (..., positions, EMBED) as one row."""
    n = embedded.shape[-2] - WIDTH + 1
    return np.concatenate([embedded[..., k : k + n, :] for k in range(WIDTH)], axis=-1)


def _pairs(net: dict[str, np.ndarray]) -> np.ndarray:
    """What each pair of bytes adds to the filters, by the pair's place in a window."""
    part = net["embed"] @ net["filters"].reshape(WIDTH, EMBED, FILTERS)  # (WIDTH, 256, FILTERS)
    return np.stack([(part[k][:, None, :] + part[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)])


def features(data: np.ndarray, offs: np.ndarray, net: dict[str, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Mean and maximum of the chunk maxima of each text. A text shorter than a window is padded with zero bytes."""
    out = np.zeros((len(offs) - 1, 2 * FILTERS), np.float32)
    size = np.maximum(np.diff(offs), WIDTH)
    # The texts stand apart, each padded to a window at least; a position belongs to the chunk it starts in.
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint8)
    row = np.repeat(np.arange(len(size)), np.diff(offs))
    flat[begin[row] + np.arange(len(data)) - offs[row]] = data
    n = size - WIDTH + 1
    chunks = -(-n // CHUNK)
    owner = np.repeat(np.arange(len(size)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    first = begin[owner] + number * CHUNK
    last = np.minimum(first + CHUNK, begin[owner] + n[owner])
    pair = (flat[:-1].astype(np.int64) << 8) | flat[1:]
    top = np.empty((len(owner), FILTERS), np.float32)
    step = 64
    for k in range(0, len(owner), step):
        a, b = first[k : k + step], last[k : k + step]
        length = b - a
        cut = np.cumsum(length) - length
        at = np.repeat(a - cut, length) + np.arange(int(length.sum()))
        held = pairs[0].take(pair[at], axis=0)
        for j in range(1, len(pairs)):
            held += pairs[j].take(pair[at + 2 * j], axis=0)
        top[k : k + step] = np.maximum.reduceat(held, cut, axis=0)
    top = np.maximum(top + net["shift"], 0)
    begin = np.cumsum(chunks) - chunks
    out[:, :FILTERS] = np.add.reduceat(top, begin, axis=0) / chunks[:, None]
    out[:, FILTERS:] = np.maximum.reduceat(top, begin, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _chunks(text: bytes) -> np.ndarray:
    """(chunks, CHUNK + WIDTH - 1) bytes that cover a training text; the last chunk ends with the text."""
    data = np.frombuffer(text, np.uint8)
    wide = CHUNK + WIDTH - 1
    if len(data) <= wide:
        return np.pad(data, (0, wide - len(data)))[None, :]
    n = -(-(len(data) - WIDTH + 1) // CHUNK)
    begin = np.minimum(np.arange(n) * CHUNK, len(data) - wide)
    return data[begin[:, None] + np.arange(wide)]


def _steps(order: np.ndarray, size: np.ndarray):
    """The texts of each training step."""
    own, held = [], 0
    for i in order:
        if own and (len(own) == BATCH or held + size[i] > STEP_CHUNKS):
            yield np.array(own)
            own, held = [], 0
        own.append(i)
        held += size[i]
    if own:
        yield np.array(own)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Trains the network by Adam on the logistic loss, the two labels weighing alike by half."""
    net, rng = start(seed), np.random.default_rng(seed)
    if not len(texts):
        return net
    labels = np.asarray(labels, np.float32)
    rate = float(np.clip(labels.mean(), 0.01, 0.99))
    weight = np.where(labels > 0, (0.5 / rate) ** 0.5, (0.5 / (1 - rate)) ** 0.5).astype(np.float32)
    net["bias"][:] = np.log(rate / (1 - rate))
    # Each text is learned from whole and as a short passage of it, since short texts are scored too.
    cut = [int(rng.integers(8, 160)) for _ in texts]
    at = [int(rng.integers(0, max(1, len(t) - n))) for t, n in zip(texts, cut)]
    chunks = [_chunks(t) for t in texts] + [_chunks(t[i : i + n]) for t, i, n in zip(texts, at, cut)]
    labels, weight = np.tile(labels, 2), np.concatenate([weight, weight * SHORT])
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    turn = 0
    for _ in range(EPOCHS):
        for own in _steps(rng.permutation(len(chunks)), np.array([len(c) for c in chunks])):
            turn += 1
            block = np.concatenate([chunks[i] for i in own])
            count = np.array([len(chunks[i]) for i in own])
            row = np.repeat(np.arange(len(own)), count)
            begin = np.cumsum(count) - count
            windows = _windows(net["embed"][block])
            value = windows @ net["filters"]
            best = value.argmax(axis=1)
            c, f = np.arange(len(block))[:, None], np.arange(FILTERS)[None, :]
            top = np.maximum(value[c, best, f] + net["shift"], 0)
            mean = np.add.reduceat(top, begin, axis=0) / count[:, None]
            most = np.maximum.reduceat(top, begin, axis=0)
            x = np.concatenate([mean, most], axis=1)
            slope = ((_sigmoid(x @ net["out"] + net["bias"]) - labels[own]) * weight[own] / BATCH).astype(np.float32)
            back = slope[:, None] * net["out"]
            d_top = (back[:, :FILTERS] / count[:, None])[row] + back[:, FILTERS:][row] * (top == most[row])
            d_top = (d_top * (top > 0)).astype(np.float32)
            picked = windows[c, best]  # (chunks, FILTERS, WIDTH * EMBED)
            d_window = d_top[:, :, None] * net["filters"].T[None]
            touched = block[c[:, :, None], best[:, :, None] + np.arange(WIDTH)].reshape(-1)
            d_embed = np.zeros_like(net["embed"])
            np.add.at(d_embed, touched, d_window.reshape(-1, EMBED))
            grads = {"embed": d_embed, "filters": np.einsum("cf,cfw->wf", d_top, picked), "shift": d_top.sum(axis=0), "out": x.T @ slope + 1e-4 * net["out"], "bias": slope.sum(keepdims=True)}
            for name, g in grads.items():
                m, v = moments[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[name] -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-7)
    return net


def _fitted(frames):
    """One row: the network learned from all rows of the one partition, as bytes by name."""
    texts, labels = [], []
    for batch in frames:
        texts += [(t or "").encode() for t in batch.column(1).to_pylist()]
        labels += batch.column(2).to_pylist()
    net = fit(texts, np.array(labels))
    yield pa.RecordBatch.from_arrays([pa.array(list(net)), pa.array([v.astype("<f4").tobytes() for v in net.values()], pa.binary())], ["name", "value"])


def _scored(shared):
    def run(batches):
        net = shared.value
        pairs = _pairs(net)
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column(2), 1 << 19):
                score = _sigmoid((features(data, offs, net, pairs) @ net["out"] + net["bias"]).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """The network learned from ``labels`` (doc_id, quality) and the texts of ``docs`` (doc_id, text)."""
    scratch = Scratch(spark, "bytecnn")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    sample = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    # The sample has ``rows`` rows at most, a few bytes each.
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # Rows repeated under one doc_id are left to ``rows`` again; the sample stays of that size.
    held = held.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    got = scratch.cut(held.coalesce(1).sortWithinPartitions("doc_id", "label").mapInArrow(_fitted, "name string, value binary"), "network")
    shapes = {k: v.shape for k, v in start().items()}
    return {r.name: np.frombuffer(r.value, "<f4").reshape(shapes[r.name]).copy() for r in got.collect()} or start()


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, quality) teaches by the rows whose crc32 of doc_id, as text, does not leave
    ``held_fold``. Null texts are empty; an empty text is scored as zero bytes. A null doc_id counts
    as an empty one, repeated rows are each scored, and without labels the untrained network scores.
    Texts of any length are read whole; other columns, whatever their names, are not read; an empty
    table gives no row.
    """
    out_of = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held_fold
    net = train(spark, docs, labels.filter(~out_of("doc_id")))
    shared = spark.sparkContext.broadcast(net)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out_of("doc_id").alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")
