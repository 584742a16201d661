"""Quality classifier: a byte-level convolutional network in numpy.

Every byte becomes a short fixed code (its class and a few pseudo-random signs); learned filters read
WIDTH bytes at every STRIDE-th byte of the whole text. Filter outputs are max-pooled over chunks of two
neighbouring blocks, so chunks overlap by half, and a document's chunks are combined by maximum, mean and minimum
(the minimum tells a stretch that repeats itself: few filters fire there) into one logistic unit.

Training runs on the driver over a bounded sample: at most SAMPLE_PER_CLASS labelled rows of each class,
chosen by a hash of the id, of at most SAMPLE_CHARS characters each. Scoring reads every whole text inside Spark tasks, in
slabs of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import extended

SAMPLE_PER_CLASS = 1200
SAMPLE_CHARS = 60_000
WIDTH, STRIDE, FILTERS, BLOCK = 8, 4, 24, 32
_STEP = STRIDE * BLOCK  # bytes to a block
_SLAB = 1 << 19


def byte_codes() -> np.ndarray:
    """256 x 16: lower, upper, digit, space, line end, sentence mark, other ASCII mark, byte over 127, eight random signs. Byte 0 pads."""
    b = np.arange(256)
    is_in = lambda s: np.isin(b, np.frombuffer(s, np.uint8))
    lower, upper, digit = (b >= 97) & (b <= 122), (b >= 65) & (b <= 90), (b >= 48) & (b <= 57)
    space, line, mark, high = is_in(b" \t"), is_in(b"\n\r"), is_in(b".,;:'\"()-?"), b >= 128
    rest = ~(lower | upper | digit | space | line | mark | high) & (b > 0)
    signs = np.random.default_rng(7).choice([-0.5, 0.5], size=(256, 8))
    codes = np.column_stack([lower, upper, digit, space, line, mark, rest, high, signs]).astype(np.float32)
    codes[0] = 0
    return codes


@dataclass
class Net:
    filters: np.ndarray  # (WIDTH * 16, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (3 * FILTERS,)
    out_bias: float
    mean: np.ndarray  # of the pooled features over the sample, and their scale
    scale: np.ndarray


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with every text at a block's start, zeros between, and each text's number of blocks."""
    blocks = np.array([max(1, -(-(len(t) + WIDTH - STRIDE) // _STEP)) for t in texts], dtype=np.int64)
    buf = np.zeros(int(blocks.sum()) * _STEP + WIDTH, np.uint8)
    at = np.r_[0, np.cumsum(blocks)[:-1]] * _STEP
    for t, a in zip(texts, at.tolist()):
        buf[a : a + len(t)] = np.frombuffer(t, np.uint8)
    return buf, blocks


def _windows(buf: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = codes[buf]
    d, n = x.shape[1], (len(buf) - WIDTH) // STRIDE
    return np.lib.stride_tricks.as_strided(x, (n, WIDTH * d), (STRIDE * d * 4, 4))


def _block_maxima(buf: np.ndarray, net: Net, codes: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(buf) - WIDTH, _SLAB):
        part = buf[i : i + _SLAB + WIDTH]
        z = _windows(part, codes) @ net.filters + net.bias
        out.append(np.maximum(z.reshape(-1, BLOCK, z.shape[1]).max(axis=1), 0))
    return np.concatenate(out)


def _pool(maxima: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(documents, 3 * FILTERS): maximum, mean and minimum over each document's overlapping chunks."""
    starts = np.r_[0, np.cumsum(blocks)[:-1]]
    last = np.zeros(len(maxima), bool)
    last[starts + blocks - 1] = True
    chunks = np.maximum(maxima, np.r_[maxima[1:], maxima[-1:]])
    real = ~last | np.repeat(blocks == 1, blocks)
    chunks[last] = maxima[last]
    n = np.maximum(blocks - 1, 1)
    at = np.r_[0, np.cumsum(n)[:-1]]
    c = chunks[real]
    return np.hstack([np.maximum.reduceat(c, at), np.add.reduceat(c, at) / n[:, None], np.minimum.reduceat(c, at)])


def score(texts: list[str | None], net: Net, codes: np.ndarray | None = None) -> np.ndarray:
    codes = byte_codes() if codes is None else codes
    buf, blocks = _layout([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    f = (_pool(_block_maxima(buf, net, codes), blocks) - net.mean) / net.scale
    return 1 / (1 + np.exp(-np.clip(f @ net.out + net.out_bias, -30, 30)))


def train(texts: list[str], labels: list[int], prior: float = 0.5, epochs: int = 12, batch: int = 48, rate: float = 0.01, seed: int = 5) -> Net:
    """Adam on the logistic loss with both classes weighing the same; then the bias moves to the prior of class 1."""
    rng, codes = np.random.default_rng(seed), byte_codes()
    d = codes.shape[1]
    net = Net(
        rng.normal(0, 1 / np.sqrt(WIDTH * 4), (WIDTH * d, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        np.zeros(3 * FILTERS, np.float32), 0.0, np.zeros(3 * FILTERS, np.float32), np.ones(3 * FILTERS, np.float32),
    )
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:  # nothing to tell apart
        net.out_bias = 30.0 if len(labels) and labels[0] else -30.0 if len(labels) else 0.0
        return net
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    first = [raw[i] for i in rng.permutation(len(raw))[:400]]
    pooled = np.concatenate([_pool(_block_maxima(b, net, codes), n) for b, n in (_layout(first[i : i + 32]) for i in range(0, len(first), 32))])
    net.mean, net.scale = pooled.mean(0).astype(np.float32), (pooled.std(0) + 0.1).astype(np.float32)
    names = ("filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(np.asarray(getattr(net, k), np.float32)) for k in names}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            grads = _gradients([raw[k] for k in pick], y[pick], weight[pick].astype(np.float32), net, codes)
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k, g in zip(names, grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                new = getattr(net, k) - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                setattr(net, k, new if k != "out_bias" else float(new))
    net.out_bias += float(np.log(prior / (1 - prior)))
    return net


def _gradients(raw: list[bytes], y: np.ndarray, weight: np.ndarray, net: Net, codes: np.ndarray):
    buf, blocks = _layout(raw)
    win = _windows(buf, codes)
    z = (win @ net.filters + net.bias).reshape(-1, BLOCK, FILTERS)
    where = z.argmax(axis=1)
    maxima = np.maximum(np.take_along_axis(z, where[:, None], 1)[:, 0], 0)
    f = (_pool(maxima, blocks) - net.mean) / net.scale
    p = 1 / (1 + np.exp(-np.clip(f @ net.out + net.out_bias, -30, 30)))
    err = ((p - y) * weight / len(y)).astype(np.float32)
    df = (err[:, None] * net.out / net.scale).astype(np.float32)
    g = np.zeros_like(maxima)
    at, cols = 0, np.arange(FILTERS)
    for k, n in enumerate(blocks.tolist()):
        own = maxima[at : at + n]
        c = np.maximum(own[:-1], own[1:]) if n > 1 else own
        gc = np.repeat(df[k, FILTERS : 2 * FILTERS][None] / len(c), len(c), axis=0)
        gc[c.argmax(0), cols] += df[k, :FILTERS]
        gc[c.argmin(0), cols] += df[k, 2 * FILTERS :]
        if n > 1:
            left = own[:-1] >= own[1:]
            g[at : at + n - 1] += gc * left
            g[at + 1 : at + n] += gc * ~left
        else:
            g[at] += gc[0]
        at += n
    g *= maxima > 0
    dw, db = np.empty_like(net.filters), g.sum(0)
    base = np.arange(len(g)) * BLOCK
    for j in range(FILTERS):
        on = np.flatnonzero(g[:, j])
        dw[:, j] = g[on, j] @ win[base[on] + where[on, j]]
    return dw + 1e-4 * net.filters, db, f.T @ err + 1e-3 * net.out, np.float32(err.sum())


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Net:
    """A net from the labelled rows of which may_learn (over doc_id) holds; labels other than 0 and 1 are passed over.

    Of each class the per_class rows least by their id's hash (ties: by id) are taken, and of those the texts of at most SAMPLE_CHARS characters; null texts and ids are not learned from, repeated rows count each, and with
    labels of one class alone every score says that class (of none, 0.5). Other columns, whatever their names, are not read.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(may_learn)
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = [
        known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)
    ]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = (
        texts.join(picked[0].unionByName(picked[1]), "doc_id").where(F.length("text") <= SAMPLE_CHARS).orderBy("doc_id", "y").select("text", "y").collect()
    )
    total = sum(counts.values())
    prior = min(max(counts.get(1, 0) / total, 0.01), 0.99) if total else 0.5
    return train([r.text for r in rows], [r.y for r in rows], prior)


def score_documents(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, score (probability of label 1), predicted (1 if score >= threshold).

    Null texts score like empty ones (one block of padding); very long texts are read whole, block by block; null ids and repeated rows stay, and equal texts have equal scores; no rows give
    no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes()
        for b in batches:
            texts, got, at = b.column(1), [], 0
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            ends, total = [], 0
            for i, n in enumerate(sizes):
                total += n
                if total >= _SLAB or i + 1 == len(sizes):
                    ends.append(i + 1)
                    total = 0
            for e in ends:
                got.append(score(texts.slice(at, e - at).to_pylist(), net, codes))
                at = e
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got) if got else [], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, extended(rows.select("doc_id"), "score double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
