"""Quality classifier: a byte-level convolutional network in numpy.

A text is read in overlapping chunks that cover it whole.  Each filter spans ``SPAN`` bytes
and sees a byte through a learned table, so a convolution is a sum of table rows.  The
rectified responses are max-pooled in each chunk, the chunks' maxima are averaged over the
text (every chunk counts), and one hidden layer combines them to a probability.  Classes weigh
in training so that ``threshold`` is the point of equal odds.  Everything is learned from a
bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.language_id import Adam, balanced, excerpts
from pairlens.llm.textbatch import Texts, over_texts, quoted

SAMPLE_ROWS = 3_000
CHUNK, OVERLAP, SPAN, FILTERS, HIDDEN = 256, 32, 5, 16, 8
THRESHOLD = 0.3


def initial(seed: int = 9) -> dict:
    rng = np.random.default_rng(seed)
    net = {f"t{k}": rng.normal(0, 0.4, (256, FILTERS)) for k in range(SPAN)}
    net |= {"tb": np.zeros(FILTERS), "w": rng.normal(0, 0.4, (FILTERS, HIDDEN)), "wb": np.zeros(HIDDEN), "v": rng.normal(0, 0.4, HIDDEN), "vb": np.zeros(1)}
    return {k: np.asarray(v, np.float32) for k, v in net.items()}


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the chunks of a text of ``size`` bytes; consecutive ones overlap and together they cover it."""
    step = CHUNK - OVERLAP
    return np.arange(0, max(1, size - OVERLAP), step)


def chunked(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (rows of bytes with SPAN - 1 zeros behind) and their texts."""
    starts, owner = [], []
    for i, (lo, hi) in enumerate(zip(texts.offsets[:-1], texts.offsets[1:])):
        if hi > lo:
            at = chunk_starts(int(hi - lo))
            starts.append(at + lo)
            owner.append(np.full(len(at), i))
    if not starts:
        return np.zeros((0, CHUNK + SPAN - 1), np.uint8), np.zeros(0, np.int64)
    start, owner = np.concatenate(starts), np.concatenate(owner)
    width = CHUNK + SPAN - 1
    padded = np.concatenate([texts.data, np.zeros(width, np.uint8)])
    cells = padded[start[:, None] + np.arange(width)]
    cells[np.arange(width) >= np.minimum(CHUNK, texts.offsets[owner + 1] - start)[:, None]] = 0
    return cells, owner


def responses(net: dict, cells: np.ndarray) -> np.ndarray:
    """(chunk, position, filter) responses before rectifying."""
    n = cells.shape[1] - SPAN + 1
    out = np.take(net["t0"] + net["tb"], cells[:, :n], axis=0)
    for k in range(1, SPAN):
        out += np.take(net[f"t{k}"], cells[:, k:k + n], axis=0)
    return out


def _head(net: dict, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ net["w"] + net["wb"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ net["v"] + net["vb"][0], -30, 30)))


def scorer(net: dict, batch: int = 256):
    def score(texts: Texts) -> list:
        cells, owner = chunked(texts)
        best = np.zeros((len(owner), FILTERS), np.float32)
        for lo in range(0, len(cells), batch):
            best[lo:lo + batch] = responses(net, cells[lo:lo + batch]).max(axis=1)
        np.maximum(best, 0, out=best)
        pooled = np.zeros((len(texts), FILTERS))
        np.add.at(pooled, owner, best)
        pooled /= np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
        p = _head(net, pooled)[1]
        return [p, (p >= THRESHOLD).astype(np.int32)]

    return score


def train(texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 4) -> dict:
    net, rng = initial(), np.random.default_rng(seed)
    adam = Adam(net, rate)
    positive = max(labels.mean(), 1e-3) if len(labels) else 0.5
    odds = THRESHOLD / (1 - THRESHOLD)  # equal evidence then scores the threshold
    weights = np.where(labels == 1, odds / positive, 1 / max(1 - positive, 1e-3)).astype(np.float32)
    width = CHUNK + SPAN - 1
    for k in range(steps):
        rows = rng.integers(0, len(texts), batch)
        cells = np.zeros((batch, width), np.uint8)
        for a, i in enumerate(rows):
            starts = chunk_starts(len(texts[i]))
            lo = int(starts[rng.integers(0, len(starts))])
            piece = texts[i][lo:lo + CHUNK]
            cells[a, :len(piece)] = np.frombuffer(piece, np.uint8)
        r = responses(net, cells)
        at = r.argmax(axis=1)
        top = np.take_along_axis(r, at[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        hidden, p = _head(net, pooled)
        y, w = labels[rows], weights[rows]
        d = ((p - y) * w / w.sum()).astype(np.float32)
        g = {"v": hidden.T @ d, "vb": np.array([d.sum()])}
        dh = d[:, None] * net["v"] * (hidden > 0)
        g |= {"w": pooled.T @ dh, "wb": dh.sum(0)}
        dr = (dh @ net["w"].T) * (top > 0)
        g["tb"] = dr.sum(0)
        column = np.broadcast_to(np.arange(FILTERS), at.shape)
        for t in range(SPAN):
            g[f"t{t}"] = np.zeros_like(net[f"t{t}"])
            np.add.at(g[f"t{t}"], (np.take_along_axis(cells, at + t, 1), column), dr)
        adam.rate = rate * (1 - 0.9 * k / steps)
        adam.step(net, {k2: np.asarray(x, np.float32) for k2, x in g.items()})
    return net


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """The network from texts joined with their labels (0 or 1); None without labelled rows.

    ``sample_rows`` bounds the labels that are looked up and the rows that reach the driver; of each an excerpt of 2,048 characters is used.
    """
    marks = labels.select(F.col(quoted(label_id_col)).alias("__key"), F.col(quoted(label_col)).cast("int").alias("__label")).filter("__label IN (0, 1) AND __key IS NOT NULL")
    chosen = balanced(marks.groupBy("__key").agg(F.max("__label").alias("__label")), "__key", sample_rows)
    # at most sample_rows narrow rows, so they go to the texts and not the texts to them
    rows = docs.select(F.col(quoted(id_col)).alias("__key"), F.col(quoted(text_col)).alias("__text")).filter("length(__text) > 0")
    sample = excerpts(rows.join(F.broadcast(chosen), "__key"), "__key", sample_rows, 2048)
    if not sample:
        return None
    return train([r["__text"].encode() for r in sample], np.array([r["__label"] for r in sample]))


def quality(docs: DataFrame, net: dict | None, text_col: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted``.

    Defined cases: a null or empty text has no chunk and is scored by the biases alone; without a
    network every score is 0.5; equal texts get equal scores; columns named like the new ones are
    replaced; an empty table gives an empty result.
    """
    if net is None:
        keep = [c for c in (docs.columns if passing is None else passing) if c not in ("score", "predicted")]
        return docs.select(*map(quoted, keep), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    return over_texts(docs, text_col, [("score", "double"), ("predicted", "int")], scorer(net), passing=passing)
