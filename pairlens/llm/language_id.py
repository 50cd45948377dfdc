"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text in consecutive windows that cover every byte.  In each window two
gated recurrent units, one per direction, run over the bytes; both states label every position
with a language, and the document's probability of a language is the mean over its positions.
Gates use the piecewise linear sigmoid and the candidate the clipped identity, which keeps a
step to a few multiplications.  Training is backpropagation through time in numpy on a bounded
sample of labelled rows, as many rows from each language as the sample allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.textbatch import Texts, over_texts, quoted

#: Rows of a label that are always taken, and characters of a training text.
LABEL_ROWS, EXCERPT = 8, 1024
SAMPLE_ROWS = 2_000
WINDOW = 128
WIDTH = 8
UNDETERMINED = "und"


def initial(languages: int, width: int = WIDTH, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {}
    for d in "fb":
        for gate in "zrn":
            net[f"x{gate}{d}"] = rng.normal(0, 0.5, (256, width))
            net[f"u{gate}{d}"] = rng.normal(0, 1 / np.sqrt(width), (width, width))
        net[f"xz{d}"] -= 1.0
        net[f"o{d}"] = rng.normal(0, 0.3, (width, languages))
    net["bias"] = np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in net.items()}


def _unit(net: dict, d: str, steps: np.ndarray, keep: bool):
    """Hidden states of one direction over ``steps`` (time, batch); with ``keep`` also what training needs."""
    n, width = steps.shape[1], net[f"uz{d}"].shape[0]
    h = np.zeros((n, width), np.float32)
    hidden = np.empty((len(steps), n, width), np.float32)
    kept = []
    tables = [0.25 * net[f"xz{d}"] + 0.5, 0.25 * net[f"xr{d}"] + 0.5, net[f"xn{d}"]]
    mats = [0.25 * net[f"uz{d}"], 0.25 * net[f"ur{d}"], net[f"un{d}"]]
    moved, (z, r, c, s) = np.empty_like(h), (np.empty_like(h) for _ in range(4))
    for t in (range(len(steps)) if d == "f" else range(len(steps) - 1, -1, -1)):
        if keep:  # arrays of its own for every step
            z, r, c, s = (np.empty_like(h) for _ in range(4))
        for x, gate in zip(tables, (z, r, c)):
            np.take(x, steps[t], axis=0, out=gate, mode="clip")  # a byte is never out of range; "raise" would need a copy
        z += np.matmul(h, mats[0], out=moved)
        np.clip(z, 0, 1, out=z)
        r += np.matmul(h, mats[1], out=moved)
        np.clip(r, 0, 1, out=r)
        np.matmul(h, mats[2], out=s)
        c += np.multiply(r, s, out=moved)
        np.clip(c, -1, 1, out=c)
        if keep:
            kept.append((t, h, z, r, s, c))
        np.subtract(c, h, out=moved)
        moved *= z
        h = np.add(h, moved, out=hidden[t])
    return hidden, kept


def _position_probabilities(net: dict, steps: np.ndarray) -> np.ndarray:
    """(time, batch, language) probabilities of every position."""
    length, n = steps.shape
    logits = net["bias"] + _unit(net, "f", steps, False)[0].reshape(length * n, -1) @ net["of"]
    logits += _unit(net, "b", steps, False)[0].reshape(length * n, -1) @ net["ob"]
    np.exp(np.minimum(logits, 30, out=logits), out=logits)
    logits /= logits @ np.ones((logits.shape[1], 1), np.float32)
    return logits.reshape(length, n, -1)


def cut_windows(texts: Texts, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every text's bytes as rows of ``window`` bytes (zero-padded), the row's length and its text."""
    sizes = np.diff(texts.offsets)
    rows = -(-sizes // window)
    owner = np.repeat(np.arange(len(sizes)), rows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = texts.offsets[owner] + number * window
    length = np.minimum(window, texts.offsets[owner + 1] - start)
    padded = np.concatenate([texts.data, np.zeros(window, np.uint8)])
    cells = padded[start[:, None] + np.arange(window)]
    cells[np.arange(window) >= length[:, None]] = 0
    return cells, length, owner


def classifier(net: dict, languages: list[str], window: int = WINDOW, batch: int = 2048):
    """A function from texts to (language, mean probability of the language)."""

    def predict(texts: Texts) -> list:
        cells, length, owner = cut_windows(texts, window)
        total = np.zeros((len(texts), len(languages)))
        order = np.argsort(length, kind="stable")
        for lo in range(0, len(order), batch):
            rows = order[lo:lo + batch]
            longest = int(length[rows].max())
            steps = np.ascontiguousarray(cells[rows, :longest].T)
            p = _position_probabilities(net, steps)
            if length[rows[0]] < longest:
                p *= (np.arange(longest)[:, None] < length[rows])[:, :, None]
            np.add.at(total, owner[rows], p.sum(0))
        mean = total / np.maximum(np.diff(texts.offsets), 1)[:, None]
        best = mean.argmax(1)
        score = np.clip(mean[np.arange(len(best)), best], 0, 1)
        return [pa.array([languages[k] for k in best], pa.string()), score]

    return predict


def gradients(net: dict, steps: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
    """Mean loss over positions and its gradient by backpropagation through time."""
    length, n = steps.shape
    runs = {d: _unit(net, d, steps, True) for d in "fb"}
    logits = net["bias"] + sum(runs[d][0].reshape(length * n, -1) @ net[f"o{d}"] for d in "fb")
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    wanted = np.tile(target, length)
    weight = mask.reshape(-1, 1) / mask.sum()
    loss = float(-(np.log(p[np.arange(len(p)), wanted] + 1e-9) * weight[:, 0]).sum())
    p[np.arange(len(p)), wanted] -= 1
    p *= weight
    g = {k: np.zeros_like(v) for k, v in net.items()}
    g["bias"] = p.sum(0)
    for d in "fb":
        hidden, kept = runs[d]
        g[f"o{d}"] = hidden.reshape(length * n, -1).T @ p
        above = (p @ net[f"o{d}"].T).reshape(length, n, -1)
        back = np.zeros_like(above[0])
        parts = {gate: np.empty_like(above) for gate in "zrn"}
        for t, h, z, r, s, c in reversed(kept):
            dh = above[t] + back
            dz = dh * (c - h) * ((z > 0) & (z < 1)) * 0.25
            dc = dh * z * ((c > -1) & (c < 1))
            dr = dc * s * ((r > 0) & (r < 1)) * 0.25
            ds = dc * r
            back = dh * (1 - z) + dz @ net[f"uz{d}"].T + dr @ net[f"ur{d}"].T + ds @ net[f"un{d}"].T
            parts["z"][t], parts["r"][t], parts["n"][t] = dz, dr, dc
            g[f"uz{d}"] += h.T @ dz
            g[f"ur{d}"] += h.T @ dr
            g[f"un{d}"] += h.T @ ds
        flat = steps.reshape(-1)
        for gate in "zrn":
            np.add.at(g[f"x{gate}{d}"], flat, parts[gate].reshape(length * n, -1))
    return loss, {k: v.astype(np.float32) for k, v in g.items()}


class Adam:
    def __init__(self, net: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))

    def step(self, net: dict, grads: dict) -> None:
        self.t += 1
        scale = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, 1.0 / (size + 1e-9))
        for k, g in grads.items():
            g = g * shrink
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            net[k] -= (self.rate * scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def train(windows: list[bytes], labels: np.ndarray, languages: int, steps: int = 300, batch: int = 128, window: int = 64, rate: float = 0.02, seed: int = 5) -> dict:
    net, rng = initial(languages), np.random.default_rng(seed)
    adam = Adam(net, rate)
    for k in range(steps):
        rows = rng.integers(0, len(windows), batch)
        length = np.array([min(window, len(windows[i])) for i in rows])
        cells = np.zeros((batch, window), np.uint8)
        for a, i in enumerate(rows):
            lo = int(rng.integers(0, len(windows[i]) - length[a] + 1))
            cells[a, :length[a]] = np.frombuffer(windows[i][lo:lo + length[a]], np.uint8)
        adam.rate = rate * (1 - 0.9 * k / steps)
        adam.step(net, gradients(net, np.ascontiguousarray(cells.T), labels[rows], (np.arange(window)[:, None] < length).astype(np.float32))[1])
    return net


def balanced(rows: DataFrame, key: str, rows_wanted: int) -> DataFrame:
    """About ``rows_wanted`` rows, as many of each ``__label`` as there are, but :data:`LABEL_ROWS` of each at least; chosen by a hash of ``key``.

    Every label is kept, however many there are; their counts (one number per label) come to the driver.
    """
    counts = {r["__label"]: r["n"] for r in rows.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    wanted = max(rows_wanted / len(counts), LABEL_ROWS)
    # a rare label's rows are all taken, so that a hash cannot miss it
    part = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, 1.0 if n <= 4 * LABEL_ROWS else min(1.0, wanted / n))])
    u = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    return rows.filter(u < part[F.col("__label")])


def excerpts(rows: DataFrame, key: str, rows_wanted: int, size: int) -> list:
    """``__label`` and an excerpt of ``__text`` of at most ``rows_wanted`` rows, at a place that depends on ``key``."""
    place = (F.pmod(F.xxhash64(key, F.lit(12)), F.lit(1 << 40)) / float(1 << 40) * F.greatest(F.length("__text") - size, F.lit(0))).cast("int") + 1
    some = rows.select(F.xxhash64(key, F.lit(13)).alias("__u"), "__label", F.col("__text").substr(place, F.lit(size)).alias("__text"))
    return some.orderBy("__u", "__label", "__text").limit(rows_wanted).collect()


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS):
    """(network, languages) from rows of ``docs`` with a text and a language; None without such rows.

    About ``sample_rows`` rows reach the driver, more only where there are so many languages that
    :data:`LABEL_ROWS` of each need them; of each an excerpt of :data:`EXCERPT` characters is used for training.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("__key"), F.col(quoted(text_col)).alias("__text"), F.col(quoted(lang_col)).cast("string").alias("__label"))
    usable = rows.filter("__label IS NOT NULL").filter(F.col("__text").rlike(r"\p{L}"))
    # the chosen rows are few; the limit only guards against ids that repeat without end
    sample = excerpts(balanced(usable, "__key", sample_rows), "__key", 16 * sample_rows, EXCERPT)
    if not sample:
        return None
    languages = sorted({r["__label"] for r in sample})
    labels = np.array([languages.index(r["__label"]) for r in sample])
    return train([r["__text"].encode() for r in sample], labels, len(languages)), languages


def identify(docs: DataFrame, model, text_col: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``.

    Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text
    without a model (nothing to learn from); equal texts get equal results; columns named like the new
    ones are replaced; an empty table gives an empty result.
    """
    letters = F.coalesce(F.col(quoted(text_col)).rlike(r"\p{L}"), F.lit(False))
    keep = [c for c in (docs.columns if passing is None else passing) if c not in ("lang_pred", "score")]
    if model is None:
        return docs.select(*map(quoted, keep), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    flagged = docs.select(*map(quoted, keep), *([] if text_col in keep else [quoted(text_col)]), letters.alias("__letters"))
    out = over_texts(flagged, text_col, [("lang_pred", "string"), ("score", "double")], classifier(*model), passing=[*keep, "__letters"])
    return out.select(
        *map(quoted, keep), F.when(F.col("__letters"), F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("__letters"), F.col("score")).otherwise(0.0).alias("score"),
    )
