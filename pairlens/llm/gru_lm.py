"""Language-model scores with a gated recurrent network and a class-factored softmax.

Counts of all training words are one distributed aggregation by 64-bit word keys.  The most
frequent ``vocabulary`` words are units of the network; every other word is one of
``BINS`` open units (by its last two bytes) times its smoothed share of that unit's count, so a
probability is given to every text.  Units are put in classes of about equal root mass;
log P(unit) = log P(class | state) + log P(unit | class, state), both computed over their own
entries only.  Output biases start from the counts of the whole corpus.  The network learns from
every token of every training text by truncated backpropagation in numpy, the state carried from
window to window: learners, as many as the tokens ask for, go on from one start over documents
dealt to them by a hash, and their parameters are averaged.  The common start is a network trained
on a bounded sample.

Scoring runs documents in lanes: a lane is a queue of whole documents, a window takes the next
tokens of all lanes, and a lane's state is carried across windows and reset between documents.
Counts of frequent words (a bounded table) are known to every task; rare words are joined.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.components import stored
from pairlens.llm.language_id import Adam
from pairlens.llm.textbatch import Texts, Words, over_texts, quoted, slices

BINS = 32
VOCABULARY = 991
FREQUENT = 1 << 17
SAMPLE_ROWS = 1_500
EXCERPT = 4_096
WIDTH = 16
LANES = 512
SCORE_BYTES = 3 << 20
#: Tokens of all lanes in a window of scoring.
WINDOW_TOKENS = 8_192
#: Tokens that one learner goes over, those it holds at a time, and its step size.
LEARNER_TOKENS = 4_000_000
LEARN_TOKENS = 1 << 18
LEARN_RATE = 0.006


def word_keys(words: Words) -> np.ndarray:
    """64-bit keys whose low bits are the word's bin (a hash of its last two bytes)."""
    last = words.data[words.ends - 1].astype(np.uint64)
    one_before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    bins = (last * np.uint64(31) + one_before) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(59)
    return ((words.hashes & ~np.uint64(BINS - 1)) | bins).view(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``key``, ``c`` of every distinct word of all texts."""
    sent = docs.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("__text"))

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([k for k, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in held])[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[at], np.add.reduceat(n, at)

        for batch in batches:
            for _, texts in slices(batch, "__text"):
                keys, n = np.unique(word_keys(Words(texts)), return_counts=True)
                if len(keys):
                    held.append((keys, n))
                if sum(len(k) for k, _ in held) > 3_000_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_500_000:  # mostly words not met again here
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), names=["key", "c"])
        if held:
            keys, n = merged()
            for lo in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo:lo + 200_000]), pa.array(n[lo:lo + 200_000])], names=["key", "c"])

    return sent.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Units:
    """The network's units: frequent words, open bins and the end, sorted into classes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_docs: int, bin_mass: np.ndarray, vocabulary: int = VOCABULARY):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        ranked = np.lexsort((self.keys, -self.counts))
        known = ranked[:vocabulary]
        self.unit_of = np.full(len(keys), -1, np.int32)  # -1: an open bin
        self.unit_of[known] = np.arange(len(known))
        mass = np.concatenate([self.counts[known], bin_mass, [max(n_docs, 1)]]).astype(np.float64)
        self.first_bin, self.end = len(known), len(known) + BINS
        self.open_mass = np.maximum(bin_mass, 1).astype(np.float64)
        by_mass = np.argsort(-mass, kind="stable")
        share = np.sqrt(np.maximum(mass[by_mass], 1))
        n_classes = max(1, int(np.sqrt(len(mass))))
        cls = np.minimum((np.cumsum(share) - share / 2) / share.sum() * n_classes, n_classes - 1).astype(np.int64)
        used = np.unique(cls)
        cls = np.searchsorted(used, cls)
        self.class_first = np.searchsorted(cls, np.arange(len(used) + 1))
        self.place = np.empty(len(mass), np.int64)
        self.place[by_mass] = np.arange(len(mass))  # units are renamed to their place
        self.class_of = cls.astype(np.int16)
        self.log_mass = np.log(np.maximum(mass[by_mass], 1))
        self.unit_of = np.where(self.unit_of >= 0, self.place[np.maximum(self.unit_of, 0)], -1).astype(np.int32)

    def known(self) -> "Known":
        own = self.unit_of >= 0
        return Known(self.keys[own], self.unit_of[own], self.place[self.first_bin:self.first_bin + BINS])

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of word keys: whether frequent, their counts (0 if not), their units."""
        if not len(self.keys):
            found, at = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        else:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
        count = np.where(found, self.counts[at], 0) if len(self.keys) else np.zeros(len(keys), np.int64)
        unit = np.where(found, self.unit_of[at], -1) if len(self.keys) else np.full(len(keys), -1)
        bins = self.place[self.first_bin + (keys & (BINS - 1))]
        return found, count, np.where(unit >= 0, unit, bins)


class Known:
    """The units of word keys without their counts: a search among the network's own words only."""

    def __init__(self, keys: np.ndarray, units: np.ndarray, bins: np.ndarray):
        self.keys, self.units, self.bins = keys, units, bins

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bins = self.bins[keys & (BINS - 1)]
        if not len(self.keys):
            return bins
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.units[at], bins)


def initial(units: Units, width: int = WIDTH, seed: int = 8) -> dict:
    rng = np.random.default_rng(seed)
    n, k = len(units.place), len(units.class_first) - 1
    net = {}
    for gate in "zrn":
        net[f"x{gate}"] = rng.normal(0, 0.3, (n, width))
        net[f"u{gate}"] = rng.normal(0, 1 / np.sqrt(width), (width, width))
    net |= {"c": rng.normal(0, 0.05, (width, k)), "w": rng.normal(0, 0.05, (n, width)), "wb": units.log_mass}
    top = np.maximum.reduceat(units.log_mass, units.class_first[:-1])
    net["cb"] = np.log(np.add.reduceat(np.exp(units.log_mass - units.log_mass.max()), units.class_first[:-1])) + 0 * top
    return {key: np.asarray(v, np.float32) for key, v in net.items()}


def _run(net: dict, steps: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """States after each of ``steps`` (time, lane) inputs; ``fresh`` marks where a document begins."""
    hidden = np.empty((len(steps), steps.shape[1], h.shape[1]), np.float32)
    inputs = np.stack([0.25 * net["xz"] + 0.5, 0.25 * net["xr"] + 0.5, net["xn"]])  # the three gates in one array: fewer calls a step
    mats = np.stack([0.25 * net["uz"], 0.25 * net["ur"], net["un"]])
    begins = fresh.any(1)
    kept = []
    for t in range(len(steps)):
        if begins[t]:
            h = h * (~fresh[t])[:, None]
        x, u = inputs.take(steps[t], 1), h @ mats
        gates, c, s = x[:2], x[2], u[2]
        gates += u[:2]
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        z, r = gates
        c += r * s
        np.maximum(c, -1, out=c)
        np.minimum(c, 1, out=c)
        if keep:
            kept.append((h, z, r, s, c))
        after = np.subtract(c, h, out=hidden[t])
        after *= z
        after += h
        h = after
    return hidden, h.copy(), kept


def _log_probabilities(net: dict, units: Units, states: np.ndarray, target: np.ndarray, grads: dict | None = None):
    """Natural log P(target | state) of rows; with ``grads`` adds the gradient of the mean loss and returns that of the states too."""
    order = np.argsort(units.class_of[target], kind="stable")  # rows of a class lie together
    states, target = states[order], target[order]
    cls = units.class_of[target]
    # rows run along the last axis, so that sums and largest values over a few entries are of whole rows
    turned = np.ascontiguousarray(states.T)
    logits = net["c"].T @ turned
    logits += net["cb"][:, None]
    logits -= logits.max(0)
    rows = np.arange(len(target))
    out = logits[cls, rows]
    np.exp(logits, out=logits)
    norm = logits.sum(0)
    out -= np.log(norm)
    below = None
    if grads is not None:
        logits /= norm
        logits[cls, rows] -= 1
        logits /= len(target)
        grads["c"] += turned @ logits.T
        grads["cb"] += logits.sum(1)
        below = logits.T @ net["c"].T
    edges = np.searchsorted(cls, np.arange(len(units.class_first)))
    for k in np.flatnonzero(edges[1:] > edges[:-1]):
        at = slice(edges[k], edges[k + 1])
        lo, hi = units.class_first[k], units.class_first[k + 1]
        if hi - lo == 1:
            continue
        inner = net["w"][lo:hi] @ turned[:, at]
        inner += net["wb"][lo:hi, None]
        inner -= inner.max(0)
        mine = target[at] - lo
        here = rows[:len(mine)]
        chosen = inner[mine, here]
        np.exp(inner, out=inner)
        total = inner.sum(0)
        out[at] += chosen - np.log(total)
        if grads is not None:
            total *= len(target)
            inner /= total
            inner[mine, here] -= np.float32(1 / len(target))
            grads["w"][lo:hi] += inner @ states[at]
            grads["wb"][lo:hi] += inner.sum(1)
            below[at] += inner.T @ net["w"][lo:hi]
    back = np.empty_like(order)
    back[order] = rows
    return out[back], below if below is None else below[back]


def _learn(net: dict, units: Units, adam: Adam, source: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """One step on a window (time, lane) by backpropagation; only targets ``there`` count.  Returns the states behind it."""
    hidden, last, kept = _run(net, source, fresh, h, True)
    g = {key: np.zeros_like(v) for key, v in net.items()}
    n = source.size
    if there is None or there.all():
        above = _log_probabilities(net, units, hidden.reshape(n, -1), target.reshape(-1), g)[1].reshape(hidden.shape)
    else:
        above = np.zeros_like(hidden)
        above[there] = _log_probabilities(net, units, hidden[there], target[there], g)[1]
    back = np.zeros_like(h)
    flat = np.empty((*source.shape, 3 * h.shape[1]), np.float32)  # of all three gates
    for t in range(len(source) - 1, -1, -1):
        h0, z, r, s, c = kept[t]
        dh = above[t] + back
        dz = dh * (c - h0) * ((z > 0) & (z < 1)) * 0.25
        dc = dh * z * ((c > -1) & (c < 1))
        dr = dc * s * ((r > 0) & (r < 1)) * 0.25
        ds = dc * r
        back = (dh * (1 - z) + dz @ net["uz"].T + dr @ net["ur"].T + ds @ net["un"].T) * (~fresh[t])[:, None]
        np.concatenate([dz, dr, dc], axis=1, out=flat[t])
        g["uz"] += h0.T @ dz
        g["ur"] += h0.T @ dr
        g["un"] += h0.T @ ds
    flat, units_in = flat.reshape(n, -1), source.reshape(-1)
    order = np.argsort(units_in, kind="stable")
    at = np.flatnonzero(np.diff(units_in[order], prepend=-1))
    sums, met = np.add.reduceat(flat[order], at), units_in[order[at]]
    for k, gate in enumerate("zrn"):
        g[f"x{gate}"][met] = sums[:, k * h.shape[1]:(k + 1) * h.shape[1]]
    adam.step(net, g)
    return last


def train(units: Units, documents: list[np.ndarray], steps: int = 400, lanes: int = 32, window: int = 16, rate: float = 0.01, seed: int = 6) -> dict:
    """A network to start from: truncated backpropagation over lanes of documents, unit sequences that end with the end unit."""
    net, rng = initial(units), np.random.default_rng(seed)
    end = int(units.place[units.end])
    documents = [d for d in documents if len(d)]
    if not documents:
        return net
    order = rng.permutation(len(documents))
    text = np.concatenate([documents[i] for i in order])
    lanes = max(1, min(lanes, len(text) // window or 1))
    span = len(text) // lanes
    grid = text[:lanes * span].reshape(lanes, span).T
    before = np.vstack([np.full((1, lanes), end), grid[:-1]])
    adam, h, at = Adam(net, rate), np.zeros((lanes, WIDTH), np.float32), 0
    for k in range(steps):
        if at >= span:
            at, h = 0, np.zeros_like(h)
        source, target = before[at:at + window], grid[at:at + window]
        at += window
        adam.rate = rate * (1 - 0.9 * k / steps)
        h = _learn(net, units, adam, source, target, source == end, h)
    return net


class Learner:
    """Goes on training a copy of ``net``, once over every unit of the documents it is given."""

    def __init__(self, units: Units, net: dict, rate: float = LEARN_RATE):
        self.units, self.net, self.seen = units, {k: v.copy() for k, v in net.items()}, 0
        self.adam = Adam(self.net, rate)

    def learn(self, text: np.ndarray, lanes: int = LANES, window: int = 16) -> None:
        """``text``: units of documents back to back, each with its end; cut into lanes of equal length, fewer for a short text so that it has several steps."""
        end = int(self.units.place[self.units.end])
        lanes = max(1, min(32, len(text) // window), min(lanes, len(text) // (32 * window)))
        span = -(-len(text) // lanes)
        padded = np.full(lanes * span, end, np.int64)
        padded[:len(text)] = text
        grid = padded.reshape(lanes, span).T
        there = (np.arange(lanes * span) < len(text)).reshape(lanes, span).T
        before = np.vstack([np.concatenate([[end], grid[-1, :-1]]), grid[:-1]])
        h = np.zeros((lanes, WIDTH), np.float32)
        for at in range(0, span, window):
            source = before[at:at + window]
            h = _learn(self.net, self.units, self.adam, source, grid[at:at + window], source == end, h, there[at:at + window])
        self.seen += len(text)


def learned(training: DataFrame, units: Units, net: dict, n_tokens: int, text_col: str = "text", id_col: str = "doc_id", learner_tokens: int = LEARNER_TOKENS) -> dict:
    """The network after one pass over all tokens of all training texts.

    Documents are dealt to learners by a hash, one for every ``learner_tokens`` tokens; each goes on from ``net`` over its
    documents, and the parameters are averaged by the tokens learned.  Which learner gets a document, and when, does not
    depend on how the table lies in files.  The driver gets the averages only, as many numbers as the network has.
    """
    names = sorted(net)
    own = F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)), F.lit(31))

    known = units.known()

    def encoded(texts: Texts) -> list:
        words = Words(texts)
        ids = known(word_keys(words)).astype("<u2")
        end = np.uint16(units.place[units.end])
        return [pa.array([np.append(ids[lo:hi], end).tobytes() for lo, hi in zip(words.first[:-1], words.first[1:])], pa.binary())]

    def run(batches):
        learner = Learner(units, net)
        held: list[bytes] = []
        size = 0

        def take() -> None:
            text = np.frombuffer(b"".join(held), "<u2")
            for lo in range(0, len(text), 2 * LEARN_TOKENS):  # only a very long text is cut here
                learner.learn(text[lo:lo + 2 * LEARN_TOKENS])

        for batch in batches:
            for ids in batch.column("__ids").to_pylist():
                held.append(ids)
                size += len(ids) // 2
                if size >= LEARN_TOKENS:
                    take()
                    held, size = [], 0
        take()
        if learner.seen:
            values = np.concatenate([learner.net[k].reshape(-1) for k in names]).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"seen": [learner.seen], "p": pa.array([values], pa.list_(pa.float64()))})

    sent = over_texts(training.select(own.alias("__u"), F.col(quoted(text_col)).alias("__text")), "__text", [("__ids", "binary")], encoded, passing=["__u"])
    dealt = sent.repartition(max(1, round(n_tokens / learner_tokens)), "__u").sortWithinPartitions("__u", "__ids")
    made = stored(dealt.select("__ids").mapInArrow(run, "seen long, p array<double>"), "lm-learned")
    total = made.agg(F.sum("seen")).first()[0]
    if not total:
        return net
    share = made.select((F.col("seen") / F.lit(float(total))).alias("share"), F.posexplode("p").alias("at", "v"))
    rows = share.groupBy("at").agg(F.sum(F.col("share") * F.col("v")).alias("v")).toPandas().sort_values("at")
    values, start, out = rows["v"].to_numpy(np.float64), 0, {}
    for k in names:
        out[k] = values[start:start + net[k].size].reshape(net[k].shape).astype(np.float32)
        start += net[k].size
    return out


def document_scores(net: dict, units: Units, tokens: np.ndarray, first: np.ndarray, lanes: int = LANES, window: int = 16) -> np.ndarray:
    """Natural log-likelihood of every document; ``tokens`` holds documents back to back from ``first``."""
    sizes = np.diff(first)
    end = int(units.place[units.end])
    queue = [(0, k) for k in range(max(1, min(lanes, len(sizes))))]
    held: list[list[int]] = [[] for _ in queue]
    for d in np.argsort(-sizes, kind="stable"):
        load, k = heapq.heappop(queue)
        held[k].append(int(d))
        heapq.heappush(queue, (load + int(sizes[d]), k))
    loads = np.array([sizes[x].sum() for x in held])
    held = [held[k] for k in np.argsort(-loads, kind="stable")]
    loads = -np.sort(-loads)
    starts = [np.concatenate([np.arange(first[d], first[d + 1]) for d in x]) if x else np.empty(0, np.int64) for x in held]
    result = np.zeros(len(tokens), np.float32)
    source = np.empty(len(tokens), np.int32)
    source[1:] = tokens[:-1]
    source[first[:-1]] = end
    h = np.zeros((len(held), WIDTH), np.float32)
    opening = np.zeros(len(tokens), bool)
    opening[first[:-1]] = True
    at = 0
    while at < loads[0]:
        active = int(np.searchsorted(-loads, -at, "left"))
        # the fewer lanes are left the longer is their window, until half of them end
        length = int(min(loads[0] - at, max(window, min(WINDOW_TOKENS // active, loads[active // 2] - at))))
        index = np.full((length, active), -1, np.int64)
        for k in range(active):
            piece = starts[k][at:at + length]
            index[:len(piece), k] = piece
        there = index >= 0
        clean = np.maximum(index, 0)
        hidden, last, _ = _run(net, source[clean], opening[clean] | ~there, h[:active], False)
        h[:active] = last
        where = index[there]
        result[where] = _log_probabilities(net, units, hidden[there], tokens[where])[0]
        at += length
    return np.add.reduceat(result.astype(np.float64), first[:-1]) if len(sizes) else np.zeros(0)


class Model:
    """Everything a task needs to score: units, network, corpus size."""

    def __init__(self, units: Units, net: dict, train_tokens: int, distinct: int, end_count: int):
        self.units, self.net, self.train_tokens, self.distinct, self.end_count = units, net, train_tokens, distinct, end_count


def unit_sequences(units: Units):
    def sequences(texts: Texts) -> list:
        words = Words(texts)
        ids = units.look_up(word_keys(words))[2].astype(np.int32)
        end = np.int32(units.place[units.end])
        made = [np.append(ids[lo:hi], end) for lo, hi in zip(words.first[:-1], words.first[1:])]
        return [pa.array(made, pa.list_(pa.int32()))]

    return sequences


def fit(training: DataFrame, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, frequent: int = FREQUENT) -> Model:
    """A model from training documents and their word counts.

    All counts come from the whole corpus, and the network learns from all of it; ``frequent`` bounds the table of counts that
    tasks hold and ``sample_rows`` the documents (of each an excerpt of 4,096 characters) for the network that learning starts from.
    """
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_docs = training.count()
    top = counts.orderBy(F.desc("c"), "key").limit(frequent).toPandas()  # the documented bound
    keys, c = top["key"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    mass = np.zeros(BINS)
    for r in counts.groupBy(F.col("key").bitwiseAND(F.lit(BINS - 1)).alias("bin")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["bin"]] = r["m"]
    known = keys[np.lexsort((keys, -c))[:VOCABULARY]]
    np.subtract.at(mass, known & (BINS - 1), c[np.lexsort((keys, -c))[:VOCABULARY]] + 1)
    units = Units(keys, c, n_docs, mass + 1)
    key = F.col(quoted(id_col))
    sample = training.select(F.xxhash64(key, F.lit(21)).alias("__u"), F.col(quoted(text_col)).substr(1, 1 << 30).alias("t")).filter("length(t) > 0")
    place = (F.pmod(F.col("__u"), F.lit(1 << 40)) / float(1 << 40) * F.greatest(F.length("t") - EXCERPT, F.lit(0))).cast("int") + 1
    chosen = sample.select("__u", F.col("t").substr(place, F.lit(EXCERPT)).alias("t")).orderBy("__u", "t").limit(sample_rows)
    rows = over_texts(chosen, "t", [("ids", "array<int>")], unit_sequences(units), passing=[]).collect()
    net = train(units, [np.array(r["ids"], np.int64) for r in rows])
    net = learned(training, units, net, int(size["n"]) + n_docs, text_col, id_col)
    return Model(units, net, int(size["n"]) + n_docs, int(size["v"]) + (n_docs > 0), n_docs)


def _score_slice(model: Model):
    units, ln10 = model.units, np.log(10)

    def score(texts: Texts) -> list:
        words = Words(texts)
        keys = word_keys(words)
        found, count, unit = units.look_up(keys)
        n_docs = len(texts)
        end = np.int64(units.place[units.end])
        first = words.first + np.arange(n_docs + 1)
        tokens = np.full(len(keys) + n_docs, end, np.int64)
        tokens[np.arange(len(keys)) + np.repeat(np.arange(n_docs), words.counts())] = unit
        likelihood = document_scores(model.net, units, tokens, first) / ln10

        def per_doc(values):
            total = np.concatenate([[0.0], np.cumsum(values)])
            return total[words.first[1:]] - total[words.first[:-1]]

        smooth = np.where(found, np.log10(count + 1.0), 0.0)
        is_open = units.place[units.first_bin + (keys & (BINS - 1))] == unit
        openness = np.where(is_open, np.where(found, smooth, 0.0) - np.log10(units.open_mass[keys & (BINS - 1)]), 0.0)
        rare_keys, rare_counts = [], []
        for lo, hi in zip(words.first[:-1], words.first[1:]):
            k, c = np.unique(keys[lo:hi][~found[lo:hi]], return_counts=True)
            rare_keys.append(k)
            rare_counts.append(c.astype(np.int32))
        lists = np.concatenate([[0], np.cumsum([len(k) for k in rare_keys])]).astype(np.int32)
        flat = lambda x, kind: pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate(x) if x else np.empty(0, kind), pa.from_numpy_dtype(kind)))
        return [
            words.counts().astype(np.int64) + 1, per_doc((found & (count > 0)).astype(np.float64)).round().astype(np.int64) + int(model.end_count > 0),
            per_doc(smooth) + np.log10(model.end_count + 1.0), likelihood + per_doc(openness), flat(rare_keys, np.dtype(np.int64)), flat(rare_counts, np.dtype(np.int32)),
        ]

    return score


def scores(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", passing: list[str] | None = None) -> DataFrame:
    """``passing`` columns (the id when not given) with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z and one end.  Defined cases: a null or
    empty text is its end alone; words that training lacks count 0 and share the smoothing mass of their
    open unit; without training documents everything is smoothing; repeated rows are scored alike, each in
    its own row; an empty table gives an empty result; columns named like the new ones are replaced.
    """
    keep = [id_col] if passing is None else passing
    fields = [("n_tokens", "long"), ("__known", "long"), ("__base", "double"), ("__score", "double"), ("__keys", "array<long>"), ("__counts", "array<int>")]
    made = over_texts(docs, text_col, fields, _score_slice(model), passing=keep, limit=SCORE_BYTES)
    made = stored(made.withColumn("__row", F.monotonically_increasing_id()), "lm-scores")
    rare = made.select("__row", F.explode(F.arrays_zip("__keys", "__counts")).alias("r")).select("__row", F.col("r.__keys").alias("key"), F.col("r.__counts").alias("n"))
    sums = rare.join(counts, "key").groupBy("__row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("__more"), F.sum("n").alias("__met"))
    norm = float(np.log10(model.train_tokens + model.distinct + 1))
    more, met = F.coalesce("__more", F.lit(0.0)), F.coalesce("__met", F.lit(0))
    return made.drop("__keys", "__counts").join(sums, "__row", "left").select(
        *map(quoted, [c for c in keep if c not in {n for n, _ in fields}]), "n_tokens", (F.col("__known") + met).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), (F.col("__base") + more - F.col("n_tokens") * norm).alias("base_score"), (F.col("__score") + more).alias("score"),
    )
