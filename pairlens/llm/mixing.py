"""Mixing to target weights with soft domains.

A classifier learned from a table of labelled documents gives every document a posterior over
the domains; nothing is assigned to one domain outright.  A document d with t_d tokens then
holds t_d·p(k|d) expected tokens of domain k.  Projected-gradient least squares fits rates r_d
(how often d is read in an epoch), none below 0 or above the repeats that an epoch allows, so that
the expected totals Σ r_d·t_d·p(k|d) meet the targets.  A step needs a few sums over all
documents; the rates are a column of a written table, none is gathered.

The classifier is naive Bayes over hashed lower-cased words, its per-bucket scores a table of
``buckets`` rows, softened by a temperature that held-out labelled rows choose.  Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.components import stored
from pairlens.llm.textbatch import quoted

BUCKETS = 65_536
#: Most repeats of a document in an epoch, and most steps of the fit.
MOST, STEPS = 4.0, 25
#: Step sizes tried at once, and the part of the squared distance that a step has to take off.
SIZES, ENOUGH = (1.0, 0.4, 0.15, 0.05, 0.01), 0.02
#: About so many labelled rows, chosen by a hash of their id, teach the classifier.
LABELLED_ROWS = 20_000
#: Score tables up to this size are broadcast, larger ones joined by bucket.
BROADCAST_BYTES = 32 << 20
#: One labelled text in so many, by a hash of the text, is held out to fit the temperature.
HELD_OUT = 5
#: Temperatures tried: words of evidence taken from a text's mean word score, factor of its telling words, and from how many
#: standard deviations above its expected document count in some domain a word is telling.
TEMPERATURES = [(mean, factor, least) for mean in (0.0, 0.5, 1.0, 2.0, 4.0, 8.0) for factor in (0.0, 0.06, 0.12, 0.25, 0.5, 1.0) for least in (6.0, 10.0, 14.0)]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _exploded(rows: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
    """A row per word of ``__text`` (``kind`` 0) and per distinct word of it (1), one with a null word at least."""
    lists = rows.select(*keys, _words(F.col("__text")).alias("ws")).select(*keys, F.posexplode(F.array("ws", F.array_distinct("ws"))).alias("kind", "ws"))
    return lists.select(*keys, "kind", F.explode_outer("ws").alias("w")).withColumn("bucket", _bucket(F.col("w"), buckets))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", domain_col: str = "domain", buckets: int = BUCKETS, labelled_rows: int = LABELLED_ROWS) -> tuple | None:
    """(domains, per-bucket scores, log priors, temperature) from about ``labelled_rows`` labelled rows, all if there are no more; None without any.

    The rows are those whose id has a hash below a bound, so their ids are few enough to go to the texts and no
    other text moves.  ``labels`` has an id and a domain; a document with several labels counts for the smallest.  The
    temperature has the best likelihood on held-out labelled texts, scored by the others' counts; equal
    texts are on one side.  When either side is empty it is fitted on all labelled rows.
    """
    marks = labels.select(F.col(quoted(label_id_col)).alias("__id"), F.col(quoted(domain_col)).cast("string").alias("__domain")).dropna().groupBy("__id").agg(F.min("__domain").alias("__domain"))
    text = F.col(quoted(text_col))
    held = F.pmod(F.xxhash64(text, F.lit(41)), F.lit(HELD_OUT)) == 0
    marks = stored(marks, "mixing-marks")
    part = min(1.0, labelled_rows / max(1, marks.count()))
    marks = marks.filter(F.pmod(F.xxhash64("__id", F.lit(43)), F.lit(1 << 30)) < round(part * (1 << 30)))
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), text.alias("__text"), held.alias("__held")).join(F.broadcast(marks), "__id")
    rows = stored(rows, "mixing-rows")
    counts = stored(_exploded(rows, buckets, ["__domain", "__held"]).filter("w IS NOT NULL").groupBy("__domain", "__held", "kind", "bucket").agg(F.count("*").alias("n")), "mixing-counts")
    groups = {(r["__domain"], r["__held"]): r["n"] for r in rows.groupBy("__domain", "__held").agg(F.count("*").alias("n")).collect()}  # two rows per domain
    if not groups:
        return None
    domains = sorted({d for d, _ in groups})
    sizes = {d: sum(groups.get((d, h), 0) for h in (False, True)) for d in domains}
    priors = [math.log(sizes[d] / sum(sizes.values())) for d in domains]
    split = len({h for _, h in groups}) == 2
    telling = sorted({t for _, _, t in TEMPERATURES})
    tried = _scores(counts.filter("NOT __held"), {d: groups.get((d, False), 0) for d in domains}, buckets, telling[0]) if split else _scores(counts, sizes, buckets, telling[0])
    sums = _sums(rows.filter("__held") if split else rows, stored(tried, "mixing-tried"), len(domains), buckets, telling)
    temperature = _temperature(sums.join(marks, "__id"), domains, priors, telling)
    return domains, stored(_scores(counts, sizes, buckets, temperature[2]), "mixing-scores"), priors, temperature


def _scores(counts: DataFrame, sizes: dict[str, int], buckets: int, least: float) -> DataFrame:
    """``kind``, ``bucket``, a score per domain and ``z``: the log likelihood of a word (``kind`` 0), or how much more documents of the domain have it than its share (1)."""
    totals = {r["__domain"]: r["n"] for r in counts.filter("kind = 0").groupBy("__domain").agg(F.sum("n").alias("n")).collect()}
    k, all_rows = range(len(sizes)), sum(sizes.values())
    part = [n / all_rows for n in sizes.values()]
    wide = counts.groupBy("kind", "bucket").agg(*[F.coalesce(F.sum(F.when(F.col("__domain") == d, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, d in enumerate(sizes)])
    whole = sum((F.col(f"n{i}") for i in k), F.lit(0))
    z = F.array_max(F.array(*[(F.col(f"n{i}") - whole * part[i]) / F.sqrt(whole * part[i] * (1 - part[i]) + 1e-9) for i in k]))
    # a bucket that no labelled row has says nothing
    scores = [F.when(F.col("kind") == 0, F.log((F.col(f"n{i}") + 1) / F.lit(float(totals.get(d, 0) + buckets)))).otherwise(F.log((F.col(f"n{i}") + 1) / (whole * part[i] + 1))).alias(f"s{i}") for i, d in enumerate(sizes)]
    return wide.select("kind", "bucket", *scores, z.alias("z")).filter(f"kind = 0 OR z >= {least}")


def _sums(rows: DataFrame, scores: DataFrame, k: int, buckets: int, telling: list[float]) -> DataFrame:
    """``__id``, ``tokens``, ``hits`` (words with scores), score sums ``t0``... and per bound of ``telling`` those of telling words, of texts ``__text``."""
    small = 2 * buckets * (k + 3) * 8 <= BROADCAST_BYTES  # the most that ``scores`` can hold
    known = _exploded(rows, buckets, ["__id"]).join(F.broadcast(scores) if small else scores, ["kind", "bucket"], "left")
    one, zero = F.col("kind") == 0, F.lit(0.0)
    return known.groupBy("__id").agg(
        F.count(F.when(one, F.col("w"))).alias("tokens"), F.count(F.when(one, F.col("s0"))).alias("hits"), *[F.coalesce(F.sum(F.when(one, F.col(f"s{i}"))), zero).alias(f"t{i}") for i in range(k)],
        *[F.coalesce(F.sum(F.when(~one & (F.col("z") >= least), F.col(f"s{i}"))), zero).alias(f"u{j}_{i}") for j, least in enumerate(telling) for i in range(k)],
    )


def _logit(i: int, prior: float, mean, factor, telling: Column) -> Column:
    return F.col(f"t{i}") * F.least(F.col("hits"), mean) / F.greatest(F.col("hits"), F.lit(1)) + telling * factor + F.lit(prior)


def _temperature(sums: DataFrame, domains: list[str], priors: list[float], telling: list[float]) -> tuple[float, float, float]:
    """The one of :data:`TEMPERATURES` with the least log loss on ``sums`` with their ``__domain``."""
    tried = sums.withColumn("c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m"), F.lit(f).alias("f"), F.lit(telling.index(t)).alias("j")) for i, (m, f, t) in enumerate(TEMPERATURES)])))
    logits = [_logit(i, x, F.col("c.m"), F.col("c.f"), F.array(*[F.col(f"u{j}_{i}") for j in range(len(telling))])[F.col("c.j")]) for i, x in enumerate(priors)]
    own = F.coalesce(*[F.when(F.col("__domain") == d, F.col("l")[i]) for i, d in enumerate(domains)])
    whole = F.array_max("l") + F.log(F.aggregate(F.transform("l", lambda x: F.exp(x - F.array_max("l"))), F.lit(0.0), lambda a, b: a + b))
    losses = tried.withColumn("l", F.array(*logits)).groupBy("c.i").agg(F.sum(whole - own).alias("loss")).collect()  # one row per temperature
    return TEMPERATURES[min((r["loss"], r["i"]) for r in losses)[1]]


def posteriors(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``__id``, ``tokens`` and ``p`` (posterior per domain) per document id.

    Two sums are softened by the model's temperature: the mean score of all words, and the scores of the
    text's distinct telling words.  A text without words has the priors.
    """
    domains, scores, priors, (mean, factor, least) = model
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text"))
    logits = F.array(*[_logit(i, x, F.lit(mean), F.lit(factor), F.col(f"u0_{i}")) for i, x in enumerate(priors)])
    exps = F.transform("l", lambda x: F.exp(x - F.array_max("l")))
    return _sums(rows, scores, len(domains), buckets, [least]).withColumn("l", logits).withColumn("e", exps).select(
        "__id", "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p")
    )


def _slope(at: list[float], drift: float) -> Column:
    return sum((F.col("p")[i] * x for i, x in enumerate(at)), F.lit(-drift))


def fit_rates(soft: DataFrame, targets: list[float], tolerance: float = 1e-4, least: float = 0.0, most: float = MOST, free: bool = False, steps: int = STEPS) -> tuple[DataFrame, list[dict]]:
    """Rates for the posteriors ``soft``; returns them with the history of totals.

    ``targets`` are the wanted shares of tokens by domain.  Projected gradient descent minimises the
    squared distance of the expected domain totals from the wanted ones over rates in [``least``, ``most``], from
    rates of 1.  The epoch keeps its length, or with ``free`` gets the one that the rates give it and only
    its shares are fitted.  The gradient of a document's rate per token is its posteriors times the totals'
    distances, so a pass gathers a few sums per domain and the rates stay a stored column.  The gradient is scaled by the
    matrix Σ t_d·v_d·v_d' of the documents that can still move (those at a bound that it would push
    beyond stand still), and of a few step sizes the one that ends nearest is taken.

    The last entry of the history has ``gap``, the largest difference from a wanted total as a share of
    the epoch, and ``status``: ``met`` (gap within ``tolerance``), ``bounded`` (a step within the bounds brings the
    totals no nearer, or by less than :data:`ENOUGH` of the squared distance), ``infeasible`` (bounded, and a plane through the targets has all posteriors on
    one side, so no rates meet them) or ``open`` (``steps`` were not enough).
    """
    k = len(targets)
    shares = [t / sum(targets) for t in targets]
    tokens, rate = F.col("tokens"), F.col("rate")
    start = F.when(tokens > 0, F.lit(min(most, max(least, 1.0)))).otherwise(1.0)
    state = stored(soft.withColumn("rate", start), "mixing-soft")
    total = state.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if total == 0:
        return state, [{"step": 0, "totals": [0.0] * k, "length": 0.0, "gap": 0.0, "status": "met"}]
    # with a free length the distances of all domains add up to nothing, so one of them says no more than the others
    used = k - 1 if free and k > 1 else k
    middle = shares if free else [0.0] * k
    v = [F.col("p")[i] - middle[i] for i in range(used)]

    def along(at: list[float]) -> Column:
        return sum((x * y for x, y in zip(v, at)), F.lit(0.0))

    def moved(at: list[float], size: float) -> Column:
        return F.when(tokens > 0, F.least(F.greatest(rate - size * along(at), F.lit(float(least))), F.lit(float(most)))).otherwise(1.0)

    def look(ways: list[Column]) -> list[dict]:
        """Totals and distances under each of some ways to set the rates, in one pass."""
        row = state.agg(*[F.sum(r * tokens * F.col("p")[i]).alias(f"a{n}_{i}") for n, r in enumerate(ways) for i in range(k)]).first()
        found = []
        for n in range(len(ways)):
            totals = [row[f"a{n}_{i}"] for i in range(k)]
            size = sum(totals) if free else total
            off = [totals[i] - shares[i] * size for i in range(k)]
            found.append({"totals": totals, "length": size, "off": off, "distance": _dot(off[:used], off[:used])})
        return found

    def movable(off: list[float]) -> list[list[float]]:
        """The matrix of the documents that the gradient moves inside the bounds."""
        up = along(off)
        inside = (tokens > 0) & ~((rate <= least) & (up > 0)) & ~((rate >= most) & (up < 0))
        row = state.filter(inside).agg(*[F.coalesce(F.sum(tokens * v[i] * v[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(used) for j in range(i, used)]).first()
        return [[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(used)] for i in range(used)]

    now, status = look([rate])[0], "open"
    history = [{"step": 0, "totals": now["totals"]}]
    while len(history) <= steps:
        if max(map(abs, now["off"])) <= tolerance * now["length"]:
            status = "met"
            break
        gram = movable(now["off"])
        scale = sum(gram[i][i] for i in range(used))
        if scale <= 1e-12 * total:
            status = "bounded"
            break
        at = _solve(gram, now["off"][:used], 1e-6 * scale)
        ways = [moved(at, size) for size in SIZES]
        best, then = min(enumerate(look(ways)), key=lambda w: w[1]["distance"])
        if then["distance"] > (1 - ENOUGH) * now["distance"]:
            status = "bounded"
            break
        state, now = stored(state.withColumn("rate", ways[best]), "mixing-soft"), then
        history.append({"step": len(history), "totals": now["totals"]})
    if status == "bounded":
        off = now["off"]
        over = state.filter("tokens > 0").agg(F.min(_slope(off, _dot(off, shares))).alias("m")).first()["m"]
        if over > 1e-9 * max(map(abs, off)):
            status = "infeasible"
    history[-1] |= {"length": now["length"], "gap": max(map(abs, now["off"])) / now["length"], "status": status}
    return state, history


def _dot(a: list[float], b: list[float]) -> float:
    return sum(x * y for x, y in zip(a, b))


def _solve(gram: list[list[float]], gap: list[float], ridge: float) -> list[float]:
    """Solves (G + ridge·I) x = gap by elimination; as many unknowns as domains."""
    n = len(gap)
    a = [[*gram[i][:i], gram[i][i] + ridge, *gram[i][i + 1:], gap[i]] for i in range(n)]
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[top] = a[top], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i])]
    return [a[i][n] / a[i][i] for i in range(n)]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", domain_col: str = "domain", least: float = 0.0, most: float = MOST, free: bool = False) -> DataFrame:
    """Per document id: ``doc_id``, ``n_tokens``, one ``p_<domain>`` each, ``rate``, ``copies``, ``gap``.

    ``copies`` rounds the rate up or down by a hash of the id, so that its mean is the rate; with
    ``least`` 1 every document has a copy, and none has more than ``most`` (rounded up).  The copies' tokens are about
    those of the documents, or with ``free`` at most ``most`` times as many.  ``gap``, the
    same in every row, is how far the rates stay from the targets (see :func:`fit_rates`); a warning is given
    when that is more than the tolerance.  Defined cases: a null or wordless text has no tokens, the prior posteriors and rate 1; rows that share an id
    are one document with all their words; a null id is one document; domains without a target keep the
    share that the labelled rows leave them (target 0 only if given); without labelled rows there is one
    domain ``all`` and every rate is 1; empty tables give an empty result; other columns are ignored.
    """
    model = learn(docs, labels, id_col, text_col, label_id_col, domain_col)
    if model is None:
        rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.size(_words(F.col(quoted(text_col)))).alias("n"))
        return rows.groupBy("doc_id").agg(F.sum("n").alias("n_tokens")).select("doc_id", "n_tokens", F.lit(1.0).alias("p_all"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"), F.lit(0.0).alias("gap"))
    domains, _, priors, _ = model
    given = {d: targets[d] for d in domains if d in targets}
    left = max(0.0, 1 - sum(given.values()))
    rest = {d: math.exp(priors[i]) for i, d in enumerate(domains) if d not in given}
    shares = [given[d] if d in given else left * rest[d] / sum(rest.values()) for d in domains]
    rated, history = fit_rates(posteriors(docs, model, id_col, text_col), shares if sum(shares) > 0 else [1.0] * len(domains), least=least, most=most, free=free)
    end = history[-1]
    if end["status"] != "met":
        warnings.warn(f"mixture targets not met ({end['status']}): largest gap {end['gap']:.4f} of the epoch's tokens, totals {dict(zip(domains, end['totals']))}", stacklevel=2)
    u = F.pmod(F.xxhash64("__id", F.lit(31)), F.lit(1 << 40)) / float(1 << 40)
    return rated.select(
        F.col("__id").alias("doc_id"), F.col("tokens").alias("n_tokens"), *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("long")).cast("long").alias("copies"), F.lit(end["gap"]).alias("gap"),
    )
