"""Personal data by boosted trees over overlapping candidates.

Generators of high recall propose spans: the four strict patterns, also where their own test
fails, and looser ones for other ways to write the same (letters beyond ASCII in a mail name,
``(at)``, dots or slashes between digits).  What the strict rules accept is always kept.  Small
integer features of a candidate's format and of the characters around it go to gradient boosted
trees; a threshold per kind, calibrated on texts held out from learning, selects which other
candidates are personal data too.  Everything is DataFrame and SQL functions.

A text's candidates stay in its row as an array, so nothing is shuffled but counts of feature
vectors.  Places of matches are running sums of the lengths of the pieces between them
(:func:`running`, in blocks, so that long texts with many matches stay linear).  Patterns are
written so that no step needs a stack or time that grows faster than the text.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.components import stored
from pairlens.llm.textbatch import quoted

KINDS = ("email", "ip", "card", "phone")
AROUND = 24
#: Training: trees, levels of a tree, step size, ridge on leaves, largest leaf.
ROUNDS, LEVELS, RATE, RIDGE, LEAF = 10, 3, 0.5, 1.0, 4.0
#: Weight of a loose candidate without a mark, which counts as no personal data.
UNMARKED = 0.2
#: One text in so many, by a hash of the text, is held out for the thresholds.
HELD_OUT = 5
#: Calibrated share of personal data that a selected candidate needs.
PRECISION = 0.9
BIN = 0.25


class Generator(NamedTuple):
    """Proposes spans of ``kind`` in texts that match ``hint``; a ``strict`` one also decides what is kept without the model."""

    kind: int
    pattern: str
    hint: str
    strict: bool


_OPEN = r"""[^\s@<>()\[\]{},;:"'|]"""
_LABEL = r"""[^\s@<>()\[\]{},;:"'|.]"""
_UPTO_255 = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: The four strict patterns.  A run of characters is only entered at its start or behind the match before.
GENERATORS = (
    Generator(0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", True),
    Generator(1, r"(?:\G|(?<![0-9]))[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]", True),
    Generator(2, r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){6}", True),
    Generator(3, r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True),
    Generator(0, rf"(?:\G|(?<!{_OPEN})){_OPEN}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", False),
    Generator(0, r"(?i)[a-z0-9._%+-]{1,64}\s?[(\[]at[)\]]\s?[a-z0-9-]{1,64}(?:\s?(?:\.|[(\[]dot[)\]])\s?[a-z0-9-]{1,64}){1,8}", r"(?i)[(\[]at[)\]]", False),
    Generator(2, r"(?:\G|(?<![0-9]))[0-9](?:[\x20./-]{0,2}[0-9]){12,18}", r"[0-9](?:[\x20./-]{0,2}[0-9]){12}", False),
    Generator(3, r"(?:\G|(?<![0-9+(]))(?:\+|00|\(|0)[0-9\x20()./-]{6,30}[0-9]", r"[+(0][0-9\x20()./-]{6}", False),
)
CUES = (r"(?i)\b(?:e-?mail|mailto)\b", r"(?i)\b(?:tel|phone|call|fax|mobile)\b", r"(?i)\b(?:card|visa|credit)\b", r"(?i)\b(?:ip|host|addr|server)\b")
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """Inclusive running ``op`` over an array of longs, in two levels of blocks; ``op`` must be associative."""
    fold = lambda xs: F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), lambda a, b: op(a, b))

    def of_blocks(blocks: Column) -> Column:
        return let(F.transform(blocks, fold), lambda tops: let(
            # what lies before each block; nothing before the first
            F.transform(blocks, lambda _, b: F.when(b > 0, fold(F.slice(tops, 1, F.greatest(b, F.lit(1)))))),
            lambda before: F.flatten(F.transform(blocks, lambda xs, b: F.transform(xs, lambda _, i: let(fold(F.slice(xs, 1, i + 1)), lambda own: F.when(b > 0, op(F.get(before, b), own)).otherwise(own))))),
        ))

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / block).cast("int")), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
    return let(values, lambda xs: F.when(F.size(xs) > 0, let(cut(xs), of_blocks)).otherwise(F.array().cast("array<bigint>")))


def _total(a: Column, b: Column) -> Column:
    return a + b


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _accepted(kind: int, m: Column) -> Column:
    """The strict test of a kind's match."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return m.rlike(rf"^{_UPTO_255}(?:\.{_UPTO_255}){{3}}$")
    size = F.length(_digits(m))
    return size.between(13, 19) & _luhn(_digits(m)) if kind == 2 else size.between(9, 15)


def _proposed(text: Column, g: Generator) -> Column:
    """The candidates of one generator: kind, place, whether kept anyway, own seed (1 accepted, 0 refused, -1 open), match, surroundings."""
    parts = F.struct(F.split(text, g.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)).alias("hits"))

    def placed(p: Column) -> Column:
        size = F.transform(p["hits"], lambda m, i: (F.length(F.get(p["gaps"], i)) + F.length(m)).cast("long"))
        return let(running(size, _total), lambda ends: F.transform(p["hits"], lambda m, i: F.struct(
            F.lit(g.kind).alias("kind"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), (_accepted(g.kind, m) if g.strict else F.lit(False)).alias("base"),
            F.lit(0 if g.strict else -1).alias("seed"), m.alias("m"), F.right(F.get(p["gaps"], i), F.lit(AROUND)).alias("before"), F.left(F.get(p["gaps"], i + 1), F.lit(AROUND)).alias("after"),
        )))

    worth = lambda c: c["base"] | (F.lit(True) if g.kind == 0 else F.length(_digits(c["m"])) >= 7)
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,seed:int,m:string,before:string,after:string>>")
    return F.when(text.rlike(g.hint), F.filter(let(parts, placed), worth)).otherwise(none)


def _unclaimed(all_: Column) -> Column:
    """The kept candidates, and of the others those that no kept one overlaps."""
    no_end, no_start = F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")

    def free(a: Column) -> Column:
        ends = running(F.transform(a, lambda c: F.when(c["base"], c["end"]).otherwise(no_end)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(a, lambda c: F.when(c["base"], c["start"]).otherwise(no_start))), F.least))
        return let(F.struct(ends.alias("e"), starts.alias("s")), lambda x: F.filter(a, lambda c, i: c["base"] | ((F.get(x["e"], i) <= c["start"]) & (F.get(x["s"], i) >= c["end"]))))

    by_place = F.array_sort(F.transform(all_, lambda c: F.struct(*[c[n].alias(n) for n in ("start", "end", "kind", "base", "seed", "m", "before", "after")])))
    return let(by_place, free)


def _features(c: Column) -> Column:
    """Small integers that tell a candidate's format and surroundings; separators and scripts are not told apart."""
    m, d = c["m"], _digits(c["m"])
    flag = lambda x: F.when(x, 1).otherwise(0)
    edge = lambda s: F.when(s.rlike(r"^[0-9]"), 1).when(s.rlike(r"^\p{L}"), 2).when(s.rlike(r"^[.@_/\\=&#-]"), 3).otherwise(0)
    cue = F.coalesce(*[F.when(c["before"].rlike(p), i + 1) for i, p in enumerate(CUES)], F.lit(0))
    groups = F.size(F.split(F.regexp_replace(F.regexp_replace(m, r"[^0-9]+", " "), r"^ | $", ""), " "))
    values = [
        c["kind"], F.least(F.length(d), F.lit(20)), F.least(F.length(F.regexp_replace(m, r"[^\p{L}]", "")), F.lit(4)), F.least(groups, F.lit(7)),
        flag(F.length(d).between(13, 19) & _luhn(d)), flag(m.rlike(rf"^{_UPTO_255}(?:\.{_UPTO_255}){{3}}$")),
        F.when(m.rlike(r"^(?:\+|00)"), 2).when(m.rlike(r"^[0(]"), 1).otherwise(0), flag(m.rlike(r"(?i)(?:@|[(\[]at[)\]]).*(?:\.|[(\[]dot[)\]])")),
        edge(F.reverse(c["before"])), edge(c["after"]), cue, F.least(F.length(_digits(c["before"])), F.lit(3)),
    ]
    return F.array(*[v.cast("int") for v in values])


def candidates(text: Column) -> Column:
    """All candidates of a text with their features ``f``, in order of place."""
    all_ = F.concat(*[_proposed(text, g) for g in GENERATORS])
    kept = let(all_, lambda a: F.when(F.size(a) > 0, _unclaimed(a)))
    return F.transform(kept, lambda c: F.struct(*[c[n].alias(n) for n in ("kind", "start", "end", "base")], F.when(c["base"], 1).otherwise(c["seed"]).alias("seed"), _features(c).alias("f")))


class Model(NamedTuple):
    """Trees as nested (feature, bound, left, right) with numbers as leaves; per kind the least margin selected, or None;
    the calibrated shares by margin; whether what a strict rule refused can be selected (only with marks to learn from)."""

    trees: tuple
    bounds: tuple
    shares: tuple
    refused: bool = False


def _tree(node, f: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    at, bound, left, right = node
    return F.when(F.get(f, F.lit(at)) <= bound, _tree(left, f)).otherwise(_tree(right, f))


def margin(trees: tuple, f: Column) -> Column:
    return sum((_tree(t, f) for t in trees), F.lit(0.0))


def _leaf(g: float, h: float) -> float:
    return max(-LEAF, min(LEAF, -RATE * g / (h + RIDGE)))


def _grow(rows: DataFrame, trees: tuple):
    """The next tree on weighted vectors ``f``, ``y``, ``w``: one pass per level, each collecting sums per node, feature and value."""
    p = 1 / (1 + F.exp(-margin(trees, F.col("f"))))
    sloped = rows.withColumn("p", p).select("f", (F.col("w") * (F.col("p") - F.col("y"))).alias("g"), (F.col("w") * F.col("p") * (1 - F.col("p"))).alias("h"))
    splits: dict[int, tuple] = {}  # node number (root 1, children 2n and 2n + 1) to its split

    def number(n: int) -> Column:
        if n not in splits:
            return F.lit(n)
        at, bound, *_ = splits[n]
        return F.when(F.get("f", F.lit(at)) <= bound, number(2 * n)).otherwise(number(2 * n + 1))

    for level in range(LEVELS):
        at_node = sloped.select(number(1).alias("node"), "g", "h", F.posexplode("f").alias("at", "value")).filter(F.col("node") >= 1 << level)
        sums: dict[tuple, list] = {}
        for r in at_node.groupBy("node", "at", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # features times values times nodes
            sums.setdefault((r["node"], r["at"]), []).append((r["value"], r["g"], r["h"]))
        best: dict[int, tuple] = {}
        for (node, at), values in sorted(sums.items()):
            values.sort()
            whole_g, whole_h = sum(v[1] for v in values), sum(v[2] for v in values)
            g = h = 0.0
            for (value, dg, dh), _ in zip(values, values[1:]):
                g, h = g + dg, h + dh
                gain = g * g / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g * whole_g / (whole_h + RIDGE)
                if gain > 1e-6 and gain > best.get(node, (1e-6,))[0] + 1e-9:
                    best[node] = (gain, at, value, g, h, whole_g - g, whole_h - h)
        if not best:
            break
        splits.update({n: b[1:] for n, b in best.items()})

    def built(n: int):
        at, bound, lg, lh, rg, rh = splits[n]
        left = built(2 * n) if 2 * n in splits else _leaf(lg, lh)
        return at, bound, left, built(2 * n + 1) if 2 * n + 1 in splits else _leaf(rg, rh)

    return built(1) if 1 in splits else None


def _isotonic(bins: list[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """Rising shares of personal data by bin from (bin, weight of it, weight of all): neighbours in the wrong order are pooled."""
    pools: list[list] = []
    for b, yes, all_ in sorted(bins):
        pools.append([[b], yes, all_])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return [(b, yes / all_) for bs, yes, all_ in pools for b in bs]


def fit(docs: DataFrame, marks: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", precision: float = PRECISION) -> Model:
    """Learn from the candidates of all texts.

    What the strict rules accept is personal data, what they refuse is not, and a loose candidate counts
    as none with weight :data:`UNMARKED`.  ``marks`` (id, ``start``, ``end`` in code points, end exclusive) names
    further true spans of documents; then every candidate with a mark is true, and a loose one without in a document
    that has some is none with full weight.  Texts held out by their hash set the thresholds; where no
    candidate is held out, all do.  Equal candidates are learned as one weighted vector.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    held = (F.pmod(F.xxhash64(text, F.lit(13)), F.lit(HELD_OUT)) == 0).alias("held")
    each = docs.select(F.col(quoted(id_col)).alias("id"), held, F.explode(candidates(text)).alias("c")).select("id", "held", "c.*")
    y, w = F.when(F.col("seed") == 1, 1.0).otherwise(0.0), F.when(F.col("seed") < 0, UNMARKED).otherwise(1.0)
    if marks is not None:
        true = marks.select(F.col(quoted(id_col)).alias("id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(True).alias("true")).distinct()
        each = each.join(true, ["id", "start", "end"], "left").join(true.select("id", F.lit(True).alias("read")).distinct(), "id", "left")
        y, w = F.when(F.col("true") | (F.col("seed") == 1), 1.0).otherwise(0.0), F.when(F.col("read") | (F.col("seed") >= 0), 1.0).otherwise(UNMARKED)
    vectors = stored(each.select("held", "kind", "f", y.alias("y"), w.alias("w")).groupBy("held", "kind", "f", "y").agg(F.sum("w").alias("w")), "pii-vectors")
    trees: tuple = ()
    while len(trees) < ROUNDS:
        tree = _grow(vectors.filter("NOT held"), trees)
        if tree is None:
            break
        trees += (tree,)
    binned = vectors.select("held", "kind", "y", "w", F.floor(margin(trees, F.col("f")) / BIN).cast("int").alias("bin"))
    rows = binned.groupBy("held", "kind", "bin").agg(F.sum(F.col("y") * F.col("w")).alias("yes"), F.sum("w").alias("all")).collect()  # margins are bounded, so are bins
    use_held = any(r["held"] for r in rows)
    bounds, shares = [], []
    for kind in range(len(KINDS)):
        steps = _isotonic([(r["bin"], r["yes"], r["all"]) for r in rows if r["kind"] == kind and r["held"] == use_held])
        enough = [b for b, share in steps if share >= precision]
        bounds.append(min(enough) * BIN if enough else None)
        shares.append(tuple((b * BIN, share) for b, share in steps))
    return Model(trees, tuple(bounds), tuple(shares), marks is not None)


def _merged(chosen: Column) -> Column:
    """Overlapping chosen candidates as one span of the first one's kind."""
    def joined(s: Column) -> Column:
        def spans(ends: Column) -> Column:
            opens = F.filter(F.transform(s, lambda c, i: F.when((i == 0) | (c["start"] >= F.get(ends, F.greatest(i - 1, F.lit(0)))), i)), lambda i: i.isNotNull())
            return let(opens, lambda o: F.transform(o, lambda i, k: F.struct(
                F.get(s, i)["kind"].alias("kind"), F.get(s, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(o, k + 1), F.size(s)) - 1).alias("end"),
            )))

        return let(running(F.transform(s, lambda c: c["end"]), F.greatest), spans)

    return let(chosen, lambda s: F.when(F.size(s) > 0, joined(s)).otherwise(F.array().cast(SPAN)))


def find(docs: DataFrame, model: Model, text_col: str = "text", passing: list[str] | None = None) -> DataFrame:
    """Add to each text ``found``, its spans (``kind`` by number, ``start``, ``end``, ``base``) by kind and start.

    Spans of the strict rules (``base``) are all there; the model adds others, which overlap none of those nor
    one another.  Only ``passing`` (all columns when not given) goes along.  Defined cases: a null or empty
    text has none; repeated rows have their spans each; an empty table gives an empty result; a column named ``found`` is replaced.
    """
    passing = [c for c in (docs.columns if passing is None else passing) if c != "found"]
    rows = docs.select(*map(quoted, passing), candidates(F.coalesce(F.col(quoted(text_col)), F.lit(""))).alias("__c"))
    score = lambda c: margin(model.trees, c["f"])
    chosen = [(c, b) for c, b in enumerate(model.bounds) if b is not None]
    picked = lambda c: F.coalesce(*[F.when(c["kind"] == k, score(c) >= b) for k, b in chosen], F.lit(False)) if chosen else F.lit(False)
    more = F.filter("__c", lambda c: ~c["base"] & (F.lit(model.refused) | (c["seed"] != 0)) & picked(c))
    span = lambda c, base: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), F.lit(base).alias("base"))
    base = F.transform(F.filter("__c", lambda c: c["base"]), lambda c: span(c, True))
    spans = F.array_sort(F.concat(base, F.transform(_merged(more), lambda c: span(c, False))))
    return rows.select(*map(quoted, passing), F.coalesce(spans, F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")).alias("found"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_<kind>`` of the strict rules, ``base_sha256`` and ``spans`` of :func:`find`'s rows."""
    base = F.filter("found", lambda s: s["base"])
    of = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(found: DataFrame, text_col: str = "text", out: str = "redacted") -> DataFrame:
    """Add ``out``: the text with each span of ``found`` written as ``[KIND]``; overlapping spans give one mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    by_place = F.transform(F.array_sort(F.transform("found", lambda s: F.struct(*[s[n].alias(n) for n in ("start", "end", "kind")]))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    piece = lambda lo, hi: F.substr(text, (lo + 1).cast("int"), (hi - lo).cast("int"))

    def marked(s: Column) -> Column:
        kept = F.transform(s, lambda c, i: F.concat(piece(F.when(i > 0, F.get(s, F.greatest(i - 1, F.lit(0)))["end"]).otherwise(F.lit(0).cast("long")), c["start"]), F.get(names, c["kind"])))
        return F.concat(F.array_join(kept, ""), piece(F.element_at(s, -1)["end"], F.length(text).cast("long")))

    return found.withColumn(out, let(_merged(by_place), lambda s: F.when(F.size(s) > 0, marked(s)).otherwise(text)))
