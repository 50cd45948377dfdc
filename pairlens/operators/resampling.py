"""Item-level (node) bootstrap and what is derived from it.

Pairs share items, so items are resampled, not pairs: a draw takes n items with
replacement and weighs pair (i, j) by multiplicity(i) * multiplicity(j).  Draws are
counter-based (a hash of seed, draw and slot), identical for every group, and are
recomputed by the task that needs them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyarrow.dataset import dataset
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairlens.functions.common import null_safe_join, ratio
from pairlens.functions.stats import slope_intercept
from pairlens.operators.effects import CONTROL, PAIR, TEXT_ONLY, controllability_measures
from pairlens.operators.ordering import exact_quantiles, indexed_by_text
from pairlens.session import fresh_path

#: Multiplicities (2 bytes each) and weights (8 bytes each) that a task holds at a time.
CELLS, WEIGHTS = 48_000_000, 1_000_000


def item_index(items: DataFrame, item: str = "story_id") -> DataFrame:
    """Distinct items with their 0-based position in sorted order."""
    distinct = items.select(F.col(item).alias("story_id")).where("story_id IS NOT NULL").distinct()
    indexed = indexed_by_text(distinct, "story_id", "__i")
    return indexed.select("story_id", (F.col("__i") - 1).alias("idx"))


def items_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(*PAIR)).alias("story_id"))


_ROUNDS = [(int(abs(math.sin(i + 1)) * 2**32), turn) for i, turn in enumerate([7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4)]
_TAILS = np.char.zfill(np.arange(10_000).astype(str), 4).astype("S4").view(np.uint8).reshape(-1, 4)


def _md5_heads(opening: bytes) -> np.ndarray:
    """First 8 bytes of the MD5 of ``opening`` followed by 0000 ... 9999, as big-endian numbers.

    The messages are one block each (at most 51 bytes before the digits) and differ in one or two words,
    so the 64 rounds run over all of them at once.
    """
    size, first = len(opening) + 4, len(opening) // 4
    block = np.zeros(64, np.uint8)
    block[: len(opening)], block[size] = np.frombuffer(opening, np.uint8), 0x80
    block[56:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
    words = [int(w) for w in block.view("<u4")]
    near = np.tile(block[4 * first : 4 * first + 8], (len(_TAILS), 1))
    near[:, len(opening) % 4 : len(opening) % 4 + 4] = _TAILS
    varying = {first + k: np.ascontiguousarray(near.view("<u4")[:, k]) for k in range(2 if len(opening) % 4 else 1)}
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(len(_TAILS), x, np.uint32) for x in start)
    f, high = np.empty_like(a), np.empty_like(a)
    for i, (constant, turn) in enumerate(_ROUNDS):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if at in varying:
            f += varying[at]
            f += np.uint32(constant)
        else:
            f += np.uint32((words[at] + constant) & 0xFFFFFFFF)
        np.right_shift(f, np.uint32(32 - turn), out=high)
        f <<= np.uint32(turn)
        f |= high
        f += b
        a, d, c, b, f = d, c, b, f, a
    a += np.uint32(start[0])
    b += np.uint32(start[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def multiplicities(n_items: int, draws: range, seed: int) -> np.ndarray:
    """How often each of ``n_items`` was taken in each of ``draws``, as ``n_items`` x ``draws``.

    The numbers are those of :func:`pairlens.functions.common.counter_draw` for (seed, draw, slot).
    """
    low = [str(slot).encode() for slot in range(min(n_items, len(_TAILS)))]
    taken = np.zeros((n_items, len(draws)), dtype=np.uint16)
    for column, draw in enumerate(draws):
        opening = f"{seed}:{draw}:".encode()
        start, heads = hashlib.md5(opening), bytearray()
        for slot in low:
            digest = start.copy()
            digest.update(slot)
            heads += digest.digest()[:8]
        numbers = np.frombuffer(heads, dtype=">u8").astype(np.uint64)
        for leading in range(1, -(-n_items // len(_TAILS)) + 1):
            np.add.at(taken[:, column], ((numbers >> np.uint64(4)) % np.uint64(n_items)).astype(np.int64), np.uint16(1))
            numbers = _md5_heads(opening + str(leading).encode())[: max(0, n_items - leading * len(_TAILS))]
    return taken


def draws_per_slice(n_items: int, draws: int, partitions: int) -> int:
    """Draws that one task holds: within the cell bound, and enough slices to use all partitions."""
    return max(1, min(CELLS // n_items, draws // (4 * partitions)))


def resampled_sums(pairs: DataFrame, items: DataFrame, group: Sequence[str], terms: Mapping[str, Column], draws: int, seed: int) -> DataFrame:
    """Weighted sums of ``terms`` per (group, draw), draws without weight dropped.

    The draws are cut into slices; a task computes the multiplicities m of its slice from the counter
    hash, each once in the whole job, and adds up the quadratic form m(i) m(j) value over the pairs.  The
    pairs are written once to the shared work folder, in order of the group inside each file, and every
    slice streams them from there, so no pair is copied for a slice.  A slice holds at most :data:`CELLS`
    multiplicities (one draw if there are more items than that), whatever the number of draws, pairs and groups.
    """
    spark, index = pairs.sparkSession, item_index(items).persist()
    n_items = index.count()
    values = pairs.select(*group, *PAIR, *[c.cast("double").alias(n) for n, c in terms.items()])
    if n_items < 2:
        empty = values.limit(0).withColumns({"draw": F.lit(0).cast("bigint"), "w": F.lit(0.0)})
        return empty.select(*group, "draw", "w", *terms)
    place = F.col("idx").cast("int" if n_items < 1 << 31 else "long")
    first = index.select(F.col("story_id").alias("story_1_id"), place.alias("__i"))
    second = index.select(F.col("story_id").alias("story_2_id"), place.alias("__j"))
    located = values.join(first, "story_1_id").join(second, "story_2_id").select(*group, "__i", "__j", *terms)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_slice = draws_per_slice(n_items, draws, partitions)
    slices = -(-draws // per_slice)
    folder = fresh_path(spark, "located-pairs")
    located.sortWithinPartitions(*group).write.parquet(folder)
    keys, names = list(group), list(terms)
    fields = [located.schema[c] for c in keys] + [T.StructField("draw", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("w", *names)]
    made = to_arrow_schema(T.StructType(fields))

    def finished(key: tuple, draw_numbers: range, total: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([v] * len(draw_numbers), made.field(c).type) for c, v in zip(keys, key)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(draw_numbers), *map(pa.array, total)], schema=made)

    def of_file(file, draw_numbers: range, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in file.to_batches(batch_size=1 << 17, use_threads=False):
            if not batch.num_rows:
                continue
            codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy() for c in map(batch.column, keys)]
            new = np.ones(batch.num_rows, dtype=bool)
            if codes:
                new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
            else:
                new[1:] = False
            starts = np.flatnonzero(new)
            i, j = batch.column("__i").to_numpy(), batch.column("__j").to_numpy()
            data = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in names], dtype=float)
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows]):
                key = tuple(batch.column(c)[int(lo)].as_py() for c in keys)
                if total is None or key != held:
                    if total is not None:
                        yield finished(held, draw_numbers, total)
                    held, total = key, np.zeros((1 + len(names), len(draw_numbers)))
                step = max(1, WEIGHTS // len(draw_numbers))
                for cut in (slice(k, min(k + step, hi)) for k in range(lo, hi, step)):
                    weights = m[i[cut]].astype(float) * m[j[cut]]
                    total[0] += weights.sum(axis=0)
                    total[1:] += data[:, cut] @ weights
        if total is not None:
            yield finished(held, draw_numbers, total)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
        where, base = pa.fs.FileSystem.from_uri(uri) if ":" in uri else (pa.fs.LocalFileSystem(), uri)
        files = sorted(dataset(base, filesystem=where, format="parquet").get_fragments(), key=lambda f: f.path)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                draw_numbers = range(at * per_slice, min(draws, (at + 1) * per_slice))
                m = multiplicities(n_items, draw_numbers, seed)
                for file in files:
                    yield from of_file(file, draw_numbers, m)

    parts = spark.range(0, slices, numPartitions=min(slices, 4 * partitions)).mapInArrow(summed, T.StructType(fields))
    sums = parts.groupBy(*group, "draw").agg(*[F.sum(c).alias(c) for c in ("w", *names)])
    return sums.where("w > 0").select(*group, "draw", "w", *terms)


def resampled_means(
    pairs: DataFrame, items: DataFrame, group: Sequence[str], value: str, draws: int, seed: int
) -> DataFrame:
    """Weighted mean of a pair value per (group, draw)."""
    rows = pairs.where(F.col(value).isNotNull())
    sums = resampled_sums(rows, items, group, {"wv": F.col(value)}, draws, seed)
    return sums.select(*group, "draw", ratio(F.col("wv"), F.col("w")).alias("estimate"))


def weighted_pair_mean(pairs: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of a pair value; NULL when the weights sum to zero."""
    w = F.col(weight).cast("double")
    return pairs.groupBy(*group).agg(ratio(F.sum(w * F.col(value)), F.sum(w)).alias("weighted_mean"))


# -- intervals -----------------------------------------------------------------------------

# Tail percentages of the reported intervals.
LEVELS = {"ci_95_lo": 0.025, "ci_90_lo": 0.05, "ci_90_hi": 0.95, "ci_95_hi": 0.975}


def percentile_intervals(estimates: DataFrame, group: Sequence[str], value: str = "estimate") -> DataFrame:
    """Exact linear-interpolation percentiles over the draws of each group.

    A group has at most as many rows as there are draws.
    """
    cuts = F.percentile(F.col(value), F.array(*[F.lit(p) for p in LEVELS.values()]))
    result = estimates.groupBy(*group).agg(cuts.alias("__c"), F.count(value).alias("n_draws"))
    return result.select(*group, "n_draws", *[F.col("__c")[i].alias(n) for i, n in enumerate(LEVELS)])


def ate_intervals(
    pairs: DataFrame, items: DataFrame, group: Sequence[str], draws: int, seed: int
) -> DataFrame:
    """Interval of the average effect of each group."""
    return percentile_intervals(resampled_means(pairs, items, group, "d_pair", draws, seed), group)


def controllability_draws(
    pairs: DataFrame, items: DataFrame, group: Sequence[str], draws: int, seed: int
) -> DataFrame:
    """Derived measures per draw; both conditions share the resample."""
    keys = [*group, "instruction_condition"]
    means = resampled_means(pairs, items, keys, "d_pair", draws, seed)

    def under(condition: str) -> Column:
        return F.max(F.when(F.col("instruction_condition") == condition, F.col("estimate")))

    wide = means.groupBy(*group, "draw").agg(under(CONTROL).alias("ate_control"), under(TEXT_ONLY).alias("ate_text_only"))
    return controllability_measures(wide.where("ate_control IS NOT NULL AND ate_text_only IS NOT NULL"))


MEASURES = (
    "ate_control", "ate_text_only", "signed_instruction_difference", "magnitude_reduction", "residual_text_only_effect",
)


def controllability_intervals(draw_rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Intervals of every measure, one row per (group, measure)."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("estimate")) for m in MEASURES])
    long = draw_rows.select(*group, F.explode(entries).alias("e")).select(*group, "e.measure", "e.estimate")
    return percentile_intervals(long, [*group, "measure"])


def equivalence(draw_rows: DataFrame, group: Sequence[str], margin: float, frozen: bool) -> DataFrame:
    """Whether the whole 90 % interval of the text-only effect lies inside the margin.

    Without a frozen design there is no verdict.
    """
    intervals = percentile_intervals(draw_rows, group, "ate_text_only")
    inside = (F.col("ci_90_lo") >= -margin) & (F.col("ci_90_hi") <= margin)
    verdict = F.when(inside, "practically_invariant").when(~inside, "not_practically_invariant")
    return intervals.withColumns(
        {
            "equivalence_margin": F.lit(float(margin)),
            "verdict": verdict if frozen else F.lit(None).cast("string"),
            "study_frozen": F.lit(frozen),
        }
    )


# -- ambiguity regression ------------------------------------------------------------------


def ambiguity_fit(rows: DataFrame, group: Sequence[str], x: str = "baseline_strength", y: str = "d_pair") -> DataFrame:
    """Unweighted least squares of the effect on baseline strength; at least two pairs."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy(*group).agg(
        F.count("*").alias("n_pairs"), F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("beta"),
    )
    cuts = exact_quantiles(both, group, x, {f"__p{p}": p / 100 for p in (25, 50, 75)})
    placed = null_safe_join(fit.where("n_pairs >= 2 AND beta IS NOT NULL"), cuts, group)
    predicted = {f"predicted_at_p{p}": F.col("intercept") + F.col("beta") * F.col(f"__p{p}") for p in (25, 50, 75)}
    return placed.withColumns(predicted).drop("__p25", "__p50", "__p75")


def slope_draws(
    rows: DataFrame,
    items: DataFrame,
    group: Sequence[str],
    draws: int,
    seed: int,
    x: str = "baseline_strength",
    y: str = "d_pair",
) -> DataFrame:
    """Refitted slope per (group, draw).

    x is centred on its group mean first, so that the sums of squares do not cancel.
    """
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = both.groupBy(*group).agg(F.avg(x).alias("__mx"))
    centred = null_safe_join(both, means, group)
    cx, cy = F.col(x) - F.col("__mx"), F.col(y)
    terms = {"wx": cx, "wy": cy, "wxx": cx * cx, "wxy": cx * cy}
    sums = resampled_sums(centred, items, group, terms, draws, seed)
    slope, _ = slope_intercept(*[F.col(c) for c in ("w", "wx", "wy", "wxx", "wxy")])
    return sums.select(*group, "draw", slope.alias("estimate")).where("estimate IS NOT NULL")


def slope_intervals(rows: DataFrame, items: DataFrame, group: Sequence[str], draws: int, seed: int) -> DataFrame:
    return percentile_intervals(slope_draws(rows, items, group, draws, seed), group)
