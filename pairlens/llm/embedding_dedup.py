"""Near-duplicate vectors with an inverted multi-index.

Vectors are scaled to length one and cut in two halves, each with a codebook of its own
(k-means on a bounded sample); the pairs of codewords form a grid of cells per label.  A
query visits cells in the order of a lower bound on the distance to any vector in them
(multi-sequence traversal over the two sorted lists of half bounds) and stops when the bound
passes the radius that belongs to the wanted similarity.  A vector's half distance to the
bisector between its own codeword and another one bounds the distance to everything behind
it, so with ``recall=1.0`` no pair is missed; a lower target stops at the bound that this share of a
sample's linked pairs needs.  A pair is found if either side visits the other's cell, and counts
for both.  Candidates are verified in double precision.

Equal vectors are compared once and counted by multiplicity.  Cells are cut in blocks of
about ``block`` vectors and compared block by block with one matrix product; a block pair
returns link counts and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.components import components, stored
from pairlens.llm.textbatch import quoted

SAMPLE_ROWS = 20_000


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codewords of a sample; at most as many as distinct points."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1)
        for c in range(len(centres)):
            own = points[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return np.unique(centres, axis=0)


def half_bounds(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and a lower bound on the distance from the row to any point that is nearest to each other codeword."""
    d = np.maximum(((x[:, None, :] - codebook[None]) ** 2).sum(2), 0) if len(x) * codebook.size < 4e6 else np.maximum((x ** 2).sum(1)[:, None] + (codebook ** 2).sum(1) - 2 * x @ codebook.T, 0)
    own = np.argmin(d, axis=1)
    apart = np.sqrt(((codebook[:, None, :] - codebook[None]) ** 2).sum(2))[own]
    bound = (d - d[np.arange(len(x)), own][:, None]) / (2 * np.where(apart > 0, apart, 1))
    return own, np.maximum(bound, 0)


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) with first[i]² + second[j]² within ``limit``, nearest first."""
    import heapq

    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    u, v, a, b = (first[a] ** 2).tolist(), (second[b] ** 2).tolist(), a.tolist(), b.tolist()
    out, heap, seen = [], [(u[0] + v[0], 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        if cost > limit:
            break
        out.append((a[i], b[j]))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(a) and n[1] < len(b) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (u[n[0]] + v[n[1]], *n))
    return out


def _limit(sample: np.ndarray, one: np.ndarray, two: np.ndarray, threshold: float, recall: float) -> float:
    """Squared bound up to which cells are visited.

    With ``recall`` below 1: what this share of the linked pairs of a sample need, half as much
    again, and at least the bound that a pair just at the threshold passes only rarely (its offset,
    seen along one direction out of many, is small).  With 1: the whole radius.
    """
    radius, (n, width) = 2 - 2 * threshold + 1e-9, sample.shape
    if recall >= 1 or n < 2:
        return radius
    some, half = sample[:1000], one.shape[1]
    near = some @ sample[:4000].T >= threshold
    near[np.arange(len(some)), np.arange(len(some))] = False
    a, b = np.nonzero(near)
    (_, bi), (_, bj) = half_bounds(some[:, :half], one), half_bounds(some[:, half:], two)
    (i, _), (j, _) = half_bounds(sample[:4000, :half], one), half_bounds(sample[:4000, half:], two)
    needed = bi[a, i[b]] ** 2 + bj[a, j[b]] ** 2
    return min(radius, max(radius * 12 / width, 1.5 * float(np.quantile(needed, recall)) if len(a) else 0.0))


def _divided(vector: Column, by: Column) -> Column:
    """Every component over ``by``.  What a lambda holds is evaluated for each component, the repeated number once for the vector."""
    return F.zip_with(vector, F.array_repeat(by, F.size(vector)), lambda x, y: x / y)


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as rows."""
    return vectors.flatten().to_numpy().reshape(len(vectors), width)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.9999, codewords: int = 16, sample_rows: int = SAMPLE_ROWS, block: int = 256) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Defined cases: a vector that is null, empty, zero or holds a null or non-finite component, and a
    null label, link with nothing; vectors of different lengths link with nothing across lengths;
    equal vectors are linked; rows that share an id are one vertex and each of them is returned, with
    the links of all; a null id is kept with a null component; an empty table gives an empty result;
    other columns are ignored.
    """
    rows = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("v"), F.col(quoted(label_col)).cast("string").alias("label"))
    scale = F.greatest(F.array_max("v"), -F.array_min("v"))  # NaN, which is beyond all numbers, if any component is
    fine = ~F.coalesce(F.exists("v", F.isnull), F.lit(True)) & (scale > 0) & (scale < float("inf"))
    # dividing by the largest component first keeps squares from running over or under
    usable = rows.filter("label IS NOT NULL AND id IS NOT NULL").filter(fine).withColumn("v", _divided(F.col("v"), scale))
    usable = usable.withColumn("v", _divided(F.col("v"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))
    usable = usable.withColumn("label", F.concat_ws(":", F.size("v"), "label"))
    tagged = stored(usable.withColumn("hash", F.xxhash64("label", "v")), "vectors")  # equal vectors are sorted by it
    reps = tagged.groupBy("hash", "label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))

    picked = tagged.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).toPandas()  # the documented bound
    books: dict[int, tuple] = {}
    for size, group in picked.groupby(picked.v.map(len)):
        data = np.stack([np.asarray(x, np.float64) for x in group.v])
        half = (size + 1) // 2
        one, two = kmeans(data[:, :half], codewords), kmeans(data[:, half:], codewords) if size > 1 else np.zeros((1, 0))
        books[int(size)] = (one, two, _limit(data, one, two, threshold, recall))

    def place(batches):
        for batch in batches:
            vectors = batch.column("v")
            own, probes = [None] * len(vectors), [None] * len(vectors)
            lengths = vectors.value_lengths().to_numpy()
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                data = _matrix(vectors.take(pa.array(at)), size)
                half = (size + 1) // 2
                one, two, limit = books.get(int(size), (np.zeros((1, half)), np.zeros((1, size - half)), 1.0))
                (i, bi), (j, bj) = half_bounds(data[:, :half], one), half_bounds(data[:, half:], two)
                for k, row in enumerate(at):
                    own[row] = int(i[k]) * len(two) + int(j[k])
                    probes[row] = [a * len(two) + b for a, b in multi_sequence(bi[k], bj[k], limit)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(probes, pa.list_(pa.int64()))], names=[*batch.schema.names, "own", "probes"])

    placed = stored(reps.mapInArrow(place, "hash long, label string, v array<double>, rep long, mult long, own long, probes array<long>"), "vector-cells")
    asked = placed.select("label", F.explode("probes").alias("cell"), "rep", "mult", "v")
    stocked = placed.select("label", F.col("own").alias("cell"), "rep", "mult", "v")
    loads = asked.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).alias("loads"))
    sizes = stocked.groupBy("label", "cell").agg(F.ceil(F.count("*") / block).alias("blocks")).join(loads, ["label", "cell"])
    stocked = stocked.join(sizes, ["label", "cell"]).withColumn("bin", F.pmod(F.xxhash64("rep"), "blocks"))
    shelf = stocked.groupBy("label", "cell", "bin").agg(F.collect_list(F.struct("rep", "mult", "v")).alias("theirs"))
    asked = asked.join(sizes, ["label", "cell"]).withColumn("load", F.pmod(F.xxhash64("rep"), "loads"))
    queries = asked.groupBy("label", "cell", "load").agg(F.collect_list(F.struct("rep", "mult", "v")).alias("ours"))
    meeting = queries.join(shelf, ["label", "cell"]).select("ours", "theirs")

    def compare(batches):
        for batch in batches:
            node, count, other = [], [], []
            for ours, theirs in zip(batch.column("ours"), batch.column("theirs")):
                ours, theirs = ours.values, theirs.values
                qi, ti = ours.field("rep").to_numpy(), theirs.field("rep").to_numpy()
                width = len(ours.field("v")[0])  # the same for all vectors of a label
                q, t = _matrix(ours.field("v"), width), _matrix(theirs.field("v"), width)
                a, b = np.nonzero(q @ t.T >= threshold)
                apart = qi[a] != ti[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                links = np.bincount(a, theirs.field("mult").to_numpy()[b], len(qi)).astype(np.int64)
                half = (width + 1) // 2
                one, two, limit = books.get(width, (np.zeros((1, half)), np.zeros((1, width - half)), 1.0))
                hit, of = np.unique(b, return_inverse=True)
                (i, _), (j, _) = half_bounds(q[:, :half], one), half_bounds(q[:, half:], two)
                (_, bi), (_, bj) = half_bounds(t[hit, :half], one), half_bounds(t[hit, half:], two)
                unasked = bi[of, i[a]] ** 2 + bj[of, j[a]] ** 2 > limit  # the other side does not visit our cell
                theirs_too = np.bincount(b[unasked], ours.field("mult").to_numpy()[a[unasked]], len(ti)).astype(np.int64)
                # the smallest id reachable within the two blocks stands for a spanning forest
                row, column = qi.copy(), ti.copy()
                while True:
                    new_row, new_column = row.copy(), column.copy()
                    np.minimum.at(new_row, a, column[b])
                    np.minimum.at(new_column, b, new_row[a])
                    if (new_row == row).all() and (new_column == column).all():
                        break
                    row, column = new_row, new_column
                for ids, least, n in ((qi, row, links), (ti, column, theirs_too)):
                    for k in np.flatnonzero(least < ids):
                        node.append(int(ids[k]))
                        count.append(0)
                        other.append(int(least[k]))
                    for k in np.flatnonzero(n):
                        node.append(int(ids[k]))
                        count.append(int(n[k]))
                        other.append(None)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "links": pa.array(count, pa.int64()), "other": pa.array(other, pa.int64())})

    found = stored(meeting.mapInArrow(compare, "node long, links long, other long"), "vector-links")
    outside = found.filter("other IS NULL").groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("outside"))
    members = stored(tagged.join(placed.select("hash", "label", "v", "rep", "mult"), ["hash", "label", "v"]).select("id", "rep", "mult"), "vector-members")
    edges = found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(members.select(F.col("rep").alias("a"), F.col("id").alias("b")).filter("a <> b"))
    named = components(edges, "vector-cc").select(F.col("node").alias("id"), F.col("component").alias("c"))
    counted = members.join(outside, "rep", "left").groupBy("id").agg(F.max(F.coalesce("outside", F.lit(0)) + F.col("mult") - 1).alias("n"))
    return rows.select("id").join(counted, "id", "left").join(named, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("c", "id"), F.lit(True)).alias("kept"),
    )
