"""Near-duplicate documents by tensored MinHash.

Each document gets two small collections of ``m`` hashes (each hash concatenates
``per_hash`` minima).  A table's key is the pair (hash i of the first collection, hash j of
the second), so 2·m·per_hash minima serve m² tables of 2·per_hash minima each.  A pair of
Jaccard similarity s meets in some table with probability (1 − (1 − s^per_hash)^m)²; the
default (m = 10, per_hash = 2) gives 0.99993 at s = 0.8.

Copies are taken together first: documents with equal shingle sets (count and 128-bit
fingerprint) are one class, and only class representatives enter the tables.  Candidates are
confirmed on the full sets read from the whole texts.  No bucket is expanded into all pairs:

1. every member is compared with its bucket's leader, starting with the leader it shares most
   tables with; confirmed links are contracted to components,
2. buckets whose leader and member are still in different components are compared,
3. twice more every bucket that holds several components takes another leader, drawn anew for
   each table, for its members of other components,
4. what is left are buckets with several components still.  Their members of different components
   are paired by rare shingles: with the shingles of all open members in one order, rarest first,
   two sets of the similarity share one near the beginning of both, and few others do.  This is
   exact, so no pair that a bucket holds is lost, and no bucket is expanded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.components import components, stored
from pairlens.llm.textbatch import SLICE_BYTES, Texts, Words, mix, over_texts, quoted, release, slices, stream, text_bytes

LEADER_TURNS = 2

_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of every text's word shingles."""
    words = Words(texts)
    h, first = words.hashes, words.first
    n = len(h)
    if n >= size:
        rolled = h[:n - size + 1].copy()
        for k in range(1, size):
            rolled = mix(rolled * _M + h[k:n - size + 1 + k])
    else:
        rolled = np.empty(0, np.uint64)
    out = []
    for lo, hi in zip(first[:-1], first[1:]):
        count = hi - lo
        if count >= size:
            ordered = np.sort(rolled[lo:hi - size + 1])  # a few hundred values: quicker than np.unique, which hashes them first
            out.append(ordered[np.append(True, ordered[1:] != ordered[:-1])])
        elif count:
            whole = h[lo:lo + 1].copy()
            for k in range(lo + 1, hi):
                whole = mix(whole * _M + h[k:k + 1])
            out.append(mix(whole + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _signer(size: int, m: int, per_hash: int):
    n_minima = 2 * m * per_hash
    factors, shifts = stream(101, n_minima) | np.uint64(1), stream(202, n_minima)

    def sign(texts: Texts) -> list:
        sets = shingle_sets(texts, size)
        counts = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(counts)
        values = np.concatenate([sets[i] for i in full]) if len(full) else np.empty(0, np.uint64)
        at = np.concatenate([[0], np.cumsum(counts[full])[:-1]]).astype(np.int64)
        collections = np.zeros((2, len(sets), m), np.uint64)
        prints = np.zeros((2, len(sets)), np.uint64)
        if len(full):
            for c in range(2):
                for i in range(m):
                    acc = np.zeros(len(full), np.uint64)
                    for k in range(per_hash):
                        f = (c * m + i) * per_hash + k
                        acc = mix(acc * _M + np.minimum.reduceat(values * factors[f] + shifts[f], at))
                    collections[c, full, i] = acc
            prints[0, full] = np.add.reduceat(mix(values), at)
            prints[1, full] = np.add.reduceat(mix(values + _M), at)
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * m + 1, m, dtype=np.int32)), pa.array(collections[c].reshape(-1).view(np.int64)))
            for c in range(2)
        ]
        return [counts, prints[0].view(np.int64), prints[1].view(np.int64), *lists]

    return sign


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, m: int = 10, per_hash: int = 2) -> DataFrame:
    """``__id``, ``n`` (set size), two fingerprints of the set and two hash collections per row."""
    sent = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text"))
    fields = [("n", "long"), ("f1", "long"), ("f2", "long"), ("s1", "array<long>"), ("s2", "array<long>")]
    return over_texts(sent, "__text", fields, _signer(shingle, m, per_hash), passing=["__id"])


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose full shingle sets reach the similarity."""
    left = pairs.join(texts.select(F.col("__id").alias("a"), F.col("__text").alias("ta")), "a")
    both = left.join(texts.select(F.col("__id").alias("b"), F.col("__text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        batch = part = met = sets = None
        for batch in batches:
            for part, _ in slices(batch, "ta", SLICE_BYTES // 2):
                met = pa.chunked_array([part.column(x).cast(pa.large_string()).fill_null("") for x in ("ta", "tb")]).combine_chunks().dictionary_encode()
                sets = shingle_sets(text_bytes(met.dictionary), shingle)  # each distinct text once
                hit = []
                for i, j in met.indices.to_numpy().reshape(2, -1).T:
                    shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    union = len(sets[i]) + len(sets[j]) - shared
                    hit.append(shared > 0 and 100 * shared >= percent * union)
                keep = pa.array(hit, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])
        del batch, part, met, sets
        release()

    return both.mapInArrow(run, "a long, b long")


def _labelled(df: DataFrame, labels: DataFrame | None, of: str, to: str) -> DataFrame:
    if labels is None:
        return df.withColumn(to, F.col(of))
    named = labels.select(F.col("node").alias(of), F.col("component").alias("__c"))
    return df.join(named, of, "left").withColumn(to, F.coalesce("__c", of)).drop("__c")


def _near(n1: str, n2: str, percent: int) -> Column:
    """Set sizes that allow the similarity."""
    return (F.col(n1) * 100 >= F.col(n2) * percent) & (F.col(n2) * 100 >= F.col(n1) * percent)


def _open_rows(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with their component ``c1``."""
    rows = _labelled(buckets, labels, "rep", "c1")
    keys = rows.groupBy("key").agg((F.min("c1") < F.max("c1")).alias("several")).filter("several").select("key")
    return rows.join(keys, "key", "left_semi").select("key", "size", "rep", "n", "c1")


def _by_rare_shingles(texts: DataFrame, held: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``held`` members of different components whose sets may be similar enough.

    The first shingle that two sets share (in any common order) has all others they share behind it
    in both.  Of a set of n, paired with one no smaller, at least 2·percent·n / (100 + percent) are
    shared, of the larger one at least percent·n / 100; so the shared one is found in the
    beginnings that leave no more than that behind, and what follows it must suffice.
    """
    def sets_of(batch: Texts) -> list:
        sets = shingle_sets(batch, shingle)
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        prints = np.array([np.bitwise_xor.reduce(mix(v)) for v in sets], np.uint64)
        return [np.diff(ends), prints.view(np.int64), pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))).cast(pa.list_(pa.int64()))]

    open_texts = texts.join(held.select(F.col("rep").alias("__id"), "c1"), "__id")
    rows = over_texts(open_texts, "__text", [("n", "long"), ("set", "long"), ("h", "array<long>")], sets_of, passing=["__id", "c1"])
    rows = stored(rows.select(F.col("__id").alias("rep"), "c1", "n", "set", F.explode("h").alias("h")), "minhash-open")
    common = rows.groupBy("h").agg(F.count("*").alias("d")).filter("d > 1")
    place = F.row_number().over(W.partitionBy("rep", "set").orderBy(F.coalesce("d", F.lit(1)), "h"))
    begin = rows.join(common, "h", "left").withColumn("at", place).filter("d > 1")  # an unshared one only takes its place
    begin = stored(begin.filter(F.col("at") <= F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1).select("h", "rep", "c1", "n", "at"), "minhash-begin")
    small = begin.filter(F.col("at") <= F.col("n") - F.expr(f"(n * {2 * percent} + {99 + percent}) div {100 + percent}") + 1)
    small = small.select(*[F.col(c).alias(c + "2") for c in ("h", "rep", "c1", "n", "at")])
    met = (F.col("h") == F.col("h2")) & (F.struct("n2", "rep2") < F.struct("n", "rep")) & (F.col("c1") != F.col("c12")) & _near("n", "n2", percent)
    met = met & ((F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1) * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    pairs = begin.join(small, met)
    return pairs.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct()


def _stars(labels: DataFrame) -> DataFrame:
    """Components found so far as links to their smallest member."""
    return labels.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _order(column: str) -> Column:
    return F.xxhash64(F.col(column), F.lit(5))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, m: int = 10, per_hash: int = 2) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer words than
    ``shingle`` has its whole sequence as the only shingle.  Defined cases: a null, empty or
    wordless text has an empty set and is its own component; rows that share an id are one
    document (each row is returned, their sets are linked through the id); a null id cannot
    be linked and is kept with a null component; an empty table gives an empty result; other
    columns are ignored.
    """
    sigs = stored(signatures(docs, id_col, text_col, shingle, m, per_hash), "minhash-signatures")
    usable = sigs.filter("n > 0 AND __id IS NOT NULL")
    classes = stored(
        usable.groupBy("n", "f1", "f2").agg(
            F.min("__id").alias("rep"), F.count("*").alias("size"), F.first("s1").alias("s1"), F.first("s2").alias("s2")
        ),
        "minhash-classes",
    )
    members = usable.join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select(F.col("rep").alias("a"), F.col("__id").alias("b")).filter("a <> b")

    grid = classes.select("rep", "n", F.posexplode("s1").alias("i", "x"), "s2").select(
        "rep", "n", "i", "x", F.posexplode("s2").alias("j", "y")
    ).select(F.xxhash64("i", "x", "j", "y").alias("key"), "rep", "n")
    grid = grid.repartition("key")  # made and dealt once, for the leaders and for the rows that join them
    shared = grid.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(_order("rep").alias("o"), F.col("rep").alias("leader"), F.col("n").alias("ln"))).alias("lead")).filter("size > 1")
    buckets = stored(
        grid.join(shared.select("key", "size", "lead.leader", "lead.ln"), "key").select("key", "size", "rep", "n", "leader", "ln"), "minhash-buckets"
    )
    stars = buckets.filter("rep <> leader").filter(_near("n", "ln", percent)).groupBy("rep", "leader").agg(F.count("*").alias("tables"))
    stars = stored(stars, "minhash-stars")

    ids = buckets.select("rep").distinct()
    source = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text"))
    texts = stored(source.join(ids, F.col("__id") == F.col("rep"), "left_semi"), "minhash-texts")

    best = stars.groupBy("rep").agg(F.max_by("leader", F.struct("tables", "leader")).alias("leader"))
    links = stored(_confirmed(best.select(F.col("rep").alias("a"), F.col("leader").alias("b")), texts, shingle, percent), "minhash-links")
    labels = stored(components(links, "minhash-cc"), "minhash-labels")

    rest = stars.join(best, ["rep", "leader"], "left_anti")
    rest = _labelled(_labelled(rest, labels, "rep", "c1"), labels, "leader", "c2").filter("c1 <> c2")
    more = stored(_confirmed(rest.select(F.col("rep").alias("a"), F.col("leader").alias("b")), texts, shingle, percent), "minhash-links")
    labels = stored(components(_stars(labels).unionByName(more), "minhash-cc"), "minhash-labels")
    tried = stars.select(F.col("rep").alias("a"), F.col("leader").alias("b"))

    for turn in range(1, LEADER_TURNS + 1):  # linear rounds: every table takes a leader of its own each time
        opened = _open_rows(buckets, labels)
        leads = opened.groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key", F.lit(turn)).alias("o"), F.col("rep").alias("leader"), F.col("n").alias("ln"), F.col("c1").alias("lc"))).alias("lead"))
        fresh = opened.join(leads.select("key", "lead.leader", "lead.ln", "lead.lc"), "key").filter("c1 <> lc").filter(_near("n", "ln", percent))
        fresh = fresh.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()
        found = stored(_confirmed(fresh, texts, shingle, percent), "minhash-links")
        labels = stored(components(_stars(labels).unionByName(found), "minhash-cc"), "minhash-labels")

    held = _open_rows(buckets, labels).select("rep", "c1").distinct()
    across = _by_rare_shingles(texts, held, shingle, percent)
    both_ways = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = across.join(both_ways, ["a", "b"], "left_anti")
    last = stored(_confirmed(across, texts, shingle, percent), "minhash-links")

    final = stored(components(_stars(labels).unionByName(last).unionByName(members), "minhash-cc"), "minhash-labels")
    named = final.select(F.col("node").alias("__id"), F.col("component").alias("__c"))
    return sigs.select("__id", "n").join(named, "__id", "left").select(
        F.col("__id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("__c", "__id").alias("component_id"),
        F.coalesce(F.col("__id") == F.coalesce("__c", "__id"), F.lit(True)).alias("kept"),
    )
