"""Prefix trie of conversations with subtree sums by centroid decomposition.

Turns are reduced to two 64-bit hashes and their length, texts move no further.  A prefix is
known by its depth and the exclusive or of the hashes of its turns, each salted with its place;
the smallest conversation below a node and the node's depth name it.

A conversation that is the smallest of a node is so for all deeper nodes of its path, and nodes on
one path with equally many members have the same members.  So runs of such nodes are one segment,
and the segments form a tree with at most two of them for each place where a conversation ends.
Its sums come from recursive splitting: in every component the deepest segment with half of the
component's conversations below it, the centroid, is taken out; the totals of the centroid and the
components below it are added to the segments on the way from it to the component's top.  A round
halves the conversations of every component, whatever the depth of the trie, and is one written table.
Components of at most ``block`` segments end in one step, each summed from the bottom up in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlens.llm.components import stored
from pairlens.llm.textbatch import quoted
from pairlens.operators.ordering import numbered

#: Segments of a component that one task sums.
BLOCK = 256
#: Binary digits of a turn's number (or place, or conversation id) inside a bucket.
TURN_BITS, ID_BITS = 12, 10
KEY = ["d", "pa", "pb"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_codes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``pos`` (1-based by turn, null first; equal turns by their hashes), ``ha``, ``hb``, ``chars`` of every turn.

    Rows without a conversation are left out; a null role or text is empty.
    """
    said = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role_col, text_col)]
    coded = turns.select(
        F.col(quoted(conv_col)).cast("long").alias("conv"), F.col(quoted(turn_col)).cast("long").alias("turn"), F.xxhash64(*said).alias("ha"),
        F.xxhash64(F.lit(17), *said).alias("hb"), F.length(said[1]).cast("long").alias("chars"),
    ).filter("conv IS NOT NULL")
    bucket = F.coalesce(F.shiftright("turn", TURN_BITS), F.lit(-(1 << 62)))
    order = [F.col("turn").asc_nulls_first(), "ha", "hb"]
    return numbered(stored(coded, "trie-turns"), ["conv"], order, bucket, "pos", keys_not_null=True).drop("turn")


def with_shared_heads(codes: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the head of another one: (turns ``conv``, ``d``, ``ha``, ``hb``, ``chars``; ids ``conv``).

    The first h turns of c are those of c - c % ``every``, h = crc32(c) % ``most``; its own follow after its first h.
    """
    codes = stored(codes, "trie-codes")
    own_head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).cast("long")
    convs = codes.filter("pos = 1").select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), own_head.alias("h"))
    heads = codes.filter((F.col("conv") % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    taken = convs.join(heads, "base").filter("pos <= h").select("conv", F.col("pos").alias("d"), "ha", "hb", "chars")
    size = heads.groupBy("base").agg(F.max("pos").alias("there"))
    shift = convs.join(size, "base", "left").select("conv", (F.least(F.coalesce("there", F.lit(0)), "h") - F.col("h")).alias("shift"))
    tails = codes.filter(F.col("pos") > own_head).join(shift, "conv").select("conv", (F.col("pos") + F.col("shift")).alias("d"), "ha", "hb", "chars")
    return taken.unionByName(tails), convs.select("conv")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation: ``conv``, ``d``, its hashes and those before the last turn, ``chars``, ``cum``."""
    salted = turns.withColumns({"xa": F.xxhash64("d", "ha", "hb"), "xb": F.xxhash64("hb", "ha", "d"), "block": F.shiftright("d", TURN_BITS)})
    upto = W.partitionBy("conv", "block").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    inside = salted.withColumns({"pa": F.bit_xor("xa").over(upto), "pb": F.bit_xor("xb").over(upto), "cum": F.sum("chars").over(upto)})
    totals = salted.groupBy("conv", "block").agg(F.bit_xor("xa").alias("ta"), F.bit_xor("xb").alias("tb"), F.sum("chars").alias("tc"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # only conversations of several blocks have an offset
    offsets = totals.select("conv", "block", F.bit_xor("ta").over(before).alias("oa"), F.bit_xor("tb").over(before).alias("ob"), F.sum("tc").over(before).alias("oc")).filter("oc IS NOT NULL")
    whole = inside.join(offsets, ["conv", "block"], "left")
    xor = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")) if isinstance(b, Column) else F.col(b))
    whole = whole.withColumns({"pa": xor("pa", F.col("oa")), "pb": xor("pb", F.col("ob")), "cum": F.col("cum") + F.coalesce("oc", F.lit(0))})
    return whole.select("conv", *KEY, xor("pa", "xa").alias("qa"), xor("pb", "xb").alias("qb"), "chars", "cum")


def _digests(last: DataFrame) -> DataFrame:
    """``ends_sha256`` per node key of ``last`` (``conv`` and the key of its whole sequence).

    Ids are joined in short ranges of ids; one open hash then runs over a node's ranges in order, so the
    members of a node are never held together.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    ranges = last.groupBy(*KEY, F.shiftright("conv", ID_BITS).alias("range")).agg(ids.alias("ids"))
    ordered = ranges.repartition(*KEY).sortWithinPartitions(*KEY, "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in [*KEY, "ids"]]
            for *at, part in zip(*columns):
                if at != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = at, hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names=[*KEY, "ends_sha256"])

    return ordered.mapInArrow(run, "d long, pa long, pb long, ends_sha256 string")


def _sum_blocks(rows: DataFrame) -> DataFrame:
    """Subtree sums inside small components ``(tc, td)``: each is whole in one task, parents before children."""
    ordered = rows.select("tc", "td", "c", "sd", "pc", "pd", "leaves", "saved").repartition("tc", "td").sortWithinPartitions("tc", "td", "sd", "c")

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        at = {(r[2], r[3]): i for i, r in enumerate(rows)}
        leaves, saved = [r[6] for r in rows], [r[7] for r in rows]
        for i in range(len(rows) - 1, 0, -1):
            up = at.get((rows[i][4], rows[i][5])) if (rows[i][2], rows[i][3]) != (rows[i][0], rows[i][1]) else None
            if up is not None:
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        return pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array(leaves), pa.array(saved)], names=["c", "sd", "leaves", "saved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the component still open, at most a block
        for batch in batches:
            rows = held + list(zip(*(c.to_pylist() for c in batch.columns)))
            cut = len(rows)
            while cut and rows[cut - 1][:2] == rows[-1][:2]:
                cut -= 1
            if cut:
                yield summed(rows[:cut])
            held = rows[cut:]
        if held:
            yield summed(held)

    return ordered.mapInArrow(run, "c long, sd long, leaves long, saved long")


def _rollup(segments: DataFrame, paths: DataFrame, block: int) -> DataFrame:
    """``c``, ``sd``, ``leaves``, ``saved``: subtree sums of the segments by centroid decomposition.

    ``segments`` has a top segment's depth ``sd``, parent, component top ``(tc, td)``, weight ``w`` (members) and own
    values; ``paths`` the segments ``(sc, sd)`` on the way to each conversation ``conv`` with the next one ``(nc, nd)``.
    """
    state, added = stored(segments, "trie-state"), []
    while True:
        sizes = state.groupBy("tc", "td").agg(F.count("*").alias("size"), F.max("w").alias("whole"))
        marked = stored(state.join(sizes, ["tc", "td"]), "trie-marked")
        added.append(stored(_sum_blocks(marked.filter(F.col("size") <= block)), "trie-added"))
        split = marked.filter(F.col("size") > block)
        if split.isEmpty():
            break
        # deepest segment with half of the members below it, of those the smallest
        best = F.max_by(F.struct("c", "sd", "w"), F.struct("sd", -F.col("c")))
        centres = split.filter("2 * w >= whole").groupBy("tc", "td").agg(best.alias("x")).select("tc", "td", F.col("x.c").alias("xc"), F.col("x.sd").alias("xd"), F.col("x.w").alias("xw"))
        met = split.drop("size", "whole").join(stored(centres, "trie-centres"), ["tc", "td"])
        below = paths.select(F.col("conv").alias("c"), F.col("sc").alias("xc"), F.col("sd").alias("xd"), "nc", "nd")
        at_centre = (F.col("c") == F.col("xc")) & (F.col("sd") == F.col("xd"))
        sides = met.join(below, ["c", "xc", "xd"], "left").withColumn("side", F.when(at_centre, 0).when(F.col("nc").isNotNull() & (F.col("sd") > F.col("xd")), 1).otherwise(2))
        sides = stored(sides, "trie-sides")
        gained = sides.filter("side < 2").groupBy("tc", "td", "xc", "xd", "xw").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        gained = stored(gained, "trie-gained")
        way = gained.join(paths.select(F.col("conv").alias("xc"), F.col("sc").alias("c"), "sd"), "xc").filter("sd >= td AND sd < xd")
        way = stored(way.select("c", "sd", "leaves", "saved", "xw"), "trie-way")
        added += [gained.select(F.col("xc").alias("c"), F.col("xd").alias("sd"), "leaves", "saved"), way.select("c", "sd", "leaves", "saved")]
        keep = ["c", "sd", "pc", "pd", "leaves", "saved"]
        under = sides.filter("side = 1").select(*keep, F.col("nc").alias("tc"), F.col("nd").alias("td"), "w")
        lighter = way.select("c", "sd", F.col("xw").alias("less"))  # a segment is on one way at most
        over = sides.filter("side = 2").select(*keep, "tc", "td", "w").join(lighter, ["c", "sd"], "left")
        over = over.withColumn("w", F.col("w") - F.coalesce("less", F.lit(0))).drop("less")
        state = stored(under.unionByName(over), "trie-state")
    return reduce(DataFrame.unionByName, added).groupBy("c", "sd").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``turns`` has coded turns (``conv``, place ``d`` from 1, ``ha``, ``hb``, ``chars``), ``convs`` every conversation, those
    without turns too.  ``saved_tokens`` sums (members - 1) times the length of a node's turn over its subtree.
    Defined cases: conversations without turns end at the root; equal conversations share all nodes and are
    one leaf; a null role or text equals an empty one; turns with one number are ordered by their content;
    without any conversation there is no root and the result is empty; other columns are ignored.
    """
    prefixes = stored(_prefixes(turns), "trie-prefixes")
    convs = stored(convs, "trie-convs")
    root = convs.agg(F.min("conv").alias("c"), F.count("*").alias("n")).first()
    zero = [F.lit(0).cast("long").alias(k) for k in (*KEY, "qa", "qb", "chars", "cum")]
    top = convs.agg(F.min("conv").alias("c"), F.count("*").alias("n")).filter("n > 0").select(*zero, "c", "n")
    kept = [F.max(x).alias(x) for x in ("qa", "qb", "chars", "cum")]
    nodes = stored(prefixes.groupBy(*KEY).agg(*kept, F.min("conv").alias("c"), F.count("*").alias("n")).unionByName(top), "trie-bare")
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("qa").alias("pa"), F.col("qb").alias("pb")).agg(F.count("*").alias("n_children"))
    ending = F.max_by(F.struct("d", "pa", "pb"), "d")
    last = convs.join(prefixes.groupBy("conv").agg(ending.alias("e")), "conv", "left").select("conv", *[F.coalesce(F.col(f"e.{k}"), F.lit(0).cast("long")).alias(k) for k in KEY])
    full = nodes.join(children, KEY, "left").join(_digests(last), KEY, "left")
    full = full.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))})
    nodes = stored(full.drop("qa", "qb"), "trie-nodes")
    # the segments on the path of every conversation that is the smallest of some node
    owners = stored(nodes.select(F.col("c").alias("conv")).distinct(), "trie-owners")
    named = nodes.select(*KEY, F.col("c").alias("sc"), "n")
    walked = prefixes.join(owners, "conv", "left_semi").select("conv", *KEY).join(named, KEY).select("conv", "d", "sc", "n")
    walked = walked.unionByName(owners.select("conv", F.lit(0).cast("long").alias("d"), F.lit(root["c"]).cast("long").alias("sc"), F.lit(root["n"]).cast("long").alias("n")))
    along = W.partitionBy("conv").orderBy("sd")
    runs = walked.groupBy("conv", "sc", "n").agg(F.min("d").alias("sd"))
    paths = runs.select(
        "conv", "sc", "sd", "n", F.lead("sc").over(along).alias("nc"), F.lead("sd").over(along).alias("nd"), F.lag("sc").over(along).alias("pc"), F.lag("sd").over(along).alias("pd")
    )
    paths = stored(paths, "trie-paths")
    spans = nodes.groupBy("c", "n").agg(
        F.min(F.col("cum") - F.col("chars")).alias("cum_top"), F.max("cum").alias("cum_end"), F.max_by("n_children", "d").alias("kids"),
    )
    own = paths.filter("conv = sc").select(F.col("sc").alias("c"), "n", "sd", "pc", "pd")
    segments = stored(spans.join(own, ["c", "n"]), "trie-segments")
    values = segments.select(
        "c", "sd", "pc", "pd", F.lit(root["c"]).cast("long").alias("tc"), F.lit(0).cast("long").alias("td"), F.col("n").alias("w"),
        F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("cum_end") - F.col("cum_top"))).alias("saved"),
    )
    sums = _rollup(values, paths.select("conv", "sc", "sd", "nc", "nd"), block)
    held = segments.join(sums, ["c", "sd"]).select("c", "n", "sd", "pc", "cum_top", "leaves", "saved")
    above = (F.col("n") - 1) * (F.col("cum") - F.col("chars") - F.col("cum_top"))
    return nodes.join(held, ["c", "n"]).select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == 0, None).when(F.col("d") > F.col("sd"), F.col("c")).otherwise(F.col("pc")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - above).alias("saved_tokens"), "ends_sha256",
    )
