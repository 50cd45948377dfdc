"""Benchmark decontamination with one Aho-Corasick automaton.

Windows of ``size`` consecutive words of the normalised benchmark texts (a shorter item is
one window) become the patterns of one automaton.  A document is normalised to its words
between single separators, scanned once whole, and every occurrence is mapped back through
the word ranges to byte spans of the original text.

The automaton goes to the executors as its patterns, so their size is checked: beyond
``max_pattern_bytes`` the items are split by hash into parts below it, each part is scanned
in turn, and the parts' marks are combined, with the same result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.llm.textbatch import Texts, over_texts, quoted

SEPARATOR = 32
MAX_PATTERN_BYTES = 32 << 20


def normaliser() -> bytes:
    """Byte map: A-Z to lower case, other ASCII besides digits and letters to the separator."""
    table = bytearray(range(256))
    for b in range(128):
        if 65 <= b <= 90:
            table[b] = b + 32
        elif not (48 <= b <= 57 or 97 <= b <= 122):
            table[b] = SEPARATOR
    return bytes(table)


def windows_of(text: str | None, size: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").translate(normaliser()).split(b" ")
    words = [w for w in words if w]
    if not words:
        return []
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


def _scanner(rows: list[tuple[str | None, str | None]], size: int, with_spans: bool):
    """Marks of a slice of texts against the windows of ``rows`` (item, text)."""
    owners: dict[bytes, set[str]] = {}
    for item, text in rows:
        for w in windows_of(text, size):
            owners.setdefault(w, set())
            if item is not None:
                owners[w].add(item)
    patterns = [(w, sorted(items)) for w, items in owners.items()]
    built: list = []

    def scan(texts: Texts) -> list:
        if not built:
            automaton = ahocorasick.Automaton()
            for k, (w, _) in enumerate(patterns):
                automaton.add_word(" " + w.decode("latin-1") + " ", k)
            if patterns:
                automaton.make_automaton()
            built.append(automaton)
        automaton, table = built[0], normaliser()
        n_words, n_hit, found, marks, spans = [], [], [], [], []
        for i in range(len(texts)):
            folded = texts.raw(i).translate(table)
            words = [w for w in folded.split(b" ") if w]
            n_words.append(len(words))
            hits = list(automaton.iter(" " + b" ".join(words).decode("latin-1") + " ")) if words and patterns else []
            if not hits:
                n_hit.append(0)
                found.append([])
                marks.append([])
                spans.append([])
                continue
            ends = np.cumsum(np.array([len(w) + 1 for w in words]))  # position of the separator after each word
            last = np.searchsorted(ends, np.array([e for e, _ in hits]))
            length = np.array([patterns[k][0].count(b" ") + 1 for _, k in hits])
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, last - length + 1, 1)
            np.add.at(cover, last + 1, -1)
            cover = np.cumsum(cover)[:-1] > 0
            runs = np.flatnonzero(np.diff(np.concatenate([[0], cover, [0]]))).reshape(-1, 2)
            n_hit.append(int(cover.sum()))
            found.append(sorted({x for _, k in hits for x in patterns[k][1]}))
            marks.append([{"first": int(a), "last": int(b) - 1} for a, b in runs])
            if with_spans:
                flags = np.frombuffer(folded, np.uint8) != SEPARATOR
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags, [0]]).astype(np.int8))).reshape(-1, 2)
                spans.append([{"start": int(edges[a][0]), "end": int(edges[b - 1][1])} for a, b in runs])
            else:
                spans.append([])
        mark = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return [
            pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, pa.list_(pa.string())),
            pa.array(marks, pa.list_(mark)), pa.array(spans, pa.list_(span)),
        ]

    return scan


FIELDS = [
    ("n_words", "long"), ("n_hit", "long"), ("items", "array<string>"),
    ("marks", "array<struct<first:long,last:long>>"), ("spans", "array<struct<start:long,end:long>>"),
]


def _merge_marks(a, b):
    """Union of two sorted lists of word ranges, as a list of disjoint ranges."""
    both = F.array_sort(F.concat(a, b))
    start = F.array().cast("array<struct<first:long,last:long>>")

    def step(acc, x):
        top = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] + 1 >= x["first"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(both, start, step)


def scan_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, with_spans: bool = True, passing: list[str] | None = None, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``items``, ``marks`` (word ranges) and ``spans`` (byte ranges of the text).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Defined cases: a null
    or wordless text has no words and no hit; an item without words has no window; a null item id
    still hits but is not listed; items with equal windows are all listed; repeated rows are
    scanned like others; empty tables give no hit or no row; columns named like the new ones are
    replaced by them.
    """
    items = benchmark.select(F.col(quoted(item_col)).cast("string").alias("item"), F.col(quoted(item_text_col)).cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] * size
    parts = max(1, -(-total // max_pattern_bytes))
    keep = docs.columns if passing is None else passing
    out = docs
    for p in range(parts):
        piece = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        rows = [(r["item"], r["text"]) for r in piece.collect()]  # below max_pattern_bytes by the split above
        if p == 0:
            out = over_texts(docs, text_col, FIELDS, _scanner(rows, size, with_spans), passing=None if parts > 1 else keep)
        else:
            earlier = out.withColumnsRenamed({"items": "__items", "marks": "__marks", "spans": "__spans"})
            out = over_texts(earlier, text_col, FIELDS, _scanner(rows, size, with_spans))
            shift = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("first"), x["end"].alias("last")))
            back = lambda c: F.transform(c, lambda x: F.struct(x["first"].alias("start"), x["last"].alias("end")))
            out = out.withColumns({
                "items": F.array_sort(F.array_union("items", "__items")),
                "marks": _merge_marks(F.col("marks"), F.col("__marks")),
                "spans": back(_merge_marks(shift(F.col("spans")), shift(F.col("__spans")))),
            }).drop("__items", "__marks", "__spans")
            out = out.withColumn("n_hit", F.aggregate("marks", F.lit(0).cast("long"), lambda acc, x: acc + x["last"] - x["first"] + 1))
    return out.select(*[quoted(c) for c in keep if c not in {n for n, _ in FIELDS}], *[n for n, _ in FIELDS])


def item_digest(items: str):
    """SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
