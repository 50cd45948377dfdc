"""Alignment of two tokenizers: a byte-level BPE vocabulary (A) and a piece model with byte fallback (B).

Both encode a space and the text.  The spans that the libraries report (character offsets of
A, byte spans of B's pieces) are coarse cuts; where a cut falls inside a character or a run of
fallback bytes, the tokens' decoded bytes give the ends.  Byte offsets where tokens of both
sides end cut the tokens into groups, and the two tokens ending there are a link.

Texts are cut at single spaces between characters that are surely no white space.  Neither
side has a token across such a place (A's pattern and B's pieces exclude it, checked when B is
loaded), so each distinct word is encoded and aligned once and a text is put together from its words.

A link's shorter token is a byte suffix of the longer one, so there are at most as many different
pairs as both vocabularies have suffixes that are tokens, about the sum of all token lengths
(:func:`pair_bound`); the table of corpus counts is held to that bound before it goes to all tasks.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
from collections.abc import Iterator
from itertools import chain, compress
from operator import attrgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pairlens.llm.components import stored
from pairlens.llm.textbatch import Texts, quoted, slices

SLICE = 1 << 20
#: Distinct words a task remembers between slices; beyond it the memory starts anew.
REMEMBERED = 400_000
#: New words aligned at a time.
ALIGNED = 8_000
SPACE = "▁"
PIECE = attrgetter("id", "begin", "end")

FIELDS = [("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("n_links", "long"), ("groups_sha256", "string")]
COUNTED = [("n_best", "long"), ("count_sum", "long")]


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Bytes of every token id of one side, back to back."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.data[np.arange(size.sum()) + np.repeat(self.start[ids] - before, size)]


def tokens_of_a(path: str) -> list[bytes]:
    tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
    return [bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode() for token in (tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size()))]


def tokens_of_b(path: str) -> list[bytes]:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if is_byte else p.replace(SPACE, " ").encode() for p, is_byte in pieces]


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """Most pairs of an A and a B token of which one is a byte suffix of the other."""
    from collections import Counter

    in_a, in_b = Counter(a), Counter(b)
    of = lambda own, other: sum(other[t[i:]] for t in own for i in range(len(t)))
    return of(a, in_b) + of(b, in_a)


class WordAligner:
    """Aligned words by number; remembers each distinct word until there are :data:`REMEMBERED`."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a_model = Tokenizer.from_file(a_path)
        self.a_model.encode_special_tokens = True
        self.b_model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        b = tokens_of_b(b_path)
        self.a, self.b = Vocabulary(tokens_of_a(a_path)), Vocabulary(b)
        # a piece with a space behind another character could reach over a cut, then nothing is cut
        self.cuttable = not any(b" " in t.lstrip(b" ") for t in b)
        self.strings = [f"{i}{mark}" for side, marks in ((self.a, ",|"), (self.b, ",;")) for mark in marks for i in range(len(side.size))]
        self.space = np.zeros(256, bool)
        self.space[32] = True
        self.plain = np.ones(256, bool)
        self.plain[:33] = self.plain[127:] = False
        self.behind = self.plain.copy()
        self.behind[0xC3:0xE0] = True  # first bytes that no white space has
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.n_a = self.n_b = self.n_links = np.empty(0, np.int64)
        self.good = np.empty(0, bool)
        self.shown = np.empty(0, object)
        self.keys, self.key_start = np.empty(0, np.int64), np.zeros(1, np.int64)
        self.fresh: list[tuple] = []

    def _settle(self) -> None:
        """Append what was aligned since the last time."""
        if not self.fresh:
            return
        n_a, n_b, n_links, good, shown, keys = (np.concatenate(x) for x in zip(*self.fresh))
        self.n_a, self.n_b = np.append(self.n_a, n_a), np.append(self.n_b, n_b)
        self.n_links, self.good = np.append(self.n_links, n_links), np.append(self.good, good)
        self.shown, self.keys = np.append(self.shown, shown), np.append(self.keys, keys)
        self.key_start = np.append(self.key_start, self.key_start[-1] + np.cumsum(n_links))
        self.fresh = []

    def words(self, texts: Texts) -> tuple[pa.Array, np.ndarray]:
        """Words of a slice in order, and how many words lie before each text's end."""
        d = texts.data
        filled = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        cut = np.zeros(len(d), bool)
        if self.cuttable and len(d) > 2:
            before = self.plain[d]
            before[1:] |= (d[:-1] >= 0xC3) & (d[:-1] < 0xE0) & (d[1:] >= 0x80)  # second byte of a two-byte character
            cut[1:-1] = self.space[d[1:-1]] & before[:-2] & self.behind[d[2:]]
            edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(d))]
            cut[edges] = cut[edges - 1] = False
        at = np.flatnonzero(cut)
        begins = np.sort(np.concatenate([filled, at]))
        gone = np.searchsorted(at, begins)  # spaces cut out before a word
        offsets = np.append(begins - gone, len(d) - len(at)).astype(np.int64)
        data = pa.py_buffer(np.ascontiguousarray(d[~cut]))
        return pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), data]), np.searchsorted(begins, texts.offsets)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of every word, after those not seen before have been aligned."""
        coded = words.dictionary_encode()
        held = coded.dictionary
        offsets = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8).tolist()
        raw = memoryview(held.buffers()[2]) if held.buffers()[2] else b""
        distinct = [bytes(raw[lo:hi]) for lo, hi in zip(offsets, offsets[1:])]
        if len(self.number) > REMEMBERED:
            self._forget()
        new = [w for w in distinct if w not in self.number]
        for lo in range(0, len(new), ALIGNED):
            self._align(new[lo:lo + ALIGNED])
        self._settle()
        of = np.array([self.number[w] for w in distinct], np.int64)
        return of[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)

    @staticmethod
    def _ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray, first: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ends of tokens from their coarse spans, and which tokens contradict them.

        A coarse cut holds where a span ends and the next one begins no earlier; the tokens between two
        such cuts share a character or a run of bytes, and their decoded sizes place them in it.
        """
        n = len(begin)
        last = np.append(first[1:], n) - 1  # last token of each word
        held = np.zeros(n, bool)
        held[:-1] = (end[:-1] <= begin[1:]) & (end[:-1] > begin[:-1]) & (end[1:] > begin[1:])
        held[last[last >= 0]] = True
        opens = np.zeros(n, np.int64)
        opens[1:] = np.where(held[:-1], np.arange(1, n), 0)
        opens[first[first < n]] = first[first < n]
        opens = np.maximum.accumulate(opens)
        at = np.where(np.isin(opens, first), base, end[opens - 1])
        total = np.cumsum(size)
        refined = at + total - (total[opens] - size[opens])
        return refined, held & (refined != end)

    def _joinable(self, words: list[bytes]) -> np.ndarray:
        """Words that stand between cuts wherever they are put: what comes before a cut ends them, what comes behind one begins them."""
        if not self.cuttable or not words:
            return np.zeros(len(words), bool)
        data = np.frombuffer(b"".join(b" " + w for w in words), np.uint8)
        size = np.array([len(w) + 1 for w in words], np.int64)
        end = np.cumsum(size)
        last, before = data[end - 1], data[end - 2]
        two = (before >= 0xC3) & (before < 0xE0) & (last >= 0x80)
        return (size > 1) & self.behind[data[np.minimum(end - size + 1, len(data) - 1)]] & (self.plain[last] | two)

    def _align(self, words: list[bytes]) -> None:
        joinable = self._joinable(words)
        left = self._add([w for w, yes in zip(words, joinable) if yes], True)
        self._add([w for w, yes in zip(words, joinable) if not yes] + left, False)

    def _add(self, words: list[bytes], joined: bool) -> list[bytes]:
        """Align words, each alone or ``joined`` as one text; returns those of a joined text that have to be aligned alone."""
        if not words:
            return []
        whole = b"".join(b" " + w for w in words)
        data = np.frombuffer(whole, np.uint8)
        size = np.array([len(w) + 1 for w in words], np.int64)
        base = np.cumsum(size) - size
        texts, text_base = ([whole[1:].decode()], base[:1]) if joined else ([w.decode() for w in words], base)
        # A: character offsets, turned into byte offsets by the characters' first bytes
        made = self.a_model.encode_batch([" " + t for t in texts], add_special_tokens=False)
        a_n = np.array([len(e) for e in made], np.int64)
        a_ids = np.fromiter(chain.from_iterable(e.ids for e in made), np.int64, a_n.sum())
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in made)), np.int64, 2 * a_n.sum())
        leads = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        char_base = np.repeat(np.searchsorted(leads, text_base), a_n)
        a_begin, a_end = leads[char_base + spans[0::2]], leads[char_base + spans[1::2]]
        # B: byte spans, which leave out the space put before the text
        protos = self.b_model.encode(texts, return_type="proto", num_threads=1)
        b_n = np.array([len(p.pieces) for p in protos], np.int64)
        flat = np.fromiter(chain.from_iterable(map(PIECE, chain.from_iterable(p.pieces for p in protos))), np.int64, 3 * b_n.sum())
        b_ids, b_base = flat[0::3], np.repeat(text_base, b_n)
        b_begin, b_end = b_base + 1 + flat[1::3], b_base + 1 + flat[2::3]
        b_first = np.cumsum(b_n) - b_n
        b_begin[b_first[b_n > 0]] -= 1
        if joined:
            a_of, b_of = (np.searchsorted(base, begin, "right") - 1 for begin in (a_begin, b_begin))
            if (np.diff(a_of) < 0).any() or (np.diff(b_of) < 0).any():
                return words
            a_n, b_n = (np.bincount(of, minlength=len(words)) for of in (a_of, b_of))
        good = np.ones(len(words), bool)
        ends = []
        for side, ids, n, begin, end in ((self.a, a_ids, a_n, a_begin, a_end), (self.b, b_ids, b_n, b_begin, b_end)):
            of = np.repeat(np.arange(len(words)), n)
            same = np.bincount(of, side.size[ids], len(words)).astype(np.int64) == size
            spelled = side.spelled(ids[same[of]])
            wrong = spelled != data[np.repeat(same, size)]
            same[np.repeat(np.arange(len(words))[same], size[same])[wrong]] = False
            first = np.cumsum(n) - n
            refined, off = self._ends(begin, end, side.size[ids], first[n > 0], base[of])
            same[of[off]] = False
            good &= same
            ends.append((refined, of))
        (a_ends, a_of), (b_ends, b_of) = ends
        a_in, b_in = good[a_of], good[b_of]
        common = np.intersect1d(a_ends[a_in], b_ends[b_in], assume_unique=True)
        a_last, b_last = a_in & np.isin(a_ends, common), b_in & np.isin(b_ends, common)
        keys = a_ids[a_last] * len(self.b.size) + b_ids[b_last]
        n_links = np.bincount(a_of[a_last], minlength=len(words))
        # one string per token: its id and what follows it in the groups
        a_code = a_ids[a_in] + np.where(a_last[a_in], len(self.a.size), 0)
        b_code = b_ids[b_in] + np.where(b_last[b_in], len(self.b.size), 0) + 2 * len(self.a.size)
        group = np.concatenate([np.searchsorted(common, a_ends[a_in]) * 2, np.searchsorted(common, b_ends[b_in]) * 2 + 1])
        order = np.argsort(group, kind="stable")
        strings = [self.strings[i] for i in np.concatenate([a_code, b_code])[order].tolist()]
        at = np.concatenate([[0], np.cumsum(np.where(good, a_n + b_n, 0))]).tolist()
        shown = np.empty(len(words), object)
        shown[:] = ["".join(strings[lo:hi]) for lo, hi in zip(at, at[1:])]
        kept = good if joined else np.ones(len(words), bool)
        start = len(self.number)
        self.number.update(zip(compress(words, kept), range(start, start + len(words))))
        self.fresh.append((*(x[kept] for x in (a_n, b_n, n_links, good, shown)), keys))
        return list(compress(words, ~kept))

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """The pair keys (A id times B's vocabulary plus B id) of words in order."""
        size = self.n_links[numbers]
        before = np.cumsum(size) - size
        return self.keys[np.arange(size.sum()) + np.repeat(self.key_start[numbers] - before, size)]


def worker_aligner(a_path: str, b_path: str) -> WordAligner:
    """The aligner of this Python worker; it outlives a task, so words are not learned anew in each."""
    held = sys.modules.setdefault("pairlens_worker_aligners", types.ModuleType("pairlens_worker_aligners")).__dict__
    if (a_path, b_path) not in held:
        held[(a_path, b_path)] = WordAligner(a_path, b_path)
    return held[(a_path, b_path)]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


def _aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str, passing: list[str], with_groups: bool, short: bool) -> DataFrame:
    """One row per text, with its ``__links``, and one row per task and pair with ``__pair`` and its ``__n``; passing columns by place."""
    fields = FIELDS + [("groups", "string")] * with_groups
    keep = [f"__{i}" for i in range(len(passing))]  # any name can pass
    sent = docs.select(*[F.col(quoted(c)).alias(k) for c, k in zip(passing, keep)], F.col(quoted(text_col)).alias("__text"))
    given = {f.name: f.dataType for f in sent.schema.fields}
    added = [T.StructField(n, T._parse_datatype_string(t)) for n, t in [*fields, ("__links", "array<int>" if short else "array<long>"), ("__pair", "int" if short else "long"), ("__n", "long")]]
    key = pa.int32() if short else pa.int64()
    schema = T.StructType([T.StructField(c, given[c]) for c in keep] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_aligner(a_path, b_path)
        names = keep + [f.name for f in added]
        pairs, counts, kinds = np.empty(0, np.int64), np.empty(0, np.int64), {}
        for batch in batches:
            kinds = {c: batch.column(c).type for c in keep}
            for part, texts in slices(batch, "__text", SLICE):
                words, at = aligner.words(texts)
                number = aligner.numbers(words)
                bad = _sums(~aligner.good[number], at) > 0
                number = number[np.repeat(~bad, np.diff(at))]
                at = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(at)))])
                n_a, n_b, n_links = (_sums(x[number], at) for x in (aligner.n_a, aligner.n_b, aligner.n_links))
                shown = aligner.shown[number].tolist()
                groups = ["".join(shown[lo:hi])[:-1] for lo, hi in zip(at[:-1], at[1:])]
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                keys = aligner.links(number)
                uniques, n = np.unique(keys, return_counts=True)
                pairs, inverse = np.unique(np.concatenate([pairs, uniques]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
                rows = len(texts)
                bounds = np.concatenate([[0], np.cumsum(n_links)])
                for lo in range(0, rows, 256):  # lists of links in small batches
                    hi = min(lo + 256, rows)
                    links = pa.ListArray.from_arrays(pa.array((bounds[lo:hi + 1] - bounds[lo]).astype(np.int32)), pa.array(keys[bounds[lo]:bounds[hi]], key))
                    columns = [part.column(c).slice(lo, hi - lo) for c in keep]
                    columns += [pa.array(x[lo:hi]) for x in (n_a, n_b, n_links, n_links)] + [pa.array(digests[lo:hi], pa.string())]
                    columns += [pa.array(groups[lo:hi], pa.string())] * with_groups + [links, pa.nulls(hi - lo, key), pa.nulls(hi - lo, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        if len(pairs):
            empty = [pa.nulls(len(pairs), kinds[c]) for c in keep] + [pa.nulls(len(pairs), t) for t in [pa.int64()] * 4 + [pa.string()] * (1 + with_groups) + [pa.list_(key)]]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(pairs, key), pa.array(counts)], names=names)

    return sent.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", passing: list[str] | None = None, with_groups: bool = False) -> DataFrame:
    """Add each text's alignment: ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``, ``count_sum``.

    A pair's count is the number of links of it in the whole of ``docs``.  ``n_best`` counts the links whose
    pair has the highest count of its B token, ``count_sum`` adds the counts of all links.  ``with_groups``
    adds the groups themselves, ``a1,a2|b1;a3|b2,b3`` by ids.  Only ``passing`` (all columns but the text
    when not given) goes along.  Defined cases: a null or empty text, and one whose joined token bytes
    differ from the text on either side, has zeros and ''; repeated rows count each; an empty table gives
    an empty result; a column that has the name of a new one is replaced by it.
    """
    passing = [c for c in docs.columns if c != text_col] if passing is None else passing
    passing = [c for c in passing if c not in {n for n, _ in FIELDS + COUNTED + [("groups", "")]}]
    a, b = tokens_of_a(a_path), tokens_of_b(b_path)
    bound, size_b = pair_bound(a, b), len(b)
    made = _aligned(docs, a_path, b_path, text_col, passing, with_groups, len(a) * size_b < 1 << 31)
    table = stored(made, "alignment")
    known = table.filter("__pair IS NOT NULL").groupBy("__pair").agg(F.sum("__n").alias("n"))
    pairs, counts, best = _counted(known.limit(bound + 1).toPandas(), size_b)
    if len(pairs) > bound:
        raise ValueError(f"{len(pairs)} pairs where the vocabularies allow {bound}")
    rows = table.filter("__pair IS NULL").drop("__pair", "__n")
    keep = [c for c in rows.columns if c != "__links"]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n, _ in COUNTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                links = part.column("__links")
                at = np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
                place = np.searchsorted(pairs, links.flatten().to_numpy())
                columns = [pa.array(_sums(x[place], at).astype(np.int64)) for x in (best, counts)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + columns, names=keep + [n for n, _ in COUNTED])

    return rows.mapInArrow(run, schema).select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(passing)], *[c for c in schema.names if not c.startswith("__")])


def _counted(frame, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair keys in order, their counts and whether a count is the highest of its B token."""
    order = np.argsort(frame["__pair"].to_numpy(np.int64))
    pairs, counts = frame["__pair"].to_numpy(np.int64)[order], frame["n"].to_numpy(np.int64)[order]
    top = np.zeros(size_b, np.int64)
    np.maximum.at(top, pairs % size_b, counts)
    return pairs, counts, counts == top[pairs % size_b]
