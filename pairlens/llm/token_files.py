"""Token ids as flat binary files with 64-bit document offsets.

One part per range of document ids: ``part-NNNNNN.bin`` holds the ids of its documents back
to back as little-endian unsigned integers (16 bits if the vocabulary allows, else 32),
``part-NNNNNN.idx`` the document offsets within the part as unsigned 64-bit integers (one more
than documents), ``part-NNNNNN.doc`` the document ids as signed 64-bit integers (the smallest
value stands for null).  ``manifest`` (a Parquet table, one row per part) holds the sizes and
each part's base, the prefix sum of the tokens before it.  Every file is written under another
name and moved into place, so a repeated task attempt leaves whole files only.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairlens.llm.textbatch import Texts, quoted, release, slices, worker_kept

NULL_ID = np.iinfo(np.int64).min
ENCODED_BYTES = 8 << 20


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE tokenizer, each distinct piece it remembers only once.

    Pieces begin at a single space or line feed between two characters that are surely no white
    space.  The tokenizer's splitting pattern never matches across such a place, so the ids of a
    text are those of its pieces.  Distinct pieces are encoded joined, where the same holds, and
    told apart again by the tokens' byte lengths; pieces at the edges of texts go on their own.
    """

    JOINED_BYTES = 1 << 18
    #: Distinct pieces remembered at most; with one more it begins anew.
    REMEMBERED = 1 << 19

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])
        opens = np.zeros(256, bool)
        opens[[32, 10]] = True
        plain = np.ones(256, bool)
        plain[:33] = False
        plain[127:] = False
        behind = plain.copy()
        behind[0xC3:0xE0] = True  # first bytes that no white space has
        self.opens, self.plain, self.behind = opens, plain, behind
        self.job = ""
        self.forget()

    def forget(self) -> None:
        """Begin without pieces."""
        self.met = pa.array([], pa.large_binary())
        self.flat, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _cuts(self, texts: Texts) -> np.ndarray:
        """Starts of all pieces, ascending; every non-empty text starts one."""
        d = texts.data
        if len(d) < 3:
            return np.unique(texts.offsets[:-1][np.diff(texts.offsets) > 0])
        lead = (d >= 0xC3) & (d < 0xE0)
        before = self.plain[d]
        before[1:] |= lead[:-1] & (d[1:] >= 0x80)  # the second byte of a two-byte character
        cut = np.zeros(len(d), bool)
        cut[1:-1] = self.opens[d[1:-1]] & before[:-2] & self.behind[d[2:]]
        # a place at the edge of a text has a neighbour of another text: no cut but the edge itself
        edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(d))]
        cut[edges - 1] = False
        cut[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
        return np.flatnonzero(cut)

    def _separately(self, pieces: list[bytes]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in made]

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, where those of each piece begin and how many they are."""
        n = len(pieces)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64, n + 1, pieces.offset * 8)
        d = np.frombuffer(pieces.buffers()[2], np.uint8)
        first, second, last, lasttwo = d[offsets[:-1]], d[np.minimum(offsets[:-1] + 1, len(d) - 1)], d[offsets[1:] - 1], d[np.maximum(offsets[1:] - 2, 0)]
        size = np.diff(offsets)
        joinable = (size > 1) & self.opens[first] & self.behind[second] & (self.plain[last] | ((lasttwo >= 0xC3) & (lasttwo < 0xE0) & (last >= 0x80) & (size > 2)))
        starts, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat: list[np.ndarray] = []
        held = 0
        inner = np.flatnonzero(joinable)
        ends = np.cumsum(size[inner])
        joined = d[offsets[0]:offsets[-1]][np.repeat(joinable, size)]
        lo = 0
        alone = list(np.flatnonzero(~joinable))
        while lo < len(inner):
            start = ends[lo] - size[inner[lo]]
            hi = max(lo + 1, int(np.searchsorted(ends, start + self.JOINED_BYTES)))
            group = inner[lo:hi]
            made = np.array(self.tokenizer.encode_batch_fast([joined[start:ends[hi - 1]].tobytes().decode()], add_special_tokens=False)[0].ids, np.int32)
            reach = np.cumsum(self.bytes_of[made])
            wanted = ends[lo:hi] - start
            at = np.searchsorted(reach, wanted)
            if len(reach) and reach[-1] == wanted[-1] and (reach[np.minimum(at, len(reach) - 1)] == wanted).all():
                starts[group] = held + np.concatenate([[0], at[:-1] + 1])
                counts[group] = np.diff(at, prepend=-1)
                flat.append(made)
                held += len(made)
            else:
                alone.extend(group)
            lo = hi
        for i, made in zip(alone, self._separately([d[offsets[i]:offsets[i + 1]].tobytes() for i in alone]) if alone else []):
            starts[i], counts[i] = held, len(made)
            flat.append(made)
            held += len(made)
        return (np.concatenate(flat) if flat else np.empty(0, np.int32)), starts, counts

    def _remembered(self, pieces: pa.Array) -> np.ndarray:
        """Where distinct pieces stand among :attr:`met`; those not met yet are encoded and added."""
        at = pc.index_in(pieces, value_set=self.met)
        if at.null_count and len(self.met) + at.null_count > self.REMEMBERED:
            self.forget()
            at = pa.nulls(len(pieces), pa.int32())
        if at.null_count:
            new = pieces.filter(at.is_null())
            flat, starts, counts = self._distinct(new)
            at = at.fill_null(-1).to_numpy().copy()
            at[at < 0] = len(self.met) + np.arange(len(new))
            self.starts, self.counts = np.append(self.starts, starts + len(self.flat)), np.append(self.counts, counts)
            self.met, self.flat = pa.concat_arrays([self.met, new]), np.append(self.flat, flat)
            return at
        return at.to_numpy()

    def encode(self, texts: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with ``end_id`` after each text, as :attr:`kind`, and the number of ids of each text."""
        cuts = self._cuts(texts)
        offsets = np.append(cuts, len(texts.data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(texts.data))])
        coded = pieces.dictionary_encode()
        at = self._remembered(coded.dictionary)
        flat, starts, counts = self.flat, self.starts[at], self.counts[at]
        place = np.int32 if len(texts.data) + len(texts) + len(flat) < 1 << 30 else np.int64  # there are no more ids than bytes and ends
        starts, counts = np.append(starts, len(flat)).astype(place), np.append(counts, 1).astype(place)
        flat = np.append(flat, end_id).astype(self.kind)
        per_text = np.searchsorted(cuts, texts.offsets)
        index = np.insert(coded.indices.to_numpy(zero_copy_only=False), per_text[1:], len(starts) - 1)  # the end as one more piece
        del pieces, coded, cuts, offsets
        size = counts[index]
        reach = np.cumsum(size, dtype=place)
        gather = np.repeat(starts[index] - reach + size, size)
        gather += np.arange(len(gather), dtype=place)
        last = per_text[1:] + np.arange(len(texts))
        return flat[gather], np.diff(reach[last].astype(np.int64), prepend=0)


def worker_encoder(path: str, job: str = "") -> PieceEncoder:
    """The encoder that this Python worker keeps for its tasks: reading a vocabulary takes as long as encoding a megabyte.

    Its pieces are those of one ``job``; another one begins without any.
    """
    if path not in worker_kept:
        worker_kept.clear()
        worker_kept[path] = PieceEncoder(path)
    encoder = worker_kept[path]
    if encoder.job != job:
        encoder.forget()
        encoder.job = job
    return encoder


def _filesystem(uri: str):
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def _put(fs, path: str, data: bytes) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(data)
    fs.move(temporary, path)


def _get(fs, path: str, dtype) -> np.ndarray:
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, slice_bytes: int = ENCODED_BYTES) -> DataFrame:
    """Write the files below ``folder`` (a URI all executors share); returns the manifest.

    Documents come in ascending order of ``id_col``.  Defined cases: a null or empty text is
    its end id alone; null ids come first; rows that share an id keep an order by their text;
    an empty table has an empty manifest; other columns are ignored.  ``slice_bytes`` of text are
    encoded at a time: fewer need less memory and more time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("__id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("__text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("__id").asc_nulls_first()).sortWithinPartitions(F.col("__id").asc_nulls_first(), F.col("__text").asc())

    def run(batches):
        from pyspark import TaskContext

        encoder = worker_encoder(vocabulary, folder)
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:06d}"
        temporary = f"{name}.bin.{uuid.uuid4().hex}"
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        with fs.open_output_stream(temporary) as out:
            for batch in batches:
                for piece, texts in slices(batch, "__text", slice_bytes):
                    made, sizes = encoder.encode(texts, end_id)
                    lengths.append(sizes)
                    keys = piece.column("__id")
                    ids.append(keys.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64))
                    out.write(made.tobytes())
        n = sum(map(len, lengths))
        if not n:
            fs.delete_file(temporary)
            return
        fs.move(temporary, f"{name}.bin")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.uint64)
        _put(fs, f"{name}.idx", offsets.tobytes())
        _put(fs, f"{name}.doc", np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n], "n_tokens": [int(offsets[-1])], "width": [np.dtype(encoder.kind).itemsize]})
        del batch, piece, texts, made, sizes, keys, lengths, ids, offsets
        release(kept=False)

    made = ordered.mapInArrow(run, "part long, n_docs long, n_tokens long, width long")
    path = f"{folder}/sizes"
    made.write.parquet(path)
    sizes = spark.read.schema(made.schema).parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file part, not per document
    manifest = sizes.withColumns({"base": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)), "base_doc": F.coalesce(F.sum("n_docs").over(before), F.lit(0))})
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and ``ids``).

    The ids are memory-mapped where the folder is on a mounted file system.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        release()  # the vocabulary: the files are written
        fs, base = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{base}/part-{row['part']:06d}"
                kind = np.dtype(f"<u{row['width']}")
                tokens, offsets, ids = (_get(fs, f"{name}.{x}", k) for x, k in (("bin", kind), ("idx", "<u8"), ("doc", "<i8")))
                if len(tokens) != row["n_tokens"] or len(offsets) != row["n_docs"] + 1:
                    raise ValueError(f"{name} does not have the sizes of the manifest")
                at = offsets.astype(np.int64)
                for lo in range(0, len(ids), 4096):
                    hi = min(lo + 4096, len(ids))
                    crc = [zlib.crc32(tokens[at[i]:at[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    columns = [
                        pa.array(ids[lo:hi], mask=np.asarray(ids[lo:hi] == NULL_ID)), pa.array(at[lo:hi] + row["base"]),
                        pa.array(np.diff(at[lo:hi + 1])), pa.array(crc, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        names.append("ids")
                        columns.append(pa.array([tokens[at[i]:at[i + 1]].astype(np.int32) for i in range(lo, hi)], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return manifest.repartition(n, "part").mapInArrow(run, schema)
