"""Token ids packed by best-fit-decreasing, with binary output."""

from __future__ import annotations

import base64
import uuid
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import remove, shared_folder
from .common import checkpointed, mapped, table, text_or_empty

#: Production parameters: ids of a row, end id after each document (its pieces are not ended), rests of documents packed together.
LENGTH, END, TOGETHER = 2048, 50_256, 1024
#: Rows that are handed on at once.
BATCH = 256
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """Open rows by the ids that still fit in, over a segment tree that finds the least sufficient capacity."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[deque[int]] = [deque() for _ in range(length + 1)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open row of the least capacity that is at least ``need``, the one that got it first, removed."""
        count, at = self.count, need + self.size
        if not count[at]:
            # Up until a right neighbour has something, then down to its least leaf.
            while at > 1 and not (at % 2 == 0 and count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(capacity, -1)
        return self.rows[capacity].popleft(), capacity


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Items (each 1 to ``length``) by row: each goes, longest first and ties in order, where the least room is left over."""
    rows: list[list[int]] = []
    open_ = Capacities(length)
    for item in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[item])
        found = open_.take(need)
        if found is None:
            row, capacity = len(rows), length
            rows.append([])
        else:
            row, capacity = found
        rows[row].append(item)
        if capacity > need:
            open_.put(capacity - need, row)
    return rows


SCHEMA = "pack long, row int, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>"
_KINDS = {"pack": pa.int64(), "row": pa.int32(), "n_tokens": pa.int32(), "ids": pa.binary(), "cu_seqlens": pa.list_(pa.int32()), "positions": pa.binary(), "doc_ids": pa.list_(pa.int64()), "starts": pa.list_(pa.int64())}


def _kind(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def _kinds(path: str, length: int, end: int | None) -> tuple[str, str]:
    """Little-endian kinds of ids and of positions."""
    return _kind(max(encoding(path).n_vocab - 1, end or 0)), _kind(length - 1)


def pack_batches(batches: Iterator[pa.RecordBatch], path: str, length: int, end: int | None, together: int, task: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of batches of (doc_id, text), in bounded memory: whole rows of long documents at once, rests as soon as ``together`` are held."""
    own = encoding(path)
    kind, place_kind = _kinds(path, length, end)
    steps = np.arange(length, dtype=place_kind)
    pack, row, held, out = 0, 0, [], []

    def add(parts: list[tuple[int | None, int, np.ndarray]]) -> None:
        nonlocal row
        line, place, ends = np.zeros(length, dtype=kind), np.zeros(length, dtype=place_kind), [0]
        for _, _, ids in parts:
            at, to = ends[-1], ends[-1] + len(ids)
            line[at:to], place[at:to] = ids, steps[: len(ids)]
            ends.append(to)
        out.append((task << 32 | pack, row, ends[-1], line.tobytes(), ends, place.tobytes(), [p[0] for p in parts], [p[1] for p in parts]))
        row += 1

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        while len(out) >= least and out:
            part = out[:BATCH]
            del out[:BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], t) for k, t in enumerate(_KINDS.values())], names=list(_KINDS))

    def close() -> None:
        nonlocal pack, row
        for items in best_fit_decreasing(np.array([len(h[2]) for h in held], dtype=np.int64), length):
            add([held[k] for k in items])
        held.clear()
        pack, row = pack + 1, 0

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = own.encode_to_numpy(text.as_py(), disallowed_special=()).astype(kind)
            if end is not None:
                ids = np.append(ids, np.array([end], dtype=kind))
            for at in range(0, len(ids), length):
                piece = ids[at : at + length]
                if len(piece) < length:
                    held.append((doc_id, at, piece.copy()))
                    continue
                add([(doc_id, at, piece)])
                yield from ready(BATCH)
            if len(held) >= together:
                close()
                yield from ready(BATCH)
    close()
    yield from ready(0)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int | None = END, together: int = TOGETHER) -> DataFrame:
    """Packed rows of the token ids of ``docs(doc_id, text)``; nothing is shuffled.

    Each document is its ids and ``end`` (None: no end id; a text without ids is then left out, as it has
    no token). One longer than ``length`` is split into whole rows, which are full as they are, and a rest; nothing is dropped. A
    task packs the rests of its own rows, ``together`` at a time, each shorter than a row: so its memory has a bound
    whatever is in the table, and no key or group of copies meets in one task. Rows of a task that runs again
    come out alike; which documents share a row depends on how the table is split into tasks. Null texts are
    empty; repeated rows are packed as often as they occur; other columns are not read; an empty table gives no rows.

    Returns pack (task and number in it), row (in the pack), n_tokens (the rest of the row is padding with 0), ids (little-endian
    uint16 or uint32 by the vocabulary, ``length`` of them), cu_seqlens (0 and the end of each segment),
    positions (uint16 or uint32 by ``length``, reset to 0 at each segment; padding 0), doc_ids and starts (each segment's
    document and its first token's number in that).
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_batches(batches, path, length, end, together, TaskContext.get().partitionId())

    return mapped(_rows(docs), run, SCHEMA)


#: Files of a shard: what a row has in each, beside the two matrices.
SHARD = ("ids", "positions", "cu_seqlens", "segments", "rows")
MANIFEST = "shard string, rows long, bytes long"


def write_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes packed rows as one shard of binary files and tells of it; without rows there is none."""
    from pyarrow import fs

    task, streams, count, size = TaskContext.get(), [], 0, 0
    # A task that runs again, or twice at once, writes other files; only those of the one that counts are told of.
    shard = f"{task.partitionId():07d}-{task.taskAttemptId()}"
    for b in batches:
        if not b.num_rows:
            continue
        if not streams:
            system, base = fs.FileSystem.from_uri(folder)
            system.create_dir(base, recursive=True)
            streams = [system.open_output_stream(f"{base}/{shard}.{name}") for name in SHARD]
        segments = [np.array([[i is not None, i or 0, s] for i, s in zip(ids, starts, strict=True)], dtype="<i8").tobytes() for ids, starts in zip(b.column(6).to_pylist(), b.column(7).to_pylist(), strict=True)]
        parts = (
            b.column(3).to_pylist(),
            b.column(5).to_pylist(),
            [np.array([len(c), *c], dtype="<i4").tobytes() for c in b.column(4).to_pylist()],
            segments,
            [np.array(r, dtype="<i8").tobytes() for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)],
        )
        for stream, values in zip(streams, parts, strict=True):
            whole = b"".join(values)
            stream.write(whole)
            size += len(whole)
        count += b.num_rows
    for stream in streams:
        stream.close()
    if count:
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["shard", "rows", "bytes"])


def write_binary(rows: DataFrame, folder: str) -> DataFrame:
    """Writes packed rows as binary shards, one for each task, into a folder that all executors reach; returns shard, rows, bytes.

    ``<shard>.ids`` is the (rows, length) id matrix and ``<shard>.positions`` that of the positions; ``<shard>.cu_seqlens`` has for each
    row the number of its entries and these, int32; ``<shard>.segments`` for each segment whether its document has an id,
    the id and its first token's number, int64; ``<shard>.rows`` pack and row, int64. Only shards that are returned
    count: files of attempts that were lost have other names and are named nowhere.
    """
    return mapped(rows, lambda batches: write_batches(batches, folder), MANIFEST)


def write_packed(docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, end: int | None = END, together: int = TOGETHER) -> DataFrame:
    """``packed`` and ``write_binary`` in one pass: rows go from the packer to the files of a task without a way through the JVM."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return write_batches(pack_batches(batches, path, length, end, together, TaskContext.get().partitionId()), folder)

    return mapped(_rows(docs), run, MANIFEST)


def read_binary(manifest: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, end: int | None = END) -> DataFrame:
    """The packed rows of the shards of ``manifest(shard, rows)``, read as they were written; no file is held whole."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        widths = [length * np.dtype(k).itemsize for k in _kinds(path, length, end)]
        for b in batches:
            for shard, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, places, cu, segments, at = (system.open_input_stream(f"{base}/{shard}.{name}") for name in SHARD)
                for first in range(0, rows, BATCH):
                    out = []
                    for _ in range(min(BATCH, rows - first)):
                        pack, row = np.frombuffer(at.read(16), "<i8").tolist()
                        ends = np.frombuffer(cu.read(4 * int(np.frombuffer(cu.read(4), "<i4")[0])), "<i4").tolist()
                        known = np.frombuffer(segments.read(24 * (len(ends) - 1)), "<i8").reshape(-1, 3).tolist()
                        out.append((pack, row, ends[-1], ids.read(widths[0]), ends, places.read(widths[1]), [k[1] if k[0] else None for k in known], [k[2] for k in known]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_KINDS.values())], names=list(_KINDS))

    return mapped(manifest.select("shard", "rows"), run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """The packed rows with digests in place of the id and position matrices, of binary shards that were written to the shared folder and read again.

    The shards are removed when the digests are made, or if that fails.
    """
    folder = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    try:
        # The manifest keeps a partition for each task, so shards are read by as many.
        written = checkpointed(write_packed(table(spark, sf_dir, "documents"), folder))
        p = read_binary(written, folder)
        return checkpointed(p.select("pack", "row", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"), "cu_seqlens", "doc_ids", "starts"))
    finally:
        remove(spark, folder)
