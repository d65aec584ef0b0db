"""SentencePiece encoding and decoding that keeps offsets into the source bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, text_or_empty

MODEL = "piece_bpe_32k.model"
#: UTF-8 of the sign that stands for a space.
SPACE = "▁".encode()
#: Texts are encoded in groups of at most so many characters, so that memory doesn't grow with a batch.
GROUP_CHARS = 500_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class CharacterMap:
    """The compiled character map of a model: a double-array trie over UTF-8 and the strings its leaves point to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.strings = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` that the map holds, and what stands for it."""
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(b"\0", found[1])]


class Normaliser:
    """Normalises as a model asks and records for each normalised byte the source byte that it comes from."""

    def __init__(self, spec, as_suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.as_suffix = as_suffix

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and their sources: one more entry than bytes, the last is where the last source part ends."""
        data = text.encode("utf-8", "replace")
        if not self.map and not self.squeeze and not self.as_suffix:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not data:
            return b"", np.zeros(1, dtype=np.int64)
        space = SPACE if self.escape else b" "
        widths = np.ones(len(data), dtype=np.int64)
        widths[np.frombuffer(data, dtype=np.uint8) == 32] = len(space)
        source = np.repeat(np.arange(len(data)), widths)
        lead = space if self.prefix else b""
        return lead + data.replace(b" ", space), np.concatenate([np.zeros(len(lead), dtype=np.int64), source, [len(data)]])

    def _parts(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(begin, end, normalised) of each longest prefix the map holds, else of each character."""
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit:
                yield at, at + hit[0], hit[1]
                at += hit[0]
            else:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                yield at, at + size, data[at : at + size]
                at += size

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.escape else b" "
        out, source, end = bytearray(), [], 0
        parts = list(self._parts(data))
        if self.squeeze:
            while parts and not parts[0][2].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", np.zeros(1, dtype=np.int64)
        start = parts[0][0]
        if self.prefix and not self.as_suffix:
            out += space
            source += [start] * len(space)
        spaced, end = self.squeeze, start
        for begin, end_, part in parts:
            if self.squeeze and spaced:
                part = part.lstrip(b" ")
            for byte in part:
                add = space if byte == 32 else bytes([byte])
                out += add
                source += [begin] * len(add)
            if part:
                spaced = self.squeeze and part.endswith(b" ")
            end = end_
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = source[-len(space)]
                del source[-len(space) :]
        if self.prefix and self.as_suffix:
            out += space
            source += [end] * len(space)
        return bytes(out), np.array([*source, end], dtype=np.int64)


class Encoder:
    """Ids as the library's, with the byte span of each piece in the source."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        kinds = {"unknown": 2, "control": 3, "byte": 6}
        self.widths = np.array([1 if p.type == kinds["byte"] else 0 if p.type == kinds["control"] else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kinds["unknown"])
        self.names = [str(k) for k in range(len(proto.pieces))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with an end id, no start id and no sampling."""
        return self.library.encode(texts, add_bos=False, add_eos=True, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(n, 2) source bytes [begin, end) of each id; those of the end id are empty, at the end.

        Pieces lie end to end in the normalised text, and the alignment projects their ends back. Several
        byte pieces of one character each take their own byte.
        """
        normal, source = self.normalise(text)
        found = np.asarray(ids, dtype=np.int64)
        widths = self.widths[found]
        if (found == self.unknown).any():
            names = self.library.encode(text, out_type=str)
            widths = np.append([len(n.encode()) for n in names], np.zeros(len(found) - len(names), dtype=np.int64))
            byte = [k for k, i in enumerate(ids[: len(names)]) if self.widths[i] == 1 and names[k].startswith("<0x")]
            widths[byte] = 1
        ends = np.cumsum(widths)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError(f"pieces cover {ends[-1] if len(ends) else 0} of {len(normal)} normalised bytes")
        return np.stack([source[ends - widths], source[ends]], axis=1) if len(ends) else np.zeros((0, 2), dtype=np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array), begins and ends (source bytes of each id), decoded for each row; null texts are empty.

    An empty text has the end id only. Repeated rows give repeated rows; other columns are not read.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            at = 0
            for texts in _groups(b.column(1).to_pylist()):
                ids = own.encode(texts)
                spans = [own.spans(t, i).astype(np.int32) for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32())), pa.array([s[:, 0] for s in spans], pa.list_(pa.int32())), pa.array([s[:, 1] for s in spans], pa.list_(pa.int32())), pa.array(own.decode(ids))],
                    names=["doc_id", "ids", "begins", "ends", "decoded"],
                )
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 of the rows of ``encoded``, made in one pass where the ids are.

    spans_sha256 is of the begins, then the ends, as little-endian 32-bit integers.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        name = own.names
        for b in batches:
            at = 0
            for texts in _groups(b.column(1).to_pylist()):
                ids = own.encode(texts)
                made = [hashlib.sha256(" ".join([name[i] for i in x]).encode()).hexdigest() for x in ids]
                decoded = [hashlib.sha256(t.encode()).hexdigest() for t in own.decode(ids)]
                spans = [hashlib.sha256(own.spans(t, i).T.astype("<i4").tobytes()).hexdigest() for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array(made), pa.array(decoded), pa.array(spans)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return mapped(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
