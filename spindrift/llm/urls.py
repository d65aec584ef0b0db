"""URL filter: a memory-mapped sorted array of 64-bit digests, probed by binary search, with stored strings against collisions."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import put, shared_folder
from .common import checkpointed, mapped, table

#: The production rules, as (verdict, host, path). Fixed values of the query's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Most bytes of a file of the index; longer lists are several files by ranges of the digest, made in tasks.
MAX_BYTES = 32 << 20
#: What a rule takes in a file beside its string: digest, offset, verdict.
_ROW = 17
_MAGIC = b"URLDIGS2"


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of (verdict, host, path) rules: of repeated rules the last one holds.

    Layout, little-endian: magic, n, p, h, then p distinct path lengths, h distinct host lengths, n sorted xxhash64 digests, n + 1
    offsets, n verdicts (1 block) and the UTF-8 strings host + path themselves.
    """
    last = {(h.translate(_LOWER).encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass")): v for v, h, p in rules}
    if any(v not in ("allow", "block") for v in last.values()):
        raise ValueError("a verdict is allow or block")
    lengths = [sorted({len(r[k]) for r in last}) for k in (1, 0)]
    whole = {h + p: v for (h, p), v in last.items()}
    rows = sorted((xxhash.xxh64_intdigest(r), r, v) for r, v in whole.items())
    offsets = np.cumsum([0, *(len(r) for _, r, _ in rows)], dtype="<u8")
    return b"".join(
        [_MAGIC, struct.pack("<QQQ", len(rows), *map(len, lengths)), *(np.array(x, dtype="<u8").tobytes() for x in lengths), np.array([d for d, _, _ in rows], dtype="<u8").tobytes(), offsets.tobytes(), bytes(v == "block" for _, _, v in rows), b"".join(r for _, r, _ in rows)]
    )


#: Only A-Z are lower-cased.
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Index:
    """A mapped file of the index. Its pages are shared by the workers of a machine and read as they are probed."""

    def __init__(self, path: str):
        self.data = data = np.memmap(path, dtype=np.uint8, mode="r")
        if bytes(data[:8]) != _MAGIC:
            raise ValueError(f"{path} is not an index")
        n, p, h = struct.unpack("<QQQ", bytes(data[8:32]))
        at = 32

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = data[at : at + count * np.dtype(kind).itemsize].view(kind)
            at += out.nbytes
            return out

        self.paths, self.hosts = take(p, "<u8").tolist(), take(h, "<u8").tolist()
        self.digests, self.offsets, self.block, self.strings = take(n, "<u8"), take(n + 1, "<u8"), take(n, "u1"), data[at:]

    def find(self, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
        """The row of each key or -1; equal digests are told apart by the stored strings."""
        found = np.full(len(keys), -1)
        if not len(self.digests) or not keys:
            return found
        at = np.searchsorted(self.digests, digests)
        for k in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests)):
            row = int(at[k])
            while row < len(self.digests) and self.digests[row] == digests[k]:
                if self.string(row) == keys[k]:
                    found[k] = row
                    break
                row += 1
        return found

    def string(self, row: int) -> bytes:
        return self.strings[int(self.offsets[row]) : int(self.offsets[row + 1])].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        return Lists([self]).judge(hosts, paths)


class Lists:
    """Files of an index by equal ranges of the digest, a power of two of them."""

    def __init__(self, files: list[Index]):
        self.files = files
        self.paths, self.hosts = (sorted({n for f in files for n in getattr(f, c)}) for c in ("paths", "hosts"))

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The file and the row of each key, or -1."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        own, rows = part_of(digests, len(self.files)), np.full(len(keys), -1)
        for k, f in enumerate(self.files):
            at = np.flatnonzero(own == k)
            rows[at] = f.find([keys[i] for i in at], digests[at])
        return own, rows

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Rule and verdict of each (host, path): the longest rule that fits (of equally long ones the longer host), else None.

        Of a host only those ends are probed that are as long as some rule's host, and of a path only such beginnings, so a url costs no more than its length
        and the lengths that rules have.
        """
        keys, owner, ranks = [], [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            host, path = host.encode("utf-8", "surrogatepass"), path.encode("utf-8", "surrogatepass")
            ends = [n for n in self.hosts if 0 < n == len(host) or (0 < n < len(host) and host[-n - 1] == _DOT)]
            for n in self.paths:
                if n > len(path):
                    break
                for e in ends:
                    keys.append(host[-e:] + path[:n])
                    owner.append(k)
                    ranks.append((e + n, e))
        best: dict[int, int] = {}
        files, rows = self.find(keys)
        for c in np.flatnonzero(rows >= 0).tolist():
            k = owner[c]
            if k not in best or ranks[c] > ranks[best[k]]:
                best[k] = c
        rule, verdict = [None] * len(hosts), [None] * len(hosts)
        for k, c in best.items():
            rule[k] = keys[c].decode("utf-8", "surrogatepass")
            verdict[k] = "block" if self.files[files[c]].block[rows[c]] else "allow"
        return rule, verdict


_DOT = ord(".")


def part_of(digests: np.ndarray, parts: int) -> np.ndarray:
    """The range of each digest, of a power of two of them."""
    bits = parts.bit_length() - 1
    return (digests >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(digests), dtype=np.int64)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def shared(spark: SparkSession, index: bytes) -> str:
    """Puts an index into the shared folder and has every executor, also a later one, fetch it; returns its file name."""
    name = f"url-index-{hashlib.sha256(index).hexdigest()[:24]}.bin"
    spark.sparkContext.addFile(put(spark, name, index))
    return name


def written(rules: DataFrame, max_bytes: int) -> list[str]:
    """The index of a frame (verdict, host, path) in files of about ``max_bytes``: names under which executors find them.

    Block holds where a rule has both verdicts. Tasks take the rules of a range of the digest each, and Spark writes what they make into the shared folder,
    where it stays with the checkpoints; nothing but names comes to the driver.
    """
    spark = rules.sparkSession
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = checkpointed(rules.where("host is not null and path is not null and verdict is not null").groupBy(lower.alias("host"), "path").agg(F.max("verdict").alias("verdict")))
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("path") + _ROW)).first()[0] or 0
    parts = 1 << max(0, (-(-size // max_bytes) - 1).bit_length())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = ((h + p).encode("utf-8", "surrogatepass") for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            digests = np.fromiter((xxhash.xxh64_intdigest(w) for w in whole), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part_of(digests, parts), pa.int32())], names=["verdict", "host", "path", "part"])

    def made(key: tuple, rows: pa.Table) -> pa.Table:
        data = build(zip(*(rows.column(c).to_pylist() for c in ("verdict", "host", "path")), strict=True))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary())})

    folder = f"{shared_folder(spark)}/url-index-{uuid.uuid4().hex}"
    rows = mapped(known.select("verdict", "host", "path"), dealt, "verdict string, host string, path string, part int")
    rows.groupBy("part").applyInArrow(made, "part int, data binary").write.option("compression", "none").parquet(folder)
    # A part may have no rule, so the number of parts goes with the names.
    names = [f"{parts}"]
    for path in spark.read.parquet(folder).select(F.input_file_name().alias("path")).distinct().collect():
        spark.sparkContext.addFile(path["path"])
        names.append(path["path"].rsplit("/", 1)[-1])
    return names


_OPEN: dict[tuple[str, ...], Lists] = {}


def _lists(names: list[str]) -> Lists:
    """The index of a process, opened once: one file as it is, or the parts that files of ``written`` hold, each laid beside its file to be mapped."""
    known = tuple(SparkFiles.get(n) for n in names)
    if known not in _OPEN:
        if len(names) == 1 and names[0].endswith(".bin"):
            _OPEN[known] = Lists([Index(known[0])])
        else:
            files: dict[int, Index] = {}
            for path in known[1:]:
                for batch in pq.ParquetFile(path).iter_batches(1):
                    part, data = batch.column(0)[0].as_py(), batch.column(1)[0].as_buffer()
                    beside = f"{path}.{part}.bin"
                    if not os.path.exists(beside):
                        with open(f"{beside}.{os.getpid()}", "wb") as f:
                            f.write(data)
                        os.replace(f.name, beside)
                    files[part] = Index(beside)
            empty = _Empty()
            _OPEN[known] = Lists([files.get(k, empty) for k in range(int(names[0]))])
    return _OPEN[known]


class _Empty:
    """A part of no rule."""

    paths = hosts = ()

    def find(self, keys: list[bytes], digests: np.ndarray) -> np.ndarray:
        return np.full(len(keys), -1)


def shipped_index(spark: SparkSession, rules: Iterable[tuple[str, str, str]] | DataFrame, max_bytes: int) -> list[str]:
    """Names of the index of a list, in which the last of repeated rules holds, or of a frame; a list above ``max_bytes`` goes the way of a frame."""
    if isinstance(rules, DataFrame):
        return written(rules, max_bytes)
    last = {(h.translate(_LOWER), p): v for v, h, p in rules}
    if sum(len(h.encode("utf-8", "surrogatepass")) + len(p.encode("utf-8", "surrogatepass")) + _ROW for h, p in last) <= max_bytes:
        return [shared(spark, build((v, h, p) for (h, p), v in last.items()))]
    return written(spark.createDataFrame([(v, h, p) for (h, p), v in last.items()], "verdict string, host string, path string"), max_bytes)


def judged(pages: DataFrame, rules: Iterable[tuple[str, str, str]] | DataFrame = RULES, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages(page_id, url)``.

    A rule fits its host and all its subdomains if the path starts with the rule's; the longest rule
    wins. rule is null and the verdict ``default`` where none fits, as for null or empty urls. Urls of any length are judged
    whole. Repeated rows give repeated rows; other columns are not read; an empty table gives no rows. Rules are
    host + path, both as in a url, a list or a frame (see ``shipped_index``); more than ``max_bytes`` of them are several files, and
    the digest of what is sought tells which of them may hold it.
    """
    names = shipped_index(pages.sparkSession, rules, max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rule, verdict = _lists(names).judge(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return mapped(rows, run, "page_id long, host string, path string, rule string, verdict string")


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERY_SQL = f"""
with rules(verdict, rhost, rpath) as (values {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select *, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(coalesce(rest, ''), length(raw) + 1), '^[^?#]*') as path, row_number() over () as rid from h)
select page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) as rule, coalesce(arg_max(verdict, length(rhost || rpath)), '{DEFAULT}') as verdict
from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
group by rid, page_id, host, path"""
