"""Token ids in framed binary records, with an offset index beside them.

A file holds records: length (unsigned 64 bits), masked CRC-32C of those eight
bytes, payload, masked CRC-32C of the payload; all little-endian. The payload
is ``flag (1 byte: id known), doc_id (8 bytes), width of an id (1 byte), ids``.
Files follow one another in ascending id order. The index, a Parquet table with
``doc_id, part, file, offset, length, n_tokens``, gives random access, and it is
what commits a file: one that a lost or repeated task left behind is in no index.

Defined results: null texts are empty (they hold the end id alone), null ids
come first, repeated rows are written repeatedly, an empty table has no files,
and other columns, of any name, are ignored. Texts of any length are encoded whole into
one record each.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.recovery import cut, remove_path, scratch_dir
from .common import bases, blocks, claim, id_and_bytes, part_count
from .tokens import encoder, tokenizer_path

#: Fixed values of the format: reflected Castagnoli polynomial and mask addend.
CASTAGNOLI = 0x82F63B78
MASK_DELTA = 0xA282EAD8
_HEAD = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("width", "u1")])
#: Bytes of text that one file takes.
FILE_BYTES = 32 << 20


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    return t


_T0 = _byte_table()


def _shift(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Registers after the zero bytes of a table, which has their low and high halves."""
    return table[0][c & np.uint32(65535)] ^ table[1][c >> np.uint32(16)]


@lru_cache(maxsize=None)
def _zeros(k: int) -> np.ndarray:
    """The table that appends 2**k zero bytes to a register."""
    halves = np.stack([np.arange(65536, dtype=np.uint32), np.arange(65536, dtype=np.uint32) << np.uint32(16)])
    if not k:
        return _T0[halves & np.uint32(255)] ^ (halves >> np.uint32(8))
    return np.stack([_shift(_zeros(k - 1), _shift(_zeros(k - 1), h)) for h in halves])


_HIGH = np.uint32(0xFFFFFFFF)
#: Registers after two bytes, by those bytes as a little-endian number.
_T16 = _shift(_zeros(0), _T0[np.arange(65536) & 255]) ^ _T0[np.arange(65536) >> 8]


def crc32c(chunks: list[bytes]) -> np.ndarray:
    """CRC-32C of every chunk, computed by halving whole matrices of bytes."""
    lengths = np.array([len(c) for c in chunks], np.int64)
    out = np.zeros(len(chunks), np.uint32)
    powers = np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
    for p in np.unique(powers):
        rows = np.flatnonzero(powers == p)
        step = max(1, (8 << 20) >> p)  # rows of a matrix of 8 MiB at most
        for lo in range(0, len(rows), step):
            own, width = rows[lo : lo + step], 1 << p
            grid = np.zeros((len(own), width), np.uint8)  # leading zeros leave a zero register as it is
            for i, r in enumerate(own):
                if lengths[r]:
                    grid[i, width - lengths[r] :] = np.frombuffer(chunks[r], np.uint8)
            c = _T16[grid.view("<u2")]
            for k in range(1, p):
                c = _shift(_zeros(k), c[:, 0::2]) ^ c[:, 1::2]
            start = np.full(len(own), _HIGH)
            for k in range(p + 1):
                on = (lengths[own] >> k & 1).astype(bool)
                start[on] = _shift(_zeros(k), start[on])
            out[own] = c[:, 0] ^ start ^ _HIGH
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    heads = [len(p).to_bytes(8, "little") for p in payloads]
    a, b = masked(crc32c(heads)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [b"".join((h, x.tobytes(), p, y.tobytes())) for h, x, p, y in zip(heads, a, payloads, b, strict=True)]


def unframe(data: memoryview | bytes) -> tuple[list[bytes], int]:
    """Whole records at the start of ``data`` and the bytes they take; checks both checksums."""
    at, heads, payloads, sums = 0, [], [], []
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        end = at + 16 + n
        if end > len(data):
            break
        heads.append(bytes(data[at : at + 8]))
        payloads.append(bytes(data[at + 12 : at + 12 + n]))
        sums.append((data[at + 8 : at + 12], data[end - 4 : end]))
        at = end
    if sums:
        stored = np.frombuffer(b"".join(x for pair in sums for x in pair), "<u4").reshape(-1, 2)
        if (masked(crc32c(heads)) != stored[:, 0]).any() or (masked(crc32c(payloads)) != stored[:, 1]).any():
            raise ValueError("a record's checksum does not fit its bytes")
    return payloads, at


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    head = np.array([(doc_id is not None, doc_id or 0, ids.dtype.itemsize)], _HEAD)
    return head.tobytes() + ids.tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    head = np.frombuffer(payload, _HEAD, 1)[0]
    ids = np.frombuffer(payload, "<u2" if head["width"] == 2 else "<u4", offset=_HEAD.itemsize)
    return (int(head["doc_id"]) if head["known"] else None), ids


def _open(uri: str, write: bool = False):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if write else system.open_input_file(path)


def _make_dir(uri: str) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)


def write_records(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    spaces_dropped: bool = False,
) -> DataFrame:
    """Writes record files and their index below ``path``; returns the index."""
    rows = id_and_bytes(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(
        part_count(size, FILE_BYTES), F.col("doc_id"), F.xxhash64("text")
    ).sortWithinPartitions("doc_id", "text")
    schema = "doc_id long, part int, file string, offset long, length long, n_tokens long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        enc = encoder(tokenizer, spaces_dropped)
        end = np.array([end_id], enc.dtype)
        part, out, at = TaskContext.get().partitionId(), None, 0
        name = f"records-{part:06d}-{uuid.uuid4().hex}.bin"
        for ids, texts in blocks(batches):
            if out is None:
                _make_dir(path)
                out = _open(f"{path}/{name}", write=True)
            coded = [np.concatenate([x, end]) for x in enc.encode(texts)]
            framed = frame([pack(i, x) for i, x in zip(ids, coded, strict=True)])
            out.write(b"".join(framed))
            ends = at + np.cumsum([len(x) for x in framed])
            lengths = np.array([len(x) for x in framed])
            n = len(ids)
            columns = [ids, [part] * n, [name] * n, ends - lengths, lengths, [len(x) for x in coded]]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "part", "file", "offset", "length", "n_tokens"],
            )
            at = int(ends[-1])
        if out is not None:
            out.close()

    ordered.mapInArrow(run, schema).write.parquet(f"{path}/index")
    return docs.sparkSession.read.schema(schema).parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every record, read from the files in order.

    ``start`` counts the ids of all records before it.
    """
    index = spark.read.parquet(f"{path}/index")
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    files = bases(files, []).select("file", "base")
    files = files.repartition(max(1, files.count()), "file")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids, coded in iter_file(f"{path}/{name}"):
                    counts = np.array([len(x) for x in coded])
                    starts = base + np.cumsum(counts) - counts
                    base += int(counts.sum())
                    sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in coded]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in (ids, starts, counts, sums)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def iter_file(uri: str, size: int = 4 << 20) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and tokens of a file's records, some megabytes at a time."""
    with _open(uri) as source:
        held = b""
        while True:
            more = source.read(size)
            held += more
            payloads, used = unframe(held)
            held = held[used:]
            if payloads:
                both = [unpack(p) for p in payloads]
                yield [x[0] for x in both], [x[1] for x in both]
            if not more:
                if held:
                    raise ValueError(f"{uri} ends within a record")
                return


def read_at(path: str, file: str, offset: int, length: int) -> tuple[int | None, np.ndarray]:
    """One record by its index entry, for shuffled reads."""
    with _open(f"{path}/{file}") as source:
        source.seek(offset)
        (payload,), _ = unframe(source.read(length))
    return unpack(payload)


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes all documents to the shared folder, reads them back, removes the files."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "records")
    if "://" not in path:
        path = "file://" + path if path.startswith("/") else path.replace("file:/", "file:///", 1)
    write_records(docs, path, tokenizer_path(tokenizer), end_id)
    out = cut(read_records(spark, path))
    remove_path(spark, path)
    return out
