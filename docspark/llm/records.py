"""Token ids as length-delimited binary records with masked checksums and an offset index."""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from . import arrays, tokens
from .common import check_columns, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK = 0xA282EAD8
#: Payload head: 1 if there is an id, the id, bytes of a token id, how many.
HEAD = "<BqBQ"
MANIFEST = "shard int, file string, docs long, tokens long, bytes long"
#: Bytes of a shard read at once.
READ_BYTES = 8_000_000


def masked(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that a checksum of data with checksums in it stays good."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """Length (8 bytes), its masked checksum (4), payload, its masked checksum (4); little-endian."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[memoryview, int]:
    """Payload of the record at ``at`` and where the next one begins; ValueError when damaged."""
    view = memoryview(data)
    length, check = struct.unpack_from("<QI", view, at)
    if masked(bytes(view[at : at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    payload = view[at + 12 : at + 12 + length]
    if len(payload) != length or struct.unpack_from("<I", view, at + 12 + length)[0] != masked(bytes(payload)):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + length


def write_records(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes one ``.rec`` and one ``.idx`` file per range of ids and returns the manifest.

    Shards follow ascending ids; rows of a shard are in that order, ties by text. The index
    holds the offset of every record and the file's end (8 bytes each), so records can be read
    in any order. A token id takes two bytes when the vocabulary allows it, else four. A task
    that runs again writes files of other names; only files in the manifest count.

    NULL text counts as empty; a NULL id comes first; repeated rows are one record each; an
    empty table gives an empty manifest. ``folder`` must be one that all executors share.
    """
    check_columns(docs, id_col, text_col)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, name = tokens.Encoder(path), TaskContext.get().partitionId(), uuid.uuid4().hex
        store, base = fs.FileSystem.from_uri(folder)
        width = 2 if max(encoder.vocabulary, end_id + 1) <= 1 << 16 else 4
        kind = np.dtype("<u2" if width == 2 else "<u4")
        out, offsets, total, at = None, [0], 0, 0
        file = f"shard-{shard:06d}-{name}"
        for batch in arrays.pieces_of(batches, "_text"):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{file}.rec")
            ids, counts = tokens.with_end(*encoder.encode(*arrays.flat(batch.column("_text"))), end_id)
            ids = ids.astype(kind)
            start = 0
            for key, n in zip(batch.column("_id").to_pylist(), counts.tolist(), strict=True):
                record = frame(struct.pack(HEAD, key is not None, key or 0, width, n) + ids[start : start + n].tobytes())
                out.write(record)
                start += n
                at += len(record)
                offsets.append(at)
            total += start
        if out is not None:
            out.close()
            with store.open_output_stream(f"{base}/{file}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "file": [file], "docs": [len(offsets) - 1], "tokens": [total], "bytes": [at]},
                schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]),
            )

    ranged = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .repartitionByRange(F.col("_id"), F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"), "_text")
    )
    return written(ranged.mapInArrow(run, MANIFEST))


def read_records(manifest: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` and, ``with_ids``, ``ids`` of every record, from the files of the manifest.

    ``start`` counts the ids of all documents before; of the shards only their totals are
    added up, one row each. Every checksum is tested. A file is read in parts along its index.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    shards = manifest.sparkSession.sparkContext.defaultParallelism
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{file}.idx") as index:
                    offsets = np.frombuffer(index.read(), "<u8").astype(np.int64)
                parts = np.flatnonzero(np.diff(offsets[:-1] // READ_BYTES)) + 1
                edges = [0, *parts.tolist(), len(offsets) - 1]
                with store.open_input_file(f"{root}/{file}.rec") as data:
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        block = data.read_at(int(offsets[b] - offsets[a]), int(offsets[a]))
                        rows = []
                        for at in (offsets[a:b] - offsets[a]).tolist():
                            payload, _ = unframe(block, at)
                            has, key, width, n = struct.unpack_from(HEAD, payload)
                            ids = np.frombuffer(payload[struct.calcsize(HEAD) :], "<u2" if width == 2 else "<u4").astype(np.uint32)
                            if len(ids) != n:
                                raise ValueError(f"{file}: {len(ids)} ids where {n} were written")
                            rows.append((key if has else None, base, n, zlib.crc32(ids.tobytes()), ids))
                            base += n
                        keys, starts, sizes, sums, lists = zip(*rows, strict=True)
                        columns = {id_col: pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                        if with_ids:
                            columns["ids"] = arrays.list_column(pa.array(np.concatenate(lists).astype(np.int32)), np.array(sizes))
                        yield pa.RecordBatch.from_pydict(columns)

    return based.repartition(shards).mapInArrow(run, schema)


def roundtrip(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Writes the records below the shared folder and reads them back."""
    folder = f"{shared_dir(docs.sparkSession)}/records"
    return read_records(write_records(docs, path, folder, end_id, id_col, text_col), folder, id_col, with_ids)
