"""Operator 1: token-id output as length-delimited binary records with an offset index.

A shard file is a run of records. Record: the payload's length (uint64, little endian), the masked CRC-32C of those
eight bytes (uint32), the payload, the masked CRC-32C of the payload (uint32); the mask rotates the checksum right by 15
bits and adds 0xA282EAD8. A payload is one document's ids as little-endian uint16, or uint32 where the vocabulary needs it;
the index and the reader carry the width. Beside each shard ``name.bin`` lies ``name.idx``: for each record its file
offset and its number of ids, two little-endian uint64, so that a shuffled reader can seek to any record.

The table that ``write_records`` returns is the manifest: only files in it count, so the file of a task attempt that was
lost with its executor is never read. Rows are written in ascending ``doc_id`` order, shard by shard.

Defined results: a null or empty text gives the end id alone; a null ``doc_id`` sorts first; rows that repeat a ``doc_id``
are written once each, ordered by a hash of their text; an empty table gives no shards and no rows. Other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdlake.session import scratch_path

from .common import materialize, open_fs, running_start, text_slices, write_bytes
from .tokens import encoder, end_with

_MASK = 0xA282EAD8


def _crc32c_tables() -> np.ndarray:
    """Eight 256-entry tables of the Castagnoli polynomial, made by its shift rule."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    out = [t]
    for _ in range(7):
        out.append(out[0][out[-1] & 0xFF] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


_T = _crc32c_tables()


def crc32c(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte spans at once: all spans step through their bytes, eight at a time, side by side."""
    order = np.argsort(-lens, kind="stable")
    starts, left = starts[order].astype(np.int64), lens[order].astype(np.int64)
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    if not len(starts):
        return crc
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    whole, at = left // 8, 0
    live = int(np.count_nonzero(whole > at))
    while live:
        p = starts[:live] + 8 * at
        b = data[p[:, None] + np.arange(8)]
        c = crc[:live]
        x = [(c >> np.uint32(8 * k)).astype(np.uint8) ^ b[:, k] for k in range(4)]
        crc[:live] = (_T[7][x[0]] ^ _T[6][x[1]] ^ _T[5][x[2]] ^ _T[4][x[3]]
                      ^ _T[3][b[:, 4]] ^ _T[2][b[:, 5]] ^ _T[1][b[:, 6]] ^ _T[0][b[:, 7]])
        at += 1
        live = int(np.count_nonzero(whole[:live] > at))
    for k in range(7):
        on = left % 8 > k
        p = (starts + 8 * whole + k)[on]
        crc[on] = _T[0][(crc[on] ^ data[p]) & 0xFF] ^ (crc[on] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frame(ids: np.ndarray, splits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The records of consecutive id sequences as bytes, and each record's offset in them."""
    n = np.diff(splits)
    size = n * width
    at = np.concatenate([[0], np.cumsum(size + 16)])
    body = ids.astype("<u2" if width == 2 else "<u4").view(np.uint8)
    out = np.empty(int(at[-1]), np.uint8)
    spread = np.ones(len(out), bool)
    head = at[:-1]
    for base, k in ((head, 12), (at[1:] - 4, 4)):
        spread[(base[:, None] + np.arange(k)).ravel()] = False
    out[spread] = body
    length = size.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[head[:, None] + np.arange(8)] = length
    out[head[:, None] + np.arange(8, 12)] = masked(crc32c(length.ravel(), np.arange(len(n)) * 8, np.full(len(n), 8))).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[at[1:, None] - 4 + np.arange(4)] = masked(crc32c(body, splits[:-1] * width, size)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, head


def unframe(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and splits of the records at ``offsets``; raises where a length or a checksum is wrong."""
    length = raw[offsets[:, None] + np.arange(8)].copy().view("<u8").ravel().astype(np.int64)
    word = lambda at: raw[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    if (masked(crc32c(raw, offsets, np.full(len(offsets), 8))) != word(offsets + 8)).any():
        raise ValueError("a record's length fails its checksum")
    if (offsets + 16 + length > len(raw)).any() or (masked(crc32c(raw, offsets + 12, length)) != word(offsets + 12 + length)).any():
        raise ValueError("a record's payload fails its checksum")
    ends = np.cumsum(length)
    take = np.repeat(offsets + 12 - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)
    return raw[take].view("<u2" if width == 2 else "<u4").astype(np.uint32), np.concatenate([[0], ends]) // width


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the shards; returns the manifest, one row per shard:
    ``shard, file, width, n_docs, n_tokens, start`` (``start``: ids of all shards before).

    One shuffle moves the texts into ``doc_id`` ranges (``partitions`` of them, else the session's shuffle partitions); a range
    is sorted, encoded slice by slice, and streamed to its file, so memory does not grow with a shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        name = f"{folder}/shard-{shard:06d}-{task.taskAttemptId()}"
        enc = encoder(tokenizer)
        width = 2 if enc.tok.get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        out, index, at, docs_, ids_, last = None, [], 0, 0, 0, []
        for batch in batches:
            for part in text_slices(batch):
                ids, splits = enc.encode(part.column("text"))
                if end_id is not None:
                    ids, splits = end_with(ids, splits, end_id)
                raw, offsets = frame(ids, splits, width)
                if out is None:
                    store, path = open_fs(f"{name}.bin")
                    store.create_dir(os.path.dirname(path), recursive=True)
                    out = store.open_output_stream(path)
                out.write(raw)
                index.append(np.stack([offsets + at, np.diff(splits)], 1).astype("<u8"))
                last.append(part.column("doc_id"))
                at, docs_, ids_ = at + len(raw), docs_ + len(offsets), ids_ + len(ids)
        if out is not None:
            out.close()
            write_bytes(f"{name}.idx", np.concatenate(index))
            import pyarrow.parquet as pq

            store, path = open_fs(f"{name}.key")
            with store.open_output_stream(path) as f:
                pq.write_table(pa.table({"doc_id": pa.chunked_array(last)}), f)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "width": [width],
                                              "n_docs": [docs_], "n_tokens": [ids_]})

    rows = (docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
            .repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    manifest = rows.mapInArrow(write, "shard long, file string, width long, n_docs long, n_tokens long")
    return running_start(materialize(manifest, "records-manifest"), "shard", "n_tokens")


def read_records(manifest: DataFrame, block: int = 2048) -> DataFrame:
    """Read the shards back through their index: one row per document with ``doc_id, start, n_tokens, ids`` (array of long).

    Every length and payload is checked against its checksum. ``block`` records are read at a time.
    """
    return _read(manifest, "doc_id long, start long, n_tokens long, ids array<long>", block, lambda ids, splits: pa.ListArray.from_arrays(
        pa.array(splits, pa.int32()), pa.array(ids.astype(np.int64))), "ids")


def read_digests(manifest: DataFrame, block: int = 2048) -> DataFrame:
    """``read_records`` with each document's ids reduced to the CRC-32 of their little-endian uint32 form, as ``ids_crc32``."""
    def digest(ids, splits):
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(splits[:-1].tolist(), splits[1:].tolist())], pa.int64())

    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", block, digest, "ids_crc32")


def _read(manifest: DataFrame, schema: str, block: int, make, column: str) -> DataFrame:
    def read(batches):
        import pyarrow.parquet as pq

        for batch in batches:
            for name, width, start in zip(*(batch.column(c).to_pylist() for c in ("file", "width", "start"))):
                store, path = open_fs(f"{name}.bin")
                with store.open_input_file(f"{path[:-4]}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2).astype(np.int64)
                with store.open_input_file(f"{path[:-4]}.key") as f:
                    key = pq.read_table(f).column("doc_id").combine_chunks()
                begin = start + np.concatenate([[0], np.cumsum(index[:, 1])])
                with store.open_input_file(path) as f:
                    for lo in range(0, len(index), block):
                        part = index[lo: lo + block]
                        size = int(part[-1, 0] + 16 + part[-1, 1] * width - part[0, 0])
                        f.seek(int(part[0, 0]))
                        raw = np.frombuffer(f.read(size), np.uint8)
                        ids, splits = unframe(raw, part[:, 0] - part[0, 0], width)
                        if (np.diff(splits) != part[:, 1]).any():
                            raise ValueError(f"{name}: the index and the records differ")
                        yield pa.RecordBatch.from_arrays(
                            [key.slice(lo, len(part)).cast(pa.int64()), pa.array(begin[lo: lo + len(part)]), pa.array(part[:, 1]), make(ids, splits)],
                            names=["doc_id", "start", "n_tokens", column])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "shard").mapInArrow(read, schema)
