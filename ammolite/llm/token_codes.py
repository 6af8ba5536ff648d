"""Directly addressable codes for token ids.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap that
says which of them continue at level k + 1. A rank directory (ones before each 512-bit superblock) turns a position at
one level into the position at the next, so any token is read by following at most four chunks, without decoding others.

A shard is one file in the shared folder: header, the documents' ids and token offsets, then the levels. Shards are
written by tasks over a range partitioning on doc_id; a file counts only if the manifest, committed by Spark, names it,
so repeated attempts of a task leave no duplicates.

Defined results: a null or empty text has the end id alone; a very long text is one document of its shard, encoded in blocks;
null doc_ids come first; rows of the same doc_id have documents of their own, in any order among them; an empty table gives
no shards and no rows; other columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ammolite.llm.common import chunk_ids, ensure_columns, materialize, scratch_path, text_blocks, tokenizer_path

MAGIC = b"AMDAC01\n"
SUPER = 512
#: Tokens that a shard holds at most before the next one begins; one document is never cut.
SHARD_TOKENS = 8_000_000


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, rank directory) of each level."""
    levels, rest = [], ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // SUPER) * SUPER, bool)
        padded[: len(more)] = more
        ones = padded.reshape(-1, SUPER).sum(1)
        directory = np.concatenate(([0], np.cumsum(ones))).astype("<u8")
        levels.append(((rest & 0xFF).astype(np.uint8), bits, directory))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


class Shard:
    """Random access to one shard's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard")
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.nulls, self.offsets = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = take("<u8", 1)
            self.levels.append((take("u1", int(n)), take("u1", -(-int(n) // 8)), take("<u8", -(-int(n) // SUPER) + 1)))

    def _rank(self, level: int, i: int) -> int:
        """Ones before position i of a level's bitmap: a directory entry and at most 63 bytes."""
        _, bits, directory = self.levels[level]
        s = i // SUPER
        ones = int(directory[s])
        lo, hi = s * SUPER // 8, i // 8
        ones += int(np.bitwise_count(bits[lo:hi]).sum())
        if i % 8:
            ones += int(bits[hi] & ((1 << i % 8) - 1)).bit_count()
        return ones

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi - 1: at each level one slice, found by rank."""
        out = np.zeros(hi - lo, np.uint32)
        where = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            if hi <= lo:
                break
            part = chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            more = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            where = np.flatnonzero(more) if where is None else where[more]
            if not len(where):
                break
            lo = self._rank(level, lo)
            hi = lo + len(where)
        return out

    def documents(self):
        """(doc_id or None, first token, ids) of each document in file order."""
        for k in range(len(self.doc_ids)):
            lo, hi = int(self.offsets[k]), int(self.offsets[k + 1])
            yield None if self.nulls[k] else int(self.doc_ids[k]), lo, self.tokens(lo, hi)


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    levels = encode_levels(flat)
    parts = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(flat), len(levels))]
    parts.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    parts.append(np.array([d is None for d in doc_ids], "u1").tobytes())
    parts.append(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<u8").tobytes())
    for chunks, bits, directory in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), directory.tobytes()]
    return b"".join(parts)


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_shards(documents: DataFrame, out: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every whole text (null: empty), append `end_id`, and write shards below `out` in ascending doc_id order.

    Returns the manifest: path, n_docs, n_tokens, start (tokens in all shards before it). Null ids come first; repeated
    ids keep all their rows. An empty table gives an empty manifest.
    """
    docs = ensure_columns(documents, doc_id="long", text="string").repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        coder, fs, root = chunk_ids(tokenizer, keep_space=True), *_filesystem(out)
        end = struct.pack("<I", end_id)
        part, seq, held, keys, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            nonlocal seq, held, keys, ids
            name = f"{root}/shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.dac"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(name) as f:
                f.write(shard_bytes(keys, ids))
            row = pa.record_batch({"path": [f"{out}/{name.rsplit('/', 1)[1]}"], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(keys)], "n_tokens": [held]})
            seq, held, keys, ids = seq + 1, 0, [], []
            return row

        for b in batches:
            texts, names = [x or "" for x in b.column(1).to_pylist()], b.column(0).to_pylist()
            for lo, hi in text_blocks(texts, 16_000_000):
                for key, raw in zip(names[lo:hi], coder.batch(texts[lo:hi])):
                    one = np.frombuffer(raw + end, "<u4")
                    if held and held + len(one) > shard_tokens:
                        yield flush()
                    keys.append(key)
                    ids.append(one)
                    held += len(one)
        if keys:
            yield flush()

    manifest = docs.mapInArrow(write, "path string, part int, seq int, n_docs long, n_tokens long")
    manifest = materialize(manifest, "shard-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("path", "n_docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files that the manifest names."""

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    shard = Shard(f.read())
                rows = [(key, base + lo, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for key, lo, ids in shard.documents()]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    files = max(1, manifest.count())
    spread = manifest.select("path", "start").repartition(min(files, 2000))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(documents, scratch_path(spark, "token-shards"), tokenizer_path("byte_bpe_50k.json"))
    return read_shards(manifest)
