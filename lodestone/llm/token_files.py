"""Token ids in seekable zstandard files.

A file holds one independent zstandard frame per document, in ascending order of the documents' ids; then a
skippable frame with those ids; then a skippable frame with the seek table of the public seekable format: each
frame's compressed and decompressed size and a checksum of its content. A reader fetches the tables from the
file's end and decompresses only the frames of the documents it wants. A frame holds unsigned little-endian
32-bit token ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, python_batches, shared_dir, table
from .tokens import batches, tokenizer

END = 2
LEVEL = 3
#: Fixed values of the zstandard and seekable formats.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _FOOTER, _SKIP, _WITH_CHECKSUM = "<III", "<IBI", "<II", 0x80
_NO_ID = -(2**63)


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def checksum(content: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class TokenFileWriter:
    """Writes documents one by one; ``close`` adds the tables."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.ids, self.entries, self.tokens = out, [], [], 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if len(ids) >> 32:
            raise ValueError(f"document {doc_id} has {len(ids) // 4} ids; the seek table counts a frame's bytes in 32 bits")
        frame = self.pack(ids)
        self.out.write(frame)
        self.ids.append(_NO_ID if doc_id is None else doc_id)
        self.entries.append((len(frame), len(ids), checksum(ids)))
        self.tokens += len(ids) // 4

    def close(self) -> None:
        names = np.array(self.ids, "<i8").tobytes()
        body = b"".join(struct.pack(_ENTRY, *e) for e in self.entries) + struct.pack(_FOOTER, len(self.entries), _WITH_CHECKSUM, SEEKABLE)
        self.out.write(struct.pack(_SKIP, SKIPPABLE_IDS, len(names)) + names)
        self.out.write(struct.pack(_SKIP, SKIPPABLE_TABLE, len(body)) + body)


class TokenFile:
    """Reads a file by its tables; ``f`` is seekable. Every frame read is held against its checksum."""

    def __init__(self, f):
        import zstandard

        self.f = f
        f.seek(0, 2)
        end = f.tell()
        n, flags, magic = struct.unpack(_FOOTER, self._read(end - struct.calcsize(_FOOTER), struct.calcsize(_FOOTER)))
        if magic != SEEKABLE or not flags & _WITH_CHECKSUM:
            raise ValueError("not a seekable token file")
        at = end - struct.calcsize(_FOOTER) - n * struct.calcsize(_ENTRY)
        sizes = np.frombuffer(self._read(at, n * struct.calcsize(_ENTRY)), "<u4").reshape(-1, 3)
        if struct.unpack(_SKIP, self._read(at - 8, 8)) != (SKIPPABLE_TABLE, n * struct.calcsize(_ENTRY) + struct.calcsize(_FOOTER)):
            raise ValueError("the seek table is damaged")
        self.ids = np.frombuffer(self._read(at - 8 - n * 8, n * 8), "<i8")
        self.compressed, self.size, self.sums = (sizes[:, k].astype(np.int64) for k in range(3))
        self.at = np.concatenate(([0], np.cumsum(self.compressed)))
        if self.at[-1] + 8 + n * 8 + 8 + n * struct.calcsize(_ENTRY) + struct.calcsize(_FOOTER) != end:
            raise ValueError("the file's length and its tables differ")
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def frame(self, k: int) -> bytes:
        packed = self._read(int(self.at[k]), int(self.compressed[k]))
        content = self.unpack(packed, max_output_size=int(self.size[k])) if self.size[k] else b""
        if len(content) != self.size[k] or checksum(content) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that name; only their frames are decompressed."""
        want = _NO_ID if doc_id is None else doc_id
        a, b = np.searchsorted(self.ids, want, "left"), np.searchsorted(self.ids, want, "right")
        return [np.frombuffer(self.frame(k), "<u4") for k in range(a, b)]


def write_token_files(docs: DataFrame, path: str, folder: str, end: int = END, key: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Writes all documents to files in ``folder`` and returns (uri, documents, tokens) of each, in order.

    Documents are range-partitioned and sorted by key (nulls first) and, where keys repeat or are null, by the text's
    hash, so that no key's rows are bound to one task; a file a partition, streamed document by document. A task writes
    under a name of its own attempt and the returned list names the files of the attempts that succeeded, so a lost
    executor leaves at most a file that nothing names. The list is one row per file; an empty table gives none.

    A null text is empty; repeated rows are frames of their own; the key is cast to long, so it must be a number or
    text of one; other columns are left out. A document of 2**30 ids or more is an error, as the format can't hold it.
    """
    spark = docs.sparkSession
    python_batches(spark, 2000)
    place, base = _place(folder)
    place.create_dir(base, recursive=True)
    mark = np.array([end], "<u4").tobytes()

    def write(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = None
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.ids.zst"
        encode = tokenizer(path).encode
        where, at = _place(name)
        out = None
        try:
            for batch in rows:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in batches(texts):
                    for one, ids in zip(keys[a:b], encode(texts[a:b])):
                        if writer is None:
                            out = where.open_output_stream(at, compression=None)
                            writer = TokenFileWriter(out)
                        writer.add(one, ids + mark)
            if writer is not None:
                writer.close()
        finally:
            if out is not None:
                out.close()
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["part", "file", "docs", "tokens"])

    order = (F.col(key).asc_nulls_first(), F.xxhash64(text))
    dealt = docs.select(F.col(key).cast("long").alias(key), text).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    listed = dealt.mapInArrow(write, "part long, file string, docs long, tokens long").collect()
    return [(r.file, r.docs, r.tokens) for r in sorted(listed, key=lambda r: r.part)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]], key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the files, frame by frame."""
    rows, start = [], 0
    for name, _, tokens in files:
        rows.append((name, start))
        start += tokens

    def read(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
        for batch in given:
            for name, at in zip(*(c.to_pylist() for c in batch.columns[:2])):
                where, path = _place(name)
                with where.open_input_file(path) as f:
                    opened, out = TokenFile(f), []
                    for k, one in enumerate(opened.ids.tolist()):
                        ids = opened.frame(k)
                        out.append((None if one == _NO_ID else one, at, len(ids) // 4, zlib.crc32(ids), ids)[: len(kinds)])
                        at += len(ids) // 4
                        if len(out) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    listed = spark.createDataFrame(rows, "file string, start long")
    listed = listed.repartition(max(1, min(len(rows), partitions(spark))))
    return listed.mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(spark, files)
