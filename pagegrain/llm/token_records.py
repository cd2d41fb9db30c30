"""Token ids as length-delimited binary records, with an offset index beside them.

A record is: payload length (8 bytes), masked checksum of those 8 bytes (4),
payload, masked checksum of the payload (4); numbers are little-endian.  The
payload is one document's ids, two bytes each while the vocabulary fits, else four.
The index is a Parquet table with a row for each record, so that a reader can take
records in any order."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT, HELD = 1 << 20, 1 << 25  # encoded words that a worker remembers, and bytes of them
BUFFER = 1 << 20
INDEX = "part int, offset long, size long, doc_id long, local_start long, n_tokens long"
_held: dict[str, tuple] = {}


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted, so that a checksum of data with checksums in it stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """The payload of one record; ValueError if a length or checksum is wrong."""
    head = record[:8]
    if len(record) < 16 or struct.unpack("<I", record[8:12])[0] != masked(head):
        raise ValueError("a record's length is damaged")
    payload = record[12:-4]
    if len(payload) != struct.unpack("<Q", head)[0] or struct.unpack("<I", record[-4:])[0] != masked(payload):
        raise ValueError("a record's payload is damaged")
    return payload


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class WordEncoder:
    """The tokenizers library over each distinct word of white space once.  The
    vocabulary's pre-tokenizer drops white space and its normalizer doesn't reach
    across it, so a text's ids are those of its words one after another; a vocabulary for which
    that doesn't hold on a sample of texts is refused."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.size = 0
        for text in ("one  two\n\tthree, four", " A\u0301b ß", "x\x0by z", "日本 語"):
            apart = [i for word in text.encode().split() for i in self.library.encode(word.decode(), add_special_tokens=False).ids]
            if self.library.encode(text, add_special_tokens=False).ids != apart:
                raise ValueError("this vocabulary's tokens cross white space")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each whole text; null is empty."""
        lists = [t.encode().split() if t else [] for t in texts]
        new = set().union(*lists).difference(self.known)
        if new:
            if len(self.known) + len(new) > KEPT or self.size > HELD:
                self.known.clear()
                self.size = 0
                new = set().union(*lists)
            fresh = list(new)
            self.size += sum(map(len, fresh))
            for at in range(0, len(fresh), 4096):
                some = fresh[at : at + 4096]
                for word, found in zip(some, self.library.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                    self.known[word] = np.array(found.ids, self.dtype).tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in lists]


def word_encoder(path: str) -> WordEncoder:
    if path not in _held:
        _held[path] = WordEncoder(path)
    return _held[path]


def blocks(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, list]]:
    """(first row, values) of a string column in blocks of about so many characters."""
    first, held, size = 0, [], 0
    for row, value in enumerate(column):
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= most:
            yield first, held
            first, held, size = row + 1, [], 0
    if held:
        yield first, held


def write_records(docs: DataFrame, path: str, folder: str, end_id: int) -> DataFrame:
    """Write docs' (doc_id, text) as records in ascending doc_id order and return the index.

    Ids end with end_id; a null or empty text is that id alone.  Parts are ranges of
    (doc_id, hash of the text), so a repeated id is no bottleneck; nulls come first,
    rows with one id follow the order of their texts' hashes.  A part is written under
    a name of its own and then renamed, so a task that runs twice does no harm.
    Memory holds a few megabytes of text and one document's ids."""

    def run(batches):
        part, task = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        words, (fs, base) = word_encoder(path), open_folder(folder)
        end = np.array([end_id], words.dtype).tobytes()
        name = f"{base}/part-{part:06d}.rec"
        offset = start = 0
        with fs.open_output_stream(f"{name}.{task}", buffer_size=BUFFER) as out:
            for batch in batches:
                rows = []
                for _, texts in blocks(batch.column(1)):
                    for ids in words.encode(texts):
                        record = frame(ids + end)
                        out.write(record)
                        rows.append((offset, len(record), start, (len(record) - 16) // words.dtype.itemsize))
                        offset += len(record)
                        start += rows[-1][3]
                at, size, local, n = (pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 4))
                yield pa.record_batch([pa.array([part] * len(batch), pa.int32()), at, size, batch.column(0), local, n], ["part", "offset", "size", "doc_id", "local_start", "n_tokens"])
        fs.move(f"{name}.{task}", name)

    spark = docs.sparkSession
    fs, base = open_folder(folder)
    fs.create_dir(base)
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = dealt.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    index = f"{folder}/index.parquet"
    dealt.select("doc_id", "text").mapInArrow(run, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def read_records(index: DataFrame, folder: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record of the index, read from the
    files: start counts the ids of all records before it, ids_crc32 is of the ids as
    little-endian unsigned 32-bit integers.  Checksums and counts are verified.  Only
    a total for each part goes through the driver."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, so_far = {}, 0
    for row in totals:
        starts[row.part] = so_far
        so_far += row.n
    dtype = "<u4" if wide else "<u2"

    def run(batches):
        fs, base = open_folder(folder)
        held, source = None, None
        for batch in batches:
            rows = []
            for part, offset, size, doc, local, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != held:
                    if source:
                        source.close()
                    held, source = part, fs.open_input_file(f"{base}/part-{part:06d}.rec")
                ids = np.frombuffer(unframe(source.read_at(size, offset)), dtype)
                if len(ids) != n:
                    raise ValueError("the index and a record differ")
                rows.append((doc, starts[part] + local, n, zlib.crc32(ids.astype("<u4").tobytes())))
            columns = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
        if source:
            source.close()

    return index.select("part", "offset", "size", "doc_id", "local_start", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write every document's record into a new shared folder and read all back."""
    from .scratch import new_path

    folder = new_path(docs.sparkSession, f"records-{uuid.uuid4().hex[:6]}")
    index = write_records(docs, path, folder, end_id)
    from tokenizers import Tokenizer

    return read_records(index, folder, wide=Tokenizer.from_file(path).get_vocab_size() > 1 << 16)
