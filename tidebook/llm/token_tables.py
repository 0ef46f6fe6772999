"""Token ids in sorted-string-table files, keyed by document identifier.

A file holds, in this order: a magic number; data blocks of about ``BLOCK`` bytes, compressed with
zstandard; a sparse index (last key, place and size of each block); a Bloom filter over the keys; and a
footer of fixed size with the places of these. In a block keys share prefixes with the key before,
except at every ``RESTART``-th entry, whose places are listed at the block's end: a lookup asks the
filter, bisects the index, reads one block (or more, for repeated keys) and bisects the restarts.

Spark deals documents out by ranges of the identifier, sorts each range and each task streams one file,
so file order is key order. Files are written under a name of their own and renamed, so a task that
runs again replaces its file by an equal one. The folder must be one that driver and executors share.

Defined cases: a null identifier has the empty key and sorts first; a repeated identifier keeps all
entries, in order of the text's hash; null and empty texts give the end id alone; very long texts are encoded
whole and their ids are one value of a block of their own size; an empty table gives no file and no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import mix
from .common import bounded, scratch_path, table, written

MAGIC, BLOCK, RESTART, BLOOM_BITS, BLOOM_HASHES, END_ID = b"TBSST001", 64_000, 16, 10, 7, 0
FOOTER = struct.Struct("<QQQQQQI8s")
VOCABULARY, CACHE, LONG = "byte_bpe_50k.json", 400_000, 12
RUNS = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")  # pre-tokens of common words: letters, digits, signs without the apostrophe
RUN = b"\xff\xff"  # stands for white space that must be encoded with its surroundings; no id is 65,535


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian 16-bit integers."""
    return struct.pack(f"<{len(ids)}H", *ids)


def splits_words(file: dict) -> bool:
    """Whether a tokenizer file cuts texts by the byte-level pattern and nothing else, so that words can be encoded one by one."""
    cut = file.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    marked = [t["content"] for t in file.get("added_tokens", [])]
    return bool(plain and file.get("normalizer") is None and file["model"]["type"] == "BPE" and all(t.startswith("<|") for t in marked))


class Encoder:
    """Byte-level BPE ids of texts as little-endian 16-bit integers (the vocabulary has under 65,536 ids).

    The tokenizer never merges across the start of a word with its one space in front, so words are
    encoded by the library once and kept; texts with runs of white space are encoded whole. That holds for files with the byte-level
    pre-tokenizer and no normalizer (``by_words``); with any other file every text is encoded whole by the library.
    """

    class Words(dict):
        """Ids of a word (with a space in front, if ``space``), filled by the library when missing."""

        def __init__(self, tokenizer, bare: Encoder.Words | None) -> None:
            self.tokenizer, self.tokenize, self.space = tokenizer, tokenizer.model.tokenize, "" if bare is None else " "
            self.bare = self if bare is None else bare
            keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in keep]
            self.letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
            self.lead = self.space.translate(self.letters)
            self.line = packed(tokenizer.encode("\n", add_special_tokens=False).ids)

        def __missing__(self, word: str) -> bytes:
            if not word or word[0].isspace() or word[-1].isspace():
                return RUN
            if word.isascii() and word.isalpha():  # one pre-token: the model alone decides
                out = packed([t.id for t in self.tokenize(self.lead + word)])
            else:
                runs = RUNS.findall(word)
                if sum(map(len, runs)) < len(word) or "\n\n" in word or "<|" in word:
                    out = packed(self.tokenizer.encode(self.space + word, add_special_tokens=False).ids)
                elif len(runs) > 1:
                    out = self[runs[0]] + b"".join([self.line if r == "\n" else self.bare[r] for r in runs[1:]])
                else:
                    out = packed([t.id for t in self.tokenize(self.lead + word.encode().decode("latin-1").translate(self.letters))])
            if len(word) <= LONG:  # longer ones seldom return
                if len(self) >= CACHE:  # short words return more often: they stay while there is room
                    short = {w: v for w, v in self.items() if len(w) <= LONG - 4}
                    self.clear()
                    if len(short) < CACHE * 3 // 4:
                        self.update(short)
                self[word] = out
            return out

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65535:
            raise ValueError("ids of this vocabulary do not fit into 16 bits")
        with open(path, encoding="utf-8") as file:
            self.by_words = splits_words(json.load(file))
        self.first = self.Words(self.tokenizer, None)
        self.next = self.Words(self.tokenizer, self.first)
        self.end = packed([END_ID])

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if not self.by_words:
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        head, *rest = text.split(" ")
        out = self.first[head] + b"".join(map(self.next.__getitem__, rest))
        if RUN in out:
            out = packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return out + self.end


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once a worker."""
    return Encoder(path)


def key_of(doc_id: int | None) -> bytes:
    """The identifier as bytes that sort as it does; null sorts first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    """The identifier of a key."""
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder (``file:``, or a store that pyarrow reaches)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def bloom_places(keys: list[bytes], bits: int) -> np.ndarray:
    """The filter's places of each key (rows)."""
    h = np.array([zlib.crc32(k) << 32 | zlib.crc32(k, 0x5BD1E995) for k in keys], np.uint64)
    a, b = mix(h), mix(h ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Streams entries in key order into one file."""

    def __init__(self, out) -> None:
        self.out, self.at = out, out.write(MAGIC)
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.last, self.entries, self.tokens = b"", 0, 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.starts, self.inside = bytearray(), [], 0

    def add(self, key: bytes, value: bytes) -> None:
        """One entry; keys must not descend."""
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.inside % RESTART == 0:
            self.starts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value
        if not self.keys or key != self.last:
            self.keys.append(key)
        self.last, self.inside, self.entries, self.tokens = key, self.inside + 1, self.entries + 1, self.tokens + len(value) // 2
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.inside:
            packed = self.packer.compress(bytes(self.block) + struct.pack(f"<{len(self.starts)}II", *self.starts, len(self.starts)))
            self.index.append((self.last, self.at, len(packed)))
            self.at += self.out.write(packed)
            self._fresh()

    def close(self) -> None:
        """Write index, filter and footer."""
        self._flush()
        rows = b"".join(struct.pack("<BQQ", len(k), at, n) + k for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 65536):
            bloom[bloom_places(self.keys[i : i + 65536], bits).ravel()] = True
        packed = np.packbits(bloom, bitorder="little").tobytes()
        self.out.write(rows + packed + FOOTER.pack(self.at, len(rows), self.at + len(rows), len(packed), self.entries, self.tokens, len(self.index), MAGIC))


class Reader:
    """Lookup and scan of one file, given a seekable binary file."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(-FOOTER.size, 2)
        at, size, bloom_at, bloom_size, self.entries, self.tokens, blocks, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        rows = self._read(at, size)
        self.bloom = np.frombuffer(self._read(bloom_at, bloom_size), np.uint8)
        self.lasts, self.places, p = [], [], 0
        for _ in range(blocks):
            n, where, long = struct.unpack_from("<BQQ", rows, p)
            self.lasts.append(rows[p + 17 : p + 17 + n])
            self.places.append((where, long))
            p += 17 + n

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        raw = zstandard.ZstdDecompressor().decompress(self._read(*self.places[i]))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, more, size = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + more]
            at += 6 + more
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries in key order, block by block."""
        for i in range(len(self.places)):
            raw, _, end = self._block(i)
            yield from self._entries(raw, 0, end)

    def may_hold(self, key: bytes) -> bool:
        """What the Bloom filter says."""
        places = bloom_places([key], len(self.bloom) * 8)[0]
        return bool(all(self.bloom[int(p) >> 3] >> (int(p) & 7) & 1 for p in places))

    def get(self, key: bytes) -> list[bytes]:
        """The values under ``key``."""
        found: list[bytes] = []
        if not self.may_hold(key):
            return found
        for i in range(bisect.bisect_left(self.lasts, key), len(self.places)):
            raw, starts, end = self._block(i)
            first = [next(self._entries(raw, s, end))[0] for s in starts]
            at = starts[max(0, bisect.bisect_left(first, key) - 1)]
            for k, v in self._entries(raw, at, end):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
        return found


def write_tables(df: DataFrame, folder: str, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and write all rows under ``folder``; rows ``(shard, path, entries, tokens)``, one for each file.

    ``vocabulary`` is the path of the tokenizer's file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        shard = TaskContext.get().partitionId()
        temporary, path, writer, out = f"{base}/.{uuid.uuid4().hex}", f"{base}/shard-{shard:06d}.sst", None, None
        for batch in batches:
            for i, t in zip(batch.column(key), batch.column("__text")):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temporary)
                    writer = Writer(out)
                writer.add(key_of(i.as_py()), encoder(vocabulary)(t.as_py()))
        if writer is not None:
            writer.close()
            out.close()
            fs.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, path, writer.entries, writer.tokens)], names=["shard", "path", "entries", "tokens"])

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias("__text"), F.xxhash64(text).alias("__h"))
    order = [F.col(key).asc_nulls_first(), F.col("__h")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "__text")
    return written(ranged.transform(bounded).mapInArrow(run, "shard long, path string, entries long, tokens long"), "manifest")


def read_tables(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """Rows ``(key, start, n_tokens, ids_crc32)`` of the files in key order, one task a file.

    The manifest has one row a file; its token counts give each file's first place in the whole.
    """
    spark = manifest.sparkSession
    files, total = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        files.append((r["shard"], r["path"], total))
        total += r["tokens"]
    schema = pa.schema([(key, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(path) as file:
                    rows: list[tuple] = []
                    for k, v in Reader(file).scan():
                        rows.append((id_of(k), start, len(v) // 2, zlib.crc32(np.frombuffer(v, "<u2").astype("<u4").tobytes())))
                        start += len(v) // 2
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], schema=schema)

    listed = spark.createDataFrame(files, "shard long, path string, start long").repartition(max(1, len(files)), "shard")
    return listed.transform(bounded).mapInArrow(run, f"{key} long, start long, n_tokens long, ids_crc32 long")


def token_tables(df: DataFrame, text: str = "text", key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write the table files of ``df`` (in the shared folder unless another is given) and read them back."""
    import public_tokenizers

    folder = folder or scratch_path(df.sparkSession, "tables")
    return read_tables(write_tables(df, folder, public_tokenizers.path(VOCABULARY), text, key), folder, key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back."""
    return token_tables(table(spark, sf_dir, "documents"))
