"""Operator 1, token ids in sorted-string tables.

Documents are range-partitioned by id, encoded, and written as one file per shard:

    blocks   zstd-compressed; entries in key order, each
             u8 shared key prefix, u8 key suffix length, u32 id count, suffix, ids
    index    one 20-byte record per block: first key (8), offset u64, length u32
    bloom    bit array, BLOOM_HASHES probes from two halves of a 128-bit hash
    footer   64 bytes, see FOOTER

Keys are 8 bytes, big-endian, sign bit flipped, so byte order is numeric order.  A shard file
is named anew by each task attempt and only the attempt that succeeds is listed in the
manifest, so lost executors leave no half-written shard in use.

Defined results: null or empty text: only the end id.  Null doc_id: stored under the smallest
key and returned as null, first in order.  Repeated ids: one entry each, ordered by text hash.
An empty table gives an empty manifest.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD_BYTES = 32 << 20  # UTF-8 text bytes per shard
BLOCK_BYTES = 64 << 10  # raw bytes per block
BLOOM_BITS, BLOOM_HASHES = 10, 7  # bits per key, probes
GROUP_BYTES = 4 << 20  # text encoded at a time
CACHE_UNITS = 500_000  # text units whose ids a worker remembers
FOOTER = "<8sQQQQQQB7x"  # magic, index at, bloom at, blocks, bloom bytes, docs, ids, id width
MAGIC = b"FOLIOST1"
_NULL = b"\0" * 8
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)\Z")
_HARD = r"[ \n][ \n]|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class Encoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library.

    Its pre-tokenizer never joins a space to what stands before it, so a text whose white space
    is single spaces and line feeds is encoded unit by unit (a unit begins at each space or line
    feed) and each distinct unit only once.  All other texts are encoded whole, and so are those
    that hold a special token of the file, which the library takes as that token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = "|".join([_HARD, *(re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", t) for t in added)])
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            seen = word.encode().decode("latin-1").translate(self.visible)
            ids = self.words[word] = self._pack([t.id for t in self.model.tokenize(seen)])
        return ids

    def _unit(self, unit: str) -> bytes:
        text = unit[1:] if unit[:1] == "\0" else unit if unit[:1] == "\n" else f" {unit}"
        found = _PLAIN.match(text[1:] if text[:1] == "\n" else text)
        if not found:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""
        space, word, mark = found.groups()
        return (self._word("\n") if text[:1] == "\n" else b"") + self._word(space + word) + (self._word(mark) if mark else b"")

    def __call__(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column and their n + 1 offsets."""
        column = column.fill_null("")
        hard = pc.match_substring_regex(column, self.whole)
        texts = pc.binary_join_element_wise(pa.scalar("\0"), pc.if_else(hard, pa.scalar(""), column), "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        if len(self.units) > CACHE_UNITS:
            self.units.clear(), self.words.clear()
        units, parts = self.units, []
        for unit in coded.dictionary.to_pylist():
            ids = units.get(unit)
            if ids is None:
                ids = units[unit] = self._unit(unit)
            parts.append(ids)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        at = coded.indices.to_numpy()
        known = np.empty(len(parts), object)
        known[:] = parts
        ids = np.frombuffer(b"".join(known[at]), self.dtype)
        offsets = np.concatenate(([0], np.cumsum(sizes[at])))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        slow = np.flatnonzero(hard.to_numpy(zero_copy_only=False))
        if not len(slow):
            return ids, offsets
        pieces = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        for i, text in zip(slow, self.tokenizer.encode_batch_fast([column[int(i)].as_py() for i in slow], add_special_tokens=False)):
            pieces[i] = np.array(text.ids, self.dtype)
        return np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))


def key_of(doc_id: int | None) -> bytes:
    return _NULL if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, stream, width: int):
        import zstandard

        self.stream, self.width, self.zip = stream, width, zstandard.ZstdCompressor(level=1)
        self.index, self.keys, self.at, self.n_ids = [], [], 0, 0
        self._open()

    def _open(self) -> None:
        self.block, self.first, self.last, self.raw = [], None, b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian, width bytes each; keys come in ascending order."""
        same = 0
        while same < len(self.last) and self.last[same] == key[same]:
            same += 1
        self.first = key if self.first is None else self.first
        self.block += (struct.pack("<BBI", same, len(key) - same, len(ids) // self.width), key[same:], ids)
        self.last, self.raw = key, self.raw + len(ids) + 14
        self.keys.append(key)
        self.n_ids += len(ids) // self.width
        if self.raw >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            data = self.zip.compress(b"".join(self.block))
            self.stream.write(data)
            self.index.append(self.first + struct.pack("<QI", self.at, len(data)))
            self.at += len(data)
        self._open()

    def close(self) -> tuple[int, int]:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.stream.write(index + bytes(bloom) + struct.pack("<Q", bits))
        self.stream.write(struct.pack(FOOTER, MAGIC, self.at, self.at + len(index), len(self.index), len(bloom) + 8, len(self.keys), self.n_ids, self.width))
        return len(self.keys), self.n_ids


class ShardReader:
    def __init__(self, uri: str):
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, index_at, bloom_at, n, bloom_n, self.n_docs, self.n_ids, self.width = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token table")
        index = self.file.read_at(20 * n, index_at)
        self.blocks = [(index[i : i + 8], *struct.unpack("<QI", index[i + 8 : i + 20])) for i in range(0, 20 * n, 20)]
        bloom = self.file.read_at(bloom_n, bloom_at)
        self.bloom, self.bits = bloom[:-8], struct.unpack("<Q", bloom[-8:])[0]

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        import zstandard

        _, at, size = self.blocks[block]
        data, p, key = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, at)), 0, b""
        while p < len(data):
            same, more, n = struct.unpack_from("<BBI", data, p)
            p += 6
            key = key[:same] + data[p : p + more]
            p += more
            yield key, np.frombuffer(data, f"<u{self.width}", n, p)
            p += n * self.width

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key, found by Bloom filter and binary search."""
        from bisect import bisect_left

        key = key_of(doc_id)
        if not self.may_have(key):
            return []
        block, found = max(0, bisect_left(self.blocks, (key,)) - 1), []
        while block < len(self.blocks) and self.blocks[block][0] <= key:
            found += [ids for k, ids in self.entries(block) if k == key]
            block += 1
        return found


def _grouped(batches: Iterator) -> Iterator:
    """Batches joined until they hold GROUP_BYTES: units repeat more in larger groups."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


MANIFEST = "shard int, path string, n_docs long, n_ids long, first long, last long"


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode docs(doc_id, text), write the shards and return their manifest, a written table."""
    spark = docs.sparkSession
    common.small_batches(spark)
    scratch = common.Scratch(spark, "tokens")
    home = scratch.path("shards")

    def shard(batches):
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        cache = common.worker_cache("token_tables")
        encode = cache.get(tokenizer)
        if encode is None:
            encode = cache[tokenizer] = Encoder(tokenizer)
        end = np.array([end_id], encode.dtype).tobytes()
        writer = uri = first = last = None
        for batch in _grouped(batches):
            if writer is None:
                number = TaskContext.get().partitionId()
                uri = f"{home}/{number:06d}-{uuid.uuid4().hex}.sst"
                fs, path = FileSystem.from_uri(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                stream = fs.open_output_stream(path)
                writer = ShardWriter(stream, encode.width)
            ids, offsets = encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                writer.add(key_of(doc_id), ids[a:b].tobytes() + end)
                first, last = doc_id if first is None else first, doc_id if last is None or doc_id is not None else last
        if writer is not None:
            n_docs, n_ids = writer.close()
            stream.close()
            columns = [pa.array([v], t) for v, t in ((number, pa.int32()), (uri, pa.string()), (n_docs, pa.int64()), (n_ids, pa.int64()), (first, pa.int64()), (last, pa.int64()))]
            common.release()
            yield pa.RecordBatch.from_arrays(columns, ["shard", "path", "n_docs", "n_ids", "first", "last"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions(*order)
    return scratch.keep(dealt.mapInArrow(shard, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian unsigned 32-bit integers, read from the files.

    start counts the ids of all entries before this one, over all shards in order.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    plan = manifest.select("shard", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def scan(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                for key, ids in ShardReader(path).scan():
                    rows.append((None if key == _NULL else id_of(key), start, ids.astype("<u4").tobytes()))
                    start, held = start + len(ids), held + 4 * len(ids)
                    if held > 4 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                yield _rows(rows)

    spread = plan.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(scan, "doc_id long, start long, ids binary")


def _rows(rows: list) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["doc_id", "start", "ids"])


def digest(entries: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() gives."""
    return entries.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
