"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order.  File layout::

    block*  index  bloom  footer

* block: zstd of entries ``varint shared | varint suffix | varint value | suffix | value``; a key
  repeats only what differs from the key before it, the first key of a block is whole;
* index: for each block its first key, offset, length and the ids before it (the sparse index);
* bloom: ten bits a key, seven probes;
* footer: fixed width, offsets and counts, a CRC of index and bloom, and the magic number.

A key is the identifier as a sortable 64-bit number (null first) and a tie number, so rows that
repeat an identifier are all kept, ordered by a hash of the text, then the text.  Null and empty texts hold the end id alone.
Further columns are not stored.  An empty table gives no shards and an empty result.

Reading back walks a shard's blocks for its keys; documents whose identifier is divisible by
LOOKUP_EVERY are then fetched as a lookup would: Bloom filter, binary search of the sparse index, block.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import batch_rows, shared_path, shuffle_partitions, text_print
from passagework.llm.store import AtomicWriter, open_fs

MAGIC = b"PWTOKSS2"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 * 1024
BITS_PER_KEY, PROBES = 10, 7
LOOKUP_EVERY = 20


# --- tokens -------------------------------------------------------------------------------------

#: The Unicode white space (fixed by the standard).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The tokenizer's split pattern, for texts of PLAIN characters (for which the two are known to agree).
PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
PLAIN = regex.compile("[\\x00-\\u0557\\u2000-\\u2060\\u20a0-\\u20bf\\u3000-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3]*")
#: The same with the Latin-1 letters and digits spelt out, which the quicker engine can run.
LATIN_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
LATIN_PIECE = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTER}]+| ?[0-9]+| ?[^\s{LATIN_LETTER}0-9]+|\s+(?!\S)|\s+"
)
LATIN = re.compile("[^\\x1c-\\x1f\\xb2\\xb3\\xb9\\xbc-\\xbe\\u0100-\\u200f\\u2028-\\u202f\\u205f-\\U0010ffff]*")
#: Pieces that are remembered, at most, and the characters of one: so about 300 MB at worst.
CACHE_PIECES, CACHE_CHARS = 1_200_000, 64


@lru_cache(maxsize=2)
def load(tokenizer_file: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    alphabet = byte_letters()
    lengths = np.zeros(max(tokenizer.get_vocab().values()) + 1, np.int64)
    for token, i in tokenizer.get_vocab().items():
        lengths[i] = len(token) if set(token) <= alphabet else 0
    return tokenizer, special, lengths, {}


def byte_letters() -> set[str]:
    """The letters that stand for bytes in a byte-level vocabulary, one letter a byte."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in seen} | {chr(256 + i) for i in range(256 - len(seen))}


def learn(pieces: list[str], tokenizer, lengths: np.ndarray, known: dict[str, bytes]) -> None:
    """Have the tokenizer encode new pieces.

    Pieces that begin with a blank keep their borders when they are strung together, so they go in
    as one text; the bytes of its tokens say where each piece ends.  Others go in one by one.
    """
    strung: list[str] = []
    alone: list[str] = []
    for p in pieces:
        (strung if p[0] == " " and not p.isspace() else alone).append(p)
    for piece, coded in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        known[piece] = np.array(coded.ids, "<u4").tobytes()
    if strung:
        ids = np.array(tokenizer.encode_batch_fast(["".join(strung)], add_special_tokens=False)[0].ids, "<u4")
        sizes = [len(p) if p.isascii() else len(p.encode()) for p in strung]
        ends = (np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1) * 4
        data, last = ids.tobytes(), 0
        for piece, end in zip(strung, ends.tolist(), strict=True):
            known[piece] = data[last:end]
            last = end


def encode_texts(texts: list[str], tokenizer_file: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text with ``end_id`` after them.

    Distinct pieces go to the tokenizer once and are remembered (the memory is emptied when full; long
    pieces are forgotten at once); texts with special tokens or characters outside ``PLAIN`` go to it whole.
    """
    tokenizer, special, lengths, known = load(tokenizer_file)
    if len(known) > CACHE_PIECES:
        known.clear()
    whole, pieces = [], []
    for i, x in enumerate(texts):
        if any(s in x for s in special):
            whole.append(i)
            pieces.append([])
        elif LATIN.fullmatch(x):
            pieces.append(LATIN_PIECE.findall(x))
        elif PLAIN.fullmatch(x):
            pieces.append(PIECE.findall(x))
        else:
            whole.append(i)
            pieces.append([])
    by_library = dict(zip(whole, tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True))
    new = list(set().union(*pieces).difference(known))
    learn(new, tokenizer, lengths, known)
    end = np.array([end_id], "<u4").tobytes()
    out = [
        np.frombuffer((np.array(by_library[i].ids, "<u4").tobytes() if i in by_library else b"".join(map(known.__getitem__, found))) + end, "<u4")
        for i, found in enumerate(pieces)
    ]
    for piece in new:
        if len(piece) > CACHE_CHARS:
            del known[piece]
    return out


# --- shard format -------------------------------------------------------------------------------


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def make_key(doc_id: int | None, tie: int) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + 2**63).to_bytes(8, "big")) + tie.to_bytes(4, "big")


def key_id(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - 2**63 if key[0] else None


def probes(name: bytes, bits: int) -> list[int]:
    h = hashlib.blake2b(name, digest_size=16).digest()
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Rows must come in key order; the open block is held, nine bytes a key for the filter and an
    index entry a block."""

    def __init__(self, uri: str):
        self.out, self.codec = AtomicWriter(uri), pa.Codec("zstd", compression_level=1)
        self.block, self.first, self.last, self.index, self.names = bytearray(), b"", b"", [], bytearray()
        self.docs = self.tokens = self.before = 0

    def add(self, doc_id: int | None, tie: int, ids: np.ndarray) -> None:
        key, value = make_key(doc_id, tie), (b"\2" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 65536 else b"\4" + ids.astype("<u4").tobytes())
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first, self.before = key, self.tokens
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.names += key[:9]
        self.docs += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = bytes(self.block)
            packed = self.codec.compress(raw, asbytes=True)
            at = self.out.write(struct.pack("<II", len(raw), zlib.crc32(packed)) + packed)
            self.index.append((self.first, at, len(packed) + 8, self.before))
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + varint(at) + varint(size) + varint(before) for k, at, size, before in self.index)
        bits = max(64, -(-self.docs * BITS_PER_KEY // 8) * 8)
        bloom, last = bytearray(bits // 8), b""
        for at in range(0, len(self.names), 9):
            name = bytes(self.names[at : at + 9])
            if name != last:  # in order, so repeats are neighbours
                for p in probes(name, bits):
                    bloom[p >> 3] |= 1 << (p & 7)
            last = name
        index_at, bloom_at = self.out.write(index), self.out.write(bytes(bloom))
        crc = zlib.crc32(bytes(bloom), zlib.crc32(index))
        self.out.write(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.docs, self.tokens, crc, PROBES, MAGIC))
        self.out.commit()

    def abort(self) -> None:
        self.out.abort()


class ShardReader:
    """Footer, index and filter are read at once, blocks as they are needed; the last one is kept."""

    def __init__(self, uri: str):
        store, path = open_fs(uri)
        self.file, self.codec = store.open_input_file(path), pa.Codec("zstd")
        end = self.file.size()
        i_at, i_len, b_at, b_len, self.docs, self.tokens, crc, _, magic = FOOTER.unpack(self.read(end - FOOTER.size, FOOTER.size))
        index, self.bloom = self.read(i_at, i_len), self.read(b_at, b_len)
        if magic != MAGIC or zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError(f"{uri} is not a whole shard")
        self.keys, self.blocks, at = [], [], 0
        while at < len(index):
            n, at = read_varint(index, at)
            self.keys.append(index[at : at + n])
            where, at = read_varint(index, at + n)
            size, at = read_varint(index, at)
            before, at = read_varint(index, at)
            self.blocks.append((where, size, before))
        self.kept: tuple[int, list[tuple[bytes, np.ndarray]]] = (-1, [])

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def entries(self, block: int) -> list[tuple[bytes, np.ndarray]]:
        """Keys and ids of a block."""
        if self.kept[0] != block:
            self.kept = block, list(self._entries(block))
        return self.kept[1]

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data = self.read(*self.blocks[block][:2])
        size, crc = struct.unpack_from("<II", data)
        if zlib.crc32(data[8:]) != crc:
            raise ValueError("a block is damaged")
        raw, at, key = self.codec.decompress(data[8:], decompressed_size=size, asbytes=True), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{raw[at]}", (length - 1) // raw[at], at + 1).astype("<u4")
            at += length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(make_key(doc_id, 0)[:9], len(self.bloom) * 8))

    def find(self, doc_id: int | None, tie: int = 0) -> tuple[int, np.ndarray] | None:
        """The ids before a row of ``doc_id`` in its shard and its own, or None: filter, binary search,
        one block."""
        if not self.may_hold(doc_id):
            return None
        key = make_key(doc_id, tie)
        block = bisect.bisect_right(self.keys, key) - 1
        if block < 0:
            return None
        start = self.blocks[block][2]
        for k, ids in self.entries(block):
            if k == key:
                return start, ids
            start += len(ids)
        return None

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first row of ``doc_id``, or None."""
        found = self.find(doc_id)
        return None if found is None else found[1]


# --- Spark --------------------------------------------------------------------------------------


def write(df: DataFrame, folder: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Write ``df`` to shards in key order; gives (number, path, documents, tokens) of each shard.

    One shuffle by range of the key; a task streams its sorted rows into one shard.  Only one row
    a shard comes to the driver.
    """
    spark = df.sparkSession
    batch_rows(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out, last, tie = TaskContext.get().partitionId(), None, (), 0
        path = f"{folder}/shard-{number:06d}.sst"
        try:
            for batch in batches:
                ids = batch.column(key).to_pylist()
                for doc_id, tokens in zip(ids, encode_texts([x or "" for x in batch.column(text).to_pylist()], tokenizer_file, end_id), strict=True):
                    out = out or ShardWriter(path)
                    tie, last = (tie + 1 if last == (doc_id,) else 0), (doc_id,)
                    out.add(doc_id, tie, tokens)
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"number": [number], "path": [path], "docs": [out.docs], "tokens": [out.tokens]})

    rows = df.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), text_print(F.col(text)).alias("_tie"))
    ordered = rows.repartitionByRange(shards or shuffle_partitions(spark), key, "_tie").sortWithinPartitions(key, "_tie", text).select(key, text)
    done = ordered.mapInArrow(run, "number long, path string, docs long, tokens long").collect()
    return sorted(tuple(r) for r in done)


def read(spark: SparkSession, shards: list[tuple[int, str, int, int]], key: str = "doc_id") -> DataFrame:
    """Every document of the shards: key, start (ids before it), n_tokens and the ids' bytes."""
    batch_rows(spark)
    rows, start = [], 0
    for _, path, _, tokens in shards:
        rows.append((path, start))
        start += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, last, tie = ShardReader(path), b"", 0
                base = at
                for block in range(len(reader.blocks)):
                    out: dict[str, list] = {key: [], "start": [], "n_tokens": [], "ids": []}
                    for k, ids in reader.entries(block):
                        doc_id, start = key_id(k), at
                        tie, last = (tie + 1 if last == k[:9] else 0), k[:9]
                        at += len(ids)
                        if doc_id is not None and doc_id % LOOKUP_EVERY == 0:
                            found = reader.find(doc_id, tie)
                            if found is None:
                                raise ValueError(f"{path} doesn't find what it holds")
                            start, ids = base + found[0], found[1]
                        for name, value in ((key, doc_id), ("start", start), ("n_tokens", len(ids)), ("ids", ids.tobytes())):
                            out[name].append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(out[key], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids"], pa.binary())], list(out))

    where = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return where.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids binary")


def write_and_read(df: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    spark = df.sparkSession
    return read(spark, write(df, shared_path(spark, "tokens"), tokenizer_file, end_id, key, text, shards), key)
