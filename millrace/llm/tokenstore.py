"""Token-id store: raw id payloads in shards, reached through minimal perfect hash indexes.

One range partition of the documents (by doc_id) becomes one shard file::

    magic 4s | id bytes u8 | pad 3x | rows u32 | keys u32 | ids u64 | displacement buckets u32 | lowest key i64
    rows x (key i64, null u8, length u32)              in ascending key order
    displacement u32 x buckets                         the minimal perfect hash over the distinct keys
    keys x (fingerprint u32, first row u32, rows u32, offset u64)
    ids x little-endian unsigned 16 or 32 bit          16 where the vocabulary allows

The shard of a key follows from the shards' lowest keys (one small row for each shard); inside it the hash gives the
slot in constant time, the stored fingerprint refuses keys that are not there, and the slot has the offset. Shards are
written by Spark's own text writer, one row each (the line separator is the file's trailing id 0), so they go to any
store, commit atomically and survive lost executors; reading uses the binaryFile source.

Defined results: null and empty texts have only the end id; rows of one doc_id lie side by side, in the order of their
texts, and each gets its own row; a null doc_id is kept under the lowest key with a flag of its own; an empty table has
no shards; texts of any length are encoded whole; other columns than doc_id and text are not read, so their names cannot
clash. Memory is one shard, of about ``SHARD_BYTES`` of text.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Memo, byte_signs, default_path
from .common import fresh_path, map_rows, small_batches, table, written

MAGIC = b"IDS1"
HEAD = struct.Struct("<4sB3xIIQIq")
ROW = np.dtype([("key", "<i8"), ("null", "u1"), ("length", "<u4")])
SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("rows", "<u4"), ("offset", "<u8")])
END = 0
#: Shards whose first places are broadcast, some hundred bytes each.
MAX_SHARDS = 200_000
#: Shards that a lookup takes at once.
MAX_INDEXED = 2_000_000
#: Bytes of text that one shard holds at most; a worker needs about three times as much for its ids.
SHARD_BYTES = 64 << 20
NO_KEY = -(2**63)
_MASK = (1 << 64) - 1


def mix(key: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded."""
    x = key.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Hash and displace: keys fall into buckets of about four; each bucket's displacement puts its keys on free slots."""

    def __init__(self, n: int, displacement: np.ndarray):
        self.n, self.displacement = n, displacement

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 4)
        displacement = np.zeros(buckets, np.uint32)
        if not n:
            return cls(0, displacement)
        own = (mix(keys, 1) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        sizes = np.bincount(own, minlength=buckets)
        ends = np.cumsum(sizes)
        base, step = mix(keys, 2), mix(keys, 3)
        taken = np.zeros(n, bool)
        size = np.uint64(n)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            at = order[ends[b] - sizes[b] : ends[b]]
            x, y = base[at], step[at]
            tried = 0
            while True:
                d = np.arange(tried, tried + 256, dtype=np.uint64)
                slots = _spread(x[None, :], y[None, :], d[:, None]) % size
                free = ~taken[slots.astype(np.int64)].any(1)
                if len(at) > 1:
                    ordered = np.sort(slots, axis=1)
                    free &= (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if free.any():
                    k = int(free.argmax())
                    displacement[b] = tried + k
                    taken[slots[k].astype(np.int64)] = True
                    break
                tried += 256
        return cls(n, displacement)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        own = (mix(keys, 1) % np.uint64(len(self.displacement))).astype(np.int64)
        return (_spread(mix(keys, 2), mix(keys, 3), self.displacement[own].astype(np.uint64)) % np.uint64(max(1, self.n))).astype(np.int64)


def _spread(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    z = (x ^ (d * np.uint64(0xD6E8FEB86659FD93))) + d * (y | np.uint64(1))
    return z ^ (z >> np.uint64(32))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 4) >> np.uint64(32)).astype(np.uint32)


def pack_shard(keys: list[int | None], payloads: list[bytes], wide: bool) -> bytes:
    """A shard's bytes, without the last id, which the writer's line separator adds. Payloads are 32-bit ids with END."""
    rows = np.zeros(len(keys), ROW)
    rows["key"] = [NO_KEY if k is None else k for k in keys]
    rows["null"] = [k is None for k in keys]
    rows["length"] = [len(p) // 4 for p in payloads]
    starts = np.concatenate([[0], np.cumsum(rows["length"].astype(np.int64))])
    first = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])) if len(keys) else np.zeros(0, np.int64)
    distinct = rows["key"][first]
    index = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    at = index.slots(distinct)
    slots["print"][at] = fingerprints(distinct)
    slots["row"][at] = first
    slots["rows"][at] = np.diff(np.concatenate([first, [len(keys)]]))
    slots["offset"][at] = starts[first]
    ids = np.frombuffer(b"".join(payloads), np.uint32)
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    head = HEAD.pack(MAGIC, 4 if wide else 2, len(keys), len(distinct), len(ids), len(index.displacement), int(rows["key"][0]))
    return head + rows.tobytes() + index.displacement.astype("<u4").tobytes() + slots.tobytes() + body[: len(body) - (4 if wide else 2)]


class Shard:
    """Reads a shard's bytes."""

    def __init__(self, data: bytes):
        magic, self.width, n, keys, self.ids, buckets, self.lowest = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size
        self.rows = np.frombuffer(data, ROW, n, at)
        at += self.rows.nbytes
        self.index = PerfectHash(keys, np.frombuffer(data, "<u4", buckets, at))
        at += 4 * buckets
        self.slots = np.frombuffer(data, SLOT, keys, at)
        self.at = at + self.slots.nbytes
        self.data = data

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys, or -1 where the fingerprint says that a key isn't there."""
        at = self.index.slots(keys)
        return np.where(self.slots["print"][at] == fingerprints(keys), at, -1) if self.index.n else np.full(len(keys), -1)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each row of a key, without the end id."""
        slot = int(self.find(np.array([key], np.int64))[0])
        if slot < 0 or self.rows["key"][self.slots["row"][slot]] != key:
            return []
        return [ids[:-1] for _, ids in self._of(slot)]

    def _of(self, slot: int) -> Iterator[tuple[int, np.ndarray]]:
        entry = self.slots[slot]
        offset = int(entry["offset"])
        for r in range(int(entry["row"]), int(entry["row"]) + int(entry["rows"])):
            n = int(self.rows["length"][r])
            yield r, np.frombuffer(self.data, f"<u{self.width}", n, self.at + self.width * offset)
            offset += n

    def entries(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(key, start in the shard, ids, crc32) of every row, each reached through the index."""
        keys = np.unique(self.rows["key"])
        found = self.find(keys)
        if (found < 0).any():
            raise ValueError("a key is missing from the index")
        for slot in found.tolist():
            start = int(self.slots["offset"][slot])
            for r, ids in self._of(slot):
                yield None if self.rows["null"][r] else int(self.rows["key"][r]), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                start += len(ids)


class LibraryEncoder:
    """Whole texts to ids by the tokenizers library, with a bounded memo of pre-tokens before it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.signs = {b: c for c, b in byte_signs().items()}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.memo = Memo(self.piece)
        self.raw = [array("I", [i]).tobytes() for i in range(self.tokenizer.get_vocab_size())]

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token: the library's model over its bytes in byte signs."""
        if not text.isascii() or not text[1:].isalpha():
            text = text.encode().decode("latin-1").translate(self.signs)
        elif text[0] == " ":
            text = "\u0120" + text[1:]
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text: pre-tokens through the memo where the text is Latin, by the library else."""
        if not any(s in text for s in self.special):
            found = self.memo.encode(text)
            if found is not None:
                return found
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(1)
def encoder(path: str) -> LibraryEncoder:
    """One encoder for all tasks of a worker process; its memo is bounded."""
    return LibraryEncoder(path)


def write_store(docs: DataFrame, out: str, path: str | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Write the shards of all documents to the folder ``out``, in ascending doc_id order.

    The texts' bytes are summed first: there are so many ranges that a shard holds about ``shard_bytes`` of text at most,
    however few shuffle partitions the session has.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    shards = -(-size // shard_bytes)
    dealt = rows.repartitionByRange(shards, *order) if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order, "text")

    def load():
        coder = encoder(path)
        end = array("I", [END]).tobytes()

        def step(source: Iterable[tuple]) -> Iterator[tuple]:
            keys, payloads = [], []
            for doc_id, text in source:
                keys.append(doc_id)
                payloads.append(coder.encode(text or "") + end)
            if keys:
                yield (pack_shard(keys, payloads, coder.wide),)

        return step

    from tokenizers import Tokenizer

    width = 4 if Tokenizer.from_file(path).get_vocab_size() > 65536 else 2
    shards = map_rows(dealt, "value binary", load).select(F.col("value").cast("string").alias("value"))
    shards.write.option("lineSep", "\0" * width).text(out)


def _files(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out)


def _entries(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start in its shard, n_tokens, ids_crc32 and file of every stored row, each reached through its shard's index."""

    def load():
        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for file, data in rows:
                if data:
                    for key, start, n, crc in Shard(data).entries():
                        yield key, start, n, crc, file

        return step

    return map_rows(_files(spark, out).select("path", "content"), "doc_id long, start long, n_tokens long, ids_crc32 long, file string", load)


def _shard_table(entries: DataFrame) -> DataFrame:
    """file, lowest key, rows without a key and ids of each shard: one small row for each."""
    return entries.groupBy("file").agg(F.coalesce(F.min("doc_id"), F.lit(NO_KEY)).alias("lowest"), F.sum(F.col("doc_id").isNull().cast("long")).alias("nulls"), F.sum("n_tokens").alias("ids"))


def read_store(spark: SparkSession, out: str, max_shards: int = MAX_SHARDS) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every stored row, from the files and through their indexes.

    Payloads are read once: the rows are written, and the shards' first places are sums over them. Those are broadcast, or
    joined by shuffle beyond ``max_shards``.
    """
    rows = written(_entries(spark, out), "store-entries")
    shards = written(_shard_table(rows), "store-shards", compact=True)
    earlier = Window.orderBy(F.col("nulls") == 0, "lowest", "file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = shards.select("file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("first"))
    firsts = F.broadcast(firsts) if shards.count() <= max_shards else firsts
    return rows.join(firsts, "file").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def index_shards(spark: SparkSession, out: str) -> str:
    """Writes the table of the shards' key ranges beside them, once for each store; gives its path."""
    path = f"{out.rstrip('/')}-shards"
    entries = _entries(spark, out).where("doc_id IS NOT NULL")
    entries.groupBy("file").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest")).write.mode("overwrite").parquet(path)
    return path


def lookup(keys: DataFrame, out: str, shards: str, max_shards: int = MAX_INDEXED) -> DataFrame:
    """key and ids (without the end id) of every stored row of the keys (column doc_id).

    The shards' key ranges (``index_shards``; some hundred bytes each, their number is checked) are broadcast and tell which
    shards can hold a key. Only those are read, on the executors; in each a key costs one hash, one fingerprint and one slice.
    """
    spark = keys.sparkSession
    ranges = spark.read.parquet(shards)
    if ranges.count() > max_shards:
        raise ValueError(f"more than {max_shards} shards; look up in parts of the store or write larger shards")
    ordered = sorted(ranges.collect(), key=lambda r: (r.lowest, r.highest))
    shared = spark.sparkContext.broadcast(([r.lowest for r in ordered], [r.highest for r in ordered], [r.file for r in ordered]))

    def find():
        lowest, highest, files = shared.value

        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for (key,) in rows:
                at = bisect_left(highest, key)  # ranges follow one another, so both ends are in order
                while at < len(files) and lowest[at] <= key:
                    yield files[at], key
                    at += 1

        return step

    def read():
        def step(rows: Iterable[tuple]) -> Iterator[tuple]:
            for mine, data in rows:
                shard = Shard(data)
                for key in mine:
                    for ids in shard.get(key):
                        yield key, ids.tolist()

        return step

    wanted = keys.select(F.col("doc_id").cast("long").alias("key")).where("key IS NOT NULL").distinct()
    own = written(map_rows(wanted, "file string, key long", find).groupBy("file").agg(F.collect_list("key").alias("keys")), "store-wanted", compact=True)
    paths = [r.file for r in own.select("file").collect()]
    if not paths:
        return spark.createDataFrame([], "key long, ids array<long>")
    contents = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")
    return map_rows(contents.join(own, "file").select("keys", "content"), "key long, ids array<long>", read)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of every document, then read all of them back from the files."""
    out = fresh_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), out)
    return read_store(spark, out)
