"""Token files: static range asymmetric numeral system over interleaved lanes, with checkpoints and checksums."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm.common import bounded, materialize, shared_path
from stratocast.llm.tokens import encoder, with_end

MAGIC = b"STOK"
HEAD = struct.Struct("<4sIIIIII")  # magic, table checksum, lanes, tokens, documents, words, checkpoints
LOW = np.uint64(1 << 31)
HALF = np.uint64(32)
BLOCKS = "part int, block int, first_token long, tokens long, payload binary"


@dataclass
class Table:
    """Shared frequencies: freq of each id (sum 2**bits, present ids at least 1) and their running sums."""

    freq: np.ndarray
    bits: int

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.checksum = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._slots = None

    @classmethod
    def from_counts(cls, counts: np.ndarray, bits: int = 20) -> Table:
        """Counts of all ids of the corpus scaled to 2**bits; every present id keeps at least one part."""
        total = 1 << bits
        present = np.flatnonzero(counts)
        if not len(present):
            return cls(np.r_[total, np.zeros(max(len(counts) - 1, 0))], bits)
        if len(present) > total:
            raise ValueError(f"{len(present)} ids need more than {bits} bits")
        share = counts[present] / counts[present].sum() * (total - len(present))
        parts = np.floor(share).astype(np.int64) + 1
        spare = total - int(parts.sum())
        parts[np.argsort(-(share - np.floor(share)), kind="stable")[:spare]] += 1
        freq = np.zeros(len(counts), dtype=np.int64)
        freq[present] = parts
        return cls(freq, bits)

    @property
    def slots(self) -> np.ndarray:
        """The id of each of the 2**bits slots."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        return self._slots

    def __reduce__(self):
        return (Table, (self.freq, self.bits))


def encode_block(table: Table, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, lanes: int = 1024, every: int = 128) -> bytes:
    """One independent block: token i goes to lane i % lanes. A checkpoint each `every` steps holds all lanes' states."""
    n = len(ids)
    steps = -(-n // lanes)
    freq, below = table.freq[ids], table.below[ids]
    if n and not freq.all():
        raise ValueError("an id has no frequency in the shared table")
    ceiling, scale = freq << np.uint64(63 - table.bits), np.uint64(table.bits)
    state = np.full(lanes, LOW)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    for t in range(steps - 1, -1, -1):
        at = slice(t * lanes, min((t + 1) * lanes, n))
        f = freq[at]
        x = state[: len(f)]
        spill = x >= ceiling[at]
        words.append((x[spill] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(spill, x >> HALF, x)
        q = x // f
        state[: len(f)] = (q << scale) + (x - q * f) + below[at]
        if t % every == 0:
            marks.append((t, state.copy()))
    words.reverse()
    before = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    marks.reverse()
    id_bytes = np.array([i if i is not None else 0 for i in doc_ids], dtype="<i8").tobytes() + np.array([i is None for i in doc_ids], dtype=np.uint8).tobytes()
    body = b"".join(
        [
            HEAD.pack(MAGIC, table.checksum, lanes, n, len(doc_ids), int(before[-1]), len(marks)), id_bytes, lengths.astype("<u4").tobytes(),
            *(struct.pack("<II", t, int(before[t])) + s.astype("<u8").tobytes() for t, s in marks), *(w.tobytes() for w in words),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def read_head(payload: bytes, table: Table) -> dict:
    """The parts of a block, its checksum and its table's checksum verified."""
    if len(payload) < HEAD.size + 4 or payload[:4] != MAGIC:
        raise ValueError("not a token block")
    if zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("a token block fails its checksum")
    _, checksum, lanes, n, docs, n_words, n_marks = HEAD.unpack_from(payload)
    if checksum != table.checksum:
        raise ValueError("a token block was written with another frequency table")
    at = HEAD.size
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    nulls = np.frombuffer(payload, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(payload, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    marks = []
    for _ in range(n_marks):
        t, word = struct.unpack_from("<II", payload, at)
        marks.append((t, word, np.frombuffer(payload, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    return {"lanes": lanes, "n": n, "doc_ids": [None if z else int(i) for i, z in zip(doc_ids, nulls, strict=True)], "lengths": lengths, "marks": marks, "words": np.frombuffer(payload, "<u4", n_words, at)}


def decode_block(table: Table, head: dict, mark: int = 0, until: int | None = None) -> np.ndarray:
    """Ids from checkpoint `mark` up to checkpoint `until` (default: the end); any stretch decodes on its own."""
    if not head["marks"]:
        return np.zeros(0, dtype=np.int64)
    lanes, n, words = head["lanes"], head["n"], head["words"]
    first, word, state = head["marks"][mark]
    state = state.astype(np.uint64)
    steps = -(-n // lanes) if until is None else head["marks"][until][0]
    mask, scale = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    slots, freq, below = table.slots, table.freq, table.below
    out = np.empty(min(steps * lanes, n) - first * lanes, dtype=np.int64)
    for t in range(first, steps):
        k = min(lanes, n - t * lanes)
        x = state[:k]
        slot = x & mask
        ids = slots[slot]
        out[(t - first) * lanes : (t - first) * lanes + k] = ids
        x = freq[ids] * (x >> scale) + slot - below[ids]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << HALF) | words[word : word + len(low)]
        word += len(low)
        state[:k] = x
    return out


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1, block_tokens: int = 1 << 18, part_tokens: int = 1 << 22, bits: int = 20) -> tuple[str, Table]:
    """Encode every whole text, append end_id, and write token blocks in ascending doc_id order; (path, table).

    Null and empty texts are end_id alone. Null ids come first; repeated ids are ordered by their ids' bytes. An empty
    table writes no block. Other columns are not read. Texts are tokenized once, into the shared folder; ids are
    counted over the whole corpus, so the frequency table is static and shared; a range shuffle of the ids orders the
    documents; each task writes its blocks through Spark's writer, which works on any store and commits whole tasks.
    """
    spark = docs.sparkSession

    def tokenise(batches):
        encode = encoder(tokenizer_path).batch
        for batch in bounded(batches, "text", max_bytes=6 << 20, max_rows=1 << 13):
            ids, counts = with_end(*encode(batch.column(1)), end_id)
            offsets = np.r_[0, np.cumsum(counts) * 2].astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], names=["doc_id", "ids"])

    def count(batches):
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in bounded(batches, "ids", max_bytes=32 << 20, max_rows=1 << 20):
            raw = batch.column(0)
            bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
            total += np.bincount(np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u2"), minlength=1 << 16)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), pa.array(total[live])], names=["id", "n"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = materialize(source.mapInArrow(tokenise, "doc_id long, ids binary"), "token-ids")
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row for each id of the vocabulary
        counts[r.id] = r.n
    table = Table.from_counts(counts, bits)

    def blocks(batches):
        part = TaskContext.get().partitionId()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        held = number = first = 0

        def row():
            nonlocal ids, doc_ids, held, number, first
            flat = np.frombuffer(b"".join(ids), "<u2")
            payload = encode_block(table, flat, doc_ids, np.array([len(x) // 2 for x in ids]))
            one = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "block", "first_token", "tokens", "payload"],
            )
            ids, doc_ids, held, number, first = [], [], 0, number + 1, first + len(flat)
            return one

        for batch in bounded(batches, "ids"):
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(x)
                doc_ids.append(doc_id)
                held += len(x) // 2
                if held >= block_tokens:
                    yield row()
        if ids:
            yield row()

    parts = max(1, -(-int(counts.sum()) // part_tokens))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("ids").asc()]
    path = shared_path(spark, "tokens")
    raw.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids").mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(table.freq) if n] or [(0, 1 << bits)], "id int, freq long").coalesce(1).write.parquet(f"{path}/table-{bits}")
    return path, table


def load_table(spark: SparkSession, path: str, bits: int = 20) -> Table:
    """The shared frequency table of a token folder."""
    freq = np.zeros(1 << 16, dtype=np.int64)
    for r in spark.read.parquet(f"{path}/table-{bits}").collect():  # one row for each id of the vocabulary
        freq[r.id] = r.freq
    return Table(freq, bits)


def read_tokens(spark: SparkSession, path: str, bits: int = 20, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 from the files; with_ids adds the ids."""
    table = load_table(spark, path, bits)
    files = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("tokens").alias("n")).collect())  # one number for each part
    base, running = {}, 0
    for part, n in totals:
        base[part] = running
        running += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def decode(batches):
        for batch in batches:
            for part, first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                head = read_head(payload.as_py(), table)
                ids = decode_block(table, head).astype("<u4")
                raw, ends = memoryview(ids.tobytes()), np.cumsum(head["lengths"])
                starts = ends - head["lengths"]
                arrays = [
                    pa.array(head["doc_ids"], pa.int64()), pa.array(base[part] + first + starts), pa.array(head["lengths"]),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return files.select("part", "first_token", "payload").mapInArrow(decode, schema)
