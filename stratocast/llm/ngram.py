"""LM scoring: interpolated modified Kneser-Ney of order 3, counted in Spark, in sorted hash arrays that workers map."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.arrays import build, look_up, mapped, mixed, save, summed
from stratocast.llm.common import bounded, materialize, posix_path, shared_path, text_bytes

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # stand for no word: words' hashes pass through mixed()
REACH = 64  # bytes of a word that the table of letters covers
_LETTERS = mixed(np.arange(REACH * 256, dtype=np.uint64)).reshape(REACH, 256)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
OWN = 65535  # code of a word that is not among the common ones: its hash follows


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, tokens of each text): words with A-Z lower-cased, each text closed by END."""
    column = column.cast(pa.binary())
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    letter = ~_BLANK[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = bounds[:-1][np.diff(bounds) > 0]
    begins[inner] = letter[inner]
    starts = np.flatnonzero(begins)
    words = np.zeros(0, np.uint64)
    if len(starts):
        solid = np.flatnonzero(letter)
        first = np.searchsorted(solid, starts)
        length = np.diff(np.r_[first, len(solid)])
        place = np.arange(len(solid), dtype=np.int32)
        place -= np.repeat(first.astype(np.int32), length)
        np.minimum(place, REACH - 1, out=place)
        lowered = _LOWER[data[solid]]
        words = mixed(np.add.reduceat(_LETTERS.ravel()[(place << 8) | lowered], first))
        for i in np.flatnonzero(length > REACH):
            words[i] = xxhash.xxh64_intdigest(lowered[first[i] : first[i] + length[i]].tobytes())
    held = np.searchsorted(starts, bounds)
    counts = np.diff(held)
    return np.insert(words, held[1:], END), counts + 1


def triples(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(second last, last, token, tokens of each text) for every token; START stands before a text's beginning."""
    w, counts = word_hashes(column)
    ends = np.cumsum(counts)
    starts = ends - counts
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[starts] = START
    u = np.empty_like(w)
    u[2:] = w[:-2]
    u[starts] = START
    u[starts[counts > 1] + 1] = START
    return u, v, w, counts


def shard_of(x: np.ndarray, shards: int) -> np.ndarray:
    """Even ranges of the hash, in its order."""
    return ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def among(x: np.ndarray, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each is in the ascending array, where)."""
    if not len(ascending):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)
    return ascending[i] == x, i


def runs_of(ascending: np.ndarray) -> list[tuple[int, int]]:
    """Beginning and end of each run of equal values."""
    cuts = np.flatnonzero(np.diff(ascending)) + 1
    return list(zip(np.r_[0, cuts], np.r_[cuts, len(ascending)], strict=True)) if len(ascending) else []


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3+) from the numbers of entries counted 1, 2, 3 and 4 times, each within 0 and its count."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    raw = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return np.array([min(max(d, 0.0), float(i)) for i, d in enumerate(raw)])


@dataclass
class Places:
    """Where triples are counted: by their middle word, so that one task sees all a word's contexts and continuations.

    Heavy middle words, with over a quarter of a shard's share of all tokens (a thousandth at most, a hundred thousandth at
    least), are dealt by (first, middle), and such pairs by the whole triple.
    common: the most frequent words, most frequent first, which packets name in two bytes.
    """

    shards: int
    side: int  # shards of what is summed by hash: words' counts, continuations of heavy words
    words: np.ndarray
    pairs: np.ndarray
    common: np.ndarray

    def shard(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        spread, _ = among(v, self.words)
        key = mixed(v)
        at = np.flatnonzero(spread)
        pair = mixed(u[at], v[at])
        key[at] = pair
        at = at[among(pair, self.pairs)[0]]
        key[at] = mixed(u[at], v[at], w[at])
        return shard_of(key, self.shards)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of little-endian numbers, all lowest ones first, which compress better than whole numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    """n numbers whose planes begin at a place of raw."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


class Packets:
    """Triples as bytes: runs of one middle word, words by two-byte codes or in full, times only where above 1.

    Codes are places in `common`, most frequent first; triples stand by middle, first and last code.
    """

    KINDS = ("<u4", "<u2", "<u8", "<u2", "<u8", "<u2", "<u8", "<u4", "<u8")

    def __init__(self, common: np.ndarray):
        self.common, self.order = common, np.argsort(common)
        self.ascending = common[self.order]

    def codes(self, x: np.ndarray) -> np.ndarray:
        known, i = among(x, self.ascending)
        return np.where(known, self.order[i] if len(self.order) else 0, OWN).astype("<u2")

    def _pressed(self, parts: list[np.ndarray]) -> bytes:
        return pa.Codec("zstd", compression_level=3).compress(b"".join(map(_planes, parts)), asbytes=True)

    def pack(self, u, v, w, times) -> bytes:
        a, b, c = (self.codes(x) for x in (u, v, w))
        order = np.lexsort((c, a, v, b))
        u, v, w, times, a, b, c = (x[order] for x in (u, v, w, times, a, b, c))
        runs = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
        parts = [np.diff(np.r_[runs, len(v)]).astype("<u4")]
        for x, code in ((v[runs], b[runs]), (u, a), (w, c)):
            parts += [code, x[code == OWN]]
        often = np.flatnonzero(times > 1)
        parts += [often.astype("<u4"), times[often].astype("<u8")]
        return np.array([*(p.size for p in parts), sum(p.nbytes for p in parts)], "<u4").tobytes() + self._pressed(parts)

    def unpack(self, packet: bytes) -> tuple[np.ndarray, ...]:
        *sizes, size = np.frombuffer(packet, "<u4", 10).tolist()
        raw = pa.decompress(memoryview(packet)[40:], size, codec="zstd", asbytes=True)
        at, parts = 0, []
        for n, kind in zip(sizes, self.KINDS, strict=True):
            parts.append(_numbers(raw, kind, n, at))
            at += parts[-1].nbytes
        u, v, w = (self._words(parts[i], parts[i + 1]) for i in (3, 1, 5))
        times = np.ones(len(u), np.int64)
        times[parts[7]] = parts[8]
        return u, np.repeat(v, parts[0]), w, times

    def pack_words(self, words: np.ndarray, count: np.ndarray, before: np.ndarray) -> bytes:
        """Words with how often they stand and how many different words stand before them."""
        code = self.codes(words)
        order = np.argsort(code, kind="stable")
        code, words = code[order], words[order]
        parts = [code, words[code == OWN], count[order].astype("<u4"), before[order].astype("<u4")]
        return np.array([len(words), sum(p.nbytes for p in parts)], "<u4").tobytes() + self._pressed(parts)

    def unpack_words(self, packet: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, size = np.frombuffer(packet, "<u4", 2).tolist()
        raw = pa.decompress(memoryview(packet)[8:], size, codec="zstd", asbytes=True)
        code = _numbers(raw, "<u2", n, 0)
        own = int((code == OWN).sum())
        words = self._words(code, _numbers(raw, "<u8", own, 2 * n))
        count, before = (_numbers(raw, "<u4", n, 2 * n + 8 * own + at) for at in (0, 4 * n))
        return words, count, before

    def _words(self, code: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.empty(len(code), np.uint64)
        full = code == OWN
        out[~full] = self.common[code[~full]]
        out[full] = own
        return out


@dataclass
class Model:
    """Where the arrays lie and the few numbers that hold for all: picklable, under a megabyte."""

    folder: str
    places: Places
    heavy_words: np.ndarray  # of each heavy middle word: total, n1, n2, n3+ of its continuations
    heavy_pairs: np.ndarray  # of each heavy pair: total, n1, n2, n3+ of its triples
    discount: list[np.ndarray]  # by order, from 1
    tokens: int
    distinct: int
    pairs: int
    tail: float  # mass of the continuation distribution left to the uniform one

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of each token after its two predecessors."""
        _, first, inverse = np.unique(mixed(u, v, w), return_index=True, return_inverse=True)
        u, v, w = u[first], v[first], w[first]
        words, back = np.unique(w, return_inverse=True)
        counted = self._found("word", shard_of(words, self.places.side), [words])[0]
        low = self._cut(counted[:, 1], self.discount[0]) / max(self.pairs, 1) + self.tail / (self.distinct + 1)
        shard = self.places.shard(u, v, w)
        pair_key, next_key = mixed(u, v), mixed(v, w)
        triple, context, after, middle = self._found("gram", shard, [mixed(u, v, w), pair_key, next_key, v])
        spread, i = among(v, self.places.words)
        middle[spread] = self.heavy_words[i[spread]]
        at = np.flatnonzero(spread)
        after[at] = self._found("next", shard_of(next_key[at], self.places.side), [next_key[at]])[0]
        heavy, i = among(pair_key[at], self.places.pairs)
        context[at[heavy]] = self.heavy_pairs[i[heavy]]
        p = self._level(after[:, 0], middle, self.discount[1], low[back])
        p = self._level(triple[:, 0], context, self.discount[2], p)
        return np.log10(p)[inverse], counted[back, 0][inverse]

    @staticmethod
    def _cut(times: np.ndarray, discount: np.ndarray) -> np.ndarray:
        return np.maximum(times - discount[np.minimum(times, 3)], 0)

    def _level(self, times, stats, discount, lower):
        seen = stats[:, 0] > 0
        total = np.where(seen, stats[:, 0], 1)
        back = np.where(seen, stats[:, 1:] @ discount[1:] / total, 1)
        return np.where(seen, self._cut(times, discount) / total, 0) + back * lower

    def _found(self, kind: str, shard: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
        """Rows of counts of each list of keys, list j from the j-th table of each key's shard file."""
        out = [np.zeros((len(shard), COLUMNS[kind][j]), np.int64) for j in range(len(keys))]
        order = np.argsort(shard, kind="stable")
        for a, b in runs_of(shard[order]):
            at = order[a:b]
            arrays = mapped(f"{self.folder}/{kind}-{shard[at[0]]}")
            for j in range(len(keys) if arrays else 0):
                out[j][at] = look_up(arrays[7 * j : 7 * j + 7], keys[j][at])[0]
        return out


COLUMNS = {"word": (2,), "gram": (1, 4, 1, 4), "next": (1,)}
SHIPPED = "kind string, shard int, key long, numbers array<long>, packet binary"


def fold_for_lm(column) -> F.Column:
    """crc32 of the id as text, modulo 5; null ids fall in fold 0 (trained on)."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5, F.lit(0)).cast("int")


def choose_places(rows: DataFrame, n_rows: int, shards: int, side: int, sampled: int = 5000) -> Places:
    """Heavy words, heavy pairs and common words (under 65536 each) of about `sampled` texts.

    They only decide where triples are counted and how packets name words, not what is counted.
    """
    share = min(1e-3, max(1 / (4 * shards), 1e-5))

    def count(batches):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        totals, n = [none, none], 0
        for batch in bounded(batches, "text", max_bytes=2 << 20):
            u, v, _, _ = triples(batch.column(1))
            n += len(v)
            for i, x in enumerate((v, mixed(u, v))):
                keys, _, c = summed(np.r_[totals[i][0], x], np.r_[totals[i][1], np.ones(len(x), np.int64)])
                kept = c > n * share / 100 if len(keys) > 300_000 else slice(None)
                totals[i] = keys[kept], c[kept]
        rows = []
        for what, least in ((0, 1), (1, n * share / 8)):
            keys, c = (x[totals[what][1] > least] for x in totals[what])
            rows += [(what, int(keys[i]), int(c[i])) for i in np.lexsort((keys, -c))[:OWN]]
        rows.append((2, 0, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)), pa.array([r[2] for r in rows], pa.int64())], names=["what", "k", "c"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, n_rows // sampled))) == 0)
    counted = materialize(sample.mapInArrow(count, "what int, k long, c long").groupBy("what", "k").agg(F.sum("c").alias("c")), "common-words")
    top = {what: counted.where(F.col("what") == what).orderBy(F.desc("c"), "k").limit(OWN).collect() for what in (0, 1, 2)}  # bounded by their limits
    least = share * sum(r.c for r in top[2])
    hashes = lambda found: np.unique(np.array([r.k for r in found], np.int64)).view(np.uint64)
    ascending = lambda found: np.sort(hashes(found))
    words = [r for r in top[0] if r.c > least]
    heavy_words = np.unique(np.r_[ascending(words), START])
    common = np.array([r.k for r in top[0]], np.int64).view(np.uint64)  # by falling count
    return Places(shards, side, heavy_words, ascending([r for r in top[1] if r.c > least]), common)


def _merged(packets: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct triples of several packets with summed times: (key, u, v, w, times), keys ascending."""
    u, v, w, times = (np.concatenate([p[i] for p in packets]) for i in range(4))
    keys, first, times = summed(mixed(u, v, w), times)
    return keys, u[first], v[first], w[first], times


def _by_shard(rows: Iterator[pa.RecordBatch], column: str = "shard") -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one shard, of a partition sorted by it."""
    shard, held = None, []
    for batch in rows:
        for row in batch.to_pylist():
            if row[column] != shard and held:
                yield shard, held
                held = []
            shard = row[column]
            held.append(row)
    if held:
        yield shard, held


def _shipped(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["kind", "shard", "key", "numbers", "packet"])


def _split(kind: str, keys: np.ndarray, shards: int, pack) -> list[tuple]:
    """A row for each shard that keys fall in, holding pack(places of its entries)."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    return [(kind, int(shard[order[a]]), 0, [], pack(order[a:b])) for a, b in runs_of(shard[order])]


def train(docs: DataFrame, fold: int = 1, shard_bytes: int = 16 << 20, chunk_bytes: int = 9 << 20, fan: int = 4096) -> Model:
    """Count word triples of all documents but those of the fold, and lay the model out in the shared folder.

    Shards hold shard_bytes of text. A scan task counts triples in chunks and sends each chunk in at most `fan` packets,
    one a shard or a range of shards, so packets grow with the text; ranges are merged and dealt again, fan ways a
    level. A shard's task sums its triples and writes one file of sorted arrays: triples, their contexts (pairs),
    continuations of pairs, and of words.
    What lies spread over shards (heavy words, heavy pairs, all words' counts) is sent on and summed by hash. The driver
    reads a fixed number of sums. Null ids are trained on; null and empty texts are the end alone; repeated rows count
    each; nothing to train on leaves a uniform model.
    """
    spark = docs.sparkSession
    rows = text_bytes(docs).where(fold_for_lm(F.col("doc_id")) != fold)
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(8, -(-n_bytes // shard_bytes))
    width = 1  # shards in one range of the first dealing
    while width * fan < shards:
        width *= fan
    places = choose_places(rows, n_rows, shards, -(-shards // 4))
    folder = posix_path(shared_path(spark, "ngram"))
    os.makedirs(folder, exist_ok=True)

    def packets(u, v, w, times, width: int) -> pa.RecordBatch:
        """A packet for each range of `width` shards."""
        code = Packets(places.common)
        ranges = places.shard(u, v, w) // width
        order = np.argsort(ranges, kind="stable")
        u, v, w, times, ranges = (x[order] for x in (u, v, w, times, ranges))
        runs = runs_of(ranges)
        made = [code.pack(u[a:b], v[a:b], w[a:b], times[a:b]) for a, b in runs]
        return pa.RecordBatch.from_arrays([pa.array([int(ranges[a]) for a, _ in runs], pa.int32()), pa.array(made, pa.binary())], names=["shard", "packet"])

    def chunks(batches):
        held, size = [], 0
        for batch in bounded(batches, "text"):
            u, v, w, _ = triples(batch.column(1))
            held.append((u, v, w, np.ones(len(u), np.int64)))
            size += batch.column(1).nbytes
            if size >= chunk_bytes:
                yield packets(*_merged(held)[1:], first_width)
                held, size = [], 0
        if held:
            yield packets(*_merged(held)[1:], first_width)

    def again(width):
        def run(batches):
            code = Packets(places.common)
            for _, found in _by_shard(batches):
                held, size = [], 0
                for row in found:
                    held.append(code.unpack(row["packet"]))
                    size += len(held[-1][0])
                    if 6 * size >= chunk_bytes:
                        yield packets(*_merged(held)[1:], width)
                        held, size = [], 0
                if held:
                    yield packets(*_merged(held)[1:], width)

        return run

    def gram_files(batches):
        code = Packets(places.common)
        for s, found in _by_shard(batches):
            keys, u, v, w, times = _merged([code.unpack(r["packet"]) for r in found])
            pair, next_ = mixed(u, v), mixed(v, w)
            levels_of = lambda x: (x == 1, x == 2, x >= 3)
            contexts, _, *stats = summed(pair, times, *levels_of(times))
            stats = np.stack(stats, axis=1)
            wide, _ = among(contexts, places.pairs)
            spread, _ = among(v, places.words)
            own = np.flatnonzero(~spread)
            nexts, first, after = summed(next_[own], np.ones(len(own), np.int64))
            middles, _, *mid = summed(v[own][first], after, *levels_of(after))
            save(
                f"{folder}/gram-{s}",
                build(keys, times[:, None]) + build(contexts[~wide], stats[~wide]) + build(nexts, after[:, None]) + build(middles, np.stack(mid, axis=1)),
            )
            words, _, count = summed(w, times)
            known, i = among(words, (followed := summed(w[own][first], np.ones(len(first), np.int64)))[0])
            before = np.where(known, followed[2][i], 0) if known.any() else np.zeros(len(words), np.int64)
            out = _split("word", words, places.side, lambda at: code.pack_words(words[at], count[at], before[at]))
            at = np.flatnonzero(spread)
            far, first, far_after = summed(next_[at], np.ones(len(at), np.int64))
            far_v, far_w = v[at][first], w[at][first]

            def far_packet(at):
                return code.pack(np.full(len(at), END), far_v[at], far_w[at], far_after[at])

            out += _split("next", far, places.side, far_packet)
            out.append(("order 3", 0, 0, [int((times == k).sum()) for k in (1, 2, 3, 4)], None))
            out.append(("order 2", 0, 0, [int((after == k).sum()) for k in (1, 2, 3, 4)], None))
            out += [("heavy pair", 0, int(k), [int(x) for x in row], None) for k, row in zip(contexts[wide].view(np.int64), stats[wide], strict=True)]
            yield _shipped(out)

    def next_files(batches):
        code = Packets(places.common)
        for s, found in _by_shard(batches):
            _, v, w, after = (np.concatenate(x) for x in zip(*(code.unpack(r["packet"]) for r in found), strict=True))
            keys, first, after = summed(mixed(v, w), after)
            save(f"{folder}/next-{s}", build(keys, after[:, None]))
            heavy, _, *stats = summed(v[first], after, after == 1, after == 2, after >= 3)
            words, _, before = summed(w[first], np.ones(len(first), np.int64))
            out = _split("word", words, places.side, lambda at: code.pack_words(words[at], np.zeros(len(at)), before[at]))
            out.append(("order 2", 0, 0, [int((after == k).sum()) for k in (1, 2, 3, 4)], None))
            out += [("heavy word", 0, int(k), [int(x) for x in row], None) for k, row in zip(heavy.view(np.int64), np.stack(stats, axis=1), strict=True)]
            yield _shipped(out)

    def word_files(batches):
        code = Packets(places.common)
        for s, found in _by_shard(batches):
            words, _, count, before = summed(*(np.concatenate(x) for x in zip(*(code.unpack_words(r["packet"]) for r in found), strict=True)))
            save(f"{folder}/word-{s}", build(words, np.stack([count, before], axis=1)))
            sums = [len(words), int(count.sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), int((before >= 3).sum())]
            yield _shipped([("order 1", 0, 0, sums, None)])

    first_width = width
    dealt = lambda df, n: df.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard")
    sent = rows.mapInArrow(chunks, "shard int, packet binary")
    while width > 1:
        width //= fan
        ranges = -(-shards // (width * fan))
        sent = sent.withColumn("salt", F.pmod(F.xxhash64("packet"), F.lit(-(-shards // ranges))))
        sent = sent.repartition(shards, "shard", "salt").sortWithinPartitions("shard").select("shard", "packet").mapInArrow(again(width), "shard int, packet binary")
    grams = materialize(dealt(sent, shards).mapInArrow(gram_files, SHIPPED), "ngram-grams")
    nexts = materialize(dealt(grams.where("kind = 'next'"), places.side).mapInArrow(next_files, SHIPPED), "ngram-nexts")
    words = dealt(grams.union(nexts).where("kind = 'word'"), places.side).mapInArrow(word_files, SHIPPED)
    sums = grams.union(nexts).where("packet is null").union(words).groupBy("kind", "key")
    sums = sums.agg(*[F.sum(F.get("numbers", F.lit(i))).alias(f"n{i}") for i in range(8)]).collect()  # a row for each order, heavy word and heavy pair
    total = {r.kind: [r[f"n{i}"] or 0 for i in range(8)] for r in sums if r.kind.startswith("order")}
    distinct, tokens, pairs, *n, three = total.get("order 1", [0] * 8)
    heavy = []
    for kind, keys in (("heavy word", places.words), ("heavy pair", places.pairs)):
        stats = {r.key: [r[f"n{i}"] for i in range(4)] for r in sums if r.kind == kind}
        heavy.append(np.array([stats.get(k, [0] * 4) for k in keys.view(np.int64).tolist()], np.int64).reshape(-1, 4))
    d = [discounts(np.array(n)), *(discounts(np.array(total.get(f"order {k}", [0] * 4))) for k in (2, 3))]
    tail = float((d[0][1] * n[0] + d[0][2] * n[1] + d[0][3] * three) / pairs) if pairs else 1.0
    return Model(folder, places, heavy[0], heavy[1], d, int(tokens), int(distinct), int(pairs), tail)


def score(docs: DataFrame, model: Model, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Words are runs of other than ASCII white space, A-Z lower-cased, and one end closes each text. base_score: log10 of
    add-half unigram probabilities. score: log10 probability by interpolated modified Kneser-Ney of order 3: counts of
    triples, then numbers of different words before a pair, then before a word, then a uniform distribution over the
    vocabulary and one unknown word. Null and empty texts are the end alone. Null ids are trained on. Repeated rows are
    scored each. Nothing to train on leaves a uniform model. An empty table gives no rows. Other columns are not read.
    """
    n, v = model.tokens, model.distinct

    def run(batches):
        for batch in bounded(batches, "text", max_bytes=3 << 20):
            *grams, counts = triples(batch.column(1))
            starts = np.cumsum(counts) - counts
            logs, seen = model.score(*grams)
            base = np.log10((seen + 0.5) / (n + 0.5 * (v + 1)))
            arrays = [
                batch.column(0), pa.array(counts), pa.array(np.add.reduceat((seen > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(logs, starts)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = text_bytes(docs).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    held = (fold_for_lm(F.col("doc_id")) == fold).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """scored with perplexity: 10 to the mean negative log10 probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
