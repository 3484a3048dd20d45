"""SimHash near-duplicate groups: pivot distance tables over fingerprints, exact at any group size."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratocast.llm.common import bounded, materialize, posix_path, shared_path, unused_name

#: Reference fingerprints of the distance table: multiples of an odd constant, so they differ in about half of the bits.
PIVOTS = np.array([(i * 0x9E3779B97F4A7C15 ^ (i << 29)) & (2**64 - 1) for i in range(1, 17)], dtype=np.uint64)
LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit SimHash for each text: XXH64 of its word shingles, a bit set if in over half of them; none: 0."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split() if text else ()
        if words:
            before = len(hashes)
            if len(words) < width:
                hashes.append(digest(join(words), seed))
            else:
                hashes += [digest(s, seed) for s in map(join, zip(*(words[j:] for j in range(width))))]
            counts[i] = len(hashes) - before
    out = np.zeros(len(texts), dtype=np.uint64)
    if not hashes:
        return out
    h = np.array(hashes, dtype=np.uint64)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    # a byte lane holds at most 255 ones, so each text is summed in runs of 255 shingles
    runs = -(-counts[full] // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts, runs) + (np.arange(runs.sum()) - np.repeat(first, runs)) * 255
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & LANES, cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)  # little-endian: lane j is bit 8j + bit
        ones = (2 * sums > counts[full][:, None]).astype(np.uint64)
        out[full] |= (ones << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(bit))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: dict[str, F.Column] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the columns `also` names, of every whole text."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *[c.alias(n) for n, c in (also or {}).items()])
    names = ["doc_id", *source.columns[2:], "fp"]

    def run(batches):
        for batch in bounded(batches, "text", max_bytes=4 << 20):
            fp = fingerprints_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(fp.view(np.int64))], names=names)

    return source.mapInArrow(run, source.drop("text").withColumn("fp", F.lit(0).cast("long")).schema)


def _children(mask: int) -> list[int]:
    """The bits outside mask cut into four runs; each joined to mask. Two equal fingerprints but for 3 bits agree on one."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << int(b) for b in part) for part in np.array_split(free, 4) if len(part)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >> 63 else mask


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each index's component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_in_groups(group: np.ndarray, fp: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fp, least linked fp) inside runs of equal group: a forest with the components of all pairs.

    Pairs whose distances to some pivot differ by more than most cannot be within most of each other (triangle
    inequality): the table discards them pivot by pivot, and only survivors are compared.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    lefts, rights = [], []
    step, at = 1, np.arange(max(len(fp) - 1, 0))
    while len(at):
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        left = at
        for p in range(table.shape[1]):
            if not len(left):
                break
            left = left[np.abs(table[left, p] - table[left + step, p]) <= most]
        left = left[np.bitwise_count(fp[left] ^ fp[left + step]) <= most]
        lefts.append(left)
        rights.append(left + step)
        step += 1
    if not lefts:
        return fp[:0], fp[:0]
    a, b = np.concatenate(lefts), np.concatenate(rights)
    touched, inverse = np.unique(np.r_[a, b], return_inverse=True)
    root = touched[_roots(len(touched), inverse[: len(a)], inverse[len(a) :])]
    moved = root != touched
    return fp[touched[moved]], fp[root[moved]]


def hamming_links(distinct: DataFrame, most: int = 3, group_rows: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints within most (at most 3) bits, reduced to a forest for each bucket.

    Fingerprints that differ in at most 3 bits agree on one of 4 runs of bits: each is dealt to 4 buckets keyed by one
    run. A bucket with more than group_rows members is dealt again on 4 runs of its remaining bits, and so on: every
    pair stays together in some bucket, no bucket is capped, and none can exceed 2**(free bits). Inside a bucket the
    pivot table finds the pairs.
    """
    if not 0 <= most <= 3:
        raise ValueError("buckets of four runs find pairs within at most 3 bits")

    def dealt(df, masks):
        keys = F.explode(F.array(*[F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for m in masks]))
        return df.select("fp", keys.alias("k")).select("fp", "k.mask", "k.key")

    def pairs(batches):
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table):
            mask, key, fp = (rows[c].to_numpy() for c in ("mask", "key", "fp"))
            if not len(fp):
                return None
            group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            a, b = linked_in_groups(group, fp.view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1])) if len(key) else key
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut and (done := solve(rows.slice(0, cut))) is not None:
                yield done
            held = rows.slice(cut).combine_chunks().to_batches()
        if held and (done := solve(pa.Table.from_batches(held))) is not None:
            yield done

    spark = distinct.sparkSession
    level = [0]
    todo = dealt(distinct, _children(0))
    found = []
    while True:
        level = sorted({c for m in level for c in _children(m)})
        crowded = todo.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("mask", "key")
        crowded = materialize(crowded, "simhash-crowded")
        again = not crowded.isEmpty()
        settled = todo.join(crowded, ["mask", "key"], "left_anti") if again else todo
        found.append(settled.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(pairs, "a long, b long"))
        if not again:
            break
        rest = todo.join(crowded, ["mask", "key"], "left_semi")
        nexts = F.create_map(*[x for m in level for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(c)).cast("long") for c in _children(m)]))])
        todo = materialize(
            rest.select("fp", F.explode(nexts[F.col("mask")]).alias("mask")).distinct().select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")),
            "simhash-level",
        )
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links.distinct() if spark else links


def join_on_key(rows: DataFrame, facts: DataFrame, key: str, n_rows: int, most_hot: int = 65_536, floor: int = 100) -> DataFrame:
    """rows joined to the one facts row of their key; facts has n, how many rows hold it.

    Keys with over floor rows and over n_rows / most_hot of them, at most most_hot keys, meet their rows by broadcast, so
    no task of the shuffled join gets more than that share of the rows for one key.
    """
    hot = F.col("n") > max(n_rows // most_hot, floor)
    if n_rows <= floor or facts.where(hot).isEmpty():
        return rows.join(facts.drop("n"), key)
    often, seldom = facts.where(hot).drop("n"), facts.where(~hot).drop("n")
    flagged = rows.join(F.broadcast(often.select(key, F.lit(True).alias("hot"))), key, "left").where("hot is null").drop("hot")
    return rows.join(F.broadcast(often), key).unionByName(flagged.join(seldom, key))


def connected(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component), for every node of the links (a, b).

    Alternating large-star and small-star steps, each written to the shared folder; the driver sees two sums a round.
    A round counts each node's links first: no node that has both a smaller and a greater one, or two smaller, means that
    all links are stars, and the nodes' least neighbours are the answer. Nodes with many links meet them by broadcast
    (see join_on_key).
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.select("u", "v", F.lit(1).alias("up")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        nodes = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"), F.sum("up").alias("up"))
        nodes = materialize(nodes.select("u", F.least("m", "u").alias("m"), "n", "up"), "nodes")
        within = (F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))
        n_links, unsettled = nodes.agg(F.sum("n"), F.sum(within.cast("long"))).first()
        if not unsettled:
            return nodes.select(F.col("u").alias("node"), F.col("m").alias("root"))
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = join_on_key(up, nodes.where("n > up").select("u", "m", (F.col("n") - F.col("up")).alias("n")), "u", n_links // 2).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        ends = F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = materialize(small.select(ends).where("u <> v").distinct(), "star")


def near_duplicates(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable), component_fp for every row.

    Words are runs of other than ASCII white space, A-Z lower-cased; shingles are 3 words with repeats, the whole
    sequence if fewer. Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null
    id get a component as all do, but lend it no id: the component of none but such rows is null. Repeated rows are
    returned as often as they stand. An empty table gives no rows. Other columns are not read.

    Exact copies meet in one row per fingerprint by map-side aggregation. The joins back, to a component's fingerprints
    and to a fingerprint's rows, send hot keys by broadcast (see join_on_key), so no group is shuffled to one task.
    """
    out = components(materialize(fingerprints(docs, id_col, text_col), "fingerprints"), most)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), "component_id", "component_fp")


def components(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, fp and others) with component_fp, the least fingerprint reachable, and component_id, the least doc_id."""
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "classes")
    roots = connected(hamming_links(classes.select("fp"), most))
    labelled = classes.join(roots, classes.fp == roots.node, "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("component_fp"))
    labelled = materialize(labelled, "labelled")
    ids = labelled.groupBy("component_fp").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    n_classes = classes.count()
    known = materialize(join_on_key(labelled.select("fp", F.col("n").alias("rows"), "component_fp"), ids, "component_fp", n_classes), "components")
    return join_on_key(rows, known.withColumnRenamed("rows", "n"), "fp", rows.count())


def _places(docs: DataFrame) -> list[F.Column]:
    """File and place in it of each row of a scan, whatever its own columns are called; raises for other tables."""
    hidden = docs.metadataColumn("_metadata")
    found = [hidden["file_path"], hidden["row_index"]]
    docs.select(*found)
    return found


def keep_one_of_each(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each near-duplicate group, with all its columns.

    Rows are judged by their own text: of the fingerprints in a group that stand beside its smallest id (beside null, if
    it has no other), the least is kept, in one row. Rows that share an id but no group thus all stay. An empty table
    gives an empty one.

    No text is shuffled: rows are known by file and place in it. The places that stay are written to the shared folder, a
    list for each file of docs, and each scan task reads the lists of its own files. Tables that are no plain scan of
    files are written to the shared folder first.
    """
    try:
        places = _places(docs)
    except AnalysisException:  # not a scan of files
        docs = materialize(docs, "documents")
        places = _places(docs)
    rows = materialize(fingerprints(docs, id_col, text_col, {"file": places[0], "place": places[1]}), "fingerprints")
    found = components(rows, most).where("doc_id <=> component_id")
    # the hex digits order fingerprints as unsigned numbers
    chosen = found.groupBy("component_fp").agg(F.min(F.struct(F.lpad(F.hex("fp"), 16, "0").alias("digits"), "file", "place")).alias("row")).select("row.file", "row.place")
    folder = posix_path(shared_path(docs.sparkSession, "kept"))
    os.makedirs(folder, exist_ok=True)
    list_of = lambda file: f"{folder}/{xxhash.xxh64_hexdigest(file)}.npy"

    def write(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        path = list_of(key[0].as_py())
        partial = f"{path}.{os.getpid()}.{id(table)}"
        with open(partial, "wb") as f:
            np.save(f, np.sort(table["place"].to_numpy()))
        os.replace(partial, path)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    chosen.groupBy("file").applyInArrow(write, "n long").agg(F.sum("n")).collect()
    file, place = unused_name(docs, "file"), unused_name(docs, "place")
    kind = docs.schema

    def keep(batches):
        lists: dict[str, np.ndarray] = {}
        for batch in batches:
            files, at = batch.column(batch.num_columns - 2).dictionary_encode(), batch.column(batch.num_columns - 1).to_numpy()
            kept, codes = np.zeros(batch.num_rows, bool), files.indices.to_numpy()
            for i, name in enumerate(files.dictionary.to_pylist()):
                if name not in lists:
                    lists[name] = np.load(list_of(name)) if os.path.exists(list_of(name)) else np.zeros(0, np.int64)
                kept |= (codes == i) & np.isin(at, lists[name])
            yield pa.RecordBatch.from_arrays(batch.columns[:-2], names=batch.schema.names[:-2]).filter(pa.array(kept))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], places[0].alias(file), places[1].alias(place)).mapInArrow(keep, kind)
