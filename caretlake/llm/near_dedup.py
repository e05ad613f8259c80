"""Near-duplicates by banded MinHash, sequential Bayesian pruning and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake.llm import minhash as mh
from caretlake.llm.common import Scratch, arrow_map, text_bytes
from caretlake.llm.components import components
from caretlake.session import maybe_broadcast

# Links join texts of at least this similarity: 100 * both >= 85 * either.
PERCENT = 85

# A corpus keeps one of the texts of this similarity.
KEEP_PERCENT = 80

# A similar pair is pruned by a look at the signatures with at most this probability.
MISS = 1e-7

# Blocks of a mixed bucket: so many documents, so many shingles of them, on average.
BLOCK_ROWS = 1024
BLOCK_SHINGLES = 1 << 20

# Candidates of up to so many bytes, counted, are broadcast to find their texts.
OWNER_BYTES = 16 << 20


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int = mh.BANDS) -> DataFrame:
    """(id, text_hash, n_shingles, node, sig): digest of the shingle set, and its signature."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes, factors = mh.WordHashes(), mh.multipliers(bands * mh.BAND_ROWS)
        for batch in batches:
            sets = [mh.shingle_set(t, hashes) for t in batch["text"]]
            yield {"id": batch["id"], "text_hash": batch["text_hash"],
                   "n_shingles": [len(s) for s in sets],
                   "node": [mh.set_digest(s) if len(s) else None for s in sets],
                   "sig": [mh.signature(s, factors).tobytes() if len(s) else None for s in sets]}

    return arrow_map(_texts(docs, id_col, text_col), run, f"id {kind}, text_hash bigint, "
                     "n_shingles bigint, node binary, sig binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_bytes(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                       text.alias("text"))


def candidate_sets(docs: DataFrame, id_col: str, text_col: str, rows: DataFrame,
                   wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, set) of the wanted nodes, recomputed from the text of one row of each.

    Few documents are near others, so sets are not kept when signatures are made. Rows
    repeating an id and a text answer together and are reduced to one.
    """
    rows = rows.select("node", "id", "text_hash").filter("node IS NOT NULL")
    owners = (rows.join(maybe_broadcast(wanted, OWNER_BYTES), "node")
              .groupBy("node", "id", "text_hash").agg(F.count("*").alias("copies"))
              .groupBy("node").agg(F.min(F.struct("id", "text_hash", "copies")).alias("o"))
              .select("node", "o.*").withColumnRenamed("id", "owner"))
    owners = maybe_broadcast(scratch.write(owners, "owners"), OWNER_BYTES)
    texts = _texts(docs, id_col, text_col).join(owners, "text_hash").filter(
        F.col("id").eqNullSafe(F.col("owner"))).select("node", "copies", "text")

    def run(batches):
        hashes = mh.WordHashes()
        for batch in batches:
            yield {"node": batch["node"], "copies": batch["copies"],
                   "set": [mh.shingle_set(t, hashes).tobytes() for t in batch["text"]]}

    sets = scratch.write(arrow_map(texts, run, "node binary, copies bigint, set binary"), "sets")
    once = sets.filter("copies = 1").select("node", "set")
    return once.union(sets.filter("copies > 1").select("node", "set").dropDuplicates(["node"]))


def band_rows(reps: DataFrame, bands: int = mh.BANDS) -> DataFrame:
    """(bucket, node, n_shingles): one row per band of every signature."""
    width = 4 * mh.BAND_ROWS
    keys = [F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width))
            for b in range(bands)]
    return reps.select(F.explode(F.array(*keys)).alias("bucket"), "node", "n_shingles")


def prune(pairs: DataFrame, reps: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b) whose signatures pass every look at the posterior."""
    sig = reps.select("node", "sig")
    rows = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(batches):
        for batch in batches:
            left, right = (_matrix(batch[c]) for c in ("sa", "sb"))
            passed = np.flatnonzero(mh.survivors(left, right, bounds) >= 0)
            yield {"a": [batch["a"][i] for i in passed], "b": [batch["b"][i] for i in passed]}

    return arrow_map(rows, run, "a binary, b binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    rows = (pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b"))

    def run(batches):
        for batch in batches:
            kept = []
            for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    kept.append(i)
            yield {"a": [batch["a"][i] for i in kept], "b": [batch["b"][i] for i in kept]}

    return arrow_map(rows, run, "a binary, b binary")


def _matrix(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint32).reshape(len(signatures), -1)


def block_links(part: np.ndarray, label: np.ndarray, sig: np.ndarray, sets: list[np.ndarray],
                bounds: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Links that join different labels of one block, or of a pair of blocks.

    part: the block of every row. With two blocks, pairs inside one are left to the task
    that has it alone. Rows that a link has joined are not compared any more, so the links
    are a spanning forest of the block.
    """
    links: list[tuple[int, int]] = []
    two = part.min() != part.max()
    sizes = np.array([len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    member = np.zeros(local.max() + 1, bool)
    label = np.unique(label, return_inverse=True)[1]
    for x in range(len(sets) - 1):
        rest = np.arange(x + 1, len(sets))
        open_ = label[rest] != label[x]
        if two:
            open_ &= part[rest] != part[x]
        rest = rest[open_]
        if not len(rest):
            continue
        passed = mh.survivors(np.broadcast_to(sig[x], (len(rest), sig.shape[1])), sig[rest], bounds)
        rest = rest[passed >= 0]
        if not len(rest):
            continue
        own = local[starts[x]:starts[x + 1]]
        member[own] = True
        spans = [local[starts[y]:starts[y + 1]] for y in rest]
        counts = np.add.reduceat(member[np.concatenate(spans)].astype(np.int64),
                                 np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]))
        member[own] = False
        for y in rest[100 * counts >= percent * (sizes[x] + sizes[rest] - counts)]:
            if label[y] != label[x]:
                links.append((x, int(y)))
                label[label == label[y]] = label[x]
    return links


def mixed_links(rows: DataFrame, bounds: list[tuple[int, int]], percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket.

    rows: (bucket, i, j, part, node, component, sig, set), all of a (bucket, i, j) in one
    partition and together. One such block or pair of blocks is in memory at a time.
    """

    def links(group):
        found = block_links(
            np.array(group["part"]), np.array(group["component"], dtype="S16"),
            _matrix(group["sig"]), [np.frombuffer(s, np.uint64) for s in group["set"]],
            bounds, percent) if len(group["node"]) > 1 else []
        return [(group["node"][x], group["node"][y]) for x, y in found]

    names = ["part", "node", "component", "sig", "set"]

    def run(batches):
        held, key = {n: [] for n in names}, None
        for batch in batches:
            out = []
            keys = list(zip(batch["bucket"], batch["i"], batch["j"]))
            cuts = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            for start, end in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[start] != key and held["node"]:
                    out += links(held)
                    held = {n: [] for n in names}
                key = keys[start]
                for n in names:
                    held[n] += batch[n][start:end]
            yield {"a": [x for x, _ in out], "b": [y for _, y in out]}
        if held["node"]:
            out = links(held)
            yield {"a": [x for x, _ in out], "b": [y for _, y in out]}

    return arrow_map(rows, run, "a binary, b binary")


def _mixed_blocks(multi: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets that hold several components, dealt into pairs of blocks.

    Buckets of the same members in different bands are taken once.
    """
    rows = scratch.write(multi.join(labels, "node", "left").select(
        "bucket", "node", "n_shingles",
        F.coalesce("component", "node").alias("component")), "labelled")
    mixed = (rows.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"),
        F.min("node").alias("least"))
        .filter("low <> high")
        .groupBy("members", "n", "shingles", "least").agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK_ROWS),
                                     F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")))
    dealt = rows.join(mixed, "bucket").withColumn(
        "part", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select(
        "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        "part", "node", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per input row: id, text_hash, n_shingles, component_id, kept.

    Texts with one set of 5-word shingles are one node. Nodes that agree in a band of their
    signatures are candidates. First every bucket's members are compared with its smallest
    node: signatures in batches, pruned when the posterior probability of a similar pair
    falls below `miss`, survivors confirmed on full sets. Then buckets that still hold
    several components are compared in blocks of bounded size, skipping what is connected
    already; only links leave a task, never pairs. A pair of `percent` similarity misses
    all bands with probability (1 - s**5)**bands: 25 bands and 4e-7 at 0.85, 40 and 1e-7 at 0.8.

    component_id is the smallest id reachable; kept marks the row that has it. Texts
    without words (null, empty, white space) are linked with nothing, not even each other.
    Rows repeating an id are texts of their own; a null id belongs to the component of its
    text and is kept only if no row there has an id. Other columns are ignored, whatever
    their names. An empty input gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    bands = mh.bands(percent / 100)
    bounds = mh.least_matches(percent / 100, miss, bands * mh.BAND_ROWS)
    rows = scratch.write(sketches(docs, id_col, text_col, bands), "sketches")
    reps = scratch.write(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("rep_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig")), "reps")

    banded = band_rows(reps, bands)
    buckets = (banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n"))
               .filter("n > 1"))
    multi = scratch.write(banded.join(buckets, "bucket").select(
        "bucket", "leader", "node", "n_shingles"), "multi")
    wanted = scratch.write(multi.select("node").distinct(), "wanted")

    sets = candidate_sets(docs, id_col, text_col, rows, wanted, scratch)

    star = multi.filter("leader <> node").select(F.col("leader").alias("a"),
                                                 F.col("node").alias("b")).distinct()
    first = scratch.write(confirm(prune(star, reps, bounds), sets, percent), "first")
    labels = components(first, scratch, "labels")

    blocks = (_mixed_blocks(multi, labels, scratch).join(reps.select("node", "sig"), "node")
              .join(sets, "node").repartition("bucket", "i", "j")
              .sortWithinPartitions("bucket", "i", "j"))
    second = scratch.write(mixed_links(blocks, bounds, percent), "second")
    joined = components(first.union(second), scratch, "components")
    scratch.free("multi", "wanted", "owners", "sets", "labelled", "first", "second")

    named = reps.select("node", "rep_id").join(joined, "node", "left").select(
        "node", "rep_id", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("rep_id").alias("component_id"))
    named = named.join(names, "component").select("node", "component_id")
    return rows.join(named, "node", "left").select(
        "id", "text_hash", "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id")).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))



def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             percent: int = KEEP_PERCENT, miss: float = MISS) -> DataFrame:
    """The rows whose id is the smallest of their component, with their own columns.

    Near copies are texts of a similarity of `percent` or more, 80 unless told otherwise.
    Rows repeating id and text stay or go together; so do rows without an id in components
    that have none.
    """
    kept = near_duplicates(docs, id_col, text_col, percent, miss).filter("kept").select(
        F.col("id").alias("__near_id"), F.col("text_hash").alias("__near_hash")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__near_id"]) & (
        F.xxhash64(text_bytes(text_col)) == kept["__near_hash"]), "left_semi")
