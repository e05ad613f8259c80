"""Best-fit packing planned on a histogram of lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from caretlake.llm.common import Scratch, arrow_map
from caretlake.llm.token_ids import byte_bpe

MAX_TOKENS = 2048
END_ID = 0

SLOTS = T.StructType([T.StructField(n, T.LongType()) for n in
                      ("length", "first_rank", "end_rank", "first_sequence", "repeats", "place")])


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_tokens: int = MAX_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids): the ids of every text with an end id behind them.

    More than `max_tokens` are cut from the end on, so that only the first piece may be shorter.
    ids are 32-bit little-endian.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], np.uint32).tobytes()

    def run(batches):
        encoder = byte_bpe(tokenizer)
        for batch in batches:
            out = {n: [] for n in ("id", "piece", "start", "length", "ids")}
            for id_, ids in zip(batch["id"], encoder.encode(batch["text"])):
                ids += end
                first = (len(ids) // 4 - 1) % max_tokens + 1
                cuts = [0, *range(4 * first, len(ids) + 1, 4 * max_tokens)]
                for piece, (at, to) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[at:to]
                    for name, value in zip(out, (id_, piece, at // 4, len(part) // 4, part)):
                        out[name].append(value)
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return arrow_map(rows, run, f"id {kind}, piece int, start bigint, length bigint, ids binary")


def plan_slots(counts: dict[int, int], max_tokens: int = MAX_TOKENS) -> list[tuple]:
    """Best-fit decreasing over {length: count}; rows of SLOTS.

    Sequences of one remaining room are ranges of numbers. A length goes, from the longest
    down, to the ranges with the least room that is enough; a range takes it as often as it
    fits, a range that isn't used up is split. So every step works on ranges, whatever the
    counts: at most two ranges arise per length, and each takes at most 63 different
    lengths, which bounds the plan by 126 rows per length (lengths that differ sum up to
    2,048 after 63). Row: pieces of `length` ranked first_rank <= rank < end_rank go to
    first_sequence + (rank - first_rank) // repeats.
    """
    slots, next_sequence = [], 0
    rooms: list[int] = []                       # sorted, those with ranges
    ranges: dict[int, list[tuple[int, int]]] = {}

    def put(room, first, count):
        if room and count:
            if not ranges.get(room):
                insort(rooms, room)
                ranges[room] = []
            ranges[room].append((first, count))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    rooms.pop(k)
            else:
                room, first = max_tokens, next_sequence
                count = -(-left // (max_tokens // length))
                next_sequence += count
            fits = room // length
            full = min(count, left // fits)
            for bins, repeats in ((full, fits), (int(full < count), left - full * fits)):
                repeats = min(repeats, fits)
                if bins and repeats > 0:
                    taken = bins * repeats
                    slots.append((length, rank, rank + taken, first, repeats, max_tokens - room))
                    put(room - repeats * length, first, bins)
                    rank, left, first, count = rank + taken, left - taken, first + bins, count - bins
            put(room, first, count)
    return slots


def pack(pieces: DataFrame, scratch: Scratch, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """`pieces` (id, piece, length, ...) with sequence_id and place added.

    Pieces are ranked within their length: numbered inside (length, deal), the deals of a
    length put one after another. So a length that a third of all pieces share is numbered
    in as many tasks as there are deals. Only the histogram, of at most `max_tokens` rows,
    reaches the driver, and only the plan (see `plan_slots`) is broadcast.
    """
    spark = pieces.sparkSession
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.write(pieces.withColumn(
        "__deal", F.pmod(F.xxhash64("id", "piece"), F.lit(deals))), "pieces")
    counts = rows.groupBy("length", "__deal").agg(F.count("*").alias("__n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(
        F.sum("__n").alias("n")).collect()}
    slots = spark.createDataFrame(plan_slots(histogram, max_tokens), SLOTS)

    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__deal")
                               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "__deal", F.coalesce(before, F.lit(0)).alias("__before"))
    order = [F.col(c) for c in ("id", "piece")] + [F.xxhash64(*pieces.columns)]
    ranked = (rows.withColumn("__row", F.row_number().over(
        Window.partitionBy("length", "__deal").orderBy(*order)))
        .join(offsets, ["length", "__deal"])
        .withColumn("__rank", F.col("__before") + F.col("__row") - 1))
    slots = F.broadcast(slots.withColumnRenamed("length", "__length"))
    at = F.col("__rank") - F.col("first_rank")
    return ranked.join(slots, (F.col("length") == F.col("__length"))
                       & (F.col("__rank") >= F.col("first_rank"))
                       & (F.col("__rank") < F.col("end_rank"))).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(at / F.col("repeats"))).alias("sequence_id"),
        (F.col("place") + at % F.col("repeats") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = MAX_TOKENS, tokenizer: str | None = None,
                   keep_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, ids.

    Sequences hold at most `max_tokens` ids and have no gaps; a text of more ids is cut.
    Without `keep_ids` the ids are reduced to their checksum before rows are shuffled.

    A null text counts as empty and makes a piece of the end id alone, as does an empty
    one. Rows repeating an id are documents of their own; null ids are allowed. Other
    columns are ignored, whatever their names. An empty input gives an empty result.
    """
    pieces = encode_pieces(docs, id_col, text_col, max_tokens, tokenizer)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        pieces = pieces.drop("ids")
    return pack(pieces, Scratch(docs.sparkSession, "packing"), max_tokens)
