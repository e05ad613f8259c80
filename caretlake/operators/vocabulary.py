"""Vocabularies: building, encoding with them, completing from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.functions.tokens import tokens
from caretlake.operators.scan import numbered
from caretlake.operators.skew import spread_join
from caretlake.session import BROADCAST_BYTES, byte_size, materialize

# Items per answer row, and copies of a page when pages are too large to broadcast.
PAGE_SIZE = 4096
_SALTS = 64

# Ids of the special tokens; words follow from FIRST_WORD_ID.
PAD, UNKNOWN, BEGIN, END, MASK_ID, FIRST_WORD_ID = 0, 1, 2, 3, 4, 5


def build_vocab(docs: DataFrame, top_n: int | None = None, min_count: int = 1,
                text: str = "text") -> DataFrame:
    """Words by frequency: (idx, item, n), ties in word order; idx starts at 0."""
    words = docs.select(tokens(F.col(text)).alias("_w")).select(F.explode("_w").alias("item"))
    counts = words.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)
    order = [F.desc("n"), F.asc("item")]
    if top_n is not None:
        counts = counts.orderBy(*order).limit(top_n)
    return numbered(counts, order, "idx").select("idx", "item", "n")


def encode_batches(docs: DataFrame, vocab: DataFrame, max_length: int = S.MAX_LENGTH,
                   batch_col: str = "batch", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Word ids per document: (key, batch, input_ids, attention_mask).

    Rows are cut to `max_length` ids, begin and end included, before anything moves, and
    padded to the longest row of their batch, which is some rows of bounded length. Texts are
    tokenized once. The cut documents are shuffled once by key; words looked up in a
    broadcast vocabulary (of a counted size) then find their document again without moving as
    single rows. Of a larger vocabulary the first words, the most frequent, are broadcast; only
    words that are not among them move as single rows, frequent ones to copies.
    """
    kept = F.slice(tokens(F.coalesce(text, F.lit(""))), 1, max_length - 2)
    words = docs.select(key, batch_col, kept.alias("_w"))
    ids = vocab.select(F.col("item").alias("_word"), (F.col("idx") + FIRST_WORD_ID).cast("int").alias("_id"))
    placed = words.repartition(key).select(key, batch_col, F.posexplode_outer("_w").alias("_pos", "_word"))
    size = byte_size(ids)
    near, rest = ids, None
    if size > BROADCAST_BYTES:
        near, rest = _first_words(ids, size)
    known = placed.join(F.broadcast(near), "_word", "left")
    if rest is None:
        known = known.withColumn("_id", F.when(F.col("_word").isNotNull(), F.coalesce("_id", F.lit(UNKNOWN))))
    # A group holds the words of one document, max_length of them at most.
    found = F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_pos", "_id")))
    rows = known.groupBy(key, batch_col).agg(found.alias("_ids"))
    if rest is not None:
        others = spread_join(known.filter(F.col("_word").isNotNull() & F.col("_id").isNull()).drop("_id"),
                             rest, ["_word"], [F.col(key), F.col("_pos")])
        others = others.withColumn("_id", F.coalesce("_id", F.lit(UNKNOWN))).groupBy(
            F.col(key).alias("_key"), F.col(batch_col).alias("_batch")).agg(found.alias("_others"))
        rows = rows.join(others, rows[key].eqNullSafe(others["_key"])
                         & rows[batch_col].eqNullSafe(others["_batch"]), "left")
        rows = rows.select(key, batch_col, F.when(F.col("_others").isNull(), F.col("_ids")).otherwise(
            F.concat("_ids", "_others")).alias("_ids"))
    # Only the ids themselves, in order, go on to their batch.
    rows = rows.select(key, batch_col, F.transform(
        F.sort_array("_ids"), lambda e: e["_id"]).alias("_ids"))
    rows = rows.withColumn("_longest", F.max(F.array_size("_ids") + 2).over(Window.partitionBy(batch_col)))
    padding = F.col("_longest") - F.array_size("_ids") - 2
    return rows.select(
        key, batch_col,
        F.concat(F.array(F.lit(BEGIN)), F.col("_ids"), F.array(F.lit(END)),
                 F.array_repeat(F.lit(PAD), padding)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.array_size("_ids") + 2),
                 F.array_repeat(F.lit(0), padding)).alias("attention_mask"))


def _first_words(ids: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """`ids` (of `size` bytes) parted at an id: as many first words as may be broadcast, the rest."""
    low, high = ids.agg(F.min("_id"), F.max("_id")).first()
    count = (high - low + 1) * BROADCAST_BYTES // size
    while byte_size(ids.filter(F.col("_id") < low + count)) > BROADCAST_BYTES:
        count //= 2
    return ids.filter(F.col("_id") < low + count), ids.filter(F.col("_id") >= low + count)


def vocab_pages(vocab: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """(page, labels): the ordered vocabulary in pages of at most `page_size` items."""
    return vocab.groupBy(F.expr(f"idx div {page_size}").cast("int").alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "item"))),
                    lambda e: e["item"]).alias("labels"))


def vocab_complete(requests: DataFrame, vocab: DataFrame, page_size: int = PAGE_SIZE,
                   of_page: dict[str, Column] | None = None) -> DataFrame:
    """Every request gets the whole vocabulary in order: requests plus (page, labels).

    One row per request and page, so an ordinary vocabulary makes one row per request
    and a huge one never becomes a single value. Pages of a checked size are broadcast,
    others meet the requests in a salted shuffle. Pass a written or materialized `vocab`.

    `of_page` are columns of a page's `labels` that take their place: all requests have the same
    pages, so they are worked out once per page, and no labels move with the requests.
    """
    size = vocab.agg(F.max("idx")).first()[0]
    if size is None:
        none = requests.withColumns({"page": F.lit(0), "labels": F.array().cast("array<string>")})
        return none if of_page is None else none.withColumns(of_page).drop("labels")
    last_page = int(size) // page_size
    pages = vocab_pages(vocab, page_size)
    if of_page is None:
        page_bytes = byte_size(vocab.select("item"))
    else:
        pages = materialize(pages.withColumns(of_page).drop("labels"))
        page_bytes = byte_size(pages)
    asked = requests.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(last_page))))
    if page_bytes <= BROADCAST_BYTES:
        return asked.join(F.broadcast(pages), "page")
    salted = pages.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    spread = asked.withColumn("_salt", F.pmod(F.xxhash64("request_id"), F.lit(_SALTS)).cast("int"))
    return spread.join(salted, ["page", "_salt"]).drop("_salt")


def limit_items(df: DataFrame, n: int | None = None, labels: str = "labels") -> DataFrame:
    """Keep the first n labels of a list in order; None keeps all."""
    return df if n is None else df.withColumn(labels, F.slice(labels, 1, n))


def labels_to_items(labels: Column) -> Column:
    return F.transform(labels, lambda label: F.struct(label.alias("label")))


def completion_items(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Ordered labels as `items ARRAY<STRUCT<label>>`, the body of a response.

    Takes label lists, or candidate rows (request_id, rank, label), of which a request
    has k at most.
    """
    if labels in df.columns:
        return df.withColumn("items", labels_to_items(F.col(labels)))
    listed = df.groupBy("request_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("_ranked"))
    return listed.select("request_id", F.transform(
        "_ranked", lambda e: F.struct(e["label"].alias("label"))).alias("items"))
