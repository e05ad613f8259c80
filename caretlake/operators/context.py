"""From documents and cursors to context windows, prompts and cloze sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretlake import schemas as S
from caretlake.functions import position as pos_fn
from caretlake.functions.tokens import tokens
from caretlake.operators.skew import spread_join, wanted_only
from caretlake.session import BROADCAST_BYTES, byte_size

# Lines per slice in `line_index`; offsets inside a slice are summed row by row.
_LINES_PER_SLICE = 1024


def line_index(docs: DataFrame, key: str = "uri", text: str = "text") -> DataFrame:
    """One row per line: (key, line_no, start, line).

    Offsets are summed inside the row that holds the document, in slices of lines, so
    nothing is shuffled and a document of a million lines stays cheap.
    """
    step = F.lit(_LINES_PER_SLICE)
    lines = docs.select(key, F.split(text, "\n", -1).alias("_lines"))
    starts = F.sequence(F.lit(0), F.floor((F.array_size("_lines") - 1) / step).cast("int"))
    sliced = lines.select(
        key, F.transform(starts, lambda s: F.slice("_lines", s * step + 1, step)).alias("_slices"))
    sizes = F.transform("_slices", lambda ls: F.aggregate(
        ls, F.lit(0), lambda n, line: n + F.length(line) + 1))
    blocks = (
        sliced.select(key, "_slices", sizes.alias("_sizes"))
        .select(key, F.explode(F.transform("_slices", lambda ls, i: F.struct(
            i.alias("no"), ls.alias("lines"),
            F.aggregate(F.slice("_sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b)
            .alias("base")))).alias("_b"))
    )
    empty = F.array().cast("array<int>")
    offsets = F.aggregate(
        "_b.lines", F.struct(F.col("_b.base").alias("at"), empty.alias("all")),
        lambda acc, line: F.struct((acc.at + F.length(line) + 1).alias("at"),
                                   F.concat(acc.all, F.array(acc.at)).alias("all")),
        lambda acc: acc.all)
    rows = blocks.select(key, F.col("_b.no").alias("_no"),
                         F.arrays_zip(F.col("_b.lines").alias("line"),
                                      offsets.alias("start")).alias("_rows"))
    return rows.select(key, "_no", F.posexplode("_rows").alias("_i", "_row")).select(
        key, (F.col("_no") * step + F.col("_i")).alias("line_no"),
        F.col("_row.start").alias("start"), F.col("_row.line").alias("line"))


def attach_documents(cursors: DataFrame, docs: DataFrame, on: str = "uri") -> DataFrame:
    """Cursor ⋈ document; a cursor without a document gets `unknown_document`.

    Documents are unique by `on`. The cursors are counted (pass written or cheap rows): few
    ones are broadcast to the documents, so no text moves. Of many, the documents nobody
    points at are left out first; one that very many point at is copied, and its cursors
    are dealt over the copies.
    """
    if byte_size(cursors) <= BROADCAST_BYTES:
        # Texts stay where they are: cursors come to them, and those that found none are added.
        found = docs.select(on, "text").join(F.broadcast(cursors), on)
        known = docs.select(on).join(F.broadcast(cursors.select(on).distinct()), on, "left_semi")
        missed = cursors.join(known, on, "left_anti")
        return found.select(*cursors.columns, "text", F.lit(S.OK).alias("status")).unionByName(
            missed.select("*", F.lit(None).cast("string").alias("text"),
                          F.lit(S.UNKNOWN_DOCUMENT).alias("status")))
    found = wanted_only(docs.select(on, "text", F.lit(True).alias("_found")), cursors, [on])
    others = [F.col(c) for c in cursors.columns if c != on] or [F.col(on)]
    return spread_join(cursors, found, [on], others).withColumn(
        "status", F.when(F.col("_found"), S.OK).otherwise(S.UNKNOWN_DOCUMENT)).drop("_found")


def resolve_position(df: DataFrame, text: str = "text", line: str = "line",
                     ch: str = "ch") -> DataFrame:
    """Add `pos` and `status`; an earlier status other than `ok` is kept.

    Line start and skipped text are columns of their own, so each is worked out once.
    """
    t, n, c, start = F.col(text), F.col(line), F.col(ch), F.col("_start")
    df = df.withColumn("_before", pos_fn.text_before_line(t, n))
    df = df.withColumn("_start", pos_fn.line_start(F.col("_before"), n))
    df = df.withColumn("_skipped", F.substr(t, start + 1, c))
    status = pos_fn.position_status(t, n, c, F.col("_before"), F.col("_skipped"))
    if "status" in df.columns:
        status = F.when(F.col("status") == S.OK, status).otherwise(F.col("status"))
    df = df.withColumn("status", status)
    return df.withColumn("pos", F.when(F.col("status") == S.OK, start + c)).drop(
        "_before", "_start", "_skipped")


def context_window(df: DataFrame, text: str = "text", pos: str = "pos",
                   window: int = S.CONTEXT_WINDOW) -> DataFrame:
    """Add `prefix` and `suffix`; the character at the caret belongs to neither.

    The text is walked once, to the neighbourhood both are taken from.
    """
    p, near = F.col(pos), F.col("_near")
    left = F.least(p, F.lit(window))
    df = df.withColumn("_near", F.substr(F.col(text), p - left + 1, left + max(window, 1)))
    return df.withColumns({"prefix": pos_fn.prefix_at(near, F.when(p.isNotNull(), left), window),
                           "suffix": pos_fn.suffix_at(near, F.when(p.isNotNull(), left), window)}
                          ).drop("_near")


def mask_prompt(df: DataFrame, mask: str = S.MASK) -> DataFrame:
    """Add `prompt`; contexts that already hold the mask become `ambiguous_mask`."""
    prefix, suffix = F.col("prefix"), F.col("suffix")
    status = pos_fn.mask_status(prefix, suffix, mask)
    if "status" in df.columns:
        status = F.when(F.col("status") == S.OK, status).otherwise(F.col("status"))
    return df.withColumns({"prompt": pos_fn.prompt_of(prefix, suffix, mask), "status": status})


def cloze_places(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """Every interior word as a place: (key, …keep, pos, target), without any context.

    As long as the text, where prompts with whole contexts would be as long as its square. The
    contexts are cut by `cut_contexts` where somebody needs them.
    """
    words = docs.select(key, *keep, tokens(F.col(text)).alias("_w"))
    inner = F.slice("_w", F.lit(2), F.greatest(F.array_size("_w") - 2, F.lit(0)))
    return words.select(key, *keep, F.posexplode(inner).alias("_i", "target")).select(
        key, *keep, (F.col("_i") + 1).alias("pos"), "target")


def cut_contexts(places: DataFrame, docs: DataFrame, window: int, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Places with `prefix` and `suffix`, up to `window` words of their document on each side.

    The words of a document are split once, and places of one document meet them as numbers: a
    place that very many refer to is dealt over copies. Place and document are matched by `key`;
    places outside their document's interior have null contexts.
    """
    words = docs.select(key, tokens(F.col(text)).alias("_w"))
    met = spread_join(places, wanted_only(words, places, [key]), [key], [F.col("pos")])
    p, w, inside = F.col("pos"), F.col("_w"), F.col("pos").between(1, F.array_size("_w") - 2)
    left = F.slice(w, F.greatest(p - window, F.lit(0)) + 1, F.least(p, F.lit(window)))
    right = F.slice(w, p + 2, F.lit(window))
    return met.withColumns({
        "prefix": F.when(inside, F.array_join(left, " ")),
        "suffix": F.when(inside, F.array_join(right, " "))}).drop("_w")


def cloze_prompts(docs: DataFrame, per_doc: int | None = None, seed: int = 31,
                  unit: str = "char", window: int | None = None,
                  key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Reproducible held-out targets: (key, …keep, i, pos, prefix, suffix, target).

    `unit="char"` hides one character, with up to `window` (128) characters on each side;
    `unit="word"` one interior word, with all words of the text before and after it, or up to
    `window` of them. Draw `i` of a document with integer key `d` is
    `(d * seed + i * 17) mod n` over its n places, so every engine draws the same;
    `per_doc=None` takes every place once; for words of long texts give it a window, or every
    place carries the whole text. Contexts are cut in the row that holds the document.
    """
    if unit == "char":
        base = docs.select(key, *keep, F.col(text).alias("_t"), F.length(text).alias("_n"))
    elif unit == "word":
        base = docs.select(key, *keep, tokens(F.col(text)).alias("_w"))
        base = base.withColumn("_n", F.array_size("_w") - 2)
    else:
        raise ValueError(f"unknown cloze unit: {unit}")
    last = F.col("_n") - 1 if per_doc is None else F.lit(per_doc - 1)
    drawn = F.col("i") if per_doc is None else F.pmod(
        F.col(key) * seed + F.col("i") * 17, F.col("_n")).cast("int")
    # A text without places explodes to nothing; a filter would tokenize it a second time.
    draws = base.withColumn("i", F.explode(
        F.when(F.col("_n") > 0, F.sequence(F.lit(0), last))))
    p = F.col("pos")
    if unit == "char":
        t, window = F.col("_t"), S.CONTEXT_WINDOW if window is None else window
        return draws.withColumn("pos", drawn).select(
            key, *keep, "i", "pos", pos_fn.prefix_at(t, p, window).alias("prefix"),
            pos_fn.suffix_at(t, p, window).alias("suffix"),
            F.substr(t, p + 1, F.lit(1)).alias("target"))
    w = F.col("_w")
    if window is None:
        left, right = F.slice(w, F.lit(1), p), F.slice(w, p + 2, F.col("_n") + 2)
    else:
        left = F.slice(w, F.greatest(p - window, F.lit(0)) + 1, F.least(p, F.lit(window)))
        right = F.slice(w, p + 2, F.lit(window))
    return draws.withColumn("pos", drawn + 1).select(
        key, *keep, "i", "pos", F.array_join(left, " ").alias("prefix"),
        F.array_join(right, " ").alias("suffix"), F.element_at(w, p + 1).alias("target"))
