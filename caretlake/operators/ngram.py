"""The n-gram fill model: training, top-k, back-off lookup and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caretlake import schemas as S
from caretlake.functions import tokens as tk
from caretlake.operators.grams import MOVED, RANKED, asked_grams, placed_grams, ranked_grams, scored_grams
from caretlake.operators.skew import spread_join
from caretlake.session import materialize, ship

_ENTRIES = "array<struct<token:string,n:bigint>>"

# Words are hot above so many rows, if they also have more than one part in HOT_WORDS of all.
HOT_ROWS, HOT_WORDS = 100_000, 1_000

# Grams to be scored go to a place per so many words; so many words are not spelled out on the way.
PLACE_WORDS, COMMON_WORDS = 1_000_000, 1 << 16


def top_k(df: DataFrame, by: list[str], score: str, k: int = S.NUM_RESULTS,
          tie: str = "token", rank: str = "rank") -> DataFrame:
    """The k best rows per group, ties broken by `tie`; adds a 1-based rank.

    Spark limits every group to k rows per task before the shuffle (WindowGroupLimit),
    so a hot group costs k rows per task, not all of its rows.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def train_ngram(docs: DataFrame, context_size: int = 1, k: int = S.NUM_RESULTS,
                min_count: int = 1, text: str = "text") -> DataFrame:
    """Counts of the middle word by context: (level, key, token, n, rk)."""
    packed, behind = _trained(docs, context_size, k, min_count, text)
    columns = ["level", "key", "token", "n", "rk"]
    return _unpacked(packed).select(*columns).unionByName(behind.select(*columns))


def train_packed(docs: DataFrame, context_size: int = 1, k: int = S.NUM_RESULTS,
                 min_count: int = 1, text: str = "text") -> DataFrame:
    """The rows of `pack_model(train_ngram(…))`, most of them packed where they were counted."""
    packed, behind = _trained(docs, context_size, k, min_count, text)
    return packed.unionByName(pack_model(behind))


def _trained(docs: DataFrame, context_size: int, k: int, min_count: int,
             text: str) -> tuple[DataFrame, DataFrame]:
    """Packed contexts, and ranked rows of the others: those of hot words alone and the context-free one.

    Words are counted first, which gives the context-free level and the hot words: those with more
    than HOT_ROWS rows and one part in HOT_WORDS of all, which bounds their list. Grams go to the place
    of one of their context's words that isn't hot, as one row per word and batch, and are counted
    and ranked there. Contexts of hot words alone are counted at the middle word's place, by which
    at most k words of a context are left in a batch, and ranked behind that.
    """
    last = tk.level_count(context_size)
    words = docs.select(tk.tokens(F.col(text)).alias("_w"))
    inside = (F.col("_i") > 0) & (F.col("_i") < F.col("_size") - 1)
    counts = materialize(words.select(
        F.array_size("_w").alias("_size"), F.posexplode("_w").alias("_i", "token")).groupBy("token").agg(
        F.count("*").alias("_n"), F.count_if(inside).alias("n")))
    least = max(HOT_ROWS, (counts.agg(F.sum("_n")).first()[0] or 0) / HOT_WORDS)
    hot = [r.token for r in counts.filter(F.col("_n") > least).select("token").collect()]
    free = counts.filter(F.col("n") >= max(min_count, 1)).select(
        F.lit(last).alias("level"), F.lit("").alias("key"), "token", "n")

    ship(docs.sparkSession)
    moved = words.mapInArrow(placed_grams(context_size, hot), MOVED).repartition("_at")
    ranked = materialize(moved.sortWithinPartitions("_at").mapInArrow(
        ranked_grams(context_size, k, min_count), RANKED))
    some = _unpacked(ranked.filter(~F.col("whole"))).drop("rk").unionByName(free)
    return (ranked.filter("whole").select("level", "key", "entries"),
            top_k(some, ["level", "key"], "n", k, rank="rk"))


def _unpacked(packed: DataFrame) -> DataFrame:
    return packed.select("level", "key", F.posexplode("entries").alias("_i", "_e")).select(
        "level", "key", "_e.token", "_e.n", (F.col("_i") + 1).alias("rk"))


def pack_model(model: DataFrame) -> DataFrame:
    """One row per context: (level, key, entries), at most k entries each, best first.

    """
    ranked = F.sort_array(F.collect_list(F.struct("rk", "token", "n")))
    return model.groupBy("level", "key").agg(F.transform(
        ranked, lambda e: F.struct(e["token"].alias("token"), e["n"].alias("n"))).alias("entries"))


def save_model(model: DataFrame, path: str) -> None:
    """Write a model in packed form, one folder per level."""
    packed = model if "entries" in model.columns else pack_model(model)
    packed.write.mode("overwrite").partitionBy("level").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """A saved model, in packed form."""
    return spark.read.schema(
        f"key string, entries {_ENTRIES}, level int").parquet(path)


def context_words(context_size: int = 1, prefix: str = "prefix",
                  suffix: str = "suffix") -> dict[str, Column]:
    """Words next to the gap: `w1 … wc` to the left, `right` to the right."""
    left = tk.tokens(F.col(prefix))
    words = {f"w{j}": F.try_element_at(left, F.lit(-j)) for j in range(1, context_size + 1)}
    return {**words, "right": F.try_element_at(tk.tokens(F.col(suffix)), F.lit(1))}


def _labelled(entries: Column, level: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(
        e["token"].alias("label"), level.alias("level"), e["n"].alias("n")))


def _context_free(model: DataFrame, last: int) -> Column:
    """The candidates of the row without context, read once as a value of k entries.

    A model of another context size is refused: its levels mean other contexts.
    """
    free = F.max(F.when((F.col("level") == last) & (F.col("key") == ""), F.col("entries")))
    read = model.agg(free.alias("free"), F.max("level").alias("top"))
    wrong = F.raise_error(F.concat(F.lit(f"the prompts ask for {last} levels, the model has "),
                                   F.col("top").cast("string"))).cast(_ENTRIES)
    entries = F.when(F.col("top").isNull() | (F.col("top") == last), F.coalesce(
        "free", F.array().cast(_ENTRIES))).otherwise(wrong)
    return read.select(_labelled(entries, F.lit(last)).alias("candidates")).scalar()


def ngram_candidates(prompts: DataFrame, model: DataFrame, k: int = S.NUM_RESULTS,
                     context_size: int = 1) -> DataFrame:
    """Prompts plus `candidates ARRAY<STRUCT<label, level, n>>`, best first.

    The lowest level number wins for a word found at several; ranks follow
    (level, n desc, word).

    Each prompt asks for one key per level with context, and each context of the model is
    one row of at most k entries, so the join returns at most one row per prompt and level.
    Contexts that very many prompts ask for are counted first and copied. The context-free
    entries every prompt ends with are added as a value, without a join.
    """
    last = tk.level_count(context_size)
    packed = model if "entries" in model.columns else pack_model(model)
    words = prompts.select("request_id", *[
        c.alias(n) for n, c in context_words(context_size).items()])
    keys = tk.level_keys([F.col(f"w{j}") for j in range(1, context_size + 1)], F.col("right"))
    asked = words.select("request_id", F.explode(keys).alias("c")).select(
        "request_id", F.col("c.level").alias("level"), F.col("c.key").alias("key")).filter(
        F.col("key").isNotNull() & (F.col("level") < last))
    contexts = packed.filter(F.col("level") < last).select("level", "key", "entries")
    # At most one packed row per level meets in a request's group.
    hits = spread_join(asked, contexts, ["level", "key"], [F.col("request_id")], how="inner").groupBy(
        "request_id").agg(F.sort_array(F.collect_list(F.struct("level", "entries"))).alias("_hits"))

    near = F.flatten(F.transform("_hits", lambda h: _labelled(h["entries"], h["level"])))
    # Entries come in (level, n desc, word) order already; keep first appearances.
    listed = prompts.join(hits, "request_id", "left").withColumn(
        "_rest", _context_free(packed, last)).withColumn(
        "_all", F.when(F.col("_hits").isNull(), F.col("_rest")).otherwise(
            F.concat(near, F.col("_rest")))).withColumn(
        "_labels", F.transform("_all", lambda e: e["label"]))
    best = F.transform(F.slice(F.array_distinct("_labels"), 1, k), lambda label: F.get(
        "_all", (F.array_position("_labels", label) - 1).cast("int")))
    return listed.withColumn("candidates", best).drop("_hits", "_rest", "_all", "_labels")


def ngram_complete(prompts: DataFrame, model: DataFrame, k: int = S.NUM_RESULTS,
                   context_size: int = 1) -> DataFrame:
    """One row per candidate: (request_id, rank, label, level, n)."""
    listed = ngram_candidates(prompts.select("request_id", "prefix", "suffix"), model, k, context_size)
    return listed.select("request_id", F.posexplode("candidates").alias("_i", "_c")).select(
        "request_id", (F.col("_i") + 1).alias("rank"), F.col("_c.label").alias("label"),
        F.col("_c.level").alias("level"), F.col("_c.n").alias("n"))


def evaluate(predictions: DataFrame, targets: DataFrame, by: list[str] | None = None,
             k: int = S.NUM_RESULTS) -> DataFrame:
    """hit@1, hit@k, MRR and coverage, overall or by columns of `targets`.

    `predictions(request_id, rank, label)` shrink to one row per request before they
    meet the targets' groups, so a group of any size costs partial sums only.
    """
    got = predictions.filter(F.col("rank") <= k).select("request_id", "rank", "label")
    matched = targets.select("request_id", "target", *(by or [])).join(got, "request_id", "left")
    per_request = matched.groupBy("request_id", *(by or [])).agg(
        F.min(F.when(F.col("label") == F.col("target"), F.col("rank"))).alias("at"),
        F.count("rank").alias("answers"))
    return score(per_request, by)


def evaluate_candidates(listed: DataFrame, by: list[str] | None = None,
                        k: int = S.NUM_RESULTS) -> DataFrame:
    """The same scores from `candidates` lists next to their `target`: no join needed."""
    return score(_places(listed, by or [], k), by)


def evaluate_held_out(docs: DataFrame, by: list[str] | None = None, folds: int = 2,
                      context_size: int = 1, k: int = S.NUM_RESULTS, key: str = "doc_id",
                      text: str = "text", fold: Column | None = None) -> DataFrame:
    """Scores over every interior word of every document, overall or by columns of `docs`.

    A document is answered by a model of the other folds, never by its own counts. `fold` numbers
    them from 0, by a hash of `key` if not given, so rows of one key are in one fold. Words with the same neighbours have the same
    answers: they are counted first and answered once. With one word of context they are answered
    where their context is counted, and only scores leave that place.
    """
    if fold is None:
        fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    if context_size == 1:
        return score(_scored_in_place(docs, by or [], folds, k, text, fold), by, F.col("weight"))
    scored = None
    for own in range(folds):
        model = materialize(train_packed(docs.filter(fold != own), context_size, k, text=text))
        grams = docs.filter(fold == own).select(
            *(by or []), F.explode(tk.interior_grams(tk.tokens(F.col(text)), context_size)).alias("g"))
        words = [*[f"w{j}" for j in range(1, context_size + 1)], "right"]
        asked = grams.groupBy(*(by or []), *[F.col(f"g.{w}").alias(w) for w in words],
                              F.col("g.token").alias("target")).agg(F.count("*").alias("weight"))
        rows = _held_out_places(asked, model, [*(by or []), "weight"], k, context_size)
        scored = rows if scored is None else scored.unionByName(rows)
    return score(scored, by, F.col("weight"))


def _scored_in_place(docs: DataFrame, by: list[str], folds: int, k: int, text: str, fold: Column) -> DataFrame:
    """(…by, at, answers, weight) of every interior word; grams of all folds move once, to their context.

    A context is counted over all folds at one place, and a fold's model is what the others count there. What
    a gram needs from elsewhere is small and known before: the k best words of no context, those behind
    a hot word, and those of a pair that is as hot as a word (see `_trained`), of which there are fewer
    than HOT_WORDS each.
    """
    words = docs.filter(fold.isNotNull()).select(
        tk.tokens(F.col(text)).alias("_w"), fold.cast("int").alias("_fold"), *by)
    other = [F.col("_fold") != own for own in range(folds)]
    inside = (F.col("_i") > 0) & (F.col("_i") < F.col("_size") - 1)
    counts = materialize(words.select("_fold", F.array_size("_w").alias("_size"), F.posexplode("_w").alias(
        "_i", "token")).groupBy("token").agg(F.count("*").alias("_n"), *[
            F.count_if(inside & o).alias(f"n{own}") for own, o in enumerate(other)]))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    least = max(HOT_ROWS, total / HOT_WORDS)
    hot = [r.token for r in counts.filter(F.col("_n") > least).select("token").collect()]
    free = [[r.token for r in counts.filter(F.col(f"n{own}") > 0).orderBy(
        F.desc(f"n{own}"), "token").limit(k).collect()] for own in range(folds)]

    near, pairs = {}, []
    if hot:
        grams = words.select("_fold", F.explode(tk.interior_grams(F.col("_w"))).alias("g")).filter(
            F.col("g.w1").isin(hot)).select("_fold", "g.w1", "g.token", F.concat_ws(
                " ", "g.w1", "g.right").alias("pair"), F.col("g.right").isin(hot).alias("both"))
        pairs = [r.pair for r in grams.filter("both").groupBy("pair").count().filter(
            F.col("count") > least).collect()]
        listed = materialize(grams.select("_fold", "token", F.explode(F.array(
            "w1", *([F.when(F.col("pair").isin(pairs), F.col("pair"))] if pairs else []))).alias("key")).filter(
            "key IS NOT NULL").groupBy("key", "token").agg(*[
                F.count_if(o).alias(f"n{own}") for own, o in enumerate(other)]))
        near = {key: [[] for _ in range(folds)] for key in [*hot, *pairs]}
        for own in range(folds):
            for r in top_k(listed.filter(F.col(f"n{own}") > 0), ["key"], f"n{own}", k).orderBy("rank").collect():
                near[r.key][own].append(r.token)

    common = [r.token for r in counts.orderBy(F.desc("_n"), "token").limit(COMMON_WORDS).collect()]
    places = max(1, total // PLACE_WORDS)
    ship(docs.sparkSession)
    kinds = words.select(*by).schema.fields
    moved = words.mapInArrow(asked_grams(hot, pairs, common, places), StructType([
        *StructType.fromDDL("_at bigint, _grams binary").fields, *kinds]))
    # A written row per place, group and rank, as models are written tables too.
    return materialize(moved.repartition("_at").sortWithinPartitions("_at").mapInArrow(
        scored_grams(by, k, free, near, common), StructType([
            *kinds, *StructType.fromDDL("at bigint, answers int, weight bigint").fields])))


def _held_out_places(asked: DataFrame, model: DataFrame, keep: list[str], k: int,
                     context_size: int) -> DataFrame:
    """(…keep, at, answers) of `target` next to its words, level by level.

    A row meets one context after the other and carries the labels of those before. Once its target
    is found it has no key any more, and no labels. Nothing is gathered by request.
    """
    last, none = tk.level_count(context_size), F.array().cast("array<string>")
    keys = tk.level_keys([F.col(f"w{j}") for j in range(1, context_size + 1)], F.col("right"))
    near = [*[f"w{j}" for j in range(1, context_size + 1)], "right"]
    rows = asked.withColumn("at", F.lit(0).cast("long")).withColumn("_seen", none)
    for level in range(1, last):
        rows = materialize(rows.select(*keep, "target", *near, "at", "_seen", F.when(
            F.col("at") == 0, F.get(keys, F.lit(level - 1))["key"]).alias("key")))
        contexts = model.filter(F.col("level") == level).select(
            "key", F.transform("entries", lambda e: e["token"]).alias("_labels"))
        met = spread_join(rows, contexts, ["key"], [F.col("target"), *[F.col(w) for w in near]])
        seen = F.array_distinct(F.concat("_seen", F.coalesce("_labels", none)))
        rows = _found(met.withColumn("_seen", F.when(F.col("at") == 0, seen).otherwise(none)), k)
    free = F.transform("_rest", lambda c: c["label"])
    whole = F.when(F.col("at") == 0, F.array_distinct(F.concat("_seen", free))).otherwise(none)
    ended = _found(rows.withColumn("_rest", _context_free(model, last)).withColumn("_seen", whole), k)
    return ended.select(*keep, F.when(F.col("at") > 0, F.col("at")).alias("at"), F.when(
        F.col("at") > 0, F.lit(1)).otherwise(F.least(F.array_size("_seen"), F.lit(k))).alias("answers"))


def _found(rows: DataFrame, k: int) -> DataFrame:
    """`at` where the target is among the first k labels seen."""
    place = F.array_position("_seen", F.col("target"))
    return rows.withColumn("at", F.when((F.col("at") == 0) & place.between(1, k), place).otherwise(F.col("at")))


def _places(listed: DataFrame, keep: list[str], k: int) -> DataFrame:
    """(…keep, at, answers): where the target stands in its list of candidates."""
    labels = F.slice(F.transform("candidates", lambda c: c.label), 1, k)
    at = F.array_position(labels, F.col("target"))
    return listed.select(*keep, F.when(at > 0, at).alias("at"),
                         F.coalesce(F.array_size("candidates"), F.lit(0)).alias("answers"))


def score(per_request: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Scores from one row per request: `at` = rank of the target or NULL, `answers`.

    With a `weight`, a row stands for so many requests of the same outcome. Shares of no requests
    are null.
    """
    weight, zero = F.lit(1).cast("long") if weight is None else weight, F.lit(0).cast("long")

    def requests(which: Column) -> Column:
        return F.coalesce(F.sum(F.when(which, weight)), zero)

    prompts = F.coalesce(F.sum(weight), zero)
    aggs = [
        prompts.alias("prompts"), requests(F.col("at") == 1).alias("hits_at_1"),
        requests(F.col("at").isNotNull()).alias("hits_at_k"),
        F.round(F.try_divide(F.sum(F.coalesce(1.0 / F.col("at"), F.lit(0.0)) * weight), prompts), 6)
        .alias("mrr"),
        F.round(F.try_divide(requests(F.col("answers") > 0), prompts), 6).alias("coverage"),
    ]
    return per_request.groupBy(*(by or [])).agg(*aggs)
