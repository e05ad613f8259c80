import collections
import json
import random

import pytest
import regex
from pyspark.sql import functions as F

from caretlake.operators import completers as comp
from caretlake.functions import tokens as tk
from caretlake.operators import context as ctx
from caretlake.operators import grams
from caretlake.operators import ngram
from caretlake.operators import vocabulary as voc
from caretlake.operators.completers import EmptyCompleter, VocabCompleter
from caretlake.session import materialize
from caretlake.streaming.complete import complete_batch

TEXTS = ["the cat sat on the mat", "the cat ran on the mat", "a dog sat on a mat", "one two", "", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def _model(texts, c, k):
    counts = collections.Counter()
    for text in texts:
        w = [t for t in regex.split(r"[^\p{L}\p{N}]+", text) if t]
        for i in range(1, len(w) - 1):
            counts[1, f"{w[i - 1]} {w[i + 1]}", w[i]] += 1
            for j in range(1, c + 1):
                if i - j >= 0:
                    counts[c - j + 2, " ".join(w[i - j:i]), w[i]] += 1
            counts[c + 2, "", w[i]] += 1
    by_key = collections.defaultdict(list)
    for (level, key, token), n in counts.items():
        by_key[level, key].append((-n, token))
    return {key: [(t, -n) for n, t in sorted(v)[:k]] for key, v in by_key.items()}


@pytest.mark.parametrize("c", [1, 2, 3])
def test_training_against_python(docs, documents, c):
    for df in (docs, documents):
        texts = [r.text for r in df.select("text").collect()]
        want = _model(texts, c, 3)
        got = collections.defaultdict(list)
        for r in ngram.train_ngram(df, context_size=c, k=3).orderBy("rk").collect():
            got[r.level, r.key].append((r.token, r.n))
        assert got == want


@pytest.mark.parametrize("c", [1, 2])
def test_completion_against_python(spark, docs, c):
    model = _model(TEXTS, c, 10)
    frame = ngram.train_ngram(docs, context_size=c)
    prompts = [(1, "the cat", "on"), (2, "zzz", "qqq"), (3, "", "mat"), (4, "the", ""), (5, "", "")]
    df = spark.createDataFrame(prompts, "request_id long, prefix string, suffix string")
    got = collections.defaultdict(list)
    for r in ngram.ngram_complete(df, frame, 4, c).orderBy("rank").collect():
        got[r.request_id].append((r.label, r.level, r.n))
    for rid, prefix, suffix in prompts:
        left, right = prefix.split(), suffix.split()
        keys = []
        if left and right:
            keys.append((1, f"{left[-1]} {right[0]}"))
        for j in range(c, 0, -1):
            if len(left) >= j:
                keys.append((c - j + 2, " ".join(left[-j:])))
        keys.append((c + 2, ""))
        want, seen = [], set()
        for level, key in keys:
            for token, n in model.get((level, key), []):
                if token not in seen:
                    seen.add(token)
                    want.append((token, level, n))
        assert got[rid] == want[:4]


def test_packed_and_saved_models_answer_alike(spark, docs, tmp_path):
    model = ngram.train_ngram(docs)
    ngram.save_model(model, str(tmp_path / "m"))
    prompts = ctx.cloze_prompts(docs, unit="word").withColumn(
        "request_id", F.col("doc_id") * 100 + F.col("pos"))
    answers = [sorted(map(tuple, ngram.ngram_complete(prompts, m).collect())) for m in (
        model, ngram.pack_model(model), ngram.load_model(spark, str(tmp_path / "m")))]
    assert answers[0] and answers[0] == answers[1] == answers[2]


def test_scores(spark):
    predictions = spark.createDataFrame(
        [(1, 1, "a", 1.0), (1, 2, "b", 0.5), (2, 1, "c", 1.0), (2, 2, "d", 0.5)],
        "request_id long, rank int, label string, score double")
    targets = spark.createDataFrame([(1, "a"), (2, "d"), (3, "e")], "request_id long, target string")
    row = ngram.evaluate(predictions, targets).first()
    assert (row.prompts, row.hits_at_1, row.hits_at_k) == (3, 1, 2)
    assert row.mrr == pytest.approx(0.5) and row.coverage == pytest.approx(0.666667)
    assert ngram.evaluate(predictions, targets, k=1).first().hits_at_k == 1
    listed = predictions.groupBy("request_id").agg(F.transform(F.sort_array(
        F.collect_list(F.struct("rank", "label"))), lambda c: F.struct(c["label"].alias("label")))
        .alias("candidates"))
    both = targets.join(listed, "request_id", "left")
    assert ngram.evaluate_candidates(both).first() == row


def test_top_k_ties(spark):
    df = spark.createDataFrame([("g", "b", 2), ("g", "a", 2), ("g", "c", 3)], "g string, token string, n long")
    rows = ngram.top_k(df, ["g"], "n", 2).orderBy("rank").collect()
    assert [r.token for r in rows] == ["c", "a"]


def test_vocabulary(spark, docs):
    rows = voc.build_vocab(docs, top_n=3).orderBy("idx").collect()
    assert [(r.idx, r.item, r.n) for r in rows] == [(0, "the", 4), (1, "mat", 3), (2, "on", 3)]
    assert {r.item for r in voc.build_vocab(docs, min_count=3).collect()} == {"the", "mat", "on"}
    whole = {(r.idx, r.item) for r in voc.build_vocab(docs).collect()}
    assert {(r.idx, r.item) for r in rows} <= whole
    assert sorted(i for i, _ in whole) == list(range(len(whole)))


def test_vocab_pages_and_salted_join_agree(spark, docs, monkeypatch):
    vocab = materialize(voc.build_vocab(docs))
    requests = spark.createDataFrame([(1,), (2,)], "request_id long")
    want = [r.item for r in vocab.orderBy("idx").collect()]
    for limit in (1 << 20, -1):
        monkeypatch.setattr(voc, "BROADCAST_BYTES", limit)
        rows = voc.vocab_complete(requests, vocab, page_size=4).orderBy("page").collect()
        for rid in (1, 2):
            assert sum([r.labels for r in rows if r.request_id == rid], []) == want
    empty = vocab.filter("false")
    assert [r.labels for r in voc.vocab_complete(requests, empty).collect()] == [[], []]


def test_encoding(spark):
    docs = spark.createDataFrame([(1, "a b zz", 0), (2, "", 0), (3, "a b a b a b", 1), (4, None, 1)],
                                 "doc_id long, text string, batch long")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "idx long, item string")
    got = {r.doc_id: (r.input_ids, r.attention_mask)
           for r in voc.encode_batches(docs, vocab, max_length=6).collect()}
    assert got[1] == ([2, 5, 6, 1, 3], [1] * 5)
    assert got[2] == ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0])
    assert got[3] == ([2, 5, 6, 5, 6, 3], [1] * 6)
    assert got[4] == ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])


def test_make_completer(spark, docs):
    vocab = spark.createDataFrame([(0, "a")], "idx long, item string")
    assert isinstance(comp.make_completer(None, vocab=vocab), comp.VocabCompleter)
    assert isinstance(comp.make_completer("vocab", vocab=vocab), comp.VocabCompleter)
    assert isinstance(comp.make_completer("hf", factory=list), comp.ModelCompleter)
    assert isinstance(comp.make_completer("huggingface", factory=list), comp.ModelCompleter)
    assert isinstance(comp.make_completer("ngram", model=docs), comp.NgramCompleter)
    assert isinstance(comp.make_completer("empty"), comp.EmptyCompleter)
    with pytest.raises(ValueError):
        comp.make_completer("other")
    prompts = spark.createDataFrame([(1, "p")], "request_id long, prompt string")
    assert comp.EmptyCompleter().complete(prompts).count() == 0


def test_model_is_built_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "built")

    def factory():
        import os
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda prompts, k: [[(p.upper(), 1.0), ("x", 0.5), ("y", 0.1)] for p in prompts]

    prompts = spark.range(100).select(
        F.col("id").alias("request_id"), F.concat(F.lit("p"), "id").alias("prompt"),
        F.when(F.col("id") == 7, "past_eol").otherwise("ok").alias("status")).repartition(8)
    rows = comp.ModelCompleter(factory, batch_size=3).complete(prompts, 2).collect()
    assert len(rows) == 198 and not any(r.request_id == 7 for r in rows)
    assert {(r.rank, r.label) for r in rows if r.request_id == 5} == {(1, "P5"), (2, "x")}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))


def test_batches_by_a_budget_hold_little_padding(spark, documents):
    """Prompts of 1 to 256 characters; the model reports the length that it pads them to."""
    def factory():
        return lambda prompts, k: [[(p, float(max(map(len, prompts)) * 1000 + len(prompts)))] for p in prompts]

    cut = F.pmod(F.xxhash64("doc_id", "i"), F.lit(256)) + 1
    prompts = documents.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select(
        (F.col("doc_id") * 10 + F.col("i")).alias("request_id"),
        F.substring("text", F.lit(1), cut.cast("int")).alias("prompt"))
    rows = comp.ModelCompleter(factory, 64, 2, budget=4096).complete(prompts).collect()
    padded, used = sum(r.score // 1000 for r in rows), sum(len(r.label) for r in rows)
    assert len(rows) == prompts.count() and 1 - used / padded < 0.10
    assert all((r.score // 1000) * (r.score % 1000) <= 4096 and r.score % 1000 <= 64 for r in rows)
    other = comp.ModelCompleter(factory, 7, 3).complete(prompts.orderBy(F.desc("request_id"))).collect()
    assert {(r.request_id, r.label) for r in rows} == {(r.request_id, r.label) for r in other}


def test_batches():
    rows = [(i, n) for i, n in enumerate([1, 2, 2, 9, 3])]
    assert [len(b) for b in comp.padded_batches(rows, 2, None)] == [2, 2, 1]
    assert [len(b) for b in comp.padded_batches(rows, 9, 6)] == [3, 1, 1]
    assert list(comp.padded_batches([], 3, 5)) == []


def test_a_model_of_another_context_size_is_refused(spark):
    docs = spark.createDataFrame([("a b c d",)], "text string")
    prompts = spark.createDataFrame([(1, "a", "c")], "request_id long, prefix string, suffix string")
    with pytest.raises(Exception, match="levels"):
        ngram.ngram_complete(prompts, ngram.train_ngram(docs, context_size=2)).collect()


def test_one_response_whatever_the_vocabulary(spark):
    vocab = spark.range(5000).select(F.col("id").alias("idx"), F.concat(F.lit("w"), "id").alias("item"))
    prompts = spark.createDataFrame(
        [(1, 5, '"req-5"', "ok", "p", "s")],
        "session long, seq long, id string, status string, prefix string, suffix string")
    (row,) = complete_batch(prompts, VocabCompleter(vocab)).collect()
    assert json.loads(row.raw)["id"] == "req-5"
    assert [i["label"] for i in json.loads(row.raw)["result"]] == [f"w{i}" for i in range(5000)]


def test_an_empty_completer_keeps_the_type_of_the_key(spark):
    prompts = spark.createDataFrame([("a/1",)], "request_id string")
    assert EmptyCompleter().complete(prompts).schema["request_id"].dataType.simpleString() == "string"


def test_held_out_scores_never_see_their_own_document(spark):
    """Two documents of words nobody else has: no hit, though each would know itself by heart."""
    docs = spark.createDataFrame(
        [(0, "x", "a b c a b c a b c"), (1, "y", "d e f d e f d e f"), (2, "z", "a b c a b c"), (3, "z", "g")],
        "doc_id long, lang string, text string")
    by = {r.lang: r for r in ngram.evaluate_held_out(
        docs, ["lang"], fold=F.when(F.col("doc_id") == 1, 1).otherwise(0)).collect()}
    assert (by["y"].prompts, by["y"].hits_at_k, by["y"].coverage) == (7, 0, 1.0)
    assert by["x"].hits_at_k == 0 and by["x"].prompts == 7
    by = {r.lang: r for r in ngram.evaluate_held_out(
        docs, ["lang"], fold=F.when(F.col("doc_id") == 0, 1).otherwise(0)).collect()}
    assert by["x"].hits_at_1 == by["x"].prompts == 7 and by["z"].hits_at_1 == 4
    assert ngram.evaluate_held_out(docs.limit(0), folds=3).first().prompts == 0


def test_pages_are_worked_out_once(spark):
    """Columns of a page take its labels' place before it meets the requests."""
    vocab = materialize(spark.createDataFrame([(i, f"w{i}") for i in range(10)], "idx long, item string"))
    requests = spark.createDataFrame([(1,), (1,), (None,), (7,)], "request_id long")
    of_page = {"n": F.size("labels"), "first": F.element_at("labels", 1)}
    got = voc.vocab_complete(requests, vocab, 4, of_page)
    assert got.columns == ["page", "request_id", "n", "first"]
    assert "labels" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = voc.vocab_complete(requests, vocab, 4).withColumns(of_page).drop("labels")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    empty = voc.vocab_complete(requests, vocab.limit(0), 4, {"n": F.size("labels")})
    assert [tuple(r) for r in empty.orderBy("request_id").collect()] == [
        (None, 0, 0), (1, 0, 0), (1, 0, 0), (7, 0, 0)]


def test_encoding_with_a_vocabulary_that_is_not_broadcast(spark, monkeypatch):
    """The first words are broadcast, the others looked up apart: the same ids as from one table."""
    texts = ["b a zz c", "", None, "zz", "a a a f e d c b a", "f"]
    rows = [(i, i // 2, t) for i, t in enumerate(texts)] + [(4, 2, texts[4]), (None, 0, "f a"), (None, None, "f zz")]
    docs = spark.createDataFrame(rows, "doc_id long, batch long, text string")
    vocab = materialize(spark.createDataFrame(list(enumerate("abcdef")), "idx long, item string"))
    want = voc.encode_batches(docs, vocab, max_length=8)
    monkeypatch.setattr(voc, "BROADCAST_BYTES", 60)
    got = voc.encode_batches(docs, vocab, max_length=8)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # Words cross the wire as single rows only if they are not among the first.
    sent = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines()
            if "Exchange hashpartitioning(_word" in line]
    assert sent and "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    near, rest = voc._first_words(vocab.select(
        vocab["item"].alias("_word"), vocab["idx"].cast("int").alias("_id")), 150)
    assert 0 < near.count() < 6 and near.count() + rest.count() == 6


@pytest.mark.parametrize("c", [1, 2, 3])
@pytest.mark.parametrize("min_count", [1, 2])
def test_training_with_hot_words_in_small_batches(spark, docs, documents, monkeypatch, c, min_count):
    """Contexts of hot words alone, and places that go on in the next batch, are counted as others are."""
    monkeypatch.setattr(ngram, "HOT_ROWS", 0)
    monkeypatch.setattr(grams, "BATCH_WORDS", 50)
    monkeypatch.setattr(grams, "BATCH_CHARS", 500)
    odd = spark.createDataFrame([(7, None), (8, "a a a a a a"), (9, "a a a a a a"), (10, "ä the ß the"), (11, "the of the")],
                                "doc_id long, text string")
    for df in (docs.unionByName(odd), documents.select("doc_id", "text")):
        want = _model([r.text or "" for r in df.select("text").collect()], c, 1 << 30)
        want = {key: kept for key, v in want.items() if (kept := [e for e in v if e[1] >= min_count][:3])}
        for words in (3, 50):
            monkeypatch.setattr(ngram, "HOT_WORDS", words)
            got = collections.defaultdict(list)
            for r in ngram.train_ngram(df, c, 3, min_count).orderBy("rk").collect():
                got[r.level, r.key].append((r.token, r.n))
            assert got == want


def test_training_moves_a_word_of_a_batch_as_one_row(spark):
    docs = spark.createDataFrame([(f"w{i % 3} x y z",) for i in range(300)], "text string").coalesce(1)
    words = docs.select(tk.tokens(F.col("text")).alias("w"))
    moved = words.mapInArrow(grams.placed_grams(1, []), grams.MOVED)
    assert sorted(r._at for r in moved.collect()) == ["w0", "w1", "w2", "x"]


@pytest.mark.parametrize("c", [1, 2])
def test_places_of_targets_are_those_among_the_candidates(spark, docs, c):
    """Level by level, without gathering labels by request."""
    model = materialize(ngram.train_packed(docs, c, 2))
    asked = spark.createDataFrame(
        [("u", "the", "cat", "on", "sat", 2), (None, "cat", "sat", "on", "sat", 1), ("the", "cat", "on", "the", "zzz", 4),
         (None, "qq", "qq", "qq", "the", 3), (None, "qq", "qq", "qq", "mat", 5), ("a", "b", "on", "x", "ran", 6)],
        "w2 string, w1 string, right string, suffix string, target string, weight long")
    placed = ngram._held_out_places(asked, model, ["weight"], 2, c)
    assert "collect_list" not in placed._jdf.queryExecution().toString()
    prompts = asked.select(F.monotonically_increasing_id().alias("request_id"), F.concat_ws(" ", *(
        ["w2", "w1"] if c == 2 else ["w1"])).alias("prefix"), F.col("right").alias("suffix"), "target", "weight")
    want = ngram._places(ngram.ngram_candidates(prompts, model, 2, c), ["weight"], 2)
    assert sorted((r.weight, r.at or 0, r.answers > 0) for r in placed.collect()) == sorted(
        (r.weight, r.at or 0, r.answers > 0) for r in want.collect())


def _held_out(rows, folds, k):
    """{by: (prompts, hits@1, hits@k, sum of 1 / rank, covered)} by scoring every word on its own."""
    def words(text):
        return (text or "").split()

    def best(counted):
        return [w for w, _ in sorted(counted.items(), key=lambda e: (-e[1], e[0]))[:k]]

    out = collections.defaultdict(lambda: [0, 0, 0, 0.0, 0])
    for own in range(folds):
        model = collections.defaultdict(collections.Counter)
        for fold, _, text in rows:
            if fold is not None and fold != own:
                w = words(text)
                for i in range(1, len(w) - 1):
                    for key in ((w[i - 1], w[i + 1]), w[i - 1], None):
                        model[key][w[i]] += 1
        model = {key: best(c) for key, c in model.items()}
        for fold, by, text in rows:
            w = words(text) if fold == own else []
            for i in range(1, len(w) - 1):
                listed = list(dict.fromkeys(x for key in ((w[i - 1], w[i + 1]), w[i - 1], None)
                                            for x in model.get(key, [])))[:k]
                at = listed.index(w[i]) + 1 if w[i] in listed else 0
                for n, more in enumerate((1, at == 1, at > 0, at and 1 / at, bool(listed))):
                    out[by][n] += more
    return dict(out)


@pytest.mark.parametrize("hot_words", [1 << 30, 60, 12, 3])
def test_held_out_scores_where_contexts_are_counted(spark, monkeypatch, hot_words):
    """With no, some and many hot words and pairs, in small batches; folds that are null or out of range; no
    gram meets a model by a join."""
    rng = random.Random(4)
    vocabulary, weights = [f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)]
    rows = [(rng.choice([0, 1, 2, 2, 3, None]), rng.choice(["x", "y", None]), " ".join(
        rng.choices(vocabulary, weights, k=rng.choice([0, 2, 3, 30])))) for _ in range(90)]
    rows += [(0, "x", None), (1, "z", "a b w0 ä w0 w1 w0"), (0, "z", "w0 w1 w0 w1 w0 w1"), (2, "q", "w0 w1 w0 q w0 w1")]
    docs = spark.createDataFrame(rows, "f int, lang string, text string").repartition(3)
    monkeypatch.setattr(ngram, "HOT_ROWS", 0)
    monkeypatch.setattr(ngram, "HOT_WORDS", hot_words if hot_words < 1 << 30 else 1)
    monkeypatch.setattr(grams, "BATCH_WORDS", 200)
    monkeypatch.setattr(grams, "BATCH_CHARS", 2000)
    monkeypatch.setattr(ngram, "spread_join", None)
    monkeypatch.setattr(ngram, "PLACE_WORDS", 100)
    monkeypatch.setattr(ngram, "COMMON_WORDS", 7)
    for k in (2, 5):
        got = {r.lang: (r.prompts, r.hits_at_1, r.hits_at_k, r.mrr, r.coverage) for r in ngram.evaluate_held_out(
            docs, ["lang"], folds=3, k=k, fold=F.col("f")).collect()}
        want = {by: (n, one, hit, round(mrr / n, 6), round(some / n, 6)) for by, (n, one, hit, mrr, some) in
                _held_out(rows, 3, k).items()}
        assert got == want


def test_grams_to_score_move_once_with_their_number():
    """All folds of a batch leave as one value per place and group, equal grams as one; a hot pair by the middle word."""
    import numpy as np
    import pyarrow as pa

    batch = pa.record_batch([pa.array([["a", "b", "c", "b", "c", "b", "d"]] * 2 + [["a", "x", "a"], None, ["a"]]),
                             pa.array([0, 0, 1, 1, 0], pa.int32())], names=["_w", "_fold"])

    def moved(hot, pairs, common):
        out = collections.defaultdict(dict)
        for b in grams.asked_grams(hot, pairs, common, 1 << 40)(iter([batch])):
            assert len({tuple(r[c] for c in b.schema.names if c != "_grams") for r in b.to_pylist()}) == b.num_rows
            for r in b.to_pylist():
                words, columns = grams._unpacked(r["_grams"])
                columns[0] = np.cumsum(columns[0].astype(np.uint32), dtype=np.uint32)
                for *gram, n, fold in columns.T.tolist():
                    out[r["_at"]][(*((common + words)[w] for w in gram), fold - 1)] = n
        at = dict(zip("abcx", grams._hashed(pa.array(list("abcx"))).tolist()))
        names = {**{n: w for w, n in at.items()}, at["b"] * 32: "b b"}
        return {names[place]: kept for place, kept in out.items()}

    for common in ([], ["b"], ["d", "c", "b", "a", "x"]):
        assert moved([], [], common) == {
            "a": {("a", "c", "b", 0): 2, ("a", "a", "x", 1): 1}, "b": {("b", "b", "c", 0): 4},
            "c": {("c", "c", "b", 0): 2, ("c", "d", "b", 0): 2}}
        assert moved(["a", "b"], ["a a"], common) == {
            "c": {("a", "c", "b", 0): 2, ("c", "c", "b", 0): 2, ("c", "d", "b", 0): 2}, "b b": {("b", "b", "c", 0): 4},
            "x": {("a", "a", "x", 1): 1}}
