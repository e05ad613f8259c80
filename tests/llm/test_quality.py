import numpy as np

from caretlake.llm.common import table
from caretlake.llm.queries_quality import fold_model, held_out, op10_quality_classifier
from caretlake.llm.quality import keep_good, repeats, score_quality, text_features, train, train_quality
from caretlake.llm.quality import WordCache, word_features
from tests.conftest import SF
from tests.llm.conftest import HARD


def test_held_out_accuracy(llm):
    rows = op10_quality_classifier(llm, SF)
    labels = table(llm, SF, "labels").select("doc_id", "quality")
    held = rows.join(labels, "doc_id").filter("held_out").collect()
    right = [r.predicted == r.quality for r in held]
    always = max(np.mean([r.quality == k for r in held]) for k in (0, 1))
    assert np.mean(right) >= max(0.9, always)
    assert rows.count() == table(llm, SF, "documents").count()


def test_training_repeats_itself(llm):
    docs = table(llm, SF, "documents")
    first, second = (fold_model(llm, SF, docs) for _ in range(2))
    assert (first.vectors == second.vectors).all() and (first.weights == second.weights).all()


def test_scores_are_those_of_the_mean_vector(llm):
    docs = table(llm, SF, "documents").limit(30)
    model = fold_model(llm, SF, table(llm, SF, "documents"))
    words = WordCache(word_features)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in score_quality(docs, model).collect():
        buckets, shares = text_features(texts[r.id], words)
        logits = model.weights @ (shares @ model.vectors[buckets]) + model.biases
        chance = np.exp(logits - logits.max())
        assert abs(chance[1] / chance.sum() - r.score) < 1e-4


def test_hard_rows(hard, llm):
    labels = llm.createDataFrame([(1, 1), (9, 0), (9, 1), (3, None), (None, 1), (10, 0), (4, 0), (77, 1)],
                                 "doc_id bigint, quality int")
    model = train_quality(hard, labels)
    got = score_quality(hard, model).collect()
    assert len(got) == len(HARD) and all(0 <= r.score <= 1 for r in got)
    blank = {r.score for r in got if r.id in (3, 4, 5, 6)}
    assert len(blank) == 1
    assert keep_good(hard, model, threshold=0.0).count() == len(HARD)
    assert keep_good(hard, model).columns == hard.columns


def test_without_labels_all_scores_are_even(hard, llm, nothing):
    labels = llm.createDataFrame([], "doc_id bigint, quality int")
    model = train_quality(hard, labels)
    assert {r.score for r in score_quality(hard, model).collect()} == {0.5}
    assert score_quality(nothing, model).count() == 0
    assert {r.score for r in score_quality(hard, train_quality(nothing, labels)).collect()} == {0.5}


def test_sample_is_bounded(llm):
    docs, labels = table(llm, SF, "documents"), table(llm, SF, "labels")
    small = train_quality(docs, labels, sample_rows=5)
    whole = train_quality(docs, labels)
    assert not (small.vectors == whole.vectors).all()


def test_rejected_rows_are_learned():
    words = WordCache(word_features)
    rows = [(*text_features(t, words), y) for t, y in [("clean words here", 1), ("BUY!!! NOW!!!", 0)] * 30]
    model = train(rows)
    margin, rest = model.margins()
    score = [rest + shares @ margin[buckets] for buckets, shares, _ in rows[:2]]
    assert score[0] > 0 > score[1] and repeats("a a b b b".split()) == 3


def test_fold_of_a_null_id(llm):
    df = llm.createDataFrame([(None,), (1,)], "doc_id bigint")
    assert [r[0] for r in df.select(held_out()).collect()][0] is False
