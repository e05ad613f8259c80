"""Whitening next to plain linear algebra over the collected vectors."""

from fractions import Fraction

import numpy as np
import pytest

from caretlake.llm.common import table
from caretlake.llm.queries_whitening import op11_embedding_whitening
from caretlake.llm.whitening import eigenvectors, fit_whitening, whiten
from tests.conftest import SF


def integers(rows):
    return np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in r] for r in rows])


def test_query_against_brute_force(llm):
    table_rows = table(llm, SF, "embeddings").select("vec_id", "embedding").collect()
    x = integers([r.embedding for r in table_rows])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    whitened = centred @ vectors / np.sqrt(values)
    got = op11_embedding_whitening(llm, SF).collect()
    assert len(got) == 8 * n
    by = {(r.vec_id, r.component): r for r in got}
    signs = np.sign([by[table_rows[0].vec_id, k + 1].whitened * whitened[0, k] for k in range(8)])
    for i, row in enumerate(table_rows):
        deviation = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))
        for k in range(8):
            r = by[row.vec_id, k + 1]
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(signs[k] * whitened[i, k], abs=1e-9)
            assert r.explained == pytest.approx(values[k] / np.trace(centred.T @ centred / n), rel=1e-9)
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [1, 1 + 1e-9, 1 + 2e-9, 1 + 3e-12, 0.5, 0.25],
    [1, 1, 1, 0.5, 0.5, 1e-12], [1, 1e-3, 1e-6, 1e-9, 0, 0], [3, 3, 3, 3, 3, 3]])
def test_refinement_reaches_extended_precision(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q + q @ (np.eye(6) - q.T @ q) / 2
    values = np.array(values, np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = eigenvectors(a)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-17
    # Vectors of simple eigenvalues, apart by 1e-9 and more, are those the matrix was made of.
    order = np.argsort(-values, kind="stable")
    for k, at in enumerate(order):
        gap = np.abs(np.delete(values, at) - values[at]).min()
        if gap >= 1e-9:
            assert 1 - abs(x[:, k] @ q[:, at]) < 1e-15


def test_float32_alone_is_not_enough():
    rng = np.random.default_rng(4)
    a = np.cov(rng.normal(size=(40, 300)) * np.linspace(1, 1.001, 40)[:, None]).astype(np.longdouble)
    found, x = eigenvectors(a)
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    assert np.abs(a @ x - x * found).max() < 1e-17 < 1e-9 < np.abs(rough.T @ rough - np.eye(40)).max() * 1e-1


def test_hard_rows(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5], 1), (2, [1.0, 2.0, 0.5], 1), (2, [0.0, -1.0, 0.5], 1), (3, None, 1),
            (4, [1.0, None, 2.0], 1), (5, [nan, 0.0, 1.0], 1), (6, [0.0, inf, 1.0], 1), (7, [], 1),
            (8, [1.0], 1), (9, [1.0, 2.0, 3.0, 4.0], 1), (None, [4.0, 4.0, 0.5], 1)]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<float>, x int")
    got = whiten(df).collect()
    assert sorted(r.id or 0 for r in got) == [0, 1, 2, 2]
    # The third dimension never varies, so there are two components.
    assert {len(r.whitened) for r in got} == {2} and {r.n for r in got} == {4}
    assert got[0].identity_error < 1e-9
    assert whiten(df.filter("vec_id = 3")).count() == 0
    assert whiten(df.limit(0)).columns == ["id", "n", "deviation", "whitened", "explained",
                                           "identity_error"]
    same = whiten(df.filter("vec_id = 1")).collect()
    assert same[0].whitened == [] and same[0].deviation == 0 and same[0].identity_error == 0


def test_large_entries_stay_exact(llm):
    rows = [(i, [1e30 * (-1) ** i, float(i), 3e11 * i]) for i in range(5)]
    df = llm.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    model = fit_whitening(df)
    limit = 1 << 53
    x = [[(limit if i % 2 == 0 else -limit) + 100_000, 1024 * i + 100_000,
          int(1024 * 3e11 * i) + 100_000] for i in range(5)]
    assert model.sums == [sum(c) for c in zip(*x)]
    centred = [[Fraction(v) - Fraction(s, 5) for v, s in zip(r, model.sums)] for r in x]
    trace = sum(v * v for r in centred for v in r) / 5
    assert sum(model.explained) == pytest.approx(1)
    assert float(model.values.sum()) == pytest.approx(float(trace), rel=1e-12)
    deviations = {r.id: int(r.deviation) for r in whiten(df, model=model).collect()}
    assert deviations == {i: int(sum((5 * v) ** 2 for v in r)) for i, r in enumerate(centred)}


def test_parts_don_t_matter(llm):
    df = table(llm, SF, "embeddings")
    one, many = fit_whitening(df.coalesce(1)), fit_whitening(df.repartition(7))
    assert one.sums == many.sums and (one.vectors == many.vectors).all()
