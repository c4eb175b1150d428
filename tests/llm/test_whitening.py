"""Embedding whitening against a dense eigenvalue solver, and its edge cases."""

import numpy as np
import pytest

from harrow.llm.whitening import LARGEST, integers, leading, whiten


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 7) for i, v in rows], "vec_id long, embedding array<float>, x string, dim int")


def dense(rows):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in sound], object)
    sums, n = x.sum(axis=0), len(x)
    y = ((x * n - sums) / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in sound], n, ((x * n - sums) ** 2).sum(axis=1), e[::-1], y @ u[:, ::-1]


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    scales = np.linspace(1, 0.3, 40)
    rows = [(i, (rng.standard_normal(40) * scales).tolist()) for i in range(300)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, [float("nan")] * 40), (902, [None] + [0.5] * 39), (903, [float("inf")] * 40), (904, [])]
    got = whiten(vectors(spark, rows)).collect()
    ids, n, deviation, e, z = dense(rows)
    assert len(got) == 8 * n and n == 302 and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], r["whitened"])
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 and r["identity_error"] < 1e-10
    for i, d, row in zip(ids, deviation, z):
        for k in range(8):
            assert abs(abs(by[i, d][k + 1]) - abs(row[k]) / np.sqrt(e[k])) < 1e-9
    assert {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(vectors(spark, rows)).collect() if r["vec_id"]} == {(r["vec_id"], r["component"]): pytest.approx(r["whitened"], abs=1e-9) for r in got if r["vec_id"]}


def test_partial_sums_are_added_in_a_tree(spark, monkeypatch):
    import harrow.llm.whitening as w

    rows = [(i, [float(i % 7), i / 8, -i % 5 / 2]) for i in range(200)]
    once = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(vectors(spark, rows).repartition(9)).collect()}
    monkeypatch.setattr(w, "FAN_IN", 2)
    again = {(r["vec_id"], r["component"]): r["whitened"] for r in whiten(vectors(spark, rows).repartition(9)).collect()}
    assert len(once) == 600 and once == pytest.approx(again, abs=1e-9)


def test_edge_cases(spark):
    assert whiten(vectors(spark, [(1, None)]).limit(0)).collect() == [] and whiten(vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whiten(vectors(spark, [(1, [0.5, 1.0])])).collect() == [] and whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect() == []
    got = whiten(vectors(spark, [(i, [i / 4, 0.0, 1.0]) for i in range(5)])).collect()  # one direction only
    assert [(r["vec_id"], r["component"]) for r in sorted(got)] == [(i, 1) for i in range(5)] and all(r["explained"] == pytest.approx(1) for r in got)
    with pytest.raises(Exception, match="different lengths"):
        whiten(vectors(spark, [(1, [0.5, 1.0]), (2, [0.5])])).collect()
    with pytest.raises(Exception, match="too large"):
        integers(spark.createDataFrame([(1, [float(LARGEST)])], "vec_id long, embedding array<double>")).collect()


def test_deviation_is_exact_where_it_is_large(spark):
    rows = [(i, [float(i * 300_000), 0.25]) for i in range(4)]
    ids, _, deviation, _, _ = dense(rows)
    assert {r["vec_id"]: r["deviation"] for r in whiten(vectors(spark, rows)).collect()} == dict(zip(ids, deviation))
    with pytest.raises(Exception, match="beyond a long"):
        whiten(vectors(spark, [(i, [float(i) * 1e11, 0.25]) for i in range(4)])).collect()


def test_close_eigenvalues_converge():
    rng = np.random.default_rng(1)
    e = np.r_[np.linspace(1.02, 1, 12), np.linspace(0.999, 0.5, 108)]
    u = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    a = u * e @ u.T
    values, axes, facts = leading(lambda q: a @ q, 120, 8)
    assert np.allclose(values, e[:8], atol=1e-13) and np.abs(np.abs(u[:, :8].T @ axes) - np.eye(8)).max() < 1e-9 and facts["residual"] < 1e-11
    with pytest.raises(ValueError, match="rounds"):
        leading(lambda q: a @ q, 120, 8, most_rounds=1)


@pytest.mark.parametrize("first", [[103_600.0, 34_200.0], [1e9], [2e6, 1.9e6, 1e5]])
def test_a_value_far_above_the_others_does_not_drown_them(first):
    rng = np.random.default_rng(2)
    spectrum = np.array([*first, *np.linspace(17_600, 12_200, 64 - len(first))])
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    v = q * spectrum @ q.T
    e, u, facts = leading(lambda x: v @ x, 64, 8)
    assert np.abs(e - spectrum[:8]).max() < 1e-10 * e[0] and np.abs(v @ u - u * e).max() < 1e-10 * e[0] and facts["passes"] < 100


def test_more_equal_values_than_the_block_holds():
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((62, 62)))[0]
    v = q * np.array([5.0] * 30 + [1.0] * 32) @ q.T
    e, u, _ = leading(lambda x: v @ x, 62, 8)
    assert np.abs(e - 5).max() < 1e-12 and np.abs(v @ u - u * e).max() < 1e-12


@pytest.mark.parametrize("n", [8e5, 1.5e7, 1e9])
def test_a_narrow_spectrum_converges(n):
    """Many vectors without a preferred direction: the values come together as 1 / sqrt(n), and 0 is far below all of them."""
    rng = np.random.default_rng(1)
    g = rng.standard_normal((64, 64))
    v = 16_384 * (np.eye(64) + (g + g.T) / np.sqrt(2 * n))
    e, u, facts = leading(lambda x: v @ x, 64, 8)  # before: an error after 60 rounds
    assert facts["passes"] < 100 and np.abs(e - np.linalg.eigvalsh(v)[::-1][:8]).max() < 1e-12 * e[0] and np.abs(v @ u - u * e).max() < 1e-12 * e[0] and np.abs(u.T @ u - np.eye(8)).max() < 1e-12


def test_deviations_beyond_a_long_have_a_column(spark):
    from decimal import Decimal

    for rows in ([(i, [float(i) * 1e11, 0.25]) for i in range(4)], [(i, [float(i * 300_000), 0.25]) for i in range(4)]):
        ids, _, deviation, _, _ = dense(rows)
        want = {i: (int(d) if d < 1 << 63 else None, Decimal(int(d))) for i, d in zip(ids, deviation)}
        got = whiten(vectors(spark, rows), exact=True).collect()  # before: an error
        assert {r["vec_id"]: (r["deviation"], r["deviation_exact"]) for r in got} == want and len(got) == 4
    with pytest.raises(Exception, match="beyond 38 digits"):
        whiten(spark.createDataFrame([(i, [i * 4e12] * 4) for i in range(2)], "vec_id long, embedding array<double>").crossJoin(spark.range(2000)), exact=True).collect()


def test_deviations_of_many_vectors_are_exact():
    from harrow.llm.whitening import deviations

    rng = np.random.default_rng(6)
    for n, size in ((10, 600), (3_000_000, 600), (15_000_000, 600), (15_000_000, 1 << 30), (1 << 33, 0)):
        x, left = rng.integers(-size, size + 1, (50, 64)), [int(r) for r in rng.integers(0, n, 64)]
        want = [sum((n * int(v) - r) ** 2 for v, r in zip(row, left)) for row in x]
        assert list(map(int, deviations(x, n, left, exact=True).to_pylist())) == want
        if max(want) < 1 << 63:
            assert deviations(x, n, left).to_pylist() == want
        else:
            with pytest.raises(ValueError, match="beyond a long"):
                deviations(x, n, left)


def test_vectors_are_packed_as_narrow_as_they_are(spark):
    from harrow.llm.whitening import packed, unpacked

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for size in (5, 50_000, 1 << 40):
            rows = [(i if i % 9 else None, [100_000 + (-1) ** i * size * i // 100 + d for d in range(3)]) for i in range(200)]
            blocks = packed(spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(3), 100_000)
            batches = blocks.toArrow().to_batches()
            got = [(i, [100_000 + int(v) for v in row]) for b in batches for part, x in unpacked(b, 3) for i, row in zip(part.column("ids").flatten().to_pylist(), x)]
            assert sorted(got, key=str) == sorted(rows, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [len(r["i2"]) for r in packed(spark.createDataFrame([(1, [100_007, 99_990])], "vec_id long, x array<long>"), 100_000).collect()] == [4]
