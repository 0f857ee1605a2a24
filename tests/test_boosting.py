"""Boosted trees: splits against exhaustive search, learning, the grid and scoring."""

import numpy as np
import pandas as pd
import pytest

from caremart.plans import boosting as BO


def _data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({c: rng.normal(size=n) for c in BO.NUMERIC} | {c: rng.choice(list("abcd"), n) for c in BO.CATEGORICAL})
    cuts = {c: sorted(np.quantile(frame[c], np.linspace(0.1, 0.9, 9)).tolist()) for c in BO.NUMERIC}
    return frame, BO.Coding(cuts, {c: list("abcd") for c in BO.CATEGORICAL}), rng


def test_codes_are_bins():
    frame, code, _ = _data()
    codes = code.codes(frame)
    for j, c in enumerate(BO.NUMERIC):
        bins = codes[:, j] - code.starts[j]
        for b, cut in enumerate(code.cuts[c]):
            assert ((frame[c] <= cut).to_numpy() == (bins <= b)).all()
    odd = pd.DataFrame({c: [None, 1e9] for c in BO.NUMERIC} | {c: ["never seen", None] for c in BO.CATEGORICAL})
    got = code.codes(odd) - code.starts
    assert got[0].tolist() == [0] * 3 + [4] * 6 and got[1].tolist() == [9] * 3 + [4] * 6


def test_first_split_is_the_best_of_all():
    frame, code, rng = _data()
    y = ((frame["session_duration"] > 0.3) | (frame["age_group"] == "c")).astype(int).to_numpy()
    codes, may = code.codes(frame), code.usable
    g, h = 0.5 - y, np.full(len(y), 0.5)
    best = {}
    for b in np.flatnonzero(may):
        col = codes[:, code.column[b]]
        left = col <= b if code.numeric[b] else col == b
        if min(h[left].sum(), h[~left].sum()) >= BO.LEAST_WEIGHT:
            best[b] = sum(g[s].sum() ** 2 / (h[s].sum() + BO.PENALTY) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + BO.PENALTY)
    model = BO.Boosted(code, 2, 0.1)
    levels, leaves, node = model._tree(codes, g, h, may, 1)
    assert best[levels[0][0]] == pytest.approx(max(best.values()))
    for leaf in (0, 1):
        assert leaves[leaf] == pytest.approx(-g[node == leaf].sum() / (h[node == leaf].sum() + BO.PENALTY))


def test_boosting_learns_and_its_beginning_is_the_shorter_fit():
    frame, code, rng = _data(1500)
    y = np.where(frame["quality_rating"] > 0.5, 2, np.where(frame["metric_name"].isin(["a", "b"]), 1, 0))
    codes = code.codes(frame)
    long = BO.Boosted(code, 3, 0.1).fit(codes[:1000], y[:1000], code.usable, 3, 40)
    short = BO.Boosted(code, 3, 0.1).fit(codes[:1000], y[:1000], code.usable, 3, 15)
    assert np.allclose(long.scores(codes, 15), short.scores(codes))
    assert (long.scores(codes[1000:]).argmax(axis=1) == y[1000:]).mean() > 0.95
    assert np.allclose(BO.shares(long.scores(codes)).sum(axis=1), 1)


def test_only_chosen_features_split():
    frame, code, rng = _data(600)
    y = np.where(frame["quality_rating"] > 0, 1, 0)
    codes = code.codes(frame)
    may = BO.best_features(codes, y, code, 1)
    assert {code.names[b] for b in np.flatnonzero(may)} == {"quality_rating"}
    assert set(BO.Boosted(code, 2, 0.1).fit(codes, y, may, 3, 5).gains) == {"quality_rating"}


def test_trained_model_reports_every_setting(spark):
    from caremart.plans.catalog import mart
    m = mart(spark, "/root/testdata/sf0.001")
    model = BO.train_boosted_model(m, k_values=(5, 20), rounds=(5, 10), depths=(2,), rates=(0.1, 0.3), folds=2, max_rows=2000)
    assert len(model.settings) == 8 and max(a for _, a in model.settings) == dict((str(s), a) for s, a in model.settings)[str(model.best_params)]
    assert 0.3 < model.test_accuracy <= 1 and model.feature_importance
    rows = BO.score(model, m.select("id", *BO.NUMERIC, *BO.CATEGORICAL)).collect()
    assert len(rows) == m.count() and all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["predicted_band"] in model.labels for r in rows[:50])
    assert BO.train_boosted_model(m.limit(20)) is None


def test_fit_over_cells_is_the_fit_over_their_rows(spark, monkeypatch):
    """F3 of round 4: rows of the same bins count once with their number, dealt over partitions, for all fits at once."""
    rng = np.random.default_rng(7)
    frame = pd.DataFrame({c: rng.integers(0, 6, 900).astype(float) for c in BO.NUMERIC}
                         | {c: rng.choice(list("abc"), 900) for c in BO.CATEGORICAL})
    score = frame["quality_rating"] + 2 * (frame["metric_name"] == "b") + rng.normal(size=900)
    frame["band"] = np.where(score > 4, "High", np.where(score > 2, "Medium", "Low"))
    frame["fold"] = rng.integers(-1, 3, 900).astype("int32")
    code = BO.Coding({c: [0.0, 1.0, 2.0, 3.0, 4.0] for c in BO.NUMERIC}, {c: list("abc") for c in BO.CATEGORICAL})
    labels = ["High", "Low", "Medium"]
    codes, y, fold = code.codes(frame), frame["band"].map(labels.index).to_numpy(), frame["fold"].to_numpy()
    monkeypatch.setattr(BO, "PART", (64, 200))
    monkeypatch.setattr(BO, "KEPT", 3)
    twice = spark.createDataFrame(pd.concat([frame, frame]))
    search = BO.Search(spark, *BO.cells(twice, code, labels, 3), code, 3, 3)
    assert search.counts[:, :code.starts[1]].sum() == 1800
    fits = [BO.Fit(5, 2, 0.3, 0, 8), BO.Fit(30, 3, 0.1, 2, 8), BO.Fit(30, 3, 0.1, None, 8)]
    models, found = search.run(fits, (4, 8))
    for i, (fit, model) in enumerate(zip(fits, models)):
        inside = (fold >= 0) & (fold != (-1 if fit.fold is None else fit.fold))
        two = lambda x: np.concatenate([x[inside], x[inside]])
        may = BO.best_features(two(codes), two(y), code, fit.k)
        plain = BO.Boosted(code, 3, fit.rate).fit(two(codes), two(y), may, fit.depth, 8)
        for (levels, leaves), (other, weights) in zip(plain.trees, model.trees):
            assert all((a == b).all() for a, b in zip(levels, other)) and np.allclose(leaves, weights)
        assert len(plain.trees) == len(model.trees) and model.gains == pytest.approx(plain.gains)
        for n in (4, 8):
            right = plain.scores(codes, n).argmax(axis=1) == y
            assert found[n][i].tolist() == pytest.approx([right[fold == s].mean() for s in range(-1, 3)])


def test_boosting_takes_the_whole_train_side(spark, monkeypatch):
    """F3 of round 4: no default bounds the rows of a fit."""
    import inspect

    from caremart.plans import model as ML
    from caremart.plans.catalog import mart
    assert inspect.signature(BO.train_boosted_model).parameters["max_rows"].default is None
    m, seen = mart(spark, "/root/testdata/sf0.001"), []
    run = BO.Search.run
    monkeypatch.setattr(BO.Search, "run", lambda self, *a: seen.append(self.counts) or run(self, *a))
    model = BO.train_boosted_model(m, k_values=(20,), rounds=(3,), depths=(2,), rates=(0.3,), folds=2)
    # every labelled row, of the train and the test side, lies in a bin of the first column
    assert seen[0][:, :model.boosted.code.starts[1]].sum() == ML.outcome_band(ML.model_frame(m)).dropna(subset=["band"]).count()
    # what the cells' counts give is what scoring the rows gives
    _, test = ML.stratified_split(ML.outcome_band(ML.model_frame(m)).dropna(subset=["band"]))
    scored = BO.score(model, test).selectExpr("avg(CAST(predicted_band = band AS DOUBLE)) AS a").first()["a"]
    assert model.test_accuracy == pytest.approx(scored)
