from math import exp, log

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import rates, scores
from pitchlake.operators import folds
from pitchlake.plans import backtest as bt
from pitchlake.plans import elo
from pitchlake.plans import goal_ratings as gr
from pitchlake.plans import models as m

from . import brute

LEAD = 86400


@pytest.fixture(scope="module")
def history():
    return brute.synthetic_matches(160)


@pytest.fixture(scope="module")
def matches(spark, history):
    return spark.createDataFrame(
        history,
        "match_id long, competition_key int, home_club_id int, away_club_id int, kickoff_at timestamp_ntz, "
        "result_observed_at timestamp_ntz, home_goals int, away_goals int",
    )


def expected_targets(history, min_train):
    for target in history:
        cutoff, training = brute.training_for(history, target, LEAD)
        if len(training) >= min_train:
            yield target, cutoff, training


@pytest.mark.parametrize("rho", [None, -0.08, 0.2])
def test_goal_models_equal_a_refit_per_target(matches, history, rho):
    model = m.PoissonModel() if rho is None else m.DixonColesModel(rho=rho)
    rows = {r["match_id"]: r for r in bt.walk_forward(matches, [model], [LEAD], min_train_matches=5).collect()}
    seen = set()
    for target, cutoff, training in expected_targets(history, 5):
        lam, mu, grid = brute.goal_grid(training, target, rho)
        row = rows[target["match_id"]]
        seen.add(target["match_id"])
        assert row["prediction_cutoff"] == cutoff
        assert row["train_match_count"] == len(training)
        assert row["data_cutoff"] == max(r["result_observed_at"] for r in training)
        assert row["expected_home_goals"] == pytest.approx(lam, abs=1e-12)
        assert row["expected_away_goals"] == pytest.approx(mu, abs=1e-12)
        p = brute.outcomes(grid)
        assert (row["p_home"], row["p_draw"], row["p_away"]) == pytest.approx(p, abs=1e-12)
        vector = brute.metric_vector(p, brute.outcome(target))
        assert (row["log_loss"], row["brier_score"], row["rps"]) == pytest.approx(vector, abs=1e-10)
        score = grid.get((target["home_goals"], target["away_goals"]), 0.0)
        assert row["score_log_loss"] == pytest.approx(-log(max(score, 1e-15)), abs=1e-10)
    assert seen == set(rows)


@pytest.mark.parametrize("segment_rows", [1_000_000, 45])
def test_elo_equals_a_sequential_refit(matches, history, segment_rows):
    targets = bt.make_targets(matches, [LEAD])
    models = [m.EloModel(), m.EloModel(k_factor=40.0, home_advantage=0.0)]
    ids = [m.config_id(x) for x in models]
    rows = elo.elo_forecasts(matches, targets, models, segment_rows).collect()
    found = {(r["match_id"], r["config_id"]): (r["p_home"], r["p_draw"], r["p_away"]) for r in rows}
    assert len(rows) == 2 * len(history)
    for target in history:
        _, training = brute.training_for(history, target, LEAD)
        for model, config in zip(models, ids):
            ratings = brute.elo_ratings(training, model.k_factor, model.home_advantage)
            p = brute.elo_outcomes(
                ratings.get(target["home_club_id"], 1500.0), ratings.get(target["away_club_id"], 1500.0),
                model.home_advantage,
            )
            assert found[target["match_id"], config] == pytest.approx(p, abs=1e-9)


def test_elo_ratings_do_not_depend_on_the_cuts(matches):
    def ratings(segment_rows):
        rows = elo.rating_history(matches, [m.EloModel()], segment_rows).drop("_seq").collect()
        return sorted((r["competition_key"], r["club_id"], r["result_observed_at"], r["ratings"][0]) for r in rows)

    whole = ratings(1_000_000)
    assert ratings(60) == whole and ratings(13) == whole and len(whole) == 2 * matches.count()


def played_one_by_one(history, model):
    """Attack and defence of the clubs of one competition after its results, in order of observation."""
    ratings = {}
    for r in sorted(history, key=lambda r: (r["result_observed_at"], r["kickoff_at"], str(r["match_id"]))):
        home, away = ratings.get(r["home_club_id"], (0.0, 0.0)), ratings.get(r["away_club_id"], (0.0, 0.0))
        lam = min(max(model.base_home_goals * exp(home[0] - away[1]), model.min_lambda), model.max_lambda)
        mu = min(max(model.base_away_goals * exp(away[0] - home[1]), model.min_lambda), model.max_lambda)
        more, other = model.learning_rate * (r["home_goals"] - lam), model.learning_rate * (r["away_goals"] - mu)
        ratings[r["home_club_id"]] = (home[0] + more, home[1] - other)
        ratings[r["away_club_id"]] = (away[0] + other, away[1] - more)
    return ratings


@pytest.mark.parametrize("segment_rows", [1_000_000, 45])
def test_goal_ratings_equal_a_sequential_refit(matches, history, segment_rows):
    models = [m.GoalRatingModel(), m.GoalRatingModel(learning_rate=0.2, base_home_goals=1.0)]
    rows = gr.goal_rating_forecasts(matches, bt.make_targets(matches, [LEAD]), models, segment_rows).collect()
    found = {(r["match_id"], r["config_id"]): (r["expected_home_goals"], r["expected_away_goals"]) for r in rows}
    assert len(rows) == 2 * len(history)
    for target in history:
        _, training = brute.training_for(history, target, LEAD)
        for model in models:
            ratings = played_one_by_one(training, model)
            home, away = ratings.get(target["home_club_id"], (0.0, 0.0)), ratings.get(target["away_club_id"], (0.0, 0.0))
            lam, mu = model.base_home_goals * exp(home[0] - away[1]), model.base_away_goals * exp(away[0] - home[1])
            expected = (min(max(lam, 0.05), 5.0), min(max(mu, 0.05), 5.0))
            assert found[target["match_id"], m.config_id(model)] == pytest.approx(expected, abs=1e-12)


def test_goal_ratings_do_not_depend_on_the_cuts(matches):
    def ratings(segment_rows):
        rows = gr.goal_rating_history(matches, [m.GoalRatingModel()], segment_rows).drop("_seq").collect()
        return sorted((r["competition_key"], r["club_id"], r["result_observed_at"], *r["ratings"]) for r in rows)

    whole = ratings(1_000_000)
    assert ratings(60) == whole and ratings(13) == whole and len(whole) == 2 * matches.count()


def counting(rows, state):
    """A running count per entry, told as text."""
    out, counts = [], {k: int(v) for k, v in state.items()}
    for who in rows["who"].tolist():
        counts[who] = counts.get(who, 0) + 1
        out.append(str(counts[who]))
    return [out]


@pytest.mark.parametrize("segment_rows", [1000, 7])
def test_fold_with_null_keys_two_key_columns_and_a_hot_key(spark, segment_rows):
    rows = [(None, "x", i, f"w{i % 3}") for i in range(5)] + [(1, None, i, "w0") for i in range(4)] + [(2, "x", i, f"w{i % 2}") for i in range(40)]
    df = spark.createDataFrame(rows, "a int, b string, at int, who string")
    fold = folds.Fold(("who",), "string", counting)
    out = folds.segmented_fold(df, fold, ["a", "b"], ["at"], keep=["at"], segment_rows=segment_rows).collect()
    seen, expected = {}, []
    for a, b, at, who in rows:
        seen[a, b, who] = seen.get((a, b, who), 0) + 1
        expected.append((a, b, who, at, str(seen[a, b, who])))
    assert sorted(map(str, expected)) == sorted(str((r["a"], r["b"], r["entry"], r["at"], r["value"])) for r in out)


@pytest.mark.parametrize("segment_rows", [1000, 150])
def test_fold_gives_python_a_batch_at_a_time(spark, segment_rows):
    def bounded(rows, state):
        if len(rows) > 50:
            raise ValueError(f"{len(rows)} rows at once")
        return counting(rows, state)

    # Entries of whole numbers and a null one, over many batches of one key.
    df = spark.range(400).selectExpr("cast(id div 390 as int) a", "id at", "nullif(id % 3, 2) who")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = folds.segmented_fold(df, folds.Fold(("who",), "string", bounded), ["a"], ["at"], keep=["at"], segment_rows=segment_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    seen, expected = {}, []
    for at in range(400):
        a, who = at // 390, None if at % 3 == 2 else at % 3
        seen[a, who] = seen.get((a, who), 0) + 1
        expected.append((a, at, who, str(seen[a, who])))
    assert sorted((r["a"], r["at"], r["entry"], r["value"]) for r in out) == sorted(expected)


def test_fold_of_no_rows(spark):
    df = spark.createDataFrame([], "a int, at int, who string")
    assert folds.segmented_fold(df, folds.Fold(("who",), "string", counting), ["a"], ["at"]).collect() == []


def test_goal_rating_settings_name_their_limits():
    with pytest.raises(ValueError, match="learning_rate is -1"):
        m.GoalRatingModel(learning_rate=-1)
    with pytest.raises(ValueError, match="base_home_goals is 9"):
        m.GoalRatingModel(base_home_goals=9)


def test_mixed_grid_keeps_one_row_per_run_and_target(matches, history):
    grid = [m.PoissonModel(), m.PoissonModel(max_goals=4), m.DixonColesModel(), m.EloModel(), m.FixedModel(0.4, 0.3, 0.3), m.GoalRatingModel()]
    rows = bt.walk_forward(matches, grid, [LEAD, 3600], min_train_matches=5)
    counts = rows.groupBy("config_id", "lead_time_seconds").agg(F.count("*").alias("n")).collect()
    assert len(counts) == 12
    day = len(list(expected_targets(history, 5)))
    assert {r["n"] for r in counts if r["lead_time_seconds"] == LEAD} == {day}
    assert bt.leakage(rows).isEmpty()


def test_leaks_are_counted_with_the_forecasts_in_one_pass(spark):
    from checks import forecasts

    sf = "/root/testdata/sf0.001"
    relations = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")
    walk = forecasts._walk(spark, sf, [m.PoissonModel()], forecasts.LEADS, market=True)
    assert 0 < relations(forecasts.leakage_check(spark, sf)) <= relations(walk)


def test_explicit_grid_agrees_with_the_sums(spark):
    df = spark.createDataFrame([(1.3, 0.9), (0.05, 5.0), (4.9, 0.05)], "l double, m double")
    for rho in (None, -0.08):
        grid = rates.score_grid(F.col("l"), F.col("m"), rho=rho)
        summed = rates.with_goal_outcomes(df, "l", "m", rho=rho or 0.0, home_goals=F.lit(2), away_goals=F.lit(1))
        out = summed.select(
            rates.outcomes_from_grid(grid).alias("g"), F.struct("p_home", "p_draw", "p_away", "p_actual_score").alias("f"), rates.grid_mass(grid).alias("mass"),
            F.size(grid).alias("cells"), rates.grid_cell(grid, F.lit(2), F.lit(1)).alias("c"),
            rates.grid_cell(grid, F.lit(9), F.lit(0)).alias("none"),
        )
        for r in out.collect():
            assert r["cells"] == 81 and r["mass"] == pytest.approx(1.0, abs=1e-12)
            assert tuple(r["g"]) == pytest.approx(tuple(r["f"])[:3], abs=1e-12)
            assert r["c"] == pytest.approx(r["f"]["p_actual_score"], abs=1e-12)
            assert r["none"] is None


def test_published_hand_values(spark):
    row = spark.range(1).select(
        scores.log_loss(F.lit(0.5), F.lit(0.3), F.lit(0.2), F.lit(0)).alias("ll"),
        scores.brier(F.lit(0.5), F.lit(0.3), F.lit(0.2), F.lit(0)).alias("b"),
        scores.ranked_probability(F.lit(0.5), F.lit(0.3), F.lit(0)).alias("r"),
        scores.log_loss(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0)).alias("zero"),
        scores.log_loss(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2)).alias("cap"),
        rates.elo_expected_home(F.lit(1500.0), F.lit(1500.0)).alias("e"),
        F.struct(*[c.alias(n) for n, c in zip("hda", rates.elo_outcomes(F.lit(1500.0), F.lit(1500.0)))]).alias("o"),
    ).first()
    assert row["ll"] == pytest.approx(0.693147, abs=1e-6)
    assert row["b"] == pytest.approx(0.126667, abs=1e-6)
    assert row["r"] == pytest.approx(0.145)
    assert row["zero"] == 0 and row["cap"] == pytest.approx(-log(1e-15))
    assert row["e"] == pytest.approx(0.592466, abs=1e-6)
    assert row["o"]["d"] == pytest.approx(0.242279, abs=1e-6)
    assert row["o"]["h"] == pytest.approx(0.448924, abs=1e-6)


def test_parameter_checks():
    for bad in (
        lambda: m.PoissonModel(smoothing_matches=0),
        lambda: m.PoissonModel(max_goals=2),
        lambda: m.DixonColesModel(rho=0.5),
        lambda: bt.BacktestConfig(0),
        lambda: bt.BacktestConfig(60, min_train_matches=0),
        lambda: bt.BacktestConfig(60, seed=-1),
        lambda: bt.BacktestConfig(60, bootstrap_samples=99),
    ):
        with pytest.raises(ValueError):
            bad()


def test_mean_score_grid_is_the_mean_of_the_grids(spark, monkeypatch):
    monkeypatch.setattr(rates, "GRID_ROWS", 3)  # a batch in several parts
    values = [0.05, 0.3, 1.4, 5.0, 30.0]
    rows = spark.createDataFrame([(("a", "b", None)[k % 3], x, y) for k, (x, y) in enumerate((x, y) for x in values for y in values)], "k string, l double, m double")
    for rho, top in ((None, 8), (-0.08, 8), (0.2, 3), (0.2, 0)):
        cells = rows.select("k", F.inline(rates.score_grid(F.col("l"), F.col("m"), rho=rho, max_goals=top)))
        want = {(r["k"], r["h"], r["a"]): r for r in cells.groupBy("k", "h", "a").agg(F.count("*").alias("n"), F.avg("p").alias("p")).collect()}
        found = rates.mean_score_grid(rows, "k", "l", "m", rho=rho, max_goals=top)
        assert "transform" not in found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["k"], r["home_goals"], r["away_goals"]): r for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(got[c]["forecasts"] == want[c]["n"] and got[c]["mean_probability"] == pytest.approx(want[c]["p"], rel=1e-12) for c in want)
    assert rates.mean_score_grid(rows.limit(0), "k", "l", "m").count() == 0
    for bad in ("null", "1000"):  # e**-1000 is 0
        with pytest.raises(Exception, match="no probability mass"):
            rates.mean_score_grid(rows.withColumn("l", F.expr(f"cast({bad} as double)")), "k", "l", "m").collect()


def test_score_grid_means_adds_up_grids_before_they_are_rows(spark):
    from checks import forecasts

    plan = forecasts.score_grid_means(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "inline(" not in plan.split("MapInArrow")[0]
