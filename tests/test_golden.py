"""Published figures of one recorded run, typed in as literals."""

from lossloom.operators import health, reports

VALIDATION = [
    4.694457685947418, 4.2100638270378115, 3.611502802371979, 3.124404078722, 2.8262981712818145, 2.7826937258243563,
    2.8046405583620073, 2.8748942375183106, 2.825864037871361, 2.7027123659849166, 2.77239476442337, 2.679754526913166,
    2.7519548401236533, 2.8908685237169265, 2.7719855561852453, 2.8132783859968185, 2.8820638000965118, 2.691628929972649,
    2.7687769502401354, 2.7051554784178733,
]
ACTIONS = (
    ["new_best"] * 5 + ["stable"] * 4 + ["new_best"] + ["stable"] * 3
    + ["degraded", "stable", "degraded", "rollback_next"] + ["stable"] * 3
)


def test_round_health_matches_the_recorded_run(spark):
    rows = spark.createDataFrame(
        [("s", i, v, True) for i, v in enumerate(VALIDATION)],
        "section_id string, round_id int, decision_loss double, complete boolean",
    )
    got = health.round_health(rows).orderBy("round_id").collect()
    assert [r.action for r in got] == ACTIONS
    assert got[16].rollback_round == 14
    best = health.running_best(rows).orderBy("round_id").collect()
    assert [r.best_so_far for r in best] == [min(VALIDATION[: i + 1]) for i in range(20)]


def test_eval_summary_matches_the_recorded_run(spark):
    base = [0.25499504804611206, 1.933163046836853, 2.0299930572509766, 2.630280017852783, 1.9754043817520142,
            3.3869922161102295, 2.6048643589019775, 2.5880396366119385, 2.3444700241088867, 2.426323890686035]
    run = [1.3879107236862183, 2.2230679988861084, 2.6779589653015137, 5.623176097869873, 3.2033910751342773,
           4.43176794052124, 3.2633543014526367, 3.6331100463867188, 2.920197010040283, 3.289865732192993]
    rows = [("h", n, i + 1, v) for n, vs in (("base", base), ("run", run)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "eval_set string, run string, batch_index int, loss double")
    got = {r.run: r for r in reports.eval_summary(df, "base").collect()}["run"]
    assert abs(got.avg_loss - 3.265379989147186) < 1e-12
    assert abs(got.delta_vs_baseline - 1.0479274213314054) < 1e-12
    assert abs(got.pct_gap_vs_baseline - 0.4725816626434663) < 1e-12
    assert (got.first_loss, got.last_loss) == (run[0], run[-1])
