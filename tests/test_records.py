import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.errors import DataError, PreregistrationError, SignificanceError
from lattica.functions import journal
from lattica.functions import preregistration as pre
from lattica.functions import significance as sig
from lattica.operators.events import EventKillCriteria
from lattica.sources import vendor

MECHANISM = "Funds that must sell after index deletions accept lower prices for immediacy, and whoever waits for them is paid for bearing the inventory until others return."


def claim(**more):
    base = dict(name="deletions", claim="deleted names rebound", edge_source=pre.EdgeSource.STRUCTURAL_CONSTRAINT, mechanism=MECHANISM, universe="US common stocks", horizon_bars=20, warmup_bars=10, parameters=("window",), trial_budget=3)
    return pre.Hypothesis(**base | more)


PASSING = dict(ic_mean=0.03, ic_t_statistic=4.0, monotonicity=0.9, oos_fold_win_rate=0.7, folds_scored=8, folds_testable=True, annual_turnover=6.0, survived_deflation=True, trials_used=3, test_window_bars=252)


def test_verdicts():
    judge = lambda **more: pre.assess(claim(), pre.Evidence(**PASSING | more))
    assert judge() == (pre.Verdict.SURVIVED, ())
    for more, name in ((dict(ic_mean=None), "min_ic"), (dict(ic_t_statistic=1.0), "min_ic_t_statistic"), (dict(annual_turnover=20.0), "max_annual_turnover"), (dict(survived_deflation=False), "require_deflation_survival")):
        verdict, found = judge(**more)
        assert verdict is pre.Verdict.KILLED and [v.criterion for v in found] == [name]
    assert "not measured" in judge(survived_deflation=None)[1][0].detail and "lucky" in judge(survived_deflation=False)[1][0].detail
    assert judge(ic_t_statistic=-4.0)[0] is pre.Verdict.SURVIVED
    for more, name in ((dict(test_window_bars=10), "warmup_exceeds_window"), (dict(folds_scored=0), "no_folds"), (dict(folds_testable=False), "never_traded"), (dict(trials_used=4), "trial_budget_exceeded")):
        verdict, found = judge(**more)
        assert verdict is pre.Verdict.INVALID and [v.criterion for v in found] == [name]
    with pytest.raises(PreregistrationError, match="EventKillCriteria"):
        pre.assess(claim(kill=EventKillCriteria()), pre.Evidence())


def test_claims_and_fingerprints():
    assert claim(notes="x").fingerprint == claim().fingerprint != claim(horizon_bars=21).fingerprint
    assert claim(mechanism=MECHANISM.replace(" ", "  ")).fingerprint == claim().fingerprint
    assert len(claim().fingerprint) == 16
    for more in (dict(mechanism="short"), dict(universe=" "), dict(horizon_bars=0), dict(warmup_bars=-1), dict(trial_budget=0), dict(parameters=("a", "b", "c", "d"))):
        with pytest.raises(ValueError):
            claim(**more)


def test_journal(spark, tmp_path):
    folder = tmp_path / "journal"
    book = journal.Journal(spark, str(folder))
    trials = lambda *rows: spark.createDataFrame(rows, "fingerprint string, sharpe double, label string")
    with pytest.raises(PreregistrationError, match="not registered"):
        book.record_trials(trials(("x", 1.0, "")))
    mark, other = book.register(claim(notes="first"), claim(horizon_bars=21))
    assert book.register(claim()) == [mark] and book.claims().count() == 2
    book.record_trials(trials(*[(mark, 0.1 * i, "a") for i in range(5)]))
    with pytest.raises(PreregistrationError, match="not registered"):
        book.record_trials(trials((mark, 1.0, "b"), ("y", 1.0, "b")))
    book.record_verdict(mark, *pre.assess(claim(), pre.Evidence(**PASSING)))
    book.record_verdict(mark, pre.Verdict.KILLED, [pre.Violation("min_ic", "low")])
    again = journal.Journal(spark, str(folder)).checked()
    found = {r.fingerprint: r for r in again.standing().collect()}
    assert (found[mark].trials, found[mark].verdict, found[mark].over_budget) == (5, "killed", True) and found[mark].best_sharpe == pytest.approx(0.4)
    assert (found[other].trials, found[other].verdict, found[other].over_budget) == (0, None, False)
    assert again.trials().count() == 5


def test_an_altered_journal_is_found_out(spark, tmp_path):
    def written(name):
        book = journal.Journal(spark, str(tmp_path / name))
        (mark,) = book.register(claim())
        book.record_trials(spark.createDataFrame([(mark, 0.5, "b"), (mark, 0.7, "c")], "fingerprint string, sharpe double, label string"))
        book.record_verdict(mark, pre.Verdict.SURVIVED, [])
        return book, mark

    def altered(name, change):
        book, mark = written(name)
        for path in (tmp_path / name).glob("part-*"):
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
            path.write_text("".join(change(x, mark) for x in path.read_text().splitlines(keepends=True)))
        return {(r.batch, r.fault) for r in book.faults().collect()}

    assert altered("same", lambda line, _: line) == set()
    assert {(0, "changed"), (0, "misfiled"), (1, "unchained")} <= altered("claim", lambda line, _: line.replace("deletions", "additions"))
    assert {(1, "changed"), (2, "unchained")} <= altered("trial", lambda line, _: line.replace("0.5", "0.9"))
    assert altered("removed", lambda line, _: "" if '\\"c\\"' in line else line) == {(2, "unchained")}
    assert (None, "unreadable") in altered("broken", lambda line, _: "{}\n" if "survived" in line else line)
    assert {(1, "unregistered"), (1, "changed")} <= altered("moved", lambda line, mark: line.replace(f'"fingerprint":"{mark}"', '"fingerprint":"z"') if '"trial"' in line else line)
    with pytest.raises(PreregistrationError, match="not as it was written"):
        journal.Journal(spark, str(tmp_path / "trial")).checked()


def test_deflation_of_many_trials_equals_one_at_a_time(spark):
    rng = random.Random(6)
    paths = {i: [rng.gauss(0.001 * (i % 5), 0.01) for _ in range(60)] for i in range(40)} | {40: [], 41: [0.01]}
    frame = spark.createDataFrame([(i, r) for i, p in paths.items() for r in p or [float("nan")]], "trial int, net double")
    found = {r.trial: r for r in sig.deflation(frame, "net", ["trial"]).collect()}
    ledger = sig.TrialLedger()
    for i, p in paths.items():
        ledger.record(p, str(i))
    for i in range(40):
        want = ledger.report(paths[i])
        assert found[i].n_trials == 42 and found[i].sharpe == pytest.approx(want.sharpe) and found[i].expected_max == pytest.approx(want.expected_max, abs=1e-9)
        assert found[i].probabilistic == pytest.approx(want.probabilistic, abs=1e-9) and found[i].deflated == pytest.approx(want.deflated, abs=1e-9)
    assert found[40].sharpe == found[41].sharpe == 0 and not found[40].survives and not found[0].identical
    ends = spark.range(1).select(*[sig.cdf(F.lit(x)).alias(f"c{i}") for i, x in enumerate((-9.0, -3.0, 0.0, 1.5, 7.5))]).first()
    assert [round(v, 12) for v in ends] == [round(sig.normal_cdf(x), 12) for x in (-9.0, -3.0, 0.0, 1.5, 7.5)]


def test_significance(spark):
    rng = random.Random(2)
    noise = [[rng.gauss(0.0004, 0.012) for _ in range(500)] for _ in range(50)]
    ledger = sig.TrialLedger()
    for i, r in enumerate(noise):
        ledger.record(r, str(i))
    winner = noise[ledger.best()[0]]
    report = ledger.report(winner)
    assert report.probabilistic > 0.95 and not report.survives_deflation
    strong = [rng.gauss(0.0018, 0.012) for _ in range(2000)]
    assert sig.deflated_sharpe(strong, [s for _, s in ledger.trials]).survives_deflation
    assert ledger.record([0.0, 0.0]) == 0.0 and ledger.n_trials == 51
    assert sig.normal_cdf(sig.normal_ppf(0.9)) == pytest.approx(0.9) and sig.expected_max_sharpe(1, 1.0) == 0
    row = sig.moments(spark.createDataFrame([(x,) for x in [*winner, None, math.nan, math.inf]], "r double"), "r").first()
    assert row.n == 500 and sig.psr(row.n, row.sharpe, row.skew, row.kurtosis) == pytest.approx(report.probabilistic)
    for wrong in (lambda: sig.sharpe_ratio([1.0]), lambda: sig.sharpe_ratio([1.0, 1.0]), lambda: sig.deflated_sharpe([1, 2], []), lambda: sig.deflated_sharpe([1, 2], [1.0] * 3), lambda: sig.normal_ppf(1.0)):
        with pytest.raises(SignificanceError):
            wrong()


def write(path, header, rows):
    path.write_text("\n".join([",".join(header), *(",".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n")
    return str(path)


def test_legacy_file(spark, tmp_path):
    rows = []
    for i in range(30):
        d = f"2020-01-{i + 1:02d}"
        rows.append((10001, d, 10 + i, 100, "C" if i == 3 else 0.01, 11, 1, "ONE", None))
        if i <= 15:
            rows.append((10002, d, 20, 100, 0.0, 11, 3, "TWO", -0.85 if i == 15 else None))
        rows.append((10003, d, -5 if i % 7 == 6 else 5, 100, 0.0, 11, 1, "THREE", None))
        rows.append((10004, d, 1, 1, 0.0, 73, 1, "FUND", None))
        rows.append((10005, d, 1, 1, 0.0, 11, 9, "FAR", None))
    path = write(tmp_path / "d.csv", "PERMNO,date,PRC,VOL,RET,SHRCD,EXCHCD,TICKER,DLRET".split(","), rows)
    data = vendor.load_daily_legacy(spark, path)
    known = {r.asset: r for r in data.securities.collect()}
    assert set(known) == {"10001", "10002", "10003"} and known["10002"].delist_ret == -0.85 and str(known["10002"].last_tradable) == "2020-01-16" and known["10001"].last_tradable is None and known["10002"].ticker == "TWO"
    cells = {(r.t, r.asset): r for r in data.panel.collect()}
    assert cells[6, "10003"].close is None and cells[6, "10003"].adv == 500 and cells[3, "10001"].ret is None and len(cells) == 90
    row = data.summary().first()
    assert row.n_securities == 3 and row.delisted == 1 and not row.survivorship_warning
    assert not vendor.is_new_layout(spark, path) and vendor.load_extract(spark, path).panel.count() == 90
    found = {(r.section, r.key): r for r in vendor.verify_extract(data).collect()}
    assert {k for k, _ in found} == {"all", "breadth", "moves", "universe"} and vendor.exit_code(vendor.verify_extract(data)) == 0
    assert found["all", "delisting_returns"].value == 1 and found["all", "delisting_worse_than_half"].severity == "OK" and found["breadth", "2020"].severity == "FLAG"
    assert found["all", "attrition_per_year"].value == pytest.approx(1 / 3 / 0.1) and found["universe", "max_members"].value == 0
    alive = vendor.Dataset(data.panel, data.securities.withColumns({"last_tradable": F.lit(None).cast("date"), "delist_ret": F.lit(None).cast("double")}))
    fatal = {r.key: r.severity for r in vendor.verify_extract(alive).where("section = 'all'").collect()}
    assert fatal["attrition_per_year"] == "FATAL" and fatal["delisting_returns"] == "FLAG" and vendor.exit_code(vendor.verify_extract(alive)) == 1
    with pytest.raises(DataError, match="lacks columns"):
        vendor.load_daily_legacy(spark, write(tmp_path / "x.csv", ["permno"], [(1,)]))
    with pytest.raises(DataError, match="survive"):
        vendor.load_daily_legacy(spark, path, share_codes=(99,))


def test_ciz_file(spark, tmp_path):
    header = "PERMNO,DlyCalDt,DlyPrc,DlyPrcFlg,DlyVol,DlyRet,ShareType,PrimaryExch,Ticker,SecurityType,SecuritySubType,IssuerType,USIncFlg".split(",")
    row = lambda p, d, price, flag="TR", ret=0.01, share="NS", exch="N", kind="EQTY", sub="COM", issuer="CORP", us="Y": (p, f"2020-01-{d:02d}", price, flag, 10, ret, share, exch, "T", kind, sub, issuer, us)
    rows = [row(40000, d, 10.0, "BA" if d == 3 else "TR", None if d == 1 else 0.01) for d in range(1, 7)]
    rows.insert(1, row(40000, 1, 99.0))  # a repeat: the first row counts
    rows += [row(40001, d, 10.0 if d < 5 else 0.08, "DP" if d == 5 else "TR") for d in range(1, 6)]
    rows += [row(40002, d, 10.0, share="ADR") for d in range(1, 7)] + [row(40003, d, 10.0, exch="X") for d in range(1, 7)]
    rows += [row(40004, d, 10.0, sub="ETF") for d in range(1, 7)] + [row(40005, d, 10.0, us="N") for d in range(1, 7)]
    path = write(tmp_path / "c.csv", header, rows)
    gone = write(tmp_path / "g.csv", ["PERMNO", "DLRET"], [(40001, -0.5), (40001, -0.72), (40001, "A")])
    data = vendor.load_extract(spark, path, gone)
    assert vendor.is_new_layout(spark, path)
    cells = {(r.asset, r.t): r for r in data.panel.collect()}
    assert {a for a, _ in cells} == {"40000", "40001"}
    assert cells["40000", 2].close is None and cells["40000", 2].close_raw == 10.0
    assert [cells["40000", t].close for t in (0, 1, 3)] == pytest.approx([10.0, 10.1, 10 * 1.01**3]) and cells["40001", 4].close is None
    known = {r.asset: r for r in data.securities.collect()}
    assert known["40001"].delist_ret == -0.72 and str(known["40001"].last_tradable) == "2020-01-04"
    with pytest.raises(DataError, match="no delisting-return.*delrettype"):
        vendor.load_delistings(spark, write(tmp_path / "n.csv", ["permno", "delrettype"], [(1, "x")]))
    with pytest.raises(DataError, match="classification"):
        vendor.load_daily_ciz(spark, write(tmp_path / "m.csv", header[:9], [r[:9] for r in rows]))
    with pytest.warns(UserWarning):
        vendor.load_daily_ciz(spark, write(tmp_path / "w.csv", [h for h in header if h != "DlyPrcFlg"], [r[:3] + r[4:] for r in rows]))


def test_an_extract_is_computed_once(spark):
    p = spark.range(120).selectExpr("cast(id div 3 as int) as t", "date_add(date'2020-01-01', cast(id div 3 as int)) as ts", "cast(id % 3 as string) as asset", "if(id % 7 = 0, null, 10.0D + id % 11) as close", "1e7D as adv")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = {(r.section, r.key): r.value for r in vendor.verify_extract(vendor.dataset_from_panel(p.mapInArrow(counted, p.schema))).collect()}
    assert found["all", "coverage"] == pytest.approx(102 / 120) and found["universe", "max_members"] == 3
    assert seen.value == 120


def test_share_of_moves_away_from_an_exit_is_of_all_moves(spark):
    # 450 assets move once and stay; later 1550 move once, in their last week
    close = "case when id div 4 < 450 then if(id % 4 = 0, 10.0D, 100.0D) when id % 4 < 2 then 10.0D when id % 4 = 2 then 100.0D end as close"
    p = spark.range(8000).selectExpr("cast(id % 4 as int) as t", "date_add(date'2020-01-06', cast(id % 4 * 7 as int)) as ts", "cast(id div 4 as string) as asset", close, "1e7D as adv")
    found = {r.key: r for r in vendor.verify_extract(vendor.dataset_from_panel(p)).where("section = 'moves'").collect()}
    assert found["large"].value == 2000 and found["cheap"].value == 0
    assert found["away_from_exit"].value == pytest.approx(450 / 2000) and found["away_from_exit"].severity == "OK"


def test_point_in_time(spark):
    frame = spark.createDataFrame([("2020-01-01", "2020-02-10"), ("2020-01-01", "2020-02-20"), ("2020-01-01", None)], "datadate string, rdq string").selectExpr("cast(datadate as date) datadate", "cast(rdq as date) rdq")
    row = vendor.check_point_in_time(frame).first()
    assert (row.median_days, row.undated, row.n) == (45.0, 1, 3)
    with pytest.raises(DataError):
        vendor.check_point_in_time(frame.drop("rdq"))


def test_refusals():
    for wrong in (dict(max_annual_turnover=0.0), dict(max_annual_turnover=-1.0), dict(min_oos_fold_win_rate=1.5), dict(min_capacity=-1.0)):
        with pytest.raises(ValueError):
            pre.KillCriteria(**wrong)
    ledger = sig.TrialLedger()
    with pytest.raises(SignificanceError):
        ledger.best()
    for r in ([0.0, 1.0, 0.5], [0.0, 2.0, 1.9], [0.0, 2.0, 1.9]):
        ledger.record(r)
    assert ledger.best()[0] == 1


def test_bars_are_part_of_the_claim():
    assert json.dumps(pre.KillCriteria().to_json()) and EventKillCriteria().to_json()["min_events"] == 30
    assert claim(kill=pre.KillCriteria(min_ic=0.02)).fingerprint != claim().fingerprint
