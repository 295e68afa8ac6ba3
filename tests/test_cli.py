from tidemark import cli


def test_unknown_names_are_refused(capsys):
    assert cli.main(["nothing"]) == 2 and "heavyhitters" in capsys.readouterr().out


def test_demos(spark):
    assert cli.panes(spark).selectExpr("windows = equal").first()[0]
    got = cli.restart(spark).first()
    assert got.results > 40 and got.missing == got.extra == 0
    rows = cli.lateness(spark).collect()
    assert [r.dropped_too_late for r in rows] == sorted((r.dropped_too_late for r in rows), reverse=True) and rows[-1].dropped_too_late == 0
