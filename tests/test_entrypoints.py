"""File-based entry points."""

import os
import tempfile

from tabtext.plans import entrypoints as EP


def _write(name, text):
    d = tempfile.mkdtemp(prefix="tabtext-ep-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_visualize_labels(spark):
    ok, why, t = EP.visualize_labels(spark, _write("a.csv", "label,x\n1,a\n0,b\n1,c\n"), "label")
    assert ok and [(r["label"], r["n"]) for r in t.collect()] == [(0, 1), (1, 2)]
    ok, why, t = EP.visualize_labels(spark, "/nonexistent.csv", "label")
    assert not ok and t is None
    ok, why, _ = EP.visualize_labels(spark, _write("b.csv", "x\n1\n"), "label")
    assert not ok and "label" in why


def test_check_class_difference(spark):
    tr = _write("tr.csv", "target,x\n0,1\n1,2\n")
    va = _write("va.csv", "target,x\n1,1\n2,2\n")
    same, diff = EP.check_class_difference(spark, tr, va, "target")
    assert not same
    assert {(r["value"], r["side"]) for r in diff.collect()} == {(0, "train_only"), (2, "valid_only")}


def test_validate_target_column(spark):
    assert EP.validate_target_column(spark, _write("t.csv", "target\n0\n1\n")).first()["ok"]
    assert EP.validate_target_column(spark, _write("t.csv", "target\n0\n\n2\n")).first()["rule"] == "gap"
    assert EP.validate_target_column(spark, _write("t.csv", "target\n0\nNA\n1\n")).first()["rule"] == "integer"
    assert EP.validate_target_column(spark, "/nope.csv").first()["rule"] == "source"


def test_vis(spark):
    cm = _write("cm.csv", ",0,1\n0,2,1\n1,0,3\n")
    res = _write("r.csv", "label,predicted_label,sentence\n0,0,a\n0,1,b\n1,1,c\n")
    cells, report = EP.vis(spark, cm, res)
    assert sum(r["n"] for r in cells.collect()) == 6
    rows = {(r["method"], r["class"]): r for r in report.collect()}
    assert abs(rows[("proposed", "all")]["accuracy"] - 2 / 3) < 1e-12


def test_plot_shap(spark):
    lines = ["sample,token,class,shap_value"]
    for s in range(4):
        lines += [f"{s},the,1,5.0", f"{s},good,1,{1.0 + s}", f"{s},bad,1,-0.5", f"{s},x y,0,0.1"]
    points, bars = EP.plot_shap(spark, _write("shap.csv", "\n".join(lines) + "\n"), num_appear=3, top_n=1)
    top = {(r["class"], r["token"]) for r in bars.collect()}
    assert top == {(1, "good"), (0, "xy")}  # 'the' excluded, blanks stripped
    assert points.count() == 8
