"""The panel's one pass gives what the single metrics give."""

import numpy as np
import pytest

from foldwright.operators import metrics


@pytest.mark.parametrize("classes", [2, 4])
def test_panel_equals_single_metrics(spark, classes):
    rng = np.random.default_rng(classes)
    p = rng.dirichlet(np.ones(classes), 300)
    y = rng.integers(0, classes, 300)
    rows = [(int(i % 3), int(y[i]), int(p[i].argmax()), [float(v) for v in p[i]]) for i in range(300)]
    preds = spark.createDataFrame(rows, "run int, y int, pred int, proba array<double>")
    got = {r["run"]: r.asDict() for r in metrics.classification_panel(preds, ["run"]).collect()}
    singles = (metrics.class_metrics, metrics.roc_auc, metrics.log_loss, metrics.expected_calibration_error, metrics.brier_score)
    assert sorted(got) == [0, 1, 2]
    for single in singles:
        for r in single(preds, ["run"]).collect():
            for name, value in r.asDict().items():
                assert got[r["run"]][name] == pytest.approx(value, abs=1e-12)
