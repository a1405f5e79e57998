import numpy as np
import pytest

from lexigraph.operators import metrics


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_quantiles_are_exact(spark, buckets):
    """Against numpy: ties, one value, very close and very far values, nulls; also with few buckets (many rounds)."""
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=301), "b": [5.0] * 40, "c": [1.0], "d": [1.0, np.nextafter(1.0, 2.0), 1e300, -1e300, 0.0], "e": list(rng.integers(0, 4, 100) / 2)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None)]
    df = metrics.cube_rows(spark.createDataFrame(rows, "g string, latency double"), ["g"], "latency")
    got = {(r["__g"]["__set"], r["__g"]["g"]): r["q"] for r in metrics.exact_quantiles(df, (0.0, 0.5, 0.95, 1.0), buckets=buckets).collect()}
    want = {(1, g): np.quantile(v, (0, 0.5, 0.95, 1)) for g, v in groups.items()} | {(0, None): np.quantile(np.concatenate(list(groups.values())), (0, 0.5, 0.95, 1))}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-12)


def test_rolled_up_rows_differ_from_null_keys(spark):
    log = spark.createDataFrame([(None, 1.0, False), ("x", 3.0, True)], "task string, latency double, failed boolean")
    got = sorted((str(r["task"]), r["requests"], r["p50"], r["error_rate"]) for r in metrics.log_metrics(log, ["task"]).collect())
    assert got == [("None", 1, 1.0, 0.0), ("None", 2, 2.0, 0.5), ("x", 1, 3.0, 1.0)]
