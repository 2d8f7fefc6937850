"""Range-bucketed exact quantiles equal numpy's linear quantiles, also for a hot group."""

import numpy as np
import pytest

from wattline.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy_with_hot_group(spark):
    rng = np.random.default_rng(0)
    hot = np.round(rng.gamma(2.0, 10.0, 3000), 2)          # one group with a third of the rows ...
    rows = [("hot", float(x)) for x in hot]
    others = {}
    for g in range(6):
        vals = np.round(rng.normal(50, 5, 1000), 2)
        others[f"g{g}"] = vals
        rows += [(f"g{g}", float(x)) for x in vals]
    df = spark.createDataFrame(rows, "g string, v double")
    levels = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p95": 0.95}
    got = {r.g: r for r in exact_quantiles(df, "v", levels, by=["g"], n_ranges=16).collect()}
    for g, vals in {"hot": hot, **others}.items():
        for name, q in levels.items():
            assert getattr(got[g], name) == pytest.approx(float(np.quantile(vals, q)), abs=1e-9)
    whole = exact_quantiles(df, "v", {"p50": 0.5}).first()
    assert whole.p50 == pytest.approx(float(np.quantile(np.concatenate([hot, *others.values()]), 0.5)))
