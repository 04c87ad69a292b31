"""The label search against trying every pair, on random catalogues and targets."""

import random

import pytest

from sunmelt import runtime
from sunmelt.operators import labels


def brute(sites, materials, low, high):
    out = {}
    for city, season, t_set, index in sites:
        if t_set is None:
            out[city, season] = None
            continue
        target = t_set + labels.SEASON_OFFSETS[season]
        tol = low if index is not None and index < labels.INDEX_THRESHOLD else high
        known = [m for m in materials if m[2] is not None]
        near = [m for m in known if target - tol <= m[2] <= target + tol]
        if near:
            best = min(near, key=lambda m: (float("inf") if m[3] is None else -m[3], m[1], m[0]))
        elif known:
            best = min(known, key=lambda m: (abs(m[2] - target), m[1], m[0]))
        else:
            best = None
        out[city, season] = best and (best[1], best[0])
    return out


@pytest.mark.parametrize("seed, cell, spread", [(1, None, False), (2, 1.3, False), (3, 0.25, False), (4, None, True)])
def test_label_search_equals_brute_force(spark, monkeypatch, seed, cell, spread):
    if spread:  # take the ways meant for tables too large for one task or a broadcast
        for module in (runtime, labels):
            monkeypatch.setattr(module, "fits_broadcast", lambda *_: False)
    rnd = random.Random(seed)
    # a third of the materials share one melting point and a third of the sites one setpoint
    materials = [
        (i, f"m{rnd.randrange(40):02d}",
         None if rnd.random() < 0.05 else 50.0 if rnd.random() < 0.33 else round(rnd.uniform(-10, 120), rnd.choice([0, 2])),
         None if rnd.random() < 0.1 else round(rnd.random(), 1))
        for i in range(8 if seed == 3 else 60)
    ]
    sites = [
        (f"c{i}", season,
         None if rnd.random() < 0.03 else 45.0 if rnd.random() < 0.33 else round(rnd.uniform(-60, 160), 1),
         None if rnd.random() < 0.1 else rnd.uniform(0, 12))
        for i in range(40) for season in labels.SEASON_OFFSETS
    ]
    low, high = rnd.choice([(6.0, 4.0), (2.5, 2.5), (3.0, 5.0)])
    got = labels.assign_labels(
        spark.createDataFrame(sites, "city string, season string, T_set double, rrtdhs_approx double"),
        spark.createDataFrame(materials, "material_id int, product string, Tm_melting double, pcm_suitability_score double"),
        low, high, cell=cell,
    ).collect()
    assert len(got) == len(sites)
    want = brute(sites, materials, low, high)
    found = {
        (r["city"], r["season"]): r["best_pcm_product"] and (r["best_pcm_product"], r["best_pcm_id"])
        for r in got
    }
    assert found == want


def test_cell_must_not_exceed_a_tolerance(spark):
    with pytest.raises(ValueError):
        labels.assign_labels(None, None, 6.0, 4.0, cell=5.0)
