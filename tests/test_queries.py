import os

import pytest

from geoloom.plans.queries import ORACLES, QUERIES, coarse, fine
from tests.oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_sharpened_cells(spark, name):
    """Queries without SQL: every fine cell of a modelled scene once, with a value near the coarse ones (brute force: test_models)."""
    sf = "/root/testdata/sf0.01" if name == "thermal_sharpening" else SF  # blocks of the smaller one are too sparse
    out = QUERIES[name](spark, sf).collect()
    cells = {(r.scene, r.iy, r.ix) for r in fine(spark, sf).collect()}
    seen = {(r.scene, r.iy, r.ix): r.lst_downscaled for r in out}
    assert len(seen) == len(out) and set(seen) <= cells and len({k[0] for k in seen}) > 10
    means = {(r.scene, r.iy, r.ix): r.lst for r in coarse(spark, sf).collect()}
    known = [(v, means[k[0], k[1] // 4, k[2] // 4]) for k, v in seen.items() if v is not None]
    assert len(known) > 0.9 * len(seen)
    assert sum(abs(a - b) for a, b in known) / len(known) < 0.5 * (max(means.values()) - min(means.values()))
    if name in ("atpk_field", "thermal_sharpening"):
        block = {}
        for k, v in seen.items():
            block.setdefault((k[0], k[1] // 4, k[2] // 4), []).append(v)
        fixed = [abs(sum(v) / len(v) - means[k]) < 1e-5 for k, v in block.items()]
        assert sum(fixed) > (0.99 if name == "atpk_field" else 0.2) * len(fixed)
