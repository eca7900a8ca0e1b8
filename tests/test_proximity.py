"""Objects near synapses by cells, against all distances."""

import math

import numpy as np
import pytest
from growth import shuffled_rows

from voxloom.operators import synapses as C


@pytest.mark.parametrize("chunk", [50, 200_000])
def test_objects_and_synapses_are_moved_once(spark, monkeypatch, chunk):
    """60 synapses with two partners, 300 objects of three cells with up to four vertices, of which nearly every pair is close enough to be looked at."""
    monkeypatch.setattr(C, "DISTANCES", chunk, raising=False)
    rng = np.random.default_rng(9)
    place = lambda spread: [float(v) for v in np.round(rng.uniform(0, spread, 3), 2)]
    syn = [(s, c, *p) for s in range(60) for p in [place(25)] for c in (s % 4, s % 4 + 1)] + [(60, 1, 5.0, 5.0, 5.0), (61, 1, 900.0, 0.0, 0.0), (62, 2, 0.0, 0.0, 0.0)]
    vox = [(s, *place(25)) for s in range(60) for _ in range(1 + s % 20)] + [(61, 900.0, 0.0, 0.0), (62, None, 0.0, 0.0), (62, 3.0, 3.0, 3.0)]  # 60 has none
    obj = [(o, 1 + o % 3, (o % 50) if o % 7 else None, *place(25)) for o in range(300)]
    vert = [(o, *place(25)) for o in range(290) for _ in range(1 + o % 4)] + [(3, None, 1.0, 1.0), (4, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0)]
    at = "x double, y double, z double"
    made = [
        spark.createDataFrame(rows, kind).cache()
        for rows, kind in ((syn, f"syn_id long, cell_id long, {at}"), (vox, f"syn_id long, {at}"), (obj, f"obj_id long, cell_id long, size long, {at}"), (vert, f"obj_id long, {at}"))
    ]
    for df in made:
        df.count()
    got = []
    assert shuffled_rows(spark, lambda: got.extend(C.proximity(*made, 18.0, 6.5).collect())) < 6000
    want = {}
    for s, c, *rep in syn:
        n, voxels, least = 0, 0.0, 1e12
        mine = [v[1:] for v in vox if v[0] == s and None not in v]
        for o, oc, size, *centre in obj:
            own = [v[1:] for v in vert if v[0] == o]
            if oc != c or math.dist(rep, centre) > 18.0:
                continue
            d = [min((math.dist(p, q) for q in mine), default=math.inf) for p in own if None not in p]
            d = [v for v in d if v < 6.5]
            if d:
                least = min([least, *d])
                if size is not None:
                    n, voxels = n + (size > 0), voxels + len(d) / len(own) * size
        want[s, c] = (n, round(voxels, 6), round(least, 6))
    assert len(got) == len(syn) and {(r.syn_id, r.cell_id): (r.n_objects, round(r.voxels, 6), round(r.min_dist, 6)) for r in got} == want
    assert sum(n > 0 for n, _, _ in want.values()) > 50
