import numpy as np
import pandas as pd

from punctum.operators.raster import MaskParams, mask_pixels, objects, stain_mask


def test_objects_are_eight_connected():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    label = objects(m)
    assert label[0, 0] == label[1, 1] == 1 and label[0, 3] == label[1, 3] == 4 and len(set(label[m])) == 4 and not label[~m].any()


def test_mask_keeps_large_objects_and_grows_them(spark):
    img = np.zeros((60, 80))
    img[10:22, 10:22] = 200.0
    img[40:43, 60:63] = 200.0  # too small
    p = MaskParams(block=31, area=100, radius=3)
    m = stain_mask(img, p)
    assert m[16, 16] and m[16, 24] and m[7, 15] and not m[16, 25] and not m[41, 61] and not m[7, 7]
    df = spark.createDataFrame([(1.5, 60, 80, img.ravel().tolist()), (3.0, 60, 80, None), (4.5, 2, 2, [1.0] * 4)], "z double, n_rows int, n_cols int, pixels array<double>")
    got = {(r["row"], r["col"]) for r in mask_pixels(df, p).where("z = 1.5").collect()}
    assert got == set(map(tuple, np.argwhere(m).tolist()))
    assert mask_pixels(df, p).where("z <> 1.5").count() == 0


def test_mask_lookup_never_searches_a_map_pixel_by_pixel(spark, monkeypatch):
    from punctum.catalog import sweeps

    rng = np.random.default_rng(3)
    xyz = np.column_stack([rng.uniform(-200, 300, (3000, 2)), rng.integers(0, 2, 3000) * 1.5])
    monkeypatch.setattr(sweeps, "readings", lambda *_: spark.createDataFrame(pd.DataFrame(xyz, columns=["global_x", "global_y", "global_z"]).reset_index(names="tx_id")))
    got = sweeps.a07_mask_lookup(spark, None)
    assert "element_at" not in got._jdf.queryExecution().optimizedPlan().toString()
    at = np.floor(xyz[:, :2] / 10).astype(int)
    at -= at.min(axis=0)
    want = []
    for z in (0.0, 1.5):
        mine = at[xyz[:, 2] == z]
        img = np.zeros(at.max(axis=0)[::-1] + 1)
        np.add.at(img, (mine[:, 1], mine[:, 0]), 1)
        want.append((z, len(mine), int(stain_mask(img, MaskParams(block=5, c=-1.0, area=1, radius=1))[mine[:, 1], mine[:, 0]].sum())))
    assert sorted(map(tuple, got.select("z", "n", "n_in").collect())) == want
