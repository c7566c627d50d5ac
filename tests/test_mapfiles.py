"""The data source of map files: what it reads, what it opens, and what it reports."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.sources import mapfiles, maps


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    for s in range(4):
        for t in ("01", "02"):
            at = root / f"sub-{s}" / f"ses-{t}" / "maps" / "cortex"
            at.mkdir(parents=True)
            for hemi in "LR":
                for feature in ("FA", "thickness"):
                    name = f"sub-{s}_ses-{t}_hemi-{hemi}_surf-fsLR-5k_label-midthickness_feature-{feature}_smooth-10mm.func.gii"
                    (at / name).write_bytes(maps.encode_surface_file([np.array([s, float(t), hemi == "L", d]) for d in range(2 if feature == "FA" else 1)]))
    (root / "sub-0" / "ses-01" / "sub-0_ses-01_hemi-L_feature-broken.func.gii").write_text("<not closed")
    (root / "sub-0" / "ses-01" / "sub-0_ses-01_hemi-R_feature-zipped.shape.gii.gz").write_bytes(gzip.compress(maps.encode_surface_file([np.array([np.nan])])))
    (root / "sub-0" / "ses-01" / "notes.txt").write_text("")
    (root / "elsewhere").mkdir()
    return str(root)


def test_every_map_is_a_row(spark, folder):
    rows = mapfiles.read_maps(spark, folder, files_per_task=3).collect()
    assert len(rows) == 4 * 2 * 2 * 3 + 2
    good = [r for r in rows if r["feature"] == "FA" and r["depth"] == 1]
    assert {(r["participant_id"], r["session_id"], r["hemi"]) for r in good} == {(f"sub-{s}", f"ses-0{t}", h) for s in range(4) for t in (1, 2) for h in "LR"}
    assert all(r["values"] == [float(r["participant_id"][4:]), float(r["session_id"][4:]), float(r["hemi"] == "L"), 1.0] and r["resolution"] == "fsLR-5k" and r["label"] == "midthickness" for r in good)
    bad = [r for r in rows if r["error"]]
    assert [r["feature"] for r in bad] == ["broken"] and bad[0]["values"] is None and "ParseError" in bad[0]["error"]
    assert [np.isnan(r["values"]).all() for r in rows if r["feature"] == "zipped"] == [True]


def test_filters_decide_what_is_opened(spark, folder):
    frame = mapfiles.read_maps(spark, folder)
    opened = lambda f: f.agg(F.count_distinct("path")).first()[0]
    assert opened(frame) == 34 and opened(frame.where("participant_id = 'sub-2'")) == 8
    assert frame.where("participant_id in ('sub-1', 'sub-9') and hemi = 'L' and session_id = 'ses-02'").count() == 3
    assert frame.where("hemi = 'L' and hemi = 'R'").count() == 0
    assert frame.where("feature = 'FA' and depth = 1 and values[0] = 3").count() == 4  # what isn't in a name is left to Spark


def test_other_folders_are_not_listed(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    listed, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: listed.append(str(p)) or scan(p))
    reader = mapfiles.MapFileReader(folder, 100)
    left = list(reader.pushFilters([EqualTo(("participant_id",), "sub-3"), In(("feature",), ("FA", "ADC")), GreaterThan(("depth",), 0)]))
    assert [type(f) for f in left] == [GreaterThan]
    paths = [p for part in reader.partitions() for p in part.paths]
    assert len(paths) == 4 and all("sub-3" in p and "feature-FA" in p for p in paths)
    assert listed and all("sub-3" in p for p in listed)
    opened = []
    monkeypatch.setattr(mapfiles, "decode_surface_file", lambda content: opened.append(len(content)) or [])
    for part in reader.partitions():
        list(reader.read(part))
    assert len(opened) == 4


def test_an_empty_folder_has_no_maps(spark, tmp_path):
    assert mapfiles.read_maps(spark, str(tmp_path)).count() == 0
