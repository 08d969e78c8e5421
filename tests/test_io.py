"""Sources and sinks go round."""

from datetime import datetime, timedelta

import pytest

from lachesis.sources import io


def series(spark, mixed=False):
    rows = [(1, 1, datetime(2020, 1, 1) + timedelta(days=i), float(i), mixed and i == 1) for i in range(3)]
    return spark.createDataFrame(rows, "patient_id int, lesion_id int, ts timestamp_ntz, volume double, is_interpolated boolean")


def test_series_round_trip(spark, tmp_path):
    io.save_series(series(spark), str(tmp_path / "s"))
    got = io.load_series(spark, str(tmp_path / "s")).orderBy("t").collect()
    assert [(r.t, r.timedelta_days, r.volume) for r in got] == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]


def test_mixed_series_fail(spark, tmp_path):
    io.save_series(series(spark, True), str(tmp_path / "s"))
    with pytest.raises(Exception, match="mixed series"):
        io.load_series(spark, str(tmp_path / "s")).collect()


def test_features_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("1:0", 1.0)], "`Lesion ID` string, t0_volume double")
    b = spark.createDataFrame([("1:1", 2.0, "CR")], "`Lesion ID` string, t0_volume double, t1_rano string")
    io.write_features(io.combine([a, b]), str(tmp_path / "f"))
    got = io.read_features(spark, str(tmp_path / "f"), "`Lesion ID` string, t0_volume double, t1_rano string").orderBy("Lesion ID").collect()
    assert [tuple(r) for r in got] == [("1:0", 1.0, None), ("1:1", 2.0, "CR")]


@pytest.mark.parametrize("layout", ["config/fold", "fold/config"])
def test_fold_predictions(spark, tmp_path, layout):
    for k in (1, 2):
        d = tmp_path / ("1yr_[t0]/Fold %d" % k if layout == "config/fold" else "Fold %d/1yr_[t0]" % k)
        d.mkdir(parents=True)
        (d / "assignments.csv").write_text("id,prediction,target,confidence\n7,CR,CR,0.5\n")
    got = io.read_fold_predictions(spark, str(tmp_path), layout, {"CR": "0"}).orderBy("fold").collect()
    assert [(r.config, r.fold, r.id, r.target, r.confidence) for r in got] == [("1yr_[t0]", k, "7", "0", 0.5) for k in (1, 2)]
    with pytest.raises(Exception, match="unknown target"):
        io.read_fold_predictions(spark, str(tmp_path), layout, {"PD": "1"}).collect()


def test_manifest(spark, tmp_path):
    for p in ("sub-1/ses-20200101000000/anat", "sub-1/ses-20200101000000/rt", "sub-1/ses-20200301000000/anat", "sub-1/ses-20200401000000/other", "sub-1/ses-2020/anat"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "x.nii").write_bytes(b"x")
    got = io.read_study_manifest(spark, str(tmp_path)).orderBy("study_ts").collect()
    assert [(r.patient_id, r.study_ts.month, r.has_treatment) for r in got] == [("sub-1", 1, True), ("sub-1", 3, False)]


def test_reports_and_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "patient_id int, matched array<string>")
    io.write_match_report(df, str(tmp_path / "r"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "r")).first().matched == '["a","b"]'
    p = spark.createDataFrame([("c", 0, "1", 1, 0, 0.5)], "config string, fold int, id string, prediction int, target int, confidence double")
    io.write_predictions(p, str(tmp_path / "p"))
    assert (tmp_path / "p" / "config=c" / "fold=0").is_dir()
    s = spark.createDataFrame([(0, "x", 1.0, 2.0)], "fold int, column string, mean double, std double")
    io.write_standardization(s, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 1


def test_cached_prepare(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert io.cached_prepare(spark, str(tmp_path / "c"), compute).count() == 3
    assert len(made) == 1


def test_match_report_goes_round(spark, tmp_path):
    row = (1, 3, 4, 3, {1: 'm "0"; x', 3: "m2"}, ["m3"], [2], {1: ["m0", "m1"]}, [])
    names = "patient_id bigint, labels_in_gt bigint, parsed_mets bigint, t0_nonzero_parsed_mets bigint, matched_mets map<int,string>, unmatched_parsed_mets array<string>, unmatched_gt_mets array<int>, ambiguous_parsed_matches map<int,array<string>>, t0_zero_mets array<string>"
    df = spark.createDataFrame([row], names)
    io.write_match_report(df, str(tmp_path / "r"))
    back = io.read_match_report(spark, str(tmp_path / "r"))
    assert [tuple(r) for r in back.collect()] == [row] and back.dtypes == df.dtypes


def test_study_tree(spark, tmp_path):
    """Folders are listed by tasks; an empty tree, files among folders, and a patient without sessions."""
    assert io.read_study_manifest(spark, str(tmp_path)).count() == 0
    paths = [f"sub-{p}/ses-2020010100{p % 60:02d}{p // 60:02d}/{f}" for p in range(150) for f in (["anat"], ["rt"], ["anat", "rt"], ["notes"])[p % 4]] + ["sub-x/other/anat", "sub-y"]
    io.write_study_tree(spark.createDataFrame([(p,) for p in paths + paths[:3] + [None]], "path string"), str(tmp_path))
    (tmp_path / "file.txt").write_text("x")
    (tmp_path / "sub-1" / "ses-20200101000000").write_text("x")
    got = io.read_study_manifest(spark, f"file://{tmp_path}")
    assert {(r.patient_id, r.has_treatment) for r in got.collect()} == {(f"sub-{p}", p % 4 in (1, 2)) for p in range(150) if p % 4 < 3}
    assert got.rdd.getNumPartitions() == 3


def test_passing_tree_leaves_no_folders(spark, tmp_path, monkeypatch):
    """Many sessions of few patients, in pieces smaller than a patient: as a whole tree says, and nothing stays on the disk."""
    from lachesis.sources import folders

    monkeypatch.setattr(folders, "SESSIONS", 7)
    monkeypatch.setattr(io.tempfile, "tempdir", str(tmp_path / "passing"))
    (tmp_path / "passing").mkdir()
    names = [f"sub-{i % 3}/ses-202001{1 + i % 28:02d}0000{i // 28:02d}/{f}" for i in range(200) for f in (["anat"], ["rt"], ["anat", "rt"], ["notes"])[i % 4]] + ["sub-9/other/anat", "sub-8", "sub-1/ses-2020/rt", "sub-0/ses-20210101000000"]
    paths = spark.createDataFrame([(p,) for p in names + names[:5] + [None]], "path string")
    io.write_study_tree(paths, str(tmp_path / "tree"))
    whole = sorted(map(tuple, io.read_study_manifest(spark, str(tmp_path / "tree")).collect()))
    got = sorted(map(tuple, io.read_passing_manifest(paths).collect()))
    assert got == whole and len(got) == 150 and not [*(tmp_path / "passing").iterdir()]


def test_study_manifest_query_keeps_no_tree(spark, monkeypatch):
    from lachesis import registry

    monkeypatch.setattr(io, "write_study_tree", None)
    assert registry.queries()["read_study_manifest"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("links", [True, False])
def test_passing_sessions_need_no_inode_each(tmp_path, monkeypatch, links):
    """A link for each kind of session and a folder for each patient of a piece, however many pieces; links that can't have a second name
    give the same."""
    from lachesis.sources import folders

    made = []
    for call in ("symlink", "mkdir"):
        real = getattr(folders.os, call)
        monkeypatch.setattr(folders.os, call, lambda *a, real=real, **k: made.append(a) or real(*a, **k))
    if not links:
        monkeypatch.setattr(folders.os, "link", lambda *a, **k: (_ for _ in ()).throw(OSError("not supported")))
    tree, kinds = folders.Passing(str(tmp_path)), [["anat"], ["rt"], ["anat", "rt"], ["notes"], []]
    for piece in range(4):
        rows = [{"patient": f"sub-{piece}-{i % 6}", "session": f"ses-{20200101000000 + i}", "inside": kinds[i % 5]} for i in range(300)]
        assert sorted(tree.visited(rows)) == sorted((r["patient"], r["session"], "anat" in r["inside"], "rt" in r["inside"]) for r in rows)
    assert not [*(tmp_path / "tree").iterdir()] and (len(made) < 30 or not links)
