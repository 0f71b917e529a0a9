"""Supply and competition, title vectors, verification."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import coupling
from tidemark.plans import verify
from tidemark.sources import title_vectors


def test_supply_follows_volume_and_skips_missing_windows():
    s = coupling.Supply()
    assert s.forecast(3) == 1.0
    for _ in range(30):
        s.push(3, 10.0)
    assert s.forecast(3) == pytest.approx(10.0) and s.forecast(4) == pytest.approx(10.0)
    before = s.level
    s.push(3, 0.0)
    s.push(3, 50.0, missing=True)
    assert s.level == before
    s.push(3, 40.0)
    assert s.level > before


def test_competition_lowers_everyone_alike(spark):
    assert coupling.competition(4.0, 4.0, 1.0) == 0.5 and coupling.competition(4.0, 0.0, 1.0) == 1.0 and coupling.competition(4.0, 9.0, 0.0) == 1.0
    p = spark.createDataFrame([("a", 1, 3.0), ("b", 1, 1.0), ("a", 2, 0.0)], "narrative_id string, win long, lam_raw double")
    s = spark.createDataFrame([(1, 4.0), (2, 4.0)], "win long, supply double")
    assert sorted((r.narrative_id, r.win, r.lam) for r in coupling.competed(p, s, 1.0).collect()) == [("a", 1, 1.5), ("a", 2, 0.0), ("b", 1, 0.5)]


def test_coupled_fit_profiles_the_exponent():
    rng = np.random.default_rng(0)
    n = 400
    x = np.ones((n, 1))
    counts = {k: rng.poisson(1.0, n).astype(float) for k in "abc"}
    f = coupling.fit_coupled({k: x for k in counts}, counts, np.full(n, 10.0), 1, np.ones(n, bool))
    assert f.omega in coupling.OMEGAS and 0.5 <= f.size <= 1e4
    raw = {k: float(np.logaddexp(0, th[0])) for k, th in f.theta.items()}
    c = float(coupling.competition(10.0, sum(raw.values()), f.omega, f.beta))
    assert all(abs(c * v - counts[k].mean()) < 0.25 for k, v in raw.items())


def test_titles_are_encoded_once_and_verified(spark, tmp_path):
    rows = [("2025-01-01", f"o{i}", f"o{i}" if i % 3 else "o0", ["same title", "other title", ""][i % 3]) for i in range(12)]
    docs = spark.createDataFrame(rows, "day string, observation_id string, copy_group string, title string")
    back = title_vectors.embed_roots(docs).cache()
    sent = docs.where("copy_group = observation_id").select("day", "observation_id", "title")
    assert back.count() == sent.count() == 9 and title_vectors.embed_roots(docs, back).count() == 0
    assert title_vectors.import_faults(sent, back).count() == 0
    title_vectors.install(sent, back, str(tmp_path / "v"))
    v = {r.observation_id: np.array(r.vec) for r in title_vectors.read_vectors(spark, str(tmp_path / "v")).collect()}
    assert v["o1"] @ title_vectors.encode("other title") > 0.999 and np.linalg.norm(v["o2"]) == 0
    worse = back.withColumn("vec", F.when(F.col("observation_id") == "o1", F.transform("vec", lambda x: (-x).cast("tinyint"))).otherwise(F.col("vec")))
    assert [r.fault for r in title_vectors.import_faults(sent, worse).collect()] == ["parity"]
    with pytest.raises(ValueError, match="ids differ"):
        title_vectors.install(sent, back.where("observation_id <> 'o4'"), str(tmp_path / "w"))
    m = title_vectors.export_manifest(sent).first()
    assert (m.n_rows, m.unique_titles) == (9, 3) and m.sha256 == title_vectors.export_manifest(sent.orderBy(F.desc("observation_id"))).first().sha256


def test_changed_records_are_found(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y")), ("c", bytearray(b"z"))], "path string, content binary")
    listed = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", hashlib.sha256(b"Y").hexdigest()), ("d", "0")], "path string, sha256 string")
    assert {r.path: r.fault for r in verify.manifest_faults(files, listed).collect()} == {"b": "changed", "c": "not listed", "d": "missing"}
    df = spark.range(5)
    got = verify.run({"same": lambda: verify.same(df, spark.range(5)), "tampered": lambda: verify.same(df, spark.range(4)), "broken": lambda: 1 / 0, "p": lambda: verify.placebo_agrees({"real": 2.0, "placebos": [1.0, 3.0], "p": 0.667}), "key": lambda: verify.archive_clean({"a": {"api_key": "k"}})})
    assert [(n, ok) for n, ok, _ in got] == [("same", True), ("tampered", False), ("broken", False), ("p", True), ("key", False)]
    for i, d in enumerate((df, df.orderBy(F.desc("id")))):
        d.write.parquet(str(tmp_path / f"t{i}"))
    assert verify.digest(spark, str(tmp_path / "t0")) == verify.digest(spark, str(tmp_path / "t1"))
