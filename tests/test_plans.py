"""Whole plans on small inputs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import case, ingest


def test_batches_become_observations(spark, tmp_path):
    t = lambda i: datetime(2024, 12, 16) + timedelta(minutes=15 * i)
    names = "record_id string, batch_ts timestamp, source_name string, url string, url_key string, title string, published_time timestamp, authors array<string>, themes array<string>, countries array<string>, persons array<string>, orgs array<string>, all_names array<string>, tone float, word_count int, sharing_image string, quotations array<struct<verb: string, quote: string>>, amounts array<struct<amount: double, object: string>>"
    row = lambda r, i, u, title: (r, t(i), "s", u, u, title, None, [], [], [], [], [], [], None, None, "", [], [])
    parsed = spark.createDataFrame([row("a", 0, "u1", "first story of the day"), row("b", 0, "u2", "second story of the day"), row("c", 2, "u1", "first story of the day"), row("d", 2, "u3", "third story of the day"), row("a", 2, "u9", "same record id again")], names)
    obs, links = ingest.observations(parsed, "2024-12-16")
    obs, links = obs.cache(), links.cache()
    assert sorted(r.record_id for r in obs.collect()) == ["a", "b", "d"]
    assert sorted((r.matched_on, r.win) for r in links.collect()) == [("native_id", 2), ("url_key", 2)]
    planned = spark.createDataFrame([(0, True), (1, False), (2, True)], "win long, present boolean")
    led = ingest.ledger(obs, links, planned)
    assert [tuple(r) for r in led.orderBy("win").collect()] == [(0, False, 2, 2, 0, 0, 2), (1, True, 0, 0, 0, 0, 0), (2, False, 3, 1, 2, 0, 1)]
    assert ingest.totals(led).first().asDict() == {"n_rows": 5, "new_objects": 3, "l1_dups": 2, "l2_merges": 0, "roots": 3, "missing_batches": 1}
    ingest.flush(obs, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "obs_doc"))
    assert back.count() == 3 and str(back.first().first_seen)[11:16] in ("00:15", "00:45")
    with pytest.raises(ValueError):
        schemas.conforms(obs.drop("url"), "obs_doc")


def small_world(spark):
    now = 96 * 20 - 1
    alpha = [("n1", "BOT", w, 0.4) for w in range(now - 900, now + 1, 10)] + [("n1", "n2", w, 0.6) for w in range(now - 900, now + 1, 10)] + [("n2", "BOT", w, 1.0) for w in range(now - 900, now + 1, 10)] + [("n1", "n2", now + 5, 1.0)]
    series = [(n, w, 2.0, False) for n in ("n1", "n2") for w in range(now - 900, now + 1, 10)] + [("n1", now - 3, 9.0, True)]
    objects = [(now - i, " acme corp falls " if i % 3 else " weather ", "n1", 0.9) for i in range(60)] + [(now - i, " nothing here ", "n2", 0.9) for i in range(60)]
    return now, spark.createDataFrame(alpha, "target string, source string, win long, alpha double"), spark.createDataFrame(series, "narrative_id string, win long, y double, burst boolean"), spark.createDataFrame(objects, "win long, text string, narrative_id string, share double")


def test_a_case_is_explained_through_its_narrative(spark):
    now, alpha, series, objects = small_world(spark)
    p = {(r.source, r.target): r.p for r in case.parent_probabilities(alpha, series, now).collect()}
    assert p == pytest.approx({("BOT", "n1"): 0.4, ("n2", "n1"): 0.6, ("BOT", "n2"): 1.0}, abs=0.02)
    links = {(r.source, r.target): r.p for r in case.terminal_links(objects, series, [" acme "], now).collect()}
    assert links == pytest.approx({("n1", "T0"): 0.95})
    e = case.explain(alpha, series, objects, [" acme "], {"real": now, "early": now - 400}).collect()
    real = next(r for r in e if r.case == "real")
    assert real.tree == "BOT>n2,n1>T0,n2>n1" and real.cost < real.abstain_cost and "n1:" in real.rivals
    rep = case.placebo_report(spark.createDataFrame(e), "real").first()
    assert rep.k == 1 and 0.5 <= rep.p <= 1
    changed = alpha.where(F.col("win") <= now)
    assert case.explain(changed, series, objects, [" acme "], {"real": now}).collect()[0].cost == real.cost  # what comes later doesn't count


def test_patterns_subjects_and_placebos(spark):
    assert case.terminal_patterns([["NVDA"]], {"NVDA": ["Nvidia Corp"]}, {"NVDA": ["Semiconductors"]}) == [" nvda | nvidia | semiconductor"]
    df = spark.createDataFrame([([["B", "a"], ["A", "b", "c"]],)], "x array<array<string>>")
    assert df.select(case.subject_of(F.col("x"))).first()[0] == "a"
    days = [f"d{i:02d}" for i in range(40)]
    a = case.placebo_cutoffs(days, 7)
    assert a == case.placebo_cutoffs(days, 7) != case.placebo_cutoffs(days, 8) and len({d for d, _ in a}) == 20 and all(32 <= w <= 83 for _, w in a)
    m = spark.createDataFrame([("o1", 5, 7, "n1", 200), ("o2", 5, 7, "n1", 200), ("o3", 5, 8, "n1", 200)], "observation_id string, win long, event_cluster long, n1 string, p1 int")
    s = spark.createDataFrame([("n1", 5, True)], "narrative_id string, win long, burst boolean")
    t = spark.createDataFrame([("real", "n1", None), ("real", "n9", 1.0)], "case string, narrative_id string, sigma_least double")
    assert {r.narrative_id: (r.event_cluster, r.signature) for r in case.hypotheses(t, m, s, 10).collect()} == {"n1": (7, True), "n9": (None, False)}
