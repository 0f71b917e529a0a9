"""Operators against brute force, small scenarios and invariants."""

import itertools
import math
import os
import random
import re
import uuid
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import attention, components, dedup, groups, narratives, observer, search, verdicts
from tidemark.operators.components import connected_components


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (2, None), (7, 7), (100, 101), (100, 101)]
    want = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            want.setdefault(x, {x})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(s) for x, s in want.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[i] for i in range(1000, 1101)} == {1000}


def articles(*rows):
    base = {"source_name": "s", "url_key": "", "sharing_image": "", "authors": [], "all_names": [], "persons": [], "orgs": [], "amounts": [], "vec": None}
    out = []
    for i, r in enumerate(rows):
        out.append(base | {"observation_id": f"{i:03d}", "observed_time": datetime(2025, 1, 1) + timedelta(minutes=i), "url_key": f"u{i}"} | r)
    return out


LONG = "markets slide as chip stocks tumble"


def test_copies_by_image_names_and_author():
    roots = lambda rows: [x[0] for x in dedup.replay(rows)]
    same = articles(*({"title": LONG, "source_name": f"s{i}", "sharing_image": "pic"} for i in range(4)))
    assert roots(same) == ["000"] * 4 and dedup.replay(same)[1][1] == "L2:s1:image"
    template = articles(*({"title": LONG, "all_names": [f"n{i}"]} for i in range(14)))
    assert len(set(roots(template))) == 14
    apart = articles({"title": LONG, "source_name": "a", "all_names": ["x", "y"]}, {"title": LONG, "source_name": "b", "all_names": ["x", "y"], "observed_time": datetime(2025, 1, 4, 1)})
    assert roots(apart) == ["000", "001"]
    author = articles({"title": LONG, "source_name": "a", "authors": ["Ann"]}, {"title": LONG, "source_name": "b", "authors": ["ann"]})
    assert dedup.replay(author)[1] == ("000", "L2:s1:author")
    short = articles({"title": "two words", "source_name": "a", "all_names": ["x"]}, {"title": "two words", "source_name": "b", "all_names": ["x"]})
    assert roots(short) == ["000", "001"]
    vec = articles({"title": "one title about something", "source_name": "a", "sharing_image": "p", "all_names": ["x"], "vec": [1.0, 0.0]}, {"title": "another title for the same", "source_name": "b", "sharing_image": "p", "all_names": ["x"], "vec": [1.0, 0.0]})
    assert dedup.replay(vec)[1] == ("000", "L2:A:image+embedding")


def sides_of_joins(plan: str) -> list[str]:
    """The operator below each sort under a sort-merge join; AQE splits a join only at plain exchanges."""
    lines = [re.sub(r"^[\s:+*()\d-]*", "", x) for x in plan.splitlines()]
    out, joins = [], 0
    for a, b in zip(lines, lines[1:], strict=False):
        joins += 2 if a.startswith("SortMergeJoin") else 0
        if joins and a.startswith("Sort "):
            out.append(b.split(" ")[0].split("(")[0])
            joins -= 1
    return out


def test_component_joins_can_be_split_at_a_hub(spark, monkeypatch):
    plans = []
    plain = components.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(components, "written", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hub = spark.range(1, 3000).selectExpr("id AS a", "0L AS b").unionByName(spark.range(5000, 5100).selectExpr("id AS a", "id + 1 AS b"))
        got = connected_components(hub)
        assert got.groupBy("component").count().orderBy("component").collect() == [(0, 3000), (5000, 101)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sides = [x for p in plans for x in sides_of_joins(p)]
    assert len(sides) >= 4 and set(sides) == {"Exchange"}


def test_rounds_leave_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    connected_components(spark.range(1, 40).selectExpr("id AS a", "id + 1 AS b"), name="rounds").count()
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1


def test_copies_inside_components_are_those_of_one_pass(spark):
    rng = random.Random(5)
    rows = articles(*({"title": f"story number {rng.randrange(8)} of the day", "source_name": f"s{rng.randrange(3)}", "sharing_image": rng.choice(["", "", "p1", "p2", "p3"]), "all_names": rng.sample(["a", "b", "c"], rng.randrange(4))} for _ in range(150)))
    want = {r["observation_id"]: x for r, x in zip(rows, dedup.replay(rows), strict=True)}
    rows += articles({"title": None, "sharing_image": None}, {"title": "", "sharing_image": "p1"}, {"title": "of its own"})
    for n, r in enumerate(rows[150:]):
        r["observation_id"], r["observed_time"] = f"{150 + n:03d}", datetime(2025, 1, 2) + timedelta(minutes=n)
    want = {r["observation_id"]: x for r, x in zip(rows, dedup.replay(rows), strict=True)}
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in "observation_id observed_time title source_name url_key sharing_image authors all_names persons orgs amounts vec".split()) for r in rows], dedup.DOCUMENT)
    got = {r.observation_id: (r.copy_group, r.evidence) for r in dedup.copy_groups(df).collect()}
    assert got == want


def test_first_seen_replays_components(spark):
    rng = random.Random(8)
    rows = [(f"o{i:03d}", f"n{rng.randrange(60)}", rng.choice(["", *[f"u{j}" for j in range(50)]]), i // 5, f"r{i:03d}") for i in range(120)]
    seen, want = dedup.FirstSeen(), {}
    for o, n, u, w, r in sorted(rows, key=lambda x: (x[3], x[2], x[4])):
        want[o] = seen.push(n, u, o)
    got = {r.observation_id: (r.canonical_id, r.matched_on) for r in dedup.first_seen(spark.createDataFrame(rows, "observation_id string, native_id string, url_key string, window long, record_id string")).collect()}
    assert got == want


def random_graph(rng):
    n, k = rng.randint(3, 7), rng.randint(1, 3)
    nodes = list(range(n))
    terminals = rng.sample(nodes[1:], min(k, n - 1))
    cost = {(rng.choice(nodes), rng.choice(nodes[1:])): rng.randint(0, 9) for _ in range(13)}
    return search.CostGraph(0, terminals, {(u, v): c for (u, v), c in cost.items() if u != v})


def cheapest(g, must=None):
    """By trying every set of edges."""
    edges, best = list(g.cost), math.inf
    for bits in range(1 << len(edges)):
        chosen = [e for i, e in enumerate(edges) if bits >> i & 1]
        c = sum(g.cost[e] for e in chosen)
        if c >= best or must and must not in chosen:
            continue
        reached, grew = {g.root}, True
        while grew:
            grew = False
            for u, v in chosen:
                if u in reached and v not in reached:
                    reached.add(v)
                    grew = True
        if all(t in reached for t in g.terminals):
            best = c
    return best


def test_trees_cost_the_least_possible():
    rng = random.Random(11)
    for _ in range(60):
        g = random_graph(rng)
        cost, tree = search.solve(g)
        assert cost == cheapest(g)
        if cost < math.inf:
            assert len({v for _, v in tree}) == len(tree)


def test_rivals_are_good_trees_through_each_entry():
    """Against all trees: a rival has its entry's edge, and costs no more above the best such tree than that edge does."""
    rng = random.Random(12)
    seen = 0
    for _ in range(60):
        g = random_graph(rng)
        best, _ = search.solve(g)
        if best == math.inf:
            continue
        found = {r: (c, tree) for r, c, tree in search.rivals(g, best, window=6)}
        for r in {v for u, v in g.cost if u == g.root and v not in g.terminals}:
            least = min((sum(g.cost[e] for e in t) for t in trees(g) if (g.root, r) in t), default=math.inf)
            assert r not in found or least <= found[r][0] <= min(least + g.cost[0, r], best + 6)
            assert r in found or least + g.cost[0, r] > best + 6 or least == math.inf
            if r in found:
                assert sum(g.cost[e] for e in found[r][1]) == found[r][0]
                seen += 1
    assert seen > 15


def trees(g):
    """All sets of edges that are trees from the root with terminals at all their ends."""
    edges = list(g.cost)
    for bits in range(1 << len(edges)):
        t = [e for i, e in enumerate(edges) if bits >> i & 1]
        heads = [v for _, v in t]
        if len(set(heads)) < len(heads) or g.root in heads or not set(g.terminals) <= {g.root, *heads}:
            continue
        above = {v: u for u, v in t}
        if any(v not in g.terminals and v not in {u for u, _ in t} for v in heads):
            continue
        if all(reaches(v, above, g.root) for v in heads):
            yield t


def reaches(v, above, root):
    for _ in range(len(above) + 1):
        if v == root:
            return True
        v = above.get(v)
    return False


def test_fixed_trees():
    trunk = {(0, 1): 900, (1, 2): 800, (2, 3): 1100, (2, 4): 1600, (3, 6): 500, (4, 7): 900, (0, 5): 400, (5, 6): 3400, (5, 7): 3500, (0, 6): 3300, (0, 7): 3300}
    g = search.CostGraph(0, [6, 7], trunk)
    cost, tree = search.solve(g)
    assert cost == 5800 and (0, 1) in tree and (0, 6) not in tree
    assert {r: c for r, c, _ in search.rivals(g, cost)} == {1: 5800, 5: 7300}
    assert search.solve(search.CostGraph(0, [2], {(0, 1): 2000, (1, 2): 3000, (0, 2): 3300})) == (3300, {(0, 2)})
    assert search.solve(search.CostGraph(0, [1], {})) == (math.inf, set())


def test_shared_trunk_and_rivals():
    g = search.CostGraph(0, [2, 3], {(0, 1): 1000, (1, 2): 500, (1, 3): 500, (0, 2): 3300, (0, 3): 3300, (0, 4): 1500, (4, 2): 600, (4, 3): 600})
    assert search.solve(g) == (2000, {(0, 1), (1, 2), (1, 3)})
    assert [(r, c) for r, c, _ in search.rivals(g, 2000)] == [(1, 2000), (4, 2700)]
    assert search.empirical_p(2.0, [1.0, 2.0, 3.0]) == 0.75


def reading_sets(reports):
    """Stable sets by trying all."""
    live = [i for i, r in enumerate(reports) if not r.copy]
    hits = lambda a, b: verdicts.contrary(a.literal, b.literal) and verdicts.independent(a, b) and a.tier <= b.tier
    out = []
    for n in range(len(live) + 1):
        for s in itertools.combinations(live, n):
            if all(not hits(reports[a], reports[b]) for a in s for b in s) and all(any(hits(reports[a], reports[b]) for a in s) for b in live if b not in s):
                out.append(s)
    return out


def test_readings_are_the_stable_sets():
    rng = random.Random(4)
    for _ in range(150):
        reports = [verdicts.Report(f"r{i}", f"o{rng.randrange(3)}", f"g{rng.randrange(4)}", rng.randint(1, 3), verdicts.Literal("x", "cost_of", str(rng.randrange(2)), "unspecified", rng.choice([1, -1])), rng.random() < 0.1) for i in range(rng.randint(1, 8))]
        h = verdicts.Hypothesis([verdicts.Report("w", "w", "w", 1), *reports])
        bits, label, n = verdicts.decide({"h": h})["h"]
        want = reading_sets(reports)
        against = {b for r in reports for b in {q.literal for q in reports} if verdicts.contrary(r.literal, b)}
        held = [any(reports[i].literal in against for i in s) for s in want]
        assert n == len(want) and want
        assert bits == (int(not all(held)), int(not any(held)), int(any(held)), int(all(held)))


def test_four_verdicts():
    w = [verdicts.Report("w1", "a", "ga", 1)]
    claim = lambda i, o, t, p: verdicts.Report(i, o, "g" + o, t, verdicts.Literal("s", "denies", "v", "unspecified", p))
    label = lambda h: verdicts.decide({"h": h})["h"][1]
    assert label(verdicts.Hypothesis(w)) == "SUPPORTED"
    assert label(verdicts.Hypothesis(w, before=False)) == "CONSISTENT-BUT-UNPROVEN"
    assert label(verdicts.Hypothesis([*w, claim("c", "x", 2, 1), claim("d", "y", 1, -1)])) == "CONTRADICTED"
    h = verdicts.Hypothesis([verdicts.Report("w2", "a", "ga", 3), verdicts.Report("w3", "b", "gb", 3)])
    assert label(h) == "SUPPORTED" and verdicts.diagnostic({"h": h}, "h") == ["w2", "w3"]


def test_claims_from_titles_quotes_and_amounts(spark):
    t = lambda s: [(c["predicate"], c["value"], c["polarity"]) for c in spark.range(1).select(verdicts.title_claims(F.lit(s))).first()[0]]
    assert t("Lab launches model, denied theft of chips") == [("released", "model", 1), ("denies", "chips", 1)]
    assert t("No export controls, officials allege") == [("restricts_exports", "chips", -1), ("alleges", "export", 1)]
    q = spark.sql("select array(named_struct('verb','alleged','quote','they copied it'), named_struct('verb','said','quote','hello')) q")
    assert [(c["predicate"], c["value"]) for c in q.select(verdicts.quote_claims(F.col("q"))).first()[0]] == [("alleges", "copied")]
    a = spark.sql("select array(named_struct('amount', 5600000D, 'object', 'dollar training'), named_struct('amount', 1D, 'object', 'cats')) a, 'It took 5.6m dollar training, excluding research. More.' t")
    assert [tuple(c) for c in a.select(verdicts.amount_claims(F.col("a"), F.col("t"))).first()[0]] == [("cost_of", "5.60000e+06", "final_run_only", 1)]
    assert spark.range(1).select(verdicts.grounded(F.lit("a  B"), F.lit("x A b y"))).first()[0]


def test_attribution_sums_to_one(spark):
    rows = spark.createDataFrame([(1, 5.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 0.0)], "k long, y double, base double")
    parts = spark.createDataFrame([(1, "a", 2.0), (1, "b", -1.0), (1, "c", 1.0)], "k long, source string, part double")
    got = {(r.k, r.source): r.alpha for r in attention.attribute(rows, parts, ["k"]).collect()}
    assert got == pytest.approx({(1, "BOT"): 0.4, (1, "a"): 0.4, (1, "c"): 0.2, (3, "BOT"): 1.0})


def test_fit_finds_the_exciting_source():
    rng = np.random.default_rng(2)
    src = rng.poisson(0.4, 900).astype(float)
    z = np.stack([attention.decayed(src, h) for h in attention.HOURS.values()], 1)
    noise = np.stack([attention.decayed(rng.poisson(0.4, 900).astype(float), h) for h in attention.HOURS.values()], 1)
    y = rng.poisson(0.3 + 1.5 * z[:, 0]).astype(float)
    x = np.concatenate([np.ones((900, 1)), z - z.mean(0), noise - noise.mean(0)], 1)
    theta = attention.fit_row(x, y, 1)
    assert theta[1:5].sum() > 0.4 > abs(theta[5:].sum())
    assert np.maximum(attention.fit_row(x, y, 1, cap=0.2)[1:], 0).sum() <= 0.2 + 1e-9


def test_change_points_and_lineage():
    c = attention.ChangePoints()
    calm = [c.push(0.0)[0] for _ in range(50)][-1]
    jump = [c.push(4.0) for _ in range(2)][-1]
    assert calm < 0.1 and jump[0] > 0.5 and jump[1] > 0
    z = {"a": np.ones(4), "b": 2 * np.ones(4)}
    merged = attention.lineage_moves(z, [{"kind": "merge", "parents": ["a", "b"], "children": ["c"]}])
    assert list(merged) == ["c"] and merged["c"].sum() == 12
    halves = attention.lineage_moves(merged, [{"kind": "split", "parents": ["c"], "children": ["d", "e"], "shares": [0.25, 0.75]}])
    assert halves["d"].sum() + halves["e"].sum() == 12


def shock(spark):
    rng, rows, day = np.random.default_rng(9), [], date(2024, 1, 1)
    symbols = ["SPY", "AAA", "BBB", "ETF", "PWR", "QUIET"]
    price = dict.fromkeys(symbols, 100.0)
    for i in range(320):
        m = rng.normal(0, 0.005)
        group = rng.normal(0, 0.004)
        for s in symbols:
            hit = i == 300 and s not in ("SPY", "QUIET")
            r = m + (group if s in ("AAA", "BBB", "ETF") else 0) + rng.normal(0, 0.002) + (-0.12 if hit and s != "PWR" else 0.12 if hit else 0)
            o = price[s] * (1 + (r if hit else rng.normal(0, 0.0005)))
            price[s] *= 1 + r
            rows.append((s, str(day + timedelta(i)), o, price[s], int(1e6 * np.exp(rng.normal(0, 0.1)) * (10 if hit else 1))))
    return spark.createDataFrame(rows, "symbol string, day string, open double, close double, volume long"), str(day + timedelta(300))


def test_shock_fires_clusters_and_cutoff(spark):
    prices, day = shock(spark)
    s = observer.daily_statistics(prices, "SPY").cache()
    fired = s.where((F.col("day") == day) & F.col("fired"))
    assert {r.symbol for r in fired.collect()} == {"AAA", "BBB", "ETF", "PWR"}
    clusters = {r.symbol: r.cluster for r in observer.fired_clusters(fired, observer.estimation_residuals(prices, fired, "SPY")).collect()}
    assert clusters["AAA"] == clusters["BBB"] == clusters["ETF"] and clusters["PWR"] == "PWR"
    assert str(observer.cutoff(fired).first().tau)[11:] in ("08:00:00", "09:00:00")


def test_dividends_adjust_earlier_closes(spark):
    p = spark.createDataFrame([("A", "1", 100.0), ("A", "2", 100.0), ("A", "3", 98.0)], "symbol string, date string, close double")
    a = spark.createDataFrame([("A", "3", "dividend", 2.0), ("A", "2", "split", 4.0)], "symbol string, date string, kind string, value double")
    assert [round(r.adj, 9) for r in observer.adjusted(p, a).orderBy("date").collect()] == [98.0, 98.0, 98.0]


def test_as_of_falls_forward(spark):
    t = lambda m: datetime(2025, 1, 1, 0, m)
    left = spark.createDataFrame([(1, t(5)), (2, t(5)), (3, t(5))], "k long, at timestamp")
    right = spark.createDataFrame([(1, t(1), "a"), (1, t(4), "b"), (1, t(9), "c"), (2, t(8), "d"), (2, t(7), "e")], "k long, ts timestamp, v string")
    got = {r.k: (r.v, r.before) for r in dedup.as_of(left, right, "k", "at", "ts", "v").collect()}
    assert got == {1: ("b", True), 2: ("e", False), 3: (None, False)}


def test_clusters_take_like_documents_together():
    c, rng = narratives.EventClusters(16), np.random.default_rng(1)
    topics = np.eye(16)[:3]
    ids = []
    for i in range(60):
        v = topics[i % 3] + rng.normal(0, 0.02, 16)
        ids.append(c.push(v / np.linalg.norm(v), [f"e{i % 3}"], i * 0.25)[0])
        c.close([[f"e{i % 3}"]])
    assert [len(set(ids[k::3])) for k in range(3)] == [1, 1, 1] and len(set(ids)) == 3
    assert sum(narratives.shares_255([0.3, 0.1])) == 255


def test_components_take_every_order(spark, tmp_path):
    from tidemark.plans.queries import QUERIES

    orders = [(c, k) for k, c in enumerate([3, 90_001, 24, 7, 1503, 3, 55, 90_001, 2, 8, 23, 7], start=1)]
    spark.createDataFrame(orders, "o_custkey long, o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for c, k in orders:
        a, b = sorted((root(c), root(7 * c + k)))
        top[b] = a
    got = {r.node: r.component for r in QUERIES["connected_components_of_pairs"](spark, str(tmp_path)).collect()}
    assert got == {x: root(x) for x in top} and 90_001 in got


def test_traces_run_from_first_to_last_window(spark, tmp_path):
    import math
    from datetime import datetime, timedelta

    from tidemark.plans.queries import QUERIES

    at = {1: [0, 0, 3, 900], 2: [500, 501]}
    rows = [(u, datetime(2024, 1, 1) + timedelta(minutes=15 * w + 1)) for u, ws in at.items() for w in ws]
    spark.createDataFrame(rows, "user_id long, ts timestamp").selectExpr("user_id", "CAST(ts AS timestamp_ntz) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.user_id, r.win): r for r in QUERIES["ewma_traces_1h_6h_1d_1w"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, w) for w in range(901)} | {(2, 500), (2, 501)}
    for (u, w), r in got.items():
        for n, tau in (("z1h", 1.0), ("z6h", 6.0), ("z1d", 24.0), ("z1w", 168.0)):
            want = sum((1 - math.exp(-0.25 / tau)) * math.exp(-0.25 / tau * (w - 1 - b)) for b in at[u] if b < w)
            assert abs(r[n] - want) < 2e-6


def test_all_pairs_whatever_the_blocks(spark):
    import numpy as np

    from tidemark.operators.narratives import all_pairs

    v = np.random.default_rng(5).normal(size=(60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.3}
    got = [(r.a, r.b) for r in all_pairs(df, "id", "v", 0.3, block=25).collect()]
    assert set(got) == want and len(got) == len(want)


def test_words_past_the_first_line_count(spark, tmp_path):
    from tidemark.plans import catalog  # noqa: F401  registers its queries
    from tidemark.plans.queries import QUERIES

    rows = [(1, "one\nsame same", "o", "en"), (2, "two\nsame. last", "o", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("entity_jaccard", "subject_by_outlet", "entity_profiles", "text_scalars")}
    assert got["entity_jaccard"][0].jaccard == 0.25
    assert (got["subject_by_outlet"][0].subject, got["subject_by_outlet"][0].n) == ("same", 3)
    assert len(got["entity_profiles"]) == 4
    assert sorted((r.norm, r.parts) for r in got["text_scalars"]) == [(" one same same ", 1), (" two same  last ", 2)]


def test_copy_groups_of_documents_are_those_of_one_pass(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    rows = dedup.documents_as_articles(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/embeddings.parquet"))
    got = {r.observation_id: (r.copy_group, r.evidence) for r in dedup.copy_groups(rows).collect()}
    plain = sorted((r.asDict(recursive=True) for r in rows.collect()), key=lambda r: (r["observed_time"], r["url_key"], r["observation_id"]))
    assert got == {r["observation_id"]: x for r, x in zip(plain, dedup.replay(plain), strict=True)}
    assert len({why for _, why in got.values()}) >= 3


def test_groups_stream_whole(spark):
    """Groups over many batches, and null as a group of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i) for i in range(60) for k in (1, 2, None, 5)] + [(9, 0)]
        df = spark.createDataFrame(rows, "k long, i long")
        got = groups.by_group(df, "k", lambda own: [(None if own["k"].isna().iloc[0] else int(own["k"].iloc[0]), len(own), int(own["i"].sum()))], "k long, n long, s long").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, 60, 1770), (2, 60, 1770), (None, 60, 1770), (5, 60, 1770), (9, 1, 0)], key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_capped_shrink_is_the_nearest_point():
    """Against the projection onto the capped positive part by bisection; a scaled vector is farther away."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        v = rng.normal(size=12)
        got = attention.shrink(v, 0, 0.0, 0.0, 0.0, 4, 1.5)
        lo, hi = 0.0, 10.0
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.maximum(v[v > 0] - mid, 0).sum() > 1.5 else (lo, mid)
        want = np.where(v > 0, np.maximum(v - (hi if v[v > 0].sum() > 1.5 else 0.0), 0), v)
        assert np.allclose(got, want, atol=1e-9)
