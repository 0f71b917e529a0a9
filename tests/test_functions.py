"""Single functions at fixed points and against plain Python."""

import hashlib
import math
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import clock, stats, text, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0] if values else spark.range(1).select(column).first()[0]


def test_windows_before_and_after_the_origin(spark):
    for at, w in ((datetime(2024, 1, 1), 0), (datetime(2024, 1, 1, 0, 14, 59), 0), (datetime(2024, 1, 1, 0, 15), 1), (datetime(2023, 12, 31, 23, 59), -1), (datetime(2024, 1, 2), 96)):
        assert one(spark, clock.window_of(F.col("t")), t=at) == w
    assert str(one(spark, clock.window_start(F.lit(97)))) == "2024-01-02 00:15:00"


def test_stamps(spark):
    assert str(one(spark, clock.parse_stamp(F.lit("20250127101500")))) == "2025-01-27 10:15:00"
    assert one(spark, clock.parse_stamp(F.lit("20251327101500"))) is None
    assert one(spark, clock.parse_stamp(F.lit("2025"))) is None


def test_session_starts_follow_daylight_saving(spark):
    at = lambda d, v, e: str(one(spark, clock.session_open_utc(F.to_date(F.lit(d)), F.lit(v), F.lit(e))))
    assert at("2025-01-27", "US", True) == "2025-01-27 09:00:00"
    assert at("2025-07-01", "US", False) == "2025-07-01 13:30:00"
    assert at("2025-07-01", "AS", False) == "2025-07-01 07:00:00"


def test_canonical_urls():
    for a, b in (
        ("http://www.Example.com:80//a//b/?utm_source=x&b=2&a=1#top", "https://example.com/a/b?a=1&b=2"),
        ("m.news.example.com/story/amp/", "https://news.example.com/story"),
        ("https://user@amp.example.org/%7Ex/?fbclid=1", "https://example.org/~x"),
        ("https://www.com/", "https://www.com/"),
        ("https://example.com/a%2fb?q=%e4", "https://example.com/a/b?q=%EF%BF%BD"),
    ):
        assert text.canonical_url(a) == b
        assert text.canonical_url(b) == b


def test_domains_titles_and_names(spark):
    assert [one(spark, text.registrable_domain(F.lit(h))) for h in ("a.b.example.com", "news.bbc.co.uk", "example.org", "localhost")] == ["example.com", "bbc.co.uk", "example.org", "localhost"]
    assert text.norm_title("Markets fall as chip stocks slide | The Herald") == "markets fall as chip stocks slide"
    assert text.norm_title("Up | Down") == "up down" and text.norm_title(None) == ""
    assert text.aliases(["Nvidia Corp.", "The", "AB"], "NVDA") == ["nvda", "nvidia"]
    assert text.lexicon(["Semiconductors & Equipment, Chips and Gas"]) == ["chip", "equipment", "gas", "semiconductor"]


def test_atoms_texts_and_hashes(spark):
    assert [one(spark, text.atom(F.lit(x))) for x in ("U.S. Steel", "3M", "---")] == ["u_s_steel", "x_3m", "x"]
    assert one(spark, text.norm_text(F.lit("  A-B! c "))) == " a b  c "
    parts = ("a", "", "é😀")
    h = hashlib.sha256()
    for p in parts:
        h.update(len(p.encode()).to_bytes(8, "big") + p.encode())
    assert one(spark, text.stable_hash(*map(F.lit, parts))) == h.hexdigest()
    assert one(spark, text.html_to_text(F.lit("<p>a &amp; b</p><script>x</script>c<br/>d"))) == "a & b\nc\nd"


def test_vectors(spark):
    assert one(spark, vectors.to_int8(F.array(F.lit(0.5 / 127), F.lit(1.5 / 127), F.lit(9.0), F.lit(-9.0)))) == [0, 2, 127, -127]
    empty = F.array().cast("array<string>")
    assert one(spark, vectors.jaccard(empty, empty)) == 0.0
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_robust_z(spark):
    ref = F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0, 100.0)))
    assert abs(one(spark, stats.robust_z(F.lit(10.0), ref)) - 0.6745 * 7 / 1) < 1e-12
    assert one(spark, stats.robust_z(F.lit(10.0), F.array(F.lit(1.0), F.lit(1.0)))) == 0.0
    assert one(spark, stats.robust_z(F.lit(1.0), F.array().cast("array<double>"))) == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e3), min_size=1, max_size=6))
def test_shares_sum_to_255(shares):
    assert sum(stats.to_255(shares)) == (255 if sum(shares) > 0 else 0)


def test_counts_and_bessel():
    assert stats.to_255([1, 1, 1]) == [85, 85, 85] and stats.to_255([0.5, 0.5]) == [128, 127]
    r, lam = 3.0, 4.0
    pmf = [math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(r / (r + lam)) + k * math.log(lam / (r + lam))) for k in range(30)]
    assert abs(stats.nb2_cdf(7, r, lam) - sum(pmf[:8])) < 1e-12 and stats.nb2_cdf(-1, r, lam) == 0
    assert abs(stats.pit(4, 1e4, 4.0, 0.5)) < 0.5
    # I_1/2(x) = sqrt(2 / (pi x)) sinh x
    assert abs(stats.log_bessel_i(0.5, 3.0) - math.log(math.sqrt(2 / (math.pi * 3)) * math.sinh(3))) < 1e-12
    series = lambda nu, x: (lambda t: max(t) + math.log(math.fsum(math.exp(v - max(t)) for v in t)))([(2 * k + nu) * math.log(x / 2) - math.lgamma(k + 1) - math.lgamma(k + nu + 1) for k in range(400)])
    for nu, x in ((31.0, 5.0), (31.0, 80.0), (191.0, 300.0)):
        assert abs(stats.log_bessel_i(nu, x) / series(nu, x) - 1) < 1e-6


def test_order_independent_sum(spark):
    xs = [float(x) for x in np.random.default_rng(0).normal(0, 1e6, 500)]
    sums = {spark.createDataFrame([(x,) for x in p], "x double").agg(stats.exact_sum(F.col("x"))).first()[0] for p in (xs, xs[::-1], sorted(xs))}
    assert len(sums) == 1
