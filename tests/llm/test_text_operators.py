"""Decontamination, personal data, quality, token counts, pieces: against brute force, and at the edges."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, pieces, quality, token_counts
from tidemark.llm.common import tokenizer_path

DOC = "doc_id long, text string, k string, n long"
ODD = [(1, None, "x", 1), (2, "", None, 2), (None, "Hello there", "y", 3), (3, "same", "a", 4), (3, "same", "a", 4), (4, " \n\t ", "b", None), (5, "wörd " * 30_000, "c", 6)]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOC)


# decontamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(text, items, size):
    words, hit, who = plain_words(text), set(), set()
    for item, t in items:
        w = plain_words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            win = w[i : i + size]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    who.add(str(item))
    return len(words), len(hit), sorted(who)


@pytest.mark.parametrize("block", [10**9, 60])
def test_windows_against_brute_force(spark, block):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(["Ab", "b", "c-d", "é", "1", "ABC"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 6))) for i in range(12)] + [(50, None), (51, "..."), (0, "b b b"), (10, "1")]
    rows = [(i, text(rng.randint(0, 25)), "", 0) for i in range(100, 180)] + ODD
    got = decontaminate.contaminated_words(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), size=3, block_bytes=block).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, *plain_hits(t, items, 3)) for i, t, *_ in rows if t is None or len(t) < 1000)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, r.item_ids) for r in got if r.doc_id != 5)
    assert have == want
    for r in got:
        assert r.items_sha256 == hashlib.sha256(",".join(r.item_ids).encode()).hexdigest() and r.contaminated == (r.n_hit > 0) and r.n_items == len(r.item_ids)


def test_matches_map_to_the_original_text(spark):
    t = "Intro: THE Quick, brown-Fox é jumps!"
    r = decontaminate.contaminated_words(docs(spark, [(1, t, "", 0)]), spark.createDataFrame([(9, "quick brown fox É"), (8, "quick brown fox é")], "item_id long, text string")).first()
    s, e = r.char_spans[0]
    assert t[s:e] == "Quick, brown-Fox é" and r.word_spans == [[2, 6]] and r.item_ids == ["8"]


def test_no_items_no_documents_and_the_filter(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contaminated_words(docs(spark), none).collect()} == {0}
    assert decontaminate.contaminated_words(docs(spark, []), none).count() == 0
    kept = decontaminate.keep_uncontaminated(docs(spark), spark.createDataFrame([(1, "Same.")], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "k", "n"] and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "None"]


# quality


def test_margin_is_the_scaled_dot_product_and_descent_separates():
    rng = random.Random(3)
    good = ["the quick brown fox " + " ".join(rng.sample("alpha beta gamma delta".split(), 3)) for _ in range(60)]
    bad = ["BUY!!! " + " ".join(rng.sample("ALPHA!! BETA!! GAMMA!! DELTA!!".split(), 3)) for _ in range(60)]
    rows = [quality.features(t.encode()) for t in good + bad]
    y = np.array([1] * 60 + [0] * 60)
    m = quality.fit(rows, y)
    assert all((m.score(r) >= 0.5) == bool(t) for r, t in zip(rows, y, strict=True))
    x = np.zeros(quality.SIZE)
    x[rows[0]] = m.ratio[rows[0]]
    assert abs(m.margin(rows[0]) - (x / np.linalg.norm(x) @ m.weights + m.bias)) < 1e-5
    assert 0 <= m.score(quality.features(b"")) <= 1


def test_descent_reaches_the_dual_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), np.sign(rng.normal(size=40))
    w, b = quality.dual_descent([(np.arange(3), v) for v in x], y, np.full(40, 0.7), 3, rounds=3000)
    primal = lambda w, b: 0.5 * (w @ w + b * b) + 0.7 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = primal(w, b)
    for _ in range(400):
        d = rng.normal(size=4) * 0.01
        assert primal(w + d[:3], b + d[3]) >= best - 1e-6


def test_features_of_chunks_are_those_of_the_whole(monkeypatch):
    t = bytes(np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8))
    whole = quality.features(t)
    monkeypatch.setattr(quality, "CHUNK", 137)
    assert np.array_equal(whole, quality.features(t))


def test_repeats_are_ngrams_of_their_own():
    ids = lambda t: set(quality.features(t).tolist())
    top = 1 << quality.BITS
    assert {x - top for x in ids(b"a b a b") if x >= top} == set() and {x - top for x in ids(b"a a b c c c") if x >= top} == {0, 1}
    assert {x - top for x in ids(b"a " * 50) if x >= top} == set(range(quality.REPEATS)) and not ids(b"")


def plain_scores(rows, labels):
    """The whole classifier again, in plain loops: counts, ratios, the hinge loss by subgradient-free coordinate ascent, the curve."""
    def grams(t):
        b, out = t.encode(), set()
        for n in (1, 2, 3, 4):
            for i in range(len(b) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 + (b[i + k] + 1) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)[k]) % 2**32
                out.add(((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> (32 - quality.BITS))
        words = re.findall(rb"[^ \t\n\r\x0b\f]+", b)
        longest = run = 0
        for x, y in zip(words, words[1:], strict=False):
            run = run + 1 if x == y else 0
            longest = max(longest, run)
        return out | {(1 << quality.BITS) + i for i in range(min(longest, quality.REPEATS))}

    known = sorted((xxhash_of(i), str(i), t) for i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1)
    y = [1.0 if labels[int(i)] else -1.0 for _, i, _ in known]
    x = [grams(t) for *_, t in known]
    held = [i % 5 == 1 for i in range(len(x))]
    pos, neg, everything = {}, {}, set().union(*x)
    for g, t, h in zip(x, y, held, strict=True):
        for f in () if h else g:
            side = pos if t > 0 else neg
            side[f] = side.get(f, 0) + 1
    p, q = sum(pos.values()) + quality.SIZE, sum(neg.values()) + quality.SIZE
    ratio = lambda f: np.log((pos.get(f, 0) + 1) / p) - np.log((neg.get(f, 0) + 1) / q)
    vector = lambda g: {f: r / max(np.sqrt(sum(ratio(k) ** 2 for k in g)), 1e-9) for f in g for r in [ratio(f)]}
    v = [vector(g) for g in x]
    fit = [i for i, h in enumerate(held) if not h]
    w, bias, alpha = dict.fromkeys(everything, 0.0), 0.0, [0.0] * len(fit)
    for _ in range(3000):  # to the optimum, which is one
        moved = 0.0
        for n, i in enumerate(fit):
            g = y[i] * (sum(w[f] * z for f, z in v[i].items()) + bias) - 1
            new = min(max(alpha[n] - g / (sum(z * z for z in v[i].values()) + 1), 0.0), 4.0)
            step = (new - alpha[n]) * y[i]
            alpha[n], bias, moved = new, bias + step, max(moved, abs(step))
            for f, z in v[i].items():
                w[f] += step * z
        if moved < 1e-9:
            break
    margin = lambda g: sum(w.get(f, 0.0) * z for f, z in vector(g).items()) + bias
    slope, offset = quality._platt(np.array([margin(x[i]) for i, h in enumerate(held) if h]), np.array([y[i] > 0 for i, h in enumerate(held) if h]))
    return {i: 1 / (1 + np.exp(-(slope * margin(grams(t)) + offset))) for i, t in rows}


def xxhash_of(key):
    import xxhash

    h = xxhash.xxh64_intdigest(str(key).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_scores_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(quality.dual_descent, "__defaults__", (3000,))
    rng = random.Random(10)
    good = lambda: " ".join(rng.choice(["stone", "river", "open", "and", "was"]) for _ in range(5))
    bad = lambda: rng.choice([" ".join([rng.choice(["stone", "river"])] * 5), "BUY " + good().upper() + "!!", good() + " $$"])
    rows = [(i, good() if i % 2 else bad()) for i in range(90)] + [(200, ""), (201, "x")]
    labels = {i: i % 2 for i in range(80)}
    table = spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOC)
    marked = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(table, quality.fit_quality(table, marked)).collect()}
    want = plain_scores(rows, labels)
    assert max(abs(got[i] - want[i]) for i in want) < 0.02 and max(want.values()) - min(want.values()) > 0.5


def test_scores_edges_and_folds(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = quality.fit_quality(docs(spark), none)
    rows = quality.quality_scores(docs(spark), m).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 3, 4, 5)}
    assert quality.keep_quality(docs(spark), m).columns == ["doc_id", "text", "k", "n"]
    assert quality.quality_scores(docs(spark, []), m).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.quality_scores(d, quality.fit_quality(d, labels)).join(labels, "doc_id").where("held_out")
    n, right = got.select(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 100 and right / n > 0.95


# token counts


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_counts_are_the_librarys_and_cached(spark, tmp_path, name):
    path = str(tmp_path / "cache")
    got = token_counts.token_counts(docs(spark), name, path, limit=10).collect()
    count = token_counts.counter(name)
    want = sorted((str(i), len((t or "").encode()), count([t or ""])[0]) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 10) for r in got)
    held = spark.read.parquet(path)
    assert held.count() == held.select("digest").distinct().count() == len({t or "" for _, t, *_ in ODD})
    token_counts.token_counts(docs(spark, [*ODD, (9, "new text", "", 0)]), name, path).count()
    assert spark.read.parquet(path).count() == held.count() + 1
    assert token_counts.token_counts(docs(spark, []), name).count() == 0


def test_a_stored_count_is_believed(spark, tmp_path):
    path, v = str(tmp_path / "cache"), token_counts.tokenizer_version("piece_bpe_32k.model")
    spark.createDataFrame([(v, bytearray(hashlib.sha256(b"same").digest()), 777), ("other", bytearray(hashlib.sha256(b"").digest()), 5)], token_counts.CACHE).write.partitionBy("version").parquet(path)
    got = {str(r.doc_id): r.n_tokens for r in token_counts.token_counts(docs(spark), "piece_bpe_32k.model", path).collect()}
    assert got["3"] == 777 and got["2"] == 0
    token_counts.compacted(spark, path, v, path + "-new")
    held = token_counts.read_cache(spark, path + "-new", v)
    assert {(bytes(r.digest), r.n_tokens) for r in held.collect()} == {(bytes(r.digest), r.n_tokens) for r in token_counts.read_cache(spark, path, v).collect()} and held.count() > 3


# pieces


@pytest.fixture(scope="module")
def public():
    return pieces.encoder("piece_bpe_32k.model")


def small(kinds=True):
    p = ["<unk>", "<s>", *[f"<0x{i:02X}>" for i in range(256)]] if kinds else ["<unk>"]
    extra = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "é", "bé"]
    k = [2, 3, *[6] * 256] if kinds else [2]
    scores = [0.0] * len(p) + [-2.0, -2.5, -2.25, -3.75, -3.0, -4.0, -5.5, -4.5, -3.0, -4.0]
    return pieces.Pieces(p + extra, scores, k + [1] * len(extra), True, False)


def every_path(e, text):
    """Best score over all ways to cut, by recursion."""
    ids = {p: i for i, p in enumerate(e.model.pieces) if e.model.kinds[i] == 1}

    def go(s):
        if not s:
            return 0.0
        best = [e.scores[ids[s[:n]]] + go(s[n:]) for n in range(1, len(s) + 1) if s[:n] in ids]
        if s[0] not in ids:
            best.append(e.unknown_score + go(s[1:]))
        return max(best)

    return go(text)


@pytest.mark.parametrize("kinds", [True, False])
def test_best_paths_against_all_paths(kinds):
    e, rng = pieces.Encoder(small(kinds)), random.Random(7)
    texts = ["".join(rng.choice("aabbé zß") for _ in range(rng.randint(1, 11))) for _ in range(150)]
    for t, ids in zip(texts, e.encode_batch(texts), strict=True):
        marked = (" " + t).replace(" ", "▁")
        unknown = sum(1 for c in marked if c not in e.model.pieces)
        known = sum(e.scores[i] for i in ids if e.model.kinds[i] == 1)
        assert abs(known + unknown * e.unknown_score - every_path(e, marked)) < 1e-9, t
        assert e.encode(t) == ids
        if kinds:
            assert e.decode(ids) == t
    assert e.encode("") == [] and e.decode([]) == ""


def test_columns_of_words_give_the_single_paths(public):
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoin éßx😀-") for _ in range(rng.randint(1, 14))).replace(" ", "▁").encode() for _ in range(2000)]
    assert public.best_paths(words) == [public.best_path(w) for w in words]


def test_trie_holds_exactly_its_keys(public):
    t = public.trie

    def find(key):
        p = 0
        for b in key:
            q = t.base[p] + b + 1
            if q >= len(t.check) or t.check[q] != p:
                return -1
            p = q
        return t.value[p]

    for i, (p, k) in enumerate(zip(public.model.pieces, public.model.kinds, strict=True)):
        if k == pieces.NORMAL:
            assert find(p.encode()) == i
    assert find("▁thezzz".encode()) == -1 and find(b"\xff") == -1


def test_encoding_rows(spark):
    rows = [*ODD, (7, "tab\tnew\nline 😀 \x00 end ", "", 0), (8, "has ▁ mark", "", 0), (9, "  two  spaces", "", 0)]
    got = {str(r.doc_id): r for r in pieces.encoded(docs(spark, rows), "piece_bpe_32k.model").collect()}
    assert got["1"].ids == [] and got["2"].n_tokens == 0 and got["7"].decoded_equal and got["9"].decoded_equal and got["5"].decoded_equal
    assert not got["8"].decoded_equal and got["7"].n_byte_pieces > 0 and got["5"].n_tokens == len(got["5"].ids)
    assert pieces.encoded(docs(spark, []), "piece_bpe_32k.model").count() == 0
    assert tokenizer_path("/some/where.model") == "/some/where.model"


def edited(raw, piece=lambda i, p: b"", trainer=b"", normalizer=b""):
    """A model file with more fields at the ends of its messages: the last of a field's values counts."""
    def varint(n):
        out = b""
        while n >= 128:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out, i = b"", 0
    for number, value in pieces._fields(raw):
        if number == 1:
            value, i = value + piece(i, value), i + 1
        value += trainer if number == 2 else normalizer if number == 3 else b""
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def unigram():
    """The public model's file with its type switched to unigram, and the scores of white space (-1e9, which the library's single precision can't add to) raised to -40,000."""
    from tidemark.llm.common import tokenizer_bytes

    score = lambda p: struct.unpack("<f", dict(pieces._fields(p)).get(2, bytes(4)))[0]
    return edited(tokenizer_bytes("piece_bpe_32k.model"), lambda i, p: b"\x15" + struct.pack("<f", -40_000.0) if score(p) <= -1e8 else b"", b"\x18\x01")


def library(raw, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return [sp.encode(t) for t in texts], [sp.decode(sp.encode(t)) for t in texts]


def test_ids_are_the_librarys_unigram(spark, unigram):
    lines = [x for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for x in (r.text or "").split("\n")][:2000]
    rng = random.Random(4)
    lines += ["".join(rng.choice("ab é▁\t  你😀\u0300.,1") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", " ", "  a  b "]
    e = pieces.Encoder(pieces.read_model(unigram))
    ids, back = library(unigram, lines)
    assert e.encode_batch(lines) == ids and [e.decode(x) for x in ids] == back


def test_a_users_pieces_win_as_in_the_library(unigram):
    own = {500: "USER A", 700: "river.stone", 900: "ab.ab"}
    raw = edited(unigram, lambda i, p: (b"\x0a" + bytes([len(own[i])]) + own[i].encode() + b"\x18\x04") if i in own else b"")
    e = pieces.Encoder(pieces.read_model(raw))
    rng = random.Random(5)
    texts = ["".join(rng.choice(["USER A", "river.stone", "ab.ab", "a", "b", " ", "stone", "river", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    assert [e.encode(t) for t in texts] == library(raw, texts)[0]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_character_maps_are_the_librarys(unigram, rule):
    import sentencepiece

    chars = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = [v for n, v in pieces._fields(chars) if n == 3][0]
    raw = edited(unigram, normalizer=spec)
    e = pieces.Encoder(pieces.read_model(raw))
    rng = random.Random(6)
    pool = ["a", "A", "é", "e\u0301", "ﬁ", "①", "Ａ", "ｶﾞ", " ", "\u3000", "\u00a0", "\t", "ß", "한", "\u1112\u1161\u11ab", "x", "\u200b", "½", "İ"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(500)] + ["", " ", "  a  b  ", "\t"]
    assert [e.encode(t) for t in texts] == library(raw, texts)[0]


@pytest.mark.parametrize("extra", [{"normalizer": b"\x20\x00"}, {"normalizer": b"\x20\x01\x18\x00"}, {"trainer": b"\xc0\x01\x01"}, {"trainer": b"\xc0\x01\x01", "normalizer": b"\x20\x01"}])
def test_spaces_are_handled_as_in_the_library(unigram, extra):
    """Squeezed or not, with the marker before, after or not at all."""
    raw = edited(unigram, **extra)
    e = pieces.Encoder(pieces.read_model(raw))
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "é", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    ids, back = library(raw, texts)
    assert [e.encode(t) for t in texts] == ids
    if "trainer" not in extra:
        assert [e.decode(x) for x in ids] == back
    elif "normalizer" not in extra:  # the library takes the space away before the text, where it set none
        assert [e.decode(x) for x in ids] == texts


# names


def test_keys_and_columns_of_any_name(spark, tmp_path):
    """A key with a dot, a space and a quote, and columns named as the operators' own."""
    k = "the `key.` of"
    df = docs(spark, [(1, "a b c d e f g h i j k", "", 0), (2, "a b c d e f g h i j k l", "", 0), (None, None, "", 0)]).withColumnRenamed("doc_id", k)
    df = df.withColumns({n: F.lit("mine") for n in ("ids", "n_tokens", "score", "held_out", "spans", "keys", "file", "h", "t", "c0", "y", "digest", "content", "starts", "_key")})
    items = docs(spark, [(7, "b c d e f g h i j k", "", 0)]).withColumnRenamed("doc_id", "item.id")
    from tidemark.llm import alike, fingerprints, packing, simhash

    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int").withColumnRenamed("doc_id", k)
    model = quality.fit_quality(df, labels, k)
    made = [
        simhash.near_duplicates(df, k), decontaminate.contaminated_words(df, items, k, item="item.id"), pieces.encoded(df, "piece_bpe_32k.model", k),
        quality.quality_scores(df, model, k), token_counts.token_counts(df, "piece_bpe_32k.model", key=k), fingerprints.edited_fingerprints(df, k), alike.alike_groups(df, k),
    ]
    assert all(sorted(str(r[k]) for r in m.collect()) == ["1", "2", "None"] for m in made)
    assert sorted(k for r in packing.packed(df, key=k, folder=str(tmp_path / "p")).collect() for k in r["keys"]) == [1, 2]
    for kept in (quality.keep_quality(df, model), decontaminate.keep_uncontaminated(df, items, item="item.id"), simhash.keep_one(df, k), alike.keep_one(df, k)):
        assert kept.columns == df.columns and kept.count() <= 3
