"""SimHash, line templates, packing, WARC, fingerprints, pipeline: against brute force, and at the edges."""

import base64
import hashlib
import io
import random
import re
import struct
import time
import tracemalloc
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, line_dedup, packing, simhash, warc

DOC = "doc_id long, text string, k string, fp long"
ODD = [(1, None, "x", 1), (2, "", None, 2), (None, "Hello there", "y", 3), (3, "same", "a", 4), (3, "same", "a", 4), (4, " \n\t ", "b", None), (5, "wörd " * 20_000, "c", 6)]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOC)


# simhash


def plain_simhash(text, size=4):
    words = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).replace("\x0b", " ").replace("\x0c", " ")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance=4):
    n = len(values)
    label = list(range(n))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(n // 4)]
    out = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(rng.choice([" ", "\n", "\x0b"]).join(t))
    return out


@pytest.mark.parametrize("fragment", [50_000, 6])
def test_components_against_all_pairs(spark, fragment):
    rows = [(i + 10, t, "", 0) for i, t in enumerate(near_texts(220, 3))] + ODD
    got = simhash.near_duplicates(docs(spark, rows), fragment=fragment).collect()
    assert len(got) == len(rows)
    prints = [plain_simhash(t) for _, t, *_ in rows]
    label = groups(prints)
    want = []
    for (i, *_), f, g in zip(rows, prints, label, strict=True):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == g and rows[j][0] is not None]
        want.append((str(i), f"{f:016x}", str(min(ids, default=None))))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted(want)
    assert len(set(label)) < len(rows) - 20


def test_index_links_like_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 150))
        v = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, n)]
        for _ in range(int(rng.integers(0, 6))):
            v = v ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        v = v[np.argsort(simhash.gray_rank(v))]
        assert simhash.link(np.zeros(n, int), v).tolist() == groups([int(x) for x in v])


def test_gray_ranks_and_masks():
    ranks = np.arange(4096, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))), ranks)
    m, rng = simhash.masks(), random.Random(2)
    assert len(m) == 15
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & x for x in m)


def test_one_of_each_group_stays(spark):
    rows = [(i, "one two three four five six seven eight", "", 0) for i in (9, 4, 7)] + [(1, "wholly other words stand here in this text", "", 0), (None, "x", "", 0)]
    kept = simhash.keep_one(docs(spark, rows), size=5)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"] and kept.columns == ["doc_id", "text", "k", "fp"]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.simhash(b"a " * 200_000) == plain_simhash("a a a a")


def test_near_copies_at_0_8_are_linked(spark):
    """All pairs of five-word shingle sets; most of these are further apart than four bits."""
    from tidemark.llm import alike

    rng = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    texts = [rng.choices(words, k=rng.randint(60, 200)) for _ in range(30)]
    for t in texts[:25]:
        for _ in range(2):
            u = list(t)
            u[rng.randrange(len(u))] = rng.choice(words)
            texts.append(u[: len(u) - rng.randint(0, 5)])
    rows = [(i, " ".join(t), "", 0) for i, t in enumerate(texts)]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    prints = [plain_simhash(r[1], 5) for r in rows]
    label = list(range(len(rows)))
    far = 0
    for i in range(len(rows)):
        for j in range(i):
            jaccard, bits = len(sets[i] & sets[j]) / len(sets[i] | sets[j]), (prints[i] ^ prints[j]).bit_count()
            far += jaccard >= 0.8 and bits > 4
            if (jaccard >= 0.8 or bits <= 4) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert far > 20
    got = {r.doc_id: r.component_id for r in alike.alike_groups(docs(spark, rows + [(None, rows[0][1], "", 0), (900, None, "", 0), (901, " ", "", 0)])).collect()}
    assert got.pop(None) == 0 and got.pop(900) == got.pop(901) == 900
    assert got == dict(enumerate(label))
    import corpus_pipeline as p

    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, *_ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.keep_one(spark, df, "").collect()} == set(label)


# line templates


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ x >> 30) * line_dedup._PAIRS & M64
    x = (x ^ x >> 27) * line_dedup._SIZES & M64
    return x ^ x >> 31


def plain_hash(values, base):
    return sum((v + 1) * pow(base, i, 1 << 64) for i, v in enumerate(values)) & M64


def plain_word(w):
    b = w.encode()
    return line_dedup.FIELD if re.search("[0-9]", w) else mix(plain_hash(b, line_dedup._BYTES) ^ len(b) * line_dedup._SIZES & M64)


def plain_units(line):
    """(first word, end, path, words) of a line's units, as the rules say; short ones of long lines without a path."""
    words = ["\0" if re.search("[0-9]", w) else w for w in re.findall(r"[^ \t\n\r\x0b\f]+", line)]
    h = [line_dedup.FIELD if w == "\0" else plain_word(w) for w in words]
    at = [0, *(i for i in range(1, len(words)) if mix((h[i - 1] * line_dedup._PAIRS + h[i]) & M64) % line_dedup.CUT == 0), len(words)] if len(words) > line_dedup.WHOLE else [0, len(words)]
    return [(a, b, (b - a, *words[a : min(b, a + line_dedup.DEPTH)]) if b - a >= line_dedup.SHORT or len(at) == 2 else None, words[a:b]) for a, b in zip(at, at[1:], strict=False) if b > a]


def plain_name(words):
    x = mix((plain_hash([line_dedup.FIELD if w == "\0" else plain_word(w) for w in words], line_dedup._WORDS) + len(words)) & M64)
    return x - (1 << 64) if x >> 63 else x


def plain_drop(rows, alike=line_dedup.ALIKE, min_docs=2):
    """The same rule over whole lines in memory."""
    h = plain_name
    leaves = {}
    for _, t, *_ in rows:
        for line in (t or "").split("\n"):
            for _, _, path, words in plain_units(line):
                if path:
                    leaves.setdefault(path, {})[h(words)] = words
    name = {}
    for path, lines in leaves.items():
        groups = []
        for x in sorted(lines):
            words = lines[x]
            score = [sum(a == b and not f for a, b, f in zip(g[1], words, g[2], strict=True)) for g in groups]
            best = max(range(len(groups)), key=lambda j: (score[j], -j), default=None)
            if best is not None and score[best] >= alike * len(words):
                g = groups[best]
                g[2] = [f or a != b for a, b, f in zip(g[1], words, g[2], strict=True)]
            else:
                best = len(groups)
                groups.append([x, words, [False] * len(words)])
            name[path, x] = path, groups[best][0]
    where = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            for _, _, path, words in plain_units(line):
                if path and i is not None:
                    where.setdefault(name[path, h(words)], set()).add(i)
    out = []
    for i, t, *_ in rows:
        kept = []
        for line in (t or "").split("\n"):
            each = plain_units(line)
            goes = []  # per word: True, False, or None in a short unit
            for a, b, path, words in each:
                seen = where.get(name[path, h(words)], set()) if path else set()
                goes += [None if not path else i is not None and len(seen) >= min_docs and i != min(seen)] * (b - a)
            if not any(goes):
                kept.append(line)
            elif all(g is not False for g in goes):
                continue
            else:
                code = "".join({True: "x", False: "-", None: "."}[g] for g in goes)
                words = list(re.finditer(r"[^ \t\n\r\x0b\f]+", line))
                text, done = "", 0
                for m in re.finditer(r"x(?:[x.]*x)?", code):
                    if m.end() - m.start() >= line_dedup.RUN:
                        text += line[done : words[m.start()].start()]
                        done = words[m.end()].start() if m.end() < len(words) else words[-1].end()
                kept.append(text + line[done:])
        out.append((str(i), t if t is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_units_are_the_same_in_any_company(monkeypatch):
    rng = random.Random(3)
    pool = ["word", "é", "a1", "x", " ", "\n", "\t", "\r\n", "longer words here", "\u00a0", "d😀"]
    texts = ["", "\n", " ", "a", "\n\nb\n"] + [" ".join(rng.choices(pool, k=rng.randint(0, 200))) for _ in range(40)]
    raw = [t.encode() for t in texts]
    together = line_dedup.Units(raw)
    monkeypatch.setattr(line_dedup, "AT_ONCE", 50)
    assert [i for at, some in line_dedup.chunks(raw) for i in range(at, at + len(some))] == list(range(len(raw)))
    for n, t in enumerate(texts):
        alone, own = line_dedup.Units([raw[n]]), together.of(n)
        for field in ("path", "name", "line", "begin", "end", "counted"):
            assert getattr(alone, field).tolist() == getattr(together, field)[own.start : own.stop].tolist(), field
        want = [(i, len(w), path is not None, plain_name(w)) for i, line in enumerate(t.split("\n")) for _, _, path, w in plain_units(line)]
        assert [(int(alone.line[i]), int(alone.last[i] - alone.first[i]), bool(alone.counted[i]), int(alone.name[i])) for i in range(len(alone.name))] == want
        assert all(line_dedup._SPACE[list(raw[n][a:b])].sum() < b - a for a, b in zip(alone.begin.tolist(), alone.end.tolist(), strict=True))
    paths = {}
    for line in texts:
        for _, _, path, w in [x for part in line.split("\n") for x in plain_units(part)]:
            if path:
                paths.setdefault(plain_name(w), path)
    seen = {}
    for i in np.flatnonzero(together.counted).tolist():
        assert seen.setdefault(paths[int(together.name[i])], int(together.path[i])) == int(together.path[i])
    assert len(set(seen.values())) == len(seen)


def test_shortened_texts_come_a_few_at_a_time(spark, monkeypatch):
    """A task returns some texts at once, never a whole batch of the engine's."""
    held, lines = {}, [f"line number {'x' * i} of all" for i in range(40)]
    df = docs(spark, [(i, "\n".join([lines[i % 40], f"own{i}", "always here again"]), "k", i) for i in range(300)]).coalesce(1)
    plain = line_dedup.in_arrow

    def watched(frame, run, schema):
        held["run"], held["rows"] = run, frame
        return plain(frame, run, schema)

    monkeypatch.setattr(line_dedup, "in_arrow", watched)
    out = line_dedup.drop_recurring_lines(df)
    whole = held["rows"].toArrow().combine_chunks().to_batches()
    monkeypatch.setattr(line_dedup, "AT_ONCE", 500)
    got = list(held["run"](iter(whole)))
    assert sum(b.num_rows for b in got) == 300 and max(sum(len(t) for t in b.column(1).to_pylist()) for b in got) < 600
    assert sorted(tuple(r.values()) for b in got for r in b.to_pylist()) == sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("remembered", [8, line_dedup.REMEMBERED])
def test_tokens_of_every_unit_on_the_map(monkeypatch, remembered):
    monkeypatch.setattr(line_dedup, "REMEMBERED", remembered)
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choices("abcd1", k=rng.randint(1, 40))) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    u = line_dedup.Units([t.encode() for t in texts])
    bits = np.zeros(1 << 10, np.uint8)
    at = u.path[u.counted][::2] % (len(bits) * 8)
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    on = {p for p in u.path.tolist() if bits[p % (len(bits) * 8) >> 3] >> (p % 8) & 1}
    want = {(int(u.path[i]), int(u.name[i]), u.words[u.first[i] : u.last[i]].astype(np.uint32).tobytes()) for i in np.flatnonzero(u.counted) if int(u.path[i]) in on}
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7] + [None])], names=["t"]) for i in range(0, 60, 7)]
    got = [tuple(r.values()) for b in line_dedup._tokens(line_dedup.DEPTH, bits)(iter(batches)) for r in b.to_pylist()]
    assert set(got) == want and (len(got) == len(want) or remembered == 8)


def test_a_map_of_paths_holds_them_all(spark):
    paths = [random.Random(2).getrandbits(63) - (1 << 62) for _ in range(3000)]
    bits = line_dedup.path_map(spark.createDataFrame([(p,) for p in paths], "path long"))
    at = np.array(paths) % (len(bits) * 8)
    assert (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all() and np.bitwise_count(bits).sum() <= 3000
    assert not line_dedup.path_map(spark.createDataFrame([], "path long")).any()


@pytest.mark.parametrize("hot_lines", [line_dedup.HOT_LINES, 12])
def test_lines_against_brute_force(spark, hot_lines):
    rng = random.Random(6)
    logs = lambda: f"{rng.choice(['GET', 'PUT'])} item {rng.randint(1, 99)} from host{rng.randint(1, 3)} took {rng.randint(1, 50)} ms {rng.choice(['ok', 'late', 'lost'])} {rng.choice('abcdefg')}"
    line = lambda: rng.choice([logs(), logs(), "Licensed under terms.", "", "  ", f"one of its kind {rng.random()} {rng.choice('pqrstuv')} " + " ".join(rng.choices("klmno", k=8))])
    words = lambda n: [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('klmnprst')}{rng.choice('aeiou')}{rng.choice('xyz')}" for _ in range(n)]
    passages = [words(60) for _ in range(4)]

    def around():
        p = list(rng.choice(passages))
        p[rng.randrange(60)] = "other"
        return " ".join(words(rng.randint(0, 30)) + p + words(rng.randint(0, 30)))

    rows = [(i, "\n".join(around() if rng.random() < 0.2 else line() for _ in range(rng.randint(1, 6))), "", 0) for i in range(10, 70)] + ODD
    got = line_dedup.drop_recurring_lines(docs(spark, rows), hot_lines=hot_lines)
    assert got.columns == ["doc_id", "text", "k", "fp", "n_lines", "n_dropped", "n_cut"]
    found = got.collect()
    assert sorted(((str(r.doc_id), r.text) for r in found), key=str) == plain_drop(rows)
    assert sum(r.n_dropped for r in found) > 50 and sum(r.n_cut for r in found) > 10 and all(r.n_dropped + r.n_cut <= r.n_lines for r in found)


def test_first_document_keeps_a_shared_passage(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own line of {w}\n{passage}", "", 0) for i, w in ((5, "alpha"), (2, "beta"), (8, "gamma"))]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs(spark, rows)).collect()}
    assert passage in got[2] and passage not in got[5] and passage not in got[8]
    assert line_dedup.drop_recurring_lines(docs(spark, [])).count() == 0


def test_a_passage_inside_other_lines_goes(spark):
    """Passages of 51 to 90 words at any place in a line: all but the first document's lose most of theirs, and nothing else."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n)]
    rows, holders = [], {}
    for p in range(30):
        passage = words(rng.randint(51, 90))
        for i in rng.sample(range(1000 * p, 1000 * p + 1000), 3):
            before, after = words(rng.randint(0, 80)), words(rng.randint(0, 80))
            rows.append((i, " ".join(before + passage + after), "", 0))
            holders.setdefault(p, []).append((i, before, passage, after))
    clean = [(100_000 + i, " ".join(words(200)), "", 0) for i in range(50)]
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(docs(spark, rows + clean)).collect()}
    assert all(got[i] == t for i, t, *_ in clean)
    left = total = 0
    for own in holders.values():
        own.sort(key=lambda x: x[0])
        for n, (i, before, passage, after) in enumerate(own):
            have = got[i].split()
            # a unit over the passage's end may agree with another's in all but a word or two of those around it
            inner, tail = before[: max(0, len(before) - 3)], after[3:]
            assert have[: len(inner)] == inner and (not tail or have[-len(tail) :] == tail)
            if not n:
                assert have == before + passage + after
            else:
                total += 1
                left += " ".join(passage) in got[i]
    assert total == 60 and left <= 4, left


def test_columns_that_clash(spark):
    df = docs(spark, [(1, "a b c d", "", 0), (2, "a b c d\nmore here", "", 0)])
    df = df.withColumns({n: F.lit("mine") for n in ("lines", "_k", "_lines", "path", "template", "component_id", "_kept", "n_words", "t")}).withColumn("n_lines", F.lit("old"))
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df).collect()}
    assert got[2].text == "more here" and got[2].lines == got[2]._k == "mine" and got[2].n_lines == 2
    assert simhash.keep_one(df).columns == df.columns and simhash.near_duplicates(df).count() == 2
    assert fingerprints.edited_fingerprints(df).count() == 2


def every_template(rows, alike=line_dedup.ALIKE):
    """Each line against every template."""
    groups, out = [], []
    for name, tokens in rows:
        score = [int(((g[1] == tokens) & ~g[2]).sum()) for g in groups]
        best = max(range(len(groups)), key=lambda j: (score[j], -j), default=None)
        if best is not None and score[best] >= alike * len(tokens):
            groups[best][2] |= groups[best][1] != tokens
        else:
            best = len(groups)
            groups.append([name, tokens, np.zeros(len(tokens), bool)])
        out.append(groups[best][0])
    return out


def placed(rows, alike=line_dedup.ALIKE, same=0):
    leaf = line_dedup.Leaf(len(rows[0][1]), alike, same)
    return [leaf.place(n, t) for n, t in rows]


def test_a_template_takes_changed_fields():
    a = np.arange(10, dtype=np.uint32)
    b, c = a.copy(), a.copy()
    b[9], c[8], c[9] = 99, 88, 77
    assert placed([(1, a), (2, b), (3, c)]) == [1, 1, 1]
    c[5] = 55
    assert placed([(1, a), (2, b), (3, c)]) == [1, 1, 3]


@pytest.mark.parametrize("width", [1, 4, 5, 6, 9, 10, 11, 23, 40])
def test_indexed_templates_are_those_of_every_comparison(width):
    rng = np.random.default_rng(width)
    for alike in (0.5, 0.8, 0.9, 1.0):
        same = min(4, width)
        seeds = rng.integers(0, 50, (6, width), dtype=np.uint32)
        rows = []
        for n in range(300):
            t = seeds[rng.integers(len(seeds))].copy()
            flip = rng.random(width) < rng.choice([0.02, 0.1, 0.3])
            t[flip] = rng.integers(0, 50, int(flip.sum()))
            t[:same] = 1
            rows.append((n, t))
        assert placed(rows, alike, same) == every_template(rows, alike)


def test_a_large_leaf_takes_no_quadratic_time():
    """Lines that share their first words only: four times as many take about four times the time."""
    rng = np.random.default_rng(2)

    def took(n):
        rows = rng.integers(0, 1 << 31, (n, 20), dtype=np.uint32)
        rows[:, :4] = 7
        began = time.perf_counter()
        assert len(set(placed([(i, r) for i, r in enumerate(rows)], same=4))) == n
        return time.perf_counter() - began

    took(1000)
    small, large = took(5_000), took(20_000)
    assert large < 10 * small


# packing


def test_best_fit_decreasing_against_a_scan():
    rng = random.Random(4)
    for _ in range(60):
        length = rng.randint(1, 40)
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 60))]
        left, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fit = [c for c in left if c >= sizes[i]]
            if fit:
                left[left.index(min(fit))] -= sizes[i]
            else:
                left.append(length - sizes[i])
        rows = packing.best_fit_decreasing(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(left), want


def test_packed_files_hold_every_token(spark, tmp_path):
    rows = [*ODD, *((i, f"text number {i} " * (i % 9), "", 0) for i in range(20, 80))]
    got = packing.packed(docs(spark, rows), folder=str(tmp_path / "p"), length=64, block_tokens=5000).collect()
    encode, pad = packing.byte_pair_encoder("byte_bpe_50k.tiktoken")
    parts = {}
    for r in got:
        ids = np.load(r.file)[r.row_no]
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1]
        assert set(ids[r.n_tokens :].tolist()) <= {pad} and hashlib.sha256(ids[: r.n_tokens].tobytes()).hexdigest() == r.ids_sha256
        for k, o, a, b in zip(r["keys"], r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            parts.setdefault(k, []).append((o, ids[a:b].tolist()))
    for i, t, *_ in rows:
        want = encode(t or "")
        have = [x for _, p in sorted(parts.get(i, [])) for x in p]
        assert sorted(have) == sorted(want * 2 if i == 3 else want)
        if i != 3:
            assert have == want
    assert packing.packed(docs(spark, [])).count() == 0


# WARC

PAGE = "page_id long, url string, html string, payload string"


def test_archives_round_trip(spark, tmp_path):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "u1", big, ""), (2, "u2\r\nX: y", big, ""), (3, None, big, ""), (4, "u4", "short", ""), (5, "u5", "short", ""), (6, "u6", None, ""), (7, "u7", other, ""), (None, "u8", other, ""), (9, "u9", "c" * 999, ""), (10, "", "c" * 999, "")]
    folder = str(tmp_path / "w")
    got = {r.page_id: r for r in warc.archived(spark.createDataFrame(rows, PAGE), folder, archive_bytes=2000).collect()}
    assert len(got) == len(rows)
    for i, u, h, _ in rows:
        r, p = got["" if i is None else str(i)], (h or "").encode()
        want = ("revisit", "3") if i in (1, 2) else ("revisit", "7") if i is None else ("response", None)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), hashlib.sha1(p).hexdigest(), *want)
        assert r.payload == (p if want[0] == "response" else None) and "\n" not in r.url
    assert spark.read.parquet(f"{folder}/manifest").agg(F.sum("records")).first()[0] == len(rows)
    assert warc.archived(spark.createDataFrame([], PAGE)).count() == 0


def test_broken_archives_are_refused():
    digest = hashlib.sha1(b"body").hexdigest()
    good = warc.record("1", "u", b"body", digest, None)
    raw = warc.archive([good, warc.record("2", "v", b"body", digest, "1")])
    out = list(warc.frames(raw))
    assert len(out) == 2 and out[0] == good
    fields, block = warc.parse(out[0], "x")
    assert warc.payload_of(fields, block, "x") == (4, digest, b"body")
    size = struct.unpack_from("<I", raw, 4)[0]
    assert struct.unpack_from("<I", raw)[0] == warc.MAGIC
    for bad in (raw[8:], raw[: 8 + size // 2], raw[:-3], raw[: 8 + size] + b"junk" + raw[8 + size :], raw[:-1] + bytes([raw[-1] ^ 1])):
        with pytest.raises(warc.Malformed):
            list(warc.frames(bad))
    for bad in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good[:-4], good.replace(b"body", b"bodz"), good.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.Malformed):
            warc.parse(bad, "x")
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    packed = zstandard.ZstdCompressor().compress(raw[8 : 8 + size])
    assert list(warc.frames(struct.pack("<II", warc.MAGIC, len(packed)) + packed + c.compress(good))) == [good]
    assert base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex() == digest


def test_reading_is_linear_and_bounded(tmp_path):
    """Four times the records take about four times the time, and a large archive needs little memory."""
    digest = hashlib.sha1(b"x" * 200).hexdigest()

    def made(n):
        return warc.archive([warc.record(str(i), f"http://h/{i}", b"x" * 200, digest, None) for i in range(n)])

    small, large = made(5_000), made(20_000)
    took = {}
    for name, raw in (("small", small), ("large", large), ("small again", small)):
        began = time.perf_counter()
        assert sum(1 for _ in warc.frames(raw)) == (5_000 if "small" in name else 20_000)
        took[name] = time.perf_counter() - began
    assert took["large"] < 8 * max(took["small"], took["small again"], 0.02)
    c = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(b"0123456789" * 50, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    rng, path = random.Random(1), tmp_path / "foreign.warc.zst"
    with open(path, "wb") as f:
        f.write(struct.pack("<II", warc.MAGIC, 500) + b"0123456789" * 50)
        for i in range(60):
            body = rng.randbytes(1_000_000)
            f.write(c.compress(warc.record(str(i), "u", body, hashlib.sha1(body).hexdigest(), None)))
    tracemalloc.start()
    with warc._open(f"file:{path}") as stream:
        assert sum(len(x) for x in warc.frames(stream)) > 60_000_000
    assert tracemalloc.get_traced_memory()[1] < 12_000_000
    tracemalloc.stop()


def test_frames_of_every_form():
    """Frame ends are found for all header forms: sizes, checksums, dictionary ids, repeated and raw blocks, streams of many blocks."""
    rng = random.Random(3)
    d = zstandard.ZstdCompressionDict(b"abcdefgh" * 100, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    bodies = [b"", b"a", b"z" * 300, b"q" * 70_000, rng.randbytes(500), rng.randbytes(300_000), b"abcdefgh" * 40_000]
    out, want = [], []
    for body in bodies:
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}, {"write_dict_id": False, "write_checksum": True}):
            c = zstandard.ZstdCompressor(dict_data=d, **options)
            out.append(c.compress(body))
            z = c.compressobj()
            out.append(z.compress(body) + z.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) + z.compress(body) + z.flush())
            want += [body, body + body]
    raw = struct.pack("<II", warc.MAGIC, 800) + b"abcdefgh" * 100 + b"".join(out)
    assert list(warc.frames(raw)) == want
    for part in (1, 7, 1000):
        b = warc._Bytes(io.BytesIO(b"".join(out)), part)
        assert [b.take(warc.frame_size(b)) for _ in out] == out and not b.has(1)


def test_foreign_records_are_rows_without_a_payload(spark, tmp_path):
    def one(kind, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:x>", "WARC-Date": warc.DATE, "Content-Length": str(len(block)), **more}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    http = {"Content-Type": "application/http; msgtype=response"}
    records = [
        one("warcinfo", b"software: x\r\n"), one("request", b"GET / HTTP/1.1\r\n\r\n", **{"Content-Type": "application/http; msgtype=request"}), one("metadata", b""),
        one("response", b"HTTP/1.1 200 OK\r\n\r\nhello", **http, **{"WARC-Target-URI": "http://a/"}), one("response", b"dns answer", **{"Content-Type": "text/dns"}),
        one("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n", **http, **{"WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(b"hello").digest()).decode()}),
        one("revisit", b"", **http),
    ]
    (tmp_path / "crawl.warc.zst").write_bytes(warc.archive(records))
    (tmp_path / "part-0.warc.zst").write_bytes(warc.archive([warc.record("7", "u", b"own", hashlib.sha1(b"own").hexdigest(), None)]))
    got = sorted(((r.record_type, r.page_id, r.payload_bytes, r.payload and bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([("warcinfo", None, None, None), ("request", None, None, None), ("metadata", None, None, None), ("response", None, 5, b"hello"), ("response", None, None, None), ("response", None, 15, b"5\r\nhello\r\n0\r\n\r\n"), ("revisit", None, None, None), ("response", "7", 3, b"own")], key=str)


def sides_of_joins(plan):
    """The operator below each sort under a sort-merge join; AQE splits a join only at plain exchanges."""
    lines = [re.sub(r"^[\s:+*()\d-]*", "", x) for x in plan.splitlines()]
    out, joins = [], 0
    for a, b in zip(lines, lines[1:], strict=False):
        joins += 2 if a.startswith("SortMergeJoin") else 0
        if joins and a.startswith("Sort "):
            out.append(b.split(" ")[0].split("(")[0])
            joins -= 1
    return out


def test_joins_at_hot_keys_can_be_split(spark, tmp_path):
    """Payloads, fingerprints, line templates and digests that a third of the rows share meet their joins on plain exchanges."""
    rows = [(i, "u" * 2000 if i % 3 == 0 else f"page {i} " * 300, "", 0) for i in range(60)]
    table = spark.createDataFrame(rows, DOC)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [warc.write_archives(table.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")), f"file://{tmp_path}"), simhash.near_duplicates(table)]
        for df in made:
            sides = sides_of_joins(df._jdf.queryExecution().executedPlan().toString())
            assert sides and set(sides) == {"Exchange"}, sides
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# fingerprints


def plain_print(text):
    """The fingerprint again, in plain Python."""
    parts = [s.split("\n") for s in text.split("\n\n")]
    run = re.compile(fingerprints.RUN, re.ASCII)
    leaf = lambda x: f"{xxhash.xxh64_intdigest(x.encode(), 42) & 0xFFFFFFFF:08x}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    root = sha(",".join(sha(",".join(map(sha, s))) for s in parts))[:32]
    return root + ":" + ";".join(",".join("".join(map(leaf, run.findall(p))) for p in s) for s in parts)


def plain_likeness(a, b):
    nodes = lambda x: {x.split(":")[0], *re.findall("[0-9a-f]{8}", x.split(":")[1])}
    x, y = nodes(a), nodes(b)
    return 2 * len(x & y) / (len(x) + len(y))


def test_fingerprints_against_a_tree_in_python(spark):
    rng = random.Random(4)
    pool = ["word", "é", "x\t", " ", "\n", "\n\n", "\r\n", "d😀", "\u00a0", "long" * 9]
    texts = ["", " ", "\n", "\n\n\n"] + [" ".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(80)]
    texts += texts[5:12]  # equal neighbours in likeness
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs(spark, rows)).collect()}
    for i, t, *_ in rows:
        after, cut, r = texts[(i + 1) % len(texts)], len(t) // 4, got[i]
        edited = t[: len(t) - cut] + after[:cut]
        assert (r.fingerprint, r.edited_fingerprint) == (plain_print(t), plain_print(edited)), repr(t)
        assert abs(r.near_edited - plain_likeness(plain_print(t), plain_print(edited))) < 1e-12 and abs(r.near_next - plain_likeness(plain_print(t), plain_print(after))) < 1e-12


def test_equal_leaves_are_not_equal_texts(spark):
    """Leaves are 32 bits wide, so some texts share theirs; their roots differ and so do they."""
    seen = {}
    for i in range(1_000_000):
        h = xxhash.xxh64_intdigest(str(i).encode(), 42) & 0xFFFFFFFF
        if h in seen:
            break
        seen[h] = i
    a, b = str(seen[h]), str(i)
    assert a != b
    r = fingerprints.edited_fingerprints(docs(spark, [(1, a, "", 0), (2, b, "", 0)])).where("doc_id = 1").first()
    other = spark.createDataFrame([(b,)], "t string").select(fingerprints.fingerprint(F.col("t"))).first()[0]
    assert r.fingerprint.split(":")[1] == other.split(":")[1] and r.fingerprint != other and r.near_next < 1


def test_edited_texts_and_likeness(spark):
    rng = random.Random(9)
    rows = [(i * 3, rng.choice(["\n", "\n\n", " "]).join(" ".join(rng.choices(["é", "abc", "d😀"], k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))), "", 0) for i in range(60)] + [(500, None, "", 0), (501, "", "", 0), (502, "same text", "", 0), (503, "same text", "", 0), (503, "same text", "", 0), (None, "abcdefgh", "", 0)]
    got = fingerprints.edited_fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {i: t or "" for i, t, *_ in rows if i is not None}
    ids = sorted(by)
    for r in got:
        t = "abcdefgh" if r.doc_id is None else by[r.doc_id]
        after = "" if r.doc_id is None else by[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        cut = len(t) // 4
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_next == 1) == (t == after)
        assert (r.fingerprint == r.edited_fingerprint) == (t == t[: len(t) - cut] + after[:cut])
    prints = {}
    for r in got:
        prints.setdefault("abcdefgh" if r.doc_id is None else by[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert fingerprints.edited_fingerprints(docs(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(docs(spark, [(1, "alone here", "", 0)])).first().near_next == 1.0


def test_following_keys_over_many_ranges(spark):
    rng = random.Random(1)
    numbers = sorted(rng.sample(range(-10_000, 10_000), 500))
    words = sorted({f"key {rng.randrange(10**9)}" for _ in range(400)})
    days = sorted({date(2020, 1, 1) + timedelta(days=rng.randrange(5000)) for _ in range(300)})
    for keys, kind in ((numbers, "long"), (words, "string"), (days, "date"), ([k + 0.5 for k in numbers], "double")):
        df = spark.createDataFrame([(k,) for k in [*keys, *keys[:20]]] + [(None,)], f"`the key.` {kind}")
        got = {r["the key."]: r.following for r in fingerprints.next_keys(df, "the key.", per_range=40).collect()}
        assert got == dict(zip(keys, keys[1:] + keys[:1], strict=True)), kind
    rows = spark.createDataFrame([(w, f"text of {w}") for w in words], "`the key.` string, text string")
    got = {r["the key."]: r for r in fingerprints.edited_fingerprints(rows, "the key.", per_range=40).collect()}
    assert len(got) == len(words) and all(got[w].near_next < 1 for w in words)


def test_branches_locate_edits(spark):
    a = "one two\nthree four\n\nfive six\nseven"
    b = "one two\nthree 4\n\nfive six\nseven"
    df = spark.createDataFrame([(a, b), (a, a), (a, a + "\nnew")], "a string, b string")
    d = df.select(fingerprints.differing_branches(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("d")).collect()
    assert [[tuple(x) for x in r.d] for r in d] == [[(0, 1)], [], [(1, 2)]]


# pipeline


def test_stages_do_what_they_say(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(12)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in "mnrst"]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = prose(24)
    rows = [(i, "\n".join(prose(rng.randint(20, 60)) for _ in range(3)), "en", "s", 0) for i in range(120)]
    rows += [(200, rows[0][1], "en", "s", 0), (201, " ".join(f"{w.upper()}!!!" for w in prose(40).split()), "en", "s", 0), (202, prose(20) + "\n" + prose(5) + " " + bench, "en", "s", 0), (203, None, None, None, None), (None, prose(40), "en", "s", 0)]
    rows += [(300 + i, " ".join(f"{w.upper()}!!!" for w in prose(40).split()), "en", "s", 0) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs_ = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs_, str(tmp_path)).columns == p.COLUMNS, name
    got = p.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert set(range(120)) <= ids and not ids & {200, 201, 202} and not any(i is not None and i >= 300 for i in ids)
    assert len(got) == len(ids)
