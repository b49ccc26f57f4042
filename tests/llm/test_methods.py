"""The operators' inner steps against plain Python, and tables of unusual shape."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanewise.llm import common, language_id, licenses, media, mixing, near_dup, packing, pii, token_counts, topk, url_filter, webp
from test_operators import WORDS, base_spans, docs_of, groups_of, saved

# ---- 1: personal data ----


def test_reliabilities_are_plain_expectation_maximisation(spark):
    rng = random.Random(6)
    patterns = {}
    for _ in range(40):
        patterns[rng.choice(("email", "card")), tuple(rng.choice((-1, 0, 1)) for _ in pii.LABELERS)] = rng.randrange(1, 300)
    rows = spark.createDataFrame([(k, list(v), n) for (k, v), n in patterns.items()], "kind string, v array<int>, n long")
    got = {r["kind"]: r["model"] for r in pii._estimated(rows).collect()}
    check = pii.LABELERS.index("check")
    for kind in ("email", "card"):
        own = [(v, n) for (k, v), n in patterns.items() if k == kind]
        prior, yes, no = 0.5, [[0.1, 0.2, 0.7] for _ in pii.LABELERS], [[0.7, 0.2, 0.1] for _ in pii.LABELERS]
        for _ in range(pii.ITERATIONS):
            shares = []
            for v, n in own:
                a, b = prior * math.prod(yes[i][x + 1] for i, x in enumerate(v)), (1 - prior) * math.prod(no[i][x + 1] for i, x in enumerate(v))
                a = 0.0 if kind in pii.EXACT and v[check] == -1 else a
                shares.append((v, n * a / (a + b), n * b / (a + b)))
            all_yes, all_no = sum(y for _, y, _ in shares), sum(x for *_, x in shares)
            prior = (1 + all_yes) / (2 + all_yes + all_no)
            yes = [[(1 + sum(y for v, y, _ in shares if v[i] == w)) / (3 + all_yes) for w in (-1, 0, 1)] for i in range(len(pii.LABELERS))]
            no = [[(1 + sum(x for v, _, x in shares if v[i] == w)) / (3 + all_no) for w in (-1, 0, 1)] for i in range(len(pii.LABELERS))]
        assert got[kind]["prior"] == pytest.approx(prior)
        assert [list(x) for x in got[kind]["yes"]] == [pytest.approx(x) for x in yes] and [list(x) for x in got[kind]["no"]] == [pytest.approx(x) for x in no]


def test_classifier_is_plain_naive_bayes(spark):
    rng = random.Random(7)
    cases = [("email", rng.random(), [f"a={rng.randrange(3)}", f"b={rng.randrange(2)}"]) for _ in range(60)]
    row = pii._trained(spark.createDataFrame(cases, "kind string, p double, f array<string>")).first()
    yes, no = sum(p for _, p, _ in cases), sum(1 - p for _, p, _ in cases)
    assert row["bias"] == pytest.approx(math.log((1 + yes) / (1 + no)))
    for f in {f for *_, fs in cases for f in fs}:
        y, n = sum(p for _, p, fs in cases if f in fs), sum(1 - p for _, p, fs in cases if f in fs)
        assert row["weights"][f] == pytest.approx(math.log((1 + y) / (2 + yes) * (2 + no) / (1 + n)))


def test_many_matches_and_overlaps(spark, tmp_path):
    """More matches than a fold takes, with their places; spans that overlap go together; a mark at the front of a part stays."""
    many = " ".join(f"10.{i % 250}.{i // 250}.7" for i in range(1500))
    rows = [many, "﻿a@b.co﻿ \U0001f600 +4930901820 4111111111111111", "x@1.2.3.4 y", None]
    df = saved(spark, tmp_path, docs_of(spark, rows))
    got = {r["doc_id"]: r for r in pii.personal_data(common.numbered(df.select("doc_id", "text"))).collect()}
    for i, text in enumerate(rows):
        assert [tuple(x) for x in got[i]["base"]] == [(a, k + 1, b, kind) for a, k, b, kind in base_spans(text or "")]
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[0] == " ".join(["[IP]"] * 1500) and masked[3] is None
    assert masked[1].startswith("﻿[EMAIL]﻿ \U0001f600 ") and masked[2] == "[EMAIL] y"
    assert pii.masked(df.where("false")).count() == 0 and pii.masked(df.where("false")).columns == df.columns


def test_free_spans(spark):
    rng = random.Random(8)
    spans = [(rng.randrange(3), a, a + rng.randrange(1, 9), rng.random() < 0.4) for a in (rng.randrange(60) for _ in range(80))]
    df = spark.createDataFrame(spans, "_row long, start int, end int, fixed boolean")
    for r in pii._free(df).collect():
        clash = any(row == r["_row"] and fixed and a < r["end"] and r["start"] < b for row, a, b, fixed in spans)
        assert r["free"] == (not clash)


# ---- 2: WebP ----


def test_predictors_of_mixed_modes():
    """Against one pixel after another; modes change from pixel to pixel."""
    rng = np.random.default_rng(3)
    for width, height in ((1, 1), (1, 7), (9, 1), (2, 2), (16, 9), (7, 20)):
        argb = rng.integers(0, 1 << 32, width * height, dtype=np.uint64).astype(np.uint32)
        modes = rng.integers(0, 16, (height, width))
        out = np.zeros((height * width, 4), np.int32)
        rest = np.stack(webp._channels(argb), -1)
        for i in range(width * height):
            y, x = divmod(i, width)
            if not i:
                near = np.array([255, 0, 0, 0])
            elif not y:
                near = out[i - 1]
            elif not x:
                near = out[i - width]
            else:
                near = webp._predict(int(modes[y, x]), out[i - 1], out[i - width], out[i - width - 1], out[i - width + 1])
            out[i] = (rest[i] + near) & 0xFF
        assert (webp._undo_predictor(argb, width, height, modes) == webp._argb(out.T)).all()


def test_stored_form_uses_what_saves(rng=random.Random(9)):
    line = b"the same row of text, sixty-four bytes long. " + b"x" * 19
    prose = " ".join(rng.choice(WORDS) for _ in range(3000)).encode()
    prose += bytes(-len(prose) % 64)
    grey = b"".join(bytes((g, g, g, 255)) for g in rng.randbytes(3200))
    few = b"".join(rng.choice((b"abcd", b"wxyz")) for _ in range(1600))
    sizes = {}
    for name, payload in (("line", line * 1000), ("prose", prose), ("grey", grey), ("few", few), ("noise", rng.randbytes(6400)), ("again", rng.randbytes(640) * 30), ("zero", bytes(64))):
        data = webp.store(payload)
        assert webp.decode_all(data)[2] == payload
        sizes[name] = len(data) / len(payload)
    assert sizes["line"] < 0.01 and sizes["prose"] < 0.5 and sizes["grey"] < 0.3 and sizes["few"] < 0.07 and sizes["noise"] < 1.05 and sizes["again"] < 0.06
    pixels = lambda payload: np.frombuffer(payload, "<u4")
    assert webp._best_transform(np.frombuffer(grey, np.uint8)) == {"subtract_green": True} and webp._best_transform(np.frombuffer(few, np.uint8)) == {"palette": True}
    assert webp._best_transform(np.frombuffer(line * 1000, np.uint8)) == {"predictor": 2}
    tokens = webp._best_tokens(pixels(prose), 16)
    assert tokens.cache_bits and len(tokens.cached)


def test_media_features(spark):
    texts = ["", "abc", "é" * 100, None]
    got = {r["doc_id"]: r["feature"] for r in media.digests(docs_of(spark, texts)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        px = raw + bytes(-len(raw) % 64) or bytes(64)
        rows = [[px[64 * y + 4 * x : 64 * y + 4 * x + 4] for x in range(16)] for y in range(len(px) // 64)]
        flat = [p for row in rows for p in row]
        sums = [sum(p[c] for p in flat) for c in range(4)] + [sum(p[c] ** 2 >> 8 for p in flat) for c in range(4)]
        right = sum(abs(a[c] - b[c]) for row in rows for a, b in itertools.pairwise(row) for c in range(4))
        down = sum(abs(a[x][c] - b[x][c]) for a, b in itertools.pairwise(rows) for x in range(16) for c in range(4))
        assert got[i] == ":".join(map(str, [*sums, right, down]))
    assert media.digests(docs_of(spark, [])).count() == 0


# ---- 3: near duplicates ----


@pytest.mark.parametrize("changed", [{"SMALL": 1}, {"SMALL": 10**6}, {"PICK_ROWS": 0}, {"hot": 2}])
def test_other_ways_give_the_same_groups(spark, tmp_path, monkeypatch, changed):
    """Prefix filter for all buckets, or for none; texts picked by shuffle; keys of three rows and more by broadcast."""
    if "hot" in changed:
        monkeypatch.setattr(common, "HOT_ROWS", 2)
    for name, value in changed.items():
        if name != "hot":
            monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(10)
    family = []
    for base in ([rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(60)] for _ in range(3)):
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, 7)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            family.append(" ".join(words))
    rows = list(enumerate([*family, *family[:9], *family[:9], "", None, "one two", "ONE two", "long " * 9000]))
    sets, group = groups_of(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(saved(spark, tmp_path, docs_of(spark, rows))).collect()}
    assert got == {i: (len(sets[i]), group[i]) for i, _ in rows}


def test_bands_miss_as_few_as_they_should():
    """Of sets at the threshold: bands that agree, against the probability that they do."""
    rng, agreed, missed = np.random.default_rng(4), 0, 0
    for _ in range(400):
        numbers = rng.integers(0, 1 << 63, 700).astype(np.uint64)
        a, b = near_dup.minima(np.sort(numbers[:600])), near_dup.minima(np.sort(numbers[100:]))  # 500 of 700
        same = int((near_dup.band_keys(a) == near_dup.band_keys(b)).sum())
        agreed, missed = agreed + same, missed + (same == 0)
    p = (500 / 700) ** near_dup.ROWS
    assert agreed / (400 * near_dup.BANDS) == pytest.approx(p, rel=0.1) and missed == 0


# ---- 4: licenses ----


def plain_alignment(template, words, shift, band, low):
    """Best (matches, -extent, -start, -end) of common subsequences within the band, by all states."""
    best, above = (0, 0, 0, 0), {}
    for j, t in enumerate(template):
        row = {}
        for i in range(j + shift - band, j + shift + band + 1):
            here = max(row.get(i - 1, (0, 0)), above.get(i, (0, 0)))
            if low <= i < len(words) and words[i] == t:
                n, start = above.get(i - 1, (0, 0))
                taken = (n + 1, start if n else i)
                here = max(here, taken)
                best = max(best, (taken[0], -(i - taken[1]), -taken[1], i))
            row[i] = here
        above = row
    n, _, start, end = best
    return (n, -start, end + 1) if n else (0, 0, 0)


def test_alignment_is_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        template = [rng.randrange(6) for _ in range(rng.randrange(1, 14))]
        words = [rng.randrange(7) for _ in range(rng.randrange(1, 40))]
        shifts, band, low = sorted({rng.randrange(-5, len(words) + 2) for _ in range(4)}), rng.randrange(0, 4), rng.choice((0, 0, 3))
        got = licenses.aligned(np.array(template, np.uint64), np.array(words, np.uint64), np.array(shifts), band, low)
        for k, shift in enumerate(shifts):
            assert tuple(int(x[k]) for x in got) == plain_alignment(template, words, shift, band, low), (template, words, shift, band, low)


def test_scan_is_brute_force(spark):
    """All windows and all diagonals, without an index, against the operator; texts of stock phrases, worn and repeated templates."""
    rng = random.Random(12)
    own = {"one": " ".join(rng.choice(WORDS) + str(rng.randrange(4)) for _ in range(25)), "two": " ".join(rng.choice(WORDS) for _ in range(9))}
    texts = [None, "", "word"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = own[rng.choice(("one", "two"))].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = "changed"
            at = rng.randrange(0, len(words) // 2) if rng.random() < 0.3 else 0
            parts += words[at:] + [rng.choice(WORDS) for _ in range(rng.randrange(0, 12))]
        texts.append(" ".join(parts))
    got = collections.defaultdict(list)
    for r in licenses.scanned(docs_of(spark, texts), own, 0.7, 4).collect():
        got[r["doc_id"]].append((r["license"], r["matched"], r["start"], r["end"]))
    found = 0
    for i, text in enumerate(texts):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
        hashes = np.array([licenses._Hashes()[w] for w in words], np.uint64)
        kept = licenses.winnowed(licenses._grams(hashes)).tolist()
        expected = []
        for name, template in own.items():
            t, done = template.split(), 0
            for k in kept:
                for j in (j for j in range(len(t) - 2) if t[j : j + 3] == words[k : k + 3]):
                    if k < done:
                        continue
                    n, start, end = plain_alignment(t, words, k - j, 4, done)
                    if n >= 0.7 * len(t) and end > done:
                        done = end
                        expected.append((name, n, spans[start][0], spans[end - 1][1]))
        assert sorted(got[i]) == sorted(expected)
        found += len(expected)
    assert found > 40


def test_licenses_that_resemble_one_another(spark):
    names = ["bsd-2-clause", "bsd-3-clause", "isc", "mit"]
    got = collections.defaultdict(set)
    for r in licenses.scanned(docs_of(spark, [licenses.TEMPLATES[n] for n in names])).collect():
        got[r["doc_id"]].add((r["license"], r["coverage"]))
    assert {i: {n for n, c in found if c == 1.0} for i, found in got.items()} == {i: {n} for i, n in enumerate(names)}


# ---- 5 and 10: tokens ----


def test_head_is_within_its_bound(spark, tmp_path):
    df = saved(spark, tmp_path, docs_of(spark, ["a b c d e f g h"] * 20 + ["a a a a b b b"] * 5))
    texts = common.numbered(df.select("doc_id", "text"))
    head = token_counts.head_counts(texts.select("_row", "text"), 25, "byte_bpe_50k.json", 3, 25)
    assert 0 < len(head) <= 3
    assert token_counts.count_tokens(df.where("false")).count() == 0


def test_packing_of_repeated_and_null_rows(spark, tmp_path):
    df = saved(spark, tmp_path, docs_of(spark, [(1, "same text here"), (1, "same text here"), (None, "x y"), (2, None), (3, "")]))
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 5 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5
    ends = collections.defaultdict(list)
    for r in rows:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in ends.values():
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(own))) and min(own)[0] == 0


# ---- 6: top-k ----


def test_top_k_in_rounds_and_of_empty_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 1, (220, 6)).astype(np.float32).tolist())] + [(300, []), (301, []), (303, []), (350, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    ask = lambda: sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    once = ask()
    assert [r for r in once if r[0] in (300, 350)] == [(300, 1, 301, 0), (300, 2, 303, 0), (300, 3, 350, 0), (350, 1, 300, 0), (350, 2, 301, 0), (350, 3, 303, 0)]
    monkeypatch.setattr(topk, "ROUND_VALUES", 20)
    assert ask() == once and len(once) == 5 * 5 + 6
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "BLOCK_VALUES", 30)
    scores, _ = topk._Best((np.array([0]), np.array([0]), np.array([[1, 2]])), 2), None
    for at in range(0, 9, 3):
        scores.meet(np.arange(at, at + 3), np.arange(at, at + 3), np.array([[at, 0], [at, 1], [at, 2]]))
    assert scores.table().column("vec_id").to_pylist() == [8, 7]


# ---- 7: languages ----


def test_filters_against_exact_sets(spark):
    """Every gram that training kept is found; of others about the stated share; a long text like its parts."""
    rng = random.Random(13)
    letters = {"x": "abcdefgh", "y": "efghijkl"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(3, 7)))
    rows = [(i, " ".join(word(lang) for _ in range(60)), lang) for i, lang in enumerate(rng.choice("xy") for _ in range(300))]
    filters = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = {lang: collections.Counter() for lang in "xy"}
    for _, text, lang in rows:
        padded = f" {text} "
        for n in language_id.SIZES:
            counts[lang].update(padded[i : i + n] for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1])
    rate = {lang: {g: n / sum(own.values()) for g, n in own.items()} for lang, own in counts.items()}
    kept = {lang: {g for g, n in own.items() if n >= language_id.LEAST and rate[lang][g] >= language_id.RATIO * max(rate[x].get(g, 0) for x in "xy")} for lang, own in counts.items()}

    def found(gram, k):
        points = language_id._folded()[np.array([ord(c) for c in gram])]
        h, _ = language_id._grams(points, len(gram))
        return all(filters.masks[0][p][0] >> k & 1 for p in language_id._positions(h))

    assert filters.languages == ["x", "y"]
    for k, lang in enumerate("xy"):
        assert all(found(g, k) for g in kept[lang])
        others = {"".join(rng.choice("mnopqrstuvw") for _ in range(4)) for _ in range(6000)}
        assert sum(found(g, k) for g in others) / len(others) <= filters.false[k] + 0.002
    text = " ".join(word("x") for _ in range(4))
    (short, long), _ = filters.scores([text, " ".join([text] * 60000)])
    assert abs(short - long).max() < 0.1 and short.argmax() == 0


# ---- 8: urls ----


def test_links_between_hosts_change_verdicts(spark, tmp_path, monkeypatch):
    """Two hops from a blocked and from an allowed host; ties allow; hubs by broadcast or not."""
    link = lambda *hosts: " ".join(f'<a class="x" href="http://{h}/p">x</a>' for h in hosts)
    pages = [
        (1, "http://bad.net/es/1", "", "x"), (2, "http://near.org/a", link("bad.net"), "x"), (3, "http://far.org/a", link("near.org"), "x"),
        (4, "http://good.com/a", link("friend.org"), "x"), (5, "http://friend.org/a", link("FRIEND.org", "second.org"), "x"), (6, "http://second.org/a", None, "x"),
        (7, "http://alone.org/a", "<a href='/rel'>", "x"), (8, "http://bad.net/other", "", "x"), (8, "http://bad.net/other", "", "x"), (9, None, link("bad.net"), "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string").repartition(3)
    expected = {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow"}
    for hot in (10**6, 0):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        rows = url_filter.filtered(saved(spark, tmp_path / str(hot), df)).collect()
        assert len(rows) == 10 and {r["page_id"]: r["verdict"] for r in rows} == expected
    ranks = {(r["mode"], r["host"]): r["rank"] for r in url_filter.propagated(spark.createDataFrame([("distrust", "a", 1.0), ("trust", "a", 1.0)], "mode string, host string, mass double"), spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "source string, target string, links double")).collect()}
    assert ranks["trust", "b"] == pytest.approx(ranks["distrust", "b"])
    assert url_filter.filtered(df.where("false")).count() == 0


# ---- shared ----


@pytest.mark.parametrize("own", [None, "1m", "64m"])
def test_workers_are_sent_a_bounded_number_of_bytes_at_once(spark, own):
    """24 MB of text in one partition; whole, and the session's own setting is as it was."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["rows", "size"])

    if own:
        spark.conf.set(common._BATCH, own)
    try:
        texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 1000).alias("text"))
        got = common.cut(texts.mapInArrow(sizes, "rows long, size long"), "sizes").collect()
        assert spark.conf.get(common._BATCH, None) == own
    finally:
        spark.conf.unset(common._BATCH)
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["size"] for r in got) < 1.1 * (1 << 20 if own == "1m" else common.BATCH_BYTES)


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 2), ("c", 9), (None, 7)) for i in range(n)], "k string, i int")
    keys = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, x int")
    assert {r["k"] for r in common.hot_keys(rows, ["k"]).collect()} == {"a", "c", None}
    for how in ("inner", "left"):
        plain, split = (sorted(map(tuple, df.select("k", "i", "x").collect()), key=str) for df in (rows.join(keys, "k", how), common.joined(rows, keys, ["k"], how)))
        assert plain == split


def test_long_plans_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    df = saved(spark, tmp_path, docs_of(spark, ["word " * n for n in (1, 5, 900, 2100, 2100, 3, 3, 3)]))
    place = lambda: sorted(tuple(r) for r in packing.pack_documents(df).drop("sequence_id").collect())
    once = place()
    monkeypatch.setattr(packing, "BROADCAST_SLOTS", 0)
    monkeypatch.setattr(packing, "PART_ROWS", 1)
    monkeypatch.setattr(packing, "SALTS", 2)
    assert [r[:4] for r in place()] == [r[:4] for r in once] and len(once) > 8


def test_a_plan_is_plain_best_fit():
    """Bin by bin, without groups: as many bins, and every item where it fits."""
    rng = random.Random(14)
    for select in ("norm", "dot"):
        for _ in range(15):
            caps = packing.Capacities(100, rng.choice((3, 100)), rng.choice((2500, 10000)), (1.0, 0.5, 2.0), select)
            histogram = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 90), 12)}
            size, weight = np.array([caps.tokens, caps.documents, caps.attention], float), np.array(caps.weights)
            bins = []
            for length in sorted(histogram, reverse=True):
                demand = np.array([length, 1, length * length], float)
                for _ in range(histogram[length]):
                    fits = [i for i, r in enumerate(bins) if (r >= demand).all()]
                    score = lambda i: float((weight * ((bins[i] - demand) / size) ** 2).sum()) if select == "norm" else -float((weight * (demand / size) * (bins[i] / size)).sum())  # noqa: B023, E731
                    at = min(fits, key=score) if fits else len(bins)
                    if not fits:
                        bins.append(size.copy())
                    bins[at] = bins[at] - demand
            rows = packing.plan(histogram, caps)
            made = {first + k for _, a, b, first, each, _ in rows for k in range(-(-(b - a) // each))}
            assert len(made) == len(bins)


def test_a_long_page_and_a_long_text(spark):
    html = "".join(f'<a href="http://h{i % 50}.org/{i}">x</a>' for i in range(20000))
    rows = url_filter.host_edges(spark.createDataFrame([("http://a.org/", html), ("http://a.org/", html), (None, html)], "url string, html string")).collect()
    assert len(rows) == 50 and {r["links"] for r in rows} == {2.0}
    docs = docs_of(spark, ["word " * 200000, "b c", "", None])
    weights = mixing.mixed(docs, mixing.Mix(repetitions=1.5)).count()
    assert weights >= 4
