"""Spelling variants, url filters and hard negatives against brute force on small tables."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tspanel.llm import negatives, spelling
from tspanel.llm.negatives import Bucket, hard_negatives
from tspanel.llm.spelling import chosen_pivots, damaged_words, near_words, spelling_groups
from tspanel.llm.urls import concentration, judge_urls, reputations

# -- spelling variants ------------------------------------------------------------------


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a != b and a[i + 1 :] == b[i + 1 :]


def brute_groups(counts):
    near = {w: [x for x in counts if distance_one(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def vocabulary(seed, size=260):
    r = random.Random(seed)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(size)}
    words |= {"aaaaa", "aaaaaa", "aaaaaaa", "baaaaaa", "abaaaaaaa", "ababababa", "babababab", "ÿÿÿÿÿ", "ÿÿÿÿ×", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    for w in list(words)[:80]:
        i = r.randrange(len(w))
        words.add(w[:i] + r.choice(["", "c", w[i] + "z"]) + w[i + 1 :])
    return {w: r.choice([3, 4, 6, 6, 12, 24, 48, 100, 1000]) for w in words if len(w) >= 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_groups_equal_brute_force(spark, seed):
    counts = vocabulary(seed)
    table = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, root string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_groups(table).collect()}
    assert got == brute_groups(counts)


def test_many_words_share_a_rare_beginning(spark):
    """All words hold the same two rare bigrams: the pivots tell nothing, the rest of the key does."""
    words = ["qxqz" + "".join(p) for p in itertools.product("abc", repeat=5)]
    pairs = near_words(spark.createDataFrame([(w,) for w in words], "word string"))
    want = {(a, b) for a in words for b in words if distance_one(a, b)}
    assert {tuple(r) for r in pairs.collect()} == want


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark sizes the keys of words by the files of the words, some 20 times too low: small files must not lead to a broadcast."""
    counts, kept = vocabulary(3), spelling.store
    run = []

    def seen(df):
        df.collect()
        run.append(df)
        return kept(df)

    monkeypatch.setattr(spelling, "store", seen)
    out = spelling_groups(spark.createDataFrame([*counts.items()], "word string, n long"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()} == brute_groups(counts)
    plans = [df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0] for df in [*run, out]]
    assert sum(p.count("SortMergeJoin") for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]


def test_pivots_are_disjoint_and_least(spark):
    r = random.Random(5)
    for _ in range(300):
        places = sorted(r.sample(range(12), r.randint(3, 7)))
        weights = [r.randint(1, 9) for _ in places]
        got = chosen_pivots(places, weights)
        options = [(weights[i] + weights[j], (i, j)) for i, j in itertools.combinations(range(len(places)), 2) if places[j] - places[i] >= 2]
        assert places[got[1]] - places[got[0]] >= 2
        assert sum(weights[i] for i in got) == min(o[0] for o in options)


def test_damaged_words_equal_brute_force(spark):
    r = random.Random(8)
    pool = ["Straße", "straße", "ÀÉÎõü", "Rivers", "rivers", "abcde", "abcdef", "four", "x" * 40, "a×b÷c"]
    texts = [" ".join(r.choice(pool) + r.choice(["", ".", "9x", "Ω"]) for _ in range(r.randint(0, 60))) for _ in range(120)] + [None, "", "   ", "Rivers " * 30000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "Rivers rivers rivers", 1)]
    want = Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    got = damaged_words(spark.createDataFrame(rows, "doc_id long, text string, word long"))
    assert {(x.word, x.n) for x in got.collect()} == {(w, n) for w, n in want.items() if len(w) >= 5 and n >= 3}


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_groups(damaged_words(empty)).count() == 0


# -- url filters ------------------------------------------------------------------------

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def judged(spark, pages, outcomes=(), rules=RULES, **more):
    out = judge_urls(
        spark.createDataFrame(pages, "page_id long, url string, host string, rule string"),
        spark.createDataFrame(list(outcomes), "page_id long, bad boolean"),
        spark.createDataFrame(rules, "verdict string, host string, path string"), **more,
    )
    return out.select("row.page_id", *[c for c in out.columns if c != "row"])


def test_parts_and_rules(spark):
    cases = {
        "http://A.Example.com/en/1?x#y": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/2": ("www.example.com", "/en/2", "www.example.com/en/", "allow"),
        "x://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://net/es/a": ("net", "/es/a", "net/es/", "block"),
        "http://ÄB.net/fr/?q=://z": ("Äb.net", "/fr/", "net/fr/", "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://a.net?/es/": ("a.net", "", None, "allow"),
        "http://\nq.net/es/\n#": ("\nq.net", "/es/\n", "net/es/", "block"),
        "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://" + "a." * 30000 + "net/es/" + "p" * 100000: ("a." * 30000 + "net", "/es/" + "p" * 100000, "net/es/", "block"),
    }
    urls = [*cases, "http://net/es/a"]
    got = judged(spark, [(i, u, "x", "y") for i, u in enumerate(urls)]).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[urls[r.page_id]]


def test_longest_rule_and_block_first_among_equals(spark):
    rules = [("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", "/x/yz"), ("allow", "b", "/")]
    got = {r.page_id: (r.rule, r.verdict) for r in judged(spark, [(1, "h://a.b/x", "", ""), (2, "h://a.b/x/yz", "", ""), (3, "h://c.b/q", "", "")], rules=rules).collect()}
    assert got == {1: ("a.b/x", "block"), 2: ("b/x/yz", "allow"), 3: ("b/", "allow")}


def brute_reputation(hosts, limit):
    """Posterior means and P(rate > limit) by the same moments, with the density summed up."""

    def moments(items):
        excess = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in items if n)
        room = sum(n * m * (1 - m) * (n - 1) for n, b, m in items if n)
        r = excess / room if room else 0
        return min(max(1 / r - 1, 1.0), 1e6) if r > 0 else 1e6

    def up(level):
        out = {}
        for h, (n, b) in hosts.items():
            key = ".".join(h.split(".")[-level:])
            x = out.setdefault(key, [0, 0])
            x[0] += n
            x[1] += b
        return out

    rates = {"": (sum(b for _, b in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)}
    parent = lambda key: key.split(".", 1)[1] if "." in key else ""
    for level in (1, 2):
        table = up(level)
        k = moments([(n, b, rates[parent(h)]) for h, (n, b) in table.items()])
        rates |= {h: (k * rates[parent(h)] + b) / (k + n) for h, (n, b) in table.items()}
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    k = moments([(n, b, rates[domain[h]]) for h, (n, b) in hosts.items()])
    out = {}
    for h, (n, b) in hosts.items():
        m = rates[domain[h]]
        a, c = k * m + b, k * (1 - m) + n - b
        x = (np.arange(400000) + 0.5) / 400000
        density = np.exp(math.lgamma(a + c) - math.lgamma(a) - math.lgamma(c) + (a - 1) * np.log(x) + (c - 1) * np.log(1 - x))
        out[h] = ((k * m + b) / (k + n), density[x > limit].mean() * (x > limit).mean())
    return out


def test_reputation_equals_brute_force(spark):
    r = random.Random(4)
    hosts = {}
    for d in range(12):
        base = r.random()
        for h in range(r.randint(1, 5)):
            n = r.choice([0, 1, 5, 40, 300])
            hosts[f"h{h}.d{d}.{r.choice(['com', 'net'])}"] = (n, sum(r.random() < base for _ in range(n)))
    table = spark.createDataFrame([(h, *v) for h, v in hosts.items()], "host string, n long, bad long")
    want = brute_reputation(hosts, 0.4)
    for row in reputations(table, 0.4).collect():
        assert (row.posterior, row.p_over) == pytest.approx(want[row.host], abs=2e-4)


def test_hosts_are_shrunk_and_blocked(spark):
    """A bad host of a good domain needs evidence; unseen hosts of a bad domain inherit it."""
    sites = {"bad.one.org": (60, 57), "ok.one.org": (200, 4), "few.one.org": (1, 1), "a.two.org": (80, 78), "b.two.org": (90, 88), "new.two.org": (0, 0)}
    sites |= {f"s{i}.d{i}.org": (50, 2) for i in range(12)}
    pages, outcomes = [], []
    for host, (n, bad) in sites.items():
        for i in range(max(n, 1)):
            pages.append((len(pages), f"http://{host}/{i}", "", ""))
            if n:
                outcomes.append((len(pages) - 1, i < bad))
    outcomes += [(None, True), (10**6, True), (0, None)]
    got = {r.host: r.verdict for r in judged(spark, pages, outcomes, rules=RULES, limit=0.5).collect()}
    blocked = {h for h, v in got.items() if v == "block"}
    assert {"bad.one.org", "a.two.org", "b.two.org"} <= blocked and not blocked & {"ok.one.org", "few.one.org", *(f"s{i}.d{i}.org" for i in range(12))}


def test_suffixes_and_empty_tables(spark):
    table = spark.createDataFrame([("a.b.co.uk", 1, 0), ("co.uk", 1, 1), ("uk", 0, 0), ("", 0, 0), ("x.y.z", 2, 1)], "host string, n long, bad long")
    got = {r.host: (r.domain, r.suffix) for r in reputations(table, 0.3).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "": ("", ""), "x.y.z": ("y.z", "z")}
    assert judged(spark, []).count() == 0
    assert concentration(spark.createDataFrame([], "n long, bad long, parent double")) == 1e6


# -- hard negatives ---------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, score long"


def brute_negatives(rows, every, low=50, high=95):
    sound = []
    for i, e, label, *_ in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            sound.append((i, [math.floor(256 * float(np.float32(x))) for x in e], label))
    order = lambda t: (-t[0], t[1] is None, t[1] if t[1] is not None else 0)
    out = Counter()
    for k, (i, v, label) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m) for k2, (j, w, m) in enumerate(sound) if k2 != k and len(w) == len(v)]
        positives = sorted((s for s in scored if s[2] == label), key=order)[:5]
        for p in positives:
            fit = sorted((s for s in scored if s[2] != label and low * p[0] <= 100 * s[0] <= high * p[0]), key=order)[:3]
            for rank, s in enumerate(fit, 1):
                out[(i, p[1], rank, s[1], p[0], s[0])] += 1
    return out


def cluttered(seed, n=240, dim=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dim))
    rows = []
    for i in range(n):
        v = (centres[i % 4] * r.choice([0.3, 1, 1, 4]) + r.normal(scale=0.4, size=dim)).round(2 if i % 3 else 1).tolist()
        rows.append((i, v, int(r.integers(0, 3)), "x", 1))
    nan = float("nan")
    rows += [(300, [1.0] * dim, None, "", 0), (305, None, 1, "", 0), (310, [nan] + [1.0] * (dim - 1), 1, "", 0), (315, [None] + [1.0] * (dim - 1), 0, "", 0)]
    rows += [(320, [float("inf")] * dim, 0, "", 0), (325, [0.0] * dim, 0, "", 0), (330, [], 0, "", 0), (335, [], 1, "", 0), (340, [1.0, 2.0], 1, "", 0), (342, [1.0, 2.0], 1, "", 0), (343, [0.9, 1.4], 2, "", 0)]
    rows += [rows[10], rows[10], (20, rows[20][1], 2, "", 0), (None, rows[5][1], 1, "", 0), (None, rows[5][1], 1, "", 0)]
    return rows


@pytest.mark.parametrize("seed,values", [(1, 1 << 18), (2, 120), (3, 300)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, values):
    monkeypatch.setattr(negatives, "BUCKET_VALUES", values)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 1 << 14 if seed == 1 else 10)
    rows = cluttered(seed)
    got = Counter(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(3), every=5).collect())
    assert got == brute_negatives(rows, 5)


def test_ties_and_one_common_vector(spark):
    rows = [(i, [1.0, 0.5], i % 2, "", 0) for i in range(60)] + [(100 + i, [0.7, 0.5], i % 2, "", 0) for i in range(30)]
    got = Counter(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, VECTORS), every=10).collect())
    assert got == brute_negatives(rows, 10) and got


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**20 + i), float(3**12 * (i % 7))], i % 2, "", 0) for i in range(40)]
    got = Counter(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, VECTORS), every=10).collect())
    assert got == brute_negatives(rows, 10) and got


def test_no_vectors_or_anchors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives(empty).count() == 0
    assert hard_negatives(spark.createDataFrame([(1, [1.0], 1, "", 0)], VECTORS)).count() == 0


def test_ranges_lose_nothing_and_exclude_much():
    """Every row that reaches theta is a candidate; on clustered vectors few others are."""
    r = np.random.default_rng(6)
    v = np.concatenate([r.normal(size=8) * 400 + r.normal(size=(100, 8)) * 40 for _ in range(10)])
    v = (v / np.linalg.norm(v, axis=1)[:, None] * r.uniform(1000, 1200, (1000, 1))).astype(np.int64)
    length = np.sqrt((v**2).sum(axis=1))
    b = Bucket(np.arange(1000), np.arange(1000), np.zeros(1000, int), length, v)
    score = v @ v.T
    kept = 0
    for share in (0.5, 0.9, 0.97):
        theta = share * length**2
        focus, first, end = b.ranges(v, length, theta)
        for i in range(0, 1000, 7):
            found = set(b.candidates(focus[i], first[i], end[i]).tolist()) if (end[i] - first[i]).min() > 0 else set()
            assert set(np.flatnonzero(score[i] >= theta[i])) <= found
            kept += len(found) * (share == 0.97)
    assert kept / 143 < 250
