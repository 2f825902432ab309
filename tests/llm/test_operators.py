"""Operators against brute force on small tables with nulls, ties, repeated rows, long and empty texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from tspanel.llm import anchors
from tspanel.llm.components import components
from tspanel.llm.decontaminate import contaminated
from tspanel.llm.fm_index import drop_repeated_words
from tspanel.llm.licenses import PHRASES, TEMPLATES, license_scan
from tspanel.llm.lines import drop_boilerplate
from tspanel.llm.minhash import near_duplicates
from tspanel.llm.mixing import mix, spread
from tspanel.llm.quality import quality_rules
from tspanel.llm.suffix_array import drop_repeated_bytes
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, label string"
R = random.Random(3)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(1, 6))) for _ in range(400)]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, n):
    w = text.split(" ")
    for _ in range(n):
        w[R.randrange(len(w))] = R.choice(WORDS) + "X"
    return " ".join(w)


def corpus():
    base, other = prose(120), prose(300)
    texts = [base, base, base + " ", edited(base, 1), edited(base, 2), edited(base, 4), edited(base, 9), base.upper(), other, edited(other, 3)]
    texts += [prose(40) + " " + other[:600] + " " + prose(30), "a " * 200, "a " * 36, "ab " * 90, "", None, "   ", "one two", "one two", "x" * 900, prose(4000)]
    texts += [prose(R.randint(1, 200)) for _ in range(15)] + ["\n".join([prose(6)] * 3 + [base]), "# $ % && <b> |\n\n#\n#"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, base), (None, prose(50)), (5, prose(60))]
    return [(i, t, R.choice(["en", "de", None]), R.choice(["s1", "s2", "s3", None]), 0 if t is None else len(t), "k", "s", "l") for i, t in rows]


ROWS = corpus()
WS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def small(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def capitals(t):
    return "".join(c.upper() if "a" <= c <= "z" else c for c in t)


def cover(seqs, window):
    counts = Counter(s[i : i + window] for s in seqs for i in range(len(s) - window + 1))
    out = []
    for s in seqs:
        m = bytearray(len(s))
        for i in range(len(s) - window + 1):
            if counts[s[i : i + window]] > 1:
                m[i : i + window] = b"\1" * window
        out.append(m)
    return out


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("hot", [1, 64])
def test_words_of_repeated_windows(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_SEGMENTS", hot)
    seqs = [tuple(WS.findall(r[1] or "")) for r in ROWS]
    want = [(r[0], len(s), sum(m), " ".join(w for w, x in zip(s, m) if not x)) for r, s, m in zip(ROWS, seqs, cover(seqs, 35))]
    assert rows(drop_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)
    assert drop_repeated_words(empty).count() == 0


@pytest.mark.parametrize("hot", [1, 64])
def test_bytes_of_repeated_strings(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_SEGMENTS", hot)
    seqs = [(r[1] or "").encode() for r in ROWS]
    want = [
        (r[0], len(s), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(bytes(c for c, x in zip(s, m) if not x)).hexdigest())
        for r, s, m in zip(ROWS, seqs, cover(seqs, 400))
    ]
    got = drop_repeated_bytes(docs).withColumn("sha", F.sha2("kept_bytes", 256))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(want, key=repr)
    assert drop_repeated_bytes(empty).count() == 0


def shingles(t):
    w = WS.findall(small(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, empty):
    sets = [shingles(r[1]) for r in ROWS]
    parent = list(range(len(ROWS)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if a and 100 * k >= 85 * (len(a) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(ROWS):
        least[find(i)] += [r[0]] if r[0] is not None else []
    want = [(r[0], len(s), min(least[find(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(ROWS, sets))]
    got = near_duplicates(docs)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())
    assert near_duplicates(empty).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 199), (199, 198), (300, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 198: 198, 199: 198, 200: 198}


def test_quality_counts_and_verdicts(docs, empty):
    def brute(t):
        w, seen, dup, cov = WS.findall(t), set(), 0, set()
        for line in t.split("\n"):
            dup += bool(WS.search(line)) and line in seen
            seen.add(line)
        n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        for i in range(len(w) - 7):
            if n[tuple(w[i : i + 8])] > 1:
                cov.update(range(i, i + 8))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov), len(w) < 20 or 100 * len(cov) > 30 * len(w)

    got = quality_rules(docs, ["doc_id", "kept"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, "row.doc_id", *names) == sorted(((r[0], *brute(r[1] or "")) for r in ROWS), key=repr)
    assert not [r for r in got.collect() if r.base_failed and r.kept]
    assert quality_rules(empty, ["doc_id"]).count() == 0


def test_contaminated(spark, docs, empty):
    items = [prose(30), prose(20), prose(14), "too short", None, prose(30)]
    rows_ = [(i, t, "x") for i, t in enumerate(items)] + [(0, items[0], "x"), (None, items[1], "x")]
    benchmark = spark.createDataFrame(rows_, "item_id long, text string, start string")
    changed = items[0].split(" ")
    changed[5], changed[17] = "other", "words"
    texts = [(500, prose(20) + " " + capitals(items[0]) + " " + prose(9)), (501, " ".join(changed)), (502, items[1]), (None, items[2]), (503, prose(90)), (504, " ".join(items[5].split(" ")[:12]))]
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0, "k", "s", "l") for i, t in texts], SCHEMA))
    got = rows(contaminated(more, benchmark), "doc_id", "item_id", "start", "matched")
    assert got == sorted([(500, 0, 20, 30), (501, 0, 0, 28), (502, 1, 0, 20), (502, None, 0, 20), (None, 2, 0, 14)], key=repr)
    assert contaminated(empty, benchmark).count() == 0 and contaminated(docs, benchmark.limit(0)).count() == 0


@pytest.mark.parametrize("changed,least", [(0, 1.0), (3, 0.99), (6, 0.95)])
def test_contaminated_finds_substituted_items(spark, changed, least):
    """Recall of 30-word items with up to 20 % of the words replaced, and of brute force over all alignments."""
    r = random.Random(41 + changed)
    items = [prose(30, r) for _ in range(200)]
    texts = []
    for item in items:
        w = item.split(" ")
        for i in r.sample(range(30), changed):
            w[i] = f"other{i}"
        texts.append(prose(r.randint(0, 40), r) + " " + " ".join(w) + " " + prose(r.randint(0, 40), r))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.start, x.matched) for x in contaminated(docs, bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i, item in enumerate(items):
            q = item.split()
            best = max((sum(w[s + j] == q[j] for j in range(30) if 0 <= s + j < len(w)), -s) for s in range(-18, len(w) - 11))
            if best[0] >= 15:
                want[(d, i)] = (-best[1], best[0])
    assert {k: v for k, v in got.items() if k in want} == {k: want[k] for k in got if k in want}
    assert len(got.keys() & want.keys()) >= least * len(want) and len(want) >= 200


def test_contaminated_finds_short_items_whole(spark):
    items = ["One two three", "a b c d e", "one two", "x y z x y z x y", "ties ties ties"]
    texts = ["zero one TWO three four one two three", "a b c d f e a b c d", "x y z x y z x y z x y", "one two", None, "ties ties ties ties", "b a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "start", "matched", "n_places") == sorted(
        [(0, 0, 1, 3, 2), (2, 3, 0, 8, 2), (5, 4, 0, 3, 2), (6, 1, 1, 5, 1)], key=repr
    )


def test_mix_spends_the_budget(docs, empty):
    weights = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {"s1": 0}}
    domain = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b")
    for percent, epochs in ((100, 2), (40, 1), (150, 3), (500, 2)):
        mixed = mix(docs, ["doc_id", "text", "n_chars"], weights, domain, percent=percent, epochs=epochs, seed=1)
        got = mixed.collect()
        total = sum(len(WS.findall(r[1] or "")) for r in ROWS)
        able = sum(r.n_tokens * epochs for r in got if r.source != "s1")
        used = sum(r.used_tokens for r in got)
        assert len(got) == len(ROWS) and used <= min(total * percent // 100, able)
        if percent == 40:
            assert used == total * 40 // 100 and sum(0 < r.prefix_tokens < r.n_tokens for r in got) <= 12
        assert all(r.used_tokens <= epochs * r.n_tokens for r in got) and not any(r.used_tokens for r in got if r.source == "s1")
        out = spread(mixed, ["doc_id", "text", "n_chars"]).collect()
        assert sum(len(WS.findall(r.text)) for r in out) == used
    assert mix(empty, ["doc_id"], weights, domain).count() == 0


def test_shares_go_to_siblings_first(spark):
    table = [(i, prose(n), lang, src, 0, "k", "s", "l") for i, (lang, src, n) in enumerate([("en", "x", 10), ("en", "y", 1000), ("de", "z", 1000)])]
    got = {r.source: r.used_tokens for r in mix(spark.createDataFrame(table, SCHEMA), ["doc_id"], {}, F.lit("d"), percent=50, epochs=1).collect()}
    assert got["x"] == 10 and sum(got.values()) == 1005 and abs(got["x"] + got["y"] - got["z"]) <= 1


@pytest.mark.parametrize("least", [2, 3])
def test_boilerplate_lines(docs, spark, empty, least):
    common = [("menu\nhome\n" if i % 2 else "menu\n\n") + prose(5) for i in range(12)]
    table = ROWS + [(600 + i, t, "en", f"s{i % 4}" if i else None, 0, "k", "s", "l") for i, t in enumerate(common)]
    sites = defaultdict(set)
    for r in table:
        for line in (r[1] or "").split("\n"):
            sites[line] |= {r[3]} - {None}
    want = []
    for r in table:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (WS.search(x) and len(sites[x]) >= least)]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = drop_boilerplate(spark.createDataFrame(table, SCHEMA), "source", least)
    assert rows(got, "doc_id", "n_lines", "n_removed", "kept_text") == sorted(want, key=repr)
    assert drop_boilerplate(empty).count() == 0


def test_license_scan(spark, docs, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    texts = ["CC BY\ncc-by 4.0", "GNU General  Public License; all rights reserved", "accby cc byx", "x\n" + mit, mit.replace("charge", "cost"), mit[:60], "Licensed under the Apache License, Version 2.0."]
    table = ROWS + [(700 + i, t, "en", "s", 0, "k", "s", "l") for i, t in enumerate(texts)]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in table:
        w, at, labels = word.findall(small(r[1])), [], set()
        for p, label in PHRASES.items():
            k = p.split()
            found = [i for i in range(len(w)) if w[i : i + len(k)] == k]
            at += found
            labels |= {label} if found else set()
        want.append((r[0], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = license_scan(spark.createDataFrame(table, SCHEMA))
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    labels = {r.doc_id: (r.labels, r.score) for r in got.filter("doc_id >= 700").collect()}
    assert [labels[i][0] for i in range(700, 707)] == ["cc-by", "gpl,reserved", "", "mit", "mit", "", "apache-2.0"]
    assert labels[703][1] == 1.0 and 0.8 <= labels[704][1] < 1 and labels[705][1] == 0
    assert license_scan(empty).count() == 0


def wrapped(notice, mark, every):
    w = notice.split()
    return "\n".join(mark + " ".join(w[i : i + every]) for i in range(0, len(w), every))


def test_license_blocks_equal_brute_force(spark):
    """Notices over lines, comment marks and empty lines, cut, mixed and damaged, against all blocks."""
    r = random.Random(21)
    notices = list(TEMPLATES) + [" ".join(f"t{r.randrange(60)}" for _ in range(150))]
    templates = dict(TEMPLATES) | {notices[-1]: "long", "mit short form": "mit"}
    texts = [wrapped(n, mark, every) for n in notices for mark, every in (("", 10), ("# ", 7), (" * ", 3), ("// \n", 1))]
    for _ in range(120):
        w = prose(r.randint(0, 90)).split() + [x for x in r.choice(notices).split() if r.random() > r.choice([0, 0.15, 0.3])]
        for _ in range(r.choice([0, 0, 3, 20])):
            w.insert(r.randrange(len(w) + 1), r.choice(["the", "of", "license", "\n#", "x"]))
        texts.append(r.choice([" ", "\n"]).join(w + prose(r.randint(0, 40)).split()))
    texts += ["", None, "the", "word " * 300_000 + notices[0], prose(30) * 3 + "\n".join(notices)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {x.doc_id: (x.labels, x.score) for x in license_scan(docs, templates=templates).collect()}
    word, found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0
    for i, t in enumerate([*texts, texts[0]]):
        w = word.findall(small(t))
        labels, best = {label for p, label in PHRASES.items() if f" {p} " in f" {' '.join(w)} "}, 0.0
        base = bool(labels)
        for notice, label in templates.items():
            want, step = set(notice.split()), 1
            while step < len(notice.split()):
                step *= 2
            share = max((len(want & set(w[k : k + 2 * step])) for k in range(0, len(w), step)), default=0)
            if 100 * share >= 80 * len(want):
                labels.add(label)
                best, found = max(best, share / len(want)), found + 1
        assert got[i] == (",".join(sorted(labels)), 1.0 if base else pytest.approx(best)), (i, t and t[:200])
    assert found > 60
    assert all(got[i][1] == 1.0 for i in range(4 * len(notices)))


def js(p, q):
    """Jensen-Shannon distance, base 2, of two tables of counts."""
    import math

    p, q = ({k: v / (sum(x.values()) or 1) for k, v in x.items()} for x in (p, q))
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    part = lambda a: sum(v * math.log2(v / m[k]) for k, v in a.items() if v)
    return math.sqrt(min(max((part(p) + part(q)) / 2, 0), 1))


@pytest.mark.parametrize("languages", [500, 0])
def test_quality_distances_equal_brute_force(spark, monkeypatch, languages):
    from tspanel.llm import quality

    monkeypatch.setattr(quality, "KEPT_LANGUAGES", languages)
    r = random.Random(11)
    usual = ["und", "die", "The", "house", "river", "Mond"]
    rows = []
    for i in range(60):
        words = r.choices(usual, [30, 20, 10, 5, 3, 2], k=r.randint(5, 120)) + r.choices(["x1", "ÄÖ", "#|$", "Zz."], k=r.randint(0, 90))
        r.shuffle(words)
        rows.append((i, " ".join(words) if i % 9 else None, r.choice(["de", "en", None]), "s", 1, "k", "s", "l"))
    rows += [rows[1], (90, "und die " * 200000, "en", "s", 1, "k", "s", "l"), (91, "7 $ " * 100, "de", "s", 1, "k", "s", "l")]
    limits = quality.Limits(top_words=3, word_min_words=20, class_min_bytes=50)
    classes, words = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang, *_ in rows:
        data = (t or "").encode()
        classes[lang] += Counter(quality._CLASS[list(data)].tolist())
        words[lang] += Counter(WS.findall(small(t)))
    top = {lang: dict(c.most_common(3)) for lang, c in words.items()}
    want = []
    for d, t, lang, *_ in rows:
        data, found = (t or "").encode(), WS.findall(small(t))
        near = lambda c, lang=lang: Counter({**{w: c[w] for w in top[lang]}, "": sum(n for w, n in c.items() if w not in top[lang])})
        c = js(Counter(quality._CLASS[list(data)].tolist()), classes[lang]) if len(data) >= 50 else None
        w = js(near(Counter(found)), near(words[lang])) if len(found) >= 20 else None
        want.append((d, c, w, (c or 0) <= limits.class_distance and (w or 0) <= limits.word_distance))
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = quality_rules(table, ["doc_id", "text"], limits).select("row.doc_id", "row.text", "class_distance", "word_distance", "kept", "base_failed").collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter((x[0], x[1]) for x in rows)
    by_id = {x.doc_id: x for x in got}
    for d, c, w, fine in want:
        x = by_id[d]
        assert x.class_distance == (None if c is None else pytest.approx(c, abs=1e-9))
        assert x.word_distance == (None if w is None else pytest.approx(w, abs=1e-9))
        assert x.kept == (fine and not x.base_failed)
    assert {x.kept for x in got if not x.base_failed} == {True, False} or all(x.base_failed for x in got if not x.kept)
