"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import itertools
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, components, decontamination, dom, html_extract, license_scan, near_dedup, packing, pii, quality_classifier, quality_rules, shingles, url_filter


def write_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def babble(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


# Shingles and near duplicates

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingle_sets():
    rng = random.Random(1)
    texts = [" ".join(babble(rng, n, 6)) for n in (0, 1, 2, 4, 5, 6, 50, 400)] + ["A b\tC\x0bd e f", "a B\nc d E F", "", "É é", "a a a a a a a"]
    found, bounds = shingles.shingle_sets([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(shingle_set(t)) for t in texts]
    names = {}
    for t, a, b in zip(texts, bounds, bounds[1:]):
        for other, c, d in zip(texts, bounds, bounds[1:]):
            assert len(set(found[a:b].tolist()) & set(found[c:d].tolist())) == len(shingle_set(t) & shingle_set(other))
    assert names == {}


def brute_groups(texts):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, j in itertools.combinations(range(len(texts)), 2):
        common_part = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common_part >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def near_copies(rng):
    texts = []
    for _ in range(12):
        base = babble(rng, rng.randrange(3, 150), 5000)
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = babble(rng, 60, 5000)
    texts += [" ".join(babble(rng, 40, 5000) + passage + babble(rng, 40, 5000)) for _ in range(30)]
    return texts


def test_near_dedup_is_brute_force(spark):
    texts = near_copies(random.Random(4))
    found = near_dedup.groups(write_docs(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == brute_groups(texts)


def test_a_chain_of_near_copies_with_many_open_buckets(spark, monkeypatch):
    """Drifting copies: neighbours link, distant ones do not; blocks are made tiny, and most keys are hot."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(common, "LEAST_PART", 3)
    rng = random.Random(6)
    text, texts = babble(rng, 120, 10**6), []
    for _ in range(60):
        for _ in range(rng.choice([1, 2, 3])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    assert [tuple(r) for r in near_dedup.groups(write_docs(spark, texts)).orderBy("doc_id").collect()] == brute_groups(texts)


def test_min_max_estimates_the_overlap():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    a, b = x[:3000], x[1000:]
    low, high = near_dedup.min_max(np.concatenate([a, b]), np.array([0, 3000]))
    agreeing = np.concatenate([low[:, 0] == low[:, 1], high[:, 0] == high[:, 1]]).mean()
    assert abs(agreeing - 0.5) < 0.16
    marks = near_dedup.sketches(low, high)
    assert marks.shape == (2, 64)


@pytest.mark.parametrize("local", [1_000_000, 7])
def test_components(spark, local):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    expected = {x: find(x) for p in links if p[0] != p[1] for x in p}
    found = components.components(spark.createDataFrame(links + [(None, 3)], "u long, v long"), local=local)
    rows = found.collect()
    assert {r.node: r.root for r in rows} == expected and len(rows) == len(expected)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_join_dealt(spark, monkeypatch):
    """Hot keys are dealt to parts without losing or repeating a row."""
    monkeypatch.setattr(common, "LEAST_PART", 10)
    rows = spark.range(500).selectExpr("id", "case when id < 300 then 0 else id % 50 end as k")
    side = spark.range(60).selectExpr("id as k", "id * 2 as v")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how, there in (("inner", side.where("k <> 7")), ("left", side.where("k <> 7"))):
        found = sorted((r.id, r.k, r.v) for r in common.join_dealt(rows, there, ["k"], counts, "id", how).collect())
        expected = [(r.id, r.k, None if r.k == 7 else 2 * r.k) for r in rows.collect() if how == "left" or r.k != 7]
        assert found == sorted(expected, key=lambda x: x[:2])


def test_scratch_tables_go(spark):
    put = common.Scratch()
    a, b = put(spark.range(3)), put(spark.range(4))
    folder = common.shared_dir(spark)[len("file://"):]
    before = set(os.listdir(folder))
    put.end(b)
    gone = before - set(os.listdir(folder))
    assert len(gone) == 1 and b.count() == 4
    near_dedup.groups(write_docs(spark, ["a b c d e f", "a b c d e f g"])).count()
    assert len(set(os.listdir(folder)) - before) <= 2


# Quality

def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_measures():
    rng = random.Random(3)
    texts = ["", "a", "a b c a b c", "a a a a", "é\xa0ü x\ny\n\ny\n y", "\x0c\x0b|<"] + ["".join(rng.choice("ab# \n\t|é") for _ in range(rng.randrange(120))) for _ in range(300)]
    for t in texts:
        assert quality_rules.measure(t)[:5] == brute_measures(t), t


def test_ledger_and_ablation(spark):
    texts = [" ".join(f"w{i}" for i in range(60)), "short", " ".join(["same"] * 80), " ".join(f"W{i}x%%%" for i in range(70)), "A B"]
    rows = quality_rules.ledger(write_docs(spark, texts)).orderBy("doc_id").collect()
    assert [quality_rules.POLICIES["v1"] & r.failed == 0 for r in rows] == [True, False, False, False, False]
    found = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(write_docs(spark, texts))).collect()}
    bits = [r.failed for r in rows]
    for rule in quality_rules.RULES:
        b = 1 << rule.bit
        assert (found[rule.name].n_failed, found[rule.name].n_only, found[rule.name].n_kept_without) == (sum(x & b > 0 for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
    kept = quality_rules.keep(write_docs(spark, texts)).collect()
    assert [r.doc_id for r in kept] == [0]


def test_classifier_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_discriminant_is_the_gaussian_formula():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)), rng.normal(size=(300, 3)) * 2 + 1]
    m = quality_classifier.Discriminant.of([200, 300], np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    q = rng.normal(size=(5, 3))
    logs = []
    for a, n in zip(x, (200, 300)):
        s, mu = np.cov(a.T, bias=True), a.mean(0)
        logs.append([math.log(n / 500) - 0.5 * math.log(np.linalg.det(s)) - 0.5 * (v - mu) @ np.linalg.inv(s) @ (v - mu) for v in q])
    assert np.allclose(m.score(q), 1 / (1 + np.exp(np.array(logs[0]) - np.array(logs[1]))))


def test_classifier_is_brute_force(spark):
    """Features, folds, the aggregate and shrinkage, redone with plain Python and numpy."""
    import zlib

    rng = random.Random(21)
    texts = [" ".join(babble(rng, rng.randrange(5, 90), 60)) + ("!" * rng.randrange(9) if k % 3 else "\nA#b X\n") for k in range(120)] + ["", None]
    quality = {k: int(k % 3 > 0) for k in range(0, 118)}
    labels = spark.createDataFrame(list(quality.items()), "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality_classifier.classify(write_docs(spark, texts), labels).collect()}

    def one(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if not w:
            return [0.0] * 13
        b = (t or "").encode()
        marks = len(re.sub(rb"[\x20\x09-\x0D]", b"", b))
        _, _, symbols, dup, repeat = brute_measures(t)
        lines = [x for x in t.split("\n") if x.strip()]
        count = lambda chars: sum(c in chars for c in b)
        upper, lower = count(range(65, 91)), count(range(97, 123))
        return [math.log1p(len(w)), math.log(marks / len(w)), (symbols / marks) ** 0.5, (upper / max(upper + lower, 1)) ** 0.5, (repeat / len(w)) ** 0.5, (sum(x == y for x, y in zip(w, w[1:])) / len(w)) ** 0.5,
                math.log1p(len(set(w))) / math.log1p(len(w)), (dup / max(len(lines), 1)) ** 0.5, math.log1p(len(w) / max(len(lines), 1)), (count(range(48, 58)) / marks) ** 0.5, (count(b"!,.:;?") / marks) ** 0.5, (count(b"!") / marks) ** 0.5, (count(range(128, 256)) / marks) ** 0.5]

    x = np.array([one(t) for t in texts])
    folds = [zlib.crc32(str(k).encode()) % 5 == 0 for k in range(len(texts))]
    learnt = [[k for k in quality if quality[k] == c and not folds[k]] for c in (0, 1)]
    scatter = [(x[i] - x[i].mean(0)).T @ (x[i] - x[i].mean(0)) for i in learnt]
    n = [len(i) for i in learnt]
    pooled = sum(scatter) / sum(n)
    logs = []
    for i, s, m in zip(learnt, scatter, n):
        sigma = 0.9 * (0.7 * s / m + 0.3 * pooled) + 0.1 * np.diag(np.diag(pooled) + 1e-6)
        off = x - x[i].mean(0)
        logs.append(math.log(m / sum(n)) - 0.5 * np.linalg.slogdet(sigma)[1] - 0.5 * (off * np.linalg.solve(sigma, off.T).T).sum(1))
    expected = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    for k in range(len(texts)):
        assert abs(rows[k].score - expected[k]) < 1e-6 and rows[k].held_out == folds[k] and rows[k].predicted == int(rows[k].score >= 0.3)


# Benchmark windows

def test_decontamination_is_brute_force(spark, monkeypatch):
    """In one block, and with items cut to pieces that are searched in many blocks."""
    rng = random.Random(11)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    item_words = [babble(rng, n, 30) for n in (3, 9, 10, 11, 40, 25)]
    items = [" ".join(w) for w in item_words] + ["", None, "Éa-é!", items_twin := " ".join(item_words[3])]
    texts = []
    for _ in range(60):
        w = babble(rng, rng.randrange(0, 80), 30)
        if rng.random() < 0.6:
            source = rng.choice(item_words)
            a = rng.randrange(len(source))
            cut = source[a : a + rng.randrange(1, 30)]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [x.upper() for x in cut] + w[at:]
        texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    texts += ["x Éa é y", "éa É", None, items_twin * 2]
    found = decontamination.search(write_docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 7)
    blocked = decontamination.search(write_docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_words=20).orderBy("doc_id").collect()
    for r, s, t in zip(found, blocked, texts):
        w, hit, its = split(t), set(), set()
        for k, item in enumerate(items):
            v = split(item)
            windows = {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9))} if v else set()
            for window in windows:
                for i in range(len(w) - len(window) + 1):
                    if tuple(w[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        its.add(k)
        assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(its)) == (s.n_words, s.n_hit, list(s["items"])), t
        assert sorted(hit) == [i for x in r.spans for i in range(x.start, x.end)] and its <= set(r.near)


# Personal data

def brute_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for n, (k, p) in enumerate(patterns.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_patterns_are_brute_force(spark):
    rng = random.Random(5)
    texts = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "0001.2.3.004", "256.1.1.1 99999999999.1.1.1", "+1 (499) 555-6503", "4111 1111 1111 1111", "411111111111111", "é a@b.co \U0001f600 +12345678901", "x@y", "a@-.-", "+1+1+123456789-0", "..@a.b@c.d", "5 4111-1111-1111-1111"]
    texts += ["".join(rng.choice("0123456789" * 2 + "..@@+- ()aé_%") for _ in range(rng.randrange(80))) for _ in range(1500)]
    rows = pii.with_base_spans(write_docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_spans(t), t
        assert all(t[s.start : s.end] == s.hit for s in r.base)


def test_revealing_terms(spark):
    """A nickname that goes with one address is hidden; common words and other documents stay."""
    rng = random.Random(2)
    texts = [f"Write to the zorblat at zed@example.com about {' '.join(babble(rng, 8))} soon" for _ in range(6)]
    texts += [f"Write to them about {' '.join(babble(rng, 9))} soon" for _ in range(60)] + ["A zorblat alone", "Write to other@example.com soon"]
    rows = {r.doc_id: r for r in pii.find(write_docs(spark, texts)).collect()}
    hidden = {(i, s.hit.lower()) for i, r in rows.items() for s in r.spans if pii.KINDS[s.kind] == "term"}
    assert hidden == {(i, "zorblat") for i in range(6)}
    clean = {r.doc_id: r.text for r in pii.sanitise(write_docs(spark, texts)).collect()}
    assert "zorblat" not in clean[0] and "<EMAIL>" in clean[0] and clean[66] == texts[66] and clean[30] == texts[30]


def brute_terms(texts):
    """(document, term start, term end, removed) by counting over all distinct texts."""
    held, words_in = {}, {}
    for t in set(texts):
        words_in[t] = {w.lower() for w in re.findall(r"[^\W\d_]+", t)}
        ents = set()
        for a, k, b in brute_spans(t):
            ents.add((k, t[a:b].lower() if k <= 1 else re.sub("[^0-9]", "", t[a:b])))
        held[t] = ents
    near = [t for t in held if held[t]]
    named = {w.lower() for t in near for w in re.findall(r"[^\W\d_]+", t) if w[0].isupper() or w[0].lower() == w[0].upper()}
    out = set()
    for t in near:
        covered = {i for a, _, b in brute_spans(t) for i in range(a, b)}
        hidden = {}
        for e in held[t]:
            of = [x for x in near if e in held[x]]
            prior = len(of) / len(held)
            for w in words_in[t]:
                if len(w) < pii.TERM_LETTERS and w not in named:
                    continue
                n = sum(w in x for x in words_in.values())
                given = (sum(w in words_in[x] for x in of) + prior * pii.PSEUDO) / (n + pii.PSEUDO)
                share = 1 + math.log2(given) / -math.log2(prior) if prior < 1 else 0
                if share >= pii.GENERALISE and given >= pii.LEAST_GIVEN_TERM:
                    hidden[w] = hidden.get(w, False) or share >= pii.REMOVE
        for i, x in enumerate(texts):
            if x == t:
                masked = "".join("0" if k in covered else c for k, c in enumerate(t))
                out |= {(i, m.start(), m.end(), hidden[m[0].lower()]) for m in re.finditer(r"[^\W\d_]+", masked) if m[0].lower() in hidden}
    return out


def test_terms_are_brute_force(spark):
    rng = random.Random(12)
    people = [("Kim", "kim@a.org"), ("Zorblat", "+1 499 555 6503"), ("Ona Petal", "10.2.3.4"), ("\u6f22\u5b57", "k.k@b.com")]
    texts = []
    for _ in range(150):
        w = [rng.choice(["Plain", "words", "of", "any", "kind", "go", "here", "too"]) for _ in range(rng.randrange(4, 14))]
        for name, value in rng.sample(people, rng.choice([0, 0, 0, 1, 1, 2])):
            w.insert(rng.randrange(len(w) + 1), value)
            if rng.random() < 0.9:
                w.insert(rng.randrange(len(w) + 1), rng.choice([name, name.lower()]))
        if rng.random() < 0.1:
            w.append(f"unique{'abcdefghij'[rng.randrange(10)]}")
        texts.append(" ".join(w))
    texts += texts[:20]
    docs = write_docs(spark, texts)
    found = {(r.doc_id, s.start, s.end) for r in pii.find(docs).collect() for s in r.spans if pii.KINDS[s.kind] == "term"}
    expected = brute_terms(texts)
    assert found == {x[:3] for x in expected} and len(found) > 10
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    for i, t in enumerate(texts):
        spans = sorted([(a, b, pii.PLACEHOLDERS[pii.KINDS[k]]) for a, k, b in brute_spans(t)] + [(a, b, "" if gone else pii.PLACEHOLDERS["name" if t[a].isupper() else "word"]) for k, a, b, gone in expected if k == i])
        out, at = [], 0
        for a, b, label in spans:
            if a >= at:
                out += [t[at:a], label]
            at = max(at, b)
        assert clean[i] == "".join(out) + t[at:], t


def test_dense_texts_take_no_more_than_their_length(spark):
    """Places and rewriting stay linear: a megabyte of matches, of failing matches, and of words to look up."""
    rng = random.Random(13)
    words = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(20_000))
    texts = ["1.1.1.1 " * 60_000, "a@" * 300_000, "1" * 500_000, "+1 " * 100_000, f"zed@example.com {words}"] + [f"Some text {k}x{chr(97 + k % 26)} here" for k in range(150)]
    rows = {r.doc_id: r for r in pii.sanitise(write_docs(spark, texts)).where("doc_id < 5").collect()}
    assert rows[0].text == "<IP> " * 60_000 and [rows[k].text == texts[k] for k in (1, 2, 3)] == [True] * 3
    assert rows[4].text.startswith("<EMAIL> ") and len(rows[4].text) < len(texts[4])


def test_a_term_far_from_its_entity_is_hidden(spark):
    rng = random.Random(3)
    texts = [f"Write to the zorblat at zed@example.com about {' '.join(babble(rng, 8))} soon" for _ in range(6)]
    texts += [f"Zorblat again {' '.join(babble(rng, 60))} at zed@example.com"] + [f"Write to them about {' '.join(babble(rng, 9))} soon" for _ in range(60)]
    rows = {r.doc_id: r for r in pii.find(write_docs(spark, texts)).collect()}
    assert "Zorblat" in [s.hit for s in rows[6].spans if pii.KINDS[s.kind] == "term"]
    assert "orblat" not in next(r.text for r in pii.sanitise(write_docs(spark, texts)).collect() if r.doc_id == 6)


def test_copies_do_not_hide_a_link(spark):
    rng = random.Random(4)
    texts = [f"Write to the zorblat at zed@example.com about {' '.join(babble(rng, 8))} soon" for _ in range(3)]
    texts += [f"Write to them about {' '.join(babble(rng, 9))} soon" for _ in range(60)] + texts[:1] * 100
    rows = pii.find(write_docs(spark, texts)).collect()
    assert {r.doc_id for r in rows if any(s.hit == "zorblat" for s in r.spans)} == {0, 1, 2, *range(63, 163)}


def test_rare_entities_and_short_names(spark):
    """One text is enough for an entity and its term, wherever the term stands; short names count, short words don't."""
    rng = random.Random(8)
    texts = [f"Write to Kim Lee about {' '.join(babble(rng, 60))} or the zorblat at zed@example.com soon", "Write to 漢字 at +12345678901 soon", "Write to them soon"]
    texts += [f"Write to them about {' '.join(babble(rng, 9))} soon" for _ in range(200)]
    rows = {r.doc_id: r for r in pii.find(write_docs(spark, texts)).collect()}
    hidden = {(i, s.hit) for i, r in rows.items() for s in r.spans if pii.KINDS[s.kind] == "term"}
    assert hidden == {(0, "Kim"), (0, "Lee"), (0, "zorblat"), (1, "漢字")}


# Chat

def test_typed_parts(spark):
    part = lambda kind, **kw: (kind, kw.get("text"), kw.get("ref"), kw.get("width"), kw.get("height"), kw.get("seconds"), kw.get("pages"))
    turns = [(1, 0, "user", [part("text", text="see <image> "), part("image", ref="a.png", width=57, height=28), part("text", text="and"), part("document", ref="b.pdf", pages=3)]),
             (1, 1, "assistant", [part("audio", ref="c.wav", seconds=2.5), part("text", text="ok"), part("image", ref="d.png"), part("odd", text="gone")]), (2, 0, "user", None)]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    rows = {r.conv_id: r for r in chat_format.format_chats(df).withColumn("read", chat_format.read_turns(F.col("formatted"))).collect()}
    assert rows[1].formatted == "### user: see \\i <image>and<document></turn>\n### assistant: <audio>ok<image></turn>\n"
    assert [(a.kind, a.ref, a.tokens) for a in rows[1].attachments] == [("image", "a.png", 3), ("document", "b.pdf", 3072), ("audio", "c.wav", 63), ("image", "d.png", 256)]
    assert rows[1].expanded_tokens == 3 + 3072 + 63 + 256
    assert [(t.role, list(t.texts), list(t.kinds)) for t in rows[1].read] == [("user", ["see <image> ", "and", ""], ["image", "document"]), ("assistant", ["", "ok", ""], ["audio", "image"])]
    assert rows[2].formatted == "### user: </turn>\n"


def test_escapes_round_trip(spark):
    rng = random.Random(7)
    bits = ["\\", "###", "#", "</turn>", "<image>", "\\h", "\\t", "t", "h", "\n", ": ", "é", "<", "/turn>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = write_docs(spark, texts).withColumn("e", chat_format.escape(F.col("text")))
    for r in df.withColumn("back", chat_format.unescape(F.col("e"))).collect():
        assert r.back == r.text and "###" not in r.e and "</turn>" not in r.e and "<image>" not in r.e


# Packing

def test_tokens_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(9)
    alphabet = ["a", "'", "s", "'ll", "é", "ß", "İ", "Σ", "漢", "１", "²", "½", "9", " ", "\xa0", "\x85", "\n", "!!", "_", "<|endoftext|>", "<|", "ǅ", "e\u0301", "\x1c", "Word", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(800)] + ["plain words, and more words' s"]
    tokens, whole = packing.WordTokens(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    for _ in range(2):
        for t, found in zip(texts, tokens.encode(texts)):
            assert np.frombuffer(found, dtype="<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("counts", [{4096: 3, 2048: 5, 1365: 7}, {1: 5000}, {3000: 40, 1096: 40}, {2100: 9, 1900: 9, 50: 100}, {900: 100_000}, {n: 1 + n % 7 for n in range(1, 4097, 13)}, {}])
def test_plans(counts):
    histogram = np.zeros(4097, dtype=np.int64)
    for n, k in counts.items():
        histogram[n] = k
    plan = packing.plan_of(histogram)
    placed = np.zeros(4097, dtype=np.int64)
    for config, n in plan:
        assert sum(a * b for a, b in config) <= 4096 and n > 0
        for a, b in config:
            placed[a] += n * b
    assert (placed == histogram).all()
    total = sum(n for _, n in plan)
    least = -(-sum(n * k for n, k in counts.items()) // 4096)
    bound = max(least, sum(k for n, k in counts.items() if n > 2048), sum(-(-k // (4096 // n)) for n, k in counts.items()) if len(counts) == 1 else 0)
    assert total <= bound * 1.02 + 1


def test_best_fit_covers_everything():
    rng = np.random.default_rng(3)
    for _ in range(30):
        histogram = np.bincount(rng.integers(1, 101, rng.integers(1, 300)), minlength=101)
        placed = np.zeros(101, dtype=np.int64)
        for config, n in packing.best_fit(histogram, 100):
            assert sum(a * b for a, b in config) <= 100
            for a, b in config:
                placed[a] += n * b
        assert (placed == histogram).all()


# Pages

def test_reputation_blocks_only_what_is_surely_bad(spark):
    hosts = [("bad.example.com", 40, 38), ("fine.example.com", 400, 30), ("few.example.com", 2, 2), ("other.org", 300, 20), ("none.net", 0, 0)]
    rows, k = [], 0
    for host, n, bad in hosts:
        for i in range(max(n, 1)):
            rows.append((k, f"http://{host}/x", None if n == 0 else int(i < bad)))
            k += 1
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    found = {r.host: r.verdict for r in url_filter.judge(df.select("page_id", "url"), df.select("page_id", "bad")).select("host", "verdict").distinct().collect()}
    assert found == {"bad.example.com": "block", "fine.example.com": "allow", "few.example.com": "allow", "other.org": "allow", "none.net": "allow"}


def test_many_rules_meet_hosts_in_a_join(spark):
    rng = random.Random(31)
    label = lambda: rng.choice(["a", "b", "com", "net", "x"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "e", "en", "7"]) for _ in range(rng.randrange(3)))
    rules = [url_filter.Rule(v, h, p) for (h, p), v in {(host(), path()): rng.choice(["block", "allow"]) for _ in range(60)}.items()]
    rows = spark.createDataFrame([(k, host() if k % 20 else "", path()) for k in range(400)], "page_id long, host string, path string")
    few, many = (sorted(map(tuple, url_filter.with_rule(rows, rules, common.Scratch(), most).select("page_id", "rule", "ruled").collect())) for most in (500, 5))
    assert [(k, bool(r)) for k, r, _ in few] == [(k, bool(r)) for k, r, _ in many] and sum(r is not None for _, r, _ in few) > 50
    size = {r.name: len(r.name) for r in rules}
    assert all(a == b or size[a[1]] == size[b[1]] for a, b in zip(few, many))


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.example.com": "example.com", "me.github.io": "me.github.io", "github.io": "github.io", "x.me.github.io": "me.github.io", "localhost": "localhost", "a.b.ne.jp": "b.ne.jp"}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", F.expr(url_filter.domain_sql("host")).alias("d")).collect()
    assert {r.host: r.d for r in rows} == hosts


def test_lower_bound_is_near_the_beta_quantile(spark):
    rng = np.random.default_rng(1)
    for a, b in ((3.0, 9.0), (40.0, 5.0), (0.7, 2.0), (500.0, 900.0)):
        logit = spark.sql(f"SELECT {url_filter.lower_bound_sql(f'{a}D', f'{b}D')} AS x").first().x
        draws = rng.beta(a, b, 200_000)
        assert abs((draws < 1 / (1 + math.exp(-logit))).mean() - 0.05) < 0.035


def test_extraction_on_generated_pages():
    maker = html_extract._Maker(np.random.default_rng(77))
    right = wrong = missed = 0
    for _ in range(120):
        page = maker.page()
        marked, nodes = dom.parse(page), dom.parse(page.replace(maker.MARK, ""))
        kept = html_extract.decode(html_extract.model().margin(html_extract.features(nodes)), nodes.parent, np.array(nodes.end))
        for (_, t), (k, u) in zip(marked.segments, nodes.segments):
            if u and u.strip():
                right += maker.MARK in t and kept[k]
                wrong += maker.MARK not in t and kept[k]
                missed += maker.MARK in t and not kept[k]
    assert right / (right + wrong) > 0.96 and right / (right + missed) > 0.95


def test_decoding_has_no_contradictions_and_is_the_best():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = 9
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        children = {i: [j for j in range(n) if parent[j] == i] for i in range(n)}
        order = []
        def walk(i):
            order.append(i)
            for j in children[i]:
                walk(j)
        walk(0)
        place = {x: k for k, x in enumerate(order)}
        up = [-1] + [place[parent[x]] for x in order[1:]]
        end = np.arange(1, n + 1)
        for i in range(n - 1, 0, -1):
            end[up[i]] = max(end[up[i]], end[i])
        margin = rng.normal(size=n) * 2
        score = lambda keep: sum(-math.log1p(math.exp(-m)) if k else -math.log1p(math.exp(m)) for k, m in zip(keep, margin))
        best = max((k for k in itertools.product([False, True], repeat=n) if k[0] and all(not k[i] or k[up[i]] for i in range(1, n))), key=score)
        assert html_extract.decode(margin, up, end) == list(best)


def test_real_pages_give_their_articles():
    import html

    import duckdb

    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for page, text in zip(pages, html_extract.extract(pages, html_extract.model())):
        body = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert text == "\n".join(p for p in parts if p)


def test_blocks_and_broken_markup():
    page = "<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><p>f<b>g</b>h<br>i<div>j</p>k<script>no</script><!-- no --><STYLE>no</STYLE>&eacute;&#8364;&nbsp;z"
    nodes = dom.parse(page)
    assert dom.blocks(nodes.segments) == "a\nb\nc\nd\ne\nfgh i\njk\u00e9\u20ac z"
    assert all(nodes.parent[i] < i < nodes.end[i] <= len(nodes.tag) for i in range(1, len(nodes.tag)))


def test_odd_quotes_are_markup():
    text = lambda page: html_extract.extract([page], html_extract.model())[0]
    for page in ("<article><p title=it's>hello</p></article>", "<article><p title=it's class='a'>hello</p></article>", '<article><p title="a>b" id = \'c>d\'>hello</p></article>', '<article><p title="x>hello</p></article>', "<article><p a==b\"c>hello</p></article>"):
        assert text(page) == "hello", page
    for page, words in (('<a href="x>b', "b"), ("a < b and <3", "a < b and <3"), ("words <b class=x", "words"), ("<p<p>a", "a")):
        assert dom.blocks(dom.parse(page).segments) == words


def test_parsing_takes_no_more_than_the_pages_length():
    import time

    began = time.time()
    for page in ("<p" * 300_000, "<" + "a" * 500_000, "<div>" * 60_000 + "</x>" * 60_000, "<p><button>" + "<div>" * 60_000, "<ul><li><b>" * 30_000, "<a b='" * 100_000, "<a =" + "= " * 300_000, "<!--" * 200_000, "</p " * 100_000):
        dom.parse(page)
    for text in ("All rights reserved.\n" * 20_000, "permission is hereby\n" * 20_000, "copyright 2020 a\n" * 20_000, "license" + "." * 500_000):
        license_scan.scan_text(text)
    assert time.time() - began < 30


# Licences

def test_licences():
    found = lambda t: [(n, t[a:b]) for n, a, b in license_scan.scan_text(t)]
    for text, licence in (("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
                          ("Released under the MIT License.", "MIT"), ("All rights reserved.", "all-rights-reserved"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-CLAUSE"), ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1")):
        assert found(text) == [(licence, text)]
        if text.endswith("."):
            assert found(f"Some words. Ünd more\n  {text}\nAnd an end. {text} Fin.") == [(licence, text)] * 2
    assert found("We talked about the MIT License. Nothing is released under the MIT license here.") == [] == found("") == license_scan.scan_text(None)
    whole = "Copyright (c) 2020 Someone. All rights reserved.\nLicensed under the Apache License, Version 2.0 (the license).\n"
    assert [n for n, _ in found(whole)] == ["all-rights-reserved"]
    mit = ". ".join(license_scan.SENTENCES[k] for k in ("mit-grant", "mit-notice")) + ". One more. " + license_scan.SENTENCES["mit-as-is"] + "."
    assert found(mit) == [("MIT", mit)]
    far = license_scan.SENTENCES["mit-grant"] + ". a. b. c. d. " + license_scan.SENTENCES["mit-notice"] + "."
    assert found(far) == []


def test_wrapped_licences():
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0."""
    bsd3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    lgpl = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    cc = """This work is licensed under a Creative Commons
Attribution-ShareAlike 4.0 International License."""
    whole = {"Apache-2.0": apache, "MIT": mit, "GPL-3.0-or-later": gpl, "GPL-2.0-or-later": gpl.replace("version 3", "version 2"), "BSD": bsd, "BSD-3-Clause": bsd3, "ISC": isc, "LGPL-2.1-or-later": lgpl, "MPL-2.0": mpl, "CC-BY-SA-4.0": cc, "CC-BY-4.0": "Creative Commons Attribution 4.0"}
    for name, text in whole.items():
        for mark in ("", " * ", "// ", "# ", "REM "):
            marked = "\n".join(mark + line for line in ["Some words first", "", *text.split("\n"), "", "Words after"])
            found = license_scan.scan_text(marked)
            assert [n for n, _, _ in found] == [name], (name, mark)
            assert marked[found[0][1] : found[0][2]] == ("\n" + mark).join(text.split("\n")), (name, mark)


def test_licences_of_documents(spark):
    """Every planted line is found, and nothing else."""
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "all-rights-reserved"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in license_scan.scan(docs).collect():
        t = texts[r.doc_id]
        planted = sorted((t.find(x), n) for x, n in lines.items() if x in t)
        found = [(m.start, m.licence) for m in r.matches]
        every = sorted((k.start(), n) for x, n in lines.items() for k in re.finditer(rf"(?:(?<=[.!?;]\s)|(?<=\n)|\A){re.escape(x)}(?=\s|\Z)", t or ""))
        assert found == every and {n for _, n in planted} == {n for _, n in found}, t


# The shared folder

def test_written_tables_use_the_sessions_folder(spark):
    df, path = common.written(spark.range(5))
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5
    common.drop_path(spark, path)
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
