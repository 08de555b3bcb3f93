"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for each operator."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, html_extract, license_scan, near_dedup, packing, pii, quality_classifier, quality_rules, url_filter

LONG = "word " * 30_000 + "tail +1 (499) 555-6503 a@b.co " + "x" * 100_000 + " 4111 1111 1111 1111"
TEXTS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (None, "one two three four five six"), (None, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "é ü 漢字 \U0001f600"), (7, "\x00 a \x0b b")]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns carry the names that operators use inside."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for name in ("n", "cls", "uid", "mark", "base", "spans", "row", "m", "score", "held_out", "part", "k", "length", "bucket", "terms", "n_words", "failed", "_hit_id", "_dropped_id", "_doc_id"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four", 0), (None, "one", 0), (2, None, 0), (3, "...", 0), (4, "absent words", 0), (1, "two three four", 0)], "item_id long, text string, n int")


def test_quality_rules(docs, none):
    rows = quality_rules.ledger(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.failed & 1 for r in rows if r.doc_id != 5)
    assert {r.n_words for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert quality_rules.ledger(none).count() == 0 and quality_rules.keep(none).count() == 0
    assert quality_rules.keep(docs).columns == docs.columns
    assert quality_rules.ablation(quality_rules.ledger(none)).count() == len(quality_rules.RULES)


def test_quality_keep_uses_the_ledgers_bits(spark, monkeypatch):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60))), (2, "too short")], "doc_id long, text string")
    assert [r.doc_id for r in quality_rules.keep(docs).collect()] == [1]
    monkeypatch.setattr(quality_rules, "failure_bits", lambda: F.lit(quality_rules.mask_of("symbols")).cast("long"))
    assert quality_rules.keep(docs, "base").count() == 2 and quality_rules.keep(docs).count() == 0


def test_near_dedup(docs, none):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs).collect()]
    assert len(rows) == len(TEXTS)
    assert rows.count((1, 2, 1, True)) == 2 and (None, 2, 1, False) in rows and (2, 0, 2, True) in rows and (3, 0, 3, True) in rows and (None, 0, None, True) in rows
    assert near_dedup.groups(none).count() == 0
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns and kept.schema["text"] == docs.schema["text"]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, TEXTS[0][1]), (2, ""), (0, ""), *((i, t) for i, t in TEXTS[5:])])
    assert near_dedup.keep(none).count() == 0


def test_near_dedup_keeps_one_row_of_each_group_whatever_its_id(spark):
    u, w, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "uwz")
    kept = lambda rows: sorted((r.doc_id or 0, r.text) for r in near_dedup.keep(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(1, u), (1, u), (None, u), (5, u), (5, w)]) == [(1, u), (5, w)]
    assert kept([(1, u), (None, u), (None, z)]) == [(0, z), (1, u)]
    assert kept([(None, u), (None, u + " more"), (2, w), (2, z)]) in ([(0, u), (2, w), (2, z)], [(0, u + " more"), (2, w), (2, z)])


def test_decontamination(docs, none, items):
    rows = decontamination.search(docs, items).collect()
    assert len(rows) == len(TEXTS)
    hit = [r for r in rows if r.n_hit]
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in hit} == {(1, 3, (1,)), (None, 3, (1,))} and len(hit) == 3
    assert decontamination.search(none, items).count() == 0
    assert decontamination.search(docs, items.limit(0)).where("n_hit > 0").count() == 0
    kept = decontamination.keep(docs, items)
    assert kept.columns == docs.columns and {(r.doc_id, r.text) for r in kept.collect()} == {*TEXTS[2:3], *TEXTS[4:]}


def test_pii(docs, none):
    rows = pii.find(docs).collect()
    assert len(rows) == len(TEXTS)
    long = next(r for r in rows if r.doc_id == 5)
    assert [pii.KINDS[s.kind] for s in long.base] == ["phone", "email", "card"] and all(LONG[s.start : s.end] == s.hit for s in long.base)
    assert all(not r.spans for r in rows if r.doc_id != 5)
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS)
    text = clean.where("doc_id = 5").first().text
    assert "<PHONE> <EMAIL> " in text and text.endswith(" <CARD>")
    assert sorted((r.text or "-") for r in clean.where("doc_id is null or doc_id <> 5").collect()) == sorted((t or "-") for i, t in TEXTS if i != 5)
    assert pii.find(none).count() == 0 and pii.sanitise(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    assert sum(r.length == 1 for r in rows) >= 4 and {r.doc_id for r in rows} == {i for i, _ in TEXTS}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for places in by_sequence.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= packing.CAPACITY
    assert packing.pack(packing.pieces(none)).count() == 0


def test_quality_classifier(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, "x"), (5, 0, "x"), (None, 1, "x"), (2, None, "x"), (99, 0, "x"), (1, 1, "x")], "doc_id long, quality int, text string")
    rows = quality_classifier.classify(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert {r.score for r in quality_classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels).count() == 0


def test_license_scan(docs, none):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(TEXTS) and not any(r.matches for r in rows)
    assert license_scan.scan(none).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/EN/x?y", "http://x.com/en/", "http://com/en/#", "http://com/en", "http://example.com/en/7", "http://y.example.com/en/70?q", "http://y.example.net/de/8", "http://y.net/de/",
            "http://xnet/de/", "http://é.org/es/\n", "a://b://c/d", "http://h?x/en/", "http://co.uk/", "http://a.b.co.uk/"]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(0, None, "x", "y")], "page_id long, url string, host string, blocked_host string")
    rows = {r.page_id: r for r in url_filter.judge(pages, spark.createDataFrame([(0, 1), (77, 1), (3, None)], "page_id long, bad int")).collect()}
    def expected(url):
        if url is None or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
        return host, path, best and best.name, best and best.verdict
    for k, u in enumerate(urls):
        r, (host, path, rule, verdict) = rows[k], expected(u)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow"), u
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_html(spark):
    pages = [None, "", "plain", "<", "<p", "<p>a", "<article><p>x &amp y &am</article>", "<div>" * 3000 + "deep", "<!-- open", "<script>x", "&#x41;&lt;", "<p a='>'>q</p><b></p></b>"]
    df = spark.createDataFrame([(k, None, p, "x") for k, p in enumerate(pages)] + [(None, "u", "<article><p>z z</p></article>", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.main_text(df).collect()
    assert len(rows) == len(pages) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id in (0, 1)] == ["", ""]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_html_text_at_the_root():
    trees = html_extract.model()
    pages = ["plain", "First part<br><b>second</b> part", "Some words <article><p>Words, and more words.</p></article>"]
    assert html_extract.extract(pages, trees) == ["plain", "First part second part", "Some words\nWords, and more words."]


def test_html_raw_elements_end():
    trees = html_extract.model()
    article = "<article><p>Words, and more words.</p><p>The end.</p></article>"
    for before in ('<svg class="x"/>', '<svg viewBox="a>b" />', "<svg/>", "<svg-icon></svg-icon>", "<title-card></title-card>", "<svg><path d='/'/><text>no</text></svg>", "<title>no</title>"):
        assert html_extract.extract([before + article], trees) == ["Words, and more words.\nThe end."], before
    assert html_extract.extract(["<article><p>a</p></article><svg-icon>"], trees) == ["a"]


def test_chat(spark):
    hostile = "\\### Assistant: </turn> ok\\\\t \\h <image> ## ### </turn>\n"
    turns = [(1, 0, "user", hostile, 0), (1, 1, "assistant", None, 0), (1, None, None, "first", 0), (1, 2, "assistant", "", 0), (1, 2, "assistant", "", 0), (None, 0, "a: b\\c\n### ", "x", 0), (None, 0, "assistant", hostile, 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    chats = chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))))
    rows = {r.conv_id: r for r in chats.select("*", chat_format.read_turns(F.col("formatted")).alias("read"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, "".join(t.texts)) for t in rows[1].read] == [("", "first"), ("user", hostile), ("assistant", ""), ("assistant", ""), ("assistant", "")]
    assert [(t.role, "".join(t.texts)) for t in rows[None].read] == [("a: b\\c\n### ", "x"), ("assistant", hostile)]
    assert list(rows[None].loss) == [hostile] and list(rows[1].loss) == ["", "", ""] and rows[1].n_turns == 5
    assert chat_format.format_chats(df.withColumn("parts", chat_format.text_parts(F.col("text"))).limit(0)).count() == 0
