"""Every operator on the awkward table: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import gc
import hashlib
import weakref

import pytest
from pyspark.sql import functions as F

from cuebook.llm import decontaminate, exact_dedup, license_scan, line_runs, odd_sketch, packing, quality, text_density, token_counts, url_reputation

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
LONG = "One two three four five six seven eight nine ten eleven.\n" * 4000
ROWS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, None), (3, ""), (4, " \n\t "), (5, "one"),
        (6, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
        (8, LONG), (9, LONG), (10, "é à 中文 <|endoftext|> <s> \x00 end"), (11, "x" * 300_000), (12, "under the MIT License and the Apache License, Version 2.0, CC BY-NC 4.0")]
# Names that the operators use inside.
EXTRA = "id long, t string, key string, digest string, score double, rep long, n long, label string, root long, part int, kept boolean, w string"
SCHEMA = f"doc_id long, text string, {EXTRA}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "t", "k", None, 0.5, 1, 2, "l", None, 3, False, "w") for i, t in ROWS]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [*ROWS, ROWS[0]]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_token_counts(docs, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in texts()]
    assert rows_of(token_counts.count_tokens(docs, path)) == sorted(want, key=repr)
    assert token_counts.count_tokens(none, path).collect() == []


def test_token_counts_json(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in texts()}


def test_packing_round_trip(docs, none):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, group_docs=5).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in ROWS}
    covered = {i: [] for i in ids}
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start:p.start + p.length], dtype="<u4")
        assert p.length > 0 and zlib.crc32(own.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        covered[p.doc_id] += range(p.start, p.start + p.length)
    for i, c in covered.items():
        assert sorted(c) == sorted([*range(len(ids[i]))] * (2 if i == 1 else 1))
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(none, path).collect() == []


def test_packing_goes_to_the_cheapest(spark):
    import numpy as np

    lengths = np.array([900, 600, 500, 400, 300, 200, 100])
    placed = packing.balance(lengths, 1024, 1.0, 1 / 1024)
    assert sum(p[2] for p in placed) == lengths.sum()
    assert [p[3] for p in placed[:2]] == [0, 1]  # the first two open a sequence each
    assert list(packing.open_sequences(3000, 1024)) == [1024, 1024, 512, 256, 128, 32, 16, 8]


def test_line_runs(docs, none):
    got = rows_of(line_runs.delete_runs(docs))
    want = brute.line_runs(ROWS)
    assert got == sorted([*want, want[0]], key=repr)
    assert line_runs.delete_runs(none).collect() == []


@pytest.mark.parametrize("run", [1, 2, 3, 4, 5])
def test_line_runs_of_any_length(spark, run):
    rows = [(1, "a\nb\nc\nd\n"), (2, "x\na\nb\nc\n\nd"), (3, None), (4, ""), (5, "a\na\na\na\na"), (6, "b\nc\nd\n e\nb\nc\nd"), (7, "\n\n\n"),
            (8, "word " * 40 + "\nz"), (9, "y\n" + "word " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(line_runs.delete_runs(df, run)) == sorted(brute.line_runs(rows, run), key=repr)


@pytest.mark.parametrize(("run", "least"), [(3, 50), (3, 51), (4, 50), (5, 70), (2, 50)])
def test_line_runs_of_many_words(spark, run, least):
    """Fewer than ``run`` lines are a run if they have ``least`` words together."""
    a, b, c, d = (f"{x} " * n for x, n in (("a", 25), ("b", 25), ("c", 20), ("d", 3)))
    rows = [(1, f"{a}\n{b}\n{c}\n{d}"), (2, f"{a}\n\n{b}\nz"), (3, f"y\n{b}\n{c}\n{d}"), (4, f"{c}\n{a}\n{b}\n{c}\nx"), (5, f"{b}\n{a}"),
            (6, f"{b}\n{a}\n{b}\n{a}"), (7, f"{d}\n{d}\n{d}"), (8, None), (9, "e " * 40), (10, "e " * 40 + "\nw")]
    seen, want = set(), []
    for i, t in rows:
        lines = (t or "").split("\n")
        full, gone = [n for n, x in enumerate(lines) if x.strip()], set()
        for p, _ in enumerate(full):
            for k in range(1, run + 1):
                w = full[p:p + k]
                words = sum(len(lines[n].split()) for n in w)
                if len(w) == k and (k == run or words >= (30 if k == 1 else least)):
                    key = (k, *[lines[n] for n in w])
                    gone.update(w if key in seen else [])
                    seen.add(key)
        want.append((i, len(lines), len(gone), "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    got = line_runs.delete_runs(spark.createDataFrame(rows, "doc_id long, text string"), run, run_words=least)
    assert rows_of(got) == sorted(want, key=repr)
    if (run, least) == (3, 50):
        assert dict((r[0], r[3]) for r in want)[2] == "\nz"


def exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted(((i, max(groups[t or ""]), len(groups[t or ""]), max(groups[t or ""]) == i, hashlib.sha256((t or "").encode()).hexdigest())
                   for i, t in rows), key=repr)


def test_exact_duplicates(docs, none):
    assert rows_of(exact_dedup.exact_duplicates(docs)) == exact(texts())
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_exact_duplicates_over_many_batches(docs):
    """State is kept between micro-batches; the split of the input does not matter."""
    assert rows_of(exact_dedup.exact_duplicates(docs.repartition(6), batch=1)) == exact(texts())


def test_exact_duplicates_take_several_batches_by_default(spark, docs, tmp_path):
    """The stream looks state up in later batches at any size, not only in this test."""
    before = exact_dedup.fresh_folder
    exact_dedup.fresh_folder = lambda _spark, name: str(tmp_path / name)
    try:
        exact_dedup.states(docs.repartition(6), "doc_id", "text")
    finally:
        exact_dedup.fresh_folder = before
    assert len(list((tmp_path / "dedup" / "changed").glob("batch=*"))) >= 3


def test_exact_duplicates_when_digests_collide(docs):
    got = exact_dedup.exact_duplicates(docs, digest=lambda t: F.length(t).cast("string"))
    assert rows_of(got.drop("text_sha256")) == sorted((r[:4] for r in exact(texts())), key=repr)


def test_exact_duplicates_keep_last(docs):
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 9, 10, 11, 12]


@pytest.mark.parametrize("block_docs", [512, 2])
def test_near_duplicates(docs, none, block_docs):
    want = brute.near(ROWS)
    assert rows_of(odd_sketch.near_duplicates(docs, block_docs=block_docs)) == sorted([*want, want[0]], key=repr)
    assert odd_sketch.near_duplicates(none).collect() == []


def test_near_duplicates_null_id(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert rows_of(odd_sketch.near_duplicates(df)) == sorted([(None, 3, None, True), (None, 3, None, True), (1, 3, 1, True)], key=repr)


def test_license_scan(docs, none):
    got = rows_of(license_scan.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    assert got == sorted(((i, *brute.phrase_places(t, license_scan.PHRASES)) for i, t in texts()), key=repr)
    assert license_scan.scan(none).collect() == []


def test_license_notice_with_edits(spark):
    notice = license_scan.NOTICES[0][1]
    edited = notice.replace("without restriction", "with hardly any restriction")
    short = " ".join(notice.split()[:8])
    rows = [(1, "intro words. " + edited.upper() + "."), (2, notice), (3, short), (4, "under the MIT license " * 3), (5, "under the \u212aIT license")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[2].score == 1.0 and 0.8 <= got[1].score < 1.0
    assert got[3].labels == "" and got[3].score < 0.8
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (3, 0, 8)
    assert got[5].labels == "" and got[5].n_base == 0


def test_contamination(docs, none, spark):
    items = [(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "two three"), (3, ""), (4, None), (None, "alpha beta"), (5, "two three"),
             (6, " ".join(f"word{i}" for i in range(30)))]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    for size in (1 << 20, 20):
        assert rows_of(decontaminate.contamination(docs, bench, block_bytes=size)) == sorted(brute.contamination(texts(), items), key=repr)
    assert decontaminate.contamination(none, bench).collect() == []
    empty = bench.limit(0)
    assert {r.contaminated for r in decontaminate.contamination(docs, empty).collect()} == {False}
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 10, 11, 12]


def test_longest_match(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:25]) + " z " + " ".join(words[:10])), (2, " ".join(words[:9]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert rows_of(decontaminate.verbatim_matches(docs, bench)) == [(1, "7", 0, 23, 10), (1, "7", 5, 2, 20)]


def test_benchmark_blocks_pass_one_at_a_time(spark, monkeypatch):
    """The driver lets a block's set go before it builds the next."""
    items = [(k, " ".join(f"w{k}x{i}" for i in range(12))) for k in range(6)]
    docs = spark.createDataFrame([(1, f"a {items[1][1]} b {items[4][1]}"), (2, items[5][1][:20])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = rows_of(decontaminate.contamination(docs, bench)), rows_of(decontaminate.verbatim_matches(docs, bench))
    sets, most, build = weakref.WeakSet(), [], decontaminate.TestSet.__init__

    def watched(self, given, window):
        gc.collect()
        most.append(len(sets))
        if given:
            sets.add(self)
        build(self, given, window)

    monkeypatch.setattr(decontaminate.TestSet, "__init__", watched)
    cut = rows_of(decontaminate.contamination(docs, bench, block_bytes=100)), rows_of(decontaminate.verbatim_matches(docs, bench, block_bytes=100))
    assert cut == once and len(most) > 2 and max(most) == 0


def test_quality(spark, docs, none):
    good = [(i, f"the quick fox number {i} walks over a calm hill and sings a song {i % 7}", 1) for i in range(200)]
    bad = [(i, f"BUY!!! $$$ CHEAP*** PILLS### NOW {i}!!! " * 5, 0) for i in range(200, 400)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").unionAll(spark.createDataFrame([(None, 1), (5, None), (7, 1), (99999, 0)], "doc_id long, quality int"))
    model = quality.fit(table.drop("quality"), labels)
    got = quality.score(table, model).join(table.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.predicted == r.quality for r in got) and {r.held_out for r in got} == {True, False}
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(texts()) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(none, model).collect() == []
    assert quality.keep_good(table, model).count() == 200 and quality.keep_good(docs, model).columns == docs.columns
    flat = quality.fit(table, labels.limit(0))
    assert {r.score for r in quality.score(docs, flat).collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark):
    table = spark.createDataFrame([(i, f"word{i % 5} text") for i in range(60)], "doc_id long, text string")
    fold = table.select("doc_id", quality.held_out(F.col("doc_id")).alias("h"))
    labels = fold.select("doc_id", F.when(F.col("h"), 0).otherwise(1).alias("quality"))  # zeros only where held out
    assert quality.fit(table, labels).bias > 0


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
URLS = [(1, "https://A.Example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (4, "http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        (5, "http://org", "org", "", None, None), (6, None, "", "", None, None), (7, "no scheme", "", "", None, None), (8, "", "", "", None, None),
        (9, "http://h.net?q=/a", "h.net", "", None, None), (10, "http://h.net#/a", "h.net", "", None, None), (11, "a://b://c/d", "b:", "//c/d", None, None),
        (12, "http://COM/de/x", "com", "/de/x", "com/de/", "block"), (13, "http://É.org/", "É.org", "/", "org/", "allow")]


def test_packing_spreads_equal_rows(spark):
    """3,000 equal rows, groups of 500: no group gathers them; each row is still packed once."""
    import public_tokenizers

    docs = spark.createDataFrame([(7, "the same words again")] * 3000 + [(i, f"text {i}") for i in range(100, 200)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), group_docs=500)
    own = pieces.filter("doc_id = 7")
    assert own.agg(F.sum("length")).first()[0] == 3000 * own.first().doc_tokens
    by_group = [r["count"] for r in pieces.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert max(by_group) < 900 and len(by_group) == 7


def test_url_rules(spark):
    pages = spark.createDataFrame([(*u[:2], "h", "r") for u in [*URLS, URLS[0]]], "page_id long, url string, host string, rule string")
    outcomes = spark.createDataFrame([], "url string, bad int")
    got = {r.page_id: r for r in url_reputation.judge(pages, outcomes, RULES).collect()}
    for i, _, host, path, rule, verdict in URLS:
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or "allow")
    assert url_reputation.judge(pages, outcomes, RULES).count() == len(URLS) + 1
    assert url_reputation.judge(pages.limit(0), outcomes, RULES).collect() == []


def test_url_reputation_shrinks(spark):
    rows = [("http://bad.one.net/1", 1)] * 60 + [("http://good.one.net/1", 0)] * 60 + [("http://few.one.net/1", 1)] + [("http://ok.two.net/1", 0)] * 50 + [(None, 1), ("http://ok.two.net/", None)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.one.net", "good.one.net", "few.one.net", "new.one.net", "ok.two.net", "x.zz"])], "page_id long, url string")
    got = {r.host: r for r in url_reputation.judge(pages, outcomes, []).collect()}
    assert got["bad.one.net"].verdict == "block" and got["good.one.net"].verdict == "allow"
    assert got["good.one.net"].bad_mean < got["few.one.net"].bad_mean < got["bad.one.net"].bad_mean
    assert got["few.one.net"].bad_bound < got["bad.one.net"].bad_bound  # one outcome says little
    assert got["new.one.net"].bad_mean != got["x.zz"].bad_mean  # the domain's, the overall one
    kept = url_reputation.allowed(pages, outcomes, [])
    assert kept.columns == pages.columns and "http://bad.one.net/" not in [r.url for r in kept.collect()]


def test_url_sites_suffixes_and_domains(spark):
    """Two registrations under one public suffix have nothing in common but the suffix."""
    hosts = {"u:p@a.co.uk:8080": ("a.co.uk", "a.co.uk", "co.uk"), "x.y.a.co.uk.": ("x.y.a.co.uk", "a.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"),
             "uk": ("uk", "uk", "uk"), "www.b.net": ("www.b.net", "b.net", "net"), "10.0.0.1:80": ("10.0.0.1",) * 3, "[::1]:80": ("[::1]",) * 3,
             "": ("", "", ""), "..": ("", "", ""), "a.b.city.jp": ("a.b.city.jp", "a.b.city.jp", "b.city.jp"), "notco.uk": ("notco.uk", "notco.uk", "uk")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    suffixes = [*url_reputation.SUFFIXES, "b.city.jp"]
    got = {r.h: (r.host, r.domain, r.suffix) for r in url_reputation.levels(df, url_reputation.site_of(F.col("h")), suffixes, "h").collect()}
    assert got == hosts
    bad = spark.createDataFrame([(f"http://{h}.co.uk/{i}", 1) for h in "ab" for i in range(17)] + [(f"http://s{i}.org/", 0) for i in range(60)], "url string, bad int")
    pages = spark.createDataFrame([(1, "http://new.co.uk/"), (2, "http://www.a.co.uk/"), (3, "http://me@a.co.uk:443/"), (4, "http://b.org/")], "page_id long, url string")
    judged = {r.page_id: r for r in url_reputation.judge(pages, bad, []).collect()}
    assert judged[2].verdict == judged[3].verdict == "block" and judged[4].verdict == "allow"
    assert judged[2].bad_mean == url_reputation.judge(pages.filter("page_id = 2"), bad, []).first().bad_mean
    assert judged[1].bad_mean < judged[2].bad_mean  # the suffix's, not that of a domain "co.uk"


PAGES = {"": "", None: "", "x &amp; y": "x & y", "<p>a<p>b": "a\n\nb", "<div": "", "<script>x": "", "<p>1 < 2 &lt; 3&nbsp;\n x</p>": "1 < 2 < 3 x",
         "<article><header>H</header><h1>T</h1><p>One <b>two<br>three</p><aside>no</aside><p>four<script>var a='</p>'</script> five</article>rest": "T\n\nOne two three\n\nfour five",
         "<body class=has-sidebar><nav><a href=/>home</a></nav><div id=c><p>Some long text of the page, word after word.</p><section><p>More of it follows here.</p></section></div>"
         "<div class='user-comments'><p>I disagree with all of it, and at length.</p></div><form><p>mail</p></form></body>": "Some long text of the page, word after word.\n\nMore of it follows here.",
         "<!-- <p>no</p> --><main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>": "a\n\nb\n\nc\n\nd"}


def test_main_text(spark):
    rows = [(i, "u", h, "t", 1) for i, h in enumerate([*PAGES, ""])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: (r.text, r.n_chars) for r in text_density.extract(pages).collect()}
    for (i, _, h, _, _) in rows:
        assert got[i] == (PAGES[h], len(PAGES[h])), h
    assert text_density.extract(pages.limit(0)).collect() == []


STORY = "<p>The first part of the story, told at length.</p><p>And the second one.</p>"
TOLD = "The first part of the story, told at length.\n\nAnd the second one."
THREAD = "<div class='comment-list'><p>No, no, no, and here is why, at much greater length than the whole of the story itself was told.</p></div>"


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'><article>{STORY}</article></div>", f"<div id='page' class='with-header'><article>{STORY}</article></div>",
    f"<section class='search-result'><article>{STORY}</article></section>", f"<div class='sidebar'><main>{STORY}</main></div>",
    f"<div class='no-comments'>{STORY}</div>", f"<div class='widget'>{STORY}</div><div class='site-footer'>Imprint.</div>{THREAD}",
    f"<div><p class='ad'>Buy this!{STORY}</div>"])
def test_main_text_stays_in_wrappers_with_hint_words(page):
    assert text_density.main_text(page) == TOLD


def test_main_text_drops_plain_names():
    assert text_density.main_text(f"<article>{STORY}</article>{THREAD}<div class='sidebar'><p>{'About us. ' * 40}</p></div>") == TOLD
    assert text_density.main_text("<article><p>Pay is due.</p><p class='notice-period'>Three months.</p><p class='cookie-notice'>We bake.</p></article>") \
        == "Pay is due.\n\nThree months."


def paragraphs(name, n, words):
    return "".join(f"<p>{name}{i} {'abcde ' * words}</p>" for i in range(n))


ONE, LINKS = paragraphs("one", 10, 40), "<ul>" + "<li><a href=/x>elsewhere</a>" * 30 + "</ul>"
BESIDE = {f"<body><main><article>{ONE}</article><article>{paragraphs('two', 10, 40)}</article></main>": "one0 one9 two0 two9",
          f"<body><article>{ONE}</article><article>{paragraphs('two', 3, 30)}</article><article>{paragraphs('three', 6, 35)}</article>{LINKS}": "one0 two0 two2 three5",
          f"<body><div><div><article>{ONE}</article></div><div><article>{paragraphs('two', 4, 20)}</article></div></div>": "one0 one9 two0 two3",
          f"<body><div>{paragraphs('before', 8, 40)}</div><article>{ONE}</article>{LINKS}": "before0 before7 one0 one9",
          f"<body>bare {'abcde ' * 900}<article>{ONE}</article>{LINKS}": "bare one0 one9",
          f"<body><main><h1>title</h1>lead <b>in</b> brief<div>{ONE}</div>{LINKS}</main>": "title lead in brief one0 one9"}


@pytest.mark.parametrize("page", BESIDE)
def test_main_text_stands_in_several_places(page):
    got = text_density.main_text(page)
    at = [f" {' '.join(got.split())} ".find(f" {w} ") for w in BESIDE[page].split()]
    assert -1 not in at and at == sorted(at)
    assert "elsewhere" not in got


def test_main_text_without_teasers():
    teaser = "<article><h3><a href=/x>elsewhere there is more to read</a></h3><p>and more</p></article>"
    assert text_density.main_text(f"<main><article>{STORY}</article>{teaser * 3}</main>") == TOLD
