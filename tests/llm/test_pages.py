"""Page and license operators: small cases, edges, and SQL over whole small tables."""

import duckdb
import pytest

from runledger.llm import html_extract, license_scan, line_dedup, registry, warc_audit

PAGE = "page_id long, url string, html string, host string"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()[want.columns.tolist()]
    rows = lambda df: sorted(map(tuple, df.astype(str).values.tolist()))
    assert rows(got) == rows(want)


def site(k, body):
    return (k, f"https://Site.example/{k}", f'<html><head><title>t</title></head><body><nav class="menu{k}"><a href="/">home</a></nav><div class="post-{k} entry">{body}</div><div class="comments"><p>long reader comment {"words " * 400}</p></div><footer>c</footer></body></html>', "x")


def test_extract(spark):
    text = "<h1>Head &amp; more</h1><p>One\n two<br>three<p><b>Four</b> <i>five</i></p><aside>no</aside><form>no</form><script>var a='</p>'</script>"
    rows = [site(k, text) for k in range(4)] + [(9, None, None, None), (10, "nonsense", "", "x"), (11, "https://site.example/z", "<p>alone &lt;x&gt;", "x")]
    out = {r.page_id: r for r in html_extract.extracted(spark.createDataFrame(rows, PAGE)).collect()}
    assert out[0].text == "Head & more\n\nOne two three\n\nFour five" and out[3].path == "/body/div.entry.post-N"
    assert out[9].text == out[10].text == "" and out[9].n_chars == 0
    assert out[11].text == "alone <x>"
    assert html_extract.extracted(spark.createDataFrame([], PAGE)).count() == 0


def test_line_dedup(spark):
    rows = [(k, "h", ["menu", f"own {k}", "menu", "foot"]) for k in range(6)] + [(6, "h", ["own 6"]), (7, None, ["menu"]), (8, "h", [])]
    df = spark.createDataFrame(rows, "page_id long, host string, lines array<string>")
    out = {r.page_id: r.kept for r in line_dedup.without_boilerplate(df).collect()}
    assert out[0] == ["own 0"] and out[6] == ["own 6"] and out[7] == ["menu"] and out[8] == []
    assert line_dedup.without_boilerplate(df.limit(0)).count() == 0


def test_audit(spark):
    rows = [(f, o, 10, f"d{f}-{o}") for f in range(3) for o in range(0, 3_000_000, 40_000)]
    kind = "file long, offset long, length long, digest string"
    a = spark.createDataFrame(rows + [(None, 1, 1, "x")], kind)
    bad = [r for r in rows if r != (1, 40_000, 10, "d1-40000") and r != (2, 0, 10, "d2-0")] + [(2, 0, 10, "other"), (2, 5_000_000, 1, "new")]
    got = sorted(tuple(r) for r in warc_audit.audit(a, spark.createDataFrame(bad, kind)).collect())
    assert got == [(1, 40_000, 10, "missing"), (2, 0, 10, "corrupt"), (2, 5_000_000, 1, "extra")]
    assert warc_audit.audit(a, a).count() == 0
    assert warc_audit.audit(a, a.limit(0)).count() == len(rows)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x\r\n\r\ny</p>", ""), (2, None, None, "")]
    df = spark.createDataFrame(rows, PAGE)
    text = "".join(r.r for r in df.orderBy("page_id").select(warc_audit.record(df["url"], df["html"]).alias("r")).collect())
    (tmp_path / "a.warc").write_bytes(text.encode())
    out = sorted((bytes(r.body), r.intact) for r in warc_audit.read_warc(spark, f"file://{tmp_path}/a.warc").collect())
    assert out == [(b"", True), (b"<p>x\r\n\r\ny</p>", True)]


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x", "plain " * 99), ("a/y", None), ("z", ""), (None, "Released under the MIT License."), ("q/own", "word " * 200 + "\nLicensed under CC BY-NC 4.0."), ("q/other", "x")]
    out = {r.path: (r.license, r.via) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert out == {"a/LICENSE": ("MIT", "own"), "a/b/LICENSE": ("Apache-2.0", "own"), "a/b/c/x": ("Apache-2.0", "a/b"), "a/y": ("MIT", "a"), "z": (None, None), None: (None, None), "q/own": ("CC-BY-NC-4.0", "own"), "q/other": (None, None)}
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_scores_equal_plain_cosine(spark):
    import math
    import re
    from collections import Counter

    texts = ["Licensed under the MIT license", "Copyright by us, warranty none", "Released under the MIT License.", "Released under the MIT License."]
    rows = [(f"d/{k}", t) for k, t in enumerate(texts)]
    terms = lambda t: Counter(x for x in re.split("[^0-9a-z]+", t.lower()) if x)
    bags = [terms(t) for t in texts] + [terms(t) for _, t in license_scan.TEMPLATES]
    idf = {w: math.log((len(bags) + 1) / (sum(w in b for b in bags) + 1)) + 1 for b in bags for w in b}
    norm = lambda b: math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
    cos = lambda a, b: sum(n * b[w] * idf[w] ** 2 for w, n in a.items()) / norm(a) / norm(b)
    got = {r.path: r.score for r in license_scan.licenses(license_scan.notices(spark.createDataFrame(rows, "path string, text string"))).collect()}
    for k, b in enumerate(bags[: len(texts)]):
        top = max(cos(b, t) for t in bags[len(texts) :])
        assert (f"d/{k}" in got) == (top >= license_scan.THRESHOLD)
        assert f"d/{k}" not in got or got[f"d/{k}"] == pytest.approx(top, abs=1e-5)


def test_full_license_files_and_notices_within_text(spark):
    full = dict(license_scan.FULL)
    prose = " ".join(f"alpha{k} beta the of and to{k}" for k in range(150))
    rows = [(f"{name}/COPYING", f"Copyright (c) 2019 Jane Roe\n\n{text}") for name, text in license_scan.FULL] + [(f"{name}/src/a", "x") for name in full]
    rows += [("run/on", f"{prose} released under the MIT License {prose}"), ("run/other", "x"), ("wrap/a", f"{prose}\nThis work is licensed under the GNU General\nPublic License, version 3.\n{prose}"), ("prose/a", f"copyright {prose} " + "the of and to any in or that license " * 200), ("many/a", "word " * 200 + "\nReleased under the MIT License."), ("many/b", "x"), ("short/a", "word " * 78 + "\nReleased under the MIT License."), ("short/b", "x")]
    rows += [("head/a", "\n".join(["# " + x for x in full["MIT"].splitlines()] + [f"call{k} = value{k}" for k in range(300)])), ("head/b", "x")]
    out = {r.path: (r.license, r.via) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in full:
        assert out[f"{name}/COPYING"] == (name, "own") and out[f"{name}/src/a"] == (name, name)
    assert out["run/on"] == ("MIT", "own") and out["run/other"] == (None, None)
    assert out["wrap/a"] == ("GPL-3.0", "own") and out["prose/a"] == (None, None)
    assert out["head/a"] == ("MIT", "own") and out["head/b"] == (None, None)
    assert out["many/b"] == (None, None) and out["short/b"] == ("MIT", "short")


def test_extract_keeps_what_layout_classes_mark(spark):
    text = "<h1>Head</h1><p>One two three four five.</p>"
    waste = '<div class="sidebar"><p>aside</p></div><nav>nav</nav>'
    pages = [
        f'<body class="single has-sidebar">{waste}<div>{text}</div></body>',
        f'<body class="search">{waste}<article class="post comments-open">{text}</article></body>',
        f'<body><div class="no-sidebar header-fixed">{waste}<main id="search">{text}</main></div></body>',
        f'<body><div class="search">{waste}<div>{text}</div></div></body>',
        '<body><div class="notice"><p>One two three four five.</p></div></body>',
        f'<body><article>{text}<figure><figcaption>Below</figcaption></figure><p>x <math><mi>y</mi></math></p><label>z</label></article></body>',
    ]
    out = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame([(k, f"https://h{k}.example/", h, "") for k, h in enumerate(pages)], PAGE)).collect()}
    assert [out[k] for k in range(4)] == ["Head\n\nOne two three four five."] * 4
    assert out[4] == "One two three four five."
    assert out[5] == "Head\n\nOne two three four five.\n\nBelow\n\nx y\n\nz"


def test_extract_with_several_templates_on_a_host(spark):
    long = "<p>" + "many words of the article " * 8 + "</p>"
    want = ("many words of the article " * 8).strip()
    pages = [f'<body><div class="a">{long}</div></body>'] * 12 + [f'<body><div class="a"><p>short</p></div><div class="b">{long}</div></body>'] * 3
    pages += [f'<body><p>lead</p><div class="t{chr(97 + k)}">{long}</div></body>' for k in range(10) for _ in range(11 - k)]
    whole = f'<body><article><h1>Head</h1><div class="content">{long}</div><section class="more"><p>More</p></section></article></body>'
    linked = f'<body><div class="l"><p><a href="/">{"link " * 9}</a> own</p></div></body>'
    unclosed = f'<body><a name="top"><div class="u">{long}</div><a href="/x">x</a></body>'
    pages += [whole, linked, unclosed]
    out = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame([(k, "https://one.example/", h, "") for k, h in enumerate(pages)], PAGE)).collect()}
    assert {out[k] for k in range(len(pages) - 3)} == {want}
    assert out[len(pages) - 3] == f"Head\n\n{want}\n\nMore"
    assert out[len(pages) - 2] == ("link " * 9).strip() + " own" and out[len(pages) - 1] == want


def test_extract_follows_the_votes_between_like_containers(spark):
    a, b = '<div class="a"><p>{}</p></div>', '<div class="b"><p>{}</p></div>'
    pages = [f"<body>{a.format('x' * 90)}</body>"] * 5 + [f"<body>{a.format('y' * 60)}{b.format('z' * 70)}</body>"]
    out = {r.page_id: r for r in html_extract.extracted(spark.createDataFrame([(k, "https://one.example/", h, "") for k, h in enumerate(pages)], PAGE)).collect()}
    assert out[5].path == "/body/div.a" and out[5].text == "y" * 60


def test_hostile_pages_take_linear_time():
    import time

    from runledger.llm import html_extract

    pages = ['<a "' * 100_000, "<script " * 60_000, '<a ="' * 100_000, "<div>" * 50_000 + "x", '<div class="ad">' * 30_000 + "text", "<" * 400_000, "<div>" * 20_000 + "</x>" * 20_000, "<p>" + "<span>" * 30_000 + "<p>" * 10_000]
    began = time.time()
    for page in pages:
        paths, found = html_extract.blocks(page)
        html_extract._candidates(paths, html_extract.scores(paths, found))
    assert time.time() - began < 20


def test_unclosed_quotes_are_no_text():
    from runledger.llm import html_extract

    page = '<article><p>Some <a href="x>oops and more text here</p><p title="a < b > c">two</p><img alt="<b>"><p>three</p><p class="end'
    paths, found = html_extract.blocks(page.replace('"x>', "'x>"))
    best = html_extract._candidates(paths, html_extract.scores(paths, found))
    assert html_extract.main_text(paths, found, best[0][1]) == "Some oops and more text here\n\ntwo\n\nthree"


def test_warc_records_within_bodies_and_damage(spark, tmp_path):
    html = "<p>WARC/1.0\r\nContent-Length: 3\r\n\r\nabc</p>"
    rows = [(k, f"http://a/{k}", html if k % 3 else "é" * k, "") for k in range(20)] + [(None, "http://n", None, ""), (3, "http://again", "x", "")]
    pages = spark.createDataFrame(rows, PAGE)
    archives = warc_audit.archive(pages, 8)
    warc_audit.write_warc(archives, f"file://{tmp_path}/w", a=archives["r"], b=warc_audit.decayed())
    a, b = (warc_audit.index_of(spark, f"file://{tmp_path}/w/replica={x}") for x in "ab")
    assert a.count() == len(rows)
    sizes = [(r.file, r.page_id, len(r.r.encode())) for r in archives.collect()]
    assert sorted((r.file, r.length) for r in a.collect()) == sorted((f, n) for f, _, n in sizes)
    assert sorted(r.status for r in warc_audit.audit(a, b).collect()) == ["corrupt", "missing"]
    assert warc_audit.audit(a, a).count() == 0
    assert warc_audit.read_warc(spark, f"file://{tmp_path}/w/replica=a").where("not intact").count() == 0
    warc_audit.write_warc(archives.limit(0), f"file://{tmp_path}/c", a=archives["r"])
