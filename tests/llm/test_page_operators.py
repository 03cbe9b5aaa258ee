"""HTML text, WARC index, URL filter, chat formatting: awkward cases against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.llm.chat_format import Template, escape, format_segments, formatted, read_segments, unescape
from sightline.llm.common import scratch_path
from sightline.llm.html_text import LineBlocks, extract_text, main_text
from sightline.llm.url_filter import entropy, held_out_accuracy, judged, labelled_sample, rule_labels
from sightline.llm.warc import ArchiveSpec, archive_round_trip, look_up, parse, query_keys, read_records, record, reversed_host_key, write_archives, write_index
from tests.llm.helpers import prose

SPEC = LineBlocks()
LEAD = "The first paragraph of the story, long enough to be text, goes here."

PAGES = [
    (None, ""),
    ("", ""),
    ("<article></article>", ""),
    ("plain text, no tags &amp; more", "plain text, no tags & more"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LEAD}</p><p>Short.</p></article><footer>f</footer>", f"T {LEAD} Short."),
    (f"<article><p><b>{LEAD}<br><p>a&nbsp;\n b&#233;&lt;x&gt;</p><script>var t='</p>';</script><style>p{{}}</style></article>", f"{LEAD} a bé<x>"),
    (f"<article><p>{LEAD}</p><div class='ad box'>Buy <div>now</div> it</div><aside>side</aside><form><p>Name</p></form><p>End.</p></article>", f"{LEAD} End."),
    (f"<main><p>{LEAD}</p><section id=comments><p>First!</p><article class=comment><p>me</p></article></section></main><div class=sidebar>x</div>", LEAD),
    (f"<body><header><h1>Site</h1></header><div class='cookie-notice'>We use them</div><div><p>{LEAD}</p><p>Two.</p></div><ul><li><a href=a>A link</a><li><a href=b>B link</a></ul></body>", f"{LEAD} Two."),
    (f"<nav><ul><li>never closed<article><p>{LEAD}</article>", LEAD),
    (f"<!-- <article>no</article> --><article>x<i>y</i>z <p>{LEAD}<!-- c --></p></article>", f"xyz {LEAD}"),
    (f"<article><header><p>by me</p><h1>Title</h1></header><p>{LEAD}</p><table><tr><td>1</td><td>2</td></tr></table></article>", f"Title {LEAD} 1 2"),
    ('<article><p title="a>b" class=\'x\'>one</p><p title="open>two</p></article>', "one two"),
]


def test_main_text():
    for page, want in PAGES:
        assert main_text(page or "", SPEC) == want, page


UNCLOSED = [
    (f"<html><head><title>t</title><body><article><p>{LEAD}</p></article></html>", LEAD),
    (f"<html><head><meta charset=x><title>t<link rel=y><body><article><p>{LEAD}</p><svg><title>i</title></svg><p>End.</p></article></html>", f"{LEAD} End."),
    (f"<head><title>t</title><style>p{{}}</style><p>{LEAD}</p>", LEAD),
    *((f"<body><{n} class=x>a b<article><p>{LEAD}</p></article>", LEAD) for n in ("title", "noscript", "template", "textarea", "select", "svg", "iframe", "object")),
    *((f"<{n}>a<article><p>{LEAD}</p><{n}>b<i>c</i></{n}><p>End.</p></article>", f"{LEAD} End.") for n in ("noscript", "select", "svg", "textarea", "object")),
    (f"<article><p>{LEAD}<noscript><img src=x></p><p>Two.</p></article><article><p>End.</p></article>", f"{LEAD} Two. End."),
    (f"<nav><svg><path></nav><p>{LEAD}</p>", LEAD),
    (f"<article><p>one<svg class=x /></p><p>{LEAD}</p><svg><g><svg><p>x</p></svg></g>y</svg></article>", f"one {LEAD}"),
    (f"<article><title-card>one</title-card><select-box>two</select-box><p>{LEAD}</p></article>", f"one two {LEAD}"),
    (f"<noscript><p>closed</p><article>no</article></noscript><title>The <p> and <title> tags</title><textarea><article></textarea><article>{LEAD}</article>", LEAD),
    (f"<article>{LEAD}</article><script>never closed <article>no</article>", LEAD),
]


TAIL = "The last paragraph, which is just as long as the first, ends it."
NAMED = [
    *((f"<body><p>Top of it all</p><div {c}><h1>T</h1><p>{LEAD}</p><p>{TAIL}</p></div></body>", f"Top of it all T {LEAD} {TAIL}")
      for c in ("class='layout with-sidebar'", "class=no-sidebar", "id=content-menu-left", "class=sidebar", "class=widget", "id='modal'")),
    *((f"<article><p>{LEAD}</p><section class='{c}'><p>{TAIL}</p></section><p>It ends after this line, which is longer than all that stands before it in the story, so no block holds most of the text.</p></article>",
       f"{LEAD} {TAIL} It ends after this line, which is longer than all that stands before it in the story, so no block holds most of the text.")
      for c in ("related-work", "share-price", "search_results", "has-ads x", "layout-menu")),
    (f"<article class='post no-comments'><p>{LEAD}</p></article>", LEAD),
    *((f"<article><p>{LEAD}</p><div class='{c}'>Out.</div><p>End.</p></article>", f"{LEAD} End.")
      for c in ("sidebar-left", "x main-menu", "related-posts", "ad_slot2", "share-buttons", "comment-list", "cookie-notice", "post-related-links")),
    (f"<p>{LEAD}</p><div class=ad>{TAIL} {TAIL}</div><section id=comments>{TAIL}<p>{TAIL}</section>", LEAD),
    (f"<div class=sidebar><div class=menu><p>{LEAD}</p><p>{TAIL}</p></div><ul class=related><li>a</ul></div>", f"{LEAD} {TAIL}"),
    *((f"<article><{h}><{n} class=related>no<i>x</i><{n}>yes</{h}><p>{LEAD}</p></article>", f"yes {LEAD}")
      for h, n in (("ul", "li"), ("dl", "dd"), ("dl", "dt"), ("table", "tr"), ("table", "td"), ("table", "th"), ("table", "tbody"), ("datalist", "option"))),
    *((f"<article><ul><li class=related>no{e}</ul><p>{LEAD}</p></article>", LEAD) for e in ("", "</li>", "<ul><li>no<li>no</ul>", "<ul><li>no</li></ul></li>", "<ol><li>no<li>no</ol></li>", "<div>no</div>", "<p>no</p>")),
    (f"<article><ul><li class=ad>no<ul><li>no</ul><li>yes<li class=ad>no</ul><p>{LEAD}</p></article>", f"yes {LEAD}"),
    (f"<article><table><tr><td class=sidebar>no<table><tr><td>no<td>no</table><td>yes</table><dl><dt class=ad>no<dd>yes</dl><p>{LEAD}</article>", f"yes yes {LEAD}"),
    (f"<div><li class=ad>no</div><p>{LEAD}</p>", LEAD),
    (f"<ul><li class=ad>no<article><p>{LEAD}</p></article>", LEAD),
]


def test_names_and_left_out_end_tags_do_not_take_the_text():
    for page, want in NAMED:
        assert main_text(page, SPEC) == want, page
    deep = "<div class=sidebar>" * 20_000
    assert main_text(f"{deep}<p>{LEAD}</p>", SPEC) == LEAD
    assert main_text("<ul>" + "<li class=menu>x<li>y" * 20_000, SPEC).startswith("y y y")


def test_unclosed_elements_do_not_take_the_page():
    for page, want in UNCLOSED:
        assert main_text(page, SPEC) == want, page
    assert main_text("<svg><p>x</p>" * 20_000 + f"<article>{LEAD}</article>", SPEC) == LEAD


def test_line_blocks_cut_what_nothing_marks():
    body = "".join(f"<p>{prose(random.Random(k), 30)}</p>" for k in range(5))
    links = "".join(f"<div><a href=x>{prose(random.Random(k), 4)}</a></div>" for k in range(6))
    want = " ".join(prose(random.Random(k), 30) for k in range(5))
    assert main_text(f"<body>{links}{body}{links}</body>", SPEC) == want


def test_extract_text(spark):
    long = "<article>" + "<p>" + prose(random.Random(1), 30_000) + "</p></article>"
    rows = [(k, f"u{k}", p) for k, (p, _) in enumerate(PAGES)] + [(99, None, long), (99, None, long), (None, "u", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = extract_text(df).collect()
    assert [(r["page_id"], r["text"]) for r in got[: len(PAGES)]] == [(k, w) for k, (_, w) in enumerate(PAGES)]
    assert [r["n_chars"] for r in got if r["page_id"] == 99] == [len(prose(random.Random(1), 30_000))] * 2
    assert len(got) == len(rows) and extract_text(df.limit(0)).count() == 0


def test_archive_round_trip(spark):
    big = "<p>" + "é" * 3000 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(k, f"http://www.Ex{k % 5}.org/a b?{k}", big) for k in range(40)]
    rows += [(100 + k, "http://same.org/", f"<p>{k % 3}</p>") for k in range(30)]
    rows += [(200, None, None), (201, "", ""), (202, "no scheme\r\nX: y", "x"), (203, "http://a.org", prose(random.Random(2), 50_000)), (None, "http://n.org", "n"), (7, "http://www.Ex2.org/a b?7", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS digest", "3 AS file", "4 AS latest")
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive_round_trip(df, ArchiveSpec(block_lines=4, file_bytes=3000)).collect())
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        last = max(i for i, _, h in rows if h == html and i is not None) if len(data) >= 1000 else None
        refers = last if last is not None and last != page_id else None
        want.append((page_id if page_id is not None else -1, len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)


def test_revisits_name_the_record_they_refer_to():
    body, digest = b"x" * 2000, hashlib.sha1(b"x" * 2000).hexdigest()
    spec = ArchiveSpec()
    first, _, payload = parse(record(9, "http://a.org/", body, digest, None, spec))
    again, http, none = parse(record(3, "http://b.org/", body, digest, 9, spec))
    assert payload == body and none == b"" and b"Content-Length: 2000" in http
    assert (again["WARC-Type"], again["WARC-Refers-To"]) == ("revisit", first["WARC-Record-ID"]) and again["WARC-Record-ID"] != first["WARC-Record-ID"]


def test_reading_is_dealt_by_the_bytes_of_the_records(spark):
    rows = [(k, f"http://h{k}.org/", prose(random.Random(k), 300)) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    catalogue = write_archives(df, folder, ArchiveSpec())
    found = read_records(catalogue, folder, stretch=5000)
    assert found.rdd.getNumPartitions() >= sum(r["length"] for r in catalogue.collect()) // 5000
    assert sorted(r["page_id"] for r in found.collect()) == list(range(60))
    assert read_records(catalogue, folder).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_lookup_finds_only_what_is_asked(spark):
    rows = [(k, f"http://h{k % 7}.example.com/{k}", f"<p>{k}</p>") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc-test")
    spec = ArchiveSpec(block_lines=5)
    catalogue = write_archives(df, folder, spec)
    directory = write_index(catalogue, folder, spec)
    assert directory.count() >= 200 / 5
    asked = query_keys(df.where("page_id % 50 = 3")).union(spark.createDataFrame([(reversed_host_key("http://zzz.org/", 1),), (reversed_host_key("http://a.b/", 1),)], "key string"))
    got = read_records(look_up(asked, directory, folder), folder).collect()
    assert sorted(r["page_id"] for r in got) == [3, 53, 103, 153]
    assert {r["url"] for r in got if r["page_id"] == 53} == {"http://h4.example.com/53"}
    empty = df.limit(0)
    assert archive_round_trip(empty).count() == 0


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def fitting(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    fits = [r for r in RULES for on in [r.split("/")[0]] if (host == on or host.endswith("." + on)) and path.startswith(r[len(on) :])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "http://a.example.net/en/1", "HTTP://A.Example.NET/en", "http://net/", "http://net", "http://badnet/", "http://x.net?q=/en/",
    "http://example.com/de/x", "http://notexample.com/de/x", "http://www.example.com/de", "http://w.org/fr/1#a", "ftp://é.org/fr/\nb", "a://b://c.net/x", "http://a.net/en/" + "y" * 5000,
]


def test_url_rules_and_trees(spark):
    rng = random.Random(5)
    urls = URLS + ["http://x.net/"] * 2
    good = [f"https://{prose(rng, 1)}.example.com/en/{rng.randint(1, 999)}" for _ in range(150)]
    bad = [f"https://{prose(rng, 1)}{rng.randint(10000, 99999)}.spam.example.org/en/{rng.randint(10**6, 10**7)}?a=1&b={rng.randint(1, 99)}" for _ in range(150)]
    rows = list(enumerate(urls + good + bad))
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS features", "2 AS suffix")
    at = len(urls)
    labels = spark.createDataFrame([(i, float(i >= at + 150)) for i in range(at, at + 300) if i % 3] + [(None, 1.0), (at, None)], "id long, bad double")
    got = {r["page_id"]: r for r in judged(df, labels, RULES).collect()}
    for i, url in rows:
        host, path, rule = fitting(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        if rule:
            assert got[i]["verdict"] == RULES[rule]
    held = [i for i in range(at, at + 300) if not i % 3]
    right = sum((got[i]["verdict"] == "block") == (i >= at + 150) for i in held)
    assert right >= 0.95 * len(held)
    nothing = judged(df, labels.limit(0), RULES)
    assert {r["verdict"] for r in nothing.where("rule IS NULL").collect()} == {"allow"}
    assert judged(df.limit(0), labels, RULES).count() == 0


def test_escape_is_reversible():
    rng = random.Random(1)
    template = Template()
    pieces = [*template.controls, "\\", "\\\\", "[", "<", "/s>", "a", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        safe = escape(text, template)
        assert unescape(safe) == text and not any(c in safe for c in template.controls)


def test_chat_format(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "[INST] a\\b"), (2, 0, "assistant", None), (2, 0, "assistant", "x"),
        (2, None, None, "y"), (None, 1, "user", "z"), (3, 0, "user\n<|im_end|>", "<|im_end|>\n"), (3, 1, "assistant", "w" * 300_000), (3, 1, "assistant", "w" * 300_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS loss")
    got = {r["conv_id"]: r for r in formatted(df).collect()}
    order = {}
    for conv, turn, role, text in rows:
        order.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(order)
    for conv, turns in order.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got[1]["n_faults"] == 0 and got[2]["n_faults"] == 3 and got[3]["n_faults"] == 3
    segments = format_segments(df)
    assert segments.where("loss").count() == 5
    assert formatted(df.limit(0)).count() == 0


OWN = [
    Template(opening="<turn ", header_end=">", closing="<end>", controls=(), last=("assistant", "user")),
    Template(opening="abab", header_end="|", closing="\n\nbaba\n", controls=("aa", "bab")),
]


@pytest.mark.parametrize("template", OWN)
def test_own_templates_are_reversible(spark, template):
    """Marks that no list of controls names, and controls that overlap one another."""
    rng = random.Random(4)
    pieces = [*template.guarded(), template.opening, template.closing, template.header_end, "a", "b", "\\", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))
        safe = escape(text, template)
        assert unescape(safe) == text and not any(c in safe for c in template.guarded())
    rows = [(1, 0, "user", template.closing), (1, 1, "assistant", template.opening + "x"), (2, 0, template.closing, ""), (3, 0, "user", "<end>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in formatted(df, template).collect()}
    for conv in (1, 2, 3):
        said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == conv)
        assert got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    # The unknown role breaks the order and may not end; a user may end only under the first template.
    assert [got[c]["n_faults"] for c in (1, 2, 3)] == [0, 2, 0 if "user" in template.last else 1]


@pytest.mark.parametrize("marks", [{"closing": "\n"}, {"opening": "#"}, {"controls": ("\\n",)}, {"after": (("user", ("",)),)}])
def test_templates_are_checked(marks):
    with pytest.raises(ValueError):
        Template(**marks)


@pytest.mark.usefixtures("batch_rows")
def test_ends_across_batches(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "x") for c in range(9) for t in range(6 + c % 2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {(r["conv_id"], r["n_faults"]) for r in formatted(df).collect()} == {(c, c % 2) for c in range(9)}


@pytest.mark.usefixtures("batch_rows")
def test_chat_across_batches(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}:{t}") for c in range(5) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = read_segments(format_segments(df)).collect()
    assert {(r["conv_id"], r["n_turns"], r["n_faults"]) for r in got} == {(c, 12, 0) for c in range(5)}


TEXT = "The council met on Monday and agreed on a plan for the bridge over the river, which had been closed since spring."
ATTRIBUTES = [
    'style="overflow:hidden"', 'title="a hidden gem"', 'data-id="ad-12"', 'onclick="el.hidden=true"', 'data-role="navigation"', 'data-class="menu"',
    'aria-hidden="false"', "data-x='id=\"menu\" hidden'", "data-hidden=1 class=body", 'xid="sidebar"', 'style = "a" data-a = "class=ad"',
]


@pytest.mark.parametrize("attribute", ATTRIBUTES)
def test_names_inside_other_attributes_mean_nothing(attribute):
    for page in ("<body><article><div {}><p>{}</p></div></article></body>", "<body><div {}><p>{}</p></div></body>", "<article><p {}>{}</p></article>"):
        assert main_text(page.format(attribute, TEXT), LineBlocks()) == TEXT


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', "HIDDEN", 'aria-hidden="true"', "aria-hidden=true", 'role="navigation"', "class=cookies", 'class="x" id="sidebar"'])
def test_real_attributes_count(attribute):
    page = f"<body><article><div {attribute}><p>Other words</p></div><p>{TEXT}</p></article></body>"
    assert main_text(page, LineBlocks()) == TEXT


@pytest.mark.parametrize("name", ["header", "site-header", "copyright", "disclaimer", "legal", "alert", "alert-box"])
def test_heads_and_feet_named_by_class(name):
    for key in ("id", "class"):
        page = f'<body><div {key}="{name}">The Daily Site, news from all over</div><div><p>{TEXT}</p><p>{TEXT}</p></div></body>'
        assert main_text(page, LineBlocks()) == f"{TEXT} {TEXT}"
    head = f'<body><article><div class="entry-header"><h1>Bridge</h1></div><div class="header"><h2>Plan</h2></div><p>{TEXT}</p></article></body>'
    assert main_text(head, LineBlocks()) == f"Bridge Plan {TEXT}"


def test_entropy_reads_the_whole_text(spark):
    texts = ["", None, "a", "aab", "é😀é", "http://" + "ab" * 400 + "c" * 900]

    def bits(t):
        return sum(t.count(c) / len(t) * -math.log2(t.count(c) / len(t)) for c in set(t)) if t else 0.0

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", entropy(F.col("t")).alias("b")).collect()
    assert all(abs(r["b"] - bits(texts[r["i"]] or "")) < 1e-9 for r in got) and len(got) == len(texts)


def test_trees_carry_the_rules_over(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    labels = rule_labels(pages, rules)
    assert {r["bad"] for r in labels.collect()} == {0.0, 1.0}
    right, constant = held_out_accuracy(labelled_sample(pages, labels))
    assert right > 0.9 > constant
    rest = judged(pages, labels, rules).where("rule IS NULL").groupBy("verdict").count().collect()
    assert {r["verdict"] for r in rest} == {"allow", "block"}
    odd = pages.limit(3).selectExpr("page_id", "CAST(NULL AS STRING) AS url", "'x' AS suffix", "'y' AS segment", "1 AS n", "2 AS bad")
    assert judged(odd, rule_labels(odd, rules), rules).count() == 3
