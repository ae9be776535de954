"""Quality rules, personal data, pages, chats, URL filters: against brute force and on odd rows."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streamframe.llm import chat, html_text, pii, quality, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, failed string"
ODD = [
    (1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 1, None), (3, "a " * 60, "en", "a", 120, 1, "x"), (3, "a " * 60, "en", "a", 120, 1, "x"),
    (None, "one two three", None, "b", 1, 2, "y"), (5, " \n\t ", "en", "b", 3, 2, "y"), (6, "word%d " * 3, "en", "b", 3, 2, "y"), (7, "x" * 300_000 + " y", "en", "b", 1, 1, ""),
]


def brute_repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


@given(st.text(alphabet="ab \n\x0b#É", max_size=60))
@settings(max_examples=300, deadline=None)
def test_measures_equal_their_definitions(text):
    m = dict(zip(quality.MEASURES, quality.measure(text)))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
    assert m["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
    assert m["n_dup_lines"] == len(lines) - len(set(lines))
    assert m["n_repeat_words"] == brute_repeats(words)


def test_quality_on_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    book = quality.verdicts(quality.ledger(docs), quality.POLICIES["v2"])
    rows = {r.doc_id: r for r in book.collect()}
    assert book.count() == len(ODD)
    assert rows[1].n_words == rows[2].n_words == rows[5].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[3].n_repeat_words == 60 and rows[3].base_failed
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_differ_without_the_texts(spark):
    good = " ".join(f"Wort{i} geht" for i in range(40))
    docs = spark.createDataFrame([(1, good), (2, good.upper()), (3, good.replace("geht", "geht!!")), (4, "kurz")], "doc_id long, text string")
    book = quality.ledger(docs)
    kept = {v: {r.doc_id for r in quality.verdicts(book, p).filter("kept").collect()} for v, p in quality.POLICIES.items()}
    assert kept == {"v1": {1, 3}, "v2": {1}}
    cut = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(book, quality.POLICIES["v2"]).collect()}
    assert cut["few_words"] == (1, 1) and cut["shouting"] == (1, 1) and cut["upper_case"] == (1, 1)
    assert {r.doc_id for r in quality.accepted(docs, quality.POLICIES["v2"]).collect()} == {1}
    assert quality.accepted(docs, quality.POLICIES["v2"]).columns == docs.columns


def test_accepted_rows_under_clashing_columns(spark, tmp_path):
    rows = [(1, "kurz", 3, 4, 5), (2, " ".join(f"Wort{i} geht" for i in range(40)), 0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, N_LINES int, failed long")
    out = quality.accepted(docs, quality.POLICIES["v2"])
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == rows[1:]
    book = quality.store(docs, str(tmp_path / "ledger"))
    assert quality.verdicts(book, quality.POLICIES["v1"]).filter("kept").count() == 1 and quality.ablation(book, quality.POLICIES["v2"]).count() == len(quality.RULES)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    n = lambda m: sum(c.isdigit() for c in m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= n(m) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= n(m) <= 15],
    }


@given(st.text(alphabet="a@.b-1234 +()x_0259", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_numbers_of_any_length_are_linear():
    assert pii.base_spans("1" * 200_000 + "." + "0" * 5000 + "7.1.1")["card"] == []
    assert pii.base_spans("a" * 200_000 + "@") == {"email": [], "ip": [], "card": [], "phone": []} and not pii.loose_spans("a" * 200_000 + "@ at", {})[1:]


def test_pii_keeps_base_and_adds(spark):
    loose = [(100 + i, f"please call us at (0{30 + i}) 555-12{i:02d} today, or write: jane{i} [at] example [dot] com") for i in range(30)]
    texts = [(1, None), (2, ""), (3, "mail a.b@example.org or +1 (201) 555-0123, 10.0.0.1 and 4111 1111 1111 1111"), (3, "mail a.b@example.org or +1 (201) 555-0123, 10.0.0.1 and 4111 1111 1111 1111"), (4, "version 1.2.3.4444 and plain words"), (None, "x@y.zz")]
    keys = [(200 + i, f'some words and token = "{hashlib.sha1(str(i).encode()).hexdigest()}" among others') for i in range(30)]
    loose += [*keys, *((300 + i, f"the number {4111111111111112 + 10 * i} is no card, and averyveryverylongwordof{'letters' * (i % 5 + 1)} no secret") for i in range(30))]
    found = pii.detect(spark.createDataFrame(texts + loose, "doc_id long, text string")).select("doc_id", pii.listed("base").alias("base"), pii.listed("spans").alias("spans"))
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(texts) + len(loose)
    assert rows[1].spans == rows[2].spans == rows[4].spans == ""
    assert rows[3].base == "email:5:20,ip:43:51,card:56:75,phone:24:41" and rows[None].base == "email:0:6"
    assert all(set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) for r in rows.values())
    assert all(f'secret:{t.index("= ") + 3}:' in rows[i].spans for i, t in keys)
    assert "phone:18:32" in rows[100].spans and "email:" in rows[100].spans and rows[100].base == ""
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.sampled_from(["a", "B9", ".", "-", "_", " ", "  ", " at ", "at", " AT ", "[at]", " [At] ", "(AT)", " dot ", "[DOT]", "(dot)", ".com", "\u017f", "\u0130", "é", "x" * 63]), max_size=14).map("".join))
@settings(max_examples=1000, deadline=None)
def test_loose_emails_equal_their_pattern(text):
    assert list(pii.loose_emails(text)) == [m.span() for m in pii._LOOSE["email"].finditer(text)]


@pytest.mark.parametrize("text", ["JANE [AT] EXAMPLE [DOT] COM", "Jane (At) Example (Dot) com", "jane at example.com", "jane AT example DOT com"])
def test_spelled_out_emails_are_candidates_in_any_case(text):
    assert pii.loose_spans(text, pii.base_spans(text)) == [("email", 0, len(text), False)]


def test_many_spans_are_linear():
    text = "call (030) 555-1200 or a@b.de " * 20_000
    base = pii.base_spans(text)
    assert len(base["email"]) == len(pii.loose_spans(text, base)) == 20_000


def test_no_candidate_begins_or_ends_inside_a_word():
    long = "x" * 500 + " at " + "y" * 300 + " dot " + ".".join(["z" * 70] * 9) + " dot com"
    assert list(pii.loose_emails(long)) == [(0, len(long))]
    for kind, s, e, _ in pii.loose_spans("key: " + "aB3" * 400 + " and " + "Zx9_" * 90 + "!", {k: [] for k in pii.BASE}):
        assert kind == "secret" and (s, e) in ((5, 1205), (1210, 1570))


def test_reliabilities_tell_labelers_apart():
    rng = random.Random(3)
    counts = {}
    for _ in range(4000):
        y = rng.random() < 0.4
        vote = tuple((1 if (rng.random() < p) == y else -1) for p in (0.95, 0.9, 0.9, 0.55, 0.85, 0.8))
        p = pii._pattern("phone", vote, 0)
        counts[p] = counts.get(p, 0) + 1
    keys = sorted(counts)
    posterior, table = pii.reliabilities(keys, [counts[k] for k in keys])
    right = table[pii.KINDS.index("phone"), :, 1, 2]
    assert right[0] > right[3] and right[0] > 0.85 and right[3] < 0.7


PAGE = """<html><head><title>T</title></head><body class="no-sidebar"><nav><a href=/>Home</a></nav><!-- <p>x --><div class=ad>Buy now, it is cheap and good for all of us!</div>
<div id=main><h1>Title &amp; more</h1><p>First   paragraph&nbsp;with enough words in it, as usual.</p><p>Short.<p>Second one with <a href=x>a link</a> and quite a lot of text.<br>New line</div>
<div class="sidebar"><p>Related stuff that nobody wants to read at all here.</p></div><div class="comments"><p>I am a reader comment, long enough to be mistaken.</p></div><form><p>Sign up!</p></form><footer>(c)</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\n\nFirst paragraph with enough words in it, as usual.\n\nShort.\n\nSecond one with a link and quite a lot of text. New line"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain text") == "plain text" and html_text.main_text("a < b <p>c") == "a < b\n\nc"
    assert html_text.main_text("<p>kept</p><script>var x = '<p>no</p>'") == "kept" and html_text.main_text("<!-- open <p>x") == ""
    assert len(html_text.main_text("<article>" + "<p>word</p>" * 20_000 + "</article>").split()) == 20_000
    assert html_text.regions([0, 100, 0, 0, 0, 0, 90, 90], 3, 40) == [(1, 2), (6, 8)]


def test_deep_pages_and_long_tags_are_read_whole():
    first, later = "The beginning of the article, which is long enough.", "What follows is much longer and fills the region. " * 9
    for deep in (10, 70, 5000):
        page = "<body>" + "<div>" * deep + f"<article><p>{first}<div><p>{later}</div><p>{later}</article>" + "</div>" * deep
        assert html_text.main_text(page).startswith(first)
    held = "x>" * 50_000
    assert html_text.main_text(f"<body><div data-state='{held}'><p>kept</p></div>") == "kept"
    assert html_text.main_text("<p title='a>b' id=c>kept</p>") == "kept" and html_text.main_text("<p title='a>kept") == "kept"
    assert len(html_text.main_text('<a b="' * 50_000 + "<p>text" * 50_000)) >= 0


def test_dropped_elements_end_where_their_end_is_implied():
    kept = "This is the paragraph that has to be kept, whatever went before."
    for page in (
        f"<div><p class=notice>Gone<p>{kept}</p><p>{kept}</p></div>",
        f"<div><p class=notice>Gone<div>{kept}</div></div><p>{kept}",
        f"<ul><li class=share>Gone<li>{kept}</ul><p>{kept}</p>",
        f"<div><ul><li>{kept}<li class=share>Gone</ul><p>{kept}</p></div>",
        f"<table><tr><td class=ad>Gone<td>{kept}<tr><td>{kept}</table>",
        f"<table><tr><td>{kept}<tr><td class=ad>Gone</table>{kept}",
        f"<dl><dt class=ad>Gone<dd>{kept}</dl><p>{kept}",
        f"<main><div><aside>Gone</div><p>{kept}</p><p>{kept}</p></main>",
        f"<body><div><table class=sidebar><tr><td>Gone</div><p>{kept}</p><p>{kept}</p>",
        f"<html><head><title>Gone</title><body><p>{kept}<p>{kept}",
        f"<div><p>{kept} <span class=ad>Gone</p><p>{kept}</p></div>",
        f"<div><nav><script>x = '</nav>'</script>Gone</nav><p>{kept}<p>{kept}</div>",
        f"<div><select><option>Gone<option>Gone</select><p>{kept}<p>{kept}</div>",
        f"<div class=ad>Gone<div>Gone</div><p>Gone<ul><li>Gone</ul>Gone</div><p>{kept}<p>{kept}",
    ):
        assert html_text.main_text(page).split("\n\n") == [kept] * 2, page


def test_attributes_that_only_look_like_boilerplate():
    kept, ad = "This is the paragraph that has to be kept, whatever its tags say.", "<div class=ad>Buy now, it is cheap!</div>"
    for tag in (
        'div style="overflow:hidden"', "div style='backface-visibility: hidden'", 'div aria-hidden="false"', 'div data-x="hidden"', 'div data-hidden="1"', "div title='display:none'", 'div hidden="until-found"',
        'article class="post category-social tag-search"', 'main id="search"', 'div class="content-with-sidebar"', 'section class="post social"', "div class=search",
    ):
        assert html_text.main_text(f"<body>{ad}<{tag}><p>{kept}</p><p>{kept}</p></{tag.split()[0]}>{ad}") == f"{kept}\n\n{kept}", tag
    for tag in ("div hidden", "div HIDDEN=''", 'div aria-hidden="true"', 'div style="color:red; display: none"', "main hidden", 'div role="search"', "div class=widget", "div id=x-sidebar"):
        assert html_text.main_text(f"<body><{tag}>Gone, though long enough to be text.</{tag.split()[0]}><p>{kept}</p><p>{kept}</p>") == f"{kept}\n\n{kept}", tag
    assert html_text.main_text(f"<body><div class=ad>{kept}</div><article><p>Short.</p></article>") == "Short."


def test_pages_on_odd_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 4 and [r.text for r in got if r.page_id == 2] == [""]


MARKS = st.sampled_from([*chat.CONTROL, "\\", "<", "s>", "[", "INST]", "a", "\n", "é"])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "[AS]"]), st.lists(MARKS, max_size=8).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_chats_read_back(turns):
    text, loss, rewrites = chat.format_conversation(turns)
    assert chat.read_back(text) == turns and not rewrites
    assert [chat.unescape(text[s:e]) for s, e in loss] == [t for r, t in turns if r == "assistant"]
    assert not any(c in chat.escape(t) for _, t in turns for c in chat.CONTROL)


def test_templates_that_rewrite_history_are_found():
    def render(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t.split('</think>')[-1]}\n" for i, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "<think>long</think>a"), ("user", "r")]
    assert [x[4] for x in chat.spans(turns, render)] == [False, False, True]
    assert chat.format_conversation(turns[:2], render)[2] is False


def test_long_conversations_are_linear():
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(400)]
    text, loss, _ = chat.format_conversation(turns)
    assert [chat.unescape(text[s:e]) for s, e in loss] == [t for r, t in turns if r == "assistant"]


def test_templates_of_any_kind_see_whole_prefixes():
    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(101)]

    def numbered(x):
        return "".join(f"<{i}:{r}>{t}\n" for i, (r, t) in enumerate(x))

    text, loss, rewrites = chat.format_conversation(turns, numbered)
    assert not rewrites and [text[s:e] for s, e in loss] == [t for r, t in turns if r == "assistant"]

    def strict(x):
        assert all(r == ("user" if i % 2 == 0 else "assistant") for i, (r, _) in enumerate(x))
        return numbered(x)

    assert chat.format_conversation(turns, strict) == (text, loss, False)
    assert chat.format_conversation(turns, lambda x: numbered((r, t.upper() if i == 20 and len(x) > 90 else t) for i, (r, t) in enumerate(x)))[2]


def test_chats_on_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 0, "user", "</s>[INST] ok [/INST]"), (3, None, "assistant", "")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 2, 2: 2, 3: 1, None: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest() and got[1].loss_chars == 1
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.example.com/en/1", ""), (2, "http://EXAMPLE.com/en/7?x", None), (3, "http://plain.test/p", link.format("http://a.example.com/en/1")),
        (4, "http://q.test/r?x=1#f", '<meta http-equiv="refresh" content="0; url=/s">'), (5, "http://q.test/s", link.format("http://b.example.com/en/7")),
        (6, "http://x.com/en/9", link.format("http://b.example.com/en/7")), (7, None, "canonical"), (8, "no scheme", ""), (8, "no scheme", ""), (9, "http://d.net/de/1", ""), (10, "http://a.org/en/", ""),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v.verdict for k, v in got.items()} == {1: "block", 2: "allow", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "block", 10: "allow"}
    assert got[1].rule == "com/en/" and got[2].rule == "example.com/en/7" and got[3].rule is None and got[7].host == got[7].path == ""
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def url_rows(rng):
    hosts = ["a.com", "b.example.com", "c.net", "x.example.net", "d.org", "plain.test", "Other.test"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'p'])}/{rng.randrange(6, 9)}{rng.choice(['', '?q=1', '#f'])}" for _ in range(120)]
    links = ['<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">', "<p>{}</p>"]
    rows = [(i, u, rng.choice(links).format(rng.choice([*urls, "/en/7", "9", "//c.net/p/1"])) if rng.random() < 0.4 else "") for i, u in enumerate(urls)]
    return rows + [(500, None, "x"), (501, "no scheme", None), (502, "http://h.test", links[0].format("?z=1&amp;y=2")), (502, "http://h.test", "")]


def test_alias_verdicts_equal_brute_force_and_sql(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F
    from streamframe.llm.queries import ORACLES

    rng = random.Random(17)
    for k in range(3):
        rows = url_rows(rng)
        pages = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "page_id long, url string, html string, host int, d string, node long")
        got = sorted(map(tuple, url_filter.judge(pages).collect()), key=str)
        edges = [tuple(r) for r in url_filter.edges(pages).collect()]
        node = {r.page_id: (r.n, r.h, r.p) for r in pages.select("page_id", url_filter.node(F.col("url")).alias("n"), *[c.alias(x) for x, c in zip("hp", url_filter.parts(F.col("url")))]).collect()}
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

        def rule(host, path):
            fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
            return max(fits, key=lambda r: len(r.text), default=None)

        def verdict(n, host, path):
            own = rule(host, path)
            if own:
                return own.allow
            todo, seen = [n], {n}
            while todo:
                for m in near.get(todo.pop(), ()):
                    if m not in seen:
                        seen.add(m)
                        todo.append(m)
            allows = [r.allow for m in seen if m in near for r in [rule(re.split("[/?]", m)[0], "/" + m.partition("/")[2].split("?")[0])] if r]
            return max(allows, default=True)

        want = [(i, node[i][1], node[i][2], getattr(rule(*node[i][1:]), "text", None), "allow" if verdict(*node[i]) else "block") for i, *_ in rows]
        assert got == sorted(want, key=str)
        con = duckdb.connect()
        pages.select("page_id", "url", "html").write.parquet(str(tmp_path / f"p{k}"))
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p{k}/*.parquet'")
        assert sorted(con.sql(ORACLES["op8_url_filters"]).fetchall(), key=str) == got


@pytest.mark.parametrize("url, host, path", [("HTTP://A.b:80/c/d?e#f", "a.b:80", "/c/d"), ("x://y", "y", ""), ("a://b://c/d", "b:", "//c/d"), ("http://h?q", "h", ""), ("", "", ""), ("://h/#p", "h", "/")])
def test_url_parts(spark, url, host, path):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(url,)], "u string").select(*[c.alias(n) for n, c in zip("hp", url_filter.parts(F.col("u")))]).first()
    assert (got.h, got.p) == (host, path)
