"""Operators on single rows: URL filter, quality rules, BPE, HTML, language, chat."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quietgrove.llm import bpe, chat, html_text, language_id, quality_rules, url_filter

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RULES = [url_filter.UrlRule("allow", "org"), url_filter.UrlRule("block", "example.org", "/es/")]


def test_url_filter(spark):
    urls = ["https://A.Example.org/es/1", "http://b.org?x=1", "http://www.bad.com/p/?utm_source=x&b=2&a=1#f",
            "http://bad.com:80/p?a=1&b=2", "http://good.com/p", None, "", "no host", "://", "http://x.com/%41?"]
    # clashing extra columns, repeated rows
    rows = spark.createDataFrame([(i, u, f"v{i}", "k", "b") for i, u in enumerate(urls + urls[:3])],
                                 "id int, url string, verdict string, key string, block string")
    listed = spark.createDataFrame([("http://bad.com/p?b=2&a=1",), (None,), ("nonsense",),
                                    ("http://bad.com/p?b=2&a=1",)], "url string")
    out = url_filter.filter_urls(rows, listed, RULES)
    assert sorted(out.columns) == sorted(["id", "url", "key", "block", "host", "path", "rule", "verdict", "listed"])
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert len(got) == len(urls) + 3
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1] == ("b.org", "", None, "allow")
    assert got[2] == ("www.bad.com", "/p/", None, "block") and got[3][3] == "block"
    assert got[4][3] == "allow" and got[5] == ("", "", None, "allow") == got[6] == got[7] == got[8]
    empty = url_filter.filter_urls(rows, listed.limit(0), RULES)
    assert empty.where("listed").count() == 0 and empty.count() == len(got)
    assert url_filter.filter_urls(rows.limit(0), listed, RULES).count() == 0


def test_url_filter_full_filter_stays_exact(spark):
    """One block for thousands of keys lets everything pass to the join, which decides alone."""
    listed = spark.range(3000).select(F.concat(F.lit("http://l.com/"), "id").alias("url"))
    rows = spark.range(6000).select("id", F.concat(F.lit("http://l.com/"), "id").alias("url"))
    out = url_filter.filter_urls(rows, listed, max_blocks=1)
    assert out.where("verdict = 'block'").agg(F.count("*"), F.max("id")).first()[:] == (3000, 2999)


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


def test_quality_measures(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n\t ", "a b c", "x y z v w " * 5, "a\na\n a\n\n\na", "é|ü #a $b 日本 𝄞", "a" * 5000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d\t", "# "]) for _ in range(rng.randint(0, 80)))
              for _ in range(40)]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "id int, text string, n_words string")
    out = {r["id"]: r for r in quality_rules.measures(rows).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"]) == plain_measures(t), t
    assert quality_rules.measures(rows.limit(0)).count() == 0


def test_quality_verdict_does_not_depend_on_order(spark):
    good = "the quick brown fox jumps over one lazy dog and runs home again"
    rows = spark.createDataFrame(
        [(0, good), (1, None), (2, "few words"), (3, good + " #" * 9), (4, "1 2 3 4 5 6 7 8 9 10 11 12"),
         (5, ("same line with six words\n") * 6), (6, good)], "id int, text string")
    kept = {r["id"] for r in quality_rules.judge(rows).where("kept").collect()}
    assert kept == {0, 6}
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        by = quality_rules.cascade(F.col("text"), rules)
        assert {r["id"] for r in rows.where(by.isNull()).collect()} == kept
    assert quality_rules.judge(rows.limit(0)).count() == 0
    found = quality_rules.estimate(rows)
    assert {e.rule.name for e in found} == {r.name for r in quality_rules.RULES}
    order = quality_rules.ordered([quality_rules.Estimate(r, c, s) for r, c, s in
                                   zip(quality_rules.RULES, (1, 1, 4, 1, 2, 1), (.1, .9, .9, 0, .4, .5))])
    assert [r.name for r in order][:3] == ["repeated_words", "few_letters", "symbols"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BYTE_BPE)


def test_bpe_trees_match_the_library(library):
    small = bpe.ByteBpe(BYTE_BPE, leaf=16)
    rng = random.Random(3)
    signs = ["abcdefghijklmnop", "aab", "éèaüß", "!?#$%&'", "0123456789", "  \n\t x", "中文字日本",
             "ab cd  e\n\n'st<|endoftext|>"]
    for i in range(400):
        text = "".join(rng.choice(signs[i % len(signs)]) for _ in range(rng.randint(0, 300)))
        if i % 5 == 0:
            text += "<|endoftext|>" + text[:20]
        want = library.encode(text, add_special_tokens=False).ids
        assert small.encode(text) == want
        parts = [(n, k, small.encode_part(k, b)) for n, k, b in small.parts(text, 24)]
        assert small.assemble(parts) == want
        assert small.decode(want) == text


def test_bpe_on_tables(spark, library):
    texts = [None, "", "Hello world", "Hello world", "ab" * 40_000, "word " * 9_000, "x<|endoftext|>y"]
    rows = spark.createDataFrame([(i, t, [1], "b") for i, t in enumerate(texts)],
                                 "id int, text string, ids array<int>, __body string")
    coded = bpe.encode(rows, BYTE_BPE, long_text=1000)
    out = {r["id"]: r for r in bpe.decode(coded, BYTE_BPE).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert list(out[i]["ids"]) == library.encode(t or "", add_special_tokens=False).ids
        assert out[i]["decoded"] == (t or "") and out[i]["__body"] == "b"
    assert bpe.encode(rows.limit(0), BYTE_BPE).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">Other</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and you agree with it by the use of it.</div>
<div id="main"><h2>Title</h2><p>The quick brown fox is in the house &amp; it was on the roof of it all.
<p>Short&nbsp; one.<ul><li>first<li>second <b>bold</b></ul><table><tr><td>a</td><td>b</td></tr></table>
<script>var x = "<p>no</p>";</script><div class="ad">Buy the best of all and be happy with it for ever now</div></div>
<section class="comments"><p>The first comment is by a reader and it has the words of it all.</p></section>
<form>Name <input name=n></form><footer>c</footer></body></html>"""


def test_html(spark):
    want = ("Title\n\nThe quick brown fox is in the house & it was on the roof of it all.\n\nShort one."
            "\n\nfirst\n\nsecond bold\n\na b")
    rows = spark.createDataFrame([(0, PAGE, "x"), (1, None, "x"), (2, "", "x"), (3, "<p", "x"), (4, PAGE, "x"),
                                  (5, "<article><p>Tiny</p></article><p>Out</p>", "x"),
                                  (6, "<div>" * 3000 + "deep", "x")], "id int, html string, text string")
    out = {r["id"]: (r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()}
    assert out[0] == out[4] == (want, len(want))
    assert out[1] == out[2] == out[3] == ("", 0)
    assert out[5][0] == "Tiny"
    assert html_text.extract(rows.limit(0)).count() == 0


def test_html_layout_classes_do_not_drop_the_article():
    body = "<p>The quick brown fox is in the house and it was on the roof of it all with the others.</p>"
    text = "The quick brown fox is in the house and it was on the roof of it all with the others."
    for name in ("layout has-sidebar", "no-sidebar", "menu-open", "search-results", "widget-content",
                 "comments-open", "widget", "content comments"):
        for inner in (body, f"<article>{body}</article>", f"<main><div>{body}</div></main>"):
            page = f"<body><div class='ad'>Buy of the best</div><div class='{name}'>{inner}</div></body>"
            assert html_text.main_text(page) == text, (name, inner)
    page = f"<article>{body}<p class='related-work'>The work of others is in it.</p></article>"
    assert html_text.main_text(page) == text + "\n\nThe work of others is in it."
    # whole tokens still name parts, also if they hold more than the article
    for name in ("comments", "left-sidebar", "siteFooter", "widget-3", "x cookie-notice"):
        assert html_text.main_text(f"<article>{body}</article><div class='{name}'>{body * 3}</div>") == text
        assert html_text.main_text(f"<div>{body * 2}</div><div id='{name}'>{body}</div>") == f"{text}\n\n{text}"


def test_html_pages_of_other_languages():
    texts = {
        "it": ["Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la via era smarrita.",
               "Ogni essere umano nasce libero ed eguale in dignità e diritti, dotato di ragione e coscienza."],
        "ru": ["Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
               "Всё смешалось в доме Облонских, и жена узнала, что муж был в связи с бывшею гувернанткой."],
        "zh": ["人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 2,
               "人人有资格享有本宣言所载的一切权利和自由,不分种族、肤色、性别、语言、宗教、政治或其他见解。" * 2]}
    links = "<div>" + "".join(f"<a href='/{i}'>Altra pagina {i}</a> " for i in range(9)) + "</div>"
    for first, second in texts.values():
        page = f"<body>{links}<div><h2>T</h2><p>{first}</p><p>{second}</p></div>{links}</body>"
        got = html_text.main_text(page).split("\n\n")
        assert [first, second] == [b for b in got if b != "T"]
    # a block in another script lies on a page of a known language
    english = "The quick brown fox is in the house and it was on the roof of it all with the others."
    page = f"<p>{english}</p><p>{texts['ru'][0]}</p><p>{english}</p>"
    assert html_text.main_text(page).split("\n\n") == [english, texts["ru"][0], english]


def test_html_second_pass():
    block = html_text.Block
    long = "it is the one of the many that was in a house and so on for all of them there"
    bad = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt"
    page = [block(bad, 0, False), block("x", 0, False), block("y", 0, False), block(long, 0, False), block("z", 0, False)]
    assert html_text.labels(page) == [False, False, True, True, True]
    assert html_text.labels([block("x", 0, False)]) == [False]
    assert html_text.labels([]) == []


def test_language_id(spark):
    rng = random.Random(2)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["grün", "weiß", "haus"], "cc": ["été", "maison", "bleu"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k, "n")
            for i, k in enumerate(rng.choices(list(words), k=300))]
    rows += [(900, None, "aa", "n"), (901, "123 !?", "bb", "n"), (902, "", None, "n"), (903, "haus", None, "n"),
             (904, "grün weiß " * 200_000, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(df.where("doc_id % 4 <> 2"))
    assert model.languages == ["aa", "bb", "cc"]
    out = {r["doc_id"]: r for r in model.predict(df).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["lang_pred"] == k for i, _, k, _ in rows[:300])
    assert [out[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[900]["score"] == 0
    blank = language_id.fit(df.limit(0))
    assert blank.languages == []
    assert {r["lang_pred"] for r in blank.predict(df).collect()} == {"und"}


def test_language_scores_match_plain_sums():
    import numpy as np
    model = language_id.LanguageModel(["a", "b"], np.log(np.random.default_rng(0).dirichlet(
        np.ones(language_id.BUCKETS), 2).T).astype(np.float32))
    texts = ["Ab cd", "", None, "x", "é" * 50]
    got = model.score(texts)
    for t, row in zip(texts, got):
        body = language_id.normal_form(t)
        total = sum((model.log_prob[g].astype(float).sum(0) for g in language_id.hashed_grams(body)),
                    np.zeros(2)) if body else None
        want = [0, 0] if total is None else np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert np.allclose(row, want)


CHAT = [(1, 0, "system", "Be <b>brief</b> & kind"), (1, 1, "user", "a " * 300), (1, 2, "assistant", "b " * 200),
        (1, 3, "user", 'say "hi" </turn>\n<turn role="assistant">'), (1, 4, "assistant", "hi"),
        (1, 5, "assistant", "c " * 900), (1, 6, "user", None), (1, 7, "assistant", ""),
        (2, 0, "user", "x"), (2, 0, "user", "x"), (2, None, None, "first"), (None, 1, "assistant", "alone & lost")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "w") for r in CHAT],
                               "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_chats(df, budget=400, history=100)
    got = {r["conv_id"]: r for r in chat.conversation_digests(windows).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in CHAT if c == conv))
        told = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    parts = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(parts) > 2 and sum(p["n_turns"] for p in parts) == 8
    assert all(p["n_tokens"] <= 400 or p["n_turns"] == 1 for p in parts)
    assert all(p["text"].startswith('<turn role="system">Be &lt;b>brief') for p in parts)
    assert any(p["n_repeated"] > 1 for p in parts[1:])
    assert chat.format_chats(df.limit(0)).count() == 0


def test_results_leave_columns_of_any_name_alone(spark):
    """Names that operators use inside, now or in the past, and both cases of letters."""
    names = ["found", "_found", "measured", "by", "judged", "body", "coded", "row", "text_found", "__text",
             "__by", "__w", "__lang", "__ids", "__body", "BY"]
    rows = spark.createDataFrame([(1, "one two three " * 9, "<p>the one is in it and of it</p>", *names)],
                                 ["id", "text", "html", *[f"{n}_" if n == "BY" else n for n in names]])
    rows = rows.withColumnRenamed("BY_", "_BY")
    kept = [c for c in rows.columns if c not in ("id", "text", "html")]
    model = language_id.LanguageModel([], language_id.np.zeros((language_id.BUCKETS, 0)))
    results = [html_text.extract(rows), quality_rules.measures(rows), quality_rules.judge(rows), model.predict(rows),
               bpe.encode(rows, BYTE_BPE), bpe.encode(rows, BYTE_BPE, long_text=5),
               bpe.decode(bpe.encode(rows, BYTE_BPE), BYTE_BPE)]
    for out in results:
        assert set(rows.columns) <= set(out.columns)
        assert out.select(kept).collect() == rows.select(kept).collect()


def test_quality_order_follows_cost_and_can_be_fixed(spark):
    """Two rules that reject the same: the dear one is asked later; a stored order is kept to."""
    rows = spark.createDataFrame([(i, "word " * 60 + ("x" if i % 2 else "y")) for i in range(300)], "id int, text string")
    last = lambda w: F.element_at(w, -1) == "x"
    dear = quality_rules.Rule("dear", lambda t, w: last(w) & (F.length(F.array_join(F.transform(
        w, lambda x: F.sha2(F.concat(x, t), 512)), "")) > 0))
    cheap = quality_rules.Rule("cheap", lambda t, w: last(w))
    found = quality_rules.estimate(rows, (dear, cheap))
    assert [e.rejected for e in found] == [pytest.approx(0.5), pytest.approx(0.5)]
    assert found[0].seconds > 3 * found[1].seconds
    assert [r.name for r in quality_rules.ordered(found)] == ["cheap", "dear"]
    for order in (["dear", "cheap"], ["cheap", "dear"]):
        by = {r["rejected_by"] for r in quality_rules.judge(rows, (dear, cheap), order=order).collect()}
        assert by == {None, order[0]}
    with pytest.raises(ValueError):
        quality_rules.judge(rows, (dear, cheap), order=["dear"])


def test_language_of_letterless_texts_and_many_languages(spark):
    assert all(language_id.normal_form(t) == "" for t in ("½", "②", "²³", "Ⅻ 12", "_-", "́", None, ""))
    assert language_id.normal_form("A1b½C é्") == " a b c é् "
    rows = spark.createDataFrame([(i, f"wort{chr(97 + i % 26)} {chr(97 + i // 26)}satz ist hier", f"l{i}")
                                  for i in range(language_id.MAX_LANGUAGES + 1)], "doc_id int, text string, lang string")
    assert len(language_id.fit(rows.where("doc_id > 0")).languages) == language_id.MAX_LANGUAGES
    with pytest.raises(ValueError):
        language_id.fit(rows)
    odd = spark.createDataFrame([(1, "½"), (2, "②²³"), (3, "1 2")], "doc_id int, text string")
    model = language_id.fit(rows.where("doc_id > 0"))
    assert {tuple(r) for r in model.predict(odd).select("lang_pred", "score").collect()} == {("und", 0.0)}


GOOD = "The quick brown fox is in the house and it was on the roof of it all with the others."
WORDY = "it is the one of the many that was in a house and so on for all of them there"


def test_html_comments_adverts_and_teasers_go():
    article = f"<article><p>{GOOD}</p><p>{GOOD}</p></article>"
    want = f"{GOOD}\n\n{GOOD}"
    for extra in ("<section class='comments'><article class='comment'><p>{}</p></article></section>",
                  "<div class='comments-section'><p>{}</p></div>", "<ul class='comment-list'><li>{}</li></ul>",
                  "<div class='related'><article><p>{}</p></article></div>", "<div class='ad-container'><p>{}</p></div>",
                  "<div class='newsletter-box'><p>{}</p></div>", "<div id='related-posts'><p>{}</p></div>",
                  "<div class='share-buttons'><p>{}</p></div>", "<div class='cookie-bar'><p>{}</p></div>",
                  "<article hidden><p>{}</p></article>", "<article class='comment'><p>{}</p></article>",
                  "<div style='display:none'><article><p>{}</p></article></div>"):
        for page in (article + extra.format(WORDY), extra.format(WORDY) + article,
                     f"<main>{article}{extra.format(WORDY)}</main>"):
            assert html_text.main_text(page) == want, page
    # a named wrapper or article that is the page's own stays
    assert html_text.main_text(f"<div class='widget'>{article}</div>") == want
    assert html_text.main_text(f"<article class='post'><p>{GOOD}</p></article>") == GOOD
    assert html_text.main_text(f"<article class='related'><p>{GOOD}</p></article>") == GOOD


class Page:
    """A random page as a tree, and its blocks by recursion over that tree."""

    def __init__(self, rng):
        self.rng = rng
        self.tree = self.element(0)

    def element(self, depth):
        rng = self.rng
        tag = rng.choice(["div", "section", "article", "p", "span", "b", "nav", "footer", "header", "main", "form"])
        name = rng.choice(["", "", "", "x", "ad", "comments", "has-sidebar", "share-buttons", "menu left", "comment-list"])
        hidden = rng.random() < 0.05
        plain = tag in ("p", "span", "b")
        inner = []
        for _ in range(rng.randint(1, 4)):
            if depth < 5 and rng.random() < 0.6 and not plain:
                inner.append(self.element(depth + 1))
            else:
                inner.append(" ".join(rng.choices(GOOD.split() + ["lorem", "ipsum"], k=rng.randint(1, 12))) + " ")
        return tag, name, hidden, inner

    def text(self, node):
        if isinstance(node, str):
            return node
        tag, name, hidden, inner = node
        attributes = (f" class='{name}'" if name else "") + " hidden" * hidden
        return f"<{tag}{attributes}>" + "".join(map(self.text, inner)) + f"</{tag}>"

    def hard(self, node, in_article):
        return node[0] in ("nav", "footer", "form") or node[2] or node[0] == "header" and not in_article

    def named(self, node, in_article):
        part = node[1] in ("ad", "comments", "share-buttons", "menu left", "comment-list")
        return part and node[0] != "main" and not self.hard(node, in_article)

    def weight(self, node, in_article=False):
        if isinstance(node, str):
            return html_text._weight(node)
        inside = in_article or node[0] in ("article", "main")
        return 0 if self.hard(node, in_article) else sum(self.weight(c, inside) for c in node[3])

    def articles(self, node, path=(), in_article=False):
        if isinstance(node, str) or self.hard(node, in_article):
            return []
        path = (*path, node) if self.named(node, in_article) else path
        if node[0] == "article":
            return [(node, path, in_article)]
        inside = in_article or node[0] == "main"
        return [a for c in node[3] for a in self.articles(c, path, inside)]

    def parts(self, node, in_article=False):
        if isinstance(node, str) or self.hard(node, in_article):
            return []
        inside = in_article or node[0] in ("article", "main")
        below = [p for c in node[3] for p in self.parts(c, inside)]
        return below + [(node, in_article)] * self.named(node, in_article)

    def blocks(self):
        found = self.articles(self.tree)
        if found:
            weights = [self.weight(a, inside) for a, _, inside in found]
            kept = [id(p) for p in found[weights.index(max(weights))][1]]
        else:
            total = self.weight(self.tree)
            kept = [id(p) for p, inside in self.parts(self.tree) if 2 * self.weight(p, inside) > total]
        out, words = [], []

        def close(in_article):
            text = " ".join("".join(words).split())
            if text:
                out.append((text, in_article))
            words.clear()

        def walk(node, in_article):
            if isinstance(node, str):
                words.append(node)
                return
            if self.hard(node, in_article) or self.named(node, in_article) and id(node) not in kept:
                if node[0] in ("span", "b"):
                    words.append(" ")
                else:
                    close(in_article)
                return
            inside = in_article or node[0] in ("article", "main")
            block = node[0] not in ("span", "b")
            if block:
                close(in_article)
            for child in node[3]:
                walk(child, inside)
            if block:
                close(inside)

        walk(self.tree, False)
        close(False)
        return out


def test_html_blocks_equal_a_recursion_over_the_tree():
    rng = random.Random(9)
    kept = 0
    for _ in range(1500):
        page = Page(rng)
        want = page.blocks()
        got = html_text.blocks(page.text(page.tree))
        assert [(b.text, b.in_article) for b in got] == want, page.text(page.tree)
        kept += len(want)
    assert kept > 1000


def test_html_takes_linear_time_and_whole_pages():
    import time
    for size in (20_000, 80_000):
        pages = ["<div>" * size + GOOD, "<b>" * size + f"<p>{GOOD}</p>" * 9, "<b>" * size + "<div>x</div>" * size,
                 "<article>" * size + GOOD, "<article class=comment>" * size + GOOD, "<li>" * size, "<a>" * size,
                 "</b></i></div>" * size, "<ul class=menu><li>" * size, "<p><i>" * size]
        began = time.thread_time()
        for page in pages:
            html_text.main_text(page)
        took = time.thread_time() - began
        first = took if size == 20_000 else first
    assert took < 12 * first
    body = [f"{GOOD} Number {i}." for i in range(50_000)]
    page = "<main>" + "".join(f"<p>{b}</p>" for b in body) + "</main>"
    assert len(page) > 5_000_000 and html_text.main_text(page) == "\n\n".join(body)
