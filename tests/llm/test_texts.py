import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from llm_fixtures import frame, odd, words

from scenaria.llm import html_extract as H
from scenaria.llm import piece_tokens as P
from scenaria.llm.kd_shards import kd_shards


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary()


ODD = ["", " ", "  a  b\n\tc ﬁ ", "▁x ▁▁ y", "漢字🙂 é", "a" * 300, "x" * 47 + " " + "yz" * 40, "\0q\0", "\U0010ffff▁", "The  Word\r\n"]


def test_without_dropout_the_pieces_are_the_models(spark, vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [t for t in ODD if "▁" not in t and "\0" not in t]
    for t, ids in zip(texts, P.Encoder(vocabulary, 1, 0.0, 4).encode(texts)):
        assert ids.tolist() == (sp.encode(t) if t else [])


def test_dropout_varies_by_seed_and_decodes_losslessly(spark, vocabulary):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ODD
    cut = [P.Encoder(vocabulary, seed, 0.1, 4).encode(texts) for seed in (1, 2, 1)]
    assert all(P.decode(vocabulary, ids) == t for run in cut for ids, t in zip(run, texts))
    assert all((a == b).all() for a, b in zip(cut[0], cut[2]) if len(a) == len(b))
    assert sum(len(a) != len(b) or (a != b).any() for a, b in zip(cut[0], cut[1])) > 50
    plain = P.Encoder(vocabulary, 1, 0.0, 4).encode(texts)
    assert sum(map(len, cut[0])) > 1.02 * sum(map(len, plain))


def test_agendas_together_and_alone_agree(vocabulary):
    rng = random.Random(3)
    units = [P.MARK + "".join(rng.choice("thereandingouéß漢x1") for _ in range(rng.randrange(0, 45))) for _ in range(400)]
    units.sort(key=len)
    for dropout in (0.0, 0.3):
        flat, count = P._cut_many(vocabulary, units, 99, dropout)
        for u, part in zip(units, np.split(flat, np.cumsum(count)[:-1])):
            assert part.tolist() == P._cut_one(vocabulary, u, 99, dropout).tolist()


def test_each_occurrence_of_a_word_is_drawn_on_its_own(vocabulary):
    texts = ["the responsibility " * 300 + str(k) for k in range(3)]
    encoder = P.Encoder(vocabulary, 1, 0.1)
    got = encoder.encode(texts)
    ways = {x.tolist() and tuple(x.tolist()) for t, ids in zip(texts, got) for x in np.split(ids, np.flatnonzero(
        [vocabulary.spelled[i].startswith(b" ") for i in ids.tolist()]))[1:] if b"".join(vocabulary.spelled[i] for i in x.tolist()) == b" responsibility"}
    assert len(ways) > 12
    assert (got[0][:200] != got[1][:200]).any()
    # the remembered traces give what each occurrence's own agenda gives
    texts += [t * 3 for t in ODD]
    counts = np.array([len(encoder.units(t)) for t in texts])
    keys = np.split(encoder.keys(texts, counts), np.cumsum(counts)[:-1])
    for dropout in (0.1, 0.5):
        for t, own, ids in zip(texts, keys, P.Encoder(vocabulary, 1, dropout).encode(texts)):
            parts = [encoder.own if u is None else P.spelled(vocabulary, P._cut_one(vocabulary, u, int(k), dropout))[0]
                     for u, k in zip(encoder.units(t), own)]
            assert ids.tolist() == [i for x in parts for i in x.tolist()]


def test_ranks_of_pairs_are_those_of_the_sorted_pairs(vocabulary):
    v = vocabulary
    rng = np.random.default_rng(4)
    left, right = np.concatenate([[v.pair // v.size, v.pair % v.size], rng.integers(0, v.size + 40, (2, 200_000))], axis=1)
    made = v.merge(left, right)
    want = np.where(made >= 0, v.rank[made], len(v.by_rank) - 1)
    assert (v.pair_ranks(left, right) == want).all()
    assert [v.rank_of_one(*p) for p in zip(left[::50].tolist(), right[::50].tolist())] == want[::50].tolist()
    assert len(v.cells) < 20 * len(v.pair)


def test_work_goes_by_distinct_units_and_long_units_take_no_array_a_pair(vocabulary, monkeypatch):
    seen, mixed = [], []
    walk, mix = P._Traces.walk, P.mix
    monkeypatch.setattr(P._Traces, "walk", lambda self, units, *rest: seen.append(len(units)) or walk(self, units, *rest))
    monkeypatch.setattr(P, "mix", lambda h: mixed.append(1) or mix(h))
    ids = P.Encoder(vocabulary, 1, 0.1).encode(["the responsibility " * 500])[0]
    assert P.decode(vocabulary, ids) == "the responsibility " * 500
    assert seen == [3]  # two words and the mark at the end
    mixed.clear()
    text = "the\nresponsibility\n" * 500  # only spaces end a unit
    assert P.decode(vocabulary, P.Encoder(vocabulary, 1, 0.1).encode([text])[0]) == text
    assert len(mixed) < 20


def test_tokens_of_odd_rows(spark, vocabulary):
    df = odd(spark)
    got = P.token_digests(df).collect()
    assert len(got) == df.count() and all(r.lossless for r in got) and sum(r.n_tokens == 0 for r in got) == 3
    out = P.encoded(df)
    assert out.columns == [*[c for c in df.columns if c != "tokens"], "tokens"]
    for r in out.collect():
        assert P.decode(vocabulary, np.array(r.tokens, int)) == (r.text or "")
    assert P.encoded(df.limit(0)).collect() == [] and P.token_digests(df.limit(0)).collect() == []


def test_shards_are_near_equal_and_keep_copies_together(spark):
    rng = random.Random(4)
    texts = [" ".join(words(rng, rng.choice([5, 20, 60, 200]))) for _ in range(3000)]
    texts += [texts[0]] * 30 + [texts[1]] * 900  # the second group is far larger than a shard's tolerance
    df = frame(spark, texts).repartition(6)
    rows = kd_shards(df, shards=10).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in rows)
    total = [sum(r.size for r in rows if r.shard == s) for s in range(10)]
    assert max(total) - min(total) < 0.06 * sum(total) / 10
    for s in range(10):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    of_copies = [r.shard for r in rows if texts[r.doc_id] == texts[0]]
    assert len(set(of_copies)) == 1


def test_shards_of_odd_rows(spark):
    df = odd(spark)
    rows = kd_shards(df, shards=4).collect()
    assert len(rows) == df.count() and all(0 <= r.shard < 4 for r in rows)
    assert sum(r.size == 16 for r in rows) == 3  # null and empty texts
    assert kd_shards(df.limit(0), shards=4).collect() == []
    assert {r.shard for r in kd_shards(df, shards=1).collect()} == {0}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body class="single has-sidebar">
<div id="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="wrap"><div class="post-%d content"><h1>Title &amp; more</h1><p>First <i>para</i>graph of %s
 with  text&nbsp;here.<p>Second<br>line <form><input><label>Mail</label></form><ul><li>One<li>Two</ul><div class="ad-slot">Buy</div></div>
<div class="x9">%s</div><section id="comments"><article class="comment">Nice post, a long reader comment about it.</article></section></div>
<aside>side</aside><footer>&copy; foot</footer>"""


def test_a_page_on_its_own():
    want = "Title & more First paragraph of words with text here. Second line One Two"
    assert H.extract(PAGE % (7, "words", ""), []) == want
    for source, text in (("", ""), ("<", "<"), ("plain  text", "plain text"), ("<div>a<div>b</div>c</div>", "a b c"), ("&lt;b&gt;", "<b>"),
                         ("<b>" * 500 + "x", "x"), ("<p>x</p", "x"), ("<script>a", "")):
        assert H.extract(source, []) == text


def test_host_consensus_leaves_unmarked_boxes_out(spark):
    rng = random.Random(5)
    body = [" ".join(words(rng, 40)) for _ in range(20)]
    # on a few pages an unmarked box is longer than the article, so the page alone would not leave it out
    box = [" ".join(words(rng, 400)) if i in (3, 11) else "" for i in range(20)]
    pages = [(i, f"http://h.example/{i}", PAGE % (i, body[i], box[i])) for i in range(20)] + [(20, None, None), (21, "http://h.example/x", ""), (21, "q", "<p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = H.main_text(df).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.page_id < 20:
            assert r.text == f"Title & more First paragraph of {body[r.page_id]} with text here. Second line One Two"
        assert r.n_chars == len(r.text)
    assert H.main_text(df.limit(0)).collect() == []


def test_nested_articles_and_hosts_with_two_templates_keep_their_text(spark):
    rng = random.Random(15)
    say = lambda n: " ".join(words(rng, n))
    lead, body, end = say(30), say(300), say(20)
    for outer in ("article", 'div class="post"'):
        page = f"<body><nav>x</nav><{outer}><h1>Title</h1><p>{lead}</p><div class=body><p>{body}</p></div><div class=end><p>{end}</p></div></{outer.split()[0]}>"
        assert H.extract(page, []) == f"Title {lead} {body} {end}"
    # twelve pages of one template, eight of another that has a small box at the path of the first
    box, text = [say(20) for _ in range(20)], [say(200) for _ in range(20)]
    pages = [(i, f"http://t.example/{i}", f"<body><div class=a><p>{text[i]}</p></div>" if i < 12 else
              f"<body><div class=a><p>{box[i]}</p></div><div class=w><div class=b><p>{text[i]}</p></div></div>") for i in range(20)]
    for r in H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert text[r.page_id] in r.text


def test_attribute_values_and_topics_of_an_article_are_no_boilerplate():
    for mark in ('style="overflow:hidden"', 'title="Hidden gems"', 'data-x="role=alert" data-hidden="true"', 'aria-hidden="false"', 'data-state=hidden'):
        assert H.extract(f"<body><div {mark}><p>Some words of the article.</p></div>", []) == "Some words of the article."
    assert H.extract('<body><a href="/hidden/y">gems</a> and words', []) == "gems and words"
    for off in ("hidden", "HIDDEN", 'hidden=""', "aria-hidden='true'", "role=search"):
        assert H.extract(f"<body><p>Words.</p><div {off}>gone</div>", []) == "Words."
    page = """<article><h1>T</h1><section id="discussion"><h2 id="related-work">Related work</h2><p>One two.</p></section><div class="search-results-article">
    Three.</div><section id="social-history"><p class="notice">Four.</p></section><div class="related-posts">x</div><ul class="share-buttons"><li>y</ul>
    <div id="cookie-notice">z</div></article>"""
    assert H.extract(page, []) == "T Related work One two. Three. Four."


def test_extraction_of_given_pages_equals_their_articles(spark):
    import html

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.main_text(df).collect()}
    for r in df.collect():
        inner = r.html[r.html.index("<article>") + 9:].partition("</article>")[0]
        inner = re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>|</?a[^>]*>", "", inner))
        assert got[r.page_id] == " ".join(html.unescape(inner).split())
