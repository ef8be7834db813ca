"""Parts of the operators without Spark, against plain versions."""

import itertools
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from tidewatch.llm import bpe, chat, common, html_text, language_id, line_dedup, ngram_join, packing, quality_model


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32 - 1))
def test_sets_of_three_quarters_share_a_key(n, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    change = rng.integers(0, n // 3 + 1)
    b = np.unique(np.concatenate((a[rng.permutation(len(a))[: len(a) - rng.integers(0, change + 1)]], rng.integers(0, 2**63, change).astype(np.uint64))))
    both = len(np.intersect1d(a, b))
    if len(b) and 4 * both >= 3 * (len(a) + len(b) - both):
        assert set(ngram_join.signatures(a)) & set(ngram_join.signatures(b))
        common = np.unique(np.concatenate((a[:: 1 + seed % 3], b[: n // 2])))
        assert set(ngram_join.signatures(a, common)) & set(ngram_join.signatures(b, common))
        differ = len(a) + len(b) - 2 * both
        assert ngram_join.sketch_distance(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)) <= differ <= ngram_join.most_different(len(a), len(b))
        assert np.bitwise_count((ngram_join.parity_sketch(a) ^ ngram_join.parity_sketch(b)).view(np.uint64)).sum() <= differ


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "A b C d", "a b c d e", "x " * 50, "É é É é É a"])
def test_shingles(text):
    assert len(ngram_join.shingle_hashes(text)) == len(shingles(text))
    assert (ngram_join.shingle_hashes(text) == ngram_join.shingle_hashes((text or "").replace("A", "a"))).all()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    found = line_dedup.PerfectHash.build(keys).find(keys)
    assert sorted(found) == list(range(len(keys)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_best_fit_fills_no_bin_beyond_capacity(lengths):
    bins = packing.best_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= max(1, 2 * sum(lengths) / 100 + 1)


@pytest.fixture(scope="module")
def tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    return Library.from_file(path), bpe.Tokenizer(path)


TEXTS = ["", "<|endoftext|> Hi<|startoftext|>x", "ΣΑΣ ὈΔΥΣΣΕΎΣ İstanbul ǅ", "a\x1cb\x1d \x85 c d", "naïve café 日本語 テキスト 1234 ½ ² Ⅷ", "don't WE'LL it's '''s", "😀👩‍👩‍👧 ok", "x" * 5000, "aaaa" * 999, "\x00\x01", "नमस्ते", "Ꟛ꟎ x"]


@pytest.mark.parametrize("text", TEXTS)
def test_encoding_is_the_library_s(tokenizers, text):
    library, own = tokenizers
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids
    assert own.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)


def test_encoding_random_texts(tokenizers):
    library, own = tokenizers
    rng = random.Random(1)
    for _ in range(800):
        text = "".join(rng.choice("aeionrstlhgdAE '’.,!1Éßñ\n\tàæøΣσς日Ⅳ²") for _ in range(rng.randrange(60)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def plain_cost(given, costs):
    """Least price over all choices, by trying them all."""

    def go(i, state):
        if i == len(given):
            return chat.insertions(state, costs).get(chat.ASSISTANT, (0, ()))[0] if given else 0
        best = 10**9
        for middle, (price, _) in chat.insertions(state, costs).items():
            for after in chat.NEXT[middle]:
                change = 0 if given[i] == after else costs.relabel if given[i] else costs.name
                best = min(best, price + change + go(i + 1, after))
        if state:
            change = 0 if given[i] == state else costs.relabel if given[i] else costs.name
            best = min(best, costs.merge + change + go(i + 1, state))
        return best

    return go(0, chat.NOTHING)


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(merge=9, relabel=1, insert=2), chat.Costs(merge=1, relabel=7, insert=8)])
def test_role_repair_is_cheapest_and_legal(costs):
    solver = chat.Repair(costs)
    for n in range(1, 5):
        for given in itertools.product(range(4), repeat=n):
            first, last = solver.borders([solver.product(list(given))])
            path = solver.path(list(given), first, last)
            assert sum(s.cost for _, s in path) + solver.closing[last][0] == plain_cost(given, costs)
            state = chat.NOTHING
            for after, step in path:
                for k in (*step.inserted, *(() if step.action == "merge" else (after,))):
                    assert k in chat.NEXT[state]
                    state = k
                assert state == after
            # cutting the turns anywhere gives the same price
            for cut in range(1, n):
                a, b, c = solver.borders([solver.product(list(given[:cut])), solver.product(list(given[cut:]))])
                both = solver.path(list(given[:cut]), a, b) + solver.path(list(given[cut:]), b, c)
                assert sum(s.cost for _, s in both) == sum(s.cost for _, s in path)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>x</ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p>One  two<br>three <b>four<p>Five &lt;six&gt;<div class="share-buttons">Share</div><!-- <p>no</p> --></article>
<section class="comments"><article>me too</article></section><footer>F</footer></body></html>"""


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain  words", "plain words"), (PAGE, "Head & line\nOne two three four\nFive <six>"),
    ("<body><p>a<p>b<form>c</form>", "a\nb"), ("<main><p>a</main><p>b", "a"), ("<p>unclosed <b", "unclosed <b"),
    ("<div>" * 3000 + "deep", "deep"), ("<article><p>a</article><article><p>b</article>", "a\nb"), ("<p title='>'>a</p>", "a"),
])
def test_html(html, text):
    assert html_text.Page(html).text() == text


@pytest.mark.parametrize(("html", "text"), [
    ('<div class="content has-sidebar"><article><p>a</article></div>', "a"), ('<div class="post no-comments"><p>a</div>', "a"), ('<article class="post no-comments"><p>a</article>', "a"),
    ('<article><h2 id="side-effects">a</h2><section id="related-work"><p>b</section><section id="notice-period">c</section><h3 id="comments">d</h3></article>', "a\nb\nc\nd"),
    ('<div class="sidebar"><main><p>a</main></div>', "a"), ('<div class="widget"><article>a</article></div><div class="widget">b</div>', "a"),
    ('<main><p>a<div class="comments"><article>me too</article></div></main>', "a"), ('<div id="comments"><article>a</article></div><div class="sidebar_box nav">b</div>', "a"),
    ('<article>a<div class="x share_buttons">b</div><ul id="related-posts"><li>c</ul><article class="comment" id="comment-7">d</article></article>', "a"),
])
def test_html_parts_by_name(html, text):
    assert html_text.Page(html).text() == text


@pytest.mark.parametrize(("html", "text"), [
    ('<p title="the hidden river">a</p>', "a"), ('<p><a title="a hidden gem" href=x>a</a>', "a"), ('<div data-note="x hidden y">a</div>', "a"), ("<div data-note=' class=ad hidden '>a</div>", "a"),
    ('<p title="x hidden>a', "a"), ("<div data-hidden title=hidden>a</div>", "a"),
    ("<p hidden>a</p>b", "b"), ('<p title="x"hidden>a</p>b', "b"), ("<div ARIA-HIDDEN = 'true'>a</div>b", "b"), ('<div aria-hidden="false">a</div>', "a"), ('<p title="a>b" class=ad hidden="">a</p>b', "b"),
])
def test_html_attributes(html, text):
    assert html_text.Page(html).text() == text


@pytest.mark.parametrize(("html", "text"), [
    ('<form id="aspnetForm"><nav>n</nav><article><p>a<input><button>go</button></article><aside><article>teaser</article></aside></form>', "a"),
    ("<div hidden><main><p>a</main></div>", "a"), ("<div hidden><article>old copy</article></div><article>a</article>", "a"), ('<div role="dialog"><article>a</article></div>', "a"),
    ("<aside><article>teaser</article></aside><main><p>a</main>", "a"), ("<footer><article>a</article></footer>", "a"), ("<fieldset><main>a</main></fieldset>b", "a"),
    ("<article>teaser</article><main><p>whole text</main>", "whole text"), ("<main><article>long enough text</article><p>more</main>", "long enough text"),
    ("<main><article>a</article><p>the text beside it</main>", "a\nthe text beside it"), ("<main><p>x</main><article>the whole article</article>", "the whole article"),
    ('<article><ul><li class="social">a</ul><div class="share"><p>b</div><p class="comment">c<div class="promotion">d</div></article>', "a\nb\nc\nd"),
    ('<article>a<div class="share"><a href=x>b</a></div><ul class="comments"><li>c</ul><div class="advert"><p>d</div></article>', "a"), ('<div class="share"><p>b</div><p>a', "a"),
])
def test_html_what_holds_the_text_stays(html, text):
    assert html_text.Page(html).text() == text


@pytest.mark.parametrize("n", [2, 199, 200, 1000])
def test_html_text_between_articles(n):
    html = "".join(f"<article><p>a{i}<article>b{i}</article></article><p>between" for i in range(n))
    assert html_text.Page(html).text() == "\n".join(f"a{i}\nb{i}" for i in range(n))


def test_code_words_differ():
    for n in (1, 2, 3, 4, 5, 12):
        code = language_id.codewords(n)
        assert code.shape[0] == n
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))


def test_features_of_texts_without_letters():
    assert language_id.features([None, "", " 12 !?", "ab"]).sum(1).astype(bool).tolist() == [False, False, False, True]


def test_pieces_are_cut_by_rows_and_bytes():
    texts = ["x" * n for n in (10, 10, 300, 10, 10, 10, 0, 10)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(9))], names=["text", "n"])
    assert [p.column("n").to_pylist() for p in common.pieces([batch], 3, 100)] == [[0, 1], [2], [3, 4, 5], [6, 7, 8]]
    for rows, size in ((3, 100), (100, 60), (1, 10**9), (100, 10**9)):
        parts = list(common.pieces([batch, batch.slice(2, 5)], rows, size))
        assert [x for p in parts for x in p.column("n").to_pylist()] == [*range(9), *range(2, 7)]
        assert all(p.num_rows <= rows and (p.num_rows == 1 or common.row_bytes(p).sum() <= size) for p in parts)
    assert list(common.pieces([batch.slice(0, 0)], 3, 100)) == []


def test_long_texts_in_stretches(monkeypatch):
    texts = ["abcdefghij" * 30, "", None, "é𝒳" * 40, "z"]
    whole = np.concatenate([quality_model.gram_codes(t) for t in texts if t])
    monkeypatch.setattr(quality_model, "STRETCH", 7)
    assert np.concatenate(list(quality_model.gram_stretches(texts))).tolist() == whole.tolist()
