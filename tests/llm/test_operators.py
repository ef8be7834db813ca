"""Operators on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; against brute force."""

import collections
import functools
import itertools
import math
import pathlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ann, bpe, chat, html_text, language_id, line_dedup, ngram_join, packing, quality_model, queries, vector_join
from tidewatch.llm.graph import components

FOLDER = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, component_id long, n string, block string, version string, sig string, rep string"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long", path=None):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def groups(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2200)] + [(5, 5)]
    want = groups({x for e in edges for x in e}, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[k] == v for k, v in got.items())
    assert set(want) - set(got) <= {k for k, v in want.items() if list(want.values()).count(v) == 1}


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE "), (5, "one two")]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice((6, 30, 90, 300)))]
        for copy in range(6):
            own = text[:]
            for _ in range(copy * len(own) // 60):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((100 + base * 10 + copy, " ".join(own + ["tail"] * (copy % 2))))
    star = [rng.choice(words) for _ in range(120)]  # copies of a text that has a large id itself: the first copies are unlike each other
    for copy in range(25):
        own = star[:]
        for at in rng.sample(range(0, 120, 6), 2):
            own[at] = rng.choice(words)
        rows.append((300 + copy, " ".join(own)))
    rows.append((399, " ".join(star)))
    rows += [(500 + i, "same text for a large group of equal copies") for i in range(40)] + [(600, "w " * 30000)]
    texts = dict(rows)
    ids = [i for i, _ in rows]
    links = [(a, b) for a in ids for b in ids if a < b and sets(texts[a]) and 100 * len(sets(texts[a]) & sets(texts[b])) >= 75 * len(sets(texts[a]) | sets(texts[b]))]
    want = groups(ids, links)
    got = ngram_join.near_duplicates(frame(spark, [(*r, "en") for r in rows] + [(None, "one", "en")], CLASH)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {i: (len(sets(texts[i])), want[i]) for i in ids}
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(1, None)]
    twice = ngram_join.near_duplicates(frame(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (8, "A b c d e f")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in twice) == [(7, 7), (8, 7)]
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicate_links(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (3, "one"), (4, "ONE "), (5, "one two")]
    for base in range(6):
        text = [rng.choice(words) for _ in range(rng.choice((30, 90, 200)))]
        for copy in range(8):
            own = text[:]
            for _ in range(copy * len(own) // 400):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows += [(100 + base * 20 + copy, " ".join(own))] + [(110 + base * 20 + copy, " ".join(own).upper())] * (copy % 3 == 0)
    texts = dict(rows)
    want = {}
    first = {i: min(j for j in texts if sets(texts[j]) == sets(texts[i])) for i in texts if sets(texts[i])}
    for a, b in itertools.combinations(sorted(first), 2):
        s, t = sets(texts[a]), sets(texts[b])
        if 100 * len(s & t) >= 75 * len(s | t):
            key = tuple(sorted((first[a], first[b])))
            want[key] = want.get(key, 0) + 1
    got = ngram_join.near_duplicates(frame(spark, rows + [(None, "one")], CLASH), links_only=True).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["n_links"] for r in got} == want
    assert max(want.values()) > 1 and sum(a < b for a, b in want) > 60


def lines_by_hand(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = {}
    for i, text in rows:
        if i is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                holders.setdefault(k, []).append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("share_mb", [32, 0])
def test_line_dedup(spark, share_mb):
    rng = random.Random(2)
    pool = [f"This repeated line number {i} is long" for i in range(12)] + ["short", "ÄÖÜ äöü repeated ÄÖÜ line", " \t Blank ends of a Repeated line \v", ""]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(("", " ", "x")) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, pool[0]), (102, "\n\n"), (103, "z" * 200_000), (7, pool[1])]
    docs = frame(spark, [(*r, "en", "s", 3) for r in rows], CLASH)
    got = line_dedup.dedup_lines(docs, share_mb=share_mb, docs_per_probe=10)
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=str) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(docs, share_mb=share_mb, carry=["lang", "source"]).select("lang", "source").distinct().count() == 1
    assert line_dedup.dedup_lines(frame(spark, []), share_mb=share_mb).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, "Hello <|endoftext|> world"), (4, "word " * 5000), (4, "again"), (None, "no id"), (5, "é" * 700)] + [(10 + i, "some words here " * (i % 90)) for i in range(200)]
    got = packing.pack_documents(frame(spark, [(*r, "en") for r in rows], CLASH), path).collect()
    want = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        starts = [*([0] if cut else []), *range(cut, len(ids), 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= math.ceil(sum(w[3] for w in want) / 1024) + 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_packing_in_a_tree(spark):
    rng = random.Random(4)
    lengths = [rng.randrange(1, 100) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    got = packing.pack(items, 100, nearly=0, items_per_task=150).toPandas()
    assert sorted(got.uid) == list(range(3000))
    fill = got.assign(length=[lengths[u] for u in got.uid]).groupby("sequence_id").length.sum()
    assert fill.max() <= 100 and len(fill) <= 1.05 * sum(lengths) / 100 + 1
    apart = packing.pack(spark.createDataFrame([(i, 60) for i in range(1000)], "uid long, length long"), 100, items_per_task=100)
    assert apart.select("sequence_id").distinct().count() == 1000


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 12))
    x = np.concatenate((base, base[:20] + rng.normal(scale=0.12, size=(20, 12)), base[:10] * 3, base[:5] + rng.normal(scale=0.3, size=(5, 12))))
    rows = [(i * 7, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [float("inf")] + [1.0] * 11), (9005, [None] + [1.0] * 11), (9006, [1.0, 2.0]), (9007, [])]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = groups([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in np.argwhere(linked) if a < b])
    frame_ = spark.createDataFrame([(i, v, 0, "x") for i, v in [*rows, *odd, (None, rows[0][1])]], "vec_id long, embedding array<double>, label int, rep string")
    got = vector_join.near_vectors(frame_, block_rows=8).collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert {i: found[i] for i, _ in rows} == {i: (int(linked[k].sum()), want[i], want[i] == i) for k, (i, _) in enumerate(rows)}
    assert all(found[i] == (0, i, True) for i, _ in odd) and found[None] == (0, None, False) and len(got) == len(rows) + len(odd) + 1
    assert vector_join.near_vectors(frame_.limit(0)).count() == 0


def test_vectors_take_turns_and_are_written_twice(spark):
    """The tiles are sent in rounds of a bounded size; single precision stays so on disk; equal vectors are one class in either precision."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(220, 16)).astype(np.float32).astype(np.float64)
    x = np.concatenate((base, base[:60] + rng.normal(scale=0.1, size=(60, 16)), base[:40], base[200:] * 2))
    x[0, 3], x[280, 3] = 0.0, -0.0
    rows = [(i * 3, [float(v) for v in r]) for i, r in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = groups([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in np.argwhere(linked) if a < b])
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    old = set(shared.iterdir())
    out = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=4, round_bytes=1)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == {i: (int(linked[k].sum()), want[i]) for k, (i, _) in enumerate(rows)}
    links, = (p for p in shared.iterdir() if p not in old and p.name.startswith("vector-links-"))
    assert len(list(links.glob("turn=*"))) > 3
    old, n = set(shared.iterdir()), 4000
    wide = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(n, 64)).astype(np.float32))]
    assert vector_join.near_vectors(spark.createDataFrame(wide, "vec_id long, embedding array<float>")).where("n_links = 0").count() == n
    written = sum(f.stat().st_size for p in shared.iterdir() if p not in old for f in p.rglob("*.parquet"))
    assert written < 2.5 * n * 64 * 4


def test_search(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8))
    x[300:330] = x[300]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [float("nan")] * 8), (1300, [None] + [1.0] * 7), (1400, [1.0])]
    frame_ = spark.createDataFrame([(i, v, 1, "q") for i, v in [*rows, *odd, (None, rows[0][1])]], "vec_id long, embedding array<double>, label int, query_id string")
    got = ann.search(frame_, F.col("vec_id") % 100 == 0, rows_per_task=40, queries_per_task=2).toPandas()
    hits = total = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        assert own.vec_id.tolist() == own.sort_values(["score", "vec_id"]).vec_id.tolist()
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 10
        if q == 300:
            assert own.vec_id.tolist() == list(range(301, 311))
    assert hits / total >= 0.9 and set(got.query_id) == set(range(0, 900, 100))
    few = ann.search(frame_.where("vec_id in (0, 1, 2, 100)"), F.col("vec_id") % 100 == 0).toPandas()
    assert few.groupby("query_id").size().to_dict() == {0: 3, 100: 3}
    assert ann.search(frame_.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(frame_.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_language_id(spark):
    en, de = "the house and the river were quiet in the morning light", "der hund und die katze liegen auf dem alten teppich im haus"
    rows = [(i, f"{en} {i}", "en") for i in range(40)] + [(100 + i, f"{de} {i}", "de") for i in range(40)]
    tests = [(500, None, None), (501, "", "en"), (502, "12 !? 34", "en"), (503, "the morning river", None), (504, "die alte katze und der hund", "en"), (None, en, "de"), (505, en * 2000, None)]
    docs = frame(spark, rows + tests, CLASH)
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.fit(docs.where("doc_id < 500")), carry=["source"]).collect()}
    assert [got[i]["lang_pred"] for i in (500, 501, 502, 503, 504, None, 505)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["score"] == 0
    assert language_id.fit(docs.where("lang is null")) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    one = language_id.fit(docs.where("doc_id < 40"))
    assert {r["lang_pred"] for r in language_id.identify(docs.where("doc_id < 500"), one).collect()} == {"en"}
    assert language_id.identify(docs.limit(0), one).count() == 0


def test_language_id_held_out(spark):
    got = queries.QUERIES["op7_language_id"](spark, FOLDER).where("held_out").join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, total = got.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert total > 20 and right / total > 0.97


def by_hand(trusted, texts):
    """Interpolated modified Kneser-Ney of order 4, straight from its definition."""
    start = chr(quality_model.START)
    counts = [{} for _ in range(5)]
    for t in trusted:
        p = start * 3 + t
        for i in range(len(t)):
            counts[4][p[i : i + 4]] = counts[4].get(p[i : i + 4], 0) + 1
    for k in (3, 2, 1):
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    cuts = []
    for c in counts:
        n = [sum(1 for v in c.values() if v == k) for k in range(5)]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            cuts.append([min(max(d, 0.01), k) for d, k in ((1 - 2 * y * n[2] / n[1], 1), (2 - 3 * y * n[3] / n[2], 2), (3 - 4 * y * n[4] / n[3], 3))])
        else:
            cuts.append([0.5, 0.75, 0.9])
    after = {}
    for c in counts:
        for g, v in c.items():
            after.setdefault(g[:-1], []).append(v)

    @functools.cache
    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (len(counts[1]) + 1)
        own = after.get(g[:-1])
        if not own:
            return lower
        cut = lambda v: cuts[len(g)][min(v, 3) - 1]
        mine = counts[len(g)].get(g)
        return (mine - cut(mine) if mine else 0) / sum(own) + sum(map(cut, own)) / sum(own) * lower

    return [math.exp(-sum(math.log(p((start * 3 + t)[i : i + 4])) for i in range(len(t))) / len(t)) if t else None for t in texts]


def test_quality_model(spark):
    rng = random.Random(8)
    make = lambda: " ".join(rng.choice(("the", "old", "river", "runs", "to", "a", "wide", "sea")) for _ in range(rng.randrange(3, 25)))
    good, texts = [make() for _ in range(30)], [make(), "ZZ%% QQ&& xx", "", None, "a", "é日本 🙂"]
    model = quality_model.train(frame(spark, [(i, t, "en") for i, t in enumerate(good)]))
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)], CLASH)
    got = {r["doc_id"]: r["perplexity"] for r in quality_model.perplexities(quality_model.with_blocks(docs, "doc_id", "text", "lang"), model).collect()}
    want = by_hand(good, [(t or "").replace("🙂", chr(0xE000 + (ord("🙂") & 0xFFF))) for t in texts])
    for i, w in enumerate(want):
        assert (got[i] is None or math.isnan(got[i])) if w is None else got[i] == pytest.approx(w, rel=1e-9)


def test_quality_verdicts(spark):
    rng = random.Random(9)
    make = lambda: " ".join(rng.choice(("the", "old", "river", "runs", "to", "a", "wide", "sea")) for _ in range(30))
    rows = [(i, make(), "en" if i % 2 else None) for i in range(300)] + [(900, "%$ QX &&& ZZZ 77 ][ " * 9, "en"), (901, None, "en"), (902, "", None), (None, make(), "en"), (5, make(), "en")]
    docs, ids = frame(spark, rows, CLASH), spark.createDataFrame([(i,) for i in range(0, 200)], "doc_id long")
    got = {(r["doc_id"], r["lang"]): r["kept"] for r in quality_model.quality(docs, ids).collect()}
    assert not got[900, "en"] and not got[901, "en"] and not got[902, None]
    assert sum(not v for v in got.values()) <= 3 + 0.05 * 300
    nothing = quality_model.quality(docs, ids.limit(0)).where("kept").count()
    assert nothing == len(rows) - 2
    assert quality_model.quality(docs.limit(0), ids).count() == 0


def test_bpe(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, "Hello WORLD's <|endoftext|>"), (3, "twice"), (None, "x"), (4, "ab" * 50_000)]
    got = bpe.decode(bpe.encode(frame(spark, rows, CLASH), path), path).collect()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    assert sorted(((r["doc_id"], list(r["ids"]), r["decoded"]) for r in got), key=str) == sorted(((i, w, library.decode(w, skip_special_tokens=False)) for (i, _), w in zip(rows, want, strict=True)), key=str)
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_html_templates(spark):
    page = "<html><body><div class='x'><p>Welcome to our site</p></div><div><p>Own words {i} of page</p></div></body></html>"
    rows = [(i, f"http://u@A.example.com:80/{i}", page.format(i=i), "z") for i in range(20)] + [(100, "http://b.example.com/", page.format(i=1), "z"), (101, None, page.format(i=2), "z"), (102, "http://a.example.com/x", None, "z"), (103, "x", "", "z"), (None, "http://a.example.com/y", page.format(i=3), "z")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert all(got[i] == f"Own words {i} of page" for i in range(20)) and got[None] == "Own words 3 of page"
    assert got[100] == "Welcome to our site\nOwn words 1 of page" and got[101] == "Welcome to our site\nOwn words 2 of page" and got[102] == got[103] == ""
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("broadcast_hashes", [2_000_000, 0])
def test_html_templates_of_large_hosts(spark, broadcast_hashes):
    def page(i):
        menu = "<div><p>Menu of a section</p></div>" if i < 60 else "<div><p>Box of few pages</p></div>" if i < 100 else ""
        return f"<article>{menu}<p>Own {i}</p><p>Notice on all</p>{'<p>On most</p>' if i % 3 else ''}</article>"

    rows = [(i, f"http://large.example.com/{i}", page(i)) for i in range(700)] + [(i, f"http://small.example.com/{i}", page(i)) for i in range(700, 704)] + [(i, None, page(1)) for i in range(800, 810)] + [(900, "http://large.example.com/", None)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame(spark, rows, "page_id long, url string, html string"), broadcast_hashes=broadcast_hashes).collect()}
    most = lambda i: "\nOn most" if i % 3 else ""
    want = {i: ("Box of few pages\n" if 60 <= i < 100 else "") + f"Own {i}" + most(i) for i in range(700)}
    want |= {i: f"Own {i}\nNotice on all" + most(i) for i in range(700, 704)} | {i: "Menu of a section\nOwn 1\nNotice on all\nOn most" for i in range(800, 810)} | {900: ""}
    assert got == want


def test_html_of_hosts_without_articles(spark):
    """Headings, cells and items that many pages share are text; menus and boxes of the site are not."""
    def page(i):
        usual = "<h2>Overview</h2><table><tr><td>Yes<td>v{0}</table><h2>References</h2><ul><li>None<li>r{0}</ul>".format(i) if i < 60 else ""
        items = "".join(f"<li{' class=on' if k == i % 5 else ''}><a href={k}>Part {k}</a>" for k in range(5))
        return f"<div><div><ul>{items}</ul></div><div><p>Site notice</div><div class=c><h1>Title {i}</h1><p>Own words {i}</p>{usual}</div></div>"

    rows = [(i, f"http://h.example.com/{i}", page(i)) for i in range(700)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nOwn words {i}" + (f"\nOverview\nYes\nv{i}\nReferences\nNone\nr{i}" if i < 60 else "") for i in range(700)}


def test_html_against_plain_counts(spark):
    """Every page of the given table, long and repeated rows and rows without a host, with subtrees counted by plain Python."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    rows += rows[:3] + [(None, None, rows[0][2]), (9001, "", rows[1][2]), (9002, rows[2][1], "<p>" + "long words " * 100_000), (9003, rows[2][1], None)]
    host = lambda u: (re.match(r"\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "") or [None, ""])[1].lower() or None
    different = {(host(u), h) for _, u, h in rows if host(u) and h is not None}
    size, seen = collections.Counter(s for s, _ in different), collections.Counter((s, k) for s, h in different for k in html_text.Page(h).hashes)
    gone = collections.defaultdict(set)
    for (s, k), n in seen.items():
        if n >= 5 and n >= (size[s] * 0.9 if k & 1 else min(size[s] * 0.1, 50)):
            gone[s].add(k)
    want = sorted((str(i), html_text.Page(h, gone[host(u)] if host(u) else set()).text()) for i, u, h in rows)
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    assert sorted((str(r["page_id"]), r["text"]) for r in got.collect()) == want


def test_chat(spark):
    rng = random.Random(11)
    turns = [(c, t, rng.choice(("user", "assistant", "system", "Human", "gpt", "tool", None)), f"t{c}-{t}") for c in range(30) for t in range(rng.randrange(1, 9))]
    turns += [(77, i, "user" if i % 2 == 0 else "assistant", "x") for i in range(600)] + [(78, i, "user", "y") for i in range(300)] + [(None, 0, "user", None), (79, 0, "user", "a"), (79, 0, "user", "a"), (80, None, "assistant", "<|im_end|>")]
    solver = chat.Repair(chat.Costs())
    schema = "conv_id long, turn long, role string, text string, new_role string, part long, pos long"
    frame_ = spark.createDataFrame([(*t, "c", 1, 1) for t in turns], schema)
    price = {"keep": 0, "merge": 2}
    for rows_per_part in (20_000, 50):
        got = chat.repair_roles(frame_, rows_per_part=rows_per_part).collect()
        assert len(got) == len(turns)
        by_conv = {}
        for r in got:
            by_conv.setdefault(r["conv_id"], []).append(r)
        for conv, own in by_conv.items():
            given = [chat.role_of(r) for _, _, r in sorted(((t[1] if t[1] is not None else -1, t[3] or "", t[2]) for t in turns if t[0] == conv), key=lambda x: x[0])]
            first, last = solver.borders([solver.product(given)])
            least = sum(s.cost for _, s in solver.path(given, first, last)) + solver.closing[last][0]
            cost = sum(4 * len(r["inserted"]) + price.get(r["action"], 0) for r in own)
            cost += sum(0 if chat.ROLES[r["new_role"]] == chat.role_of(r["role"]) else 5 if chat.role_of(r["role"]) else 1 for r in own)
            assert cost == least
            text = "".join(r["rendered"] for r in sorted(own, key=lambda r: (-1 if r["turn"] is None else r["turn"])))
            roles = re.findall(r"<\|im_start\|>(\w+)", text)
            assert re.fullmatch(r"(system )?(user assistant )+", " ".join(roles) + " ")
            assert text.count("<|im_end|>") == len(roles)
    assert chat.repair_roles(frame_.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in queries.SQL:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want = con.execute(queries.SQL[name]).df()[list(got.columns)]
        plain = lambda df: df.sort_values(df.columns[0]).astype(object).where(df.notna(), None).values.tolist()
        assert plain(got) == plain(want)


def kept_by_hand(spark, rows):
    """Ids that the quality stage keeps, by the definitions of model, level and threshold."""
    held = {r["doc_id"] for r in spark.createDataFrame([(r["doc_id"],) for r in rows], "doc_id long").where(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()}
    trusted = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    perplexity = dict(zip((r["doc_id"] for r in rows), by_hand([r["text"] for r in rows if r["doc_id"] in trusted - held and r["text"]], [r["text"] for r in rows]), strict=True))
    ruler = [r for r in rows if r["doc_id"] in trusted & held and r["text"]]
    by_lang = lambda lang, value: [value(r) for r in ruler if r["lang"] == lang] if sum(r["lang"] == lang for r in ruler) >= 20 else [value(r) for r in ruler]
    out = set()

    def level(r):
        typical = np.mean(by_lang(r["lang"], lambda x: math.log(perplexity[x["doc_id"]])))
        n = len(r["text"])
        return math.exp((n * math.log(perplexity[r["doc_id"]]) + 40 * typical) / (n + 40))

    for r in rows:
        if r["text"]:
            levels = sorted(by_lang(r["lang"], level))
            if level(r) <= 1.05 * levels[math.ceil(0.995 * len(levels)) - 1]:
                out.add(r["doc_id"])
    return out


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen, tables = docs, [docs.collect()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        step(spark, seen, FOLDER).write.mode("overwrite").parquet(path)
        seen = spark.read.parquet(path)
        assert seen.columns == docs.columns and seen.dtypes == docs.dtypes
        tables.append(seen.collect())
    first, good, known, lines, unlike = tables
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(good) == kept_by_hand(spark, first)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = {i for i, q in labels.items() if q == 1}
    assert len(clean & ids(good)) >= 0.99 * len(clean)
    assert ids(known) == {r["doc_id"] for r in good if any(c.isalpha() for c in r["text"])}
    lang = {r["doc_id"]: r["lang"] for r in first}
    assert sum(lang[r["doc_id"]] == r["lang"] for r in known) >= 0.97 * len(known)
    want = {i: t for i, t, _, _ in lines_by_hand([(r["doc_id"], r["text"]) for r in known]) if t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in lines} == want and all(r["n_chars"] == len(r["text"]) for r in lines)
    own = {r["doc_id"]: sets(r["text"]) for r in lines}
    links = [(a, b) for a in own for b in own if a < b and own[a] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b])]
    component = groups(own, links)
    assert ids(unlike) == {i for i, c in component.items() if i == c}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, FOLDER).toPandas()
    total = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in unlike}
    assert packed.groupby("doc_id").length.sum().to_dict() == total
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed.sequence_id.nunique() <= 1.02 * sum(total.values()) / 1024 + 2


def test_pipeline_with_odd_rows(spark):
    import corpus_pipeline

    rows = [(i, f"A plain text number {i} about the river and the old house near the sea.", "en", "s", 60) for i in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "A text without a number of its own, but with words.", "en", "s", 9), (5, rows[5][1], "en", "s", 60), (102, "word " * 40_000, "en", "s", 1), (103, "?! 12", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = docs.withColumns({c: F.lit("x") for c in ("text_hash", "component_id", "lang_pred", "block", "version", "perplexity", "kept", "carry_0")})
    for docs_ in (docs, docs.limit(0), clash):
        seen = docs_
        for _, step in corpus_pipeline.STAGES[:-1]:
            seen = step(spark, seen, FOLDER)
            assert seen.columns == corpus_pipeline.COLUMNS
        assert (corpus_pipeline.STAGES[-1][1](spark, seen, FOLDER).count() > 0) == (not docs_.isEmpty())
