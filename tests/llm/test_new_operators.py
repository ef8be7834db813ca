"""Operators 11 to 13 on small frames: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; against brute force."""

import functools
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import fill_middle, repeat_spans, turn_viterbi

DOCS = "doc_id long, text string, id long, n long, form string, body string, block long, marks string, answers string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, 7, "x", "y", 3, "m", "a") for r in rows], DOCS)


# 11


def arranged(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, len(units), "plain", None, None, text, text
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, len(units), out[0], len(p), len(m), out[1], text


def test_fill_in_middle(spark):
    rng = random.Random(4)
    alphabet = ["a", "Zz", "word", " ", "\n", "é", "𝒳", "<", "S", ">", "<S", "P>", "0", "ß", "\u0000", "日本"]
    rows = [(None, None), (None, "some words here"), (1, None), (2, ""), (3, "<P>"), (4, "a <M> b"), (5, "one"), (5, "one"), (6, "a " * 200_000), (7, "x" * 300_000), (8, "é" * 5000)]
    rows += [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(9, 400)]
    rows += [(i, " ".join("w" * rng.choice([1, 2, 900]) for _ in range(3000))) for i in range(400, 404)]
    out = fill_middle.fill_in_middle(docs(spark, rows))
    got = out.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r) for r in got), key=key) == sorted((arranged(*r) for r in rows), key=key)
    assert fill_middle.fill_in_middle(docs(spark, [])).collect() == []


def test_rank_index():
    rng = np.random.default_rng(2)
    for steps in ([1] * 10, [1], rng.integers(1, 9, 50_000), rng.choice([1, 5000], 3000), np.full(5000, 3), rng.integers(1, 200_000, 400)):
        offsets = np.cumsum(steps)
        index = fill_middle.RankIndex.fit(offsets)
        ranks = np.arange(len(offsets))
        assert (index.select(ranks) == offsets).all()
        assert np.abs(offsets - index.predict(ranks)).max() <= fill_middle.WIDTH + 1
    assert len(fill_middle.RankIndex.fit(np.arange(0, 300_000, 3)).first) == 1


# 12


def plain_repair(rows):
    """Exhaustive: the least (cost, letters) over all edits of rows as (role, text, fault)."""
    after = {"0": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in "0a":
            options.append((0, "", ()))
        if inserted < 3:
            nxt = after[state]
            c, l, out = best(i, nxt, inserted + 1)
            options.append((c + 5, "I" + l, (({"u": "user", "a": "assistant"}[nxt], ""), *out)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, l, out = best(i + 1, state, 0)
            options.append((c + 2, "D" + l, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if (state, role[:1]) in {("0", "s"), ("0", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    c, l, out = best(i + 1, role[:1], 0)
                    options.append((c + extra, "K" + l, ((role, text), *out)))
                c, l, out = best(i + 1, after[state], 0)
                options.append((c + 1 + extra, "R" + l, (({"u": "user", "a": "assistant"}[after[state]], text), *out)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, "0", 0)


def plain_talk(conv, rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, out = plain_repair(tuple((r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest), out


CHAT = "conv_id long, turn long, role string, text string, away boolean, part int, seq long, key string, behind int, first string"


def chat(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, "f") for r in rows], CHAT)


def talks(rng, n):
    rows = [(None, None, None, None, False), (None, 3, "user", "Hi.", False), (900, 1, "user", "Gone.", True), (901, 5, "", "x.", False), (902, None, "user", "a.", False), (902, None, "user", "a.", False)]
    for conv in range(n):
        rows += [(conv, rng.choice([None, t, t, t + 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(["Yes.", "no", " ", "", "ok!", f"t{t}?", f"u{t} \n", f"Fine {t}. \t", None]), rng.random() < 0.05) for t in range(rng.randrange(9))]
    return rows


@pytest.mark.parametrize("block_rows", [1, 3, 2048])
def test_repair_turns(spark, block_rows):
    rows = talks(random.Random(block_rows), 60)
    by = {}
    for conv, turn, role, text, away in rows:
        by.setdefault(conv, [])
        if not away:
            by[conv].append((turn, role, text))
    want = {c: plain_talk(c, r) for c, r in by.items()}
    df = chat(spark, rows).repartition(3)
    got = {r["conv_id"]: tuple(r) for r in turn_viterbi.repair_turns(df, absent=F.col("away"), block_rows=block_rows).collect()}
    assert got == {c: w[0] for c, w in want.items()}
    turns = turn_viterbi.repair_turns(df, absent=F.col("away"), block_rows=block_rows, repaired=True).orderBy("conv_id", "place").collect()
    assert {c: [(r["role"], r["text"]) for r in turns if r["conv_id"] == c] for c in want} == {c: list(w[1]) for c, w in want.items()}


@pytest.mark.parametrize("roles", ["ua", "u", "uuas", "b", "sua"])
def test_long_conversations_span_partitions(spark, roles):
    """One conversation holds most rows; chunks that never converge by themselves ("u" alone, blank rows) need their passes."""
    rng = random.Random(roles)
    names = {"u": "user", "a": "assistant", "s": "system", "b": "user"}
    rows = [(1, t, names[rng.choice(roles)], "" if roles == "b" and t else rng.choice([f"t{t}.", f"t{t}", "Again.", "Word."]), False) for t in range(400)]
    rows += [(2, t, "user", "x.", False) for t in range(5)]
    df = chat(spark, rows).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["conv_id"]: tuple(r) for r in turn_viterbi.repair_turns(df, block_rows=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        assert got == {c: plain_talk(c, [r[1:4] for r in rows if r[0] == c])[0] for c in (1, 2)}
    finally:
        sys.setrecursionlimit(limit)


def test_repair_of_nothing(spark):
    assert turn_viterbi.repair_turns(chat(spark, [])).collect() == []
    assert len(turn_viterbi.VECTORS) < 100


# 13


def plain_cut(rows, size):
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - size + 1):
            if b[p : p + size] in seen:
                gone[p : p + size] = [True] * size
            seen.add(b[p : p + size])
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        out.append((doc, len(b), sum(gone), len(spans), bytes(c for c, g in zip(b, gone, strict=True) if not g), spans))
    return out


@pytest.mark.parametrize(("size", "limits"), [(100, {}), (100, {"hot": 3, "block_bytes": 3000, "shard_bytes": 20_000}), (100, {"hot": 0, "block_bytes": 600, "shard_bytes": 9000}), (60, {"hot": 2, "block_bytes": 2000})])
def test_cut_repeats(spark, size, limits):
    rng = random.Random(size)
    passages = ["".join(rng.choice("abcdef é\n") for _ in range(rng.choice([60, 100, 130, 400]))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 101), (5, "x" * 1000), (6, "ab" * 300), (7, "x" * 99 + "y"), (8, passages[0] * 2)]
    for i in range(9, 160):
        rows.append((i, "".join(rng.choice([rng.choice(passages), rng.choice(passages)[: rng.randrange(130)], "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80)))]) for _ in range(rng.randrange(8)))))
    got = repeat_spans.cut_repeats(docs(spark, rows).repartition(5), min_bytes=size, **limits).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["span_starts"]) for r in got) == plain_cut(rows, size)
    assert all(sum(r["span_lengths"]) == r["n_removed"] for r in got)


def test_cut_repeats_without_ids_and_with_repeated_ones(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(500))
    got = repeat_spans.cut_repeats(docs(spark, [(5, text), (5, text), (None, text), (None, text), (1, text + "!")])).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in got) == [(False, 0, 0), (False, 0, 500), (True, 1, 500), (True, 5, 500), (True, 5, 500)]
    assert repeat_spans.cut_repeats(docs(spark, [])).collect() == []
    with pytest.raises(ValueError, match="min_bytes"):
        repeat_spans.cut_repeats(docs(spark, []), min_bytes=20)


def test_cut_repeats_in_very_long_texts(spark):
    rng = random.Random(9)
    long_ = "".join(rng.choice("abcdefghij \n") for _ in range(1_300_000))
    got = {r["doc_id"]: r for r in repeat_spans.cut_repeats(docs(spark, [(1, long_), (2, "z" * 40 + long_[400_000:1_200_000]), (3, "q" * 700_000)])).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], bytes(got[2]["kept"])) == (0, 800_000, b"z" * 40)
    assert (got[3]["n_removed"], got[3]["span_starts"]) == (699_999, [1])


def test_previous_factors():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        rank, place = rng.integers(0, 7, n), rng.permutation(n)
        want = [any(rank[j] == rank[i] and place[j] < place[i] for j in range(n)) for i in range(n)]
        assert repeat_spans.previous_factors(rank, place).tolist() == want
