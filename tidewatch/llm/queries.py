"""Queries of this package over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


_COMPONENTS = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node)"""


@query("op2_ngram_jaccard_join", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
u AS MATERIALIZED (SELECT doc_id, unnest(sh) AS t FROM s), n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
{_COMPONENTS}
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM n LEFT JOIN c ON node = doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op9_line_dedup", r"""
WITH l AS (
  SELECT doc_id, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key0
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
k AS (SELECT *, translate(key0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.line_dedup import dedup_lines

    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_best_fit_packing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm.packing import pack_documents

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.quality_model import quality

    return quality(table(spark, folder, "documents"), table(spark, folder, "labels").where("quality = 1").select("doc_id")).drop("text_hash")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.language_id import fit, identify

    docs = table(spark, folder, "documents")
    found = identify(docs, fit(docs.where(~held_out()).select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op10_bpe_round_trip")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tidewatch.llm.bpe import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(table(spark, folder, "documents"), path), path)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_epsilon_grid_join", f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda i: i IS NULL OR NOT isfinite(i))) = 0 AND len(list_filter(x, lambda i: i <> 0)) > 0),
l AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9),
{_COMPONENTS}, d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM v LEFT JOIN d ON d.a = vec_id LEFT JOIN c ON node = vec_id""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.vector_join import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


@query("op8_learned_partitions")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.ann import search

    return search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_site_template_removal")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.html_text import main_text

    return main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_chat_role_repair")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.chat import repair_roles

    return repair_roles(table(spark, folder, "conversations")).withColumn("inserted", F.array_join("inserted", ","))


@query("op13_longest_previous_factors", r"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, unnest(range(n - 99)) AS p, h FROM d WHERE n >= 100),
k AS MATERIALIZED (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) AS s FROM w),
f AS (SELECT s, min((doc_id, p)) AS first FROM k GROUP BY s HAVING count(*) > 1),
m AS (SELECT k.doc_id, p FROM k JOIN f USING (s) WHERE (k.doc_id, p) <> first),
g AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100 IS NOT FALSE AS opens FROM m),
i AS (SELECT doc_id, p, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
r AS (SELECT doc_id, run, min(p) AS low, max(p) + 100 AS high FROM i GROUP BY ALL),
c AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM r),
t AS (SELECT doc_id, sum(high - low) AS removed, count(*) AS spans, max(high) AS last, list((before, low) ORDER BY low) AS gaps FROM c GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN h ELSE array_to_string(list_transform(gaps, lambda x: substr(h, 2 * x[1] + 1, 2 * (x[2] - x[1]))), '') || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.repeat_spans import cut_repeats

    kept = cut_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_rank_index_fim", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS s FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1:least(a, b)], '') AS pre, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(w[greatest(a, b) + 1:n], '') AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM f""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.fill_middle import fill_in_middle, restore

    out = fill_in_middle(table(spark, folder, "documents"))
    restored = restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op12_rank_convergent_viterbi", rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
n AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM n WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i, rtrim(text, {_BLANKS}) AS bare FROM d),
f AS MATERIALIZED (SELECT *, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
  CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
  count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r(conv_id, i, p, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'l': '', 't': ''}}, {{'c': 1000000::BIGINT, 'l': '', 't': ''}}, {{'c': 1000000::BIGINT, 'l': '', 't': ''}}, {{'c': 1000000::BIGINT, 'l': '', 't': ''}} FROM c
  UNION ALL
  SELECT conv_id, i,
    {{'c': p.c + 2, 'l': p.l || 'D', 't': p.t}},
    list_min([{{'c': s.c + 2, 'l': s.l || 'D', 't': s.t}}, {{'c': p.c + CASE WHEN x = 's' THEN keep ELSE 1000000 END, 'l': p.l || 'K', 't': p.t || kept}}]),
    list_min([{{'c': v.c + 2, 'l': v.l || 'D', 't': v.t}}] || list_transform([p, s, b], lambda z: {{'c': z.c + CASE WHEN x = 'u' THEN keep ELSE 1000000 END, 'l': z.l || 'K', 't': z.t || kept}})
      || list_transform([p, s, b], lambda z: {{'c': z.c + keep + 1, 'l': z.l || 'R', 't': z.t || chr(10) || 'user:' || text}})),
    list_min([{{'c': b.c + 2, 'l': b.l || 'D', 't': b.t}}, {{'c': v.c + CASE WHEN x = 'a' THEN keep ELSE 1000000 END, 'l': v.l || 'K', 't': v.t || kept}},
      {{'c': v.c + keep + 1, 'l': v.l || 'R', 't': v.t || chr(10) || 'assistant:' || text}}])
  FROM (SELECT *, list_min([a, {{'c': v.c + 5, 'l': v.l || 'I', 't': v.t || chr(10) || 'assistant:'}}]) AS b FROM (
    SELECT r.conv_id, f.i, f.x, f.text, chr(10) || f.role || ':' || f.text AS kept, CASE f.fault WHEN '' THEN 0 WHEN 't' THEN 5 ELSE 1000000 END AS keep, p, s, a,
      list_min([u] || list_transform([p, s, a], lambda z: {{'c': z.c + 5, 'l': z.l || 'I', 't': z.t || chr(10) || 'user:'}})) AS v
    FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1))),
e AS (SELECT c.*, list_min([p, a, {{'c': u.c + 5, 'l': u.l || 'I', 't': u.t || chr(10) || 'assistant:'}}, {{'c': s.c + 10, 'l': s.l || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}]) AS best
  FROM r JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = c.n)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM g.conv_id""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from tidewatch.llm.turn_viterbi import damage, repair_turns

    damaged, dropped = damage(table(spark, folder, "conversations"))
    return repair_turns(damaged, absent=dropped)
