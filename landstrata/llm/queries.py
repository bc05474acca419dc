"""One registered query per operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landstrata.session import scratch_path

from . import chat, decontam, jaccard, licenses, mixing, packing, resampling, secrets, spelling, tokencount, topk, toxicity, warc

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- 1 ---------------------------------------------------------------------------------------------------------------

#: Rule regexes as DuckDB reads them: one group more or less does not matter, (?i:...) spelt out.
_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"


def _rule_sql(i: int, rule: secrets.Rule) -> str:
    regex = rule.regex.replace("((?i:password|passwd|secret|token|api_?key))", _KEY).replace("'", "''")
    return f"""
      SELECT k, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda j: struct_pack(
               s := list_sum(list_transform(g[:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:j - 1], lambda x: length(x))), 0),
               ord := {i}, n := length(m[j]), v := length(v[j]), kind := '{rule.kind}')), lambda x: x.v >= {rule.least})) AS p
      FROM (SELECT k, string_split_regex(t, '{regex}') g, regexp_extract_all(t, '{regex}', 0) m,
                   regexp_extract_all(t, '{regex}', {rule.group}) v FROM d)"""


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(secrets.RULES))}),
a AS (SELECT k, p.ord AS ord, p.s::BIGINT AS s, p.kind || ':' || p.s::BIGINT || ':' || (p.s + p.n)::BIGINT AS span FROM p),
h AS (SELECT k, count(*) FILTER (ord = 0) n0, count(*) FILTER (ord = 1) n1, count(*) FILTER (ord = 2) n2,
        string_agg(span, ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY s, ord) AS spans
      FROM a GROUP BY k)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN h USING (k)"""


@query("op1_secret_scans", OP1_SQL)
def op1(spark, sf_dir):
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["ord"] < len(secrets.BASE))

    def count(i):
        return F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("bigint")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"))


# --- 2 ---------------------------------------------------------------------------------------------------------------

OP2_SQL = """
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN r THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r THEN f END AS refers_to
FROM (SELECT page_id, h, f, octet_length(encode(h)) >= 100 AND page_id <> f AS r
      FROM (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS f FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)))"""


@query("op2_warc", OP2_SQL)
def op2(spark, sf_dir):
    path = scratch_path(spark, "warc")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    back = warc.read_archive(spark, path)
    field = warc.record_fields(F.col("record"), F.col("header"))
    return back.select(
        F.col("key").alias("page_id"), field["payload_bytes"].alias("payload_bytes"),
        F.sha2(field["payload"], 256).alias("payload_digest"), field["record_type"].alias("record_type"),
        field["refers_to"].cast("bigint").alias("refers_to"))


# --- 3 ---------------------------------------------------------------------------------------------------------------

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query("op3_exact_top_k", OP3_SQL)
def op3(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    best = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


# --- 4 ---------------------------------------------------------------------------------------------------------------


@query("op4_benchmark_decontamination")
def op4(spark, sf_dir):
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# --- 5 ---------------------------------------------------------------------------------------------------------------


@query("op5_packing")
def op5(spark, sf_dir):
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


# --- 6 ---------------------------------------------------------------------------------------------------------------

_ADDED = "</s>[INST] ok [/INST]"


def _escaped(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for mark in chat.CONTROLS:
        x = rf"replace({x}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return x


OP6_SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_ADDED}' UNION ALL SELECT -7, 1, 'assistant', '{_ADDED}'),
t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escaped('text')}) + CASE WHEN opens THEN 20 + length({_escaped('role')}) ELSE 6 END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op6_chat_formatting", OP6_SQL)
def op6(spark, sf_dir):
    added = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{_ADDED}'), (-7L, 1L, 'assistant', '{_ADDED}') AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = chat.format_conversations(rows)
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss_text(F.col("formatted"), F.col("loss_spans"))
    back = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


# --- 7 ---------------------------------------------------------------------------------------------------------------

OP7_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) LEFT JOIN n USING (doc_id)"""


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7(spark, sf_dir):
    return jaccard.link_documents(read(spark, sf_dir, "documents"), k=4, percent=85).drop("text_key", "group")


# --- 8 ---------------------------------------------------------------------------------------------------------------


@query("op8_license_scans")
def op8(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"))


# --- 9 ---------------------------------------------------------------------------------------------------------------


@query("op9_token_counts")
def op9(spark, sf_dir):
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


# --- 10 --------------------------------------------------------------------------------------------------------------


@query("op10_toxicity")
def op10(spark, sf_dir):
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- 11 --------------------------------------------------------------------------------------------------------------

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: CRC-32 of each row's ``x`` of the table ``strings``, byte by byte.
_CRC_SQL = """
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END, i)) AS t),
bytes AS (SELECT x, list_transform(range(octet_length(encode(x))), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT) AS b FROM strings),
crc AS (SELECT x, xor(4294967295::BIGINT, list_reduce(b, lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), 4294967295::BIGINT)) AS crc FROM bytes, tab)"""

OP11_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS k, true AS own, doc_id, text FROM documents UNION ALL
               SELECT row_number() OVER (), false, NULL, text FROM benchmark),
w AS (SELECT k, own, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT k, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
strings AS (SELECT DISTINCT x FROM f), {_CRC_SQL},
h AS (SELECT k, own, crc % 10000 AS bucket, count(*) AS n FROM f JOIN crc USING (x) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM h GROUP BY bucket),
z AS (SELECT sum(s) AS s, sum(t) AS t FROM b),
g AS (SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((b.s + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS gain FROM b, z),
d AS (SELECT k, sum(n) AS n, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM h JOIN g USING (bucket) WHERE own GROUP BY k),
p AS (SELECT w.k, doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (k) WHERE own),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY words >= 20) AS n FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM r"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark, sf_dir):
    drawn = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=25, least_words=20, n=2, buckets=10_000, seed=7)
    return drawn.drop("n_words")


# --- 12 --------------------------------------------------------------------------------------------------------------

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             coalesce(doc_id::VARCHAR, sha256(coalesce(text, ''))) AS name,
             greatest(coalesce(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[!-@\\[-`{{-~]+', '', 'g')) / length(text) END, {mixing.LEAST}), {mixing.LEAST}) AS w FROM documents),
x AS (SELECT *, -ln((('0x' || substr(sha256('1:' || name), 1, {mixing.DIGITS}))::BIGINT + 0.5::DOUBLE) / {16**mixing.DIGITS}) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
c AS (SELECT *, [5.0::DOUBLE, 2, 1][(place - 1) % 3 + 1] AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM c),
l AS (SELECT rest, share FROM o WHERE cap >= weight * rest / share ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * l.rest / l.share) AS target, round(least(cap, weight * l.rest / l.share))::BIGINT AS words FROM c, l),
r AS (SELECT x.*, source_size, target, words, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs,
             sum(size) OVER (PARTITION BY x.source ORDER BY key, doc_id, size, k ROWS UNBOUNDED PRECEDING) - size AS before
      FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (epochs * size + greatest(0, least(words - epochs * source_size - before, size)))::BIGINT AS taken FROM r"""


@query("op12_source_mixing", OP12_SQL)
def op12(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, quality=mixing.prose_share(F.col("text")), seed=1)


# --- 13 --------------------------------------------------------------------------------------------------------------

OP13_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), {_LOWER}) AS run FROM documents),
c AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS x, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
strings AS (SELECT DISTINCT x FROM c), {_CRC_SQL},
m AS (SELECT n, CASE WHEN crc % 97 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM c JOIN crc USING (x)),
words AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN forms f ON f.word = w.next)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.at AS root FROM forms f JOIN way w ON w.word = f.word AND w.next IS NULL"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark, sf_dir):
    return spelling.variants(spelling.vocabulary(read(spark, sf_dir, "documents"), least_length=5, least_count=3, every=97), ratio=2)
