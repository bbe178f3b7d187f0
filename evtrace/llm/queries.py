"""Registered queries of these operators, over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, chat, fingerprints, html_text, language, line_templates, near_dedup, ngram_join, packing, personal, resampling, top_k


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark, sf_dir):
    return top_k.search(top_k.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op2_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=80)


def op3_personal_data(spark, sf_dir):
    return personal.find(table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), pattern(), digest=True)


def op5_main_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def packing_tokenizer() -> tuple[str, str, str]:
    return tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json"), pattern()


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), packing_tokenizer())


def op8_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.read_back(chat.format_chats(chat.log_of_turns(rows.unionByName(extra)))))


def op9_line_dedup(spark, sf_dir):
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_language(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("text", F.col("lang").alias("label"))
    return language.of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), labelled).select("page_id", "language", F.round("posterior", 6).alias("posterior"), "rejected")


def op11_alignment(spark, sf_dir):
    paths = [tokenizer_path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents"), (*paths, pattern()))


def op12_resampling(spark, sf_dir):
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_ngram_join(spark, sf_dir):
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), words=5, similarity=80)


def queries() -> dict:
    every = (
        op1_top_k, op2_near_duplicates, op3_personal_data, op4_bpe, op5_main_text, op6_fingerprints, op7_packing, op8_chat,
        op9_line_dedup, op10_language, op11_alignment, op12_resampling, op13_ngram_join,
    )
    return {f.__name__: f for f in every}


OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM r GROUP BY a) m USING (doc_id)
"""

#: The same with five words, and without the choice of one document.
OP13 = OP2.replace("w[i : i + 3]", "w[i : i + 4]").replace("len(w) - 3", "len(w) - 4").replace(", d.doc_id <= coalesce(m.b, d.doc_id) AS kept", "")

OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + length(role) + 1 + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)')) + 11) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""

def _op9() -> str:
    levels = []
    for i in range(line_templates.LEVELS):
        levels.append(f"""
v{i} AS (SELECT node, p, m[p] AS token, sum(c) AS c FROM (SELECT *, unnest(range(4, len(m) + 1)) AS p FROM r{i}) GROUP BY ALL),
u{i} AS (SELECT * FROM v{i} QUALIFY row_number() OVER (PARTITION BY node, p ORDER BY c DESC, encode(token) DESC) = 1),
pattern{i} AS (SELECT node, list(token ORDER BY p) AS pattern FROM u{i} GROUP BY node),
told{i} AS (
  SELECT r.*, len(list_filter(range(4, len(m) + 1), lambda i: m[i] = pattern[i - 3] AND m[i] <> '<*>')) AS same, len(list_filter(m[4:], lambda x: x <> '<*>')) AS free
  FROM r{i} r JOIN pattern{i} USING (node)),
rest{i} AS (SELECT node, m, c FROM told{i} WHERE NOT (same >= 0.75 * free AND same >= 3)),
place{i} AS (SELECT *, m[p] AS token FROM (SELECT *, unnest(range(4, len(m) + 1)) AS p FROM rest{i})),
every{i} AS (SELECT node, count(*) AS every FROM rest{i} GROUP BY node),
counted{i} AS (SELECT node, p, token, sum(c) AS votes, count(*) AS k FROM place{i} GROUP BY ALL),
shared{i} AS (SELECT node, p, token, votes FROM counted{i} JOIN every{i} USING (node) WHERE k > 1 AND k < every),
r{i + 1} AS (
  SELECT node || [p::VARCHAR, token] AS node, m, c FROM place{i} JOIN shared{i} USING (node, p, token)
  QUALIFY row_number() OVER (PARTITION BY node, m ORDER BY votes DESC, p) = 1),""")
    general = " UNION ALL ".join(f"SELECT m, node || ['pattern {i}'] AS general FROM told{i} WHERE same >= 0.75 * free AND same >= 3" for i in range(line_templates.LEVELS))
    return OP9.replace("-- levels", "".join(levels)).replace("-- general", f"general AS ({general}),")


#: The levels of the tree stand where it says so.
OP9 = r"""
WITH l AS (
  SELECT doc_id, i AS line_no, list_filter(regexp_split_to_array(ls[i], '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
masked AS (SELECT doc_id, line_no, t, len(t) AS n, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM l WHERE len(t) >= 4),
m AS (SELECT *, len(list_filter(m, lambda x: x <> '<*>')) >= 4 AS plain FROM masked),
k AS (SELECT [n::VARCHAR] || m[1:3] AS node, m, count(*) AS c FROM m WHERE plain GROUP BY ALL),
r0 AS (SELECT k.* FROM k SEMI JOIN (SELECT node FROM k GROUP BY node HAVING count(*) > 1 AND max(len(m)) >= 6 AND sum(c) >= CASE WHEN max(len(m)) >= 50 THEN 2 ELSE 3 END) USING (node)),
-- levels
-- general
own AS (
  SELECT m.doc_id, m.line_no, m.n, CASE WHEN NOT plain THEN ['exact'] || m.t WHEN general.m IS NULL THEN ['own'] || m.m ELSE general END AS template
  FROM m LEFT JOIN general ON plain AND m.m = general.m),
spread AS (SELECT template, count(DISTINCT doc_id) AS docs, max(n) AS n, min(doc_id) AS first FROM own GROUP BY template),
gone AS (
  SELECT own.doc_id, list(own.line_no) AS gone FROM own JOIN spread USING (template)
  WHERE docs >= CASE WHEN spread.n >= 50 THEN 2 ELSE 3 END AND own.doc_id <> first GROUP BY own.doc_id),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ls[i]), chr(10)) END AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN gone USING (doc_id)
"""


#: A CRC is linear: it is the exclusive or of what each byte adds, given how many bytes follow it, and of that of as many zeros.
OP12 = r"""
WITH RECURSIVE
step AS (
  SELECT b, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)::BIGINT AS v
  FROM (SELECT unnest(range(256)) AS b)),
w AS (
  SELECT *, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 'd' AS kind, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark)),
g AS (
  SELECT kind, r, unnest(w) AS f FROM w
  UNION ALL SELECT kind, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
  UNION ALL SELECT kind, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT kind, r, f, count(*) AS c FROM g GROUP BY ALL),
d AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM f GROUP BY f),
longest AS MATERIALIZED (SELECT max(length(h)) // 2 AS n FROM d),
zeros AS (
  SELECT 0::BIGINT AS n, 4294967295::BIGINT AS s
  UNION ALL SELECT zeros.n + 1, xor(s >> 8, v) FROM zeros JOIN step ON b = s & 255 WHERE zeros.n < (SELECT n FROM longest)),
behind AS (
  SELECT 0::BIGINT AS n, b, v FROM step
  UNION ALL SELECT behind.n + 1, behind.b, xor(behind.v >> 8, step.v) FROM behind JOIN step ON step.b = behind.v & 255 WHERE behind.n < (SELECT n FROM longest)),
bytes AS (
  SELECT f, length(h) // 2 AS n, i, (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS b
  FROM (SELECT f, h, unnest(range(length(h) // 2)) AS i FROM d)),
crc AS (
  SELECT f, xor(xor(bit_xor(behind.v), any_value(zeros.s)), 4294967295) % 10000 AS bucket
  FROM bytes JOIN behind ON behind.n = bytes.n - 1 - i AND behind.b = bytes.b JOIN zeros ON zeros.n = bytes.n GROUP BY f),
placed AS MATERIALIZED (SELECT kind, r, bucket, sum(c) AS c FROM f JOIN crc USING (f) GROUP BY ALL),
total AS (SELECT bucket, coalesce(sum(c) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM total),
doc AS (
  SELECT w.r, any_value(doc_id) AS doc_id, any_value(len(w)) AS n_words, coalesce(sum(c), 0)::BIGINT AS n_features, coalesce(sum(c * gain), 0)::BIGINT AS weight
  FROM w LEFT JOIN placed ON placed.r = w.r LEFT JOIN gain USING (bucket) WHERE w.kind = 'd' GROUP BY w.r),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM doc),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_top_k": OP1, "op2_near_duplicates": OP2, "op8_chat": OP8, "op9_line_dedup": _op9(), "op12_resampling": OP12, "op13_ngram_join": OP13}
