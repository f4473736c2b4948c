"""One query for each operator of this subpackage, over its whole table, and SQL where it can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmith.llm import ann, bagminhash, bloomlm, htmltext, linedup, media, mixing, packing, periodic, pii, quality, sharding, vectorcode
from oddsmith.llm.common import table


def tokenizer_files() -> tuple[str, str]:
    """Path of the ranks of the 50k byte-level vocabulary and its pretokeniser's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def tokenizer_added() -> dict[str, int]:
    """The added tokens of the same vocabulary."""
    import public_tokenizers

    return packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op1_recurrent_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op2_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("key")


def op4_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_alike")


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.labelled(table(spark, sf_dir, "documents"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_deleted", "longest_copy")


def op7_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), *tokenizer_files(), added=tokenizer_added())


def op8_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.sniffed(media.stored(table(spark, sf_dir, "documents"))))


def op9_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.scored(table(spark, sf_dir, "documents"))


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of equal numbers of rows; only sizes and hashes of the texts are moved."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text")
    )
    found = sharding.sharded(docs, 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vectorcode.fitted(vectors)
    coded = vectorcode.encoded(vectors, books, keep=("vec_id", "label"))
    digest = hashlib.sha256(",".join(map(str, books.numbers() if books else ())).encode()).hexdigest()
    rows = coded.select(F.col("vec_id").cast("long"), F.lower(F.hex("code")).alias("code"), "error", "label")
    rows = vectorcode.with_group_sum(rows, "label", "error", "label_error")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) ends with digit 0, the words from some place on repeat a block.

    With h the checksum, g = floor(h / 10) and n words, the block starts at word g % n and has
    1 + floor((n - start) / (3 + g % 8)) words. A null doc_id has the checksum of the empty text
    and so repeats a block as well.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h"), g.alias("g"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = n - F.col("a")
    turns = F.ceil(rest / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), turns)), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_lpf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of the words of `planted_runs`, and the text without the repetitions."""
    found = periodic.repeats(planted_runs(table(spark, sf_dir, "documents")), keep=["doc_id"])
    # Exponents are compared as fractions; the first of equals is the one that starts first.
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda best, x: F.when(better(best, x), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_recurrent_labeller,
        op2_block_join,
        op3_importance_resampling,
        op4_bagminhash,
        op5_weak_supervision,
        op6_line_runs,
        op7_online_packing,
        op8_signature_sniffing,
        op9_poisson_mixing,
        op10_bloom_lm,
        op11_feistel_shards,
        op12_product_codes,
        op13_lpf_runs,
    )
    return {f.__name__: f for f in found}


# Sums run from the first component to the last, as the operator's do.
OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

# Windows of one to five lines in place of ranks: a shortest run of five words has no more lines.
# Windows of powers of two lines give the longest copy.
OP6_SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, text, md5(text) AS hash FROM documents WHERE text IS NOT NULL),
split AS (
  SELECT doc_id, hash, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM docs),
lines AS (
  SELECT doc_id, hash, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id, hash ORDER BY pos) AS seq
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS m),
runs AS (
  SELECT m, a.doc_id, a.hash, a.seq, string_agg(b.line, chr(10) ORDER BY b.seq) AS run, sum(b.words) AS words, list(b.pos) AS poss
  FROM sizes, lines a JOIN lines b ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.hash = a.hash AND b.seq >= a.seq AND b.seq < a.seq + m
  GROUP BY m, a.doc_id, a.hash, a.seq HAVING count(*) = m AND sum(b.words) >= 5),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY m, md5(run), len(run) ORDER BY doc_id NULLS LAST, hash, seq) AS nth FROM runs),
gone AS (SELECT DISTINCT doc_id, hash, unnest(poss) AS pos FROM placed WHERE nth > 1),
lists AS (SELECT doc_id, hash, list(pos) AS gone FROM gone GROUP BY doc_id, hash),
powers AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS m),
copies AS (
  SELECT m, a.doc_id, a.hash, a.seq, md5(string_agg(md5(b.line), ',' ORDER BY b.seq)) AS run
  FROM powers, lines a JOIN lines b ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.hash = a.hash AND b.seq >= a.seq AND b.seq < a.seq + m
  GROUP BY m, a.doc_id, a.hash, a.seq HAVING count(*) = m),
longest AS (
  SELECT doc_id, hash, max(m) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY m, run ORDER BY doc_id NULLS LAST, hash, seq) AS nth FROM copies) WHERE nth > 1 GROUP BY 1, 2)
SELECT d.doc_id,
  CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(
    list_zip(string_split(d.text, chr(10)), range(0, len(string_split(d.text, chr(10))))),
    lambda p: NOT list_contains(g.gone, p[2])), lambda p: p[1]), chr(10)) END AS text,
  (CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END)::INTEGER AS n_lines,
  coalesce(len(g.gone), 0)::INTEGER AS n_deleted, coalesce(l.run, 0)::INTEGER AS longest_copy
FROM documents d LEFT JOIN lists g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND md5(d.text) = g.hash
LEFT JOIN longest l ON d.doc_id IS NOT DISTINCT FROM l.doc_id AND md5(d.text) = l.hash
"""

# The Poisson distribution is inverted by adding up its terms until they pass the hash.
OP9_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(n, 0.5) * (SELECT sum(n) FROM sizes) / ((SELECT sum(pow(n, 0.5)) FROM sizes) * n) AS rate FROM sizes),
cdf AS (
  SELECT source, list_transform(range(0, 80), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-rate + j * ln(rate) - lgamma(j + 1))))) AS c
  FROM rates),
named AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND count(*) OVER (PARTITION BY doc_id) = 1 THEN doc_id::VARCHAR ELSE coalesce(doc_id::VARCHAR, 'null') || ':' ||
    md5(concat_ws(':', coalesce('=' || doc_id, '-'), coalesce('=' || text, '-'), coalesce('=' || lang, '-'), coalesce('=' || source, '-'), coalesce('=' || n_chars, '-'))) || ':' ||
    row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) END AS key FROM documents),
counted AS (
  SELECT d.*, len(list_filter(c.c, lambda x: x < (('0x' || substr(md5('17:count:0:' || key), 1, 12))::BIGINT + 0.5) / 281474976710656.0)) AS times
  FROM named d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INTEGER AS copy FROM counted WHERE times > 0
"""


# crc32 byte by byte from a table made by its rule; the permutation round by round, again where it leaves the row numbers.
def op11_sql(shards: int = 40, seed: int = 0) -> str:
    low = "4294967295"
    steps, left, right = [], "l", "r"
    for k in range(sharding.ROUNDS):
        key = ((seed + k + 1) * sharding.STEP) & 0xFFFFFFFF
        source, bits = (right, "a") if k % 2 == 0 else (left, "b")
        steps.append(f"(({source}::HUGEINT * {sharding.FIRST} + {key}) & {low})::BIGINT AS x{k}")
        steps.append(f"(xor(x{k}, x{k} >> 15)::HUGEINT * {sharding.SECOND} & {low})::BIGINT AS y{k}")
        steps.append(f"xor(y{k}, y{k} >> 13) & ((1::BIGINT << {bits}) - 1) AS f{k}")
        if k % 2 == 0:
            steps.append(f"xor({left}, f{k}) AS l{k}")
            left = f"l{k}"
        else:
            steps.append(f"xor({right}, f{k}) AS r{k}")
            right = f"r{k}"
    once = f"SELECT number, n, a, b, ({left} << b) + {right} AS p FROM (SELECT *, p >> b AS l, p & ((1::BIGINT << b) - 1) AS r, {', '.join(steps)} FROM %s)"
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(0, 256), lambda c: list_reduce(list_concat([c], range(0, 8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
keyed AS (
  SELECT doc_id, md5(md5(text)) AS tie, length(h) // 2 + 16 AS size,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT)),
      lambda v, x: xor(v >> 8, t[(xor(v, x) & 255) + 1])), 4294967295) AS text_crc32 FROM hexed, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, tie, size, text_crc32) - 1 AS number, count(*) OVER () AS n FROM keyed),
bits AS (
  SELECT number, n, b // 2 AS a, b - b // 2 AS b, number AS p FROM (SELECT *, greatest(2, CASE WHEN n <= 1 THEN 0 ELSE length(ltrim(bin(n - 1), '0')) END)::BIGINT AS b FROM numbered)),
walk AS (
  {once % "bits"}
  UNION ALL
  {once % "(SELECT * FROM walk WHERE p >= n)"})
SELECT k.doc_id, k.size, k.text_crc32, 'rows' AS law, (w.p % {shards})::INTEGER AS shard, w.p // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM walk w JOIN numbered k ON w.number = k.number WHERE w.p < w.n
"""


# Rounds of assignment and floored means, all in whole numbers.
def op12_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cut AS MATERIALIZED (SELECT id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range(0, {parts})) AS p)),
first AS (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {entries}),
book0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN first USING (id))"""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(rounds + 1):
        text += f""",
near{k} AS MATERIALIZED (
  SELECT id, p, min(struct_pack(d := {far}, e := e)) AS m FROM cut JOIN book{k} USING (p) GROUP BY id, p)"""
        if k < rounds:
            text += f""",
sums{k} AS (
  SELECT p, e, i, sum(y) AS s, count(*) AS n FROM (
    SELECT p, m.e AS e, unnest(range(0, len(x))) AS i, unnest(x) AS y FROM near{k} JOIN cut USING (id, p)) GROUP BY p, e, i),
means{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM sums{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN means{k} m USING (p, e))"""
    return text + f""",
coded AS (SELECT id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_block_join": OP2_SQL, "op6_line_runs": OP6_SQL, "op9_poisson_mixing": OP9_SQL, "op11_feistel_shards": op11_sql(), "op12_product_codes": op12_sql()}
