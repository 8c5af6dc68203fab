"""One query per operator, over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supportlake.llm import backoff, editcount, encode, langid, minhash, mixing, periodic, quality, rlz, toccur, tokenfiles, topk, trie
from supportlake.session import materialize
from supportlake.sources.tables import read_input

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(name: str, oracle: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


#: Components of the given vectors; others take no part.
VECTOR_WIDTH = 64

_TOPK = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = 64
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND (b.vec_id <> a.vec_id OR b.q <> a.q)
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 20
"""


@query("op1_topk_blocks", _TOPK)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_input(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64, width=VECTOR_WIDTH)


@query("op2_prob_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicates(read_input(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id")


_MIX = """
WITH sized AS (
  SELECT source, sum(length(text)) AS units FROM documents GROUP BY source HAVING sum(length(text)) > 0
), rates AS (
  SELECT source, sum(units) OVER () / count(*) OVER () / units AS rate FROM sized
), steps AS (
  SELECT source, list(c ORDER BY k) AS steps FROM (
    SELECT source, k, sum(exp(-rate) * pow(rate, k) / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS c
    FROM rates, unnest(range(0, 60)) AS t(k)) GROUP BY source
), counted AS (
  SELECT d.*, len([c FOR c IN steps IF c <= CAST('0x' || substr(md5('0:' || doc_id || ':0'), 1, 13) AS BIGINT) / 4503599627370496.0]) AS n
  FROM documents d JOIN steps ON d.source IS NOT DISTINCT FROM steps.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy FROM counted, unnest(range(1, n + 1)) AS t(c)
"""


@query("op3_poisson_mix", _MIX)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_input(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.col("mix_copy").alias("copy"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(read_input(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


_BACKOFF = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (SELECT doc_id, len(w) AS n, p, w[p] AS a, CASE WHEN p > 1 THEN w[p - 1] END AS b, CASE WHEN p > 2 THEN w[p - 2] END AS c
  FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
counted AS (SELECT doc_id, n, p, count(*) OVER () - n AS rest,
  count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS k1,
  count(*) OVER (PARTITION BY b, a) - count(*) OVER (PARTITION BY doc_id, b, a) AS k2,
  count(*) OVER (PARTITION BY c, b, a) - count(*) OVER (PARTITION BY doc_id, c, b, a) AS k3 FROM tok),
context AS (SELECT *, lag(k1) OVER (PARTITION BY doc_id ORDER BY p) AS x1, lag(k2) OVER (PARTITION BY doc_id ORDER BY p) AS x2 FROM counted),
s1 AS (SELECT *, CASE WHEN k1 > 0 THEN k1 / greatest(rest, 1) ELSE 1 / (rest + 1) END AS v1 FROM context),
s2 AS (SELECT *, CASE WHEN p < 2 THEN v1 WHEN k2 > 0 THEN k2 / greatest(x1, 1) ELSE 0.4::DOUBLE * v1 END AS v2 FROM s1),
s3 AS (SELECT *, CASE WHEN p < 3 THEN v2 WHEN k3 > 0 THEN k3 / greatest(x2, 1) ELSE 0.4::DOUBLE * v2 END AS v3 FROM s2),
scored AS (SELECT doc_id, sum(ln(v3)) AS total, count(*) FILTER (WHERE p > 2 AND k3 <= 0) AS missed FROM s3 GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(total, 0), 4) AS log_score, round(total / len(w), 6) AS mean_log_score,
  coalesce(missed, 0) AS n_backoff FROM d LEFT JOIN scored USING (doc_id)
"""


@query("op5_stupid_backoff", _BACKOFF)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score_documents(read_input(spark, sf_dir, "documents"), order=3)
    return scored.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


@query("op6_language_codes")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_input(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    named = langid.identify_languages(docs.select("doc_id", "text"), model)
    return named.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op7_pair_index_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_input(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), keep_ids=False, keep_text=False)
    return coded.select(
        "doc_id", F.col("bpe_n_tokens").alias("n_tokens"), F.col("bpe_ids_sha256").alias("ids_sha256"),
        F.col("bpe_text_sha256").alias("decoded_sha256"),
    )


@query("op8_edit_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    docs = read_input(spark, sf_dir, "documents").select("doc_id", "text")
    trees = editcount.count_tokens(docs, path)
    edited = editcount.apply_edits(trees, editcount.sample_edits(F.coalesce("text", F.lit("")), F.col("doc_id")), path)
    return edited.select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded")


_REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(s) WHERE len(w) >= 20),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
cov AS (SELECT DISTINCT doc_id, s + j AS p FROM dup, unnest(range(0, 20)) AS u(j)),
words AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op9_relative_parse", _REPEATS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rlz.remove_repeats(read_input(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS t(s) WHERE len(w) >= 5),
rep AS (SELECT doc_id, count(DISTINCT s + j) AS n FROM (
  SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win), unnest(range(0, 5)) AS u(j) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    NOT regexp_matches(line, '[.!?…][")\]”»’]*[\x20\x09-\x0D]*$') OR regexp_matches(line, '[|›»•·][^|›»•·]*[|›»•·]')
    OR regexp_matches(lower(line), 'PHRASES') AS fails
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost FROM judged GROUP BY doc_id),
base AS (
  SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN per USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_lost_words <= 50 * n_words AS kept FROM base
""".replace("PHRASES", "|".join(quality.PHRASES))


@query("op10_line_rules", _QUALITY)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_quality_rules(read_input(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept"
    )


#: Unsigned crc32 of a decimal number in SQL: ``t`` is the usual byte table, from its rule.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i))"""


def _crc(column: str) -> str:
    codes = f"list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce({codes}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


_WORDS = r"[^\x20\x09-\x0D]+"

_JOIN = r"""
WITH RECURSIVE given AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'WORDS') AS w
  FROM documents
), elements AS (
  SELECT DISTINCT k, array_to_string(w[i:i + 3], ' ') AS e FROM given, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT k, count(*) AS n FROM elements GROUP BY k),
common AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM elements x JOIN elements y ON x.e = y.e AND x.k < y.k GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT k AS a, k AS b FROM sizes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a AS k, min(doc_id) AS component_id FROM reach JOIN given ON given.k = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM given LEFT JOIN sizes USING (k) LEFT JOIN least USING (k)
""".replace("WORDS", _WORDS)


@query("op11_divide_skip_join", _JOIN)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toccur.similarity_components(read_input(spark, sf_dir, "documents").select("doc_id", "text"))


_RUNS = r"""
WITH CRC, given AS (
  SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(coalesce(text, ''), 'WORDS') AS w, HASH AS h FROM documents, crc
), sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM given),
parts AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a, CASE WHEN n > 0 AND h % 10 = 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
d AS (SELECT doc_id, k, n, CASE WHEN a IS NULL THEN w ELSE [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] END AS w FROM parts),
six AS (SELECT k, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM d, unnest(range(n - 5)) AS t(i) WHERE n >= 12),
same AS (SELECT x.k, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.k = y.k AND x.s = y.s AND x.i < y.i),
isles AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS isle FROM same),
long AS (SELECT k, q, min(i) AS a, min(i) + count(*) + 5 + q AS z FROM isles GROUP BY k, q, isle HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
runs AS (SELECT * FROM long x WHERE NOT EXISTS (SELECT 1 FROM long y WHERE y.k = x.k AND y.q < x.q AND y.a <= x.a AND y.z >= x.z)),
per AS (SELECT k, count(*) AS n_runs, sha256(string_agg(a || ',' || (z - a) || ',' || q || chr(10), '' ORDER BY a, q)) AS runs_sha256,
  list(struct_pack(a := a, z := z, q := q) ORDER BY z - a DESC, a, q)[1] AS best FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, i FROM runs, unnest(range(a + q, z)) AS t(i)),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS x FROM (SELECT k, i, w[i + 1] AS x FROM d, unnest(range(n)) AS t(i)) ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.a AS BIGINT) AS start, CAST(best.z - best.a AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * (best.z - best.a) // best.q AS BIGINT) AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (k) LEFT JOIN kept USING (k)
""".replace("CRC", _CRC_TABLE).replace("HASH", _crc("doc_id")).replace("WORDS", _WORDS)


def plant_runs(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of all ids made periodic: with h the crc32 of the id and g = h // 10, words from a = g % n on repeat p words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORDS), F.lit(0))
    chosen = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    sized = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.pmod(g, F.col("n"))).cast("int"))
    planned = sized.withColumn("p", F.expr("cast(1 + (n - a) div (3 + pmod(h div 10, 8)) as int)"))
    turned = F.expr("concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a))")
    return planned.withColumn("text", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text"))).select("doc_id", "text")


@query("op12_block_convolution", _RUNS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(plant_runs(read_input(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), listed.alias("listed"), "collapsed_text").select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"),
        F.sha2(F.concat("listed", F.when(F.col("n_runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


_TRIE = r"""
WITH CRC, given AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT conv_id, HASH % 4 AS h FROM (SELECT DISTINCT conv_id FROM given), crc),
rebuilt AS (
  SELECT ids.conv_id, pos AS o, role, text FROM ids JOIN given ON given.conv_id = ids.conv_id - ids.conv_id % 20 AND pos <= h
  UNION ALL SELECT conv_id, pos + 3, role, text FROM given JOIN ids USING (conv_id) WHERE pos > h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS d, md5(length(role) || ':' || role || text) AS k,
  len(regexp_extract_all(text, 'WORDS')) AS words FROM rebuilt),
members AS (
  SELECT conv_id, 0 AS d, 0 AS words, '' AS key FROM ids
  UNION ALL SELECT conv_id, d, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) FROM turns),
nodes AS (SELECT key, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM members GROUP BY key),
kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
sums AS (SELECT left(key, 32 * e) AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM counted, unnest(range(depth + 1)) AS t(e) GROUP BY 1),
ends AS (SELECT key, sha256(string_agg(conv_id, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(key, d) AS key FROM members GROUP BY conv_id) GROUP BY key)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM counted c JOIN sums USING (key) LEFT JOIN ends USING (key) LEFT JOIN nodes p ON c.depth > 0 AND p.key = left(c.key, length(c.key) - 32)
""".replace("CRC", _CRC_TABLE).replace("HASH", _crc("conv_id")).replace("WORDS", _WORDS)


def rebuild_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and their ids: c begins with the first h turns of c - c % 20, h = crc32(c) % 4, and goes on with its own after h."""
    given = turns.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    placed = materialize(trie.number_turns(given, "role", "text"), "rebuilt-numbers")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    ids = given.select("conv_id").distinct()
    wanted = ids.select(F.col("conv_id").alias("own"), (F.col("conv_id") - F.col("conv_id") % 20).alias("conv_id"), h.alias("h")).where("h > 0")
    heads = placed.where("pos <= 3").join(wanted, "conv_id").where("pos <= h").select(F.col("own").alias("conv_id"), F.col("pos").alias("turn"), "role", "text")
    tails = placed.where(F.col("pos") > h).select("conv_id", (F.col("pos") + 3).alias("turn"), "role", "text")
    return heads.unionByName(tails), ids


@query("op13_double_array_trie", _TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuild_conversations(read_input(spark, sf_dir, "conversations"))
    nodes = trie.prefix_trie(turns, ids)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
