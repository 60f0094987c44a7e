"""The training-data operators as queries over the tables of a data set, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, chat_windows, decontamination, language_id, lattice_lm, line_dedup, merkle, mixing, secret_scan, simhash, token_counts, vector_search, whitening
from tallyloom.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary tokens by the rule "start"."""
    return token_counts.section_tokens(table(spark, sf_dir, "documents"), rule="start")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that quotes control strings, read back from the windows."""
    says = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_windows.digests(chat_windows.format_chats(turns))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, weights = language_id.train(docs, fold() != 0)
    return language_id.predict(docs.select("doc_id", "text"), langs, weights).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "base", "added")

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"), secret_scan.span_text(every).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of lines, of dropped lines, and the digest of what stays."""
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in each document."""
    found = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate")


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors for every fiftieth vector."""
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and lattice scores of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lattice_lm.log_likelihood(docs, fold() != 1)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the text decoded from them, as digests."""
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 32 strongest components, at unit covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and way to the root, and whether what a change of n_chars leaves of it still gives that root."""
    docs = table(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    changed = F.col("n_chars") + F.when(F.crc32(id_.cast("binary")) % 7 == 0, 1).otherwise(0)
    before, after = (merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (F.col("n_chars"), changed))
    found = merkle.manifest(docs.select("doc_id", "lang", before.alias("leaf"), after.alias("given")))
    again = found.withColumn("folded_root", merkle.folded(F.col("given"), F.col("proof")))
    return again.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (op1_token_counts, op2_chat_formatting, op3_language_id, op4_secret_scan, op5_line_dedup, op6_decontamination, op7_source_mixing, op8_vector_search, op9_near_duplicates, op10_lm_scoring, op11_bpe, op12_whitening, op13_merkle_manifest, pipeline)
    return {f.__name__: f for f in own}


_OP4_KINDS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, regexp_extract_all({'c' if k == 9 else 't'}, $p${p}$p$) AS f, regexp_split_to_array({'c' if k == 9 else 't'}, $p${p}$p$) AS g FROM d"
    for k, p in ((0, secret_scan.ASSIGN), (1, r"AKIA[A-Z0-9]+"), (2, r"[0-9a-f]+"), (9, secret_scan.CANDIDATE))
)
#: Token characters outside words of the allow-list, which blanks stand for.
_OP4_BLANKED = "coalesce(text, '')"
for _word in secret_scan.ALLOW_WORDS:
    _OP4_BLANKED = f"regexp_replace({_OP4_BLANKED}, '{''.join('[' + c.upper() + c + ']' for c in _word)}', repeat(' ', {len(_word)}), 'g')"
_OP4_ALLOWED = " OR ".join(f"regexp_matches(found, $p${p}$p$)" for p in secret_scan.ALLOW)
_OP4_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(found, $p${c.pattern}$p$) THEN {{{i}}}" for i, c in enumerate(secret_scan.CLASSES)) + " END"
#: Matches and the gaps between them give the places; every window's entropy is counted anew.
_OP4 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_OP4_BLANKED} AS c FROM documents),
m AS ({_OP4_KINDS}),
x AS (
  SELECT doc_id, k, unnest(f) AS found, unnest([list_sum([length(y) FOR y IN g[1:i]]) + coalesce(list_sum([length(y) FOR y IN f[1:i - 1]]), 0) FOR i IN range(1, len(f) + 1)]) AS s
  FROM m),
base AS (
  SELECT doc_id, k, CAST(s AS BIGINT) AS s, CAST(s + length(found) AS BIGINT) AS e FROM x
  WHERE k = 0 AND length(regexp_extract(found, $p$^{secret_scan.ASSIGN}$$p$, 2)) >= 12 OR k = 1 AND length(found) >= 18 OR k = 2 AND length(found) >= 16),
c AS (
  SELECT doc_id, found, s, {_OP4_CLASS.format(*(3 + i for i in range(3)))} AS k, {_OP4_CLASS.format(*(c.threshold for c in secret_scan.CLASSES))} AS least
  FROM x WHERE k = 9 AND NOT ({_OP4_ALLOWED}) AND len([p FOR p IN regexp_split_to_array(found, $p${secret_scan.SIGNS}$p$) IF NOT regexp_matches(p, $p${secret_scan.PLAIN}$p$)]) > 0),
w AS (SELECT *, unnest(range(1, length(found) - {secret_scan.WINDOW} + 2)) AS i FROM c),
h AS (SELECT *, string_split(substr(found, i, {secret_scan.WINDOW}), '') AS z FROM w),
n AS (SELECT *, list_sum([-log2(len([y FOR y IN z IF y = a]) / {secret_scan.WINDOW}.0) * len([y FOR y IN z IF y = a]) / {secret_scan.WINDOW}.0 FOR a IN list_distinct(z)]) AS bits FROM h),
added AS (
  SELECT doc_id, k, CAST(s + min(i) - 1 AS BIGINT) AS s, CAST(s + max(i) - 1 + {secret_scan.WINDOW} AS BIGINT) AS e FROM n WHERE bits >= least GROUP BY doc_id, k, s, found),
every AS (SELECT *, {list(secret_scan.KINDS)!r}[k + 1] || ':' || s || ':' || e AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM added))
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY s, k), '') AS spans
FROM d LEFT JOIN every ON d.doc_id = every.doc_id GROUP BY d.doc_id
"""

#: Lines by (doc_id, number) with their keys; chr(32) and chr(9) to chr(13) are stripped.
_OP5 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keep IS NOT NULL AND k.doc_id <> c.keep AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: The windows' rules on lengths alone; texts are put together only for the digests.
_OP2 = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role0, coalesce(text, '') AS text0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
base AS (
  SELECT *, replace(replace(role0, '\', '\\'), '<|', '<\|') AS role, replace(replace(text0, '\', '\\'), '<|', '<\|') AS text FROM raw),
seen AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens, length(role) + length(text) + 23 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM base),
sys AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system,
         max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id) AS sys_tokens,
         max(CASE WHEN pos = 1 AND role = 'system' THEN chars END) OVER (PARTITION BY conv_id) AS sys_chars FROM seen),
half AS (SELECT *, greatest(768 - coalesce(sys_tokens, 0), 2) // 2 AS half, CASE WHEN is_system THEN 0 ELSE tokens END AS body FROM sys),
sums AS (
  SELECT *, body > half AS large, sum(body) OVER w - body AS start,
         sum(CASE WHEN body <= half THEN body ELSE 0 END) OVER w AS small_end, sum(CASE WHEN body > half THEN 1 ELSE 0 END) OVER w AS larges
  FROM half WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
runs AS (
  SELECT *, CASE WHEN NOT is_system THEN (larges * 2 - large::INT) || ':' || CASE WHEN large THEN 0 ELSE (small_end - 1) // half END END AS run FROM sums),
opened AS (
  SELECT *, CASE WHEN NOT is_system AND lag(run) OVER w IS DISTINCT FROM run THEN 1 ELSE 0 END AS opens FROM runs WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
placed AS (
  SELECT *, greatest(sum(opens) OVER w, 1) AS win,
         CASE WHEN NOT is_system AND lead(opens, 1) OVER w = 1 AND lead(start, 1) OVER w - start <= 256 THEN 1 ELSE 0 END
         + CASE WHEN NOT is_system AND lead(opens, 2) OVER w = 1 AND lead(start, 2) OVER w - start <= 256 THEN 1 ELSE 0 END AS repeats
  FROM opened WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role0 || chr(10) || text0 || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text0)) FILTER (role0 = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text0, '' ORDER BY pos) FILTER (role0 = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars * (1 + repeats)) + coalesce(sum(sys_chars) FILTER (opens = 1 AND win > 1), 0) AS BIGINT) AS formatted_chars,
       CAST(max(win) AS BIGINT) AS n_windows
FROM placed GROUP BY conv_id
"""

_OP6 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bn AS (
  SELECT item_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0)),
dn AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i,
         unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS win
  FROM dw, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n),
h AS (SELECT DISTINCT doc_id, item_id, i, dn.n FROM dn JOIN bn USING (win, n)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id
"""

_OP8 = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([a.q[i] * b.q[i] FOR i IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: crc32 byte by byte; levels of pairs; a leaf is folded along them.
_OP13 = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, *, CAST(doc_id AS VARCHAR) AS id,
         list_reduce([4294967295] || [ascii(c) FOR c IN regexp_extract_all(CAST(doc_id AS VARCHAR), '.')],
           lambda a, b: list_reduce([xor(a, b)] || [0 FOR i IN range(8)], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM documents),
h AS (
  SELECT rid, doc_id, lang, [sha256(array_to_string([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN [id, source, lang, CAST(n AS VARCHAR), text]], '')) FOR n IN
         [n_chars, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END]] AS two FROM d),
a AS (SELECT rid, doc_id, lang, two[1] AS leaf, two[2] AS given, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, two[1]) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
t(level, lang, i, n, hash) AS (
  SELECT 0, lang, i, n, leaf FROM a
  UNION ALL SELECT level + 1, lang, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, lang, i // 2, n),
s AS (SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, n, hash) AS (
  SELECT 0, i, n, hash FROM s UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
f(rid, level, lang, i, n, own, sib) AS (
  SELECT rid, 0, lang, i, n, given, '' FROM a
  UNION ALL SELECT rid, f.level + 1, f.lang, f.i // 2, (f.n + 1) // 2, sha256(CASE f.i % 2 WHEN 0 THEN own || coalesce(hash, '') ELSE hash || own END), sib || coalesce(hash, '')
  FROM f LEFT JOIN t ON t.level = f.level AND t.lang IS NOT DISTINCT FROM f.lang AND t.i = xor(f.i, 1) WHERE f.n > 1),
g(rid, level, i, n, own, sib) AS (
  SELECT rid, 0, s.i, s.n, own, sib FROM f JOIN s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
  UNION ALL SELECT rid, g.level + 1, g.i // 2, (g.n + 1) // 2, sha256(CASE g.i % 2 WHEN 0 THEN own || coalesce(hash, '') ELSE hash || own END), sib || coalesce(hash, '')
  FROM g LEFT JOIN u ON u.level = g.level AND u.i = xor(g.i, 1) WHERE g.n > 1)
SELECT doc_id, leaf, s.hash AS subroot, r.hash AS root, sha256(sib) AS proof_sha256, own AS folded_root, own = r.hash AS verified
FROM a JOIN g ON g.rid = a.rid AND g.n = 1 JOIN s ON s.lang IS NOT DISTINCT FROM a.lang JOIN (SELECT hash FROM u WHERE n = 1) r ON true
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": _OP2, "op4_secret_scan": _OP4, "op5_line_dedup": _OP5, "op6_decontamination": _OP6, "op8_vector_search": _OP8, "op13_merkle_manifest": _OP13}
