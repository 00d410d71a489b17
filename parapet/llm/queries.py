"""One registered query for each operator, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, decontamination, extraction, licences, lm, manifest, mixing, quality, search, sharding, simhash, store, toxicity
from .common import crc_remainder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_patterns"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = crc_remainder(F.col("doc_id"), 10) == 0
    model = lm.fit(docs, ~out, _tokenizer("byte_bpe_50k.tiktoken"))
    return lm.score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fair_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.topology(8)
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"), tree, sharding.grown(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.store_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(_read(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 3) == 0, manifest.lower_ascii(F.col("text")))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build(_read(spark, sf_dir, "documents"))
    return index.search(_read(spark, sf_dir, "benchmark"), 50)


def op13_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digest(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


_ALL = (
    op1_toxicity, op2_simhash, op3_extraction, op4_lm, op5_mixing, op6_sharding, op7_quality, op8_licences, op9_decontamination, op10_store,
    op11_manifest, op12_search, op13_bytebpe,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"[^\x20\x09-\x0D]+"

OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source),
levels AS (
  SELECT *, 2 * source_size / w AS r,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
one AS (SELECT arg_min(level, r) FILTER (WHERE level < r) AS level FROM levels),
t AS (
  SELECT source, source_size,
    CASE WHEN r > (SELECT level FROM one) THEN (SELECT level FROM one) * w ELSE CAST(2 * source_size AS DOUBLE) END AS target
  FROM levels),
q AS (
  SELECT d.doc_id, d.source, d.size, d.turn, t.source_size, t.target,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
offers AS (
  SELECT doc_id, source, size, turn, e, (sent + e * source_size) / target AS finish
  FROM q, (VALUES (0), (1)) AS v(e) WHERE size > 0 AND target > 0),
taken AS (
  SELECT *, sum(size) OVER (ORDER BY finish, coalesce(source, chr(1114111)), turn, coalesce(CAST(doc_id AS VARCHAR), ''), size ROWS UNBOUNDED PRECEDING) AS until FROM offers),
n AS (SELECT doc_id, count(*) AS copies FROM taken WHERE until <= (SELECT floor(sum(size) * CAST(1.5 AS DOUBLE)) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(n.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""

OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls, row_number() OVER () AS k
  FROM documents),
g AS (SELECT k, i, ws[i] || chr(0) || ws[i + 1] || chr(0) || ws[i + 2] AS gram FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
hit AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY k),
f AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
  FROM d LEFT JOIN rep USING (k)),
r AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, n_symbols > 0.1 * n_words AS symbols, n_dup_lines > 0.5 * n_lines AS lines FROM f),
h AS (SELECT host, rule, count(*) AS n, sum(CAST(failed AS INTEGER)) AS bad FROM (UNPIVOT (SELECT host, short, repeats, symbols, lines FROM r) ON short, repeats, symbols, lines INTO NAME rule VALUE failed) GROUP BY host, rule),
m AS (
  SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) ** 2 AS spread FROM h GROUP BY rule),
p AS (SELECT *, spread - mean * (1 - mean) * hosts / docs AS extra, docs / hosts AS heavy FROM m),
w AS (SELECT *, CASE WHEN extra > 0 THEN least(heavy, greatest(1.0, mean * (1 - mean) / extra - 1)) ELSE heavy END AS weight FROM p),
v AS (SELECT h.host, bool_and((h.bad + w.mean * w.weight) / (h.n + w.weight) <= 0.6) AS ok FROM h JOIN w USING (rule) GROUP BY h.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND v.ok AS kept
FROM r JOIN v ON r.host IS NOT DISTINCT FROM v.host
"""


def _op8_sql() -> str:
    sets = licences.template_sets()
    rows = ", ".join(f"({i}, '{name}', {grams!r})" for i, (name, grams) in enumerate(sets))
    sizes = [licences.size_bounds(len(grams), licences.THRESHOLD) for _, grams in sets]
    least, most = min(a for a, _ in sizes), max(b for _, b in sizes)
    n = licences.MAX_LINES
    return rf"""
WITH t(id, licence, grams) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
    list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls
  FROM documents),
l AS (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS j FROM d),
f AS (SELECT k, ls, j FROM l WHERE list_has_any(string_split(ls[j], ' '), {licences.marked_words(sets)!r})),
u AS (SELECT a.k, a.j, array_to_string(a.ls[a.j:b.j], ' ') AS unit FROM f a JOIN f b ON a.k = b.k AND b.j BETWEEN a.j AND a.j + {n - 1}
  UNION ALL SELECT k, 0, array_to_string(ls, ' ') FROM d WHERE len(ls) > {n}),
g AS (
  SELECT k, j, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams
  FROM (SELECT k, j, string_split_regex(trim(unit), ' +') AS ws FROM u) WHERE len(ws) <= {licences.word_limit(sets, licences.THRESHOLD)}),
s AS (SELECT row_number() OVER () AS r, * FROM g WHERE len(grams) BETWEEN {least} AND {most}),
m AS (
  SELECT r, k, j, licence, 2.0 * len(list_intersect(s.grams, t.grams)) / (len(s.grams) + len(t.grams)) AS dice
  FROM s JOIN t ON list_has_any(s.grams, t.grams)),
b AS (SELECT k, j, max({{'dice': CAST(dice AS DOUBLE), 'licence': licence}}) AS best FROM m WHERE dice >= 0.8 GROUP BY k, j),
a AS (SELECT k, count(*) AS n_matches, max(best) AS best, array_to_string(list_sort(list(DISTINCT best.licence)), ',') AS licences FROM b GROUP BY k)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_units, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, best.licence AS licence, best.dice AS dice, coalesce(licences, '') AS licences
FROM d LEFT JOIN a USING (k)
"""


def _op11_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** ``levels`` leaves a group, and as many groups."""
    field = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    crc = "list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), 'null'), ''), lambda x: ord(x))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))"
    step = "list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    parts = [f"""
WITH crc AS MATERIALIZED (SELECT list({step} ORDER BY i) AS tab FROM range(256) AS r(i)),
d AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {leaf("text")} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')")} ELSE {leaf("text")} END AS claimed FROM documents, crc)),
a0 AS (SELECT lang AS g, p, n, leaf AS h FROM d)"""]

    def tree(name: str) -> None:
        for k in range(levels):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, p // 8 AS p, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY p)) AS h FROM (SELECT * FROM {name}{k} WHERE n > 1) GROUP BY g, p // 8, (n + 7) // 8)")
            parts.append(f"{name}step{k} AS MATERIALIZED (SELECT x.g, x.p, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p < x.p), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.p) FILTER (y.p > x.p), '') AS r FROM {name}{k} x JOIN {name}{k} y ON x.g IS NOT DISTINCT FROM y.g AND x.p // 8 = y.p // 8 WHERE x.n > 1 GROUP BY x.g, x.p)")
        parts.append(f"{name}top AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    tree("a")
    parts.append("b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h, g AS lang FROM atop)")
    tree("b")
    parts.append("f0 AS (SELECT d.doc_id, d.lang, d.p, d.leaf, b0.p AS q, b0.h AS subroot, d.claimed AS h, '' AS proof FROM d JOIN b0 ON d.lang IS NOT DISTINCT FROM b0.lang)")
    for k in range(2 * levels):
        name, at, place, group = ("a", k, "p", "s.g IS NOT DISTINCT FROM f.lang") if k < levels else ("b", k - levels, "q", "true")
        parts.append(f"f{k + 1} AS (SELECT f.* REPLACE (CASE WHEN s.p IS NULL THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, f.proof || coalesce(s.l || s.r, '') AS proof) FROM f{k} f LEFT JOIN {name}step{at} s ON {group} AND s.p = f.{place} // {8**at})")
    return ",\n".join(parts) + f"""
SELECT f.doc_id, f.leaf, f.subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified FROM f{2 * levels} f, btop t
"""


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{manifest.UPPER}', '{manifest.LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ts FROM documents),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
q AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{manifest.UPPER}', '{manifest.LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS t
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM c) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p GROUP BY t),
s AS (
  SELECT q.i, q.item_id, p.r, p.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (t) JOIN w USING (t), c GROUP BY q.i, q.item_id, p.r, p.doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

ORACLE_SQL = {"op5_mixing": OP5_SQL, "op7_quality": OP7_SQL, "op8_licences": _op8_sql(), "op11_manifest": _op11_sql(), "op12_search": OP12_SQL}
