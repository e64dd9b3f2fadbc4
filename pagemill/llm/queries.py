"""The registered queries of the numbered operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import attention, bayes, compression, grammar, lines, merkle, packing, repeats, resampling, simhash, suffixes, tagpaths, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(folds: int) -> Column:
    """Whether the row belongs to the held-out fold; a row without an id does not."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 2, F.lit(False))


@query
def op1_lines(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"), count="removed")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return cleaned.select("doc_id", F.when(F.col("removed").isNull(), 0).otherwise(n_removed).cast("long").alias("n_removed"), "removed", "text")


@query
def op2_compression(spark: SparkSession, sf: str) -> DataFrame:
    return compression.compression_rules(table(spark, sf, "documents"))


@query
def op3_tagpaths(spark: SparkSession, sf: str) -> DataFrame:
    return tagpaths.extracted(table(spark, sf, "pages"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return grammar.secrets(docs, grammar.learn(docs))


@query
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query
def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = bayes.fit(docs.select("text", F.when(~held_out(4), F.col("lang")).alias("label")))
    return bayes.predicted(docs, model).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


@query
def op8_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op9_attention(spark: SparkSession, sf: str) -> DataFrame:
    found = attention.language_model_scores(table(spark, sf, "documents"), held_out(7))
    return found.select("doc_id", held_out(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op10_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = suffixes.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), named_only=False)
    n_hit = suffixes.covered("ranges")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened(table(spark, sf, "embeddings"))


@query
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.proofs(table(spark, sf, "documents"))


@query
def op13_repeats(spark: SparkSession, sf: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["past"] - s["first"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op10_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
item_at AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM sized),
item_windows AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS t FROM item_at),
doc_at AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k),
doc_windows AS (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS t FROM doc_at),
found AS (SELECT r, p, k, item_id FROM doc_windows JOIN item_windows USING (k, t)),
hit AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + k)) AS q FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n, list_sort(list(DISTINCT item_id)) AS l FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(array_to_string(items.l, ','), '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def _octopus_sql(levels: int = 12, top_levels: int = 4) -> str:
    """Trees level by level, then every leaf's walk to the root, by joins on the runs above it.

    Unrolled to trees of 8^12 leaves and 8^4 languages.
    """
    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = (
        "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), "
        "lambda crc, byte: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, step: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), "
        "CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    )
    kids = "list(digest ORDER BY idx)"

    def tree(name: str, bottom: str, count: int) -> list[str]:
        parts = [f"{name}0 AS ({bottom})"]
        for level in range(count):
            parts.append(f"{name}_runs{level} AS (SELECT tree, idx // 8 AS p, {kids} AS kids, any_value(size) AS size FROM {name}{level} WHERE size > 1 GROUP BY tree, idx // 8)")
            parts.append(
                f"{name}{level + 1} AS (SELECT tree, p AS idx, sha256(array_to_string(kids, '')) AS digest, (size + 7) // 8 AS size FROM {name}_runs{level} "
                f"UNION ALL SELECT tree, idx, digest, size FROM {name}{level} WHERE size = 1)"
            )
        runs = " UNION ALL ".join(f"SELECT tree, {level} AS level, p, kids FROM {name}_runs{level}" for level in range(count))
        return [*parts, f"{name}_runs AS ({runs})"]

    def walk(name: str, start: str, count: int) -> list[str]:
        parts = [f"{name}_walk0 AS ({start})"]
        for level in range(count):
            others = "list_concat(kids[:w.idx % 8], kids[w.idx % 8 + 2:])"
            cut = "list_concat(list_concat(kids[:w.idx % 8], [w.cur]), kids[w.idx % 8 + 2:])"
            parts.append(
                f"{name}_walk{level + 1} AS (SELECT w.r, w.tree, w.idx // 8 AS idx, CASE WHEN kids IS NULL THEN w.cur ELSE sha256(array_to_string({cut}, '')) END AS cur, "
                f"CASE WHEN kids IS NULL THEN w.proof ELSE w.proof || array_to_string({others}, '') END AS proof "
                f"FROM {name}_walk{level} w LEFT JOIN {name}_runs{level} k ON k.tree = w.tree AND k.p = w.idx // 8)"
            )
        return parts

    own = "SELECT tree, pos AS idx, leaf AS digest, size FROM leaves"
    parts = [
        f"hashed AS (SELECT doc_id, coalesce('L' || hex(lang), '-') AS tree, {leaf.format(part.format('text'))} AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN {leaf.format(part.format(lowered))} END AS changed FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS r, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
        "count(*) OVER (PARTITION BY tree) AS size FROM hashed)",
        *tree("n", own, levels),
        f"subroots AS (SELECT tree AS lang_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM n{levels})",
        *tree("t", "SELECT 'top' AS tree, idx, digest, size FROM subroots", top_levels),
        *walk("n", "SELECT r, tree, pos AS idx, coalesce(changed, leaf) AS cur, '' AS proof FROM leaves", levels),
        *walk("t", f"SELECT w.r, 'top' AS tree, s.idx, w.cur, w.proof FROM n_walk{levels} w JOIN subroots s ON s.lang_tree = w.tree", top_levels),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, "
        f"w.cur AS folded_root, w.cur = t.digest AS verified FROM leaves l JOIN subroots s ON s.lang_tree = l.tree "
        f"JOIN t_walk{top_levels} w ON w.r = l.r, t{top_levels} t"
    )


ORACLES["op12_merkle"] = _octopus_sql()

# bytes are two hexadecimal digits each; strings are cut out of pieces of 512 bytes and the 49 after them
ORACLES["op13_repeats"] = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(hex(encode(text)), '') AS h FROM documents),
places AS (SELECT r, doc_id, h, unnest(range(0, length(h) // 2 - 49, 512)) AS k FROM d),
cut_up AS (SELECT r, doc_id, k, substring(h, 2 * k + 1, 1122) AS h FROM places),
windows AS (SELECT r, doc_id, k + j AS s, substring(h, 2 * j + 1, 100) AS t FROM (SELECT r, doc_id, k, h, unnest(range(0, least(512, length(h) // 2 - 49))) AS j FROM cut_up) w),
owners AS (SELECT t, min(doc_id) AS first_id FROM windows GROUP BY t HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, s FROM windows JOIN owners USING (t) WHERE first_id < doc_id),
marked AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM hit),
runs AS (SELECT r, min(s) AS first, max(s) + 50 AS past FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM marked) m GROUP BY r, run),
pieces AS (SELECT r, first, past, coalesce(lag(past) OVER (PARTITION BY r ORDER BY first), 0) AS start FROM runs),
cut AS (SELECT r, sum(past - first) AS removed, count(*) AS n, max(past) AS tail, string_agg(substring(h, 2 * start + 1, 2 * (first - start)), '' ORDER BY first) AS kept
        FROM pieces JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
