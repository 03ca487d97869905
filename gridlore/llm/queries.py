"""The thin queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm.common import small_batches


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.sentencepiece_table import encode_documents

    return encode_documents(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridlore.llm.packing import pack_documents, special_tokens

    special = special_tokens(tokenizer_file("byte_bpe_50k.json"))
    return pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.jaccard_partenum import jaccard_components

    return jaccard_components(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.quality_pu import score_documents

    return score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.language_cnn import identify_documents

    return identify_documents(documents(spark, sf_dir))


#: verdict, host, path
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.url_markov import judge_urls

    judged = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)
    return judged.withColumn("score", F.round("score", 6))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.ann_srs import nearest_vectors

    return nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.suffix_dedup import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.toxicity_automata import score_documents

    return score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.filter_audit import audit_filters

    return audit_filters(documents(spark, sf_dir), labels(spark, sf_dir))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the id ends in 0, the text's words from some place on repeat with some period."""
    from gridlore.llm.common import crc_of_id
    from gridlore.llm.filter_audit import words_of

    h = crc_of_id()
    cut = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"), F.floor(h / 10).alias("g"))
    n, long = F.size("words"), lambda c: c.cast("long")
    placed = cut.select("*", F.when(n > 0, long(F.col("g") % n)).alias("a"))
    placed = placed.select("*", (1 + F.call_function("div", n - F.col("a"), 3 + F.col("g") % 8)).alias("p"))
    turned = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.periodic_runs import periodic_runs

    found = periodic_runs(with_planted_runs(documents(spark, sf_dir)))
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlore.llm.minmax_dedup import minmax_components

    return minmax_components(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_packing": op2_packing,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_fingerprints": op4_fingerprints,
        "op5_quality": op5_quality,
        "op6_language": op6_language,
        "op7_url_filter": op7_url_filter,
        "op8_neighbours": op8_neighbours,
        "op9_toxicity": op9_toxicity,
        "op10_repeated_passages": op10_repeated_passages,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_minmax_dedup": op13_minmax_dedup,
    }


#: Counts by the set of failed filters, then every step of every order by itself; no potentials.
AUDIT_SQL = r"""WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  m AS (SELECT part, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
      + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS INTEGER)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask, quality, toxic
    FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM m GROUP BY part, mask),
  f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
  o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
  s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS gone FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
  x AS (SELECT part, filter_order, step, bit, sum(n) FILTER (WHERE mask & (gone | bit) = 0) AS kept, sum(n) FILTER (WHERE mask & gone = 0 AND mask & bit <> 0) AS removed,
      sum(n) FILTER (WHERE mask & gone <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (WHERE mask = bit) AS unique_fails,
      sum(good) FILTER (WHERE mask & gone = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & gone = 0 AND mask & bit <> 0) AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
    CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM x"""


def url_sql() -> str:
    """The rules, both models and the threshold of ``op7_url_filter``, order by order."""
    from gridlore.llm.url_markov import ALPHABET, HELD, ORDER

    rules = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(kind, h, p)}'" for kind, h, p in rules) + " END"
    part = lambda k: f"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"
    models = []
    for k in range(ORDER + 1):
        low = [f"CAST({1 / ALPHABET!r} AS DOUBLE)"] * 2 if k == 0 else ["p.a", "p.b"]
        lower = "" if k == 0 else f"JOIN p{k - 1} p ON p.gram = substring(n.gram, 2, {k})"
        chance = lambda c, x: f"(n.{c} + greatest(c.{c}_kinds, 1) * {x}) / CAST(c.{c}_all + greatest(c.{c}_kinds, 1) AS DOUBLE)"
        models.append(f"""n{k} AS (SELECT substring(gram, {ORDER + 1 - k}, {k + 1}) AS gram, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1),
  c{k} AS (SELECT substring(gram, 1, {k}) AS context, sum(a) AS a_all, sum(b) AS b_all, count(*) FILTER (WHERE a > 0) AS a_kinds, count(*) FILTER (WHERE b > 0) AS b_kinds FROM n{k} GROUP BY 1),
  p{k} AS (SELECT n.gram, {chance("a", low[0])} AS a, {chance("b", low[1])} AS b FROM n{k} n JOIN c{k} c ON c.context = substring(n.gram, 1, {k}) {lower})""")
    return f"""WITH r AS (SELECT page_id, url, translate({part(1)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {part(2)} AS path FROM pages),
  u AS (SELECT url, count(*) AS copies, any_value({case(lambda kind, h, p: kind)}) AS kind, CAST('0x' || substring(md5(url), 1, 6) AS BIGINT) % {HELD} = 0 AS held FROM r WHERE url IS NOT NULL GROUP BY url),
  g AS (SELECT url, copies, kind, held, substring(t, CAST(place AS BIGINT), {ORDER + 1}) AS gram FROM (SELECT *, unnest(range(1, length(t) - {ORDER} + 1)) AS place FROM (
    SELECT *, repeat(chr(2), {ORDER}) || translate(lower(url), '0123456789', '0000000000') || chr(3) AS t FROM u))),
  counts AS (SELECT gram, coalesce(sum(copies) FILTER (WHERE kind = 'allow' AND NOT held), 0) AS a, coalesce(sum(copies) FILTER (WHERE kind = 'block' AND NOT held), 0) AS b FROM g GROUP BY gram),
  {", ".join(models)},
  s AS (SELECT url, any_value(kind) AS kind, any_value(held) AS held, avg(ln(p.a) - ln(p.b)) AS score FROM g JOIN p{ORDER} p ON p.gram = g.gram GROUP BY url),
  h AS (SELECT kind, avg(score) AS mean, coalesce(stddev_pop(score), 0) + CAST(0.000001 AS DOUBLE) AS spread FROM s WHERE held AND kind IS NOT NULL GROUP BY kind),
  t AS (SELECT CASE WHEN (SELECT count(*) FROM h) = 2 THEN (SELECT (a.mean * b.spread + b.mean * a.spread) / (a.spread + b.spread) FROM h a, h b WHERE a.kind = 'allow' AND b.kind = 'block')
    WHEN (SELECT count(DISTINCT kind) FROM s) = 2 THEN CAST(0 AS DOUBLE) END AS threshold)
  SELECT page_id, host, path, {case(lambda kind, h, p: h + p)} AS rule, coalesce({case(lambda kind, h, p: kind)}, CASE WHEN score < threshold THEN 'block' ELSE 'allow' END) AS verdict,
    round(score - coalesce(threshold, 0), 6) AS score FROM r LEFT JOIN s ON r.url = s.url, t"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": url_sql(), "op11_filter_audit": AUDIT_SQL}
