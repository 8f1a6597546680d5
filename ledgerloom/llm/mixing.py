"""Mixing sources to target weights.

Words are aggregated per source, a source's target gives its repetition rate, and each document is
taken floor(rate) times, plus once more with the probability of the rate's fraction, by a hash.

The draws are systematic: a source's documents of like size (as many binary digits) stand in the order of a
hash, and the one at place i gets the copy if a whole number lies between i x fraction and (i + 1) x fraction,
both moved by an offset. Offsets are hash-seeded, so every document's probability is the fraction, while the
words of documents of like size stray from their share by about a document. Of a few such offsets a source uses
those whose words come nearest to its target, which matters for sources of few documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.llm.common import WORDS, cut, rank_within


def _targets(per: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per source (columns source, source_size) with its ``target``.

    Capped shares by weight: a level is looked for such that min(cap, level x weight) adds up to the
    whole. With sources in the order of cap / weight, the level is that of the first source that its
    own level does not fill.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    all_rows = W.partitionBy(F.lit(1))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("level", (
        (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(all_rows)["level"])
    return t.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that the seed and the columns decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(*cols)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _fraction(rate: Column) -> Column:
    return rate - F.floor(rate)


def _drawn(fraction: Column, offset: Column, step: Column) -> Column:
    """1 if the document at ``place`` among those of like size gets one copy more, else 0."""
    moved = offset + F.col("digits") * step
    return (F.floor((F.col("place") + 1) * fraction + moved) - F.floor(F.col("place") * fraction + moved)).cast("long")


def rates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", offsets: int = 32,
) -> DataFrame:
    """Per row: ``doc_id``, ``th``, ``size`` (words), ``source_size``, ``target``, ``copies``, ``taken``.

    Sources by code point, null last and a source like others, weigh ``weights``, repeating; together
    they get ``share`` of all words, each at most ``most`` times its own. Null texts have no words.
    Places are by a hash of ``doc_id`` (null: of the text), then ``doc_id`` and the text, so reruns agree;
    rows that repeat all of that get neighbouring places, in any order. Sources without words
    have target 0. A target of 2 takes each document twice. An empty table gives no rows.
    """
    rows = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        uniform(seed, F.col(id_col).cast("string"), F.col(text_col), F.lit("")).alias("u"),
    ))
    per = _targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = cut(per.withColumn("rate", rate).withColumnRenamed("source", "s"))
    rows = rows.withColumn("digits", F.length(F.bin("size")))
    # cells in the order of places, by the hash's first bits, so a hot source never meets in one task
    order = [F.col("u"), F.col("doc_id").asc_nulls_last(), F.col("th")]
    placed = rank_within(rows, ["source", "digits"], order, [F.floor(F.col("u") * 256)], "place")
    met = cut(placed.join(per, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    fraction = _fraction(F.col("rate"))
    at = [[uniform(f"{seed}:{x}{k}", F.col("source"), F.lit("")) for x in ("offset", "step")] for k in range(offsets)]
    words = [F.sum((F.floor(F.col("rate")) + _drawn(fraction, F.col(f"o{k}"), F.col(f"s{k}"))) * F.col("size")).alias(f"w{k}") for k in range(offsets)]
    drawn = [c.alias(f"{x}{k}") for k, pair in enumerate(at) for x, c in zip("os", pair, strict=True)]
    seeds = per.select(F.col("s").alias("source")).select(F.col("source").alias("r"), *drawn)
    tried = met.join(seeds, F.col("source").eqNullSafe(F.col("r"))).groupBy("source").agg(F.first("target").alias("t"), *words)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("t")).alias("off"), F.lit(k).alias("k"), *[c.alias(x) for x, c in zip("os", at[k], strict=True)]) for k in range(offsets)]))
    tried = tried.select(F.col("source").alias("s"), best["o"].alias("offset"), best["s"].alias("step"))
    met = met.join(tried, F.col("source").eqNullSafe(F.col("s")))
    copies = (F.floor(F.col("rate")) + _drawn(fraction, F.col("offset"), F.col("step"))).cast("long")
    return met.select("doc_id", "th", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Columns stay as they are.

    Takes the options of ``rates``. Rows that repeat both ``doc_id`` and text have one decision: what ``rates``
    gives them on average, its fraction by a hash.
    """
    id_col, text_col, seed = options.get("id_col", "doc_id"), options.get("text_col", "text"), options.get("seed", "mix")
    took = rates(docs, **options).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.avg("copies").alias("_n"))
    drawn = uniform(f"{seed}:again", F.concat(F.col("_d").cast("string"), F.lit(":"), F.col("_t").cast("string")), F.col("_t").cast("string"), F.lit(""))
    took = took.select("_d", "_t", (F.floor("_n") + (drawn < _fraction(F.col("_n"))).cast("int")).cast("int").alias("_n"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col)).alias("_h"))
    met = rows.join(took, F.col("_id").eqNullSafe(F.col("_d")) & F.col("_h").eqNullSafe(F.col("_t"))).where("_n > 0")
    return met.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of each row, as ``rates`` has them."""
    return rates(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap
  FROM per
), l AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0::DOUBLE))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS lev
  FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size,
         least(cap, weight * (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, source ASC NULLS LAST LIMIT 1)) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, length(bin(d.size)) AS digits,
         row_number() OVER (PARTITION BY d.source, length(bin(d.size)) ORDER BY d.u, d.doc_id ASC NULLS LAST) - 1 AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT source, k, ('0x' || substr(md5('mix:offset' || k || ':' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS offs,
         ('0x' || substr(md5('mix:step' || k || ':' || coalesce(source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS step
  FROM (SELECT DISTINCT source FROM t), range(32) AS x(k)
), c AS (
  SELECT r.*, o.k, (floor(rate) + floor((place + 1) * (rate - floor(rate)) + (offs + digits * step)) - floor(place * (rate - floor(rate)) + (offs + digits * step)))::BIGINT AS copies
  FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source
), best AS (
  SELECT source, k FROM (SELECT source, k, abs(sum(copies * size) - any_value(target)) AS off FROM c GROUP BY source, k)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM c JOIN best ON c.source IS NOT DISTINCT FROM best.source AND c.k = best.k
"""
