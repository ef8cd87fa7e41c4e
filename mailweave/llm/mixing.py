"""Mixing sources to target weights by capped water-filling (native).

Every source wants a share of the mix in proportion to its weight, but is
clamped at ``max_epochs`` times its size; the excess is shared again among the
others by weight until none is above. A source's target is then met by whole
repetitions of all its documents and one fractional repetition: documents in a
seeded order are taken whole until the rest of the target is used up, and the
last one by its first words only.

Defined cases: a null text has size 0 and nothing is taken of it; a null source
is a source of its own, ordered last; rows with the same doc_id count each;
identical rows may be told apart only by what is taken of them (the same
multiset on every run); an empty table gives no rows; other columns of the
input are ignored unless named in ``keep``, where a name of the result wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, staged, word_count

SEED = "mix-1"
OUT = ("doc_id", "size", "source_size", "target", "repeats", "taken")


def sized(docs: DataFrame, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Size and seeded position of each document; ``b1``, ``b2`` cut the order
    of a source into 4,096 x 4,096 ranges, so no window holds a whole source."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                             F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    return (docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col("doc_id").alias("_id"),
                        F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"),
                        draw.alias("_draw"))
            .withColumn("_b1", F.substring("_draw", 1, 3)).withColumn("_b2", F.substring("_draw", 4, 3)))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Water-filling over (``_source``, ``_source_size``): adds ``_target``.

    The level rises until every source is either clamped or below its cap;
    each round is one aggregate of which two numbers reach the driver."""
    order = [F.col("_source").asc_nulls_last()]
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = staged(ranked(sources, order, "mix_rank")
               .withColumn("_w", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
               .withColumn("_cap", F.col("_source_size") * F.lit(float(max_epochs))).drop("rank"), "mix_sources")
    row = s.agg((F.sum("_source_size") * F.lit(float(share))).alias("t"), F.sum("_w").alias("w")).first()
    if row.w is None:
        return s.withColumn("_target", F.lit(0.0))
    total, level = row.t, row.t / row.w
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        row = s.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("used"),
                    F.sum(F.when(~full, F.col("_w")).otherwise(0.0)).alias("w")).first()
        if row.w == 0:
            return s.withColumn("_target", F.least(F.col("_cap"), F.lit(level) * F.col("_w")))
        again = (total - row.used) / row.w
        if again <= level:
            return s.withColumn("_target", F.least(F.col("_cap"), F.lit(level) * F.col("_w")))
        level = again


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
        seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``keep`` columns, doc_id, size, source_size, target, repeats,
    taken): ``taken`` words of each document, ``repeats`` whole passes among
    them."""
    keep = tuple(c for c in keep if c.lower() not in OUT)
    d = sized(docs, seed, keep)
    h = staged(d.groupBy("_source", "_b1", "_b2").agg(F.sum("_size").alias("_sum")), "mix_ranges")
    sources = h.groupBy("_source").agg(F.sum("_sum").alias("_source_size"))
    s = targets(sources, weights, share, max_epochs)
    whole = F.floor(F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0))
    s = (s.withColumn("_whole", whole)
         .withColumn("_rest", F.round(F.col("_target") - F.col("_whole") * F.col("_source_size")).cast("long"))
         .select(F.col("_source").alias("_s"), "_source_size", "_target", "_whole", "_rest"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    h1 = (h.groupBy("_source", "_b1").agg(F.sum("_sum").alias("_sum"))
          .withColumn("_first", F.coalesce(F.sum("_sum").over(before("_source", "_b1")), F.lit(0)))
          .join(s, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
          .withColumnsRenamed({"_source": "_s", "_b1": "_s1"}))
    h2 = (h.withColumn("_second", F.coalesce(F.sum("_sum").over(before("_source", "_b1", "_b2")), F.lit(0)))
          .join(h1, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b1") == F.col("_s1")))
          .select(F.col("_source").alias("_s"), F.col("_b1").alias("_s1"), F.col("_b2").alias("_s2"),
                  "_source_size", "_target", "_whole", "_rest", (F.col("_first") + F.col("_second")).alias("_base")))
    own = Window.partitionBy("_source", "_b1", "_b2").orderBy("_draw", "_size")
    d = d.withColumn("_in", F.coalesce(F.sum("_size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(h2, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b1") == F.col("_s1"))
               & (F.col("_b2") == F.col("_s2")))
    extra = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_base") - F.col("_in")))
    return d.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], F.col("_id").alias("doc_id"),
                    F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                    F.col("_target").alias("target"), F.col("_whole").cast("long").alias("repeats"),
                    (F.col("_whole") * F.col("_size") + extra).cast("long").alias("taken"))


#: DuckDB: the same rows from the definition, with plain windows.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('mix-1:', COALESCE(CAST(doc_id AS VARCHAR), ''), ':', md5(COALESCE(text, '')))) AS draw
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         COALESCE(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s),
l AS (SELECT max((total - used) / rest) AS level FROM c),
t AS (SELECT c.source, c.source_size, least(c.cap, l.level * c.w) AS target FROM c, l),
r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size,
         CAST(round(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM r
"""
