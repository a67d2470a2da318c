"""Mixing sources to target weights.

Every document gets a hash-random key.  Within each source the documents are
ranged by that key, a distributed prefix sum of their sizes is taken (a sum per
key range, a running sum over the ranges, a running sum inside each range), and
the source is cut where the prefix sum meets its budget.  Budgets above the
size of the source take whole epochs first.

The ranges are prefixes of a uniform hash, so a source that holds most of the
rows is spread over as many ranges as any other.

Defined results for odd input
-----------------------------
* null text: size 0, taken 0; null ``source``: a source of its own, ordered last;
* null ``doc_id``: keyed by the text, so that many of them spread too; repeated
  rows are separate documents that share a key, taken one after the other in the
  order of id, size and a hash of the text; texts of any length are counted whole;
* an empty table gives an empty plan; a source without words has target 0;
* columns of the input, of any name, are kept by ``apply_mix``; ``plan_mix`` reads
  only ``doc_id``, ``text`` and ``source``, and refuses to carry a column of its own names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickflow.llm.shared import aside

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the key that name a range: 16 ** 4 ranges in each source.
RANGE_DIGITS = 4
#: Names that the plan gives its own columns.
OWN = {"doc_id", "source", "size", "source_size", "target", "taken", "epochs", "cut", "hkey", "digest", "skey", "range", "offset", "start", "budget"}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """``totals`` (source, source_size) with ``target`` words for each source.

    The weights repeat over the sources in code point order.  A target is
    ``min(max_epochs * size, level * weight)``: the level at which the targets
    add up is the largest of the levels found by capping a prefix of the sources
    in the order of cap to weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    rows = (
        totals.withColumn("pos", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    capped = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(min(float(share), float(max_epochs))) * F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("level", (total - capped) / left)
    level = F.max("level").over(Window.partitionBy())
    return rows.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "source_size", "target")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: size, source_size, target, taken, and ``carry`` columns.

    ``taken`` counts the words that the mix takes from the document, repeats
    included; the document at the cut gives its first words only.
    """
    if clash := OWN.intersection(carry):
        raise ValueError(f"columns to carry have names of the plan: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(text, "UTF-8")))))
    sized = docs.select(
        "doc_id", "source", *carry, word_count(F.col("text")).alias("size"), key.alias("hkey"), F.xxhash64(text).alias("digest")
    )
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = sized.withColumn("skey", name).withColumn("range", F.substring("hkey", 1, RANGE_DIGITS))

    ranges = sized.groupBy("skey", "source", "range").agg(F.sum("size").alias("range_size"))
    totals = ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs).withColumn("skey", name).drop("source")
    before = F.sum("range_size").over(
        Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = ranges.select("skey", "range", F.coalesce(before, F.lit(0)).alias("offset")).join(targets, "skey")

    inside = Window.partitionBy("skey", "range").orderBy("hkey", "doc_id", "size", "digest")
    start = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start") - F.col("offset")))
    return (
        sized.withColumn("start", start)
        .join(offsets, ["skey", "range"])
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("cut", cut.cast("long"))
        .select(
            "doc_id",
            *carry,
            "size",
            "source_size",
            "target",
            (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
            "epochs",
            "cut",
        )
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: whole epochs, then the cut.

    A document is repeated once per epoch; in the last, partial epoch the
    documents before the cut are whole and the one at the cut keeps its first
    words with the white space between them.  ``n_chars``, if there, follows.
    Documents without words are kept once, so that nothing clean is lost.
    """
    moved, back = aside(docs, "doc_id", "text", "source")
    at = dict(zip(docs.columns, moved.columns, strict=False))
    plan = plan_mix(moved, carry=list(at.values()), **options)
    text, size = F.col(at["text"]), F.col("size")
    copies = F.when(size == 0, F.lit(1)).otherwise(F.col("epochs") + (F.col("cut") > 0).cast("long")).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    short = F.array_join(F.slice(pieces, F.lit(1), F.col("cut").cast("int")), "")
    partial = (size > 0) & (F.col("copy") > F.col("epochs")) & (F.col("cut") < size)
    out = plan.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    out = out.withColumn("partial", partial).withColumn(at["text"], F.when(partial, short).otherwise(text))
    if "n_chars" in at:
        n = F.when(F.col("partial"), F.char_length(at["text"])).otherwise(F.col(at["n_chars"]))
        out = out.withColumn(at["n_chars"], n.cast(docs.schema["n_chars"].dataType))
    return out.select(*back)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS hkey
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY source IS NULL, source) AS pos
  FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM totals)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, least(cap, (SELECT max(level) FROM levels) * weight) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5::DOUBLE)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY hkey, s.doc_id, s.size
                            ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, budget - epochs * source_size - start)))::BIGINT AS taken
FROM cut
"""
