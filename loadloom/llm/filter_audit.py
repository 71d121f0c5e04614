"""Interaction of filters: who removes what, in every order of the filters.

*Masks.* Native expressions say of each row which conditions it fails, as bits of one number. The last filter, repeated
texts, needs the table: a grouping by text (by its SHA-256) gives the least id of each.
*Histogram.* Rows are counted by mask and part: with n filters 2^n cells a part hold all there is to know.
*Orders.* What each filter removes at each step of each of the n! orders is a sum over a part's cells; no row is looked at again.

A text that a third of all rows have is counted before it is shuffled: of each (text, mask, part, labels) the rows, the least
id and the rows with that id are added up in every task, so its group has as many rows as there are parts and labels.

Defined results. A null text is an empty one: it has no words, so it fails a least number of words and no share. A null part is the
empty string. A null id is not larger than any and has no label; its row repeats nothing. Rows with the same id and text all stay, for no id is
smaller. A doc_id with several labels counts as 1 where one of them is 1. A part has its rows if it has a document, zeros included; an
empty table gives no rows. Texts are taken whole; columns of the input beside the three named ones are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space between words.
BLANK = r"[\x20\x09-\x0D]+"
#: What the conditions of the query ask of a text.
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_CAPITALS_PCT, SYMBOLS = 200, 50, 3, r"[#$%&*|]"
#: The name of the filter of repeated texts.
REPEATED = "E"


def conditions(text: Column, words: Column) -> dict[str, Column]:
    """Failures that a row shows by itself; no part of them is null for a text that isn't."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS_PCT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def _or_of(bits: list[Column]) -> Column:
    out = F.lit(0)
    for b in bits:
        out = out.bitwiseOR(b)
    return out


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id, part, digest, mask`` of every row, with the bits of all filters but the last."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("text"), F.col("words")).values())]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _or_of(bits).alias("mask"))


def histogram(rows: DataFrame, labels: DataFrame, bit: int) -> DataFrame:
    """Of :func:`masks` the cells ``part, mask, n, good, toxic``; ``bit`` is that of repeated texts."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    tagged = rows.join(known, "doc_id", "left").na.fill(0, ["quality", "toxic"])
    kinds = ["digest", "part", "mask", "quality", "toxic"]
    ids = tagged.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
    each = ids.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    first = F.min("least").over(Window.partitionBy("digest"))
    fresh = F.col("no_id") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    each = each.withColumn("fresh", fresh)
    cells = F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(bit).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    cells = each.select("part", "quality", "toxic", F.explode(cells).alias("x")).select("part", "quality", "toxic", "x.*")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders(cells: DataFrame, names: str) -> DataFrame:
    """The rows of every part, order and step from the cells of a :func:`histogram`; ``names`` has a letter for each bit, from the lowest on."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^n cells
    every = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])
    steps = parts.select("part", "cells", F.explode(every).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(names)))).alias("step"))
    letter = lambda at: F.substring("filter_order", at, 1)
    bit_of = lambda c: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(names), c) - 1)
    before = [F.when(F.col("step") > i, bit_of(letter(i))).otherwise(0) for i in range(1, len(names))]
    steps = steps.withColumns({"filter": letter(F.col("step")), "before": _or_of(before)}).withColumn("bit", bit_of(F.col("filter")))

    def total(which, field: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, x: acc + F.when(which(x["mask"]), x[field]).otherwise(0))

    own = lambda m: m.bitwiseAND(F.col("bit")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: own(m) & ~earlier(m)
    got = steps.select(
        "part", "filter_order", "step", "filter",
        total(lambda m: ~own(m) & ~earlier(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: own(m) & earlier(m)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"), total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
    )
    return got.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """By part, order of the filters and step: documents kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = masks(docs, id_col, text_col, part_col)
    names = "".join(conditions(F.lit(""), F.array())) + REPEATED
    return orders(histogram(rows, labels, 1 << names.index(REPEATED)), names)


SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
+ CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS q, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(q, 0)) AS g, sum(coalesce(x, 0)) AS x FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM f p, f q, f r, f s, f t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
a AS (SELECT part, filter_order, step, b, sum(CASE WHEN mask & (before | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before <> 0 AND mask & b <> 0 THEN n ELSE 0 END) AS redundant,
sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & b <> 0 THEN x ELSE 0 END) AS toxic_lost FROM c, k GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM a"""
