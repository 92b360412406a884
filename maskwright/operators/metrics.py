"""Detection, stability, exposure and co-reference measures as grouped aggregations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import met


def marked(docs: DataFrame, mentions: DataFrame, predicted: DataFrame, every: bool = False) -> DataFrame:
    """``doc_id, ord, mention, sources``: tokens with the last mention that covers them (null: none) and the distinct sources that do.

    ``predicted(source, doc_id, start, end)``; ``mention`` holds ``ord``,
    ``type`` and ``entity``.  Without ``every`` bare tokens are left out.
    """
    layer = mentions.selectExpr("doc_id", "start", "end", "ord as m", "type", "entity", "cast(null as string) as source")
    layer = layer.unionAll(predicted.selectExpr("doc_id", "start", "end", "cast(null as int)", "cast(null as string)", "cast(null as string)", "source"))
    return met(docs, layer, every).selectExpr(
        "doc_id", "ord", "array_max(transform(filter(hits, h -> h.m is not null), h -> struct(h.m as ord, h.type as type, h.entity as entity))) as mention",
        "array_distinct(filter(transform(hits, h -> h.source), x -> x is not null)) as sources",
    )


def covered(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, ord, detectors``: tokens that a span overlaps, with the distinct detectors of those spans."""
    return met(docs, spans.select("doc_id", "start", "end", "detector")).selectExpr("doc_id", "ord", "array_sort(array_distinct(transform(hits, h -> h.detector))) as detectors")


def detection_score(docs: DataFrame, mentions: DataFrame, predicted: DataFrame, by: str = "mention.type") -> DataFrame:
    """``predicted(source, doc_id, start, end)`` -> per source and type (or class), and over all (null): tokens, hits and protected entities.

    A mention is masked if all its tokens are; an entity of a document if all
    its mentions are.  Tokens are counted once: hits by entity and source come
    from each token's own sources, totals meet the sources as rows of a type.
    """
    toks = marked(docs, mentions, predicted).where("mention is not null").selectExpr(f"{by} as type", "doc_id", "mention.entity as entity", "sources")
    # an entity's tokens and its hits by source, in one aggregation: the null source counts the tokens
    counts = toks.selectExpr("type", "doc_id", "entity", "explode(concat(array(cast(null as string)), sources)) as source").groupBy("type", "doc_id", "entity", "source").agg(F.count(F.lit(1)).alias("k"))
    held = counts.groupBy("type", "doc_id", "entity").agg(F.max(F.expr("if(source is null, k, 0)")).alias("n"), F.collect_list(F.expr("if(source is null, null, struct(source, k))")).alias("hits"))
    hit = held.selectExpr("type", "n", "explode(hits) as h").groupBy("type", "h.source").agg(F.sum("h.k").alias("hit_tokens"), F.count_if(F.expr("h.k = n")).alias("protected"))
    total = held.groupBy("type").agg(F.sum("n").alias("gold_tokens"), F.count(F.lit(1)).alias("entities"))
    every = predicted.select("source").distinct().crossJoin(F.broadcast(total))  # sources by types
    rows = every.join(hit, ["source", "type"], "left").na.fill(0, ["hit_tokens", "protected"])
    return rows.groupingSets([["source", "type"], ["source"]], "source", "type").agg(*(F.sum(c).alias(c) for c in ("gold_tokens", "hit_tokens", "entities", "protected")))


def detection_precision(docs: DataFrame, mentions: DataFrame, predicted: DataFrame) -> DataFrame:
    """``source, predicted, correct, precision``: covered tokens and those of them that a mention covers too."""
    toks = marked(docs, mentions, predicted).selectExpr("mention is not null as gold", "explode(sources) as source")
    rows = toks.groupBy("source").agg(F.count(F.lit(1)).alias("predicted"), F.count_if("gold").alias("correct"))
    return rows.withColumn("precision", F.col("correct") / F.col("predicted"))


def token_weights(tokens: DataFrame) -> DataFrame:
    """``word, weight``: information of a lower-cased token under an add-one unigram model."""
    counts = tokens.selectExpr("lower(tok) as word").groupBy("word").count()
    totals = counts.selectExpr("sum(count) as n", "count(1) as v")  # one row
    return counts.join(F.broadcast(totals)).selectExpr("word", "-log2((count + 1) / (n + v + 1)) as weight")


def stability(assigned: DataFrame, cross_document: bool) -> DataFrame:
    """``doc_id, type, entity, surrogate`` -> collision, fragmentation and, across documents, drift rates by type, and distinct surrogates."""
    collide = assigned.groupBy("type", "doc_id", "surrogate").agg(F.countDistinct("entity").alias("n")).groupBy("type").agg(F.avg((F.col("n") > 1).cast("double")).alias("collision"))
    split = assigned.groupBy("type", "doc_id", "entity").agg(F.countDistinct("surrogate").alias("n")).groupBy("type").agg(F.avg((F.col("n") > 1).cast("double")).alias("fragmentation"))
    across = assigned.groupBy("type", "entity").agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("surrogate").alias("n")).where("docs > 1")
    drift = across.groupBy("type").agg(F.avg((F.col("n") > 1).cast("double")).alias("drift"))
    surfaces = assigned.groupBy("type").agg(F.countDistinct("surrogate").alias("surfaces"))
    out = collide.join(split, "type").join(drift, "type", "left").join(surfaces, "type")
    return out if cross_document else out.withColumn("drift", F.lit(None).cast("double"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one pairing of rows and columns with the greatest total gain (shortest augmenting paths, cubic)."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, came, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            free = ~done[1:]
            slack = cost[owner[at] - 1] - row_price[owner[at]] - col_price[1:]
            better = free & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            nearest = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nearest]
            row_price[owner[done]] += step
            col_price[done] -= step
            least[1:][free] -= step
            at = nearest
            if not owner[at]:
                break
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _ceaf(rows: pd.DataFrame) -> float:
    g, p = rows["g"].astype("category").cat, rows["p"].astype("category").cat
    gain = np.zeros((len(g.categories), len(p.categories)))
    gain[g.codes, p.codes] = 2 * rows["k"] / (rows["n_g"] + rows["n_p"])
    return float(sum(gain[i, j] for i, j in assignment(gain)))


def coreference(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """``doc_id, mention, cluster`` twice -> MUC, B-cubed and CEAF-e precision, recall and F1 and their mean, by document; singletons dropped on both sides.

    Documents without a gold chain of two mentions have nothing to score and no
    row; a document without predicted chains scores 0.
    """

    def multi(x: DataFrame, name: str) -> DataFrame:
        sized = x.selectExpr("doc_id", "mention", f"cluster as {name}", f"count(1) over (partition by doc_id, cluster) as n_{name}")
        return sized.where(f"n_{name} > 1")

    both = multi(gold, "g").join(multi(predicted, "p"), ["doc_id", "mention"], "full")
    cells = both.groupBy("doc_id", "g", "p").agg(F.count(F.lit(1)).alias("k"), F.max("n_g").alias("n_g"), F.max("n_p").alias("n_p"))

    def side(x: str, y: str) -> DataFrame:
        per = cells.where(f"{x} is not null").groupBy("doc_id", x).agg(
            F.max(f"n_{x}").alias("n"), F.sum(F.expr(f"if({y} is null, k, 1)")).alias("pieces"), F.sum(F.expr(f"if({y} is null, 0, k * k / n_{x})")).alias("b3"))
        return per.groupBy("doc_id").agg(
            (F.sum(F.expr("n - pieces")) / F.sum(F.expr("n - 1"))).alias(f"muc_{x}"), (F.sum("b3") / F.sum("n")).alias(f"b3_{x}"), F.count(F.lit(1)).alias(f"chains_{x}"))

    met_ = cells.where("g is not null and p is not null")
    total = met_.groupBy("doc_id").applyInPandas(lambda x: pd.DataFrame({"doc_id": [x["doc_id"].iloc[0]], "ceaf": [_ceaf(x)]}), f"doc_id {gold.schema['doc_id'].dataType.simpleString()}, ceaf double")
    rows = side("g", "p").join(side("p", "g"), "doc_id", "left").join(total, "doc_id", "left").na.fill(0.0, ["muc_p", "b3_p", "ceaf"])
    rows = rows.selectExpr("doc_id", "muc_g as muc_recall", "muc_p as muc_precision", "b3_g as b3_recall", "b3_p as b3_precision", "ceaf / chains_g as ceaf_recall", "coalesce(ceaf / chains_p, 0) as ceaf_precision")
    f1 = lambda m: f"if({m}_recall + {m}_precision = 0, 0, 2 * {m}_recall * {m}_precision / ({m}_recall + {m}_precision)) as {m}_f1"
    return rows.selectExpr("*", *(f1(m) for m in ("muc", "b3", "ceaf"))).selectExpr("*", "(muc_f1 + b3_f1 + ceaf_f1) / 3 as conll")


def character_scores(mentions: DataFrame, predicted: DataFrame) -> DataFrame:
    """Gold and predicted characters and their intersection, by document; spans of one side must not overlap each other."""
    met = mentions.alias("g").join(predicted.alias("p"), F.expr("g.doc_id = p.doc_id and g.end > p.start and g.start < p.end"))
    both = met.selectExpr("g.doc_id", "least(g.end, p.end) - greatest(g.start, p.start) as n").groupBy("doc_id").agg(F.sum("n").alias("both_chars"))
    g = mentions.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("gold_chars"))
    p = predicted.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("predicted_chars"))
    return g.join(p, "doc_id", "full").join(both, "doc_id", "left").na.fill(0)


def clustering_scores(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """Character precision, recall and F1 of merged spans, and how they grow: ``gold(doc_id, start, end)``, ``spans(doc_id, start, end, merged)``.

    ``inflation`` is the mean of predicted over gold length of overlapping pairs,
    ``merge_rate`` the share of spans that joined more than one.  Spans of one
    side must not overlap each other.
    """
    pairs = gold.alias("g").join(spans.alias("p"), F.expr("g.doc_id = p.doc_id and g.end > p.start and g.start < p.end"))
    pairs = pairs.selectExpr("least(g.end, p.end) - greatest(g.start, p.start) as n", "(p.end - p.start) / (g.end - g.start) as grown").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("both"), F.avg("grown").alias("inflation"))
    g = gold.agg(F.sum(F.expr("end - start")).alias("g"))
    p = spans.agg(F.sum(F.expr("end - start")).alias("p"), F.avg(F.expr("cast(merged > 1 as int)")).alias("merge_rate"))
    rows = pairs.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(p))  # one row each
    return rows.selectExpr("both / p as precision", "both / g as recall", "2 * both / (g + p) as f1", "inflation", "merge_rate")


def exposure(mentions: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exposed share at four grains: mention, entity in a document, document, case (``mentions`` carries ``subject``)."""
    covered = mentions.alias("m").join(predicted.alias("s"), F.expr("m.doc_id = s.doc_id and s.start <= m.start and s.end >= m.end"), "left_semi").select("doc_id", "ord")
    flagged = mentions.join(covered.withColumn("safe", F.lit(1)), ["doc_id", "ord"], "left").withColumn("open", F.col("safe").isNull().cast("int"))
    grains = {"mention": ["doc_id", "ord"], "entity_document": ["doc_id", "entity"], "document": ["doc_id"], "case": ["subject"]}
    out = None
    for name, by in grains.items():
        rows = flagged.groupBy(*by).agg(F.max("open").alias("open")).selectExpr(f"'{name}' as grain", "open").groupBy("grain").agg(F.count(F.lit(1)).alias("units"), F.sum("open").alias("exposed"))
        out = rows if out is None else out.unionAll(rows)
    return out
