"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Rules count words, symbols, repeated lines and words of repeated three-word
windows.  The verdict compares two multinomials over hashed words, and two over
hashed word pairs: one of trusted documents, one of the whole corpus.  A
document's score is the mean log ratio of its words plus ``PAIRS`` times that of
its pairs.  Ratios are drawn towards zero by a prior of ``PRIOR`` trusted counts
a bucket, so rare words, which say least, weigh least.  A document passes at or
above the threshold that best parts good from toxic or bad among labelled
documents held out of the fit (greatest share of bad ones rejected less ``COST``
times the share of good ones lost; the lowest of equal ones).  Log ratios are
fixed-point integers, so sums don't depend on the order of rows.

The corpus model counts every document.  The trusted model is fitted on at most
``TRUSTED`` labelled documents (least hashed ids first); their ids, and the
table of ``2**(BITS + 1)`` log ratios, are the only things broadcast.  The threshold
counts every held-out labelled document; without good or without bad ones, all
but ``SHARE`` of the held-out good, else of the trusted documents reach it.

Cases: null text has no words and fails; the rules hold for texts of any
length; a null id is scored but never trusted; rows repeating id and text get
the same result; no trusted document, or an empty table, makes every ratio zero
and the threshold zero; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch

TRUSTED = 20_000
BITS = 16
SCALE = 1_000_000
#: Trusted counts added to every bucket of words and of pairs, weight of the pairs' mean, and of good documents lost.
PRIOR, PAIRS, COST = (4.0, 20.0), 0.25, 2
#: Labelled documents whose remainder is this one are held out of the fit.
FOLDS, HELD = 4, 2
#: Share of good documents that may score below the threshold where no bad ones are labelled, and the step of scores counted for it.
SHARE, STEP = 0.002, 0.001
#: Rules: fewer words than this, or more than this per cent of words in repeated windows, fail.
MIN_WORDS, MAX_REPEAT = 50, 50

_SPACE = r"[ \\t-\\r]+"
_TEXT = "coalesce(text, '')"
_TRIMMED = rf"btrim({_TEXT}, ' \t\n\u000b\f\r')"
_WORDS = rf"if({_TRIMMED} = '', cast(array() as array<string>), split({_TRIMMED}, '{_SPACE}'))"


def base_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` -> ``doc_id, mark`` and the counts; ``mark`` is a hash of the text."""
    rows = docs.selectExpr("doc_id", f"xxhash64({_TEXT}) as mark", f"{_TEXT} as text", f"{_WORDS} as words")
    rows = rows.selectExpr(
        "doc_id", "mark", "text", "words",
        "if(size(words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))) as grams",
        r"filter(split(text, '\n'), x -> x rlike '[^ \\t-\\r]') as lines",
    )
    # windows found twice: sorted by hash and place, those equal to a neighbour; each adds the words no earlier one covers
    rows = rows.selectExpr(
        "doc_id", "mark", "text", "words", "lines",
        "if(size(grams) = size(array_distinct(grams)), cast(null as array<struct<g: bigint, i: int>>), array_sort(transform(grams, (g, i) -> struct(g as g, i as i)))) as sorted",
    )
    places = "array_sort(transform(filter(transform(sorted, (s, j) -> struct(s.i as i, coalesce(s.g = get(sorted, j - 1).g, false) or coalesce(s.g = get(sorted, j + 1).g, false) as twice)), s -> s.twice), s -> s.i))"
    return rows.selectExpr(
        "doc_id", "mark",
        "cast(size(words) as bigint) as n_words",
        "cast(length(array_join(words, '')) as bigint) as word_chars",
        "cast(regexp_count(text, '[#*$%&|<>]') as bigint) as n_symbols",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        f"if(sorted is null, 0L, aggregate({places}, struct(-3 as last, 0L as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)) as n_repeat_words",
    )


def _grams(docs: DataFrame, bits: int, *carry: str) -> DataFrame:
    """A row for every word and pair of words of every text, each hashed to ``2**bits`` buckets, those of pairs after those of words."""
    pairs = docs.selectExpr(*carry, f"{_WORDS} as words").selectExpr(*carry, "explode(arrays_zip(words, slice(words, 2, greatest(size(words) - 1, 0)))) as pair")
    pairs = pairs.selectExpr(*carry, "pair.`0` as a", "pair.`1` as b") if "0" in pairs.schema["pair"].dataType.names else pairs.selectExpr(*carry, "pair.words as a", "pair.`1` as b")
    mask = (1 << bits) - 1
    both = f"if(b is null, array(cast(xxhash64(a) & {mask} as int)), array(cast(xxhash64(a) & {mask} as int), cast(xxhash64(a, b) & {mask} as int) + {1 << bits}))"
    return pairs.selectExpr(*carry, f"explode({both}) as bucket")


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """At most ``limit`` ids of labelled good, not toxic documents that are not held out."""
    good = labels.where(f"crc32(cast(doc_id as string)) % {FOLDS} != {HELD}").where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def held_out(labels: DataFrame) -> DataFrame:
    """``doc_id, bad``: held-out labelled documents; bad are the toxic ones and those of low quality."""
    rows = labels.where(f"crc32(cast(doc_id as string)) % {FOLDS} = {HELD}").selectExpr("doc_id", "case when quality = 0 or toxic = 1 then 1 when quality = 1 then 0 end as bad")
    return rows.where("bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))


def parting(steps: list[tuple[int, int, int]], share: float) -> int | None:
    """Of sorted ``(step, good, bad)`` the step at which to start keeping; None without good ones."""
    good, bad = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not good:
        return None
    lost = cut = 0
    best, at = None, None
    for step, g, b in steps:
        if bad:
            gain = cut * good - COST * lost * bad
            if best is None or gain > best:
                best, at = gain, step
        elif lost + g > share * good:
            return step
        lost, cut = lost + g, cut + b
    return at if bad else steps[-1][0]


def log_ratios(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> DataFrame:
    """``bucket, ratio``: fixed-point log of trusted over expected counts, the corpus's share of all trusted ones, each with the prior; one row per bucket."""
    flagged = docs.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left").select("text", "good")
    counts = _grams(flagged, bits, "good").groupBy("bucket").agg(F.count("good").alias("t"), F.count(F.lit(1)).alias("c"))
    every = docs.sparkSession.range(2 << bits).selectExpr("cast(id as int) as bucket")
    counts = every.join(counts, "bucket", "left").selectExpr("bucket", f"bucket div {1 << bits} as kind", "coalesce(t, 0) as t", "coalesce(c, 0) as c")
    totals = counts.groupBy("kind").agg(F.sum("t").alias("nt"), F.sum("c").alias("nc"))  # two rows
    prior = f"if(kind = 0, {PRIOR[0]}D, {PRIOR[1]}D)"
    ratio = f"if(nt = 0, 0L, cast(round({SCALE} * ln((t + {prior}) / (c * (nt / nc) + {prior}))) as bigint))"
    return counts.join(F.broadcast(totals), "kind").selectExpr("bucket", f"{ratio} as ratio")


def quality_rules(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRUSTED, bits: int = BITS, share: float = SHARE
) -> DataFrame:
    """One row per row of ``docs``: the counts, ``base_failed``, ``llr`` (mean log ratio), ``threshold`` and ``kept``."""
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    trusted = scratch.keep(trusted_ids(labels, limit), "trusted")
    ratios = scratch.keep(log_ratios(rows, trusted, bits), "ratios")
    marked = rows.selectExpr("doc_id", "text", f"xxhash64({_TEXT}) as mark")
    scores = _grams(marked, bits, "doc_id", "mark").join(F.broadcast(ratios), "bucket").groupBy("doc_id", "mark")
    word = F.col("bucket") < (1 << bits)
    sums = [F.coalesce(F.sum(F.when(k, F.col("ratio"))), F.lit(0)).alias(f"total_{n}") for n, k in (("w", word), ("p", ~word))]
    sums += [F.count_if(k).alias(f"n_{n}") for n, k in (("w", word), ("p", ~word))]
    mean = f"(total_w / n_w + {PAIRS}D * coalesce(total_p / nullif(n_p, 0), 0)) / {SCALE}"
    scores = scratch.keep(scores.agg(*sums).selectExpr("doc_id", "mark", f"{mean} as llr"), "scores")
    threshold = 0.0
    for marks in (held_out(labels), F.broadcast(trusted.withColumn("bad", F.lit(0)))):
        steps = scores.join(marks, "doc_id").groupBy(F.floor(F.col("llr") / STEP).alias("step")).agg(F.count_if(F.col("bad") == 0), F.count_if(F.col("bad") == 1))
        step = parting(sorted(tuple(r) for r in steps.collect()), share)  # a row for each step of a bounded range of scores
        if step is not None:
            threshold = step * STEP
            break
    out = base_rules(rows).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words"))
    got = scores.select(F.col("doc_id").alias("id2"), F.col("mark").alias("mark2"), "llr")
    out = out.join(got, out["doc_id"].eqNullSafe(got["id2"]) & (out["mark"] == got["mark2"]), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", F.lit(threshold).alias("threshold"),
        (~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False))).alias("kept"),
    )
