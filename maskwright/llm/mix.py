"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree of domains, languages and sources.  A token budget
goes down the tree by weight.  A node can hold no more than its tokens times
the epochs allowed; what it can't use goes to its siblings by weight, and only
what all of them can't use goes back up to the ancestors' siblings.  Each leaf
then reads seeded epochs, every one a permutation by hash of its documents, and
takes the prefix that holds its budget.

The tree has a row per leaf and is the only thing on the driver.  A prefix is
found without sorting a leaf: documents fall by hash into ``BUCKETS`` buckets,
whole buckets are in or out by their cumulative sums, and only the one bucket
where the budget ends is ordered.

Cases: null domain, language or source is a branch of its own; null text has
no tokens, and a document without tokens is taken if the prefix reaches it;
null ids are allowed; rows repeating id and text are ordered arbitrarily among
themselves; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch

#: Production parameters: targets by (domain,), (domain, language) or (domain, language, source), 1 where not named.
DOMAIN = "concat('domain', crc32(source) % 4)"
WEIGHTS: dict[tuple[str, ...], float] = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1}
SHARE, EPOCHS, SEED = 0.6, 2, 17
BUCKETS = 4096
#: Leaves (about 100 bytes each) that are broadcast; more are joined by shuffle, each leaf over ``SALT`` tasks.
BROADCAST_LEAVES, SALT = 50_000, 32
NULL = "(null)"
LEVELS = ("domain", "lang", "source")

_TEXT = "btrim(coalesce(text, ''), ' \\t\\n\\u000b\\f\\r')"
_WORDS = rf"if({_TEXT} = '', 0L, cast(size(split({_TEXT}, '[ \\t-\\r]+')) as bigint))"

Leaf = tuple[str, ...]


def share_out(budget: int, weights: Sequence[float], room: Sequence[int]) -> list[int]:
    """Whole tokens for siblings by weight, none over its room; shortages go to the others by weight."""
    out, open_ = [0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    exact = [Fraction(w).limit_denominator(10**9) for w in weights]
    while open_ and left:
        total = sum(exact[i] for i in open_)
        full = [i for i in open_ if left * exact[i] >= room[i] * total]
        if full:
            for i in full:
                out[i] = room[i]
            left -= sum(room[i] for i in full)
            open_ = [i for i in open_ if i not in set(full)]
            continue
        parts = [left * exact[i] / total for i in open_]
        for i, p in zip(open_, parts, strict=True):
            out[i] = int(p)
        rest = left - sum(int(p) for p in parts)
        for i, _ in sorted(zip(open_, parts, strict=True), key=lambda x: (int(x[1]) - x[1], x[0]))[:rest]:
            out[i] += 1
        break
    return out


def budgets(tokens: Mapping[Leaf, int], weights: Mapping[Leaf, float], budget: int, epochs: int) -> dict[Leaf, int]:
    """Each leaf's budget: ``share_out`` at every node from the root down."""
    room: dict[Leaf, int] = {}
    for leaf, n in tokens.items():
        for depth in range(len(leaf) + 1):
            room[leaf[:depth]] = room.get(leaf[:depth], 0) + n * epochs
    out: dict[Leaf, int] = {}

    def down(node: Leaf, amount: int) -> None:
        children = kids.get(node, [])
        if not children:
            out[node] = amount
            return
        for child, part in zip(children, share_out(amount, [weights.get(c, 1.0) for c in children], [room[c] for c in children]), strict=True):
            down(child, part)

    kids: dict[Leaf, list[Leaf]] = {}
    for x in sorted(room):
        if x:
            kids.setdefault(x[:-1], []).append(x)
    if tokens:
        down((), min(budget, room[()]))
    return out


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    domain: str = DOMAIN,
    weights: Mapping[Leaf, float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """A row for each time a document is taken: ``doc_id, mark, domain, lang, source, epoch, n_tokens, take_tokens``.

    The budget is ``share`` of all tokens (words); ``domain`` is SQL over the
    columns of ``docs``, ``mark`` a hash of the text.  The last document of a
    leaf's prefix may be taken in part.
    """
    scratch = Scratch(spark)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NULL))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), name(F.expr(domain)).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"))
    rows = scratch.keep(rows.selectExpr("doc_id", "xxhash64(coalesce(text, '')) as mark", *LEVELS, f"{_WORDS} as n_tokens"), "tokens")
    tokens = {tuple(r[:3]): int(r[3]) for r in rows.groupBy(*LEVELS).agg(F.sum("n_tokens")).collect()}  # a row for each leaf
    parts = budgets(tokens, weights, int(share * sum(tokens.values())), epochs)
    plan = [(*leaf, *(divmod(parts.get(leaf, 0), n) if n else (0, 0))) for leaf, n in sorted(tokens.items())]
    leaves = spark.createDataFrame(plan, "domain string, lang string, source string, full long, rest long")
    if len(plan) <= BROADCAST_LEAVES:
        rows = rows.join(F.broadcast(leaves), list(LEVELS))
    else:  # a leaf's documents are dealt over SALT tasks, each of which gets the leaf's row
        rows = rows.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, mark), {SALT})"))
        rows = rows.join(leaves.withColumn("salt", F.expr(f"explode(sequence(0L, {SALT - 1}L))")), [*LEVELS, "salt"]).drop("salt")
    rows = rows.withColumn("at", F.expr(f"xxhash64({seed}, full, doc_id, mark)"))
    rows = rows.withColumn("bucket", F.expr(f"cast(floor((at / 18446744073709551616D + 0.5D) * {buckets}) as int)"))
    sums = rows.where("rest > 0").groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = scratch.keep(sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))), "buckets")
    whole = rows.where("full > 0").selectExpr("doc_id", "mark", *LEVELS, "explode(sequence(0L, full - 1)) as epoch", "n_tokens", "n_tokens as take_tokens")
    met = rows.where("rest > 0").join(sums.where("before is not null"), [*LEVELS, "bucket"]).where("before < rest")
    inside = met.where("before + size <= rest").selectExpr("doc_id", "mark", *LEVELS, "full as epoch", "n_tokens", "n_tokens as take_tokens")
    order = Window.partitionBy(*LEVELS, "bucket").orderBy("at", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    edge = met.where("before + size > rest").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    edge = edge.where("start < rest").selectExpr("doc_id", "mark", *LEVELS, "full as epoch", "n_tokens", "least(n_tokens, rest - start) as take_tokens")
    return whole.unionAll(inside).unionAll(edge)
