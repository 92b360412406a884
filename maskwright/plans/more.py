"""Further registered queries: taxonomy, ports, inventories, patch sets, occurrences, trained scorers, candidate attacks, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest16
from ..operators import attacks, audits, combine, construct, dedup, detect, inventory, linear, metrics, occurrences, patches, ports, ranking, reports, sampling, select, stats, tasks, taxonomy
from ..staging import written
from .queries import _POOL, _SWEEP, VOCABULARY, Tables, _features, _sweep, query
from .sqltext import LABEL

# --- taxonomy and ports -------------------------------------------------------------------------
query(
    "taxonomy_routes", "detector:S type_src:S type:S was_mapped:B n:L",
    f"""SELECT detector, type_src, coalesce(t, 'MISC') AS type, t IS NOT NULL AS was_mapped, count(*) AS n FROM (SELECT *, CASE label_ WHEN 'PERSON' THEN 'PERSON' WHEN 'PER' THEN CASE WHEN detector LIKE 'hf:%' THEN 'PERSON' END END AS t
        FROM (SELECT CASE WHEN ord % 2 = 0 THEN 'presidio:' || detector ELSE 'hf:Davlan/xlm-roberta-large-ner-hrl' END AS detector, type_src, {LABEL} AS label_ FROM raw)) GROUP BY ALL""",
)(
    lambda t: taxonomy.harmonise(t.raw.withColumn("detector", F.expr("if(ord % 2 = 0, concat('presidio:', detector), 'hf:Davlan/xlm-roberta-large-ner-hrl')")))
    .groupBy("detector", "type_src", "type", "was_mapped").agg(F.count(F.lit(1)).alias("n"))
)
query("prompt_windows", "doc_id:L start:L digest:S", r"SELECT doc_id, start, sha256(chunk) AS digest FROM (SELECT doc_id, start, substring(text, start + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 800)) AS start FROM documents)) WHERE regexp_matches(chunk, '\S')")(
    lambda t: ports.prompt_windows(t.docs, 800).selectExpr("doc_id", "start", "sha2(chunk, 256) as digest")
)
query("answer_caps", "doc_id:L cap:L", "SELECT doc_id, greatest(512, least(greatest(512, ceil(greatest(1, ceil(length(text) / 2.5)) * 1.5) + 512), 7168 - greatest(1, ceil(length(text) / 2.5)))) AS cap FROM documents WHERE length(text) > 0")(
    lambda t: t.docs.where("length(text) > 0").selectExpr("doc_id", f"{ports.answer_cap('text', 8192, 1.5)} as cap")
)
query("static_replay", "doc_id:L detector:S start:L end:L", "SELECT s.doc_id, 'stored' AS detector, s.start, s.\"end\" FROM spans s JOIN documents d USING (doc_id) WHERE d.lang = 'de' AND s.detector = 'pair'")(
    lambda t: ports.replay(t.docs.where("lang = 'de'"), t.spans.where("detector = 'pair'"), "stored").select("doc_id", "detector", "start", "end")
)


@query("grounded_replies", "doc_id:L start:L end:L type_src:S")
def _grounded(t: Tables) -> DataFrame:
    """Surfaces of the reference layer, written as replies with white space and case changed, found again in the texts."""
    said = t.gold.selectExpr("doc_id", "struct(ord, replace(text, '.', '') as text, type) as x").groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return ports.grounded(t.docs, said.selectExpr("doc_id", "0 as start", "to_json(transform(x, y -> struct(y.text as text, y.type as type))) as reply"), "model")


# --- inventories --------------------------------------------------------------------------------
def _stock(t: Tables) -> DataFrame:
    nation = t.table("nation").selectExpr("n_nationkey as k", "n_regionkey as r")
    return t.table("supplier").join(nation, F.expr("s_nationkey = k")).selectExpr("'PERSON' as type", "cast(r as string) as lang", "s_name as surface", "cast(s_suppkey % 17 + 1 as double) as freq", "if(s_suppkey % 2 = 0, 'f', 'm') as gender").where("lang <> '4'")


def _drawers(t: Tables) -> DataFrame:
    nation = t.table("nation").selectExpr("n_nationkey as k", "n_regionkey as r")
    return t.table("customer").join(nation, F.expr("c_nationkey = k")).selectExpr("c_custkey", "'PERSON' as type", "cast(r as string) as lang", "c_custkey * 2654435761 % 4294967296 as idx", "if(c_custkey % 3 = 0, 'f', null) as gender").where("lang <> '4'")


_STOCK = "SELECT n_regionkey AS lang, s_name AS surface, (s_suppkey % 17 + 1)::DOUBLE AS freq, CASE WHEN s_suppkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 4"
_DRAWERS = "SELECT c_custkey, n_regionkey AS lang, c_custkey * 2654435761 % 4294967296 AS idx, CASE WHEN c_custkey % 3 = 0 THEN 'f' END AS gender FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 4"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY freq DESC, surface) - 1 AS place, count(*) OVER (PARTITION BY {0}) AS n, sum(freq) OVER (PARTITION BY {0} ORDER BY freq DESC, surface ROWS UNBOUNDED PRECEDING) AS upto, sum(freq) OVER (PARTITION BY {0}) AS total FROM (" + _STOCK + ")"
query("inventory_uniform", "c_custkey:L surrogate:S", f"SELECT c_custkey, surface AS surrogate FROM ({_DRAWERS}) d JOIN ({_RANKED.format('lang')}) s ON d.lang = s.lang AND s.place = d.idx % s.n")(lambda t: inventory.drawn(_drawers(t), _stock(t)).select("c_custkey", "surrogate"))
query("inventory_weighted", "c_custkey:L surrogate:S", f"SELECT c_custkey, arg_min(surface, place) AS surrogate FROM ({_DRAWERS}) d JOIN ({_RANKED.format('lang')}) s ON d.lang = s.lang AND s.upto > d.idx / 4294967296.0 * s.total GROUP BY 1")(
    lambda t: inventory.drawn(_drawers(t), _stock(t), weighted=True).select("c_custkey", "surrogate")
)
query(
    "inventory_strata", "c_custkey:L surrogate:S",
    f"""SELECT c_custkey, coalesce(a.surface, s.surface) AS surrogate FROM ({_DRAWERS}) d JOIN ({_RANKED.format('lang')}) s ON d.lang = s.lang AND s.place = d.idx % s.n
        LEFT JOIN ({_RANKED.format('lang, gender')}) a ON d.lang = a.lang AND d.gender = a.gender AND a.place = d.idx % a.n""",
)(lambda t: inventory.drawn(_drawers(t), _stock(t), attributes=["gender"]).select("c_custkey", "surrogate"))
query("inventory_attested", "type:S lang:S surface:S freq:L", "SELECT type, lang, g.text AS surface, count(*) AS freq FROM gold g JOIN documents USING (doc_id) GROUP BY type, lang, g.text HAVING count(*) >= 2")(
    lambda t: inventory.attested(t.gold.withColumnRenamed("text", "surface").join(t.docs.select("doc_id", "lang"), "doc_id"))
)
query("inventory_uncovered", "type:S lang:S n:L", "SELECT type, lang, count(*) AS n FROM gold JOIN documents USING (doc_id) WHERE NOT (type = 'PERSON' AND lang IN ('en', 'de')) GROUP BY ALL")(
    lambda t: inventory.uncovered(t.gold.join(t.docs.select("doc_id", "lang"), "doc_id"), t.spark.createDataFrame([("PERSON", "en", "x", 1.0), ("PERSON", "de", "y", 1.0)], "type string, lang string, surface string, freq double"))
)

# --- patch sets ---------------------------------------------------------------------------------
_CHAIN = 'SELECT p.*, arg_min(g.entity, (g.start, g."end")) AS gold_entity FROM placed_b p LEFT JOIN gold g ON g.doc_id = p.doc_id AND g."end" > p.old_start AND g.start < p.old_end GROUP BY ALL'
query("patch_chains", "doc_id:L old_start:L gold_entity:S", f"SELECT doc_id, old_start, gold_entity FROM ({_CHAIN})")(lambda t: patches.with_chains(t.edits("B"), t.gold).select("doc_id", "old_start", "gold_entity"))
query(
    "patch_sets", "doc_id:L condition:S text_sha256:S skipped:L entries:L",
    """SELECT p.doc_id, condition, substring(sha256(text), 1, 16) AS text_sha256, coalesce(k, 0) AS skipped, entries FROM (
        SELECT doc_id, 'B' AS condition, count(*) AS entries FROM placed_b GROUP BY 1 UNION ALL SELECT doc_id, 'C', count(*) FROM placed_c GROUP BY 1) p JOIN documents USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS k FROM resolved WHERE NOT kept GROUP BY 1) USING (doc_id)""",
)(lambda t: patches.build(t.docs, t.resolved).selectExpr("doc_id", "condition", "text_sha256", "skipped", "size(entries) as entries"))
query("condition_a", "doc_id:L entries:L digest:S", "SELECT doc_id, 0 AS entries, sha256(text) AS digest FROM documents")(
    lambda t: patches.apply(t.docs, p := patches.build(t.docs, t.resolved, ("A",))).join(p, "doc_id").selectExpr("doc_id", "size(entries) as entries", "sha2(released, 256) as digest")
)
query(
    "remap_layer", "doc_id:L ord:L start:L end:L",
    """SELECT g.doc_id, g.ord, CASE WHEN a.doc_id IS NULL THEN g.start WHEN g.start >= a.old_end THEN g.start + a.new_end - a.old_end WHEN a.new_end - a.new_start = a.old_end - a.old_start THEN a.new_start + g.start - a.old_start ELSE a.new_start END AS start,
        CASE WHEN b.doc_id IS NULL THEN g."end" WHEN g."end" - 1 >= b.old_end THEN g."end" + b.new_end - b.old_end WHEN b.new_end - b.new_start = b.old_end - b.old_start THEN b.new_start + g."end" - b.old_start ELSE b.new_end END AS "end"
        FROM (SELECT *, "end" - 1 AS last_ FROM gold) g ASOF LEFT JOIN placed_b a ON g.doc_id = a.doc_id AND g.start >= a.old_start ASOF LEFT JOIN placed_b b ON g.doc_id = b.doc_id AND g.last_ >= b.old_start""",
)(lambda t: patches.remap(t.gold.select("doc_id", "ord", "start", "end"), t.edits("B")))


def _records(t: Tables) -> DataFrame:
    rows = t.spans.groupBy("doc_id", "detector").agg(F.count(F.lit(1)).alias("spans")).join(t.docs.select("doc_id", "text"), "doc_id")
    return rows.selectExpr("doc_id", "detector", "0 as seq", "spans", "if(doc_id % 9 = 0, 'old', " + digest16("text") + ") as text_sha256", "if(doc_id % 7 = 0, 'timeout', null) as error", "doc_id % 5 = 0 as truncated")


query(
    "usable_records", "doc_id:L detector:S spans:L",
    "SELECT doc_id, detector, count(*) AS spans FROM spans WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0 GROUP BY 1, 2",
)(lambda t: patches.usable(_records(t), t.docs).select("doc_id", "detector", "spans"))

# --- occurrences and causes ---------------------------------------------------------------------
_OUTCOME = """SELECT g.doc_id, g.ord, CASE WHEN coalesce(max((e.old_start <= g.start AND e.old_end >= g."end")::INT), 0) = 1 THEN 'covered' WHEN count(e.doc_id) > 0 THEN 'clipped' ELSE 'missed' END AS outcome
    FROM gold g LEFT JOIN (SELECT * FROM placed_b WHERE replacement <> text) e ON e.doc_id = g.doc_id AND e.old_end > g.start AND e.old_start < g."end" GROUP BY 1, 2"""


def _strict(t: Tables) -> DataFrame:
    """Edits of the release that only one detector's spans made, so that something is left to find."""
    return construct.edits(construct.assign(construct.resolve_overlaps(t.spans.where("detector = 'strict'")).where("kept")), construct.surrogate())


query("release_outcomes", "doc_id:L ord:L outcome:S", _OUTCOME)(lambda t: occurrences.from_release(t.gold, t.edits("B")).select("doc_id", "ord", "outcome"))
query(
    "findings_histogram", "bucket:S documents:L",
    f"SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS documents FROM (SELECT doc_id, count(*) FILTER (outcome <> 'covered') AS n FROM ({_OUTCOME}) GROUP BY 1) GROUP BY 1",
)(lambda t: occurrences.findings(occurrences.from_release(t.gold, t.edits("B"))))
query("overlap_losers", "doc_id:L start:L end:L winner_start:L winner_end:L", 'SELECT doc_id, start, "end", k.s AS winner_start, k.e AS winner_end FROM (SELECT *, last_value(CASE WHEN kept THEN {\'s\': start, \'e\': "end"} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS k FROM resolved) WHERE NOT kept')(
    lambda t: occurrences.losers(t.resolved)
)
query(
    "exposure_causes", "cause:S n:L",
    """SELECT cause, count(*) AS n FROM (SELECT CASE
        WHEN EXISTS (SELECT 1 FROM placed_b e WHERE e.doc_id = g.doc_id AND e.replacement <> e.text AND e.old_start <= g.start AND e.old_end >= g."end") THEN 'safe'
        WHEN EXISTS (SELECT 1 FROM placed_b e WHERE e.doc_id = g.doc_id AND e.replacement = e.text AND e.old_start <= g.start AND e.old_end >= g."end") THEN 'unchanged'
        WHEN EXISTS (SELECT 1 FROM placed_b e WHERE e.doc_id = g.doc_id AND e.replacement <> e.text AND e.old_end > g.start AND e.old_start < g."end") THEN 'clipped'
        WHEN EXISTS (SELECT 1 FROM resolved e WHERE e.doc_id = g.doc_id AND NOT e.kept AND e.start <= g.start AND e."end" >= g."end") THEN 'lost_overlap'
        WHEN EXISTS (SELECT 1 FROM spans e WHERE e.doc_id = g.doc_id AND e.start <= g.start AND e."end" >= g."end") THEN 'not_replaced'
        WHEN EXISTS (SELECT 1 FROM spans e WHERE e.doc_id = g.doc_id AND e."end" > g.start AND e.start < g."end") THEN 'clipped_detection' ELSE 'not_detected' END AS cause FROM gold g) GROUP BY 1""",
)(lambda t: occurrences.causes(t.gold, t.spans, t.resolved, t.edits("B")).groupBy("cause").agg(F.count(F.lit(1)).alias("n")))


@query("occurrences", "label:S replaced_type:S n:L persons:L")
def _occurrences(t: Tables) -> DataFrame:
    e = patches.with_chains(_strict(t), t.gold)
    found = occurrences.label_occurrences(t.docs, construct.splice(t.docs, e), e, t.gold.where("type = 'PERSON'"))
    return found.groupBy("label", "replaced_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("persons"))


@query("a2_outcomes", "observed:L attempted:L n_1_to_1:L n_1_to_many:L n_many_to_1:L n_many_to_many:L n_wrong:L n_abstained:L n_undetected:L correct:L c_at_1:D")
def _a2_outcomes(t: Tables) -> DataFrame:
    e = patches.with_chains(_strict(t), t.gold).where("type = 'PERSON'")
    names = attacks.prior(t.gold.where("type = 'PERSON'").groupBy(F.col("entity").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    aligned = attacks.align(attacks.observe(construct.splice(t.docs, e)), names, 0.1)
    truth = e.where("gold_entity is not null").selectExpr("replacement as surface", "gold_entity as entity", "false as real").unionByName(t.gold.where("type = 'PERSON'").selectExpr("text as surface", "entity", "true as real")).distinct()
    return attacks.a2_score(aligned, truth, names.count())


# --- trained scorers ----------------------------------------------------------------------------
def _labelled(t: Tables) -> DataFrame:
    return linear.text_counts(t.docs.select("doc_id", "text").join(t.table("labels").where("quality is not null"), "doc_id").selectExpr("doc_id", "text", "cast(quality as string) as label"))


@query("task_quality", "documents:L accuracy:D")
def _task_quality(t: Tables) -> DataFrame:
    """Quality labels predicted by two cross-fitted classifiers of words and characters."""
    rows = linear.spread_out(written(_labelled(t).drop("text"), "terms"), ["words_", "chars_"])
    got = linear.cross_fit(rows, ["words_", "chars_"], 2, 3, least=3, iterations=20)
    return got.agg(F.count(F.lit(1)).alias("documents"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))


query(
    "task_tags", "doc_id:L ord:L label:S",
    """SELECT t.doc_id, t.ord, coalesce(x.label, 'O') AS label FROM tokens t LEFT JOIN (SELECT doc_id, ord, arg_max(label, (s0, s1)) AS label FROM (
        SELECT t.doc_id, t.ord, s.start AS s0, s."end" AS s1, CASE WHEN t.ord = min(t.ord) OVER (PARTITION BY t.doc_id, s.start, s."end", s.type) THEN 'B-' ELSE 'I-' END || s.type AS label
        FROM tokens t JOIN union_ s ON t.doc_id = s.doc_id AND t."end" > s.start AND t.start < s."end") GROUP BY 1, 2) x USING (doc_id, ord)""",
)(lambda t: linear.task_tags(t.tokens, combine.combine(t.spans, t.docs, "union")).select("doc_id", "ord", "label"))


query("multilabel_scores", "doc_id:L tp:L n_gold:L n_got:L f1:D exact:B", """SELECT doc_id, len(list_intersect(a, b)) AS tp, len(list_distinct(a)) AS n_gold, len(list_distinct(b)) AS n_got, CASE WHEN n_gold + n_got = 0 THEN 1 ELSE 2 * tp / (n_gold + n_got) END AS f1, tp = n_gold AND tp = n_got AS exact
    FROM (SELECT doc_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM documents LEFT JOIN (SELECT doc_id, list(DISTINCT type) AS a FROM gold GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, list(DISTINCT type) AS b FROM spans WHERE detector IN ('mail', 'pair') GROUP BY 1) USING (doc_id))""")(
    lambda t: linear.multilabel_scores(
        t.docs.select("doc_id").join(t.gold.groupBy("doc_id").agg(F.collect_set("type").alias("gold")), "doc_id", "left").join(t.spans.where("detector in ('mail', 'pair')").groupBy("doc_id").agg(F.collect_set("type").alias("got")), "doc_id", "left")
        .selectExpr("doc_id", "coalesce(gold, cast(array() as array<string>)) as gold", "coalesce(got, cast(array() as array<string>)) as got")
    )
)
query("packed_scores", "task:S n:L", "SELECT 'quality' AS task, sum(quality) AS n FROM labels GROUP BY 1 HAVING sum(quality) > 0")(
    lambda t: linear.packed(t.table("labels").selectExpr("'quality' as task", "doc_id", "quality as score")).groupBy("task").agg(F.sum(F.expr("bitmap_count(bits)")).alias("n"))
)

# --- attacks ------------------------------------------------------------------------------------
query("a5_linkage", "queries:L rank1:D rank5:D mrr:D")(lambda t: attacks.rank_summary(ranking.learned_linkage(_features(t), VOCABULARY + 4, k=2)))


@query("a4_candidates", "items:L rank1:D rank5:D map:D recovered:L misled:L failed:L abstained:L")
def _a4(t: Tables) -> DataFrame:
    e = patches.with_chains(_strict(t), t.gold).where("type = 'PERSON'")
    items = ranking.items(construct.splice(t.docs, e), e, t.gold.where("type = 'PERSON'"), context=200)
    return ranking.report(ranking.score(items, ranking.similarity_ranker(items), "B"))


@query("linkage_ceiling", "side:S pairs:L mean:D")
def _ceiling(t: Tables) -> DataFrame:
    f = _features(t)
    out = None
    for side in ("gallery", "query"):
        rows = reports.pairwise_cosine(f.where(F.col("side") == side)).selectExpr(f"'{side}' as side", "pairs", "mean")
        out = rows if out is None else out.unionAll(rows)
    return out


# --- reports ------------------------------------------------------------------------------------
@query("utility_compare", "task:S condition:S kind:S shared:L interpretable:B p:D q:D")
def _compare(t: Tables) -> DataFrame:
    return reports.compare(t.quality.unionByName(t.graded))


query(
    "best_sources", "criterion:S source:S value:D",
    "WITH s AS MATERIALIZED (" + _SWEEP + ") " + " UNION ALL ".join(
        f"(SELECT '{n}' AS criterion, source, ({c})::DOUBLE AS value FROM s WHERE ({c}) IS NOT NULL ORDER BY round({c}, 12) DESC, source LIMIT 1)"
        for n, c in (("sensitivity", "sensitivity"), ("specificity", "specificity"), ("f1", "2 * sensitivity * precision / (sensitivity + precision)"), ("youden", "sensitivity + specificity - 1"), ("eager", "predicted"), ("careful", "-predicted"))
    ),
)(lambda t: reports.best_sources(t.spark.createDataFrame((s := _sweep(t)[1]).collect(), s.schema)))
query("recall_bands", "band:S sources:L mean:D sd:D", f"SELECT CASE WHEN sensitivity < 0.5 THEN '< 0.5' WHEN sensitivity < 0.7 THEN '< 0.7' WHEN sensitivity < 0.8 THEN '< 0.8' WHEN sensitivity < 0.9 THEN '< 0.9' WHEN sensitivity < 0.95 THEN '< 0.95' ELSE '>= 0.95' END AS band, count(*) AS sources, avg(1 - sensitivity) AS mean, stddev_samp(1 - sensitivity) AS sd FROM ({_SWEEP}) GROUP BY 1")(
    lambda t: reports.recall_bands(_sweep(t)[1].selectExpr("sensitivity as recall", "1 - sensitivity as leak"))
)
query(
    "auroc", "source:S positives:L negatives:L auroc:D",
    """SELECT source, sum(t) AS positives, sum(1 - t) AS negatives, (sum(r * t) - sum(t) * (sum(t) + 1) / 2) / nullif(sum(t) * sum(1 - t), 0) AS auroc FROM (
        SELECT source, t, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2 AS r FROM (SELECT source, n_chars AS s, quality AS t FROM documents JOIN labels USING (doc_id))) GROUP BY 1""",
)(lambda t: reports.auroc(t.docs.join(t.table("labels"), "doc_id"), "n_chars", "quality", "source"))
query("shard_plan", "source:S shard:L", f"SELECT source, (row_number() OVER (ORDER BY source) - 1) % 4 AS shard FROM ({' UNION ALL '.join(f'SELECT {chr(39)}{s}{chr(39)} AS source' for s, _, _ in select.plan(_POOL))})")(
    lambda t: reports.shards(select.sources(t.spark, _POOL), 4).select("source", "shard")
)
query("candidate_space", "source:S tokens:L beyond:L documents:L", "SELECT c.detector AS source, count(*) AS tokens, count(*) FILTER (b.ord IS NULL) AS beyond, count(DISTINCT c.doc_id) AS documents FROM covered c LEFT JOIN (SELECT doc_id, ord FROM covered WHERE detector = 'strict') b USING (doc_id, ord) GROUP BY 1")(
    lambda t: reports.candidate_space(metrics.covered(t.docs, t.spans).selectExpr("explode(detectors) as source", "doc_id", "ord"), "strict")
)
query("leak_ablation", "source:S spans:L", """SELECT source, count(*) AS spans FROM (SELECT DISTINCT detector AS source, doc_id, start, "end", ord FROM spans WHERE detector IN ('strict', 'mail')) GROUP BY 1
    UNION ALL SELECT source || '+gold', count(*) FROM (SELECT detector AS source, doc_id, start, "end" FROM spans WHERE detector IN ('strict', 'mail') UNION SELECT d, doc_id, start, "end" FROM gold CROSS JOIN (VALUES ('strict'), ('mail')) AS v(d) WHERE type = 'PERSON') GROUP BY 1""")(
    lambda t: reports.ablated(t.predicted.where("source in ('strict', 'mail')"), t.gold).groupBy("source").agg(F.count(F.lit(1)).alias("spans"))
)
query("sample_stamped", "doc_id:L provenance:S", "SELECT doc_id, 'document:0.2:4' AS provenance FROM documents ORDER BY sha256('4|' || doc_id::VARCHAR), doc_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.2, 0))::BIGINT FROM documents)")(
    lambda t: sampling.sample(t.docs.select("doc_id"), "document", 0.2, 4)
)
query("technique_aes_siv", "c_custkey:L idx:L")(lambda t: t.table("customer").selectExpr("c_custkey", f"{construct.keys.siv_index('c_name', 'c_mktsegment', construct.SIV_KEY)} as idx"))
query("technique_unique", "scope:S idx:L", "SELECT scope, row_number() OVER (ORDER BY sha256('7|' || scope), scope) - 1 AS idx FROM (SELECT DISTINCT entity AS scope FROM gold)")(lambda t: construct.drawn(t.gold.selectExpr("entity as scope"), 7))
query("score_pairs", "task:S condition:S shared:L", "SELECT task, condition, count(*) AS shared FROM (SELECT 'capitals' AS task, unnest(['B', 'C']) AS condition FROM documents WHERE length(text) > 0) GROUP BY 1, 2")(
    lambda t: stats.paired(t.graded).groupBy("task", "condition").agg(F.count(F.lit(1)).alias("shared"))
)
query("text_language_routes", "backbone:S n:L", "SELECT CASE lang WHEN 'de' THEN 'news' WHEN 'en' THEN 'web' ELSE 'multi' END AS backbone, count(*) AS n FROM documents GROUP BY 1")(
    lambda t: ports.routed(t.docs, {"de": "news", "en": "web"}, "multi")[0].groupBy("backbone").agg(F.count(F.lit(1)).alias("n"))
)
query("detectors_registered", "detector:S n:L", "SELECT detector, count(*) AS n FROM raw WHERE detector IN ('mail', 'pair') GROUP BY 1")(
    lambda t: ports.detect(t.docs, ["mail", "pair"]).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
)


# --- audits and tasks ---------------------------------------------------------------------------
_NEAR = 's.doc_id = g.doc_id AND s.type = g.type AND g."end" > s.start AND g.start < s."end"'
query(
    "rule_precision", "rule:S type:S spans:L exact:L overlap:L",
    f"""SELECT rule, type, count(*) AS spans, count(*) FILTER (e) AS exact, count(*) FILTER (k > 0) AS overlap FROM (SELECT s.detector AS rule, s.type, s.doc_id, s.start, s."end", coalesce(bool_or(g.start = s.start AND g."end" = s."end"), false) AS e, count(g.doc_id) AS k
        FROM spans s LEFT JOIN gold g ON {_NEAR} GROUP BY ALL) GROUP BY 1, 2""",
)(lambda t: audits.rule_precision(t.spans, t.gold))
query("rule_recall", "rule:S type:S found:L mentions:L", f"SELECT rule, x.type, found, mentions FROM (SELECT s.detector AS rule, g.type, count(DISTINCT (g.doc_id, g.ord)) AS found FROM gold g JOIN spans s ON {_NEAR} GROUP BY 1, 2) x JOIN (SELECT type, count(*) AS mentions FROM gold GROUP BY 1) USING (type)")(
    lambda t: audits.rule_recall(t.spans, t.gold)
)
query("skip_rate", "corpus:S written:L skipped:L rate:D", "SELECT source AS corpus, count(*) FILTER (kept) AS written, count(*) FILTER (NOT kept) AS skipped, count(*) FILTER (NOT kept) / count(*) AS rate FROM resolved JOIN documents USING (doc_id) GROUP BY 1")(
    lambda t: audits.skip_rate(t.resolved.join(t.docs.selectExpr("doc_id", "source as corpus"), "doc_id"))
)
query("compare_layers", "change:S type:S n:L", """SELECT change, type, count(*) AS n FROM (SELECT type, CASE WHEN b IS NULL THEN 'dropped' WHEN a IS NULL THEN 'added' ELSE 'kept' END AS change FROM (SELECT DISTINCT doc_id, start, "end", type, 1 AS a FROM gold) FULL JOIN (SELECT DISTINCT doc_id, start, "end", type, 1 AS b FROM union_) USING (doc_id, start, "end", type)) GROUP BY 1, 2""")(
    lambda t: audits.compare_layers(t.gold, combine.combine(t.spans, t.docs, "union"))
)
query("length_bands", "type:S band:S n:L", """SELECT type, CASE WHEN "end" - start <= 4 THEN '1-4' WHEN "end" - start <= 8 THEN '5-8' WHEN "end" - start <= 16 THEN '9-16' ELSE '17+' END AS band, count(*) AS n FROM gold GROUP BY 1, 2""")(lambda t: audits.length_bands(t.gold))
query("recurring_surfaces", "documents:L surfaces:L", "SELECT documents, count(*) AS surfaces FROM (SELECT text, count(DISTINCT doc_id) AS documents FROM gold GROUP BY 1) GROUP BY 1")(lambda t: audits.recurring(t.gold))
query(
    "record_counts", "detector:S records:L failed:L truncated:L stale:L usable:L",
    """SELECT detector, count(*) AS records, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'truncated') AS truncated, count(*) FILTER (s = 'stale') AS stale, count(*) FILTER (s = 'usable') AS usable
        FROM (SELECT detector, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'truncated' WHEN doc_id % 9 = 0 THEN 'stale' ELSE 'usable' END AS s FROM (SELECT DISTINCT detector, doc_id FROM spans)) GROUP BY 1""",
)(lambda t: audits.record_counts(_records(t), t.docs))
query("equal_texts", "same:L changed:L missing:L", "SELECT count(*) FILTER (released = text) AS same, count(*) FILTER (released <> text) AS changed, count(*) FILTER (released IS NULL) AS missing FROM documents LEFT JOIN (SELECT * FROM release_c WHERE doc_id IN (SELECT doc_id FROM placed_c)) USING (doc_id)")(
    lambda t: audits.equal_texts(t.docs, construct.splice(t.docs, t.edits("C"), keep_unpatched=False).withColumnRenamed("released", "text"))
)
query("recall_leak_correlation", "n:L pearson:D", f"SELECT count(*) AS n, corr(sensitivity, precision) AS pearson FROM ({_SWEEP})")(lambda t: audits.correlation(_sweep(t)[1], "sensitivity", "precision"))


@query("clustering_scores", "precision:D recall:D f1:D inflation:D merge_rate:D", """WITH p AS (SELECT doc_id, start, "end", votes AS merged FROM union_ WHERE type = 'PERSON'), g AS (SELECT * FROM gold WHERE type = 'PERSON'),
    b AS (SELECT coalesce(sum(least(g."end", p."end") - greatest(g.start, p.start)), 0) AS n, avg((p."end" - p.start) / (g."end" - g.start)) AS inflation FROM g JOIN p ON g.doc_id = p.doc_id AND g."end" > p.start AND g.start < p."end"),
    x AS (SELECT (SELECT sum("end" - start) FROM g) AS g, (SELECT sum("end" - start) FROM p) AS p, (SELECT avg((merged > 1)::INT) FROM p) AS merge_rate)
    SELECT n / p AS precision, n / g AS recall, 2 * n / (g + p) AS f1, inflation, merge_rate FROM b, x""")
def _clustering(t: Tables) -> DataFrame:
    spans = combine.combine(t.spans, t.docs, "union").where("type = 'PERSON'").selectExpr("doc_id", "start", "end", "votes as merged")
    return metrics.clustering_scores(t.gold.where("type = 'PERSON'"), spans)


@query("ner_agreement", "documents:L agreement:D")
def _agreement(t: Tables) -> DataFrame:
    """How far one native detector finds the same spans in the release with names as in the texts."""
    strict = _native("strict")
    e = t.edits("B")
    rows = tasks.agreement(t.docs, construct.splice(t.docs, e), e, lambda docs: strict(docs).withColumnRenamed("type_src", "type"))
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("agreement"))


@query("task_coreference", "documents:L conll:D")
def _task_coreference(t: Tables) -> DataFrame:
    """A resolver that chains equal words, on the release, against the moved reference chains."""
    from ..functions.text import words

    e = t.edits("B")
    chains = lambda docs: words(docs).where("word rlike '^[A-ZÀ-Þ]'").selectExpr("doc_id", "start", "end", "lower(word) as cluster")
    rows = tasks.coreference(construct.splice(t.docs, e), t.gold, e, chains)
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("conll"))


query("draw_units", "unit:L mailbox:S size:L")(lambda t: dedup.draw(t.table("conversations").groupBy(F.col("conv_id").alias("unit")).agg(F.count(F.lit(1)).alias("size")).selectExpr("unit", "concat('m', unit % 9) as mailbox", "size"), 100, 12, 5))


def _native(name: str) -> ports.Detector:
    from ..functions.text import words

    return lambda docs: detect.detect(words(docs, ahead=True)).where(F.col("detector") == name)


for _name in (*detect.DETECTORS, "pair"):
    ports.register(_name)(_native(_name))
