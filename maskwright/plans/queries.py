"""Registered queries: each a DataFrame over the driver's tables and, where SQL can say it, DuckDB SQL.

Results are cast to the types named with each query, doubles rounded to six
places, so both engines return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.text import digest16, tokens, words
from ..operators import attacks, combine, construct, dedup, detect, metrics, sampling, select, stats
from ..staging import written
from .sqltext import format_preserving, hmac_hex, index32, n1, n2, synthetic, with_

_KINDS = {"L": ("bigint", "BIGINT"), "S": ("string", "VARCHAR"), "B": ("boolean", "BOOLEAN"), "D": ("double", "DOUBLE")}


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    columns: dict[str, str]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        cast = [f"round(cast(`{c}` as double), 6) as `{c}`" if k == "D" else f"cast(`{c}` as {_KINDS[k][0]}) as `{c}`" for c, k in self.columns.items()]
        return self.build(Tables(spark, sf_dir)).selectExpr(*cast)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cast = [f'round(CAST("{c}" AS DOUBLE), 6) + 0 AS "{c}"' if k == "D" else f'CAST("{c}" AS {_KINDS[k][1]}) AS "{c}"' for c, k in self.columns.items()]
        return with_(f"SELECT {', '.join(cast)} FROM ({self.sql})")


class Tables:
    """The driver's tables and the layers built on them, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        keys.register(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def docs(self) -> DataFrame:
        """Dealt by id where there are fewer files than tasks: a single file would be opened, tokenised and detected in one task."""
        rows, n = self.table("documents"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, "doc_id") if len(rows.inputFiles()) < n else rows

    @property
    def words(self) -> DataFrame:
        return words(self.docs, ahead=True)

    @property
    def tokens(self) -> DataFrame:
        return tokens(self.docs)

    @property
    def gold(self) -> DataFrame:
        return detect.gold(self.words)

    @property
    def raw(self) -> DataFrame:
        return detect.detect(self.words)

    @property
    def harmonised(self) -> DataFrame:
        return detect.harmonise(self.raw)

    @property
    def spans(self) -> DataFrame:
        return detect.code_filter(self.harmonised)

    @property
    def resolved(self) -> DataFrame:
        return construct.resolve_overlaps(combine.combine(self.spans, self.docs, "union"))

    @property
    def assigned(self) -> DataFrame:
        return construct.assign(self.resolved.where("kept"))

    def edits(self, condition: str) -> DataFrame:
        return construct.edits(self.assigned, construct.surrogate() if condition == "B" else keys.placeholder("type"))

    @property
    def predicted(self) -> DataFrame:
        return self.spans.selectExpr("detector as source", "doc_id", "start", "end")

    @property
    def quality(self) -> DataFrame:
        """Scores of two tasks under three conditions, functions of the labels."""
        rows = self.table("labels").where("doc_id is not null")
        out = None
        for condition, q, t in (("A", "quality", "toxic"), ("B", "if(doc_id % 7 = 0, 1 - quality, quality)", "if(doc_id % 11 = 0, 1 - toxic, toxic)"), ("C", "if(doc_id % 3 = 0, 0, quality)", "if(doc_id % 5 = 0, 1, toxic)")):
            for task, expr in (("quality", q), ("toxic", t)):
                part = rows.selectExpr(f"'{task}' as task", f"'{condition}' as condition", "doc_id", f"cast({expr} as double) as score")
                out = part if out is None else out.unionAll(part)
        return out

    @property
    def graded(self) -> DataFrame:
        """Real-valued scores: a document's share of capitals, changed by condition."""
        docs = self.docs.selectExpr("doc_id", "length(text) as n", "length(regexp_replace(text, '[^A-Z]', '')) as c")
        out = None
        for condition, expr in (("A", "c / n"), ("B", "(c + doc_id % 5) / n"), ("C", "(c - doc_id % 3 + 1) / n")):
            part = docs.where("n > 0").selectExpr("'capitals' as task", f"'{condition}' as condition", "doc_id", f"round({expr}, 9) as score")
            out = part if out is None else out.unionAll(part)
        return out


_QUALITY = """SELECT 'quality' AS task, 'A' AS condition, doc_id, quality::DOUBLE AS score FROM labels
    UNION ALL SELECT 'toxic', 'A', doc_id, toxic FROM labels
    UNION ALL SELECT 'quality', 'B', doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END FROM labels
    UNION ALL SELECT 'toxic', 'B', doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END FROM labels
    UNION ALL SELECT 'quality', 'C', doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE quality END FROM labels
    UNION ALL SELECT 'toxic', 'C', doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE toxic END FROM labels"""
_GRADED = " UNION ALL ".join(
    f"SELECT 'capitals' AS task, '{k}' AS condition, doc_id, round(({e})::DOUBLE / length(text), 9) AS score FROM (SELECT *, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS c FROM documents) WHERE length(text) > 0"
    for k, e in (("A", "c"), ("B", "c + doc_id % 5"), ("C", "c - doc_id % 3 + 1"))
)
_PAIRED = "SELECT s.*, r.score AS ref, s.score - r.score AS diff FROM ({0}) s JOIN ({0}) r ON s.task = r.task AND s.doc_id = r.doc_id AND r.condition = 'A' WHERE s.condition <> 'A'"

QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = Query(build, dict(c.rsplit(":", 1) for c in columns.split()), sql)
        return build

    return add


SPAN = "doc_id:L type:S start:L end:L text:S votes:L"

# --- tokens, keys, techniques -------------------------------------------------------------------
query("tokenise", "doc_id:L ord:L start:L end:L tok:S", "SELECT * FROM tokens")(lambda t: t.tokens)
query("words", "doc_id:L ord:L start:L end:L word:S", "SELECT * FROM words")(lambda t: t.words)
query("token_weights", "word:S weight:D", "SELECT word, -log2((n + 1) / (sum(n) OVER () + count(*) OVER () + 1)) AS weight FROM (SELECT lower(tok) AS word, count(*) AS n FROM tokens GROUP BY 1)")(
    lambda t: metrics.token_weights(t.tokens)
)
query("text_digest", "doc_id:L digest:S", "SELECT doc_id, substring(sha256(text), 1, 16) AS digest FROM documents")(lambda t: t.docs.selectExpr("doc_id", f"{digest16('text')} as digest"))


@query("entity_key_levels", "name:S N0:S N2:S N3:S N4:S", f"""SELECT name, name AS "N0", k AS "N2", n3 AS "N3", string_split(n3, ' ')[-1] AS "N4" FROM (
    SELECT *, coalesce(nullif(array_to_string(list_filter(string_split(k, ' '), lambda x: length(x) > 1), ' '), ''), k) AS n3 FROM (
    SELECT DISTINCT name, {n2('name')} AS k FROM (SELECT 'Dr. ' || c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT entity FROM gold)))""")
def _entity_keys(t: Tables) -> DataFrame:
    names = t.table("customer").selectExpr("concat('Dr. ', c_name) as name").unionAll(t.table("supplier").selectExpr("s_name")).unionAll(t.gold.selectExpr("entity")).distinct()
    return names.selectExpr("name", *(f"{keys.NORMALISERS[k]('name')} as {k}" for k in ("N0", "N2", "N3", "N4")))


query("casefold_key", "c_name:S key:S", f"SELECT c_name, {n1('c_name')} AS key FROM customer")(lambda t: t.table("customer").selectExpr("c_name", f"{keys.n1('c_name')} as key"))
_SCOPES = "concat_ws(chr(31), 'PERSON', c_name)"
query(
    "techniques", "c_custkey:L hash:L hmac:L draw:L",
    f"""SELECT c_custkey, {index32('sha256(k)')} AS hash, {index32(hmac_hex('k'))} AS hmac, ('0x' || substring(sha256('7|' || k), 1, 8))::BIGINT % 4096 AS draw FROM (SELECT *, {_SCOPES} AS k FROM customer)""",
)(lambda t: t.table("customer").selectExpr("*", f"{keys.entity_key(chr(39) + 'PERSON' + chr(39), 'c_name')} as k").selectExpr("c_custkey", f"{keys.hash_index('k')} as hash", f"{keys.hmac_index('k', construct.KEY)} as hmac", f"{keys.table_index('k', 7, 4096)} as draw"))
query(
    "policy_scopes", "entity_key:S deterministic:L document:L full:L",
    f"""SELECT entity_key, count(DISTINCT entity_key) AS deterministic, count(DISTINCT doc_id) AS document, count(DISTINCT (doc_id, start)) AS "full" FROM assigned GROUP BY 1""",
)(lambda t: t.assigned.selectExpr("entity_key", "type", *(f"{p('entity_key', 'doc_id', 'start')} as {n}" for n, p in keys.POLICIES.items())).groupBy("entity_key").agg(*(F.countDistinct(n).alias(n) for n in keys.POLICIES)))
query(
    "counter_ordinal", "type:S entity_key:S ordinal:L",
    "SELECT type, entity_key, row_number() OVER (PARTITION BY type ORDER BY d, s) - 1 AS ordinal FROM (SELECT type, entity_key, min((doc_id, start)) AS f, f[1] AS d, f[2] AS s FROM (SELECT * FROM assigned) GROUP BY 1, 2)",
)(lambda t: construct.counter(t.assigned).selectExpr("type", "scope as entity_key", "ordinal"))
query(
    "tag_surrogates", "type:S entity_key:S tag:S",
    "SELECT type, entity_key, '[' || type || '_' || (row_number() OVER (PARTITION BY type ORDER BY d, s) - 1)::VARCHAR || ']' AS tag FROM (SELECT type, entity_key, min((doc_id, start)) AS f, f[1] AS d, f[2] AS s FROM assigned GROUP BY 1, 2)",
)(lambda t: construct.counter(t.assigned).selectExpr("type", "scope as entity_key", f"{keys.tag('type', 'ordinal')} as tag"))
query("synthetic_surrogate", "c_custkey:L person:S place:S", f"SELECT c_custkey, {synthetic('c_custkey * 7919', chr(39) + 'PERSON' + chr(39))} AS person, {synthetic('c_custkey * 7919', chr(39) + 'LOC' + chr(39))} AS place FROM customer")(
    lambda t: t.table("customer").selectExpr("c_custkey", f"{keys.synthetic('c_custkey * 7919', chr(39) + 'PERSON' + chr(39))} as person", f"{keys.synthetic('c_custkey * 7919', chr(39) + 'LOC' + chr(39))} as place")
)
query("format_preserving", "s_suppkey:L code:S", f"SELECT s_suppkey, {format_preserving('s_name', 's_suppkey * 104729')} AS code FROM supplier")(
    lambda t: t.table("supplier").selectExpr("s_suppkey", f"{keys.format_preserving('s_name', 's_suppkey * 104729')} as code")
)
query("checked_surrogates", "doc_id:L start:L attempt:L surrogate:S")(lambda t: construct.checked_surrogate(t.assigned).select("doc_id", "start", "attempt", "surrogate"))
query(
    "structured_joins", "policy:S joined:L",
    f"""SELECT 'deterministic' AS policy, count(*) AS joined FROM orders o JOIN customer c ON sha256(o.o_custkey::VARCHAR) = sha256(c.c_custkey::VARCHAR)
    UNION ALL SELECT 'document', count(*) FROM orders o JOIN customer c ON sha256(o.o_custkey::VARCHAR || chr(31) || 'orders') = sha256(c.c_custkey::VARCHAR || chr(31) || 'customer')""",
)(
    lambda t: t.table("orders").selectExpr("'deterministic' as policy", "sha2(cast(o_custkey as string), 256) as k").join(t.table("customer").selectExpr("sha2(cast(c_custkey as string), 256) as k"), "k").groupBy("policy").agg(F.count(F.lit(1)).alias("joined"))
    .unionAll(t.table("orders").selectExpr(f"sha2({keys.POLICIES['document']('cast(o_custkey as string)', chr(39) + 'orders' + chr(39), '')}, 256) as k").join(t.table("customer").selectExpr(f"sha2({keys.POLICIES['document']('cast(c_custkey as string)', chr(39) + 'customer' + chr(39), '')}, 256) as k"), "k").agg(F.lit("document"), F.count(F.lit(1))))
)

# --- detection and span algebra -----------------------------------------------------------------
query("detect", "doc_id:L detector:S ord:L start:L end:L text:S type_src:S score:D", "SELECT * FROM raw")(lambda t: t.raw)
query("gold_mentions", "doc_id:L ord:L start:L end:L text:S type:S entity:S", "SELECT * FROM gold")(lambda t: t.gold)
query("harmonise_tally", "detector:S type:S n:L unmapped:L", "SELECT detector, type, count(*) AS n, count(*) FILTER (NOT was_mapped) AS unmapped FROM harmonised GROUP BY 1, 2")(
    lambda t: t.harmonised.groupBy("detector", "type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("was_mapped")).alias("unmapped"))
)
query("code_filter", "detector:S type:S n:L", "SELECT detector, type, count(*) AS n FROM spans GROUP BY 1, 2")(lambda t: t.spans.groupBy("detector", "type").agg(F.count(F.lit(1)).alias("n")))
query("text_windows", "doc_id:L start:L digest:S", "SELECT doc_id, start, sha256(substring(text, start + 1, 500)) AS digest FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50 - 1, 0) + 1, 450)) AS start FROM documents)")(
    lambda t: detect.text_windows(t.docs, 500, 50).selectExpr("doc_id", "start", "sha2(window, 256) as digest")
)
query("dedupe_spans", "doc_id:L start:L end:L type:S detector:S", 'SELECT doc_id, start, "end", type, detector FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end", type ORDER BY coalesce(score, 0) DESC, detector, ord) AS n FROM spans) WHERE n = 1')(
    lambda t: detect.dedupe(t.spans)
)
query("cluster_single", "doc_id:L type:S start:L end:L detector:S cluster:L", "SELECT * FROM clusters")(lambda t: combine.cluster_single(t.spans))
query("cluster_iou", "doc_id:L type:S start:L end:L detector:S cluster:L")(lambda t: combine.cluster_iou(t.spans))
query("combine_union", SPAN, "SELECT * FROM union_")(lambda t: combine.combine(t.spans, t.docs, "union"))
for _rule, _keep, _order in (
    ("intersection", "votes >= present", "len_, start"),
    ("vote2", "votes >= 2", "agreed_ DESC, len_ DESC, start"),
    ("majority", "votes >= present // 2 + 1", "agreed_ DESC, len_ DESC, start"),
    ("widest", "true", "len_ DESC, start"),
):
    query(f"combine_{_rule}", SPAN, f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type, cluster ORDER BY {_order}, detector) AS n FROM voted WHERE {_keep}) WHERE n = 1")(
        lambda t, rule=_rule: combine.combine(t.spans, t.docs, rule)
    )
query(
    "combine_weighted", SPAN,
    """SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.doc_id, v.type, v.cluster ORDER BY agreed_ DESC, len_ DESC, start, detector) AS n FROM voted v JOIN (
        SELECT doc_id, type, cluster, sum(CASE detector WHEN 'strict' THEN 0.9 WHEN 'pair' THEN 0.8 WHEN 'loose' THEN 0.4 ELSE 1 END) AS w FROM (SELECT DISTINCT doc_id, type, cluster, detector FROM clusters) GROUP BY ALL) x
        USING (doc_id, type, cluster) WHERE w >= 1.5) WHERE n = 1""",
)(lambda t: combine.combine(t.spans, t.docs, "weighted", {"strict": 0.9, "pair": 0.8, "loose": 0.4}, 1.5))
query("cascade", "doc_id:L type:S start:L end:L detector:S")(lambda t: combine.cascade(t.spans, ["pair", "strict", "loose", "mail", "digits"]))
query(
    "token_vote", "doc_id:L ord:L type:S n:L",
    """SELECT doc_id, ord, type, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY n DESC, type) AS r FROM (
        SELECT t.doc_id, t.ord, s.type, count(DISTINCT s.detector) AS n FROM tokens t JOIN spans s ON t.doc_id = s.doc_id AND t."end" > s.start AND t.start < s."end" GROUP BY ALL)) JOIN (
        SELECT doc_id, ord, count(*) AS c FROM covered GROUP BY ALL) USING (doc_id, ord) JOIN (SELECT doc_id, count(DISTINCT detector) AS p FROM spans GROUP BY 1) USING (doc_id) WHERE r = 1 AND 2 * c > p""",
)(lambda t: combine.token_vote(t.spans, t.docs))
query(
    "bio_labels", "doc_id:L ord:L label:S",
    """SELECT doc_id, ord, CASE WHEN ord = min(ord) OVER (PARTITION BY doc_id, s0, s1, type) THEN 'B-' ELSE 'I-' END || type AS label FROM (
        SELECT t.doc_id, t.ord, s.start AS s0, s."end" AS s1, s.type, row_number() OVER (PARTITION BY t.doc_id, t.ord ORDER BY s.start, s."end" DESC, s.type) AS n
        FROM tokens t JOIN union_ s ON t.doc_id = s.doc_id AND t."end" > s.start AND t.start < s."end") WHERE n = 1""",
)(lambda t: combine.bio(combine.combine(t.spans, t.docs, "union"), t.docs))

# --- construction -------------------------------------------------------------------------------
query("overlap_resolution", "doc_id:L ord:L start:L end:L text:S type:S kept:B", "SELECT * FROM resolved")(lambda t: t.resolved)
query("assign_hmac", "doc_id:L start:L entity_key:S idx:L", "SELECT doc_id, start, entity_key, idx FROM assigned")(lambda t: t.assigned)
EDIT = "doc_id:L old_start:L old_end:L new_start:L new_end:L replacement:S"
query("patch_offsets_b", EDIT, "SELECT * FROM placed_b")(lambda t: t.edits("B"))
query("patch_offsets_c", EDIT, "SELECT * FROM placed_c")(lambda t: t.edits("C"))
query("effective_edits", "type:S n:L", "SELECT type, count(*) AS n FROM placed_b WHERE replacement <> text GROUP BY 1")(lambda t: construct.effective(t.edits("B")).groupBy("type").agg(F.count(F.lit(1)).alias("n")))
query("release_b", "doc_id:L released:S", "SELECT * FROM release_b")(lambda t: construct.splice(t.docs, t.edits("B")))
query("release_c", "doc_id:L released:S", "SELECT * FROM release_c")(lambda t: construct.splice(t.docs, t.edits("C")))
query("release_patched_only", "doc_id:L released:S", "SELECT * FROM release_c WHERE doc_id IN (SELECT doc_id FROM placed_c)")(lambda t: construct.splice(t.docs, t.edits("C"), keep_unpatched=False))


@query("roundtrip", "documents:L restored:L", "SELECT count(*) AS documents, count(*) AS restored FROM documents")
def _roundtrip(t: Tables) -> DataFrame:
    edits_ = t.edits("B")
    back = construct.restore(construct.splice(t.docs, edits_), edits_).withColumnRenamed("text", "back")
    return t.docs.join(back, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text") == F.col("back")).alias("restored"))


query(
    "offset_map", "doc_id:L at:L new_at:L",
    """SELECT DISTINCT g.doc_id, g.start AS at, CASE WHEN p.doc_id IS NULL THEN g.start WHEN g.start >= p.old_end THEN g.start + p.new_end - p.old_end
        WHEN p.new_end - p.new_start = p.old_end - p.old_start THEN p.new_start + g.start - p.old_start ELSE p.new_start END AS new_at
        FROM gold g ASOF LEFT JOIN placed_b p ON g.doc_id = p.doc_id AND g.start >= p.old_start""",
)(lambda t: construct.map_offsets(t.gold.selectExpr("doc_id", "start as at"), t.edits("B")))
query(
    "stale_records", "doc_id:L text_sha256:S",
    "SELECT doc_id, text_sha256 FROM (SELECT doc_id, substring(sha256(text || CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE '' END), 1, 16) AS text_sha256, substring(sha256(text), 1, 16) AS now_ FROM documents) WHERE text_sha256 <> now_",
)(lambda t: construct.stale(t.docs, t.docs.selectExpr("doc_id", f"{digest16('concat(text, if(doc_id % 10 = 0, ' + chr(39) + 'x' + chr(39) + ', ' + chr(39) * 2 + '))')} as text_sha256")))

# --- metrics ------------------------------------------------------------------------------------
query("covered_tokens", "detector:S n:L", "SELECT detector, count(*) AS n FROM covered GROUP BY 1")(
    lambda t: metrics.covered(t.docs, t.spans).select(F.explode("detectors").alias("detector")).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "detection_score", "source:S type:S gold_tokens:L hit_tokens:L entities:L protected:L",
    """SELECT source, type, sum(n) AS gold_tokens, sum(h) AS hit_tokens, count(*) AS entities, count(*) FILTER (n = h) AS protected FROM (
        SELECT p.source, g.type, g.doc_id, g.entity, count(*) AS n, count(c.ord) AS h FROM gold_tokens g CROSS JOIN (SELECT DISTINCT source FROM predicted) p
        LEFT JOIN covered c ON c.doc_id = g.doc_id AND c.ord = g.ord AND c.detector = p.source GROUP BY ALL) GROUP BY GROUPING SETS ((source, type), (source))""",
)(lambda t: metrics.detection_score(t.docs, t.gold, t.predicted))
_CLASS = "CASE WHEN type = 'CODE' THEN 'DIRECT' ELSE 'QUASI' END"
query(
    "detection_by_class", "source:S class:S gold_tokens:L hit_tokens:L entities:L protected:L",
    f"""SELECT source, class, sum(n) AS gold_tokens, sum(h) AS hit_tokens, count(*) AS entities, count(*) FILTER (n = h) AS protected FROM (
        SELECT p.source, {_CLASS} AS class, g.doc_id, g.entity, count(*) AS n, count(c.ord) AS h FROM gold_tokens g CROSS JOIN (SELECT DISTINCT source FROM predicted) p
        LEFT JOIN covered c ON c.doc_id = g.doc_id AND c.ord = g.ord AND c.detector = p.source GROUP BY ALL) GROUP BY GROUPING SETS ((source, class), (source))""",
)(lambda t: metrics.detection_score(t.docs, t.gold, t.predicted, "if(mention.type = 'CODE', 'DIRECT', 'QUASI')").withColumnRenamed("type", "class"))
query(
    "detection_precision", "source:S predicted:L correct:L precision:D",
    "SELECT c.detector AS source, count(*) AS predicted, count(g.ord) AS correct, count(g.ord) / count(*) AS precision FROM covered c LEFT JOIN gold_tokens g USING (doc_id, ord) GROUP BY 1",
)(lambda t: metrics.detection_precision(t.docs, t.gold, t.predicted))
for _name, _policy, _cross in (("stability_cross", "deterministic", True), ("stability_within", "document", False)):
    _scope = f"type || chr(31) || {n2('text')}" + ("" if _cross else " || chr(31) || doc_id::VARCHAR")
    query(
        _name, "type:S collision:D fragmentation:D drift:D surfaces:L",
        f"""SELECT type, c AS collision, f AS fragmentation, {'d' if _cross else 'NULL'} AS drift, u AS surfaces FROM (SELECT type, count(DISTINCT {index32(hmac_hex(_scope))}) AS u FROM gold GROUP BY 1) JOIN (
            SELECT type, avg((n > 1)::INT) AS c FROM (SELECT type, doc_id, s, count(DISTINCT entity) AS n FROM (SELECT *, {index32(hmac_hex(_scope))} AS s FROM gold) GROUP BY ALL) GROUP BY 1) USING (type) JOIN (
            SELECT type, avg((n > 1)::INT) AS f FROM (SELECT type, doc_id, entity, count(DISTINCT s) AS n FROM (SELECT *, {index32(hmac_hex(_scope))} AS s FROM gold) GROUP BY ALL) GROUP BY 1) USING (type) LEFT JOIN (
            SELECT type, avg((n > 1)::INT) AS d FROM (SELECT type, entity, count(DISTINCT s) AS n, count(DISTINCT doc_id) AS k FROM (SELECT *, {index32(hmac_hex(_scope))} AS s FROM gold) GROUP BY ALL HAVING k > 1) GROUP BY 1) USING (type)""",
    )(lambda t, p=_policy, c=_cross: metrics.stability(construct.assign(t.gold, policy=p).selectExpr("doc_id", "type", "entity", "idx as surrogate"), c))
query(
    "exposure", "grain:S units:L exposed:L",
    """WITH f AS (SELECT g.*, d.source AS subject, (NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = g.doc_id AND s.detector = 'strict' AND s.start <= g.start AND s."end" >= g."end"))::INT AS o FROM gold g JOIN documents d USING (doc_id))
    SELECT 'mention' AS grain, count(*) AS units, sum(o) AS exposed FROM f UNION ALL SELECT 'entity_document', count(*), sum(o) FROM (SELECT max(o) AS o FROM f GROUP BY doc_id, entity)
    UNION ALL SELECT 'document', count(*), sum(o) FROM (SELECT max(o) AS o FROM f GROUP BY doc_id) UNION ALL SELECT 'case', count(*), sum(o) FROM (SELECT max(o) AS o FROM f GROUP BY subject)""",
)(lambda t: metrics.exposure(t.gold.join(t.docs.selectExpr("doc_id", "source as subject"), "doc_id"), t.spans.where("detector = 'strict'")))
query(
    "character_scores", "doc_id:L gold_chars:L predicted_chars:L both_chars:L",
    """SELECT doc_id, coalesce(a, 0) AS gold_chars, coalesce(b, 0) AS predicted_chars, coalesce(c, 0) AS both_chars FROM (SELECT doc_id, sum("end" - start) AS a FROM gold GROUP BY 1)
    FULL JOIN (SELECT doc_id, sum("end" - start) AS b FROM spans WHERE detector = 'title' GROUP BY 1) USING (doc_id)
    LEFT JOIN (SELECT g.doc_id, sum(least(g."end", s."end") - greatest(g.start, s.start)) AS c FROM gold g JOIN spans s ON g.doc_id = s.doc_id AND s.detector = 'title' AND g."end" > s.start AND g.start < s."end" GROUP BY 1) USING (doc_id)""",
)(lambda t: metrics.character_scores(t.gold, t.spans.where("detector = 'title'")))
query("coreference", "doc_id:L muc_recall:D muc_precision:D b3_recall:D b3_precision:D ceaf_recall:D ceaf_precision:D conll:D")(
    lambda t: metrics.coreference(t.gold.selectExpr("doc_id", "ord as mention", "entity as cluster"), t.gold.selectExpr("doc_id", "ord as mention", "concat(type, left(lower(text), 3)) as cluster"))
)

# --- sweep and selection ------------------------------------------------------------------------
_POOL = ["strict", "loose", "title", "mail", "digits", "pair"]


def _sweep(t: Tables) -> tuple[DataFrame, DataFrame]:
    sources = select.sources(t.spark, _POOL)
    return sources, select.sweep(select.token_sets(metrics.marked(t.docs, t.gold, t.predicted, every=True)), sources)


_SOURCES = " UNION ALL ".join(f"SELECT '{s}' AS source, '{r}' AS rule, [{', '.join(repr(m) for m in ms)}] AS members" for s, r, ms in select.plan(_POOL))
_SWEEP = f"""SELECT source, predicted, hit, hit / (SELECT count(*) FROM gold_tokens) AS sensitivity, 1 - (predicted - hit) / ((SELECT count(*) FROM tokens) - (SELECT count(*) FROM gold_tokens)) AS specificity, hit / predicted AS precision FROM (
    SELECT source, count(*) AS predicted, count(g.ord) AS hit FROM (SELECT c.doc_id, c.ord, x.source FROM covered c JOIN ({_SOURCES}) x ON list_contains(x.members, c.detector) GROUP BY c.doc_id, c.ord, x.source, x.rule, x.members
        HAVING CASE x.rule WHEN 'intersection' THEN count(*) = len(x.members) WHEN 'vote2' THEN count(*) >= 2 ELSE true END) LEFT JOIN gold_tokens g USING (doc_id, ord) GROUP BY 1)"""
_COSTS = f"SELECT source, max(c) AS parallel, round(sum(c), 6) AS serial FROM (SELECT source, unnest(members) AS detector FROM ({_SOURCES})) JOIN cost USING (detector) GROUP BY 1"
query("detection_sweep", "source:S predicted:L hit:L sensitivity:D specificity:D precision:D", _SWEEP)(lambda t: _sweep(t)[1])
query("ensemble_cost", "source:S parallel:D serial:D", _COSTS)(lambda t: select.ensemble_cost(select.sources(t.spark, _POOL)))


def _points(t: Tables) -> DataFrame:
    sources, scores = _sweep(t)
    scores = t.spark.createDataFrame(scores.collect(), scores.schema)  # one row for each source of the plan, read by several branches
    return scores.join(select.ensemble_cost(sources), "source").selectExpr("source", "parallel", "round(sensitivity, 9) as sensitivity", "round(specificity, 9) as specificity")


_POINTS = f"SELECT source, parallel, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity FROM ({_SWEEP}) JOIN ({_COSTS}) USING (source)"
query(
    "pareto_front", "source:S parallel:D sensitivity:D",
    f"SELECT * FROM (SELECT *, max(sensitivity) OVER (ORDER BY parallel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT *, row_number() OVER (PARTITION BY parallel ORDER BY sensitivity DESC, source) AS n FROM ({_POINTS})) WHERE n = 1) WHERE m IS NULL OR sensitivity > m",
)(lambda t: select.pareto(_points(t), "parallel", "sensitivity"))
query(
    "operating_points", "point:S source:S parallel:D sensitivity:D specificity:D",
    "WITH p AS MATERIALIZED (" + _POINTS + ") " + " UNION ALL ".join(
        f"(SELECT 'max {q}' AS point, * FROM p WHERE {w} ORDER BY {q} DESC, parallel, source LIMIT 1) UNION ALL (SELECT 'fast {q}', * FROM p WHERE {w} AND {q} >= 0.9 * (SELECT max({q}) FROM p WHERE {w}) ORDER BY parallel, {q} DESC, source LIMIT 1)"
        for q, w in (("sensitivity", "true"), ("specificity", "sensitivity >= 0.5"))
    ),
)(lambda t: select.operating_points(_points(t)))

# --- statistics ---------------------------------------------------------------------------------
query("score_summary", "task:S condition:S n:L mean:D sd:D median:D", f"SELECT task, condition, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd, median(score) AS median FROM ({_GRADED}) GROUP BY 1, 2")(lambda t: stats.describe(t.graded))
query("paired_spread", "task:S condition:S n:L mean_diff:D sd_diff:D iqr:D", f"SELECT task, condition, count(*) AS n, avg(diff) AS mean_diff, stddev_samp(diff) AS sd_diff, quantile_cont(diff, 0.75) - quantile_cont(diff, 0.25) AS iqr FROM ({_PAIRED.format(_GRADED)}) GROUP BY 1, 2")(
    lambda t: stats.spread(stats.paired(t.graded))
)
query(
    "wilcoxon", "task:S condition:S n:L w_plus:D w_minus:D effect:D",
    f"""SELECT task, condition, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus, (w_plus - w_minus) / (w_plus + w_minus) AS effect FROM (
        SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY task, condition, abs(diff)) - 1) / 2 AS r FROM (SELECT * REPLACE (round(diff, 9) AS diff) FROM ({_PAIRED.format(_GRADED)})) WHERE diff <> 0 WINDOW w AS (PARTITION BY task, condition ORDER BY abs(diff))) GROUP BY 1, 2""",
)(lambda t: stats.wilcoxon(stats.paired(t.graded).withColumn("diff", F.round("diff", 9))))


@query("wilcoxon_pvalues", "task:S condition:S p:D")
def _wilcoxon_p(t: Tables) -> DataFrame:
    return stats.wilcoxon(stats.paired(t.graded).withColumn("diff", F.round("diff", 9))).withColumn("p", stats.wilcoxon_p("w_plus", "w_minus", "n"))


query(
    "mcnemar", "task:S condition:S b:L c:L chi2:D",
    f"SELECT task, condition, sum((ref > score)::INT) AS b, sum((score > ref)::INT) AS c, CASE WHEN b + c >= 25 THEN pow(abs(b - c) - 1, 2) / (b + c) END AS chi2 FROM ({_PAIRED.format(_QUALITY)}) GROUP BY 1, 2",
)(lambda t: stats.mcnemar(stats.paired(t.quality)))
query("mcnemar_pvalues", "task:S condition:S p:D")(lambda t: stats.mcnemar(stats.paired(t.quality)).withColumn("p", stats.mcnemar_p("b", "c")))
_TESTS = "SELECT source AS family, doc_id AS test, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS p FROM documents"
query(
    "bh_qvalues", "family:S test:L p:D q:D",
    f"SELECT family, test, p, least(1, min(p * m / r) OVER (PARTITION BY family ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS r, count(*) OVER (PARTITION BY family) AS m FROM ({_TESTS}))",
)(lambda t: stats.benjamini_hochberg(t.docs.selectExpr("source as family", "doc_id as test", "(doc_id * 7919 % 1000) / 1000.0D as p")))
query(
    "spearman", "source:S rho:D n:L",
    """SELECT source, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT source, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY source ORDER BY y) + (count(*) OVER (PARTITION BY source, y) - 1) / 2 AS ry
        FROM (SELECT source, n_chars AS x, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS y FROM documents)) GROUP BY 1""",
)(lambda t: stats.spearman(t.docs.selectExpr("source", "n_chars as x", "length(regexp_replace(text, '[^A-Z]', '')) as y"), "x", "y", "source"))
query(
    "span_f1", "doc_id:L n_gold:L n_pred:L tp:L f1:D",
    """SELECT doc_id, coalesce(a, 0) AS n_gold, coalesce(b, 0) AS n_pred, coalesce(c, 0) AS tp, 2 * tp / (n_gold + n_pred) AS f1 FROM (SELECT doc_id, count(DISTINCT (start, "end", type)) AS a FROM gold GROUP BY 1)
    FULL JOIN (SELECT doc_id, count(DISTINCT (start, "end", type)) AS b FROM spans GROUP BY 1) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, start, "end", type FROM gold INTERSECT SELECT DISTINCT doc_id, start, "end", type FROM spans) GROUP BY 1) USING (doc_id)""",
)(lambda t: stats.span_f1(t.gold, t.spans))

# --- sampling, splits, duplicates ---------------------------------------------------------------
def _d(c: str, seed: int) -> str:
    return f"sha256('{seed}|' || {c}::VARCHAR)"


query("sample_document", "doc_id:L", f"SELECT doc_id FROM documents ORDER BY {_d('doc_id', 11)}, doc_id LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT FROM documents)")(lambda t: sampling.by_document(t.docs.select("doc_id"), 0.1, 11))
query("sample_subject", "doc_id:L source:S", f"SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY {_d('source', 11)}, source LIMIT (SELECT greatest(1, round_even(count(DISTINCT source) * 0.25, 0))::BIGINT FROM documents))")(
    lambda t: sampling.by_subject(t.docs.select("doc_id", "source"), 0.25, 11)
)
query(
    "sample_stratified", "doc_id:L source:S",
    f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_d('doc_id', 11)}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= greatest(1, round_even(n * 0.2, 0))",
)(lambda t: sampling.stratified(t.docs.select("doc_id", "source"), 0.2, 11))
query("sample_window", "doc_id:L n_chars:L", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT (SELECT (count(*) * 0.75)::INT - (count(*) * 0.25)::INT FROM documents) OFFSET (SELECT (count(*) * 0.25)::INT FROM documents)")(
    lambda t: sampling.window(t.docs.select("doc_id", "n_chars"), "n_chars", 0.25, 0.75)
)
query("split_disjoint", "doc_id:L half:S", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_d('doc_id', 5)}, doc_id) <= floor(count(*) OVER () * 0.5) THEN 'gallery' ELSE 'query' END AS half FROM documents")(
    lambda t: sampling.disjoint_split(t.docs.select("doc_id"), 0.5, 5)
)
query("split_folds", "doc_id:L fold:L", f"SELECT doc_id, ('0x' || substring({_d('doc_id', 5)}, 1, 8))::BIGINT % 5 AS fold FROM documents")(lambda t: sampling.folds(t.docs.select("doc_id"), 5, 5))
query(
    "split_threads", "conv_id:L size:L half:S",
    f"SELECT conv_id, size, CASE WHEN sum(size) OVER (ORDER BY {_d('conv_id', 5)}, conv_id ROWS UNBOUNDED PRECEDING) <= floor(sum(size) OVER () * 0.5) THEN 'gallery' ELSE 'query' END AS half FROM (SELECT conv_id, count(*) AS size FROM conversations GROUP BY 1)",
)(lambda t: sampling.thread_split(t.table("conversations"), 0.5, 5))
_FOLDED = r"trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
query("exact_dedup", "digest:S doc_id:L copies:L", f"SELECT sha1({_FOLDED}) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")(lambda t: dedup.exact(t.docs))
query("exact_members", "doc_id:L digest:S representative:L", f"SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS representative FROM (SELECT doc_id, sha1({_FOLDED}) AS digest FROM documents)")(
    lambda t: dedup.members(t.docs)
)
query("near_duplicates", "a:L b:L jaccard:D containment:D")(lambda t: dedup.near_pairs(t.docs.select("doc_id", "text")))
query(
    "thread_key", "conv_id:L turn:L key:S",
    "SELECT conv_id, turn, nullif(" + n1(r"regexp_replace('Re: FW[2] : ANTW:  ' || text, '^([ \t\n\x0B\f\r]*(?i:re|fwd|fw|aw|wg|antw)[ \t\n\x0B\f\r]*(\[[0-9]+\])?[ \t\n\x0B\f\r]*:[ \t\n\x0B\f\r]*)+', '')") + ", '') AS key FROM conversations",
)(lambda t: t.table("conversations").selectExpr("conv_id", "turn", f"{dedup.thread_key('concat(' + chr(39) + 'Re: FW[2] : ANTW:  ' + chr(39) + ', text)')} as key"))
query(
    "derive_sections", "doc_id:L start:L end:L label:S",
    """SELECT * FROM (SELECT doc_id, start, word AS label, lead(start, 1, n_chars) OVER (PARTITION BY doc_id ORDER BY start, word) AS "end" FROM (SELECT w.doc_id, w.start, w.word, d.n_chars FROM words w JOIN documents d USING (doc_id) WHERE w.ord % 50 = 0)) WHERE "end" > start""",
)(lambda t: dedup.sections(t.words.where("ord % 50 = 0").join(t.docs.select("doc_id", "n_chars"), "doc_id").selectExpr("doc_id", "start", "word as label", "n_chars as text_len")))

# --- attacks ------------------------------------------------------------------------------------
_A1 = f"SELECT DISTINCT type, {synthetic(index32(chr(115) + 'ha256(type || chr(31) || ' + n2('text') + ')'), 'type')} AS surrogate, {n2('text')} AS truth, doc_id FROM gold WHERE type = 'PERSON'"


def _a1(t: Tables) -> DataFrame:
    rows = t.gold.where("type = 'PERSON'").selectExpr("doc_id", "type", f"{keys.n2('text')} as truth").distinct()
    rows = rows.selectExpr("doc_id", "type", "truth", f"{keys.hash_index(keys.entity_key('type', 'truth'))} as idx").selectExpr("doc_id", "type", "truth", f"{keys.synthetic('idx', 'type')} as surrogate")
    names = rows.where("doc_id % 2 = 0").selectExpr("type", "surrogate", "truth as guess", "truth as ord")
    return attacks.dictionary(rows.where("doc_id % 2 = 1"), names)


query(
    "a1_dictionary", "type:S surrogate:S truth:S guess:S hit:B",
    f"WITH a1 AS MATERIALIZED ({_A1}) SELECT r.*, c.guess, coalesce(c.guess = r.truth, false) AS hit FROM (SELECT DISTINCT type, surrogate, truth FROM a1 WHERE doc_id % 2 = 1) r LEFT JOIN (SELECT type, surrogate, min(truth) AS guess FROM a1 WHERE doc_id % 2 = 0 GROUP BY 1, 2) c USING (type, surrogate)",
)(_a1)
query(
    "a1_bands", "band:S n:L hits:L",
    f"""WITH a1 AS MATERIALIZED ({_A1}) SELECT CASE WHEN length(truth) <= 4 THEN 'short' WHEN length(truth) <= 8 THEN 'medium' ELSE 'long' END AS band, count(*) AS n, sum(hit::INT) AS hits FROM (
        SELECT r.*, coalesce(c.guess = r.truth, false) AS hit FROM (SELECT DISTINCT type, surrogate, truth FROM a1 WHERE doc_id % 2 = 1) r LEFT JOIN (SELECT type, surrogate, min(truth) AS guess FROM a1 WHERE doc_id % 2 = 0 GROUP BY 1, 2) c USING (type, surrogate)) GROUP BY 1""",
)(lambda t: _a1(t).groupBy(F.expr("case when length(truth) <= 4 then 'short' when length(truth) <= 8 then 'medium' else 'long' end").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("int")).alias("hits")))
_W = r"[A-ZÀ-Þ][a-zß-ÿ\x27’\-]+"
_OBS = rf"SELECT surface, count(*) AS n FROM (SELECT unnest(regexp_extract_all(released, '({_W}([ \t\n\x0B\f\r]+{_W}){{0,2}})', 1)) AS surface FROM release_b) GROUP BY 1"
query("a2_observe", "surface:S n:L", _OBS)(lambda t: attacks.observe(construct.splice(t.docs, t.edits("B"))))
_PRIOR = "SELECT name, n / sum(n) OVER () AS weight FROM (SELECT entity AS name, count(*) AS n FROM gold WHERE type = 'PERSON' GROUP BY 1{})"


def _prior(t: Tables) -> DataFrame:
    return attacks.prior(t.gold.where("type = 'PERSON'").groupBy(F.col("entity").alias("name")).agg(F.count(F.lit(1)).alias("n")))


query("a2_prior", "name:S weight:D", _PRIOR.format(""))(_prior)
query("a2_prior_top500", "name:S weight:D", _PRIOR.format(" ORDER BY n DESC, name LIMIT 500"))(lambda t: attacks.degrade(_prior(t), 500))
query("a2_alignment", "surface:S n:L guess:S abstains:B")(lambda t: attacks.align(attacks.observe(construct.splice(t.docs, t.edits("B"))), _prior(t), 1.5))
query("profile_neighbours", "entity:S degree:L w:L", "SELECT entity, count(*) AS degree, sum(w) AS w FROM (SELECT a.entity, b.entity AS o, sum(a.m) AS w FROM (SELECT doc_id, entity, count(*) AS m FROM gold WHERE type = 'PERSON' GROUP BY 1, 2) a JOIN (SELECT DISTINCT doc_id, entity FROM gold WHERE type = 'PERSON') b ON a.doc_id = b.doc_id AND a.entity <> b.entity GROUP BY 1, 2) GROUP BY 1")(
    lambda t: attacks.neighbours(t.gold.where("type = 'PERSON'")).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("w"))
)
_CONTEXT = r"""SELECT entity, lower(t) AS term, count(*) AS n FROM (SELECT g.entity, unnest(regexp_extract_all(substring(d.text, greatest(g.start - 120, 0) + 1, least(g.start, 120)) || ' ' || substring(d.text, g."end" + 1, 120), '([A-Za-z][A-Za-z\x27\-]{2,})', 1)) AS t
    FROM gold g JOIN documents d USING (doc_id) WHERE g.type = 'PERSON') WHERE lower(t) NOT IN (SELECT term FROM stop) GROUP BY 1, 2"""
query("profile_context", "entity:S term:S n:L", _CONTEXT)(lambda t: attacks.context(t.docs, t.gold.where("type = 'PERSON'")))


VOCABULARY = 20_000


def _features(t: Tables) -> DataFrame:
    halves = sampling.folds(t.docs.select("doc_id"), 2, 5).selectExpr("doc_id", "if(fold = 0, 'gallery', 'query') as side")
    mentions = written(t.gold.where("type = 'PERSON'").join(halves, "doc_id").select("side", "doc_id", "entity", "start", "end"), "mentions")
    near = written(attacks.bags(t.docs, mentions), "bags")
    terms = attacks.vocabulary(near, VOCABULARY)
    return written(attacks.featurise(attacks.structure(mentions).join(near, ["side", "entity"], "left"), terms, VOCABULARY), "features")


query("a3_linkage", "queries:L rank1:D rank5:D mrr:D")(lambda t: attacks.rank_summary(attacks.rank(_features(t))))

# --- analytic reports ---------------------------------------------------------------------------
query("spans_per_language", "detector:S lang:S spans:L documents:L", "SELECT detector, lang, count(*) AS spans, count(DISTINCT doc_id) AS documents FROM spans JOIN documents USING (doc_id) GROUP BY ROLLUP (detector, lang)")(
    lambda t: t.spans.join(t.docs.select("doc_id", "lang"), "doc_id").rollup("detector", "lang").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("doc_id").alias("documents"))
)
query(
    "latency_summary", "event_type:S n:L mean:D median:D p90:D",
    "SELECT event_type, count(*) AS n, avg(value) AS mean, median(value) AS median, max(value) FILTER (r = floor(0.9 * (m - 1)) + 1) AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL) GROUP BY 1",
)(
    lambda t: t.table("events").where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k"))
    .selectExpr("*", "sum(k) over (partition by event_type order by value) as upto", "sum(k) over (partition by event_type) as m").groupBy("event_type")
    .agg(F.sum("k").alias("n"), (F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("mean"), F.expr("percentile(value, 0.5, k)").alias("median"), F.expr("min(case when upto > floor(0.9 * (m - 1)) then value end)").alias("p90"))
)
query("detector_records", "detector:S documents:L missing:L", "SELECT detector, count(DISTINCT doc_id) AS documents, (SELECT count(*) FROM documents) - count(DISTINCT doc_id) AS missing FROM spans GROUP BY 1")(
    lambda t: t.spans.groupBy("detector").agg(F.countDistinct("doc_id").alias("documents")).crossJoin(F.broadcast(t.docs.agg(F.count(F.lit(1)).alias("all_")))).selectExpr("detector", "documents", "all_ - documents as missing")
)
query("shared_identities", "type:S n:L", "SELECT type, count(*) AS n FROM (SELECT type, entity FROM gold WHERE doc_id % 2 = 0 INTERSECT SELECT type, entity FROM gold WHERE doc_id % 2 = 1) GROUP BY 1")(
    lambda t: t.gold.groupBy("type", "entity").agg(F.countDistinct(F.expr("doc_id % 2")).alias("k")).where("k = 2").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
)
query("documents_per_identity", "docs:L identities:L", "SELECT docs, count(*) AS identities FROM (SELECT entity, count(DISTINCT doc_id) AS docs FROM gold GROUP BY 1) GROUP BY 1")(
    lambda t: t.gold.groupBy("entity").agg(F.countDistinct("doc_id").alias("docs")).groupBy("docs").agg(F.count(F.lit(1)).alias("identities"))
)
query(
    "duplicate_leak", "half:S documents:L leaked:L",
    f"""WITH h AS (SELECT doc_id, sha1({_FOLDED}) AS d, CASE WHEN doc_id % 2 = 0 THEN 'gallery' ELSE 'query' END AS half FROM documents)
    SELECT half, count(*) AS documents, count(*) FILTER (k = 2) AS leaked FROM (SELECT h.half, x.k FROM h JOIN (SELECT d, count(DISTINCT half) AS k FROM h GROUP BY 1) x USING (d)) GROUP BY 1""",
)(
    lambda t: t.docs.selectExpr(f"sha1({dedup._FOLD}) as d", "if(doc_id % 2 = 0, 'gallery', 'query') as half").groupBy("d", "half").agg(F.count(F.lit(1)).alias("n"))
    .groupBy("d").agg(F.sum(F.expr("if(half = 'gallery', n, 0)")).alias("g"), F.sum(F.expr("if(half = 'query', n, 0)")).alias("q"))
    .selectExpr("inline(array(struct('gallery' as half, g as n, if(q > 0, g, 0) as l), struct('query' as half, q as n, if(g > 0, q, 0) as l)))").groupBy("half").agg(F.sum("n").alias("documents"), F.sum("l").alias("leaked"))
)
query(
    "clipped_or_missed", "outcome:S n:L",
    """SELECT outcome, count(*) AS n FROM (SELECT g.doc_id, g.ord, CASE WHEN max((s.start <= g.start AND s."end" >= g."end")::INT) = 1 THEN 'covered' WHEN count(s.doc_id) > 0 THEN 'clipped' ELSE 'missed' END AS outcome
    FROM gold g LEFT JOIN spans s ON s.doc_id = g.doc_id AND s.detector IN ('pair', 'digits') AND s."end" > g.start AND s.start < g."end" GROUP BY 1, 2) GROUP BY 1""",
)(
    lambda t: t.gold.alias("g").join(t.spans.where("detector in ('pair', 'digits')").alias("s"), F.expr("g.doc_id = s.doc_id and s.end > g.start and s.start < g.end"), "left")
    .groupBy("g.doc_id", "g.ord").agg(F.max(F.expr("s.start <= g.start and s.end >= g.end")).alias("whole"), F.count("s.doc_id").alias("k"))
    .selectExpr("case when whole then 'covered' when k > 0 then 'clipped' else 'missed' end as outcome").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
)
query(
    "detector_agreement", "a:S b:S n:L",
    'SELECT a.detector AS a, b.detector AS b, count(*) AS n FROM covered a JOIN covered b ON a.doc_id = b.doc_id AND a.ord = b.ord AND a.detector <= b.detector GROUP BY 1, 2',
)(
    lambda t: metrics.covered(t.docs, t.spans).withColumnRenamed("detectors", "d").groupBy("d").agg(F.count(F.lit(1)).alias("k")).selectExpr("d", "k", "explode(d) as a").selectExpr("a", "k", "explode(filter(d, x -> x >= a)) as b").groupBy("a", "b").agg(F.sum("k").alias("n"))
)
query(
    "multilabel_f1", "condition:S tp:L n_ref:L n_got:L f1:D",
    f"SELECT condition, sum(score * ref) AS tp, sum(ref) AS n_ref, sum(score) AS n_got, 2 * sum(score * ref) / (sum(ref) + sum(score)) AS f1 FROM ({_PAIRED.format(_QUALITY)}) GROUP BY 1",
)(lambda t: stats.paired(t.quality).groupBy("condition").agg(F.sum(F.col("score") * F.col("ref")).alias("tp"), F.sum("ref").alias("n_ref"), F.sum("score").alias("n_got")).selectExpr("*", "2 * tp / (n_ref + n_got) as f1"))
query(
    "deciles", "decile:L documents:L least:L most:L",
    "SELECT decile, count(*) AS documents, min(n_chars) AS least, max(n_chars) AS most FROM (SELECT n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) * 10 // count(*) OVER () + 1 AS decile FROM documents) GROUP BY 1",
)(
    lambda t: t.docs.groupBy("n_chars").agg(F.count(F.lit(1)).alias("k")).selectExpr("n_chars", "k", "sum(k) over (order by n_chars) - k as before", "sum(k) over () as m")
    # a value's ranks fall into one decile, or into a run of them: counts stay counts
    .selectExpr("n_chars", "m", "before", "before + k as upto", "explode(sequence(before * 10 div m + 1, (before + k - 1) * 10 div m + 1)) as decile")
    .selectExpr("decile", "n_chars", "least(upto, (decile * m + 9) div 10) - greatest(before, ((decile - 1) * m + 9) div 10) as n").groupBy("decile").agg(F.sum("n").alias("documents"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))
)
