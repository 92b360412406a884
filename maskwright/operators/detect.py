"""Native detectors: word patterns to spans, and span-set hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Detector -> word pattern, raw label and score; boundaries and recall differ on purpose.
DETECTORS: dict[str, tuple[str, str, float]] = {
    "strict": (r"^[A-Z][a-z]{4,}$", "B-PER", 0.9),
    "loose": (r"^[A-ZÀ-Þ][a-zß-ÿ]+$", "per", 0.6),
    "title": (r"^[A-ZÀ-Þ][a-zß-ÿ]{2,}$", "Person Name", 0.7),
    "mail": (r"^[^@]+@[^@]+[.][a-z]+$", "E-MAIL", 0.95),
    "digits": (r"[0-9]{3}", "id num", 0.5),
}
GOLD: dict[str, str] = {"PERSON": r"^[A-ZÀ-Þ][a-zß-ÿ]{3,}$", "CODE": r"@|[0-9]{4}"}

# Raw labels of the native detectors and the types they mean.
LABELS = {"PER": "PERSON", "PERSON_NAME": "PERSON", "E_MAIL": "CODE", "ID_NUM": "CODE"}


def detect(words: DataFrame) -> DataFrame:
    """Words with their followers -> ``doc_id, detector, ord, start, end, text, type_src, score``; ``pair`` joins two capitalised words one character apart."""
    cap = "rlike '^[A-ZÀ-Þ][a-zß-ÿ]+$'"
    one = "struct('{}' as detector, ord, start, {} as end, {} as text, '{}' as type_src, {}D as score)"
    found = [f"if(word rlike '{p}', {one.format(n, 'end', 'word', label, score)}, null)" for n, (p, label, score) in DETECTORS.items()]
    pair = one.format("pair", "end2", "concat(word, ' ', word2)", "PERSON NAME", 0.8)
    found.append(f"if(word {cap} and word2 {cap} and start2 = end + 1, {pair}, null)")
    # all detectors in one pass over the words
    return words.selectExpr("doc_id", f"inline(filter(array({', '.join(found)}), x -> x is not null))")


def gold(words: DataFrame) -> DataFrame:
    """Reference mentions: ``doc_id, ord, start, end, text, type, entity``; an entity is a type and a folded surface."""
    kind = " ".join(f"when word rlike '{p}' then '{t}'" for t, p in GOLD.items())
    rows = words.selectExpr("doc_id", "ord", "start", "end", "word as text", f"case {kind} end as type").where("type is not null")
    return rows.selectExpr("*", "concat(type, ':', lower(text)) as entity")


def normalise_label(c: str) -> str:
    """BIO prefix off, white space and hyphens to one underscore, upper case."""
    return rf"upper(trim(both '_' from regexp_replace(regexp_replace(trim({c}), '^[BIESUL][-_](.)', '$1'), '[ \\t\\-]+', '_')))"


def harmonise(spans: DataFrame) -> DataFrame:
    """Adds ``type`` and ``was_mapped``; labels not in the table become MISC unless they are a type already."""
    label = normalise_label("type_src")
    table = " ".join(f"when '{k}' then '{v}'" for k, v in LABELS.items())
    types = "'PERSON','LOC','ORG','DATETIME','CODE','DEMOGRAPHIC','QUANTITY','MISC'"
    rows = spans.selectExpr("*", f"{label} as label_").selectExpr("*", f"case label_ {table} else case when label_ in ({types}) then label_ end end as type_")
    return rows.selectExpr(*(f"`{c}`" for c in spans.columns), "coalesce(type_, 'MISC') as type", "type_ is not null as was_mapped")


def code_filter(spans: DataFrame) -> DataFrame:
    """Drops CODE spans under five characters or without a letter or digit."""
    return spans.where(r"type <> 'CODE' or (length(trim(text)) >= 5 and text rlike '[\\p{L}\\p{N}]')")


def dedupe(spans: DataFrame) -> DataFrame:
    """One span for each document, place and type: the best score, then detector."""
    rows = spans.selectExpr("*", "row_number() over (partition by doc_id, start, end, type order by coalesce(score, 0) desc, detector, ord) as nth_")
    return rows.where("nth_ = 1").drop("nth_")


def text_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping windows of characters, the last clipped."""
    step = size - overlap
    rows = docs.selectExpr("doc_id", "text", f"explode(sequence(0, greatest(length(text) - {overlap} - 1, 0), {step})) as start")
    return rows.selectExpr("doc_id", "start", f"substring(text, start + 1, {size}) as window")
