import corpus_pipeline
import pytest

from maskwright.llm import langid, mix, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, mark int, `__mark` string, epoch int, component_id string"
COLUMNS = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def test_stages(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "s1", 10), (2, text, "en", "s1", 10), (3, "...", "en", "s1", 3), (4, "other words entirely " * 3, "en", "s2", 9), (5, None, None, None, None), (6, "more " + text, "en", "s2", 9)]
    docs = frame(spark, rows)
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == COLUMNS
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept[0] == [1, 2, 4, 6] and kept[1][0] == 1 and 2 not in kept[1]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(kept[-1])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_of_nothing(spark, name, stage):
    assert stage(spark, frame(spark, [(1, "a", "en", "s", 1)]).limit(0), "").count() == 0


def test_near_dedup_keeps_one_row_of_a_group(spark):
    rows = [(1, "alpha beta gamma delta", "en", "s", 1), (1, "quite another text of seven words", "en", "s", 1), (1, "alpha beta gamma delta", "en", "t", 1), (2, "alpha beta gamma delta", "en", "s", 1)]
    rows += [(None, "a third text that no other equals", None, None, None), (7, None, None, None, None), (8, "", None, None, None), (9, " ", None, None, None)]
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, rows[0][1]), (1, rows[1][1]), (0, rows[4][1]), (7, "")])
    groups = simhash.simhash_dedup(spark, frame(spark, rows)).select("group_root").distinct().count()
    assert groups == len(got)


def test_remove_repeats_counts_again(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    got = {r.doc_id: r for r in corpus_pipeline.remove_repeats(spark, frame(spark, [(1, passage, "en", "s", 7), (2, f"own  words {passage}", "en", "s", 7), (3, None, None, None, None)]), "").collect()}
    assert got[1].text == passage and got[2].text == "own words" and got[2].n_chars == 9 and got[3].text is None and got[3].n_chars is None


def test_mix_meets_budgets(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(10 + i % 7)), "en", f"s{i % 4}", 1) for i in range(60)] + [(100, None, None, None, None), (None, "one two", "en", "s1", 7)]
    docs = frame(spark, rows)
    got = corpus_pipeline.mix(spark, docs, "").collect()
    want = {}
    for r in mix.mix_sources(spark, docs, share=corpus_pipeline.MIX_SHARE, epochs=1).collect():
        want[r.source] = want.get(r.source, 0) + r.take_tokens
    have = {}
    for r in got:
        have[r.source or mix.NULL] = have.get(r.source or mix.NULL, 0) + len((r.text or "").split())
    assert {k: v for k, v in have.items() if v} == {k: v for k, v in want.items() if v}
    assert sum(have.values()) == int(0.95 * sum(len((r[1] or "").split()) for r in rows))
    cut = [r for r in got if r.n_chars not in (1, 7, None)]
    assert all(r.n_chars == len(r.text) for r in cut) and 1 <= len(cut) <= 5


def test_gibberish_is_rejected(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(langid, "STEPS", 120)
    rng = np.random.default_rng(4)
    speak = lambda parts, size: " ".join("".join(rng.choice(parts, size)) for _ in range(40))
    said = {"en": ["the", "ing", "er"], "es": ["ção", "ñu", "lla"], "de": ["sch", "ung", "ck"], "fr": ["eau", "oi", "que"], "it": ["zio", "gli", "ma"]}
    for langs in (list(said)[:4], list(said)):
        rows = [(i, speak(said[lang], 3), lang, "s", 9) for i, lang in enumerate(x for x in langs for _ in range(40))]
        junk = [(1000 + i, speak(list("bcdfghjklmnpqrstvwxz"), 7), None, "s", 9) for i in range(10)]
        kept = {r.doc_id for r in langid.accepted(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
        assert not [i for i in kept if i >= 1000]
        assert len(kept) >= 0.95 * len(rows)
