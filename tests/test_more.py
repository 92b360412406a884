"""Taxonomy, ports, inventories, patch sets, occurrences, trained scorers, candidate attacks and reports on small frames."""

import itertools
import json
import random
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.functions.text import tokens
from maskwright.operators import attacks, audits, construct, inventory, linear, occurrences, patches, ports, ranking, reports, sampling, tasks, taxonomy
from maskwright.plans import QUERIES
from maskwright.sources import readers


def test_routes_against_tables(spark):
    labels = [(f"{d}", x) for d in ("llm:a", "local:b", "gliner:x", "presidio-de", "privacy_tagger", "hf:obi/deid_roberta_i2b2", "gold:tab", "other") for x in ("B-PER", "person", "e-mail", "EMAIL", "date time", "DATE_TIME", "OTHERPHI", "I-dem", "Patient", "weird label", "_ORG_")]
    got = {(r.detector, r.type_src): (r.type, r.was_mapped) for r in taxonomy.harmonise(spark.createDataFrame(labels, "detector string, type_src string")).collect()}
    for d, x in labels:
        key = x.strip()
        key = key[2:] if key[:2] in ("B-", "I-") else key
        key = "_".join(key.replace("-", " ").split()).strip("_").upper()
        routes = taxonomy.ROUTES.get(taxonomy.source_for(d), {})
        want = next((t for t, names in routes.items() if key in names.split()), key if key in taxonomy.TYPES else None)
        assert got[d, x] == (want or "MISC", want is not None), (d, x)
    assert got["hf:obi/deid_roberta_i2b2", "OTHERPHI"] == ("MISC", True)
    with pytest.raises(KeyError):
        taxonomy.source_for("gold")
    twice = taxonomy.tally(taxonomy.harmonise(spark.createDataFrame([("other", "weird label")] * 2, "detector string, type_src string")))
    assert taxonomy.merge_tallies(twice, twice).first().n == 4


def test_replies_and_grounding(spark):
    whole = '[{"text": "Ann", "type": "person"}, {"text": "x"}, 3, {"text": ""}]'
    assert ports.parse_reply(f"sure: {whole} done") == [("Ann", "PERSON"), ("x", "MISC")]
    assert ports.parse_reply('[{"text": "Ann", "type": "PERSON"}, {"text": "Bo", "ty') == [("Ann", "PERSON")]
    assert ports.parse_reply(None) == ports.parse_reply("none") == ports.parse_reply("[broken") == []
    text = "José met  Ann. JOSÉ left; Ann stayed"
    found = [text[a:b] for a, b, _ in ports.ground(text, [("Ann", "P"), ("Ann", "P"), ("met ann", "X"), ("Zed", "P"), ("jose", "P")])]
    assert found[:3] == ["Ann", "Ann", "met  Ann"] and found[3].startswith("Jos")
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    replies = spark.createDataFrame([(1, 0, '[{"text": "Ann", "type": "PERSON"}]'), (1, 10, '[{"text": "Ann", "type": "PERSON"'), (1, 20, '[{"text": "Ann", "type": "PERSON"}]'), (2, 0, whole)], "doc_id long, start int, reply string")
    assert [(r.doc_id, r.start) for r in ports.grounded(docs, replies, "m").orderBy("start").collect()] == [(1, 10), (1, text.rindex("Ann"))]


def test_gateway_and_streams():
    assert ports.retry_after("7") == 7 and ports.retry_after(None, "Please try again in 250ms") == 0.25 and ports.retry_after(None, "retry after 2 minutes") == 120 and ports.retry_after("soon") is None
    lines = ['data: {"choices": [{"delta": {"content": "a"}}]}', ": ping", 'data: {"choices": [{"delta": {"content": "b"}, "finish_reason": "stop"}]}', "data: [DONE]"]
    assert ports.assemble_stream(lines) == ("ab", "stop")
    answers, waits = iter([(429, "3", ""), (503, None, ""), (429, None, "try again in 9 s"), (200, None, "ok")]), []
    assert ports.Gateway(lambda m: next(answers), waits.append).ask([]) == "ok" and waits == [3.0, 2.0, 9.0]
    with pytest.raises(RuntimeError):
        ports.Gateway(lambda m: (400, None, ""), waits.append).ask([])
    assert ports.align_tokens("one  two three", ["one", "two", "missing", "three"]) == [(0, 3), (5, 8), None, (9, 14)]


def test_model_port(spark):
    docs = spark.createDataFrame([(i, "say Ann" if i % 2 else None) for i in range(7)], "doc_id long, text string")
    factory = lambda: lambda texts: [[{"start": 4, "end": 7, "label": "PER"}] if t else [] for t in texts]
    assert sorted((r.doc_id, r.text) for r in ports.model(docs, "m", factory, batch=2).collect()) == [(1, "Ann"), (3, "Ann"), (5, "Ann")]
    with pytest.raises(KeyError):
        ports.detect(docs, ["nothing of the kind"])
    records = spark.createDataFrame([("plain", None, False, 10, k) for k in range(1, 101)] + [("plain", "x", False, 10, 900), ("plain", None, True, 10, 900)], "family string, error string, truncated boolean, prompt_tokens int, completion_tokens int")
    assert ports.fit_ratio(records).first().ratio == 10.0 or ports.fit_ratio(records).first().ratio == 9.9


def test_inventories(spark):
    stock = spark.createDataFrame([("P", "en", f"n{i}", float(i + 1), "f" if i < 3 else None) for i in range(9)], "type string, lang string, surface string, freq double, gender string")
    rng = random.Random(1)
    idx = [rng.randrange(1 << 32) for _ in range(60)] + [0, (1 << 32) - 1]
    mentions = spark.createDataFrame([("P", "en", x, "f" if n % 2 else "x") for n, x in enumerate(idx)], "type string, lang string, idx long, gender string")
    order = sorted(((-f, s) for _, _, s, f, _ in stock.collect()))
    upto = list(itertools.accumulate(-f for f, _ in order))
    weighted = {r.idx: r.surrogate for r in inventory.drawn(mentions, stock, weighted=True).collect()}
    assert weighted == {x: order[next(i for i, u in enumerate(upto) if u > x / (1 << 32) * upto[-1])][1] for x in idx}
    strata = {r.idx: r.surrogate for r in inventory.drawn(mentions, stock, attributes=["gender"]).collect()}
    assert all(strata[x] == (["n2", "n1", "n0"][x % 3] if n % 2 else order[x % 9][1]) for n, x in enumerate(idx))
    with pytest.raises(Exception, match="no names for type P, language fr"):
        inventory.drawn(spark.createDataFrame([("P", "fr", 1)], "type string, lang string, idx long"), stock).collect()
    with pytest.raises(Exception, match="two inventories hold P, en"):
        inventory.merged(stock, stock).collect()
    parts = spark.createDataFrame([("zh", a, None, n, None) for a, n in (("Li", 5), ("Wu", 2))] + [("zh", None, b, None, n) for b, n in (("an", 3), ("bo", 1))], "lang string, first string, last string, freq_first long, freq_last long")
    gone = spark.createDataFrame([("zh", "Lian")], "lang string, surface string")
    assert [(r.surface, r.freq) for r in inventory.recombined(parts, gone, 3).orderBy("freq").collect()] == [("Libo", 5.0), ("Wuan", 6.0)]


def _released(spark):
    docs = spark.createDataFrame([(1, "Anna Lee met Bo in Rome. Then Weber left."), (2, "Nobody here")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 0, 8, "Anna Lee", "PERSON", True), (1, 1, 5, 8, "Lee", "PERSON", False), (1, 2, 19, 23, "Rome", "DATETIME", True)], "doc_id long, ord int, start int, end int, text string, type string, kept boolean")
    gold = spark.createDataFrame([(1, 0, 0, 4, "Anna", "PERSON", "e1"), (1, 1, 5, 8, "Lee", "PERSON", "e2"), (1, 2, 30, 35, "Weber", "PERSON", "e3"), (1, 3, 19, 23, "Rome", "LOC", "e4")], "doc_id long, ord int, start int, end int, text string, type string, entity string")
    return docs, spans, gold


def test_patch_round_trip(spark, tmp_path):
    docs, spans, gold = _released(spark)
    built = patches.build(docs, spans, ("A", "B", "C"))
    patches.write_patches(built, str(tmp_path / "p"))
    back = patches.read_patches(spark, str(tmp_path / "p"))
    rows = lambda x: sorted(json.dumps(r.asDict(True), sort_keys=True) for r in x.select("doc_id", "condition", "text_sha256", "skipped", "entries").collect())
    assert rows(back) == rows(built)
    c = back.where("condition = 'C'")
    assert [(r.doc_id, r.released) for r in patches.apply(docs, c).collect()] == [(1, "[PERSON] met Bo in [DATETIME]. Then Weber left.")]
    assert patches.apply(docs, c, keep_unpatched=True).count() == 2
    assert {r.released for r in patches.apply(docs, back.where("condition = 'A'")).collect()} == {r.text for r in docs.collect()}
    assert c.first().skipped == 1
    assert {r.old_start: r.gold_entity for r in patches.with_chains(patches.opened(c), gold).collect()} == {0: "e1", 19: "e4"}
    moved = {r.ord: (r.start, r.end) for r in patches.remap(gold.select("doc_id", "ord", "start", "end"), patches.opened(c)).collect()}
    assert moved == {0: (0, 4), 1: (5, 8), 2: (36, 41), 3: (19, 29)}  # eight letters stay in place, ten replace four
    assert patches.check_current(docs, back).count() == back.count()
    with pytest.raises(Exception, match="3 stale patches, first of document 1"):
        patches.check_current(docs.selectExpr("doc_id", "concat(text, if(doc_id = 1, '!', '')) as text"), back.where("condition <> 'A'").union(back.where("condition = 'A' and doc_id = 1"))).collect()
    with pytest.raises(ValueError):
        patches.condition("D")


def test_occurrences(spark):
    docs, spans, gold = _released(spark)
    e = patches.with_chains(construct.edits(construct.assign(spans.where("kept")), "case type when 'PERSON' then 'Kim Sol' else text end"), gold)
    released = construct.splice(docs, e)
    got = [(r.surface, r.label, r.entity, r.replaced_type, r.old_start) for r in occurrences.label_occurrences(docs, released, e, gold.where("type = 'PERSON'")).where("doc_id = 1").orderBy("start").collect()]
    assert got == [("Kim Sol", "surrogate", "e1", "PERSON", 0), ("Bo", "other", None, None, 13), ("Rome", "other", None, None, 19), ("Then Weber", "survivor", "e3", None, 25)]
    text = "Xu Weber"  # a run split where a replacement ends
    cut = occurrences.label("Li Weber", text, [{"old_start": 0, "old_end": 2, "new_start": 0, "new_end": 2, "replacement": "Xu", "type": "PERSON", "gold_entity": None}], [{"start": 3, "end": 8, "entity": "w"}])
    assert [(x[4], x[5], x[6]) for x in cut] == [("Xu", "surrogate", None), ("Weber", "survivor", "w")]
    caused = {r.ord: r.cause for r in occurrences.causes(gold, spans.select("doc_id", "start", "end"), spans, e).collect()}
    assert caused == {0: "safe", 1: "safe", 2: "not_detected", 3: "unchanged"}


def test_classifier(spark, tmp_path):
    rng = random.Random(4)
    say = {"a": "apple orange pear plum", "b": "hammer nail saw drill", "c": "violin flute drum harp"}
    rows = [(i, " ".join(rng.choices(say[k].split(), k=8)) + " common words", k) for i, k in ((i, "abc"[i % 3]) for i in range(90))]
    docs = linear.text_terms(spark.createDataFrame(rows, "doc_id long, text string, label string"))
    got = linear.cross_fit(docs, ["words_", "chars_"], 3, 1, iterations=15)
    assert got.count() == 90 and got.where("label = predicted").count() == 90
    model = linear.train(docs, ["words_"], iterations=15)
    assert {r.predicted for r in model.predict(docs, ["a", "b"]).where("label = 'c'").collect()} <= {"a", "b"}
    model.save(str(tmp_path / "m"), spark)
    again = linear.load(str(tmp_path / "m"), spark)
    assert again.labels == model.labels and again.predict(docs).where("label = predicted").count() == 90
    two = linear.train(docs.where("label <> 'c'"), ["words_"], iterations=10)
    assert len(two.scores(docs).first().raw) == 2
    terms = spark.sql(f"select {linear.word_terms(chr(39) + 'One two, a THREE' + chr(39))} as w, {linear.char_terms(chr(39) + 'ab c' + chr(39))} as c").first()
    assert terms.w == ["one", "two", "three", "one two", "two three"] and terms.c == [" ab", "ab ", " c ", " ab ", " c "]


def test_tagger(spark):
    texts = [(i, f"we saw {n} in {p} and then went home 12") for i, (n, p) in enumerate(itertools.product(["Anna", "Boris", "Clara", "Dora"], ["Rome", "Paris", "Bonn"]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spans = spark.createDataFrame([(i, 7, 7 + len(t.split()[2]), "PERSON") for i, t in texts], "doc_id long, start int, end int, type string")
    tagged = linear.task_tags(tokens(docs), spans)
    feats = {r.tok: r.feats for r in linear.token_features(tagged).where("doc_id = 0").collect()}
    assert feats["Anna"] == ["w=anna", "shape=Xxxx", "pre3=ann", "suf3=nna", "suf2=na", "prev=saw", "next=in", "bigram=saw_anna", "isdigit=false", "istitle=true", "isupper=false"]
    assert "isdigit=true" in feats["12"] and "next=</s>" in feats["12"] and "prev=<s>" in feats["we"]
    model = linear.train_tagger(tagged.where("doc_id < 9"), iterations=20)
    got = model.predict(linear.token_features(tagged.where("doc_id >= 9")))
    assert got.where("label <> predicted").count() == 0 and got.where("predicted = 'B-PERSON'").count() == 3


def test_learned_metric(spark):
    rng = np.random.default_rng(3)
    n, width = 40, 12
    mark, noise = rng.random((n, 6)), rng.random((2, n, 6)) * 3
    rows = [(side, f"e{i:02d}", list(range(width)), (v / np.linalg.norm(v)).tolist()) for s, side in enumerate(("query", "gallery")) for i in range(n) for v in [np.concatenate([mark[i], noise[s][i]])]]
    features = spark.createDataFrame(rows, "side string, entity string, cols array<int>, ws array<double>")
    pairs = pd.DataFrame({"qc": [list(range(width))] * n, "gc": [list(range(width))] * n, "qw": [r[3] for r in rows[:n]], "gw": [r[3] for r in rows[n:]]})
    weights = ranking.fit_metric(pairs, width)
    assert weights[:6].mean() > weights[6:].mean() and (weights >= 0).all()
    plain = attacks.rank_summary(attacks.rank(features)).first()
    learned = ranking.learned_linkage(features, width, k=4)
    assert learned.count() == n and learned.select("query").distinct().count() == n
    assert attacks.rank_summary(learned).first().mrr >= plain.mrr


def test_candidate_items(spark):
    docs = spark.createDataFrame([(i, f"text {i} Kim{i} word{i % 5} tail") for i in range(12)], "doc_id long, released string")
    edits = spark.createDataFrame([(i, 7, 11, len(f"text {i} "), len(f"text {i} Kim{i}"), f"Kim{i}", f"e{i % 5}") for i in range(12)], "doc_id long, old_start int, old_end int, new_start int, new_end int, replacement string, gold_entity string")
    gold = spark.createDataFrame([(i, f"e{i % 5}", f"Name{i % 5}") for i in range(12)] + [(3, "e9", "Kim3 Zed")], "doc_id long, entity string, text string")
    items = ranking.items(docs, edits, gold, n=4, context=20)
    rows = items.collect()
    assert len(rows) == 12
    for r in rows:
        names = [c.entity for c in r.candidates]
        assert len(names) == len(set(names)) == 4 and r.truth in names and f"«{r.pseudonym}»" in r.marked
        assert all(f"Kim{r.doc_id} " not in c.context for c in r.candidates)
    assert {r.key for r in ranking.items(docs, edits, gold, n=4).collect()} == {r.key for r in rows}
    first = rows[0]
    at = [c.entity for c in first.candidates].index(first.truth)
    said = spark.createDataFrame([(first.key, [at]), (rows[1].key, [(([c.entity for c in rows[1].candidates].index(rows[1].truth)) + 1) % 4])], "key string, ranking array<int>")
    scored = {r.key: r for r in ranking.score(items, said, "C").collect()}
    assert scored[first.key].outcome == "recovered" and scored[rows[1].key].outcome == "failed" and scored[rows[1].key].rank > 1
    gone = {r.key: r for r in ranking.score(items, said, "C", may_abstain=True).collect()}
    assert gone[rows[2].key].outcome == "abstained" and gone[rows[2].key].rank == 4
    assert ranking.parse_ranking("I say [3, 1, 3, 9]", 4) == [2, 0] and ranking.parse_ranking("unknown", 4) is None
    best = ranking.score(items, ranking.similarity_ranker(items), "B")
    assert best.count() == 12 and ranking.report(best).first().rank5 == 1.0
    back = ranking.model_ranker(items, lambda: lambda marked, candidates: str(1 + len(candidates) % 2)).collect()
    assert {tuple(r.ranking) for r in back} == {(0,)}
    train, test = ranking.split_entities(items, 0.6, 1)
    assert not {r.truth for r in train.collect()} & {r.truth for r in test.collect()}
    assert ranking.linear_ranker(items, ranking.train_linear_ranker(items, iterations=5)).count() == 12


def test_misled(spark):
    items = spark.createDataFrame([("k", 1, "«Kim Sol»", "e1", "Kim Sol", [("e2", "Sol Weber", ""), ("e1", "Ann", "")])], "key string, doc_id long, marked string, truth string, pseudonym string, candidates array<struct<entity: string, surface: string, context: string>>")
    said = spark.createDataFrame([("k", [0])], "key string, ranking array<int>")
    assert [ranking.score(items, said, c).first().outcome for c in "BC"] == ["misled", "failed"]


def test_reports(spark):
    scores = [("t", c, i, float(i % 2 if c == "A" else 0)) for c in "AB" for i in range(60)] + [("few", c, i, 1.0) for c in "AB" for i in range(3)] + [("low", c, i, 0.0) for c in "AB" for i in range(30)]
    rows = {r.task: r for r in reports.compare(spark.createDataFrame(scores, "task string, condition string, doc_id long, score double")).collect()}
    assert rows["t"].kind == "binary" and rows["t"].p < 1e-6 and rows["t"].interpretable and not rows["few"].interpretable and not rows["low"].interpretable and rows["low"].p is None
    verdicts = {r.task: r.verdict for r in reports.utility_report(reports.compare(spark.createDataFrame(scores, "task string, condition string, doc_id long, score double"))).collect()}
    assert verdicts == {"t": "changed", "few": "not interpretable", "low": "not interpretable"}
    rng = np.random.default_rng(2)
    v = rng.random((9, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    frame = spark.createDataFrame([(f"e{i}", list(range(5)), x.tolist()) for i, x in enumerate(v)], "entity string, cols array<int>, ws array<double>")
    r = reports.pairwise_cosine(frame).first()
    assert r.pairs == 36 and r.mean == pytest.approx(np.mean([v[i] @ v[j] for i in range(9) for j in range(9) if i != j]))
    parts = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 0)], "source string, v long, shard int")
    assert sorted((x.source, x.v) for x in reports.merge_shards(parts).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(Exception, match="shards disagree on a"):
        reports.merge_shards(parts.union(spark.createDataFrame([("a", 9, 2)], parts.schema))).collect()
    joined = reports.safety(
        spark.createDataFrame([("x", 0.5), ("y", 0.7), ("z", 0.9)], "source string, youden double"), spark.createDataFrame([("x", 30, 0.1, 100), ("y", 30, 0.1, 100), ("z", 3, 0.0, 100)], "source string, queries long, rank1 double, gallery long"),
        spark.createDataFrame([(s, 0.0) for s in "xyz"], "source string, mean_diff double"),
    )
    assert {x.source: (x.safest, x.enough) for x in joined.collect()} == {"x": (False, True), "y": (True, True), "z": (False, False)}
    weights = reports.rank_weights(spark.createDataFrame([(1, 50), (2, 20)], "rank int, n long"), spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "rank int, name string"))
    assert {x.name: x.freq for x in weights.collect()} == {"a": 50, "b": 20, "c": 20}
    picked = reports.decile_sample(spark.createDataFrame([(f"s{i:03d}", i / 7) for i in range(100)], "source string, v double"), "source", "v", 2, 1, ["s000"])
    assert 20 <= picked.count() <= 21 and picked.where("source = 's000'").count() == 1
    assert "&lt;b&gt;" in reports.page("t", {"x": (["a"], [["<b>"], [None], [0.5]])})


def test_tasks_and_answers(spark):
    assert tasks.parse_array('so ["a", 3, {"x": 1}] ok') == ["a", "3"] and tasks.parse_array("- one\n* two\n") == ["one", "two"] and tasks.parse_array(None) == []
    assert tasks.closest("Anamnesis.", ["Anamnesis", "Diagnosis"]) == "Anamnesis" and tasks.closest("the diagnosis", ["Anamnesis", "Diagnosis"]) == "Diagnosis" and tasks.closest("x", ["a", "b"]) is None
    rows = spark.createDataFrame([(1, ["a"], ["a", "b"]), (2, [], [])], "doc_id long, gold array<string>, got array<string>")
    assert {r.doc_id: round(r.score, 3) for r in tasks.multilabel(rows).collect()} == {1: 0.667, 2: 1.0}
    items = spark.createDataFrame([(1, "x", True, True, True), (1, "y", False, True, False), (2, "z", True, False, True)], "doc_id long, item string, in_narrative boolean, is_gold boolean, is_got boolean")
    assert {(r.doc_id, r.split): round(r.f1, 3) for r in linear.split_scores(items).collect()} == {(1, "all"): 0.667, (1, "narrative"): 1.0, (1, "other"): 0.0, (2, "all"): 0.0, (2, "narrative"): 0.0, (2, "other"): 1.0}
    scored = tasks.regression(spark.createDataFrame([(1, 2.0, 3.5)], "doc_id long, value double, truth double"))
    assert scored.first().score == -1.5
    swept = tasks.sweep({"A": rows, "B": rows}, tasks.multilabel, "t")
    assert swept.count() == 4
    kept, gone = linear.score_vector("t", swept.selectExpr("doc_id", "if(doc_id = 1, null, score) as s"), "s")
    assert kept.count() == 2 and gone.first().skipped == 2
    docs, spans, gold = _released(spark)
    e = construct.edits(spans.where("kept"), "concat('[', type, ']')")
    released = construct.splice(docs, e)
    whole = tasks.agreement(docs, released, e, lambda d: d.selectExpr("doc_id", "0 as start", "8 as end", "'P' as type").where("doc_id = 1"))
    assert {r.doc_id: r.score for r in whole.collect()} == {1: 1.0, 2: 1.0}


def test_audits(spark):
    dates = [("3.4.21", "03.04.2021"), ("2021-4-3", "03.04.2021"), ("3. März 2021", "03.03.2021"), ("soon", None), ("3. Foo 2021", None)]
    got = {r.s: r.d for r in spark.createDataFrame([(a,) for a, _ in dates], "s string").selectExpr("s", f"{audits.german_date('s')} as d").collect()}
    assert got == dict(dates)
    names = [r.s for r in spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "s string").orderBy(F.expr(audits.numeric_order("s"))).collect()]
    assert names == ["9", "10", "a", "b"]
    assert audits.attack_row("a2", "B", "x", {"r": 0.5, "s": float("nan"), "t": None}) == [("a2", "B", "x", "r", 0.5, ""), ("a2", "B", "x", "s", None, ""), ("a2", "B", "x", "t", None, "")]


def test_records(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    digest = {r.doc_id: r.d for r in docs.selectExpr("doc_id", "substring(sha2(text, 256), 1, 16) as d").collect()}
    rows = [(1, "d", "c", 0, digest[1], "timeout", [1]), (1, "d", "c", 1, digest[1], None, [2]), (2, "d", "c", 0, "old", None, [3]), (3, "d", "c", 0, digest[3], "x", [4])]
    records = spark.createDataFrame(rows, "doc_id long, detector string, corpus string, seq int, text_sha256 string, error string, spans array<int>")
    readers.append_records(records.where("seq = 0"), str(tmp_path / "r"))
    readers.append_records(records.where("seq = 1"), str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert sorted(r.doc_id for r in readers.pending(docs, back).collect()) == [2, 3]
    assert {r.doc_id: r.spans for r in readers.latest(back).collect()} == {1: [2], 2: [3], 3: [4]}
    usable = patches.usable(back.withColumn("truncated", F.lit(False)), docs)
    assert [r.doc_id for r in usable.collect()] == [1]
    with pytest.raises(Exception, match="members share only"):
        patches.covered_by_all(back.union(back.where("doc_id = 1").withColumn("detector", F.lit("e"))), ["d", "e"]).collect()
    assert patches.covered_by_all(back, ["d"]).count() == 3


def test_court_cases(spark, tmp_path):
    mention = lambda i, a, b, t: {"entity_mention_id": f"m{i}", "entity_type": t, "start_offset": a, "end_offset": b, "entity_id": f"e{i}", "identifier_type": "DIRECT", "span_text": ""}
    record = {"doc_id": "d", "text": "Ann saw Bo", "dataset_type": "dev", "quality_checked": True, "meta": {}, "annotations": {"a2": {"entity_mentions": [mention(2, 8, 10, "DEM")]}, "a1": {"entity_mentions": [mention(1, 0, 3, "PERSON")]}}}
    (tmp_path / "x.json").write_text(json.dumps([record, record | {"doc_id": "e", "quality_checked": False}]))
    got = {c: sorted((r.doc_id, r.text, r.type) for r in readers.tab_json(spark, str(tmp_path / "x.json"), c)[1].collect()) for c in ("first", "quality_checked", "all")}
    assert got["first"] == [("d", "Ann", "PERSON"), ("e", "Ann", "PERSON")] and got["quality_checked"] == [("d", "Bo", "DEMOGRAPHIC"), ("e", "Ann", "PERSON")] and len(got["all"]) == 4
    assert readers.tab_json(spark, str(tmp_path / "x.json"), "all", ["DEMOGRAPHIC"])[1].count() == 2


def _peak(run, batch):
    tracemalloc.start()
    rows = sum(x.num_rows for x in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, peak


def test_batches_are_opened_in_runs():
    """What a Python worker holds of pieces does not grow with the documents of a batch."""
    one = "Anna met Bob in Rome " * 1000

    def batch(n):
        spans = [[{"start": 5 * i, "end": 5 * i + 4, "source": "s"} for i in range(100)]] * n
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([one] * n), pa.array(spans, kind)], ["doc_id", "text", "spans_"])

    for run in (text._opened(text.WORD, True), text._opened(text.TOKEN, False), text._meet(["start", "end", "source"], True)):
        (few, low), (many, high) = _peak(run, batch(50)), _peak(run, batch(250))
        assert few == 50 * 5000 and many == 5 * few
        assert high < 1.5 * low
    none = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([None, "", "x" * (3 * text.HELD)])], ["doc_id", "text"])
    assert [x.num_rows for x in text.runs(none)] == [2, 1]
    assert [x.to_pydict()["tok"] for x in text._opened(text.WORD, False)(iter([none]))] == [["x" * (3 * text.HELD)]]


def test_weighted_draws_from_a_long_pool(spark):
    """The entry of every draw, ends of intervals, free entries and out-of-range indexes among them, without an array of the pool in a row."""
    rng = random.Random(7)
    names = [("P", lang, f"n{i:05d}", float(rng.choice([0, 1, 1, 2, 500]))) for lang in ("en", "de") for i in range(3000)]
    stock = spark.createDataFrame([*names, ("P", "zz", "only", 0.0)], "type string, lang string, surface string, freq double")
    idx = [rng.randrange(1 << 32) for _ in range(2000)] + [0, (1 << 32) - 1, 1 << 32, 1 << 31, -1]
    mentions = spark.createDataFrame([(i, "P", ("en", "de", "zz")[i % 3], x) for i, x in enumerate(idx)], "id long, type string, lang string, idx long")
    frame = inventory.drawn(mentions, stock, weighted=True)
    assert frame.columns == ["id", "type", "lang", "idx", "surrogate"]
    got = {r.id: r.surrogate for r in frame.collect()}
    for lang in ("en", "de", "zz"):
        order = sorted((-f, s) for _, of, s, f in stock.collect() if of == lang)
        upto = list(itertools.accumulate(-f for f, _ in order))
        for i, x in enumerate(idx):
            if ("en", "de", "zz")[i % 3] == lang:
                assert got[i] == order[next((k for k, u in enumerate(upto) if u > x / (1 << 32) * upto[-1]), len(order) - 1)][1], (lang, x)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "collect_list" not in plan
    uniform = {r.id: r.surrogate for r in inventory.drawn(mentions.where("idx >= 0"), stock).collect()}
    assert len(uniform) == len(idx) - 1 and all(uniform[i] == "only" for i in uniform if i % 3 == 2)


def test_attested_keeps_every_surface(spark):
    rows = spark.range(25_000).selectExpr("'P' as type", "'en' as lang", "concat('n', id) as surface")
    rows = rows.unionAll(rows).unionAll(rows.where("surface = 'n7'"))
    assert inventory.attested(rows).count() == 25_000
    assert [(r.surface, r.freq) for r in inventory.attested(rows, limit=1).collect()] == [("n7", 3)]


def test_window_ends_are_rounded_as_sql_does(spark):
    """Odd numbers of documents, repeated and null keys."""
    for n in (1, 2, 3, 5, 6, 50, 51, 53):
        rows = [(i, None if i % 13 == 5 else i * 7 % 10) for i in range(n)]
        con = duckdb.connect()
        con.execute("create table documents (doc_id bigint, n_chars bigint)")
        con.executemany("insert into documents values (?, ?)", rows)
        want = con.execute(QUERIES["sample_window"].sql).fetchall()
        got = sampling.window(spark.createDataFrame(rows, "doc_id long, n_chars long"), "n_chars", 0.25, 0.75)
        assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _ in want), n


def test_degrees_without_rows_of_pairs(spark, monkeypatch):
    """Distinct others of entities in several documents, repeats and tiny unions among them; no row of a pair is made."""
    monkeypatch.setattr(attacks, "UNION", 16)
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"e{min(rng.randrange(60), rng.randrange(60))}", d, 0, 1) for d in range(40) for _ in range(rng.choice([1, 2, 5, 40]))]
    rows = [(("a", "b")[d % 2], e, d, a, b) for _, e, d, a, b in rows]
    frame = attacks.structure(spark.createDataFrame(rows, "side string, entity string, doc_id long, start int, end int"))
    got = {(r.side, r.entity): (r.mentions, r.documents, r.degree) for r in frame.collect()}
    held = {}
    for side, e, d, *_ in rows:
        held.setdefault((side, d), set()).add(e)
    want = {}
    for side, e, *_ in rows:
        mine = [d for (s, d), es in held.items() if s == side and e in es]
        want[side, e] = (sum(x[:2] == (side, e) for x in rows), len(mine), len(set().union(*(held[side, d] for d in mine))) - 1)
    assert got == want
    assert "of_ = other" not in (plan := frame._jdf.queryExecution().optimizedPlan().toString()) and "other#" not in plan


def test_counted_terms_are_written_once_each(spark):
    """What is written holds a term once with its times; the damped arrays come from it."""
    docs = spark.createDataFrame([(1, ["a"] * 5 + ["b"]), (2, [])], "doc_id long, f array<string>")
    held = {r.doc_id: {(x.term, x.times) for x in r.f} for r in linear.counted(docs, ["f"]).collect()}
    times = round(linear.STEPS * (1 + np.log(5)))
    assert held == {1: {("a", times), ("b", linear.STEPS)}, 2: set()}
    assert {r.doc_id: sorted(r.f) for r in linear.damped(docs, ["f"]).collect()} == {1: ["a"] * times + ["b"] * linear.STEPS, 2: []}
    kind = linear.text_counts(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).schema["chars_"].dataType.simpleString()
    assert kind == "array<struct<term:string,times:int>>"
