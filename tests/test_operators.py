"""Invariants of the operators on small frames."""

import bisect
import collections
import hashlib
import hmac
import itertools
import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from maskwright.functions import keys
from maskwright.functions.text import met, tokens, words
from maskwright.operators import attacks, combine, construct, dedup, metrics, sampling, select, stats
from maskwright.sources import readers
from maskwright.streaming import release


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Dr. Weber met Weber in Berlin. F. Weber later left Berlin."), (2, "Weber 12-34 é😀x"), (3, "")], "doc_id long, text string")


def test_offsets_cut_their_tokens(docs):
    for rows, name in ((tokens(docs), "tok"), (words(docs), "word")):
        got = rows.join(docs, "doc_id").selectExpr(f"{name} = substring(text, start + 1, end - start) as same").collect()
        assert got and all(r.same for r in got)


def test_keys_and_techniques(spark):
    keys.register(spark)
    row = spark.range(1).selectExpr("'Dr. F. Weber' as s").selectExpr(*(f"{n('s')} as {k}" for k, n in keys.NORMALISERS.items()), f"{keys.hmac_digest('s', b'k')} as h", f"{keys.hash_index('s')} as i").first()
    assert (row.N0, row.N1, row.N2, row.N3, row.N4) == ("Dr. F. Weber", "dr. f. weber", "f weber", "weber", "weber")
    assert row.h == hmac.new(b"k", b"Dr. F. Weber", "sha256").hexdigest()
    assert row.i == int.from_bytes(hashlib.sha256(b"Dr. F. Weber").digest()[:8], "big") & 0xFFFFFFFF


def test_cursor_not_islands(spark):
    spans = spark.createDataFrame([(1, 0, 10, "a", "PERSON"), (1, 8, 20, "b", "PERSON"), (1, 12, 15, "c", "PERSON")], "doc_id long, start int, end int, text string, type string")
    assert [(r.start, r.kept) for r in construct.resolve_overlaps(spans).orderBy("start").collect()] == [(0, True), (8, False), (12, True)]


def test_cluster_and_cascade(spark):
    rows = [(1, "a", 0, 0, 5, "PERSON"), (1, "b", 0, 4, 9, "PERSON"), (1, "a", 1, 9, 12, "PERSON")]
    spans = spark.createDataFrame(rows, "doc_id long, detector string, ord int, start int, end int, type string")
    assert [r.cluster for r in combine.cluster_single(spans).orderBy("start").collect()] == [1, 1, 2]
    assert len({r.cluster for r in combine.cluster_iou(spans, 0.5).collect()}) == 3
    assert sorted((r.start, r.detector) for r in combine.cascade(spans, ["b", "a"]).collect()) == [(4, "b"), (9, "a")]


def test_stability_and_folds(spark, docs):
    rows = spark.createDataFrame([(1, "P", "e1", "x"), (2, "P", "e1", "y"), (1, "P", "e2", "x")], "doc_id long, type string, entity string, surrogate string")
    r = metrics.stability(rows, True).first()
    assert (r.collision, r.fragmentation, r.drift) == (0.5, 0.0, 1.0)
    assert metrics.stability(rows, False).first().drift is None
    assert {r.fold for r in sampling.folds(docs, 2, 1).collect()} <= {0, 1}


def test_statistics(spark):
    assert spark.createDataFrame([(3, 0), (30, 10), (0, 0)], "b long, c long").select(stats.mcnemar_p("b", "c").alias("p")).first().p == 0.25
    q = stats.benjamini_hochberg(spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, None)], "family string, test int, p double")).orderBy("test").collect()
    assert [r.q for r in q] == [0.02, 0.04, None]


def test_near_pairs(spark):
    a = " ".join(f"w{i}" for i in range(60))
    longer = " ".join(f"v{i}" for i in range(200)) + " " + a
    rows = spark.createDataFrame([(1, a), (2, a + " x"), (3, a), (4, "other words"), (5, longer)], "doc_id long, text string")
    assert sorted((r.a, r.b) for r in dedup.near_pairs(rows).collect()) == [(1, 2), (1, 5), (2, 5)]


def test_sources_and_stream(spark, tmp_path):
    got = readers.parse_sgml('A &amp; <ENAMEX TYPE="PERSON">Weber</ENAMEX> x')
    assert got["text"] == "A & Weber x" and got["spans"] == [{"start": 4, "end": 9, "label": "PERSON", "chain": ""}]
    m = readers.parse_mail(b"From: A <a@x.org>\nTo: B@x.org\nSubject: Hi\n\nhello\n> old\n")
    assert m["body"] == "hello" and m["participants"] == ["a@x.org", "b@x.org"]
    spark.createDataFrame([(1, "Seen Weber there")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    release.start(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().released == "[PERSON] [PERSON] there"


def test_keys_fold_as_unicode_says(spark):
    """N1 to N3 of awkward surfaces against Python's own normalisation and case folding."""
    keys.register(spark)
    surfaces = ["Straße", "STRASSE", "ＦＵＬＬ　Ｗｉｄｔｈ", "ﬁn", "Dr.\u00a0Weber", "ÄÖÜ ß", "ΣΊΣΥΦΟΣ", "e\u0301cole", "m² µ", "Prof.Weber", "Drax", "dr weber", "Sr. O'Neil-Smith", "  a  b ", "", "İstanbul"]
    punctuation, honorific = "[.,;:!?'\"()\\[\\]{}<>«»„“”‘’]", re.compile(rf"^(?:{'|'.join(keys.HONORIFICS)})\b\.?\s*")

    def n2(x):
        return " ".join(honorific.sub("", re.sub(punctuation, "", keys.fold(x))).split())

    rows = spark.createDataFrame([(x,) for x in surfaces], "s string").selectExpr("s", f"{keys.n1('s')} as n1", f"{keys.n2('s')} as n2", f"{keys.n3('s')} as n3").collect()
    for r in rows:
        assert r.n1 == keys.fold(r.s), r
        assert r.n2 == n2(r.s), r
        assert r.n3 == (" ".join(t for t in n2(r.s).split() if len(t) > 1) or n2(r.s)), r


def test_tokens_meet_spans(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("ab é,.  \n漢😀") for _ in range(rng.randint(0, 60)))) for i in range(40)]
    spans = [(i, a, a + rng.randint(0, 9), rng.choice("xyz")) for i in range(0, 40, 2) for a in (rng.randint(0, 50) for _ in range(rng.randint(0, 6)))]
    docs, frame = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(spans, "doc_id long, start int, end int, source string")
    for every in (False, True):
        got = {(r.doc_id, r.ord): sorted((h.start, h.end, h.source) for h in r.hits) for r in met(docs, frame, every).collect()}
        want = {}
        for i, t in texts:
            for n, m in enumerate(re.finditer(r"\w+|[^\w\s]", t)):
                hits = sorted((a, b, x) for j, a, b, x in spans if j == i and m.end() > a and m.start() < b)
                if hits or every:
                    want[i, n] = hits
        assert got == want


def test_checked_surrogates(spark):
    rows = spark.createDataFrame([("PERSON", "Lota", 12), ("PERSON", "Weber", 5), ("CODE", "7", 7), ("CODE", "---", 3), ("CODE", "31.12.1999", 9), ("DATETIME", "may", 1)], "type string, text string, idx long")
    plain = {r.text: r.s for r in rows.selectExpr("text", f"{construct.surrogate()} as s").collect()}
    same = rows.union(spark.createDataFrame([("PERSON", plain["Weber"], 5), ("CODE", plain["7"], 7)], rows.schema))
    got = {r.text: r for r in construct.checked_surrogate(same).collect()}
    assert got[plain["Weber"]].surrogate.lower() != plain["Weber"].lower() and got[plain["Weber"]].attempt > 0
    assert got[plain["7"]].surrogate != plain["7"] and got["---"].surrogate == "---" and got["Weber"].attempt == 0
    day, month, year = got["31.12.1999"].surrogate.split(".")
    pd.Timestamp(int(year), int(month), int(day))
    with pytest.raises(Exception, match="no surrogate passes in 20 draws"):
        construct.checked_surrogate(same, "type <> 'PERSON'", 20).collect()


def _conll(gold, predicted):
    def multi(x):
        by = collections.defaultdict(set)
        for m, c in x.items():
            by[c].add(m)
        return [c for c in by.values() if len(c) > 1]

    g, p = multi(gold), multi(predicted)
    side = lambda a, b: (
        sum(len(c) - len({next((i for i, d in enumerate(b) if m in d), (m,)) for m in c}) for c in a) / sum(len(c) - 1 for c in a) if a else 0.0,
        sum(len(c & d) ** 2 / len(c) for c in a for d in b) / sum(map(len, a)) if a else 0.0,
    )
    gain = [[2 * len(x & y) / (len(x) + len(y)) for y in p] for x in g]
    best = 0.0
    if g and p:
        small, large = (gain, len(p)) if len(g) <= len(p) else ([list(c) for c in zip(*gain)], len(g))
        best = max(sum(small[i][j] for i, j in enumerate(perm)) for perm in itertools.permutations(range(large), len(small)))
    f = lambda r, q: 2 * r * q / (r + q) if r + q else 0.0
    (mr, br), (mp, bp) = side(g, p), side(p, g)
    cr, cp = (best / len(g), best / len(p) if p else 0.0) if g else (0, 0)
    return (f(mr, mp) + f(br, bp) + f(cr, cp)) / 3, mr, mp, br, bp, cr, cp


def test_coreference(spark):
    rng = random.Random(9)
    gold, predicted = {}, {}
    for d in range(25):
        gold[d] = {m: rng.randint(0, 3) for m in range(rng.randint(2, 9))}
        predicted[d] = {m: rng.randint(0, 3) for m in range(rng.randint(0, 9))}
    frame = lambda x: spark.createDataFrame([(d, m, f"c{c}") for d, v in x.items() for m, c in v.items()], "doc_id long, mention long, cluster string")
    got = {r.doc_id: r for r in metrics.coreference(frame(gold), frame(predicted)).collect()}
    scored = {d for d, v in gold.items() if max(collections.Counter(v.values()).values()) > 1}
    assert set(got) == scored
    for d in scored:
        want = _conll(gold[d], predicted[d])
        r = got[d]
        assert (r.conll, r.muc_recall, r.muc_precision, r.b3_recall, r.b3_precision, r.ceaf_recall, r.ceaf_precision) == pytest.approx(want)


def test_assignment():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 5), (5, 3), (5, 5), (1, 6)):
        gain = rng.random((n, m))
        pairs = metrics.assignment(gain)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small = gain if n <= m else gain.T
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_alignment(spark):
    """The two nearest expected counts on either side, with ties, against a plain search over all names."""
    rng = random.Random(2)
    observed = [(f"s{i}", rng.choice([1, 1, 2, 3, 5, 10, 100])) for i in range(40)] + [("close", 100)]
    prior = [("a", 0.90), ("b", 0.89), ("c", 0.01)] + [(f"n{i}", rng.choice([0.001, 0.002, 0.01])) for i in range(30)]
    got = {r.surface: (r.guess, r.abstains) for r in attacks.align(spark.createDataFrame(observed, "surface string, n long"), spark.createDataFrame(prior, "name string, weight double"), 1.0).collect()}
    total = sum(n for _, n in observed)
    expected = sorted((w * total, name) for name, w in prior)
    e = [x for x, _ in expected]
    for surface, n in observed:
        scores = sorted(((-abs(math.log(n + 1) - math.log(x + 1)), i) for i, x in enumerate(e)), reverse=True)
        sd = float(np.std([s for s, _ in scores]))
        assert got[surface] == (expected[scores[0][1]][1], (scores[0][0] - scores[1][0]) / sd < 1.0), surface


def test_linkage(spark):
    """Profiles, features and ranks against dense matrices."""
    rng = random.Random(6)
    names, terms = [f"Name{i}" for i in range(14)], [f"term{chr(97 + i)}x" for i in range(20)]
    docs, mentions = [], []
    for d in range(60):
        text = ""
        for _ in range(rng.randint(1, 6)):
            name = rng.choice(names)
            text += " ".join(rng.choices(terms, k=2)) + " "
            mentions.append(("gallery" if d % 2 else "query", name, d, len(text), len(text) + len(name)))
            text += name + " "
        docs.append((d, text))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    seen = attacks.profiles(frame, spark.createDataFrame(mentions, "side string, entity string, doc_id long, start int, end int"), 30)
    top = 12
    features = attacks.featurise(seen, attacks.vocabulary(seen, top), top)
    bags, counts, texts = collections.defaultdict(collections.Counter), {}, dict(docs)
    for side, entity, d, a, b in mentions:
        near = texts[d][max(0, a - 30) : a] + " " + texts[d][b : b + 30]
        bags[side, entity].update(w.lower() for w in re.findall(r"[A-Za-z][A-Za-z'\\-]{2,}", near) if w.lower() not in attacks.STOP)
    per = collections.defaultdict(collections.Counter)
    for side, entity, d, *_ in mentions:
        per[side, d][entity] += 1
    for side, entity in bags:
        mine = [d for (s, d), c in per.items() if s == side and entity in c]
        others = collections.Counter()
        for d in mine:
            for o in per[side, d]:
                if o != entity:
                    others[o] += per[side, d][entity]
        counts[side, entity] = (sum(per[side, d][entity] for d in mine), len(mine), len(others), sum(others.values()))
    total = collections.Counter()
    for b in bags.values():
        total.update(b)
    vocabulary = [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]]
    rows = {k: np.array([math.log1p(bags[k][t]) for t in vocabulary] + [math.log1p(x) for x in counts[k]]) for k in bags}
    rows = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    got = {(r.side, r.entity): dict(zip(r.cols, r.ws)) for r in features.collect()}
    assert set(got) == set(rows)
    for k, v in rows.items():
        assert {c: pytest.approx(w) for c, w in enumerate(v) if w} == got[k]
    ranks = {r.query: r.rank for r in attacks.rank(features).collect()}
    gallery = sorted(e for s, e in rows if s == "gallery")
    for s, e in rows:
        if s == "query" and e in gallery:
            sims = sorted((-round(float(rows[s, e] @ rows["gallery", g]), 9), g) for g in gallery)
            assert ranks[e] == [g for _, g in sims].index(e) + 1
    assert len(ranks) == len({e for s, e in rows if s == "query"} & set(gallery))


def test_token_vote_and_decoding(spark):
    docs = spark.createDataFrame([(1, "Anna Lee met Bo in Rome"), (2, "x y")], "doc_id long, text string")
    spans = [(1, "a", 0, 8, "PER"), (1, "b", 0, 8, "PER"), (1, "c", 5, 8, "ORG"), (1, "a", 13, 15, "PER"), (1, "b", 19, 23, "LOC"), (1, "c", 19, 23, "LOC")]
    frame = spark.createDataFrame(spans, "doc_id long, detector string, start int, end int, type string")
    voted = combine.token_vote(frame, docs)
    assert sorted((r.ord, r.label, r.n) for r in voted.collect()) == [(0, "B-PER", 2), (1, "I-PER", 2), (5, "B-LOC", 2)]
    assert sorted((r.start, r.end, r.type) for r in combine.decode_bio(voted).collect()) == [(0, 8, "PER"), (19, 23, "LOC")]
    stray = spark.createDataFrame([(1, 0, 0, 2, "I-A"), (1, 1, 3, 4, "I-B"), (1, 2, 5, 6, "I-B"), (1, 4, 9, 10, "I-B"), (1, 5, 11, 12, "B-B"), (1, 6, 13, 14, "O")], "doc_id long, ord int, start int, end int, label string")
    assert sorted((r.start, r.end, r.type) for r in combine.decode_bio(stray).collect()) == [(0, 2, "A"), (3, 6, "B"), (9, 10, "B"), (11, 12, "B")]
    chosen = frame.where("detector = 'a'").select("doc_id", "type", "start", "end")
    assert sorted((r.start, r.voters) for r in combine.voters(chosen, frame).collect()) == [(0, ["a", "b"]), (13, ["a"])]
    assert {r.pool: r.documents for r in combine.pool_sizes(frame, docs).collect()} == {3: 1, 0: 1}


def test_iou_clusters_and_cascade(spark):
    """Both folds against plain loops on random spans."""
    rng = random.Random(7)
    spans = sorted({(d, rng.choice("abc"), a, a + rng.randint(1, 12), rng.choice("PQ")) for d in range(12) for a in (rng.randint(0, 30) for _ in range(9))})
    frame = spark.createDataFrame(spans, "doc_id long, detector string, start int, end int, type string")
    iou = lambda x, y: max(0, min(x[1], y[1]) - max(x[0], y[0])) / (max(x[1], y[1]) - min(x[0], y[0]))
    want, kept = {}, set()
    for key in {(s[0], s[4]) for s in spans}:
        mine = sorted((s[2], s[3], s[1]) for s in spans if (s[0], s[4]) == key)
        n, held = 0, []
        for s in mine:
            if any(iou(s, h) >= 0.5 for h in held):
                held.append(s)
            else:
                n, held = n + 1, [s]
            want[(*key, *s)] = n
        taken = []
        for s in sorted(mine, key=lambda s: ("cab".index(s[2]), s[0], s[1])):
            if not any(s[0] < h[1] and h[0] < s[1] for h in taken):
                taken.append(s)
        kept |= {(*key, *s) for s in taken}
    assert {(r.doc_id, r.type, r.start, r.end, r.detector): r.cluster for r in combine.cluster_iou(frame).collect()} == want
    assert {(r.doc_id, r.type, r.start, r.end, r.detector) for r in combine.cascade(frame, ["c", "a", "b"]).collect()} == kept


def test_ranked_sums_and_draws(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i * 7 % 501, rng.randint(0, 5)) for i in range(500)]
    got = {(r.g, r.k): r.before_ for r in construct.ranked_sums(spark.createDataFrame(rows, "g string, k long, n long"), "k", "n", "g").collect()}
    assert got == {(g, k): sum(n for h, j, n in rows if h == g and j < k) for g, k, _ in rows}
    scopes = spark.createDataFrame([(f"s{i % 300}",) for i in range(900)], "scope string")
    idx = {r.scope: r.idx for r in construct.drawn(scopes, 7).collect()}
    order = sorted(idx, key=lambda s: (hashlib.sha256(f"7|{s}".encode()).hexdigest(), s))
    assert [idx[s] for s in order] == list(range(300))
    units = spark.createDataFrame([(i, f"m{i % 4}", 1 + i % 3) for i in range(80)], "unit long, mailbox string, size long")
    taken = dedup.draw(units, 40, 9, 3).collect()
    assert sum(r["size"] for r in taken) <= 40 and max(collections.Counter(r.mailbox for r in taken).values()) <= 9 and len(taken) > 10
    assert sampling.sample(units.withColumnRenamed("unit", "doc_id"), "document", 0.25, 2).selectExpr("count(1)", "min(provenance)").first() == (20, "document:0.25:2")


def test_plan_of_sources():
    plan = select.plan(["b", "a", "c"], required=("a",), extras=("vote2:a+b+c", "union:b+c"))
    labels = [x[0] for x in plan]
    assert labels[:3] == ["single:a", "union:a+b", "intersection:a+b"] and labels[-1] == "union:b+c" and labels.count("vote2:a+b+c") == 1
    assert select.parse_label("vote3:x+y")[2] == ("x", "y")
    with pytest.raises(ValueError):
        select.parse_label("most:a")


def test_aes_siv_vector(spark):
    """RFC 5297, A.1: the synthetic vector begins 85632d07 c6e8f37f."""
    key = bytes.fromhex("fffefdfcfbfaf9f8f7f6f5f4f3f2f1f0f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff")
    text = keys.siv_index("pt", "ad", key).replace("hex(encode(pt, 'utf-8'))", "pt").replace("hex(encode(ad, 'utf-8'))", "ad")
    row = spark.sql("select '112233445566778899AABBCCDDEE' as pt, '101112131415161718191A1B1C1D1E1F2021222324252627' as ad").selectExpr(f"{text} as x")
    assert row.first().x == 0xC6E8F37F
