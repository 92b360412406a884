"""Every operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from maskwright.llm import chat, embed, langid, lm, mix, pack, quality, simhash, substring, tokenbin
from maskwright.llm._elias import EliasFano
from maskwright.llm._tokens import WordEncoder, default_tokenizer

WORD = r"[^\x20\x09-\x0d]+"
LONG = " ".join(f"w{i % 977}" for i in range(6000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
TEXTS = [
    (1, "The cat sat on the mat. " * 8), (2, "The cat sat on the mat. " * 8), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two"), (8, LONG), (9, LONG + " tail"),
    (10, "alpha beta " + PASSAGE + " gamma"), (11, PASSAGE + " delta"), (12, "ÀÉ ß 漢字 I'LL don't <|endoftext|> x"), (13, "a a a a " * 30), (14, "line\nline\nother & <b>|</b>\n"), (None, "no id here " + PASSAGE), (14, "line\nline\nother & <b>|</b>\n"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", "clash", 1) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, fp string, n_words int")


def words(text):
    return re.findall(WORD, text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_simhash(spark, docs):
    def fp(t):
        w = [x.encode() for x in words(low(t))]
        runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.simhash_dedup(spark, docs).collect()
    assert len(got) == len(TEXTS)
    prints = [fp(t) for _, t in TEXTS]
    near = lambda a, b: bin(a ^ b).count("1") <= 2
    root = {f: f for f in prints}
    for _ in prints:
        for a in root:
            root[a] = min(root[b] for b in root if near(a, b))
    least = collections.defaultdict(list)
    for (i, _), f in zip(TEXTS, prints, strict=True):
        least[root[f]].append(i)
    want = collections.Counter((i, f"{f:016x}", min(x for x in least[root[f]] if x is not None) if any(least[root[f]]) else None) for (i, _), f in zip(TEXTS, prints, strict=True))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("crowd", [64, 2])
def test_simhash_links(spark, crowd):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 3)
    prints = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 60, (25, 2))} | set(base.tolist()))
    edges = simhash.links(spark, spark.createDataFrame([(p,) for p in prints], "fp long"), crowd=crowd).collect()
    linked = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    assert all(linked(e.a, e.b) for e in edges)

    def groups(pairs):
        at = {p: p for p in prints}
        for _ in prints:
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert groups([(e.a, e.b) for e in edges]) == groups([(a, b) for a in prints for b in prints if linked(a, b)])


def test_substring(spark, docs):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(spark, docs).collect())
    first, want = {}, collections.Counter()
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    for i, t in order:
        w = words(t)
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    for i, t in order:
        w = words(t)
        gone = {q for p in range(len(w) - 19) if first[tuple(w[p : p + 20])] != (i, p) for q in range(p, p + 20)}
        kept = [x for q, x in enumerate(w) if q not in gone]
        want[i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()] += 1
    assert got == want
    texts = {r.doc_id: r.text for r in substring.substring_dedup(spark, docs, with_text=True).collect()}
    assert texts[11].split() != PASSAGE.split() + ["delta"] and texts[14] == TEXTS[13][1]


def test_pack_and_files(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(default_tokenizer())
    ids = [(i, whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in TEXTS]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    rows = pack.best_fit_pack(spark, docs).collect()
    want = collections.Counter((i, p, p * 4096, len(x[p * 4096 : (p + 1) * 4096]), crc(x[p * 4096 : (p + 1) * 4096])) for i, x in ids for p in range(-(-len(x) // 4096)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    read = sorted(tokenbin.read_token_files(spark, tokenbin.write_token_files(spark, docs)).collect(), key=lambda r: r.start)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in read) == collections.Counter((i, len(x), crc(x)) for i, x in ids)
    assert [r.doc_id for r in read] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in read] == [0, *np.cumsum([r.n_tokens for r in read])[:-1].tolist()]


def test_word_encoder_equals_whole_texts():
    import random

    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(default_tokenizer()), random.Random(5)
    texts = ["".join(rng.choice("aZé'ßsStldmrev.,!<|>_0９ \n\t\x1c ́ŒΣİ²-×") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    ids, bounds = WordEncoder(default_tokenizer()).encode(pa.array(texts), None)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 31])
def test_bit_packing(tmp_path, width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1000).astype(np.uint32)
    assert (tokenbin.unpack_bits(tokenbin.pack_bits(ids, width), 1000, width) == ids).all()
    with open(tmp_path / "x", "wb") as f:
        w = tokenbin.Writer(f, width, block=64)
        w.add(pa.array([5, None]), ids[:300], np.array([0, 100, 300]))
        w.add(pa.array([9]), ids[300:], np.array([0, 700]))
        w.close()
    r = tokenbin.Reader(f"file://{tmp_path}/x")
    assert r.doc_id.to_pylist() == [5, None, 9]
    assert [r.doc(i).tolist() for i in range(3)] == [ids[:100].tolist(), ids[100:300].tolist(), ids[300:].tolist()]


def test_plan_fills_sequences():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 101), 60, replace=False), rng.integers(1, 50, 60), strict=True)}
    held, count = collections.defaultdict(list), collections.Counter()
    for length, rank, bins, each, sequence, offset in pack.plan(histogram, 100):
        assert rank == count[length]
        count[length] += bins * each
        for k in range(bins * each):
            held[sequence + k // each].append((offset + k % each * length, length))
    assert count == collections.Counter(histogram)
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 100


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, None), (14, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(spark, docs, labels, bits=10).collect()
    want = []
    for i, t in TEXTS:
        w, c = words(t), collections.Counter()
        runs = list(zip(w, w[1:], w[2:], strict=False))
        c.update(runs)
        twice = {q for p, r in enumerate(runs) if c[r] > 1 for q in (p, p + 1, p + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(twice), failed))
    assert collections.Counter(tuple(r)[:7] for r in rows) == collections.Counter(want)
    # the ratio itself
    from maskwright.llm.quality import SCALE

    hash64 = {}
    pairs = sorted({(a, b) for _, t in TEXTS for w in [words(t)] for a, b in zip(w, [*w[1:], None], strict=False)}, key=str)
    for r in spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "xxhash64(a) & 1023 as u", "xxhash64(a, b) & 1023 as v").collect():
        hash64[r.a, r.b] = r.u, r.v if r.b is not None else None
    kinds = [[[g for a, b in zip(w, [*w[1:], None], strict=False) if (g := hash64[a, b][k]) is not None] for w in (words(t) for _, t in TEXTS)] for k in (0, 1)]
    means = []
    for k, prior in enumerate(quality.PRIOR):
        c, good = collections.Counter(g for x in kinds[k] for g in x), collections.Counter(g for (i, _), x in zip(TEXTS, kinds[k], strict=True) if i in (1, 8) for g in x)
        share = sum(good.values()) / sum(c.values())
        means.append([sum(round(SCALE * math.log((good[g] + prior) / (c[g] * share + prior))) for g in x) / max(len(x), 1) / SCALE for x in kinds[k]])
    scores = {i: u + quality.PAIRS * v for (i, _), u, v in zip(TEXTS, *means, strict=True)}
    for r in rows:
        assert (r.llr is None) == (r.n_words == 0)
        if r.llr is not None:
            assert abs(r.llr - scores[r.doc_id]) < 1e-5
            assert r.kept == (not r.base_failed and r.llr >= r.threshold)


def test_quality_rejects_toxic(spark):
    rng = np.random.default_rng(3)
    say = lambda i, bad: " ".join("vile" if bad and k % 20 == 0 else f"w{rng.integers(0, 40)}" for k in range(120))
    rows = [(i, say(i, i % 3 == 0)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert sum(not got[i] for i in got if i % 3 == 0) >= 95
    assert sum(got[i] for i in got if i % 3) >= 190


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, universe in ((1, 1), (1, 5), (1000, 1 << 44), (1000, 1000), (3000, 70000), (300, 1 << 63)):
        v = np.sort(rng.integers(0, universe, n, dtype=np.uint64))
        e = EliasFano.build(v, universe)
        assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, universe, 300, dtype=np.uint64)])
        assert (e.successor(q) == np.searchsorted(v, q)).all()
        assert ((e.find(q) >= 0) == np.isin(q, v)).all()


@pytest.mark.parametrize("hot", [1 << 20, 12])
def test_lm(spark, docs, monkeypatch, hot):
    for name, value in (("SHARD", 300), ("SHARD_BYTES", 5000), ("FLUSH", 700), ("HOT", hot), ("MAPPED", 1), ("PIECE", 100), ("SCORED_BYTES", 4000)):
        monkeypatch.setattr(lm, name, value)
    rows = lm.lm_score(spark, docs).collect()
    toks = [(i, words(low(t)) + [None]) for i, t in TEXTS]
    learn = [w for i, w in toks if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(x for w in learn for x in w)
    n, v = sum(c.values()), len(c)
    base = lambda x: math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1)))
    want = collections.Counter((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(map(base, w)), 4)) for i, w in toks)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    # the trie's smoothed n-grams, from plain counts
    grams = collections.Counter()
    for w in learn:
        s = ["<s>", *w]
        for k in range(1, len(s)):
            grams[(s[k - 1],), s[k]] += 1
            if k > 1:
                grams[(s[k - 2], s[k - 1]), s[k]] += 1
    total, kinds = collections.Counter(), collections.Counter()
    for (h, _), m in grams.items():
        total[h] += m
        kinds[h] += 1

    def mixed(h, x, lower):
        return lower if h not in total else max(grams[h, x] - 0.5, 0) / total[h] + 0.5 * kinds[h] / total[h] * lower

    for (i, w), r in zip(sorted(toks, key=lambda x: (x[0] is not None, x[0] or 0)), sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        score, s = 0.0, ["<s>", *w]
        for k in range(1, len(s)):
            p = mixed((s[k - 1],), s[k], 10 ** base(s[k]))
            score += math.log10(mixed((s[k - 2], s[k - 1]), s[k], p) if k > 1 else p)
        assert abs(score - r.score) <= 0.021 * len(w) + 1e-6, (i, score, r.score)


def test_lm_keeps_rare_grams(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 10]
    common = " ".join(f"f{i % 7}" for i in range(50_000))
    rows = [(i, common) for i in ids[:8]] + [(ids[8], "zeta omega psi")]
    got = {r.doc_id: r for r in lm.lm_score(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, v = 8 * 50_001 + 4, 11
    one = lambda c: (c + 0.1) / (n + 0.1 * (v + 1))
    half = lambda p: 0.5 + 0.5 * p  # each was seen once after a context seen once
    first = 0.5 / 9 + 0.5 * 2 / 9 * one(1)
    want = math.log10(first) + math.log10(half(half(one(1)))) * 2 + math.log10(half(half(one(9))))
    assert abs(got[ids[8]].score - want) <= 0.08, (got[ids[8]].score, want)


def test_gru_gradient():
    p = langid.init(3, hidden=4, kind=np.float64)
    rng = np.random.default_rng(0)
    seq, truth = rng.integers(97, 122, (5, 6)), rng.integers(0, 3, 5)
    _, grad = langid.loss_and_gradient(p, seq, truth)
    for k in p:
        flat = p[k].reshape(-1)
        for j in rng.choice(np.flatnonzero(grad[k].reshape(-1)), 3):
            old = flat[j]
            flat[j] = old + 1e-5
            up, _ = langid.loss_and_gradient(p, seq, truth)
            flat[j] = old - 1e-5
            down, _ = langid.loss_and_gradient(p, seq, truth)
            flat[j] = old
            assert abs((up - down) / 2e-5 - grad[k].reshape(-1)[j]) < 1e-6


def test_language_id(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 120)
    rng = np.random.default_rng(4)
    speak = lambda syllables: " ".join("".join(rng.choice(syllables, 3)) for _ in range(40))
    rows = [(i, speak(["the", "ing", "er"]) if i % 2 else speak(["ção", "ñu", "lla"]), "en" if i % 2 else "es", "s") for i in range(60)]
    rows += [(100, None, "en", "s"), (101, "123 ...", "en", "s"), (None, speak(["the", "ing"]), None, "s"), (102, "", None, "s")]
    got = {r.doc_id: r for r in langid.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "es") for i in range(60))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[None].lang_pred == "en"
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(60)) and not got[None].held_out


def test_labels_of_every_byte():
    """Pieces with their surroundings against one pass over each whole text; white space counts."""
    rng = np.random.default_rng(8)
    p = langid.init(3, hidden=5, seed=3)
    for k in p:
        p[k] = p[k] * 0.5  # states forget within AROUND bytes
    texts = ["", "a b\n", "é漢 " * 200, "".join(rng.choice(list("abc \t"), 700)), None]
    got = langid.Labeller(p).texts(pa.array(texts).fill_null(""))
    for t, sums in zip(texts, got, strict=True):
        codes = np.frombuffer((t or "").encode(), np.uint8)
        padded = np.concatenate([np.full(16, 32, np.uint8), codes, np.full(16, 32, np.uint8)])
        prob = langid._softmax(langid._states(p, padded[:, None]) @ p["w"] + p["b"])[16 : 16 + len(codes), 0]
        assert np.allclose(sums, prob.sum(axis=0), atol=2e-2 * max(1, len(codes) / 100)) and np.isclose(sums.sum(), len(codes), rtol=1e-3)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify_language(spark, docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right, n = got.selectExpr("count_if(lang = lang_pred)", "count(1)").first()
    assert n > 150 and right >= 0.98 * n, (right, n)


def test_language_threshold_comes_from_all_held_out(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "".join(rng.choice(list("abcdeé ñ"), 3 + i % 40)), "ab"[i % 2]) for i in range(6000)] + [(-1, None, "a"), (-2, "12 34", "b"), (-3, "abc", None), (None, "abc", "a")]
    rows += rows[:500]
    p, names = langid.init(3, hidden=5, seed=3), ["a", "b"]
    held = [(t, lang) for i, t, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 and lang and re.search(r"[^\W\d_]", t or "")]
    sums = langid.Labeller(p).texts(pa.array([t for t, _ in held]))
    prob = sums / sums.sum(axis=1, keepdims=True)
    best = prob[:, :2].argmax(axis=1)
    want = sorted(prob[k, b] for k, (b, (_, lang)) in enumerate(zip(best, held, strict=True)) if names[b] == lang)
    assert len(want) > 600  # more than a bounded number for each language would be
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for share in (0.0, langid.REJECTED, 0.01, 0.3):
        assert langid.least_score(docs, names, p, share) == pytest.approx(want[int(share * len(want))], abs=1e-6)


def test_value_at_a_rank(spark):
    rng = np.random.default_rng(2)
    for values in ([0.5], [0.25] * 7, [0.0, 1e-300, 2e-300, 1.0], [*rng.random(300), *rng.choice([0.2, 0.9], 100), 0.2 + 2e-17, 0.9 - 1e-16]):
        scores = spark.createDataFrame([(float(v),) for v in values], "score double")
        for rank in {0, 1, len(values) // 3, len(values) // 2, len(values) - 1}:
            if rank < len(values):
                assert langid.at_rank(scores, rank) == sorted(values)[rank]


def test_language_column_of_another_type(spark):
    rows = [(i, ("the king and " if i % 2 else "çã ñu ") * 30, i % 2) for i in range(40)]
    got = langid.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang int")).collect()
    assert {r.lang_pred for r in got} == {"0", "1"}
    none = langid.accepted(spark.createDataFrame([(1, "ab", None), (2, "12", None)], "doc_id long, text string, lang string"))
    assert [r.doc_id for r in none.collect()] == [1]


def test_chat(spark):
    turns = [(1, 0, "user", "a<b>\\ </turn>"), (1, 1, "assistant", "<turn:user>x</turn>\n"), (2, None, None, None), (2, 0, "assistant", "é漢"), (None, 0, "as>s", "t"), (3, 0, "assistant", "")]
    chats = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.digest_chat(chats).collect()}
    assert len(got) == 4
    for conv in (1, 2, 3, None):
        mine = [(r or "", t or "") for c, _, r, t in turns if c == conv]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mix(spark, docs):
    assert mix.share_out(10, [1, 1, 2], [1, 100, 100]) == [1, 3, 6]
    assert mix.budgets({("a", "x", "1"): 10, ("a", "x", "2"): 100, ("b", "y", "3"): 100}, {("a",): 1, ("b",): 1}, 100, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 40, ("b", "y", "3"): 50}
    rows = mix.mix_sources(spark, docs, share=0.7, epochs=2, buckets=4).collect()
    total = sum(len(words(t)) for _, t in TEXTS)
    leaf = collections.Counter()
    for i, t in TEXTS:
        s = f"s{(i or 0) % 3}"
        leaf[f"domain{zlib.crc32(s.encode()) % 4}", "xx" if (i or 0) % 2 else mix.NULL, s] += len(words(t))
    want = mix.budgets(leaf, mix.WEIGHTS, int(0.7 * total), 2)
    took = collections.Counter()
    for r in rows:
        took[r.domain, r.lang, r.source] += r.take_tokens
        assert 0 <= r.take_tokens <= r.n_tokens
    assert {k: v for k, v in took.items() if v} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("leaves, epochs", [(50_000, 3), (0, 3), (50_000, 1)])
def test_mix_takes_seeded_prefixes(spark, monkeypatch, leaves, epochs):
    """Which documents each leaf takes, in which epoch: the prefix by hash, another order in every epoch; the last one in part."""
    monkeypatch.setattr(mix, "BROADCAST_LEAVES", leaves)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(i * 7 % 11)), "ab"[i % 2], f"s{i % 3}") for i in range(90)] + [(None, "no id", "a", "s0"), (3, "same id other text", "b", "s0"), (5, "x y", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {("d", "a"): 9, ("d", "b"): 1}
    got = mix.mix_sources(spark, docs, domain="'d'", weights=weights, share=0.8, epochs=epochs, buckets=8).collect()
    at = spark.createDataFrame([(e,) for e in range(epochs + 1)], "e long").crossJoin(docs.selectExpr("*", "xxhash64(coalesce(text, '')) as mark")).selectExpr("*", f"xxhash64({mix.SEED}, e, doc_id, mark) as at").collect()
    tokens = collections.Counter()
    for _, t, lang, source in rows:
        tokens["d", lang or mix.NULL, source or mix.NULL] += len(words(t))
    parts = mix.budgets(tokens, weights, int(0.8 * sum(tokens.values())), epochs)
    want = collections.Counter()
    for leaf, n in tokens.items():
        full, rest = divmod(parts.get(leaf, 0), n) if n else (0, 0)
        mine = [r for r in at if ("d", r.lang or mix.NULL, r.source or mix.NULL) == leaf]
        for r in mine:
            if r.e < full:
                want[r.doc_id, r.mark, r.e, len(words(r.text))] += 1
        for r in sorted((r for r in mine if r.e == full), key=lambda r: (r["at"], r.doc_id is not None, r.doc_id or 0, r.mark)):
            if rest <= 0:
                break
            take = min(len(words(r.text)), rest)
            want[r.doc_id, r.mark, full, take] += 1
            rest -= take
    assert collections.Counter((r.doc_id, r.mark, r.epoch, r.take_tokens) for r in got) == want
    orders = [[(r.doc_id, r.mark) for r in sorted((r for r in at if r.e == e), key=lambda r: r["at"])] for e in (0, 1)]
    assert orders[0] != orders[1]


def test_recursion_skips_clusters():
    """Leaves of far clusters are skipped, and no link is lost; of evenly spread vectors next to nothing is."""
    rng = np.random.default_rng(12)
    centres = embed.unit(rng.normal(size=(12, 64)))
    for spread, least in ((0.02, 0.75), (None, 0.0)):
        v = embed.unit(np.concatenate([centres[rng.integers(0, 12, 1500)] + rng.normal(0, spread, (1500, 64)) if spread else rng.normal(size=(1500, 64))]))
        axes = embed.fit_axes([(1, 64, x) for x in v.tolist()])
        z = embed.rotated(v, axes, 1)
        order = np.lexsort(np.floor(z[:, : embed.GRID] / 0.374).T[::-1])
        v, z = v[order], z[order]
        n = -(-len(v) // embed.LEAF)
        leaves = embed.near_leaves(z, z, math.sqrt(0.14), True)
        assert 1 - len(leaves) / (n * (n + 1) / 2) >= least
        rows, cols = embed.linked(v, v, z, z, 0.93, True)
        near = v @ v.T >= 0.93
        np.fill_diagonal(near, False)
        assert sorted(zip(rows.tolist(), cols.tolist(), strict=True)) == list(map(tuple, np.argwhere(near).tolist()))
        rows, cols = embed.linked(v[:700], v[700:], z[:700], z[700:], 0.93, False)
        assert sorted(zip(rows.tolist(), cols.tolist(), strict=True)) == list(map(tuple, np.argwhere(v[:700] @ v[700:].T >= 0.93).tolist()))


@pytest.mark.parametrize("block", [8, 1024])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.12, 16)).tolist(), i % 2) for i in range(80)]
    rows += [(200, [0.0] * 16, 1), (201, None, 1), (202, [1.0] * 16, None), (203, [math.nan] * 16, 1), (204, [1.0] * 16, 1), (205, [1.0] * 16, 1), (205, [1.0] * 16, 1), (206, [1.0] * 3, 1), (207, [], 0), (208, [None] + [1.0] * 15, 0)]
    got = embed.embedding_dedup(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    ok = [k for k, (_, e, lab) in enumerate(rows) if lab is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[k][1], np.float32).astype(float)) for k in ok}
    link = {(a, b) for a in ok for b in ok if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93}
    at = {k: rows[k][0] for k in range(len(rows))}
    for _ in rows:
        for a, b in link:
            at[a] = at[b] = min(at[a], at[b])
    want = collections.Counter((rows[k][0], sum(a == k for a, _ in link), at[k], rows[k][0] == at[k]) for k in range(len(rows)))
    assert collections.Counter(map(tuple, got)) == want


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        simhash.simhash_dedup(spark, none), substring.substring_dedup(spark, none), pack.best_fit_pack(spark, none), quality.quality_rules(spark, none, labels), lm.lm_score(spark, none), langid.identify_language(spark, none),
        mix.mix_sources(spark, none), tokenbin.read_token_files(spark, tokenbin.write_token_files(spark, none)), embed.embedding_dedup(spark, spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert out.count() == 0


def test_other_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = Tokenizer.from_file(path), ["Two  Words\n", "", "İ <|endoftext|> x", None]
    ids, bounds = WordEncoder(path).encode(pa.array(texts), 7)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [whole.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def test_substring_tells_texts_of_one_id_apart(spark):
    """Texts under one id whose 64-bit hashes agree in their low 15 bits, one long, one short; and columns named like internal ones."""
    stem = " ".join(f"q{i}" for i in range(30))
    texts = spark.range(40_000).selectExpr(f"concat('{stem} v', id, if(id % 2 = 0, ' {' '.join(f'z{i}' for i in range(40))}', '')) as text")
    same = texts.selectExpr("text", "pmod(xxhash64(text), 32768) as m", "size(split(text, ' ')) as n").groupBy("m").agg({"n": "min", "text": "collect_list", "*": "count"})
    pair = next(sorted(r[0], key=len) for r in same.selectExpr("`collect_list(text)`", "`min(n)`").where("`min(n)` < 40").toLocalIterator() if len({len(t) > 200 for t in r[0]}) == 2)
    rows = [(7, pair[0], 1, "a"), (7, pair[-1], 2, "b"), (8, pair[-1], 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __mark int, __text string")
    got = substring.substring_dedup(spark, docs, with_text=True).collect()
    assert {(r["__mark"], r["__text"]) for r in got} == {(1, "a"), (2, "b"), (3, "c")}
    left = {r["__mark"]: r.n_words - r.n_removed for r in got}
    assert left[3] == 0 and sorted(left[k] for k in (1, 2))[0] in (1, 41) and len(got) == 3


def test_substring_deals_hot_keys(spark, docs, monkeypatch):
    monkeypatch.setattr(substring, "HOT_LEAST", 1)
    monkeypatch.setattr(substring, "HOT_SHARE", 50)
    test_substring(spark, docs)


def test_graph_follows_long_paths(spark):
    from maskwright.llm._graph import connected_components

    edges = spark.range(1, 400).selectExpr("id * 7919 % 400 as a", "(id + 1) * 7919 % 400 as b")
    assert {r.root for r in connected_components(spark, edges).collect()} == {0}


def test_chat_spans_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN_BYTES", 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        turns = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} <&") for c in (1, 2, 3, None) for t in range({1: 8, 2: 1, 3: 5}.get(c, 7))]
        chats = chat.format_chat(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1))
        got = {r.conv_id: chat.parse(r.formatted) for r in chats.collect()}
        assert got == {c: [(r, x) for d, _, r, x in turns if d == c] for c in (1, 2, 3, None)}
        assert chat.format_chat(chats.selectExpr("conv_id", "1L as turn", "formatted as role", "formatted as text").limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
