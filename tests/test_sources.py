"""Readers of mail, layers, name lists and corpora against small files."""

import io
import itertools
import json
import tarfile
import zipfile

import pytest

from maskwright.operators import inventory
from maskwright.sources import corpus, fill, layers, letters, pools

MAIL = {
    "bo/inbox/1": b"From: ann.lee@x.org\nX-From: Lee, Ann M. <ann.lee@x.org>\nTo: bo@y.org\nX-To: Bo Cook </O=X/OU=Y/CN=Z>\nSubject: Hi\n\nDear Bo Cook,\nAnn here; write to Zoe@z.org.\n\n-----Original Message-----\nFrom: x\nold",
    "bo/sent/2": b"From: ann.lee@x.org\nX-From: Lee, Ann M.\nTo: cy@z.org\nSubject: Re: Hi\n\nNote text\n\nMax Muster\n01/02/2001 10:11 AM\nTo: a\ncc: b\nSubject: c\n\nquoted",
    "cy/inbox/3": b"From: info@z.org\nX-From: info\nTo: ann.lee@x.org\nSubject: Memo\nContent-Transfer-Encoding: quoted-printable\n\nFrom: a\nTo: b\nSubject: c\n\nbody w=F6rd talking=\n on, says Ann Lee to Will.\n> quoted",
    "cy/inbox/4": b"From: bo@y.org\nX-From: Bo Cook\nTo: cy@z.org\n\n",
    "cy/inbox/5": b"From: bo@y.org\nX-From: Bo Cook\nTo: cy@z.org\n\nBo again, with Lee, Ann",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("mail")
    for name, raw in MAIL.items():
        (root / "maildir" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "maildir" / name).write_bytes(raw)
    with tarfile.open(root / "mail.tar.gz", "w:gz") as tar:
        for name, raw in MAIL.items():
            info = tarfile.TarInfo(f"maildir/{name}")
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    return root


def test_mail(spark, tree):
    rows = {r.doc_id[-1]: r for r in letters.messages(spark, str(tree / "maildir")).collect()}
    assert rows["1"].mailbox == "bo" and rows["3"].mailbox == "cy" and len(rows) == 5
    assert rows["1"].body == "Dear Bo Cook,\nAnn here; write to Zoe@z.org." and rows["1"].text.startswith("From: Lee, Ann M. <ann.lee@x.org>, ann.lee@x.org\nTo: Bo Cook, bo@y.org\nSubject: Hi\n\nDear")
    assert rows["2"].body == "Note text" and rows["4"].body == "" and rows["3"].body == "body wörd talking on, says Ann Lee to Will."
    assert rows["1"].participants == ["ann.lee@x.org", "bo@y.org"]
    packed = letters.messages(spark, str(tree / "mail.tar.gz"), mailboxes=["cy"], require_body=True).collect()
    assert sorted(r.doc_id[-1] for r in packed) == ["3", "5"]
    assert sorted(r.doc_id[-1] for r in letters.messages(spark, str(tree / "maildir"), stride=2, limit=2).collect()) == ["1", "3"]


def test_identities_and_mentions(spark, tree):
    mail = letters.messages(spark, str(tree / "maildir"))
    table = letters.identities(mail)
    assert {r.name: (r.address, r.n) for r in table.collect()} == {"lee, ann m.": ("ann.lee@x.org", 2), "info": ("info@z.org", 1), "bo cook": ("bo@y.org", 2)}
    got = {}
    for r in letters.mentions(mail, table).collect():
        got.setdefault(r.doc_id[-1], set()).add((r.text, r.type, r.rule, r.entity))
    assert ("Bo Cook", "PERSON", "p", "bo@y.org") in got["1"] and ("Zoe@z.org", "CODE", "a", "zoe@z.org") in {(a, b, c, d) for a, b, c, d in got["1"]} or ("Zoe@z.org.", "CODE", "a", "zoe@z.org.") in got["1"]
    assert ("Ann", "PERSON", "f", "ann.lee@x.org") in got["1"]
    assert ("Ann Lee", "PERSON", "p", "ann.lee@x.org") in got["3"]
    assert ("Lee, Ann", "PERSON", "n", "ann.lee@x.org") in got["5"] and ("Bo", "PERSON", "f", "bo@y.org") not in got["5"]  # two letters carry no identity


def test_name_forms(spark):
    names = ["Lee, Ann M.", "Bo Cook", "info", "x@y", "J P", "O'Neil", "Mary-Jane van der Berg"]
    rows = {r.n: r for r in spark.createDataFrame([(n,) for n in names], "n string").selectExpr("n", f"{letters.forms('n')} as f", f"{letters.is_person('lower(n)')} as p", f"{letters.from_address('n')} as a").collect()}
    assert rows["Lee, Ann M."].f.many == ["ann lee", "lee, ann", "lee, ann m."] and rows["Lee, Ann M."].f.one == ["ann", "lee"]
    assert rows["Mary-Jane van der Berg"].f.many == ["berg, mary-jane", "mary-jane berg", "mary-jane van der berg"]
    assert rows["x@y"].f.many == [] and rows["J P"].f.many == ["j p"][:0] and rows["O'Neil"].f.one == ["o'neil"]
    assert not rows["info"].p and rows["Bo Cook"].p and rows["O'Neil"].p
    assert spark.sql(f"select {letters.from_address(chr(39) + 'First.Last@x.org' + chr(39))} as a, {letters.from_address(chr(39) + 'news.desk@x.org' + chr(39))} as b").first() == ("first last", None)


def test_layers(spark):
    target, source = "Ann saw Bo . He left", "Ann *T*-1 saw Bo . *pro* He left 0"
    at = lambda w: {"start": source.index(w), "end": source.index(w) + len(w), "chain": w}
    spans, lost = layers.carried(target, source, [at("Ann"), at("He"), at("*pro*"), {"start": 0, "end": source.index("saw") + 3, "chain": "x"}])
    assert [(target[s["start"] : s["end"]], s["chain"]) for s in spans] == [("Ann", "Ann"), ("He", "He")] and lost == 2
    row = spark.createDataFrame([(target, source, [(0, 3, "c")])], "t string, s string, x array<struct<start: int, end: int, chain: string>>").select(layers.carry("t", "s", "x").alias("r")).first().r
    assert row.dropped == 0 and row.spans[0].end == 3
    names = spark.createDataFrame([("d", "en", 0, 3, "PERSON"), ("d", "en", 8, 10, "PERSON")], "doc_id string, lang string, start int, end int, type string")
    out, tally = layers.with_chains(names, spark.createDataFrame([("d", 0, 3, "7"), ("d", 8, 9, "8")], "doc_id string, start int, end int, chain string"), "c")
    assert sorted((r.start, r.entity) for r in out.collect()) == [(0, "c#d#7"), (8, None)] and tally.first() == ("en", 2, 1)
    text = "Herr B-PER I-PER kam, I-PER ging nach B-LOC-I-LOC am B-DATE B-DATE"
    want = [("B-PER I-PER", "PER", 2), ("I-PER", "PER", 1), ("B-LOC-I-LOC", "LOC", 2), ("B-DATE", "DATE", 1), ("B-DATE", "DATE", 1)]
    assert [(text[a:b], t, n) for a, b, t, n in layers.tag_runs(text)] == want
    assert [r.tokens for r in layers.runs_of(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("start").collect()] == [n for *_, n in want]
    marked = "am <[Pseudo] 3.4.2001> und 😀 <[Pseudo] x>!"
    dates = layers.date_marks(spark.createDataFrame([(1, marked)], "doc_id long, text string")).orderBy("start").collect()
    assert [marked[r.start : r.end] for r in dates] == [r.text for r in dates] == ["<[Pseudo] 3.4.2001>", "<[Pseudo] x>"]


def test_clinical_xml(spark):
    text = "a😀 Aspirin 5mg"
    head = '<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:cas="http:///uima/cas.ecore" xmlns:custom="http:///webanno/custom.ecore">'
    xml = f'{head}<cas:Sofa sofaString="{text}"/><custom:Medication begin="4" end="11" ClassType="DRUG" InNarrative="true"/><custom:Sectionsentence begin="0" end="15" Sectiontypes="Anamnese"/></xmi:XMI>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("x/cas.xmi", xml)
    rows = spark.createDataFrame([("1", text, bytearray(raw.getvalue())), ("2", text + "!", bytearray(raw.getvalue())), ("3", "plain", None)], "doc_id string, text string, archive binary")
    got = {r.doc_id: r for r in layers.clinical(rows).collect()}
    drug = got["1"].spans[0]
    assert (text[drug.start : drug.end], drug.label, drug.in_narrative, got["1"].used) == ("Aspirin", "DRUG", True, "letter")
    assert got["2"].used == "cas" and got["2"].text == text and got["3"].spans == [] and got["1"].spans[1].label == "Anamnese"


def test_fill(spark):
    visits = fill.population(200, 3)
    assert visits == fill.population(200, 3) and visits[0].patient == 0
    seen = set()
    for v in visits:
        assert v.patient <= len(seen) and len(v.physicians) == 2
        seen.add(v.patient)
        assert all(v.letter // 40 <= p < v.letter // 40 + 12 for p in v.physicians)
    assert 100 < len(seen) < 180
    text = "Patient B-PER I-PER, Dr. med. B-PER aus B-LOC und B-OTHER"
    names = {"PER": [("Kim Sol", 1.0), ("Uwe Ost", 1.0), ("Ada Rau", 2.0)], "LOC": [("Ulm", 1.0)]}
    new, edits, found = fill.filled(text, visits[5], 1, names)
    assert [new[m["start"] : m["end"]] for m in found] == [m["text"] for m in found] and found[2]["text"] == "Ulm" and found[3]["text"] == "B-OTHER"
    assert found[0]["entity"] == f"patient{visits[5].patient}" and found[1]["entity"].startswith("physician") and new.endswith("aus Ulm und B-OTHER")
    assert fill.filled(text, visits[5], 1, names)[0] == new
    letters_ = spark.createDataFrame([("d", 5, text, [(0, 7, "x"), (text.index("aus"), len(text), "y")])], "doc_id string, letter int, text string, layer array<struct<start: int, end: int, label: string>>")
    row = fill.fill(letters_, visits, 1, names).first()
    assert row.text == new and [new[x.start : x.end] for x in row.layer][0] == "Patient" and new[row.layer[1].start :] == "aus Ulm und B-OTHER"
    assert fill.moved(text.index("I-PER"), edits) == edits[0]["new_start"]
    assert [fill.weighted([("a", 1), ("b", 3)], x) for x in (0, 0.24, 0.25, 0.99)] == ["a", "a", "b", "b"]


def test_pools(spark, tmp_path):
    (tmp_path / "census.csv").write_text("name,rank,count\nO'HARA,1,50\nSMITH,2,40\nALL OTHER NAMES,0,900\nBAD,x,1\nLEE,3,30\n")
    (tmp_path / "given.csv").write_text("Name,Gender,Count,Probability\nann,F,9,0\nbo,M,5,0\nx1,F,9,0\nann,M,1,0\n")
    (tmp_path / "geo.tsv").write_text("\n".join("\t".join([str(i), n, "", "", "", "", c, "", k, "", "", "", "", "", str(p)]) for i, (n, c, k, p) in enumerate([("Ulm", "P", "DE", 100), ("Bonn", "P", "DE", 300), ("Rhein", "H", "DE", 0), ("Paris", "P", "FR", 900)])) + "\n")
    (tmp_path / "de.json").write_text(json.dumps({"family": ["Ost", "Rau"], "city": {"DE": ["Ulm"], "AT": ["Wien", "Ulm"]}}))
    assert [tuple(r) for r in pools.census(spark, str(tmp_path / "census.csv"), 2).collect()] == [("O'Hara", 50), ("Smith", 40)]
    given = pools.given_names(spark, str(tmp_path / "given.csv"), 2)
    assert sorted(tuple(r) for r in given.collect()) == [("Ann", "f", 9), ("Bo", "m", 5)]
    assert [r.name for r in pools.cities(spark, str(tmp_path / "geo.tsv"), 1, ["DE"], 1).collect()] == ["Bonn"]
    nested = pools.nested(spark, str(tmp_path / "de.json"), {"family": ("PERSON", None), "city": ("LOC", None)}, "de")
    assert sorted(r.surface for r in nested.collect()) == ["Ost", "Rau", "Ulm", "Wien"]
    prior = {r.name: r.weight for r in pools.as_prior(given, given, pools.census(spark, str(tmp_path / "census.csv"))).collect()}
    assert prior["ann"] == pytest.approx(18 / (28 + 120)) and pools.describe(pools.as_prior(given)).first().names == 2
    assert inventory.merged(pools.as_inventory(given, "PERSON", "en"), nested).count() == 6
    row = spark.createDataFrame([("مُحَمَّد علي", "٣٬٤٥٠", "x1")], "a string, n string, b string").selectExpr(f"{pools.clean_part('a')} as a", f"{pools.number('n')} as n", f"{pools.has_diacritics('a')} as d", f"{pools.clean_part('b')} as b").first()
    assert row == ("محمد علي", 3450, True, None)
    names = spark.createDataFrame([("ar", f"{a} {b}") for a, b in itertools.product(["محمد", "علي"], ["حسن", "كريم"])][:3] * 2, "lang string, surface string")
    made = inventory.recombined(pools.name_parts(names), names.distinct()).collect()
    assert [r.surface for r in made] == ["علي كريم"]


def test_corpus_files(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a\nb", {"k": "v"}, None), (2, None, None, [1, 2])], "doc_id long, text string, meta map<string, string>, xs array<int>")
    corpus.write(rows, str(tmp_path / "c"), "demo")
    back = corpus.read(spark, str(tmp_path / "c"))
    key = lambda r: r.doc_id
    assert back.schema == rows.schema and sorted(back.collect(), key=key) == sorted(rows.collect(), key=key) and corpus.header(spark, str(tmp_path / "c"))["documents"] == 2
    rows.write.mode("append").json(str(tmp_path / "c" / "documents"))
    with pytest.raises(ValueError):
        corpus.read(spark, str(tmp_path / "c"))
    monkeypatch.setenv("MASKWRIGHT_WORK", "/w")
    assert corpus.folder("out") == "/w/out"
    with pytest.raises(LookupError):
        corpus.folder("vault", restricted=True)
    for label, n in (("a", 3), ("b", 2)):
        (tmp_path / "t" / label).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "t" / label / f"{i}.txt").write_text("long enough text " * 5 if i else "x")
    got = corpus.topics(spark, str(tmp_path / "t"), per_label=1)
    assert corpus.labels(got) == ["a", "b"] and got.count() == 2 and corpus.topics(spark, str(tmp_path / "t")).count() == 3
    (tmp_path / "t" / "a" / "9.txt").write_text("version https://git-lfs.github.com/spec/v1 " + "x" * 60)
    with pytest.raises(Exception, match="is a pointer"):
        corpus.topics(spark, str(tmp_path / "t")).collect()
    assert corpus.formality(spark, str(tmp_path / "none.csv")).count() == 0
