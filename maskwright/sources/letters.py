"""Mail as text with a reference layer: bodies without history, names from headers, and mentions found by a dictionary."""

from __future__ import annotations

import email
import email.policy
import io
import quopri
import re
import tarfile
from collections.abc import Iterable, Iterator, Sequence
from email.message import Message

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Mailboxes that are a function, words of organisations, header fields of embedded blocks, and markers of quoted history.
ROLES = (
    "admin administrator alerts announcements billing bounce contact customerservice documents enquiries feedback help helpdesk info information list listserv mail mailer mailing marketing "
    "members news newsletter noreply notifications offers orders postmaster questions reactions register registration reply reporting request sales service staff subscribe subscriptions "
    "support team unsubscribe updates webmaster weather"
).split()
FIELDS = re.compile(r"\s*(to|cc|bcc|from|sent|sent by|date|subject|reply-to|message-id|received|mime-version|content-type|content-transfer-encoding|importance|x-[a-z0-9-]+)\s*:", re.I)
HISTORY = re.compile(r"\s*(-+ ?original message ?-+|-{5,}.*forwarded by|_{5,}\s*$)", re.I)
STAMP = re.compile(r"\s*\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}(:\d{2})?\s*([AP]M)?\s*$", re.I)
NEAR = 6
ADDRESS = re.compile(r"[\w.+-]+@[\w-]+\.[\w.-]+")
ROUTING = re.compile(r"</?O=[^>]*>|/O=\S+", re.I)
SHOWN = (("From", "X-From"), ("To", "X-To"), ("Cc", "X-cc"), ("Subject", None))


# --- bodies and texts ---------------------------------------------------------------------------


def body(message: Message) -> str:
    """The plain part, decoded where quoted-printable is declared or its soft breaks show."""
    parts = [p for p in message.walk() if not p.is_multipart()]
    part = next((p for p in parts if p.get_content_type() == "text/plain"), parts[0] if parts else None)
    raw = part.get_payload() if part is not None else ""
    if not isinstance(raw, str):
        return ""
    if (part.get("Content-Transfer-Encoding") or "").strip().lower() != "quoted-printable" and not re.search(r"=\r?\n", raw):
        return raw
    data = quopri.decodestring(raw.encode("latin-1", "replace"))
    for charset in (part.get_content_charset() or "cp1252", "cp1252", "latin-1"):
        try:
            return data.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    return raw


def own_words(text: str) -> str:
    """A body without history: cut at a quote marker; quoted lines and a header block at the top left out; cut at a header block below prose, with the stamp and name above it."""
    lines = [x for x in text.splitlines()]
    stop = next((i for i, x in enumerate(lines) if HISTORY.match(x)), len(lines))
    lines = [x for x in lines[:stop] if not x.lstrip().startswith(">")]
    field = [(m[1].lower() if (m := FIELDS.match(x)) else None) for x in lines]
    blank = [not x.strip() for x in lines]
    first = 0
    i = 0
    while i < len(lines):
        if field[i] and len({f for f in field[i : i + NEAR] if f}) > 1:
            if all(blank[first:i]):  # a memo's own header
                while i < len(lines) and not blank[i]:
                    i += 1
                first = i
                continue
            if i and STAMP.match(lines[i - 1]):
                i -= 1
                name = lines[i - 1].strip() if i > first else ""
                if name and ":" not in name and len(name) <= 60 and name[-1] not in ".!?,;" and len(name.split()) <= 6:
                    i -= 1
            lines = lines[:i]
            break
        i += 1
    return "\n".join(lines[first:]).strip()


def shown(message: Message) -> str:
    """The text a client shows: sender, recipients and subject with names and addresses, without routing, then the body."""
    tidy = lambda x: re.sub(r"\s{2,}", " ", re.sub(r",\s*(?=,)", "", ROUTING.sub("", x or ""))).strip(" ,\t\n")
    head = []
    for field, name in SHOWN:
        values = [tidy(message.get(name)) if name else "", tidy(message.get(field))]
        kept = [v for i, v in enumerate(values) if v and v not in values[:i]]
        if kept:
            head.append(f"{field}: {', '.join(kept)}")
    said = own_words(body(message))
    return "\n".join(head) + (f"\n\n{said}" if said else "\n")


def people(message: Message) -> list[str]:
    """Addresses of sender and recipients, folded, distinct, sorted."""
    return sorted({a.casefold() for h in ("From", "To", "Cc", "Bcc") for a in ADDRESS.findall(str(message.get(h) or ""))})


_ROW = "subject string, date string, sender string, display string, participants array<string>, body string, text string"


def _opened(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for raw in frame["content"]:
            m = email.message_from_bytes(bytes(raw), policy=email.policy.compat32)
            got = ADDRESS.findall(str(m.get("From") or ""))
            display = re.sub(r"\s*<[^>]*>", "", str(m.get("X-From") or "")).strip(" \"'")
            rows.append((str(m.get("Subject") or ""), str(m.get("Date") or ""), got[0].casefold() if got else None, display or None, people(m), own_words(body(m)), shown(m)))
        yield pd.concat([frame[["mailbox", "doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])], axis=1)


def messages(spark: SparkSession, path: str, mailboxes: Sequence[str] | None = None, limit: int | None = None, stride: int = 1, require_body: bool = False) -> DataFrame:
    """Mail of a tree of files, or of tar archives (``*.tar``, ``*.tar.gz``), as texts: ``mailbox, doc_id, ...``.

    ``stride`` keeps every n-th message in order of path, then ``limit`` the first.
    """
    if re.search(r"\.tar(\.gz|\.bz2)?$|\.tgz$", path):
        files = archive_members(spark, path)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).selectExpr("path as doc_id", "content")
    rows = files.selectExpr("element_at(filter(split(doc_id, '/'), x -> x <> ''), -3) as far", "element_at(filter(split(doc_id, '/'), x -> x <> ''), -2) as near", "doc_id", "content").selectExpr("coalesce(far, near) as mailbox", "doc_id", "content")
    if mailboxes is not None:
        rows = rows.where(F.col("mailbox").isin(list(mailboxes)))
    if stride > 1 or limit is not None:
        from ..operators.construct import ranked_sums

        place = ranked_sums(rows.selectExpr("doc_id", "1L as one"), "doc_id", "one")
        keep = place.where(f"before_ % {stride} = 0" + (f" and before_ div {stride} < {limit}" if limit is not None else "")).select("doc_id")
        rows = rows.join(keep, "doc_id", "left_semi")
    out = rows.mapInPandas(_opened, f"mailbox string, doc_id string, {_ROW}")
    return out.where("body <> ''") if require_body else out


def archive_members(spark: SparkSession, path: str, keep: str = ".*") -> DataFrame:
    """``doc_id, content`` of the members of tar archives whose name matches: each archive is read once, from first to last."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, raw in zip(frame["path"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(bytes(raw)), mode="r:*") as tar:
                    rows: list[tuple[str, bytes]] = []
                    for member in tar:
                        if member.isfile() and re.search(keep, member.name):
                            rows.append((f"{where}!/{member.name}", tar.extractfile(member).read()))
                            if len(rows) == 500:
                                yield pd.DataFrame(rows, columns=["doc_id", "content"])
                                rows = []
                    yield pd.DataFrame(rows, columns=["doc_id", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "doc_id string, content binary")


# --- identities ---------------------------------------------------------------------------------


def identities(mail: DataFrame) -> DataFrame:
    """``name, address, n``: for each sender's display name the address most messages give it (ties to the first by address), and how many have the name."""
    pairs = mail.where("sender is not null and display is not null").selectExpr("lower(display) as name", "sender as address").where(r"name rlike '^[a-z][a-z.\\x27\\- ]{1,48}(,\\s*[a-z][a-z.\\x27\\- ]{0,24})?$'")
    votes = pairs.groupBy("name", "address").agg(F.count(F.lit(1)).alias("k"))
    return votes.groupBy("name").agg(F.min_by("address", F.struct((-F.col("k")).alias("k"), "address")).alias("address"), F.sum("k").alias("n"))


def is_person(name: str, known: str | None = None) -> str:
    """SQL: a display name that can be a person: more than one word, or one that is no role, has three letters and no dot, and, where ``known`` names an array of them, is a known name."""
    roles = ", ".join(f"'{r}'" for r in ROLES)
    listed = "true" if known is None else rf"(array_contains({known}, {name}) or array_contains({known}, regexp_replace({name}, '[\\x27’\\-]', '')))"
    return f"({name} like '% %' or {name} like '%,%' or (length({name}) >= 3 and not contains({name}, '.') and {name} not in ({roles}) and {listed}))"


def forms(name: str) -> str:
    """SQL: ``struct(many, one)`` of a display name: forms of several words that a body may use, and single ones of three letters or more.

    ``Last, First`` is turned round and initials are left out.
    """
    plain = f"trim(both '\\'\"' from trim(regexp_replace(lower({name}), '\\\\s+', ' ')))"
    turned = "if(contains(p.w, ','), concat(trim(substring(p.w, locate(',', p.w) + 1)), ' ', trim(substring_index(p.w, ',', 1))), p.w)"
    words = f"filter(regexp_extract_all({turned}, '([\\\\p{{L}}][\\\\p{{L}}\\\\x27\\\\-]*)', 1), x -> length(x) > 1)"
    many = "if(size(t.t) < 2, cast(array() as array<string>), array_sort(array_distinct(array(concat(t.t[0], ' ', element_at(t.t, -1)), concat(element_at(t.t, -1), ', ', t.t[0]), array_join(t.t, ' '), regexp_replace(t.w, '\\\\s*,\\\\s*', ', ')))))"
    one = "array_sort(array_distinct(filter(if(size(t.t) < 2, t.t, array(t.t[0], element_at(t.t, -1))), x -> length(x) >= 3)))"
    inner = f"transform(transform(array({plain}), w -> struct(w as w)), p -> struct(p.w as w, if(contains(p.w, '@'), cast(array() as array<string>), {words}) as t))"
    return f"get(transform({inner}, t -> struct({many} as many, {one} as one)), 0)"


def from_address(address: str) -> str:
    """SQL: ``first.last@`` as a name, null for any other form and for roles."""
    local = f"split(substring_index(lower({address}), '@', 1), '[._]')"
    roles = ", ".join(f"'{r}'" for r in ROLES)
    return f"if(size({local}) = 2 and forall({local}, x -> x rlike '^\\\\p{{L}}{{2,}}$' and not x in ({roles})), array_join({local}, ' '), null)"


def name_index(table: DataFrame, least: int = 2) -> DataFrame:
    """``form, owner, single``: what a body may call somebody; a form of several people has no owner."""
    rows = table.where(f"n >= {least} and {is_person('name')}").selectExpr("address", f"{forms('name')} as f")
    many = rows.selectExpr("address", "explode(f.many) as form").groupBy("form").agg(F.collect_set("address").alias("a"))
    one = rows.selectExpr("explode(f.one) as form").distinct()
    return many.selectExpr("form", "if(size(a) = 1, a[0], null) as owner", "false as single").unionByName(one.selectExpr("form", "cast(null as string) as owner", "true as single"))


def claims(text: str, local_many: dict[str, set[str]], local_one: dict[str, set[str]], many: dict[str, str | None], one: Iterable[str]) -> list[tuple[int, int, str, str, str | None]]:
    """(start, end, rule, kind, owner), none overlapping: addresses first, then names of several words, longest first, then single capitalised ones; the envelope's before the corpus's.

    Rules: a address, p participant's full name, n corpus name, f participant's
    single name, g corpus's single name.
    """
    taken: list[tuple[int, int, str, str, str | None]] = []

    def claim(found: list[tuple[int, int, str, str, str | None]]) -> None:
        for x in found:
            if all(x[1] <= a or b <= x[0] for a, b, *_ in taken):
                taken.append(x)

    lone = lambda owners: next(iter(owners)) if len(owners) == 1 else None
    claim([(m.start(), m.end(), "a", "CODE", m[0].casefold()) for m in ADDRESS.finditer(text)])
    words = [(m.start(), m.end(), m[0].casefold()) for m in re.finditer(r"[^\W\d_][^\W\d_'\-]*\.?", text)]
    longest = max((f.count(" ") + 1 for f in (*local_many, *many)), default=0)
    found = []
    for i in range(len(words)):
        for k in range(2, longest + 1):
            if i + k > len(words):
                break
            start, end = words[i][0], words[i + k - 1][1]
            form = re.sub(r"\s*,\s*", ", ", " ".join(text[start:end].casefold().split()))
            for rule, known in (("p", local_many), ("n", many)):
                if form in known:
                    found.append((start, end, rule, "PERSON", lone(known[form]) if rule == "p" else known[form]))
                    break
    claim(sorted(found, key=lambda x: (x[0] - x[1], x[2] != "p", x[0])))
    single = set(one)
    lonely = [(a, b, "f", "PERSON", lone(local_one[w])) if w in local_one else (a, b, "g", "PERSON", None) for a, b, w in words if text[a].isupper() and (w in local_one or w in single)]
    claim(sorted(lonely, key=lambda x: (x[0] - x[1], x[2] != "f", x[0])))
    return sorted(taken, key=lambda x: (x[0], -x[1]))


def mentions(mail: DataFrame, table: DataFrame, least: int = 2) -> DataFrame:
    """``doc_id, start, end, text, type, rule, entity`` of every message, from its envelope and the corpus's names.

    Each message brings the corpus forms that its own words can begin: forms
    meet messages by first word in a join, so no task holds all names.
    """
    index = name_index(table, least).selectExpr("*", "substring_index(form, ' ', 1) as head")
    heads = mail.selectExpr("doc_id", "explode(array_distinct(regexp_extract_all(lower(text), '([\\\\p{L}][\\\\p{L}\\\\x27\\\\-]*,?)', 1))) as head")
    met = heads.join(index, "head").groupBy("doc_id").agg(F.collect_set(F.struct("form", "owner", "single")).alias("corpus"))
    byname = table.selectExpr("address as a_", "name")
    envelope = mail.selectExpr("doc_id", "explode(participants) as a_").distinct()
    listed = envelope.join(byname, "a_").unionByName(envelope.selectExpr("doc_id", "a_", f"{from_address('a_')} as name").where("name is not null"))
    listed = listed.selectExpr("doc_id", "a_ as address", f"{forms('name')} as f").groupBy("doc_id").agg(F.collect_list(F.struct("address", "f")).alias("envelope"))
    rows = mail.select("doc_id", "text").join(met, "doc_id", "left").join(listed, "doc_id", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text, corpus, mine in zip(frame["doc_id"], frame["text"], frame["corpus"], frame["envelope"], strict=True):
                local: tuple[dict, dict] = {}, {}
                for x in [] if mine is None else mine:
                    for to, names in zip(local, (x["f"]["many"], x["f"]["one"]), strict=True):
                        for n in names:
                            to.setdefault(n, set()).add(x["address"])
                known = [] if corpus is None else corpus
                got = claims(text, *local, {x["form"]: x["owner"] for x in known if not x["single"]}, [x["form"] for x in known if x["single"]])
                out += [(doc_id, a, b, text[a:b], kind, rule, owner) for a, b, rule, kind, owner in got]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "text", "type", "rule", "entity"])

    return rows.mapInPandas(run, f"doc_id {mail.schema['doc_id'].dataType.simpleString()}, start int, end int, text string, type string, rule string, entity string")
