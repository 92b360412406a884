"""Detector ports: registry, replay, model ports, windows, prompts, reply parsing, grounding and token budgets.

A detector is a function from documents (``doc_id, text``) to raw spans
(``doc_id, detector, start, end, text, type_src, score``).  Ports that need a
model or a gateway take a factory: it is called once in each worker and its
result for each text, in Arrow batches, so nothing here needs a network.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = "detector string, start int, end int, text string, type_src string, score double"
Detector = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Detector] = {}


def register(name: str) -> Callable[[Detector], Detector]:
    """Makes a detector known by name; a name is given once."""

    def add(detector: Detector) -> Detector:
        if name in REGISTRY:
            raise ValueError(f"{name!r} is taken")
        REGISTRY[name] = detector
        return detector

    return add


def detect(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Spans of several registered detectors, in one frame."""
    missing = [n for n in names if n not in REGISTRY]
    if missing:
        raise KeyError(f"no detector {missing}; there are {sorted(REGISTRY)}")
    out = None
    for n in names:
        rows = REGISTRY[n](docs)
        out = rows if out is None else out.unionByName(rows)
    return out


def replay(docs: DataFrame, stored: DataFrame, name: str) -> DataFrame:
    """A stored detector: its spans of the documents at hand."""
    return stored.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("detector", F.lit(name))


def model(docs: DataFrame, name: str, factory: Callable[[], Callable[[list[str]], list[list[dict]]]], batch: int = 32) -> DataFrame:
    """A port for a model: ``factory()`` loads it, once a worker, and returns a function from texts to lists of spans.

    Spans are dictionaries of ``start, end, label`` and, where there is one, ``score``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = None
        for frame in frames:
            predict = predict or factory()
            rows = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                for doc_id, text, spans in zip(part["doc_id"], part["text"], predict(part["text"].fillna("").tolist()), strict=True):
                    rows += [(doc_id, name, s["start"], s["end"], text[s["start"] : s["end"]], s["label"], s.get("score")) for s in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "detector", "start", "end", "text", "type_src", "score"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {RAW}")


def routed(docs: DataFrame, backbones: dict[str, str], default: str) -> tuple[DataFrame, DataFrame]:
    """Adds the backbone of each document's language, and counts those that fall back: ``lang, n``."""
    table = F.create_map(*(F.lit(x) for k, v in sorted(backbones.items()) for x in (k, v)))
    out = docs.withColumn("backbone", F.coalesce(table[F.col("lang")], F.lit(default)))
    return out, docs.where(table[F.col("lang")].isNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


# --- prompts and replies ------------------------------------------------------------------------

# Types asked for and the instruction.
ASKED = ("PERSON", "LOC", "ORG", "DATETIME", "EMAIL", "PHONE", "ID", "PROFESSION")
SYSTEM = (
    "You extract personally identifying information from text. "
    "Return ONLY a JSON array, no prose, no code fence. "
    'Each element is {"text": "<exact substring from the input>", "type": "<TYPE>"}. '
    "Copy the substring exactly as it appears, including case and punctuation. "
    "Return an empty array if there is nothing to extract."
)


def prompt_windows(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, start, chunk``: windows that don't overlap, blank ones left out."""
    rows = docs.selectExpr("doc_id", "text", f"explode(sequence(0, greatest(length(text) - 1, 0), {size})) as start")
    return rows.selectExpr("doc_id", "start", f"substring(text, start + 1, {size}) as chunk").where(r"chunk rlike '\\S'")


def messages(chunk: str, types: Sequence[str] = ASKED) -> str:
    """SQL for the two messages of a window, as an array of (role, content)."""
    quoted = SYSTEM.replace("'", "\\'")
    return f"array(struct('system' as role, '{quoted}' as content), struct('user' as role, concat('Types: {', '.join(types)}\\n\\n', {chunk}) as content))"


def parse_reply(reply: str | None) -> list[tuple[str, str]]:
    """(surface, type) pairs of a reply: the JSON array in it; of an array that breaks off, its whole elements."""
    reply = reply or ""
    first, last = reply.find("["), reply.rfind("]")
    if first < 0:
        return []
    blob = reply[first : last + 1] if last > first else reply[first:]
    for text in (blob, blob[: blob.rfind("}") + 1] + "]"):
        try:
            items = json.loads(text)
        except json.JSONDecodeError:
            continue
        return [(str(x["text"]), str(x.get("type", "MISC")).upper()) for x in items if isinstance(x, dict) and x.get("text")]
    return []


def _folded(text: str) -> tuple[str, list[int]]:
    """Decomposed, without combining marks, case-folded, white space collapsed; and where each character came from."""
    out, back, space = [], [], False
    for i, c in enumerate(text):
        kept = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if not kept:
            continue
        if kept.isspace():
            if space:
                continue
            kept = " "
        space = kept == " "
        out.append(kept)
        back += [i] * len(kept)
    return "".join(out), back


def ground(text: str, pairs: Iterable[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, type) of surfaces in a text, each occurrence once from left to right; folded where the exact surface isn't there."""
    spans, exact, loose = [], {}, {}
    view: tuple[str, list[int]] | None = None
    for surface, type_ in pairs:
        key = surface, type_
        start = text.find(surface, exact.get(key, 0))
        end = start + len(surface)
        if start < 0:
            view = view or _folded(text)
            needle = _folded(surface)[0].strip()
            at = view[0].find(needle, loose.get(key, 0)) if needle else -1
            if at < 0:
                continue
            loose[key] = at + len(needle)
            start, end = view[1][at], view[1][at + len(needle) - 1] + 1
        exact[key] = end
        spans.append((start, end, type_))
    return spans


def grounded(docs: DataFrame, replies: DataFrame, name: str) -> DataFrame:
    """``replies(doc_id, start, reply)`` of a document's windows -> raw spans in the whole text, replies in window order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    listed = replies.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "reply"))), lambda x: x["reply"]).alias("replies"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text, said in zip(frame["doc_id"], frame["text"], frame["replies"], strict=True):
                found = ground(text or "", [pair for reply in said for pair in parse_reply(reply)])
                rows += [(doc_id, name, a, b, text[a:b], t, None) for a, b, t in found]
            yield pd.DataFrame(rows, columns=["doc_id", "detector", "start", "end", "text", "type_src", "score"]).astype({"score": "float64"})

    return docs.select("doc_id", "text").join(listed, "doc_id").mapInPandas(run, f"doc_id {kind}, {RAW}")


# --- budgets ------------------------------------------------------------------------------------

# Characters a token by script, the least answer, and the least answer of models that reason.
CHARS = {"cjk": 1.0, "arabic": 1.0, "default": 2.5}
FLOOR, REASONING_FLOOR, RESERVE = 512, 8192, 1024
_CJK, _ARABIC = "[\\u4e00-\\u9fff\\u3400-\\u4dbf\\u3000-\\u303f]", "[\\u0600-\\u06ff\\u0750-\\u077f\\ufb50-\\ufdff]"


def chars_per_token(text: str) -> str:
    """SQL: the mean over a text's characters of the rate of their script."""
    cjk, arabic = f"regexp_count({text}, '{_CJK}')", f"regexp_count({text}, '{_ARABIC}')"
    mean = f"({cjk} * {CHARS['cjk']}D + {arabic} * {CHARS['arabic']}D + (length({text}) - {cjk} - {arabic}) * {CHARS['default']}D) / length({text})"
    return f"if(length({text}) = 0, {CHARS['default']}D, {mean})"


def max_prompt_tokens(context: int, ratio: float) -> int:
    return max(FLOOR, int((context - RESERVE) / (1 + ratio)))


def answer_cap(text: str, context: int, ratio: float, reasoning: bool = False, cap: int | None = None) -> str:
    """SQL: tokens granted to an answer: the prompt's share and a margin, at least the floor, at most what the context leaves."""
    prompt = f"greatest(1, ceil(length({text}) / {chars_per_token(text)}))"
    want = str(cap) if cap else f"greatest({REASONING_FLOOR if reasoning else FLOOR}, ceil({prompt} * {ratio}D) + {FLOOR})"
    return f"greatest({FLOOR}, least({want}, {context - RESERVE} - {prompt}))"


def fit_ratio(records: DataFrame, quantile: float = 0.99) -> DataFrame:
    """``family, ratio``: the upper order statistic of answer over prompt tokens among whole, unfailed replies."""
    ok = records.where("error is null and not coalesce(truncated, false) and prompt_tokens > 0").selectExpr("family", "completion_tokens / prompt_tokens as r")
    ranked = ok.groupBy("family", "r").count().selectExpr("family", "r", "sum(count) over (partition by family order by r) as upto", "sum(count) over (partition by family) as n")
    return ranked.where(f"upto > least(n - 1, ceil({quantile}D * (n - 1)))").groupBy("family").agg(F.min("r").alias("ratio"))


# --- a gateway ----------------------------------------------------------------------------------

_WAIT = re.compile(r"(?:try again|retry) (?:in|after) ([0-9.]+) ?(ms|s|sec|seconds|m|min|minutes)?", re.I)


def retry_after(header: str | None, body: str | None = None) -> float | None:
    """Seconds to wait that a refusal names: in its header, else in its text."""
    if header and re.fullmatch(r"\s*[0-9.]+\s*", header):
        return float(header)
    found = _WAIT.search(f"{header or ''} {body or ''}")
    if not found:
        return None
    unit = (found[2] or "s").lower()
    return float(found[1]) * (0.001 if unit == "ms" else 60 if unit.startswith("m") else 1)


def assemble_stream(lines: Iterable[str]) -> tuple[str, str | None]:
    """Text and finish reason of a stream of server-sent events."""
    text, reason = [], None
    for line in lines:
        if not line.startswith("data:") or line[5:].strip() == "[DONE]":
            continue
        choice = (json.loads(line[5:]).get("choices") or [{}])[0]
        text.append((choice.get("delta") or {}).get("content") or "")
        reason = choice.get("finish_reason") or reason
    return "".join(text), reason


class Gateway:
    """Chat over any transport ``send(messages) -> (status, header, body)``: waits as refusals say, else twice as long each time."""

    def __init__(self, send: Callable[[list[dict]], tuple[int, str | None, str]], sleep: Callable[[float], None], tries: int = 6, first: float = 1.0):
        self.send, self.sleep, self.tries, self.first = send, sleep, tries, first

    def ask(self, messages_: list[dict]) -> str:
        wait = self.first
        for n in range(self.tries):
            status, header, body = self.send(messages_)
            if status == 200:
                return body
            if status not in (429, 500, 502, 503, 504) or n == self.tries - 1:
                raise RuntimeError(f"gateway answered {status}")
            said = retry_after(header, body)
            self.sleep(said if said is not None else wait)
            wait = min(2 * wait, 60.0)
        raise AssertionError("not reached")


def align_tokens(text: str, tokens: Sequence[str], max_skip: int = 64) -> list[tuple[int, int] | None]:
    """Left-to-right places of tokens in a text; one that isn't within ``max_skip`` characters is None and moves nothing."""
    out, at = [], 0
    for t in tokens:
        found = text.find(t, at, at + max_skip + len(t))
        out.append((found, found + len(t)) if found >= 0 else None)
        at = found + len(t) if found >= 0 else at
    return out
