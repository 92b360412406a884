"""Filling tag runs of released letters with seeded values: a population of patients and physicians, roles by context, layers moved along."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .layers import tag_runs

#: Characters before a person's run that tell a physician from a patient.
CUES, REACH = re.compile(r"\b(dr|prof|arzt|ärztin|oberarzt|chefarzt|kolleg\w*|med)\b", re.I), 90


def weighted(names: Sequence[tuple[str, float]], at: float) -> str:
    """The first name whose cumulated weight is over ``at`` (0 to 1) of the total."""
    total, upto = sum(w for _, w in names), 0.0
    for name, w in names:
        upto += w
        if at * total < upto:
            return name
    return names[-1][0]


@dataclass(frozen=True)
class Visit:
    letter: int
    patient: int
    physicians: tuple[int, ...]


def population(letters: int, seed: int, back: float = 0.3, roster: int = 12, turnover: int = 40, present: int = 2) -> list[Visit]:
    """Who each letter is about and who signs it, one after the other: a patient is new, or with chance ``back`` one of those seen; physicians come from a roster that a new one joins every ``turnover`` letters, the oldest leaving."""
    rng, seen, out = random.Random(seed), 0, []
    for n in range(letters):
        again = seen and rng.random() < back
        patient = rng.randrange(seen) if again else seen
        seen += not again
        first = n // turnover
        out.append(Visit(n, patient, tuple(sorted(rng.sample(range(first, first + roster), min(present, roster))))))
    return out


def _draw(seed: int, *what: object) -> float:
    raw = hashlib.sha256("|".join(map(str, (seed, *what))).encode()).digest()
    return int.from_bytes(raw[:8], "big") / 2**64


def filled(text: str, visit: Visit, seed: int, pools: dict[str, Sequence[tuple[str, float]]]) -> tuple[str, list[dict], list[dict]]:
    """Text with every run replaced, edits, and mentions: persons by their role (physicians where a cue stands before), the same value for the same identity everywhere, other types by letter and place.

    Pools are named by type; a type without one keeps its run's tag as it is.
    """
    out, edits, found, at, size = [], [], [], 0, 0
    for start, end, type_, _ in tag_runs(text):
        if type_ == "PER":
            cue = CUES.search(text[max(0, start - REACH) : start])
            who = f"physician{visit.physicians[start % len(visit.physicians)]}" if cue and visit.physicians else f"patient{visit.patient}"
        else:
            who = f"{type_}:{visit.letter}:{start}"
        pool = pools.get(type_)
        value = weighted(pool, _draw(seed, type_, who)) if pool else text[start:end]
        out.append(text[at:start])
        size += start - at
        edits.append({"old_start": start, "old_end": end, "new_start": size, "new_end": size + len(value)})
        found.append({"start": size, "end": size + len(value), "text": value, "type": type_, "entity": who})
        out.append(value)
        size, at = size + len(value), end
    return "".join(out) + text[at:], edits, found


def moved(place: int, edits: Sequence[dict]) -> int:
    """An offset in the filled text: inside a replacement it goes to its start, whichever end of a span it is."""
    shift = 0
    for e in edits:
        if place < e["old_start"]:
            break
        if place < e["old_end"]:
            return e["new_start"]
        shift = e["new_end"] - e["old_end"]
    return place + shift


def fill(letters: DataFrame, visits: list[Visit], seed: int, pools: dict[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """``letters(doc_id, letter, text, layer array<struct<start, end, label>>)`` -> ``doc_id, text, mentions, layer``, the layer moved along.

    The population has one entry for each letter (some hundreds) and travels
    with the function.
    """
    by = {v.letter: v for v in visits}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, letter, text, layer in zip(frame["doc_id"], frame["letter"], frame["text"], frame["layer"], strict=True):
                new, edits, found = filled(text, by[letter], seed, pools)
                rows.append((doc_id, new, found, [{"start": moved(x["start"], edits), "end": moved(x["end"], edits), "label": x["label"]} for x in ([] if layer is None else layer)]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "mentions", "layer"])

    kind = letters.schema["doc_id"].dataType.simpleString()
    return letters.select("doc_id", "letter", "text", "layer").mapInPandas(run, f"doc_id {kind}, text string, mentions array<struct<start: int, end: int, text: string, type: string, entity: string>>, layer array<struct<start: int, end: int, label: string>>")
