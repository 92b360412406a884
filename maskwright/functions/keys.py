"""Entity keys, scope keys, pseudonym indexes and surrogates as Spark SQL over column names.

N1 and the keys above it are exact: Latin texts are folded inside the JVM, texts
with any other character (or one that compatibility normalisation changes) by a
Python function that sees nothing else.  ``register`` makes it known to SQL.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Honorifics that a key drops at its start, and the punctuation it drops.
HONORIFICS = (
    "mr mrs ms miss mx dr prof professor sir lord lady judge justice president chancellor minister rev reverend capt col gen sgt lt hon "
    "herr frau monsieur madame mme mlle señor señora sr sra dhr mevr"
).split()

# Syllables of the synthetic inventory, and its size.
ONSET = "b d f g k l m n p r s t v z".split()
NUCLEUS = "a e i o u ei ou ae".split()
CODA = ["", *"n r s t l ng ck".split()]
POOL = 4096

SEPARATOR = "\\u001f"
_PUNCT_CLASS = r"[.,;:!?\\x27\\x22()\\[\\]{}<>«»„“”‘’]"


#: Texts of these characters fold by lower case and one replacement; normalisation leaves them as they are.
_LATIN = r"^[\\t-\\r -~¡-§©«¬®°±¶·»¿-ÿ]*$"


def fold(surface: str) -> str:
    """NFKC, strip, collapse white space, case fold."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", surface).strip()).casefold()


@F.pandas_udf(T.StringType())
def _fold(surface: pd.Series) -> pd.Series:
    return surface.map(fold, na_action="ignore")


def register(spark: SparkSession) -> None:
    """Makes the Python part of N1 known to the session's SQL."""
    spark.udf.register("maskwright_fold", _fold)


def n1(c: str) -> str:
    latin = rf"replace(lower(trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' '))), 'ß', 'ss')"
    return f"if({c} rlike '{_LATIN}', {latin}, maskwright_fold(if({c} rlike '{_LATIN}', null, {c})))"


def n2(c: str) -> str:
    bare = f"regexp_replace({n1(c)}, '{_PUNCT_CLASS}', '')"
    plain = rf"regexp_replace({bare}, '^({'|'.join(HONORIFICS)})(?![\\p{{L}}\\p{{N}}_]) *', '')"
    return f"trim(regexp_replace({plain}, ' +', ' '))"


def n3(c: str) -> str:
    key = n2(c)
    return f"coalesce(nullif(array_join(filter(split({key}, ' '), x -> length(x) > 1), ' '), ''), {key})"


def n4(c: str) -> str:
    return f"element_at(split({n3(c)}, ' '), -1)"


NORMALISERS = {"N0": lambda c: c, "N1": n1, "N2": n2, "N3": n3, "N4": n4}


def entity_key(type_: str, norm: str) -> str:
    return f"concat_ws('{SEPARATOR}', {type_}, {norm})"


POLICIES = {
    "deterministic": lambda key, doc, mention: key,
    "document": lambda key, doc, mention: f"concat_ws('{SEPARATOR}', {key}, {doc})",
    "full": lambda key, doc, mention: f"concat_ws('{SEPARATOR}', {key}, {doc}, {mention})",
}


def _index(digest: str) -> str:
    """Low 32 bits of the first eight digest bytes."""
    return f"cast(conv(substring({digest}, 9, 8), 16, 10) as bigint)"


def hash_index(scope: str) -> str:
    return _index(f"sha2({scope}, 256)")


def hmac_digest(scope: str, key: bytes) -> str:
    """HMAC-SHA256 in hex (RFC 2104), of nested SHA-256."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({scope}, 'utf-8')), 256))), 256)"


def hmac_index(scope: str, key: bytes) -> str:
    return _index(hmac_digest(scope, key))


def table_index(scope: str, seed: int, space: int) -> str:
    """A seeded draw with replacement, reproducible in any SQL engine."""
    return f"cast(conv(substring(sha2(concat_ws('|', '{seed}', {scope}), 256), 1, 8), 16, 10) as bigint) % {space}"


def _doubled(x: str) -> str:
    """A 128-bit block (hex of 32 digits) doubled in GF(2^128), as SQL."""
    hi, lo = f"conv(substring({x}, 1, 16), 16, -10)", f"conv(substring({x}, 17, 16), 16, -10)"
    high = f"shiftleft(cast({hi} as bigint), 1) | shiftrightunsigned(cast({lo} as bigint), 63)"
    low = f"shiftleft(cast({lo} as bigint), 1) ^ if(cast({hi} as bigint) < 0, 135L, 0L)"
    return f"concat(lpad(hex({high}), 16, '0'), lpad(hex({low}), 16, '0'))"


def _xor(x: str, y: str) -> str:
    part = lambda c, n: f"cast(conv(substring({c}, {n}, 16), 16, -10) as bigint)"
    return f"concat(lpad(hex({part(x, 1)} ^ {part(y, 1)}), 16, '0'), lpad(hex({part(x, 17)} ^ {part(y, 17)}), 16, '0'))"


def _block(x: str, key: str) -> str:
    """One raw AES block of 32 hex digits: of the padded encryption the first block."""
    return f"substring(hex(aes_encrypt(unhex({x}), unhex('{key}'), 'ECB', 'PKCS')), 1, 32)"


def _cmac(message: str, key: str, sub1: str, sub2: str) -> str:
    """CMAC (RFC 4493) of a message in hex of any length: a fold over its blocks."""
    n = f"greatest(cast(ceil(length({message}) / 32D) as int), 1)"
    last = f"substring({message}, 32 * ({n} - 1) + 1)"
    closed = f"if(length({last}) = 32, {_xor(last, sub1)}, {_xor(f'rpad(concat({last}, {chr(39)}80{chr(39)}), 32, {chr(39)}0{chr(39)})', sub2)})"
    chain = f"aggregate(sequence(1, {n}), repeat('0', 32), (acc, i) -> {_block(_xor('acc', f'if(i = {n}, {closed}, substring({message}, 32 * (i - 1) + 1, 32))'), key)})"
    return chain


def siv_index(scope: str, type_: str, key: bytes) -> str:
    """AES-SIV (RFC 5297) with the type as associated data: the low 32 bits of the first eight bytes of the synthetic vector.

    ``key`` is the whole key of 32 or 64 bytes; its first half makes the vector,
    and nothing else of the ciphertext is used.
    """
    half = key[: len(key) // 2].hex()
    zero = _block("repeat('0', 32)", half)
    hexed = lambda c: f"hex(encode({c}, 'utf-8'))"
    sub1, sub2 = "k.k1", "k.k2"
    # D = dbl(CMAC(0)) xor CMAC(type); a message of a block or more ends in D, a shorter one is padded and meets dbl(D)
    d = _xor(_doubled(_cmac("repeat('0', 32)", half, sub1, sub2)), _cmac("k.ad", half, sub1, sub2))
    long_ = f"concat(substring(v.m, 1, length(v.m) - 32), {_xor('substring(v.m, length(v.m) - 31)', 'v.d')})"
    short = _xor("rpad(concat(v.m, '80'), 32, '0')", _doubled("v.d"))
    whole = _cmac(f"if(length(v.m) >= 32, {long_}, {short})", half, "v.k1", "v.k2")
    keys_ = f"transform(array({zero}), z -> struct({_doubled('z')} as k1))"
    keys_ = f"transform({keys_}, a -> struct(a.k1 as k1, {_doubled('a.k1')} as k2, {hexed(type_)} as ad, {hexed(scope)} as m))"
    held = f"transform({keys_}, k -> struct({d} as d, k.m as m, k.k1 as k1, k.k2 as k2))"
    vector = f"get(transform({held}, v -> {whole}), 0)"
    return f"cast(conv(substring({vector}, 9, 8), 16, 10) as bigint)"


def placeholder(type_: str) -> str:
    return f"concat('[', case when {type_} = 'LOC' then 'LOCATION' else {type_} end, ']')"


def tag(type_: str, ordinal: str) -> str:
    return f"concat('[', {type_}, '_', {ordinal}, ']')"


def _word_list(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def synthetic(index: str, type_: str) -> str:
    """Pronounceable surrogate: two syllables for persons, three otherwise."""

    def syllable(i: str) -> str:
        return (
            f"concat(element_at({_word_list(ONSET)}, cast(({i}) % {len(ONSET)} as int) + 1), "
            f"element_at({_word_list(NUCLEUS)}, cast((({i}) div 7) % {len(NUCLEUS)} as int) + 1), "
            f"element_at({_word_list(CODA)}, cast((({i}) div 13) % {len(CODA)} as int) + 1))"
        )

    first = f"({index}) % {POOL}"
    parts = [syllable(first), syllable(f"({first}) div 3"), f"case when {type_} = 'PERSON' then '' else {syllable(f'({first}) div 9')} end"]
    whole = f"concat({', '.join(parts)})"
    return f"concat(upper(substring({whole}, 1, 1)), substring({whole}, 2))"


# What a code keeps at its head, and the years a date is drawn from.
URL_PREFIXES = ("https://", "http://", "mailto:", "ftp://", "file://", "www.")
YEARS = (1900, 2099)
_HEAD = "^(?i)((" + "|".join(p.replace(".", "[.]") for p in URL_PREFIXES) + ")*)"
DMY, YMD, TIME = "^([0-9]{1,2})([./-])([0-9]{1,2})([./-])([0-9]{2,4})$", "^([0-9]{4})([./-])([0-9]{1,2})([./-])([0-9]{1,2})$", "^([0-9]{1,2}):([0-9]{2})(:([0-9]{2}))?$"


def _group(c: str, pattern: str, n: int) -> str:
    return f"regexp_extract({c}, '{pattern}', {n})"


def _shaped(c: str, pattern: str) -> str:
    return f"({c} rlike '{pattern}' and {_group(c, pattern, 2)} = {_group(c, pattern, 4)})"


def is_date(c: str) -> str:
    """Whether a code is a real date or time: two-digit years are of this century, four-digit ones within ``YEARS``."""
    day, month, year = (f"cast({_group(c, DMY, n)} as int)" for n in (1, 3, 5))
    dmy = f"length({_group(c, DMY, 5)}) in (2, 4) and ({year} < 100 or {year} between {YEARS[0]} and {YEARS[1]}) and try_to_date(concat_ws('-', if(length({_group(c, DMY, 5)}) = 2, 2000, 0) + {year}, {month}, {day}), 'yyyy-M-d') is not null"
    day, month, year = (f"cast({_group(c, YMD, n)} as int)" for n in (5, 3, 1))
    ymd = f"{year} between {YEARS[0]} and {YEARS[1]} and try_to_date(concat_ws('-', {year}, {month}, {day}), 'yyyy-M-d') is not null"
    hour, minute, second = (f"cast(coalesce(nullif({_group(c, TIME, n)}, ''), '0') as int)" for n in (1, 2, 4))
    return f"case when {_shaped(c, DMY)} then {dmy} when {_shaped(c, YMD)} then {ymd} when {c} rlike '{TIME}' then {hour} < 24 and {minute} < 60 and {second} < 60 else false end"


def _dated(c: str, byte: list[str]) -> str:
    """A date or time of the same shape and widths from key bytes, null for other codes."""
    wide = f"({YEARS[0]} + ({byte[0]} * 256 + {byte[1]}) % {YEARS[1] - YEARS[0] + 1})"
    pad = lambda x, width: f"lpad(cast({x} as string), {width}, '0')"

    def parts(pattern: str, at: tuple[int, int, int]) -> tuple[str, str, str, str, str]:
        day, month, year = (_group(c, pattern, n) for n in at)
        y = f"if(length({year}) = 4, {wide}, {byte[0]} % 100)"
        m = f"({byte[2]} % if(length({month}) = 1, 9, 12) + 1)"
        top = f"day(last_day(make_date(if(length({year}) = 4, {wide}, 2000 + {byte[0]} % 100), {m}, 1)))"
        d = f"({byte[3]} % least({top}, if(length({day}) = 1, 9, 31)) + 1)"
        return pad(d, f"length({day})"), pad(m, f"length({month})"), pad(y, f"length({year})"), _group(c, pattern, 2), y

    d, m, y, sep, _ = parts(DMY, (1, 3, 5))
    dmy = f"concat({d}, {sep}, {m}, {sep}, {y})"
    d, m, y, sep, _ = parts(YMD, (5, 3, 1))
    ymd = f"concat({y}, {sep}, {m}, {sep}, {d})"
    hour = _group(c, TIME, 1)
    clock = f"concat({pad(f'{byte[0]} % if(length({hour}) = 1, 10, 24)', f'length({hour})')}, ':', {pad(f'{byte[1]} % 60', 2)}, if({_group(c, TIME, 4)} = '', '', concat(':', {pad(f'{byte[2]} % 60', 2)})))"
    return f"case when {_shaped(c, DMY)} then {dmy} when {_shaped(c, YMD)} then {ymd} when {c} rlike '{TIME}' then {clock} end"


def format_preserving(source: str, index: str) -> str:
    """URL prefixes kept, dates and times drawn as such, else digit for digit and letter for letter of the same case, from a keystream of hashed (index, counter)."""
    block = f"sha2(concat({index}, ':', (i - 1) div 32), 256)"
    byte = f"cast(conv(substring({block}, 2 * ((i - 1) % 32) + 1, 2), 16, 10) as int)"
    c = "substring(s.rest, i, 1)"
    letters = f"""array_join(transform(sequence(1, greatest(length(s.rest), 1)), i -> case
        when {c} between '0' and '9' then cast({byte} % 10 as string)
        when {c} between 'a' and 'z' then char(97 + {byte} % 26)
        when {c} between 'A' and 'Z' then char(65 + {byte} % 26)
        else {c} end), '')"""
    bytes_ = [f"cast(conv(substring(s.first, {2 * k + 1}, 2), 16, 10) as int)" for k in range(4)]
    head = f"regexp_extract({source}, '{_HEAD}', 1)"
    parts = f"array(struct({head} as head, substring({source}, length({head}) + 1) as rest, sha2(concat({index}, ':', 0), 256) as first))"
    # a lambda over one struct names the parts once
    return f"get(transform({parts}, s -> concat(s.head, coalesce({_dated('s.rest', bytes_)}, {letters}))), 0)"


def redraw(index: str, attempt: str) -> str:
    return f"cast(conv(substring(sha2(concat('redraw:', {index}, ':', {attempt}), 256), 1, 8), 16, 10) as bigint)"
