"""Text functions as Column expressions: folding, tokens, segments, redaction, typed values."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import patterns as P

MAX_SPELLINGS = 500_000  # that a worker remembers
#: Unicode's white space: what (?U)\s stands for.
_WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Up to U+036F only U+00AD is a format control and none looks alike; nor does a dash, a quotation mark or the euro sign.
_MAY_LOOK_ALIKE = r"[^\x00-\x{00ac}\x{00ae}-\x{036f}\x{2010}-\x{2027}\x{20ac}]"
#: What ends a line for str.splitlines().
_LINE_ENDS = r"\r\n|[\n\r\x{000b}\x{000c}\x{001c}-\x{001e}\x{0085}\x{2028}\x{2029}]"


@lru_cache(maxsize=1)
def _ascii_of_characters() -> tuple[str, str, dict[str, str]]:
    """By rule: which characters become one ASCII character by compatibility decomposition, and which several."""
    source, target, longer = [], [], {}
    for code in (*range(0x80, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        plain = unicodedata.normalize("NFKD", chr(code).casefold()).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
        elif plain:
            longer[chr(code)] = plain
    return "".join(source), "".join(target), longer


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITE))


def let(value: Column, body) -> Column:
    """body(value); as an element of an array it is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def constant_map(values: dict[str, str]) -> Column:
    """A map as one literal, which the optimizer folds: quick to build, however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


@lru_cache(maxsize=1)
def _longer() -> tuple[str, dict[str, str]]:
    """The characters that become several, as a pattern and with what they become."""
    longer = _ascii_of_characters()[2]
    ranges: list[list[int]] = []
    for code in sorted(map(ord, longer)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    # A class is tried range by range; ASCII characters are passed over before.
    return r"(?=[^\x00-\x7F])[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]", longer


def fold(text: Column) -> Column:
    """Lower case, compatibility decomposition, ASCII only: what is left of other characters is dropped."""
    source, target, _ = _ascii_of_characters()
    any_longer, longer = _longer()
    table = constant_map(longer)  # looked up only in texts that hold such a character

    def plain(lowered: Column) -> Column:
        parts = F.regexp_extract_all(lowered, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
        spelled = F.array_join(F.transform(parts, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        single = F.when(lowered.rlike(any_longer), spelled).otherwise(lowered)
        return F.regexp_replace(F.translate(single, source, target), r"[^\x00-\x7F]+", "")

    return F.when(text.rlike(r"[^\x00-\x7F]"), let(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), plain)).otherwise(F.lower(text))


def normalize(text: Column) -> Column:
    """Folded words with one space between."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def strong_fold(text: Column) -> Column:
    """normalize() after format controls go and look-alike letters become Latin; `over ride` is one word."""
    latin = F.translate(F.lower(F.regexp_replace(text, r"\p{Cf}", "")), "".join(map(chr, P.HOMOGLYPHS)), "".join(P.HOMOGLYPHS.values()))
    folded = let(F.when(text.rlike(_MAY_LOOK_ALIKE), latin).otherwise(text), normalize)
    return let(folded, lambda t: F.when(t.contains("ride"), F.regexp_replace(t, r"\bover\s+ride\b", "override")).otherwise(t))


def squeeze(text: Column) -> Column:
    """Lower case with one space between words."""
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def stem(token: Column) -> Column:
    """Without the first suffix that leaves more than three letters."""
    out = F.when(F.lit(False), token)
    for suffix in P.STEM_SUFFIXES:
        out = out.when((F.length(token) > len(suffix) + 3) & token.endswith(suffix), F.substring(token, F.lit(1), F.length(token) - len(suffix)))
    return out.otherwise(token)


def _canonical(token: Column) -> Column:
    table = constant_map(P.CANONICAL_TOKENS)
    return F.coalesce(F.try_element_at(table, token), token)


def lexical_tokens(text: Column) -> Column:
    """The set of canonical tokens: stop words go before stemming."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*P.STOPWORDS))
    return F.array_distinct(F.transform(kept, lambda w: _canonical(stem(w))))


def canonical_of(word: str) -> str | None:
    """stem() and the canonical form of one folded word; None for a stop word."""
    if word in P.STOPWORDS:
        return None
    stemmed = next((word[: -len(s)] for s in P.STEM_SUFFIXES if len(word) > len(s) + 3 and word.endswith(s)), word)
    return P.CANONICAL_TOKENS.get(stemmed, stemmed)


def lexical_tokens_among(text: Column, words: Iterable[str] | None) -> Column:
    """Those of lexical_tokens() that are among the words; None for all.

    A text's words recur, so each spelling is looked at once a worker; Column
    functions would stem every word of every text anew.
    """
    wanted = None if words is None else frozenset(words)

    @F.pandas_udf("array<string>")
    def among(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str | None] = {}

        def of(folded: str) -> list[str]:
            found = {}
            for word in re.findall("[a-z0-9]+", folded):
                if word in known:
                    token = known[word]
                else:
                    token = canonical_of(word)
                    token = token if wanted is None or token in wanted else None
                    if len(known) < MAX_SPELLINGS:
                        known[word] = token
                if token is not None:
                    found[token] = None
            return list(found)

        for part in parts:
            yield part.map(of)

    return among(fold(F.coalesce(text, F.lit(""))))


def placed_tokens(text: Column) -> Column:
    """Canonical tokens with their places from 1, repeats included; stop words have places, but go."""
    words = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1).alias("place")))
    kept = F.filter(placed, lambda x: ~x["word"].isin(*P.STOPWORDS))
    return F.transform(kept, lambda x: F.struct(_canonical(stem(x["word"])).alias("word"), x["place"].alias("place")))


def document_scope(text: Column) -> Column:
    folded = fold(text)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, scope in P.SCOPES:
        out = out.when(folded.rlike(pattern), F.lit(scope))
    return out


def _pieces(text: Column, boundary: str, lines: str) -> Column:
    parts = F.flatten(F.transform(F.split(text, lines), lambda line: F.split(strip(line), boundary)))
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def segments(text: Column) -> Column:
    """Lines, cut after . ! ? before a capital."""
    return _pieces(text, r"(?U)(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ])", _LINE_ENDS)


def statements(text: Column) -> Column:
    """Lines without bullets, cut after . ! ? before a capital or a digit."""
    return F.filter(F.transform(_pieces(text, r"(?U)(?<=[.!?])\s+(?=[A-ZÀ-ÖØ-Þ0-9])", _LINE_ENDS), lambda s: strip(F.regexp_replace(s, r"^[•\s]+", ""))), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Lines ended by U+000A, cut after . ! ?"""
    return _pieces(text, r"(?U)(?<=[.!?])\s+", r"\n")


def redact(text: Column, data: tuple = P.PERSONAL_DATA) -> Column:
    """struct(text, counts): personal data by their kind's placeholder; counts without zeros. A kind that is named twice is looked for twice."""

    def rest(kinds: tuple, out: Column, found: dict[str, Column]) -> Column:
        if not kinds:
            counts = F.map_filter(F.create_map(*(x for name, n in found.items() for x in (F.lit(name), n))), lambda _, n: n > 0)
            return F.struct(out.alias("text"), counts.alias("counts"))
        name, pattern, placeholder, sign = kinds[0]
        held = out.rlike(sign)
        count = F.when(held, F.regexp_count(out, F.lit(pattern))).otherwise(0)
        count = found[name] + count if name in found else count
        return let(F.when(held, F.regexp_replace(out, pattern, placeholder)).otherwise(out), lambda t: rest(kinds[1:], t, {**found, name: count}))

    return rest(data, text, {})


def instructs(folded: Column, product: str | None = None) -> Column:
    """Whether strongly folded text gives instructions; `product` is what the reading system is called, if it may be addressed by name."""
    # A dot stands for any character but a line feed.
    hit = F.lit(False)
    for pattern in P.untrusted(product):
        hit = hit | folded.rlike(f"(?d){pattern}")
    return hit | (folded.rlike(f"(?d){P.DISCLOSURE}") & ~folded.rlike(f"(?d){P.PROHIBITION}"))


def may_instruct(folded: Column, product: str | None = None) -> Column:
    """A word that every instruction has one of: without any, instructs() is false."""
    return folded.rlike(rf"\b(?:{P.trigger(product)})")


def untrusted(text: Column, product: str | None = None) -> Column:
    """Whether a document's text gives instructions to whoever reads it, rather than states facts."""
    folded = strong_fold(F.coalesce(text, F.lit("")))
    # As an element of an array the text is folded once, however many patterns look at it.
    told = F.transform(F.array(folded), lambda t: F.when(may_instruct(t, product), instructs(t, product)).otherwise(False))
    return F.get(told, F.lit(0))


def zoned_time(text: Column) -> Column:
    """A struct of the instant that an ISO time stamp names, and what is wrong if it names none: missing, invalid, or no_timezone."""
    shape = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
    zoned = text.rlike(r"[T ].*(?:Z|[+-]\d{2}(?::?\d{2})?)$")
    # The parts that may be left out are spelled out: seconds, and minutes of the offset.
    full = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"([T ]\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00"), r"([T ]\d{2})(?=Z|[+-]|$)", "$1:00:00")
    full = F.regexp_replace(F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    at = F.when(text.rlike(shape), F.try_to_timestamp(full))
    error = F.when(text.isNull(), "missing").when(at.isNull(), "invalid").when(~zoned, "no_timezone")
    return F.struct(F.when(error.isNull(), at).alias("at"), error.alias("error"))


def same_question(text: Column) -> Column:
    """A question as it is compared with others: in lower case and without the word, or the number of a list, that it begins with."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[a-z0-9]+[.:\- )]*", ""))


def source_path(filename: Column, path: Column, generated: str = "datasets/generated") -> Column:
    """Where a corpus document's file is: PDF files are generated, others are where the manifest says."""
    return F.when(filename.endswith(".pdf"), F.concat(F.lit(f"{generated}/"), filename)).otherwise(path)


def iso_date(text: Column) -> Column:
    """YYYY-MM-DD from ISO, DD/MM/YYYY and English and French names; else the normalised text. No calendar check."""
    raw, folded = strip(text), normalize(text)
    months = F.create_map(*(F.lit(x) for pair in P.MONTH_NUMBERS.items() for x in pair))
    iso, slash = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{2})/(\d{2})/(\d{4})\b"
    day_first, month_first = r"\b(\d{1,2})(?:er)?\s+([a-z]+)\s+(\d{4})\b", r"\b([a-z]+)\s+(\d{1,2})\s+(\d{4})\b"

    def group(source: Column, pattern: str, i: int) -> Column:
        return F.regexp_extract(source, pattern, i)

    def named(pattern: str, day: int, month: int) -> Column:
        number = F.try_element_at(months, group(folded, pattern, month))
        return F.when(number.isNotNull(), F.concat_ws("-", F.lpad(group(folded, pattern, 3), 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(group(folded, pattern, day).cast("int").cast("string"), 2, "0")))

    return F.coalesce(
        F.when(raw.rlike(iso), F.concat_ws("-", *(group(raw, iso, i) for i in (1, 2, 3)))),
        F.when(raw.rlike(slash), F.concat_ws("-", *(group(raw, slash, i) for i in (3, 2, 1)))),
        named(day_first, 1, 2),
        named(month_first, 2, 1),
        folded,
    )


def _money_number(raw: Column) -> Column:
    """Digits without separators; one or two digits after the last separator are decimals."""
    compact = F.regexp_replace(raw, r"[\s\x{00a0}\x{202f}']", "")
    decimals = F.regexp_extract(compact, r"[.,](\d{1,2})$", 1)
    whole = F.when(decimals != "", F.regexp_replace(compact, r"[.,]\d{1,2}$", "")).otherwise(compact)
    # Where a separator recurs, only the last sets decimals off; digits before it are joined.
    digits = F.regexp_replace(F.regexp_replace(whole, r"\D", ""), "^0+(?=[0-9])", "")
    rest = F.regexp_replace(decimals, "0+$", "")
    return F.when(rest != "", F.concat(F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")), F.lit("."), rest)).otherwise(digits)


def money_values(text: Column) -> Column:
    """Distinct CUR:number in order; `:number` if a lone number has no currency."""
    raw = strip(text)
    pair = f"(?iu)(?:({P.CURRENCY})\\s*({P.MONEY_NUMBER})|({P.MONEY_NUMBER})\\s*({P.CURRENCY}))"
    codes = F.create_map(*(F.lit(x) for item in P.CURRENCY_CODES.items() for x in item))
    groups = F.arrays_zip(*(F.regexp_extract_all(raw, F.lit(pair), F.lit(i)).alias(f"g{i}") for i in (1, 2, 3, 4)))
    named = F.transform(groups, lambda g: F.concat_ws(":", F.try_element_at(codes, F.upper(F.concat(g["g1"], g["g4"]))), _money_number(F.concat(g["g2"], g["g3"]))))
    lone = F.regexp_extract_all(raw, F.lit(P.MONEY_NUMBER), F.lit(0))
    return F.when(F.size(named) > 0, F.array_distinct(named)).when(F.size(lone) == 1, F.transform(lone, lambda n: F.concat(F.lit(":"), _money_number(n)))).otherwise(F.array().cast("array<string>"))


def value_matches(actual: Column, expected: Column, kind: Column) -> Column:
    """Typed equality: money by any common value, dates by their ISO form, text also by containment of three words or more."""
    a, b = normalize(actual), normalize(expected)
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    contained = (F.size(F.split(short, " ")) >= 3) & F.contains(long, short)
    return F.when(kind == "money", F.arrays_overlap(money_values(actual), money_values(expected))).when(kind == "date", iso_date(actual) == iso_date(expected)).otherwise((a == b) | contained)


def safe_name(filename: Column) -> Column:
    return F.element_at(F.split(F.replace(filename, F.lit("\\"), F.lit("/")), "/"), -1)


def storage_key(document_id: Column, filename: Column) -> Column:
    """`id/document.ext` for the three kinds of files that are taken; else null."""
    suffix = F.lower(F.regexp_extract(safe_name(filename), r"\.[^.]+$", 0))
    return F.when(suffix.isin(".pdf", ".txt", ".md"), F.concat(document_id, F.lit("/document"), suffix))
