"""Column expressions on text. Everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """Collapse whitespace and trim; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def strip(c: Column | str) -> Column:
    """Drop white space, newlines included, at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def clean_list(c: Column | str) -> Column:
    return F.array_join(F.transform(col(c), lambda x: clean(x)), " ")


def clean_map(c: Column | str) -> Column:
    pairs = F.transform(
        F.map_entries(col(c)), lambda e: F.concat(e["key"], F.lit(": "), clean(e["value"]))
    )
    return F.array_join(pairs, "; ")


def first_non_blank(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(clean(c), F.lit("")) for c in cols])


def parse_price(c: Column | str) -> Column:
    digits = F.regexp_extract(F.replace(clean(c), F.lit(","), F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def cents(c: Column | str) -> Column:
    """Round half up to two digits."""
    return F.floor(col(c) * 100 + 0.5) / 100


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), group)


def found(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, null when there is none."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def contains_any(c: Column | str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(t)) for t in terms])


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenize(c: Column | str) -> Column:
    """Lower-cased ASCII alphanumeric runs and single CJK characters.

    ASCII letters are lowered before matching, so no per-token step is needed.
    """
    return find_all(F.translate(F.coalesce(col(c), F.lit("")), UPPER, LOWER), fv.TOKEN_PATTERN)


def replace_first(c: Column | str, search: str, replacement: str) -> Column:
    """Replace only the first occurrence of a one-character string."""
    at = F.instr(col(c), F.lit(search))
    return F.when(at > 0, F.overlay(col(c), F.lit(replacement), at, F.lit(len(search)))).otherwise(col(c))


def partial_name(title: Column | str) -> Column:
    """First two distinctive ASCII tokens (four or more characters), else the first two tokens."""
    tokens = find_all(title, r"[A-Za-z0-9][A-Za-z0-9+._-]*")
    distinctive = F.filter(tokens, lambda t: F.length(t) >= 4)
    return F.array_join(F.slice(F.when(F.size(distinctive) > 0, distinctive).otherwise(tokens), 1, 2), " ")


def redact_codes(c: Column | str) -> Column:
    """Mask free-standing six-digit credentials; ids such as ``O000001`` stay."""
    return F.regexp_replace(col(c), r"(?<![A-Za-z0-9])[0-9]{6}(?![A-Za-z0-9])", "[REDACTED]")


def redact_json(c: Column | str) -> Column:
    """Mask credentials in serialised JSON, and any value under ``verification_code``."""
    keyed = F.regexp_replace(
        col(c),
        r'"verification_code"\s*:\s*(?:"(?:[^"\\]|\\.)*"|[^,}\]\s]+)',
        '"verification_code":"[REDACTED]"',
    )
    return redact_codes(keyed)


def glob_to_regex(glob: Column | str) -> Column:
    """Anchored regex for a glob of ``*``, ``?``, ``[seq]`` and ``[!seq]``."""
    quoted = F.regexp_replace(col(glob), r"([.+(){}|^$\\])", r"\\$1")
    starred = F.regexp_replace(F.regexp_replace(quoted, r"\[!", "[^"), r"\*", ".*")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(starred, r"\?", "."), F.lit("$"))


# --- sentences, dates, facts --------------------------------------------


def split_sentences(c: Column | str, min_chars: int = 6) -> Column:
    """Split after 。！？? and newlines, drop source tags and bullets, keep six characters or more."""
    parts = F.split(col(c), r"(?<=[。！？?\n])")
    tidy = F.transform(
        parts,
        lambda p: F.regexp_replace(
            F.regexp_replace(p, r"\[资料[0-9]+\]", ""), r"^[ \n\t\-•]+|[ \n\t\-•]+$", ""
        ),
    )
    return F.filter(tidy, lambda p: F.length(p) >= min_chars)


def answer_sentences(c: Column | str) -> Column:
    """Sentences of an answer with trailing citations pulled before the full stop."""
    moved = F.regexp_replace(col(c), r"([。！？.!?])(\s*(?:\[E[1-9][0-9]*\])+)", "$2$1")
    sentences = split_sentences(moved)
    whole = F.trim(col(c))
    return (
        F.when(F.size(sentences) > 0, sentences)
        .when(F.length(whole) > 0, F.array(whole))
        .otherwise(F.array().cast("array<string>"))
    )


def normalized_dates(c: Column | str) -> Column:
    """ISO, Chinese and English dates as ``yyyy-mm-dd`` strings, in that order.

    Each kind is looked for only in texts with the sign that all its dates have.
    """

    def having(sign: str, dates: Column) -> Column:
        return F.when(F.contains(col(c), F.lit(sign)), dates).when(col(c).isNotNull(), F.array().cast("array<string>"))

    iso = find_all(c, fv.ISO_DATE_PATTERN)
    zh = F.transform(
        find_all(c, fv.ZH_DATE_PATTERN),
        lambda d: F.concat_ws(
            "-",
            F.regexp_extract(d, r"^([0-9]{4})年", 1),
            F.lpad(F.regexp_extract(d, r"年([0-9]{1,2})月", 1), 2, "0"),
            F.lpad(F.regexp_extract(d, r"月([0-9]{1,2})日", 1), 2, "0"),
        ),
    )
    months = F.array(*[F.lit(m[:3]) for m in fv.MONTH_NAMES])
    en = F.transform(
        find_all(c, fv.EN_DATE_PATTERN),
        lambda d: F.concat_ws(
            "-",
            F.regexp_extract(d, r"([0-9]{4})$", 1),
            F.lpad(F.array_position(months, F.lower(F.substring(d, 1, 3))).cast("string"), 2, "0"),
            F.lpad(F.regexp_extract(d, r"\s([0-9]{1,2}),", 1), 2, "0"),
        ),
    )
    return F.concat(having("-", iso), having("年", zh), having(",", en))


def mask_dates(c: Column | str) -> Column:
    """Dates as blanks; each kind is looked for only in texts with the sign that all its dates have."""
    out = col(c)
    for sign, pattern in ((",", fv.EN_DATE_PATTERN), ("年", fv.ZH_DATE_PATTERN), ("-", fv.ISO_DATE_PATTERN)):
        out = F.when(F.contains(col(c), F.lit(sign)), F.regexp_replace(out, pattern, " ")).otherwise(out)
    return out


_STATUS_WORDS = sorted(fv.STATUS_TERMS + ["available"], key=len, reverse=True)
#: a status word, looked for only where a letter stands that begins one
_STATUS_WORD = f"(?=[{''.join(sorted({t[0] for t in _STATUS_WORDS}))}])({'|'.join(_STATUS_WORDS)})"


def status_facts(masked: Column, lowered: Column | None = None) -> Column:
    """Status words in a text, longest term first, so a term inside a longer one is not counted."""
    lowered = F.lower(masked) if lowered is None else lowered
    hits = F.regexp_extract_all(lowered, F.lit(_STATUS_WORD), F.lit(1))
    near_stock = lowered.rlike(
        r"(?:库存|存货|缺货|有货)[^。！？.!?]{0,12}\bavailable\b|\bavailable\b[^。！？.!?]{0,12}(?:库存|存货)"
    )
    return F.filter(hits, lambda t: (t != "available") | near_stock)


def facts(c: Column | str, masked: Column | None = None, lowered: Column | None = None) -> Column:
    """Distinct ids, dates, measured numbers and status words of a sentence.

    ``masked`` is the sentence without its dates and ``lowered`` that in lower case, as columns of their own.
    """
    masked = mask_dates(c) if masked is None else masked
    found_all = F.concat(
        find_all(masked, fv.ID_FACT_PATTERN),
        normalized_dates(c),
        find_all(masked, fv.NUMERIC_FACT_PATTERN),
        status_facts(masked, lowered),
    )
    return F.array_distinct(F.filter(F.transform(found_all, lambda f: F.trim(f)), lambda f: f != ""))


def despace(c: Column | str) -> Column:
    """Lower case without white space, character by character of what ``\\s`` matches: no regex to run on every row."""
    return reduce(lambda out, blank: F.replace(out, F.lit(blank), F.lit("")), " \t\n\x0b\f\r", F.lower(col(c)))
