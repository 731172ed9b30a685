r"""Text functions for Arabic and other scripts, as expressions of built-in functions.

Null is empty unless a function says otherwise. White space is Unicode's, with U+001C to U+001F: Java's `\s` and `trim` know
less, so that WS is used everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

WS = r"(?U)[\s\x1C-\x1F]+"
#: Marks that are deleted, by function, and letters that are folded.
MARKS_SEARCH = r"[ً-ٕ]"
MARKS_WIDE = r"[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ]"
MARKS_NARROW = r"[ؐ-ًؚ-ٰٟ]"
NAME_PUNCTUATION = r"""[.,،؛;:؟?!"'«»\-_/\\]"""
#: Words that open a transmission, and honorifics that end a name, each list in its order of use.
TRANSMISSION_WORDS = ["حدثنا", "أخبرنا", "حدثني", "أخبرني", "سمعت", "عن", "قال"]
HONORIFICS = ["رضي الله عنه", "رضي الله عنها", "رضي الله عنهم", "رضي الله عنهما", "صلى الله عليه وسلم", "عليه السلام", "رحمه الله", "رحمها الله", "أم المؤمنين", "الصحابي", "التابعي"]
#: Names that several persons share, and single words that aren't a person's ambiguous name.
AMBIGUOUS_NAMES = ["سفيان", "حماد", "إسماعيل", "هشام", "يحيى", "إبراهيم", "عمرو", "عبيد الله", "عبد الله", "أبيه", "أبي", "شعبة", "سعيد", "الحكم", "موسى", "مسلم", "خالد", "الليث", "مالك", "ثابت", "قتادة", "سليمان"]
NOT_AMBIGUOUS = ["النبي", "رسول الله"]
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
DASH = "[-–—]"


def _s(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def trim_ws(c) -> Column:
    return F.regexp_replace(_s(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def normalize_whitespace(c) -> Column:
    return F.regexp_replace(trim_ws(c), WS, " ")


def normalize_arabic(c) -> Column:
    """Trim, collapse, delete the tatweel, fold hamza carriers; diacritics stay."""
    return F.translate(normalize_whitespace(c), "أإآؤئـ", "اااوي")


def normalize_for_search(c) -> Column:
    return F.regexp_replace(normalize_arabic(c), MARKS_SEARCH, "")


def strip_marks(c, wide: bool = True) -> Column:
    return F.regexp_replace(_s(c), MARKS_WIDE if wide else MARKS_NARROW, "")


def normalize_name(c) -> Column:
    """The key by which names are compared: no marks, brackets or punctuation, letters folded, a leading waw dropped."""
    x = F.regexp_replace(strip_marks(c), r"\p{Mn}", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\(.*?\)", ""), NAME_PUNCTUATION, "")
    x = F.translate(x, "أإآئؤةى", "ااايوهي")
    return normalize_whitespace(F.regexp_replace(x, r"(?U)^و[\s\x1C-\x1F]*", ""))


def clean_person_name(c) -> Column:
    x = normalize_whitespace(c)
    x = reduce(lambda y, w: F.regexp_replace(y, rf"(?U)^{w}\s+", ""), TRANSMISSION_WORDS, x)
    return normalize_whitespace(reduce(lambda y, w: F.regexp_replace(y, rf"(?U)\s+{w}.*", ""), HONORIFICS, x))


def trim_name_tail(c) -> Column:
    return F.regexp_replace(trim_ws(c), "[،:,]+$", "")


def strip_leading(c, chars: str = ": ") -> Column:
    """Delete any of chars at the start: a set, not a prefix."""
    return F.ltrim(_s(c), F.lit(chars))


def strip_number(c) -> Column:
    return trim_ws(F.regexp_replace(_s(c), rf"(?U)^[{ARABIC_DIGITS}0-9\s]+{DASH}+\s*", ""))


def _number(digits: Column) -> Column:
    return F.nullif(F.translate(digits, ARABIC_DIGITS, "0123456789"), F.lit("")).try_cast("int")


def extract_number(c) -> Column:
    """Leading digits, ASCII or Arabic-Indic; null without."""
    return _number(F.regexp_extract(trim_ws(c), rf"^([{ARABIC_DIGITS}0-9]+)", 1))


def arabic_index(c) -> Column:
    """Leading Arabic-Indic digits only."""
    return _number(F.regexp_extract(trim_ws(c), rf"^([{ARABIC_DIGITS}]+)", 1))


def all_indices(c, fallback: Column | None = None, least: int = 1, most: int | None = None) -> Column:
    """Every number before a dash (a bracketed note may stand between) from least to most (unbounded by default); else the fallback alone."""
    found = F.regexp_extract_all(_s(c), F.lit(rf"(?<![0-9{ARABIC_DIGITS}])([0-9{ARABIC_DIGITS}]+)\s*(?:\([^)]*\)\s*)?{DASH}"), F.lit(1))
    kept = F.filter(F.transform(found, _number), lambda x: (x >= least) & (x <= most) if most is not None else x >= least)
    other = F.array(fallback.cast("int")) if fallback is not None else F.array().cast("array<int>")
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(other, lambda x: x.isNotNull()))


def section_id(href) -> Column:
    return _number(F.regexp_extract(_s(href), r"/book/\d+/(\d+)", 1))


def url_id(url, kind: str = "narrator") -> Column:
    return F.nullif(F.regexp_extract(_s(url), rf"/{kind}/(\d+)", 1), F.lit(""))


def url_ids(text, kind: str = "people") -> Column:
    return F.array_distinct(F.regexp_extract_all(_s(text), F.lit(rf"/{kind}/(\d+)"), F.lit(1)))


def first_word(c) -> Column:
    """The first word after a number; null if it is all digits or there is none."""
    w = F.split(strip_number(c), WS)[0]
    return F.when((w != "") & ~w.rlike(r"(?U)^\d+$"), w)


def is_arabic_heavy(c) -> Column:
    return F.length(F.regexp_replace(_s(c), "[^؀-ۿ]", "")) > 20


def is_ambiguous(c) -> Column:
    name = trim_ws(c)
    return name.isin(AMBIGUOUS_NAMES) | ((F.size(F.split(name, WS)) == 1) & (name != "") & ~name.isin(NOT_AMBIGUOUS))


def clean_key(c) -> Column:
    return trim_ws(F.regexp_replace(normalize_whitespace(F.translate(_s(c), "：", ":")), ":$", ""))


def dedup_lines(c) -> Column:
    """Trim lines, drop blank ones and those equal to the line before."""
    lines = F.filter(F.transform(F.split(_s(c), "\n"), trim_ws), lambda x: x != "")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.try_element_at(lines, i)))
    return F.array_join(kept, "\n")


def absolute_url(c, host: str) -> Column:
    u = _s(c)
    return F.when(u.startswith("/"), F.concat(F.lit(host.rstrip("/")), u)).otherwise(u)


def format_chain(names: Column, arrow: str = " → ") -> Column:
    return F.array_join(names, arrow)


def escape_quotes(c, double: bool = False) -> Column:
    x = F.replace(F.replace(_s(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.replace(x, F.lit('"'), F.lit('\\"')) if double else x


def token_prefixes(tokens: Column) -> Column:
    """Prefixes of n - 1 to 1 tokens, longest first."""
    n = F.size(tokens)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(tokens, F.lit(1), i), " "))).otherwise(F.array().cast("array<string>"))


def preview(c, n: int = 200) -> Column:
    x = _s(c)
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("..."))).otherwise(x)


def person_hash_id(c) -> Column:
    return F.concat(F.lit("NAR_"), F.upper(F.left(F.sha2(c, 256), F.lit(12))))


def iso_utc(ts) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second, with Z. The session's zone doesn't matter."""
    at = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def prefixed_id(prefix: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), *parts)


def chains_json(names: Column, chains: Column) -> Column:
    """{"chain_1": "a → b", ...} from parallel arrays; an error object without any."""
    return F.when(F.size(names) > 0, F.to_json(F.map_from_arrays(names, chains))).otherwise(F.lit('{"error":"no chains"}'))


def hrefs(json_text) -> Column:
    """All href values of a JSON text, at any depth."""
    return F.array_distinct(F.regexp_extract_all(_s(json_text), F.lit(r'"href"\s*:\s*"([^"]+)"'), F.lit(1)))


def breadcrumb(links: Column, place: int) -> Column:
    """Element at a 0-based place, null beyond the end."""
    return F.try_element_at(links, F.lit(place + 1))


def drop_empty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull() & (x != ""))


def unique_lead_first(chains: Column, name: str = "name") -> Column:
    """Members of array<array<struct>> with each chain reversed, the first of each name."""
    flat = F.flatten(F.transform(chains, F.reverse))
    names = F.transform(flat, lambda x: x[name])
    return F.filter(flat, lambda x, i: F.array_position(names, x[name]) == i + 1)
