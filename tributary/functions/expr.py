"""Scalar functions as native Column expressions: everything here stays in the JVM and inside whole-stage code generation.

Nulls give null unless a docstring says otherwise.  Python's ``strip`` removes all white space, SQL's TRIM spaces only; both
exist here (``strip`` and ``F.trim``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------------------------------------

#: Words that an organisation's legal form or grammar adds to its name.
LEGAL_SUFFIXES = (
    "INC", "INCORPORATED", "LTD", "LIMITED", "LTEE", "CORP", "CORPORATION", "FOUNDATION", "FONDATION", "SOCIETY", "SOCIETE",
    "ASSOCIATION", "ASSOC", "ORGANIZATION", "ORGANISATION", "TRUST", "CHARITABLE", "CHARITY", "CHARITE", "OF", "THE", "DE", "DU",
    "LA", "LE", "LES", "AND", "ET",
)
#: What discovery's normalisation drops besides.
DISCOVERY_SUFFIXES = (*LEGAL_SUFFIXES, "ENR")
#: Words without distinguishing value when names are scored: connectors, then categories.
SCORING_STOPWORDS = (
    "DES", "POUR", "EN", "AU", "AUX",
    "MONTREAL", "QUEBEC", "CANADA", "CENTRE", "EGLISE", "CLUB", "SAINT", "ST", "COMMUNAUTAIRE", "MAISON", "PETITE", "ENFANCE",
    "ECOLE", "CONGREGATION", "INSTITUT", "QUEBECOISE", "PAROISSE", "THEATRE", "INTERNATIONAL", "CHURCH", "FABRIQUE", "EVANGELIQUE",
    "SANTE", "GROUPE", "FEDERATION", "DEVELOPPEMENT", "COMMUNAUTE", "SYNDICAT", "FONDS", "ACTION",
)
#: Words after a comma that show a company rather than a person's first name.
CORPORATE_SUFFIXES = ("INC", "LTD", "LTEE", "LTÉE", "CORP", "LLC", "LLP", "CO", "LIMITED", "INCORPORATED", "ULC", "SA", "SARL", "SENC")
#: Letters without a decomposition, as match keys write them.
TRANSLITERATED = {"Œ": "OE", "œ": "oe", "Æ": "AE", "æ": "ae", "ß": "ss", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "ı": "i", "–": "-", "—": "--", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...", "•": "*", "€": "EUR", "«": "<<", "»": ">>", "°": "deg", "№": "No", " ": " "}
#: Municipalities of one island, as registries write them.
ISLAND_MUNICIPALITIES = (
    "MONTREAL", "MONTRÉAL", "BAIE-D'URFE", "BAIE-D'URFÉ", "BEACONSFIELD", "COTE-SAINT-LUC", "CÔTE-SAINT-LUC", "DOLLARD-DES-ORMEAUX",
    "DORVAL", "HAMPSTEAD", "KIRKLAND", "L'ILE-DORVAL", "L'ÎLE-DORVAL", "MONTREAL-EST", "MONTRÉAL-EST", "MONTREAL-OUEST", "MONTRÉAL-OUEST",
    "MONT-ROYAL", "TOWN OF MOUNT ROYAL", "POINTE-CLAIRE", "SAINTE-ANNE-DE-BELLEVUE", "SENNEVILLE", "WESTMOUNT",
)
ISLAND_FSA_PREFIXES = ("H1", "H2", "H3", "H4", "H8", "H9")
#: What a word of a person's name looks like, in two kinds of schedules.
_WORD = r"[A-Za-zÀ-ÿ'\-]+"
_GIVEN = r"[A-ZÀ-Þ][A-Za-zÀ-ÿ'\-\.]*"
#: A raw name of just this length was probably cut off.
TRUNCATED_LENGTH = 60


def _accented() -> tuple[str, str]:
    """Letters of Latin-1 to Latin Extended-B, and of Latin Extended Additional, that are one base letter with marks, and those base letters."""
    source, target = [], []
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and unicodedata.combining(parts[1]) and parts[0].isascii():
            source.append(chr(c))
            target.append(parts[0])
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accented()


# --- text -----------------------------------------------------------------------------------------------------------------


def strip(x: Column) -> Column:
    """Without any white space at either end."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def squeezed(x: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_accents(x: Column) -> Column:
    """Letters without their marks; letters that aren't a base letter with marks stay."""
    return F.translate(x, ACCENTED, PLAIN)


def fold(x: Column) -> Column:
    """The form that searches compare: squeezed, without accents, lower case."""
    return F.lower(strip_accents(squeezed(x)))


def transliterate(x: Column) -> Column:
    """ASCII for match keys; characters without a transliteration go."""
    x = strip_accents(x)
    for a, b in TRANSLITERATED.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, r"[^\x00-\x7F]", "")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def _kept(tokens: Column, dropped: Sequence[str]) -> Column:
    """The tokens without the dropped words, as one string; all of them if nothing were left."""
    kept = F.filter(tokens, lambda w: ~w.isin(*dropped))
    return F.concat_ws(" ", F.when(F.size(kept) > 0, kept).otherwise(tokens))


def normalize_name(x: Column, dropped: Sequence[str] = LEGAL_SUFFIXES) -> Column:
    """Match key of a name that has no markup: part before "|", ASCII upper case, letters and digits, without legal suffixes.
    Null gives an empty string."""
    plain = F.regexp_replace(F.upper(transliterate(F.split_part(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(1)))), r"[^A-Z0-9 ]", " ")
    return _kept(words(plain), dropped)


def normalize_org_name(x: Column) -> Column:
    return normalize_name(x, DISCOVERY_SUFFIXES)


def normalize_for_scoring(x: Column) -> Column:
    """For scores only: discovery's key without single letters and words that say little; the key itself if nothing is left."""
    base = normalize_org_name(x)
    kept = F.filter(words(base), lambda w: (F.length(w) > 1) & ~w.isin(*SCORING_STOPWORDS))
    return F.when(F.size(kept) > 0, F.concat_ws(" ", kept)).otherwise(base)


def display_name(x: Column) -> Column:
    return strip(F.split_part(x, F.lit("|"), F.lit(1)))


def name_variants(x: Column) -> Column:
    """The name itself and, if it has "/", its non-blank parts."""
    halves = F.filter(F.transform(F.split(x, "/"), strip), lambda p: p != "")
    return F.when(x.isNull(), F.array().cast("array<string>")).when(x.contains("/"), F.array_distinct(F.concat(F.array(x), halves))).otherwise(F.array(x))


def slugify(x: Column) -> Column:
    """Lower case, with runs of anything but ASCII letters and digits as one hyphen; "org" if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit("")), F.lit("org"))


def english_name(x: Column) -> Column:
    """The part of a bilingual name before "|"."""
    return display_name(x)


def word_start(column: Column, query: str) -> Column:
    """Whether the query begins at the start of a word of the (folded) column; all its characters are literal."""
    literal = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return column.rlike(f"(^|[^a-zA-Z0-9]){literal}")


def like_escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def verbatim(quote: Column, text: Column) -> Column:
    """Whether the quote is not blank and occurs in the text, up to case and white space."""
    q, t = F.lower(squeezed(quote)), F.lower(squeezed(text))
    return F.coalesce((q != "") & t.contains(q), F.lit(False))


def has_keyword(columns: Sequence[Column], keywords: Sequence[str]) -> Column:
    """Whether any keyword occurs in the columns' text."""
    text = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(False)
    for k in sorted(keywords):
        out = out | text.contains(k.lower())
    return out


# --- identifiers ----------------------------------------------------------------------------------------------------------


def _compact_bn(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(F.upper(raw)), r"^(?:ARC|CRA)\s*", ""), r"[\s.\-]", "")


def normalize_bn(raw: Column) -> Column:
    """The nine-digit root of a business number, with or without a program account; null for anything else."""
    compact = _compact_bn(raw)
    return F.when(compact.rlike(r"^[0-9]{9}(?:(?:RR|RT|RP|RC)[0-9]{4})?$"), F.substring(compact, 1, 9))


def bn_reject_shape(raw: Column) -> Column:
    """What a rejected number looks like: "blank", "n digits" or "non-numeric"."""
    compact = F.coalesce(_compact_bn(raw), F.lit(""))
    return F.when(compact == "", "blank").when(compact.rlike(r"^[0-9]+$"), F.concat(F.length(compact).cast("string"), F.lit(" digits"))).otherwise("non-numeric")


def valid_crn(raw: Column) -> Column:
    """The root of a registration number that is just nine digits, or those and RR with four; null otherwise."""
    x = strip(raw)
    return F.when(x.rlike(r"^[0-9]{9}(RR[0-9]{4})?$"), F.substring(x, 1, 9))


def normalize_postal(raw: Column) -> Column:
    x = F.upper(F.regexp_replace(raw, r"\s+", ""))
    return F.when(x.rlike(r"^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$"), x)


def fsa(postal: Column) -> Column:
    return F.substring(postal, 1, 3)


def block_key(province: Column, norm: Column) -> Column:
    return F.concat(F.substring(F.upper(strip(F.coalesce(province, F.lit("")))), 1, 2), F.lit("|"), F.substring(norm, 1, 4))


def name_prefix(norm: Column) -> Column:
    return F.substring(norm, 1, 4)


def individual_donee(name: Column) -> Column:
    """Two words with two or more spaces between, and perhaps a nickname in parentheses: the shape of a person's name in gift schedules."""
    return F.coalesce(strip(name).rlike(rf"^{_WORD}  +{_WORD}(\s*\([^)]*\))?$"), F.lit(False))


def individual_comma(name: Column) -> Column:
    """"Last, First": capitalised after the comma, and no corporate suffix there."""
    x = strip(name)
    first = F.regexp_extract(x, r",\s*(\S+)", 1)
    corporate = F.upper(F.regexp_replace(first, r"\.+$", "")).isin(*CORPORATE_SUFFIXES)
    return F.coalesce(x.rlike(rf"^{_WORD},\s*{_GIVEN}(\s+{_GIVEN})?(\s*\([^)]*\))?$") & ~corporate, F.lit(False))


def digit_tokens(norm: Column, raw_length: Column | None = None) -> Column:
    """The sorted distinct words with a digit, a single letter after a number joined to it ("1 B" is "1B").

    The last letter of a name that was probably cut off at 60 characters is dropped instead."""
    tokens = words(norm)
    cut = F.lit(False) if raw_length is None else F.coalesce(raw_length == TRUNCATED_LENGTH, F.lit(False))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(0).alias("at"))

    def step(state: Column, token: Column) -> Column:
        done, at = state["done"], state["at"] + 1
        last = F.try_element_at(done, F.lit(-1))
        joins = token.rlike("^[A-Z]$") & F.coalesce(last.rlike("^[0-9]+$"), F.lit(False))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        fused = F.when(cut & (at == F.size(tokens)), done).otherwise(F.concat(head, F.array(F.concat(last, token))))
        return F.struct(F.when(joins, fused).otherwise(F.concat(done, F.array(token))).alias("done"), at.alias("at"))

    fused = F.aggregate(tokens, start, step, lambda s: s["done"])
    return F.array_sort(F.array_distinct(F.filter(fused, lambda t: t.rlike("[0-9]"))))


def digit_tokens_match(a: Column, b: Column) -> Column:
    """Other tokens must be the same; years (1800 to 2099) too, but only if both sides have some."""
    year = lambda t: t.rlike("^(?:18|19|20)[0-9]{2}$")
    other = lambda x: F.filter(x, lambda t: ~year(t))
    years = lambda x: F.filter(x, year)
    return (other(a) == other(b)) & ((F.size(years(a)) == 0) | (F.size(years(b)) == 0) | (years(a) == years(b)))


def bn_neighbours(root: Column) -> Column:
    """All nine-digit numbers one edit away, as (candidate, edit): 81 substitutions, then up to 20 shifts (a digit inserted at one
    end and one dropped at the other)."""
    digits = F.sequence(F.lit(0), F.lit(9))
    changed = F.flatten(
        F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.transform(digits, lambda d: F.concat(F.substring(root, F.lit(1), i - 1), d.cast("string"), F.substring(root, i + 1, F.lit(9)))))
    )
    front = F.transform(digits, lambda d: F.concat(d.cast("string"), F.substring(root, 1, 8)))
    back = F.transform(digits, lambda d: F.concat(F.substring(root, 2, 8), d.cast("string")))
    named = lambda x, edit: F.transform(F.filter(F.array_distinct(x), lambda c: c != root), lambda c: F.struct(c.alias("candidate"), F.lit(edit).alias("edit")))
    shifts = F.array_except(F.concat(front, back), changed)
    return F.concat(named(changed, "substitution"), named(shifts, "insertion_deletion"))


# --- numbers, dates, years ------------------------------------------------------------------------------------------------

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(x: Column) -> Column:
    """A plain decimal number; null for anything else (a suffix, NaN, blank)."""
    t = F.trim(x)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def to_int(x: Column) -> Column:
    """An integer, decimal strings rounded half away from zero; null for anything else or out of range."""
    return F.round(to_double(x)).try_cast("int")


def money(x: Column) -> Column:
    """A number with "$" and thousands separators taken away."""
    return to_double(F.translate(F.trim(x), ",$", ""))


def parse_failed(raw: Column, parsed: Column) -> Column:
    """There was something to parse and it wasn't parsed."""
    return F.coalesce(F.trim(raw) != "", F.lit(False)) & parsed.isNull()


def any_date(x: Column) -> Column:
    """A date written as Y-m-d, Y/m/d or d/m/Y, tried in this order."""
    t = F.trim(x)
    tries = [F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form))) for shape, form in ((r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$", "y-M-d"), (r"^[0-9]{3,4}/[0-9]{1,2}/[0-9]{1,2}$", "y/M/d"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,4}$", "d/M/y"))]
    return F.coalesce(*tries).cast("date")


def fiscal_year(day: Column, cutover: int = 4) -> Column:
    """The year in which the fiscal year of a date began; months before ``cutover`` belong to the year before."""
    return F.year(day) - F.when(F.month(day) < cutover, 1).otherwise(0)


def fiscal_year_of_label(x: Column) -> Column:
    """The year that a label such as "2019-2020" begins with."""
    return F.regexp_extract(F.coalesce(x, F.lit("")), r"^([0-9]{4})", 1).try_cast("int")


def net_amount(awarded: Column, rescinded: Column) -> Column:
    """Awarded less rescinded, at least 0; null if nothing was awarded."""
    return F.when(awarded.isNotNull(), F.greatest(awarded - F.coalesce(rescinded, F.lit(0.0)), F.lit(0.0)))


def multi_year(start: Column, end: Column) -> Column:
    return F.year(end) > F.year(start) + F.when(F.month(start) >= 4, 1).otherwise(0)


def prorated(value: Column, start_year: Column, end_year: Column) -> Column:
    """(fiscal_year, amount) for each year of the span, equal parts; a missing or earlier end means the first year alone, a
    missing start or value nothing."""
    last = F.when(end_year >= start_year, end_year).otherwise(start_year)
    years = F.sequence(start_year, last)
    parts = F.transform(years, lambda y: F.struct(y.alias("fiscal_year"), (value / F.size(years)).alias("amount")))
    none = F.array().cast("array<struct<fiscal_year:int,amount:double>>")
    return F.when(start_year.isNull() | value.isNull(), none).otherwise(parts)


def pct_change(before: Column, after: Column) -> Column:
    return F.try_divide(after - before, before)


def fmt_money(v: Column) -> Column:
    """$12B, $1.2B, $3.4M or $5,678; a dash for null."""
    a = F.abs(v)
    part = lambda d, places, s: F.concat(F.lit("$"), F.format_number(v / d, places), F.lit(s))
    return F.when(v.isNull(), "—").when(a >= 1e10, part(1e9, 0, "B")).when(a >= 1e9, part(1e9, 1, "B")).when(a >= 1e6, part(1e6, 1, "M")).otherwise(F.concat(F.lit("$"), F.format_number(v, 0)))


def fmt_pct(identified: Column, declared: Column) -> Column:
    """How much of a declared amount is identified; a dash if nothing is declared."""
    share = F.when(declared != 0, 100.0 * identified / declared)
    return F.when(share.isNull(), "—").when(share > 999, ">999%").otherwise(F.concat(F.format_number(share, 0), F.lit("%")))


# --- taxonomy -------------------------------------------------------------------------------------------------------------


def ancestor_or_self(ancestor: Column, code: Column) -> Column:
    """Eight-character codes in four groups of two; "00" in the ancestor stands for anything, save in the first group."""
    group = lambda x, i: F.substring(x, 2 * i + 1, 2)
    out = group(ancestor, 0) == group(code, 0)
    deeper = F.lit(False)
    for i in (1, 2, 3):
        deeper = deeper | (group(ancestor, i) == "00")
        out = out & (deeper | (group(ancestor, i) == group(code, i)))
    return out


def codes_related(a: Column, b: Column) -> Column:
    return ancestor_or_self(a, b) | ancestor_or_self(b, a)


# --- regions --------------------------------------------------------------------------------------------------------------

def clean_city(x: Column) -> Column:
    """Without a province at the end."""
    return strip(F.regexp_replace(x, r"(?i)\s*(\((?:qu[eé]bec|qc)\)|,?\s+qc)\s*$", ""))


def on_island(city: Column, postal: Column) -> Column:
    return F.coalesce(F.upper(strip(city)).isin(*ISLAND_MUNICIPALITIES), F.lit(False)) | F.coalesce(F.substring(postal, 1, 2).isin(*ISLAND_FSA_PREFIXES), F.lit(False))


def in_province(province: Column, code: str = "QC") -> Column:
    return F.coalesce(F.upper(strip(province)) == code, F.lit(False))


# --- links ----------------------------------------------------------------------------------------------------------------


def record_url(base: str, *parts: Column) -> Column:
    """A hyperlink with the parts percent-encoded; null if one is blank."""
    out = F.lit(base)
    for i, p in enumerate(parts):
        out = F.concat(out, F.lit("," if i else ""), F.url_encode(blank_to_null(p)))
    return out
