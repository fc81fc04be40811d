"""Text functions: Column in, Column out, evaluated by the JVM. Only NFKC, which Spark lacks, is an Arrow UDF, and it
gets null for every text without a compatibility character."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import constants as C

AR = C.ARABIC
SPACES = r"(?U)\s+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


#: Beyond these blocks NFKC may change a text. Latin letters, Arabic letters, general punctuation without compatibility forms.
STABLE = r"^[\x00-\x7f¡-§©«-®°-±¶-·»¿-ıĴ-ľŁ-ňŊ-ž؀-ٴٹ-ۿ​-‐–-‖‘-‣]*$"


def nfkc(c: Column) -> Column:
    odd = ~c.rlike(STABLE)
    return F.when(odd, _nfkc(F.when(odd, c))).otherwise(c)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a column that is computed once: as the output of a generator it is not copied into what
    is built on it, and Arrow functions may take it."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def strip(c: Column) -> Column:
    """Trim Unicode white space. A text is searched only if its first or last character is one."""
    ends = lambda v: F.concat(F.left(v, F.lit(1)), F.right(v, F.lit(1)))
    return let(c, lambda v: F.when(ends(v).rlike(r"(?U)\s"), F.regexp_replace(v, r"(?U)^\s+|\s+\z", "")).otherwise(v))


def blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, trimmed. Single spaces, as most are, are no match."""
    return F.trim(F.regexp_replace(c, r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def contains_any(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(m)) for m in markers), F.lit(False))


def starts_with_any(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(m)) for m in markers), F.lit(False))


def ends_with_any(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.endswith(c, F.lit(m)) for m in markers), F.lit(False))


def words(c: Column) -> Column:
    """White-space separated words; none in a blank text."""
    return F.filter(F.split(c, SPACES), lambda w: w != "")


# --- Arabic -----------------------------------------------------------------------------------------------------
def collapse_spaced_letters(c: Column) -> Column:
    """Three or more single Arabic characters with white space between them lose it. The run may begin with the last
    letter of a word and end with the first of another."""
    if_spaced = lambda t: F.when(t.rlike(rf"(?U)(?:[{AR}]\s+){{2,}}[{AR}]"), _collapsed(t)).otherwise(t)
    return let(c, if_spaced)


def _collapsed(c: Column) -> Column:
    marked = F.regexp_replace(c, rf"(?U)((?:[{AR}]\s+){{2,}}[{AR}])", "\x01$1\x02")
    pieces = F.split(marked, "\x01")
    fixed = F.transform(pieces, lambda p, i: F.when((i == 0) | ~F.contains(p, F.lit("\x02")), p).otherwise(F.concat(F.regexp_replace(F.substring_index(p, "\x02", 1), SPACES, ""), F.regexp_replace(p, "(?s)^[^\x02]*\x02", ""))))
    return F.array_join(fixed, "")


def shape_score(c: Column) -> Column:
    """How natural the Arabic words of a text look: the sum over its words of their affixes, fragments and pairs."""
    one = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    any_of = lambda words: f"(?:{'|'.join(words)})"  # noqa: E731  letters alone, which stand for themselves

    def score(t: Column) -> Column:
        known = F.regexp_count(t, F.lit(f"(?={any_of(C.BIGRAMS)})"))
        fragments = reduce(lambda a, b: a + b, (F.contains(t, F.lit(x)).cast("int") for x in C.FRAGMENTS))
        good = one(t.rlike(f"^{any_of(C.PREFIXES)}"), 2) + one(t.rlike(f"{any_of(C.SUFFIXES)}$"), 2) + fragments + known
        return good - one(t.rlike(f"^{any_of(C.ODD_STARTS)}"), 2) - one(t.rlike(f"{any_of(C.ODD_ENDS)}$") & (F.length(t) > 3), 1)

    tokens = F.filter(F.regexp_extract_all(c, F.lit(f"([{AR}]+)"), F.lit(1)), lambda t: F.length(t) >= 2)
    return F.aggregate(tokens, F.lit(0), lambda acc, t: acc + score(t))


def repair_visual_order(c: Column) -> Column:
    """Reverse every purely Arabic token if that makes the text score 4 at least and 3 more than before."""


    def turned(v: Column) -> Column:
        pieces = F.split(v, r"(?U)(?<=\s)(?=\S)|(?<=\S)(?=\s)")
        return F.array_join(F.transform(pieces, lambda t: F.when(t.rlike(rf"^[{AR}]+$") & (F.length(t) > 1), F.reverse(t)).otherwise(t)), "")

    def chosen(v: Column) -> Column:
        both = F.transform(F.array(v, turned(v)), lambda t: F.struct(t.alias("t"), shape_score(t).alias("n")))
        return let(both, lambda b: F.when((b[1]["n"] >= 4) & (b[1]["n"] >= b[0]["n"] + 3), b[1]["t"]).otherwise(b[0]["t"]))

    return let(c, lambda v: F.when(v.rlike(f"[{AR}]"), chosen(v)).otherwise(v))


#: Anything but ASCII and accented Latin letters that have no compatibility form.
BEYOND_LATIN = r"[^\x00-\x7F\u00C0-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3]"


def normalize_arabic(c: Column, *, diacritics: bool = False, alef: bool = True, ya: bool = True, teh: bool = True, tatweel: bool = True, compat: bool = True) -> Column:
    """Letters unified for retrieval. ``compat=False`` leaves NFKC out, for text that has been cleaned before."""
    drop = C.TATWEEL if tatweel else ""
    src, dst = (C.ALEF_VARIANTS, "ا" * len(C.ALEF_VARIANTS)) if alef else ("", "")
    src, dst = (src + "ى", dst + "ي") if ya else (src, dst)
    src, dst = (src + "ة", dst + "ه") if teh else (src, dst)

    def whole(v: Column) -> Column:
        v = F.translate(v, src + drop, dst)
        return _tidy(F.regexp_replace(v, C.DIACRITICS, "") if diacritics else v)

    # A text of plain Latin letters alone, as most are, needs its spacing unified and nothing else.
    v = F.coalesce(c, F.lit(""))
    return let(nfkc(v) if compat else v, lambda v: F.when(plain_latin(v), _spaced(v)).otherwise(whole(v)))


def _tidy(v: Column) -> Column:
    v = repair_visual_order(collapse_spaced_letters(F.regexp_replace(v, C.INVISIBLE, "")))
    return _spaced(v)


def _spaced(v: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(v, r"[ \t\f\x0b]+", " "), r"\n{3,}", "\n\n"))


def clean_text(c: Column, for_retrieval: bool = True) -> Column:
    """Text as it is indexed: compatibility forms, line ends, marks and spacing unified; teh marbuta is kept."""
    v = _tidy(F.regexp_replace(nfkc(F.coalesce(c, F.lit(""))), r"\r\n?", "\n"))
    return normalize_arabic(v, teh=False, compat=False) if for_retrieval else v


def has_arabic(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(f"[{AR}]")


def script_counts(c: Column) -> tuple[Column, Column]:
    return F.regexp_count(c, F.lit(f"[{AR}]")), F.regexp_count(c, F.lit("[A-Za-z]"))


def detect_language(c: Column) -> Column:
    """ar, en or mixed: mixed if both scripts have three letters, else the majority (tie: ar)."""
    v = F.coalesce(c, F.lit(""))
    arabic, latin = script_counts(v)
    return (
        F.when(blank(v), "en")
        .when((arabic >= 3) & (latin >= 3), "mixed")
        .when((arabic > 0) & (latin > 0), F.when(arabic >= latin, "ar").otherwise("en"))
        .when(arabic > 0, "ar")
        .otherwise("en")
    )


def response_language(explicit: Column, question: Column) -> Column:
    return F.when(explicit.isin("ar", "en"), explicit).otherwise(detect_language(question))


def arabic_ratio(c: Column) -> Column:
    """Arabic characters among letters."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(f"[{AR}]")) / letters).otherwise(F.lit(0.0))


def direction(c: Column) -> Column:
    size = F.length(c)
    return F.when((size > 0) & (F.regexp_count(c, F.lit(f"[{AR}]")) / size > 0.3), "rtl").otherwise("ltr")


def unreliable_extraction(c: Column) -> Column:
    """Arabic text that looks badly extracted: letters set apart, many single characters or very short words."""

    def bad(tokens: Column) -> Column:
        n = F.size(tokens)
        single = F.size(F.filter(tokens, lambda t: F.length(t) == 1)) / n
        mean = F.length(F.array_join(tokens, "")) / n
        return (n == 0) | (single > 0.35) | (mean < 2.2)

    v = F.coalesce(c, F.lit(""))
    # Lengths of Arabic words as ``clean_text`` leaves them: turning words round, letters that give way one for one and
    # spacing change none of them, so these steps are left out.
    joined = collapse_spaced_letters(F.regexp_replace(nfkc(v), C.INVISIBLE, ""))
    joined = collapse_spaced_letters(F.translate(joined, C.TATWEEL, ""))
    tokens = F.regexp_extract_all(joined, F.lit(f"([{AR}]+)"), F.lit(1))
    return F.when(has_arabic(v), v.rlike(rf"(?U)(?:[{AR}]\s+){{2,}}[{AR}]") | let(tokens, bad)).otherwise(F.lit(False))


# --- Tokens -----------------------------------------------------------------------------------------------------
def plain_latin(v: Column) -> Column:
    """Whether a text has no more than ASCII and accented Latin letters; ASCII alone shows in its size,
    and the rest of a text is searched without it."""
    return (F.octet_length(v) == F.length(v)) | ~F.regexp_replace(v, r"[\x00-\x7F]+", "").rlike(BEYOND_LATIN)


def folded(c: Column, compat: bool = False) -> Column:
    """Text beyond plain Latin letters as its tokens are found in it, before small letters."""
    return F.translate(normalize_arabic(c, diacritics=True, compat=compat), C.DIGITS_FROM, C.DIGITS_TO)


def tokenize(c: Column, compat: bool = False) -> Column:
    """Ranking tokens: letters and digits of Latin and Arabic script, article stripped, stop words and single
    characters left out. ``compat`` for text that has not been cleaned."""
    found = lambda t: F.regexp_extract_all(F.lower(t), F.lit(f"([A-Za-z0-9{AR}]+)"), F.lit(1))
    bare = lambda t: F.when((F.length(t) > 3) & F.startswith(t, F.lit("ال")), F.substring(t, F.lit(3), F.length(t))).otherwise(t)
    # In plain Latin text normalisation changes spacing alone, which is no part of a token.
    whole = lambda t: F.transform(found(folded(t, compat)), bare)
    v = F.coalesce(c, F.lit(""))
    raw = F.when(plain_latin(v), found(v)).otherwise(whole(v))
    return F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(C.STOPWORDS))


def leading_tokens(c: Column, n: int, least: int, head: int = 256) -> Column:
    """The first ``n`` distinct tokens (``tokenize``) of ``least`` characters or more."""
    wanted = lambda tokens: F.slice(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= least) & (F.length(t) > 1) & ~t.isin(C.STOPWORDS))), 1, n)
    # Normalisation changes spacing alone in a head of plain Latin letters, whatever comes behind it, so the whole tokens
    # of such a head come first. Where they are too few, or the head is another, all of the text is cut.
    token = "[A-Za-z0-9]+"
    begin = lambda v: F.regexp_replace(F.lower(v), rf"{token}\z", "")
    first = lambda v: F.when(plain_latin(v), wanted(F.regexp_extract_all(begin(v), F.lit(f"({token})"), F.lit(1))))
    whole = lambda v: let(let(F.left(v, F.lit(head)), first), lambda t: F.when(F.size(t) == n, t).otherwise(wanted(tokenize(v))))
    return let(F.coalesce(c, F.lit("")), whole)


def rerank_tokens(c: Column) -> Column:
    v = F.lower(normalize_arabic(c, diacritics=True, compat=False))
    return F.array_distinct(F.regexp_extract_all(v, F.lit(rf"([\p{{L}}\p{{N}}_{AR}]+)"), F.lit(1)))


def keywords(c: Column, most: int = 8) -> Column:
    """First ``most`` distinct words of two characters or more that are no stop words."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"([\p{{L}}\p{{N}}_{AR}]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(raw, lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(C.KEYWORD_STOPWORDS))), 1, most)


def sentences(c: Column) -> Column:
    """Split after sentence ends followed by white space and at blank lines; the whole text if nothing is left."""
    parts = F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?؟۔])\s+|\n\s*\n"), strip), lambda s: s != "")
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.filter(F.array(strip(c)), lambda s: s != "")))


def dedupe_lines(c: Column) -> Column:
    """Drop a line that repeats the last non-blank line (compared trimmed); blank lines stay."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    kept = F.aggregate(
        lines,
        F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: let(strip(x), lambda v: F.when((v != "") & (v == acc["last"]), acc).otherwise(F.struct(F.when(v == "", acc["last"]).otherwise(v).alias("last"), F.concat(acc["out"], F.array(x)).alias("out")))),
    )
    return F.array_join(kept["out"], "\n")


# --- HTML, links, names -----------------------------------------------------------------------------------------
def html_strip(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def html_blocks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?is)(<(?:h[1-6]|p|li|tr|div|table)[^>]*>.*?</(?:h[1-6]|p|li|tr|div|table)>)"), F.lit(1))


def links(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(https?://[^\s)]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;]+$", "")))


def search_query(c: Column) -> Column:
    """A question without its command and question words; the trimmed text where nothing is left."""
    raw = strip(F.coalesce(c, F.lit("")))
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, C.QUERY_COMMAND_EN, ""), C.QUERY_COMMAND_AR, ""), C.QUERY_WH, "")
    q = F.regexp_replace(q, "^[ ?؟.]+|[ ?؟.]+$", "")
    return F.when(q != "", q).otherwise(raw)


def wants_screenshot(c: Column) -> Column:
    raw = strip(F.coalesce(c, F.lit("")))
    return contains_any(F.lower(raw), C.SCREENSHOT)


def sanitize_filename(c: Column, default: str = "uploaded.bin", compat: bool = True) -> Column:
    raw = strip(F.coalesce(c, F.lit("")))
    raw = F.when(raw == "", F.lit(default)).otherwise(nfkc(raw) if compat else raw)
    base = F.regexp_extract(F.regexp_replace(F.translate(raw, "\\", "/"), "/+$", ""), r"([^/]*)$", 1)
    base = F.regexp_replace(F.regexp_replace(base, C.UNSAFE_IN_NAMES, "_"), "^[ .]+|[ .]+$", "")
    suffix = F.substring(F.regexp_extract(base, r"[^.](\.[^.]+)$", 1), 1, 20)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]+$", "")
    short = F.concat(F.left(stem, 200 - F.length(suffix)), suffix)
    return F.when(base == "", F.lit(default)).when(F.length(base) > 200, short).otherwise(base)


def valid_collection_name(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))).rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")


def truncated(c: Column, most: int = 12_000, note: str = "\n… [truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit(note))).otherwise(c)


def strip_sources_footer(c: Column) -> Column:
    """A text up to the first line that begins as one of the footer's headings does, without a rule above it."""
    lines = F.split(strip(F.coalesce(c, F.lit(""))), "\n")

    def cut(v: Column) -> Column:
        heads = F.transform(v, lambda x: F.exists(F.array(*map(F.lit, C.FOOTERS)), lambda h: F.startswith(F.lower(F.ltrim(x)), h)))
        at = F.array_position(heads, True)
        return F.array_join(F.when(at > 0, F.slice(v, F.lit(1), (at - 1).cast("int"))).otherwise(v), "\n")

    return strip(F.regexp_replace(strip(let(lines, cut)), r"\n-{1,3}\z", ""))


def mid_fingerprint(c: Column) -> Column:
    """A window of 48 characters around the middle of a text of 60 or more; null where it is too thin."""
    window = lambda t: F.trim(F.substring(t, F.greatest(F.floor(F.length(t) / 2).cast("int") - 24, F.lit(0)) + 1, F.lit(48)))
    thick = lambda t: let(F.when(F.length(t) >= 60, window(t)), lambda w: F.when(F.length(w) >= 24, w))
    return let(squeeze(c), thick)


def json_object(c: Column) -> Column:
    """The outermost object of a chatty reply as a variant; null where there is none."""
    return F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0))


# --- Keys -------------------------------------------------------------------------------------------------------
def chunk_id(fingerprint: Column, page: Column, ordinal: Column, text: Column) -> Column:
    fp = F.left(F.when(F.coalesce(fingerprint, F.lit("")) == "", F.lit("nofp")).otherwise(fingerprint), F.lit(16))
    return F.concat_ws(":", fp, page.cast("string"), ordinal.cast("string"), F.left(F.sha2(F.coalesce(text, F.lit("")), 256), F.lit(8)))


def uuid5(name: Column) -> Column:
    """UUID of version 5 in the DNS namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(C.UUID_DNS)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
