"""Titles, names, identifiers and descriptions as Column expressions.

All of it stays in the JVM.  White space is spelled out (`WS`) and word bounds
are ASCII (`WB_L`, `WB_R`), because Java's own classes differ from those of the
catalogue's rules.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
DASH = r"[-–—]"
WB_L, WB_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _sub(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    return _sub(c, rf"^{WS}+|{WS}+$")


#: Patterns of title noise, in order; suffixes and prefixes go, noise becomes a blank.
TITLE_SUFFIXES = (
    rf"(?iu){WS}*[:\-–—]{WS}*[^:]*?{WB_L}book{WS}+\d+{WS}*$",
    rf"{WS}*\([^)]*#{WS}*\d+{WS}*\){WS}*$",
    rf"(?iu){WS}*,{WS}*book{WS}+\d+{WS}*$",
)
TITLE_PREFIXES = (
    rf"^{WS}*[A-Za-z'’. ]{{2,25}}{WS}+#?\d{{1,3}}{WS}*{DASH}{WS}+",
    rf"(?iu)^{WS}*[^,]{{2,30}},{WS}*book{WS}+\d+{WS}*[-–—:]{WS}+",
    rf"^{WS}*[A-Z]{{2,5}}\d{{1,3}}{WS}*{DASH}{WS}+",
)
TITLE_NOISE = (
    r"(?i)\((?:un)?abridged\)",
    r"(?i)\[(?:un)?abridged\]",
    rf"(?i){WB_L}unabridged{WB_R}",
    rf"(?i){WB_L}audiobook{WB_R}",
    rf"(?i){WB_L}book{WS}+\d+{WB_R}",
    rf"(?i){WB_L}vol(?:ume)?\.?{WS}*\d+{WB_R}",
    rf"(?i){WB_L}part{WS}+\d+{WB_R}",
    rf"(?i){WB_L}disc{WS}+\d+{WB_R}",
    rf"^{WS}*\d{{1,3}}{WS}*[-._]{WS}*(?=\D)",
    rf"^{WS}*\[\d{{1,3}}\]{WS}*",
    rf"^{WS}*0\d{{0,2}}{WS}+",
    rf"^{WS}*\[[^\]]{{1,40}}\]{WS}*{DASH}?{WS}*",
)


def normalize_title(c: Column) -> Column:
    """A title without series, format and track noise; null gives the empty string."""
    t = strip(F.coalesce(c, F.lit("")))
    for p in (*TITLE_SUFFIXES, *TITLE_PREFIXES):
        t = _sub(t, p)
    for p in TITLE_NOISE:
        t = _sub(t, p, " ")
    t = _sub(_sub(t, r"[_.]+", " "), rf"{WS}{{2,}}", " ")
    return _sub(t, rf"^(?:{WS}|[-–—:,])+|(?:{WS}|[-–—:,])+$")


def bracketed_asin(c: Column) -> Column:
    """The first store id inside brackets or parentheses, else null."""
    inner = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\[(]([^\])]{1,40})[\])]"), F.lit(1))
    ids = F.filter(F.transform(inner, lambda x: F.regexp_extract(x, rf"{WB_L}B[0-9A-Z]{{9}}{WB_R}", 0)), lambda x: x != "")
    return F.get(ids, F.lit(0))


def without_edge_brackets(c: Column) -> Column:
    t = _sub(F.coalesce(c, F.lit("")), rf"^{WS}*\[[^\]]{{1,40}}\]{WS}*|{WS}*\[[^\]]{{1,40}}\]{WS}*$", " ")
    return strip(_sub(t, rf"{WS}{{2,}}", " "))


def _fold_pairs() -> tuple[str, str]:
    """Every letter of the Basic Multilingual Plane that decomposes to one base letter and marks, and that base."""
    have, base = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        kept = "".join(x for x in parts if not "\u0300" <= x <= "\u036f")
        if len(kept) == 1 and kept != chr(code):
            have.append(chr(code))
            base.append(kept)
    return "".join(have), "".join(base)


_FOLD = _fold_pairs()


def fold_marks(c: Column) -> Column:
    """Letters without their combining marks; letters that don't decompose stay."""
    return _sub(F.translate(c, *_FOLD), r"[\u0300-\u036F]")


def clean(c: Column) -> Column:
    """The form that similarity compares: folded, lower case, only a-z, 0-9 and blanks."""
    return strip(_sub(F.lower(fold_marks(c)), r"[^a-z0-9 ]"))


def base_title(c: Column) -> Column:
    """Up to the first colon or parenthesis."""
    return strip(_sub(c, rf"(?s){WS}*[:(].*"))


def base_title_dashed(c: Column) -> Column:
    """As base_title, and up to a spaced dash."""
    return strip(_sub(_sub(c, rf"(?s){WS}+{DASH}{WS}+.*"), rf"(?s){WS}*[:(].*"))


def without_article(c: Column) -> Column:
    return _sub(c, rf"(?i)^{WS}*(?:the|a|an){WS}+")


def unify_ampersand(c: Column) -> Column:
    return strip(_sub(_sub(c, rf"{WS}*&{WS}*", " and "), rf"{WS}{{2,}}", " "))


def title_variants(c: Column) -> Column:
    """Distinct spellings to score: as is, without article, with `and`, both."""
    return F.array_distinct(F.array(c, without_article(c), unify_ampersand(c), without_article(unify_ampersand(c))))


def split_authors(c: Column) -> Column:
    """The whole credit, then its parts; no author gives one empty name."""
    whole = strip(F.coalesce(c, F.lit("")))
    parts = F.filter(F.split(whole, rf"(?i){WS}*(?:,|&|;|/|{WB_L}and{WB_R}){WS}*"), lambda x: x != "")
    return F.when(whole == "", F.array(F.lit(""))).otherwise(F.array_distinct(F.concat(F.array(whole), parts)))


def volume_numbers(c: Column) -> Column:
    """Distinct numbers that follow part, book, vol(ume) or #."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?i)(?:{WB_L}(?:part|book|vol(?:ume)?\.?){WS}*|#{WS}*)(\d{{1,3}}){WB_R}"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def volumes_conflict(a: Column, b: Column) -> Column:
    """Both name volumes and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def alnum_key(c: Column) -> Column:
    return _sub(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]")


def normalize_name(c: Column) -> Column:
    return strip(_sub(F.lower(c), rf"{WS}+", " "))


def _middle(c: Column) -> Column:
    parts = F.split(normalize_name(c), " ")
    return F.when(F.size(parts) > 2, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def initials(c: Column) -> Column:
    """Middle initials in order."""
    return F.array_join(F.transform(F.filter(_middle(c), lambda t: t.rlike(r"^[a-z]\.?$")), lambda t: F.substring(t, 1, 1)), "")


def without_initials(c: Column) -> Column:
    parts = F.split(normalize_name(c), " ")
    kept = F.concat(F.slice(parts, 1, 1), F.filter(_middle(c), lambda t: ~t.rlike(r"^[a-z]\.?$")), F.slice(parts, -1, 1))
    return F.when(F.size(parts) < 3, F.array_join(parts, " ")).otherwise(F.array_join(kept, " "))


#: Words that stay small inside a title.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "nor", "of", "on", "or", "the", "to", "via", "vs", "with")


def title_case(c: Column) -> Column:
    """Capitals for a title that has none past its first character."""
    words = F.split(c, " ")
    n = F.size(words)

    def word(w: Column, i: Column) -> Column:
        bare = F.lower(_sub(w, r"[^A-Za-z]"))
        inner = (i > 0) & (i < n - 1) & bare.isin(*SMALL_WORDS)
        return F.when((w == "") | inner, w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.when((c == "") | F.substr(c, F.lit(2)).rlike("[A-Z]"), c).otherwise(F.array_join(F.transform(words, word), " "))


def chapter_title(c: Column, word: Column) -> Column:
    """A chapter heading: bare numbers and `x_y` forms get the local word for chapter."""
    t = _sub(c, r"\.$")
    trimmed = strip(t)
    numeric = (trimmed == "") | trimmed.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$")
    whole = F.regexp_extract(trimmed, r"^([+-]?\d+)", 1)
    number = F.when(whole == "", F.lit("NaN")).otherwise(F.expr("cast(null as string)"))
    number = F.coalesce(number, F.when(whole != "", whole.cast("bigint").cast("string")))
    return F.when(numeric & (F.char_length(t) <= 3), F.concat_ws(" ", word, number)).when(t.contains("_"), F.concat_ws(" ", word, F.get(F.split(t, "_"), F.lit(1)))).otherwise(t)


#: What is removed from descriptions, in order.
EMAIL = r"[a-zA-Z0-9._-]++@[a-zA-Z0-9._-]+\.[a-zA-Z0-9_-]+"
HANDLE = r"(?:^|[^@A-Za-z0-9_])@[A-Za-z0-9_]{1,15}(?![A-Za-z0-9_])"
URL = r"(?:https?:\/\/)?[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)+\.?(?::\d+)?(?:\/\S*)?"


def cleanup_description(c: Column) -> Column:
    """A description without e-mail addresses, handles and urls; texts without an at-sign or a dot skip what needs one."""
    t = F.when(c.contains("@"), _sub(_sub(c, EMAIL), HANDLE)).otherwise(c)
    return strip(F.when(t.contains("."), _sub(t, URL)).otherwise(t))


def clean_store_title(c: Column) -> Column:
    return strip(_sub(c, rf"(?i){WS}*\((?:un)?abridged\){WS}*$"))


def strip_html(c: Column, paragraphs: bool = False) -> Column:
    """Flat text of simple markup; null where nothing is left."""
    t = _sub(c, r"(?i)<br\s*/?>", "\n")
    if paragraphs:
        t = _sub(t, r"(?i)</p>", "\n")
    t = _sub(t, r"<[^>]+>")
    names = (("&nbsp;", " "), ("&amp;", "&")) if paragraphs else (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;|&apos;", "'"), ("&quot;", '"'), ("&nbsp;", " "))
    for name, to in names:
        t = _sub(t, f"(?i){name}" if paragraphs else name, to)
    return F.nullif(strip(_sub(t, r"[ \t]+\n", "\n")), F.lit(""))


def html_text(c: Column) -> Column:
    """Text of markup: blocks on lines of their own, white space closed up, character names decoded."""
    t = _sub(_sub(c, r"(?is)<(script|style)\b.*?</\1\s*>"), rf"{WS}+", " ")
    t = _sub(t, r"(?i) ?<br\s*/?> ?", "\n")
    t = _sub(t, r"(?i) ?</?(?:p|div|h[1-6]|ul|ol|li|blockquote|section|article|tr|table)(?:\s[^>]*)?> ?", "\n\n")
    t = _sub(t, r"<[^>]+>")
    for name, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&")):
        t = _sub(t, name, to)
    return strip(_sub(t, r"\n{3,}", "\n\n"))


def publisher_of_copyright(c: Column) -> Column:
    return F.nullif(strip(_sub(c, r"^[©℗\s]*\d{4}\s*")), F.lit(""))


def copyright_year(c: Column) -> Column:
    """The first four digits after a copyright sign or word."""
    return F.nullif(F.regexp_extract(c, r"(?i)(?:©|\(c\)|copyright)\s*(\d{4})", 1), F.lit("")).cast("int")


def clean_biography(c: Column) -> Column:
    """A biography without footnotes, their references and emphasis marks."""
    t = _sub(_sub(c, r"\r\n", "\n"), r"(?m)^[ \t]*\[\d+\]:\s*\S+.*$")
    t = _sub(_sub(t, r"\s*\(?\[[^\]]+\]\[\d+\]\)?"), r"\*")
    return strip(_sub(t, r"\n{3,}", "\n\n"))


def number_text(c: Column) -> Column:
    """A number as short as it can be: 1, not 1.0."""
    return _sub(c.cast("double").cast("string"), r"\.0$")


def asin_of_url(c: Column) -> Column:
    """The first store id inside a link, else null."""
    return F.nullif(F.regexp_extract(c, r"B[0-9A-Z]{9}|[0-9]{9}[0-9X]", 0), F.lit(""))


def genre_of_url(c: Column) -> Column:
    """The first eleven digits inside a link, else null."""
    return F.nullif(F.regexp_extract(c, r"[0-9]{11}", 0), F.lit(""))


#: Hosts and forms of covers that are square as they are.
SQUARE_COVERS = (r"(?i)mzstatic\.com/.*/\d+x\d+bb\.(?:jpg|png)", r"(?i)//m\.media-amazon\.com/images/")


def is_square_cover(c: Column) -> Column:
    return F.coalesce(c.rlike(SQUARE_COVERS[0]) | c.rlike(SQUARE_COVERS[1]), F.lit(False))


def drop_image_modifier(c: Column) -> Column:
    """A cover url without the size token before its suffix."""
    return _sub(c, r"\._[A-Za-z0-9_,-]+_(?=\.[A-Za-z]+$)")


def square_cover(c: Column) -> Column:
    """Upsized square artwork; null without a size segment."""
    t = _sub(c, r"/\d+x\d+[^/]*$", "/600x600bb.jpg")
    return F.when(t != c, t)


def encode_id(provider: Column, kind: Column, native: Column) -> Column:
    """A provider's id as one string; store ids stay as they are."""
    bare = _sub(native, r"^/?works/")
    return F.when(provider == "audible", native).when(provider.isin("storytel", "overdrive"), F.concat_ws("-", provider, native)).otherwise(F.concat_ws("-", provider, kind, bare))


def decode_id(c: Column) -> Column:
    """struct(provider, kind, native), null for a store id or an unknown form."""

    def form(pattern: str, provider: str, kind: Column, native: Column) -> Column:
        return F.when(c.rlike(pattern), F.struct(F.lit(provider).alias("provider"), kind.alias("kind"), native.alias("native")))

    part = lambda pattern, k=1: F.regexp_extract(c, pattern, k)
    hc = r"^hardcover-(edition|book)-(\d+)$"
    return F.when(~is_asin(c), F.coalesce(
        form(hc, "hardcover", part(hc), part(hc, 2)),
        form(r"^openlibrary-works-(.+)$", "openlibrary", F.lit("works"), F.concat(F.lit("/works/"), part(r"^openlibrary-works-(.+)$"))),
        form(r"^storytel-(.+)$", "storytel", F.lit("book"), part(r"^storytel-(.+)$")),
        form(r"^apple-audiobook-(\d+)$", "apple", F.lit("audiobook"), part(r"^apple-audiobook-(\d+)$")),
        form(r"^overdrive-(\d+)$", "overdrive", F.lit("media"), part(r"^overdrive-(\d+)$")),
    ))


def is_asin(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^B[0-9A-Z]{9}$"), F.lit(False))


#: Marks of bundles, foreign editions and synthetic narrators.
BUNDLE = rf"(?i){WB_L}(?:box(?:ed)?[- ]?set|gift[- ]?set|omnibus|collection|complete series|books? \d+\s*[-–—]\s*\d+|\d+[- ]book set|trilogy set){WB_R}"
FOREIGN_EDITION = rf"(?i){WB_L}(?:spanish|french|german|italian|portuguese|dutch|polish|russian|japanese|chinese|swedish|norwegian|danish|finnish|czech|turkish|korean)\s+(?:edition|version){WB_R}|{WB_L}edici[oó]n{WB_R}|{WB_L}[ée]dition\s+fran[cç]aise{WB_R}|{WB_L}ausgabe{WB_R}|{WB_L}edizione{WB_R}"
VIRTUAL_VOICE = rf"(?i){WB_L}virtual voice{WB_R}"


def is_bundle(c: Column) -> Column:
    return F.coalesce(c.rlike(BUNDLE), F.lit(False))


def is_foreign_edition(c: Column) -> Column:
    return F.coalesce(c.rlike(FOREIGN_EDITION), F.lit(False))


def is_ai_narrated(narrators: Column) -> Column:
    return F.coalesce(F.exists(narrators, lambda n: n.rlike(VIRTUAL_VOICE)), F.lit(False))
