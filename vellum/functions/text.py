"""Text functions as Column expressions: no Python worker, one pass inside codegen where Spark has it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lists that results depend on.
PAGE_NUMBER = r"(?i)^(?:page\s*)?(?:\d{1,4}|[ivxlcdm]{1,7})(?:\s*(?:of|/)\s*\d{1,4})?$"
ODD_SPACES = r"[\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
INVISIBLE = r"[\u200B-\u200D\u2060\uFEFF\u00AD]"
WINANSI = r"[^\x09\x0A\x20-\x7E\u00A0-\u00FF\u20AC\u201A\u0192\u201E\u2026\u2020\u2021\u02C6\u2030\u0160\u2039\u0152\u017D\u2018\u2019\u201C\u201D\u2022\u2013\u2014\u02DC\u2122\u0161\u203A\u0153\u017E\u0178]"
CONTROLS = r"[\u0000-\u0008\u000B\u000C\u000D\u000E-\u001F\u007F]"
SCRIPTS = (
    ("devanagari", r"\u0900-\u097F"),
    ("bengali", r"\u0980-\u09FF"),
    ("gurmukhi", r"\u0A00-\u0A7F"),
    ("gujarati", r"\u0A80-\u0AFF"),
    ("oriya", r"\u0B00-\u0B7F"),
    ("tamil", r"\u0B80-\u0BFF"),
    ("telugu", r"\u0C00-\u0C7F"),
    ("kannada", r"\u0C80-\u0CFF"),
    ("malayalam", r"\u0D00-\u0D7F"),
    ("sinhala", r"\u0D80-\u0DFF"),
    ("thai", r"\u0E00-\u0E7F"),
    ("lao", r"\u0E80-\u0EFF"),
    ("myanmar", r"\u1000-\u109F"),
    ("khmer", r"\u1780-\u17FF"),
    ("arabic", r"\u0600-\u06FF\u0750-\u077F\uFB50-\uFDFF\uFE70-\uFEFF"),
    ("hebrew", r"\u0590-\u05FF\uFB1D-\uFB4F"),
    ("cjk", r"\u3040-\u30FF\u3130-\u318F\u3400-\u4DBF\u4E00-\u9FFF\uAC00-\uD7A3\uF900-\uFAFF"),
    ("cyrillic", r"\u0400-\u052F"),
    ("greek", r"\u0370-\u03FF\u1F00-\u1FFF"),
    ("armenian", r"\u0530-\u058F"),
    ("georgian", r"\u10A0-\u10FF"),
    ("ethiopic", r"\u1200-\u137F"),
)
RTL = ("arabic", "hebrew")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def repeat_key(c: Column) -> Column:
    """Key under which running heads recur: digits run together."""
    return collapsed(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\d+", "#"))


def is_page_number(c: Column) -> Column:
    return trimmed(c).rlike(PAGE_NUMBER)


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")


def clean_noise_tokens(c: Column) -> Column:
    return F.array_join(F.filter(tokens(c), lambda w: w.rlike("[A-Za-z0-9]")), " ")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_noise_line(c: Column) -> Column:
    """Speckle: no token with three letters, no run of three digits, and not several short words."""
    t = tokens(c)
    word = F.exists(t, lambda w: _count(w, "[A-Za-z]") >= 3)
    several = (F.size(t) >= 4) & (_count(c, "[A-Za-z]") >= F.size(t))
    return ~(word | c.rlike(r"\d{3,}") | several)


def clean_editable(c: Column) -> Column:
    """Odd spaces to spaces; zero-width marks and controls dropped, tab and line feed kept."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ODD_SPACES, " "), INVISIBLE, ""), CONTROLS, "")


def winansi_safe(c: Column) -> Column:
    """What a standard font can draw; other characters become a question mark."""
    return F.regexp_replace(c, WINANSI, "?")


def tidy_line(c: Column) -> Column:
    """Odd white space to spaces, runs of 25 and more cut to 24, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"[^\S ]+", " "), " {25,}", " " * 24))


def edit_budget(n: Column) -> Column:
    return F.when(n >= 8, 2).when(n >= 4, 1).otherwise(0)


def script_counts(c: Column) -> Column:
    """(n, -priority, script) of every script found."""
    rows = F.array(*[F.struct(_count(c, f"[{p}]").alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("script")) for i, (k, p) in enumerate(SCRIPTS)])
    return F.filter(rows, lambda r: r["n"] > 0)


def script_of(c: Column) -> Column:
    """Script with most characters, the earlier one in the table on ties, else latin."""
    found = script_counts(c)
    return F.when(F.size(found) > 0, F.array_max(found)["script"]).otherwise("latin")


def direction_of(c: Column) -> Column:
    return F.when(script_of(c).isin(*RTL), "rtl").otherwise("ltr")


def url(c: Column) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.when(t == "", "").when(t.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), t).when(t.rlike(r"^[^\s@/]+@[^\s@/]+\.[^\s@/]+$"), F.concat(F.lit("mailto:"), t)).otherwise(F.concat(F.lit("https://"), t))


def escape_html(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), c)


def escape_rtf(c: Column) -> Column:
    """Backslash and braces escaped; beyond ASCII as signed 16-bit units."""
    safe = F.regexp_replace(c, r"([\\{}])", r"\\$1")
    unit = lambda n: F.concat(F.lit("\\u"), F.when(n > 32767, n - 65536).otherwise(n).cast("string"), F.lit("?"))

    def one(x: Column) -> Column:
        n = F.ascii(x)  # the code point
        over = n - 65536
        pair = F.concat(unit(F.floor(over / 1024).cast("int") + 55296), unit(over % 1024 + 56320))
        return F.when(n < 128, x).when(n < 65536, unit(n)).otherwise(pair)

    return F.when(safe.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(safe, ""), one), "")).otherwise(safe)


def utf16_hex(c: Column) -> Column:
    return F.concat(F.lit("FEFF"), F.hex(F.encode(c, "UTF-16BE")))


def strip_subset(c: Column) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(c, F.lit("")), r"\+"), -1))


def human_size(n: Column) -> Column:
    mb = n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(mb < 1, F.concat(F.floor(n / 1024 + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def snippet(c: Column, start: Column, end: Column, around: int = 34) -> Column:
    """``around`` characters of context on either side, with ellipses where cut."""
    left = F.greatest(start - around, F.lit(0))
    right = F.least(end + around, F.length(c))
    body = c.substr(left + 1, right - left)
    return F.concat(F.when(left > 0, "…").otherwise(""), body, F.when(right < F.length(c), "…").otherwise(""))


#: Letters by which a line is cut into runs; a run goes on to the next letter of the other kind, the first one takes what stands before it.
ACCENTED, LATIN = "À-ÿ", "A-Za-z"
LETTER_RUN = f"(?s)^[^{LATIN}{ACCENTED}]+$|(?:^[^{LATIN}{ACCENTED}]+)?(?:[{LATIN}][^{ACCENTED}]*|[{ACCENTED}][^{LATIN}]*)"


def letter_runs(text: Column) -> Column:
    """Runs of one kind of letter as (kind, text), in one pass of a pattern; without letters the text is one run of no kind."""
    kind = lambda t: F.when(t.rlike(f"[{ACCENTED}]"), "accented").when(t.rlike(f"[{LATIN}]"), "latin")
    return F.transform(F.regexp_extract_all(text, F.lit(LETTER_RUN), F.lit(0)), lambda t: F.struct(kind(t).alias("kind"), t.alias("text")))
