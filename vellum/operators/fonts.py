"""Font names: catalogue keys, style and family rules. Dimensions are fixed values, broadcast by construction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.text import WINANSI, strip_subset

# Name part and catalogue key, first match wins.
FAMILY_KEYS = (
    ("ibm plex mono", "ibmplexmono"), ("ibmplex", "ibmplexmono"), ("jetbrains", "jetbrainsmono"), ("source code", "sourcecodepro"), ("fira code", "firacode"), ("firacode", "firacode"), ("source sans", "sourcesans"), ("sourcesans", "sourcesans"),
    ("libre baskerville", "librebaskerville"), ("librebaskerville", "librebaskerville"), ("baskerville", "baskerville"), ("playfair", "playfair"), ("noto serif", "notoserif"), ("notoserif", "notoserif"), ("eb garamond", "garamond"), ("ebgaramond", "garamond"), ("garamond", "garamond"),
    ("merriweather", "merriweather"), ("pt sans", "ptsans"), ("ptsans", "ptsans"), ("poppins", "poppins"), ("nunito", "nunito"), ("ubuntu", "ubuntu"), ("lato", "lato"), ("inter", "inter"), ("carlito", "calibri"), ("calibri", "calibri"), ("caladea", "cambria"), ("cambria", "cambria"),
    ("consolas", "consolas"), ("trebuchet", "trebuchet"), ("tahoma", "tahoma"), ("palatino", "palatino"), ("comic neue", "comicneue"), ("comicneue", "comicneue"), ("comic", "comicsans"), ("pacifico", "pacifico"), ("brush script", "brushscript"), ("brushscript", "brushscript"),
    ("arimo", "arial"), ("arial", "arial"), ("geneva", "arial"), ("helvetica", "helvetica"), ("verdana", "verdana"), ("tinos", "times"), ("times", "times"), ("cousine", "courier"), ("courier", "courier"), ("gelasio", "georgia"), ("georgia", "georgia"), ("roboto", "roboto"),
    ("open sans", "opensans"), ("opensans", "opensans"), ("montserrat", "montserrat"),
)
# Name parts that tell a family.
SERIF = ("times", "serif", "georgia", "garamond", "roman", "minion", "charter", "tinos", "caladea", "cambria", "gelasio", "baskerville", "merriweather", "playfair", "notoserif", "ptserif", "librebaskerville", "palatino", "liberation serif")
SANS = (
    "helvetica", "arial", "verdana", "tahoma", "segoe", "calibri", "roboto", "opensans", "open sans", "montserrat", "noto sans", "notosans", "dejavu sans", "liberation sans", "gill", "futura", "myriad", "arimo", "carlito", "cousine", "lato", "nunito", "ubuntu", "poppins",
    "sourcesans", "ptsans", "trebuchet", "comic neue", "comicneue", "comic sans", "comicsans",
)
MONO = ("courier", "mono", "consol", "cousine", "firacode", "fira code", "jetbrains", "ibmplex", "ibm plex", "sourcecode", "source code")
BOLD, ITALIC = "bold|black|heavy|semi.?bold|demi.?bold|medium", "italic|oblique"
LATEX = r"^(cm|lm)[a-z]{1,6}\d"
TEX_TIMES, TEX_HELVETICA, TEX_COURIER = ("texgyretermes", "termes", "nimbusrom", "pagella", "bonum", "schola"), ("texgyreheros", "heros", "nimbussans", "adventor"), ("texgyrecursor", "cursor", "nimbusmono")
TEX_BOLD, TEX_ITALIC = ("cmbx", "cmb", "bx", "bold", "black", "heavy", "semibold"), ("cmti", "cmsl", "cmmi", "cmssi", "cmitt", "cmsltt", "italic", "oblique", "slanted")

# Names of the standard faces, plain, bold, italic, both.
STANDARD = (("sans", ("helv", "hebo", "heit", "hebi")), ("serif", ("tiro", "tibo", "tiit", "tibi")), ("mono", ("cour", "cobo", "coit", "cobi")))
FACE_BOLD, FACE_ITALIC = "bold|black|heavy|semibold|cmbx", "italic|oblique|cmti|cmsl"


def holds(name: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])


def family_key(name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(F.get(F.filter(F.array(*[F.when(F.contains(n, F.lit(p)), k) for p, k in FAMILY_KEYS]), lambda x: x.isNotNull()), 0), F.lit(""))


def style(name: Column, family: Column) -> Column:
    """(family, bold, italic); a sans name beats a serif flag."""
    n = strip_subset(name)
    mono = holds(n, MONO) | (family == "monospace")
    serif = ~mono & (holds(n, SERIF) | ((family == "serif") & ~holds(n, SANS)))
    return F.struct(F.when(mono, "mono").when(serif, "serif").otherwise("sans").alias("family"), n.rlike(BOLD).alias("bold"), n.rlike(ITALIC).alias("italic"))


def standard_family(name: Column) -> Column:
    n = strip_subset(name)
    return F.when(n.rlike("^(helvetica|arial)"), "sans").when(n.rlike("^times|times new roman"), "serif").when(n.rlike("^courier"), "mono")


def latex_profile(name: Column) -> Column:
    """(shape, family, bold, italic) of a TeX font, else null."""
    raw = strip_subset(name)
    n = F.regexp_replace(raw, r"[\s-]", "")
    shape = F.when(holds(n, TEX_TIMES), "times").when(holds(n, TEX_HELVETICA), "helvetica").when(holds(n, TEX_COURIER), "courier").when(raw.rlike(LATEX) | n.rlike("latinmodern|computermodern|^(lmroman|lmsans|lmmono)"), "cm")
    family = F.when(shape == "times", "serif").when(shape == "helvetica", "sans").when(shape == "courier", "mono").when(n.rlike("cmss|lmsans|lmss"), "sans").when(n.rlike("cmtt|cmitt|cmsltt|lmmono|lmtt"), "mono").otherwise("serif")
    return F.when(shape.isNotNull(), F.struct(shape.alias("shape"), family.alias("family"), holds(n, TEX_BOLD).alias("bold"), holds(n, TEX_ITALIC).alias("italic")))


def _yes(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def wishes(edits: DataFrame, families: DataFrame) -> DataFrame:
    """``edits`` with ``size``, ``generic`` and what their face should be: ``want_serif``, ``want_bold``, ``want_italic``, ``want_mono``.

    ``edits`` hold what was chosen (family, font_size, size_override, serif, bold,
    italic), the original text (span_font, span_size, span_mono), the uniform
    style of its line (line_serif, line_bold, line_italic) and the style of one run
    (run_bold, run_italic); ``families(family, generic)`` the families to choose
    from.  The original's size stays unless it was changed; a name that tells a
    family beats the flag unless a family was chosen; a line's style only adds; a
    run's style replaces all others; a fixed pitch is never serif.
    """
    known = families.select(F.col("family").alias("_family"), "generic")
    both = edits.join(known, F.lower(F.coalesce("family", F.lit(""))) == F.col("_family"), "left").drop("_family")
    name = F.lower("span_font")
    told = F.col("span_font").isNotNull() & (F.coalesce("family", F.lit("")) == "")
    run = F.col("run_bold").isNotNull()
    flag = _yes("serif") | _yes(F.col("generic") == "serif")
    serif = F.when(told & holds(name, SANS), False).when(told & holds(name, SERIF), True).otherwise(flag) | (~run & _yes("line_serif"))
    mono = _yes(F.col("generic") == "mono") | _yes(told & (holds(name, MONO) | _yes("span_mono") | _yes(standard_family(F.col("span_font")) == "mono")))
    either = lambda k: F.when(run, _yes(f"run_{k}")).otherwise(_yes(k) | _yes(f"line_{k}"))
    size = F.when((F.col("span_size") > 0) & ~_yes("size_override"), F.col("span_size")).otherwise(F.coalesce(F.nullif("font_size", F.lit(0.0)), F.lit(12.0)))
    return both.withColumns({"size": size, "want_mono": mono, "want_serif": serif & ~mono, "want_bold": either("bold"), "want_italic": either("italic")})


def font_options(wished: DataFrame, faces: DataFrame, *key: str) -> DataFrame:
    """(key, rank, font, kind, style_ok): faces to draw each edit with, best first.

    First the chosen family, or the original's own standard face where the page
    doesn't embed it; then the page's embedded faces, the original's first,
    without TeX's and Type 1, whose glyphs can't be used again; last a face that
    draws everything, Latin Modern and its like for TeX's.  ``faces(doc_id,
    page_index, pos, name, kind)`` lists a page's embedded faces.
    """
    style = F.concat(*(F.col(c).cast("int").cast("string") for c in ("want_bold", "want_italic")))
    own = faces.select("doc_id", "page_index", strip_subset(F.col("name")).alias("_own")).distinct().withColumn("_held", F.lit(True))
    rows = wished.withColumns({"_own": strip_subset(F.col("span_font")), "_std": standard_family(F.col("span_font")), "_tex": latex_profile(F.col("span_font"))}).join(own, ["doc_id", "page_index", "_own"], "left")
    variant = F.col("want_bold").cast("int") + 2 * F.col("want_italic").cast("int")
    standard = F.element_at(F.create_map(*[x for k, names in STANDARD for x in (F.lit(k), F.array(*map(F.lit, names)))]), F.col("_std"))
    option = lambda level, font, kind: F.struct(F.lit(level).alias("level"), F.lit(0).alias("pos"), font.alias("font"), F.lit(kind).alias("kind"), F.lit(True).alias("style_ok"))
    chosen = option(0, F.concat(F.lower("family"), F.lit("_"), style), "family")
    again = option(0, F.get(standard, variant), "winansi")
    first = F.when(F.col("generic").isNotNull(), chosen).when(F.col("_std").isNotNull() & F.col("_held").isNull(), again)
    tex = F.concat_ws("_", F.lit("lx"), "_tex.shape", "_tex.family", F.concat(*((F.col(f"want_{c}") | F.col(f"_tex.{c}")).cast("int").cast("string") for c in ("bold", "italic"))))
    plain = F.concat(F.lit("ed_"), F.when(F.col("want_mono"), "m").otherwise(F.col("want_serif").cast("int").cast("string")), style)
    last = option(2, F.when(F.col("_tex").isNotNull() & F.col("generic").isNull(), tex).otherwise(plain), "any")
    ends = rows.select(*key, F.inline(F.filter(F.array(first, last), lambda x: x.isNotNull())))

    bare = strip_subset(F.col("name"))
    fit = faces.filter((F.col("kind") != "Type1") & latex_profile(F.col("name")).isNull()).select("doc_id", "page_index", "pos", F.col("name").alias("font"), bare.alias("_bare"), bare.rlike(FACE_BOLD).alias("_bold"), bare.rlike(FACE_ITALIC).alias("_italic"))
    held = rows.filter("span_font is not null").join(fit, ["doc_id", "page_index"])
    at = F.col("pos") + F.when(F.col("_bare") == F.col("_own"), F.lit(0)).otherwise(1 << 20)
    inner = held.select(*key, F.lit(1).alias("level"), at.cast("int").alias("pos"), "font", F.lit("embedded").alias("kind"), ((F.col("_bold") == F.col("want_bold")) & (F.col("_italic") == F.col("want_italic"))).alias("style_ok"))
    by = Window.partitionBy(*key).orderBy("level", "pos", "font")
    return ends.unionByName(inner).withColumn("rank", F.row_number().over(by)).select(*key, "rank", "font", "kind", "style_ok")


def _offered(chars: DataFrame, options: DataFrame, charsets: DataFrame, key: str) -> DataFrame:
    """Each text's distinct characters with each of its faces."""
    kinds = chars.select(key, "ch").distinct().join(options.select(key, "rank", "font", "kind"), key)
    return kinds.join(charsets.select("font", "ch").distinct().withColumn("drawn", F.lit(True)), ["font", "ch"], "left")


def _draws() -> Column:
    return F.when(F.col("kind") == "any", True).when(F.col("kind") == "winansi", ~F.col("ch").rlike(WINANSI)).otherwise(_yes("drawn"))


def drawn_by(chars: DataFrame, options: DataFrame, charsets: DataFrame, key: str) -> DataFrame:
    """(key, ch, draws): whether some face of the text draws the character."""
    return _offered(chars, options, charsets, key).groupBy(key, "ch").agg(F.bool_or(_draws()).alias("draws"))


def char_fonts(chars: DataFrame, options: DataFrame, charsets: DataFrame, key: str) -> DataFrame:
    """``chars(key, ch)`` with ``font``, the first of ``options(key, rank, font, kind)`` that draws it, else the last.

    A face of kind ``any`` draws everything, a standard one WinAnsi, others what
    ``charsets(font, ch)`` lists.  Each text's distinct characters are looked up once.
    """
    seen = _offered(chars, options, charsets, key)
    draws = _draws()
    best = seen.groupBy(key, "ch").agg(F.coalesce(F.min_by("font", F.when(draws, F.col("rank"))), F.max_by("font", "rank")).alias("font"))
    return chars.join(best, [key, "ch"], "left")


def font_runs(drawn: DataFrame, key: str) -> DataFrame:
    """(key, run, font, text): neighbouring characters of ``drawn(key, i, ch, font)`` in one face."""
    w = Window.partitionBy(key).orderBy("i")
    marked = drawn.withColumn("run", F.sum((~F.col("font").eqNullSafe(F.lag("font").over(w))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chars = F.transform(F.array_sort(F.collect_list(F.struct("i", "ch"))), lambda x: x["ch"])
    return marked.groupBy(key, "run").agg(F.first("font").alias("font"), F.array_join(chars, "").alias("text"))
