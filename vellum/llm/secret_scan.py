"""Operator 10: secret scans with DataFrame expressions only.

Base kinds are patterns; the method adds spans of high Shannon entropy: each
candidate string of a character class (hex digits; base64 letters; base32
letters; lower-case letters and digits) is read by
a sliding window whose entropy is kept by incremental counts.  For counts c of
a window of w characters, ``H = log2(w) - sum(c * log2(c)) / w``; when one
character leaves and one enters, only their two counts and terms change.  Windows that
touch an entry of the allow list (placeholders, alphabets) are suppressed, and
whole candidates that are published checksums; base spans never are.

Everything is a per-row expression: one scan, no shuffle, no Python worker.
A row without a candidate costs one pattern search a kind.

Work is linear in a text and, but for a factor of the root of their number, in
its spans.

Defined results: null text is empty (no spans, the digest of the empty
string; ``redact`` leaves it null); an empty table gives no rows; spans are in
code points, end exclusive; repeated rows stay; other columns stay as they are,
but ``scan`` replaces those that have the names of its own two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.scratch import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that is long enough is the same match as any run kept by its length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6

WINDOW = 20
#: Code points counted by a window: from "+" to "z".
FIRST_SIGN, SIGNS = 43, 80
#: kind, run of its characters, what a stretch must hold, least bits in some window
CLASSES = (
    ("entropy_hex", "[0-9A-Fa-f]", ("[0-9]", "[A-Fa-f]"), 2.95),
    ("entropy_base64", "[A-Za-z0-9+/=_-]", ("[0-9]", "[A-Z]", "[a-z]"), 3.65),
    ("entropy_base32", "[A-Z2-7]", ("[2-7]", "[A-Z]"), 3.65),
    ("entropy_lower", "[a-z0-9]", ("[0-9]", "[g-z]"), 3.65),
)
ALLOW = r"(?i:wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|example|sample|dummy|placeholder|changeme|redacted|your[-_]?(?:key|token|secret)|xxxx|0000000|deadbeef|0123456789|1234567890|abcdefghij|qwertyuiop)"
#: Candidates that are whole of this form: integrity values, sizes.
CHECKSUM = r"^(?i:sha)(?:1|256|384|512)[-=]|^[0-9]+[xX][0-9]+$"

KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))


def _run(chars: str) -> str:
    return f"{chars}{{{WINDOW},}}"


def _guarded(chars: str, needs: tuple[str, ...]) -> str:
    """The same runs, but only those that hold what they must: most texts then end at one search."""
    return f"(?<!{chars})" + "".join(f"(?={chars}*{x})" for x in needs) + _run(chars)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, init: Column, step, kind: str) -> Column:
    """All results of ``step(state, item) -> (state, result)`` over an array; ``kind`` is the result's type.

    Appending to an array copies it, so results are gathered in parts of about
    the root of their number and the parts are joined once.
    """
    none = F.array().cast(f"array<{kind}>")

    def append(acc: Column, x: Column) -> Column:
        state, result = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def over(held: Column) -> Column:
        part = F.ceil(F.sqrt(F.size(held))).cast("int")
        parts = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.ceil(F.size(held) / part).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

        def one(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(held, k * part + 1, part), F.struct(acc["state"].alias("state"), none.alias("out")), append)
            return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        return F.aggregate(parts, F.struct(init.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), one, lambda a: F.flatten(a["out"]))

    return let(items, over)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs (start, stop, word); ``word`` is the group's text.

    Positions come from the lengths of the pieces between matches, so they count code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(found, lambda x: F.length(x)).alias("len"), words.alias("word"))
    kind = "struct<start:int,stop:int,word:string>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + x["0"]
        return start + x["1"], F.struct(start.alias("start"), (start + x["1"]).alias("stop"), x["2"].alias("word"))

    zipped = rows.cast("array<struct<`0`:int,`1`:int,`2`:string>>")
    return F.when(text.rlike(pattern), running(F.filter(zipped, lambda x: x["1"].isNotNull()), F.lit(0), step, kind)).otherwise(F.array().cast(f"array<{kind}>"))


def _term(c: Column) -> Column:
    """c * log2(c), 0 at 0."""
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def surge(word: Column, bits: float, window: int = WINDOW) -> Column:
    """(first, last) window of ``word`` with at least ``bits``; first is null if there is none.

    One fold over the characters keeps a count of each and the sum of their
    terms; a character that enters or leaves changes one count and one term.
    """
    none = F.lit(None).cast("int")
    empty = F.array_repeat(F.lit(0), SIGNS)
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST_SIGN)

    def put(counts: Column, at: Column, n: Column) -> Column:
        return F.concat(F.slice(counts, F.lit(1), at), F.array(n), F.slice(counts, at + 2, F.lit(SIGNS)))

    def over(held: Column) -> Column:
        def leave(acc: Column, j: Column) -> Column:
            out = F.get(held, j - window)
            n = F.get(acc["counts"], out)
            return F.when(j >= window, F.struct(put(acc["counts"], out, n - 1).alias("counts"), (acc["s"] - _term(n) + _term(n - 1)).alias("s"))).otherwise(F.struct(acc["counts"].alias("counts"), acc["s"].alias("s")))

        def enter(left: Column, acc: Column, j: Column) -> Column:
            new = F.get(held, j)
            n = F.get(left["counts"], new)
            return let(left["s"] + _term(n + 1) - _term(n), lambda s: note(put(left["counts"], new, n + 1), s, j, acc))

        def note(counts: Column, s: Column, j: Column, acc: Column) -> Column:
            at = j - (window - 1)
            high = (at >= 0) & (F.log2(F.lit(float(window))) - s / window >= bits)
            return F.struct(counts.alias("counts"), s.alias("s"), F.when(high & acc["first"].isNull(), at).otherwise(acc["first"]).alias("first"), F.when(high, at).otherwise(acc["last"]).alias("last"))

        init = F.struct(empty.alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(held) - 1), init, lambda acc, j: let(leave(acc, j), lambda left: enter(left, acc, j)), lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return let(codes, over)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _stretch(chars: str) -> str:
    """Matches of checksums, of entries of the allow list, and, as group 1, of what stands between them in a run."""
    checksum = f"(?<!{chars})(?:(?i:sha)(?:1|256|384|512)[-=]{chars}*|[0-9]+[xX][0-9]+(?!{chars}))"
    return f"{checksum}|{ALLOW}|((?:(?!{ALLOW}){chars}){{{WINDOW},}})"


def _entropy(text: Column, kind: str, chars: str, needs: tuple[str, ...], bits: float) -> Column:
    # a text without a candidate costs one search
    some = F.when(text.rlike(_guarded(chars, needs)), text).otherwise("")
    able = F.filter(matches(some, _stretch(chars), 1), lambda m: reduce(lambda a, b: a & b, [m["word"].rlike(x) for x in needs], F.length(m["word"]) >= WINDOW))
    marked = F.transform(able, lambda m: F.struct(m["start"].alias("start"), surge(m["word"], bits).alias("w")))
    high = F.filter(marked, lambda m: m["w"]["first"].isNotNull())
    return _kind(F.transform(high, lambda m: F.struct((m["start"] + m["w"]["first"]).alias("start"), (m["start"] + m["w"]["last"] + WINDOW).alias("stop"))), kind)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["stop"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", added: str = "entropy_spans") -> DataFrame:
    """``docs`` plus the arrays ``base`` and ``added`` of (start, rank, stop, kind); columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(matches(t, ASSIGN, 2), lambda m: F.length(m["word"]) >= ASSIGN_VALUE)
    plain = F.concat(_kind(assign, "assign"), _kind(matches(t, ACCESS), "access"), _kind(matches(t, HEX), "hex"))
    return docs.withColumns({base: plain, added: reduce(lambda a, b: F.concat(a, b), [_entropy(t, *c) for c in CLASSES])})


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the base digest and all spans as text."""
    count = lambda k: F.size(F.filter("base_spans", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(key, count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.concat("base_spans", "entropy_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced; overlapping spans become one mark.  All columns of ``docs`` stay.

    A text is cut at the first span of each part of about the root of their
    number, as finding a place in a text reads it from its beginning.
    """
    base, added = fresh(docs, "base"), fresh(docs, "added")
    t = F.col(text)
    n = F.length(t)

    def cut(spans: Column) -> Column:
        part = F.ceil(F.sqrt(F.size(spans))).cast("int")

        def one(k: Column) -> Column:
            some = F.slice(spans, k * part + 1, part)
            start = F.when(k == 0, 0).otherwise(some[0]["start"])
            stop = F.coalesce(F.get(spans, (k + 1) * part)["start"], n)
            # what earlier parts have covered: their furthest stop
            reach = F.coalesce(F.array_max(F.transform(F.slice(spans, F.lit(1), k * part), lambda m: m["stop"])), F.lit(0))
            return let(F.struct(start.alias("at"), F.substring(t, start + 1, F.greatest(stop, F.array_max(F.transform(some, lambda m: m["stop"]))) - start).alias("text")), lambda p: pieces(some, p, stop, reach))

        def pieces(some: Column, p: Column, stop: Column, reach: Column) -> Column:
            def step(at: Column, m: Column) -> tuple[Column, Column]:
                shown = F.concat(F.substring(p["text"], at - p["at"] + 1, m["start"] - at), F.lit(mark))
                return F.greatest(at, m["stop"]), F.when(m["start"] >= at, shown).otherwise("")

            begun = F.greatest(reach, p["at"])
            done = running(some, begun, step, "string")
            end = F.greatest(begun, F.array_max(F.transform(some, lambda m: m["stop"])))
            rest = F.when(stop > end, F.substring(p["text"], end - p["at"] + 1, stop - end)).otherwise("")
            return F.concat(F.array_join(done, ""), rest)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(spans) / part).cast("int") - 1), one), "")

    spans = F.array_sort(F.concat(base, added))
    return scan(docs, text, base, added).withColumn(text, F.when(F.size(F.concat(base, added)) > 0, let(spans, cut)).otherwise(t)).select(*docs.columns)
