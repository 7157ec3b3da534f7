"""Text predicates and clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases a form keeps as entered.
PROTECTED_PHRASES = [
    "Not Applicable",
    "Data Not Available",
    "Absent",
    "Not Visible",
    "As per approved GAD",
]

# Spoken forms of the protected phrases, tested in this order.
PHRASE_FORMS = {
    "not applicable": "Not Applicable",
    "n/a": "Not Applicable",
    "data not available": "Data Not Available",
    "not available": "Data Not Available",
    "same as above": "Same as above",
    "absent": "Absent",
    "not visible": "Not Visible",
    "as per approved gad": "As per approved GAD",
}

# Words that look like bar marks but are column headers.
NOT_BAR_MARKS = [
    "dia", "nos", "no", "mk", "wt", "kg", "m", "mm", "cm", "pile", "pier", "pilecap",
    "bar", "mark", "total", "unit", "length", "weight", "spacing", "count", "number", "shape",
]

# Thanks in words and signs.
GRATITUDE_WORDS = ["thank you", "thanks", "thankyou", "thank u", "shukriya", "dhanyawad"]
GRATITUDE_EMOJI = ["👍", "🙏", "❤️", "😊", "🤝", "👏"]


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once.

    An expression written inside a lambda is computed again for every element; a
    lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    """Trim all white space, not only spaces."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_group(c: Column, pattern: str, groups: int) -> Column:
    """The first non-empty group of the first match."""
    return F.coalesce(*[first_match(c, pattern, i) for i in range(1, groups + 1)])


def present_text(c: Column) -> Column:
    """The value as it is, or NULL when it is blank or a dash."""
    return F.when(~strip(c).isin("", "-"), c)


def cell_text(c: Column) -> Column:
    """A report cell as trimmed text, NULL for blank, a dash or ``None``."""
    t = strip(c)
    return F.when(~t.isin("", "-", "None"), t)


def first_present(*cs: Column) -> Column:
    return F.coalesce(*[present_text(c) for c in cs])


def location(lat: Column, lon: Column) -> Column:
    lat, lon = present_text(lat), present_text(lon)
    return F.concat(lat, F.lit("° , "), lon, F.lit("°"))


def division_circle(div: Column, cir: Column) -> Column:
    """``div / cir`` when both are present and differ, else whichever is."""
    d, c = present_text(div), present_text(cir)
    return F.when(d != c, F.concat(d, F.lit(" / "), c)).otherwise(F.coalesce(d, c))


def spans_cell(spans: Column) -> Column:
    t = cell_text(spans)
    return F.concat(F.lit("Number of Span: "), t)


def combine(parts: list[Column], sep: str) -> Column:
    """The present parts joined by ``sep``, a dash if there are none."""
    joined = F.concat_ws(sep, *[present_text(p) for p in parts])
    return F.when(joined == "", "-").otherwise(joined)


def safe(c: Column, default: str = "-") -> Column:
    """A default for NULL only; zero and blank stay."""
    return F.coalesce(c.cast("string"), F.lit(default))


def is_protected(c: Column) -> Column:
    return c.isin(*PROTECTED_PHRASES)


def is_gratitude(c: Column) -> Column:
    words = "|".join([*GRATITUDE_WORDS, *GRATITUDE_EMOJI])
    return F.lower(c).rlike(words)


def command(c: Column) -> Column:
    return F.lower(strip(c))


def bar_mark_token(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip(c), "^['\"]+|['\"]+$", ""))


def is_bar_mark(c: Column) -> Column:
    t = bar_mark_token(c)
    return t.rlike(r"^[a-z]\d{0,2}$") & ~t.isin(*NOT_BAR_MARKS)


def normal_hyphens(c: Column) -> Column:
    """Soft hyphen, en dash and em dash become a plain hyphen."""
    return F.translate(c, "­–—", "---")


def strip_text_codes(c: Column) -> Column:
    """Remove ``%%`` escapes of single-line text; keep degree, plus-minus and diameter."""
    out = F.regexp_replace(c, "%%[uUoO]", "")
    for code, sign in (("[dD]", "°"), ("[pP]", "±"), ("[cC]", "Ø"), (r"\d{3}", "")):
        out = F.regexp_replace(out, "%%" + code, sign)
    return strip(out)


def strip_mtext_codes(c: Column) -> Column:
    """Remove inline codes of multi-line text but keep what braces enclose."""
    out = F.replace(c, F.lit("\\P"), F.lit("\n"))
    out = F.regexp_replace(out, r"\\[LlOoKk]", "")
    out = F.regexp_replace(out, r"\\[pCcFfAaQqHhWwBbIiTtSs][^;]*;", "")
    out = F.translate(out, "{}", "")
    return strip(F.replace(out, F.lit("\\~"), F.lit(" ")))


def strip_dimension_override(c: Column) -> Column:
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"\\[A-Za-z][^;\\]*?;", "")
    out = F.translate(out, "{}", "")
    out = F.regexp_replace(out, r"\\[XxPp]", " ")
    out = strip(F.replace(out, F.lit("<>"), F.lit("")))
    return strip(F.regexp_replace(out, r"\s{2,}", " "))


def value_after_label(raw: Column, label: Column | str) -> Column:
    """What follows the first occurrence of a label, when it is unambiguous.

    The text up to the next boundary is returned as a protected phrase, as a
    measurement ``n m``, or as it is up to 80 characters.
    """
    label = F.lit(label) if isinstance(label, str) else label
    low = F.lower(raw)
    at = F.position(label, low)
    rest = strip(F.substring(raw, at + F.length(label), F.length(raw)))
    low_rest = F.lower(rest)
    stops = [F.locate(s, low_rest) for s in ("next ", " and then ", "\n")]
    end = F.least(*[F.when(s > 1, s - 1) for s in stops])
    chunk = F.coalesce(F.substring(rest, F.lit(1), end), rest)
    chunk = F.regexp_replace(strip(chunk), "[.,]+$", "")
    low_chunk = F.lower(chunk)
    phrase = F.lit(None).cast("string")
    for form, value in reversed(list(PHRASE_FORMS.items())):
        phrase = F.when(low_chunk.startswith(form), value).otherwise(phrase)
    number = first_match(chunk, r"(?i)^(\d+(?:\.\d+)?)\s*(?:m|meter|metre|mtr)?\b")
    value = (
        F.when(phrase.isNotNull(), phrase)
        .when(number.isNotNull(), F.concat(number, F.lit(" m")))
        .when(F.length(chunk) <= 80, chunk)
    )
    return F.when((at > 0) & (chunk != ""), value)


def file_name(parts: list[Column]) -> Column:
    """Non-word characters become underscores; slashes in a part become dashes."""
    clean = [F.regexp_replace(F.replace(p, F.lit("/"), F.lit("-")), r"[^\w\-]+", "_") for p in parts]
    return F.concat_ws("_", *clean)


def short_title(desc: Column, words: int = 10) -> Column:
    return F.array_join(F.slice(F.split(strip(desc), r"\s+"), 1, words), " ")


def number_g(v: Column) -> Column:
    """A number with up to six significant digits and no trailing zeros."""
    text = F.format_string("%.6g", v)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by each value, NULL as nothing."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def fill_from_map(template: Column, values: Column) -> Column:
    """Replace every ``{{key}}`` of a string map."""
    return F.aggregate(
        F.map_entries(values),
        template,
        lambda acc, e: F.replace(
            acc,
            F.concat(F.lit("{{"), e["key"], F.lit("}}")),
            F.coalesce(e["value"], F.lit("")),
        ),
    )


def photo_refs(c: Column) -> Column:
    """All photo numbers a text refers to, in order."""
    found = F.regexp_extract_all(c, F.lit(r"\(Photo No\.-(\d+)\)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("int"))


# How an issue description states design and drawing; the groups in
# (design, drawing) order and the unit added to both.
COMPARISON_FORMS = [
    (r"(?i)drawn as ([\d,.]+\s*mm) but design specifies ([\d,.]+\s*mm)", 2, 1, ""),
    (r"(?i)has segment ([\d,.]+\s*mm) but closest value in drawing is ([\d,.]+\s*mm)", 1, 2, ""),
    (r"(?i)(\d+) bar(?:s|\(s\))? (?:are|is) drawn.+?Expected (\d+)", 2, 1, " bars"),
    (r"(?i)Design input [a-z ]+= (.+?) for (?:bar )?'.+?Drawing (?:schedule )?shows (.+?)\.?$", 1, 2, ""),
    (r"(?i)specifies (\d+) bars? for .+?Drawing schedule shows (\d+) bars?", 1, 2, " nos"),
    (r"(?i)specifies (\d+\s*mm) diameter.+?Drawing (?:schedule )?shows (\d+\s*mm)", 1, 2, ""),
    (r"(?i)specifies ([\d.]+\s*mm\s*c/c).+?Drawing (?:schedule )?shows ([\d.]+\s*mm\s*c/c)", 1, 2, ""),
    (r"(?i)specifies spacing of ([\d.]+\s*mm\s*c/c)", 1, 0, ""),
]


def comparison_pair(desc: Column) -> Column:
    """Design and drawing values stated in a description, as a struct or NULL."""
    out = F.lit(None).cast("struct<design:string,drawing:string>")
    for pattern, design, drawing, unit in reversed(COMPARISON_FORMS):
        d = F.concat(F.regexp_extract(desc, pattern, design), F.lit(unit))
        w = (
            F.concat(F.regexp_extract(desc, pattern, drawing), F.lit(unit))
            if drawing
            else F.lit("not shown")
        )
        pair = F.struct(strip(d).alias("design"), strip(w).alias("drawing"))
        out = F.when(F.regexp_like(desc, F.lit(pattern)), pair).otherwise(out)
    return out


# Words for numbers and for units in dictated notes.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
UNIT_WORDS = [
    (r"(?i)\b(?:kilometers|kilometer|kilometres|kilometre)\b", "km"),
    (r"(?i)\b(?:meters|meter|metres|metre)\b", "m"),
    (r"(?i)\bplus\b", "+"),
    (r"(?i)\bminus\b", "−"),
    (r"(?i)\b(?:multiplied by|into|times)\b", "×"),
]


def unit_words(c: Column) -> Column:
    for pattern, sign in UNIT_WORDS:
        c = F.regexp_replace(c, pattern, sign)
    return c


def number_words(c: Column) -> Column:
    """Number words as digits, only inside table, figure, picture and photo references."""
    words = "|".join(NUMBER_WORDS)
    phrase = rf"(?i)\b(?:tables?|figures?|pictures?|photos?)(?:\s+(?:number|no\.?))?(?:[\s,]+(?:and\s+)?(?:{words}))+\b"
    hits = F.regexp_extract_all(c, F.lit(phrase), F.lit(0))

    def digits(p: Column) -> Column:
        for i, w in enumerate(NUMBER_WORDS, 1):
            p = F.regexp_replace(p, rf"(?i)\b{w}\b", str(i))
        return p

    return F.aggregate(hits, c, lambda acc, p: F.replace(acc, p, digits(p)))


def lenient_json(c: Column, schema: str) -> Column:
    """The object inside a reply with fences or preamble; ``_corrupt_record`` holds what cannot be parsed."""
    body = F.regexp_extract(c, r"(?s)(\{.*)", 1)
    body = F.regexp_replace(body, r"(?s)\s*```.*$", "")
    whole = F.regexp_extract(body, r"(?s)^(\{.*\})", 1)
    return F.from_json(
        F.when(whole != "", whole).otherwise(body),
        f"{schema}, _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
