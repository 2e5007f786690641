"""Scalar text functions as Column expressions: no Python runs for a row."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that body fonts lack, and what looks like them.
LOOKALIKES = {
    " ": " ", " ": " ", " ": " ", " ": " ", " ": " ", " ": " ",
    "․": ".", "−": "-", "∼": "~", "⁃": "-",
}
PLACEHOLDER = r"\{\{\s*[^{}]+?\s*\}\}"
#: Wide characters of layout estimates.
WIDE = r"[ᄀ-ᇿ⺀-꓏가-힯豈-﫿＀-￯]"
#: Code point ranges by script.
SCRIPTS = {
    "kana": r"[ぁ-ヺヽ-ヿｦ-ﾝ]",
    "han": r"[一-鿿㐀-䶿々]",
    "hangul": r"[가-힣ㄱ-ㆎ]",
    "latin": r"[A-Za-zÀ-ɏḀ-ỿ]",
    "greek": r"[Ͱ-Ͽ]",
    "digit": r"[0-9]",
}


def _lit(x: str | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def count_of(text: Column, find: str | Column) -> Column:
    """Non-overlapping occurrences of a literal; null text and empty find give 0."""
    f = _lit(find)
    gone = F.length(text) - F.length(F.replace(text, f, F.lit("")))
    return F.when(F.length(f) > 0, F.coalesce((gone / F.length(f)).cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in order: later pairs see what earlier ones wrote."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def _quoted(find: str) -> str:
    return r"\Q" + find.replace(r"\E", r"\E\\E\Q") + r"\E"


def replaced_ignoring_case(text: Column, find: str, by: str) -> Column:
    return F.regexp_replace(text, "(?iu)" + _quoted(find), by.replace("\\", "\\\\").replace("$", "\\$"))


def placeholders(text: Column) -> Column:
    """Distinct {{ name }} marks in the order in which they first stand."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)))


def left_after(text: Column, find: str, by: str) -> Column:
    """Occurrences left after a replacement; none count when the replacement brings the phrase itself."""
    return F.lit(0).cast("long") if find in by else count_of(text, find)


def xml_escaped(text: Column) -> Column:
    return replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def xml_unescaped(text: Column) -> Column:
    """The ampersand comes last, so that &amp;lt; becomes &lt;."""
    return replaced(text, [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")])


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def same_ignoring_space(a: Column, b: Column) -> Column:
    return without_space(a) == without_space(b)


def dense_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(without_space(text)).cast("long")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: supplementary characters count twice."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def plain_lookalikes(text: Column) -> Column:
    return F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def has_private_use(text: Column) -> Column:
    return text.rlike(r"[-\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]")


def circled_digits(text: Column) -> Column:
    """Symbol-font places U+F080..U+F095 to circled and dark circled digits."""
    source = "".join(map(chr, range(0xF080, 0xF096)))
    target = chr(0x24EA) + "".join(map(chr, range(0x2460, 0x246A))) + chr(0x24FF) + "".join(map(chr, range(0x2776, 0x2780)))
    return F.translate(text, source, target)


def width_weight(text: Column, narrow: float = 0.55) -> Column:
    """Estimated width: wide characters count 1, others `narrow`."""
    wide = F.regexp_count(text, F.lit(WIDE))
    return wide + (F.length(text) - wide) * F.lit(narrow)


def script_counts(text: Column) -> Column:
    return F.struct(*(F.regexp_count(text, F.lit(p)).cast("long").alias(s) for s, p in SCRIPTS.items()))


def line_script(text: Column, confidence: Column) -> Column:
    """ja, han, gr, la or other of a recognised line."""
    n = {s: F.regexp_count(text, F.lit(p)) for s, p in SCRIPTS.items()}
    return (
        F.when(confidence < 0.6, "other").when(n["kana"] > 0, "ja").when(n["han"] + n["latin"] + n["greek"] == 0, "other")
        .when(n["han"] >= F.greatest(F.lit(1), n["latin"]), "han").when(n["greek"] > n["latin"], "gr").otherwise("la")
    )


_EAST_ASIAN = r"[぀-ヿ㐀-鿿가-힣]"


def needs_vietnamese(text: Column) -> Column:
    marks = r"[ĂăÂâĐđÊêÔôƠơƯưẠ-ỵ̃̀́̃̉]"
    return text.rlike(marks) & ~text.rlike(_EAST_ASIAN)


def needs_thai(text: Column) -> Column:
    return text.rlike(r"[฀-๿]") & ~text.rlike(_EAST_ASIAN)


def byte_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.2f MB", n / 1024.0 / 1024.0))
    )


def exif_date(text: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS with hyphens; no zone is invented. Anything else is only trimmed."""
    return F.regexp_replace(F.trim(text), r"^(\d{4}):(\d{2}):(\d{2})[ T](\d{2}):(\d{2}):(\d{2}).*$", "$1-$2-$3 $4:$5:$6")


def target_size(width: Column, height: Column, mode: str, value: float, no_upscale: bool = True) -> Column:
    """struct(width, height) of a resize by width, height, longest side or percent."""
    ratio = height / width
    w, h = {
        "width": (F.lit(float(value)), F.lit(float(value)) * ratio),
        "height": (F.lit(float(value)) / ratio, F.lit(float(value))),
        "longest": (width * (value / F.greatest(width, height)), height * (value / F.greatest(width, height))),
        "percent": (width * value / 100.0, height * value / 100.0),
    }[mode]
    if no_upscale:
        up = w > width
        w, h = F.when(up, width).otherwise(w), F.when(up, height).otherwise(h)
    one = F.lit(1).cast("long")
    return F.struct(F.greatest(one, js_round(w).cast("long")).alias("width"), F.greatest(one, js_round(h).cast("long")).alias("height"))


def safe_file_name(name: Column, fallback: Column, ext: str) -> Column:
    """Illegal characters to _, spaces to one, trimmed; the fallback when nothing is left; the extension once."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"(?U)\s+", " "))
    base = F.when(F.length(clean) > 0, clean).otherwise(fallback.cast("string"))
    return F.when(F.endswith(base, F.lit("." + ext)), base).otherwise(F.concat(base, F.lit("." + ext)))


def filled(template: str, values: dict[str, Column], spaced: bool = True) -> Column:
    """A literal template with its {{key}} marks replaced by columns; null is empty. Not spaced: only {{key}} and {{ key }} count.

    The template is cut once, on the driver, and put together as one concat: a value that holds a mark is not filled
    again, and no pattern runs for a row.
    """
    space = r"\s*" if spaced else " ?"
    parts, at = [], 0
    for m in re.finditer(r"\{\{(" + space + r")([^{}]+?)(" + space + r")\}\}", template):
        if m[2] in values and (spaced or m[1] == m[3]):
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[2]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


#: Weights by words of a style, the first that fits.
FONT_WEIGHTS = (
    ("thin|hairline", 100), ("extralight|ultralight", 200), ("light", 300), ("medium", 500), ("semibold|demibold", 600), ("extrabold|ultrabold", 800), ("black|heavy", 900), ("bold", 700),
)


def font_name(name: Column) -> Column:
    """struct(family, style, weight) of an embedded font's name without its subset tag."""
    bare = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    style = F.regexp_extract(bare, r"[-,](.*)$", 1)
    weight = F.lit(400)
    for pattern, w in reversed(FONT_WEIGHTS):
        weight = F.when(F.lower(style).rlike(pattern), w).otherwise(weight)
    return F.struct(F.regexp_extract(bare, r"^([^-,]*)", 1).alias("family"), style.alias("style"), weight.alias("weight"))


def nearest_weight(wanted: Column, have: Column) -> Column:
    """Of an array of weights the one nearest to the wanted, the bolder on a tie."""
    return F.array_min(F.transform(have, lambda w: F.struct(F.abs(w - wanted).alias("away"), (-w).alias("less"))))["less"] * -1


def metadata_format(content: Column) -> Column:
    """jpeg, png, webp, pdf, ole or zip by the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "jpeg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
        .when(F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250")), "webp").when(F.startswith(head, F.lit("25504446")), "pdf")
        .when(F.startswith(head, F.lit("D0CF11E0A1B11AE1")), "ole").when(F.startswith(head, F.lit("504B0304")), "zip")
    )


#: Order in which metadata tags are reported.
TAG_ORDER = ("gps", "camera", "datetime", "thumbnail", "software", "exif", "xmp", "iptc", "comment", "docinfo")


def tags_by_risk(tags: Column) -> Column:
    return F.array_intersect(F.array(*map(F.lit, TAG_ORDER)), tags)


#: Words of messages of readers, the file system and Python, by the code of this engine that they mean; the first that fits.
ERROR_WORDS = {
    "NOT_FOUND": ("enoent", "filenotfound", "path does not exist"), "TOO_LARGE": ("too large", "bytes, the limit is"), "PASSWORD_WRONG": ("wrong password",),
    "PASSWORD_REQUIRED": ("password",), "UNSUPPORTED": ("not supported", "no reader", "no metadata is read"), "BAD_ARGUMENT": ("out of range", "is needed", "unknown argument"),
}
CODES = (*ERROR_WORDS, "EMPTY", "NOT_APPLIED", "RULE", "VERIFY_FAILED", "UNREADABLE")


def error_code(message: Column) -> Column:
    """The code that a message begins with (CODE: ..), else the one its words mean, else UNREADABLE."""
    low, out = F.lower(message), F.lit("UNREADABLE")
    for code, words in reversed(ERROR_WORDS.items()):
        said = reduce(lambda x, y: x | y, (F.contains(low, F.lit(w)) for w in words))
        out = F.when(said, code).otherwise(out)
    own = F.regexp_extract(message, r"^([A-Z_]+):", 1)
    return F.when(own.isin(*CODES), own).otherwise(out)


def upper_median_of(column: str) -> Column:
    """The upper middle of a group, as an aggregate that keeps counts of values and no list."""
    return F.expr(f"percentile_disc(0.5) within group (order by `{column}` desc)")


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of an even number."""
    s = F.array_sort(values)
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bitmap_similarity(a: Column, b: Column) -> Column:
    """0.5 IoU + 0.5 tolerant overlap (a pixel's slack) of two glyphs, arrays of 32 rows of 32 bits."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    ones = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + F.bit_count(v.cast("long").bitwiseAND(mask)))

    def grown(x: Column) -> Column:
        wide = F.transform(x, lambda v: v.cast("long").bitwiseAND(mask).bitwiseOR(F.shiftleft(v.cast("long"), 1)).bitwiseOR(F.shiftrightunsigned(v.cast("long").bitwiseAND(mask), 1)).bitwiseAND(mask))
        up = F.concat(F.slice(wide, 2, F.size(wide)), F.array(F.lit(0).cast("long")))
        down = F.concat(F.array(F.lit(0).cast("long")), F.slice(wide, 1, F.size(wide) - 1))
        return F.zip_with(F.zip_with(wide, up, lambda p, q: p.bitwiseOR(q)), down, lambda p, q: p.bitwiseOR(q))

    both = lambda x, y: ones(F.zip_with(x, y, lambda p, q: p.cast("long").bitwiseAND(q.cast("long"))))
    any_ = ones(F.zip_with(a, b, lambda p, q: p.cast("long").bitwiseOR(q.cast("long"))))
    iou = F.when(any_ > 0, both(a, b) / any_).otherwise(0.0)
    total = ones(a) + ones(b)
    tolerant = F.when(total > 0, (both(a, grown(b)) + both(b, grown(a))) / total).otherwise(0.0)
    return 0.5 * iou + 0.5 * tolerant
