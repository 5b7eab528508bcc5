"""Column builders for text: folding, similarity, sort keys, names, tags and paths. None of them is a UDF."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that search drops (not replaced by a space).
SEARCH_DROPS = ".,/#!?$%^&*;:{}=-_'\"´`~()"
#: Punctuation that the closest-match comparison drops.
CLOSEST_DROPS = " -'’\".!?"


@cache
def _fold_table() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII-range base and marks, and their bases."""
    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x1F00) for d in (unicodedata.normalize("NFD", chr(i)),) if len(d) > 1 and ord(d[0]) < 0x250]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold_accents(c: Column, drop: str = "") -> Column:
    """Letters without their marks, in one pass; marks that stand alone go, and so do the characters of ``drop``.
    Letters that have no decomposition (ß, ø) stay."""
    marked, bases = _fold_table()
    return F.translate(c, marked + MARKS + drop, bases)


def format_search(c: Column, spaces: bool = True) -> Column:
    """Search form: lower case, without punctuation and accents, and without white space if ``spaces`` is false; null is empty."""
    x = fold_accents(F.lower(F.coalesce(c, F.lit(""))), SEARCH_DROPS)
    return x if spaces else F.regexp_replace(x, r"\s+", "")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")


def closest_form(c: Column) -> Column:
    return fold_accents(F.lower(c), CLOSEST_DROPS)


def similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(F.levenshtein(a, b), longest))


def coverage(text: Column, words: Column) -> Column:
    """Share of ``words`` that occur anywhere in ``text``."""
    n = F.size(words)
    return F.when((n > 0) & (text != ""), F.try_divide(F.size(F.filter(words, lambda w: F.contains(text, w))), n)).otherwise(0.0)


def occurrences(text: Column, part: Column) -> Column:
    """Number of occurrences that don't overlap, from the left."""
    n = F.length(part)
    return F.when(n > 0, F.try_divide(F.length(text) - F.length(F.replace(text, part, F.lit(""))), n)).otherwise(0).cast("int")


def natural_key(c: Column) -> Column:
    """Sorts a2 before a10, whatever case and accents: digit runs are padded to twenty places."""
    parts = F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def number_parts(c: Column) -> Column:
    """struct(empty, prefix, number, suffix) of a song number such as MP133b; without digits the number is infinite."""
    x = F.trim(F.coalesce(c, F.lit("")))
    pattern = r"^([A-Za-z]*)(\d+)?([A-Za-z]*)$"
    digits = F.regexp_extract(x, pattern, 2)
    return F.struct(
        (x == "").alias("empty"),
        F.upper(F.regexp_extract(x, pattern, 1)).alias("prefix"),
        F.when(digits != "", digits.cast("double")).otherwise(F.lit(float("inf"))).alias("number"),
        F.upper(F.regexp_extract(x, pattern, 3)).alias("suffix"),
    )


def file_parts(c: Column) -> Column:
    """struct(stem, number, extension): trailing digits of the stem are its number, else 0."""
    pattern = r"^(.*?)(\d+)?(\.\w+)?$"
    return F.struct(
        F.regexp_extract(c, pattern, 1).alias("stem"),
        F.coalesce(F.regexp_extract(c, pattern, 2).try_cast("long"), F.lit(0)).alias("number"),
        F.regexp_extract(c, pattern, 3).alias("extension"),
    )


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def sanitize_verse(c: Column) -> Column:
    """Breaks and non-breaking spaces become spaces, quotation tags quotation marks, other tags go, spaces are squeezed."""
    x = F.regexp_replace(c, r"(?i)<br\s*/?>|&nbsp;|\u00a0", " ")
    x = strip_tags(F.regexp_replace(x, r"(?i)</?q\b[^>]*>", '"'))
    return F.trim(F.regexp_replace(x, " {2,}", " "))


def label_id(c: Column, digits: bool = False) -> Column:
    """Group id of a section label: lower case, without repeat counts, brackets and quotes; digits only if asked for."""
    x = F.regexp_replace(F.lower(c), r"x\d+", "")
    x = F.regexp_replace(x, "[\\[\\](){}'\":]", "")
    x = x if digits else F.regexp_replace(x, r"\d", "")
    return F.regexp_replace(F.trim(x), r"\s+", "_")


def file_name(c: Column) -> Column:
    """A legal file name of at most 255 characters: colons become commas, other illegal characters go."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, ":", ","), r'[/\\?%*|"<>\x00-\x1f]', "")), 1, 255)


def variable_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), " ", "_")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\?#]+)(?:[?#].*)?$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


#: Media type by extension.
MEDIA_TYPES = {
    "audio": ("aac", "flac", "m4a", "mp3", "ogg", "opus", "wav"),
    "image": ("avif", "bmp", "gif", "jpeg", "jpg", "png", "svg", "tif", "tiff", "webp"),
    "video": ("avi", "m4v", "mkv", "mov", "mp4", "mpeg", "webm", "wmv"),
}


def media_type(path: Column) -> Column:
    found = F.lit("unknown")
    for name, endings in MEDIA_TYPES.items():
        found = F.when(extension(path).isin(*endings), name).otherwise(found)
    return found


def format_bytes(n: Column) -> Column:
    """1536 -> 1.5 KB, to two decimals without trailing zeros."""
    step = F.when(n >= 1, F.floor(F.log(1024.0, F.greatest(n, F.lit(1)).cast("double")) + 1e-12)).otherwise(0).cast("int")
    value = F.round(n / F.pow(F.lit(1024.0), step), 2)
    shown = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.concat(F.when(n >= 1, shown).otherwise("0"), F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB"))), step + 1))


def snippet(text: Column, query: Column, before: int = 30, after: int = 50) -> Column:
    """The first match with its surroundings, dots where the text goes on; empty without a match."""
    at = F.position(F.lower(query), F.lower(text))
    start = F.greatest(at - before, F.lit(1))
    end = F.least(at + F.length(query) - 1 + after, F.length(text))
    cut = F.substring(text, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end < F.length(text), "...").otherwise(""))).otherwise("")


def highlight(text: Column, query: str) -> Column:
    """Marks the whole phrase where it occurs, else the query's words, the longest first."""
    import re

    phrase = re.escape(query.strip())
    words = "|".join(re.escape(w) for w in sorted(set(query.split()), key=lambda w: (-len(w), w)))
    mark = lambda p: F.regexp_replace(text, f"(?i)({p})", "<mark>$1</mark>")
    return F.when(text.rlike(f"(?i){phrase}"), mark(phrase)).otherwise(mark(words)) if words else text


def acronym(c: Column) -> Column:
    """First letters of the words; of a single word its first three letters."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > 1, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))).otherwise(F.upper(F.substring(F.trim(c), 1, 3)))


def part_letter(n: Column) -> Column:
    """1 -> a, 26 -> z."""
    return F.chr(n + 96)


def string_hash32(c: Column) -> Column:
    """The 32-bit rolling hash h * 31 + code over characters, wrapped to a signed int."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x))
    wrap = lambda v: F.pmod(v + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x)).cast("int")


def style_map(c: Column) -> Column:
    """``color: red; top: 1px`` as a map of trimmed names and values; a repeated name takes the last value."""
    pairs = F.filter(F.split(c, ";"), lambda p: F.contains(p, F.lit(":")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)), F.trim(F.regexp_extract(p, r"(?s)^[^:]*:(.*)$", 1))))
    start = F.expr("cast(map() as map<string,string>)")
    return F.aggregate(entries, start, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["col1"]), F.map_from_arrays(F.array(e["col1"]), F.array(e["col2"]))))


def typed(c: Column) -> Column:
    """struct(kind, flag, number) of a message's argument: true and false, numbers, else text; empty text stays text."""
    number = F.when(F.trim(c) != "", c.try_cast("double"))
    kind = F.when(c.isin("true", "false"), "boolean").when(number.isNotNull(), "number").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind == "boolean", c == "true").alias("flag"), F.when(kind == "number", number).alias("number"))


def feed_text(items: Column, divider: str = " | ", most: int = 5) -> Column:
    """``title: description`` of a feed's first items in one line."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda i: F.concat_ws(": ", i["title"], i["description"])), divider)


def decorations(template: Column, own: Column, underline: bool = False, line_through: bool = False) -> Column:
    """A template's text decorations, with underline and line-through as the text itself has them where they are to be
    kept; ``none`` if there are none."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    out, have = words(template), words(own)
    for name, keep in (("underline", underline), ("line-through", line_through)):
        if keep:
            out = F.when(F.array_contains(have, name), F.array_union(out, F.array(F.lit(name)))).otherwise(F.array_remove(out, name))
    return F.when(F.size(out) == 0, "none").otherwise(F.array_join(out, " "))


def halves(c: Column) -> Column:
    """One or two parts: behind the last of . , ! ? in the middle half of the text, else at the space closest to its middle."""
    n, centre = F.length(c), F.floor(F.length(c) / 2).cast("int")
    margin = F.floor(centre / 2).cast("int")
    low = centre - margin
    window = F.substring(c, low + 1, 2 * margin + 1)
    marked = F.length(F.regexp_extract(window, r"^(?s:.*)[.,!?]", 0))
    head = F.length(F.regexp_extract(F.substring(c, F.lit(1), centre + 1), r"^(?s:.*) ", 0))
    tail = F.position(F.lit(" "), F.substring(c, centre + 1, n))
    left, right = F.when(head > 0, head - 1), F.when(tail > 0, centre + tail - 1)
    space = F.when(right.isNull() | (centre - left <= right - centre), left).otherwise(right)
    at = F.when(marked > 0, low + marked).otherwise(F.coalesce(space, right))
    parts = F.array(F.trim(F.substring(c, F.lit(1), at)), F.trim(F.substring(c, at + 1, n)))
    return F.when(at.isNull(), F.array(c)).otherwise(parts)


def broken_lines(line: Column, most: int, rounds: int = 24) -> Column:
    """A line of over ``most`` words in halves, those again in halves, and so on; array of the lines in order."""
    words = F.split(line, " ")

    def cut(parts: Column, _: Column) -> Column:
        half = lambda w: F.floor(F.size(w) / 2).cast("int")
        two = lambda w: F.array(F.slice(w, F.lit(1), half(w)), F.slice(w, half(w) + 1, F.size(w)))
        again = F.flatten(F.transform(parts, lambda w: F.when(F.size(w) > most, two(w)).otherwise(F.array(w))))
        return F.when(F.exists(parts, lambda w: F.size(w) > most), again).otherwise(parts)

    parts = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(words), cut)
    return F.transform(parts, lambda w: F.array_join(w, " "))


def filled(text: Column, values: dict[str, Column], drop: tuple[str, ...] = ()) -> Column:
    """``{name}`` placeholders replaced by values; those of ``drop`` go, with the space behind them."""
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    for name in drop:
        text = F.replace(F.replace(text, F.lit(f"{{{name}}} "), F.lit("")), F.lit(f"{{{name}}}"), F.lit(""))
    return text


def without_tokens(lines: Column) -> Column:
    """Lines without dynamic tokens such as ``{time_h}``."""
    return F.transform(lines, lambda x: F.regexp_replace(x, r"\{[A-Za-z]\w*(?:[#|][^{}]*)?\}", ""))
