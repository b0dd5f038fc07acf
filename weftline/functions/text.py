"""Column functions on text. Each takes and gives Columns, stays inside the JVM and is null for a null text unless it
says otherwise. Indices count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# The characters that count as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ROT = _UPPER[13:] + _UPPER[:13]


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A lambda evaluates what it captures for each element, so whatever is
    costly and used within one, or more than once, is bound this way first."""
    return F.get(F.transform(F.array(x), body), 0)


def let2(x: Column, y: Column, body: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(x.alias("x"), y.alias("y")), lambda v: body(v["x"], v["y"]))


def strip(x: Column) -> Column:
    """The text without white space of any script at either end (``trim`` alone knows the blank only; a regular
    expression would look at each blank of a long run again)."""
    return F.btrim(x, F.lit(WHITE))


def is_blank(x: Column) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(strip(x), F.lit("")) == ""


def tokens(x: Column) -> Column:
    """The parts between runs of white space, none of them empty; no parts for null."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def word_count(x: Column) -> Column:
    """How many parts there are between runs of white space; 0 for null."""
    return F.size(tokens(x))


def normalize_answer(x: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles taken out, single blanks between words."""
    bare = F.translate(F.lower(x), PUNCTUATION, "")
    return F.array_join(tokens(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")), " ")


def answer_tokens(x: Column) -> Column:
    """The words of the normalised answer; none for null and empty."""
    return tokens(normalize_answer(F.coalesce(x, F.lit(""))))


def capitalize_first(x: Column, only_lower: bool = False) -> Column:
    """The first character in upper case, the rest as it is. ``only_lower``: only if it is a lower-case letter now."""
    first = F.substring(x, 1, 1)
    up = F.concat(F.upper(first), F.substring(x, 2, 1 << 30))
    return F.when(first != F.lower(first), x).otherwise(up) if only_lower else up


def approx_tokens(x: Column) -> Column:
    """An estimate without a tokenizer: 1.3 for each part between white space, rounded up."""
    return F.ceil(word_count(x) * F.lit(13) / F.lit(10)).cast("long")


def sentences(x: Column) -> Column:
    """The parts after each run of white space that follows . ! or ?, stripped, without blank ones."""
    return F.filter(F.transform(F.split(strip(x), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def lines(x: Column) -> Column:
    """The lines that aren't blank."""
    return F.filter(F.split(strip(x), "\n"), lambda s: strip(s) != "")


def letter_count(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]", ""))


def rot13(x: Column) -> Column:
    return F.translate(x, _UPPER + _UPPER.lower(), _ROT + _ROT.lower())


def words_of(x: Column, letters: str = "a-z") -> Column:
    """The distinct words of lower-case ``letters`` in the text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(rf"(?U)\b[{letters}]+\b"), F.lit(0)))


def count_matches(x: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))


def count_listed(x: Column, listed: list[str]) -> Column:
    """How many of the strings the text holds, wherever they stand."""
    total = F.lit(0)
    for s in listed:
        total = total + F.contains(x, F.lit(s)).cast("int")
    return total


def syllables(word: Column) -> Column:
    """An estimate for a word: groups of vowels, less one for a silent final e (not le), one at least, none if empty."""
    return let(F.regexp_replace(F.lower(word), "[^a-z]", ""), _syllables)


def _syllables(w: Column) -> Column:
    groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    silent = w.endswith("e") & ~w.endswith("le") & (groups > 1)
    return F.when(w == "", 0).otherwise(F.greatest(F.lit(1), groups - silent.cast("int")))


def rhymes(a: Column, b: Column) -> Column:
    """Whether two words are equal, share their last three letters (fewer in shorter words) or the last two."""
    n = F.least(F.lit(3), F.length(a), F.length(b))
    # of no letters, the whole of either word is compared
    ends = F.when(n == 0, a == b).otherwise(F.right(a, n) == F.right(b, n))
    two = (F.length(a) >= 2) & (F.length(b) >= 2) & (F.right(a, F.lit(2)) == F.right(b, F.lit(2)))
    return (a == b) | ends | two


def stamp_millis(x: Column) -> Column:
    """Milliseconds of a stamp [hh:mm:ss.mmm] at the start; null without one."""
    p = r"^\[(\d{2}):(\d{2}):(\d{2})\.(\d{3})\]"
    part = [F.regexp_extract(x, p, k).try_cast("long") for k in (1, 2, 3, 4)]
    return part[0] * 3_600_000 + part[1] * 60_000 + part[2] * 1000 + part[3]


def strict_json(x: Column) -> Column:
    """The VARIANT of a text that is one JSON value and nothing more, else null. The parser alone is content with a
    value at the start; within brackets whatever follows shows."""
    inside = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), x, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(inside) == 1, F.get(inside, 0))


def json_response(x: Column) -> Column:
    """The JSON in a reply as VARIANT: of its fenced block, else the whole, else from the first [ to the last ], else
    from the first { to the last }; null if none parses."""

    def between(a: str, b: str) -> Column:
        return F.when((F.instr(x, a) > 0) & F.contains(x, F.lit(b)), F.regexp_extract(x, rf"(?s)(\{a}.*\{b})", 1))

    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)```", 1)
    tries = [F.nullif(strip(fenced), F.lit("")), strip(x), between("[", "]"), between("{", "}")]
    return F.coalesce(*[strict_json(t) for t in tries])


def length_ratio(a: Column, b: Column) -> Column:
    """Characters of a for each of b, of which at least one is assumed."""
    return F.length(a) / F.greatest(F.length(b), F.lit(1))


def prefix_match(ref: Column, hyp: Column) -> Column:
    """The share of ref, an array, up to the first element in which hyp differs; 1 for an empty ref, null for a
    ref longer than 0 without hyp. What ref has beyond hyp counts as different."""

    def ratio(r: Column, h: Column) -> Column:
        same = F.transform(F.sequence(F.lit(1), F.greatest(F.size(r), F.lit(1))), lambda i: F.coalesce(F.get(r, i - 1) == F.get(h, i - 1), F.lit(False)))
        n = F.size(r)
        return let(F.array_position(same, False), lambda first: F.when(n == 0, F.lit(1.0)).when(h.isNotNull(), F.when(first == 0, n).otherwise(first - 1) / n))

    return let2(ref, hyp, ratio)


def completion(x: Column, ratio: Column) -> Column:
    """(prompt, rest): the words up to a ratio of them and the others, neither empty; a text of fewer than two words
    has itself, or "text" if blank, and "Nothing to complete."."""

    def parts(w: Column) -> Column:
        n = F.size(w)
        cut = F.least(F.greatest(F.floor(n * ratio).cast("int"), F.lit(1)), n - 1)
        short = F.struct(F.when(n == 0, F.lit("text")).otherwise(F.array_join(w, " ")).alias("prompt"), F.lit("Nothing to complete.").alias("rest"))
        long = F.struct(F.array_join(F.slice(w, F.lit(1), cut), " ").alias("prompt"), F.array_join(F.slice(w, cut + 1, F.greatest(n - cut, F.lit(1))), " ").alias("rest"))
        return F.when(n < 2, short).otherwise(long)

    return let(tokens(x), parts)


def file_name(x: Column) -> Column:
    """The text with _ for all but ASCII letters and digits."""
    return F.regexp_replace(x, "[^A-Za-z0-9]", "_")


def without_echo(full: Column, prompt: Column) -> Column:
    """The output after the prompt, if it begins with the prompt; else as it is."""
    return F.when(F.startswith(full, prompt), F.substring(full, F.length(prompt) + 1, F.length(full))).otherwise(full)


def wiki_title(line: Column) -> Column:
    """The title in a line of equal signs, the same number on either side; null in other lines."""
    return F.nullif(F.regexp_extract(line, r"^\s*(=+)\s*([^=].*?)\s*\1\s*$", 2), F.lit(""))


def preview(x: Column, most: int = 300) -> Column:
    """The text, cut after ``most`` characters with ... for what is left out."""
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced by its value, nulls by nothing."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def bullet_list(items: Column) -> Column:
    """The elements as lines beginning with "- "."""
    return F.array_join(F.transform(items, lambda s: F.concat(F.lit("- "), s)), "\n")


def blocks(*parts: tuple[Column, str]) -> Column:
    """The texts whose condition holds, with a blank line between them."""
    chosen = F.array(*[F.when(c, F.lit(t)) for c, t in parts])
    return F.array_join(F.filter(chosen, lambda t: t.isNotNull()), "\n\n")


def valid_article(x: Column) -> Column:
    """Not blank, five or more words of two ASCII letters at least, at most one character in a thousand not ASCII."""
    foreign = F.length(F.regexp_replace(x, r"[\x00-\x7F]", ""))
    return F.coalesce(~is_blank(x) & (count_matches(x, "[A-Za-z]{2,}") >= 5) & (foreign * 1000 <= F.length(x)), F.lit(False))
