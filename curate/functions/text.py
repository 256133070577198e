"""Text expressions: Python-compatible stripping, cleaning versions, sample assembly, markup repair."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters Python's str.strip and regex \s treat as white space. Java's \s
# is ASCII only and (?U)\s misses U+001C to U+001F.
# The first half excludes most letters at once, which makes matching about twice as fast.
WHITESPACE = (
    r"[[^!-~\x{a1}-\x{167f}\x{3001}-\x{10ffff}]&&"
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
WHITESPACE_CHARACTERS = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        *(0x85, 0xA0, 0x1680),
        *range(0x2000, 0x200B),
        *(0x2028, 0x2029, 0x202F, 0x205F, 0x3000),
    )
)

# The marker that replaces a line break in cleaning version V3, and the prefix that
# introduces a label in classifier input lines.
NEW_LINE = "<NEW_LINE>"
LABEL_PREFIX = "__label__"
UNKNOWN_TOKEN = "<unk>"
ELLIPSIS = "..."

CLEANING_VERSIONS = ("V1", "V2", "V3")


def strip(text: Column) -> Column:
    """``str.strip()``: remove white space of any script from both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space."""
    # A lone space is not matched: it needs no replacement, and most runs are one.
    return F.regexp_replace(text, rf" {WHITESPACE}++|(?! ){WHITESPACE}++", " ")


def clean(text: Column, version: str = "V1") -> Column:
    """Text cleaning for the n-gram classifier."""
    if version == "V1":
        return F.lower(strip(F.replace(text, F.lit("\n"), F.lit(""))))
    if version == "V2":
        return F.lower(strip(squeeze(text)))
    if version == "V3":
        marked = F.regexp_replace(text, r"\r?\n", f" {NEW_LINE} ")
        return F.lower(strip(squeeze(marked)))
    raise ValueError(f"unknown cleaning version {version!r}, expected one of {CLEANING_VERSIONS}")


def labelled_line(label: Column, text: Column, version: str = "V1") -> Column:
    """One classifier input line: ``__label__<label> <cleaned text>``."""
    return F.concat(F.lit(LABEL_PREFIX), label, F.lit(" "), clean(text, version))


def label_only(line: Column) -> Column:
    """True for lines that carry a label and nothing else."""
    return line.rlike(rf"(?i)^{WHITESPACE}*{LABEL_PREFIX}(positive|negative){WHITESPACE}*$")


def pair_text(inputs: Column, targets: Column) -> Column:
    """Instruction and answer joined by a space; a trailing ellipsis of the answer is dropped."""
    answer = F.when(
        F.endswith(targets, F.lit(ELLIPSIS)), F.left(targets, F.length(targets) - len(ELLIPSIS))
    ).otherwise(targets)
    return F.concat(inputs, F.lit(" "), answer)


def indexed_choice(choices: Column, answer: Column) -> Column:
    """The choice at one-based ``answer``; 0 wraps to the last, -1 to the one before it.

    Null where the answer lies outside the list in either direction.
    """
    position = F.when(answer >= 1, answer).otherwise(answer - 1)
    return F.try_element_at(choices, position.cast("int"))


def indexed_choice_text(question: Column, choices: Column, answer: Column) -> Column:
    """Question and chosen answer joined by a space."""
    return F.concat(question, F.lit(" "), indexed_choice(choices, answer))


def lettered_choice_text(question: Column, key: Column, options: dict[str, Column]) -> Column:
    """Question and the option whose letter is ``key``; an unknown letter leaves the answer empty."""
    letter = strip(F.coalesce(key, F.lit("")))
    picked = F.lit(None).cast("string")
    for name, option in options.items():
        picked = F.when(letter == name, option).otherwise(picked)
    return F.concat(
        strip(F.coalesce(question, F.lit(""))), F.lit(" "), strip(F.coalesce(picked, F.lit("")))
    )


def has_text(text: Column) -> Column:
    """True where the text is neither null nor empty."""
    return text.isNotNull() & (text != "")


def without_unknown(text: Column) -> Column:
    """True where the text carries no unknown-token marker."""
    return ~F.contains(text, F.lit(UNKNOWN_TOKEN))


def words(text: Column) -> Column:
    """Default tokenizer: maximal runs of non-white-space characters."""
    inner = strip(text)
    none = F.array().cast("array<string>")
    return F.when(inner == "", none).otherwise(F.split(inner, rf"{WHITESPACE}+"))


# Named character references of HTML 5; those for an ampersand are folded before.
ENTITIES = {name[:-1]: char for name, char in html5.items() if name.endswith(";") and char != "&"}
AMPERSAND = r"&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+"
TERMINAL_ESCAPE = r"\x1b\[[0-9;]*[A-Za-z]"
# Control characters without a use in text. Tab, line feed, form feed and carriage
# return stay.
CONTROL = r"[\x00-\x08\x0b\x0e-\x1f\x7f\x{206a}-\x{206f}\x{feff}\x{fff9}-\x{fffc}]"


def _windows_1252() -> tuple[str, str]:
    """C1 control characters that are Windows-1252 characters in disguise, with their meaning."""
    source, target = [], []
    for code in range(0x80, 0xA0):
        try:
            target.append(bytes([code]).decode("cp1252"))
        except UnicodeDecodeError:
            continue
        source.append(chr(code))
    return "".join(source), "".join(target)


def _decode_reference(token: Column) -> Column:
    """One token of text; numeric and known named character references become their character."""
    decimal = F.regexp_extract(token, r"\A&#0*([0-9]{1,7});\z", 1)
    hexadecimal = F.regexp_extract(token, r"\A&#[xX]0*([0-9a-fA-F]{1,6});\z", 1)
    code = F.when(decimal != "", decimal.cast("int")).when(
        hexadecimal != "", F.conv(hexadecimal, 16, 10).cast("int")
    )
    valid = (code >= 1) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.create_map(
        *[F.lit(part) for name, char in ENTITIES.items() for part in (f"&{name};", char)]
    )
    # a hash set tells first whether a token is a name at all
    known = token.isin([f"&{name};" for name in ENTITIES])
    return F.when(valid, character).when(known, F.element_at(named, token)).otherwise(token)


def unescape_entities(text: Column) -> Column:
    """Replace character references, up to the line that holds the first ``<``.

    A text with a ``<`` is taken to be markup from that line on, where references are meant as such.
    Chains of escaped ampersands are folded first; no other reference yields an ampersand, so one
    pass leaves nothing to unescape.
    """
    before = F.substring_index(text, "<", 1)
    open_line = F.substring_index(before, "\n", -1)
    head = F.when(~F.contains(text, F.lit("<")), text).otherwise(
        F.left(before, F.length(before) - F.length(open_line))
    )
    tail = F.right(text, F.length(text) - F.length(head))
    folded = F.regexp_replace(head, AMPERSAND, "&")
    tokens = F.regexp_extract_all(
        folded, F.lit(r"&#?[0-9a-zA-Z]+;|[^&]+|&"), F.lit(0)
    )
    plain = F.array_join(F.transform(tokens, _decode_reference), "")
    return F.concat(F.when(F.contains(folded, F.lit("&")), plain).otherwise(folded), tail)


def repair(text: Column) -> Column:
    """Repair of markup and control-character damage, in the order the damage is nested.

    Character references, then C1 controls that stand for Windows-1252 characters, then terminal
    escape sequences, then control characters. Encoding mix-ups are not repaired.
    """
    source, target = _windows_1252()
    mended = F.translate(unescape_entities(text), source, target)
    mended = F.regexp_replace(mended, TERMINAL_ESCAPE, "")
    return F.regexp_replace(mended, CONTROL, "")
