"""Cleaning of bytes and text: every function takes a column and gives a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of ANSI escape sequences.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
LATIN = "ISO-8859-1"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def printable(raw: Column, allow_escape: bool = True) -> Column:
    """Bytes without those outside 32-126; the escape byte stays if allowed. Tabs and line ends go, too."""
    keep = r"\x20-\x7E\x1B" if allow_escape else r"\x20-\x7E"
    return F.encode(F.regexp_replace(F.decode(raw, LATIN), f"[^{keep}]", ""), LATIN)


def decode_bytes(raw: Column, encoding: str = "ascii", errors: str = "replace") -> Column:
    """Bytes as text: ASCII, UTF-8, or Latin-1, in which no byte is bad. Bad bytes: ``replace`` by U+FFFD, ``ignore``, or ``strict``: null."""
    if errors not in ("replace", "ignore", "strict"):
        raise ValueError(f"unknown errors {errors!r}")
    if encoding.lower() in ("utf-8", "utf8"):
        text = raw.cast("string")
        if errors == "strict":
            return F.when(F.is_valid_utf8(text), text)
        fixed = F.make_valid_utf8(text)
        return fixed if errors == "replace" else F.when(F.is_valid_utf8(text), text).otherwise(F.replace(fixed, F.lit("\ufffd"), F.lit("")))
    if encoding.lower() in ("latin-1", "latin1", "iso-8859-1", "iso8859-1"):
        return F.decode(raw, LATIN)
    if encoding.lower() not in ("ascii", "us-ascii"):
        raise ValueError(f"unknown encoding {encoding!r}")
    text = F.decode(raw, LATIN)
    if errors == "strict":
        return F.when(~text.rlike(r"[\x80-\xFF]"), text)
    return F.regexp_replace(text, r"[\x80-\xFF]", "\ufffd" if errors == "replace" else "")


def regex_replace(text: Column, pattern: str = ANSI, replace: str = "") -> Column:
    """Replaces all matches; group references may be written ``\\1`` or ``$1``."""
    return F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", replace))


def ansi_filter(text: Column) -> Column:
    return regex_replace(text)


def string_replace(text: Column, search: str, replace: str = "") -> Column:
    """Replaces all occurrences. An empty search, which would put the replacement between all characters, is refused."""
    if not search:
        raise ValueError("empty search")
    return F.replace(text, F.lit(search), F.lit(replace))


def whitespace_normalize(text: Column) -> Column:
    """Runs of white space, Unicode's too, as one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column, chars: str | None = None) -> Column:
    """Without the given characters (white space by default) at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "") if chars is None else F.trim(text, F.lit(chars))


#: Fixed value: one tag of a header, ``[TAG WORDS]`` with an optional colon, or ``word:``.
_TAG = r" *(\[[^\]]*\]:?|[^ \[][^ ]*:(?= |$)|:(?= |$))"


def path_normalize(text: Column, module_index: int = 0) -> Column:
    """After ``module_index`` words, header tags become one dotted lower-case path, followed by the rest.

    The words before are cut off by their true position, however many spaces part them. Too few words: unchanged.
    """
    prefix = rf"^\s*(?:\S+\s+){{{module_index - 1}}}\S+" if module_index else "^"
    before = F.regexp_extract(text, prefix, 0)
    rest = F.ltrim(F.substring(text, F.length(before) + 1, F.length(text)))
    header = F.regexp_extract(rest, f"^(?:{_TAG})*+", 0)  # possessive: a loop, however many tags

    def clean(tag: Column) -> Column:
        inner = F.replace(F.trim(F.lower(F.regexp_extract(tag, r"^\[([^\]]*)\]", 1))), F.lit(" "), F.lit("_"))
        return F.when(tag.startswith("["), inner).otherwise(F.lower(F.rtrim(tag, F.lit(":"))))

    tags = F.filter(F.transform(F.regexp_extract_all(header, F.lit(_TAG), F.lit(1)), clean), lambda t: t != "")
    body = F.ltrim(F.substring(rest, F.length(header) + 1, F.length(rest)))
    words = F.array_join(F.filter(F.split(before, r"\s+"), lambda w: w != ""), " ")
    out = F.trim(F.concat(words, F.lit(" " if module_index else ""), F.array_join(tags, "."), F.lit(" "), body))
    return F.when(text.rlike(prefix), out).otherwise(text)


def fixed_width_normalize(text: Column, module_index: int = 0, max_chars: int = 25) -> Column:
    """The ``max_chars`` characters from word ``module_index`` become ``name:``, followed by the rest. Too few words: unchanged."""
    prefix = rf"^\s*(?:\S+\s+){{{module_index}}}" if module_index else "^"
    before = F.regexp_extract(text, prefix, 0)
    rest = F.substring(text, F.length(before) + 1, F.length(text))
    name = F.translate(strip(F.lower(F.substring(rest, 1, max_chars))), " /-", "___")
    name = F.trim(F.regexp_replace(name, "_+", "_"), F.lit("_"))
    colon = F.when((name != "") & ~name.endswith(":"), ":").otherwise("")
    body = F.ltrim(F.substring(rest, max_chars + 1, F.length(rest)))
    out = F.concat(name, colon, F.lit(" "), body)
    if not module_index:
        return out
    words = F.array_join(F.filter(F.split(before, r"\s+"), lambda w: w != ""), " ")
    return F.when(text.rlike(prefix) & (rest != ""), F.trim(F.concat(words, F.lit(" "), out))).otherwise(text)


#: Level texts of the known formats.
LEVEL_MAPS = {
    "default": {"T": 5, "D": 10, "I": 20, "W": 30, "E": 40, "F": 45, "C": 50},
    "nrf": {"<trace>": 5, "<debug>": 10, "<info>": 20, "<warn>": 30, "<warning>": 30, "<error>": 40, "<fatal>": 45, "<critical>": 50},
    "zephyr": {"<dbg>": 10, "<inf>": 20, "<wrn>": 30, "<err>": 40},
    "custom": {},
}


def map_level(text: Column, mapping: str | dict[str, int] = "default") -> Column:
    """Level of a text, null if unknown; a mapped number that is no level means INFO. Case matters."""
    from loomlog.model import INFO, LEVELS

    known = {x[0] for x in LEVELS}
    pairs = LEVEL_MAPS[mapping] if isinstance(mapping, str) else mapping
    if not pairs:
        return F.lit(None).cast("int")
    return F.create_map(*[F.lit(x) for key, value in pairs.items() for x in (key, value if value in known else INFO)])[text]


def normalize_device(text: Column) -> Column:
    return F.lower(text)


def normalize_module(text: Column) -> Column:
    """The lower-case path, null if it holds anything but ``a-z 0-9 _ .`` or is empty."""
    low = F.lower(text)
    return F.when(low.rlike(r"\A[a-z0-9_.]+\z"), low)


#: Fixed value: the pattern of a number in a message.
NUMBER = r"[-+]?\d*\.\d+(?:[eE][-+]?\d+)?|[-+]?\d+"


def extract_numbers(text: Column) -> Column:
    """All numbers in a message, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))


def parse_duration(text: Column) -> Column:
    """Whole seconds of ``10s``, ``5m``, ``2h`` or ``7``; null for anything else."""
    clean = F.lower(F.trim(text))
    pattern = r"^(\d*\.?\d+)\s*([smh]?)$"  # fixed value: a number and its unit
    unit = F.regexp_extract(clean, pattern, 2)
    factor = F.when(unit == "m", 60).when(unit == "h", 3600).otherwise(1)
    return F.when(clean.rlike(pattern), F.floor(F.regexp_extract(clean, pattern, 1).try_cast("double") * factor).cast("int"))


def parent_path(module: Column) -> Column:
    """The path one level up; the root's is null."""
    return F.when(module != "", F.regexp_replace(module, r"(^|\.)[^.]*$", ""))


def within(module: Column, path: str | Column) -> Column:
    """Whether a module is the path or below it; the root holds all. Pushes down as equality or prefix when path is a text."""
    if isinstance(path, str):
        return F.lit(True) if path == "" else (module == path) | module.startswith(f"{path}.")
    return (path == "") | (module == path) | module.startswith(F.concat(path, F.lit(".")))


def split_id(identifier: str) -> tuple[str, str]:
    """Device and module of ``device.path``."""
    device, _, module = identifier.partition(".")
    return device.lower(), module.lower()


def search_condition(text: Column, query: str) -> Column:
    """A search box: space is OR, ``+`` AND within a group, ``-`` in front excludes everywhere; substrings, any case."""
    low = F.lower(text)
    groups, banned = [], []
    for token in query.lower().split():
        if token.startswith("-"):
            banned += [token[1:]] if len(token) > 1 else []
        else:
            groups.append([x for x in token.split("+") if x])
    some = F.lit(not groups)
    for group in groups:
        every = F.lit(True)
        for word in group:
            every = every & low.contains(word)
        some = some | every
    for word in banned:
        some = some & ~low.contains(word)
    return some
