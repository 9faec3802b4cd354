"""HTML as column expressions: tokens, start tags, attributes.

A page is read by one left-to-right pattern, so it costs one linear pass and no
shuffle.  Repeats are possessive: Java then matches
them in a loop instead of recursing, and long attributes cannot exhaust the
stack.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions.expr import distinct_by_first, let, one_of

_ATTR = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
#: A name and, where it has one, its value with the quotes.
_PAIR = r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_ATTRS = rf"(?:[\s/]++|{_ATTR})*+"
#: The attributes that are looked up by start tag. Behind its style, a tag's values come in this order.
LOOKED_UP = {
    **dict.fromkeys(("a", "base"), ("href",)),
    **dict.fromkeys(("iframe", "frame", "script"), ("src",)),
    "img": ("src", "srcset", "data-srcset", "data-src", "data-original", "data-lazy-src"),
    "source": ("src", "srcset", "data-srcset"),
    **dict.fromkeys(("video", "audio"), ("src", "poster")),
    "link": ("href", "rel"),
    "meta": ("name", "property", "content", "charset"),
    "html": ("lang",),
}
_RAW_ELEMENTS = "script|style|title|textarea|iframe|xmp|noembed|noframes"
_END_OF_NAME = r"(?=[\s/>])"
_START_TAG = rf"\A<[A-Za-z]++{_ATTRS}>"

# Named references come from the standard table: those with a semicolon by name, the
# old ones that also count without it as a pattern, longest first.
_MARK = "\x01"
_FREQUENT = ("amp;", "quot;", "lt;", "gt;", "nbsp;", "apos;", "copy;", "middot;")
_NEXT = "\x02"
_LETTERS = [chr(c) for c in range(ord("A"), ord("z") + 1)]
# One table per first letter: a name is looked up among those that begin as it does.
_NAMED = _NEXT.join(
    "".join(
        f"{_MARK}{name}{html5[name]}"
        for name in (*_FREQUENT, *(n for n in html5 if n[-1] == ";" and n not in _FREQUENT))
        if name[0] == letter
    )
    for letter in _LETTERS
)
_BARE = "|".join(sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n)))
_REFERENCES = r"&#[0-9]++;?|&#[xX][0-9A-Fa-f]++;?|&[A-Za-z][0-9A-Za-z]*+;|&(?:{bare}){end}|[^&]++|&"
# What the standard reads for the code points 128 to 159.
_C1 = "".join(bytes([c]).decode("cp1252", "replace").replace("\ufffd", chr(c)) for c in range(128, 160))



def token_pattern(names: tuple[str, ...] = ()) -> str:
    """One left-to-right pattern for a page's tokens.

    A token is a comment, a raw-text element with its text, the end of a form, or
    a start tag; ``names`` limits the start tags to those asked for.  Comments and
    raw-text elements are always taken whole, so markup inside them is skipped.
    A tag that is never closed runs to the end of the page, so no part of a page
    is read again for the next tag.
    """
    name = f"(?:{'|'.join(names)}){_END_OF_NAME}" if names else r"[a-z][^\s/>]*+"
    return (
        r"(?is)<(?:!--(?:-?>|.*?(?:-->|--!>|\z))"
        rf"|({_RAW_ELEMENTS}){_END_OF_NAME}{_ATTRS}(?:>.*?(?:</\1{_END_OF_NAME}[^>]*+(?:>|\z)|\z)|\z)"
        rf"|/form{_END_OF_NAME}[^>]*+(?:>|\z)"
        rf"|{name}{_ATTRS}(?:>|\z))"
    )


def tokens(html: Column, names: tuple[str, ...] = ()) -> Column:
    """Raw-text elements, form ends and start tags of a page in document order."""
    raw = rf"(?i)\A<(?:{_RAW_ELEMENTS})[\s/>]"
    return F.filter(
        F.regexp_extract_all(html, F.lit(token_pattern(names)), F.lit(0)),
        lambda t: ~t.startswith("<!") & (t.endswith(">") | (t.rlike(raw) & t.rlike(_START_TAG))),
    )


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"\A<(/?[A-Za-z][^\s/>]*)", 1))


def _before(name: str) -> str:
    """A start tag up to its first attribute of that name."""
    return rf"\A<[A-Za-z][^\s/>]*+(?:[\s/]++|(?!(?i:{name})[\s/>=]){_ATTR})*+(?i:{name})"


def _raw_value(tag: Column, name: str) -> Column:
    """Value of the first attribute of that name as written, without its quotes; '' when missing."""
    value = r"""["']?+((?<=")[^"]*+(?=")|(?<=')[^']*+(?=')|(?<!["'])[^\s>"'][^\s>]*+)"""
    return F.regexp_extract(tag, rf"{_before(name)}\s*+=\s*+{value}", 1)


def names_of(found: Column) -> Column:
    """Tokens as ``array<struct<name,text>>``; raw-text elements lose their text."""

    def tag(token: Column) -> Column:
        def named(name: Column) -> Column:
            text = F.when(one_of(name, *_RAW_ELEMENTS.split("|")), F.regexp_extract(token, _START_TAG, 0)).otherwise(token)
            return F.struct(name.alias("name"), text.alias("text"))

        return let(tag_name(token), named)

    return F.transform(found, tag)


def read_attributes(named: Column, read: tuple[str, ...] = (), styled: bool = True) -> Column:
    """Add ``attrs`` to the tags of :func:`names_of`.

    ``attrs`` has what :func:`value_of` looks up, for the tags named by ``read`` and, with ``styled``, for those that may
    have a style.  Each value is cut out of the tag and decoded once, by one table for all of them.
    """

    def values(name: Column, text: Column) -> Column:
        none = F.array().cast("array<string>")
        has_style = F.contains(F.lower(text), F.lit("style")) if styled else F.lit(False)
        style = F.when(has_style, _raw_value(text, "style")).otherwise("") if styled else F.lit("")
        raws = F.when(~F.contains(text, F.lit("=")), none)
        for looked_up in dict.fromkeys(LOOKED_UP[n] for n in read):
            tags = [n for n in read if LOOKED_UP[n] == looked_up]
            raws = raws.when(one_of(name, *tags), F.array(style, *[_raw_value(text, a) for a in looked_up]))
        raws = raws.when(has_style, F.array(style)).otherwise(none)
        return F.transform(raws, lambda v: decode_references(v))

    return F.transform(
        named,
        lambda t: F.struct(t["name"].alias("name"), t["text"].alias("text"), values(t["name"], t["text"]).alias("attrs")),
    )


def tags_of(found: Column, read: tuple[str, ...] = (), styled: bool = True) -> Column:
    """Tokens as ``array<struct<name,text,attrs>>``; see :func:`names_of` and :func:`read_attributes`."""
    return read_attributes(names_of(found), read, styled)


def texts_of(found: Column, tags: Column, element: str) -> Column:
    """Text of every raw-text element of one name among the tokens; ``tags`` are those of :func:`tags_of`."""
    return F.transform(
        F.filter(found, lambda t, i: F.get(tags, i)["name"] == element),
        lambda t: F.regexp_extract(
            t, rf"(?is)\A<{element}{_ATTRS}>(.*?)(?:</{element}{_END_OF_NAME}[^>]*+>?)?\z", 1
        ),
    )


def _numbered(reference: Column) -> Column:
    """The character of a reference by number; the standard's replacements for bad numbers."""
    digits = F.regexp_extract(reference, r"\A&#[xX]?0*([0-9A-Fa-f]*)", 1)
    base_16 = reference.rlike(r"\A&#[xX]")

    def character(code: Column) -> Column:
        wrong = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        return (
            F.when(wrong, "\ufffd")
            .when(code.between(128, 159), F.substr(F.lit(_C1), code - 127, F.lit(1)))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    def number(d: Column) -> Column:
        known = F.concat(F.lit("0"), d)
        return F.when(
            F.length(d) <= 7, F.when(base_16, F.conv(known, 16, 10)).otherwise(F.conv(known, 10, 10)).cast("int")
        ).otherwise(0)

    return let(let(digits, number), character)


def _named(reference: Column) -> Column:
    """The characters of a reference by name, or the reference as it is."""
    name = F.concat(F.lit(_MARK), F.rtrim(F.substr(reference, F.lit(2)), F.lit(";")), F.lit(";"))
    table = F.get(F.split(F.lit(_NAMED), _NEXT), F.ascii(F.substr(reference, F.lit(2), F.lit(1))) - ord(_LETTERS[0]))
    return let(
        F.struct(name.alias("name"), table.alias("table")),
        lambda n: let(
            F.instr(n["table"], n["name"]),
            lambda at: F.when(
                at > 0, F.substring_index(F.substr(n["table"], at + F.length(n["name"]), F.lit(4)), _MARK, 1)
            ).otherwise(reference),
        ),
    )


def decode_references(text: Column, in_attribute: bool = True) -> Column:
    """Character references by number and by name, decoded in one pass from the left.

    In an attribute an old name without its semicolon does not count before a
    letter, a digit or ``=``, so query strings stay as they are.
    """
    pattern = _REFERENCES.format(bare=_BARE, end="(?![0-9A-Za-z=])" if in_attribute else "")
    decoded = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda part: F.when(part.startswith("&#") & (F.length(part) > 2), _numbered(part))
        .when(part.startswith("&") & (part != "&"), _named(part))
        .otherwise(part),
    )
    return F.when(text.contains("&"), F.array_join(decoded, "")).otherwise(text)


def _unquote(value: Column) -> Column:
    return F.when(
        value.startswith('"') | value.startswith("'"),
        F.substr(value, F.lit(2), F.length(value) - 2),
    ).otherwise(value)


def attribute_list(tag: Column) -> Column:
    """All attributes of a start tag in order as ``array<struct<name,value>>``, references decoded."""

    def pairs(body: Column) -> Column:
        return F.zip_with(
            F.regexp_extract_all(body, F.lit(_PAIR), F.lit(1)),
            F.regexp_extract_all(body, F.lit(_PAIR), F.lit(2)),
            lambda name, value: F.struct(F.lower(name).alias("name"), decode_references(_unquote(value)).alias("value")),
        )

    return let(F.regexp_extract(tag, r"(?s)\A<[A-Za-z][^\s/>]*(.*)>\z", 1), pairs)


def listed_value(attrs: Column, name: str) -> Column:
    """Value of the first of all attributes of that name, '' when missing or empty."""
    return F.coalesce(F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"], F.lit(""))


def value_of(tag: Column, name: str, of: str = "") -> Column:
    """Value of the first attribute of that name of a tag, '' when missing or empty; ``of`` names the tag, or one looked up alike."""
    place = 0 if name == "style" else 1 + LOOKED_UP[of].index(name)
    return F.coalesce(F.get(tag["attrs"], F.lit(place)), F.lit(""))


def has_attribute(tag: Column, name: str) -> Column:
    return tag["text"].rlike(rf"{_before(name)}[\s/>=]")


def attributes(tag: Column) -> Column:
    """All attributes as ``array<struct<name,value>>``, the first of each name."""
    return distinct_by_first(attribute_list(tag), "name", ["name", "value"])
