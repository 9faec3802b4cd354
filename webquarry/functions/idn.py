"""International host names as column expressions: the Unicode mapping for hosts (UTS 46, nontransitional) and punycode.

A name is folded and put into compatibility form, ignored characters go, and ideographic stops become dots.
Sharp s, final sigma and the joiners, which older rules replaced, stay.  Labels outside ASCII are then
written in punycode.  Everything runs inside the row, and only for hosts that need it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a name loses, and signs behind which a joiner may stand.
_IGNORED = r"[\x{00AD}\x{034F}\x{180B}-\x{180D}\x{180F}\x{200B}\x{2060}\x{2064}\x{FE00}-\x{FE0F}\x{FEFF}\x{E0100}-\x{E01EF}]"
_VIRAMA = (
    r"[\x{094D}\x{09CD}\x{0A4D}\x{0ACD}\x{0B4D}\x{0BCD}\x{0C4D}\x{0CCD}\x{0D3B}\x{0D3C}\x{0D4D}\x{0DCA}\x{0E3A}\x{0EBA}\x{0F84}"
    r"\x{1039}\x{103A}\x{1714}\x{1734}\x{17D2}\x{1A60}\x{1B44}\x{1BAA}\x{1BAB}\x{1BF2}\x{1BF3}\x{2D7F}\x{A806}\x{A8C4}\x{A953}\x{A9C0}\x{AAF6}\x{ABED}]"
)
_JOINING = r"[\p{IsArabic}\p{IsSyriac}\p{IsMongolian}\p{IsNko}&&\p{L}]"
#: A joiner that is not behind a virama and, for the one that parts letters, not between letters that join.
_LOOSE_JOINER = rf"(?<!{_VIRAMA})\x{{200D}}|(?<!{_VIRAMA})(?<!{_JOINING}\p{{M}}{{0,4}})\x{{200C}}|(?<!{_VIRAMA})\x{{200C}}(?!\p{{M}}*{_JOINING})"
#: Kept as they are, standing in for them while the rest is folded.
_KEPT, _STAND_INS = "\N{LATIN SMALL LETTER SHARP S}\N{GREEK SMALL LETTER FINAL SIGMA}", chr(0xE000) + chr(0xE001)
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _fold(text: str) -> str:
    """Case folding and compatibility composition, in SQL."""
    folded = f"try_reflect('com.ibm.icu.lang.UCharacter', 'foldCase', {text}, true)"
    return f"try_reflect('com.ibm.icu.text.Normalizer', 'compose', {folded}, true)"


# Punycode as one lambda in SQL text: built call by call, it would double the time it takes to plan a URL.
# A number of variable length ends with the first digit below a threshold; nine digits hold more than any host name needs.
_WRITTEN = f"""aggregate(array({", ".join(f"{36 * k}L" for k in range(1, 10))}), named_struct('q', delta, 'out', '', 'done', false),
  (d, k) -> if(d.done, d, transform(array(greatest(1L, least(26L, k - s.bias))), t -> named_struct(
    'q', (d.q - t) div (36L - t),
    'out', concat(d.out, substr('{_DIGITS}', cast(if(d.q < t, d.q, t + (d.q - t) % (36L - t)) AS int) + 1, 1)),
    'done', d.q < t))[0]),
  d -> d.out)"""
_ADAPTED = """transform(array(if(s.first, delta div 700L, delta div 2L)), e -> transform(array(
  aggregate(array(1, 2, 3, 4, 5, 6), named_struct('d', e + e div (s.h + 1L), 'k', 0L),
    (a, z) -> if(a.d > 455L, named_struct('d', a.d div 35L, 'k', a.k + 36L), a))),
  a -> a.k + 36L * a.d div (a.d + 38L))[0])[0]"""
# Characters outside ASCII are inserted in the order of their code points, each written as the distance from the one before.
_PUNYCODE = f"""cs -> transform(array(transform(cs, c -> cast(ascii(c) AS bigint))), codes -> aggregate(
  array_sort(filter(transform(codes, (c, i) -> named_struct('m', c, 'at', i)), x -> x.m >= 128L)),
  named_struct('n', 128L, 'i', 0L, 'h', cast(size(filter(codes, c -> c < 128L)) AS bigint), 'bias', 72L, 'first', true,
    'out', concat(array_join(filter(cs, c -> ascii(c) < 128), ''), if(exists(codes, c -> c < 128L), '-', ''))),
  (s, x) -> transform(array(cast(size(filter(slice(codes, 1, x.at), c -> c <= x.m)) AS bigint)), at ->
    transform(array((x.m - s.n) * (s.h + 1L) + at - s.i), delta -> named_struct(
      'n', x.m, 'i', at + 1L, 'h', s.h + 1L, 'bias', {_ADAPTED}, 'first', false, 'out', concat(s.out, {_WRITTEN})))[0])[0],
  s -> s.out))[0]"""


def punycode(label: Column) -> Column:
    """A label in punycode, without the prefix."""
    chars = F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0))
    return F.call_function("transform", F.array(chars), F.expr(_PUNYCODE))[0]


# The Unicode form of a name, null with private characters; then, unless a joiner stands loose, its labels in ASCII.  The JVM's
# older rules judge which characters a name may have; what they would replace is left out of the question.
_SAFE = rf"if(h rlike r'\p{{Co}}', NULL, translate(h, '{_KEPT}', '{_STAND_INS}'))"
_STOP, _PLAIN = "\u3002", "s\u03c3"
_MAPPED = f"translate(regexp_replace(translate({_fold(_fold(_SAFE))}, '{_STAND_INS}', '{_KEPT}'), r'{_IGNORED}', ''), '{_STOP}', '.')"
_JUDGED = f"regexp_replace(translate(m, '{_KEPT}', '{_PLAIN}'), r'[\\x{{200C}}\\x{{200D}}]', '')"
_LABELS = rf"""transform(split(m, r'\.'), x -> if(x rlike r'[^\x00-\x7f]',
  concat('xn--', transform(array(regexp_extract_all(x, '(?s).', 0)), {_PUNYCODE})[0]), x))"""
_ASCII = f"""h -> transform(array({_MAPPED}), m -> CASE
  WHEN m rlike r'{_LOOSE_JOINER}' THEN NULL
  WHEN try_reflect('java.net.IDN', 'toASCII', {_JUDGED}, 1) IS NOT NULL THEN array_join({_LABELS}, '.') END)[0]"""


def ascii_name(name: Column) -> Column:
    """A lower-case host name in ASCII; null where it is not a valid name."""
    return F.call_function("transform", F.array(name), F.expr(_ASCII))[0]
