"""Letters at which texts of scripts other than Latin are cut, by one rule over code points instead of a list for each script.

Alphabets and syllabaries stand in rows of 16 code points, and the eleventh and twelfth of every row are taken: between one
letter in twenty and one in six of running text in Greek, Cyrillic, Armenian, Hebrew, Arabic, the scripts of India, Thai,
Georgian, Ethiopic or kana. Of Chinese characters and Hangul syllables it is every eighth by blocks. Scripts beyond the first
65,536 code points have none.
"""

from __future__ import annotations

from itertools import groupby

#: Blocks of letters, and of characters that are words or syllables by themselves: first and last code point.
LETTERS = ((0x370, 0x1FFF), (0x2C00, 0x2DFF), (0x3040, 0x31FF), (0xA480, 0xABFF))
CHARACTERS = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3))


def taken(point: int) -> bool:
    """Whether a code point is one to cut at."""
    inside = lambda blocks: any(a <= point <= b for a, b in blocks)
    return inside(LETTERS) and point % 16 in (10, 11) or inside(CHARACTERS) and 0x140 <= point % 0x200 < 0x180


def ranges() -> list[tuple[int, int]]:
    """The code points taken, as ranges."""
    points = [p for a, b in LETTERS + CHARACTERS for p in range(a, b + 1) if taken(p)]
    runs = [[p for _, p in g] for _, g in groupby(enumerate(sorted(points)), lambda x: x[1] - x[0])]
    return [(r[0], r[-1]) for r in runs]


def _written(found: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in found)


def plain_class() -> str:
    """The inside of a bracket expression, for engines that compile large classes well."""
    return _written(ranges())


def nested_class(found: list[tuple[int, int]] | None = None, bits: tuple[int, ...] = (16, 13, 10, 8)) -> str:
    """A bracket expression of the same characters for Java, which tries one range after the other: as intersections
    with ever smaller blocks, so that a Latin letter fails at one comparison and any other after few."""
    found = ranges() if found is None else found
    if not bits:
        return f"[{_written(found)}]"
    blocks = [list(g) for _, g in groupby(found, lambda r: r[0] >> bits[0])]
    return "[" + "".join(rf"[{_written([(b[0][0], b[-1][1])])}&&{nested_class(b, bits[1:])}]" for b in blocks) + "]"
