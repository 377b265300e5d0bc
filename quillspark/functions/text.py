"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Latin letters with marks (Vietnamese and western European) and what they fold to.
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđäëïöüñçîûå"
PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyydaeiounciua"
#: Look-alike characters in labels.
LOOK_ALIKES = {"–": "-", "—": "-", "\u2010": "-", "×": "x", "“": '"', "”": '"', "‘": "'", "’": "'", "\u00a0": " "}
#: Characters that composition leaves alone and that begin no composition with one another: Latin as far as
#: U+02FF, Latin Extended Additional (U+1E9B and U+1E9A aside), dashes, quotes and currency signs.
INERT = "\\x00-\u02ff\u1e00-\u1e99\u1ea0-\u1eff\u2010-\u2027\u20a0-\u20bf"
SPACES = "[ \\t\\n\\r\\f]+"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition; there is no built-in one.  Only needed where marks may be apart."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def compose(c: Column) -> Column:
    """NFC, through Python only for texts with a character that composition may change: the others are not sent there."""
    return F.coalesce(nfc(F.when(c.rlike(f"[^{INERT}]"), c)), c)


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Decomposed text without its marks."""
    strip = lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn")
    return s.map(lambda x: None if x is None else strip(x))


def collapse(c: Column) -> Column:
    """Runs of white space to one space, ends trimmed, empty to null."""
    return F.nullif(F.trim(F.regexp_replace(c, SPACES, " ")), F.lit(""))


def canonical_raw(c: Column) -> Column:
    return collapse(compose(c))


def normalize_text(c: Column) -> Column:
    return F.lower(canonical_raw(c))


def match_key(c: Column) -> Column:
    """As :func:`normalize_text`, without spaces around ``. , - + : / ( )``."""
    return F.regexp_replace(normalize_text(c), " *([.,+:/()-]) *", "$1")


def fold(c: Column) -> Column:
    """Lower case without marks, ``đ`` as ``d``: by a table of letters, through Python where another character stands."""
    low = F.translate(F.lower(c), MARKED, PLAIN)
    return F.coalesce(without_marks(F.when(low.rlike("[^\\x00-\\x7f]"), low)), low)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def clean_label(c: Column) -> Column:
    """In canonical form, look-alikes replaced."""
    c = canonical_raw(c)
    return F.translate(c, "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values()))


def join_lines(c: Column) -> Column:
    """Non-empty lines, each collapsed, joined by a space; null if none."""
    lines = F.filter(F.transform(F.split(c, "\\n"), lambda x: F.trim(F.regexp_replace(x, SPACES, " "))), lambda x: x != "")
    return F.nullif(F.array_join(lines, " "), F.lit(""))


def character_error_rate(ref: Column, hyp: Column) -> Column:
    """Edits over the reference's characters; null for an empty reference."""
    return F.when(F.char_length(ref) > 0, F.levenshtein(ref, hyp) / F.char_length(ref))


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0], corner = i, i, i - 1
        for j, y in enumerate(b, 1):
            left = min(left + 1, row[j] + 1, corner + (x != y))
            corner, row[j] = row[j], left
    return row[-1]


def substring_distance(needle: str, hay: str) -> tuple[int, int, int]:
    """Least edits that turn some part of ``hay`` into ``needle``, with the part's start and end.

    Of equally near parts that which ends last, and of those with this end that which starts first.
    """
    if needle and (at := hay.rfind(needle)) >= 0:
        return 0, at, at + len(needle)
    # Cost and start of a part are one number, cost * edit + start, so that they are compared at once.
    edit = len(hay) + 1
    row = list(range(edit))
    for i, a in enumerate(needle, 1):
        corner, row[0] = row[0], i * edit
        left = row[0]
        for j, b in enumerate(hay, 1):
            up = row[j]
            if a != b:
                corner += edit
            least = (left if left < up else up) + edit
            left = row[j] = corner if corner < least else least
            corner = up
    end = min(range(edit), key=lambda j: (row[j] // edit, -j))
    return row[end] // edit, row[end] % edit, end


def region_match(needle: str, lines: list[str]) -> float | None:
    """Least share of a region's text that has to change to stand in one of the lines, at most 1; None for no text."""
    return min([1.0, *(substring_distance(needle, line)[0] / len(needle) for line in lines)]) if needle else None


def safe_filename(c: Column) -> Column:
    """Characters outside letters, digits, dot, dash and underscore become underscores; leading dots go."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]", "_"), "^[.]+", "")


def split_compound(c: Column) -> Column:
    """A cell delimited by three bars; an empty cell is an empty list."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, "[|]{3}"))


def valid_missing_key(c: Column, item_labels: list[str], labels: list[str]) -> Column:
    """``LABEL`` for document labels, ``LABEL:n`` with ``n > 0`` for item labels."""
    return c.rlike(f"^(?:{'|'.join(labels)})$|^(?:{'|'.join(item_labels)}):0*[1-9][0-9]*$")


def image_kind(c: Column) -> Column:
    """``jpeg``, ``png``, ``webp``, ``pdf`` or null by the first bytes."""
    x = lambda n: F.hex(F.substring(c, 1, n))
    return (
        F.when(x(3) == "FFD8FF", "jpeg")
        .when(x(8) == "89504E470D0A1A0A", "png")
        .when((x(4) == "52494646") & (F.hex(F.substring(c, 9, 4)) == "57454250"), "webp")
        .when(F.instr(F.substring(c, 1, 1024).cast("string"), "%PDF-") > 0, "pdf")
    )
