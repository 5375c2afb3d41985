"""Text cleaning as native Column expressions (no Python UDFs).

Every function maps ``Column -> Column`` and stays inside whole-stage
codegen: ``translate``, ``replace``, ``regexp_replace``, ``split`` and
higher-order array functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
# ---------------------------------------------------------------------------

# Characters turned into a space by both punctuation rules.
SPACED_MARKS = "/-'"

# Rule A replaces "&" with the literal word "punct" (its template string was
# never formatted, and the braces are removed afterwards); rule B keeps "&".
AMPERSAND_RULE_A = " punct "
AMPERSAND_RULE_B = " & "

# Characters deleted by rule A, then by rule B (rule B adds - / and the
# curly quotes).
REMOVED_MARKS_RULE_A = "?!.,\"#$%'()*+:;<=>@[\\]^_`{|}~"
REMOVED_MARKS_RULE_B = "?!.,\"#$%'()*+-/:;<=>@[\\]^_`{|}~" + "“”’"

# Digit masking, applied in this order: runs of five or more digits, then
# groups of four, three and two.
DIGIT_MASKS = (
    ("[0-9]{5,}", "#####"),
    ("[0-9]{4}", "####"),
    ("[0-9]{3}", "###"),
    ("[0-9]{2}", "##"),
)

# Misspelling table, in its original order (the order decides which
# alternative wins where keys overlap).
MISSPELLINGS = (
    ("colour", "color"),
    ("centre", "center"),
    ("didnt", "did not"),
    ("doesnt", "does not"),
    ("isnt", "is not"),
    ("shouldnt", "should not"),
    ("favourite", "favorite"),
    ("travelling", "traveling"),
    ("counselling", "counseling"),
    ("theatre", "theater"),
    ("cancelled", "canceled"),
    ("labour", "labor"),
    ("organisation", "organization"),
    ("wwii", "world war 2"),
    ("citicise", "criticize"),
    ("instagram", "social medium"),
    ("whatsapp", "social medium"),
    ("snapchat", "social medium"),
)

# Whitespace of Python's ``str.split()`` (``str.isspace``), written as a
# regex class that Java and RE2 read alike.
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)

# Non-ASCII characters.
NON_ASCII = "[^\\x00-\\x7F]"

# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_text(c) -> Column:
    """Trim spaces (only U+0020) on the left, then on the right."""
    return F.rtrim(F.ltrim(_col(c)))


def ascii_only(c) -> Column:
    """Drop every non-ASCII character."""
    return F.regexp_replace(_col(c), NON_ASCII, "")


def clean_punct(c, rule: str = "a") -> Column:
    """Punctuation rules.

    ``a``: ``/ - '`` become a space, ``&`` becomes `` punct ``, the listed
    marks are deleted. ``b``: the same, but ``&`` becomes `` & `` and the
    curly quotes are deleted too. Two ``translate`` calls and one
    ``replace``; the order matches the sequential character replacements
    because no step produces a character a later step maps differently
    except the braces around ``punct`` which rule A deletes.
    """
    if rule not in ("a", "b"):
        raise ValueError("rule must be 'a' or 'b'")
    x = F.translate(_col(c), SPACED_MARKS, " " * len(SPACED_MARKS))
    amp = AMPERSAND_RULE_A if rule == "a" else AMPERSAND_RULE_B
    x = F.replace(x, F.lit("&"), F.lit(amp))
    removed = REMOVED_MARKS_RULE_A if rule == "a" else REMOVED_MARKS_RULE_B
    return F.translate(x, removed, "")


def mask_numbers(c) -> Column:
    """Replace digit runs: five or more -> ``#####``, then groups of 4, 3, 2.

    Text without two adjacent digits is returned as is (one scan instead of
    four)."""
    x = _col(c)
    masked = x
    for pattern, mask in DIGIT_MASKS:
        masked = F.regexp_replace(masked, pattern, mask)
    return F.when(x.rlike("[0-9]{2}"), masked).otherwise(x)


def misspelling_pattern(table=MISSPELLINGS) -> str:
    return "(" + "|".join(_regex_quote(k) for k, _ in table) + ")"


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def fix_misspellings(c, table=MISSPELLINGS) -> Column:
    """Replace every misspelling in one left-to-right pass.

    The text is split on the alternation and the matches are extracted with
    the same pattern, so piece ``i`` is followed by match ``i``. Each match
    is mapped through the table and the pieces are joined again. One pass
    means a replacement is never re-scanned, and at each position the first
    key in table order wins (case-sensitive, substring match).
    """
    x = _col(c)
    pattern = misspelling_pattern(table)
    mapping = F.create_map(*[F.lit(v) for kv in table for v in kv])
    pieces = F.split(x, pattern, -1)
    hits = F.regexp_extract_all(x, F.lit(pattern), 1)
    joined = F.zip_with(
        pieces, hits,
        lambda piece, hit: F.concat(piece, F.coalesce(F.try_element_at(mapping, hit), F.lit(""))),
    )
    # text with no key at all (most of it) skips the split / extract / join
    return F.when(x.rlike(pattern), F.array_join(joined, "")).otherwise(x)


def words_of(c) -> Column:
    """Words as Python ``str.split()`` gives them: any whitespace, no empties."""
    parts = F.split(_col(c), PY_WHITESPACE_CLASS + "+", -1)
    return F.filter(parts, lambda w: w != "")


def to_label(c) -> Column:
    """Class label as an integer; text that is not an integer gives NULL."""
    return _col(c).try_cast("int")
