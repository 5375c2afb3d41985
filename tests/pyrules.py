"""The cleaning rules restated as plain Python, for comparison on random
strings. Written from the rule descriptions with literals of its own, so that a
wrong table in the library shows."""

import re

# Characters that rules A and B delete, spelled out here.
DELETED_BY_A = set("?!.,\"#$%'()*+:;<=>@[\\]^_`{|}~")
DELETED_BY_B = set("?!.,\"#$%'()*+-/:;<=>@[\\]^_`{|}~\u201c\u201d\u2019")
# Misspellings and what they become.
CORRECTED = {
    "colour": "color", "centre": "center", "didnt": "did not", "doesnt": "does not", "isnt": "is not",
    "shouldnt": "should not", "favourite": "favorite", "travelling": "traveling", "counselling": "counseling",
    "theatre": "theater", "cancelled": "canceled", "labour": "labor", "organisation": "organization",
    "wwii": "world war 2", "citicise": "criticize", "instagram": "social medium", "whatsapp": "social medium",
    "snapchat": "social medium",
}


def trim(x):
    return x.lstrip(" ").rstrip(" ")


def ascii_only(x):
    return "".join(ch for ch in x if ord(ch) < 128)


def punct(x, rule):
    out = []
    for ch in x:
        if ch in "/-'":
            out.append(" ")
        elif ch == "&":
            out.append(" punct " if rule == "a" else " & ")
        elif ch not in (DELETED_BY_A if rule == "a" else DELETED_BY_B):
            out.append(ch)
    return "".join(out)


def mask(x):
    """Every run of ASCII digits by its length: five or more become five marks, a single digit stays."""
    return "".join("#" * min(len(run), 5) if len(run) > 1 and run[0] in "0123456789" else run
                   for run in re.findall("[0-9]+|[^0-9]+", x))


def misspell(x):
    """From left to right; what has been put in isn't looked at again."""
    out, i = [], 0
    while i < len(x):
        found = next((w for w in CORRECTED if x.startswith(w, i)), None)
        out.append(CORRECTED[found] if found else x[i])
        i += len(found) if found else 1
    return "".join(out)


def words(x):
    return x.split()


def tokens(x):
    # lower-case, split on each of " \t\n\x0b\f\r", trailing empties dropped
    parts = re.split("[ \t\n\x0b\f\r]", x.lower())
    if x == "":
        return [""]
    while parts and parts[-1] == "":
        parts.pop()
    return parts
