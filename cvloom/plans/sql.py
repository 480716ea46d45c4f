"""Pieces of SQL that several queries share."""

SPACE = "[\\s\\x{0b}\\x{85}\\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def inline(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def paragraph(x: str) -> str:
    lines = f"string_split(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"
    return strip(f"array_to_string(list_transform({lines}, lambda l: {strip('l')}), chr(10))")


def abbreviated(x: str) -> str:
    once = "regexp_replace({0}, '([A-Z]) \\. ([A-Z])([^a-zA-Z]|$)', '\\1.\\2\\3', 'g')"
    return once.format(once.format(x))


def cleaned(x: str) -> str:
    """As clean_text(); abbreviations are joined twice for lack of look-around."""
    plain = abbreviated(f"replace({x}, chr(0), '')")
    return "left(" + strip(f"regexp_replace(regexp_replace({plain}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')") + ", 25000)"


MARK = "^(?:[•*-]|[0-9]+[.)])\\s+"
NUMBERED = "^([0-9]+(?:\\.[0-9]+){0,4})\\s+"


def depth(t: str, other: str) -> str:
    number = f"regexp_extract({t}, '^([0-9]+(?:\\.[0-9]+)*)', 1)"
    return f"CASE WHEN {number} = '' THEN {other} ELSE least(6, len(string_split({number}, '.'))) END"
