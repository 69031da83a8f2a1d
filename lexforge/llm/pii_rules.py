"""Patterns of personal information.

They serve twice: as the labelling functions that mark spans in the training texts of the tagger
(:mod:`lexforge.llm.pii_train`), and to trim the edges of a span the tagger has found where a value of the known
forms begins or ends a few characters off. They neither find values in the query nor reject any for its form.
"""

from __future__ import annotations

import re

KINDS = ("email", "phone", "id_number", "address", "name")

_UP = "A-ZÀ-ÖØ-Þ"
_LO = "a-zß-öø-ÿ"
_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_])?"
_AT = r"(?: ?\(at\) ?| ?\[at\] ?|@)"
_TOWN = rf"[{_UP}][{_LO}]+(?:[ -][{_UP}][{_LO}]+)?"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Row|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Court|Close|Way|Square|Terrace)"
_WEG = rf"[{_UP}][{_LO}]*(?:weg|gasse|straße|strasse|str\.|allee|platz|ring|damm|ufer)"

EMAIL = re.compile(
    rf"(?<![\w.+-]){_LOCAL}(?:{_AT}[A-Za-z0-9-]+(?:(?:\.| dot )[A-Za-z0-9-]+)+| at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+)"
)
#: A remote of a version control service looks like a mailbox but is none.
REMOTE = re.compile(r"^(?:git|svn|hg|cvs|ssh)@", re.I)
PHONE = re.compile(
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d[\d .()-]{5,16}\d|\(\d{2,5}\) ?\d{3,4}[ -]\d{3,5}|\d{3}[-.]\d{3}[-.]\d{4}|(?<!\d )0\d{2,5}[ /]\d{3,6}(?: \d{3,5})?)(?![\w-]|\.\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{3}[. ]\d{2}[. ]\d{4}|6\d{8}|[A-Z]{2}\d{7}|\d{8}-\d{3}[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w-]|\.\d)"
)
ADDRESS = re.compile(
    rf"(?<!\w)(?:(?:Flat|Apt|Unit) \w+, )?\d{{1,5}}[A-Za-z]? [{_UP}][{_LO}]+(?: [{_UP}][{_LO}]+)? {_STREET}(?:,? (?:Apt|Flat|Unit)\.? \w+)?(?:, {_TOWN})(?:,? (?:[A-Z]{{2}} )?\d{{5}})?(?!\w)"
    rf"|(?<!\w){_WEG} \d{{1,4}}[a-z]?, (?:\d{{5}} )?{_TOWN}(?!\w)"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo|Camino) [{_UP}][{_LO}]+,? \d{{1,4}}, (?:\d{{5}} )?{_TOWN}(?!\w)"
    rf"|(?<!\w)\d{{1,4}}(?: bis)?,? (?:[Rr]ue|[Aa]venue|[Bb]oulevard|[Pp]lace|[Cc]hemin) (?:de (?:la )?|du |des )?[{_UP}][{_LO}]+, (?:\d{{5}} )?{_TOWN}(?!\w)"
)
_FAM = rf"[{_UP}][{_LO}]+(?:-[{_UP}][{_LO}]+)?"
_UFAM = rf"[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})?"
NAME = re.compile(
    rf"(?<![\w.@-])(?:{_FAM}, {_FAM}|(?:[{_UP}]\. )?(?:[{_UP}][{_LO}]+|[{_UP}]\.) (?:[{_UP}]\. )?{_FAM}|{_UFAM} (?:[{_UP}]\. )?{_UFAM}|{_UFAM}, {_UFAM}|{_FAM} [{_UP}]\.)(?![\w@-])"
)
PATTERNS = {"email": EMAIL, "phone": PHONE, "id_number": ID_NUMBER, "address": ADDRESS, "name": NAME}

#: Titles, which do not belong to a name.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Sra", "Herr", "Frau", "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.")


#: Edges move by at most so many characters.
TRIM = 3


def snap(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """Edges of the value that a found span points at: those of a known form where both differ by at most TRIM, else the span without outer blanks and marks.

    None only if what is left lacks what defines its kind: a name has two parts, a mailbox an at and no version control service, the others have digits.
    """
    a, b = start, end
    while a < b and text[a] in " \t\r\n,;:<>\"'`|*":
        a += 1
    while b > a and text[b - 1] in " \t\r\n,;:<>\"'`|*" or (b > a and text[b - 1] == "." and kind in ("email", "phone", "id_number")):
        b -= 1
    if kind == "name" and (head := text[a:b].split(" ", 1))[0] in TITLES and len(head) > 1:
        a += len(head[0]) + 1
    best = TRIM + 1
    for m in PATTERNS[kind].finditer(text, max(0, start - 48), min(len(text), end + 48)):
        x, y = m.span()
        if kind == "name" and (head := m[0].split(" ", 1))[0] in TITLES and len(head) > 1:
            x += len(head[0]) + 1
        off = max(abs(x - start), abs(y - end))
        if off < best:
            best, a, b = off, x, y
    return (a, b) if a < b and _may_be(kind, text[a:b]) else None


def _may_be(kind: str, value: str) -> bool:
    if kind == "name":
        return bool(re.search(r"\w\W+\w", value))
    if kind == "email":
        return bool(re.search(r"@|\bat\b", value, re.I)) and not REMOTE.match(value)
    return kind == "address" or any(c.isdigit() for c in value)
