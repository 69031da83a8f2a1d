"""English noun inflection by ordered rewrite rules, compiled to one CASE expression.

A rule declared later outranks one declared earlier; irregular nouns outrank all.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules of the plural as (pattern, replacement), in order of declaration.
PLURAL = [
    ("$", "s"), ("s$", "s"), ("(ax|test)is$", "$1es"), ("(octop|vir)us$", "$1i"), ("(octop|vir)i$", "$1i"),
    ("(alias|status)$", "$1es"), ("(bu)s$", "$1ses"), ("(buffal|tomat)o$", "$1oes"), ("([ti])um$", "$1a"), ("([ti])a$", "$1a"),
    ("sis$", "ses"), ("(?:([^f])fe|([lr])f)$", "$1$2ves"), ("(hive)$", "$1s"), ("([^aeiouy]|qu)y$", "$1ies"), ("(x|ch|ss|sh)$", "$1es"),
    ("(matr|vert|ind)ix|ex$", "$1ices"), ("([m|l])ouse$", "$1ice"), ("([m|l])ice$", "$1ice"), ("^(ox)$", "$1en"), ("(quiz)$", "$1zes"),
    ("(people|men|children|sexes|moves|stadiums)$", "$1"), ("(oxen|octopi|viri|aliases|quizzes)$", "$1"),
]

#: Rules of the singular, in order of declaration.
SINGULAR = [
    ("s$", ""), ("(s|si|u)s$", "$1s"), ("(n)ews$", "$1ews"), ("([ti])a$", "$1um"),
    ("((a)naly|(b)a|(d)iagno|(p)arenthe|(p)rogno|(s)ynop|(t)he)ses$", "$1$2sis"), ("(^analy)ses$", "$1sis"), ("(^analy)sis$", "$1sis"),
    ("([^f])ves$", "$1fe"), ("(hive)s$", "$1"), ("(tive)s$", "$1"), ("([lr])ves$", "$1f"), ("([^aeiouy]|qu)ies$", "$1y"),
    ("(s)eries$", "$1eries"), ("(m)ovies$", "$1ovie"), ("(x|ch|ss|sh)es$", "$1"), ("([m|l])ice$", "$1ouse"), ("(bus)es$", "$1"),
    ("(o)es$", "$1"), ("(shoe)s$", "$1"), ("(cris|ax|test)is$", "$1is"), ("(cris|ax|test)es$", "$1is"), ("(octop|vir)i$", "$1us"),
    ("(octop|vir)us$", "$1us"), ("(alias|status)es$", "$1"), ("(alias|status)$", "$1"), ("^(ox)en", "$1"), ("(vert|ind)ices$", "$1ex"),
    ("(matr)ices$", "$1ix"),
]

#: Irregular nouns, in order of declaration.
IRREGULAR = [("person", "people"), ("man", "men"), ("child", "children"), ("sex", "sexes"), ("move", "moves"), ("stadium", "stadiums")]

#: Nouns without a plural.
UNCOUNTABLE = (
    "equipment information rice money species series fish sheep advice air alcohol art beef blood butter coffee confusion cotton education "
    "electricity entertainment experience fiction flour food forgiveness furniture gold gossip grass ground happiness history homework honey hop "
    "ice knowledge lightning literature love luck luggage meat milk mist music news noise oil oxygen patience pay peace pepper petrol plastic pork "
    "power pressure rain research sadness salt sand shopping silver snow space speed steam sugar sunshine tea tennis thunder toothpaste traffic "
    "trousers vinegar water weather wood wool work"
).split()


def rules(declared: Iterable[tuple[str, str]], irregular: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules by falling rank. An irregular pair (a, b) is the rule that keeps the first letter: (a0)rest$ -> $1 rest of b."""
    made = [(f"({a[0]}){a[1:]}$", f"$1{b[1:]}") for a, b in irregular]
    return [*reversed(made), *reversed(list(declared))]


def checked(declared: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rules, or ValueError if a pattern is null or empty."""
    declared = list(declared)
    if any(not p for p, _ in declared):
        raise ValueError("a rule needs a pattern")
    return declared


def same_rule(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Rules are equal if their patterns are, ignoring case."""
    return a[0].lower() == b[0].lower()


PLURAL_RULES = rules(checked(PLURAL), IRREGULAR)
SINGULAR_RULES = rules(checked(SINGULAR), [(b, a) for a, b in IRREGULAR])


@dataclass(frozen=True)
class Grammar:
    """Ranked rules and the words they leave alone; each builder gives a new grammar whose rule outranks the others."""

    plurals: tuple[tuple[str, str], ...] = tuple(PLURAL_RULES)
    singulars: tuple[tuple[str, str], ...] = tuple(SINGULAR_RULES)
    bare: tuple[str, ...] = tuple(UNCOUNTABLE)

    def plural(self, pattern: str, replacement: str) -> Grammar:
        return replace(self, plurals=(*checked([(pattern, replacement)]), *self.plurals))

    def singular(self, pattern: str, replacement: str) -> Grammar:
        return replace(self, singulars=(*checked([(pattern, replacement)]), *self.singulars))

    def irregular(self, one: str, many: str) -> Grammar:
        return self.plural(*rules([], [(one, many)])[0]).singular(*rules([], [(many, one)])[0])

    def uncountable(self, *words: str) -> Grammar:
        return replace(self, bare=(*self.bare, *words))

    def clear(self) -> Grammar:
        """Without any rule: nothing inflects."""
        return Grammar((), (), ())

    def plural_of(self, c: str) -> Column:
        return F.expr(_spark_sql(f"`{c}`", self.plurals, self.bare))

    def singular_of(self, c: str) -> Column:
        return F.expr(_spark_sql(f"`{c}`", self.singulars, self.bare))


def is_uncountable(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*UNCOUNTABLE), F.lit(False))


def apply_rule(c: Column, pattern: str, replacement: str) -> Column:
    """Replacement of all matches, ignoring case; null if there is none."""
    (pattern, replacement), = checked([(pattern, replacement)])
    return F.when(c.rlike(f"(?i){pattern}"), F.regexp_replace(c, f"(?i){pattern}", replacement))


def _spark_sql(word: str, ranked: Iterable[tuple[str, str]], bare: Iterable[str] = UNCOUNTABLE) -> str:
    cases = [f"WHEN lower(trim({word})) IN ({', '.join(f"'{w}'" for w in bare)}) THEN {word}"] * bool(bare)
    cases += [f"WHEN {word} RLIKE '(?i){p}' THEN regexp_replace({word}, '(?i){p}', '{r}')" for p, r in ranked]
    return f"CASE {' '.join(cases)} ELSE {word} END" if cases else word


def _inflect(c: Column | str, ranked: list[tuple[str, str]]) -> Column:
    """The rules over a column; one given by name is parsed from SQL at once, which is much faster than call by call."""
    if isinstance(c, str):
        return F.expr(_spark_sql(f"`{c}`", ranked))
    out = F.when(is_uncountable(c), c)
    for pattern, replacement in ranked:
        out = out.when(c.rlike(f"(?i){pattern}"), F.regexp_replace(c, f"(?i){pattern}", replacement))
    return out.otherwise(c)


def plural_of(c: Column | str) -> Column:
    return _inflect(c, PLURAL_RULES)


def singular_of(c: Column | str) -> Column:
    return _inflect(c, SINGULAR_RULES)


def is_plural(c: str) -> Column:
    return plural_of(c) == F.col(c)


def is_singular(c: str) -> Column:
    return singular_of(c) == F.col(c)


def sql(word: str, plural: bool) -> str:
    """The same expression for DuckDB."""
    bare = ", ".join(f"'{w}'" for w in UNCOUNTABLE)
    cases = [f"WHEN lower(trim({word})) IN ({bare}) THEN {word}"]
    for pattern, replacement in PLURAL_RULES if plural else SINGULAR_RULES:
        to = replacement.replace("$", "\\")
        cases.append(f"WHEN regexp_matches({word}, '{pattern}', 'i') THEN regexp_replace({word}, '{pattern}', '{to}', 'gi')")
    return f"CASE {' '.join(cases)} ELSE {word} END"
