"""Version keys: every version as one binary value whose order is the versions' order.

A version is ``[epoch!]release[pre][.postN][.devN][+local]``; release numbers
count without zeros at their end.  The key is built so that bytes compare like
versions, and so that every condition on a version is a range of keys or an
equality; no condition needs the parts again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a version, whatever their case: separators may be left out or differ, names of pre-releases have short and long forms.
PATTERN = (
    r"^\s*v?(?:([0-9]+)!)?([0-9]+(?:\.[0-9]+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?([0-9]*))?"
    r"(?:-([0-9]+)|[-_.]?(post|rev|r)[-_.]?([0-9]*))?(?:[-_.]?(dev)[-_.]?([0-9]*))?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
#: What the names of pre-releases stand for, in order.
PRE = {"a": "a", "alpha": "a", "b": "b", "beta": "b", "c": "c", "rc": "c", "pre": "c", "preview": "c"}


def _digits(text: Column) -> Column:
    """A number as text that sorts like it: its length before its digits."""
    plain = F.ltrim(text, F.lit("0"))
    return F.concat(F.chr(F.lit(65) + F.length(plain)), plain)


def _parts(version: Column) -> list[Column]:
    low = F.lower(version)
    return [F.regexp_extract(low, PATTERN, k) for k in range(1, 11)]


def is_version(text: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(text), F.lit(PATTERN)), F.lit(False))


def release_key(release: Column) -> Column:
    """Key of release numbers without zeros at the end; ``!`` ends it, below every number."""
    numbers = F.split(F.regexp_replace(release, r"(\.0+)+$", ""), r"\.")
    return F.concat(F.array_join(F.transform(numbers, _digits), ""), F.lit("!"))


def _suffix_key(pre: Column, pre_number: Column, post_told: Column, post_number: Column, dev_told: Column, dev_number: Column) -> Column:
    """Pre-release, post-release, dev: a dev of nothing else is below all pre-releases, a version without any is above them, posts above it."""
    letter = F.when(F.startswith(pre, F.lit("a")), "a").when(F.startswith(pre, F.lit("b")), "b").otherwise("c")
    first = F.when(pre != "", F.concat(letter, _digits(pre_number))).when(dev_told & ~post_told, F.lit("A")).otherwise(F.lit("z"))
    second = F.when(post_told, F.concat(F.lit("p"), _digits(post_number))).otherwise(F.lit("n"))
    third = F.when(dev_told, F.concat(F.lit("d"), _digits(dev_number))).otherwise(F.lit("z"))
    return F.concat(first, F.lit("."), second, F.lit("."), third)


def _local_key(local: Column) -> Column:
    """Segments of a local version: numbers above letters, more segments above fewer."""
    segments = F.split(F.translate(local, "-_", ".."), r"\.")
    told = F.transform(segments, lambda s: F.when(F.rlike(s, F.lit(r"\A[0-9]+\z")), F.concat(F.lit("1"), _digits(s))).otherwise(F.concat(F.lit("0"), s)))
    return F.when(local == "", F.lit("")).otherwise(F.concat(F.array_join(F.transform(told, lambda s: F.concat(F.lit("+"), s)), "!"), F.lit("!")))


def version_key(version: Column, local: bool = True) -> Column:
    """Binary key of a version; null where the text is none.  Without ``local`` the local part counts for nothing."""
    epoch, release, pre, pre_n, dash, post, post_n, dev, dev_n, own = _parts(version)
    post_told, dev_told = (post != "") | (dash != ""), dev != ""
    key = F.concat(_digits(epoch), F.lit("|"), release_key(release), F.lit("|"), _suffix_key(pre, pre_n, post_told, F.when(dash != "", dash).otherwise(post_n), dev_told, dev_n), F.lit("|"), _local_key(own) if local else F.lit(""))
    return F.when(is_version(version), key.cast("binary"))


def is_prerelease(version: Column) -> Column:
    parts = _parts(version)
    return (parts[2] != "") | (parts[7] != "")


def _prefix_key(epoch: Column, numbers: Column) -> Column:
    """What the keys of all versions with these first numbers have in common."""
    return F.concat(_digits(epoch), F.lit("|"), F.array_join(F.transform(numbers, _digits), ""))


#: Operators of a condition; ``===`` compares texts.
OPERATORS = ("===", "~=", "==", "!=", "<=", ">=", "<", ">")
CONDITION = r"^\s*(===|~=|==|!=|<=|>=|<|>)\s*(.*?)\s*$"


@dataclass(frozen=True)
class Wanted:
    """Columns of a condition's version."""

    text: Column

    @property
    def stem(self) -> Column:
        """Without the wildcard at its end."""
        return F.regexp_replace(self.text, r"\.\*\s*$", "")

    @property
    def any_end(self) -> Column:
        return F.rlike(self.text, F.lit(r"\.\*\s*$"))


def _padded(release: Column, n: Column) -> Column:
    """The first n numbers of a release, zeros where it has fewer."""
    numbers = F.split(release, r"\.")
    return F.slice(F.concat(numbers, F.array_repeat(F.lit("0"), F.greatest(n - F.size(numbers), F.lit(0)))), F.lit(1), n)


def _same_start(have: list[Column], want: list[Column], n: Column) -> Column:
    """Whether both have the same epoch and the same first n release numbers."""
    return _prefix_key(have[0], _padded(have[1], n)) == _prefix_key(want[0], _padded(want[1], n))


def valid_condition(condition: Column) -> Column:
    """Whether a text is a condition: an operator and a version it can take."""
    operator, text = F.regexp_extract(condition, CONDITION, 1), F.regexp_extract(condition, CONDITION, 2)
    wanted = Wanted(text)
    parts = _parts(wanted.stem)
    plain = is_version(text) & ((operator == "==") | (operator == "!=") | (parts[9] == ""))
    star = wanted.any_end & operator.isin("==", "!=") & F.rlike(wanted.stem, F.lit(r"\A\s*v?([0-9]+!)?[0-9]+(\.[0-9]+)*\z"))
    two = F.size(F.split(parts[1], r"\.")) >= 2
    return F.coalesce(((operator == "===") & (text != "")) | (operator.isin(*OPERATORS[1:]) & (plain | star) & ((operator != "~=") | two)), F.lit(False))


def meets(version: Column, condition: Column) -> Column:
    """Whether a version meets one condition (``>=1.2``, ``==3.0.*``, ``~=2.1``, ``===text``); null where either is malformed.

    Exclusive bounds leave out what belongs to their version: ``>1.7`` no
    post-release or local version of 1.7, ``<1.7`` no pre-release of it, unless
    the bound is one itself.  Local parts count where the condition has one.
    """
    operator, text = F.regexp_extract(condition, CONDITION, 1), F.regexp_extract(condition, CONDITION, 2)
    wanted = Wanted(text)
    have, want = _parts(version), _parts(wanted.stem)
    full, public = version_key(version), version_key(version, local=False)
    bound = version_key(wanted.stem)
    own = F.when(want[9] != "", full).otherwise(public)
    same_release = _prefix_key(have[0], F.array(F.lit("0"))).eqNullSafe(_prefix_key(want[0], F.array(F.lit("0")))) & (release_key(have[1]) == release_key(want[1]))
    want_post, want_pre = (want[4] != "") | (want[5] != ""), (want[2] != "") | (want[7] != "")
    have_post = (have[4] != "") | (have[5] != "")
    number = lambda parts: _digits(F.when(parts[4] != "", parts[4]).otherwise(parts[6]))
    # a pre-release of 1.0.post2 is a dev of that post-release alone
    early = lambda parts: F.concat(F.when(parts[2] == "", "").when(F.startswith(parts[2], F.lit("a")), "a").when(F.startswith(parts[2], F.lit("b")), "b").otherwise("c"), _digits(parts[3]))
    after = have_post & ~want_post & same_release & (want[7] == "") & (early(have) == early(want))
    before = is_prerelease(version) & same_release & (~want_post | (have_post & (have[2] == "") & (number(have) == number(want))))
    size = F.size(F.split(want[1], r"\."))
    starred = _same_start(have, want, size)
    told = (
        F.when(operator == "===", F.lower(F.trim(version)) == F.lower(text))
        .when(operator == "==", F.when(wanted.any_end, starred).otherwise(own == bound))
        .when(operator == "!=", ~F.when(wanted.any_end, starred).otherwise(own == bound))
        .when(operator == "<=", public <= bound).when(operator == ">=", public >= bound)
        .when(operator == "<", (public < bound) & ~(~want_pre & before))
        .when(operator == ">", (public > bound) & ~after)
        .when(operator == "~=", (public >= bound) & _same_start(have, want, size - 1))
    )
    return F.when(valid_condition(condition) & (is_version(version) | (operator == "===")), told)


def meets_all(version: Column, conditions: Column, prereleases: bool | None = None) -> Column:
    """Whether a version meets every condition of an array; null where one is malformed.

    A pre-release counts only where ``prereleases`` is true, or, where it is left
    open, one of the conditions names a pre-release by another operator than ``!=``.
    """
    ok = F.forall(conditions, lambda c: meets(version, c))
    if prereleases is True:
        return ok
    named = F.lit(False) if prereleases is False else F.exists(conditions, lambda c: (F.regexp_extract(c, CONDITION, 1) != "!=") & is_prerelease(Wanted(F.regexp_extract(c, CONDITION, 2)).stem))
    return ok & (~is_prerelease(version) | named)


def compare(a: str, b: str) -> int:
    """-1, 0 or 1 as version ``a`` is below, equal to or above ``b``; for the driver's few versions."""
    x, y = _plain_key(a), _plain_key(b)
    return (x > y) - (x < y)


def _plain_key(text: str) -> tuple:
    found = re.match(PATTERN, text.lower())
    if not found:
        raise ValueError(f"not a version: {text!r}")
    epoch, release, pre, pre_n, dash, post, post_n, dev, dev_n, local = found.groups()
    numbers = [int(x) for x in release.split(".")]
    while len(numbers) > 1 and numbers[-1] == 0:
        numbers.pop()
    early = (PRE[pre], int(pre_n or 0)) if pre else ("A", 0) if dev and not (post or dash) else ("z", 0)
    later = int(dash or post_n or 0) if post or dash else -1
    draft = (0, int(dev_n or 0)) if dev else (1, 0)
    own = tuple((1, int(s), "") if s.isdigit() else (0, 0, s) for s in re.split(r"[-_.]", local)) if local else ()
    return int(epoch or 0), tuple(numbers), early, later, draft, (1, own) if local else (0, ())
