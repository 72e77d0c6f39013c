"""Masks of values: as many characters as before, by kind and policy. Entities like &amp; are left as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = r"&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"
HANGUL = "[가-힣]"


def beside_entities(value: Column, change) -> Column:
    """The change, applied between entities."""
    gaps, kept = F.split(value, ENTITY, -1), F.regexp_extract_all(value, F.lit(ENTITY), F.lit(0))
    return F.when(~value.contains("&"), change(value)).otherwise(F.array_join(F.zip_with(gaps, kept, lambda g, k: F.concat(change(g), F.coalesce(k, F.lit("")))), ""))


def keep_rules(value: Column) -> Column:
    """Letters, digits, dots and underscores are masked; hyphens, blanks and the rest stay."""
    return beside_entities(value, lambda v: F.regexp_replace(v, r"[\p{L}\p{N}._]", "*"))


def email(value: Column) -> Column:
    return keep_rules(value)


def document_email(value: Column) -> Column:
    return beside_entities(value, lambda v: F.regexp_replace(v, "[^@-]", "*"))


def except_hyphen(value: Column) -> Column:
    return F.regexp_replace(value, "[^-]", "*")


def except_hyphen_at(value: Column) -> Column:
    return F.regexp_replace(value, "[^@-]", "*")


def _n_digits(value: Column) -> Column:
    return F.length(value) - F.length(F.translate(value, "0123456789", ""))


def _by_digit(value: Column, masked) -> Column:
    """Masks the digits for which masked(rank from 1, place from 0, number of digits) holds."""
    rank = lambda i: _n_digits(F.substring(value, F.lit(1), i + 1))
    one = lambda total: lambda c, i: F.when(c.between("0", "9") & masked(rank(i), i, total), F.lit("*")).otherwise(c)
    # a lambda's variable is computed once, the expression behind it would be for each character
    whole = F.get(F.transform(F.array(_n_digits(value)), lambda total: F.array_join(F.transform(F.split(value, ""), one(total)), "")), F.lit(0))
    return F.when(value == "", value).otherwise(whole)


def first_digits(value: Column, n: int = 6) -> Column:
    return _by_digit(value, lambda rank, i, total: rank > n)


def last_digits(value: Column, n: int = 4) -> Column:
    return _by_digit(value, lambda rank, i, total: (rank <= total - n) & (total > n))


def _first_group_end(value: Column) -> Column:
    return F.length(F.regexp_extract(value, "^[^0-9]*[0-9]+", 0))


def phone_group(value: Column) -> Column:
    """The first run of digits stays (of a number without hyphens, all)."""
    cut = _first_group_end(value)
    return _by_digit(value, lambda rank, i, total: i >= cut)


def phone_plain(value: Column) -> Column:
    """As phone_group, but of a number of digits alone the area or mobile code stays."""
    plain = value.rlike("^[0-9]+$")
    cut = F.when(plain & value.startswith("02"), F.lit(2)).when(plain & value.startswith("0"), F.lit(3)).otherwise(_first_group_end(value))
    return _by_digit(value, lambda rank, i, total: i >= cut)


def card_ends(value: Column) -> Column:
    """The first and last four digits stay; up to eight digits stay whole."""
    return _by_digit(value, lambda rank, i, total: (total > 8) & (rank > 4) & (rank <= total - 4))


def name_first(value: Column) -> Column:
    """The first Hangul syllable stays, if there are two at least."""
    at = F.regexp_instr(value, F.lit(HANGUL))
    rest = F.regexp_replace(F.substring(value, at + 1, F.length(value)), HANGUL, "*")
    return F.when(at > 0, F.concat(F.substring(value, F.lit(1), at), rest)).otherwise(value)


def _mode(policy: dict[str, str] | None, key: str, mode: str) -> bool:
    return (policy or {}).get(key) == mode


def text_policy(rule: Column, value: Column, policy: dict[str, str] | None = None) -> Column:
    """The mask of a rule's value in texts and packages."""
    r, out = F.lower(rule), keep_rules(value)
    partial = [
        ("ps", "keep_first_char", r.isin("ps", "name"), name_first),
        ("card", "keep_first4_last4", r == "card", card_ends),
        ("phone", "keep_first_group", r.isin("phone_mobile", "phone_city"), phone_group),
        ("fgn", "keep_birth6", r == "fgn", first_digits),
        ("rrn", "keep_birth6", r == "rrn", first_digits),
    ]
    for key, mode, fits, mask in partial:
        if _mode(policy, key, mode):
            out = F.when(fits, mask(value)).otherwise(out)
    return F.when(r == "email", email(value)).otherwise(out)


def binary_policy(rule: Column, value: Column, policy: dict[str, str] | None = None) -> Column:
    """The mask in binary documents; null where the default mask (all but hyphens) is due."""
    r, out = F.lower(rule), F.lit(None).cast("string")
    total = F.length(F.regexp_replace(value, "[^0-9]", ""))
    hangul = F.regexp_count(value, F.lit(HANGUL))
    partial = [
        ("ps", "keep_first_char", (r == "ps") & (hangul > 1), name_first),
        ("card", "keep_first4_last4", (r == "card") & (total > 8), card_ends),
        ("phone", "keep_first_group", r.isin("phone_mobile", "phone_city") & (total > 0), phone_plain),
        ("fgn", "keep_birth6", r == "fgn", first_digits),
        ("rrn", "keep_birth6", r == "rrn", first_digits),
    ]
    for key, mode, fits, mask in partial:
        if _mode(policy, key, mode):
            out = F.when(fits, mask(value)).otherwise(out)
    return F.when(r == "email", F.lit(None).cast("string")).otherwise(out)


def binary_mask(rule: Column, value: Column, policy: dict[str, str] | None = None) -> Column:
    return F.coalesce(binary_policy(rule, value, policy), except_hyphen(value))


def same_length(value: Column, mask: Column) -> Column:
    """The replacement, only if it is as long as the value."""
    return F.when(F.length(value) == F.length(mask), mask)


def masked_places(rule: Column, value: Column, policy: dict[str, str] | None = None) -> Column:
    """Places of the characters that a page's box covers: those the policy masks, or all of them."""
    mask = binary_policy(rule, value, policy)
    every = F.sequence(F.lit(0), F.length(value) - 1)
    own = F.filter(every, lambda i: F.substring(mask, i + 1, F.lit(1)) != F.substring(value, i + 1, F.lit(1)))
    return F.when(F.length(value) == 0, F.array().cast("array<int>")).when(mask.isNull() | (F.size(own) == 0), every).otherwise(own)
