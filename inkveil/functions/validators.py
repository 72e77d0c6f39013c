"""Checks of candidates, and the reasons why they fail. Columns in, columns out; ``as_of`` takes the place of today."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

AS_OF = datetime.date(2026, 1, 1)
WEIGHTS = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]


def digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[^0-9]", "")


def hyphens(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("-"), F.lit("")))


def _digit(d: Column, place: int) -> Column:
    return F.substring(d, place, 1).try_cast("int")


def _int(s: Column) -> Column:
    return s.try_cast("int")


def date6(d: Column) -> Column:
    """The date of YYMMDD, years to 68 taken as 20xx; null if there is none such."""
    century = F.when(_int(F.substring(d, 1, 2)) <= 68, F.lit("20")).otherwise(F.lit("19"))
    whole = F.concat(century, d)
    return F.when(d.rlike("^[0-9]{6}$"), F.try_to_date(whole, "yyyyMMdd"))


def is_date6(d: Column, as_of: datetime.date = AS_OF) -> Column:
    return F.coalesce(date6(d) <= F.lit(as_of), F.lit(False))


def _check(d: Column) -> Column:
    total = sum((_digit(d, i + 1) * w for i, w in enumerate(WEIGHTS[1:], 1)), _digit(d, 1) * WEIGHTS[0])
    return F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(10))


def is_rrn_checksum(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 13) & F.coalesce(_check(d) == _digit(d, 13), F.lit(False))


def is_fgn_checksum(value: Column) -> Column:
    d = digits(value)
    return (F.length(d) == 13) & F.coalesce(F.pmod(_check(d) + 2, F.lit(10)) == _digit(d, 13), F.lit(False))


def _pivot(yy: Column, as_of: datetime.date) -> Column:
    return F.when(yy > as_of.year % 100, 1900 + yy).otherwise(2000 + yy)


def rrn_year(value: Column, as_of: datetime.date = AS_OF) -> Column:
    """The year of birth, by the seventh digit."""
    d = digits(value)
    yy, s = _int(F.substring(d, 1, 2)), F.substring(d, 7, 1)
    return F.when(s.isin("1", "2"), 1900 + yy).when(s.isin("3", "4"), 2000 + yy).when(s.isin("0", "9"), 1800 + yy).otherwise(_pivot(yy, as_of))


def is_rrn(value: Column, as_of: datetime.date = AS_OF, checksum: bool = True) -> Column:
    d = digits(value)
    summed = (rrn_year(value, as_of) >= 2020) | is_rrn_checksum(value) if checksum else F.lit(True)
    return (F.length(d) == 13) & is_date6(F.substring(d, 1, 6), as_of) & summed


def is_fgn(value: Column, as_of: datetime.date = AS_OF) -> Column:
    d = digits(value)
    year = _pivot(_int(F.substring(d, 1, 2)), as_of)
    return (F.length(d) == 13) & is_date6(F.substring(d, 1, 6), as_of) & F.substring(d, 7, 1).isin("5", "6", "7", "8") & ((year >= 2020) | is_fgn_checksum(value))


def is_phone_mobile(value: Column) -> Column:
    d, n = digits(value), hyphens(value)
    return n.isin(0, 2) & d.startswith("010") & (F.length(d) == 11) & ((n == 0) | value.rlike("^010-[0-9]{3,4}-[0-9]{4}$"))


def is_phone_city(value: Column) -> Column:
    d, n = digits(value), hyphens(value)
    seoul = F.when(n == 2, value.rlike("^02-[0-9]{3,4}-[0-9]{4}$")).otherwise(F.length(d).isin(9, 10))
    area = _int(F.substring(d, 1, 3)).between(31, 64) & d.startswith("0")
    other = F.when(n == 2, value.rlike("^0[0-9]{2}-[0-9]{3,4}-[0-9]{4}$")).otherwise(F.length(d).isin(10, 11))
    return n.isin(0, 2) & F.when(d.startswith("02"), seoul).when(area, other).otherwise(F.lit(False))


def is_luhn(d: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def is_iin(d: Column) -> Column:
    two, four = _int(F.substring(d, 1, 2)), _int(F.substring(d, 1, 4))
    sixteen = F.substring(d, 1, 1).isin("4", "6", "9") | two.between(51, 55) | four.between(2221, 2720) | (two == 35)
    return F.coalesce(F.when(F.length(d) == 16, sixteen).when(F.length(d) == 15, two.isin(34, 37)), F.lit(False))


def is_card(value: Column, luhn: bool = True, iin: bool = True) -> Column:
    d = digits(value)
    return F.length(d).isin(15, 16) & (is_iin(d) if iin else F.lit(True)) & (is_luhn(d) if luhn else F.lit(True))


def is_ocr_card(value: Column) -> Column:
    """A candidate of 13 to 19 digits, checked as a card."""
    return F.length(digits(value)).between(13, 19) & is_card(value)


def is_driver_license(value: Column, as_of: datetime.date = AS_OF, min_issue_year: int = 1995) -> Column:
    d = digits(value)
    year = _pivot(_int(F.substring(d, 3, 2)), as_of)
    return (F.length(d) == 12) & _int(F.substring(d, 1, 2)).between(11, 26) & year.between(min_issue_year, as_of.year)


def is_email(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"), F.lit(False))


def is_passport(value: Column) -> Column:
    return F.lit(True)


def is_valid(rule: Column, value: Column, as_of: datetime.date = AS_OF) -> Column:
    """The check of the rule's candidates; a rule without one passes, a failing check is false."""
    found = (
        F.when(rule == "rrn", is_rrn(value, as_of))
        .when(rule == "fgn", is_fgn(value, as_of))
        .when(rule == "phone_mobile", is_phone_mobile(value))
        .when(rule == "phone_city", is_phone_city(value))
        .when(rule == "card", is_card(value))
        .when(rule == "driver_license", is_driver_license(value, as_of))
        .when(rule == "email", is_email(value))
        .otherwise(F.lit(True))
    )
    return F.coalesce(found, F.lit(False))


def of_rule(rule: str, value: Column, as_of: datetime.date = AS_OF) -> Column:
    """The check of one known rule."""
    checks = {"rrn": lambda: is_rrn(value, as_of), "fgn": lambda: is_fgn(value, as_of), "phone_mobile": lambda: is_phone_mobile(value), "phone_city": lambda: is_phone_city(value), "card": lambda: is_card(value), "driver_license": lambda: is_driver_license(value, as_of), "email": lambda: is_email(value)}
    return F.coalesce(checks[rule](), F.lit(False)) if rule in checks else F.lit(True)


# The texts of reasons.
REASONS = {
    "length13": ("자릿수 오류 (", "자리, 13자리 필요)"),
    "length11": ("자릿수 오류 (", "자리, 11자리 필요)"),
    "length15": ("자릿수 오류 (", "자리, 15-16자리 필요)"),
    "length12": ("자릿수 오류 (", "자리, 12자리 필요)"),
    "future": "미래 날짜",
    "date": "유효하지 않은 날짜",
    "checksum": "체크섬 불일치",
    "failed": "검증 실패",
    "gender": ("성별코드 오류 (", ", 5-8 필요)"),
    "hyphens": ("하이픈 개수 오류 (", "개)"),
    "not010": "010으로 시작하지 않음",
    "seoul": ("서울 번호 자릿수 오류 (", "자리)"),
    "area": ("지역번호 자릿수 오류 (", "자리)"),
    "phone": "전화번호 형식 오류",
    "luhn": "Luhn 체크섬 불일치",
    "issuer": ("알 수 없는 카드사 (첫자리: ", ")"),
    "card": "카드번호 형식 오류",
    "region": ("지역코드 오류 (", ")"),
    "driver": "운전면허 형식 오류",
    "no_at": "@ 기호 없음",
    "many_at": "@ 기호가 여러 개",
    "no_dot": "도메인에 . 없음",
    "email": "이메일 형식 오류",
    "passport": "여권번호 형식 오류",
}


def _why(name: str, value: Column | None = None) -> Column:
    text = REASONS[name]
    return F.lit(text) if isinstance(text, str) else F.concat(F.lit(text[0]), value.cast("string"), F.lit(text[1]))


def fail_reason(rule: Column, value: Column, as_of: datetime.date = AS_OF) -> Column:
    """Why a candidate that failed its check may have failed; the first cause in a fixed order, not always the real one."""
    r, d = F.lower(rule), digits(value)
    n, h = F.length(d), hyphens(value)
    born = date6(F.substring(d, 1, 6))
    rrn = F.when(n != 13, _why("length13", n)).when(born.isNull(), _why("date")).when(born > F.lit(as_of), _why("future")).when(~is_rrn_checksum(value), _why("checksum")).otherwise(_why("failed"))
    fgn = F.when(n != 13, _why("length13", n)).when(born.isNull(), _why("date")).when(~F.substring(d, 7, 1).isin("5", "6", "7", "8"), _why("gender", F.substring(d, 7, 1))).when(~is_fgn_checksum(value), _why("checksum")).otherwise(_why("failed"))
    mobile = F.when(~d.startswith("010"), _why("not010")).when(n != 11, _why("length11", n)).otherwise(_why("phone"))
    city = F.when(d.startswith("02"), F.when(~n.isin(9, 10), _why("seoul", n)).otherwise(_why("phone"))).when(~n.isin(10, 11), _why("area", n)).otherwise(_why("phone"))
    phone = F.when(~h.isin(0, 2), _why("hyphens", h)).when(r.contains("mobile"), mobile).otherwise(city)
    card = F.when(~n.isin(15, 16), _why("length15", n)).when(~is_luhn(d), _why("luhn")).when((n == 16) & ~F.substring(d, 1, 1).isin("2", "4", "5", "6", "8", "9"), _why("issuer", F.substring(d, 1, 1))).otherwise(_why("card"))
    driver = F.when(n != 12, _why("length12", n)).when(~_int(F.substring(d, 1, 2)).between(11, 26), _why("region", F.substring(d, 1, 2))).otherwise(_why("driver"))
    parts = F.split(value, "@")
    email = F.when(~value.contains("@"), _why("no_at")).when(F.size(parts) != 2, _why("many_at")).when(~F.get(parts, F.lit(1)).contains("."), _why("no_dot")).otherwise(_why("email"))
    return (
        F.when(r.contains("rrn"), rrn).when(r.contains("fgn"), fgn)
        .when(r.contains("phone") | r.contains("mobile") | r.contains("tel"), phone)
        .when(r.contains("card"), card).when(r.contains("driver"), driver).when(r.contains("email"), email)
        .when(r.contains("passport"), _why("passport")).otherwise(_why("failed"))
    )
