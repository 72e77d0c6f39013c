"""Personal data is replaced by surrogates, in SQL functions only.

One expression finds e-mail addresses, IPv4 and IPv6 addresses, telephone, card (Luhn), account (IBAN, checked), social-security
and Korean resident and telephone numbers (the library's own checks), secrets (keys, tokens, passwords) and names: after a
title with all their parts, particles and initials, or with a known first name. Each distinct value gets one surrogate, made by
a keyed hash (SHA-512 of key, type, value and attempt): without the key it can't be traced back, with the same key it is the
same in every run. Surrogates keep type and format: digits stay digits, letters keep case and script, separators stay where
they are, card numbers keep issuer digit and Luhn, accounts their country and check digits, resident numbers their century and
gender digit, a possible date and the checksum, addresses stay valid, e-mail goes to the reserved ``.example``.

Names are replaced part by part, so "Ms Lena Berg" and "Ms Berg" stay one person. Known first names map to others of the same
gender and script (a keyed cycle over the list, so no two share one); unknown first names get an ending of the title's
gender; surnames get syllables of their script. Parts of a person's name that stand alone elsewhere in the same text ("Lena
left") are replaced alike. Values are compared in a canonical form (digits of a number, lower-case e-mail and names), so that
their spellings stay one entity too.

Collision checks: of the values, of any kind, that drew the same surrogate all but the smallest draw again, and so does one
whose surrogate is itself a value of the corpus or a listed first name, until none is left.

Defined results: a null text stays null, with no entities; empty tables give no rows; repeated rows keep a row each and
get the same surrogates; all columns stay, but one named like the
count is replaced by it; very long texts are searched whole; a secret after a key word runs to the end of its characters, however long, and all
other repetitions are bounded. A number after a key word that is no card is a secret; one that fails its check is none. Ties
don't occur: of alternatives at a place the first in ANY is taken.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.rules import PATTERNS
from inkveil.functions.validators import is_fgn, is_rrn
from inkveil.llm.common import cut, stored

# Given names by (gender, script).
FIRST_NAMES = {
    ("f", "latin"): "Anna Clara Elena Emily Emma Hannah Julia Laura Lena Linda Lucia Maria Marie Mary Nina Olivia Patricia Sarah Sofia Susan".split(),
    ("m", "latin"): "Carlos David Felix James Jean John Jonas Jorge Juan Karl Lucas Luis Michael Oliver Paul Peter Pierre Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Андрей Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
# Syllables of surnames by script.
SYLLABLES = {
    "latin": "ba bel bor dan del fer gar hal kel lan lin lor mar mel mon nor pel ran rel ros sal sen tal ter tor val van ver vin wel win zan".split(),
    "cyrillic": "ба бел бор ва вол гар дан дел кар кол лан лен мар мел мор нов пол ран рос сал сен тал тор фед".split(),
}
#: Attempts after which an e-mail's or secret's surrogate gets a character more, and after which there are too few.
GROW, MOST_ATTEMPTS = 8, 100
#: Distinct values up to which their surrogates are broadcast (short strings); beyond it, occurrences of a value for a task.
BROADCAST_ROWS, HOT = 200_000, 1_000_000
#: Words as parts of names are, and what stands between them: every character is in one of these.
ALONE = r"\p{L}+(?:['’-]\p{Lu}\p{L}*)*|[^\p{L}]+"
# Titles by the gender they tell, and particles of surnames.
TITLES_OF = {"f": "Mrs|Ms|Miss|Frau|Sra|Señora|Mme|Madame|Mlle|Госпожа", "m": "Mr|Herr|Sr|Señor|Monsieur|Господин", "": "Dr|Prof|Professor|Доктор|Профессор"}
TITLES = "|".join(TITLES_OF.values())
PARTICLES = "de|del|della|di|da|dos|du|des|la|le|van|von|der|den|ten|ter|zu|zur|bin|al|el|y"
# Endings that tell the gender of an unknown first name, by script.
ENDINGS = {"latin": {"given_f": "a", "given_m": "o"}, "cyrillic": {"given_f": "а", "given_m": "ан"}}
NAMES = ("name", "given", "given_f", "given_m")

_given = "|".join(sorted((n for names in FIRST_NAMES.values() for n in names), key=len, reverse=True))
_octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_part = r"\p{Lu}\p{L}{0,30}+(?:['’-]\p{Lu}\p{L}{0,30}+){0,3}(?!\p{L})"
_unit = rf"(?:\p{{Lu}}\. ){{0,3}}(?:(?:{PARTICLES}) ){{0,3}}{_part}"
#: In the order in which they are tried at a place of the text. The type of a match is told again by TYPES.
SECRET = r"((?<=[=: \"'])(?=[A-Za-z0-9_/+.\-]{8})(?<=(?:token|key|secret|password|passwd|pwd)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9_/+.\-]{8,}(?<![.\-]))|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{40})(?![A-Za-z0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IP = rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?![0-9]|\.[0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]{0,39}[0-9])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![0-9A-Za-z:])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){2,6}(?: ?(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
RESIDENT = r"(?<![0-9-])[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])-[0-9]{7}(?![0-9-])"
KOREAN = rf"(?<![0-9A-Za-z-])(?:{PATTERNS['phone_mobile']}|{PATTERNS['phone_city'].replace('-?', '-')})(?![0-9A-Za-z-])"
CARD_FORM = r"[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
CARD = rf"(?<![0-9])(?:{CARD_FORM})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:(?:{TITLES})\.? ){{1,3}}{_unit}(?: {_unit}){{0,5}}|(?:{_given})(?: {_unit}){{1,2}})"
#: Group 1 is the secret after a key word; no other group captures.
ANY = "|".join(f"(?:{x})" for x in (EMAIL, IP, IPV6, IBAN, SECRET, SSN, RESIDENT, KOREAN, CARD, PHONE, NAME))
#: Every text with a match has one of these, or a digit or @, or a name; other texts aren't searched.
HINTS = ("token", "key", "secret", "password", "passwd", "pwd", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def may_hold(text: Column) -> Column:
    """A cheap test that every text with a match of ANY passes."""
    out = text.rlike("[0-9@]")
    for hint in HINTS:
        out = out | text.contains(hint)
    return out | text.rlike("[a-f]{40}") | text.rlike(NAME)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def matches_of(text: Column) -> Column:
    """All matches of ANY in a text; none in a null one."""
    return F.when(F.coalesce(may_hold(text), F.lit(False)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def with_secrets(text: Column, found: Column) -> Column:
    """array<struct<v, s>> of the matches found; s: the match again where a key word stands before it, told only in texts
    with a number that fails Luhn."""
    fails = F.exists(found, lambda v: v.rlike(f"^(?:{CARD_FORM})$") & ~F.call_function("luhn_check", digits(v)))
    keyed = F.when(fails, F.regexp_extract_all(text, F.lit(ANY), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.arrays_zip(found, keyed).cast("array<struct<v: string, s: string>>")


def type_of(value: Column) -> Column:
    """The type of a match of ANY; null: none after all (a number that fails Luhn), or a secret by its key word."""
    only = lambda rx: value.rlike(f"^(?:{rx})$")
    number = only(CARD_FORM)
    resident = only("[0-9]{13}") & (is_rrn(value) | is_fgn(value))
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(value.contains(":") & only(IPV6), F.lit("ipv6"))
        .when(only(IBAN), F.when(_mod97(F.concat(F.substring(_plain(value), F.lit(5), F.length(value)), F.substring(_plain(value), 1, 4))) == 1, F.lit("iban")))
        .when(only("[0-9]{6}-[0-9]{7}") | resident, F.lit("resident"))
        .when(only(KOREAN), F.lit("korean"))
        .when(only(rf"(?:{_octet}\.){{3}}{_octet}"), F.lit("ip"))
        .when(only(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.lit("ssn"))
        .when(number, F.when(F.call_function("luhn_check", digits(value)), F.lit("card")))
        .when(only(r"\+[0-9 ().-]{6,30}|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"), F.lit("phone"))
        .when(value.rlike(rf"^(?:(?:{TITLES})\.?|{_given}) "), F.lit("name"))
        .otherwise(F.lit("secret"))
    )


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _mod97(value: Column) -> Column:
    """The remainder of letters (10 to 35) and digits, read as one number."""
    each = F.transform(F.split(value, ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    return F.aggregate(each, F.lit(0), lambda acc, x: F.pmod(acc * F.when(x > 9, 100).otherwise(10) + F.greatest(x, F.lit(0)), F.lit(97)))


def canonical(kind: Column, value: Column) -> Column:
    """The form in which spellings of a value agree; names come by their parts."""
    return (
        F.when(kind.isin("email", "ipv6", *NAMES), F.lower(value))
        .when(kind.isin("card", "phone", "ssn", "resident", "korean"), digits(value))
        .when(kind == "iban", _plain(value))
        .otherwise(value)
    )


def _blocks(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """array<struct<v, s>>: 64 characters of the value each, and as many keyed bytes in hexadecimal digits."""
    count = F.ceil(F.length(value) / F.lit(64)).cast("int")
    keyed = lambda b: F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, attempt.cast("string"), b.cast("string")).cast("binary"), 512)
    return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), lambda b: F.struct(F.substring(value, b * 64 + 1, F.lit(64)).alias("v"), keyed(b).alias("s")))


def _number(stream: Column, at: Column | int) -> Column:
    """0 to 255, from the stream's place."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _alike(blocks: Column, hexadecimal: Column) -> Column:
    """Character by character: a digit for a digit, a letter of the same case and script for a letter."""
    def one(c: Column, i: Column, stream: Column) -> Column:
        n = _number(stream, i)
        return (
            F.when(c.rlike("[0-9]"), F.when(hexadecimal, _pick("0123456789abcdef", n)).otherwise(_pick("0123456789", n)))
            .when(c.rlike("[a-z]"), F.when(hexadecimal, _pick("0123456789abcdef", n)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n)))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .otherwise(c)
        )

    return F.array_join(F.transform(blocks, lambda x: F.array_join(F.transform(F.split(x["v"], ""), lambda c, i: one(c, i, x["s"])), "")), "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit that completes a number."""
    n = F.length(body)
    doubled = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(body, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, F.lit(2)).otherwise(F.lit(1)))
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _name(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """A name of keyed syllables in the value's script, lower-case, with its separator if it has one; later attempts make
    longer ones, so there is always another."""
    def of(script: str) -> Column:
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        some = lambda first, last: F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(syllables, F.pmod(_number(stream, i), F.lit(len(SYLLABLES[script]))))), "")
        mark = F.regexp_extract(value, "['’-]", 0)
        second = F.when(mark != "", F.concat(mark, some(F.lit(30), F.lit(31)))).otherwise(F.lit(""))
        ending = F.lit("")
        for gender, end in ENDINGS[script].items():
            ending = F.when(kind == gender, F.lit(end)).otherwise(ending)
        return F.concat(some(F.lit(0), F.least(F.lit(2) + F.floor(attempt / 3).cast("int"), F.lit(28))), second, ending)

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _resident(value: Column, stream: Column) -> Column:
    """A resident number: a possible date, century and gender as they were, and the checksum of its kind."""
    two = lambda at, most: F.lpad((F.pmod(_number(stream, at), F.lit(most)) + 1).cast("string"), 2, "0")
    sign = F.substring(value, 7, 1)
    tail = F.array_join(F.array(*[_pick("0123456789", _number(stream, k)) for k in range(4, 9)]), "")
    body = F.concat(F.lpad(F.pmod(_number(stream, 1), F.lit(69)).cast("string"), 2, "0"), two(2, 12), two(3, 28), sign, tail)
    total = sum((F.substring(body, k + 1, 1).cast("int") * (k % 8 + 2) for k in range(1, 12)), F.substring(body, 1, 1).cast("int") * 2)
    check = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)) + F.when(sign.isin("5", "6", "7", "8"), 2).otherwise(0), F.lit(10))
    return F.concat(body, check.cast("string"))


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The surrogate, canonical as the value, of an attempt."""
    blocks = _blocks(key, kind, value, attempt)
    s = F.array_join(F.transform(blocks, lambda x: x["s"]), "")
    # after some attempts in vain there may be too few of that length: e-mail and secrets then grow
    longer = F.substring(s, F.lit(1), F.floor(attempt / GROW).cast("int"))
    plain = _alike(blocks, F.lit(False))
    body = F.concat(F.substring(value, 1, 1), F.substring(plain, F.lit(2), F.length(value) - 2))
    linked = F.regexp_extract(value, "^(fe80|f[cd][0-9a-f]{2}):", 0)
    country, account = F.substring(value, 1, 2), F.substring(plain, F.lit(5), F.length(value))
    area = F.regexp_extract(value, "^(01[0-9]|02|0[0-9]{2})", 1)
    private = F.regexp_extract(value, r"^(10\.|192\.168\.|127\.)", 1)
    octet = lambda i: F.pmod(_number(s, i), F.lit(254)).cast("string")
    public = F.concat_ws(".", (F.pmod(_number(s, 0), F.lit(200)) + 12).cast("string"), octet(1), octet(2), octet(3))
    within = F.when(private == "192.168.", F.concat(private, octet(1), F.lit("."), octet(2))).otherwise(F.concat(private, octet(1), F.lit("."), octet(2), F.lit("."), octet(3)))
    return (
        F.when(kind == "email", F.concat(longer, F.regexp_replace(plain, r"\.[^.]+$", ".example")))
        .when(kind == "ip", F.when(private != "", within).otherwise(public))
        .when(kind == "card", F.concat(body, _check_digit(body)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(plain, 2, 8)))
        .when(kind == "phone", F.concat(F.substring(value, 1, 1), (F.pmod(_number(s, 1), F.lit(8)) + 2).cast("string"), F.substring(plain, F.lit(3), F.length(value))))
        .when(kind == "ipv6", F.concat(linked, F.substring(_alike(blocks, F.lit(True)), F.length(linked) + 1, F.length(value))))
        .when(kind == "iban", F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account))
        .when(kind == "resident", _resident(value, s))
        .when(kind == "korean", F.concat(area, F.substring(plain, F.length(area) + 1, F.length(value))))
        .when(kind.isin(*NAMES), _name(kind, value, s, attempt))
        .otherwise(F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(plain, F.lit(5), F.length(value)))).otherwise(F.concat(longer, _alike(blocks, value.rlike("^[0-9a-f]+$")))))
    )


def first_names(key: str) -> dict[str, str]:
    """A keyed cycle over each list: every name maps to another one of its gender and script, and no two to the same."""
    out = {}
    for names in FIRST_NAMES.values():
        order = sorted(names, key=lambda n: hashlib.sha512(f"{key}\u0001{n}".encode()).hexdigest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def written(kind: Column, value: Column, sub: Column) -> Column:
    """The surrogate in the spelling of an occurrence."""
    place = lambda i: F.length(_plain(F.substring(value, F.lit(1), i + 1)))
    spaced = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(sub, place(i), F.lit(1))).otherwise(c)), "")
    parted = F.array_join(F.transform(F.split(sub, "(?<=['’-])"), lambda x: F.initcap(x)), "")
    named = F.when((F.length(value) > 1) & (F.upper(value) == value), F.upper(sub)).otherwise(parted)
    return F.when(kind.isin("card", "phone", "ssn", "resident", "korean", "iban"), spaced).when(kind.isin(*NAMES), named).otherwise(sub)


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): surrogates distinct, and none a value of the corpus, of any kind."""
    now = cut(values.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))))
    listed = values.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n.lower()) for names in FIRST_NAMES.values() for n in names])).alias("surrogate"))
    taken = values.select(F.col("value").alias("surrogate")).unionByName(listed).distinct().withColumn("taken", F.lit(True))
    for _ in range(MOST_ATTEMPTS):
        first = now.groupBy("surrogate").agg(F.min(F.struct("value", "kind")).alias("first"), F.count("*").alias("n"))
        again = now.join(first.where("n > 1"), "surrogate", "left").join(taken, "surrogate", "left")
        clash = (F.col("first").isNotNull() & (F.struct("value", "kind") != F.col("first"))) | F.col("taken").isNotNull()
        bad = again.withColumn("clash", clash)
        now = cut(bad.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int")).select("kind", "value", "attempt", F.when(F.col("clash"), surrogate(key, F.col("kind"), F.col("value"), F.col("attempt"))).otherwise(F.col("surrogate")).alias("surrogate"), "clash"))
        if not now.where("clash").limit(1).count():
            return now.select("kind", "value", "surrogate")
        now = now.drop("clash")
    raise RuntimeError("too few surrogates of some type for the values of the corpus")


def name_parts(value: Column) -> Column:
    """array<struct<v, kind>> of a name's words: kind null for titles, particles and initials, "listed" for known first
    names, name for the last other part, given, given_f or given_m (by the title) for those before it."""
    words = F.split(value, " ")
    gender = F.lit("given")
    for tells, titles in TITLES_OF.items():
        if tells:
            gender = F.when(value.rlike(rf"^(?:(?:{TITLES})\.? )*(?:{titles})\.? "), F.lit(f"given_{tells}")).otherwise(gender)
    titled = F.size(F.split(F.regexp_extract(value, rf"^(?:(?:{TITLES})\.? )+", 0), " ")) - 1
    untouched = lambda w, i: (i < titled) | w.rlike(rf"^(?:{PARTICLES})$") | w.rlike(r"^\p{Lu}\.$")
    return F.transform(words, lambda w, i: F.struct(w.alias("v"), F.when(untouched(w, i), F.lit(None).cast("string")).when(w.rlike(f"^(?:{_given})$"), F.lit("listed")).when(i == F.size(words) - 1, F.lit("name")).otherwise(gender).alias("kind")))


def _mapped(each: DataFrame, table: DataFrame) -> DataFrame:
    """Occurrences with their surrogates: the table is broadcast while it has few rows; else values of more than HOT
    occurrences are split over several tasks."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return each.join(F.broadcast(table), ["kind", "value"])
    hot = cut(each.groupBy("kind", "value").agg(F.count("*").alias("_c")).where(F.col("_c") > HOT).withColumn("_c", F.ceil(F.col("_c") / HOT).cast("int")))
    salted = each.join(F.broadcast(hot), ["kind", "value"], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_at", "_k"), F.col("_c")).cast("int"), F.lit(0)))
    dealt = table.join(F.broadcast(hot), ["kind", "value"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_c"), F.lit(1)) - 1)))
    return salted.drop("_c").join(dealt.drop("_c"), ["kind", "value", "_salt"]).drop("_salt")


def replace(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """The table with surrogates in its texts; count_col: the number of entities found."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    found = df.select(row.alias("_row"), matches_of(F.col(f"`{text_col}`")).alias("_m"))
    # only the texts with a match are stored; the others are read again
    hits = stored(found.where(F.size("_m") > 0).withColumn("_at", F.monotonically_increasing_id()), "pii")
    each = hits.select("_at", F.posexplode(with_secrets(F.col(f"_row.`{text_col}`"), F.col("_m"))).alias("_k", "_x")).select("_at", "_k", F.col("_x.v").alias("_v"), F.col("_x.s").alias("_s"))
    each = each.withColumn("kind", F.coalesce(type_of(F.col("_v")), F.when(F.col("_s") != "", F.lit("secret"))))
    # names go part by part, all else is one part
    whole = F.array(F.struct(F.col("_v").alias("v"), F.col("kind").alias("kind")))
    each = each.select("_at", "_k", F.col("kind").isNotNull().cast("int").alias("_e"), F.posexplode(F.when(F.col("kind") == "name", name_parts(F.col("_v"))).otherwise(whole)).alias("_j", "_p"))
    each = each.select("_at", "_k", "_j", F.when(F.col("_j") == 0, F.col("_e")).otherwise(0).alias("_e"), F.col("_p.v").alias("_v"), F.col("_p.kind").alias("kind"), canonical(F.col("_p.kind"), F.col("_p.v")).alias("value"))
    known = F.coalesce(F.col("kind") == "listed", F.lit(False))
    valued = each.where(F.col("kind").isNotNull() & ~known)
    table = surrogates(valued.groupBy("kind", "value").agg(F.lit(1).alias("_one")).select("kind", "value"), key)
    # what is no entity, and titles, keep their text, so that places and matches stay aligned
    cycle = F.create_map(*[F.lit(x) for pair in sorted(first_names(key).items()) for x in pair])
    other = each.where(F.col("kind").isNull() | known).select("_at", "_k", "_j", "_e", F.when(known, F.element_at(cycle, F.col("_v"))).otherwise(F.col("_v")).alias("_s"), F.when(known, F.col("_v")).alias("_o"))
    mapped = _mapped(valued, table).select("_at", "_k", "_j", "_e", written(F.col("kind"), F.col("_v"), F.col("surrogate")).alias("_s"), F.when(F.col("kind").isin(*NAMES) & (F.length("_v") > 1), F.col("_v")).alias("_o"))
    lists = mapped.unionByName(other).groupBy("_at").agg(F.sort_array(F.collect_list(F.struct("_k", "_j", "_s", "_o"))).alias("_l"), F.sum("_e").alias("_n"))
    raw = F.col(f"_row.`{text_col}`")
    named = F.array_sort(F.transform(F.filter("_l", lambda x: x["_o"].isNotNull()), lambda x: F.struct(x["_o"].alias("o"), x["_k"].alias("k"), x["_j"].alias("j"), x["_s"].alias("s"))))
    joined = hits.join(lists, "_at").select("_row", "_l", "_n", F.split(raw, ANY, -1).alias("_gaps"), named.alias("_named"))
    # of each part its first occurrence counts
    firsts = F.filter("_named", lambda x, i: (i == 0) | (F.get("_named", i - 1)["o"] != x["o"]))
    joined = joined.select("_row", "_l", "_n", "_gaps", F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["o"], x["s"]))).alias("_parts"))
    alone = lambda g: F.array_join(F.transform(F.regexp_extract_all(g, F.lit(ALONE), F.lit(0)), lambda w: F.when(w.rlike(r"^\p{Lu}"), F.coalesce(F.try_element_at("_parts", w), w)).otherwise(w)), "")
    gaps = F.when(F.size(F.map_keys("_parts")) == 0, F.col("_gaps")).otherwise(F.transform("_gaps", alone))
    joined = joined.select("_row", "_l", "_n", gaps.alias("_gaps"))
    pieces = F.transform("_l", lambda x: F.concat(F.when(x["_j"] == 0, F.get("_gaps", x["_k"])).otherwise(F.lit(" ")), x["_s"]))
    text = F.concat(F.array_join(pieces, ""), F.element_at("_gaps", -1))
    fields = lambda t: [(t if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in df.columns if c != count_col]
    count = lambda n: [n.cast("long").alias(count_col)] if count_col else []
    clean = found.where(F.size("_m") == 0).select(*fields(raw), *count(F.lit(0)))
    return clean.unionByName(joined.select(*fields(text), *count(F.col("_n"))))


def entities(text: str) -> list[str]:
    """The matches of one text by Python's regular expressions, for tests (no lookbehind of varying length there)."""
    import regex

    return [m.group() for m in regex.finditer(ANY, text)] if text else []
