"""Private values under format-preserving pseudonyms, in DataFrame functions only.

Validated numbers and dates pass a keyed Feistel network over their own format: a
mixed radix a * b of which one half is shifted by a keyed function of the other,
round by round. That is a permutation of the format, so equal values stay equal in
every document and different values stay different.

Validated means: account numbers of 13 to 19 digits pass the Luhn check (and their
pseudonyms do), dates exist, social security numbers have no forbidden area, group
or serial, octets of addresses are below 256, telephone numbers have an area in
brackets or a country code. Numbers that fail are left as they are. Mail
addresses and long hexadecimal secrets, of any length, get keyed hashes of their format.

The key comes to the rows as a column that a subquery fills, so it stands in no
plan, and in no log of plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import unused

ROUNDS = 10
#: 1900-01-01 to 2099-12-31 are 73049 = 319 * 229 days.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229

_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LABEL, _TOP = "[A-Za-z0-9-]++", r"[A-Za-z]{2,}+(?![A-Za-z0-9])"
#: The kinds in the order in which they are tried; fixed values. Repetitions have no upper end and
#: give nothing back, so no text, however long its runs, is read more than a few times.
#: A mail's domain ends in its last label, or else in the first that can be a top one.
KINDS = {
    "mail": rf"(?<![._%+-])[A-Za-z0-9._%+-]++@(?:(?:{_LABEL}\.(?=[A-Za-z0-9-]))++{_TOP}|{_LABEL}(?:\.(?!{_TOP}){_LABEL})*+\.{_TOP})",
    "secret": r"[0-9a-f]{32,}+|[0-9A-F]{32,}+",
    "address": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?!\.[0-9])",
    "iso_date": rf"{_YEAR}-{_MONTH}-{_DAY}",
    "slash_date": rf"{_DAY}/{_MONTH}/{_YEAR}",
    "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}",
    "account": r"[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}",
}
#: No letter or digit on either side, and no dot or sign that would continue a number.
BEFORE, AFTER = r"(?<![A-Za-z0-9])(?<![0-9][.-])", r"(?![A-Za-z0-9])"
PATTERN = BEFORE + "(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")" + AFTER
#: What no match can do without, cheaper to look for.
HINT = r"@|[0-9][0-9/(). -]{6}|[0-9a-fA-F]{32}"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shift(key: str, kind: str, round_: str, half: str) -> str:
    """A keyed number of 48 bits from a round and a half."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {round_}, {half}), 256), 1, 12), 16, 10) as bigint)"


def _feistel(key: str, kind: str, left: str, right: str, a: str, b: str) -> str:
    """SQL struct (l, r) of a pair in a * b after all rounds; odd rounds shift the left half."""
    first = f"pmod(s.l + {_shift(key, kind, 'i', 's.r')}, {a})"
    second = f"pmod(s.r + {_shift(key, kind, 'i', 's.l')}, {b})"
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> "
        f"named_struct('l', if(i % 2 = 1, {first}, s.l), 'r', if(i % 2 = 1, s.r, {second})))"
    )


def _digits_permuted(key: str, kind: str, digits: str) -> str:
    """A string of two or more digits permuted among those of its length."""
    n = f"length({digits})"
    half = f"cast({n} div 2 as int)"
    a, b = f"cast(pow(10, {half}) as bigint)", f"cast(pow(10, {n} - {half}) as bigint)"
    out = _feistel(key, kind, f"left({digits}, {half})", f"substr({digits}, {half} + 1)", a, b)
    return _with(out, "p", f"concat(lpad(p.l, {half}, '0'), lpad(p.r, {n} - {half}, '0'))")


def _with(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _filled(template: str, digits: str) -> str:
    """The digits of ``template`` replaced, in order, by ``digits``."""
    return (
        f"aggregate(split({template}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c >= '0' and c <= '9', "
        f"named_struct('o', concat(s.o, substr({digits}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"
    )


def _luhn_sum(digits: str, odd: int) -> str:
    """Luhn sum; from the right, places of ``odd`` remainder are doubled (0: with the check digit)."""
    n = f"length({digits})"
    d = f"cast(substr({digits}, i, 1) as int)"
    return (
        f"aggregate(sequence(1, {n}), 0, (s, i) -> s + if(({n} - i) % 2 = {1 - odd}, "
        f"if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"
    )


def _date(key: str, m: str, form: str) -> str:
    day = f"datediff(to_date({m}, '{form}'), date'{FIRST_DAY}')"
    out = _feistel(key, "date", f"{day} div {DAYS_B}", f"{day} % {DAYS_B}", str(DAYS_A), str(DAYS_B))
    return f"date_format(date_add(date'{FIRST_DAY}', cast({_with(out, 'p', f'p.l * {DAYS_B} + p.r')} as int)), '{form}')"


def _pseudonym(key: str) -> str:
    """SQL of a match ``m``'s pseudonym; what is not valid stays. ``key`` is the name of the key's column."""
    plain = "regexp_replace(m, '[^0-9]', '')"
    is_ = lambda kind: f"m rlike {_text('^(?:' + KINDS[kind] + ')$')}"
    hash_ = f"sha2(concat_ws('|', {key}, 'text', m), 512)"
    octet = lambda k: f"cast(split(m, '[.]')[{k}] as int)"
    address = _with(
        _feistel(key, "address", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536"),
        "p",
        "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)",
    )
    area, group, serial = "cast(substr(m, 1, 3) as int)", "cast(substr(m, 5, 2) as int)", "cast(substr(m, 8, 4) as int)"
    #: Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    index = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1"
    back = "(p.l div 99) + 1 + if(p.l div 99 >= 665, 1, 0)"
    social = _with(
        _feistel(key, "social", index, f"{serial} - 1", str(898 * 99), "9999"),
        "p",
        f"concat_ws('-', lpad({back}, 3, '0'), lpad(p.l % 99 + 1, 2, '0'), lpad(p.r + 1, 4, '0'))",
    )
    real = f"({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0)"
    country = "if(m like '+%', length(regexp_extract(m, '^[+]([0-9]{1,3})', 1)), 0)"
    country = f"if({plain} = '' or length({plain}) - {country} < 7, 0, {country})"
    local = f"substr({plain}, {country} + 1)"
    phone = _with(f"concat(left({plain}, {country}), {_digits_permuted(key, 'phone', local)})", "q", _filled("m", "q"))
    body = f"left({plain}, length({plain}) - 1)"
    check = f"concat(b, pmod(-{_luhn_sum('b', 1)}, 10))"
    account = _with(_with(_digits_permuted(key, "account", body), "b", check), "q", _filled("m", "q"))
    mail = f"concat('user-', substr({hash_}, 1, 32), '@mail.invalid')"
    # As many hashes as the secret has room for; the first is of the secret alone.
    more = f"transform(sequence(1, (length(m) - 1) div 128 + 1), i -> if(i = 1, {hash_}, sha2(concat_ws('|', {key}, 'text', i, m), 512)))"
    secret = _with(f"left(array_join({more}, ''), length(m))", "x", "if(m rlike '[A-F]', upper(x), x)")
    return f"""case
        when {is_("mail")} then {mail}
        when {is_("secret")} and m rlike '[A-Fa-f]' and m rlike '[0-9]' then {secret}
        when {is_("address")} then {address}
        when {is_("iso_date")} and try_to_date(m, 'yyyy-MM-dd') is not null then {_date(key, "m", "yyyy-MM-dd")}
        when {is_("slash_date")} and try_to_date(m, 'dd/MM/yyyy') is not null then {_date(key, "m", "dd/MM/yyyy")}
        when {is_("social")} and {real} then {social}
        when {is_("phone")} then {phone}
        when {is_("account")} and {_luhn_sum(plain, 0)} % 10 = 0 then {account}
        else m end"""


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with private values in ``text`` replaced, and ``n_private``, how many were.

    Rows and other columns stay as they are, whatever their names (a column named
    ``n_private`` is replaced); null stays null and counts none, as empty texts do. Texts and
    values of any length are read whole. Rows that are repeated give repeated results, an
    empty table none.
    """
    found, names, secret = unused(docs.columns, "found", "names", "key")
    t, own = F.col(f"`{text}`"), [c for c in docs.columns if c != "n_private"]
    given = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    rows = docs.select("*", F.when(t.rlike(HINT) & t.rlike(PATTERN), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).alias(found))
    rows = rows.select("*", F.when(F.col(found).isNotNull(), given).alias(secret))
    rows = rows.select("*", F.expr(f"transform({found}, m -> {_pseudonym(secret)})").alias(names))
    woven = F.array_join(F.flatten(F.zip_with(F.split(t, PATTERN), names, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.expr(f"cast(size(filter(zip_with({found}, {names}, (a, b) -> a <> b), x -> x)) as bigint)")
    none = F.col(found).isNull()
    columns = [F.when(none, t).otherwise(woven).alias(text) if c == text else F.col(f"`{c}`") for c in own]
    return rows.select(*columns, F.when(none, F.lit(0).cast("long")).otherwise(changed).alias("n_private"))
