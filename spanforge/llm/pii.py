"""Format-preserving pseudonyms for personal data (DataFrame and SQL functions only).

Candidates are found by one pattern, validated by kind, and permuted inside their own
format by a keyed Feistel network: a card number becomes another number with a valid
check digit, a date another date between 0001-01-01 and 9999-12-31, a social security
or phone number another one that could be issued.  The network works on the product of
two ranges that together number the valid values exactly, so it is a permutation of
them.  It depends on the key and the value alone: equal values stay linked across
documents and different ones stay apart.  E-mail addresses and secrets have no number format to
permute in; they get a keyed digest in the shape of the original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The setting that holds the key.
KEY_SETTING = "spanforge.pii.key"
FEISTEL_ROUNDS = 8
#: Days from 0001-01-01 to 9999-12-31, as a product of two ranges.
DAY_RANGES = (1717, 2127)

#: Kinds of candidate, in the order tried at a position.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
CLOUD_KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_-]{8,}+"
ISO_DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
PATTERN = "|".join((EMAIL, CLOUD_KEY, SECRET, ISO_DATE, IPV4, SSN, PHONE, CARD))


def key_of(spark: SparkSession, default: str | None = None) -> str:
    """The session's key.  There is no key in the operator: without the setting or a default it refuses."""
    key = spark.conf.get(KEY_SETTING, default)
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return key


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(tag: str, value: str, key: str) -> str:
    return f"sha2(concat('{key}|{tag}|', {value}), 256)"


def _permute(tag: str, left: str, right: str, a: str, b: str, key: str, shape: str) -> str:
    """Alternating Feistel network on Z_a x Z_b; ``shape`` formats the pair ``s`` (s.l, s.r)."""
    rounds = ", ".join(map(str, range(FEISTEL_ROUNDS)))

    def noise(x: str) -> str:
        return f"cast(conv(substr(sha2(concat('{key}|{tag}|', i, '|', {x}), 256), 1, 14), 16, 10) as bigint)"

    network = (
        f"aggregate(array({rounds}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
        f"if(i % 2 = 0, named_struct('l', (s.l + {noise('s.r')}) % cast({a} as bigint), 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {noise('s.l')}) % cast({b} as bigint))))"
    )
    return f"element_at(transform(array({network}), s -> {shape}), 1)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order by those of ``digits``."""
    return (
        f"aggregate(sequence(1, length({value})), named_struct('o', '', 'k', 0), (t, j) -> "
        f"if(substr({value}, j, 1) between '0' and '9', named_struct('o', concat(t.o, substr({digits}, t.k + 1, 1)), 'k', t.k + 1), "
        f"named_struct('o', concat(t.o, substr({value}, j, 1)), 'k', t.k)), t -> t.o)"
    )


def _luhn_sum(digits: str) -> str:
    digit = f"cast(substr({digits}, length({digits}) - j, 1) as int)"
    return (
        f"aggregate(sequence(0, length({digits}) - 1), 0, (t, j) -> t + "
        f"if(j % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit})))"
    )


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def pseudonym_sql(m: str, key: str) -> str:
    """SQL for the pseudonym of candidate ``m``; an invalid candidate stays as it is."""
    if not key:
        raise ValueError("an empty key")
    key = key.replace("\\", "\\\\").replace("'", "\\'")
    number = f"rpad('1', {{}} + 1, '0')"
    check = _bind("concat(p, '0')", "z", _luhn_sum("z"))
    card = _bind(
        _digits(m), "d",
        f"if({_luhn_sum('d')} % 10 = 0, "
        + _bind(
            _permute(
                "card",
                "substr(d, 1, (length(d) - 1) div 2)",
                "substr(d, (length(d) - 1) div 2 + 1, length(d) - 1 - (length(d) - 1) div 2)",
                number.format("(length(d) - 1) div 2"),
                number.format("length(d) - 1 - (length(d) - 1) div 2"),
                key,
                "concat(lpad(s.l, (length(d) - 1) div 2, '0'), lpad(s.r, length(d) - 1 - (length(d) - 1) div 2, '0'))",
            ),
            "p", _bind(f"concat(p, cast((10 - {check} % 10) % 10 as string))", "n", _refill(m, "n")),
        )
        + f", {m})",
    )
    # Area and exchange: 200 to 999 without those that end in 11, 99 of every hundred.
    def nth(x: str) -> str:
        return f"({x} - 200 - ({x} - 112) div 100)"

    def of(i: str) -> str:
        return f"(({i} div 99 + 2) * 100 + {i} % 99 + if({i} % 99 >= 11, 1, 0))"

    phone = _bind(
        _digits(m), "d",
        "if(substr(d, -10) rlike '^[2-9](?!11)[0-9]{2}[2-9](?!11)[0-9]{6}$', "
        + _bind(
            _permute("phone", nth("cast(substr(d, -10, 3) as int)"), f"{nth('cast(substr(d, -7, 3) as int)')} * 10000 + cast(substr(d, -4) as int)", "792", "7920000", key,
                     f"concat(substr(d, 1, length(d) - 10), {of('s.l')}, {of('(s.r div 10000)')}, lpad(s.r % 10000, 4, '0'))"),
            "n", _refill(m, "n"),
        )
        + f", {m})",
    )
    # Area 1 to 899 but 666, group 1 to 99, serial 1 to 9999.
    area, group, serial = (f"cast(substr({m}, {at}, {n}) as int)" for at, n in ((1, 3), (5, 2), (8, 4)))
    ssn = f"if({m} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$', " + _permute(
        "ssn", f"{area} - 1 - if({area} > 666, 1, 0)", f"({group} - 1) * 9999 + {serial} - 1", "898", "989901", key,
        "concat(lpad(s.l + 1 + if(s.l >= 665, 1, 0), 3, '0'), '-', lpad(s.r div 9999 + 1, 2, '0'), '-', lpad(s.r % 9999 + 1, 4, '0'))",
    ) + f", {m})"
    ip = _bind(
        f"transform(split({m}, '[.]'), x -> cast(x as int))", "o",
        f"if(array_max(o) > 255, {m}, "
        + _permute("ipv4", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", key,
                   "concat_ws('.', cast(s.l div 256 as string), cast(s.l % 256 as string), cast(s.r div 256 as string), cast(s.r % 256 as string))")
        + ")",
    )
    days, rest = DAY_RANGES
    date = _bind(
        f"datediff(try_cast({m} as date), date'0001-01-01')", "e",
        f"if(e is null or e < 0, {m}, "
        + _permute("date", f"e div {rest}", f"e % {rest}", str(days), str(rest), key, f"lpad(cast(date_add(date'0001-01-01', cast(s.l * {rest} + s.r as int)) as string), 10, '0')")
        + ")",
    )
    email = _bind(_digest("email", f"lower({m})", key), "h", "concat('u', substr(h, 1, 12), '@d', substr(h, 13, 8), '.example')")
    cloud = f"concat('AKIA', upper(substr({_digest('cloud', m, key)}, 1, 16)))"
    secret = _bind(
        f"regexp_extract({m}, '[A-Za-z0-9+/_-]+$', 0)", "v",
        f"concat(substr({m}, 1, length({m}) - length(v)), substr(repeat({_digest('secret', 'v', key)}, length(v) div 64 + 1), 1, length(v)))",
    )
    return (
        f"case when contains({m}, '@') then {email} "
        f"when startswith({m}, 'AKIA') and length({m}) = 20 then {cloud} "
        f"when {m} rlike '[=:]' then {secret} "
        f"when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then {date} "
        f"when {m} rlike '^[0-9]+([.][0-9]+){{3}}$' then {ip} "
        f"when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn} "
        f"when {m} rlike '^([+][0-9]{{1,3}}[ .-])?([(][0-9]{{3}}[)] ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$' then {phone} "
        f"else {card} end"
    )


def pseudonymise_column(text_col: str, key: str) -> Column:
    """``text_col`` with every validated value replaced; null stays null."""
    text = "`" + text_col.replace("`", "``") + "`"
    pattern = _quoted(PATTERN)
    return F.expr(
        f"case when {text} rlike {pattern} then array_join(zip_with(split({text}, {pattern}, -1), "
        f"transform(regexp_extract_all({text}, {pattern}, 0), m -> {pseudonym_sql('m', key)}), "
        f"(a, b) -> concat(a, coalesce(b, ''))), '') else {text} end"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` pseudonymised; all other columns as they are.

    Null and empty texts stay so.  Candidates that fail validation (check digit,
    octets, calendar, numbers never issued) stay in place.  Repeated rows come out equal.  No shuffle.
    """
    return docs.withColumn(text_col, pseudonymise_column(text_col, key))
