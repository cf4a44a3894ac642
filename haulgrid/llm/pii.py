"""Format-preserving pseudonyms of personal data, in SQL functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulgrid.llm.common import texts

ROUNDS = 10
#: Groups of four (the last may be shorter), 4-6-5, or digits in one piece: where a card may start.
_CARD = r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w)"
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t|tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
#: What is looked for, in this order. Each needs a digit, @, = or :, which a first quick look uses.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
              r"|(?i:(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key))\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+",
    "date": r"(?<![\d.,/-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\d/-])",
    "daytext": rf"(?<![\w.,/-])(?:\d{{1,2}}(?:st|nd|rd|th)? {_MONTH}\.?,? \d{{4}}|{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:]|\.\d)"
            r"|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?<![\w+.-])(?:\+\d{1,3}[ .-])?\d{3}(?<cut>[ .-])\d{3}\k<cut>\d{4}(?![\d-]|[ -]\d{4}[ -]\d{4}(?!\d))"
             r"|(?<![\w+.-])1(?<dot>[ .-])\d{3}\k<dot>\d{3}\k<dot>\d{4}(?![\d-])"
             r"|(?<![\w+])\+(?=\d(?:[ ().-]{0,2}\d){7,14}(?!\d))\d{1,3}(?:[ .-]?\(\d{1,4}\))?[ .-]?\d{1,12}(?:[ .-]\d{1,12}){0,5}(?!\d)"
             r"|(?<![\w.,/:=+-])1?[2-9]\d{2}[2-9]\d{6}(?![\w-]|[.,:/]\d)",
    "card": rf"(?<![\w.-])\d{{4}}(?<gap>[ -])\d{{4}}(?:\k<gap>\d{{4}}){{2,6}}(?:\k<gap>\d{{1,3}}(?![ -]\d))?(?![\w-])"
            rf"|(?<![\w.-])\d(?:(?![ -]{_CARD})[ -]?\d){{12,18}}(?![\w-])",
}
KINDS = tuple(PATTERNS)


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _feistel(kind: str, a: str, b: str, value: str, key: str) -> str:
    """A keyed permutation of 0 .. a*b - 1: rounds that add a digest of one half to the other,
    by turns modulo a and b. Each round can be undone, so different values stay different."""
    digest = "cast(conv(substr(sha2(concat_ws(':', {key}, '{kind}', i, {half}), 256), 1, 15), 16, 10) as bigint)"
    left, right = (digest.format(key=key, kind=kind, half=h) for h in ("s.r", "s.l"))
    turn = (
        f"if(i % 2 = 0, named_struct('l', pmod(s.l + {left}, fa), 'r', s.r), "
        f"named_struct('l', s.l, 'r', pmod(s.r + {right}, fb)))"
    )
    loop = (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', fv div fb, 'r', fv % fb), (s, i) -> {turn}, s -> s.l * fb + s.r)"
    )
    return _let("fa", f"cast({a} as bigint)", _let("fb", f"cast({b} as bigint)", _let("fv", f"cast({value} as bigint)", loop)))


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refill(template: str, digits: str) -> str:
    """``template`` with its digits replaced in order."""
    return _let("fd", digits, f"array_join(transform(split({template}, ''), (c, i) -> if(c between '0' and '9', "
                f"substr(fd, length({_digits(f'substr({template}, 1, i + 1)')}), 1), c)), '')")


def _power(n: str) -> str:
    return f"cast(rpad('1', cast({n} as int) + 1, '0') as bigint)"


def _check_digit(payload: str) -> str:
    """Luhn check digit of a digit string."""
    digit = f"cast(substr({payload}, length({payload}) - k + 1, 1) as int)"
    total = (f"aggregate(sequence(1, length({payload})), 0, (t, k) -> t + if(k % 2 = 0, {digit}, "
             f"{digit} * 2 - if({digit} > 4, 9, 0)))")
    return f"cast(pmod(10 - {total} % 10, 10) as string)"


def _cards(x: str, key: str) -> str:
    """(text, n): ``x`` with its cards replaced, and their number. What is no card as a whole is
    tried from each group of digits on, the longest run of groups first; all groups of a card
    but the last have four digits or more."""
    run = "array_join(slice(parts, i + 1, m), '')"
    runs = f"transform(sequence(least(size(parts) - i, 5), 1, -1), m -> named_struct('m', m, 'run', {run}, 'short', exists(slice(parts, i + 1, m - 1), p -> length(p) < 5)))"
    fits = f"length({_digits('u.run')}) between 13 and 19 and not u.short"
    hits = f"filter(transform(filter({runs}, u -> {fits}), u -> named_struct('m', u.m, 'new', {_card('u.run', key)})), u -> u.new is not null)"
    step = _let("hit", f"get({hits}, 0)",
                "if(hit is null, named_struct('out', concat(s.out, parts[i]), 'skip', 0, 'n', s.n), "
                "named_struct('out', concat(s.out, hit.new), 'skip', hit.m - 1, 'n', s.n + 1))")
    skip = "named_struct('out', s.out, 'skip', s.skip - 1, 'n', s.n)"
    scan = f"aggregate(sequence(0, size(parts) - 1), named_struct('out', '', 'skip', 0, 'n', 0), (s, i) -> if(s.skip > 0, {skip}, {step}), s -> named_struct('out', s.out, 'n', s.n))"
    whole = f"if(length({_digits(x)}) between 13 and 19, {_card(x, key)}, null)"
    parts = f"regexp_extract_all({x}, '[0-9]+[ -]?', 0)"
    return _let("all", whole, f"if(all is not null, named_struct('out', all, 'n', 1), {_let('parts', parts, scan)})")


def _card(x: str, key: str) -> str:
    """First digit and length stay, the digits between are permuted, the check digit follows."""
    middle = "substr(d, 2, length(d) - 2)"
    half = "(length(d) - 2) div 2"
    moved = _feistel("card", _power(half), _power(f"length(d) - 2 - {half}"), middle, key)
    payload = f"concat(substr(d, 1, 1), lpad(cast({moved} as string), length(d) - 2, '0'))"
    new = _let("p", payload, f"concat(p, {_check_digit('p')})")
    valid = f"{_let('q', 'substr(d, 1, length(d) - 1)', _check_digit('q'))} = substr(d, length(d), 1)"
    return _let("d", _digits(x), f"if({valid}, {_refill(x, new)}, null)")


def _phone(x: str, key: str) -> str:
    """The country code stays; the digits after it, the last ten at most, are permuted."""
    code = f"if({x} like '+%', length(regexp_extract({x}, '^[+]([0-9]{{1,3}})(?![0-9])', 1)), 0)"
    moved = _feistel("phone", _power("tail div 2"), _power("tail - tail div 2"), "substr(d, length(d) - tail + 1)", key)
    new = f"concat(substr(d, 1, length(d) - tail), lpad(cast({moved} as string), tail, '0'))"
    return _let("d", _digits(x), _let("tail", f"least(10, length(d) - if({x} like '+%', greatest(1, {code}), 0))", _refill(x, new)))


def _ssn(x: str, key: str) -> str:
    area, group, serial = (f"cast(substr({x}, {a}, {n}) as int)" for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    value = f"({area} - 1 - if({area} > 666, 1, 0)) * 989901L + ({group} - 1) * 9999 + {serial} - 1"
    area_back = "v div 989901 + 1 + if(v div 989901 >= 665, 1, 0)"
    back = (f"concat(lpad(cast({area_back} as string), 3, '0'), '-', lpad(cast(v % 989901 div 9999 + 1 as string), 2, '0'), '-', "
            f"lpad(cast(v % 989901 % 9999 + 1 as string), 4, '0'))")
    return f"if({valid}, {_let('v', _feistel('ssn', '898', '989901', value, key), back)}, null)"


def _ip(x: str, key: str) -> str:
    octets = f"transform(split({x}, '[.]'), o -> cast(o as bigint))"
    back = "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)"
    value = "((o4[0] * 256 + o4[1]) * 256 + o4[2]) * 256 + o4[3]"
    return _let("o4", octets, f"if(forall(o4, o -> o < 256), {_let('v', _feistel('ip', '65536', '65536', value, key), back)}, null)")


def _date(x: str, key: str) -> str:
    """Days of the 400 years from 1800 are permuted among themselves; day/month/year is read
    before month/day/year, and each style is written back as it was found."""
    iso = f"try_cast({x} as date)"

    def day(d: int, m: int) -> str:
        part = f"split({x}, '[/.]')"
        return f"try_cast(concat_ws('-', {part}[2], lpad({part}[{m}], 2, '0'), lpad({part}[{d}], 2, '0')) as date)"

    def written(d: int, m: int) -> str:
        cut = f"if({x} like '%/%', '/', '.')"
        first, second = ("dd", "MM") if d == 0 else ("MM", "dd")
        pad = f"if(length(split({x}, '[/.]')[0]) = 2 and length(split({x}, '[/.]')[1]) = 2, '{first}', '{first[0]}')"
        pad2 = f"if(length(split({x}, '[/.]')[0]) = 2 and length(split({x}, '[/.]')[1]) = 2, '{second}', '{second[0]}')"
        return f"concat(date_format(n, {pad}), {cut}, date_format(n, {pad2}), {cut}, date_format(n, 'yyyy'))"

    def moved(day: str, text: str) -> str:
        index = f"datediff({day}, DATE '1800-01-01')"
        new = f"date_add(DATE '1800-01-01', cast({_feistel('date', '189', '773', index, key)} as int))"
        return f"if({day} between DATE '1800-01-01' and DATE '2199-12-31', {_let('n', new, text)}, null)"

    style = "date_format(n, 'yyyy-MM-dd')"
    return (f"if({x} like '____-%', {moved(iso, style)}, "
            f"coalesce({moved(day(0, 1), written(0, 1))}, {moved(day(1, 0), written(1, 0))}))")


def _daytext(x: str, key: str) -> str:
    """The same permutation of days; the month is written out or shortened as it was found."""
    months = "array('jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec')"
    name = f"regexp_extract({x}, '[A-Z][a-z]+', 0)"
    number = f"regexp_extract({x}, '([0-9]{{1,2}})(?:st|nd|rd|th)?[ ,]', 1)"
    day = f"try_cast(concat_ws('-', right({x}, 4), lpad(array_position({months}, lower(left(mn, 3))), 2, '0'), lpad({number}, 2, '0')) as date)"
    index = "datediff(dy, DATE '1800-01-01')"
    new = f"date_add(DATE '1800-01-01', cast({_feistel('date', '189', '773', index, key)} as int))"
    month = "if(length(mn) > 3, date_format(n, 'MMMM'), date_format(n, 'MMM'))"
    back = (f"if({x} rlike '^[0-9]', concat_ws(' ', date_format(n, 'd'), {month}, date_format(n, 'yyyy')), "
            f"concat({month}, ' ', date_format(n, 'd'), if({x} like '%,%', ', ', ' '), date_format(n, 'yyyy')))")
    moved = f"if(dy between DATE '1800-01-01' and DATE '2199-12-31', {_let('n', new, back)}, null)"
    return _let("mn", name, _let("dy", day, moved))


def _mod97(text: str) -> str:
    """Remainder of a string by 97, letters counting 10 to 35."""
    value = "if(c between '0' and '9', cast(c as int), ascii(c) - 55)"
    return f"aggregate(split({text}, ''), 0, (t, c) -> (t * if(c between '0' and '9', 10, 100) + {value}) % 97)"


def _iban(x: str, key: str) -> str:
    """Country and letters stay, the digits of the account are permuted, the check digits follow."""
    tail = "right(dg, least(18, length(dg)))"
    moved = _feistel("iban", _power("tl div 2"), _power("tl - tl div 2"), tail, key)
    head = "left(dg, length(dg) - tl)"
    first = _feistel("ibanhead", _power("hl div 2"), _power("hl - hl div 2"), head, key)
    new = (f"concat(if(hl = 0, '', lpad(cast({_let('hl0', 'hl', first)} as string), hl, '0')), lpad(cast({moved} as string), tl, '0'))")
    digits = _let("dg", _digits("substr(ib, 5)"), _let("tl", "least(18, length(dg))", _let("hl", "length(dg) - tl", f"if(tl = 0, '', {new})")))
    account = _let("nd", digits, _refill("substr(ib, 5)", "nd"))
    check = f"lpad(cast(98 - {_mod97(chr(39).join(['concat(ac, left(ib, 2), ', '00', ')']))} as string), 2, '0')"
    made = _let("ac", account, f"concat(left(ib, 2), {check}, ac)")
    spaced = f"if({x} like '% %', rtrim(regexp_replace(nw, '(.{{4}})', '$1 ')), nw)"
    valid = f"length(ib) between 15 and 34 and {_mod97('concat(substr(ib, 5), left(ib, 4))')} = 1"
    return _let("ib", f"replace({x}, ' ', '')", f"if({valid}, {_let('nw', made, spaced)}, null)")


def _ipv6(x: str, key: str) -> str:
    """All 128 bits are permuted by halves of 64, with exclusive-or in place of sums; written in full."""
    groups = (f"if({x} like '%::%', concat(filter(split(split({x}, '::')[0], ':'), g -> g <> ''), "
              f"array_repeat('0', 8 - size(filter(split({x}, ':'), g -> g <> ''))), filter(split(split({x}, '::')[1], ':'), g -> g <> '')), split({x}, ':'))")

    def half(start: int) -> str:
        return f"cast(conv(array_join(transform(slice(gr, {start}, 4), g -> lpad(g, 4, '0')), ''), 16, -10) as bigint)"

    def digest(of: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws(':', {key}, 'ipv6', i, {of}), 256), 1, 16), 16, -10) as bigint)"

    turn = f"if(i % 2 = 0, named_struct('l', s.l ^ {digest('s.r')}, 'r', s.r), named_struct('l', s.l, 'r', s.r ^ {digest('s.l')}))"
    loop = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {half(1)}, 'r', {half(5)}), (s, i) -> {turn})"
    back = ("concat_ws(':', transform(sequence(0, 7), k -> lower(hex((if(k < 4, shiftrightunsigned(v.l, 48 - 16 * k), "
            "shiftrightunsigned(v.r, 48 - 16 * (k - 4)))) & 65535L))))")
    valid = f"size(gr) = 8 and {x} rlike '[0-9]' and size(filter(gr, g -> g <> '0')) > 1"
    return _let("gr", groups, f"if({valid}, {_let('v', loop, back)}, null)")


def _email(x: str, key: str) -> str:
    """Not a number, so no permutation: the same address has the same keyed digest."""
    return f"concat('u', substr(sha2(concat_ws(':', {key}, 'email', lower({x})), 256), 1, 16), '@example.invalid')"


def _secret(x: str, key: str) -> str:
    """Name and length stay; a value that holds a digit becomes a keyed digest."""
    value = f"if({x} like 'AKIA%', substr({x}, 5), regexp_extract({x}, {_quoted('[A-Za-z0-9+/_-]{8,}$')}, 0))"
    new = f"substr(repeat(sha2(concat_ws(':', {key}, 'secret', w), 256), length(w) div 64 + 1), 1, length(w))"
    whole = f"concat(substr({x}, 1, length({x}) - length(w)), if({x} like 'AKIA%', upper({new}), {new}))"
    return _let("w", value, f"if({x} like 'AKIA%' or w rlike '[0-9]', {whole}, null)")


_MAKERS = {"email": _email, "secret": _secret, "date": _date, "daytext": _daytext, "iban": _iban, "ipv6": _ipv6, "ssn": _ssn, "ip": _ip, "phone": _phone}


def pseudonymize(docs: DataFrame, key: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace personal data in whole texts by keyed pseudonyms of the same format.

    ``key`` is a table of one row and one column, read while the query runs: the key itself is in
    no plan, so in no log or user interface that shows plans.

    Card numbers (Luhn), bank accounts (IBAN, mod 97), social security numbers (ranges), IPv4 and
    IPv6 addresses, dates (real days of 1800 to 2199; in figures or with an English month) and phone numbers go through a Feistel permutation of all values of their
    format, so a pseudonym is valid again, equal values have equal pseudonyms in all documents,
    and different values different ones. E-mail addresses and secrets become keyed digests.
    Phones are grouped 3-3-4, international with a plus, or ten digits in one piece that may be
    a North American number. A card beside other numbers is found at the borders of groups of
    digits. What fails its validation is left as it is.

    Result: doc_id, text, and n_<kind> (replaced) for each kind; one row per input row, no
    shuffle.

    * null text: empty. Null ids, ties and repeated rows pass row by row; empty table: empty
      result. Texts without any of it come back as they are.
    """
    quoted = "secret_key"
    every = "|".join(PATTERNS.values())
    rows = texts(docs, id_col=id_col, text_col=text_col).withColumn(quoted, key.scalar())
    pattern = F.lit(every)
    some = F.col("text").rlike("[0-9@=:]")
    rows = rows.withColumn("found", F.when(some, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))
    kind = "case " + " ".join(f"when x rlike {_quoted('^(?:' + _alone(PATTERNS[k]) + ')$')} then '{k}'" for k in KINDS) + " end"
    new = "case y.kind " + " ".join(f"when '{k}' then {make('y.x', quoted)}" for k, make in _MAKERS.items()) + " end"
    made = f"if(y.kind = 'card', {_cards('y.x', quoted)}, named_struct('out', {new}, 'n', 1))"
    made = _let("z", made, "named_struct('x', y.x, 'kind', y.kind, 'new', if(z.n > 0, z.out, null), 'n', z.n)")
    named = f"transform(transform(found, x -> named_struct('x', x, 'kind', {kind})), y -> {made})"
    rows = rows.withColumn("made", F.expr(f"if(size(found) = 0, cast(array() as array<struct<x:string,kind:string,new:string,n:int>>), {named})"))
    whole = F.expr("array_join(zip_with(gaps, made, (g, m) -> concat(g, coalesce(m.new, m.x, ''))), '')")
    rows = rows.withColumn("gaps", F.when(F.size("found") > 0, F.split("text", every, -1)))
    counts = [F.expr(f"aggregate(filter(made, m -> m.kind = '{k}' and m.new is not null), 0, (n, m) -> n + m.n)").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", F.when(F.size("found") > 0, whole).otherwise(F.col("text")).alias("text"), *counts)


def _alone(pattern: str) -> str:
    """A pattern for the match by itself: what stands around it is gone."""


    return re.sub(r"\(\?<![^()]*\)", "", pattern)
