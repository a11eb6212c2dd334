"""Format-preserving pseudonyms for personal data, as column expressions only.

Candidates are found by one pattern, validated by what the format demands (check digit, octets,
calendar, number plan), and replaced by a keyed permutation of the same format, so that equal
values get equal pseudonyms in every document and different values never share one.

A value becomes a vector of digits, each with its own radix (10 for a digit, 26 for a letter, 256
for an octet, 8 for a digit from 2 to 9, 27 x 5411 for the 146,097 days of the 400-year calendar
cycle).  A Feistel network adds, digit by digit and modulo its radix, a keyed hash of one half to
the other half.  Every round can be undone, whatever the radices, so the whole is a bijection on
exactly the valid values of the format, without cycle walking; check digits are computed anew.

The work is a projection over the scan: no shuffle, no user function.  Texts without any character
that all candidates need are passed through.

Defined results: null stays null, empty stays empty; candidates that fail validation stay as they
are; a text may be of any length, every pattern has bounded parts and starts at a boundary only, so
matching is linear; repeated rows are treated alike; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.llm.common import query, table
from mirrortab.llm.quality import let

ROUNDS = 8
#: Key of the registered query and pipeline.  A deployment passes its own secret.
EXAMPLE_KEY = "replace-this-key"

#: First day and number of days of the calendar cycle that dates are permuted in.
FIRST_DAY, DAYS, DAY_RADIX = "1700-03-01", 146_097, 5_411

#: What candidates look like, in order of preference.
SECRET_HEAD = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x22\x27]?[ ]{0,3}[=:][ ]{0,3}[\x22\x27]?"
BEARER_HEAD = r"(?i:bearer)[ ]{1,3}"
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])" + SECRET_HEAD + r"[^\s\x22\x27]{6,}+",
    "bearer": r"(?<![A-Za-z0-9])" + BEARER_HEAD + r"[A-Za-z0-9._~+/=-]{16,}+",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+(?:1(?:[ .()/-]{0,3}[0-9]){10}|[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{1,4}\)?){2,5})(?![0-9])",
    "national": r"(?<![0-9])(?<![0-9][.-])(?:(?:1[ .-]?)?\([0-9]{3}\)[ .-]{0,2}[0-9]{3}[ .-]?|(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-])"
    r"[0-9]{4}(?![0-9]|[.-][0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|"
    r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:]|[.][0-9])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Digits that one piece of noise serves: six hex digits each of two 512-bit hashes.
PIECE = 42
#: Every candidate holds one of these characters.
NEEDED = "[0-9@=:]|(?i:bearer )"


def feistel(values: Column, radices: Column, tweak: Column | str, key: str) -> Column:
    """Permute a vector of digits; each stays below its radix."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def one_round(v: Column, r: Column, radices: Column) -> Column:
        cut = F.floor(F.size(v) / 2).cast("int")
        left_turn = r % 2 == 1
        other = F.when(left_turn, F.slice(v, cut + 1, F.size(v) - cut)).otherwise(F.slice(v, F.lit(1), cut))
        said = F.concat_ws("|", F.lit(key), tweak, r.cast("string"), F.array_join(other.cast("array<string>"), ","))
        longer = F.size(v) - cut
        hashed = lambda x, i: F.sha2(F.concat(x, F.lit(f"|{i}")), 512)

        def pieces(x: Column) -> Column:
            first = F.array(F.concat(hashed(x, 0), hashed(x, 1)))
            numbered = lambda seed, k: F.concat_ws("|", seed, k.cast("string"))
            further = lambda seed: F.transform(
                F.sequence(F.lit(1), F.floor((longer - 1) / PIECE).cast("int")),
                lambda k: F.concat(hashed(numbered(seed, k), 0), hashed(numbered(seed, k), 1)),
            )
            return F.when(longer <= PIECE, first).otherwise(F.concat(first, let(hashed(x, 2), further)))

        def step(h: Column) -> Column:
            nth = lambda i: F.when(left_turn, i).otherwise(i - cut)
            digits = lambda j: F.substr(F.get(h, F.floor(j / PIECE).cast("int")), j % PIECE * 6 + 1, F.lit(6))
            add = lambda i: F.conv(digits(nth(i)), 16, 10).cast("bigint")
            return F.transform(
                v, lambda x, i: F.when((i < cut) == left_turn, F.pmod(x + add(i), F.get(radices, i))).otherwise(x)
            )

        return let(let(said, pieces), step)

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return let(radices, lambda m: F.aggregate(rounds, values, lambda v, r: one_round(v, r, m)))


def _chars(m: Column) -> Column:
    return F.split(m, "")


def _entry(c: Column, free: Column, low: Column | None = None) -> Column:
    """``(base, value, radix)`` of a character; a radix of 1 keeps it.

    Digits from ``low`` on stay there, and so do those below it.
    """
    code = F.ascii(c)
    digit, small, large = c.between("0", "9"), c.between("a", "z"), c.between("A", "Z")
    base = F.when(digit, F.lit(48)).when(small, F.lit(97)).otherwise(F.lit(65))
    radix = F.when(digit, F.lit(10)).otherwise(F.lit(26))
    if low is not None:
        above, below = digit & (code >= 48 + low), digit & (code < 48 + low)
        base, radix = F.when(above, 48 + low).otherwise(base), F.when(above, 10 - low).when(below, low).otherwise(radix)
    moves = free & (digit | small | large)
    return F.struct(
        F.when(moves, base).otherwise(code).cast("bigint").alias("base"),
        F.when(moves, code - base).otherwise(F.lit(0)).cast("bigint").alias("value"),
        F.when(moves, radix).otherwise(F.lit(1)).cast("bigint").alias("radix"),
    )


def _permuted_text(entries: Column, tweak: str, key: str) -> Column:
    """Permute the characters with a radix above 1 among themselves."""

    def rebuilt(e: Column) -> Column:
        placed = F.transform(e, lambda x, i: F.struct(i.alias("at"), x.alias("of")))
        active = F.filter(placed, lambda x: x["of"]["radix"] > 1)
        others = F.filter(placed, lambda x: x["of"]["radix"] <= 1)
        shown = lambda x, new: F.struct(x["at"].alias("at"), F.char(x["of"]["base"] + new).alias("c"))

        def put(a: Column) -> Column:
            new = feistel(F.transform(a, lambda x: x["of"]["value"]), F.transform(a, lambda x: x["of"]["radix"]), tweak, key)
            moved = let(new, lambda v: F.transform(a, lambda x, k: shown(x, F.get(v, k))))
            whole = F.array_sort(F.concat(moved, F.transform(others, lambda x: shown(x, F.lit(0)))))
            return F.array_join(F.transform(whole, lambda x: x["c"]), "")

        return let(active, put)

    return let(entries, rebuilt)


def _by_class(m: Column, first: Column, last: Column, tweak: str, key: str) -> Column:
    """Letters stay letters and digits stay digits from character ``first`` to ``last`` (from 1)."""

    def entries(ends: Column) -> Column:
        return F.transform(_chars(m), lambda c, i: _entry(c, (i + 1 >= ends["first"]) & (i + 1 <= ends["last"])))

    return _permuted_text(let(F.struct(first.alias("first"), last.alias("last")), entries), tweak, key)


def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Sum of a digit string from its right end, doubling every other digit."""
    values = F.transform(_chars(F.reverse(digits)), lambda c: c.cast("bigint"))
    weighed = F.transform(
        values, lambda d, i: F.when((i % 2 == 0) == F.lit(doubled_first), F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    )
    return F.aggregate(weighed, F.lit(0).cast("bigint"), lambda a, d: a + d)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    n = F.char_length(m)
    body = _by_class(m, F.lit(2), n - 1, "card", key)

    def checked(new: Column) -> Column:
        front = F.substr(new, F.lit(1), n - 1)
        return F.concat(front, ((10 - _luhn_sum(_digits(front), True) % 10) % 10).cast("string"))

    return F.when(_luhn_sum(_digits(m), False) % 10 == 0, let(body, checked)).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("bigint"))
    new = let(octets, lambda v: feistel(v, F.array(*[F.lit(256).cast("bigint")] * 4), "ipv4", key))
    valid = F.forall(octets, lambda o: o <= 255)
    return F.when(valid, F.array_join(new.cast("array<string>"), ".")).otherwise(m)


def _ipv6(m: Column, key: str) -> Column:
    """All eight groups of the address, however it is written; shown in full."""
    said = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    sides = F.split(m, "::")
    right = F.when(F.size(sides) > 1, said(F.get(sides, F.lit(1)))).otherwise(F.array().cast("array<string>"))

    def shown(of: Column) -> Column:
        missing = 8 - F.size(of["left"]) - F.size(of["right"])
        groups = F.concat(of["left"], F.array_repeat(F.lit("0"), missing), of["right"])
        values = F.transform(groups, lambda g: F.conv(g, 16, 10).cast("bigint"))
        new = let(values, lambda v: feistel(v, F.array(*[F.lit(65_536).cast("bigint")] * 8), "ipv6", key))
        text = F.array_join(F.transform(new, lambda v: F.lower(F.hex(v))), ":")
        named = F.size(of["left"]) + F.size(of["right"])
        # fewer or shorter groups are as likely something else
        short = m.contains("::") & named.between(2, 7) & F.exists(groups, lambda g: F.char_length(g) > 2)
        return F.when(((missing == 0) & ~m.contains("::")) | short, text).otherwise(m)

    return let(F.struct(said(F.get(sides, F.lit(0))).alias("left"), right.alias("right")), shown)


def _mod_97(m: Column) -> Column:
    """An account number of letters and digits modulo 97, a letter being 10 to 35."""
    digit = lambda c: c.between("0", "9")
    return F.aggregate(
        _chars(m), F.lit(0).cast("bigint"),
        lambda a, c: F.when(digit(c), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97,
    )


def _iban(m: Column, key: str) -> Column:
    """Country and layout stay, letters stay letters; the check digits are computed anew."""
    plain = lambda x: F.regexp_replace(x, " ", "")
    turned = lambda x, check: F.concat(F.substr(x, F.lit(5), F.char_length(x)), F.substr(x, F.lit(1), F.lit(2)), check)
    own = lambda x: F.substr(x, F.lit(3), F.lit(2))
    valid = let(plain(m), lambda x: (_mod_97(turned(x, own(x))) == 1) & own(x).between("02", "98") & (F.char_length(x) >= 15))

    def checked(new: Column) -> Column:
        check = F.lpad((98 - _mod_97(turned(plain(new), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substr(new, F.lit(1), F.lit(2)), check, F.substr(new, F.lit(5), F.char_length(new)))

    return F.when(valid, let(_by_class(m, F.lit(5), F.char_length(m), "iban", key), checked)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; a number of code 1 has the same pseudonym with and without it.

    In its plan area and exchange begin with 2 to 9.  Numbers outside the plan are as personal: a first
    digit of 0 or 1 becomes 0 or 1, so that they never share a pseudonym with a number of the plan.
    """
    n = F.char_length(_digits(m))
    american = ~m.startswith("+") | m.startswith("+1")
    code = F.char_length(F.regexp_extract(m, r"^\+(?:[0-9]{1,3}?(?![0-9])|7|[0-9]{2})", 0))

    def entries(chars: Column) -> Column:
        nth = lambda i: F.char_length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9]", "")) - n + 10  # in the ten
        free = lambda i: F.when(american, nth(i) > 0).otherwise(i + 1 > code)
        lows = lambda i: F.when(american & nth(i).isin(1, 4), F.lit(2)).otherwise(F.lit(0))
        return F.transform(chars, lambda c, i: _entry(c, free(i), lows(i)))

    return F.when(american | n.between(8, 15), _permuted_text(entries(_chars(m)), "phone", key)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.get(F.split(m, "-"), F.lit(i)).cast("bigint")
    area, group, serial = part(0), part(1), part(2)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(area - 1 - (area > 666).cast("bigint"), group - 1, serial - 1)
    new = feistel(values, F.array(*[F.lit(r).cast("bigint") for r in (898, 99, 9999)]), "ssn", key)

    def shown(v: Column) -> Column:
        index = F.get(v, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", index + (index >= 666).cast("bigint"), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)

    return F.when(valid, let(new, shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """In the first of the layouts of its shape in which it is a day of the cycle."""
    out = m
    layouts = (
        ("^....-", "yyyy-MM-dd"), ("^../", "dd/MM/yyyy"), ("^../", "MM/dd/yyyy"), (r"^..\.", "dd.MM.yyyy"),
    )
    for shape, layout in layouts:
        day = F.try_to_date(m, layout)
        number = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
        values = F.array(F.floor(number / DAY_RADIX), number % DAY_RADIX)
        new = feistel(values, F.array(F.lit(DAYS // DAY_RADIX).cast("bigint"), F.lit(DAY_RADIX).cast("bigint")), "date", key)
        moved = let(new, lambda v: F.date_format(
            F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(v, F.lit(0)) * DAY_RADIX + F.get(v, F.lit(1))).cast("int")), layout
        ))
        valid = m.rlike(shape) & (number >= 0) & (number < DAYS)
        out = F.when(m == out, F.when(valid, moved).otherwise(out)).otherwise(out) if out is not m else F.when(valid, moved).otherwise(m)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate itself if it is not valid."""
    whole = F.char_length(m)
    head = F.char_length(F.regexp_extract(m, "^(?:" + SECRET_HEAD + "|" + BEARER_HEAD + ")", 0))
    return (
        F.when(head > 0, _by_class(m, head + 1, whole, "secret", key))
        .when(m.contains("@"), _by_class(m, F.lit(1), F.instr(m, "@") - 1, "email", key))
        .when(m.startswith("AKIA"), _by_class(m, F.lit(5), whole, "access_key", key))
        .when(m.startswith("+") | m.rlike("^(?:" + PATTERNS["national"] + ")$"), _phone(m, key))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}"), _iban(m, key))
        .when(m.rlike("^(?i:[0-9a-f:]*:[0-9a-f:]*)$"), _ipv6(m, key))
        .when(m.rlike("^[0-9]{1,3}(?:[.][0-9]{1,3}){3}$"), _ipv4(m, key))
        .when(m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), _date(m, key))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
        .otherwise(_card(m, key))
    )


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced.

    ``found`` names a column for the number of values that were replaced.
    """
    t = F.col(f"`{text}`")

    def parts(candidates: Column) -> Column:
        new = F.transform(candidates, lambda m: pseudonym(m, key))

        def joined(n: Column) -> Column:
            pieces = F.split(t, ANY, -1)
            whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(n, i), F.lit("")))), "")
            count = F.size(F.filter(F.arrays_zip(candidates.alias("a"), n.alias("b")), lambda z: z["a"] != z["b"]))
            return F.struct(whole.alias("text"), count.cast("bigint").alias("n"))

        return F.when(F.size(candidates) > 0, let(new, joined)).otherwise(unchanged)

    unchanged = F.struct(t.alias("text"), F.lit(0).cast("bigint").alias("n"))
    done = F.when(t.rlike(NEEDED), let(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), parts)).otherwise(unchanged)
    held = "_".join(["pseudonymised", *sorted(docs.columns)])  # a name no column has
    out = docs.withColumn(held, done)
    if found:
        out = out.withColumn(found, F.col(f"`{held}`")["n"])
    return out.withColumn(text, F.col(f"`{held}`")["text"]).drop(held)


@query("op6_pii_pseudonyms")
def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, EXAMPLE_KEY, found="n_replaced").select("doc_id", "n_replaced", "text")
