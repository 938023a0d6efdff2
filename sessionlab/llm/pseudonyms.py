"""Personal data as format-preserving pseudonyms, in DataFrame functions only.

Every value found and validated is permuted within its own format by a keyed Feistel network, so equal values get equal
pseudonyms in every document and no table of values is kept: e-mail addresses (letters and digits of the local part),
payment cards (Luhn), IBANs (mod 97), phone numbers, IPv4 addresses, US social security numbers, dates, access keys and
passwords. Cards keep their first digit and get a right check digit, IBANs their country and right check digits, phone
numbers what makes them dialable, dates stay dates within one of the 16384-day windows counted from 1900. Numbers that
fail their check are left as they are, and so are digits in other groups than a card's; phone numbers are told by length and punctuation alone.

Defined results: a null text stays null, without counts; texts without values stay as they are; repeated rows give equal
rows; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10  # even, so that both halves end in their places

# The formats looked for, in this order where two begin at one place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
PASSWORD = r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api_key)[=:] ?[^\s,;\"']{4,200}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE3 = r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
PHONE = (r"(?<![A-Za-z0-9])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|"
         rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)|[0-9]{{2,4}})(?:(?! (?:{IP}|{DATE}|{SSN}))[ .-]?[0-9]{{2,4}}){{2,4}}|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}|{PHONE3})(?![0-9])")
# Cards and IBANs stand in runs of groups, which end where a value of another format begins; the values are looked for inside.
OTHER = f"(?! (?:{EMAIL}|{KEY}|{IP}|{DATE}|{SSN}|{PHONE3}))"
IBANS = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{8}})[A-Z0-9]++(?![a-z])(?:{OTHER}[ -][A-Z0-9]++(?![a-z]))*+"
CARDS = rf"(?<![A-Za-z0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?![A-Za-z])(?:{OTHER}[ -][0-9]++(?![A-Za-z]))*+"
ANY = "|".join((EMAIL, KEY, PASSWORD, IBANS, IP, DATE, SSN, PHONE, CARDS))
# Readings of a run at its group bounds, the first valid ones win: longer before shorter. A card begins and is as long as issuers have it,
# and stands unbroken or in a card's groups: fours with a shorter last one, or 4-6-5 and 4-6-4. Other numbers in a row are no card, whatever their digits add up to.
IBAN_READINGS = tuple(rf"(?<![A-Za-z0-9])(?=([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}})(?![A-Za-z0-9]))" for n in range(31, 7, -1))
ISSUED = ((19, "[46]"), (18, "6"), (17, "6"), (16, "(?:[456]|2[2-7]|35)"), (15, "3[47]"), (14, "3[0689]"), (13, "4"))
SIXES = {15: "5", 14: "4"}


def card_reading(length: int, first: str) -> str:
    """A card of `length` digits, unbroken or grouped with one kind of separator."""
    fours, last = divmod(length - 4, 4)
    grouped = rf"[0-9]{{4}}([ -])[0-9]{{4}}(?:\2[0-9]{{4}}){{{fours - 1}}}" + (rf"\2[0-9]{{{last}}}" if last else "")
    sixes = rf"|[0-9]{{4}}([ -])[0-9]{{6}}\3[0-9]{{{SIXES[length]}}}" if length in SIXES else ""
    return rf"(?<![A-Za-z0-9])(?={first})(?=([0-9]{{{length}}}|{grouped}{sixes})(?![A-Za-z0-9]))"


CARD_READINGS = tuple(card_reading(*issued) for issued in ISSUED)
HIDDEN = "".join(chr(0xE000 + i) for i in range(36))
SHOWN = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that it uses more than once: written out, the value would stand in the plan, and be computed, each time."""
    return F.transform(F.array(value), body)[0]


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def part(s: Column, at, length=None) -> Column:
    """Characters from place `at` (1 is the first)."""
    return F.substring(s, at, length) if length is not None else F.substring(s, at, F.length(s))


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def keystream(key: str, kind: str, turn: Column, other: Column, i: Column) -> Column:
    """A number of 0 to 65535 for place `i`, from the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), F.floor(i / 16).cast("string"), other), 256)
    return F.conv(F.substring(digest, ((i % 16) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def shifted(half: Column, other: Column, key: str, kind: str, turn: Column) -> Column:
    """Every digit, small and capital letter (A-Z) of `half` moved on within its own class."""
    def move(c, i):
        first = F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
        size = F.when(first == 48, 10).otherwise(26)
        return F.when(first.isNotNull(), F.chr(first + (F.ascii(c) - first + keystream(key, kind, turn, other, i)) % size)).otherwise(c)
    return F.array_join(F.transform(letters(half), move), "")


def feistel(core: Column, key: str, kind: str) -> Column:
    """The two halves of `core` shifted in turn, each by a keyed hash of the other: a permutation of strings of its shape."""
    def halves(s):
        cut = F.floor(F.length(s) / 2).cast("int")
        return F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), named(core, halves), lambda s, t: F.struct(
        s["b"].alias("a"), shifted(s["a"], s["b"], key, kind, t).alias("b")))
    return named(end, lambda e: F.concat(e["a"], e["b"]))


def feistel_number(x: Column, half: int, key: str, kind: str) -> Column:
    """A permutation of 0 to half*half - 1."""
    start = named(x, lambda v: F.struct(F.floor(v / half).cast("long").alias("a"), (v % half).cast("long").alias("b")))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, t: F.struct(
        s["b"].alias("a"), ((s["a"] + keystream(key, kind, t, s["b"].cast("string"), F.lit(0)) % half) % half).alias("b")))
    return named(end, lambda e: e["a"] * half + e["b"])


def refilled(shape: Column, chars: Column, what: str) -> Column:
    """`shape` with its characters of the class `what` (a regex) replaced, in order, by those of `chars`."""
    end = F.aggregate(letters(shape), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), lambda acc, c: F.when(
        c.rlike(what), F.struct(F.concat(acc["s"], F.substring(chars, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(
        F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i"))))
    return end["s"]


def luhn(d: Column, first: int) -> Column:
    """Luhn sum of the digits of `d` from the right; `first` is the last digit's factor."""
    def add(acc, c):
        v = c.cast("int") * acc["f"]
        return F.struct((acc["s"] + F.when(v > 9, v - 9).otherwise(v)).alias("s"), (3 - acc["f"]).alias("f"))
    return F.aggregate(letters(F.reverse(d)), F.struct(F.lit(0).alias("s"), F.lit(first).alias("f")), add)["s"]


def mod97(s: Column) -> Column:
    return F.aggregate(letters(s), F.lit(0), lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def card(m: Column, key: str) -> tuple[Column, Column]:
    d = digits(m)
    core = F.concat(part(d, F.lit(1), F.lit(1)), feistel(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    whole = named(core, lambda c: F.concat(c, ((10 - luhn(c, 2) % 10) % 10).cast("string")))
    return luhn(d, 1) % 10 == 0, refilled(m, whole, "[0-9]")


def iban(m: Column, key: str) -> tuple[Column, Column]:
    s = F.replace(m, F.lit(" "), F.lit(""))
    country, rest = F.substring(s, 1, 2), part(s, F.lit(5))
    check = lambda fresh: F.lpad((98 - mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
    whole = named(feistel(rest, key, "iban"), lambda fresh: F.concat(country, check(fresh), fresh))
    return mod97(F.concat(rest, F.substring(s, 1, 4))) == 1, refilled(m, whole, "[0-9A-Z]")


def ip(m: Column, key: str) -> tuple[Column, Column]:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    fresh = feistel_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, key, "ip")
    out = named(fresh, lambda n: F.concat_ws(".", *(F.floor(n / 256 ** k).cast("long") % 256 for k in (3, 2, 1, 0))))
    return F.forall(o, lambda x: x < 256), out


def date(m: Column, key: str) -> tuple[Column, Column]:
    iso = F.when(m.contains("."), F.concat_ws("-", part(m, F.lit(7), F.lit(4)), part(m, F.lit(4), F.lit(2)), part(m, F.lit(1), F.lit(2)))).otherwise(F.replace(m, F.lit("/"), F.lit("-")))
    day = F.try_to_date(iso, "yyyy-MM-dd")
    n = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    x = F.pmod(n, F.lit(16384))
    fresh = F.date_add(F.lit("1900-01-01").cast("date"), (n - x + feistel_number(x, 128, key, "date")).cast("int"))
    text = named(fresh, lambda x: F.when(m.contains("-"), F.date_format(x, "yyyy-MM-dd")).when(m.contains("/"), F.date_format(x, "yyyy/MM/dd")).otherwise(F.date_format(x, "dd.MM.yyyy")))
    return F.coalesce(F.year(day).between(1000, 9899), F.lit(False)), text


def ssn(m: Column, key: str) -> tuple[Column, Column]:
    ok = ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    d = digits(m)
    return ok, refilled(m, F.concat(F.substring(d, 1, 1), feistel(part(d, F.lit(2)), key, "ssn")), "[0-9]")


def phone(m: Column, key: str) -> tuple[Column, Column]:
    """Of ten digits with or without a leading 1 the first of area and exchange stay, whatever they are, of others the first three."""
    d = digits(m)
    n = F.length(d)
    north = (n == 10) & ~m.startswith("+") | (n == 11) & d.startswith("1")
    at = n - 9  # place of the area's first digit
    core = F.when(north, F.concat(F.substring(d, at + 1, F.lit(2)), F.substring(d, at + 4, F.lit(6)))).otherwise(part(d, F.lit(4)))
    out = named(feistel(core, key, "phone"), lambda fresh: F.when(north, F.concat(
        F.substring(d, F.lit(1), at), F.substring(fresh, 1, 2), F.substring(d, at + 3, F.lit(1)), F.substring(fresh, 3, 6))).otherwise(F.concat(F.substring(d, 1, 3), fresh)))
    return n.between(8, 15), refilled(m, out, "[0-9]")


def email(m: Column, key: str) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    fresh = feistel(F.regexp_replace(local, "[^A-Za-z0-9]", ""), key, "email")
    return local.rlike("[A-Za-z0-9]"), F.concat(refilled(local, fresh, "[A-Za-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1))


def access_key(m: Column, key: str) -> tuple[Column, Column]:
    return F.lit(True), F.concat(F.substring(m, 1, 4), feistel(part(m, F.lit(5)), key, "key"))


def password(m: Column, key: str) -> tuple[Column, Column]:
    name = F.regexp_extract(m, "^[a-z_]+[=:] ?", 0)
    return F.lit(True), F.concat(name, feistel(part(m, F.length(name) + 1), key, "password"))


def in_run(m: Column, key: str) -> Column:
    """A run of groups with the cards and IBANs in it replaced (s), and their number (n). What is replaced is hidden from later readings."""
    def readings(patterns):
        return F.array_distinct(F.flatten(F.transform(F.array(*map(F.lit, patterns)), lambda p: F.regexp_extract_all(m, p, F.lit(1)))))

    def put(kind):
        def step(acc, r):
            ok, fresh = kind(r, key)
            bounded = F.concat(F.lit(f"(?<![A-Za-z0-9{HIDDEN}])"), r, F.lit(f"(?![A-Za-z0-9{HIDDEN}])"))
            return F.when(ok, F.struct(F.regexp_replace(acc["s"], bounded, F.translate(fresh, SHOWN, HIDDEN)).alias("s"),
                                       (acc["n"] + F.regexp_count(acc["s"], bounded)).alias("n"))).otherwise(acc)
        return step
    start = F.struct(m.alias("s"), F.lit(0).alias("n"))
    ibans = F.when(m.rlike("^[A-Z]"), F.aggregate(readings(IBAN_READINGS), start, put(iban))).otherwise(start)
    end = F.aggregate(readings(CARD_READINGS), ibans, put(card))
    return named(end, lambda e: F.struct(F.translate(e["s"], HIDDEN, SHOWN).alias("s"), e["n"].alias("n")))


def pseudonym(m: Column, key: str) -> Column:
    """One match with pseudonyms in place of its values (s) and their number (n, 0 where no value passes its check)."""
    def when_ok(found):
        return F.when(found[0], F.struct(found[1].alias("s"), F.lit(1).alias("n"))).otherwise(F.struct(m.alias("s"), F.lit(0).alias("n")))

    kinds = ((m.rlike(f"^(?:{PASSWORD})$"), password), (m.contains("@"), email), (m.rlike("^A[KS]IA[0-9A-Z]{16}$"), access_key),
             (m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), ip), (m.rlike(r"^(?:[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})$"), date),
             (m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ssn), (m.rlike(r"^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), phone))
    out = None
    for test, fn in kinds:
        fresh = when_ok(fn(m, key))
        out = F.when(test, fresh) if out is None else out.when(test, fresh)
    return out.otherwise(in_run(m, key))  # what begins with two capitals, or with a digit and is nothing else


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with `text_col` replaced and `_replaced` (values replaced) added; a narrow job without shuffle."""
    text = F.col(text_col)
    found = F.when(text.rlike("[0-9@]|(?:password|passwd|pwd|secret|token|api_key)[=:]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    some = docs.withColumn("_found", F.coalesce(found, F.when(text.isNotNull(), F.array().cast("array<string>"))))
    fresh = some.withColumn("_fresh", F.transform("_found", lambda m: pseudonym(m, key)))
    whole = F.array_join(F.zip_with(F.split(text, ANY, -1), F.concat(F.col("_fresh.s"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return fresh.withColumn(text_col, F.when(F.size("_found") > 0, whole).otherwise(text)).withColumn(
        "_replaced", F.when(text.isNotNull(), F.aggregate("_fresh", F.lit(0), lambda acc, f: acc + f["n"])).cast("long")).drop("_found", "_fresh")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_replaced of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_pseudonyms(own, key).withColumnRenamed("_replaced", "n_replaced")
