r"""Format-preserving pseudonyms for personal data; DataFrame functions only.

Matches are found by one alternation, validated by kind and permuted within their format by keyed Feistel networks, so
equal values of a kind get equal pseudonyms in every document, distinct ones distinct pseudonyms, and nothing is stored:
* letters and digits (e-mail names and domains in lower case, the digits of phone numbers after the country code, and of
  social-security numbers): the characters are halved; each round shifts those of one half, within their own alphabet, by
  a keyed hash of the other half. Digits then take the places of those of the match, so the ways to write a number, and
  capitals in an address, do not part equal values;
* card numbers, 13-19 digits that pass Luhn: the same for all digits but the last, which is the Luhn digit again; those
  that fail it: the same for all digits, again and again until the outcome fails it too;
* IPv4 addresses: the 32 bits, in halves of 16; * dates from 1900 to 2099, as year-month-day: the day's number among
  73,049 = 17 x 4,297, with rounds of modular addition on both parts, so the pseudonym is a date in that range again.
A match that fails its validation (an octet over 255 or with a leading zero, a month 13) stays. Country codes, top-level
domains and all signs between are kept. Round hashes are HMAC-SHA-256 under the key. There is no shuffle.

Cases: null text stays null, empty text empty. A null id is kept. Repeated rows give repeated rows, equal ones. Extra
columns are kept; a column named as the count is replaced. Very long texts take one pass of the pattern, in which nothing
recurses deeper than a domain has labels (127 at most; of a longer one the beginning counts). Where patterns tie at a
place, the order of PATTERNS decides.
"""

from __future__ import annotations

import hashlib
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secret_scan import bound

ROUNDS = 8
DAYS, LEFT, RIGHT = 73_049, 17, 4_297
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "phone": r"\+\d{1,3}[ -]?\(?\d{2,4}\)?[ -]?\d{3}[ -]?\d{4}(?!\d)|(?<![\d-])\(?\d{3}\)?[ -]\d{3}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
}
KIND_OF = {"email": r"@", "ip": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "date": r"^\d{4}-\d{2}-\d{2}$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "card": r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}$|^\d{13,19}$", "phone": r""}
FIND = "|".join(f"(?:{p})" for p in PATTERNS.values())
ANY = r"[0-9@]"


#: Outcomes of a number that may pass Luhn in turn (one in ten does); after so many it is an error.
WALK = 40


def pads(key: str) -> tuple[bytes, bytes]:
    """The key as HMAC-SHA-256 mixes it in: for the inner and the outer hash."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k), bytes(b ^ 0x5C for b in k)


def digest(key: str, kind: str, i: Column, half: Column) -> Column:
    """HMAC-SHA-256 of the kind, the round and a half, in hexadecimal digits."""
    inner, outer = pads(key)
    said = F.concat_ws("|", F.lit(kind), i.cast("string"), half.cast("string"))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(said, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer), first), 256)


def number(hexed: Column, start, size: int) -> Column:
    return F.conv(F.substring(hexed, start, size), 16, 10).cast("long")


def feistel(left: Column, right: Column, turn: Callable[[Column, Column, Column], Column]) -> Column:
    """The halves after ROUNDS rounds of (l, r) -> (r, turn(l, r, i)), as struct(l, r)."""
    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, F.struct(left.alias("l"), right.alias("r")), lambda acc, i: F.struct(acc["r"].alias("l"), turn(acc["l"], acc["r"], i).alias("r")))


def permute_text(x: Column, key: str, kind: str) -> Column:
    """x with its letters and digits permuted within their alphabets; other characters stay."""

    def turn(part, other, i):
        def shifted(h):
            def shift(c, k):
                by = number(h, (F.pmod(k, F.lit(32)) * 2 + 1).cast("int"), 2)
                a = F.ascii(c)
                moved = lambda low, size: F.chr((F.pmod(a - low + by, F.lit(size)) + low).cast("long"))
                return F.when(c.rlike("[0-9]"), moved(48, 10)).when(c.rlike("[a-z]"), moved(97, 26)).when(c.rlike("[A-Z]"), moved(65, 26)).otherwise(c)

            return F.array_join(F.transform(F.split(part, ""), shift), "")

        return bound(digest(key, kind, i, F.concat_ws("|", F.length(part), other)), shifted)  # one hash a round

    n = F.floor(F.length(x) / 2).cast("int")
    out = feistel(F.substring(x, F.lit(1), n), F.substring(x, n + 1, F.length(x)), turn)
    return F.concat(out["l"], out["r"])


def luhn_digit(digits: Column) -> Column:
    """The digit that completes a string of digits."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1)))
    total = F.aggregate(d, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(-total, F.lit(10)).cast("string")


def spread(plain: Column, like: Column) -> Column:
    """Digits of `plain` in the places of the digits of `like`, which has a few dozen characters at most."""
    digits = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(like, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(plain, digits(i) + 1, F.lit(1))).otherwise(c)), "")


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    return luhn_digit(F.left(digits, F.length(digits) - 1)) == F.right(digits, F.lit(1))


def card(x: Column, key: str) -> Column:
    def made(digits):
        sound = permute_text(F.left(digits, F.length(digits) - 1), key, "card")
        again = lambda y, _: F.when(passes_luhn(y), permute_text(y, key, "number")).otherwise(y)
        other = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), permute_text(digits, key, "number"), again)
        walked = bound(other, lambda y: F.when(passes_luhn(y), F.raise_error(F.lit("no number that fails Luhn was met")).cast("string")).otherwise(y))
        return F.when(passes_luhn(digits), bound(sound, lambda y: F.concat(y, luhn_digit(y)))).otherwise(walked)

    return spread(bound(digits_of(x), made), x)


def ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    half = lambda i: (F.get(parts, F.lit(i)) * 256 + F.get(parts, F.lit(i + 1))).cast("long")
    out = feistel(half(0), half(2), lambda a, b, i: F.pmod(a + number(digest(key, "ip", i, b), 1, 8), F.lit(65536)))
    octets = [F.floor(out["l"] / 256), F.pmod(out["l"], F.lit(256)), F.floor(out["r"] / 256), F.pmod(out["r"], F.lit(256))]
    return F.when(F.exists(parts, lambda p: p > 255) | x.rlike(r"(^|\.)0\d"), x).otherwise(F.concat_ws(".", *[o.cast("string") for o in octets]))


def date(x: Column, key: str) -> Column:
    first = F.lit("1900-01-01").cast("date")
    day = F.datediff(F.try_to_date(x, "yyyy-MM-dd"), first).cast("long")

    def both(acc, i):
        r = F.pmod(acc["r"] + number(digest(key, "day", i, acc["l"]), 1, 8), F.lit(RIGHT))
        return F.struct(F.pmod(acc["l"] + number(digest(key, "day+", i, r), 1, 8), F.lit(LEFT)).alias("l"), r.alias("r"))

    start = F.struct(F.floor(day / RIGHT).alias("l"), F.pmod(day, F.lit(RIGHT)).alias("r"))
    out = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, both)
    moved = F.date_format(F.date_add(first, (out["l"] * RIGHT + out["r"]).cast("int")), "yyyy-MM-dd")
    return F.when(day.between(0, DAYS - 1), moved).otherwise(x)


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one match of FIND."""
    tail = F.regexp_extract(x, r"(\.[A-Za-z]+)$", 1)
    low = F.lower(x)
    name, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    email = F.concat(permute_text(name, key, "name"), F.lit("@"), permute_text(F.substring(domain, F.lit(1), F.length(domain) - F.length(tail)), key, "domain"), F.lower(tail))
    code = F.regexp_extract(x, r"^(\+\d{1,3}(?=[ (-]))", 1)
    rest = F.substring(x, F.length(code) + 1, F.length(x))
    phone = F.concat(code, spread(permute_text(digits_of(rest), key, "phone"), rest))
    made = {"email": email, "ip": ip(x, key), "date": date(x, key), "ssn": spread(permute_text(digits_of(x), key, "ssn"), x), "card": card(x, key)}
    out = F
    for kind, c in made.items():
        out = out.when(x.rlike(KIND_OF[kind]), c)
    return out.otherwise(phone)


def pseudonymize(docs: DataFrame, key: str, text: str = "text", count: str = "n_private") -> DataFrame:
    """docs with personal data in `text` replaced, and `count`, the number of values that changed."""
    t = F.col(text)
    found, made = (f"_{uuid.uuid4().hex}" for _ in range(2))  # names that no column has
    docs = docs.withColumn(found, F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(FIND), F.lit(0))).otherwise(F.array().cast("array<string>")))
    docs = docs.withColumn(made, F.transform(found, lambda x: pseudonym(x, key)))
    joined = F.array_join(F.flatten(F.zip_with(F.split(t, FIND, -1), made, lambda gap, m: F.array(gap, F.coalesce(m, F.lit(""))))), "")
    docs = docs.withColumn(text, F.when(F.size(found) > 0, joined).otherwise(t))
    changed = F.size(F.filter(F.zip_with(found, made, lambda a, b: a != b), lambda x: x))
    return docs.withColumn(count, F.greatest(changed, F.lit(0)).cast("long")).drop(found, made)


KEY_SETTING = "spark.quillspark.pseudonyms.key"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the key that the session's KEY_SETTING names; where there is none, as in tests, with one that is no secret, and
    a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: whoever has this code can undo the pseudonyms", stacklevel=2)
        key = "no secret"
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
