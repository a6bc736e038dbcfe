"""Operator 10: personal data replaced by format-preserving Feistel pseudonyms. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, table

#: The key of the permutations where none is given: it hides nothing. Set spark.tapeline.pii.key to a secret one.
KEY = "set a key of your own"
ROUNDS = 8

# Patterns by kind, tried from the first on at each place. No kind begins or ends inside a longer run of letters or digits.
_EDGE, _END = r"(?<![\p{L}\p{N}_.+-])", r"(?![\p{L}\p{N}_])"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
    "ip": _EDGE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[\p{L}\p{N}_])",
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + _END,
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[\p{L}\p{N}_])",
    "card": _EDGE + r"[0-9](?:[ -]?[0-9]){12,18}(?!-?[\p{L}\p{N}_])",
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?!-?[\p{L}\p{N}_])|(?<![\p{L}\p{N}_+])\+[0-9]{8,14}(?![\p{L}\p{N}_])",
}
# IBANs by the length of their country; a following word isn't taken in.
LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_EXACT = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![\p{L}\p{N}])" for n, c in LENGTHS.items()) + ")"
# A whole run of digit groups that can hold a card; it ends before a dotted number, a date with slashes or an e-mail name.
_RUN = _EDGE + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9][0-9 -]*[0-9](?!-?[\p{L}\p{N}_]|[./][0-9]{1,3}[./][0-9]|[\p{L}\p{N}._%+-]{0,64}@)"
ANY = "|".join(f"(?:{p})" for p in (PATTERNS | {"iban": rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}[0-9]{{2}}){_EXACT}|" + PATTERNS["iban"], "card": _RUN}).values())
# What is looked for inside a find that isn't valid as a whole, the surest first. Four groups of four are no phone.
INSIDE = [
    _EXACT, "[0-9]{32,128}", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}(?:\2[0-9]{3})?", r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}", "[0-9]{13,19}",
    r"(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}", "[0-9]{2,4}[ -][0-9]{3}[ -][0-9]{4}", "(?![0-9]{4}[ -][0-9]{4}[ -][0-9]{4})[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{3,4}",
]


def _let(value: Column, use) -> Column:
    """use(value), where value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rounds(key: str, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of pairs (l, r) in [0, a) x [0, b): each round adds to one half a number that comes from the other,
    60 bits of SHA-256 over key, kind, round, size and half. The rounds are one fold over an array."""
    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])

    def step(s: Column, i: Column) -> Column:
        add = lambda value, size: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), size.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("decimal(20,0)"), size.cast("decimal(20,0)")).cast("long")
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + add(s["r"], s["a"]), s["a"])).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + add(s["l"], s["b"]), s["b"])).alias("r"),
            s["a"].alias("a"),
            s["b"].alias("b"),
        )

    return F.aggregate(turns, F.struct(*[v.cast("long").alias(k) for k, v in (("l", left), ("r", right), ("a", a), ("b", b))]), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits(key: str, kind: str, value: Column) -> Column:
    """A string of 2 to 36 digits permuted among those of its length; its first half and the rest are the Feistel halves."""

    def halves(p: Column) -> Column:
        v, h, rest = p["v"], p["h"], p["rest"]
        done = _rounds(key, kind, F.substring(v, F.lit(1), h).cast("long"), F.substring(v, h + 1, rest).cast("long"), _power(h), _power(rest))
        return _let(done, lambda s: F.concat(F.lpad(s["l"].cast("string"), h, "0"), F.lpad(s["r"].cast("string"), rest, "0")))

    half = lambda v: F.floor(F.length(v) / 2).cast("int")
    return _let(value, lambda v: _let(F.struct(v.alias("v"), half(v).alias("h"), (F.length(v) - half(v)).alias("rest")), halves))


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """The sum of a digit string by Luhn's rule, its last digit being the check digit."""
    return F.aggregate(F.split(F.reverse(x), ""), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("at")), lambda s, d: F.struct(
        (s["sum"] + F.when(s["at"] % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))).alias("sum"), (s["at"] + 1).alias("at")))["sum"]


def _into(shape: Column, values: Column, places: str = "^[0-9]$") -> Column:
    """The digits of `shape`, or what else `places` matches, replaced by the signs of `values` in order; all other signs stay."""
    filled = F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), values.alias("values")), lambda s, c: F.struct(
        F.concat(s["out"], F.when(c.rlike(places), F.substring(s["values"], s["at"], F.lit(1))).otherwise(c)).alias("out"),
        (s["at"] + F.when(c.rlike(places), 1).otherwise(0)).alias("at"), s["values"].alias("values")))
    return filled["out"]


def _mod97(x: Column) -> Column:
    """An IBAN's remainder: its first four signs moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
    return F.aggregate(F.split(moved, ""), F.lit(0).cast("long"), lambda s, c: F.when(c.rlike("^[0-9]$"), F.pmod(s * 10 + c.cast("long"), F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))))


def _email(key: str, x: Column) -> Column:
    """A keyed name before the @, the same for the same address; the host stays."""
    name = F.substring(F.sha2(F.concat(F.lit(key), F.lit("|email|"), F.lower(x)), 256), 1, 12)
    return F.concat(F.lit("user_"), name, F.lit("@"), F.substring_index(x, "@", -1))


def _secret(key: str, x: Column) -> Column:
    hexed = F.substring(F.repeat(F.sha2(F.concat(F.lit(key), F.lit("|secret|"), F.lower(x)), 256), 2), F.lit(1), F.length(x))
    return _let(hexed, lambda h: F.when(F.upper(x) == x, F.upper(h)).otherwise(h))


def _ip(key: str, x: Column) -> Column:
    def whole(parts: Column) -> Column:
        pair = lambda i: F.element_at(parts, i).cast("long") * 256 + F.element_at(parts, i + 1).cast("long")
        name = lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string"))
        new = _let(_rounds(key, "ip", pair(1), pair(3), F.lit(65536), F.lit(65536)), lambda s: F.concat_ws(".", name(s["l"]), name(s["r"])))
        return F.when(F.forall(parts, lambda p: p.cast("int") <= 255), new).otherwise(x)

    return _let(F.split(x, "\\."), whole)


def _date(key: str, x: Column) -> Column:
    """Slashes hold month and day, or, where that is no date, day and month; the form stays."""
    start = F.lit("1800-01-01").cast("date")
    form = F.when(x.contains("-"), "yyyy-MM-dd").when(x.contains("."), "dd.MM.yyyy").when(F.substring(x, 1, 2) > "12", "dd/MM/yyyy").otherwise("MM/dd/yyyy")

    def moved(nth: Column, form: Column) -> Column:
        # 146097 days, whole years in 400: 189 times 773.
        new = _let(_rounds(key, "date", F.floor(nth / 773), nth % 773, F.lit(189), F.lit(773)), lambda s: F.date_add(start, (s["l"] * 773 + s["r"]).cast("int")))
        shown = _let(new, lambda d: F.when(form == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(form == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).when(form == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
        return F.when(nth.between(0, 146096), shown).otherwise(x)

    return _let(form, lambda form: _let(F.datediff(F.try_to_timestamp(x, form).cast("date"), start), lambda nth: moved(nth, form)))


def _ssn(key: str, x: Column) -> Column:
    """Areas are 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""

    def moved(p: Column) -> Column:
        area, group, serial = p[0].cast("long"), p[1].cast("long"), p[2].cast("long")
        done = _rounds(key, "ssn", (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999))
        place = lambda s: F.floor(s["l"] / 99) + 1
        new = _let(done, lambda s: F.concat_ws("-", F.lpad((place(s) + F.when(place(s) >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0")))
        return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), new).otherwise(x)

    return _let(F.split(x, "-"), moved)


def _iban(key: str, x: Column) -> Column:
    """The country, letters and spaces stay; other digits are permuted, and the check digits are right."""

    def moved(flat: Column) -> Column:
        account = _let(F.substring(flat, F.lit(5), F.length(flat)), lambda a: _into(a, digits(key, "iban", _only_digits(a))))
        check = lambda a: F.lpad((98 - _mod97(F.concat(F.substring(flat, 1, 2), F.lit("00"), a))).cast("string"), 2, "0")
        new = _let(account, lambda a: F.concat(F.substring(flat, 1, 2), check(a), a))
        return F.when((_mod97(flat) == 1) & (F.length(_only_digits(F.substring(flat, F.lit(5), F.length(flat)))) >= 2), _into(x, new, "^[^ ]$")).otherwise(x)

    return _let(F.replace(x, F.lit(" "), F.lit("")), moved)


def _card(key: str, x: Column) -> Column:
    def moved(d: Column) -> Column:
        body = digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        new = _let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn(d) % 10 == 0, _into(x, new)).otherwise(x)

    return _let(_only_digits(x), moved)


#: Country calling codes: fixed values of the numbering plan; all others have three digits.
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _phone(key: str, x: Column) -> Column:
    """The country's calling code stays, whether a separator follows it or not."""
    code = F.when(x.rlike(r"^\+[0-9]{1,3}[ .(-]"), F.length(_only_digits(F.regexp_extract(x, r"^(\+[0-9]{1,3})", 1)))).when(x.startswith("+"), F.length(F.regexp_extract(x, CALLING, 1))).otherwise(0)
    both = F.struct(_only_digits(x).alias("d"), code.alias("code"))
    return _let(both, lambda p: _into(x, F.concat(F.substring(p["d"], F.lit(1), p["code"]), digits(key, "phone", F.substring(p["d"], p["code"] + 1, F.length(p["d"]))))))


def pseudonym(x: Column, key: str = KEY) -> Column:
    """What stands for one found string: its pseudonym, or itself if it isn't valid as any kind.

    email: the part before @ becomes a keyed name. secret: hex digits become keyed hex digits. ip, phone: digits permuted,
    a phone's country code kept and each ip number within 0 to 255. card: permuted, Luhn's check digit kept right. date:
    permuted among the 146097 days of 1800 to 2199, in its own form. ssn: permuted among valid numbers. iban: country and
    spaces kept, check digits right.
    """
    full = lambda kind: x.rlike("^(?:" + PATTERNS[kind] + ")$")
    return (
        F.when(full("email"), _email(key, x))
        .when(full("secret") & x.rlike("[0-9]"), _secret(key, x))
        .when(full("ip"), _ip(key, x))
        .when(full("date"), _date(key, x))
        .when(full("iban"), _iban(key, x))
        .when(full("ssn"), _ssn(key, x))
        .when(full("card") & (_luhn(_only_digits(x)) % 10 == 0), _card(key, x))
        .when(full("phone"), _phone(key, x))
        .otherwise(x)
    )


def _inside(x: Column) -> Column:
    """What may be valid inside a find, the surest first; candidates may overlap."""
    found = [F.regexp_extract_all(x, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?=({p})(?![\p{{L}}\p{{N}}]))"), F.lit(1)) for p in INSIDE]
    return F.array_distinct(F.concat(*found))


def _look_inside(x: Column, inner: Column, pairs: Column) -> Column:
    """A find that isn't valid as a whole: its text with the valid parts replaced, and how many.

    Valid parts are marked in the order of `inner`, a mark being no part of later ones, and marks are filled last.
    """
    mark = lambda i: F.concat(F.lit("<"), F.translate(i.cast("string"), "0123456789", "abcdefghij"), F.lit(">"))
    valid = F.transform(F.filter(inner, lambda c: pairs[c].isNotNull()), lambda c, i: F.struct(c.alias("old"), pairs[c].alias("new"), mark(i).alias("mark")))
    whole = lambda p: F.concat(F.lit("(?<![A-Z0-9])"), p["old"], F.lit("(?![A-Z0-9])"))
    start = F.struct(x.alias("text"), F.lit(0).alias("n"), valid.alias("valid"))
    marked = lambda s, p: F.struct(F.regexp_replace(s["text"], whole(p), p["mark"]).alias("text"), (s["n"] + F.regexp_count(s["text"], whole(p))).alias("n"), s["valid"].alias("valid"))
    filled = lambda s: F.struct(F.aggregate(s["valid"], s["text"], lambda t, p: F.replace(t, p["mark"], p["new"])).alias("text"), s["n"].alias("n"))
    return F.aggregate(valid, start, marked, filled)


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """docs with `column`'s personal data replaced, and n_replaced: how many strings were.

    key: the permutations' key; without it that of the session's setting spark.tapeline.pii.key, or else KEY, which all know.
    The text is cut at what the patterns find, each find is replaced by its pseudonym, or, where it isn't valid as a whole, the
    valid parts within it by theirs, and both are put together again, so equal values stay equal across documents, and no
    replacement is looked at twice. No rows move. Null stays null with n_replaced 0; empty texts stay; repeated rows get equal
    results; rows and other columns are kept as they are, except one called n_replaced, and those called _found, _pairs,
    _new, which are left out. An empty table gives no rows.
    """
    key = key or docs.sparkSession.conf.get("spark.tapeline.pii.key", KEY)
    text = F.col(column)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    pieces = F.split(text, ANY, -1)
    # Most texts hold no digit run and no @ at all and are passed by.
    hot = text.rlike("[0-9][0-9 ()./-]{5}|@|[0-9a-fA-F]{32}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
    # Each find with what may be valid inside it, then the pseudonyms of all of them.
    parts = F.transform(found, lambda x: F.struct(x.alias("x"), F.when(x.rlike("^[A-Z0-9 -]{13,}$"), _inside(x)).alias("inner")))
    df = docs.withColumns({"_found": F.when(hot, parts)})
    each = F.array_distinct(F.flatten(F.transform("_found", lambda f: F.concat(F.array(f["x"]), F.coalesce(f["inner"], F.expr("cast(array() as array<string>)"))))))
    changed = F.filter(F.transform(each, lambda x: F.struct(x.alias("old"), pseudonym(x, key).alias("new"))), lambda p: p["old"] != p["new"])
    df = df.withColumns({"_pairs": F.when(F.size("_found") > 0, F.map_from_entries(changed))})
    one = lambda x, n: F.struct(x.alias("text"), F.lit(n).alias("n"))
    pairs = F.col("_pairs")
    df = df.withColumns({"_new": F.transform("_found", lambda f: F.when(pairs[f["x"]].isNotNull(), one(pairs[f["x"]], 1)).when(F.size(f["inner"]) > 0, _look_inside(f["x"], f["inner"], pairs)).otherwise(one(f["x"], 0)))})
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("_new")), F.col("_new"), lambda piece, new: F.concat(piece, new["text"])), ""), F.element_at(pieces, -1))
    count = F.aggregate("_new", F.lit(0), lambda total, new: total + new["n"])
    return df.withColumns({"n_replaced": F.when(F.size("_new") > 0, count).otherwise(0).cast("int"), column: F.when(F.size("_new") > 0, joined).otherwise(text)}).drop("_found", "_pairs", "_new")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
