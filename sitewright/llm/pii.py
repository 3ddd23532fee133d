"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Entities are found by patterns: e-mail addresses, telephone numbers with and without a country's code, card,
social-security and bank account numbers, IPv4 and IPv6 addresses, keys with the prefixes of their issuers, long
hexadecimal secrets, and names after a form of address (a name without one is not found). Card numbers must pass
their check digit and account numbers theirs, or they are left alone. An entity is its kind and canonical form
(digits alone, lower case), so the same number in two notations, and the same family name in two documents, are
one.

Each entity gets one surrogate from a keyed SHA-256, valid for its type: cards keep the issuer's first digit and
accounts the country, and both get new check digits; telephone numbers keep the country's code; social-security
numbers and octets stay in range; hexadecimal digits keep their case, addresses lie in reserved domains, keys keep
their prefix, and names are of the same script and of the gender that the form of address shows (that form itself
stays). Names get longer with each attempt, so they never run out.

Surrogates of distinct entities must differ, and none may be an entity of the data: those that clash are made
anew with the next attempt until none does, over all entities at once. A text is cut by the same pattern that
found the mentions and joined again around the surrogates, so the rest of it is untouched.

Null text counts as empty. Documents without entities give no rows in `surrogates` and pass through `rewrite`
unchanged, null text as null. Rows with equal ids are rewritten each. Of an empty table the result is empty. Other
columns are kept by `rewrite` unless their names start with ``_pii_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filled, joined_hot, save

# Patterns of the kinds, in the order in which they are tried. Repeats are bounded or never taken
# back, and words are entered at their start alone, so a text of one endless word costs no more than another. An
# address begins at the first of words joined by single dots, or where a mention before it ends.
TITLES = {
    "m": "Mr|Sir|Herr|Monsieur|Señor|Sr|Signor|г-н|господин",
    "f": "Mrs|Ms|Miss|Lady|Frau|Madame|Mme|Señora|Sra|Signora|г-жа|госпожа",
    "n": "Dr|Prof|доктор|профессор",
}
CAPITAL = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
BEFORE, AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
HEXES = "[0-9a-fA-F]{1,4}"
KINDS = {
    "email": r"(?:(?<![\p{L}\p{N}_%+-])(?<![\p{L}\p{N}_%+-]\.)|\G|(?<=\G\.))[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[\p{L}\p{N}-]++(?:\.(?!\p{L}{2})[\p{L}\p{N}-]++)*+\.(?=\p{L}{2}))++\p{L}{2,}+",
    "key": r"(?<![\p{L}\p{N}_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|AIza[A-Za-z0-9_-]{35})(?![\p{L}\p{N}_-])",
    "iban": BEFORE + r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?" + AFTER,
    "phone": r"(?<![\p{L}\p{N}+])\+[1-9](?:[ .-]?\(?\d\)?){7,14}" + AFTER,
    "card": r"(?<![\p{L}\p{N}.])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})" + AFTER,
    "local": r"(?<![\p{L}\p{N}.+-])(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}-])",
    "ssn": r"(?<![\p{L}\p{N}-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\p{N}-])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{HEXES}:){{7}}{HEXES}|(?=[0-9a-fA-F:]{{0,45}}\d)(?=(?:[0-9a-fA-F]{{0,4}}:){{3}})(?:{HEXES}:){{1,6}}(?::{HEXES}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{OCTET}\.){{3}}{OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "secret": BEFORE + r"(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,64}" + AFTER,
    "name": rf"{BEFORE}(?:{'|'.join(TITLES.values())})\.?[ ]{CAPITAL}(?:[ ]{CAPITAL}){{0,2}}",
}


def _either(*kinds: str) -> str:
    return "(?:" + "|".join(f"(?:{KINDS[k]})" for k in kinds) + ")"


#: All kinds, in their order; those that begin alike are tried only where a word begins so.
ANY = rf"{_either('email')}|{BEFORE}(?:(?=[A-Zgxs]){_either('key', 'iban')}|(?=[+\d(]){_either('phone', 'card', 'local', 'ssn')}|(?=[0-9a-fA-F]){_either('ipv6', 'ip', 'secret')}|(?=[\p{{Lu}}гдп]){_either('name')})"
# Cheaper tests, one of which passes every text with an entity: a pattern, and what it may contain instead.
HINT = r"\d(?:\d{2,3}[ -]?\d|\.\d{1,3}\.\d)|\+\d|:[0-9a-fA-F]{0,4}:|[0-9a-fA-F]{32}|[A-Z]{2}\d{2}"
HOLDS = (
    *("@", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk-", "AIza"),
    *("Mr", "Ms", "Miss", "Sir", "Lady", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Signor", "Dr", "Prof", "г-", "господин", "госпожа", "доктор", "профессор"),
)
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga go ha ka ke ki la le li lo ma me mi mo na ne no ra re ri ro ta".split(), "cyrillic": "ба бе би бо ва ве ви га го да де ди жа за ка ке ла ле ли ло ма ме ми на не но ра ре ри ро са та".split()}
ENDINGS = {
    ("latin", "given", "m"): "n", ("latin", "given", "f"): "a", ("latin", "given", "n"): "i", ("latin", "family", "m"): "r",
    ("cyrillic", "given", "m"): "н", ("cyrillic", "given", "f"): "я", ("cyrillic", "given", "n"): "ли", ("cyrillic", "family", "m"): "ков", ("cyrillic", "family", "f"): "кова",
}
#: Codes of countries that have one or two digits; all others have three.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Kinds whose surrogates are laid into the notation of a mention, digit by digit and letter by letter.
LAID = ("phone", "local", "card", "ssn", "iban")


def _digit_at(text: Column, i: Column) -> Column:
    return text.substr(i, F.lit(1)).cast("int")


def _luhn(digits: Column, last: int) -> Column:
    """The sum of a number's digits of which every second is doubled, the last one or not."""
    n = F.char_length(digits)
    twice = lambda i: (n - i) % 2 == last
    value = lambda i: F.when(twice(i), _digit_at(digits, i) * 2 - F.when(_digit_at(digits, i) > 4, 9).otherwise(0)).otherwise(_digit_at(digits, i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))


def _mod97(text: Column) -> Column:
    """An account number, its first four characters moved to the end, as a number modulo 97."""
    chars = F.sequence(F.lit(1), F.char_length(text))
    at = lambda i: text.substr(i, F.lit(1))
    step = lambda acc, i: F.when(at(i).rlike(r"\d"), (acc * 10 + at(i).cast("int")) % 97).otherwise((acc * 100 + F.ascii(at(i)) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def valid(mention: Column) -> Column:
    """Whether the check digits of a card or account number are right; true of other kinds."""
    bare = F.regexp_replace(mention, "[ -]", "")
    account = F.concat(bare.substr(F.lit(5), F.char_length(bare)), bare.substr(1, 4))
    return F.when(mention.rlike(f"^(?:{KINDS['iban']})$"), _mod97(account) == 1).when(mention.rlike(f"^(?:{KINDS['card']})$"), _luhn(bare, 1) % 10 == 0).otherwise(True)


def kind_of(mention: Column) -> Column:
    out = F.lit("name")
    for k in reversed([k for k in KINDS if k != "name"]):
        out = F.when(mention.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(out)
    return out


def _name_kind(word: Column, last: Column, gender: Column) -> Column:
    """Script, part and gender of a name. A Latin family name is the same for any gender; a Cyrillic one shows it
    where the form of address does not."""
    cyrillic = word.rlike(r"^\p{IsCyrillic}")
    shown = F.when(gender != "n", gender).when(word.rlike("(?:ва|на|ая)$"), "f").otherwise("m")
    family = F.when(cyrillic, F.concat(F.lit("cyrillic:family:"), shown)).otherwise("latin:family:m")
    return F.when(last, family).otherwise(F.concat_ws(":", F.when(cyrillic, "cyrillic").otherwise("latin"), F.lit("given"), gender))


def parts_of(mention: Column) -> Column:
    """The entities in a mention: kind and raw form; one, but for names, where each word after the title is, and
    none where check digits are wrong."""
    kind = kind_of(mention)
    words = F.split(mention, " ")
    is_ = lambda g: words[0].rlike(rf"^(?:{TITLES[g]})\.?$")
    gender = F.when(is_("f"), "f").when(is_("n"), "n").otherwise("m")
    names = F.transform(F.slice(words, F.lit(2), F.size(words) - 1), lambda w, i: F.struct(_name_kind(w, i == F.size(words) - 2, gender).alias("kind"), w.alias("raw")))
    one = F.array(F.struct(kind.alias("kind"), mention.alias("raw")))
    return F.when(kind == "name", names).when(valid(mention), one).otherwise(F.slice(one, F.lit(1), F.lit(0)))


def canonical(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin("phone", "local", "card", "ssn"), F.regexp_replace(raw, r"\D", "")).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind == "key", raw).otherwise(F.lower(raw))


def _number(digest: Column, i: Column | int, of: int) -> Column:
    """A number below ``of`` from the i-th place of a hex digest."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.pmod(F.conv(digest.substr(i % 56 + 1, F.lit(8)), 16, 10).cast("long") + i * 7919, F.lit(of))


def _like(text: Column, digest: Column, at: int, hexes: bool = False) -> Column:
    """A text with other digits for digits and letters for letters, case kept; or hexadecimal digits, never 0."""

    def other(i: Column) -> Column:
        c = text.substr(i + 1, F.lit(1))
        if hexes:
            return F.when(c == ":", c).otherwise(F.lower(F.hex(_number(digest, i + at, 15) + 1)))
        letter = _number(digest, i + at, 26)
        return F.when(c.rlike(r"\d"), _number(digest, i + at, 10).cast("string")).when(c.rlike("[A-Z]"), F.char(letter + 65)).when(c.rlike(r"\p{L}"), F.char(letter + 97)).otherwise(c)

    return F.when(F.char_length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.char_length(text) - 1), other), "")).otherwise("")


def _syllable(of: list[str], digest: Column):
    return lambda i: F.get(F.array(*map(F.lit, of)), _number(digest, i * 8, len(of)).cast("int"))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    n = F.char_length(canon)
    digits = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _number(h, i, 10).cast("string")), "")
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.hex(_number(h, i, 16)))), "")
    tld = F.substring_index(canon, ".", -1)
    mail = F.concat(_like(F.substring_index(canon, "@", 1), h, 0), F.lit("@"), _like(F.lit("aaaaaa"), h, 29), F.lit(".example."), F.when(tld.isin("com", "net", "org"), tld).otherwise("com"))
    code = F.when(canon.rlike(COUNTRY), F.char_length(F.regexp_extract(canon, COUNTRY, 0))).otherwise(3)
    phone = F.concat(canon.substr(F.lit(1), code), _number(h, 57, 8) + 2, digits.substr(code + 2, n))
    local = F.concat(_number(h, 57, 8) + 2, digits.substr(F.lit(2), n))
    bare = F.concat(canon.substr(1, 1), digits.substr(F.lit(2), n - 2))
    card = F.concat(bare, F.pmod(-_luhn(bare, 0), F.lit(10)))
    area = _number(h, 0, 898) + 1
    ssn = F.concat_ws("", F.lpad((area + F.when(area >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((_number(h, 8, 99) + 1).cast("string"), 2, "0"), F.lpad((_number(h, 16, 9999) + 1).cast("string"), 4, "0"))
    own = _like(canon.substr(F.lit(5), n), h, 0)
    iban = F.concat(canon.substr(1, 2), F.lpad((98 - _mod97(F.concat(own, canon.substr(1, 2), F.lit("00")))).cast("string"), 2, "0"), own)
    fixed = F.regexp_extract(canon, "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-|AIza)", 0)
    token = F.concat(fixed, _like(canon.substr(F.char_length(fixed) + 1, n), h, 0))
    ip = F.concat_ws(".", *[(_number(h, 8 * i, 254) + 1).cast("string") for i in range(4)])
    out = F.when(kind == "email", mail).when(kind == "phone", phone).when(kind == "local", local).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", iban)
    out = out.when(kind == "key", token).when(kind == "secret", hexes).when(kind == "ip", ip).when(kind == "ipv6", _like(canon, h, 0, hexes=True))
    for (script, part, gender), end in ENDINGS.items():
        syllables = F.transform(F.sequence(F.lit(0), attempt + 2), _syllable(SYLLABLES[script], h))
        out = out.when(kind == f"{script}:{part}:{gender}", F.concat(F.array_join(syllables, ""), F.lit(end)))
    return out


def written(kind: Column, raw: Column, value: Column) -> Column:
    """A surrogate in the notation of a mention."""
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    seen = lambda i: F.char_length(F.regexp_replace(raw.substr(F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
    laid = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), value.substr(seen(i), F.lit(1))).otherwise(c)), "")
    cased = F.when(raw.rlike(r"\p{Lu}") & ~raw.rlike(r"\p{Ll}"), F.upper(value)).when(kind.contains(":"), F.initcap(value)).otherwise(value)
    return F.when(kind.isin(*LAID), laid).when(kind == "key", value).otherwise(cased)


def entities(parts: DataFrame, key: str) -> DataFrame:
    """kind, canon, value and mentions (how many) for each distinct entity, after the collision checks."""
    todo = save(parts.groupBy("kind", "canon").agg(F.count("*").alias("mentions")).withColumn("attempt", F.lit(0)), "pii-entities")
    real, done = todo.select("kind", F.col("canon").alias("value")), None
    while True:
        made = todo.withColumn("value", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        made = made.withColumn("old", F.lit(False))
        every = made if done is None else made.unionByName(done.withColumn("old", F.lit(True)))
        # of equal surrogates the one made first stays; one that is itself in the data never does
        first = F.row_number().over(W.partitionBy("kind", "value").orderBy(F.desc("old"), "canon"))
        taken = real.withColumn("real", F.lit(True))
        every = save(every.withColumn("n", first).join(taken, ["kind", "value"], "left").withColumn("good", (F.col("n") == 1) & F.col("real").isNull()), "pii-tries")
        done = every.where("good").select("kind", "canon", "mentions", "attempt", "value")
        todo = every.where("NOT good").select("kind", "canon", "mentions", (F.col("attempt") + 1).alias("attempt"))
        if not todo.limit(1).count():
            return done.select("kind", "canon", "value", "mentions")


def hinted(text: Column) -> Column:
    out = text.contains(HOLDS[0])
    for x in HOLDS[1:]:
        out = out | text.contains(x)
    return out | text.rlike(HINT)


def found_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def mentions(docs: DataFrame, text_col: str) -> DataFrame:
    """Rows that hold entities, with their mentions in order (those with wrong check digits among them)."""
    text = filled(F.col(text_col).cast("string"))
    # a row's number in the same step keeps the optimizer from finding the mentions twice
    some = docs.where(hinted(text)).withColumns({"_pii_found": found_in(text), "_pii_row": F.monotonically_increasing_id()})
    return some.where(F.exists("_pii_found", valid))


def rewrite(docs: DataFrame, text_col: str = "text", key: str = "surrogates", only_changed: bool = False) -> DataFrame:
    """The rows with surrogates for entities; _pii_n and _pii_kinds tell how many mentions of which kinds."""
    # saved before its rows' numbers are used: they need not come out the same a second time
    found = save(mentions(docs, text_col), "pii-found")
    each = found.select("_pii_row", F.posexplode("_pii_found").alias("at", "mention"))
    each = each.select("_pii_row", "at", "mention", F.posexplode(parts_of(F.col("mention"))).alias("part", "p"))
    parts = save(each.select("_pii_row", "at", "mention", "part", F.col("p.kind").alias("kind"), F.col("p.raw").alias("raw"), canonical(F.col("p.kind"), F.col("p.raw")).alias("canon")), "pii-parts")
    # an entity may stand in a third of all documents
    told = joined_hot(parts, entities(parts, key), ["kind", "canon"], "mentions", "inner")
    one = told.groupBy("_pii_row", "at").agg(F.first("mention").alias("mention"), F.array_sort(F.collect_list(F.struct("part", written(F.col("kind"), F.col("raw"), F.col("value")).alias("v")))).alias("v"), F.min("kind").alias("kind"))
    named = F.col("kind").contains(":")
    kind = F.when(named, "name").when(F.col("kind") == "local", "phone").otherwise(F.col("kind"))
    value = F.array_join(F.transform("v", lambda x: x["v"]), " ")
    value = F.when(named, F.concat(F.substring_index("mention", " ", 1), F.lit(" "), value)).otherwise(value)
    by_row = one.groupBy("_pii_row").agg(F.map_from_entries(F.collect_list(F.struct("at", value.alias("v")))).alias("_pii_values"), F.array_sort(F.collect_set(kind)).alias("_pii_kinds"))
    changed = found.join(by_row, "_pii_row")
    between = F.split(F.col(text_col).cast("string"), ANY, -1)
    after = F.transform("_pii_found", lambda m, i: F.concat(F.coalesce(F.try_element_at("_pii_values", i), m), F.get(between, i + 1)))
    changed = changed.withColumn(text_col, F.concat(F.get(between, F.lit(0)), F.array_join(after, "")))
    changed = changed.withColumn("_pii_n", F.size("_pii_values").cast("long")).drop("_pii_found", "_pii_values")
    if only_changed:
        return changed.drop("_pii_row")
    text = filled(F.col(text_col).cast("string"))
    same = docs.where(~(hinted(text) & F.exists(found_in(text), valid))).withColumns({"_pii_n": F.lit(0).cast("long"), "_pii_kinds": F.array().cast("array<string>")})
    return changed.drop("_pii_row").unionByName(same)


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "surrogates") -> DataFrame:
    """id, n_mentions, kinds, text for each document with entities."""
    out = rewrite(docs.select(id_col, text_col), text_col, key, only_changed=True)
    return out.select(id_col, F.col("_pii_n").alias("n_mentions"), F.array_join("_pii_kinds", ",").alias("kinds"), text_col)
