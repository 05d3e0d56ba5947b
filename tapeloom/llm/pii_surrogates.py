"""Personal data replaced by keyed surrogates.

Detected kinds: e-mail addresses, phone numbers, payment cards (only numbers that pass the
Luhn check), IPv4 addresses, hexadecimal secrets of 32 digits or more, and names after a
form of address.  Every entity, a mention without its formatting, gets a surrogate drawn from
a keyed hash: digits become digits, letters letters of their script, cards pass the Luhn
check again, octets stay octets of as many digits, e-mail addresses keep their top-level
domain.  Names and addresses are put together from the surrogates of their parts: a surname
has one surrogate wherever it stands, a given name one for each gender of the form of
address, a domain one for all its addresses.  A mention shows the surrogate in its own format
and case.

Collision check.  Surrogates are drawn for the distinct entities and parts of the whole
corpus.  One that equals a real one, or another surrogate, is drawn again until all are
distinct, so different entities stay different and mentions of one entity stay the same.
Mr. and Mrs. of one surname share its surrogate and are told apart by the form of address.
Crowded kinds are widened after ``NARROW_ATTEMPTS`` draws.

Only DataFrame functions are used.  Entities are aggregated before they are joined, and only
texts with a mention are shuffled.

Defined results: null and empty texts are unchanged and have no entity; equal rows are
rewritten alike; rows without a mention are unchanged, all columns are kept.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import free_names
from tapeloom.session import settle

NARROW_ATTEMPTS = 3
MOST_ATTEMPTS = 60
#: Copies of the table of domains, over which the addresses of a common domain are dealt.
DOMAIN_COPIES = 16
#: Forms of address; fixed values of the detector.
MALE = ("Mr.", "Herr", "Herrn", "Monsieur", "Señor", "господин")
FEMALE = ("Mrs.", "Ms.", "Miss", "Frau", "Madame", "Señora", "госпожа")
#: Parts of names before the surname, by the kind of the name.
GIVEN = {"man": "given of a man", "woman": "given of a woman"}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}[\p{L}’']*(?:[ -]\p{Lu}[\p{L}’']*){0,2}"
_TITLE = "(?:" + "|".join(t.replace(".", r"\.") for t in MALE + FEMALE) + ")"
_LOCAL = r"[\p{L}\p{N}._%+-]"
_HOST = r"@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}(?![\p{L}\p{N}])"
#: Each part starts where no longer run of its kind could start, so a scan is linear.
PATTERN = "|".join(
    (
        rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+{_HOST}",
        # A longer run of such characters; a rule of signs in it ends what stands before.
        rf"(?:(?<!{_LOCAL})(?={_LOCAL}{{65}})|(?<=[._%+-]{{8}})(?![._%+-]))(?!{_LOCAL}*?[._%+-]{{8}}){_LOCAL}++{_HOST}",
        r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}.+])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}+(])\(\d{3}\) ?\d{3}[-.]\d{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}.+-])\d{3}([-.])\d{3}\2\d{4}(?![\p{L}\p{N}])",
        rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\p{{L}}\p{{N}}])",
        rf"(?<![\p{{L}}\p{{N}}]){_TITLE} {_NAME}",
    )
)
#: What every mention contains; decides cheaply that a text has none.
HINT = r"[@0-9]|" + _TITLE + " "
SCRIPTS = {
    r"\p{IsLatin}": "abcdefghijklmnopqrstuvwxyz",
    r"\p{IsCyrillic}": "абвгдежзиклмнопрстуфхцчшэюя",
    r"\p{IsGreek}": "αβγδεζηθικλμνξοπρστυφχψω",
    r"\p{IsHan}": "安本成大方光海和金林明平山文心新星英雨月",
}
VOWELS = {r"\p{IsLatin}": ("aeiou", "bcdfghklmnprstvw"), r"\p{IsCyrillic}": ("аеиоу", "бвгдзклмнпрст"), r"\p{IsGreek}": ("αεηιο", "βγδθκλμνπρστ")}
ENDINGS = {r"\p{IsLatin}": ("o", "a"), r"\p{IsCyrillic}": ("н", "а"), r"\p{IsGreek}": ("ς", "α")}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _drawn(seed: Column, text: Column, char: Callable[[Column, Column, Column], Column]) -> Column:
    """``char`` of every character, a number from the keyed hash of ``seed``, and its place from 0."""
    stream = F.concat(F.sha2(F.concat(seed, F.lit("|0")), 512), F.sha2(F.concat(seed, F.lit("|1")), 512))

    def every(h: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            n = F.conv(F.substring(h, (i % 64 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
            return char(c, n + F.floor(i / 64).cast("int"), i)

        return F.array_join(F.transform(_chars(text), one), "")

    return _let(stream, every)


def _same_kind(c: Column, n: Column, i: Column) -> Column:
    out = F.when(c.rlike("[0-9]"), _pick("0123456789", n))
    for script, alphabet in SCRIPTS.items():
        out = out.when(c.rlike(script), _pick(alphabet, n))
    return out.when(c.rlike(r"\p{L}"), _pick(SCRIPTS[r"\p{IsLatin}"], n)).otherwise(c)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of the digits, the last of which is not doubled."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)


# Mentions and entities.


def mentions(text: Column) -> Column:
    """All mentions in order, false card numbers included."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """Kind of a mention; null for a number of a card's form that is none."""
    digits = _digits(mention)
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^[0-9a-fA-F]{32,}$"), "secret")
        .when(mention.rlike(r"^\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}$"), F.when(_luhn_sum(digits) % 10 == 0, "card"))
        .when(mention.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "address")
        .when(mention.rlike(r"^[+(\d]"), "phone")
        .when(mention.rlike("^(?:" + "|".join(t.replace(".", r"\.") for t in FEMALE) + ") "), "woman")
        .otherwise("man")
    )


def content_of(mention: Column, kind: Column) -> Column:
    """The part of a mention that is replaced: of a name what follows the form of address."""
    return F.when(kind.isin("man", "woman"), F.regexp_replace(mention, "^[^ ]+ ", "")).otherwise(mention)


def entity_of(mention: Column, kind: Column) -> Column:
    return F.when(kind.isin("phone", "card"), _digits(mention)).otherwise(F.lower(content_of(mention, kind)))


# Surrogates.


def _name_word(seed: Column, word: Column, ending: Column | None) -> Column:
    """A word of vowels and consonants in turn, in the script of ``word``."""
    length = F.length(word)

    def char(c: Column, n: Column, i: Column) -> Column:
        out = F.when(~c.rlike(r"\p{L}"), c)
        for script, (vowels, consonants) in VOWELS.items():
            own = F.when(i % 2 == 0, _pick(consonants, n)).otherwise(_pick(vowels, n))
            if ending is not None:
                male, female = ENDINGS[script]
                own = F.when((i == length - 1) & (length > 1), F.when(ending, female).otherwise(male)).otherwise(own)
            out = out.when(c.rlike(script), own)
        return out.otherwise(_same_kind(c, n, i))

    return _drawn(seed, word, char)


def surrogate(kind: Column, entity: Column, attempt: int, key: str) -> Column:
    """The ``attempt``-th draw for an entity or a part of one, in canonical form.

    Of an e-mail address the local part is drawn; its domain, a part, is put in later.
    """

    def seed(what: str, of: Column) -> Column:
        return F.concat(F.lit(f"{key}|{what}|{attempt}|"), of)

    wide = attempt >= NARROW_ATTEMPTS
    more = "x" * (attempt - NARROW_ATTEMPTS + 3) if wide else ""

    local, at = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.concat(_drawn(seed("email", entity), F.concat(local, F.lit(more)), _same_kind), F.lit("@"), at)
    top = F.substring_index(entity, ".", -1)
    labels = F.concat(F.lit(more), F.substring(entity, F.lit(1), F.length(entity) - F.length(top)))
    domain = F.concat(_drawn(seed("domain", entity), labels, _same_kind), top)
    secret = _drawn(seed("secret", entity), entity, lambda c, n, i: _pick("0123456789abcdef", n))
    # Cards keep their first digit; the last one makes the Luhn sum a multiple of ten.
    body = F.substring(_drawn(seed("card", entity), entity, lambda c, n, i: F.when(i == 0, c).otherwise(_pick("0123456789", n))), F.lit(1), F.length(entity) - 1)
    card = _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    # The country code before the last ten digits stays, as does the format.
    kept = F.lit(0) if wide else F.greatest(F.lit(0), F.length(entity) - 10)
    phone = _drawn(seed("phone", entity), entity, lambda c, n, i: F.when(i < kept, c).otherwise(_pick("0123456789", n)))
    octet_seed = seed("address", entity)

    def octet(o: Column, i: Column) -> Column:
        n = F.conv(F.substring(F.sha2(F.concat(octet_seed, i.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
        if wide:
            return (n % 256).cast("string")
        return F.when(F.length(o) == 3, 100 + n % 156).when(F.length(o) == 2, 10 + n % 90).otherwise(n % 10).cast("string")

    address = F.array_join(F.transform(F.split(entity, r"\."), octet), ".")
    longer = F.concat(entity, F.lit(more))
    surname = _name_word(seed("surname", entity), longer, None)
    male, female = (_name_word(seed(part, entity), longer, F.lit(part == "given of a woman")) for part in GIVEN.values())
    return (
        F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "secret", secret).when(kind == "card", card)
        .when(kind == "phone", phone).when(kind == "address", address)
        .when(kind == "surname", surname).when(kind == GIVEN["man"], male).otherwise(female)
    )


def _name_parts(entities: DataFrame) -> DataFrame:
    """kind, entity, place, part kind and word of names; the last word is the surname."""
    names = entities.where(F.col("kind").isin(*GIVEN)).withColumn("words", F.split("entity", " "))
    words = names.select("kind", "entity", F.size("words").alias("n"), F.posexplode("words").alias("place", "word"))
    given = F.when(F.col("kind") == "man", GIVEN["man"]).otherwise(GIVEN["woman"])
    return words.select("kind", "entity", "place", F.when(F.col("place") == F.col("n") - 1, "surname").otherwise(given).alias("part"), "word")


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate: one to one within a kind, and no surrogate is an entity.

    All words of names have different surrogates, and none is a word of a name.
    """
    entities = settle(entities.select("kind", "entity").distinct())
    parts = _name_parts(entities)
    domain_of = F.substring_index("entity", "@", -1)
    emails = entities.where("kind = 'email'")
    domains = emails.select(F.lit("domain").alias("kind"), domain_of.alias("entity"))
    atoms = entities.where(~F.col("kind").isin(*GIVEN)).unionAll(domains.unionAll(parts.select("part", "word")).distinct())
    drawn = _drawn_apart(settle(atoms), key)

    words = drawn.where(F.col("kind").isin("surname", *GIVEN.values())).toDF("part", "word", "surrogate")
    names = parts.join(words, ["part", "word"]).groupBy("kind", "entity").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("words"))
    names = names.select("kind", "entity", F.array_join("words.surrogate", " ").alias("surrogate"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(DOMAIN_COPIES - 1))).alias("copy")
    new_domains = drawn.where("kind = 'domain'").select(F.col("entity").alias("domain"), F.col("surrogate").alias("new_domain"), copies)
    emails = drawn.where("kind = 'email'").withColumns({"domain": domain_of, "copy": F.pmod(F.xxhash64("entity"), F.lit(DOMAIN_COPIES)).cast("int")})
    local = F.substring_index("surrogate", "@", 1)
    emails = emails.join(new_domains, ["domain", "copy"]).select("kind", "entity", F.concat(local, F.lit("@"), "new_domain").alias("surrogate"))
    return drawn.where(~F.col("kind").isin("email", "domain", "surname", *GIVEN.values())).unionAll(names).unionAll(emails)


def _drawn_apart(pending: DataFrame, key: str) -> DataFrame:
    """kind, entity, surrogate of distinct entities and parts, drawn until all are distinct."""
    family = F.when(F.col("kind").isin("surname", *GIVEN.values()), "name").otherwise(F.col("kind")).alias("family")
    taken = pending.select(family, F.col("entity").alias("surrogate"))
    done: list[DataFrame] = []
    for attempt in range(MOST_ATTEMPTS):
        drawn = pending.select("kind", "entity", family, surrogate(F.col("kind"), F.col("entity"), attempt, key).alias("surrogate"))
        offers = drawn.select("family", "surrogate", F.concat_ws("|", "kind", "entity").alias("by"))
        held = taken.select("family", "surrogate", F.lit(None).cast("string").alias("by"))
        # A surrogate goes to one entity, and to none if it is held already.
        winner = offers.unionAll(held).groupBy("family", "surrogate").agg(
            F.max(F.col("by").isNull()).alias("held"), F.min("by").alias("by")
        ).where("NOT held").select(F.col("family").alias("_f"), F.col("surrogate").alias("_s"), "by")
        on = (F.col("family") == F.col("_f")) & (F.col("surrogate") == F.col("_s")) & (F.concat_ws("|", "kind", "entity") == F.col("by"))
        judged = settle(drawn.join(winner, on, "left").select("kind", "entity", "family", "surrogate", F.col("by").isNotNull().alias("won")))
        won = judged.where("won")
        done.append(won.select("kind", "entity", "surrogate"))
        pending = judged.where("NOT won").select("kind", "entity")
        if not pending.head(1):
            return reduce(DataFrame.unionAll, done)
        taken = taken.unionAll(won.select("family", "surrogate"))
    raise RuntimeError(f"no distinct surrogates after {MOST_ATTEMPTS} draws")


def shown(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format and case of the mention."""
    content = content_of(mention, kind)
    title = F.substring(mention, F.lit(1), F.length(mention) - F.length(content))

    def digit(c: Column, i: Column) -> Column:
        place = F.length(_digits(F.substring(mention, F.lit(1), (i + 1).cast("int"))))
        return F.when(c.rlike("[0-9]"), F.substring(surrogate, place, F.lit(1))).otherwise(c)

    def cased(c: Column, own: Column) -> Column:
        return F.when((own == F.upper(own)) & (own != F.lower(own)), F.upper(c)).otherwise(c)

    numbers = F.array_join(F.transform(_chars(mention), digit), "")
    letters = (
        F.when(content == F.lower(content), surrogate)
        .when(content == F.upper(content), F.upper(surrogate))
        .when(F.length(content) == F.length(surrogate), F.array_join(F.zip_with(_chars(surrogate), _chars(content), cased), ""))
        .otherwise(F.initcap(surrogate))
    )
    return F.concat(title, F.when(kind.isin("phone", "card"), numbers).otherwise(letters))


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """mention and replacement for every distinct mention of an entity in ``docs``."""
    found = docs.select(F.explode(F.array_distinct(mentions(F.col("text").cast("string")))).alias("mention")).distinct()
    found = settle(found.withColumn("kind", kind_of(F.col("mention"))).where("kind IS NOT NULL").withColumn("entity", entity_of(F.col("mention"), F.col("kind"))))
    one = distinct_surrogates(found, key)
    return found.join(one, ["kind", "entity"]).select("mention", shown(F.col("mention"), F.col("kind"), F.col("surrogate")).alias("replacement"))


def anonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, all other columns as they are."""
    columns = docs.columns
    table = settle(replacements(docs, key))
    text = F.col("text").cast("string")
    found, hashed, of, mapped = free_names(columns, "found", "hash", "of", "map")
    docs = docs.withColumn(found, mentions(text))
    clean = docs.where(F.col(found).isNull() | (F.size(found) == 0)).drop(found)
    touched = docs.where(F.size(found) > 0).withColumn(hashed, F.xxhash64(text))
    each = touched.select(F.col(hashed).alias(of), F.explode(F.array_distinct(found)).alias("mention")).distinct()
    maps = each.join(table, "mention").groupBy(of).agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias(mapped))
    joined = touched.join(maps, F.col(hashed) == F.col(of), "left")
    parts = F.split(text, PATTERN, -1)
    new = F.transform(found, lambda m: F.coalesce(F.col(mapped)[m], m))
    woven = F.zip_with(parts, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    rewritten = joined.withColumn("text", F.array_join(woven, ""))
    return clean.select(columns).unionAll(rewritten.select(columns))
