"""PII surrogates in DataFrame functions alone.

Entities (e-mail and IP addresses, phone and card numbers, social security numbers, names after a title) are found by one pattern. Each gets a surrogate from
a keyed SHA-256 of its canonical form, so all mentions of an entity get the same one (coreference), written
in the format of each mention: letters for letters, digits for digits, the same separators and upper case; phone numbers keep their
country code, cards their first digit and a valid check digit, names the gender and script of their title.

A name is drawn word by word: its given name by gender, script and that word, each part of its surname by script and that part alone, whatever the title. So "Mr John Smith", "Mr Smith" and
"Mrs Smith-Jones" keep what they share. Titles, particles, hyphens and the like of O' stay; initials are exchanged by a keyed shift of the alphabet.

Collision checks: the surrogates of all distinct forms are grouped. A form whose surrogate another form of its kind holds with a smaller salt (then form), or that is
itself a real form of the corpus, is drawn again with the next salt, until no collision is left. Values grow with the salt, so they don't run out. So distinct entities stay distinct
and no surrogate is another's true value. Distinct forms, never texts, are grouped for this.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written

# Titles by gender and script, and names to draw from.
TITLES = {
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"),
    ("m", "cyrillic"): ("Господин",),
    ("f", "cyrillic"): ("Госпожа",),
}
FIRST_NAMES = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul"),
    ("f", "latin"): ("Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Petra"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения"),
}
SYLLABLES = {"latin": ("ba", "do", "fen", "gar", "hol", "ker", "lin", "mor", "nas", "pol", "ril", "sen", "tar", "vel", "win", "zan"), "cyrillic": ("ба", "до", "фен", "гар", "хол", "кер", "лин", "мор")}

# The alternatives start with tests of one or two characters, so that most places in a text are left at once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
PHONE = r"(?<![0-9+])(?=\+(?:[ .()-]{0,3}[0-9]){7})(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|[0-9](?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"
# The country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_TITLES = sorted((t for x in TITLES.values() for t in x), key=len, reverse=True)
# Titles that follow one of those, and particles of surnames.
SECOND = "Dr|Prof|Doctor|Professor|Ing|Mag|Dipl"
PARTICLES = "van|von|vom|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|zu|zur|bin|ibn|al|el"
_WORD = r"\p{Lu}(?:['’](?=\p{Lu}))?[\p{L}\p{M}]++(?:['’](?!s(?![\p{L}\p{M}]))[\p{L}\p{M}]++|-[\p{L}\p{M}]++)*+"
_BEFORE = rf"(?:{'|'.join(_TITLES)})\.? (?:(?:{SECOND})\.? )*"
_GIVEN, _INITIALS, _FAMILY = rf"(?:{_WORD})", r"(?:\p{Lu}\. ?)++", rf"(?:(?:{PARTICLES}) )*"
NAME = rf"(?<!\p{{L}})(?=[{''.join(sorted({t[0] for t in _TITLES}))}]){_BEFORE}(?:{_GIVEN} (?:{_INITIALS})?|{_INITIALS})?{_FAMILY}{_WORD}"
#: The parts of a name: titles, given name, initials behind it, initials alone, particles, surname.
NAME_PARTS = rf"^({_BEFORE})(?:({_GIVEN}) ({_INITIALS})?|({_INITIALS}))?({_FAMILY})({_WORD})$"
LETTERS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"}
#: Digits that a phone number has at least.
PHONE_DIGITS = 7
#: Draws after which a value grows.
GROW = 3
ENTITY = rf"{EMAIL}|(?=[0-9+(])(?:{IP}|{PHONE}|{CARD}|{SSN})|{NAME}"


def may_hold(text: Column) -> Column:
    """False only for texts that ENTITY can't match anywhere: they hold no @, no three digits or dotted digits, no + before a digit, and no title."""
    out = text.contains("@") | text.rlike("[0-9][0-9.][0-9.]|[+][0-9]")
    for title in _TITLES:
        out = out | text.contains(title)
    return out


def kind(entity: Column) -> Column:
    """email, ip, card, ssn, phone or name; none for a number too short for a phone."""
    digits = F.length(F.regexp_replace(entity, "[^0-9]", ""))
    plain = entity.rlike(r"^[0-9 -]+$")
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\p{Lu}"), "name")
        .when(entity.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(plain & (digits >= 15), "card")
        .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(digits >= PHONE_DIGITS, "phone")
        .otherwise("none")
    )


def canonical(entity: Column, of: Column) -> Column:
    """The form that all mentions of an entity share: lower case for addresses, digits alone for numbers."""
    number = F.concat(F.when(entity.startswith("+"), "+").otherwise(""), F.regexp_replace(entity, "[^0-9]", ""))
    return F.when(of.isin("phone", "card", "ssn"), number).otherwise(F.lower(entity))


def _of_title(entity: Column, value) -> Column:
    """value(gender, script) of a name's title."""
    title = F.lower(F.regexp_extract(entity, r"^([\p{L}]+)", 1))
    out = F.lit(None)
    for (gender, script), titles in TITLES.items():
        out = F.when(title.isin(*(t.lower() for t in titles)), value(gender, script)).otherwise(out)
    return out


def _part(entity: Column, k: int) -> Column:
    return F.regexp_extract(entity, NAME_PARTS, k)


def _cores(word: Column) -> Column:
    """(what stands before a part's core, core) of a name's word: its parts at hyphens, without the like of O'."""
    return F.transform(F.split(word, "-"), lambda x: F.struct(F.regexp_extract(x, r"^(\p{Lu}['’])?", 0).alias("before"), F.regexp_replace(x, r"^\p{Lu}['’]", "").alias("core")))


def forms(entity: Column, of: Column) -> Column:
    """(kind, form) of everything that is drawn for an entity: one for most kinds, one for each part of a name."""
    named = lambda k, kind_: F.transform(F.filter(_cores(_part(entity, k)), lambda x: x["core"] != ""), lambda x: F.struct(kind_.alias("kind"), F.lower(x["core"]).alias("form")))
    given = _of_title(entity, lambda gender, script: F.lit(f"given:{gender}:{script}"))
    family = _of_title(entity, lambda gender, script: F.lit(f"surname:{script}"))
    return F.when(of == "name", F.concat(named(2, given), named(6, family))).when(of == "none", F.array().cast("array<struct<kind:string,form:string>>")).otherwise(F.array(F.struct(of.alias("kind"), canonical(entity, of).alias("form"))))


def _draw(seed: Column, place: Column, below: int) -> Column:
    """A number under `below` for each place, from the keyed digest."""
    block = F.sha2(F.concat(seed, F.lit(":"), F.floor((place - 1) / 8).cast("string")), 256)
    return F.pmod(F.conv(block.substr((F.pmod(place - 1, F.lit(8)) * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long"), F.lit(below)).cast("int")


def _alike(text: Column, seed: Column) -> Column:
    """Letters for letters and digits for digits, other characters as they are."""
    def one(c: Column, i: Column) -> Column:
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(seed, i + 1, 26) + 1, F.lit(1))
        return F.when(c.rlike("[a-z]"), letter).when(c.rlike("[0-9]"), _draw(seed, i + 1, 10).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _check_digit(body: Column) -> Column:
    """The Luhn digit for a number without its last digit."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), value), F.lit(0), lambda a, b: a + b)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _more(salt: Column, letters: str, seed: Column) -> Column:
    """Further characters for later draws: the values of a kind grow with the salt."""
    some = F.transform(F.sequence(F.lit(1), F.greatest(salt - GROW, F.lit(1))), lambda i: F.substring(F.lit(letters), _draw(seed, i + 64, len(letters)) + 1, F.lit(1)))
    return F.when(salt > GROW, F.array_join(some, "")).otherwise("")


def _syllables(script: str, seed: Column, n: Column) -> Column:
    parts = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(2), n + 1), lambda i: F.element_at(parts, _draw(seed, i, len(SYLLABLES[script])) + 1)), "")


def _name(of: Column, seed: Column, salt: Column) -> Column:
    """A given name of the kind's gender and script, longer from the fourth draw on, or a surname of four syllables and one more for each salt."""
    out = F.lit(None).cast("string")
    for (gender, script), names in FIRST_NAMES.items():
        first = F.element_at(F.array(*map(F.lit, names)), _draw(seed, F.lit(1), len(names)) + 1)
        longer = F.when(salt > GROW, _syllables(script, seed, F.greatest(salt - GROW, F.lit(1)))).otherwise("")
        out = F.when(of == f"given:{gender}:{script}", F.concat(F.lower(first), longer)).when(of == f"surname:{script}", _syllables(script, seed, 4 + salt)).otherwise(out)
    return out


def surrogate(of: Column, form: Column, salt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical form."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), of, form, salt.cast("string")), 256)
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    tail = F.regexp_extract(domain, r"(\.[^.]+)$", 1)
    host = domain.substr(F.lit(1), F.length(domain) - F.length(tail))
    host_seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), domain), 256)
    salt = salt.cast("int")
    email = F.concat(_alike(local, seed), _more(salt, "abcdefghijklmnopqrstuvwxyz", seed), F.lit("@"), _alike(host, host_seed), tail)
    digits = _more(salt, "0123456789", seed)
    ip = F.concat(F.concat_ws(".", *(((_draw(seed, F.lit(i), 254)) + 1).cast("string") for i in range(1, 5))), F.when(salt > GROW, F.concat(F.lit("."), digits)).otherwise(""))
    code = F.regexp_extract(form, COUNTRY, 0)
    phone = F.concat(code, _alike(form.substr(F.length(code) + 1, F.length(form)), seed), digits)
    body = F.concat(form.substr(1, 1), _alike(form.substr(F.lit(2), F.length(form) - 2), seed))
    valid = form.substr(F.length(form), F.lit(1)) == _check_digit(form.substr(F.lit(1), F.length(form) - 1))
    card = F.concat(body, F.when(valid, _check_digit(body)).otherwise(_draw(seed, F.lit(40), 10).cast("string")))
    named = of.startswith("given:") | of.startswith("surname:")
    return F.when(of == "email", email).when(of == "ip", ip).when(of == "phone", phone).when(of == "card", F.concat(card, digits)).when(named, _name(of, seed, salt)).otherwise(F.concat(_alike(form, seed), digits))


def _in_format(entity: Column, of: Column, form: Column) -> Column:
    """A canonical surrogate written as the mention is: its separators, or its upper case."""
    digits = F.regexp_replace(form, "[^0-9]", "")
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(acc["s"], F.when(digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + F.when(digit, 1).otherwise(0)).alias("i"))

    # A value that has grown is longer than the mention: the rest stands behind it.
    numbers = F.aggregate(F.split(entity, ""), start, step, lambda acc: F.concat(acc["s"], F.substring(digits, acc["i"], F.length(digits))))
    cased = F.array_join(F.zip_with(F.split(entity, ""), F.split(form, ""), lambda a, b: F.when((a != F.lower(a)) & a.isNotNull(), F.upper(b)).otherwise(F.coalesce(b, F.lit("")))), "")
    return F.when(of.isin("phone", "card", "ssn"), numbers).when(of == "email", cased).otherwise(form)


def _shifted(initials: Column, key: str) -> Column:
    """Initials exchanged by a keyed shift of their alphabet; letters of no alphabet here become X."""
    out = F.regexp_replace(initials, "[^A-ZА-Я. ]", "X")
    for letters in LETTERS.values():
        by = 1 + int(hashlib.sha256(f"{key}|initials".encode()).hexdigest()[:8], 16) % (len(letters) - 1)
        out = F.translate(out, letters, letters[by:] + letters[:by])
    return out


def _named(entity: Column, drawn: Column, key: str) -> Column:
    """A name with the surrogates of its parts; drawn maps kind and form, with a blank between them, to surrogates."""
    given = _of_title(entity, lambda gender, script: F.lit(f"given:{gender}:{script}"))
    family = _of_title(entity, lambda gender, script: F.lit(f"surname:{script}"))

    def word(k: int, kind_: Column) -> Column:
        def one(x: Column) -> Column:
            new = drawn[F.concat(kind_, F.lit(" "), F.lower(x["core"]))]
            high = (F.length(x["core"]) > 1) & (x["core"] == F.upper(x["core"]))
            return F.concat(x["before"], F.when(high, F.upper(new)).when(x["core"] == F.lower(x["core"]), new).otherwise(F.initcap(new)))

        return F.array_join(F.transform(_cores(_part(entity, k)), one), "-")

    first = F.when(_part(entity, 2) != "", F.concat(word(2, given), F.lit(" "))).otherwise("")
    initials = _shifted(F.concat(_part(entity, 3), _part(entity, 4)), key)
    return F.concat(_part(entity, 1), first, initials, _part(entity, 5), word(6, family))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) of distinct (kind, form), free of collisions. Each round draws again what collides; values grow with the rounds, so this ends."""
    drawn = written(entities.select("kind", "form", F.lit(0).alias("salt")).withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("salt"), key)))
    real = entities.select("kind", F.col("form").alias("surrogate"))
    while True:
        owners = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("salt", "form")).alias("owner"))
        taken = owners.join(real.withColumn("real", F.lit(True)), ["kind", "surrogate"], "left")
        again = drawn.join(taken, ["kind", "surrogate"]).where(F.col("real").isNotNull() | (F.col("owner.form") != F.col("form"))).select("kind", "form", F.lit(True).alias("again"))
        if again.isEmpty():
            return drawn.select("kind", "form", "surrogate")
        salt = F.col("salt") + F.when(F.col("again"), 1).otherwise(0)
        drawn = written(drawn.join(again, ["kind", "form"], "left").select("kind", "form", salt.alias("salt"), F.when(F.col("again"), surrogate(F.col("kind"), F.col("form"), salt, key)).otherwise(F.col("surrogate")).alias("surrogate")))


def pseudonymise(docs: DataFrame, *, key: str = "surrogate-key", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with surrogates, n_entities and n_email, n_ip, n_phone, n_card, n_ssn, n_name.

    Null texts stay null and empty ones empty, without entities; very long ones are changed whole, and their entities counted like others'. Repeated rows give repeated rows, an empty table none, ids may be null;
    other columns are not read. The same key gives the same surrogates unless collisions differ between corpora.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), F.coalesce(may_hold(text), F.lit(False)).alias("maybe"))
    names = ("email", "ip", "phone", "card", "ssn", "name")
    plain = rows.where(~F.col("maybe")).select("doc_id", "text", *(F.lit(0).cast("long").alias(f"n_{n}") for n in ("entities", *names)))
    found = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    some = rows.where("maybe").select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    mentions = written(some.select("h1", "h2", F.explode(F.array_distinct(found)).alias("entity")).distinct())
    of = kind(F.col("entity"))
    entities = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", of).withColumn("forms", forms(F.col("entity"), F.col("kind")))
    entities = written(entities)
    parts = written(entities.select("entity", F.explode("forms").alias("f")).select("entity", "f.kind", "f.form"))
    # A surname that many names share is one key: where it is in a thousandth of all parts it is sent to all tasks.
    uses = parts.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("uses"))
    assigned = written(assign(uses.select("kind", "form"), key).join(uses, ["kind", "form"]))
    n_parts = parts.count()
    drawn = looked_up(parts, assigned, ["kind", "form"], 1000 * F.col("uses") >= n_parts)
    drawn = drawn.groupBy("entity").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "form"), "surrogate"))).alias("drawn"))
    one = F.col("drawn")[F.concat(F.col("kind"), F.lit(" "), F.col("forms")[0]["form"])]
    new = F.when(F.col("kind") == "name", _named(F.col("entity"), F.col("drawn"), key)).when(F.col("kind") == "none", F.col("entity")).otherwise(_in_format(F.col("entity"), F.col("kind"), one))
    replaced = written(entities.join(drawn, "entity", "left").select("entity", "n", new.alias("new"), "kind"))
    n_mentions = mentions.count()
    table = looked_up(mentions, replaced, ["entity"], 1000 * F.col("n") >= n_mentions).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("entity", F.struct("new", "kind")))).alias("table"))
    # A text without a table holds no entity.
    whole = F.when(F.col("table").isNotNull(), F.struct(F.split("text", ENTITY, -1).alias("between"), found.alias("found")))
    joined = some.join(table, ["h1", "h2"], "left").select("doc_id", "text", "table", whole.alias("w"))
    parts = joined.select("doc_id", "text", "w.between", F.transform("w.found", lambda e: F.col("table")[e]).alias("new"))

    def count(name: str) -> Column:
        return F.coalesce(F.size(F.filter("new", lambda x: x["kind"] == name)), F.lit(0)).cast("long").alias(f"n_{name}")

    ends = F.concat(F.col("new.new"), F.array(F.lit("")))
    changed = F.coalesce(F.array_join(F.zip_with("between", ends, lambda a, b: F.concat(a, b)), ""), "text")
    n = F.coalesce(F.size(F.filter("new", lambda x: x["kind"] != "none")), F.lit(0)).cast("long").alias("n_entities")
    return parts.select("doc_id", changed.alias("text"), n, *map(count, names)).unionByName(plain)
