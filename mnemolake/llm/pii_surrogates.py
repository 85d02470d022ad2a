"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Entities are found by one pattern for each kind. An entity's canonical form (digits of a
phone number, lower-case mail parts, one name token) gets a candidate from SHA-512 of the
key, kind, form and attempt, in the shape of the form: digits for digits, letters for
letters of the same script, card check digits that hold if they held, endings of surnames
that tell gender as they are. Distinct forms are then
checked globally: of the forms that drew one candidate, or a candidate that is itself a form
in the data, all but the least draw again. Given names take the next of their list of one
gender and script in an order by the key, so no two share one and none stays. Distinct
names so get distinct surrogates, as each of their words does. The table of forms goes back
to its places by a join, so one person is one surrogate in every document, and the surrogate
takes the case and separators of each mention.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import native
from .store import checkpoint, written

#: Given names by gender and script; a name's surrogate comes from its own list.
GIVEN = {
    "female_latin": "Alice Anna Barbara Carmen Caroline Catherine Charlotte Christine Claire Claudia Diana Elena Elisabeth Elizabeth Emily Emma Eva Hannah Helen Isabel Jennifer Jessica Julia Karen Laura Linda Lisa Lucia Margaret Maria Marie Martha Monica Nancy Nicole Olivia Patricia Rachel Rebecca Rosa Sandra Sarah Sofia Sophie Stephanie Susan Teresa Ursula Valerie Victoria".split(),
    "male_latin": "Adam Albert Alexander Andrew Anthony Antonio Benjamin Bernard Carlos Charles Christopher Daniel David Dieter Edward Eric Francisco Frank Fritz George Hans Henry Jacques James Jean John Jonathan Jorge Joseph Juan Karl Kevin Luis Manuel Martin Matthew Michael Miguel Nicholas Oliver Oscar Otto Patrick Paul Peter Philip Pierre Richard Robert Samuel Simon Stephen Thomas Walter Werner William".split(),
    "female_cyrillic": "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    "male_cyrillic": "Алексей Андрей Борис Виктор Дмитрий Иван Максим Николай Павел Сергей".split(),
}
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora|Señor|Monsieur|Madame|Sr|Sra"
_SURNAME = "\\p{Lu}\\p{Ll}{1,20}(?:-\\p{Lu}\\p{Ll}{1,20})?"
_ANY_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
#: kind -> pattern; where two patterns could match at one place, the first kind has it.
KINDS = {
    "email": "[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,63})@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\\.?[0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9A-Za-z-])[0-9](?:[\\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": "(?<![0-9A-Za-z+])(?:\\+[0-9]{1,3}[\\x20.-]?)?(?:\\([0-9]{2,4}\\)\\x20?|[0-9]{2,4}[\\x20.-])[0-9]{3,4}[\\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
    "name": f"(?<!\\p{{L}})(?:(?:{_TITLES})\\.?\\x20{_SURNAME}(?:\\x20{_SURNAME})?|(?:{_ANY_GIVEN})\\x20{_SURNAME})(?!\\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: Texts without any of these hold no entity; it is cheaper to look for than PATTERN.
HINT = f"@|[0-9]{{3}}|[0-9]\\.[0-9]|(?<!\\p{{L}})(?:{_TITLES}|{_ANY_GIVEN})(?!\\p{{L}})"
#: Endings of surnames that differ between women and men.
GENDERED = "(?<=\\p{L})(?:[оеё]ва|[оеё]в|ина|ин|ская|ский|ской|цкая|цкий|ová|ova|eva|ov|ev|ska|ski|skaya|sky)$"
MAX_ATTEMPTS = 64
_LATIN_CONSONANTS, _LATIN_VOWELS = "bcdfghjklmnprstvwz", "aeiou"
_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS = "бвгджзклмнпрстфхцчш", "аеиоуыэюя"


def _kind(value: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def _given_list(token: Column) -> Column:
    """The list that a given name belongs to; null for other tokens."""
    out = None
    for name, members in GIVEN.items():
        test = token.isin(members)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def _parts(kind: Column, value: Column) -> Column:
    """array<struct<kind, text, masked>> of the pieces of an entity: masked ones get a surrogate each."""
    piece = lambda k, t, masked: F.struct(k.alias("kind"), t.alias("text"), F.lit(masked).alias("masked"))
    title = F.regexp_extract(value, f"^(?:{_TITLES})\\.?\\x20", 0)
    tokens = F.split(F.substr(value, F.char_length(title) + 1), "\\x20")
    named = F.concat(
        F.array(piece(F.lit("title"), title, False)),
        F.flatten(F.transform(tokens, lambda t, i: F.array(piece(F.lit("space"), F.when(i > 0, F.lit(" ")).otherwise(F.lit("")), False), piece(F.coalesce(_given_list(t), F.lit("surname")), t, True)))),
    )
    local, domain = F.substring_index(value, "@", 1), F.regexp_extract(value, "@(.*)\\.[A-Za-z0-9-]+$", 1)
    mail = F.array(
        piece(F.lit("mail_user"), local, True), piece(F.lit("at"), F.lit("@"), False), piece(F.lit("mail_host"), domain, True),
        piece(F.lit("tld"), F.concat(F.lit("."), F.substring_index(value, ".", -1)), False),
    )
    country = F.regexp_extract(value, "^\\+[0-9]{1,3}[\\x20.-]?", 0)
    phone = F.array(piece(F.lit("country"), country, False), piece(kind, F.substr(value, F.char_length(country) + 1), True))
    return F.when(kind == "name", named).when(kind == "email", mail).when(kind == "phone", phone).otherwise(F.array(piece(kind, value, True)))


def _canonical(kind: Column, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (
        F.when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.regexp_replace(text, "\\x20", ""))
        .when(kind.isin("mail_user", "mail_host"), F.lower(text))
        .otherwise(text)
    )


def remainder(text: Column) -> Column:
    """The number that digits and capital letters, as 10 to 35, make, modulo 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def given_surrogates(key: str) -> dict[str, dict[str, str]]:
    """Each list's names with their surrogates: the next in the order by a hash of the key and the name, one cycle through the list."""
    out = {}
    for kind, members in GIVEN.items():
        order = sorted(members, key=lambda n: (hashlib.sha512(f"{key}\x1f{kind}\x1f{n}".encode()).digest(), n))
        out[kind] = dict(zip(order, order[1:] + order[:1]))
    return out


def candidate(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """A surrogate of a canonical form, of its kind, length (names and addresses of hosts aside) and shape.

    Valid card numbers and IBANs get valid check digits. Surnames keep an ending that tells gender. Surnames and parts of mail addresses get longer
    by a letter with every second attempt if they have one or two characters besides, with
    every eighth if more, as few others are that short.
    """
    ending = F.when(kind == "surname", F.regexp_extract(form, GENDERED, 0)).otherwise(F.lit(""))
    form = F.substr(form, F.lit(1), F.char_length(form) - F.char_length(ending))
    step = F.when(F.char_length(form) < 3, F.lit(2)).otherwise(F.lit(8))
    more = F.when(kind == "surname", F.substring(form, -1, 1)).otherwise(F.lit("a"))
    form = F.when(kind.isin("surname", "mail_user", "mail_host"), F.concat(form, F.repeat(more, F.floor(attempt / step).cast("int")))).otherwise(form)
    seed = F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"))
    digest = F.sha2(seed, 512)
    value = lambda i: F.conv(F.substr(digest, 2 * (i % 60) + 1, F.lit(4)), 16, 10).cast("int")
    pick = lambda letters, i: F.substr(F.lit(letters), value(i) % len(letters) + 1, F.lit(1))

    def letter(c: Column, i: Column) -> Column:
        lower = F.when(c.rlike("\\p{IsCyrillic}"), F.when(i % 2 == 0, pick(_CYRILLIC_CONSONANTS, i)).otherwise(pick(_CYRILLIC_VOWELS, i))).otherwise(
            F.when(i % 2 == 0, pick(_LATIN_CONSONANTS, i)).otherwise(pick(_LATIN_VOWELS, i))
        )
        return F.when(c.rlike("\\p{Lu}"), F.upper(lower)).otherwise(lower)

    def shaped(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (value(i) % 10).cast("string")).when(c.rlike("\\p{L}"), letter(c, i)).otherwise(c)

    chars = F.filter(F.split(form, ""), lambda c: c != "")
    any_shape = F.array_join(F.transform(chars, shaped), "")
    # the first digits of a card name its network, the first two letters of an IBAN a country
    card = F.concat(F.substring(form, 1, 1), F.array_join(F.transform(F.slice(chars, F.lit(2), F.size(chars) - 1), shaped), ""))
    body = F.substr(card, F.lit(1), F.char_length(card) - 1)
    checked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda v: F.call_function("luhn_check", v))[0]
    country, account = F.substring(form, 1, 2), F.array_join(F.transform(F.slice(chars, F.lit(5), F.size(chars) - 4), lambda c, i: shaped(c, i + 2)), "")
    check = F.lpad((98 - remainder(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    drawn = F.array_join(F.transform(F.slice(chars, F.lit(3), F.lit(2)), shaped), "")
    valid = remainder(F.concat(F.substr(form, F.lit(5)), F.substring(form, 1, 4))) == 1
    iban = F.concat(country, F.when(valid, check).otherwise(drawn), account)
    octets = F.transform(F.split(form, "\\."), lambda o, i: (value(2 * i) % 254 + 1).cast("string"))
    out = F.when(kind == "card", F.when(F.call_function("luhn_check", form), checked).otherwise(card)).when(kind == "ip", F.array_join(octets, ".")).when(kind == "iban", iban)
    for name, following in given_surrogates(key).items():
        place = F.array_position(F.array(*map(F.lit, following)), form).cast("int")
        out = out.when(kind == name, F.get(F.array(*map(F.lit, following.values())), place - 1))
    return out.otherwise(F.concat(any_shape, ending))


def assign_surrogates(forms: DataFrame, key: str) -> DataFrame:
    """kind, form -> and surrogate, distinct in each kind and no form of the data.

    ``forms`` holds each pair once. Of the forms with one candidate, the least takes it and the
    others draw again, up to MAX_ATTEMPTS; what is left then keeps its last candidate with a hash
    of the form appended. Given names have a surrogate each from the start, which may be a name
    of the data, as each list is short; surnames keep clear of all lists.
    """
    forms = checkpoint(forms)
    given = F.col("kind").isin(*GIVEN)
    done = forms.filter(given).withColumn("surrogate", candidate(key, F.col("kind"), F.col("form"), F.lit(0)))
    pending = forms.filter(~given).withColumn("attempt", F.lit(0))
    taken = forms.filter(~given).select("kind", F.col("form").alias("surrogate"))
    listed = [n for names in GIVEN.values() for n in names]
    for attempt in range(MAX_ATTEMPTS):
        drawn = pending.withColumn("surrogate", candidate(key, F.col("kind"), F.col("form"), F.col("attempt")))
        free = drawn.filter(~((F.col("kind") == "surname") & F.col("surrogate").isin(listed))).join(taken, ["kind", "surrogate"], "left_anti")
        best = checkpoint(free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")).select("kind", "form", "surrogate"))
        done = done.unionByName(best)
        pending = checkpoint(pending.join(best, ["kind", "form"], "left_anti").select("kind", "form", F.lit(attempt + 1).alias("attempt")))
        if pending.isEmpty():
            return done
        taken = taken.unionByName(best.select("kind", "surrogate"))
    last = pending.withColumn("surrogate", F.concat(candidate(key, F.col("kind"), F.col("form"), F.col("attempt")), F.lit("-"), F.substring(F.sha2("form", 256), 1, 16)))
    return done.unionByName(last.select("kind", "form", "surrogate"))


def _poured(text: Column, surrogate: Column, kind: Column) -> Column:
    """A surrogate in the case and with the separators of a mention."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    digits_only = F.aggregate(
        chars(text),
        F.struct(F.lit(0).alias("k"), F.lit("").alias("out")),
        lambda acc, c: F.when(c.rlike("[0-9A-Z]"), F.struct((acc["k"] + 1).alias("k"), F.concat(acc["out"], F.substr(surrogate, acc["k"] + 1, F.lit(1))).alias("out"))).otherwise(
            F.struct(acc["k"].alias("k"), F.concat(acc["out"], c).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    cased = F.array_join(F.zip_with(chars(surrogate), chars(text), lambda s, t: F.when(t.rlike("[A-Z]"), F.upper(s)).otherwise(s)), "")
    return F.when(kind.isin("phone", "ssn", "card", "iban"), digits_only).when(kind.isin("mail_user", "mail_host") & (F.char_length(text) == F.char_length(surrogate)), cased).otherwise(surrogate)


def replace_pii(docs: DataFrame, key: str = "surrogate-key", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with surrogates in the text, and ``n_entities`` (long).

    Texts without an entity, and null texts, stay as they are. Equal rows get equal results;
    rows with one id and different texts are told apart by a hash of the text. Null ids are
    served like others. The same key gives the same surrogates as long as no form that it
    collides with comes or goes. A column named ``n_entities`` is replaced; the order of the
    others stays. An empty table gives no rows.

    The texts are searched once: the table is written with what was found, and read from
    there. Only documents with an entity are shuffled with their texts; the entities of one
    document, however long, come together in one row.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    own_found, own_th, part_id, part_th, pieces_of, times = native.fresh(columns, "_found", "_hit_th", "_pii_id", "_pii_th", "_pii_all", "_pii_n")
    text = native.quoted(text_col)
    none = F.array().cast("array<string>")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)
    marked = written(docs.select(*(native.quoted(c) for c in columns), found.alias(own_found)))
    hit, clean = marked.filter(F.size(own_found) > 0), marked.filter(F.size(own_found) == 0)
    entities = hit.select(native.quoted(id_col).alias("_id"), F.xxhash64(text).alias("_th"), F.col(own_found).alias("_found")).distinct()
    entities = entities.select("_id", "_th", F.posexplode("_found").alias("_at", "_value"))
    pieces = entities.select("_id", "_th", "_at", F.posexplode(_parts(_kind(F.col("_value")), F.col("_value"))).alias("_part", "_piece"))
    form = _canonical(F.col("_piece.kind"), F.col("_piece.text")).alias("form")
    pieces = written(pieces.select("_id", "_th", "_at", "_part", "_piece.kind", "_piece.text", "_piece.masked", form))
    forms = pieces.filter("masked AND form <> ''").select("kind", "form").distinct()
    table = assign_surrogates(forms, key)
    filled = pieces.join(table, ["kind", "form"], "left")
    value = F.when(F.col("surrogate").isNull(), F.col("text")).otherwise(_poured(F.col("text"), F.col("surrogate"), F.col("kind")))
    # an entity's pieces, then a document's entities, in order; both are bounded by the document
    parts = filled.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("_at", "_part", value.alias("value")))).alias("_all"), F.max("_at").alias("_last"))
    parts = parts.select(F.col("_id").alias(part_id), F.col("_th").alias(part_th), F.col("_all").alias(pieces_of), (F.col("_last") + 1).cast("long").alias(times))
    rebuilt = hit.withColumn(own_th, F.xxhash64(text)).join(parts, native.quoted(id_col).eqNullSafe(F.col(part_id)) & (F.col(own_th) == F.col(part_th)))
    gaps = F.transform(F.split(text, PATTERN, -1), lambda g, i: F.struct(i.alias("_at"), F.lit(-1).alias("_part"), g.alias("value")))
    joined = F.array_join(F.transform(F.sort_array(F.concat(gaps, pieces_of)), lambda x: x["value"]), "")
    done = rebuilt.select(*(joined.alias(c) if c == text_col else native.quoted(c) for c in columns), F.col(times).alias("n_entities"))
    return done.unionByName(clean.select(*(native.quoted(c) for c in columns), F.lit(0).cast("long").alias("n_entities")))
