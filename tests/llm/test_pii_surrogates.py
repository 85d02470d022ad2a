import hashlib
import random
import re

import regex

from mnemolake.llm import pii_surrogates as P
from tests.llm.common import documents, sample

MAIL = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]*\w")
IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
CARD = re.compile(r"(?<!\d)\d{16}(?!\d)")
PHONE = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}")


def replaced(spark, texts, ids=None, **kw):
    docs = documents(spark, texts, ids=ids)
    return [r.text for r in P.replace_pii(docs, **kw).orderBy("doc_id").collect()]


def test_sample_has_no_entity_left_and_keeps_the_rest(spark):
    docs = sample(spark, "sf0.01")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: (r.text, r.n_entities) for r in P.replace_pii(docs).collect()}
    assert set(before) == set(after)
    mapped = {}
    for pattern in (MAIL, IP, CARD, PHONE):
        old = {x for t in before.values() for x in pattern.findall(t)}
        assert old and not old & {x for t, _ in after.values() for x in pattern.findall(t)}
        for k, t in before.items():
            for a, b in zip(pattern.findall(t), pattern.findall(after[k][0]), strict=True):
                assert mapped.setdefault(a, b) == b
    assert len(set(mapped.values())) == len(mapped)
    for k, t in before.items():
        if not any(p.search(t) for p in (MAIL, IP, CARD, PHONE)):
            assert after[k][0] == t


def test_formats_gender_and_script(spark):
    texts = [
        "Call +1 (743) 555-3824 or +1 743-555-3824; card 4111 1111 1111 1111, 4111111111111111.",
        "Mrs. Anna Bell wrote to Bob.Hill@Mail.example.com and BOB.HILL@mail.example.com.",
        "Mr. Peter Bell met Анна Иванова; SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00, host 10.0.0.7",
        None, "", "plain text with 12 numbers and 3.5 values", "Peter Bell again",
    ]
    out = replaced(spark, texts)
    assert out[3:6] == texts[3:6]
    phones = re.findall(r"\+(\d) \(?(\d{3})\)?[ -](\d{3})-(\d{4})", out[0])
    assert len(phones) == 2 and phones[0] == phones[1] and phones[0] != ("1", "743", "555", "3824") and phones[0][0] == "1"
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{16})\.", out[0])
    assert cards[1].replace(" ", "") == cards[2] and cards[2][0] == "4" and luhn(cards[2]) and cards[2] != "4" + "1" * 15
    mails = re.findall(r"\S+@\S+\.com", out[1])
    assert mails[0].lower() == mails[1].lower() and re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{3}@[A-Z][a-z]{3}\.[a-z]{7}\.com", mails[0])
    she = re.search(r"Mrs\. (\w+) (\w+)", out[1])
    he = re.search(r"Mr\. (\w+) (\w+) met (\w+) (\w+)", out[2])
    again = out[6].split()
    assert she[1] in P.GIVEN["female_latin"] and he[1] in P.GIVEN["male_latin"] and he[3] in P.GIVEN["female_cyrillic"]
    assert she[2] == he[2] == again[1] and again[0] == he[1] and she[2] != "Bell"
    assert re.fullmatch("[А-Я][а-я]+", he[4]) and he[4] != "Иванова"
    assert re.search(r"SSN \d{3}-\d\d-\d{4}, IBAN DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, host \d+\.\d+\.\d+\.\d+$", out[2])
    assert replaced(spark, texts) == out and replaced(spark, texts, key="other") != out


def sound(iban):
    """Whether the check digits of an IBAN are right."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_valid_ibans_stay_valid(spark):
    """And those with wrong check digits, which are no one's, need not become valid."""
    rng = random.Random(4)
    valid = []
    for _ in range(60):
        country, account = rng.choice(["DE", "FR", "GB"]), "".join(rng.choice("0123456789ABZ") for _ in range(18))
        valid.append(next(f"{country}{d:02d}{account}" for d in range(2, 99) if sound(f"{country}{d:02d}{account}")))
    out = replaced(spark, [f"pay to {v} now" for v in valid] + ["pay to DE00370400440532013000 now", "pay to DE89 3704 0044 0532 0130 00 now"])
    found = [t[7:-4] for t in out]
    assert all(sound(x) and x != v and x[:2] == v[:2] for x, v in zip(found, valid)) and len(set(found)) == 62
    assert re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", found[61]) and sound(found[61].replace(" ", ""))


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def test_collisions_are_drawn_again(spark):
    forms = spark.createDataFrame([("mail_user", f"{a:02d}{b}") for a in range(20) for b in "abcde"], "kind string, form string")
    rows = P.assign_surrogates(forms, "k").collect()
    assert len(rows) == 100 and len({r.surrogate for r in rows}) == 100
    assert not {r.surrogate for r in rows} & {r.form for r in rows}


def test_given_names_and_short_forms_are_held_apart(spark):
    short = [("surname", a + b) for a in "BDLWXYZ" for b in "abcdefghijklmnopqrstuvwxyz"]
    short += [("mail_user", x) for x in "abcdefghijklmnopqrstuvwxyz0123456789"] + [("mail_host", x) for x in ("x", "y", "q1", "-")]
    given = [(k, n) for k, names in P.GIVEN.items() for n in names]
    rows = P.assign_surrogates(spark.createDataFrame(short + given, "kind string, form string"), "k").collect()
    assert len(rows) == len(short) + len(given) == len({(r.kind, r.surrogate) for r in rows})
    assert not any(r.form == r.surrogate for r in rows) and not {(r.kind, r.surrogate) for r in rows} & set(short)
    assert all((r.surrogate in P.GIVEN[r.kind]) for r in rows if r.kind in P.GIVEN)
    names = [f"{g} {s}" for _, g in given for s in ("Li", "Wu", "Xu", "Smith")]
    out = replaced(spark, ["Yesterday " + n + " came" for n in names])
    people = [t.removeprefix("Yesterday ").removesuffix(" came") for t in out]
    assert len(set(people)) == len(names)
    assert all(set(a.split()).isdisjoint(b.split()) for a, b in zip(names, people))


# Brute force: one loop over texts, one dictionary of forms, with the documented draw.
PYTHON = regex.compile(P.PATTERN.replace("\\p{IsCyrillic}", "\\p{Cyrillic}"))
VOWELS = {True: ("бвгджзклмнпрстфхцчш", "аеиоуыэюя"), False: ("bcdfghjklmnprstvwz", "aeiou")}


def draw(key, kind, form, attempt):
    for name, members in P.GIVEN.items():
        if kind == name:
            return P.given_surrogates(key)[kind][form]
    ending = (regex.search(P.GENDERED, form) or [""])[0] if kind == "surname" else ""
    body = form[: len(form) - len(ending)]
    if kind in ("surname", "mail_user", "mail_host"):
        body += (body[-1] if kind == "surname" else "a") * (attempt // (2 if len(body) < 3 else 8))
    digest = hashlib.sha512("\x1f".join([key, kind, body, str(attempt)]).encode()).hexdigest()
    value = lambda i: int(digest[2 * (i % 60) :][:4], 16)

    def shaped(c, i):
        if c in "0123456789":
            return str(value(i) % 10)
        if not regex.match(r"\p{L}", c):
            return c
        letters = VOWELS[bool(regex.match(r"\p{Cyrillic}", c))][i % 2]
        out = letters[value(i) % len(letters)]
        return out.upper() if regex.match(r"\p{Lu}", c) else out

    every = lambda x: "".join(shaped(c, i) for i, c in enumerate(x))
    if kind == "card":
        out = body[0] + every(body[1:])
        return next(out[:-1] + str(d) for d in range(10) if luhn(out[:-1] + str(d))) if luhn(body) else out
    if kind == "iban":
        out = body[:2] + every(body[2:])
        if sound(body):
            out = next(f"{body[:2]}{d:02d}{out[4:]}" for d in range(2, 99) if sound(f"{body[:2]}{d:02d}{out[4:]}"))
        return out
    if kind == "ip":
        return ".".join(str(value(2 * i) % 254 + 1) for i in range(4))
    return every(body) + ending


def pieces(value):
    """(kind, text, masked) of an entity's parts."""
    kind = next(k for k, p in P.KINDS.items() if regex.fullmatch(p, value))
    if kind == "name":
        title = (regex.match(f"(?:{P._TITLES})\\.?\\x20", value) or [""])[0]
        out = [("title", title, False)]
        for i, t in enumerate(value[len(title) :].split(" ")):
            out += [("space", " " if i else "", False), (next((n for n, m in P.GIVEN.items() if t in m), "surname"), t, True)]
        return out
    if kind == "email":
        user, _, rest = value.partition("@")
        host, _, tld = rest.rpartition(".")
        return [("mail_user", user, True), ("at", "@", False), ("mail_host", host, True), ("tld", "." + tld, False)]
    if kind == "phone":
        country = (re.match(r"\+[0-9]{1,3}[ .-]?", value) or [""])[0]
        return [("country", country, False), ("phone", value[len(country) :], True)]
    return [(kind, value, True)]


def canonical(kind, text):
    if kind in ("phone", "ssn", "card"):
        return re.sub("[^0-9]", "", text)
    return text.replace(" ", "") if kind == "iban" else text.lower() if kind in ("mail_user", "mail_host") else text


def poured(kind, text, s):
    if kind in ("phone", "ssn", "card", "iban"):
        own = iter(s)
        return "".join(next(own) if re.match("[0-9A-Z]", c) else c for c in text)
    if kind in ("mail_user", "mail_host") and len(s) == len(text):
        return "".join(a.upper() if re.match("[A-Z]", b) else a for a, b in zip(s, text))
    return s


def brute(texts, key="surrogate-key"):
    found = [list(PYTHON.finditer(t)) if t else [] for t in texts]
    forms = {(k, canonical(k, t)) for ms in found for m in ms for k, t, masked in pieces(m[0]) if masked and canonical(k, t)}
    listed = {n for names in P.GIVEN.values() for n in names}
    taken, out, pending = {f for f in forms if f[0] not in P.GIVEN}, {f: draw(key, *f, 0) for f in forms if f[0] in P.GIVEN}, sorted(f for f in forms if f[0] not in P.GIVEN)
    for attempt in range(P.MAX_ATTEMPTS):
        best = {}
        for kind, form in pending:
            s = draw(key, kind, form, attempt)
            if (kind, s) not in taken and not (kind == "surname" and s in listed):
                best.setdefault((kind, s), form)
        out |= {(kind, form): s for (kind, s), form in best.items()}
        taken |= set(best)
        pending = [f for f in pending if f not in out]
    assert not pending
    done = []
    for t, ms in zip(texts, found):
        at, parts = 0, []
        for m in ms:
            parts += [t[at : m.start()], *(poured(k, x, out[k, canonical(k, x)]) if masked and canonical(k, x) else x for k, x, masked in pieces(m[0]))]
            at = m.end()
        done.append((None if t is None else "".join([*parts, t[at:]]), len(ms)))
    return done, out


def test_against_brute_force(spark):
    texts = [r.text for r in sample(spark, "sf0.01").orderBy("doc_id").collect()]
    texts += [f"{t} {g} {s} and {g} {s}-Li; {g.lower()}@{s.lower()}.org, +49 {k}21 555 {1000 + k}, 4{k:03d}111111111111" for k, (t, g, s) in enumerate(
        (t, g, s) for t in ("Mr.", "Frau", "Señora") for names in P.GIVEN.values() for g in names[:6] for s in ("Li", "Иванова", "Petrov", "Bell", "Wu"))]
    rows = P.replace_pii(documents(spark, texts)).orderBy("doc_id").collect()
    want, table = brute(texts)
    assert [(r.text, r.n_entities) for r in rows] == want
    assert len({(k, s) for (k, _), s in table.items()}) == len(table) and not any(f == s for (_, f), s in table.items())


def test_surnames_keep_gender(spark):
    forms = ["Иванова", "Иванов", "Петровский", "Петровская", "Smith", "Novákova"]
    got = {r.form: r.surrogate for r in P.assign_surrogates(spark.createDataFrame([("surname", f) for f in forms], "kind string, form string"), "k").collect()}
    assert all(got[f].endswith(e) and got[f] != f for f, e in zip(forms, ("ова", "ов", "ский", "ская", "", "ova")))


def test_edges(spark):
    docs = documents(spark, ["a@b.co x", "a@b.co x", "a@b.co y", "z " * 50000 + "a@b.co"], ids=[None, 1, 1, 2]).selectExpr("*", "1 AS n_entities", "2 AS kind", "3 AS form", "4 AS _found", "5 AS _hit_th", "6 AS _pii_id", "7 AS _pii_all")
    out = P.replace_pii(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kind", "form", "_found", "_hit_th", "_pii_id", "_pii_all", "n_entities"]
    rows = out.collect()
    assert len(rows) == 4 and all(r.n_entities == 1 and "a@b.co" not in r.text for r in rows)
    assert P.replace_pii(documents(spark, [])).count() == 0
