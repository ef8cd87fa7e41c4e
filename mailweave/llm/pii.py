"""PII surrogates: detected entities get keyed, type-consistent replacements (native).

Detected are e-mail addresses, IPv4 and IPv6 addresses, card, account (IBAN),
social-security and phone numbers, secrets (long hex strings and tokens with
well-known prefixes) and names of persons (after a form of address, or a known
given name before a family name, in Latin or Cyrillic script).

A surrogate is a function of the secret key, the entity's type and its canonical
value, so every mention of an entity gets the same one in all documents. It keeps
the format: character classes, script and length, separators as in each mention, the
first digit and check digit of cards, country prefixes of phones and IBANs and an IBAN's
check digits, the private ranges of IPv4, which groups of an IPv6 address are zero and
how they are written, token prefixes, the last label of a mail domain, letter case
of upper-case mentions. A name's parts are replaced one by one: a given name by
one of the same gender and script, a family name by an invented one of the same
script, so that "Anna Berg" and "Ms Berg" still share a name. A given name's gender
is that of the lists, else of most of the titled mentions of that name in all documents.

Distinctness: surrogates of a type (given names of one script are one) are checked
against each other and against the type's real values; of a collision all but the
smallest value are drawn again until none is left (after ``SHORT`` draws with one more
character each); what is settled is not looked at again but as what others may not be.

Defined cases: a null text stays null; a text without entities is unchanged; a
mention that fits several types takes the first in ``TYPES``; rows equal in
doc_id and text are treated alike; a null doc_id is an id of its own; an empty
table gives no rows; other columns pass through ``keep`` or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KEY = "surrogate-key-1"
SHORT = 8

#: Forms of address by gender (fixed values).
TITLES_M = ("Mr", "Herr", "Señor", "Monsieur", "господин", "г-н")
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "госпожа", "г-жа")
TITLES_U = ("Dr", "Prof")

#: Given names by gender and script (fixed values).
GIVEN_F = ("Alice", "Andrea", "Anna", "Barbara", "Beatriz", "Camille", "Carmen", "Caroline", "Catherine", "Charlotte",
           "Christine", "Claire", "Claudia", "Daniela", "Elizabeth", "Emily", "Emma", "Franziska", "Gabriela", "Hannah",
           "Helen", "Isabel", "Jennifer", "Jessica", "Julia", "Katharina", "Laura", "Linda", "Louise", "Lucia", "Margaret",
           "Maria", "Marie", "Mary", "Monika", "Nicole", "Olivia", "Patricia", "Petra", "Rachel", "Sabine", "Sandra", "Sarah",
           "Sofia", "Sophie", "Susan", "Teresa", "Ursula", "Victoria")
GIVEN_M = ("Alejandro", "Alexander", "Andrew", "Antonio", "Benjamin", "Carlos", "Charles", "Christian", "Christopher",
           "Daniel", "David", "Diego", "Edward", "Fernando", "François", "George", "Hans", "Henry", "Jacques", "James",
           "Javier", "Jean", "John", "Jorge", "José", "Joseph", "Juan", "Jürgen", "Klaus", "Lucas", "Luis", "Manuel", "Mark",
           "Martin", "Matthew", "Michael", "Miguel", "Nicolas", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard",
           "Robert", "Stefan", "Thomas", "William", "Wolfgang")
GIVEN_F_CYRILLIC = ("Анна", "Валентина", "Вера", "Галина", "Екатерина", "Елена", "Ирина", "Людмила", "Мария", "Надежда",
                    "Наталья", "Ольга", "Светлана", "Татьяна")
GIVEN_M_CYRILLIC = ("Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Олег",
                    "Павел", "Пётр", "Сергей", "Юрий")
#: Syllables of invented family names (fixed values).
SYLLABLES = ("bal", "ben", "cor", "dal", "den", "dor", "fal", "fen", "gar", "gol", "hal", "har", "kel", "kor", "lan", "lin",
             "mar", "mel", "mor", "nar", "nel", "pal", "per", "ral", "ren", "sal", "sor", "tal", "ter", "val", "ver", "wil")
SYLLABLES_CYRILLIC = ("бал", "бен", "вор", "гал", "дан", "дор", "зел", "кал", "кор", "лан", "мал", "мер", "нар", "пал", "рен", "тал")

_ANY = lambda names: "(?:" + "|".join(names) + ")"
_L = r"\p{L}\p{N}"
#: Possessive groups are matched in a loop; others would recurse once a label, and a long run of labels ends the JVM.
_LABEL = rf"[{_L}]++(?:-++[{_L}]++)*+"
EMAIL = rf"(?<![{_L}._%+\-])[{_L}][{_L}._%+\-]*+@{_LABEL}(?:\.{_LABEL})++"
_H = "[0-9A-Fa-f]{1,4}"
#: Compressed forms: n groups before ``::`` and at most 7 - n after it.
_SHORT6 = "|".join([f"::{_H}(?::{_H}){{0,6}}"] + [f"(?:{_H}:){{{n}}}:(?:{_H}(?::{_H}){{0,{6 - n}}})?" for n in range(1, 7)]
                   + [f"(?:{_H}:){{7}}:"])
IPV6 = (r"(?:(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Fa-f:])"
        rf"|(?<![{_L}:._])(?:{_SHORT6})(?![{_L}:_]|\.[0-9]))")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
SECRET = (r"(?<![0-9A-Za-z_\-])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}"
          r"|sk-[0-9A-Za-z\-]{20,}|xox[abprs]-[0-9A-Za-z\-]{10,}|eyJ[0-9A-Za-z_\-]+\.eyJ[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+)(?![0-9A-Za-z_])")
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
CARD = r"(?<![0-9A-Za-z.+\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]|[.\-][0-9])"
PHONE = (r"(?:(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .\-]?\(?[0-9]{1,4}\)?){2,5}"
         r"|(?<![0-9A-Za-z.\-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}"
         r"|(?<![0-9A-Za-z.\-])0[0-9]{1,4}[ /\-][0-9]{3,4}[ \-]?[0-9]{3,5})(?![0-9A-Za-z]|[.\-][0-9])")
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_TITLED = rf"(?<!\p{{L}}){_ANY(TITLES_M + TITLES_F + TITLES_U)}(?!\p{{L}})\.?(?: Dr\.?)? {_NAME}(?: {_NAME}){{0,2}}"
_GIVEN = rf"(?<!\p{{L}})(?=\p{{Lu}}){_ANY(GIVEN_F + GIVEN_M + GIVEN_F_CYRILLIC + GIVEN_M_CYRILLIC)}(?: (?:{_NAME}|\p{{Lu}}\.))?(?: {_NAME})"
PERSON = f"(?:{_TITLED}|{_GIVEN})"

TYPES = (("email", EMAIL), ("ipv6", IPV6), ("ipv4", IPV4), ("secret", SECRET), ("iban", IBAN), ("ssn", SSN),
         ("card", CARD), ("phone", PHONE), ("person", PERSON))
PATTERN = "(?:" + "|".join(p for _, p in TYPES) + ")"
#: What every entity contains; one cheap pass tells most clean texts.
HINT = rf"[0-9@]|::|[A-Fa-f]:[A-Fa-f]{{1,4}}:|(?<![A-Za-z_\-])(?:sk-|xox[abprs]-|gh[pousr]_|AKIA|eyJ|[a-f]{{32}}|[A-F]{{32}})|(?<!\p{{L}})(?=[\p{{Lu}}г]){_ANY(TITLES_M + TITLES_F + TITLES_U + GIVEN_F + GIVEN_M + GIVEN_F_CYRILLIC + GIVEN_M_CYRILLIC + ('господин', 'госпожа'))}(?!\p{{L}})"


def type_of(mention: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed(TYPES[:-1]):
        out = F.when(mention.rlike(f"^{pattern}$"), name).otherwise(out)
    return out


def _groups(half: Column) -> Column:
    return F.array_remove(F.split(half, ":"), "")


def six_groups(address: Column) -> Column:
    """The eight groups of an IPv6 address in lower case without leading zeros."""
    low = F.lower(address)
    left, right = _groups(F.substring_index(low, "::", 1)), F.when(F.contains(low, F.lit("::")), _groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0{1,3}(?=.)", ""))


def canonical(kind: Column, mention: Column) -> Column:
    """Value that all spellings of an entity share."""
    return (F.when(kind.isin("card", "ssn"), F.regexp_replace(mention, "[^0-9]", ""))
            .when(kind == "phone", F.regexp_replace(mention, "[^0-9+]", ""))
            .when(kind == "iban", F.regexp_replace(mention, " ", ""))
            .when(kind == "email", F.lower(mention))
            .when(kind == "ipv6", F.array_join(six_groups(mention), ":"))
            .otherwise(mention))


def name_atoms(mention: Column) -> Column:
    """array<struct(kind, canon, word, vote)> of a person's mention: forms of address and
    initials keep (kind null), the last name is the family name, others are given names.
    ``vote``: 1 for a woman's, -1 for a man's, by the mention; 1000 times that by the lists."""
    words = F.split(mention, " ")
    title = lambda w, names: F.regexp_replace(w, r"\.$", "").isin(*names)
    every = TITLES_M + TITLES_F + TITLES_U
    female, male = F.exists(words, lambda w: title(w, TITLES_F)), F.exists(words, lambda w: title(w, TITLES_M))

    def atom(w, i):
        script = F.when(w.rlike(r"\p{IsCyrillic}"), "c").otherwise("l")
        listed = F.when(w.isin(*GIVEN_F, *GIVEN_F_CYRILLIC), 1000).when(w.isin(*GIVEN_M, *GIVEN_M_CYRILLIC), -1000)
        vote = F.coalesce(listed, female.cast("int") - male.cast("int"))
        last = i == F.size(words) - 1
        bare = F.when(script == "c", F.regexp_replace(F.lower(w), "(ов|ев|ин)а$", "$1")).otherwise(F.lower(w))
        kind = (F.when(title(w, every) | w.rlike(r"^\p{Lu}\.$"), F.lit(None).cast("string"))
                .when(last, F.concat(F.lit("family_"), script)).otherwise(F.concat(F.lit("given_"), script)))
        return F.struct(kind.alias("kind"), F.when(last, bare).otherwise(F.lower(w)).alias("canon"), w.alias("word"), vote.alias("vote"))
    return F.transform(words, atom)


def stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """512 keyed hex digits of an entity's draw."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")).cast("binary"), 512) for i in range(4)])


def _byte(s: Column, i: Column) -> Column:
    return F.conv(F.substr(s, 2 * (i % 250) + 1, F.lit(2)), 16, 10).cast("int")


#: Character classes and the letters that stand for theirs (fixed values); for letters of other scripts a to z do.
LETTERS = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
           (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"), (r"\p{IsCyrillic}", "абвгдежзийклмнопрстуфхцчшщъыьэюя"),
           (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
           (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
           (r"\p{IsHan}", "一二三四五六七八九十人口山川日月木水火土"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alike(value: Column, s: Column) -> Column:
    """Every digit and letter replaced inside its class and script, everything else kept."""
    def one(c, i):
        letters = F.lit("")
        for kind, own in reversed(LETTERS):
            letters = F.when(c.rlike(f"^{kind}$"), own).otherwise(letters)
        return _let(letters, lambda x: F.when(x == "", c).otherwise(F.substr(x, _byte(s, i) % F.greatest(F.length(x), F.lit(1)) + 1, F.lit(1))))
    return F.array_join(F.transform(F.split(value, ""), one), "")


def six_alike(canon: Column, s: Column, attempt: Column) -> Column:
    """Groups of an IPv6 address that are not zero get other digits; after ``SHORT`` draws all groups do."""
    def one(g, i):
        x = F.substr(s, i * 4 + 1, F.lit(4))
        first = F.regexp_replace(F.substr(x, F.lit(1), F.lit(1)), "0", "f")
        new = F.concat(first, F.substr(x, F.lit(2), F.when(attempt >= SHORT, 3).otherwise(F.length(g) - 1)))
        return F.when((g == "0") & (attempt < SHORT), g).otherwise(new)
    return F.array_join(F.transform(F.split(canon, ":"), one), ":")


def six_spelled(word: Column, fake: Column) -> Column:
    """An address's surrogate with the zeros, the gap and the widths of a mention; in
    full where the mention's gap hides groups that are not zero in the surrogate."""
    groups = F.split(fake, ":")
    left, right = _groups(F.substring_index(word, "::", 1)), _groups(F.substring_index(word, "::", -1))
    put = lambda old, at: F.lpad(F.get(groups, at), F.greatest(F.length(F.get(groups, at)), F.when(old.rlike("^0."), F.length(old)).otherwise(1)), "0")
    own = F.array_join(F.transform(left, lambda g, i: put(g, i)), ":")
    gap = F.concat(own, F.lit("::"), F.array_join(F.transform(right, lambda g, i: put(g, F.lit(8) - F.size(right) + i)), ":"))
    hidden = F.slice(groups, F.size(left) + 1, F.lit(8) - F.size(left) - F.size(right))
    return F.when(~F.contains(word, F.lit("::")), own).when(F.exists(hidden, lambda g: g != "0"), fake).otherwise(gap)


def iban_rest(digits: Column) -> Column:
    """An IBAN, its first four characters moved to the end, modulo 97."""
    def add(total, c):
        return F.when(c.rlike("^[0-9]$"), (total * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(F.concat(F.substr(digits, F.lit(5)), F.substr(digits, F.lit(1), F.lit(4))), ""), F.lit(0), add)


def hex_alike(value: Column, s: Column) -> Column:
    """Every hex digit replaced by another hex digit in the value's letter case."""
    def one(c, i):
        x = F.substr(s, i % 500 + 1, F.lit(1))
        return F.when(c.rlike("^[0-9A-Fa-f]$"), x).otherwise(c)
    out = F.array_join(F.transform(F.split(value, ""), one), "")
    return F.when(value.rlike("[A-F]"), F.upper(out)).otherwise(out)


def luhn(digits: Column, check_last: bool) -> Column:
    """Sum of the digits, every second one from the right doubled (the last one too if it is not the check digit)."""
    d = F.reverse(F.split(digits, ""))
    odd = 1 if check_last else 0

    def add(total, x):
        v = x["v"].cast("int")
        twice = F.when(x["i"] % 2 == odd, v * 2).otherwise(v)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)
    return F.aggregate(F.transform(d, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), F.lit(0), add)


def _choose(names: tuple[str, ...], s: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]),
                        F.conv(F.substr(s, F.lit(at + 1), F.lit(6)), 16, 10).cast("int") % len(names) + 1)


def surrogate(key: str, kind: Column, canon: Column, attempt: Column, vote: Column) -> Column:
    """Canonical surrogate of an entity's draw; ``vote`` tells a given name's gender."""
    return _let(stream(key, kind, canon, attempt), lambda s: _surrogate(key, s, kind, canon, attempt, vote))


def _surrogate(key: str, s: Column, kind: Column, canon: Column, attempt: Column, vote: Column) -> Column:
    more = F.when(attempt >= SHORT, alike(F.repeat(F.lit("0"), attempt - SHORT + 1), F.reverse(s))).otherwise("")
    at = F.instr(canon, "@")
    domain = F.substr(canon, at + 1)
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    ds = stream(key, F.lit("domain"), domain, F.lit(0))
    email = F.concat(alike(F.substr(canon, F.lit(1), at - 1), s), more, F.lit("@"), _let(ds, lambda d: alike(host, d)), F.lit("."),
                     F.substring_index(domain, ".", -1))
    octet = lambda i, lo, n: (_byte(s, F.lit(i)) % n + lo).cast("string")
    private = F.regexp_extract(canon, r"^(10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 1)
    ipv4 = (F.when(canon.startswith("10."), F.concat_ws(".", F.lit("10"), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254)))
            .when(private != "", F.concat(private, octet(2, 0, 256), F.lit("."), octet(3, 1, 254)))
            .otherwise(F.concat_ws(".", octet(0, 11, 89), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))))
    digits = alike(canon, s)
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2), F.length(canon) - 2), more)
    check = ((10 - luhn(body, False) % 10) % 10).cast("string")
    valid = luhn(canon, True) % 10 == 0
    card = F.concat(body, F.when(valid, check).otherwise(F.substr(digits, F.length(canon))))
    lead = F.regexp_extract(canon, r"^(\+[17]|\+[2-9][0-9]|0)", 1)
    phone = F.concat(lead, F.substr(digits, F.length(lead) + 1), more)
    country, tail = F.substr(canon, F.lit(1), F.lit(2)), F.concat(F.substr(digits, F.lit(5)), more)
    control = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), tail))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(iban_rest(canon) == 1, control).otherwise(F.substr(digits, F.lit(3), F.lit(2))), tail)
    prefix = F.regexp_extract(canon, r"^(AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", 1)
    secret = F.concat(F.when(canon.rlike("^[0-9A-Fa-f]+$"), hex_alike(canon, s))
                      .otherwise(F.concat(prefix, alike(F.substr(canon, F.length(prefix) + 1), s))), more)
    given = F.lit(None).cast("string")
    for tag, women, men in (("l", GIVEN_F, GIVEN_M), ("c", GIVEN_F_CYRILLIC, GIVEN_M_CYRILLIC)):
        drawn = lambda names: F.concat_ws("-", *[F.when(attempt >= 2 * i, _choose(names, s, 6 * i)) for i in range(8)])
        given = F.when(kind == f"given_{tag}", F.when(vote > 0, drawn(women)).when(vote < 0, drawn(men)).otherwise(drawn(women + men))).otherwise(given)
    for tag, names in (("l", SYLLABLES), ("c", SYLLABLES_CYRILLIC)):
        parts = [F.when(attempt >= max(0, 2 * (i - 2)), _choose(names, s, 6 * i)) for i in range(10)]
        ending = F.lit("ов") if tag == "c" else F.lit("")
        given = F.when(kind == f"family_{tag}", F.initcap(F.concat(F.concat_ws("", *parts), ending))).otherwise(given)
    return (F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "ipv6", six_alike(canon, s, attempt))
            .when(kind == "card", card).when(kind == "ssn", F.concat(digits, more)).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "secret", secret).otherwise(given))


def entity_table(mentions: DataFrame, key: str, name: str) -> DataFrame:
    """(kind, canon, fake): one distinct surrogate for each distinct entity. Draws that
    no value and no settled surrogate equals are settled, of equal ones the smallest
    value's; only the others are drawn again."""
    drawn = lambda df: df.withColumn("fake", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"), F.col("vote")))
    found = mentions.where("kind is not null").groupBy("kind", "canon").agg(F.sum("vote").alias("vote"))
    found = staged(found.withColumn("attempt", F.lit(0)), f"{name}_entities")
    taken = found.select(F.col("kind").alias("_k"), F.lower("canon").alias("_f"))     # what no surrogate may be
    settled, open_ = None, staged(drawn(found), f"{name}_draw")
    while True:
        first = open_.groupBy(F.col("kind").alias("_kind"), F.lower("fake").alias("_fake")).agg(F.min("canon").alias("_first"))
        told = open_.join(first, (F.col("kind") == F.col("_kind")) & (F.lower("fake") == F.col("_fake")))
        told = told.join(taken.withColumn("_hit", F.lit(True)).distinct(), (F.col("kind") == F.col("_k")) & (F.lower("fake") == F.col("_f")), "left")
        told = staged(told.select("kind", "canon", "vote", "attempt", "fake", (F.col("_hit").isNull() & (F.col("_first") == F.col("canon"))).alias("_own")),
                      f"{name}_told")
        own = told.where("_own").select("kind", "canon", "fake")
        settled = own if settled is None else settled.union(own)
        if told.where("not _own").isEmpty():
            return settled
        taken = taken.union(own.select("kind", F.lower("fake")))
        open_ = staged(drawn(told.where("not _own").select("kind", "canon", "vote", (F.col("attempt") + 1).alias("attempt"))), f"{name}_draw")


def spelled(kind: Column, word: Column, fake: Column) -> Column:
    """The surrogate in the spelling of a mention: its separators, its letter case."""
    plain = F.regexp_replace(word, F.when(kind == "phone", "[^0-9+]").when(kind == "iban", "[ ]").otherwise("[^0-9]"), "")
    mark = lambda c: F.when(kind == "phone", c.rlike("[0-9+]")).when(kind == "iban", c != " ").otherwise(c.rlike("[0-9]"))
    chars = F.split(word, "")
    order = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: mark(x))))
    laid = F.array_join(F.zip_with(chars, order, lambda c, n: F.when(mark(c), F.substr(fake, n, F.lit(1))).otherwise(c)), "")
    laid = F.concat(laid, F.substr(fake, F.length(plain) + 1))
    woman = word.rlike("(?:ова|ева|ина)$") & kind.startswith("family_c")
    named = F.when(woman, F.concat(fake, F.lit("а"))).otherwise(fake)
    named = F.when(kind == "ipv6", six_spelled(word, fake)).otherwise(named)
    same = F.when((F.upper(word) == word) & (F.lower(word) != word) & ~kind.isin("secret"), F.upper(named)).otherwise(named)
    return F.when(kind.isin("card", "ssn", "phone", "iban"), laid).otherwise(same)


def replacements(docs: DataFrame, key: str, name: str) -> DataFrame:
    """(_id, _hash, fakes): the replacement of each mention, in order, of every text that has some."""
    text = F.col("text")
    hit = docs.where(text.rlike(HINT)).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"),
                                              F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("m"))
    at = hit.select("_id", "_hash", F.posexplode("m").alias("pos", "mention")).distinct()
    at = at.withColumn("type", type_of(F.col("mention")))
    whole = F.array(F.struct(F.col("type").alias("kind"), canonical(F.col("type"), F.col("mention")).alias("canon"),
                             F.col("mention").alias("word"), F.lit(0).alias("vote")))
    atoms = F.when(F.col("type") == "person", name_atoms(F.col("mention"))).otherwise(whole)
    at = at.select("_id", "_hash", "pos", F.posexplode(atoms).alias("part", "a")).select("_id", "_hash", "pos", "part", "a.*")
    at = staged(at, f"{name}_mentions")
    table = entity_table(at, key, name)
    done = at.join(table, ["kind", "canon"], "left")
    word = F.when(F.col("fake").isNull(), F.col("word")).otherwise(spelled(F.col("kind"), F.col("word"), F.col("fake")))
    joined = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "w"))), lambda x: x["w"])
    done = done.select("_id", "_hash", "pos", "part", word.alias("w")).groupBy("_id", "_hash", "pos").agg(F.array_join(joined("part"), " ").alias("w"))
    return done.groupBy("_id", "_hash").agg(joined("pos").alias("fakes"))


#: Bits of the map of texts that have an entity (16 MB, in pieces of 4 KB).
MAP_BITS = 1 << 27


def split_by(docs: DataFrame, fakes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose text may have replacements, rows whose text has none), by a bitmap of
    fixed size that is broadcast: clean texts are neither matched again nor shuffled."""
    place = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(MAP_BITS))
    bits = (fakes.select(place("_id", "_hash").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_piece"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits")))
    docs = docs.withColumn("_own", F.xxhash64("text")).withColumn("_place", place("doc_id", "_own"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = (docs.withColumn("_piece", F.bitmap_bucket_number("_place")).join(F.broadcast(bits), "_piece", "left")
            .withColumn("_may", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_piece", "_bits", "_place"))
    return told.where("_may").drop("_may"), told.where("not _may").drop("_may")


def replaced(docs: DataFrame, key: str = KEY, keep: tuple[str, ...] = (), name: str = "pii") -> DataFrame:
    """(doc_id, ``keep``, text, n_entities) of every document, its entities replaced. The
    pattern of all types passes over a text twice: to find its mentions, and to put the surrogates in."""
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "text", "n_entities"))
    fakes = staged(replacements(docs, key, name), f"{name}_fakes")
    may, clean = split_by(docs.select("doc_id", "text", *[F.col(c).alias(f"_keep_{c}") for c in keep]), fakes)
    kept = [F.col(f"_keep_{c}").alias(c) for c in keep]
    clean = clean.select("doc_id", *kept, "text", F.lit(0).cast("long").alias("n_entities"))
    hit = may.join(fakes, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    parts = F.zip_with(F.split("text", PATTERN, -1), F.col("fakes"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    new = F.when(F.col("fakes").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    return clean.union(hit.select("doc_id", *kept, new.alias("text"), F.when(F.col("fakes").isNull(), 0).otherwise(F.size("fakes")).cast("long").alias("n_entities")))
