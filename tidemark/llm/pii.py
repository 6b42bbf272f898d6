"""PII: surrogates for detected entities, with DataFrame and SQL functions only.

Detected are e-mail addresses, IPv4 addresses, payment card numbers (with a right check digit), phone numbers, IBANs, US social security numbers,
names (after a title, or of a known given name and a surname, in capitals too, with apostrophes and hyphens), private
keys, web tokens, IPv6 and MAC addresses, and secrets (access keys, and values after words such as password or token,
quoted or not). One alternation finds them all, so that of overlapping entities the first begun wins, and the
alternatives' order decides between those begun at the same place.

A surrogate is drawn by an HMAC of the entity's type and canonical form under the caller's key, so one entity gets one surrogate in every
document (coreference). It keeps the type and the format: digits become digits, letters letters of their case and
script (Latin, Greek or Cyrillic), separators stay; addresses go to reserved names and ranges; card numbers keep their
issuer digit and get a right check digit. Of a name the given name and the surname are entities of their own, so
"Mr. John Smith", "John Smith" and "Mr. Smith" keep one surname; given names keep the gender that their title or
the name itself tells (the name before the title; a title elsewhere where neither tells, so that "Dr. Kim Lee" and
"Mr. Kim Lee" are one), surnames in Cyrillic a feminine ending, both their script and capitals. Of different entities of
a type whose surrogates fall together the least form keeps its own; the others draw again, DRAWS times at most in their
own format, then from a space of about 90 bits or more (a longer value; for IPv4 the IPv6 addresses of documentation), which no number of rows exhausts. A surrogate that
is itself an entity of the corpus counts as a collision too. So the work ends after DRAWS + 1 draws, whatever the data;
if even the last draws collide, which 2^90 makes as good as impossible, an error says so.

Cases: a null text stays null with 0 entities; a text without entities is unchanged; texts are processed whole;
repeated rows are repeated; a null id is a row like others; columns of any other name pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table, unused, written

#: The key of HMAC if neither the caller nor the session (KEY_SETTING) names one: for tests and repeatable runs only.
KEY = "surrogates-1"
KEY_SETTING = "tidemark.pii.key"
#: Draws in an entity's own format before the wide one, and the wide one's symbols (of 10 to 26 values each).
DRAWS, WIDE = 3, 28
# Titles of women, of men and of both; given names that tell a name without a title.
WOMEN = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Κυρία|κα|госпожа|Госпожа|г-жа"
MEN = "Mr|Herr|Monsieur|Señor|Sr|Κύριος|κ|господин|Господин|г-н"
ANYONE = "Dr|Prof"
HER_NAMES = ["Alice", "Amanda", "Angela", "Anna", "Barbara", "Carmen", "Catherine", "Christine", "Claudia", "Elena", "Elizabeth", "Emily", "Emma", "Ingrid", "Isabel", "Jane", "Jennifer", "Jessica", "Karen", "Laura", "Linda", "Lisa", "Lucia", "Maria", "Marie", "Mary", "Michelle", "Monika", "Nancy", "Patricia", "Petra", "Sabine", "Sandra", "Sarah", "Sophie", "Susan", "Ursula", "Анна", "Елена", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Άννα", "Ελένη", "Κατερίνα", "Μαρία"]
HIS_NAMES = ["Alexander", "Andreas", "Andrew", "Antonio", "Carlos", "Charles", "Christopher", "Daniel", "David", "Edward", "Fernando", "François", "George", "Hans", "Heinrich", "James", "Jean", "John", "Jorge", "José", "Joseph", "Juan", "Klaus", "Luis", "Manuel", "Mark", "Matthew", "Michael", "Miguel", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Richard", "Robert", "Stefan", "Steven", "Thomas", "William", "Wolfgang", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Пётр", "Сергей", "Γιάννης", "Γιώργος", "Δημήτρης", "Νίκος"]
KNOWN = "|".join(HER_NAMES + HIS_NAMES)
#: A word of a name: O'Neil, Smith-Jones, SMITH, McDonald.
NAME_WORD = r"\p{Lu}(?:\p{L}|['’-](?=\p{L}))+"
# What each type looks like, in the order of precedence.
TYPES = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]{0,30}PRIVATE KEY-----",
    "jwt": r"(?<![\w.-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|(?<![A-Za-z0-9-])sk-(?=-*[A-Za-z0-9])[A-Za-z0-9-]{10,}",
    "secret": r"(?<=(?<![A-Za-z])(?i:password|passwd|secret|token|api_key|apikey)[\"']?(?:=|: ?| = )[\"']?)(?=[_.-]*[A-Za-z0-9])[A-Za-z0-9_.-]{8,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ip6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?=[A-Fa-f]{0,3}\d)[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])",
    "mac": r"(?<![\w:-])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:-])|(?<![\w:-])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\w:-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{4}(?![\d-])|(?<![\d.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ -]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": rf"(?<![\p{{L}}.-])(?:{WOMEN}|{MEN}|{ANYONE}|MRS|MS|MR|DR|PROF)\.? (?:(?:{KNOWN}) {NAME_WORD} {NAME_WORD}|{NAME_WORD}(?: {NAME_WORD})?)|(?<![\p{{L}}.-])(?=\p{{Lu}})(?i:{KNOWN}) {NAME_WORD}",
}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: What a text with an entity holds: a digit, an at sign, one of these, or one of WORDS in any case. Other texts skip
#: the patterns.
HINTS = ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "-----BEGIN ", "eyJ", "::", "MR", "MS", "DR", "PROF", "Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Κύριος", "Κυρία", "κ", "господин", "госпожа", "Господин", "Госпожа", "г-н", "г-жа"]
WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]
KNOWN_HINT = rf"(?<!\p{{L}})(?=\p{{Lu}})(?i:{KNOWN}) \p{{Lu}}"
# The names that stand in, by script; and the letters of further ones.
HERS = {"latin": ["Ada", "Berta", "Clara", "Doris", "Edith", "Flora", "Greta", "Hanna", "Irma", "Julia", "Klara", "Lotte", "Marta", "Nora", "Olga", "Paula"], "greek": ["Αγάπη", "Βάσω", "Δάφνη", "Ζωή", "Θάλεια", "Ίριδα", "Λένα", "Ρένα"], "cyrillic": ["Алла", "Вера", "Галина", "Дарья", "Жанна", "Зоя", "Инна", "Римма"]}
HIS = {"latin": ["Anton", "Bruno", "Conrad", "Dietmar", "Emil", "Felix", "Gustav", "Hugo", "Ivo", "Jakob", "Karl", "Leon", "Martin", "Nils", "Oskar", "Rolf"], "greek": ["Αλέκος", "Βασίλης", "Ηλίας", "Θωμάς", "Λευτέρης", "Μάνος", "Πέτρος", "Τάσος"], "cyrillic": ["Антон", "Борис", "Глеб", "Денис", "Егор", "Захар", "Матвей", "Роман"]}
LAST = {"latin": ["Abel", "Brand", "Corin", "Dorn", "Ebner", "Falk", "Garde", "Holm", "Iversen", "Jansen", "Keller", "Lind", "Moreau", "Norden", "Olsen", "Perrin"], "greek": ["Βλάχος", "Γκίκας", "Δούκας", "Ζέρβας", "Καράς", "Λάππας", "Μάντης", "Ράλλης"], "cyrillic": ["Белов", "Воронов", "Громов", "Дроздов", "Журавлёв", "Комаров", "Лебедев", "Соколов"]}
CONSONANTS = {"latin": "bdfgklmnprstvwz", "greek": "βγδθκλμνπρσφ", "cyrillic": "бвгдзклмнпрст"}
VOWELS = {"latin": "aeiou", "greek": "αειου", "cyrillic": "аеиоу"}


def entity_type(value: Column) -> Column:
    """The type of a found entity, by its own shape (the alternatives differ in it); none for numbers that have a card's
    form but not its check digit."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(value.startswith("-----BEGIN"), "pem")
        .when(value.rlike(r"^eyJ[\w-]+\.eyJ"), "jwt")
        .when(value.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"), "mac")
        .when(value.rlike(r"^[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]+$"), "ip6")
        .when(value.contains("@"), "email")
        .when(value.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk-"), "key")
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3}"), "iban")
        .when(value.rlike(r"^(?:\d[ -]?){14,15}\d$"), F.when(check_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.substr(digits, F.length(digits), F.lit(1)), "card").otherwise("none"))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(value.rlike(r"^[\p{L}-]+\.? \p{Lu}") & ~value.rlike("[0-9]"), "name")
        .otherwise("secret")
    )


def canonical(kind: Column, value: Column) -> Column:
    """What stays the same between ways to write an entity: case of addresses, separators of numbers. Of a private key
    its digest stands for it."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(value))
        .when(kind == "mac", F.translate(F.lower(value), "-", ":"))
        .when(kind == "pem", F.sha2(value, 256))
        .when(kind.isin("card", "iban", "ssn"), F.regexp_replace(value, "[ -]", ""))
        .when(kind == "phone", F.regexp_replace(value, r"[^\d+]", ""))
        .otherwise(value)
    )


TITLE = rf"^(?:{WOMEN}|{MEN}|{ANYONE}|MRS|MS|MR|DR|PROF)\.? "


def parts_of(kind: Column, value: Column) -> Column:
    """The (kind, form, shout) triples that get surrogates: a name's given names, if there are any, and surname, without
    regard to case; else the whole. shout: written in capitals."""
    words = F.split(F.regexp_replace(value, TITLE, ""), " ")
    pair = lambda k, f: F.struct(k.alias("kind"), f.alias("form"), F.lit(False).alias("shout"))
    lower = lambda names: [n.lower() for n in names]
    titled = F.when(value.rlike(rf"^(?:{WOMEN}|MRS|MS)\.? "), "given-f").when(value.rlike(rf"^(?:{MEN}|MR)\.? "), "given-m")

    def part(w: Column, i: Column) -> Column:
        form = F.lower(w)
        gender = F.when(form.isin(*lower(HER_NAMES)), "given-f").when(form.isin(*lower(HIS_NAMES)), "given-m").otherwise(F.coalesce(titled, F.lit("given-x")))
        return F.struct(F.when(i == F.size(words) - 1, "last").otherwise(gender).alias("kind"), form.alias("form"), ((F.length(w) > 1) & (w == F.upper(w))).alias("shout"))

    return F.when(kind != "name", F.array(pair(kind, canonical(kind, value)))).otherwise(F.transform(words, part))


def one_gender(kinds: DataFrame) -> DataFrame:
    """Given names without a gender get that which titles elsewhere give them, if these agree."""
    told = kinds.filter("kind in ('given-f', 'given-m')").groupBy("form").agg(F.min("kind").alias("told"), F.max("kind").alias("other")).filter("told = other")
    told = told.select("form", "told", F.lit("given-x").alias("kind"))
    return kinds.join(told, ["kind", "form"], "left").withColumn("kind", F.coalesce("told", "kind")).drop("told")


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a text, in hexadecimal."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def drawn(key: str, seed: Column, n: Column) -> Column:
    """At least n pseudo-random numbers of 16 bits, 16 from each HMAC."""
    numbers = lambda h: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.substr(h, k * 4 + 1, F.lit(4)), 16, 10).cast("int"))
    block = lambda i: F.flatten(F.transform(F.array(keyed(key, F.concat_ws("|", i.cast("string"), seed))), numbers))
    return F.flatten(F.transform(F.sequence(F.lit(0), (F.greatest(n, F.lit(1)) / 16).cast("int")), block))


def from_range(r: Column, first: int, n: int | Column) -> Column:
    return F.char(F.pmod(r, n if isinstance(n, Column) else F.lit(n)) + first)


def like_format(text: Column, numbers: Column) -> Column:
    """Each digit or letter of a text replaced by a drawn one of its kind, case and script."""
    letters = F.split(text, "")
    lower = F.when(text.rlike("^[0-9a-f]+$"), F.lit(6)).otherwise(F.lit(26))  # hexadecimal stays so

    def one(c, i):
        r = F.get(numbers, i)
        wide = lambda first, n: F.decode(F.encode(F.substr(F.lit("".join(chr(first + k) for k in range(n))), F.pmod(r, F.lit(n)) + 1, F.lit(1)), "utf-8"), "utf-8")
        return (
            F.when(c.rlike("[0-9]"), from_range(r, 48, 10))
            .when(c.rlike("[a-z]"), from_range(r, 97, lower))
            .when(c.rlike("[A-Z]"), from_range(r, 65, 26))
            .when(c.rlike("[α-ρσ-ω]"), wide(0x3B1, 17))
            .when(c.rlike("[Α-ΡΣ-Ω]"), wide(0x391, 17))
            .when(c.rlike("[а-я]"), wide(0x430, 32))
            .when(c.rlike("[А-Я]"), wide(0x410, 32))
            .when(c.rlike(r"\p{Ll}"), from_range(r, 97, 26))
            .when(c.rlike(r"\p{Lu}"), from_range(r, 65, 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(letters, one), "")


def check_digit(digits: Column) -> Column:
    """The Luhn digit after digits."""
    one = lambda c, i: F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 1, F.when(c.try_cast("int") > 4, c.try_cast("int") * 2 - 9).otherwise(c.try_cast("int") * 2)).otherwise(c.try_cast("int"))
    total = F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def name_surrogate(kind: Column, form: Column, attempt: Column, n: Column) -> Column:
    """A name of the form's script and the kind's gender; from the second attempt on with a second part, of four
    syllables more an attempt (3, 7, ...)."""

    def of(script: str) -> Column:
        at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.get(n, F.lit(k)), F.lit(len(values))) + 1)
        last = at(LAST[script], 0)
        if script == "cyrillic":  # feminine forms end in a
            last = F.when(form.rlike("[ая]$"), F.concat(last, F.lit("а"))).otherwise(last)
        first = F.when(kind == "last", last).when(kind == "given-f", at(HERS[script], 0)).when(kind == "given-m", at(HIS[script], 0)).otherwise(at(HERS[script] + HIS[script], 0))
        letter = lambda of_, i: F.substr(F.lit(of_[script]), F.pmod(F.get(n, i), F.lit(len(of_[script]))) + 1, F.lit(1))
        syllables = F.transform(F.sequence(F.lit(1), F.greatest(4 * attempt - 1, F.lit(1))), lambda i: F.concat(letter(CONSONANTS, 2 * i), letter(VOWELS, 2 * i + 1)))
        return F.when(attempt == 0, first).otherwise(F.concat(first, F.lit("-"), F.initcap(F.array_join(syllables, ""))))

    return F.when(form.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(form.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def core_surrogate(kind: Column, form: Column, attempt: int, n: Column) -> Column:
    """The surrogate of a canonical form, itself canonical. n: drawn numbers, WIDE + 8 more than the form has
    letters. From attempt DRAWS on it is longer by WIDE symbols."""
    wide = attempt >= DRAWS
    more = lambda first, values: F.array_join(F.transform(F.slice(n, F.length(form) + 8, WIDE), lambda r: from_range(r, first, values)), "") if wide else F.lit("")
    letters, numbers, capitals = more(97, 26), more(48, 10), more(65, 26)
    tail = F.concat(F.lit("-"), letters) if wide else F.lit("")
    digits = F.concat(F.substring(form, 1, 1), like_format(F.substr(form, F.lit(2), F.length(form) - 2), n), numbers)
    byte = lambda k: F.pmod(F.get(n, F.lit(k)), F.lit(256)).cast("string")
    group = lambda k: F.lower(F.hex(F.get(n, F.lit(k))))
    ip6 = F.concat(F.lit("2001:db8"), *[x for k in range(6) for x in (F.lit(":"), group(k))])
    first = {0: F.concat(F.lit("198."), F.element_at(F.array(F.lit("18"), F.lit("19")), F.pmod(F.get(n, F.lit(0)), F.lit(2)) + 1)), 1: F.concat(F.lit("10."), byte(0))}
    first |= {2: F.concat((F.pmod(F.get(n, F.lit(3)), F.lit(15)) + 240).cast("string"), F.lit("."), byte(0))}
    ip = ip6 if wide else F.concat(first[attempt], F.lit("."), byte(1), F.lit("."), byte(2))
    mac = F.concat(F.lit("02"), *[F.concat(F.lit(":"), F.lower(F.lpad(F.hex(F.pmod(F.get(n, F.lit(k)), F.lit(256))), 2, "0"))) for k in range(13 if wide else 5)])
    phone = F.concat(F.regexp_extract(form, r"^(\+\d)", 1), like_format(F.regexp_replace(form, r"^\+\d", ""), n), numbers)
    iban = F.concat(F.substring(form, 1, 2), like_format(F.substr(form, F.lit(3), F.length(form)), n), capitals)
    prefix = F.regexp_extract(form, r"^(AKIA|ASIA|gh[pousr]_|sk-)", 1)
    mail = F.concat(F.lit("@mail"), F.pmod(F.get(n, F.length(form)), F.lit(10000)).cast("string"), F.lit(".example.org"))
    return (
        F.when(kind == "email", F.concat(like_format(F.regexp_extract(form, "^([^@]*)@", 1), n), tail, mail))
        .when(kind == "ip", ip)
        .when(kind == "ip6", ip6)
        .when(kind == "mac", mac)
        .when(kind == "card", F.concat(digits, check_digit(digits)))
        .when(kind.startswith("given-") | (kind == "last"), name_surrogate(kind, form, F.lit(attempt + wide), n))
        .when(kind == "phone", phone)
        .when(kind == "iban", iban)
        .when(kind == "ssn", F.concat(like_format(form, n), numbers))
        .when(kind == "pem", like_format(form, n))
        .when(kind == "key", F.concat(prefix, like_format(F.substr(form, F.length(prefix) + 1, F.length(form)), n), letters))
        .when(kind == "jwt", F.concat(F.lit("eyJ"), like_format(F.substr(form, F.lit(4), F.length(form)), n), letters))
        .otherwise(F.concat(like_format(form, n), tail))
    )


def in_form(kind: Column, value: Column, core: Column) -> Column:
    """A canonical surrogate written the way the entity was: its separators at their places, what is longer after it."""
    spaced = F.array_join(
        F.aggregate(
            F.split(value, ""),
            F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("at")),
            lambda a, c: F.when(c.rlike("[A-Za-z0-9+]"), F.struct(F.array_append(a["out"], F.substr(core, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.array_append(a["out"], c).alias("out"), a["at"].alias("at"))),
            lambda a: F.array_append(a["out"], F.substr(core, a["at"], F.greatest(F.length(core) - a["at"] + 1, F.lit(0)))),
        ),
        "",
    )
    pem = F.concat(F.regexp_extract(value, r"^(-----BEGIN [A-Z ]*-----)", 1), F.lit("\n"), core, F.lit("\n"), F.regexp_extract(value, r"(-----END [A-Z ]*-----)$", 1))
    mac = F.when(value.contains("-"), F.translate(core, ":", "-")).otherwise(core)
    return F.when(kind.isin("card", "iban", "ssn", "phone"), spaced).when(kind == "pem", pem).when(kind == "mac", mac).otherwise(core)


def surrogates(s: Scratch, entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, core): distinct entities with distinct surrogates, without regard to case. Those that collide draw
    again, the last time from the wide space; each draw's winner is the least form, so all machines agree."""
    known = s.write(entities.select("kind", "form").distinct(), "entities")
    left, taken = known, known.select("kind", F.lower("form").alias("lower"))
    settled: DataFrame | None = None
    for attempt in range(DRAWS + 1):
        numbers = drawn(key, F.concat_ws("|", F.lit(str(attempt)), F.col("kind"), F.col("form")), F.length("form") + WIDE + 12)
        # Written, so that a form's numbers are drawn once and not for each of its letters.
        drew = s.write(left.withColumn("numbers", numbers), "numbers")
        core = core_surrogate(F.col("kind"), F.col("form"), attempt, F.col("numbers"))
        made = s.write(drew.select("kind", "form", core.alias("core")).withColumn("lower", F.lower("core")), "made")
        firsts = made.groupBy("kind", "lower").agg(F.min(F.struct("form", "core")).alias("first")).select("kind", "lower", "first.*")
        free = s.write(firsts.join(taken, ["kind", "lower"], "left_anti").select("kind", "lower", "form", "core"), "free")
        won = free.select("kind", "form", "core")
        settled = won if settled is None else settled.union(won)
        taken = taken.union(free.select("kind", "lower"))
        left = s.write(made.join(free, ["kind", "form"], "left_anti").select("kind", "form"), "left")
        s.drop(drew, made)
        if not left.limit(1).count():
            return settled
    raise RuntimeError("surrogates of the wide space collide")


def replace_pii(docs: DataFrame, key: str | None = None, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """All columns of docs, the text with surrogates in place of entities, and n_entities. Texts without
    digits, at signs or hints stay out of the shuffle; the others are cut once, written, and meet their surrogates by a
    hash of their id and text."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text = F.col(text_column)
    maybe = text.rlike("[0-9@]")
    for hint in HINTS:
        maybe = maybe | text.contains(hint)
    for word in WORDS:
        maybe = maybe | F.lower(text).contains(word)
    maybe = maybe | text.rlike(KNOWN_HINT)
    row, parts, new, flag = (unused(x, docs) for x in ("_row", "_parts", "_new", "_maybe"))
    marked = docs.withColumn(flag, F.coalesce(maybe, F.lit(False)))
    clean = marked.filter(~F.col(flag)).drop(flag).withColumn("n_entities", F.lit(0))
    # A mark that the text doesn't hold: a control character, with the text's hash after it if need be.
    mark = F.when(text.contains("\x01"), F.concat(F.lit("\x01"), F.md5(text), F.lit("\x01"))).otherwise(F.lit("\x01"))
    pieces = F.split(F.regexp_replace(text, F.lit(ANY), F.concat(mark, F.lit("$0"), mark)), mark)
    cut = written(marked.filter(flag).drop(flag).withColumns({row: F.xxhash64(id_column, text_column), parts: pieces}), "pii-parts")
    values = F.filter(parts, lambda _, i: i % 2 == 1)
    with Scratch(docs.sparkSession, "pii") as s:
        found = s.write(cut.select(F.col(row).alias("row"), F.explode(F.array_distinct(values)).alias("value")).distinct(), "found")
        kinds = s.write(one_gender(found.select("value").distinct().withColumn("type", entity_type(F.col("value"))).filter("type <> 'none'").select("value", "type", F.posexplode(parts_of(F.col("type"), F.col("value"))).alias("n", "part")).select("value", "type", "n", "part.*")), "parts")
        cores = kinds.join(surrogates(s, kinds, key), ["kind", "form"]).withColumn("core", F.when(F.col("shout"), F.upper("core")).otherwise(F.col("core")))
        in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "core"))), lambda x: x["core"]), " ")
        spoken = cores.groupBy("value", "type").agg(in_order.alias("core")).select("value", F.when(F.col("type") == "name", F.concat(F.regexp_extract("value", TITLE, 0), "core")).otherwise(in_form(F.col("type"), F.col("value"), F.col("core"))).alias("new"))
        said = found.join(s.write(spoken, "spoken"), "value")
        by_row = s.finish(said.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias(new)))
    joined = cut.join(by_row, row, "left")
    is_entity = lambda x, i: (i % 2 == 1) & F.col(new)[x].isNotNull()
    whole = F.array_join(F.transform(parts, lambda x, i: F.when(is_entity(x, i), F.col(new)[x]).otherwise(x)), "")
    done = joined.withColumn(text_column, whole).withColumn("n_entities", F.size(F.filter(parts, is_entity)))
    return clean.unionByName(done.drop(row, parts, new))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = replace_pii(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_entities", "text")
