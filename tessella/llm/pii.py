"""Surrogates for personal data; DataFrame functions only.

E-mail addresses, phone numbers, IP addresses (both versions), payment-card numbers, bank accounts (IBAN with right check digits)
and persons named after a title are found by patterns and replaced. A surrogate is a keyed digest of the entity's normal form spelled in the entity's own format: digits
become digits and letters letters of the same case and script, separators stay; octets of an address stay below 256, card
numbers keep a valid check digit if they had one, accounts their country and valid check digits.

A person is found by a title, academic ones included, with initials, particles, hyphens, apostrophes and capitals. The last word
is the family name, a word before it the given name, and each is an entity of its own kind: so ``Mr. John Smith``, ``Mr. Smith`` and
``SMITH`` share the surrogate of the family name. Every other mention of a found name in the same document, a whole capitalised word,
is replaced too, titled or not, before or after. Given names follow the title's gender; after a title without gender that of the same
name elsewhere, else they get a name of either gender. Surrogates are in the script of the name (Latin, Greek or Cyrillic, there with the family name's
feminine form; other scripts get Latin names) and in capitals where the name is. Initials and particles stay.

Phone numbers are found in these forms: ``+`` or ``00`` and a country code with groups of 2 to 4 digits, or one digit and four
pairs; North American numbers of 3, 3 and 4 digits; French ones of five pairs; Spanish ones of nine digits in groups; German and
British ones with a leading 0, an area of 3 to 6 digits in all and a subscriber of 4 digits or more. National numbers without any separator are found only
if they are French (ten digits from 0 on), and a number's national and international spelling count as two entities.

The same entity gets the same surrogate everywhere (coreference); an attempt number, part of the digest, keeps different
entities apart: all surrogates are compared, with each other and with the entities that occur. Of those that collide the smallest entity
keeps its surrogate, unless it is an entity itself; the others, and only they, try again against all that is taken. An entity that
collides after ``RELAXED`` attempts may take a longer form, and after ``COUNTED`` attempts its surrogate ends with a number that
no other has, so that this ends however many entities there are.

Patterns start at the first character of a run and never go back over repeated groups, so their cost is linear in a text of any
length and shape.

Defined results: null texts stay null and have no entities; empty tables give empty results; overlapping entities: the one that begins first, then the one
of the kind listed first, is replaced; repeated rows give repeated results; extra columns are kept by :func:`pseudonymise`, but for those named
like its counts, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table
from .spans import let, places, replaced, scanned

KINDS = ["email", "phone", "ip", "card", "man", "woman", "national", "ip6", "account", "either", "family", "feminine"]
# A run of signs before the address belongs to the match and is cut off afterwards.
EMAIL = r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*+[A-Za-z0-9])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_SEP = r"[ .\u00A0\u202F/-]"
PHONE = (
    r"(?<![0-9A-Za-z])\+(?:"
    rf"[0-9]{{1,3}}{_SEP}?(?:\(0\){_SEP}?)?[1-9](?:{_SEP}?[0-9]{{2}}){{4}}(?![0-9])"  # an area of one digit and four pairs
    rf"|[0-9]{{1,3}}{_SEP}?(?:\(0\){_SEP}?)?\(?[0-9]{{2,4}}\)?(?:{_SEP}?[0-9]{{2,4}}){{2,3}}(?![0-9]))"
)
_ABROAD = rf"00[1-9][0-9]{{0,2}}{_SEP}(?:\(0\){_SEP}?)?\(?[0-9]{{1,5}}\)?(?:{_SEP}?[0-9]{{2,4}}){{2,4}}(?![0-9A-Za-z])"  # 00 for +
# Without a country code; a number that follows one is PHONE's. Separators inside a number of fixed groups are all the same.
NATIONAL = (
    r"(?<![0-9A-Za-z+])(?<!\+[0-9]{1,3}[ .\u00A0\u202F/-]?)(?<![0-9][.,])(?:"
    rf"(?:1{_SEP})?(?:\([2-9][0-9]{{2}}\){_SEP}?|[2-9][0-9]{{2}}{_SEP})[0-9]{{3}}{_SEP}[0-9]{{4}}"  # North America
    rf"|0[1-9]({_SEP}?)[0-9]{{2}}(?:\1[0-9]{{2}}){{3}}"  # France
    r"|[6-9][0-9]{2}([ \u00A0\u202F-])(?:[0-9]{3}\2[0-9]{3}|[0-9]{2}\2[0-9]{2}\2[0-9]{2})|9[0-9]([ \u00A0\u202F-])[0-9]{3}\3[0-9]{2}\3[0-9]{2}"  # Spain
    rf"|\(?0[1-9][0-9]{{1,4}}(?:\) ?/? ?| ?[/-] ?|{_SEP})[0-9]{{2,4}}(?:{_SEP}?[0-9]{{2,4}}){{1,3}}"  # Germany, United Kingdom
    rf"|{_ABROAD}"
    r")(?![0-9A-Za-z])"
)
IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])"
CARD = rf"(?<![0-9])(?!{_ABROAD})" + r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
# Titles of men, of women and of either.
_MR, _MRS = "Mr|Herrn?|Monsieur|Señor|Sr|господин|г-н|κύριος|κ", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|госпожа|г-жа|κυρία|κα"
_DR = "Dr|Dra|Prof|Professor|Professorin|Doctor|Docteur|Доктор|Профессор"
_PARTICLES = "(?:(?:von|van|zu|zum|zur|vom|de|der|den|del|della|da|di|du|des|la|le|ter|ten|dos|das) ){0,3}"
# A capitalised word, with more of them after hyphens and apostrophes; possessive, so that none is given back.
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{Lu}))(?:['’-]\p{Lu}[\p{L}\p{M}]*+)*+"
NAME = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_]|\p{{Lu}}['’-])(?!(?:{_MR}|{_MRS}|{_DR})(?![\p{{L}}\p{{M}}])){_WORD}"
# A title, more titles and initials before a name.
TITLED = rf"(?<![\p{{L}}\p{{N}}_])(?:{_MR}|{_MRS}|{_DR})\.? (?:(?:{_DR})\.? ){{0,2}}(?:\p{{Lu}}\. ?){{0,3}}(?:{NAME} )?{_PARTICLES}{NAME}"
GATE = (
    rf"@|\+[0-9]|[0-9]\.[0-9]|[0-9](?:[^0-9A-Za-z]{{0,4}}[0-9]){{7}}|(?<![\p{{L}}\p{{N}}_])(?:{_MR}|{_MRS}|{_DR})\.? (?:{_PARTICLES}\p{{Lu}}|(?:{_DR})[. ])"
    r"|:[0-9A-Fa-f]{0,4}:|(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"
)
# Names by script: men, women, either, families, families of women. Latin families are a stem and an ending.
_MEN = "James Robert Lukas Felix Pierre Julien Diego Carlos Oscar Victor Hugo Martin Simon Leon Pablo Adam"
_WOMEN = "Mary Anna Julia Clara Marie Camille Lucia Elena Sofia Laura Alice Emma Nora Ines Paula Eva"
_EITHER = "Robin Alexis Sasha Jules Dominique Charlie Noa Kim Mika Luca Jamie Morgan Sidney Toni Andrea Chris"
_STEMS = "Arn Ber Cal Dor Ell Fal Gar Hol Kel Lam Mar Nor Per Ros Tal Wal"
_ENDINGS = "berg den ell er feld ford in ister mann mond ner ot sen son stett ton"
_CYRILLIC = (
    "Алексей Борис Виктор Григорий Дмитрий Иван Максим Олег", "Анна Вера Галина Дарья Елена Ирина Мария Ольга", "Саша Женя Валя Слава",
    "Орлов Соколов Лебедев Морозов Волков Зайцев Павлов Титов", "Орлова Соколова Лебедева Морозова Волкова Зайцева Павлова Титова",
)
_GREEK = (
    "Αλέξανδρος Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Πέτρος Σπύρος", "Άννα Βασιλική Δήμητρα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία", "Άρτεμις Άγγελος Φώτης Ζωή",
    *["Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παναγιώτου Χρήστου Αθανασίου"] * 2,
)
# Alphabets by script; a letter becomes a letter of the alphabet that holds it, any other letter stays a letter of its case.
_SCRIPTS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
DOUBLED = 2  # attempts from which names are double
RELAXED = 4
COUNTED = 12
_HEX = "0123456789abcdef"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normal(kind: Column, raw: Column) -> Column:
    """What two mentions of one entity have in common."""
    return (
        F.when(kind.isin(0, 4, 5, 7, 9, 10, 11), F.lower(raw)).when((kind == 1) | (kind == 3) | (kind == 6), _digits(raw))
        .when(kind == 8, F.replace(raw, F.lit(" "), F.lit(""))).otherwise(raw)
    )


def _digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind.cast("string"), norm, attempt.cast("string")).cast("binary"), 512)


def _nth(hexes: Column, i: Column) -> Column:
    """A number below 65536 for place ``i``; places beyond the digest's length use another digest."""
    block = F.substring(F.when(i < 32, hexes).otherwise(F.sha2(F.concat(hexes, (i / F.lit(32)).cast("int").cast("string")).cast("binary"), 512)), (i % 32) * 4 + 1, F.lit(4))
    return F.conv(block, 16, 10).cast("int")


def _spelled(raw: Column, hexes: Column, skip: Column | None = None) -> Column:
    """``raw`` with its letters and digits drawn anew; the first ``skip`` characters stay."""
    chars = F.split(raw, "")

    def drawn(c: Column, n: Column) -> Column:
        out = F.when(c.between("0", "9"), (n % 10).cast("string"))
        for letters in _SCRIPTS:
            out = out.when(F.lit(letters).contains(c), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
        return out.otherwise(c)

    def one(c: Column, i: Column) -> Column:
        out = let(_nth(hexes, i), lambda n: drawn(c, n))
        return out if skip is None else F.when(i < skip, c).otherwise(out)

    return F.array_join(F.transform(F.filter(chars, lambda c: c != ""), one), "")


def _octets(raw: Column, hexes: Column, attempt: Column) -> Column:
    """Four numbers below 256, each with as many digits as before; any number from the relaxed attempts on."""

    def drawn(o: Column, x: Column) -> Column:
        own = F.when(F.length(o) == 1, x % 10).when(F.length(o) == 2, x % 90 + 10).otherwise(x % 156 + 100)
        return F.when(attempt >= RELAXED, x % 256).otherwise(own).cast("string")

    return F.array_join(F.transform(F.split(raw, r"\."), lambda o, i: let(_nth(hexes, i), lambda x: drawn(o, x))), ".")


def _luhn(digits: Column) -> Column:
    """Check sum of a string of digits, whose last is the check digit."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda total, d: total + d) % 10


def _card(norm: Column, hexes: Column) -> Column:
    """The digits of a card number: the first stays, the last is the right check digit if it was before."""

    def checked(drawn: Column) -> Column:
        body = F.substring(drawn, F.lit(1), F.length(norm) - 1)
        fixed = let(body, lambda b: F.concat(b, ((F.lit(10) - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
        return F.when(_luhn(norm) == 0, fixed).otherwise(drawn)

    return let(_spelled(norm, hexes, F.lit(1)), checked)


def _in_format(raw: Column, drawn: Column, kept: str = "[0-9]") -> Column:
    """The characters of ``drawn`` in place of those of ``raw`` that ``kept`` matches; what is left of it follows."""
    chars = F.filter(F.split(raw, ""), lambda c: c != "")

    def put(drawn: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            own = c.rlike(kept)
            return F.struct((acc["n"] + own.cast("int")).alias("n"), F.concat(acc["out"], F.when(own, F.substring(drawn, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    return let(drawn, put)


def _name(kind: Column, raw: Column, hexes: Column, attempt: Column) -> Column:
    """A given name of the kind's gender or a family name; a double one, then one with a drawn part, in later attempts."""

    def by_script(latin: Column, cyrillic: Column, greek: Column) -> Column:
        return F.when(raw.rlike(r"(?i)^\p{IsCyrillic}"), cyrillic).when(raw.rlike(r"(?i)^\p{IsGreek}"), greek).otherwise(latin)

    def by_kind(man: str, woman: str, either: str, family: str, hers: str) -> Column:
        return F.when(kind == 4, man).when(kind == 5, woman).when(kind == 9, either).when(kind == 11, hers).otherwise(F.lit(family))

    def pick(names: Column, i: int) -> Column:
        return F.element_at(names, _nth(hexes, F.lit(i)) % F.size(names) + 1)

    starts = by_script(by_kind(_MEN, _WOMEN, _EITHER, _STEMS, _STEMS), by_kind(*_CYRILLIC), by_kind(*_GREEK))
    ends = F.when((kind >= 10) & ~raw.rlike(r"(?i)^[\p{IsCyrillic}\p{IsGreek}]"), _ENDINGS).otherwise("")
    tail = _spelled(by_script(F.lit("Aaaaaa"), F.lit("Аааааа"), F.lit("Αααααα")), hexes)

    def drawn(x: Column) -> Column:
        one = lambda i: F.concat(pick(x["starts"], i), pick(x["ends"], i + 1))
        return F.concat_ws("-", one(0), F.when(attempt >= DOUBLED, one(2)), F.when(attempt >= RELAXED, tail))

    made = let(F.struct(F.split(starts, " ").alias("starts"), F.split(ends, " ").alias("ends")), drawn)
    return let(made, lambda x: F.when((F.upper(raw) == raw) & (F.lower(raw) != raw), F.upper(x)).otherwise(x))


def _groups(raw: Column, hexes: Column, attempt: Column) -> Column:
    """An address of version 6 with its digits drawn anew, in eight full groups from the relaxed attempts on."""

    def one(c: Column, i: Column) -> Column:
        digit = let(_nth(hexes, i), lambda n: F.substring(F.lit(_HEX), n % 16 + 1, F.lit(1)))
        return F.when(c == ":", c).when(c.between("A", "F"), F.upper(digit)).otherwise(digit)

    full = F.concat_ws(":", *(F.substring(hexes, F.lit(4 * k + 1), F.lit(4)) for k in range(8)))
    return F.when(attempt >= RELAXED, full).otherwise(F.array_join(F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), one), ""))


def _remainder(account: Column) -> Column:
    """Of an account number, read as its check sum reads it, by 97."""
    chars = F.filter(F.split(F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4))), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.between("0", "9"), r * 10 + c.cast("int")).otherwise(r * 100 + F.ascii(c) - 55) % 97)


def _iban(norm: Column, hexes: Column) -> Column:
    """An account of the same country and format with the right check digits."""
    body = F.substring(_spelled(norm, hexes, F.lit(4)), F.lit(5), F.length(norm))
    country = F.substring(norm, F.lit(1), F.lit(2))
    return let(body, lambda b: F.concat(country, F.lpad((F.lit(98) - _remainder(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))


def surrogate(key: str, kind: Column, raw: Column, norm: Column, attempt: Column) -> Column:
    """The replacement of one mention."""

    def numbered(new: Column) -> Column:
        with_number = F.when(kind == 0, F.concat(attempt.cast("string"), F.lit("-"), new)).otherwise(F.concat(new, F.lit("-"), attempt.cast("string")))
        return F.when(attempt >= COUNTED, with_number).otherwise(new)

    # Bound, as each use of an expression would repeat all of it in the plan.
    return let(let(_digest(key, kind, norm, attempt), lambda h: _from_digest(h, kind, raw, norm, attempt)), numbered)


def _from_digest(h: Column, kind: Column, raw: Column, norm: Column, attempt: Column) -> Column:
    longer = F.when(attempt >= RELAXED, F.substring(h, F.lit(1), F.lit(4))).otherwise("")
    # the domain's last label stays
    tld = F.regexp_extract(raw, r"(\.[A-Za-z0-9-]+)$", 1)
    email = F.concat(longer, _spelled(F.substring(raw, F.lit(1), F.length(raw) - F.length(tld)), h), tld)
    country = F.length(F.regexp_extract(norm, "^(1|7|[2-9][0-9])", 1))
    return (
        F.when(kind == 0, email).when(kind == 1, _in_format(raw, _spelled(norm, h, country))).when(kind == 2, _octets(raw, h, attempt))
        .when(kind == 6, _in_format(raw, _spelled(norm, h, F.length(F.regexp_extract(norm, "^(0*)", 1)))))
        .when(kind == 3, _in_format(raw, _card(norm, h))).when(kind == 7, _groups(raw, h, attempt)).when(kind == 8, _in_format(raw, _iban(norm, h), "[^ ]"))
        .otherwise(_name(kind, raw, h, attempt))
    )


def attempts(entities: DataFrame, new: Column) -> DataFrame:
    """kind, norm and the attempt whose surrogate is like no other's and like no entity; ``entities`` has kind and norm.

    ``new`` is :func:`surrogate` over the columns kind, raw, norm and attempt, built once, as building it takes seconds.
    """
    new = let(new, lambda x: normal(F.col("kind"), x))
    known = materialise(entities.select("kind", "norm").distinct(), "pii-entities")
    open_, settled, taken, attempt = known, [], [known.select("kind", F.col("norm").alias("made"))], 0
    while True:
        number = F.lit(attempt).cast("long") if attempt < COUNTED else F.monotonically_increasing_id() * 64 + attempt
        made = open_.select("kind", "norm", F.col("norm").alias("raw"), number.alias("attempt"))
        made = materialise(made.select("kind", "norm", "attempt", new.alias("made")), "pii-made")
        used = taken[0]
        for more in taken[1:]:
            used = used.union(more)
        owners = made.groupBy("kind", "made").agg(F.min("norm").alias("norm")).join(used, ["kind", "made"], "left_anti")
        won = materialise(made.join(owners, ["kind", "made", "norm"]).select("kind", "norm", "attempt", "made"), "pii-won")
        settled.append(won.select("kind", "norm", "attempt"))
        taken.append(won.select("kind", "made"))
        open_ = materialise(made.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm"), "pii-lost")
        discard(made)
        attempt += 1
        if not open_.limit(1).count():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _persons(gated: DataFrame) -> DataFrame:
    """row, s (start, kind, end) and raw of every mention of a name that stands after a title somewhere in the same text.

    Titled mentions only tell the names of a text; its capitalised words are joined with them by text and name, so a
    text's mentions agree, and no task holds more than a text's words.
    """
    titled = gated.select(F.col("__row").alias("row"), F.explode(places(F.col("text"), TITLED, 0, raw=True)).alias("t")).select("row", F.col("t.raw").alias("raw"))
    first = F.regexp_extract("raw", r"^([\p{L}-]+)", 1)
    title = F.when(first.rlike(f"^(?:{_MR})$"), 4).when(first.rlike(f"^(?:{_MRS})$"), 5).otherwise(9)
    titled = titled.withColumn("title", title)
    family = F.regexp_extract("raw", f"({NAME})$", 1)
    feminine = family.rlike(r"^\p{IsCyrillic}") & ((F.col("title") == 5) | ((F.col("title") == 9) & family.rlike("(?i)[ая]$")))
    given = F.regexp_extract("raw", rf"(?<=[ .])({NAME}) {_PARTICLES}{NAME}$", 1)
    words = F.array(F.struct(F.lower(family).alias("norm"), F.when(feminine, 11).otherwise(10).alias("kind")), F.struct(F.lower(given).alias("norm"), F.col("title").alias("kind")))
    names = titled.select("row", F.explode(words).alias("w")).where("w.norm <> ''").select("row", "w.norm", "w.kind")
    # a name of either gender has that which it has elsewhere; a word that is both in a text is a family name there
    names = materialise(names.distinct(), "pii-names")
    known = names.where("kind in (4, 5)").groupBy("norm").agg(F.min("kind").alias("known"))
    own = names.groupBy("row", "norm").agg(F.max(F.when(F.col("kind") >= 10, F.col("kind"))).alias("family"), F.min("kind").alias("kind"))
    gender = F.when(F.col("kind") == 9, F.coalesce("known", "kind")).otherwise(F.col("kind"))
    own = own.join(known, "norm", "left").select("row", "norm", F.coalesce("family", gender).alias("kind"))
    texts = gated.join(names.select(F.col("row").alias("__row")).distinct(), "__row", "left_semi")
    tokens = texts.select(F.col("__row").alias("row"), F.explode(places(F.col("text"), NAME, 0, raw=True)).alias("t")).withColumn("norm", F.lower("t.raw"))
    found = tokens.join(own, ["row", "norm"])
    return found.select("row", F.struct(F.col("t.start").alias("start"), F.col("kind"), F.col("t.end").alias("end")).alias("s"), "kind", F.col("t.raw").alias("raw"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All documents with surrogates in their texts and n_email, n_phone, n_ip, n_card, n_person (names, given and family each), n_account; n_chars is counted anew."""
    counts = ["n_email", "n_phone", "n_ip", "n_card", "n_person", "n_account"]
    names = [c for c in docs.columns if c not in counts]
    docs = docs.select(*names)
    text = F.coalesce(F.col("text"), F.lit(""))
    gated = materialise(docs.where(text.rlike(GATE)).withColumn("__row", F.monotonically_increasing_id()), "pii-gated")
    patterns = {0: EMAIL, 1: PHONE, 2: IP, 3: CARD, 6: NATIONAL, 7: IP6, 8: ACCOUNT}
    found = F.concat(*(places(F.col("text"), p, k, raw=True) for k, p in patterns.items()))
    spans = gated.select(F.col("__row").alias("row"), F.explode(found).alias("s"))
    lead = F.when(F.col("s.kind") == 0, F.length(F.regexp_extract("s.raw", "^[._%+-]+", 0))).otherwise(0)
    own = F.struct((F.col("s.start") + lead).alias("start"), "s.kind", "s.end")
    spans = spans.select("row", own.alias("s"), F.col("s.kind").alias("kind"), F.substring("s.raw", lead + 1, F.length("s.raw")).alias("raw"))
    right = _remainder(normal(F.col("kind"), F.col("raw"))) == 1
    spans = spans.where(F.when(F.col("kind") == 8, right).otherwise(True))
    spans = materialise(spans.union(_persons(gated)), "pii-spans")
    ents = spans.withColumn("norm", normal(F.col("kind"), F.col("raw")))
    drawn = surrogate(key, F.col("kind"), F.col("raw"), F.col("norm"), F.col("attempt"))
    tries = attempts(ents, drawn)
    new = ents.join(tries, ["kind", "norm"]).select("row", F.struct("s.start", "s.kind", "s.end", drawn.alias("new")).alias("s"))
    found = "array<struct<start:int,kind:int,end:int,new:string>>"
    none = F.array().cast(found)
    # of overlapping spans only the first is replaced, and only it counts
    first = lambda at, s: (F.when(s["start"] >= at, s["end"]).otherwise(at), F.when(s["start"] >= at, F.array(s)).otherwise(none))
    own = scanned(F.col("s"), none, first)
    by_row = materialise(new.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list("s")).alias("s")).select("__row", own.alias("__found")), "pii-by-row")
    some = gated.join(by_row, "__row", "left").withColumn("__found", F.coalesce("__found", none))
    count = lambda *k: F.size(F.filter("__found", lambda s: s["kind"].isin(*k))).cast("long")
    tail = [count(*k).alias(c) for c, k in zip(counts, [(0,), (1, 6), (2, 7), (3,), (4, 5, 9, 10, 11), (8,)], strict=True)]
    some = some.select(*names, "__found", *tail).withColumn("text", replaced(F.col("text"), F.col("__found"), lambda s: s["new"], found))
    if "n_chars" in names:
        some = some.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    rest = docs.where(~text.rlike(GATE)).select(*names, *(F.lit(0).cast("long").alias(c) for c in counts))
    return some.select(*names, *counts).union(rest)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "tessella")


QUERIES = {"op8_surrogates": op8_surrogates}
ORACLE_SQL: dict[str, str] = {}
