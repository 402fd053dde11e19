"""Personal data replaced by surrogates, as Spark expressions only.

Entities are found by one regular expression and replaced where they stand:

* character kinds (mail addresses, phone, card and account numbers, addresses of hosts, secrets) go through a keyed Feistel
  permutation of their letters and digits that keeps length, separators, case, script and each character's class, a card's
  check digit, a phone's country code and a mail address's last domain label.  A permutation cannot collide, so equal entities
  stay equal and different ones different over any corpus, without a table of them.  An entity may be of any length.
* names behind a title are replaced token by token from lists of the same gender and script.  A list is finite, so the
  distinct tokens of the corpus are checked for collisions: those that draw the same entry are numbered, and all but the first get a
  suffix.  A family name keeps its surrogate with and without a given name before it.  A name has up to 16 words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberflow.llm.common import materialize

# Titles, name lists and alphabets.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|г-н|господин"
FEMALE_TITLES = "Mrs|Ms|Frau|Madame|Mme|Mlle|Señora|Señorita|г-жа|госпожа"
POOLS = {
    "latin male": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karim Louis Marco Noel Oscar Paul Rafael Simon Tomas Victor".split(),
    "latin female": "Alma Berta Clara Diana Elena Flora Greta Helga Irene Julia Karla Laura Marta Nadia Olga Paula Rosa Sonia Tania Vera".split(),
    "latin family": "Abel Becker Castell Dorn Ebner Fabre Garnier Haller Iseler Jansen Keller Lambert Moreau Navarro Ortiz Pereira Quint Romero Salinas Thaler Ulmer Vidal Weber Zeller".split(),
    "cyrillic male": "Антон Борис Виктор Георгий Денис Егор Иван Кирилл Максим Олег Павел Роман".split(),
    "cyrillic female": "Алла Вера Галина Дарья Елена Жанна Ирина Лариса Мария Нина Ольга Тамара".split(),
    "cyrillic family male": "Белов Волков Громов Дубов Ершов Жуков Зимин Котов Лунин Морозов Орлов Соколов".split(),
    "cyrillic family female": "Белова Волкова Громова Дубова Ершова Жукова Зимина Котова Лунина Морозова Орлова Соколова".split(),
}
SYLLABLES = {"latin": "Ba De Fi Go Ku La Me Ni Po Ru Sa Te".split(), "cyrillic": "Ба Де Фи Го Ку Ла Ме Ни По Ру Са Те".split()}
DIGITS, HEX, LOWER = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
LATIN, CYRILLIC, GREEK = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"
# Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
ROUNDS = 6

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
HOST = rf"(?<![\p{{L}}\p{{N}}.]){OCTET}(?:\.{OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)"
SECRET = (
    r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pous]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})(?![\p{L}\p{N}])"
    r"|(?<![A-Za-z0-9_/+.-])(?=[A-Za-z0-9_/+.-]{12})(?<=(?i:token|secret|password|passwd|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_/+.-]{12,}"
)
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\p{L}\p{N}])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{13,19})(?![\p{L}\p{N}])"
PHONE = (
    r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\p{L}\p{N}])"
    r"|(?<![\p{L}\p{N}.-])\d{3}[-.]\d{2,3}[-.]\d{4}(?![\p{L}\p{N}])"
)
WORD = r"\p{Lu}[\p{L}'’]+"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE_TITLES}|{FEMALE_TITLES})\.?\s{{1,2}}{WORD}(?:[ -]{WORD}){{0,15}}"
TITLE_STARTS = ("Mr", "Ms", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "г-н", "г-жа", "господин", "госпожа")
PATTERN = "|".join((MAIL, HOST, SECRET, ACCOUNT, CARD, PHONE, NAME))


def _at(text: Column, index: Column | int) -> Column:
    return F.substring(text, index, 1)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever the body uses it."""
    return F.transform(F.array(value), body)[0]


def _letters(text: Column) -> Column:
    """The characters of a text; none of the empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _draw(key: str, *parts: Column) -> Column:
    return F.xxhash64(F.lit(key), *parts)


def _shifted(char: Column, by: Column, hexadecimal: Column) -> Column:
    """The character moved by a number of places within its class; one of no class stays."""

    def within(alphabet: str) -> Column:
        place = F.position(char, F.lit(alphabet)) - 1
        return _at(F.lit(alphabet), (F.pmod(place + F.pmod(by, F.lit(len(alphabet))), F.lit(len(alphabet))) + 1).cast("int"))

    def has(alphabet: str) -> Column:
        return F.position(char, F.lit(alphabet)) > 0

    found = F.when(hexadecimal & has(HEX), within(HEX))
    for alphabet in (DIGITS, LOWER, LATIN, CYRILLIC, GREEK):
        found = found.when(has(alphabet), within(alphabet))
    return found.otherwise(char)


def permuted(text: Column, key: str, hexadecimal: Column | None = None) -> Column:
    """Keyed permutation of texts of one class pattern: each half is shifted by draws from the other, in turns.

    A half is hashed once in a turn, and each of its letters draws from that hash and its place, so the work is linear in the length.
    """
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal

    def turn(halves: Column, k: Column) -> Column:
        def shifted(drawn: Column) -> Column:
            return F.transform(halves["moved"], lambda c, i: _shifted(c, F.xxhash64(drawn, i), hexadecimal))

        return F.struct(_let(_draw(key, k, halves["kept"]), shifted).alias("kept"), halves["kept"].alias("moved"))

    def through(letters: Column) -> Column:
        half = F.floor(F.size(letters) / 2).cast("int")
        start = F.struct(F.slice(letters, 1, half).alias("kept"), F.slice(letters, half + 1, F.size(letters)).alias("moved"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
        return _let(end, lambda e: F.array_join(F.concat(e["kept"], e["moved"]), ""))

    return _let(_letters(text), through)


def _refilled(shape: Column, letters: Column) -> Column:
    """``shape`` with its letters and digits replaced in order by ``letters``, upper case where they were."""

    def filled(old: Column) -> Column:
        own = F.filter(old, lambda x: x["letter"])
        new = F.zip_with(own, _letters(letters), lambda x, c: F.struct(x["i"].alias("i"), F.when(x["c"].rlike(r"^\p{Lu}"), F.upper(c)).otherwise(c).alias("c")))
        rest = F.transform(F.filter(old, lambda x: ~x["letter"]), lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))
        return F.array_join(F.transform(F.array_sort(F.concat(new, rest)), lambda x: x["c"]), "")

    placed = F.transform(_letters(shape), lambda c, i: F.struct(i.alias("i"), c.alias("c"), c.rlike(r"^[\p{L}\p{N}]").alias("letter")))
    return _let(placed, filled)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def _characters(text: Column, key: str) -> Column:
    """Letters and digits permuted, all else as it stands."""
    return F.when(F.length(_bare(text)) > 0, _refilled(text, permuted(_bare(text), key))).otherwise(text)


def _mail(entity: Column, key: str) -> Column:
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    last = F.substring_index(domain, ".", -1)
    inner = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return F.concat(_characters(local, key + " local"), F.lit("@"), _characters(inner, key + " domain"), F.lit("."), last)


def _host(entity: Column, key: str) -> Column:
    octets = F.transform(F.split(entity, r"\."), lambda o: o.cast("long"))
    start = F.struct((octets[0] * 256 + octets[1]).alias("kept"), (octets[2] * 256 + octets[3]).alias("moved"))

    def turn(halves: Column, k: Column) -> Column:
        moved = F.pmod(halves["moved"] + F.pmod(_draw(key, k, halves["kept"]), F.lit(65536)), F.lit(65536))
        return F.struct(moved.alias("kept"), halves["kept"].alias("moved"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)
    parts = [F.floor(end[half] / 256) if high else F.pmod(end[half], F.lit(256)) for half in ("kept", "moved") for high in (True, False)]
    return F.concat_ws(".", *(p.cast("string") for p in parts))


def _luhn(digits: Column) -> Column:
    """Check digit that belongs behind the digits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        digit = _at(digits, F.length(digits) - i + 1).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(digit)

    return F.pmod(-F.aggregate(F.transform(places, value), F.lit(0), lambda a, b: a + b), F.lit(10))


def _card(entity: Column, key: str) -> Column:
    """The digits before the last are permuted; the last keeps its distance from the right check digit."""
    digits = _bare(entity)
    front, last = F.substring(digits, F.lit(1), F.length(digits) - 1), _at(digits, F.length(digits)).cast("int")
    new = permuted(front, key)
    check = F.pmod(_luhn(new) + last - _luhn(front), F.lit(10))
    return _refilled(entity, F.concat(new, check.cast("string")))


def _phone(entity: Column, key: str) -> Column:
    code = F.regexp_extract(entity, COUNTRY, 0)
    return F.concat(code, _characters(F.substring(entity, F.length(code) + 1, F.length(entity)), key))


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "mail")
        .when(entity.rlike(rf"^(?:{MALE_TITLES}|{FEMALE_TITLES})\.?\s"), "name")
        .when(entity.rlike(r"^\d+(?:\.\d+){3}$"), "host")
        .when(entity.rlike(r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})$"), "card")
        .when(entity.rlike(r"^[A-Z]{2}\d{2} ?[A-Z0-9]{4}") & ~entity.rlike(r"^[0-9A-F]{32,}$"), "account")
        .when(entity.rlike(r"^[+(\d][\d .()+-]*$"), "phone")
        .otherwise("secret")
    )


def name_tokens(entity: Column) -> Column:
    """(list, token) of each word of a name behind its title; the last word is the family name."""
    gender = F.when(entity.rlike(rf"^(?:{FEMALE_TITLES})\.?\s"), "female").otherwise("male")
    words = F.split(F.regexp_replace(entity, r"^\S+\s+", ""), "[ -]")

    def token(word: Column, i: Column) -> Column:
        cyrillic = word.rlike(r"\p{IsCyrillic}")
        family = i == F.size(words) - 1
        pool = (
            F.when(cyrillic & family, F.concat(F.lit("cyrillic family "), gender))
            .when(cyrillic, F.concat(F.lit("cyrillic "), gender))
            .when(family, "latin family")
            .otherwise(F.concat(F.lit("latin "), gender))
        )
        return F.struct(pool.alias("pool"), F.lower(word).alias("token"))

    return F.transform(words, token)


def _spelled(number: Column, parts: list[str]) -> Column:
    """The number's digits to the base of the list, each as its syllable."""

    def syllable(digit: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, parts)), F.conv(digit, len(parts), 10).cast("int") + 1)

    digits = F.split(F.conv(number.cast("string"), 10, len(parts)), "(?!^)")
    return F.lower(F.array_join(F.transform(digits, syllable), ""))


def name_table(tokens: DataFrame, key: str) -> DataFrame:
    """(pool, token, surrogate) for every distinct (pool, token), collisions resolved.

    Tokens that draw one entry are numbered in the order of another draw; number 1 gets the entry, the others get a suffix made
    of their number, which no entry holds.
    """
    sizes = F.create_map(*(x for name, names in POOLS.items() for x in (F.lit(name), F.array(*map(F.lit, names)))))
    drawn = tokens.select("pool", "token").distinct().withColumn("entry", _draw(key, F.col("pool"), F.col("token")))
    drawn = drawn.withColumn("names", sizes[F.col("pool")])
    drawn = drawn.withColumn("base", F.element_at("names", (F.pmod("entry", F.size("names")) + 1).cast("int"))).drop("names")
    numbered = drawn.withColumn(
        "number", F.expr("row_number() over (partition by pool, base order by entry, token)").cast("int") - 1
    )
    suffix = {script: F.concat(F.lit("-"), F.initcap(_spelled(F.col("number"), parts))) for script, parts in SYLLABLES.items()}
    own = F.when(F.col("pool").startswith("cyrillic"), suffix["cyrillic"]).otherwise(suffix["latin"])
    return numbered.select("pool", "token", F.concat("base", F.when(F.col("number") > 0, own).otherwise("")).alias("surrogate"))


def _name(entity: Column, names: Column) -> Column:
    """Title and separators as they stand, each word replaced; ``names`` maps "pool token" to its surrogate."""
    title = F.regexp_extract(entity, r"^\S+\s+", 0)
    apart = F.regexp_extract_all(F.substring(entity, F.length(title) + 1, F.length(entity)), F.lit("[ -]"), 0)
    new = F.transform(name_tokens(entity), lambda t: names[F.concat_ws(" ", t["pool"], t["token"])])
    joined = F.zip_with(new, F.concat(apart, F.array(F.lit(""))), lambda w, s: F.concat(w, s))
    return F.concat(title, F.array_join(joined, ""))


def surrogate(entity: Column, key: str, names: Column | None = None) -> Column:
    kind, hexadecimal = kind_of(entity), entity.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
    drawn = permuted(_bare(entity), key + " secret", hexadecimal)
    secret = F.when(hexadecimal & ~entity.rlike("[a-z]"), F.upper(drawn)).when(hexadecimal, drawn).otherwise(_refilled(entity, drawn))
    found = (
        F.when(kind == "mail", _mail(entity, key + " mail"))
        .when(kind == "host", _host(entity, key + " host"))
        .when(kind == "card", _card(entity, key + " card"))
        .when(kind == "phone", _phone(entity, key + " phone"))
        .when(kind == "secret", secret)
        .when(kind == "account", F.concat(F.substring(entity, 1, 2), _characters(F.substring(entity, F.lit(3), F.length(entity)), key + " account")))
    )
    return found.otherwise(entity) if names is None else found.otherwise(_name(entity, names))


def entities(text: Column) -> Column:
    """Every entity of the text, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERN), 0)


def _titled(text: Column) -> Column:
    """Whether a name can be found; plain searches for the titles come first, as most texts have none."""
    some = F.lit(False)
    for start in TITLE_STARTS:
        some = some | text.contains(start)
    return F.coalesce(some & text.rlike(NAME), F.lit(False))


def _rewritten(text: Column, key: str, names: Column | None = None) -> Column:
    """The text rebuilt from its entities and what stands between; only where a sign is present that every entity but a
    name holds is the long expression tried."""
    new = F.transform(entities(text), lambda e: surrogate(e, key, names))
    pieces = F.zip_with(F.split(text, PATTERN, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    sign = text.rlike("[0-9@=:]") if names is None else F.lit(True)
    return F.when(sign, F.array_join(pieces, "")).otherwise(text)


def replace(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``documents`` with the entities of ``column`` replaced; all columns, rows and nulls stay.

    Null texts stay null and empty ones empty; a text without entities is unchanged to the character; repeated rows get the same
    surrogates, and so do equal entities anywhere in the table.  Texts with titled names take a second path, as their surrogates
    come from the table of checked names: it is joined to the texts' own names, never sent whole to one place.
    """
    text, named = F.col(f"row.`{column}`"), _titled(F.col(f"row.`{column}`"))
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))

    def whole(frame: DataFrame, new: Column) -> DataFrame:
        return frame.select(*((new if c == column else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))

    plain = whole(rows.filter(~named), _rewritten(text, key))
    holders = rows.filter(named).withColumn("id", F.sha2(text, 256))
    own = F.filter(entities(text), lambda e: kind_of(e) == "name")
    used = materialize(
        holders.select("id", F.explode(F.flatten(F.transform(own, name_tokens))).alias("t")).select("id", "t.pool", "t.token").distinct()
    )
    checked = name_table(used, key)
    maps = (
        used.join(checked, ["pool", "token"])
        .groupBy("id")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "pool", "token"), "surrogate"))).alias("names"))
    )  # one text's own names: bounded by that text
    return plain.unionByName(whole(holders.join(maps, "id"), _rewritten(text, key, F.col("names"))))
