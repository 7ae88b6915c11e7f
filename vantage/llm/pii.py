"""Personal data: keyed surrogates of the same type and format, with native functions only.

Entities are found by one regular expression. A surrogate is a keyed permutation of what the entity's format
leaves open: letters stay letters of their script and case, digits stay digits, separators stay. It is a Feistel
network whose rounds draw on SHA-256, so that one entity gets one surrogate wherever it stands (coreference) and
two entities never get the same (distinctness). A name becomes another of its script and gender, which a list of given
names, the title or the name's ending tells: a listed given name another one of its list, any other one is put
together from syllables. A
collision check over all entities finds surrogates that are someone's real data; those entities are permuted
once more, under another tweak, until none is left. Where a format has no free values for them, that is an error.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored

#: The Spark setting that holds the secret key of surrogates.
KEY = "spark.vantage.pii.key"
_random_keys: dict[str, str] = {}

# What introduces a name, and given names by gender and script.
MALE = "Mr|Herr|Monsieur|Señor|Signor|господин|Господин|κύριος|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Signora|госпожа|Госпожа|κυρία|Κυρία"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mademoiselle|Señor|Señora|Señorita|Signor|Signora|господин|госпожа|Господин|Госпожа|κύριος|κυρία|Κύριος|Κυρία"
GIVEN = {
    "female_latin": "anna emma maria julia laura sophie clara elena lucia alice helen irene nina paula rosa vera".split(),
    "male_latin": "adam paul peter david lukas martin thomas daniel carlos henri james oscar felix simon victor hugo".split(),
    "female_cyrillic": "анна мария елена ольга ирина наталья вера нина".split(),
    "male_cyrillic": "иван петр павел олег игорь антон сергей борис".split(),
    "female_greek": "μαρία ελένη άννα σοφία".split(),
    "male_greek": "γιώργος νίκος πέτρος παύλος".split(),
}
# Syllables by script, endings of given names by gender, and endings of family names.
SYLLABLES = {
    "latin": {"onset": "b d f g h k l m n p r s t v z br dr gr kl st".split(), "vowel": "a e i o u".split(), "male": "an ar as en ik ol on us".split(), "female": "a ia ina ela ette ora una ysa".split(), "family": "ard berg el en er ik in man ov son".split()},
    "cyrillic": {"onset": "б в г д ж з к л м н п р с т ф х".split(), "vowel": "а е и о у".split(), "male": "ан ей ий ил ир ор".split(), "female": "а ена ида ина ия ора".split(), "family": "ак енко ин ич ов ский".split(), "family_female": "ак енко ина ич ова ская".split()},
    "greek": {"onset": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "vowel": "α ε ι ο".split(), "male": "ας ης ος".split(), "female": "α η ία ω".split(), "family": "άκης ίδης ιάδης όπουλος".split(), "family_female": "άκη ίδου ιάδου οπούλου".split()},
}
_NAME = r"\p{Lu}(?:\p{L}+(?:[-']\p{Lu}?\p{L}+)?|'\p{Lu}\p{L}+)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: In the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "api_key": r"(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|ghs|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}",
    "hex_secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "birth": r"(?<!\p{L})(?:[Bb]orn(?: on)?|[Dd]ate of [Bb]irth|DOB|[Gg]eboren(?: am)?|[Nn]ée? le|[Nn]acid[oa] el):? (?:[12][0-9]{3}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][./][0-3]?[0-9][./][12][0-9]{3})(?![0-9])",
    "address": r"(?<![\p{L}0-9])[1-9][0-9]{0,4} \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)? (?:Street|Avenue|Road|Lane|Drive|Boulevard|St\.|Ave\.|Rd\.|Blvd\.)",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? {_NAME}(?: {_NAME})?",
}
#: Patterns by what they start with, so that most places are passed over at once.
_STARTS = {"[A-Z]": ("access_key", "iban"), "[spgx]": ("api_key",), "[0-9a-f]": ("hex_secret",), "[0-9+(]": ("phone", "card", "ssn", "ip", "address"), "[BbDdGgNn]": ("birth",), f"[{''.join(sorted({t[0] for t in TITLES.split('|')}))}]": ("name",)}
ENTITY = "|".join([f"(?:{PATTERNS['email']})", *(f"(?={start})(?:{'|'.join(f'(?:{PATTERNS[k]})' for k in kinds)})" for start, kinds in _STARTS.items())])
#: Surrogates tried in one round for entities that found none before.
MOST_TRIED = 1 << 20
#: What a text with an entity has at least; cheap to look for.
_HINT = rf"[@0-9]|{list(_STARTS)[-1]}(?:{'|'.join(sorted({t[1:] for t in TITLES.split('|')}))})\.? \p{{Lu}}|[spgx](?:k|ho|hp|hs|oxb|oxp)[-_]|A[KS]IA"

_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "ñáéíóúüäößàâçèêëîïôùûœ")
_HEX = ("0123456789abcdef",)


def _shift(text: Column, tweak: Column, alphabets: tuple[str, ...]) -> Column:
    """Move each character within its alphabet by an amount drawn from SHA-256 of the tweak."""
    instr = lambda a, c: F.call_function("instr", a, c)

    def moved(digest: Column, c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.pmod(i * 3, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
        own = F.get(F.filter(F.array(*map(F.lit, alphabets)), lambda a: instr(a, c) > 0), F.lit(0))
        return _held(own, lambda a: F.when(a.isNull() | (c == ""), c).otherwise(F.substr(a, F.pmod(instr(a, c) - 1 + by, F.length(a)) + 1, F.lit(1))))

    return _held(F.sha2(tweak, 256), lambda digest: F.array_join(F.transform(F.split(text, ""), lambda c, i: moved(digest, c, i)), ""))


def permuted(text: Column, tweak: Column, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """A keyed permutation of the texts of one pattern of alphabets; other characters stay.

    Letters' case is kept, and does not change the result otherwise. Separators are kept and not looked at, so
    that one number written in two ways stays one number.
    """
    every = "".join(alphabets)
    bare = F.regexp_replace(F.lower(text), f"[^{every}]", "")
    half = F.floor(F.length(bare) / 2).cast("int")
    left, right = F.substr(bare, F.lit(1), half), F.substr(bare, half + 1, F.length(bare))

    def turn(pair: Column, k: Column) -> Column:
        """One round: the halves change places, and the one that was left moves by what the other says."""
        return F.struct(pair["r"].alias("l"), _shift(pair["l"], F.concat(tweak, F.lit("|"), k.cast("string"), F.lit("|"), pair["r"]), alphabets).alias("r"))

    both = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.struct(left.alias("l"), right.alias("r")), turn, lambda p: F.concat(p["l"], p["r"]))

    def again(new: Column) -> Column:
        """Put the characters back between the separators."""

        def char(c: Column, i: Column) -> Column:
            low = F.lower(c)
            n = F.length(F.regexp_replace(F.lower(F.substr(text, F.lit(1), i + 1)), f"[^{every}]", ""))
            to = F.substr(new, n, F.lit(1))
            return F.when(low.rlike(f"[{every}]"), F.when(c != low, F.upper(to)).otherwise(to)).otherwise(c)

        return F.array_join(F.transform(F.split(text, ""), char), "")

    return _held(both, again)


def _held(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _luhn(digits: Column) -> Column:
    """The check digit for a string of digits."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")).otherwise(c.cast("int"))),
        F.lit(0),
        lambda a, x: a + x.cast("int"),
    )
    return F.pmod(-total, F.lit(10))


def _card(text: Column, tweak: Column) -> Column:
    """The first digit stays; a check digit stays right, and a wrong one stays as wrong."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)

    def whole(d: Column) -> Column:
        body = F.substr(d, F.lit(2), n - 2)
        first = F.substr(d, F.lit(1), F.lit(1))
        off = F.substr(d, n, F.lit(1)).cast("int") - _luhn(F.substr(d, F.lit(1), n - 1))
        return _held(F.concat(first, permuted(body, F.concat(tweak, first))), lambda p: F.concat(p, F.pmod(_luhn(p) + off, F.lit(10)).cast("string")))

    def char(new: Column):
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(new, F.length(F.regexp_replace(F.substr(text, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c)), "")

    return _held(_held(digits, whole), char)


def _ip(text: Column, tweak: Column) -> Column:
    """A permutation of the 32-bit address, by its halves."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))

    def draw(half: Column, k: Column) -> Column:
        return F.conv(F.substr(F.sha2(F.concat(tweak, F.lit("|"), k.cast("string"), F.lit("|"), half.cast("string")), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")

    def turn(pair: Column, k: Column) -> Column:
        return F.struct(pair["r"].alias("l"), F.pmod(pair["l"] + draw(pair["r"], k), F.lit(65536)).alias("r"))

    first = _held(parts, lambda p: F.struct((p[0] * 256 + p[1]).alias("l"), (p[2] * 256 + p[3]).alias("r")))
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(5)), first, turn)
    return _held(pair, lambda p: F.concat_ws(".", *(x.cast("int").cast("string") for x in (F.floor(p["l"] / 256), F.pmod(p["l"], F.lit(256)), F.floor(p["r"] / 256), F.pmod(p["r"], F.lit(256))))))


def _draw(digest: Column, at: int, of: list[str]) -> Column:
    """One of a list, by four hexadecimal digits."""
    n = F.conv(F.substr(digest, F.lit(4 * at + 1), F.lit(4)), 16, 10).cast("int")
    return F.element_at(F.array(*map(F.lit, of)), F.pmod(n, F.lit(len(of))) + 1)


def _cased(new: Column, old: Column) -> Column:
    """``new`` with the case of ``old``: all or only the first letter in upper case, or none."""
    first = F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2), F.length(new)))
    return F.when((F.length(old) > 1) & (F.upper(old) == old), F.upper(new)).when(old.rlike(r"^\p{Lu}"), first).otherwise(new)


def _made(name: Column, tweak: Column, female: Column, part: str) -> Column:
    """A given or family name of the script of ``name``, drawn by its letters; separators stay, a lone letter becomes one."""

    def word(token: Column) -> Column:
        def of(digest: Column) -> Column:
            out = F.lit(None).cast("string")
            for script, of_script in SYLLABLES.items():
                her = of_script["female"] if part == "given" else of_script.get("family_female", of_script["family"])
                his = of_script["male"] if part == "given" else of_script["family"]
                stem = F.concat(*(_draw(digest, i, of_script["onset" if i % 2 == 0 else "vowel"]) for i in range(4 if part == "given" else 6)), _draw(digest, 6, of_script["onset"]))
                made = F.concat(stem, F.when(female, _draw(digest, 7, her)).otherwise(_draw(digest, 7, his)))
                out = made if script == "latin" else F.when(token.rlike(rf"\p{{Is{script.capitalize()}}}"), made).otherwise(out)
            return out

        made = _held(F.sha2(F.concat(tweak, F.lit(f"|{part}|"), F.lower(token)), 256), of)
        new = _held(made, lambda m: _cased(F.when(F.length(token) > 1, m).otherwise(F.substr(m, F.lit(1), F.lit(1))), token))
        return F.when(token.rlike(r"^\p{L}"), new).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\p{L}+|[^\p{L}]+"), 0), word), "")


def _female(title: Column, given: Column) -> Column:
    """Whether a name is a woman's: by the list of given names, the title, or how it ends."""
    listed = lambda gender: F.lower(given).isin(*(n for k, names in GIVEN.items() if k.startswith(gender) for n in names))
    by_title = F.when(title.rlike(rf"^(?:{FEMALE})\.? $"), F.lit(True)).when(title.rlike(rf"^(?:{MALE})\.? $"), F.lit(False))
    by_list = F.when(listed("female"), F.lit(True)).when(listed("male"), F.lit(False))
    return F.coalesce(by_list, by_title, F.lower(given).rlike("[aáяаαηάή]$"))


def _given(name: Column, tweak: Column, female: Column) -> Column:
    """A listed given name becomes another of its gender and script; any other is made from syllables of both."""
    out = _made(name, tweak, female, "given")
    low = F.lower(name)
    for kind, names in GIVEN.items():
        step = F.conv(F.substr(F.sha2(F.concat(tweak, F.lit(kind)), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")
        array = F.array(*map(F.lit, names))
        at = F.array_position(array, low).cast("int")
        to = F.element_at(array, (F.pmod(at + F.pmod(step, F.lit(len(names) - 1)), F.lit(len(names))) + 1).cast("int"))
        out = F.when(at > 0, _cased(to, name)).otherwise(out)
    return out


def _name(entity: Column, tweak: Column) -> Column:
    """Title, given name if there are two names, and family name, which is drawn alike in both forms."""
    title = F.regexp_extract(entity, rf"^(?:{TITLES})\.? ", 0)
    names = F.split(F.substr(entity, F.length(title) + 1, F.length(entity)), " ")
    female = _female(title, names[0])
    family = _made(F.element_at(names, -1), tweak, female, "family")
    given = F.when(F.size(names) > 1, F.concat(_given(names[0], tweak, female), F.lit(" "))).otherwise(F.lit(""))
    return F.concat(title, given, family)


def _birth(entity: Column, tweak: Column) -> Column:
    """Another date in the same decade and format; days and months over 12 stay so, up to 28 unless they were above."""
    digest = F.sha2(F.concat(tweak, F.lit("|birth")), 256)

    def part(token: Column, i: Column) -> Column:
        n = token.cast("int")
        by = F.conv(F.substr(digest, F.pmod(i, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        new = (
            F.when(F.length(token) == 4, n - F.pmod(n, F.lit(10)) + F.pmod(n + by, F.lit(10)))
            .when(n <= 12, F.pmod(n - 1 + by, F.lit(12)) + 1).when(n <= 28, F.pmod(n - 13 + by, F.lit(16)) + 13).otherwise(n)
        )
        whole = F.when(token.rlike("^0|^[0-9]{2}"), F.lpad(new.cast("string"), F.greatest(F.lit(2), F.length(token)), F.lit("0"))).otherwise(new.cast("string"))
        return F.when(token.rlike("^[0-9]+$"), whole).otherwise(token)

    return F.array_join(F.transform(F.regexp_extract_all(entity, F.lit("[0-9]+|[^0-9]+"), 0), part), "")


def _address(entity: Column, tweak: Column) -> Column:
    """Another number of as many digits, another street name; the kind of street stays."""
    number = F.substring_index(entity, " ", 1)
    kind = F.substring_index(entity, " ", -1)
    street = F.substr(entity, F.length(number) + 2, F.length(entity) - F.length(number) - F.length(kind) - 2)
    drawn = F.conv(F.substr(F.sha2(F.concat(tweak, F.lit("|address|"), F.lower(entity)), 256), F.lit(1), F.lit(10)), 16, 10).cast("long")
    low = F.pow(F.lit(10.0), F.length(number) - 1).cast("long")
    return F.concat((low + F.pmod(drawn, low * 9)).cast("string"), F.lit(" "), _made(street, tweak, F.lit(False), "family"), F.lit(" "), kind)


def kind_of(entity: Column) -> Column:
    """The type of a found entity."""
    return reduce(lambda out, k: F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out), reversed(PATTERNS), F.lit("other"))


def normal(entity: Column, kind: Column) -> Column:
    """What makes two mentions one entity: letters and digits in lower case, for names without their title."""
    bare = F.regexp_replace(entity, rf"^(?:{TITLES})\.? ", "")
    return F.when(kind.isin("email", "ip"), F.lower(entity)).when(kind == "name", F.lower(bare)).otherwise(F.regexp_replace(F.lower(entity), r"[^\p{L}\p{N}]", ""))


def surrogate(entity: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity of a kind under a secret key."""
    tweak = F.concat(F.lit(f"{key}|"), kind, F.lit("|"), attempt.cast("string"))
    at = F.locate("@", entity)
    host = F.substr(entity, at + 1, F.length(entity))
    top = F.substring_index(host, ".", -1)
    domain = F.substr(host, F.lit(1), F.length(host) - F.length(top) - 1)
    # A domain is one entity in all addresses, whatever becomes of the local part.
    email = F.concat(permuted(F.substr(entity, F.lit(1), at - 1), F.concat(tweak, F.lower(host))), F.lit("@"), permuted(domain, F.lit(f"{key}|domain")), F.lit("."), top)
    start = F.regexp_extract(entity, r"^(?:AKIA|ASIA|[a-z]{2,4}[-_]|[A-Z]{2}(?=[0-9])|\+[0-9]{1,3}(?![0-9]))", 0)
    rest = F.substr(entity, F.length(start) + 1, F.length(entity))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", _ip(entity, tweak))
        .when(kind == "card", _card(entity, tweak))
        .when(kind == "hex_secret", permuted(entity, tweak, _HEX))
        .when(kind == "name", _name(entity, tweak))
        .when(kind == "birth", _birth(entity, tweak))
        .when(kind == "address", _address(entity, tweak))
        .when(kind.isin("phone", "iban", "access_key", "api_key"), F.concat(start, permuted(rest, F.concat(tweak, start))))
        .otherwise(permuted(entity, tweak))
    )


def _found(docs: DataFrame) -> Column:
    text = F.col("text")
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct entities of all texts: kind, id (the normal form) and entity (a mention, the first in order)."""
    one = docs.where(F.col("text").isNotNull()).select(F.explode(_found(docs)).alias("entity"))
    one = one.withColumn("kind", kind_of(F.col("entity")))
    return one.groupBy("kind", normal(F.col("entity"), F.col("kind")).alias("id")).agg(F.min("entity").alias("entity"))


def retried(known: DataFrame, key: str, attempts: int = 4) -> DataFrame:
    """kind, id and attempt (1 or more) of the entities whose first surrogate collides.

    A collision is a surrogate that is a real entity of the corpus or the surrogate of another entity. Of entities
    with one surrogate the one of the smallest id keeps it; the others get the least attempt whose surrogate is free,
    among the next ``attempts``, and twice as many after a round that settled none. ValueError names how many are left
    where that many attempts find no free value: their format's space is full. ``known`` is what :func:`entities` returns.
    """
    real = known.select("kind", F.col("id").alias("new"))

    def tried(left: DataFrame, first: int, n: int) -> DataFrame:
        """kind, id, entity, attempt and new of the attempts whose surrogates are nobody's real data."""
        rows = left.select("kind", "id", "entity", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("attempt"))
        to = surrogate(F.col("entity"), F.col("kind"), key, F.col("attempt"))
        return rows.select("kind", "id", "entity", "attempt", _held(to, lambda x: normal(x, F.col("kind"))).alias("new")).join(real, ["kind", "new"], "left_anti")

    def settled(rows: DataFrame) -> DataFrame:
        """At most one entity for each surrogate, and one attempt for each entity."""
        one = rows.groupBy("kind", "new").agg(F.min(F.struct("id", "attempt")).alias("x")).select("kind", F.col("x.id").alias("id"), F.col("x.attempt").alias("attempt"), "new")
        return one.groupBy("kind", "id").agg(F.min(F.struct("attempt", "new")).alias("x")).select("kind", "id", "x.attempt", "x.new")

    done = stored(settled(tried(known, 0, 1)), "surrogates")
    left = stored(known.join(done, ["kind", "id"], "left_anti").select("kind", "id", "entity"), "collisions")
    first, n, count, stalled = 1, attempts, left.count(), False
    while count:
        if stalled and n * count > MOST_TRIED:
            kinds = sorted(r.kind for r in left.select("kind").distinct().collect())
            raise ValueError(f"no free surrogates for {count} entities ({', '.join(kinds)}) in {first} attempts: too few values of their formats are left")
        new = stored(settled(tried(left, first, n).join(done.select("kind", "new"), ["kind", "new"], "left_anti")), "surrogates")
        done = done.unionByName(new)
        left = stored(left.join(new, ["kind", "id"], "left_anti"), "collisions")
        before, count, first = count, left.count(), first + n
        stalled = count == before
        n = 2 * n if stalled else n
    return done.where("attempt > 0").select("kind", "id", "attempt")


def session_key(spark: SparkSession) -> str:
    """The secret key: the setting ``spark.vantage.pii.key``, or else a random one of this Spark application."""
    key = spark.conf.get(KEY, None) or _random_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))
    return key


def replace(docs: DataFrame, key: str, keep: bool = False) -> DataFrame:
    """Replace personal data in ``docs`` (doc_id, text) by surrogates under a secret key.

    Whoever has the key can undo most surrogates. Returns doc_id, text, n_entities and kinds (distinct, sorted); with
    ``keep`` all columns of ``docs`` and n_entities, whose name begins with further underscores where ``docs`` holds it.
    A null text stays null with 0 entities; texts without an entity stay as they are, byte for byte; repeated rows
    get the same text; null doc_ids are kept; an empty table gives an empty table. Names without a title before
    them are not found.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    found, row, again, number = free_name(docs.columns, "_found", "_row", "_again", "n_entities")
    exceptions = retried(stored(entities(docs), "entities"), key)
    rows = docs.withColumn(found, F.when(F.col("text").isNotNull(), _found(docs)).otherwise(F.array().cast("array<string>")))
    attempt = lambda e, k: F.lit(0)
    if not exceptions.isEmpty():
        # Only texts with such an entity meet the exceptions; the others keep attempt 0.
        rows = rows.withColumn(row, F.xxhash64("text"))
        own = rows.select(F.col(row), F.explode(found).alias("e")).distinct().withColumn("kind", kind_of(F.col("e"))).withColumn("id", normal(F.col("e"), F.col("kind")))
        own = own.join(exceptions, ["kind", "id"]).groupBy(row).agg(F.map_from_entries(F.collect_set(F.struct("e", "attempt"))).alias(again))
        rows = rows.join(own, row, "left")
        attempt = lambda e, k: F.coalesce(F.element_at(F.col(again), e), F.lit(0))
    new = F.transform(F.col(found), lambda e: _held(kind_of(e), lambda k: surrogate(e, k, key, attempt(e, k))))
    # As many pieces stand between the entities as there are entities, and one more.
    whole = F.array_join(F.flatten(F.zip_with(F.split(F.col("text"), ENTITY, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = rows.withColumn("text", F.when(F.size(found) > 0, whole).otherwise(F.col("text"))).withColumn(number, F.size(found))
    if keep:
        return out.select(*docs.columns, number)
    kinds = F.array_sort(F.array_distinct(F.transform(found, kind_of)))
    return out.select("doc_id", "text", F.col(number).alias("n_entities"), kinds.alias("kinds"))
