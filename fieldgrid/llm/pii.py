"""PII surrogates (native).

Entities are found by patterns (e-mail, phone, card, IPv4, IBAN, national
number, secrets, titled names). Each mention has a type and a canonical form
(digits of a phone, lower-cased address and so on), so the same entity in
several spellings is one entity. Every distinct entity of the whole corpus gets
one surrogate, drawn from SHA-256 of a key, the type, the canonical form and an
attempt number:

Secrets are values of any length: those named by what stands before them (with
a digit, from 6 characters), hexadecimal keys from 32 digits, and AKIA, gh?_,
sk- (from 20 characters; hyphens inside only with a digit) and xox?- tokens.

* letters become letters of the same script and case, digits become digits,
  punctuation stays, so the format is kept; letters of scripts without a listed
  alphabet become Latin ones, so no letter is copied; IPv4 parts stay in
  1..223/0..255; a card that passes the Luhn test gets a surrogate that passes it
  too; an IBAN keeps its country and gets valid check digits;
* titled names draw a given name of the title's gender and of the name's script,
  made of syllables, so there are as many names as are needed.

Collision checks: each entity proposes several attempts. A proposal that is a
real entity of the corpus is void; one made by several entities belongs to the
least of them (by canonical form); each entity takes its first own proposal.
Those left without one, as in a type whose forms are used up, go to further
attempts, which are longer each time: more syllables, or added digits. So
distinct entities keep distinct surrogates, and one entity has one surrogate
everywhere (coreference). The key is the caller's: who lacks it can't rebuild
the mapping.

Whether a text has entities is asked by type, and first for characters that the
type can't do without, so most texts never meet a pattern. Texts without entities
never leave the scan. Texts with entities are written once with their mentions
and joined to their replacements by the list of mentions. Defined cases: null
texts stay null with no entities; null or repeated ids are fine (nothing is keyed
by id); texts of any length are read whole; other columns, whatever their names,
pass through; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgrid.llm.common import materialise, text_or_empty

ATTEMPTS = 3

#: Titles and the gender they imply. Fixed values.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"]}
#: Consonants and vowels of which given names are made, and their last letters by gender. Fixed values.
NAMES = {
    "latin": ("b d f g h k l m n p r s t v z", "a e i o u", {"m": "n r s l k t", "f": "a"}),
    "cyrillic": ("б в г д з к л м н п р с т", "а е и о у", {"m": "н р с л к т", "f": "а я"}),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ", "α ε ι ο υ", {"m": "ς", "f": "α η"}),
}
_title = "|".join(sorted(TITLES["m"] + TITLES["f"], key=len, reverse=True))
#: What stands before a secret that only its name gives away; it stays. Fixed values.
NAMED = r"(?i:password|passwd|pwd|secret|api[_-]?key)[ \t]{0,2}[=:][ \t]{0,2}[\"']?"
#: Secrets have a least length and no greatest; they end at the last letter or digit before a character outside their class.
#: Possessive quantifiers keep long ones linear.
VALUE = r"[A-Za-z0-9](?=[A-Za-z0-9_+/.~-]{4}[_+/.~-]*+[A-Za-z0-9])(?:[_+/.~-]*+[A-Za-z0-9])++"
SK = r"sk-(?:(?=[A-Za-z0-9]{20})|(?=[A-Za-z_-]*+[0-9])(?=[A-Za-z0-9_-]{19}[_-]*+[A-Za-z0-9]))[A-Za-z0-9](?:[_-]*+[A-Za-z0-9])++"
#: type -> pattern; the order decides which one a mention belongs to.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?:" + NAMED + r"(?=[A-Za-z_+/.~-]*+[0-9])" + VALUE + r"|(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?=[0-9]*+[A-Fa-f])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)|gh[pousr]_[A-Za-z0-9]{36,}+|" + SK + r"|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9]))",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}|\([0-9]{3}\)[ -]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "person": r"(?<!\p{L})(?:" + _title + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?!\p{L})",
}
ANY = "|".join(PATTERNS.values())
LOWER, CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets from which a character of the same class is drawn: pattern of the class, first code point, size. Fixed values.
ASCII_CLASSES = [("[a-z]", 0x61, 26), ("[0-9]", 0x30, 10), ("[A-Z]", 0x41, 26)]
CASED = [("Latin", (0x61, 26), (0x41, 26)), ("Greek", (0x3B1, 17), (0x391, 17)), ("Cyrillic", (0x430, 32), (0x410, 32)), ("Armenian", (0x561, 38), (0x531, 38))]
UNCASED = [("Arabic", 0x628, 19), ("Bengali", 0x995, 20), ("Devanagari", 0x915, 37), ("Georgian", 0x10D0, 33), ("Han", 0x4E00, 20902), ("Hangul", 0xAC00, 11172), ("Hebrew", 0x5D0, 27), ("Hiragana", 0x304B, 24), ("Katakana", 0x30AB, 24), ("Thai", 0xE01, 46)]
WIDE_CLASSES = [(rf"[\p{{Is{n}}}&&[\p{{Lu}}\p{{Lt}}]]", *up) for n, _, up in CASED] + [(rf"[\p{{Is{n}}}&&\p{{L}}]", *low) for n, low, _ in CASED] + [(rf"[\p{{Is{n}}}&&\p{{L}}]", k, size) for n, k, size in UNCASED]
WIDE_CLASSES += [(r"[\p{Lu}\p{Lt}]", 0x41, 26), (r"\p{L}", 0x61, 26), (r"\p{N}", 0x30, 10)]


def holds_entity(text: Column) -> Column:
    """Whether any pattern matches. Each type is asked for only in texts with characters that it must have."""
    secret = F.array(text.rlike("[0-9]"), text.contains("AKIA"), text.contains("_"), text.contains("sk-"), text.contains("xox"), text.rlike("[a-fA-F]{32}"))
    guards = {"email": text.contains("@"), "secret": F.exists(secret, lambda x: x), "person": F.lit(True)}
    out = F.lit(False)
    for kind in ("person", "secret", "email"):
        out = (guards[kind] & text.rlike(PATTERNS[kind])) | out
    numbers = "|".join(PATTERNS[k] for k in ("iban", "ip", "ssn", "card", "phone"))
    return F.coalesce((text.rlike("[0-9][0-9.]") & text.rlike(numbers)) | out, F.lit(False))


def kind_of(mention: Column) -> Column:
    """The first type whose pattern spans the mention."""
    out = F.lit("person")
    for kind, pattern in reversed(PATTERNS.items()):
        if kind != "person":
            out = F.when(mention.rlike("^(?:" + pattern + ")$"), kind).otherwise(out)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """One form for all spellings of an entity. Titles go, but their gender stays in front of a name."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    name = F.regexp_replace(mention, r"^\S+ ", "")
    value = F.regexp_replace(mention, "^" + NAMED, "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "secret", F.when(value == F.upper(value), F.lower(value)).otherwise(value))
        .when(kind == "person", F.concat(_gender(mention), F.lit(":"), name))
        .otherwise(mention)
    )


def _gender(mention: Column) -> Column:
    female = F.regexp_replace(F.regexp_extract(mention, r"^(\S+)", 1), r"\.$", "").isin(TITLES["f"])
    return F.when(female, "f").otherwise("m")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _number(hex_digest: Column, at: int | Column, width: int = 7) -> Column:
    """A number from ``width`` hexadecimal digits of a digest."""
    return F.conv(F.substring(hex_digest, at, width), 16, 10).cast("long")


def _masked(text: Column, seed: Column) -> Column:
    """Each letter or digit drawn anew within its class; the draw depends on the seed and the place."""

    def draw(c: Column, i: Column) -> Column:
        n = F.pmod(F.xxhash64(seed, i), F.lit(1 << 40))
        letter = lambda first, size: F.decode(F.unhex(F.lpad(F.hex(n % size + first), 4, "0")), "UTF-16BE")
        out = c
        for pattern, first, size in reversed(WIDE_CLASSES):
            out = F.when(c.rlike(pattern), letter(first, size)).otherwise(out)
        out = F.when(c < "\x80", c).otherwise(out)
        for pattern, first, size in reversed(ASCII_CLASSES):
            out = F.when(c.rlike(pattern), letter(first, size)).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo ten."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _valid_card(masked: Column) -> Column:
    """The masked digits with their last one set so that the Luhn test passes."""
    body = F.substring(masked, F.lit(1), F.length(masked) - 1)
    return F.concat(body, ((F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))


def _check_digits(country: Column, body: Column) -> Column:
    """The two digits that make country + digits + body a valid IBAN."""
    each = F.split(F.concat(body, country, F.lit("00")), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.lpad((F.lit(98) - F.aggregate(each, F.lit(0), step)).cast("string"), 2, "0")


def _given(seed: Column, syllables: Column, script: str, gender: str) -> Column:
    """A capitalised name of so many syllables and a last letter of the gender, drawn from the seed."""
    consonants, vowels, last = NAMES[script]
    each = F.array(*[F.lit(c + v) for c in consonants.split() for v in vowels.split()])
    ends = last[gender].split()
    pick = lambda letters, i: F.get(letters, F.pmod(F.xxhash64(seed, i), F.size(letters)).cast("int"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), syllables), lambda i: pick(each, i)), "")
    front = F.substring(body, F.lit(1), F.length(body) - 1) if gender == "f" else body
    return F.initcap(F.concat(front, pick(F.array(*map(F.lit, ends)), F.lit(0))))


def _name(canon: Column, seed: Column, syllables: Column) -> Column:
    """gender:Given[ Family] -> the same shape with a given name of the gender and script; the family name keeps its format."""
    gender, name = F.substring(canon, 1, 1), F.substring(canon, F.lit(3), F.length(canon))
    first, family = F.substring_index(name, " ", 1), F.regexp_extract(name, r"^\S+ (.*)$", 1)
    given = F.concat(_masked(first, seed), F.repeat(_masked(F.right(first, F.lit(1)), seed), syllables - 3))
    for script in NAMES:
        for g in "mf":
            given = F.when((gender == g) & first.rlike(rf"^\p{{Is{script.title()}}}"), _given(seed, syllables, script, g)).otherwise(given)
    return F.concat(gender, F.lit(":"), F.when(family == "", given).otherwise(F.concat_ws(" ", given, _masked(family, seed))))


def propose(entities: DataFrame, key: str, first_attempt: int, attempts: int = ATTEMPTS) -> DataFrame:
    """kind, canon, attempt, surrogate: keyed proposals in canonical form. Attempts beyond the first round are longer: names
    have more syllables, other types more digits, which follow an ``x`` in types whose form is fixed."""
    tries = entities.select("kind", "canon", F.explode(F.sequence(F.lit(first_attempt), F.lit(first_attempt + attempts - 1))).alias("attempt"))
    tries = tries.withColumn("seed", _digest(key, F.col("kind"), F.col("canon"), F.col("attempt").cast("string")))
    tries = tries.withColumn("m", _masked(F.col("canon"), F.col("seed")))
    tries = tries.withColumn("real_luhn", F.when(F.col("kind") == "card", _luhn(F.col("canon")) == 0).otherwise(F.lit(False)))
    added = F.greatest(F.col("attempt") - ATTEMPTS + 1, F.lit(0)) * 4
    extra = F.substring(F.translate("seed", "abcdef", ""), F.lit(1), added)
    part = lambda k, low, size: (_number(F.col("seed"), 1 + 7 * k) % size + low).cast("string")
    address = F.concat_ws(".", part(0, 1, 223), part(1, 0, 256), part(2, 0, 256), part(3, 1, 254))
    local, domain = F.substring_index("m", "@", 1), F.substring_index("canon", "@", -1)
    host = F.concat(F.lit("mail"), (_number(_digest(key, F.lit("domain"), domain), 1, 12) % 10**12).cast("string"), F.lit(".example.org"))
    kept = lambda n: F.concat(F.substring(F.col("canon"), 1, n), F.expr(f"substring(m, {n + 1})"))
    card = _valid_card(F.col("m"))
    country = F.length(F.col("canon")) - 10  # digits before a ten-digit number stay
    phone = F.when(country.between(1, 3), F.expr("concat(substring(canon, 1, length(canon) - 10), substring(m, length(canon) - 9))")).otherwise(F.col("m"))
    hexed = F.translate(F.col("m"), "ghijklmnopqrstuvwxyz", "abcdefabcdefabcdefab")
    land, account = F.substring("canon", 1, 2), F.expr("substring(m, 5)")
    secret = (
        F.when(F.col("canon").startswith("akia") & (F.length("canon") == 20), kept(4))
        .when(F.col("canon").rlike("^[0-9a-f]+$"), hexed)
        .when(F.col("canon").rlike("^(gh._|xox.-)"), kept(4))
        .when(F.col("canon").startswith("sk-"), kept(3))
        .otherwise(F.col("m"))
    )
    fixed = F.when(F.col("kind") == "ip", address).when(F.col("real_luhn"), card).when(F.col("kind") == "phone", phone).when(F.col("kind") == "iban", F.concat(land, _check_digits(land, account), account)).otherwise(F.col("m"))
    out = (
        F.when(F.col("kind") == "email", F.concat(local, extra, F.lit("@"), host))
        .when(F.col("kind") == "secret", F.concat(secret, extra))
        .when(F.col("kind") == "person", _name(F.col("canon"), F.col("seed"), F.col("attempt") + 3))
        .otherwise(F.concat(fixed, F.when(added > 0, F.concat(F.lit("x"), extra)).otherwise(F.lit(""))))
    )
    return tries.select("kind", "canon", "attempt", out.alias("surrogate"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, canon), distinct -> kind, canon, surrogate, with distinct surrogates that are no real entity.
    Rounds go on until every entity has one; they are few, for each has ten thousand times the forms of the one before."""
    done, left, turn = None, entities, 0
    while True:
        tries = propose(left, key, turn * ATTEMPTS).join(entities.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            tries = tries.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        owned = tries.groupBy("kind", "surrogate").agg(F.min(F.struct("canon", "attempt")).alias("o")).select("kind", "surrogate", "o.canon", "o.attempt")
        chosen = materialise(owned.groupBy("kind", "canon").agg(F.min_by("surrogate", "attempt").alias("surrogate")), "surrogates")
        done = chosen if done is None else done.unionByName(chosen)
        left, turn = materialise(left.join(chosen, ["kind", "canon"], "left_anti"), "unassigned"), turn + 1
        if left.isEmpty():
            return done


def _spelled(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The canonical surrogate in the mention's own spelling. ``plain`` is the mention's letters and digits."""
    chars = F.split(mention, "")
    # running count of the digits (or, for IBAN, of all but spaces) up to each character
    counted = F.when(kind == "iban", F.regexp_replace(mention, "[^ ]", "x")).otherwise(F.regexp_replace(F.regexp_replace(mention, "[^0-9]", " "), "[0-9]", "x"))
    fill = F.array_join(
        F.transform(chars, lambda c, i: F.when(F.substring(counted, i + 1, F.lit(1)) == "x", F.substring(surrogate, F.length(F.replace(F.substring(counted, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))).otherwise(c)), ""
    )
    added = F.when(surrogate.contains("x"), F.concat(F.lit("-"), F.substring_index(surrogate, "x", -1))).otherwise(F.lit(""))
    title = F.regexp_extract(mention, r"^(\S+ )", 1)
    front = F.regexp_extract(mention, "^(" + NAMED + ")", 1)
    value = F.regexp_replace(mention, "^" + NAMED, "")
    shouted = (F.upper(value) == value) & (F.lower(value) != value)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(fill, added))
        .when(kind == "ip", F.concat(F.substring_index(surrogate, "x", 1), added))
        .when(kind == "person", F.concat(title, F.substring(surrogate, F.lit(3), F.length(surrogate))))
        .when(kind == "secret", F.concat(front, F.when(shouted, F.upper(surrogate)).otherwise(surrogate)))
        .when((kind == "email") & shouted, F.upper(surrogate))
        .otherwise(surrogate)
    )


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + ANY + ")"), F.lit(1))


def with_surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with ``text`` rewritten, plus _kinds: the types of its mentions in order (empty if there are none)."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_t"))
    has = holds_entity(F.col("_t"))
    clean = packed.filter(~has).select("_row", "_t", F.array().cast("array<string>").alias("_kinds"))
    listed = materialise(packed.filter(has).select("_row", "_t", mentions_of(F.col("_t")).alias("_m")), "mentions").withColumn("list", F.sha2(F.array_join("_m", "\x1f"), 256))
    lists = materialise(listed.select("list", F.col("_m").alias("m")).groupBy("list").agg(F.first("m").alias("m")), "mention-lists")
    each = lists.select("list", F.posexplode("m").alias("pos", "mention"))
    kind = kind_of(F.col("mention"))
    spellings = materialise(each.select("mention").distinct().select("mention", kind.alias("kind")).select("mention", "kind", canonical(F.col("kind"), F.col("mention")).alias("canon")), "spellings")
    entities = materialise(spellings.select("kind", "canon").distinct(), "entities")
    replaced = spellings.join(assign(entities, key), ["kind", "canon"]).select("mention", "kind", _spelled(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"))
    filled = each.join(replaced, "mention").groupBy("list").agg(F.array_sort(F.collect_list(F.struct("pos", "new", "kind"))).alias("r"))
    filled = materialise(filled.select("list", "r.new", F.col("r.kind").alias("_kinds")), "replacements")
    dirty = listed.drop("_m").join(filled, "list")
    between = F.split("_t", ANY, -1)
    rebuilt = F.array_join(F.zip_with(between, F.concat("new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    both = clean.unionByName(dirty.select("_row", rebuilt.alias("_t"), "_kinds"))
    return both.select(F.col("_row").withField(text, F.col("_t")).alias("_row"), "_kinds").select("_row.*", "_kinds")


def scrub(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in place of entities, columns as they were."""
    names = docs.columns
    return with_surrogates(docs, key, text).select(*[F.col(f"`{c}`") for c in names])


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the rewritten text, and how many mentions of each type were replaced."""
    done = with_surrogates(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", F.size("_kinds").cast("long").alias("n_entities"), *map(count, PATTERNS))
