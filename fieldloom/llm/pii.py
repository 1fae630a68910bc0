"""Personal data replaced by surrogates, with DataFrame functions alone.

Mail addresses, phone and card numbers, network addresses, keys and titled names
are found by one pattern; a number is a card's only if its check digit holds. A
mention is drawn from one entity or, for a name, from two: the given and the
family name are entities of their own, so that short and full mentions agree. An
entity's surrogate comes from a keyed hash of its kind and its value in a plain
spelling, so it is the same in every document. A surrogate keeps the kind's form:
separators, country code, issuer digit and check digit of numbers, hexadecimal
digits and case of keys, and for names the title, the gender that titles tell, and
the script. Two entities, or an entity and a surrogate, that would read the same
are told apart: all but the first draw again, from more surrogates each time,
until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined_evenly, let, row_digest, sent_whole, text_or_empty, written

# Titles by the gender that they tell, in Latin, Cyrillic and Greek script.
MALE = "Mr Herr Herrn Monsieur Señor Sr Signor Господин Κύριος".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Mademoiselle Señora Señorita Sra Signora Госпожа Κυρία".split()
EITHER = "Dr Prof Professor Доктор".split()
# Consonants, vowels and closings of made-up syllables, and endings of made-up names, by script.
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v w z".split(), "a e i o u".split(), ["", "l", "n", "r", "s", "m"]),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х ш".split(), "а е и о у".split(), ["", "л", "н", "р", "с", "м"]),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ ψ".split(), "α ε ι ο ω".split(), ["", "λ", "ν", "ρ", "σ", "μ"]),
}
ENDINGS = {
    ("latin", "male"): "an en or us ard win to mund".split(),
    ("latin", "female"): "a ia ina ela ette ora issa anne".split(),
    ("latin", "either"): "ey in is ley ay el er ow".split(),
    ("latin", "family"): "son berg ley mont field well hart stein ford worth".split(),
    ("cyrillic", "male"): "ан ен ор ий ад мир слав ей".split(),
    ("cyrillic", "female"): "а ия ина ена ора иса яна ея".split(),
    ("cyrillic", "either"): "и о ай ель ин ис уш ко".split(),
    ("cyrillic", "family"): "енко ский ович юк чук дзе ян их".split(),
    ("greek", "male"): "ος ης ας ων ιος ινος ικος ανος".split(),
    ("greek", "female"): "α η ια ινα ελα ορα ισσα ανη".split(),
    ("greek", "either"): "ι ω υς ις αξ ελ ιν ορ".split(),
    ("greek", "family"): "ιδης οπουλος ακης ατος ογλου ιου ινος αντης".split(),
}
TITLES = "|".join(sorted([*MALE, *FEMALE, *EITHER], key=lambda t: (-len(t), t)))
NOISE = r"[^\w\s]{0,3}"
EMAIL = r"(?<![\p{L}\p{N}._%+@-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
HEX = r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])"
SECRET = r"(?<=[\"'])(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key)[\"']?\s{0,2}[:=]\s{0,2}[\"'])[^\s\"']{8,}+(?=[\"'])"
IPV4 = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
PHONE = rf"\+\d{{1,3}}{NOISE}[ .-]?\(?\d{{2,4}}\)?{NOISE}[ .-]?\d{{3,4}}{NOISE}[ .-]?\d{{2,4}}(?:[ .-]\d{{2,4}})?(?!\d)|(?<![\p{{L}}\p{{N}}])(?:\(\d{{3}}\){NOISE} ?|\d{{3}}[.-])\d{{3}}[.-]\d{{4}}(?!\d)"
CARD = r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\p{L}\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?"
PATTERN = "|".join((EMAIL, IPV4, HEX, SECRET, PHONE, CARD, NAME))
KINDS = ("email", "ip", "phone", "card", "name", "key")
KEY = "surrogates-1"
FIXED_FORM = 8  # draws within the form of an entity; further ones are longer
BROADCAST_TEXTS = 100_000
MARK, HELD, MARK_SAID, HELD_SAID = "\x01", "\x02", "\x02\x03", "\x02\x04"  # what stands around a mention, and what stands for these signs in texts


def kind_of(value: Column) -> Column:
    """What a mention is, by its own form; null for a number that only looks like a card's."""
    return (
        F.when(value.contains("@") & value.rlike(rf"^(?:{EMAIL})$"), "email")
        .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(value.rlike(rf"^(?:{CARD})$"), F.when(luhn(value) % 10 == 0, "card"))
        .when(value.rlike(rf"^(?:{PHONE})$"), "phone")
        .when(value.rlike(rf"^(?:{NAME})$"), "name")
        .otherwise("key")
    )


def plain(value: Column, kind: Column) -> Column:
    """The spelling under which one entity's mentions are the same."""
    return F.when(kind.isin("phone", "card"), F.regexp_replace(value, r"\D", "")).otherwise(F.lower(value))


def title_of(name: Column) -> Column:
    return F.regexp_extract(name, rf"^((?:{TITLES})\.?)", 1)


def names_of(name: Column) -> Column:
    """The names after the title: a family name, or a given and a family name."""
    return F.split(F.trim(F.substr(name, F.length(title_of(name)) + 1, F.length(name))), " +")


def gender_of(name: Column) -> Column:
    """The gender that a name's title tells."""
    bare = F.regexp_replace(title_of(name), r"\.", "")
    return F.when(bare.isin(MALE), "male").when(bare.isin(FEMALE), "female").otherwise("either")


def digest(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits keyed by ``key``."""
    said = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(F.sha2(said, 256), F.sha2(F.concat(said, F.lit("|+")), 256))


def byte(hexes: Column, i: Column) -> Column:
    """The ``i``th byte of a digest, which begins anew where it ends."""
    return F.conv(F.substr(hexes, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(choices: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(number, F.lit(len(choices))).cast("int"))


def letters(hexes: Column, n: Column) -> Column:
    """A word of ``n`` letters, consonant and vowel in turn."""
    either = lambda i: F.when(i % 2 == 0, pick(list("bcdfghjklmnprstvz"), byte(hexes, i) + byte(hexes, i + 32) * 7)).otherwise(pick(list("aeiou"), byte(hexes, i) + byte(hexes, i + 32) * 7))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), either), "")


def each_sign(value: Column, change) -> Column:
    """``value`` with ``change(sign, position)`` in place of each sign."""
    return F.array_join(F.transform(F.split(value, ""), change), "")


def digits(value: Column, hexes: Column) -> Column:
    """``value`` with its digits drawn anew, each by how many digits come before it, whatever stands between them."""
    before = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"\D", ""))
    drawn = lambda i: F.pmod(byte(hexes, i) * 7 + byte(hexes, i + 31), F.lit(10)).cast("string")
    return each_sign(value, lambda c, i: F.when(c.between("0", "9"), drawn(before(i))).otherwise(c))


def longer(made: Column, own: Column, attempt: Column) -> Column:
    """``made`` with digits after it where the draws within the form are used up."""
    more = F.array_join(F.transform(F.sequence(F.lit(1), attempt - FIXED_FORM), lambda i: F.pmod(byte(own, i + 40), F.lit(10)).cast("string")), "")
    return F.when(attempt > FIXED_FORM, F.concat(made, more)).otherwise(made)


def luhn(number: Column) -> Column:
    """The sum of the check for card numbers, over the digits from the right."""
    signs = F.split(F.reverse(F.regexp_replace(number, r"\D", "")), "")
    doubled = F.transform(signs, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def surrogate(value: Column, kind: Column, key: str, attempt: Column, gender: Column) -> Column:
    """The replacement of one entity; values with the same plain spelling give ones that differ in layout and case only."""
    own = digest(key, kind, plain(value, kind), attempt.cast("string"))
    made = {
        "email": lambda h: mail(value, h, key, attempt),
        "ip": lambda h: network(h, attempt),
        "phone": lambda h: longer(phone(value, h), h, attempt),
        "card": lambda h: longer(card(value, h), h, attempt),
        "given": lambda h: name(value, h, gender, attempt),
        "family": lambda h: name(value, h, F.lit("family"), attempt),
        "key": lambda h: longer(secret(value, h), h, attempt),
    }
    out = F.lit(None).cast("string")
    for said, make in made.items():
        out = F.when(kind == said, let(own, make)).otherwise(out)
    return out


def mail(value: Column, own: Column, key: str, attempt: Column) -> Column:
    """A word and the layout of the digits after it; the domain has a word of its own, under a name kept for examples."""
    local, domain = F.substring_index(value, "@", 1), F.lower(F.substring_index(value, "@", -1))
    tail = F.regexp_extract(local, r"([._-]?\d*)$", 1)
    shout = (F.upper(local) == local) & (F.lower(local) != local)
    word = let(letters(own, attempt + 8), lambda w: F.when(shout, F.upper(w)).otherwise(w))
    host = let(digest(key, F.lit("domain"), domain), lambda h: letters(h, F.lit(6)))
    return F.concat(word, digits(tail, own), F.lit("@"), host, F.lit(".example."), F.substring_index(domain, ".", -1))


def network(own: Column, attempt: Column) -> Column:
    """An address of the same form, or one of the longer form that is kept for examples once the draws are used up."""
    short = F.concat_ws(".", *[(F.pmod(byte(own, F.lit(i)), F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4)])
    return F.when(attempt > FIXED_FORM, F.concat(F.lit("2001:db8:"), F.regexp_replace(F.substring(own, 1, 24), "(....)(?=.)", "$1:"))).otherwise(short)


def phone(value: Column, own: Column) -> Column:
    """The country code stays."""
    code = F.regexp_extract(value, r"^(\+\d{1,3}[^\w\s]{0,3})", 1)
    return F.concat(code, digits(F.substr(value, F.length(code) + 1, F.length(value)), own))


def card(value: Column, own: Column) -> Column:
    """The issuer's digit stays, and the last digit is the check over the others."""
    drawn = F.concat(F.substring(value, 1, 1), digits(F.substr(value, F.lit(2), F.length(value)), own))
    ended = lambda body: F.concat(body, F.pmod(F.lit(10) - F.pmod(luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))
    return let(F.substr(drawn, F.lit(1), F.length(drawn) - 1), ended)


def secret(value: Column, own: Column) -> Column:
    """Hexadecimal keys stay so; other signs keep their class and case."""
    bare_hex, shout = value.rlike("^[0-9a-fA-F]+$"), F.upper(value) == value

    def sign(c: Column, i: Column) -> Column:
        n = byte(own, i)
        nibble = F.substr(F.lit("0123456789abcdef"), F.pmod(n, F.lit(16)) + 1, F.lit(1))
        letter = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(n + byte(own, i + 29), F.lit(26)) + 1, F.lit(1))
        plain_sign = F.when(c.between("0", "9"), F.pmod(n, F.lit(10)).cast("string")).when(c.between("a", "z"), letter).when(c.between("A", "Z"), F.upper(letter)).otherwise(c)
        return F.when(bare_hex, F.when(shout, F.upper(nibble)).otherwise(nibble)).otherwise(plain_sign)

    return each_sign(value, sign)


def name(value: Column, own: Column, gender: Column, attempt: Column) -> Column:
    """A name of ``value``'s script and case: made-up syllables, one more with each attempt, and an ending of its gender or of families."""
    script = F.when(value.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def spelt(said: str) -> Column:
        consonants, vowels, closings = SYLLABLES[said]
        syllable = lambda i: F.concat(pick(consonants, byte(own, i * 3)), pick(vowels, byte(own, i * 3 + 1)), pick(closings, byte(own, i * 3 + 2)))
        end = F.lit("")
        for (of, kind), endings in ENDINGS.items():
            if of == said:
                end = F.when(gender == kind, pick(endings, byte(own, F.lit(63)))).otherwise(end)
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), syllable), ""), end)

    word = F.lit("")
    for said in SYLLABLES:
        word = F.when(script == said, spelt(said)).otherwise(word)
    shout = (F.upper(value) == value) & (F.length(value) > 1)
    return let(word, lambda w: F.when(shout, F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w)))))


def parted(text: Column) -> Column:
    """A text in parts: what stands between mentions, and at each odd place a mention."""
    held = F.replace(F.replace(text, F.lit(HELD), F.lit(HELD_SAID)), F.lit(MARK), F.lit(MARK_SAID))
    return F.split(F.regexp_replace(held, f"(?:{PATTERN})", f"{MARK}$0{MARK}"), MARK, -1)


def whole(text: Column) -> Column:
    """The text whose parts, joined, are ``text``."""
    return F.replace(F.replace(text, F.lit(MARK_SAID), F.lit(MARK)), F.lit(HELD_SAID), F.lit(HELD))


def entities_of(value: Column) -> Column:
    """The entities that a mention is drawn from, as an array of (kind, plain, value, gender)."""

    def one(kind: Column, said: Column, gender: Column) -> Column:
        return F.struct(kind.alias("kind"), plain(said, kind).alias("plain"), said.alias("value"), gender.alias("gender"))

    either = F.lit("either")
    of_name = let(names_of(value), lambda n: F.when(F.size(n) > 1, F.array(one(F.lit("given"), F.get(n, F.lit(0)), gender_of(value)), one(F.lit("family"), F.element_at(n, -1), either))).otherwise(F.array(one(F.lit("family"), F.element_at(n, -1), either))))
    return let(kind_of(value), lambda k: F.when(k == "name", of_name).when(k.isNotNull(), F.array(one(k, value, either))))


def exceptions(found: DataFrame, key: str) -> DataFrame:
    """(kind, plain, attempt, gender) of the entities in ``found`` (kind, plain, value, gender) that may not keep the first draw of all their mentions.

    Entities are made distinct before they are compared, so a value that most
    documents hold is one row. An entity draws again while its surrogate reads as
    that of an entity before it (by spelling), or as any entity of the corpus. A
    given name's gender is the one that all of its titles tell, or either.
    """
    told = F.collect_set(F.when(F.col("gender") != "either", F.col("gender")))
    grouped = found.groupBy("kind", "plain").agg(F.min("value").alias("value"), told.alias("told"), F.count_distinct("gender").alias("genders"))
    gender = F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise("either")
    entities = cut(grouped.select("kind", "plain", "value", gender.alias("gender"), (F.col("genders") > 1).alias("mixed")))
    real = entities.select("kind", F.col("plain").alias("reads"))
    settled, open_, attempt = None, entities, 0
    while True:
        drawn = open_.withColumn("reads", plain(surrogate(F.col("value"), F.col("kind"), key, F.lit(attempt), F.col("gender")), F.col("kind")))
        taken = real if settled is None else real.unionAll(settled.select("kind", "reads"))
        held = taken.distinct().withColumn("held", F.lit(True))
        firsts = drawn.groupBy("kind", "reads").agg(F.min("plain").alias("first"))
        judged = cut(drawn.join(firsts, ["kind", "reads"]).join(held, ["kind", "reads"], "left").withColumn("fine", F.col("held").isNull() & (F.col("plain") == F.col("first"))))
        good = judged.where("fine").select("kind", "plain", "reads", "gender", "mixed", F.lit(attempt).alias("attempt"))
        settled = good if settled is None else settled.unionAll(good)
        open_ = judged.where(~F.col("fine")).select("kind", "plain", "value", "gender", "mixed")
        if open_.isEmpty():
            return settled.where("attempt > 0 or mixed").select("kind", "plain", "attempt", "gender")
        attempt += 1


def surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(row columns, text, n_entities, n_<kind>…): ``docs`` with each mention in ``text`` replaced, and the counts of mentions.

    All rows and all columns but ``text`` stay as they are; counts that clash with
    a column's name take its place (names that begin with ``_fl_`` are reserved). A
    null text stays null and an empty one empty, with no mentions. A mention is
    replaced in each row that repeats it, in whole texts of any length. An empty
    table gives no rows.

    The pattern runs twice over each text: to gather the entities, and to replace
    the mentions. Draws other than the first are few; they come to the texts that
    need them, told by 128-bit digests, and are sent whole under a bound.
    """
    said = docs.select(row_digest("text").alias("_fl_key"), F.explode(F.filter(parted(text_or_empty()), lambda p, i: i % 2 == 1)).alias("value"))
    found = written(said.select("_fl_key", F.explode(entities_of(F.col("value"))).alias("e")).select("_fl_key", "e.*"))
    other = cut(exceptions(found, key))
    rows = docs.withColumn("_fl_parts", parted(text_or_empty()))
    draw = lambda kind, said, gender: F.struct(F.lit(0).alias("attempt"), gender.alias("gender"))
    if not other.isEmpty():
        named = F.concat_ws("|", "kind", "plain").alias("entity")
        asked = cut(found.select("_fl_key", named).distinct())
        table = other.select(named, F.struct("attempt", "gender").alias("draw"))
        own = joined_evenly(asked, table, "entity", "_fl_key", counted=asked).groupBy("_fl_key").agg(F.map_from_entries(F.collect_list(F.struct("entity", "draw"))).alias("_fl_draws"))
        rows = rows.withColumn("_fl_key", row_digest("text")).join(sent_whole(cut(own), BROADCAST_TEXTS), "_fl_key", "left")
        draw = lambda kind, said, gender: F.coalesce(F.element_at("_fl_draws", F.concat_ws("|", kind, said)), F.struct(F.lit(0).alias("attempt"), gender.alias("gender")))
    one = lambda e: let(draw(e["kind"], e["plain"], e["gender"]), lambda d: surrogate(e["value"], e["kind"], key, d["attempt"], d["gender"]))
    titled = lambda v, drawn: F.when(kind_of(v) == "name", F.concat(title_of(v), F.lit(" "), drawn)).otherwise(drawn)
    replaced = lambda v: F.coalesce(titled(v, F.array_join(F.transform(entities_of(v), one), " ")), v)
    out = F.transform("_fl_parts", lambda p, i: F.when(i % 2 == 1, replaced(p)).otherwise(p))
    text = F.when(F.size("_fl_parts") > 1, whole(F.array_join(out, ""))).otherwise(F.col("text"))
    kinds = F.filter(F.transform("_fl_parts", lambda p, i: F.when(i % 2 == 1, kind_of(p))), lambda k: k.isNotNull())
    counted = lambda said: F.size(F.filter("_fl_kinds", lambda k: k == F.lit(said))).cast("long").alias(f"n_{said}")
    names = {"n_entities", *(f"n_{k}" for k in KINDS)}
    return rows.withColumn("_fl_kinds", kinds).select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in names], F.size("_fl_kinds").cast("long").alias("n_entities"), *[counted(k) for k in KINDS])
