"""Keyed, type-consistent surrogates for personal data (operator 2, built-in functions only).

Entities are found by one pattern. Every distinct entity of the corpus gets a
surrogate derived from a key, its type and its canonical form: digits stay
digits, letters letters, separators stay where they are, card numbers keep their
first digit and whether their check digit is right, octets stay octets of equal
width, names keep the gender of their title and the script of their letters. Forms
that mean the same (a phone number with and without blanks) share a canonical
form, hence a surrogate, in every document.

Collision checks: two canonical forms of a type (given names, by gender, are one of
their own) may not share a surrogate, and no
surrogate may equal a form that occurs in the corpus. Those that do are derived
again with the next attempt number until none is left. What a format cannot settle
in ``ATTEMPTS`` tries gets a wider one: a longer local part, more sounds, octets
and phone numbers of full length, more digits.

Coreference: a document that names a person by title may name the same person
without one. There, every word that is part of a titled name of the document (the
family name or a given name, as it is written) is replaced like that part.

Scale: only matches travel; a hot entity is joined as a row of a small table; text
meets its document's replacements once, by document id and text hash. Matches are
numbered in their text and meet its pieces by number, so a text of many entities
takes a time linear in its length.

Cases: null text stays null and has no entities; texts without matches are
returned as they are; null and repeated doc_ids are told apart by text;
matches are found left to right and never overlap.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import common as C

KEY = "surrogates/v1"
#: Replacements (at most some 100 bytes each) of all texts together that may be broadcast.
MOST_ENTRIES = 100_000
#: Tries inside an entity's own format; later ones widen it.
ATTEMPTS = 40

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Titles by gender; fixed values.
MASCULINE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Senhor", "Sir", "господин", "Господин", "κύριος", "Κύριος")
FEMININE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Signora", "Senhora", "госпожа", "Госпожа", "κυρία", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Mx", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Doctora", "Profesor", "Profesora", "доктор", "профессор")
#: One or more titles with the blanks after them.
_TITLES = rf"(?:(?:{'|'.join(MASCULINE + FEMININE + NEUTRAL)})\.? )+"
#: A word of a name: hyphens, and apostrophes before a capital, are part of it.
_WORD = r"\p{Lu}(?:\p{L}{1,30}+|['’]\p{Lu}\p{L}{1,30}+)(?:-\p{L}{1,30}+|['’]\p{Lu}\p{L}{1,30}+){0,4}+"
_INITIAL = r"(?:\p{Lu}\. ?)"
#: Small words inside names; fixed values.
PARTICLES = ("van", "von", "de", "der", "den", "da", "di", "del", "della", "du", "dos", "das", "bin", "ibn", "ten", "ter", "zu", "la")
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)}) )"
_NAME = rf"(?:{_INITIAL}){{0,3}}{_PARTICLE}{{0,2}}{_WORD}(?: {_INITIAL}{{0,2}}{_PARTICLE}{{0,2}}{_WORD}){{0,3}}"
#: Entity types in order of precedence: name, pattern (Java syntax, no groups).
TYPES: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++){0,126}\.(?:[A-Za-z]{2,}+|[\p{L}\p{M}&&[^A-Za-z]]{2,}+)"),
    ("token", r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk)[_-](?:live|test|proj)[_-][0-9A-Za-z_-]{8,}+|sk-[0-9A-Za-z]{20,}+|gh[pousr]_[0-9A-Za-z]{36,}+|eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+)(?![0-9A-Za-z])"),
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])|(?<![0-9A-Za-z])NO[0-9]{2} ?[0-9]{4} ?[0-9]{4} ?[0-9]{3}(?![0-9A-Za-z])"),
    ("ip6", r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\p{L}\p{N}:])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}(?![0-9])|(?<![0-9+])\+[0-9]{7,15}(?![0-9])|(?<![0-9+])\+(?=(?:[ .-]?[0-9]){7,15}(?![0-9]))[0-9]{1,3}(?:[ .-][0-9]{1,12}){1,6}(?![0-9])|(?<![0-9])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|\.[0-9])|(?<![0-9])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?! ?[0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}]){_TITLES}{_NAME}"),
)


def _guarded() -> str:
    """All types in one pattern. Guards look at the next characters first, so prose is passed over at a glance."""
    p = dict(TYPES)
    heads = "".join(sorted({t[0] for t in MASCULINE + FEMININE + NEUTRAL}))
    digits = "|".join(p[k] for k in ("ip", "phone", "card", "ssn"))
    parts = (p["email"], f"(?=[Aeprgs])(?:{p['token']})", f"(?=[0-9A-Fa-f])(?:{p['secret']})", f"(?=[A-Z]{{2}}[0-9]{{2}})(?:{p['iban']})", f"(?=[0-9A-Fa-f:])(?:{p['ip6']})", f"(?=[(+0-9])(?:{digits})", f"(?=[{heads}])(?:{p['name']})")
    return "|".join(parts)


PATTERN = _guarded()
#: With the words that may be parts of names, for texts that hold titled ones.
WORDS_TOO = rf"{PATTERN}|(?<![\p{{L}}\p{{N}}]){_WORD}"
#: Sounds from which names are made, by script; the ending tells the gender.
SOUNDS = {
    "latin": "ba be di do fa ga hi jo ka le li ma mo na ne ra ri sa so va".split(),
    "cyrillic": "ба бе ди до фа га хи жо ка ле ли ма мо на не ра ри са со ва".split(),
    "greek": "βα βε δι δο φα γα χι ζο κα λε λι μα μο να νε ρα ρι σα σο τα".split(),
}
ENDINGS = {"latin": ("n", "lia", "r"), "cyrillic": ("н", "на", "р"), "greek": ("ν", "να", "ρ")}
#: Letters that stand for letters of scripts other than Latin; scripts with one case have one row. An entity in several of
#: them takes the first.
LETTERS = {
    "Cyrillic": ("абвгдежзиклмнопрстуфхцч", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧ"),
    "Greek": ("αβγδεζηθικλμνξοπρτυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΤΥΦΧΨΩ"),
    "Hebrew": ("אבגדהוזחטילמנסעפצקרשת",),
    "Arabic": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي",),
    "Devanagari": ("कखगघचछजझटठडढतथदधनपफबभमयरलवशसह",),
    "Hiragana": ("あいうえおかきくけこさしすせそたちつてとなにぬねの",),
    "Katakana": ("アイウエオカキクケコサシスセソタチツテトナニヌネノ",),
    "Hangul": ("가나다라마바사아자차카타파하고노도로모보소오조초코토포호",),
    "Han": ("山川田林木水火土石金天日月星春夏秋冬東西南北中大小",),
}


def _array(words) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def matches(text: Column, pattern: str = PATTERN) -> Column:
    """The entities of a text from left to right."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def entity_type(raw: Column) -> Column:
    found = F.lit("other")
    for name, pattern in reversed(TYPES):
        found = F.when(raw.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


#: Canonical form of entity ``raw`` of type ``kind``.
CANONICAL = """CASE WHEN kind = 'email' THEN lower(raw) WHEN kind IN ('phone', 'card', 'ssn') THEN regexp_replace(raw, '[^0-9]', '')
  WHEN kind IN ('secret', 'ip6', 'given_f', 'given_m', 'given_n') THEN lower(raw) WHEN kind = 'iban' THEN replace(raw, ' ', '') WHEN kind = 'name' THEN lower(element_at(split(raw, ' '), -1)) ELSE raw END"""


def _numbers(*parts: str) -> str:
    """SQL: 64 numbers from 0 to 65535, derived from the key and ``parts``."""
    seed = f"concat_ws('|', key, {', '.join(parts)}"
    digests = ", ".join(f"sha2({seed}, '{c}'), 256)" for c in "abcd")
    return f"transform(sequence(0, 63), i -> cast(conv(substr(concat({digests}), i * 4 + 1, 4), 16, 10) AS int))"


_AT = "element_at(nums, cast(pmod({k}, 64) AS int) + 1)"
_CHAR = """CASE WHEN {c} rlike '^[0-9]$' THEN cast({n} % 10 AS string)
  WHEN {c} rlike '^[a-z]$' THEN char(97 + {n} % 26) WHEN {c} rlike '^[A-Z]$' THEN char(65 + {n} % 26)
  WHEN {c} rlike '^\\\\p{{L}}$' THEN CASE WHEN lower({c}) = {c} THEN substr(small, {n} % length(small) + 1, 1) ELSE substr(large, {n} % length(large) + 1, 1) END ELSE {c} END"""


def _letters(case: int) -> str:
    """SQL: lower (0) or upper (-1) letters that stand for those of ``raw`` which are not a-z."""
    latin = "abcdefghijklmnopqrstuvwxyz"
    return "CASE " + " ".join(f"WHEN raw rlike '\\\\p{{Is{script}}}' THEN '{rows[case]}'" for script, rows in LETTERS.items()) + f" ELSE '{latin.upper() if case else latin}' END"


#: Head of a token that tells its issuer and stays.
_ISSUER = "^(AKIA|(?:sk|pk|rk)[_-](?:live|test|proj)[_-]|sk-|gh[pousr]_|eyJ)"


def _fold(raw: str, keep: int, char: str = _CHAR, nums: str = "nums") -> str:
    """SQL: ``raw`` with every letter and digit after the first ``keep`` of them replaced, separators left."""
    n = _AT.replace("nums", nums).format(k="acc.k")
    new = char.format(c="c", n=n)
    return f"""aggregate(split({raw}, ''), named_struct('o', '', 'k', 0), (acc, c) -> named_struct(
      'o', concat(acc.o, CASE WHEN acc.k < {keep} THEN c ELSE {new} END), 'k', acc.k + CASE WHEN c rlike '^[\\\\p{{L}}\\\\p{{N}}]$' THEN 1 ELSE 0 END), acc -> acc.o)"""


_HEX = "CASE WHEN {c} = '' THEN '' WHEN raw rlike '[A-F]' THEN substr('0123456789ABCDEF', {n} % 16 + 1, 1) ELSE substr('0123456789abcdef', {n} % 16 + 1, 1) END"
#: Sum over all digits but the check digit; from the right, every other one counts double.
_LUHN = "aggregate(sequence(1, length(canon) - 1), 0, (a, i) -> a + CASE WHEN (length(canon) - i) % 2 = 0 THEN cast(substr({d}, i, 1) AS int) ELSE cast(substr({d}, i, 1) AS int) * 2 - CASE WHEN cast(substr({d}, i, 1) AS int) > 4 THEN 9 ELSE 0 END END)"
_HEX6 = _HEX.replace("ELSE substr('0123456789abcdef', {n} % 16 + 1, 1) END", "WHEN {c} rlike '^[0-9A-Fa-f]$' THEN substr('0123456789abcdef', {n} % 16 + 1, 1) ELSE {c} END").replace("WHEN raw rlike '[A-F]'", "WHEN raw rlike '[A-F]' AND {c} rlike '^[0-9A-Fa-f]$'")
#: Digits of a card surrogate: first digit kept, check digit right if and only if the original's is.
_CARD_BODY = f"concat(substr(canon, 1, 1), array_join(transform(sequence(1, length(canon) - 2), i -> cast({_AT.format(k='i')} % 10 AS string)), ''))"
_CHECKED = f"pmod({_LUHN.format(d='canon')} + cast(substr(canon, -1, 1) AS int), 10) = 0"
_CARD = f"""concat(body, cast(pmod(10 - {_LUHN.format(d='body')} % 10 +
  CASE WHEN {_CHECKED} THEN 0 ELSE 1 + {_AT.format(k='15')} % 9 END, 10) AS string))"""
#: The digits of ``raw`` replaced by those of ``new_digits`` in order.
_REFORMAT = """aggregate(split(raw, ''), named_struct('o', '', 'k', 1), (acc, c) -> named_struct(
  'o', concat(acc.o, CASE WHEN c rlike '^[0-9]$' THEN substr(new_digits, acc.k, 1) ELSE c END), 'k', acc.k + CASE WHEN c rlike '^[0-9]$' THEN 1 ELSE 0 END), acc -> acc.o)"""
_IP = f"""array_join(transform(split(raw, '[.]'), (x, i) -> cast(CASE CASE WHEN wide THEN 3 ELSE length(x) END WHEN 3 THEN 100 + {_AT.format(k='i')} % 156 WHEN 2 THEN 10 + {_AT.format(k='i')} % 90 ELSE 1 + {_AT.format(k='i')} % 9 END AS string)), '.')"""


def _longer(many: int | str, char: str) -> str:
    """SQL: ``many`` more characters for a full format."""
    return f"array_join(transform(sequence(1, {many}), i -> {char.format(n=_AT.format(k='40 + i'))}), '')"


def _word(nums: str, ending: str) -> str:
    """SQL: a capitalised name of four sounds (ten in the wider format) in the script of the entity."""
    def made(script: str) -> str:
        sounds = _array(SOUNDS[script])
        sound = [f"element_at({sounds}, element_at({nums}, {i}) % 20 + 1)" for i in range(1, 11)]
        # a double name stays one
        body = f"concat({sound[0]}, {sound[1]}, CASE WHEN canon LIKE '%-%' THEN '-' ELSE '' END, {sound[2]}, {sound[3]}, CASE WHEN wide THEN concat({', '.join(sound[4:])}) ELSE '' END)"
        m, f, neutral = ENDINGS[script]
        end = {"given": f"CASE gender WHEN 'f' THEN '{f}' WHEN 'm' THEN '{m}' ELSE '{neutral}' END", "family": "''"}[ending]
        return f"array_join(transform(split(concat({body}, {end}), '-'), w -> initcap(w)), '-')"

    return f"CASE WHEN raw rlike '\\\\p{{IsCyrillic}} ?$' THEN {made('cyrillic')} WHEN raw rlike '\\\\p{{IsGreek}} ?$' THEN {made('greek')} ELSE {made('latin')} END"


#: SQL: word ``w`` of a name is a small one.
_IS_PARTICLE = f"w IN ({', '.join(repr(x) for x in PARTICLES)})"
#: SQL: the given names among ``words``: all but the last, small words and initials.
_GIVENS = f"filter(slice(words, 1, size(words) - 1), w -> NOT w LIKE '%.' AND NOT {_IS_PARTICLE})"


def _parts_of_names(e: DataFrame) -> DataFrame:
    """``e`` with the title and words of names and the gender of the title (n: none); a given name's is in its kind."""
    e = e.withColumn("title", F.when(F.col("kind") == "name", F.regexp_extract("raw", f"^({_TITLES})", 1)))
    e = e.withColumn("words", F.when(F.col("kind") == "name", F.split(F.regexp_replace(F.expr("substr(raw, length(title) + 1)"), r"\.(?=\p{L})", ". "), " ")))
    feminine, masculine = (F.col("title").rlike(rf"(?:^| )(?:{'|'.join(t)})[. ]") for t in (FEMININE, MASCULINE))
    return e.withColumn("gender", F.when(F.col("kind").startswith("given_"), F.substring("kind", -1, 1)).when(feminine, "f").when(masculine, "m").otherwise("n"))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``entities`` (raw, kind, canon, attempt) with ``surrogate`` and ``new_canon``, the surrogate's canonical form."""
    e = entities.withColumn("key", F.lit(key)).withColumn("wide", F.col("attempt") >= ATTEMPTS).withColumn("nums", F.expr(_numbers("kind", "canon", "cast(attempt AS string)")))
    # an email's domain is derived from the domain alone, so addresses of one domain stay together; a name's given names
    # (column ``givens``: their surrogates by lower-case word) are entities of their own
    e = e.withColumn("domain", F.expr("CASE WHEN kind = 'email' THEN lower(regexp_extract(raw, '@(.*)$', 1)) END"))
    e = e.withColumn("domain_nums", F.expr(f"CASE WHEN kind = 'email' THEN {_numbers(chr(39) + 'domain' + chr(39), 'domain')} END"))
    e = e.withColumns({"small": F.expr(_letters(0)), "large": F.expr(_letters(-1))})
    e = _parts_of_names(e)
    if "givens" not in e.columns:
        e = e.withColumn("givens", F.create_map().cast("map<string,string>"))
    e = e.withColumn("body", F.expr(f"CASE WHEN kind = 'card' THEN {_CARD_BODY} END"))
    digits = f"CASE WHEN kind = 'card' THEN {_CARD} WHEN kind = 'phone' AND raw like '+%' THEN {_fold('canon', "length(regexp_extract(raw, '^[+]([0-9]+)', 1))")} WHEN kind IN ('phone', 'ssn') THEN {_fold('canon', 0)} END"
    e = e.withColumn("new_digits", F.expr(digits))
    reserved = "domain rlike '(^|[.])example[.](com|net|org)$'"
    labels = "regexp_replace(domain, '[.]?[^.]+[.][^.]+$', '')"
    host = f"CASE WHEN {reserved} THEN concat_ws('.', nullif({_fold(labels, 0, nums='domain_nums')}, ''), regexp_extract(domain, 'example[.][a-z]+$', 0)) ELSE concat({_fold('regexp_replace(domain, ' + repr('[.][^.]+$') + ', ' + repr('') + ')', 0, nums='domain_nums')}, '.example.com') END"
    initial = "concat(upper(substr(large, pmod(hash(key, w), length(large)) + 1, 1)), '.')"
    part = f"CASE WHEN i = size(words) - 1 THEN {_word('nums', 'family')} WHEN {_IS_PARTICLE} THEN w WHEN w LIKE '%.' THEN {initial} ELSE coalesce(givens[lower(w)], '') END"
    name = f"concat(title, array_join(transform(words, (w, i) -> {part}), ' '))"
    given = _word("nums", "given")
    made = f"""CASE kind WHEN 'email' THEN concat({_fold("regexp_extract(raw, '^([^@]*)@', 1)", 0)}, CASE WHEN wide THEN {_longer(12, "char(97 + {n} % 26)")} ELSE '' END, '@', {host})
      WHEN 'token' THEN {_fold('raw', f"length(regexp_replace(regexp_extract(raw, '{_ISSUER}', 1), '[^0-9A-Za-z]', ''))")}
      WHEN 'secret' THEN {_fold('raw', 0, _HEX)} WHEN 'iban' THEN {_fold('raw', 2)} WHEN 'ip' THEN {_IP}
      WHEN 'ip6' THEN CASE WHEN wide THEN {_fold("repeat('0000:', 7) || '0000'", 0, _HEX6)} ELSE {_fold('raw', 0, _HEX6)} END
      WHEN 'name' THEN {name} WHEN 'given_f' THEN {given} WHEN 'given_m' THEN {given} WHEN 'given_n' THEN {given} WHEN 'other' THEN {_fold('raw', 0)}
      WHEN 'ssn' THEN concat({_REFORMAT}, CASE WHEN wide THEN {_longer(6, "cast({n} % 10 AS string)")} ELSE '' END)
      WHEN 'phone' THEN concat({_REFORMAT}, CASE WHEN wide AND length(canon) < 15 THEN {_longer("15 - length(canon)", "cast({n} % 10 AS string)")} ELSE '' END) ELSE {_REFORMAT} END"""
    e = e.withColumn("surrogate", F.expr(made))
    again = CANONICAL.replace("raw", "surrogate")
    return e.withColumn("new_canon", F.expr(again)).drop("key", "wide", "small", "large", "nums", "domain", "domain_nums", "title", "words", "gender", "givens", "body", "new_digits")


def dictionary(found: DataFrame, key: str = KEY) -> DataFrame:
    """raw, surrogate for the distinct entities of ``found`` (column ``found``: array of entities)."""
    raws = found.select(F.explode("found").alias("raw")).distinct().withColumn("kind", entity_type(F.col("raw")))
    # digits of a card's other lengths count only with a right check digit
    card = F.expr(f"kind <> 'card' OR length(canon) = 16 OR {_CHECKED}")
    raws = C.stored(raws.withColumn("canon", F.expr(CANONICAL)).where(card), "entities")
    # given names by gender are entities too; a surrogate of one may equal no real one of any gender
    people = _parts_of_names(raws.where("kind = 'name'")).select("gender", F.explode(F.expr(_GIVENS)).alias("raw"))
    given = C.stored(people.select("raw", F.concat(F.lit("given_"), "gender").alias("kind"), F.lower("raw").alias("canon")).distinct(), "given")
    real = C.stored(raws.select("kind", F.col("canon").alias("new_canon")).union(given.select(F.explode(F.array(*(F.lit(f"given_{g}") for g in "fmn"))).alias("kind"), F.col("canon").alias("new_canon"))).distinct(), "real")
    raws = raws.unionByName(given)
    # one spelling stands for a canonical form while collisions are sought
    todo = raws.groupBy("kind", "canon").agg(F.min("raw").alias("raw")).withColumn("attempt", F.lit(0))
    settled = None
    for attempt in itertools.count():
        tried = C.stored(surrogates(todo, key).select("kind", "canon", "raw", "attempt", "new_canon"), "tried")
        clean = tried.join(real, ["kind", "new_canon"], "left_anti")
        if settled is not None:
            clean = clean.join(settled.select("kind", "new_canon"), ["kind", "new_canon"], "left_anti")
        first = clean.groupBy("kind", "new_canon").agg(F.min("canon").alias("canon"))
        good = clean.join(first, ["kind", "new_canon", "canon"])
        settled = C.stored(good if settled is None else settled.unionByName(good), "settled")
        todo = C.stored(tried.join(settled.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "raw", F.lit(attempt + 1).alias("attempt")), "todo")
        if todo.isEmpty():  # every format has a wider one, so that each round settles nearly all
            break
    done = raws.join(settled.select("kind", "canon", "attempt"), ["kind", "canon"])
    firsts = surrogates(done.where("kind LIKE 'given%'"), key).groupBy("kind", "canon").agg(F.min("surrogate").alias("new"))
    others = done.where("NOT kind LIKE 'given%'")
    words = _parts_of_names(others.where("kind = 'name'")).select(F.col("raw").alias("_raw"), F.concat(F.lit("given_"), "gender").alias("kind"), F.explode(F.expr(f"transform({_GIVENS}, w -> lower(w))")).alias("canon")).distinct()
    givens = words.join(firsts, ["kind", "canon"]).groupBy("_raw").agg(F.map_from_entries(F.collect_list(F.struct("canon", "new"))).alias("givens"))
    beside = others.join(givens, others["raw"] == givens["_raw"], "left").drop("_raw").withColumn("givens", F.coalesce("givens", F.create_map().cast("map<string,string>")))
    return surrogates(beside, key).select("raw", "surrogate")


def _name_words(known: DataFrame) -> DataFrame:
    """raw, word, new: what stands for each word of a titled name when it is alone."""
    said = known.where(F.col("raw").rlike(f"^{_TITLES}")).where(entity_type(F.col("raw")) == "name")
    parts = lambda c: _parts_of_names(said.select(F.col(c).alias("raw"), F.lit("name").alias("kind"), F.col("raw").alias("_raw"))).select(F.col("_raw"), F.col("words").alias(c))
    both = parts("raw").join(parts("surrogate"), "_raw").select(F.col("_raw").alias("raw"), F.explode(F.arrays_zip(F.col("raw").alias("w"), F.col("surrogate").alias("new"))).alias("p"))
    return both.select("raw", F.col("p.w").alias("word"), F.col("p.new").alias("new")).where(F.expr(f"NOT word LIKE '%.' AND NOT {_IS_PARTICLE.replace('w IN', 'word IN')}"))


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and n_entities."""
    text = F.col("text")
    own = docs.select("doc_id", F.xxhash64("text").alias("_text"), text, matches(text).alias("found")).where(F.size("found") > 0)
    titled = F.exists("found", lambda x: x.rlike(f"^{_TITLES}"))
    found = own.withColumn("_titled", titled).withColumn("found", F.when(F.col("_titled"), matches(text, WORDS_TOO)).otherwise(F.col("found")))
    # rows of one id and text have the same matches
    found = C.stored(found.select("doc_id", "_text", "_titled", "found").dropDuplicates(["doc_id", "_text"]), "found")
    each = found.select("doc_id", "_text", "_titled", F.posexplode("found").alias("_at", "raw"))
    word = F.col("_titled") & F.col("raw").rlike(f"^{_WORD}$")
    entities = each.where(~word | (entity_type(F.col("raw")) != "other"))
    known = C.stored(dictionary(entities.select(F.array("raw").alias("found")), key), "dictionary")
    # words of titled names stand for the same person in their document; a family name comes before a given one
    people = entities.where("_titled").join(C.sized_broadcast(_name_words(known)), "raw").select("doc_id", "_text", "word", "new").groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_own"), F.col("word").alias("_word")).agg(F.min("new").alias("_new"))
    whole = each.join(C.sized_broadcast(known), "raw", "left")
    alone = (whole["doc_id"].eqNullSafe(people["_id"])) & (whole["_text"] == people["_own"]) & (whole["raw"] == people["_word"])
    told = whole.join(people, alone, "left").select("doc_id", "_text", "_titled", "_at", "raw", F.coalesce("surrogate", "_new").alias("new"))
    lists = told.groupBy(F.col("doc_id").alias("_id"), "_text", "_titled").agg(F.count("new").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("new", "raw").alias("new")))), lambda x: x["new"]).alias("_new"))
    lists = C.stored(lists.where("_n > 0"), "replacements")
    plain = docs.drop("n_entities", "_new", "_n", "_titled")
    same = plain["doc_id"].eqNullSafe(lists["_id"]) & (F.xxhash64(plain["text"]) == lists["_text"])
    # a row holds all replacements of a text, so their number is what bounds a broadcast
    entries = lists.agg(F.coalesce(F.sum(F.size("_new")), F.lit(0))).first()[0]
    rows = plain.join(F.broadcast(lists) if entries <= MOST_ENTRIES else lists, same, "left").drop("_id", "_text")
    gaps = F.when(F.col("_titled"), F.split("text", WORDS_TOO, -1)).otherwise(F.split("text", PATTERN, -1))
    new = F.array_join(F.zip_with(gaps, "_new", lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    return rows.withColumns({"n_entities": F.coalesce("_n", F.lit(0)).cast("long"), "text": F.when(F.col("_n").isNotNull(), new).otherwise(F.col("text"))}).drop("_new", "_n", "_titled")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(C.documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with surrogates; n_chars follows the text."""
    out = replace_entities(docs)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)
