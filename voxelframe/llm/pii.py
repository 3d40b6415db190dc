"""Personal data replaced by surrogates, in DataFrame functions only.

Detected entities (e-mail and IPv4 addresses, payment cards, phone numbers, social security
numbers, IBANs, secrets that are assigned to a key word, names after a title) get a keyed
replacement of the same type: digits stay digits, letters stay letters of their script and case,
cards keep issuer and a valid check digit, IBANs their country and check digits, IPv4 addresses
stay public or in their private range, names follow the title's gender and the name's script.

An assigned secret is found from 16 characters on (letters, digits and _-./+), an assigned password
from 6 on (any run without blanks and quotes, less the punctuation at its end), whatever its length.

A quoted secret or password ends at its quote and may hold blanks.

A surrogate is a keyed permutation of the entity's format (a Feistel network over its characters), so
two entities of one format never share one. Names are replaced word by word: each given name and
each family name of the corpus has one surrogate word that no other has, whatever the title, so
that names differ where the real ones do and `Mr John Smith`, `Dr Smith` and a bare `John Smith` or
`Smith` in a text that also has the titled name stay one family. Given and family names are made
of syllables, one more at every attempt until all differ: their space grows with the corpus. The
same entity gets the same surrogate in the whole corpus, however it is written (case, digit
separators). Surrogates are checked against each other and against every entity found in the
corpus; those that clash are drawn again. Where a format is so crowded that some still clash, all
entities of that format keep their first permutation: distinct, but a surrogate may then be another
real value. Only entities are shuffled for that, pre-aggregated; texts are shuffled only if they may
hold an entity, and each distinct text is searched and rewritten once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelframe.llm.common import col, hot_keys, salted_join, stage, unused, without

WORD = r"\p{L}\p{N}"
#: Title -> gender; fixed values. Upper- and lower-case letters as written.
TITLES = {"Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "г-н": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Doña": "f", "г-жа": "f",
          "Dr": "n", "Prof": "n"}
#: Given names by script and gender, and syllables of family names by script; fixed values.
GIVEN = {"latin": {"m": "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Marc Oscar Paul Simon Tom Victor", "f": "Alba Clara Diana Elena Flora Greta Ida Julia Laura Maria Nora Olga Paula Rosa Sara Vera",
                   "n": "Alex Andrea Ariel Charlie Dana Eden Jamie Kim Luca Micha Nika Noa Robin Sam Sascha Toni"},
         "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Семён Тимур Фёдор", "f": "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Мария Нина Ольга Полина Раиса Софья Юлия",
                      "n": "Саша Женя Валя Шура Слава Паша Миша Никита Тоня Вася Лёша Юра Костя Даня Рома Тима"}}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve", "cyrillic": "ба бе бо да де до фа фе га ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве"}

TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ")"
PASSWORD, ASSIGNED = "(?i:password|passwd|pwd)", r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: A word of a name: a capital, or a letter of a script without case. Particles may stand between such words.
#: An apostrophe stands between letters; 's at the end is no part of the name.
NAMED = r"[\p{Lu}\p{Lo}](?:[\p{L}\p{M}\-]|['’](?=\p{L})(?!s(?!\p{L}))){1,40}"
PARTICLE = "(?:de|del|der|den|di|da|dos|la|le|van|von|zu|bin|al|el|y)"
#: Length of a country's IBANs; fixed values.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
                25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}
#: Country calling codes of one and two digits, all others have three; fixed values.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
SECRET_WORD = r"(?i:token|secret|api[_\-]?key|access[_\-]?key|auth[_\-]?key)"
PATTERNS = {
    "quoted": rf"(?<=[=:]\s{{0,3}}\")(?<=(?:{PASSWORD}|{SECRET_WORD})[\"']?\s{{0,3}}[=:]\s{{0,3}}\")[^\"\r\n]{{6,}}+(?=\")|(?<=[=:]\s{{0,3}}')(?<=(?:{PASSWORD}|{SECRET_WORD})[\"']?\s{{0,3}}[=:]\s{{0,3}}')[^'\r\n]{{6,}}+(?=')",
    "password": rf"(?<=[=:]\s{{0,3}}[\"']?)(?<={PASSWORD}{ASSIGNED})[^\s\p{{Z}}\"']{{5,}}[^\s\p{{Z}}\"'.,;:)\]}}>]",
    "email": rf"(?<![{WORD}._%+\-])[{WORD}._%+\-]{{1,64}}@[{WORD}\-]{{1,63}}(?:\.[{WORD}\-]{{1,63}}){{1,8}}(?![{WORD}])",
    "secret": rf"(?<=[=:]\s{{0,3}}[\"']?)(?<={SECRET_WORD}{ASSIGNED})[A-Za-z0-9_\-./+]{{16,}}+={{0,2}}(?![A-Za-z0-9_/+])",
    "iban": r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.\-])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?!\.?[\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "name": rf"(?<![{WORD}]){TITLE}\.? {NAMED}(?: (?:{PARTICLE} ){{0,2}}{NAMED}){{0,3}}",
}
#: All entities but cards, whose end only the check digit tells: _cards() finds those of a text first.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
CARD = r"[2-6][0-9]{3}(?:[ \-]?[0-9]{2,4}){2,5}[0-9]"
BEFORE_CARD, AFTER_CARD = r"(?<![\p{L}\p{N}.\-])", r"(?![\p{L}\p{N}])"
#: Digits of a card by issuer (Visa, Mastercard, American Express, Discover, Diners, JCB, UnionPay).
ISSUERS = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d{2}|7[01]\d|720)\d{12}|3[47]\d{13}|6(?:011|5\d{2}|4[4-9]\d)\d{12}|3(?:0[0-5]|[68]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}|62\d{14,17})$"


def _digit(s: Column, i: Column) -> Column:
    return F.substr(s, i, F.lit(1)).cast("int")


def luhn_sum(s: Column, shift: int = 0) -> Column:
    """Luhn sum of a digit string; shift 1 leaves room for a check digit at the right."""
    def add(a: Column, i: Column) -> Column:
        d = _digit(s, F.length(s) - i + 1)
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return a + F.when((i + shift) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), add)


def _is_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return value.rlike(f"^{CARD}$") & digits.rlike(ISSUERS) & (luhn_sum(digits) % 10 == 0)


def _cards(text: Column) -> Column:
    """The cards of a text: at every start the longest run of digits, single blanks and hyphens that is one, whatever number comes next."""
    runs = F.regexp_extract_all(text, F.lit(BEFORE_CARD + r"(?=([2-6][0-9]{3}(?:[ \-]?[0-9]){9,15}(?s:.{0,2})))"), F.lit(1))

    def longest(run: Column) -> Column:
        # an end inside a number with dots or hyphens (an address, an SSN) counts only if there is no other, the first one then
        ends = [(n, AFTER_CARD + r"(?![.\-][0-9])") for n in range(19, 12, -1)] + [(n, AFTER_CARD) for n in range(13, 20)]
        heads = F.array(*[F.regexp_extract(run, rf"^([0-9](?:[ \-]?[0-9]){{{n - 1}}}){end}", 1) for n, end in ends])
        return F.try_element_at(F.filter(heads, _is_card), F.lit(1))

    return F.filter(F.array_distinct(F.transform(runs, longest)), lambda c: c.isNotNull())


def _longest_first(values: Column) -> Column:
    return F.array_join(F.transform(F.reverse(F.array_sort(F.transform(values, lambda c: F.struct(F.length(c).alias("n"), c.alias("c"))))), lambda x: x["c"]), "|")


def _any(cards: Column, bare: Column) -> Column:
    """ANY, these cards and these names, longer ones first. Most texts have neither and share the one pattern."""
    some = F.concat(F.lit(ANY), F.when(F.size(cards) > 0, F.concat(F.lit(f"|{BEFORE_CARD}(?:"), _longest_first(cards), F.lit(f"){AFTER_CARD}"))).otherwise(F.lit("")),
                    F.when(F.size(bare) > 0, F.concat(F.lit(rf"|(?<![{WORD}'’\-])(?:"), _longest_first(bare), F.lit(rf")(?![{WORD}\-])"))).otherwise(F.lit("")))
    return F.when((F.size(cards) > 0) | (F.size(bare) > 0), some).otherwise(F.lit(ANY))


def _bare_names(text: Column) -> Column:
    """What a text may call its titled persons later: the name without the title, and its last word."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda v: F.regexp_replace(v, rf"^{TITLE}\.? ", ""))
    found = F.array_distinct(F.concat(whole, F.transform(whole, lambda n: F.substring_index(n, " ", -1))))
    return F.when(text.rlike(TITLED), found).otherwise(F.array().cast("array<string>"))


def iban_rest(s: Column) -> Column:
    """Remainder modulo 97 of an IBAN without blanks; 1 if it is valid."""
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

    def add(a: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + letter) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _kind(value: Column, secret: Column, bare: Column) -> Column:
    """Type of a match, null if it is none after all (check digits, issuer). secret: it is assigned to a key word; bare: it is a titled person's name."""
    digits, blanks = F.regexp_replace(value, "[^0-9]", ""), F.regexp_replace(value, " ", "")
    full = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    return (F.when(secret & value.rlike(r"\s"), "secret")
            .when(full("email"), "email")
            .when(bare | value.rlike(rf"^{TITLE}\.? "), "name")
            .when(full("iban") & (iban_rest(blanks) == 1), "iban")
            .when(full("ip"), "ip")
            .when(full("phone"), F.when(F.length(digits).between(7, 15), "phone"))
            .when(full("ssn"), "ssn")
            .when(_is_card(value), "card")
            .when(secret, "secret"))


def _canonical(kind: Column, value: Column) -> Column:
    """What all spellings of an entity have in common."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (F.when(kind == "email", F.lower(value)).when(kind == "phone", F.concat(F.regexp_extract(value, r"^\+", 0), digits)).when(kind.isin("card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind == "name", F.regexp_replace(value, rf"^{TITLE}\.? ", "")).otherwise(value))


def _gender(value: Column) -> Column:
    """m or f where a title tells it, else n."""
    title = F.regexp_extract(value, rf"^({TITLE})\.? ", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), title), F.lit("n"))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(i - 1, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


#: Letters and digits that stay among themselves, as first and last code point: scripts by case.
RANGES = [(0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x430, 0x45F), (0x400, 0x42F), (0x561, 0x586), (0x531, 0x556), (0x5D0, 0x5EA), (0x620, 0x63F),
          (0x641, 0x64A), (0x904, 0x939), (0x985, 0x9B9), (0xE01, 0xE30), (0x10D0, 0x10FA), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
#: Latin letters beyond ASCII by block and case; printable ASCII without quotes; hexadecimal digits.
POOLS = ["".join(c for c in map(chr, range(lo, hi)) if getattr(c, case)()) for lo, hi in ((0xC0, 0x100), (0x100, 0x180), (0x180, 0x250)) for case in ("islower", "isupper")]
POOLS += ["".join(chr(c) for c in range(33, 127) if chr(c) not in "\"'"), "0123456789abcdef", "0123456789ABCDEF"]
PRINTABLE, HEX_LOW, HEX_UP = len(POOLS) - 2, len(POOLS) - 1, len(POOLS)
ROUNDS, LONG = 4, 64


def _bound(value: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _classes(s: Column, mode: Column) -> Column:
    """(base, n, v) of every character: the v-th of n that may stand in its place; base < 0 is a pool. mode: a pool for all that it holds, or 0."""
    def one(c: Column, mode: Column) -> Column:
        at = F.ascii(c)
        named = lambda base, n, v: F.struct(base.cast("int").alias("base"), F.lit(n).cast("int").alias("n"), v.cast("int").alias("v"))
        found = F.when(F.lit(False), named(at, 1, F.lit(0)))
        for k in (len(POOLS) - 2, len(POOLS) - 1, len(POOLS)):
            found = found.when((mode == k) & (F.instr(F.lit(POOLS[k - 1]), c) > 0), named(F.lit(-k), len(POOLS[k - 1]), F.instr(F.lit(POOLS[k - 1]), c) - 1))
        for lo, hi in RANGES:
            found = found.when(at.between(lo, hi), named(F.lit(lo), hi - lo + 1, at - lo))
        for k, pool in enumerate(POOLS[:6], 1):
            found = found.when((at > 191) & (at < 592) & (F.instr(F.lit(pool), c) > 0), named(F.lit(-k), len(pool), F.instr(F.lit(pool), c) - 1))
        # any other script: its neighbours
        return found.when(c.rlike(r"[\p{L}\p{N}]"), named(at - at % 16, 16, at % 16)).otherwise(named(at, 1, F.lit(0)))

    return _bound(mode, lambda m: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: one(c, m)))


def _character(base: Column, v: Column) -> Column:
    other = F.decode(F.unhex(F.lpad(F.hex(base + v), 8, "0")), "UTF-32")
    pools = F.array(*map(F.lit, POOLS))
    return F.when(base < 0, F.substr(F.element_at(pools, F.greatest(-base, F.lit(1))), v + 1, F.lit(1))).otherwise(other)


def _permuted(numbers: Column, seed: Column) -> Column:
    """Keyed permutation of the numbers (n, v), 0 <= v < n: in turn every other one is shifted by what the rest and the seed hash to."""
    def step(now: Column, turn: Column) -> Column:
        rest = F.array_join(F.transform(F.filter(now, lambda x, i: i % 2 != turn % 2), lambda x: x["v"]), ",")
        digest = F.sha2(F.concat_ws("\u0001", seed, turn.cast("string"), rest), 256)
        shifted = lambda d: F.transform(now, lambda x, i: F.when(i % 2 == turn % 2, F.struct(x["n"].alias("n"), F.pmod(x["v"] + F.pmod(F.xxhash64(d, i), x["n"]), x["n"]).cast("int").alias("v"))).otherwise(x))
        return _bound(digest, shifted)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), numbers, step)


def _alike(s: Column, seed: Column, mode: Column) -> Column:
    """A keyed permutation of all strings whose characters are of the same kinds; other signs stay.

    Strings beyond LONG characters are shifted by a hash of the whole instead.
    """
    def short(cls: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(cls)), lambda i: F.element_at(cls, i)["n"] > 1)
        numbers = F.transform(places, lambda i: F.struct(F.element_at(cls, i)["n"].alias("n"), F.element_at(cls, i)["v"].alias("v")))
        put = lambda new: F.transform(cls, lambda c, i: _character(c["base"], F.when(c["n"] > 1, F.try_element_at(new, F.array_position(places, i + 1).cast("int"))["v"]).otherwise(c["v"])))
        return F.array_join(_bound(_permuted(numbers, seed), put), "")

    def long(cls: Column) -> Column:
        moved = lambda d: F.transform(cls, lambda c, i: _character(c["base"], F.pmod(c["v"] + F.pmod(F.xxhash64(d, i), c["n"]), c["n"]).cast("int")))
        return F.array_join(_bound(F.sha2(F.concat_ws("\u0001", seed, s), 256), moved), "")

    return F.when(s == "", s).otherwise(_bound(_classes(s, mode), lambda cls: F.when(F.size(cls) <= LONG, short(cls)).otherwise(long(cls))))


def _address(canon: Column, seed: Column) -> Column:
    """IPv4 addresses: public ones among themselves, each private, local or special range in itself."""
    parts = F.transform(F.split(canon, r"\."), lambda x: x.cast("int"))
    a, b = F.element_at(parts, 1), F.element_at(parts, 2)
    octet, first = "sequence(0, 255)", "array_except(sequence(1, 223), array(10, 127, 169, 172, 192))"
    # second parts that are no public addresses
    mixed = {169: "array(254)", 172: "sequence(16, 31)", 192: "array(168)"}
    second = F.when(F.lit(False), F.expr(octet))
    for n, inner in mixed.items():
        second = second.when((a == n) & F.array_contains(F.expr(inner), b), F.expr(inner)).when(a == n, F.expr(f"array_except({octet}, {inner})"))
    doms = F.array(F.when(F.array_contains(F.expr(first), a), F.expr(first)).otherwise(F.array(a)), second.otherwise(F.expr(octet)), F.expr(octet), F.expr(octet))
    numbers = lambda ds: F.zip_with(ds, parts, lambda d, x: F.struct(F.size(d).alias("n"), (F.array_position(d, x) - 1).cast("int").alias("v")))
    return _bound(doms, lambda ds: F.array_join(F.zip_with(ds, _permuted(numbers(ds), seed), lambda d, x: F.element_at(d, x["v"] + 1)), "."))


def _choose(words: str, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words.split())), F.pmod(n, F.lit(len(words.split()))) + 1)


def _word(kind: Column, word: Column, gender: Column, script: Column, key: str, attempt: int) -> Column:
    """A surrogate word: of the given names at first, then of syllables, one more at every attempt."""
    def made(d: Column) -> Column:
        out = F.when(F.lit(False), word)
        if not attempt:
            for s, by in GIVEN.items():
                for g, names in by.items():
                    out = out.when((kind == "given") & (script == s) & (gender == g), _choose(names, _byte(d, F.lit(1))))
        for s, syl in SYLLABLES.items():
            some = lambda n: F.concat(*[_choose(syl, _byte(d, F.lit(i))) for i in range(2, 2 + n + min(attempt, 24))])  # noqa: B023, E731
            by_gender = lambda m, f, n: F.when(gender == "m", m).when(gender == "f", f).otherwise(n)
            given = by_gender("н", "я", "ль") if s == "cyrillic" else by_gender("n", "a", "l")
            family = F.when((gender == "f") | word.rlike("(ова|ева|ина)$"), "ова").otherwise("ов") if s == "cyrillic" else F.lit("rn")
            out = out.when((script == s) & (kind == "given"), F.initcap(F.concat(some(1), given))).when(script == s, F.initcap(F.concat(some(4), family)))
        return out

    return _bound(F.sha2(F.concat_ws("\u0001", F.lit(key), kind, word, F.lit(str(attempt))), 256), made)


#: Kinds of a name's words.
NAMES = ("given", "family")


def _drawn(entities: DataFrame, attempt: int, key: str) -> DataFrame:
    """(kind, canon, gender, surrogate) at an attempt; but for words of names a permutation of the entity's format."""
    kind, canon, head, moved = F.col("kind"), F.col("canon"), F.col("head"), F.col("moved")
    seed = F.concat_ws("\u0001", F.lit(key), kind, F.lit(str(attempt)))
    first = lambda n: F.substr(canon, F.lit(1), n if isinstance(n, Column) else F.lit(n))
    dot = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    known = lambda n: F.substr(canon, F.lit(2), F.lit(n)).isin(*[c for c in CALLING.split() if len(c) == n])
    country = F.when(~canon.startswith("+"), 1).when(known(1), 2).when(known(2), 3).otherwise(4)
    # what stays at the front: an issuer, a calling code, else the first digit of a phone, an IBAN's country and check digits
    front = F.when(kind == "card", F.when(canon.startswith("4"), 1).otherwise(4)).when(kind == "phone", country).when(kind == "iban", 4).otherwise(0)
    stop = F.when(kind == "email", dot).when(kind == "card", F.length(canon) - 1).otherwise(F.length(canon))
    # few letters and digits, or a crowded format: any printable signs
    few = (F.length(F.regexp_replace(canon, "[^A-Za-z0-9]", "")) < 6) | F.lit(attempt >= 3)
    mode = F.when(kind != "secret", 0).when(few, PRINTABLE).when(canon.rlike("^[0-9a-f]{6,}$"), HEX_LOW).when(canon.rlike("^[0-9A-F]{6,}$"), HEX_UP).otherwise(0)
    cut = entities.select("kind", "canon", "gender", first(front).alias("head"), F.substr(canon, front + 1, stop - front).alias("middle"), F.substr(canon, stop + 1).alias("tail"), mode.alias("mode"))
    script = F.when(canon.rlike("[А-яЁё]"), "cyrillic").when(canon.rlike(r"\p{IsLatin}"), "latin")
    lettered = kind.isin(*NAMES) & script.isNotNull()
    cut = cut.withColumn("moved", F.when((kind != "ip") & ~F.coalesce(lettered, F.lit(False)), _alike(F.col("middle"), F.concat_ws("\u0001", seed, F.when(kind != "iban", head)), F.col("mode"))))
    check = _bound(F.concat(head, moved), lambda x: F.concat(x, F.pmod(10 - luhn_sum(x, 1) % 10, F.lit(10)).cast("string")))
    state = F.substr(head, F.lit(1), F.lit(2))
    iban = F.concat(state, F.lpad((98 - iban_rest(F.concat(state, F.lit("00"), moved))).cast("string"), 2, "0"), moved)
    made = F.when(kind == "card", check).when(kind == "iban", iban).when(lettered, _word(kind, canon, F.col("gender"), script, key, attempt)).when(kind == "ip", _address(canon, seed)).otherwise(F.concat(head, moved, "tail"))
    return cut.select("kind", "canon", "gender", made.alias("surrogate"))


def _format(kind: Column, canon: Column) -> Column:
    """What the first permutation of an entity leaves as it is: entities of one format are permuted among themselves."""
    shape = F.array_join(F.transform(_classes(canon, F.lit(0)), lambda c: F.concat_ws(":", c["base"].cast("string"), c["n"].cast("string"))), ",")
    return F.when(kind == "ip", kind).otherwise(shape)


def _spelt(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate written as the occurrence was: its separators, its title, its upper case."""
    def fill(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^A-Z0-9]", ""))
        return F.when(c.rlike("[A-Z0-9]"), F.substr(F.regexp_replace(surrogate, r"^\+", ""), before, F.lit(1))).otherwise(c)

    refilled = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), fill), "")
    title = F.regexp_extract(value, rf"^({TITLE}\.? )", 1)
    return (F.when(kind.isin("card", "phone", "ssn", "iban"), refilled).when(kind == "name", F.concat(title, surrogate))
            .when((kind == "email") & (value == F.upper(value)), F.upper(surrogate)).otherwise(surrogate))


#: A title and the start of a name.
TITLED = "[" + "".join(sorted({t[0] for t in TITLES})) + "](?:" + "|".join(sorted({t[1:] for t in TITLES}, key=lambda t: (-len(t), t))) + r")\.? [\p{Lu}\p{Lo}]"


def _maybe(text: Column) -> Column:
    """Whether a text has any of the signs that every entity has: cheap scans that begin with one rare character each."""
    quoted = rf"[=:](?<=(?:{PASSWORD}|{SECRET_WORD})[\"']?\s{{0,3}}.)\s{{0,3}}[\"'][^\"'\r\n]"
    return F.coalesce(text.contains("@") | text.rlike("[0-9][0-9.() -]{4}") | text.rlike("[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}") | text.rlike(r"[=:]\s{0,3}[\"']?[A-Za-z0-9_\-./+]{16}") | text.rlike(rf"[=:](?<={PASSWORD}[\"']?\s{{0,3}}.)\s{{0,3}}[\"']?[^\s\"']{{6}}") | text.rlike(quoted) | text.rlike(TITLED), F.lit(False))


def _resolve(entities: DataFrame, key: str, rounds: int) -> DataFrame:
    """(kind, canon, surrogate): no two entities of a kind share a surrogate, and none is itself an entity unless its format is full.

    Words of names never have a full format: their attempts go on, each with a syllable more, until all differ.
    """
    spark, kept = entities.sparkSession, ["kind", "canon", "surrogate"]
    entities = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit("n"))
    parts = max(1, min(-(-entities.count() // 1000), 4 * max(50, spark.sparkContext.defaultParallelism)))
    real = entities.select("kind", F.col("canon").alias("surrogate"))
    pending, settled, full = entities, None, None
    lettered = F.col("kind").isin(*NAMES) & F.col("canon").rlike(r"[А-яЁё]|\p{IsLatin}")
    for attempt in range(64):
        drawn = stage(_drawn(pending.repartition(parts, "kind", "canon"), attempt, key))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled, ["kind", "surrogate"], "left_anti")
        now = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select(*kept)
        settled = stage(now if settled is None else settled.unionByName(now))
        pending = stage(drawn.join(settled, ["kind", "canon"], "left_anti").select("kind", "canon", "gender"))
        if attempt + 1 == rounds:
            full, pending = pending.where(~lettered), pending.where(lettered)
        if pending.isEmpty():
            break
    if full is None or full.isEmpty():
        return settled
    # formats without room
    named = lambda df: df.withColumn("format", _format(F.col("kind"), F.col("canon")))
    crowded = stage(named(entities).join(named(full).select("kind", "format").distinct(), ["kind", "format"], "left_semi").where(~lettered).select("kind", "canon", "gender"))
    first = _drawn(crowded.repartition(parts, "kind", "canon"), 0, key).select(*kept)
    return stage(settled.join(crowded, ["kind", "canon"], "left_anti").select(*kept).unionByName(first))


def _names(values: DataFrame) -> DataFrame:
    """(value, at, kind, canon, gender) of the words of named values; particles have a null kind. A word's gender is the one that all titles agree on."""
    words = F.split("canon", " ")
    w = values.where("kind = 'name'").select("value", _gender(F.col("value")).alias("own"), F.size(words).alias("n"), F.posexplode(words).alias("at", "canon"))
    return w.select("value", "at", "canon", "own", F.when(F.col("at") == F.col("n") - 1, "family").when(~F.col("canon").rlike(r"^\p{Ll}"), "given").alias("kind"))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", entities_col: str = "entities", rounds: int = 6) -> DataFrame:
    """docs with every entity in text_col replaced, and entities_col: (kind, surrogate) in text order.

    key: the secret that the surrogates depend on. Null and empty texts, and texts without an
    entity, stay as they are with an empty list. Whole texts are searched. Repeated rows and copies
    get the same text. All columns of docs stay; a column named like entities_col is replaced.
    rounds: attempts to find surrogates that are no real values. Copies of a text that are a large
    part of all are dealt to several tasks.
    """
    cols = without(docs.columns, entities_col)
    base, text = docs.select(*map(col, cols)), col(text_col)
    k, new = unused([*cols, entities_col], "k", "new")
    some = base.where(_maybe(text)).withColumn(k, F.md5(F.encode(text, "UTF-8")))
    whole = stage(some.groupBy(F.col(k).alias("k")).agg(F.any_value(text).alias("text"), F.count(F.lit(1)).alias("n")))
    assigned = F.when(F.col("text").rlike("[=:]"), F.regexp_extract_all("text", F.lit("|".join(f"(?:{PATTERNS[x]})" for x in ("quoted", "password", "secret"))), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = whole.select("k", "text", _cards(F.col("text")).alias("cards"), _bare_names(F.col("text")).alias("bare"), assigned.alias("secrets"))
    found = found.select("k", "bare", "secrets", F.explode(F.array_distinct(F.regexp_extract_all("text", _any(F.col("cards"), F.col("bare")), F.lit(0)))).alias("value"))
    found = found.select("k", "value", _kind(F.col("value"), F.array_contains("secrets", F.col("value")), F.array_contains("bare", F.col("value"))).alias("kind"))
    found = stage(found.where(F.col("kind").isNotNull()).withColumn("canon", _canonical(F.col("kind"), F.col("value"))))
    # an entity that many texts hold is spelt once, and its rows are dealt to several tasks
    values = stage(found.groupBy("value", "kind", "canon").agg(F.count(F.lit(1)).alias("n")))
    words = stage(_names(values))
    told = F.when(F.col("own") != "n", F.col("own"))
    genders = words.where(F.col("kind").isNotNull()).groupBy("kind", "canon").agg(F.when(F.min(told) == F.max(told), F.min(told)).otherwise("n").alias("gender"))
    settled = _resolve(stage(values.where("kind != 'name'").select("kind", "canon").distinct().withColumn("gender", F.lit("n")).unionByName(genders)), key, rounds)
    told = hot_keys(words.groupBy("canon").agg(F.count(F.lit(1)).alias("n")), "canon")
    new_words = salted_join(words.where(F.col("kind").isNotNull()), settled.where(F.col("kind").isin(*NAMES)).select(F.col("kind").alias("role"), "canon", "surrogate"), "canon", told).where(F.col("kind") == F.col("role"))
    placed = new_words.select("value", "at", "surrogate").unionByName(words.where(F.col("kind").isNull()).select("value", "at", F.col("canon").alias("surrogate")))
    named = placed.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]), " ").alias("surrogate"))
    whole_names = values.where("kind = 'name'").join(named, "value")
    others = values.where("kind != 'name'").join(settled, ["kind", "canon"])
    spelt = stage(others.select("value", "kind", "surrogate").unionByName(whole_names.select("value", "kind", "surrogate")).select("value", F.struct("kind", _spelt(F.col("kind"), F.col("value"), F.col("surrogate")).alias("s")).alias("r")))
    maps = salted_join(found.select("k", "value"), spelt, "value", hot_keys(values, "value")).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("value", "r"))).alias("map"))
    held = whole.drop("n").join(maps, "k").withColumn("any", _any(F.map_keys(F.map_filter("map", lambda _, r: r["kind"] == "card")), F.map_keys(F.map_filter("map", lambda v, r: (r["kind"] == "name") & ~v.rlike(rf"^{TITLE}\.? ")))))
    held = held.withColumn("known", F.transform(F.regexp_extract_all("text", F.col("any"), F.lit(0)), lambda v: F.struct(v.alias("v"), F.try_element_at(F.col("map"), v).alias("r"))))
    filled = F.concat(F.transform("known", lambda x: F.coalesce(x["r"]["s"], x["v"])), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(F.split("text", F.col("any"), -1), filled, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    listed = F.transform(F.filter("known", lambda x: x["r"].isNotNull()), lambda x: F.struct(x["r"]["kind"].alias("kind"), x["r"]["s"].alias("surrogate")))
    done = stage(held.select(F.col("k").alias(k), F.struct(rebuilt.alias("text"), listed.alias("list")).alias(new)))
    nothing = F.array().cast("array<struct<kind:string,surrogate:string>>")
    out = salted_join(some, done, k, hot_keys(whole, "k"), "left")
    changed = col(new).isNotNull()
    out = out.select(*[(F.when(changed, col(new)["text"]).otherwise(text) if c == text_col else col(c)).alias(c) for c in cols], F.when(changed, col(new)["list"]).otherwise(nothing).alias(entities_col))
    return out.unionByName(base.where(~_maybe(text)).select(*map(col, cols), nothing.alias(entities_col)))
