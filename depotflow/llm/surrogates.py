"""Personal data replaced by keyed surrogates, with Spark expressions only.

Detected are e-mail and network addresses, phone and card numbers, access keys, secrets after a name such as token=, and names after a
title. Every entity is replaced by one of its own kind: letters by letters of the same script and case, digits by digits, an octet
by an octet, a valid card number by a valid one, a name by a name of the gender its title says. What replaces an entity
depends on a secret key and on the entity's canonical form only, so mentions in other spellings (case, blanks, dashes) and in other documents keep
referring to the same thing. A check over the whole corpus finds entities that would share a surrogate, or whose surrogate is a
real entity; all but the first of them draw again until every entity has its own.

Nulls: a null text stays null; repeated rows are treated alike. Texts without entities stay as they are. An empty table gives an
empty result. Rows are told apart by a 64-bit hash of id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from depotflow.llm.common import bound, stage

ROUNDS = 20
WORD = r"\p{L}0-9._%+-"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Titles that tell the gender of the name after them.
MALE, FEMALE = "Mr|Herr|Señor|Monsieur|господин", "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|госпожа"
SECRET_NAMES = "password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key"
KINDS = {
    "email": rf"(?<![{WORD}])[{WORD}]++@(?:[\p{{L}}0-9-]+\.)+\p{{L}}{{2,}}",
    "secret": rf"(?<!\p{{L}})(?i:{SECRET_NAMES})\s?[=:]\s?[\"']?[A-Za-z0-9+/_.-]{{6,}}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
PATTERN = "|".join(KINDS.values())

# What letters of a script are replaced by, and names by gender.
SCRIPTS = [
    ("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "9", "0123456789"),
    ("à", "ÿ", "àâäçèéêëîïñôöùûü"), ("À", "Þ", "ÀÂÄÇÈÉÊËÎÏÑÔÖÙÛÜ"), ("а", "я", "абвгдежзиклмнопрстуфхцчшэюя"),
    ("А", "Я", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), ("α", "ω", "αβγδεζηθικλμνξοπρστυφχψω"), ("Α", "Ω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("一", "鿿", "安白方海江林明山田文永玉"),
]
GIVEN = {
    ("latin", "m"): "Adam Carl David Emil Felix Hugo Ivan Jonas Leon Martin Oscar Peter Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Bella Clara Diana Elena Flora Helena Irene Julia Laura Maria Nora Paula Rosa Sofia Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Егор Иван Максим Олег".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Ольга Софья".split(),
}
SYLLABLES = {
    "latin": "bal cor den fal gar hol kel lan mor nel por ran sel tor val win".split(),
    "cyrillic": "бел вор гор дан зим кал лес мар нов пет рос сав тар фед хар шум".split(),
}
SURNAME_ENDS = {("latin", "m"): "er", ("latin", "f"): "er", ("cyrillic", "m"): "ов", ("cyrillic", "f"): "ова"}


def kind_of(value: Column) -> Column:
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(list(KINDS.items())):
        found = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(found)
    return found


def canonical(kind: Column, value: Column) -> Column:
    """The form that all spellings of one entity share; of a secret only what follows its name, of a name all but its title."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    gender = F.when(value.rlike(f"^(?:{FEMALE})(?!\\p{{L}})"), "f:").otherwise("m:")
    return (
        F.when(kind.isin("phone", "card"), digits)
        .when(kind == "secret", F.lower(F.regexp_replace(value, rf"^(?i:{SECRET_NAMES})\s?[=:]\s?[\"']?", "")))
        .when(kind == "name", F.concat(gender, F.regexp_replace(value, r"^\p{L}+\.? ", "")))
        .otherwise(F.lower(value))
    )


def _draw(seed: Column, at: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(at) if isinstance(at, int) else at), F.lit(n))


def _relettered(text: Column, seed: Column, skip: Column | None = None) -> Column:
    """Each letter and digit becomes another of its script; the draw depends on its number among them, so other spellings agree."""

    def letters(whole: Column) -> Column:
        def swap(char: Column, at: Column) -> Column:
            def other(number: Column) -> Column:
                out = char
                for low, high, alphabet in SCRIPTS:
                    pick = F.substring(F.lit(alphabet), _draw(seed, number, len(alphabet)).cast("int") + 1, 1)
                    out = F.when((char >= low) & (char <= high), pick).otherwise(out)
                return out if skip is None else F.when(number <= skip, char).otherwise(out)

            return bound(F.char_length(F.regexp_replace(F.substring(whole, F.lit(1), at + 1), r"[^\p{L}0-9]", "")), other)

        return F.array_join(F.transform(F.split(whole, ""), swap), "")

    return bound(text, letters)


def luhn_sum(digits: Column) -> Column:
    """The check sum of a string of digits whose last one counts singly."""
    n = F.char_length(digits)

    def part(char: Column, at: Column) -> Column:
        d = char.cast("int")
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - at) % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def surrogate(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    """What stands for `value`, in its format."""
    host = F.lower(F.substring_index(value, "@", -1))
    given = F.struct(
        kind.alias("kind"), value.alias("value"), canonical(kind, value).alias("canon"), attempt.cast("string").alias("attempt"),
        F.sha2(F.concat_ws("|", F.lit(secret), F.lit("host"), host), 256).alias("of_host"),
    )
    seeded = lambda e: F.sha2(F.concat_ws("|", F.lit(secret), e["kind"], e["canon"], e["attempt"]), 256)
    return bound(given, lambda e: bound(seeded(e), lambda seed: _drawn(e["kind"], e["value"], e["canon"], seed, e["of_host"], e["attempt"].cast("int"))))


def _longer(text: Column, attempt: Column) -> Column:
    """The text with its last character repeated once for each attempt, so that there are more surrogates for each further draw."""
    return F.concat(text, F.repeat(F.right(text, F.lit(1)), attempt))


def _drawn(kind: Column, value: Column, canon: Column, seed: Column, of_host: Column, attempt: Column) -> Column:
    ip = F.concat_ws(".", *[(_draw(seed, k, 254) + 1).cast("string") for k in range(4)])
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    ending = F.substring_index(host, ".", -1)
    front = F.substring(host, F.lit(1), F.char_length(host) - F.char_length(ending))
    # addresses of one host keep sharing one host
    email = F.concat(_relettered(_longer(local, attempt), seed), F.lit("@"), _relettered(front, of_host), ending)

    def checked(drawn: Column) -> Column:
        digits = F.regexp_replace(drawn, "[^0-9]", "")
        open_ = F.concat(F.substring(digits, F.lit(1), F.char_length(digits) - 1), F.lit("0"))
        check = F.pmod(-luhn_sum(open_), F.lit(10)).cast("string")
        valid = luhn_sum(canon) % 10 == 0
        return F.when(valid, F.concat(F.substring(drawn, F.lit(1), F.char_length(drawn) - 1), check)).otherwise(drawn)

    card = bound(_relettered(value, seed, F.lit(1)), checked)  # the first digit tells the issuer
    country = F.char_length(F.regexp_extract(value, r"^\+([0-9]{1,3})[ .(-]", 1))
    prefix = F.regexp_extract(value, rf"^(?i:{SECRET_NAMES})\s?[=:]\s?[\"']?", 0)
    kept = F.substring(value, F.char_length(prefix) + 1, F.char_length(value))
    hexed = F.substring(F.sha2(seed, 512), F.lit(1), F.char_length(kept))
    title = F.regexp_extract(value, r"^\p{L}+\.? ", 0)
    script = F.when(value.rlike(r" \p{IsCyrillic}"), "cyrillic").when(value.rlike(r" \p{IsLatin}"), "latin")
    name = F.concat(title, _relettered(_longer(F.substring(value, F.char_length(title) + 1, F.char_length(value)), attempt), seed))
    two = F.size(F.split(F.substring(value, F.char_length(title) + 1, F.char_length(value)), " ")) > 1
    for (letters, gender), given in GIVEN.items():
        pick = lambda at, of: F.get(F.array(*map(F.lit, of)), _draw(seed, at, len(of)).cast("int"))
        some = F.array(*map(F.lit, SYLLABLES[letters]))
        more = F.transform(F.slice(F.sequence(F.lit(0), attempt), 2, attempt), lambda k: F.get(some, _draw(seed, k + 3, len(SYLLABLES[letters])).cast("int")))  # noqa: B023
        parts = F.concat(*[pick(k, SYLLABLES[letters]) for k in (1, 2, 3)], F.array_join(more, ""))  # one syllable more for each further draw
        surname = F.concat(F.initcap(parts), F.lit(SURNAME_ENDS[letters, gender]))
        whole = F.concat(title, F.when(two, F.concat(pick(0, given), F.lit(" "))).otherwise(""), surname)
        name = F.when((script == letters) & F.startswith(canon, F.lit(f"{gender}:")), whole).otherwise(name)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", _relettered(value, seed, country))
        .when(kind == "key", _relettered(value, seed, F.lit(4)))
        .when(kind == "secret", F.concat(prefix, F.when(kept.rlike("^[0-9a-f]{16,128}$"), hexed).otherwise(_relettered(kept, seed))))
        .otherwise(name)
    )


def draws(entities: DataFrame, secret: str, rounds: int = ROUNDS) -> DataFrame:
    """(kind, canon, attempt) of the entities (kind, canon, value) that need another draw than the first; mostly none."""
    known = stage(entities.groupBy("kind", "canon").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(0)))
    real = known.select("kind", F.col("canon").alias("mark"))
    for _ in range(rounds):
        drawn = known.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), secret))
        drawn = stage(drawn.withColumn("mark", canonical(F.col("kind"), F.col("new"))))
        # the first by name keeps a surrogate that others drew too; none keeps one that is real
        first = drawn.groupBy("kind", "mark").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        again = drawn.join(first, ["kind", "mark"]).filter("canon <> first").select("kind", "canon")
        again = again.unionByName(drawn.join(real, ["kind", "mark"], "left_semi").select("kind", "canon")).distinct()
        again = stage(again.withColumn("more", F.lit(1)))
        if again.isEmpty():
            return known.filter("attempt > 0").select("kind", "canon", "attempt")
        known = stage(
            known.join(again, ["kind", "canon"], "left").select("kind", "canon", "value", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
        )
    # names and addresses get longer with each draw, so this is about numbers of a format with hardly any free number
    raise ValueError(f"after {rounds} rounds some entities still share a surrogate")


def replace_entities(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text replaced, and n_entities; a column of that name is replaced."""
    keyed = docs.withColumn("_pii_row", F.xxhash64(F.col(id_col), F.col(text_col)))
    rows = keyed.select("_pii_row", F.col(text_col).alias("_t"))
    matches = F.regexp_extract_all("_t", F.lit(PATTERN), F.lit(0))
    found = rows.select("_pii_row", F.posexplode(matches).alias("at", "value")).distinct()  # repeated rows count once
    found = found.withColumn("kind", F.coalesce(kind_of(F.col("value")), F.lit("name")))
    found = stage(found.withColumn("canon", canonical(F.col("kind"), F.col("value"))))
    others = draws(found, secret)
    new = found.join(others, ["kind", "canon"], "left")
    new = new.withColumn("new", surrogate(F.col("kind"), F.col("value"), F.coalesce("attempt", F.lit(0)), secret))
    per_row = new.groupBy("_pii_row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("_pii_new"))  # of one text
    joined = keyed.join(per_row, "_pii_row", "left")
    pieces = F.split(F.col(text_col), PATTERN, -1)
    mixed = F.concat(F.array_join(F.flatten(F.zip_with(pieces, F.col("_pii_new.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""))
    text = F.when(F.col("_pii_new").isNull(), F.col(text_col)).otherwise(mixed)
    counts = F.coalesce(F.size("_pii_new"), F.lit(0)).cast("int")
    counts = F.when(F.col("_pii_new").isNull(), 0).otherwise(counts).alias("n_entities")
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "n_entities"]
    return joined.select(*kept, counts)
