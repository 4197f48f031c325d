r"""Surrogates for personal data, in DataFrame operations only.

Detected entities (e-mail, IPv4 and IPv6 addresses, phone, card and social security numbers, bank accounts,
titled names) are replaced by others of their kind. A surrogate depends on a key, the kind and the
normalised value alone, so one entity has one surrogate in all documents and spellings. Digits become
digits, letters become letters of the same case and script, separators stay; e-mail and IP addresses keep their
shape; card and account numbers whose check digits are right get right ones; a phone number keeps its
country code, which is read from its digits and so is the same in all spellings.

A name is up to three words behind one or more titles, with hyphens, apostrophes and inner capitals. It has
one surrogate with and without a dot, under all titles and, if it has two words or more, where it stands
in the same text without a title. There its last word alone, with or without a title, gets the last word
of the surrogate; of several full names with that word the first is meant. Its given name is replaced by one of
its script and gender, which the corpus's titles tell, else the name itself.

Later attempts widen what a format leaves too few values for: names grow by letters, country codes are
let go, numbers grow by digits. A dictionary of all different
entities is checked: entities whose surrogate another entity shares, or that is itself an entity of
the corpus, are keyed anew until none is left.

Defined cases: null texts stay null and have no entities; texts without entities come back unchanged;
repeated rows, null ids among them, get equal texts; texts of any length are searched and split whole; other columns pass
through, whatever their names, but for n_entities, which gives way to the result; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolark.core import field, own_columns, scratch, staged

#: A word of a name: hyphens and apostrophes inside, capitals anywhere behind the first.
NAME_WORD = r"\p{Lu}\p{L}*+(?:['’\-]\p{L}++)*+"
TITLES = r"(?:(?:Mrs|Ms|Mr|Miss|Herr|Frau|Monsieur|Madame|Señora|Señor|Sra|Sr|Dr|Prof)\b\.? )+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.\p{L}{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)",
    "ip6": r"(?<![\p{L}\p{N}:])(?=[A-Fa-f:]*+\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\p{L}\p{N}:])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4} \d{3,4} \d{3,4}|(?<![\p{L}\d.,\-_/=])[2-9]\d{2}[2-9]\d{6}(?![\p{L}_]|[.,]\d))(?![\d\-])",
    "card": r"(?<![\d.])\d{4}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?![\d.]*\d)",
    "name": rf"(?<!\p{{L}}){TITLES}(?!(?:Mrs|Ms|Mr|Dr|Prof)\.){NAME_WORD}(?: {NAME_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Given names by script and gender; those of a list also tell the gender of a name.
GIVEN = {
    "[A-Za-zÀ-ɏ]": ("Anna Clara Elena Julia Laura Maria Nora Paula Sofia Vera Alice Carmen Ingrid Ruth Helen Karen", "Adam Boris David Erik Felix Hugo Leon Martin Oscar Viktor Joshua Luca Nikola Peter Thomas Andreas"),
    "[Ѐ-ӿ]": ("Анна Вера Дарья Елена Ирина Любовь Мария Ольга", "Антон Борис Виктор Иван Илья Максим Никита Фёдор"),
    "[Ͱ-Ͽ]": ("Άννα Ελένη Ειρήνη Ζωή Μαρία Σοφία Δανάη Χλόη", "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Φώτης"),
}
TITLE = f"^{TITLES}"
#: A full name, without a title.
FULL = rf"^{NAME_WORD}(?: {NAME_WORD}){{1,2}}$"
FEMALE, MALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|Sra)\b", r"^(?:Mr|Herr|Monsieur|Señor|Sr)\b"
#: The calling codes of one and two digits; the others have three. Separators may stand between.
CODE = r"^\+(?:[17]|2\D*[07]|3\D*[0-469]|4\D*[013-9]|5\D*[1-8]|6\D*[0-6]|8\D*[1246]|9\D*[0-58]|\d\D*\d\D*\d)"
#: From this attempt on, a phone number's country code is exchanged too.
FREE_CODE = 10
HEX = "0123456789abcdef"
ALPHABETS = {"[a-z]": "bcdfghjklmnprstv", "[A-Z]": "BCDFGHJKLMNPRSTV", "[а-я]": "бвгдежзиклмнопрс", "[А-Я]": "БВГДЕЖЗИКЛМНОПРС", "[α-ω]": "αβγδεζηθικλμνξοπ", "[Α-Ω]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠ", r"\p{Ll}": "bcdfghjklmnprstv", r"\p{Lu}": "BCDFGHJKLMNPRSTV"}
#: From this attempt on, numbers grow by a digit for each attempt.
LONGER_NUMBERS = 12
MAX_ROUNDS = 60


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it (also in lambdas of its own)."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _surname(name: Column) -> Column:
    return F.regexp_extract(name, r"(\S+)$", 1)


def kind_of(value: Column) -> Column:
    chain = None
    for kind, pattern in PATTERNS.items():
        whole = value.rlike(rf"^(?:{pattern})$")
        chain = F.when(whole, F.lit(kind)) if chain is None else chain.when(whole, F.lit(kind))
    # a name that is known from its title elsewhere in the text
    return chain.when(value.rlike(rf"^{NAME_WORD}(?: {NAME_WORD}){{0,2}}$"), F.lit("name")).otherwise(F.lit("card"))


def normalised(value: Column, kind: Column) -> Column:
    """What spellings of one entity have in common."""
    bare = F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
    phone = F.concat(F.regexp_extract(value, r"^\+?", 0), bare)
    return F.when(kind.isin("email", "ip6"), F.lower(value)).when(kind == "ip", value).when(kind == "name", F.regexp_replace(value, TITLE, "")).when(kind == "phone", phone).otherwise(bare)


def _letter(c: Column, digest: Column, at: Column) -> Column:
    """What a letter or digit becomes: one of its case and script, keyed by its place."""
    out = F.when(c.rlike("[0-9]"), F.substr(F.translate(digest, HEX, "0123456789314159"), at, F.lit(1)))
    for letters, alphabet in ALPHABETS.items():
        out = out.when(c.rlike(letters), F.substr(F.translate(digest, HEX, alphabet), at, F.lit(1)))
    return out.otherwise(c)


def _bare_shaped(value: Column, digest: Column) -> Column:
    """The value's letters and digits, without separators, exchanged for keyed ones."""
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    chars = F.filter(F.split(bare, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: _letter(c, digest, F.pmod(i, F.lit(64)) + 1)), "")


def _spelled_like(value: Column, bare: Column) -> Column:
    """`bare` with the separators of value at their places."""
    pieces = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"), bare.alias("bare"))

    def put(s: Column, piece: Column) -> Column:
        own = piece.rlike(r"^[\p{L}\p{N}]")
        size = F.length(piece)
        return F.struct((s.at + F.when(own, size).otherwise(0)).alias("at"), F.concat(s.out, F.when(own, F.substr(s.bare, s.at, size)).otherwise(piece)).alias("out"), s.bare.alias("bare"))

    return F.aggregate(pieces, start, put, lambda s: F.concat(s.out, F.substr(s.bare, s.at)))


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def luhn(text: Column) -> Column:
    """The sum of a number's digits, every second from the last doubled and its digits summed, modulo 10."""
    doubled = F.transform(F.reverse(_digits(text)), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda s, d: s + d), F.lit(10))


def mod97(account: Column) -> Column:
    """An account's rest: country and check digits go last, letters count as 10 to 35; 1 if it is right."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _longer(name: Column, digest: Column, attempt: Column) -> Column:
    """A letter more for every two attempts, in the script of the name's last one."""
    last, part = F.substr(name, F.length(name)), F.substr(digest, F.lit(20), F.floor(attempt / 2).cast("int"))
    more = None
    for letters, alphabet in ALPHABETS.items():
        if alphabet == alphabet.lower():
            new = F.translate(part, HEX, alphabet)
            more = F.when(last.rlike(letters), new) if more is None else more.when(last.rlike(letters), new)
    return _spelled_like(name, F.concat(_bare_shaped(name, digest), F.when(attempt > 1, more).otherwise("")))


def female_by_name(given: Column) -> Column:
    """Whether a given name is of a list of women's names or, if of neither list, ends like one."""
    women, men = (F.array(*[F.lit(x) for lists in GIVEN.values() for x in lists[k].split(" ")]) for k in (0, 1))
    return F.when(F.array_contains(women, given), True).when(F.array_contains(men, given), False).otherwise(given.rlike("[aаяαηά]$"))


def _name(bare: Column, digest: Column, attempt: Column, female: Column) -> Column:
    pick = F.conv(F.substr(digest, F.lit(40), F.lit(4)), 16, 10).cast("int")
    first, middle, family = F.regexp_extract(bare, r"^(\S+) ", 1), F.regexp_extract(bare, r"^\S+ (\S+) ", 1), F.regexp_extract(bare, r"(\S+)$", 1)
    given, woman = _bare_shaped(first, digest), F.coalesce(female, female_by_name(first))
    for script, lists in GIVEN.items():
        women, men = (F.array(*[F.lit(x) for x in names.split(" ")]) for names in lists)
        chosen = lambda names: F.element_at(names, F.pmod(pick, F.size(names)) + 1)
        given = F.when(first.rlike(script), F.when(woman, chosen(women)).otherwise(chosen(men))).otherwise(given)
    given = F.when(first.rlike(r"^\p{Lu}{2}"), F.upper(given)).otherwise(given)
    # a middle name has letters of its own place in the digest
    between = F.when(middle != "", _spelled_like(middle, _bare_shaped(middle, F.substr(digest, F.lit(33)))))
    return F.when(first != "", F.concat_ws(" ", given, between, _longer(family, digest, attempt))).otherwise(_longer(family, digest, attempt))


def surrogate(value: Column, kind: Column, key: str, attempt: Column, female: Column) -> Column:
    """The replacement of an entity; attempt tells tries apart, female is known of some names."""
    made = lambda k, norm: let(F.sha2(F.concat_ws("\x1f", F.lit(key), k, norm, attempt.cast("string")), 256), lambda digest: _of_kind(value, k, norm, digest, attempt, female))
    return let(kind, lambda k: let(normalised(value, k), lambda norm: made(k, norm)))


def _of_kind(value: Column, kind: Column, norm: Column, digest: Column, attempt: Column, female: Column) -> Column:
    octet = lambda i: (F.conv(F.substr(digest, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int") % 254 + 1).cast("string")
    local = F.substring_index(F.lower(value), "@", 1)
    email = F.concat(_spelled_like(local, _bare_shaped(local, digest)), F.lit("@"), F.translate(F.substr(digest, F.lit(50), F.lit(8)), HEX, ALPHABETS["[a-z]"]), F.lit(".example.net"))
    name = F.concat(F.regexp_extract(value, TITLE, 0), _name(norm, digest, attempt, female))
    more = F.when(attempt >= LONGER_NUMBERS, F.translate(F.substr(digest, F.lit(30), attempt - LONGER_NUMBERS + 1), HEX, "0123456789314159")).otherwise("")
    bare = F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    number = let(bare, lambda old: let(F.concat(_bare_shaped(old, digest), more), lambda new: _number(value, kind, old, new, attempt)))
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(digest, 4 * i + 1, F.lit(4)))
    return F.when(kind == "email", email).when(kind == "ip6", F.array_join(groups, ":")).when(kind == "ip", F.concat_ws(".", *[octet(i) for i in range(4)])).when(kind == "name", name).otherwise(number)


def _number(value: Column, kind: Column, old: Column, new: Column, attempt: Column) -> Column:
    """new, the keyed form of old, with right check digits or country code, spelled like value."""
    start = F.substr(new, F.lit(1), F.length(new) - 1)
    card = F.when(luhn(old) == 0, F.concat(start, F.pmod(10 - luhn(F.concat(start, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(new)
    country, rest = F.substr(old, F.lit(1), F.lit(2)), F.substr(new, F.lit(5))
    check = F.when(mod97(old) == 1, _two(98 - mod97(F.concat(country, F.lit("00"), rest)))).otherwise(F.substr(new, F.lit(3), F.lit(2)))
    code = F.when(attempt < FREE_CODE, F.regexp_replace(F.regexp_extract(value, CODE, 0), r"\D", "")).otherwise("")
    phone = F.concat(code, F.substr(new, F.length(code) + 1))
    return _spelled_like(value, F.when(kind == "iban", F.concat(country, check, rest)).when(kind == "phone", phone).when(kind == "card", card).otherwise(new))


def entity_dictionary(rows: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, female) of every entity that needs another attempt than the first, or whose
    titles tell another gender than its name; checked until no two entities of a kind share a surrogate
    and none is an entity itself."""
    values = rows.select(F.explode("found").alias("value")).distinct()
    values = values.withColumn("kind", kind_of(F.col("value"))).withColumn("norm", normalised(F.col("value"), F.col("kind")))
    female = F.when(F.max(F.col("value").rlike(FEMALE)), True).when(F.max(F.col("value").rlike(MALE)), False)
    entities = values.groupBy("kind", "norm").agg(F.min("value").alias("value"), female.alias("female"))
    entities = staged(entities.withColumns({"value": F.when(F.col("kind") == "name", F.col("norm")).otherwise(F.col("value")), "attempt": F.lit(0)}))
    for _ in range(MAX_ROUNDS):
        made = entities.withColumn("made", surrogate(F.col("value"), F.col("kind"), key, F.col("attempt"), F.col("female")))
        made = staged(made.withColumn("as", normalised(F.col("made"), F.col("kind"))))
        shared = made.groupBy("kind", "as").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = made.join(shared, ["kind", "as"]).where(F.col("norm") != F.col("first.norm")).select("kind", "norm")
        real = made.join(made.select("kind", F.col("norm").alias("as")), ["kind", "as"], "left_semi").select("kind", "norm")
        again = staged(again.union(real).distinct())
        if again.isEmpty():
            told = (F.col("kind") == "name") & (F.col("female") != female_by_name(F.regexp_extract("norm", r"^\S+", 0)))
            return staged(made.where((F.col("attempt") > 0) | F.coalesce(told, F.lit(False))).select("kind", "norm", "attempt", "female"), keep=True)
        entities = staged(entities.join(again.withColumn("more", F.lit(1)), ["kind", "norm"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more"))
    raise RuntimeError("surrogates still collide; the kinds' formats leave too few values")


def with_surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's entities replaced, and n_entities."""
    own = docs.select(own_columns(docs), F.monotonically_increasing_id().alias("row"), docs[f"`{text}`"].alias("text"))
    none = F.array().cast("array<string>")
    titled = own.withColumn("found", F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), none))
    names = F.filter(F.transform(F.filter("found", lambda v: v.rlike(TITLE)), lambda v: F.regexp_replace(v, TITLE, "")), lambda v: v.rlike(FULL))
    # longer ones first, as the first alternative that fits is taken
    names = F.array_distinct(F.concat(names, F.transform(names, _surname)))
    with_names = F.concat(F.lit(ANY + r"|(?<!\p{L})(?:"), F.array_join(names, "|"), F.lit(r")(?!\p{L})"))
    marked = titled.withColumn("any", F.when(F.size(names) > 0, with_names))
    found = F.when(F.col("any").isNull(), F.col("found")).otherwise(F.regexp_extract_all("text", F.col("any"), F.lit(0)))
    rows = staged(marked.select("doc", "row", "any", found.alias("found")))
    with scratch(docs.sparkSession):
        changed = entity_dictionary(rows, key)
        if changed.isEmpty():
            known = rows.withColumn("known", F.create_map().cast("map<string,struct<attempt:int,female:boolean>>"))
        else:
            held = rows.select("row", F.explode(F.array_distinct("found")).alias("value")).withColumn("kind", kind_of(F.col("value")))
            held = held.withColumn("norm", normalised(F.col("value"), F.col("kind"))).join(changed, ["kind", "norm"])
            maps = held.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("value", F.struct("attempt", "female")))).alias("known"))
            known = rows.join(staged(maps, keep=True), "row", "left")
    of = lambda v: F.try_element_at(F.col("known"), v)
    whole_of = lambda v: surrogate(v, kind_of(v), key, F.coalesce(of(v).attempt, F.lit(0)), of(v).female)
    # a surname is that of the first full name of the text that ends in it
    full = F.filter("found", lambda v: F.regexp_replace(v, TITLE, "").rlike(FULL) & kind_of(v).eqNullSafe("name"))
    named = F.transform(full, lambda v: F.struct(_surname(v).alias("old"), v.alias("value")))
    bearer = lambda v: F.get(F.filter(named, lambda n: n.old == F.regexp_replace(v, TITLE, "")), F.lit(0)).value
    made = F.transform("found", lambda v: let(bearer(v), lambda b: F.when(b.isNull(), whole_of(v)).otherwise(F.concat(F.regexp_extract(v, TITLE, 0), _surname(whole_of(b))))))
    whole = F.col(field("doc", text))
    gaps = F.when(F.col("any").isNull(), F.split(whole, ANY, -1)).otherwise(F.split(whole, F.col("any"), -1))
    pieces = F.zip_with(gaps, made, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    out = F.when(F.size("found") == 0, whole).otherwise(F.array_join(pieces, "")).alias(text)
    kept = [out if c == text else F.col(field("doc", c)) for c in docs.columns if c.lower() != "n_entities"]
    return known.select(*kept, F.size("found").cast("long").alias("n_entities"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = "corpus-surrogates-v1") -> DataFrame:
    """Every document of documents with surrogates in place of personal data. The key given here is for
    the test tables; a corpus of real people takes one of its own, kept secret."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_surrogates(docs, key).select("doc_id", "n_entities", "text")
