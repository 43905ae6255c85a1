"""Operator 8, PII surrogates. DataFrame functions only.

1. Entities are found by one pattern (only in texts with a digit, an @ or a title of
   address); card numbers must pass the Luhn check, other long numbers are left alone.
2. Every distinct entity consists of units: its normalised form (digits of a phone
   number or card, the lower-cased address, ...), or for a person the given names and
   the surname, so that "Mr. John Smith" and "Mr. Smith" stay one person. A full name
   found after a title is an entity wherever it stands in the same text without one.
3. Every distinct unit gets a surrogate from a keyed SHA-256: same type, same length and
   character classes, gender and script of the title and name, valid check digit.
   A surrogate taken twice, or equal to an original of its type, is drawn again with the
   next attempt number until all differ: distinct entities stay distinct, and equal ones
   (whatever their format) stay equal over all documents. Where a format has no free
   surrogate left, it grows.
4. Texts are put together again from the pieces between their entities.

Only entities are shuffled, and, once, the texts that hold some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table

SALTS = 16
GROW = 8             # from this attempt on, formats without another free surrogate grow
ROUNDS = 64          # more collisions in a row than this: an error

# fixed values: titles of address by gender, surrogate names by gender and script
MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н"]
NEUTRAL = ["Dr", "Prof", "Professor", "Doctor", "Doktor"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа"]
GIVEN = {
    "m_latin": ["Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan",
                "Jonas", "Leon", "Marco", "Nico", "Oscar", "Paul", "Robin"],
    "f_latin": ["Anna", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Ines",
                "Julia", "Laura", "Marta", "Nora", "Olivia", "Paula", "Rosa"],
    "n_latin": ["Alexis", "Casey", "Dana", "Jamie", "Kim", "Morgan", "Sascha", "Toni"],
    "n_cyrillic": ["Женя", "Саша", "Шура", "Валя"],
    "m_cyrillic": ["Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Кирилл", "Марк"],
    "f_cyrillic": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Ксения", "Мария", "Ольга"],
}
SYLLABLES = {"latin": ["ba", "del", "fin", "gar", "hol", "ker", "lin", "mar", "nor", "pel", "ros",
                       "san", "tal", "ver", "win", "zor"],
             "cyrillic": ["ба", "вел", "гор", "дан", "зар", "кол", "лар", "мил", "нов", "пет",
                          "рад", "сав", "тар", "фед", "хол", "яр"]}
ENDING = {"m_latin": "o", "f_latin": "a", "n_latin": "i", "m_cyrillic": "ов", "f_cyrillic": "ова",
          "n_cyrillic": "ко", "latin": "er"}

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Java recurses for every round of a group with alternatives, but not for a class, a group of
# fixed length or a possessive group: long names, hosts and rows of titles need no stack.
# An address may follow any punctuation; inside a run of its characters only the first letter
# or digit is tried, which finds the same and keeps the search linear
EMAIL = (r"(?=[A-Za-z0-9])(?<![A-Za-z0-9])(?:(?<![._%+-])|(?<![A-Za-z0-9][._%+-]{1,32}))"
         r"[A-Za-z0-9][A-Za-z0-9._%+-]*+"
         # the host's labels, back to the last dot before a top-level name
         r"@[A-Za-z0-9](?:[A-Za-z0-9.-](?<![.-]\.)(?<!\.-))*(?<![.-])\.[A-Za-z]{2,}+")
# each pattern looks at its first character before it looks behind, which is dearer
IP = rf"(?=[0-9])(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
CARD = (r"(?=[0-9])(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}"
        r"|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])")
PHONE = (r"(?=\+)(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
         r"|(?=[0-9])(?<![0-9A-Za-z])(?<![0-9][.-])(?:1[ .-]?\([0-9]{3}\)[ .-]?|(?:1[ .-])?[0-9]{3}[ .-])"
         r"[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = r"(?=[0-9])(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
SECRET = (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{16})"
          r"(?<=(?i:token|secret|api_key|apikey|api-key|password|passwd)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)"
          r"[A-Za-z0-9+/_-]{16,}+")
TITLE = "(?:" + "|".join(x for t in MALE + FEMALE + NEUTRAL for x in (t, t.upper())) + r")\.?"
# a quote or a possessive 's at the end is no part of a name
NAME = r"\p{Lu}(?:\p{L}++|-(?=\p{L})|['’](?=\p{L})(?![sS](?!\p{L})))++"
TITLES = f"{TITLE}(?: {TITLE}(?= {NAME}))*+"
TITLE_START = "(?=[" + "".join(sorted({x for t in MALE + FEMALE + NEUTRAL for x in (t[0].upper(), t[0])})) + "])"
PERSON = rf"{TITLE_START}(?<![\p{{L}}\p{{N}}]){TITLES} {NAME}(?: {NAME}){{0,2}}"
FULL_NAME = f"^{NAME}(?: {NAME}){{1,2}}$"
KINDS = [("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("ssn", SSN),
         ("secret", SECRET), ("person", PERSON)]
ENTITY = "|".join(f"(?:{p})" for _, p in KINDS)
# what every text with an entity holds; a secret follows = or :
TRIGGER = rf"[0-9@=:]|{TITLE_START}(?<![\p{{L}}\p{{N}}]){TITLE} "


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits; a valid number's is divisible by 10."""
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        double = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, double).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def entities(text: Column) -> Column:
    """Array of all entity candidates of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(TRIGGER), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


def name_of(person: Column) -> Column:
    return F.regexp_replace(person, f"^{TITLES} ", "")


def full_names(found: Column) -> Column:
    """Distinct full names (two words or more) of the persons among the candidates of a text,
    also in capitals, or capitalised where found in capitals; longer ones come first."""
    names = F.filter(F.transform(F.filter(found, lambda x: x.rlike(f"^{TITLE} ")), name_of),
                     lambda x: x.contains(" "))
    written = F.flatten(F.transform(names, lambda x: F.array(
        x, F.upper(x), F.when(x == F.upper(x), F.initcap(x)).otherwise(x))))
    return F.reverse(F.array_sort(F.array_distinct(written)))


def with_names(names: Column) -> Column:
    """ENTITY, or one of these names; they consist of letters, spaces, ', ’ and - only. Names
    with the same first two letters share a branch, so that a word is not tried against all."""
    def branch(start):
        ends = F.transform(F.filter(names, lambda x: F.startswith(x, start)),
                           lambda x: F.substring(x, F.lit(3), F.length(x)))
        return F.concat(start, F.lit("(?:"), F.array_join(ends, "|"), F.lit(")"))
    starts = F.array_distinct(F.transform(names, lambda x: F.substring(x, 1, 2)))
    return F.concat(F.lit(ENTITY + r"|(?=\p{Lu})(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(starts, branch), "|"),
                    F.lit(r")(?![\p{L}\p{N}])"))


def kind_of(entity: Column) -> Column:
    """Type of a candidate; null for a long number that is no card."""
    out = None
    for kind, pattern in [("person", PERSON), ("email", EMAIL), ("ip", IP), ("phone", PHONE),
                          ("ssn", SSN), ("card", CARD)]:
        test = entity.rlike(f"^(?:{pattern})$")
        value = F.lit(kind)
        if kind == "card":
            value = F.when((luhn_sum(only_digits(entity)) % 10 == 0), F.lit(kind))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.when(~entity.rlike("^[0-9 -]+$"), F.lit("secret")))


def units(kind: Column, entity: Column) -> Column:
    """Array of (kind, norm) that an entity consists of."""
    one = lambda k, norm: F.array(F.struct(F.lit(k).alias("kind"), norm.alias("norm")))
    name, title = name_of(entity), F.regexp_extract(entity, f"^{TITLES} ", 0)
    has = lambda titles: title.rlike(r"(?:^| )(?iu:" + "|".join(titles) + r")\.? ")
    gender = F.when(has(MALE), "m").when(has(FEMALE), "f").otherwise("n")
    script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    words = F.split(F.lower(name), " ")
    last = F.size(words) - 1
    family = F.when(script == "cyrillic", F.concat(F.lit("family_"), gender, F.lit("_cyrillic"))).otherwise("family_latin")
    person = F.transform(words, lambda w, i: F.struct(
        F.when(i == last, family).otherwise(F.concat(F.lit("given_"), gender, F.lit("_"), script)).alias("kind"),
        w.alias("norm")))
    return (F.when(kind == "person", person)
            .when(kind == "email", one("email", F.lower(entity)))
            .when(kind == "ip", one("ip", entity))
            .when(kind == "card", one("card", only_digits(entity)))
            .when(kind == "phone", one("phone", only_digits(entity)))
            .when(kind == "ssn", one("ssn", only_digits(entity)))
            .otherwise(one("secret", entity)))


def _number(h: Column, i) -> Column:
    """The i-th byte of a hexadecimal string."""
    return F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _bytes(h: Column) -> Column:
    """The bytes of a SHA-256 in hexadecimal digits."""
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: _number(h, i))


def _digits(h: Column) -> Column:
    """Hexadecimal digits as decimal ones."""
    return F.translate(h, "abcdef", "012345")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n % len(values) + 1)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Keyed replacement of a unit, of its type, length and character classes."""
    def digest(*more):
        return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), *more), 256)

    def numbers(n):  # n bytes; a digest is made once for 32 of them
        each = F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), lambda i: digest(i.cast("string")))
        return F.slice(F.flatten(F.transform(each, _bytes)), F.lit(1), F.greatest(n, F.lit(0)))

    def shaped(s, hexadecimal=False):
        abc = "0123456789abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"

        def one(c, v):
            at = lambda letters: F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))
            if hexadecimal:
                return at(abc)
            return (F.when(c.rlike("[0-9]"), at("0123456789")).when(c.rlike("[a-z]"), at(abc))
                    .when(c.rlike("[A-Z]"), at(abc.upper())).otherwise(c))
        return F.array_join(F.zip_with(F.split(s, ""), numbers(F.length(s)), one), "")

    first, rest = F.substring(norm, 1, 1), F.substring(norm, F.lit(2), F.length(norm))
    grown = F.substring(_digits(digest(F.lit("more"))), F.lit(1), F.greatest(attempt - GROW, F.lit(0)))
    numeric = F.concat(first, shaped(rest), grown)
    body = F.concat(first, shaped(F.substring(norm, F.lit(2), F.length(norm) - 2)))
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    # the host depends on the host alone, so that addresses of one host stay together
    host_hash = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("host"), host), 256)
    # an array of one hash, so that it is made once and not for every character
    new_host = F.transform(F.array(host_hash), lambda hashed: F.array_join(F.transform(
        F.split(host, ""), lambda c, i: F.when(
            c.rlike("[a-z0-9]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"),
                                             _number(hashed, i % 32) % 26 + 1, F.lit(1))).otherwise(c)), ""))[0]
    # a short local part that keeps colliding grows
    more = F.when(attempt > 3, F.substring(F.translate(digest(F.lit("more")), "0123456789", "ghijklmnop"),
                                           F.lit(1), attempt - 3)).otherwise("")
    email = F.concat(shaped(local), more, F.lit("@"), new_host, F.lit("."), top)
    h = digest()
    ip = F.concat_ws(".", *[(_number(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    secret = F.when(norm.rlike("^[0-9a-f]+$"), shaped(norm, True)).otherwise(shaped(norm))
    out = (F.when(kind == "email", email).when(kind == "ip", ip)
           .when(kind == "card", F.concat(body, check))
           .when(kind.isin("phone", "ssn"), numeric).when(kind == "secret", secret))
    for script, syllables in SYLLABLES.items():
        def made(ending, syllables=syllables):
            n = F.least(2 + F.floor(attempt / 3).cast("int"), F.lit(8))
            return F.initcap(F.concat(F.array_join(F.transform(
                F.sequence(F.lit(1), n), lambda i: _pick(syllables, _number(h, i))), ""), F.lit(ending)))
        for g in ("m", "f", "n"):
            who = f"{g}_{script}"
            out = out.when(kind == f"given_{who}",
                           F.when(attempt < 2, _pick(GIVEN[who], _number(h, F.lit(0)))).otherwise(made(ENDING[who])))
            if script == "cyrillic":
                out = out.when(kind == f"family_{who}", made(ENDING[who]))
        if script == "latin":
            out = out.when(kind == "family_latin", made(ENDING["latin"]))
    return out


def unit_surrogates(found: DataFrame, key: str) -> DataFrame:
    """Distinct units (kind, norm) with surrogates that all differ and are no original.

    A round draws for the units that have none yet. Of equal draws the least unit keeps its
    own, if no unit of an earlier round and no original has it; a round writes what it settled."""
    originals = stored(found.select("kind", F.lower("norm").alias("taken")).distinct())
    todo, done = found.select("kind", "norm"), None
    for attempt in range(ROUNDS):
        drawn = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        # a minimum is partly made before the shuffle: many equal draws fill no task
        first = (drawn.withColumn("taken", F.lower("surrogate")).groupBy("kind", "taken")
                 .agg(F.min(F.struct("norm", "surrogate")).alias("who"))
                 .join(originals, ["kind", "taken"], "left_anti"))
        if done is not None:
            first = first.join(done, ["kind", "taken"], "left_anti")
        new = stored(first.select("kind", "taken", "who.norm", "who.surrogate"))
        done = new if done is None else done.unionByName(new)
        todo = stored(todo.join(new, ["kind", "norm"], "left_anti"))
        if todo.isEmpty():
            return done.select("kind", "norm", "surrogate")
    raise ValueError("no free surrogate for some entities")


def replacements(found: DataFrame, key: str) -> DataFrame:
    """Distinct candidates (column entity) -> (entity, replacement) of the real entities."""
    typed = (found.select("entity").distinct().withColumn("type", kind_of(F.col("entity")))
             .filter("type IS NOT NULL"))
    parts = stored(typed.select("entity", "type", F.posexplode_outer(units(F.col("type"), F.col("entity"))).alias("i", "unit"))
                   .select("entity", "type", "i", "unit.kind", "unit.norm"))
    new = unit_surrogates(stored(parts.select("kind", "norm").distinct()), key)
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x.surrogate)
    whole = (parts.join(new, ["kind", "norm"]).groupBy("entity", "type").agg(words.alias("words")))
    e, w = F.col("entity"), F.col("words")
    flat = w[0]
    # digits go back into the entity's own format, those that it grew by after its last one
    pieces = F.split(e, "[0-9]", -1)
    places = F.size(pieces) - 1
    digits = F.concat(F.slice(F.split(flat, ""), F.lit(1), F.greatest(places - 1, F.lit(0))),
                      F.array(F.substring(flat, places, F.length(flat)), F.lit("")))
    refilled = F.array_join(F.zip_with(pieces, digits, lambda a, b: F.concat(a, b)), "")
    title = F.regexp_extract(e, f"^{TITLES} ", 0)
    person = F.concat(title, F.array_join(w, " "))
    out = (F.when(F.col("type").isin("card", "phone", "ssn"), refilled)
           .when(F.col("type") == "person", person).otherwise(flat))
    shout = (e == F.upper(e)) & (e != F.lower(e)) & F.col("type").isin("email", "person")
    return whole.select("entity", F.when(shout, F.upper(out)).otherwise(out).alias("replacement"))


def replace_pii(docs: DataFrame, key: str, text_col: str = "text",
                count_col: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced, and their number as ``count_col``.
    The ``key`` is the caller's secret: with it, surrogates can be drawn again and compared.

    Null and empty texts stay as they are, as does every text without entities. Rows are
    told apart by nothing but their texts: ids may be null or repeated, all other columns
    are kept, and an empty table gives an empty result.
    """
    cols = docs.columns
    text = F.col(text_col)
    made = F.struct(*[F.col(c) for c in cols]).alias("row")
    rows = docs.select(made, text.alias("t"), entities(text).alias("e0"))
    n = (lambda c: [c.cast("int").alias(count_col)]) if count_col else (lambda c: [])
    plain = (rows.filter(F.col("e0").isNull() | (F.size("e0") == 0))
             .select(*[F.col("row")[c].alias(c) for c in cols], *n(F.lit(0))))
    # a second look, with the full names of the first one's persons, where there are any
    named, pattern = F.size("names") > 0, with_names(F.col("names"))
    held = (rows.filter(F.size("e0") > 0).withColumn("names", full_names(F.col("e0")))
            .withColumn("e", F.when(named, F.regexp_extract_all("t", pattern, F.lit(0))).otherwise(F.col("e0")))
            .withColumn("k", F.sha2(F.array_join("e", "\x00"), 256)))
    # texts with the same entities (copies) share one row here
    lists = stored(held.groupBy("k").agg(F.first("e").alias("e"), F.count("*").alias("texts")))
    # lists that a large part of the texts share (64 at most) meet them under salts
    every = lists.agg(F.sum("texts")).first()[0] or 0
    hot = [r.k for r in lists.filter(F.col("texts") * 64 > every).select("k").collect()]
    # a name without title stands for the first person of that name
    persons = F.transform(F.filter("e", lambda x: x.rlike(f"^{TITLE} ")),
                          lambda x: F.struct(F.lower(name_of(x)).alias("name"), x.alias("entity")))

    def seen(x):
        same = F.filter("persons", lambda p: p["name"] == F.lower(x))
        return F.struct(x.alias("s"), F.when(x.rlike(FULL_NAME), F.get(same, 0)["entity"]).alias("entity"))
    each = (lists.withColumn("persons", persons)
            .select("k", F.posexplode(F.transform("e", seen)).alias("i", "seen"))
            .select("k", "i", "seen.s", F.coalesce("seen.entity", "seen.s").alias("entity"),
                    F.col("seen.entity").isNotNull().alias("bare")))
    news = stored(replacements(each, key))
    name = name_of(F.col("replacement"))
    again = F.when(F.col("s") == F.upper("s"), F.upper(name)).otherwise(F.initcap(name))
    filled = (each.join(news, "entity", "left")
              .groupBy("k").agg(F.array_sort(F.collect_list(F.struct(
                  "i", F.coalesce(F.when(F.col("bare"), again).otherwise(F.col("replacement")), "s").alias("s"),
                  F.col("replacement").isNotNull().cast("int").alias("n")))).alias("new")))
    between = F.when(named, F.split("t", pattern, -1)).otherwise(F.split("t", ENTITY, -1))
    joined = F.array_join(F.zip_with(
        between, F.concat(F.transform("new", lambda x: x.s), F.array(F.lit(""))),
        lambda a, b: F.concat(a, b)), "")
    count = F.aggregate("new", F.lit(0), lambda acc, x: acc + x.n)
    is_hot = F.col("k").isin(hot)
    filled = filled.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1)))
                                                 .otherwise(F.array(F.lit(0)))))
    salt = F.when(is_hot, F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)
    changed = held.withColumn("salt", salt).join(filled, ["k", "salt"]).select(
        *[joined.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in cols], *n(count))
    return plain.unionByName(changed)


@register("op8_pii_surrogates")
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with PII replaced by surrogates, and the number of replacements.
    SQL has no keyed draw with collision rounds: the tests check types, formats,
    distinctness and coreference against the originals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_pii(docs, "op8_pii_surrogates", count_col="n_replaced")
