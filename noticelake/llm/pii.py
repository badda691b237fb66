"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern: e-mail addresses, phone numbers, social security
and card numbers, IPv4 addresses, access keys, values of passwords and tokens, and
names (after a title or a known given name). Each distinct entity gets one surrogate
of its type, derived from a secret key with SHA-2, so every mention of it, in any
document and in any punctuation, gets the same one:

* digits stay digits, letters keep case, script and whether they are vowels, so the
  format survives; card numbers keep their Luhn validity, telephone numbers their
  country code, addresses become reserved ones (240.0.0.0/4 or the same private net),
  e-mail domains become subdomains of example.com;
* given names are exchanged for names of the same gender and script by a keyed
  rotation of the list; titles stay; Cyrillic surnames keep a feminine ending.

Surrogates are then checked over the corpus: one that two entities would share, or
that is itself an entity of the corpus, is derived again, with more characters from
the fifth attempt on, until all are distinct. What has no room for more characters takes
a wider pool: private addresses leave their net for 10.0.0.0/8 after four attempts and
for 240.0.0.0/4 after nine, all addresses that net after fourteen, and telephone and social security
numbers their fixed first digits after nine. Given names need no check, a rotation is
one to one.

Every word of a name that is no title is replaced wherever else it stands alone in the
same text, by the same surrogate: "Smith" after "Mr John Smith". In a text without the
full name such a word is left as it is.

Null texts stay null, empty texts empty; rows are not identified by an id, so
repeated rows and ids are treated alike. All other columns pass through."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from noticelake.llm.common import stored

# Common given names by script and gender.
GIVEN = {
    "latin male": "Adam Ahmed Alexander Ali Andrew Antonio Carlos Charles Daniel David Dmitri Francisco Friedrich George Hans "
                  "Henri Hiroshi Jacques James Jean John Jorge José Jürgen Kenji Klaus Louis Luis Mark Michael Michel Mohammed "
                  "Omar Paul Pedro Peter Philippe Pierre Rahul Richard Robert Sergei Stefan Thomas Walter William Wolfgang",
    "latin female": "Aisha Alice Amina Andrea Anna Barbara Brigitte Carmen Catherine Charlotte Christine Claire Elena Elizabeth Emily "
                    "Emma Fatima Françoise Heike Helga Ingrid Irina Isabel Jane Jennifer Julia Karin Laura Linda Lucía "
                    "Margaret Maria Marie Martina Mary Monique Monika Nathalie Olga Petra Priya Sabine Sarah Sophie Susan Svetlana Teresa Yuki",
    "cyrillic male": "Александр Алексей Андрей Борис Владимир Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей",
    "cyrillic female": "Александра Анастасия Анна Валентина Вера Галина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Sir Herr Frau Monsieur Madame Mme Mlle Señor Señora Señorita Sr Sra Господин Госпожа".split()

#: A name of any given name may follow these words and a colon.
CUES = "name author contact signed sender editor applicant".split()

_ALL = "|".join(sorted({n for names in GIVEN.values() for n in names.split()}, key=lambda n: (-len(n), n)))
_TITLE = "|".join(sorted(TITLES, key=lambda t: (-len(t), t)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_CUE = rf"(?<=(?i:{'|'.join(CUES)}): )"
#: A word that may mention a name again.
BARE = rf"(?<![\p{{L}}\p{{N}}@.+-]){_NAME}(?![\p{{L}}\p{{N}}@])"
_NUMBERS = "|".join((
    r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?<s>[ .-])\d{2,4}(?:\k<s>\d{2,4}){0,3}(?!\d)",
    r"(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\d-])",
    r"\d{3}-\d{2}-\d{4}(?![\d-])",
    r"[3-6]\d{3}(?<c>[ -]?)\d{4}\k<c>\d{4}\k<c>\d{4}(?!\d)", r"3[47]\d{2}(?<x>[ -]?)\d{6}\k<x>\d{5}(?!\d)",
    rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"))
#: A cheap look at the next characters goes before each costly alternative.
PATTERN = r"(?<![\p{L}\p{N}@.+-])(?:" + "|".join((
    rf"(?=[\d+(])(?:{_NUMBERS})",
    r"(?=[PpSsTtAa])(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\x22']?[^\s\x22',;]{5,}[^\s\x22',;.]",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    rf"(?=\p{{Lu}}\p{{Ll}}*+\.? \p{{Lu}}\p{{Ll}})(?:(?:{_TITLE})\.? (?:{_NAME} )?|(?:{_ALL}) ){_NAME}",
    rf"(?=\p{{Lu}}\p{{Ll}}*+\.? \p{{Lu}}\p{{Ll}}){_CUE}{_NAME} {_NAME}",
    r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}")) + ")"
_SECRET = r"(?s)^((?i:password|passwd|secret|token|api_?key) ?[=:] ?[\x22']?)(.*)$"

_CLASSES = [  # (pattern of a character, what stands for it)
    (r"\d", "0123456789"), (r"[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûü]", "aeiou"), (r"[AEIOUYÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜ]", "AEIOU"),
    (r"[аеёиоуыэюя]", "аеиоуыэюя"), (r"[АЕЁИОУЫЭЮЯ]", "АЕИОУЭЮЯ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "бвгджзклмнпрстфхцчш"), (r"[\p{IsCyrillic}&&\p{Lu}]", "БВГДЖЗКЛМНПРСТФХЦЧШ"),
    (r"\p{Lu}", "BCDFGHJKLMNPQRSTVWXZ"), (r"\p{L}", "bcdfghjklmnpqrstvwxz")]


def found(text: Column | str) -> Column:
    """The entities of a text in order."""
    return F.regexp_extract_all(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), F.lit(PATTERN), 0)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kind(m: Column) -> Column:
    """The type of a match; null for a long number that is no card by its check digit."""
    return (F.when(m.rlike(_SECRET), "secret").when(m.contains("@"), "email").when(m.rlike(r"^[+(]|^\d{3}-\d{3}-"), "phone")
            .when(m.rlike(r"^\d{3}-\d{2}-"), "ssn").when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
            .when(m.rlike(r"^\d"), F.when(_luhn(_digits(m)) == 0, "card"))
            .when(m.rlike("^A[KS]IA[0-9A-Z]{16}$"), "access key").otherwise("name"))


def name_part(word: Column) -> Column:
    """Of a word of a name: null for a title, the group of a given name, or surname."""
    given = {n: g for g, names in reversed(GIVEN.items()) for n in names.split()}
    table = F.create_map(*[F.lit(x) for item in given.items() for x in item])
    return F.when(~F.replace(word, F.lit("."), F.lit("")).isin(TITLES), F.coalesce(table[word], F.lit("surname")))


def norm(m: Column, of: Column) -> Column:
    """What all mentions of an entity share."""
    digits = _digits(m)
    return (F.when(of == "email", F.lower(m)).when(of.isin("card", "ssn"), digits)
            .when(of == "phone", F.when(digits.rlike(r"^1?\d{10}$"), F.right(digits, F.lit(10))).otherwise(digits))
            .when(of == "secret", F.regexp_replace(m, _SECRET, "$2")).otherwise(m))


def _stream(key: str, *parts: Column) -> Column:
    """Hex digits for the characters of an entity, 32 characters a block."""
    seed = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    blocks = F.sequence(F.lit(0), F.floor((F.length(parts[1]) + 40) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(seed, b.cast("string")), 512)), "")


def _poured(text: Column, stream: Column, hexed: Column) -> Column:
    """Each letter and digit exchanged for one of its class."""
    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = F.when(hexed & c.rlike("[a-f]"), F.substring(F.lit("abcdef"), v % 6 + 1, F.lit(1)))
        for pattern, into in _CLASSES:
            out = out.when(c.rlike(f"^{pattern}$"), F.substring(F.lit(into), v % len(into) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _card(entity: Column, poured: Column) -> Column:
    body = F.concat(F.left(entity, F.lit(1)), F.substring(poured, F.lit(2), F.length(entity) - 2))
    check = ((F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    return F.when(_luhn(entity) == 0, F.concat(body, check)).otherwise(F.concat(body, F.right(poured, F.lit(1))))


def _rotation(key: str) -> Column:
    """Given name -> another of its gender and script, one to one."""
    pairs: dict[tuple[str, str], str] = {}
    for group, names in GIVEN.items():
        order = sorted(names.split(), key=lambda n: hashlib.sha256(f"{key}\x1f{n}".encode()).digest())
        pairs |= {(group, a): b for a, b in zip(order, order[1:] + order[:1])}
    return F.create_map(*[F.lit(x) for (group, a), b in pairs.items() for x in (f"{group} {a}", b)])


def derived(entities: DataFrame, key: str) -> DataFrame:
    """Normalized entities (kind, entity, attempt) with their ``surrogate``."""
    of, entity, stream, poured = (F.col(c) for c in ("kind", "entity", "stream", "poured"))
    staged = entities.select(
        "kind", "entity", "attempt", _stream(key, of, entity, F.col("attempt")).alias("stream"),
        F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: i).alias("four"))
    staged = staged.withColumn("poured", _poured(entity, stream, entity.rlike("^[0-9a-f]{8,}$"))).withColumn(
        "numbers", F.transform("four", lambda i: F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))
    more = F.when(of.isin("card", "ssn", "phone", "ip"), 0).otherwise(F.greatest(F.col("attempt") - 4, F.lit(0)))
    letters = _letters(F.left(F.sha2(F.concat(stream, F.lit("more")), 256), more))
    private = entity.rlike(r"^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.")
    net = F.when(~private | (F.col("attempt") > 9), 0).when(entity.rlike(r"^10\.") | (F.col("attempt") > 4), 1).otherwise(2)
    first = F.when(private & (net == 1), "10").when(F.col("attempt") > 14, (F.get("numbers", F.lit(0)) % 256).cast("string")).otherwise(
        (F.get("numbers", F.lit(0)) % 15 + 240).cast("string"))
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: F.when(i == 0, F.when(net == 2, o).otherwise(first)).when(
        i < net, o).otherwise((F.get("numbers", i) % 256).cast("string"))), ".")
    domain = _letters(F.left(F.sha2(F.concat_ws("\x1f", F.lit(key), F.regexp_replace(entity, "^.*@", "")), 256), F.lit(10)))
    area = F.concat(_from_two(poured, 1), F.substring(poured, 2, 2), _from_two(poured, 4), F.substring(poured, 5, 6))
    whole = F.concat(F.left(entity, F.lit(2)), F.substring(poured, F.lit(3), F.length(poured)))
    ending = F.when(entity.rlike("[ая]$"), F.concat(F.left(poured, F.length(poured) - 1), F.right(entity, F.lit(1)))).otherwise(poured)
    return staged.select(
        "kind", "entity", "attempt",
        F.when(of == "email", F.concat(F.regexp_replace(poured, "@.*$", ""), letters, F.lit("@"), domain, F.lit(".example.com")))
        .when(of == "card", _card(entity, poured))
        .when(of == "ssn", F.when(F.col("attempt") > 9, poured).otherwise(F.concat(F.lit("9"), F.substring(poured, F.lit(2), F.length(poured)))))
        .when(of == "phone", F.when(F.col("attempt") > 9, poured).when(F.length(entity) == 10, area).otherwise(whole)).when(of == "ip", ip)
        .when(of == "access key", F.concat(F.left(entity, F.lit(4)), F.substring(F.upper(poured), F.lit(5), F.lit(16)), F.upper(letters)))
        .when(of == "surname", F.concat(ending, letters)).when(of == "secret", F.concat(poured, letters))
        .otherwise(_rotation(key)[F.concat_ws(" ", of, entity)]).alias("surrogate"))


def _letters(hexed: Column) -> Column:
    return F.translate(hexed, "0123456789", "ghkmnprstz")


def _from_two(poured: Column, at: int) -> Column:
    return (F.substring(poured, at, 1).cast("int") % 8 + 2).cast("string")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities (kind, entity) -> (kind, entity, surrogate): distinct within
    a kind, and no entity of the corpus. One written table per round of derivation."""
    current = stored(derived(entities.select("kind", "entity", F.lit(0).alias("attempt")), key))
    while True:
        checked = current.where("NOT kind rlike 'male$'")
        claims = checked.select("kind", F.col("surrogate").alias("value"), "entity").union(
            checked.select("kind", F.col("entity").alias("value"), F.lit(None).cast("string")))
        owners = claims.groupBy("kind", "value").agg(
            F.max(F.col("entity").isNull()).alias("real"), F.count("entity").alias("n"), F.min("entity").alias("owner"))
        clash = owners.where("n > 0 AND (real OR n > 1)").withColumnRenamed("value", "surrogate")
        lost = stored(checked.join(clash, ["kind", "surrogate"]).where("real OR owner <> entity")
                      .select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))
        if lost.isEmpty():
            return current.drop("attempt")
        current = stored(current.join(lost, ["kind", "entity"], "left_anti").union(
            derived(lost, key).select(*current.columns)))


def mention(m: Column, of: Column, new: Column) -> Column:
    """``new`` in the format of the mention."""
    chars = F.regexp_extract_all(m, F.lit("(?s)."), 0)
    kept = F.length(_digits(m)) - F.length(new)

    def digit(c: Column, i: Column) -> Column:
        k = F.length(_digits(F.substring(m, F.lit(1), i + 1))) - kept
        return F.when(c.rlike(r"\d") & (k > 0), F.substring(new, k, F.lit(1))).otherwise(c)

    return (F.when(of.isin("phone", "card", "ssn"), F.array_join(F.transform(chars, digit), ""))
            .when(of == "secret", F.concat(F.regexp_replace(m, _SECRET, "$1"), new)).otherwise(new))


def again(gap: Column) -> Column:
    """Text between entities with the words of names in the map ``words`` exchanged."""
    found_ = F.transform(F.regexp_extract_all(gap, F.lit(BARE), 0), lambda w: F.coalesce(F.col("words")[w], w))
    return F.array_join(F.zip_with(F.split(gap, BARE, -1), found_, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def replace(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; ``count`` names a further column
    for the number of replacements (it takes the place of one of that name)."""
    name = [c for c in docs.columns if c.lower() == text.lower()][0]
    whole = docs.select(F.struct("*").alias("doc"), F.col(name).alias("t"))
    some = F.col("t").rlike(PATTERN)
    # Texts with the same entities in the same order share one row of replacements.
    signature = F.sha2(F.array_join("all", "\x1f"), 256)
    orders = stored(whole.where(some).select(found("t").alias("all")).groupBy(signature.alias("signature")).agg(F.first("all").alias("all")))
    matched = orders.select(F.explode("all").alias("m")).distinct().select("m", kind(F.col("m")).alias("kind")).where("kind IS NOT NULL")
    parts = stored(matched.select("m", "kind", F.posexplode(
        F.when(F.col("kind") == "name", F.split("m", " ")).otherwise(F.array("m"))).alias("i", "part"))
        .withColumn("kind", F.when(F.col("kind") == "name", name_part(F.col("part"))).otherwise(F.col("kind")))
        .withColumn("entity", norm(F.col("part"), F.col("kind"))))
    new = surrogates(parts.where("kind IS NOT NULL").select("kind", "entity").distinct(), key)
    named = (F.col("kind") == "surname") | F.col("kind").rlike("male$")
    table = parts.join(new, ["kind", "entity"], "left").select("m", "i", named.alias("named"), "part", F.coalesce(
        mention(F.col("part"), F.col("kind"), F.col("surrogate")), "part").alias("s"))
    table = table.groupBy("m").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), " ").alias("s"),
        F.collect_list(F.when(F.col("named"), F.struct("part", "s"))).alias("words"))
    replaced = (orders.select("signature", F.posexplode("all").alias("i", "m")).join(table, "m", "left")
                .groupBy("signature").agg(
                    F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("s", "m").alias("s")))), lambda x: x["s"]).alias("news"),
                    F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
                    F.count("s").alias("n")))
    gaps = F.when(F.size("words") > 0, F.transform(F.split("t", PATTERN, -1), again)).otherwise(F.split("t", PATTERN, -1))
    bare = F.when(F.size("words") > 0, F.size(F.filter(F.flatten(F.transform(
        F.split("t", PATTERN, -1), lambda g: F.regexp_extract_all(g, F.lit(BARE), 0))), lambda w: F.col("words")[w].isNotNull()))).otherwise(0)
    fused = F.array_join(F.zip_with(gaps, F.col("news"), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    changed = (whole.where(some).withColumn("all", found("t")).withColumn("signature", signature).drop("all").join(replaced, "signature")
               .select("doc", fused.alias("t"), (F.col("n") + bare).alias("n")))
    rows = whole.where(~F.coalesce(some, F.lit(False))).select("doc", "t", F.lit(0).cast("long").alias("n")).union(changed)
    out = rows.select(F.col("doc").withField(f"`{name}`", F.col("t")).alias("doc"), "n")
    if count is None:
        return out.select("doc.*")
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() != count.lower()], F.col("n").alias(count))
