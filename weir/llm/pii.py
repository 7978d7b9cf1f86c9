"""Surrogates for personal data, with SQL functions only.

Entities are found by one expression per type. Each gets a replacement drawn from
a keyed hash of its type and canonical form: digits for digits, letters of the same
case and script for letters, names of the same gender, valid octets, card numbers
that pass their check where the original did. Equal entities, however written, get equal
replacements anywhere in the corpus.

What is drawn is the part by which mentions belong together: of a name the family name, so that "Mr Smith" and "John Smith"
stay one family, and of a phone number its last ten digits, with or without the country before them. Given names move along their
list by a step that the family name and the key set, others letter by letter, so different given names of a family stay
different without a check. A check over all distinct drawn parts finds replacements
that two of them share, or that are themselves one of the corpus; those are
drawn again. Where a shape has few spellings, later draws are longer, so this ends.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm._scratch import Scratch

#: Draws after which a replacement gets longer by a character, where its type allows that; and draws at most.
WIDER, MOST = 8, 64
#: Redrawn entities that a plan may carry as a literal; beyond it they are joined.
LITERAL = 1000

_MALE = "James Robert John Michael David William Richard Thomas Charles Daniel Matthew Anthony Steven Andrew Paul Joshua Kevin Brian George Edward Hans Karl Jürgen Klaus Pierre Jean Luis Carlos José Javier Miguel Antonio".split()
_FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Ursula Monika Petra Sabine Marie Sophie Isabelle María Carmen Ana Lucía Elena".split()
_MALE_CYRILLIC = "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел".split()
_FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split()
#: Names that are recognized too, of the same groups; replacements are drawn from the lists above.
_MORE = {
    "m": "Aaron Adam Adrian Ahmed Alan Albert Alejandro Alessandro Alex Alexander Alexandre Alfred Ali Andrea Andreas Andrés Antoine Arthur Axel Benjamin Bernd Bernhard Björn Bradley Brandon Bruce Bruno Bryan Carl Christian Christoph Christopher Claude Craig David Dennis Diego Dieter Dirk Donald Douglas Dylan Edgar Eduardo Emil Enrique Eric Erik Ernst Ethan Eugene Fabian Felix Fernando Florian Francesco Francis Francisco François Frank Franz Fred Frederick Friedrich Gabriel Gary Gerald Gerhard Giovanni Giuseppe Gregory Guillaume Günter Gustav Harold Harry Hassan Heinrich Heinz Helmut Henri Henry Herbert Hermann Holger Hugo Ian Ibrahim Isaac Ivan Jack Jacob Jacques Jakob Jan Jason Jeffrey Jens Jeremy Jerry Jesús Jesse Joachim Joe Johann Johannes Jonas Jonathan Jorge Joseph Juan Julian Julien Justin Keith Kenneth Konrad Kurt Kyle Lars Laurent Lawrence Leo Leon Liam Logan Louis Luca Lucas Ludwig Luke Lukas Manfred Manuel Marc Marco Marcel Mario Mark Markus Martin Mathieu Matthias Max Maximilian Michel Miguel Mohamed Mohammed Moritz Nathan Nicholas Nicolas Niklas Noah Norbert Oliver Olivier Oscar Otto Pablo Patrick Pedro Peter Philip Philipp Philippe Rafael Rainer Ralf Ralph Raymond René Ricardo Roger Roland Ronald Rolf Roy Rudolf Russell Ryan Samuel Scott Sean Sebastian Sebastián Sergio Simon Stefan Stephan Stephen Sven Theo Thierry Tim Timothy Tobias Tom Tyler Ulrich Uwe Vicente Victor Vincent Walter Wayne Werner Wolfgang Xavier Yusuf Zachary Álvaro Óscar",
    "f": "Abigail Adriana Agnes Alexandra Alice Alicia Alina Amber Amélie Amy Andrea Angela Anita Anke Anna Anne Annette Antje Aurélie Ava Barbara Beatriz Beatrice Beate Bettina Betty Birgit Brenda Brigitte Camille Carla Carolina Caroline Carolyn Catherine Cécile Charlotte Chantal Cheryl Chloé Christina Christine Cindy Clara Claire Claudia Cornelia Cristina Cynthia Daniela Danielle Debra Deborah Denise Diana Diane Dolores Doris Dorothy Elisabeth Elisa Elke Ella Ellen Emma Erika Eva Evelyn Fatima Florence Françoise Franziska Frances Gabriele Gabriela Gertrud Gisela Gloria Grace Hannah Hanna Heather Heidi Heike Helen Helena Helga Hélène Ingrid Inés Ines Irene Isabel Isabella Jacqueline Jana Jane Janet Janice Jean Jessica Joan Johanna Joyce Juana Judith Judy Julia Julie Jutta Karin Katharina Katherine Kathleen Kathryn Katja Kelly Kerstin Kimberly Kristin Kirsten Laura Lauren Laure Lea Léa Lena Leonie Linda Louise Lucie Lucy Luisa Madison Manuela Margarita Maria Marion Marta Martha Martina Mathilde Megan Melanie Melissa Mercedes Mia Michèle Mónica Nadine Natalie Nathalie Nicole Nina Nora Olivia Paula Pamela Patrizia Paulina Pauline Pilar Rachel Raquel Rebecca Regina Renate Rita Rosa Rosario Ruth Sabrina Samantha Sara Sharon Silke Silvia Simone Sofía Sophia Sonja Stefanie Stella Stephanie Susana Susanne Sylvie Sylvia Tanja Teresa Theresa Tina Ute Valentina Valérie Vanessa Vera Verónica Véronique Victoria Zoe Élise Émilie",
    "mc": "Алексей Анатолий Антон Артём Артем Борис Вадим Валентин Валерий Василий Виктор Виталий Владислав Вячеслав Геннадий Георгий Григорий Даниил Денис Евгений Егор Игорь Илья Кирилл Константин Лев Леонид Максим Никита Олег Пётр Петр Роман Руслан Семён Станислав Степан Тимур Фёдор Федор Юрий Яков Ярослав",
    "fc": "Алина Алла Анастасия Валентина Валерия Вера Вероника Виктория Галина Дарья Евгения Елизавета Жанна Зоя Инна Кристина Ксения Лариса Лидия Людмила Маргарита Марина Надежда Нина Оксана Полина Раиса Софья София Тамара Яна",
}
_MORE = {k: v.split() for k, v in _MORE.items()}
#: Lists along which given names move, by gender and script; a name stands in one.
_POOLS = []
for _k, _pool in (("m", _MALE), ("f", _FEMALE), ("mc", _MALE_CYRILLIC), ("fc", _FEMALE_CYRILLIC)):
    _POOLS.append([x for x in dict.fromkeys(_pool + _MORE[_k]) if not any(x in p for p in _POOLS)])
_HE, _SHE = "Mr|Sir|Herr|Señor|Monsieur|господин", "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|госпожа"
_TITLES = rf"(?:(?:{_HE}|{_SHE}|Dr|Prof|Professor)\.? )+"


def _any_of(words: set[str]) -> str:
    """A pattern of ``words`` that shares their beginnings, so that a word of a text is tried against few."""
    if not words - {""}:
        return ""
    by = sorted({w[0] for w in words if w})
    tails = [re.escape(c) + _any_of({w[1:] for w in words if w[:1] == c}) for c in by]
    return "(?:" + "|".join(tails) + ")" + ("?" if "" in words else "")


_GIVEN = _any_of({*_MALE, *_FEMALE, *_MALE_CYRILLIC, *_FEMALE_CYRILLIC, *sum(_MORE.values(), [])})
#: A name's word: a capital and letters, with inner capitals, and apostrophes or hyphens before a capital (McDonald, O'Brien, Smith-Jones, Abd-el-Krim).
_PART = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{Lu}))(?:['’-](?:\p{Ll}{1,3}-)?\p{Lu}[\p{L}\p{M}]*+)*+"
_FAMILY = rf"(?:(?:van|von|vom|der|den|de|da|di|du|del|della|la|le|dos|das|zu|zur|ten|ter|bin|ibn|al|el) ){{0,3}}(?:[dl]['’])?{_PART}"
_FIRST = rf"{_GIVEN}(?:-{_PART})?"
#: Further given names and initials between a name's first word and its family name.
_MIDDLE = rf"(?:(?:{_FIRST}|\p{{Lu}}\.) ){{0,4}}"

#: In order: what matches earlier is taken. Lookbehinds keep a search from starting inside a word.
# Of a token or a quoted secret all of it is taken, however long; possessive quantifiers keep that linear.
_TOKEN = r"(?<![0-9A-Za-z_])(?:(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z_])|(?:AKIA|ghp_|sk-|xox[bp]-)[0-9A-Za-z_-]{12,}+)"
_QUOTED = r"(?<=(?:token|secret|password|passwd|api_key|apikey) {0,2}[=:] {0,2}[\"'])(?:[^\"'\r\n]{6,}+(?=[\"'])|[^\"'\s]{6,}+)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\dA-Za-z])\d{13,19}(?![\dA-Za-z])",
    "phone": r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d(?:[ ./()-]{0,3}\d){7,14}(?!\d)",
    "secret": f"{_TOKEN}|{_QUOTED}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES}{_MIDDLE}{_FAMILY}(?: {_FAMILY})?|{_FIRST} {_MIDDLE}{_FAMILY})",
}
_WORD = r"A-Za-z0-9\u00C0-\u024F\u0370-\u052F"
#: All types. An entity starts a word, and its first character leaves few types to try, which spares most of a text.
ALL = (
    rf"(?<![{_WORD}])(?:(?:{PATTERNS['email']})"
    rf"|(?=[\d+(])(?:{'|'.join(PATTERNS[k] for k in ('ip', 'ssn', 'card', 'phone'))})"
    rf"|(?=[0-9A-Fa-fgsx])(?:{_TOKEN})|(?<=[\"'])(?:{_QUOTED})"
    rf"|(?=[A-Z])(?:{PATTERNS['iban']})|(?=[A-Z\u0400-\u04FF])(?:{PATTERNS['name']}))"
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(entity: Column) -> Column:
    """The type of a whole entity."""
    out = None
    for name, p in PATTERNS.items():
        if name != "secret":  # what no other type matches
            test = entity.rlike("^(?:" + p + ")$")
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("secret"))


def canonical(kind: Column, entity: Column) -> Column:
    """One spelling for all ways to write an entity."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", F.lower(entity)).when(kind == "name", F.regexp_replace(entity, f"^{_TITLES}", "")).otherwise(entity)


def _nibble(h: Column, i: Column, n: int) -> Column:
    """A number below n from place i of a hex digest."""
    return F.conv(F.substring(h, (i * 3 % 120) + 1, F.lit(6)), 16, 10).cast("int") % n


def _letters(h: Column, text: Column) -> Column:
    """``text`` with letters and digits replaced by others of their case, script and kind."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda base, n: F.char(F.lit(base) + _nibble(h, i, n))
        wide = lambda letters: F.substring(F.lit(letters), _nibble(h, i, len(letters)) + 1, F.lit(1))
        return (
            F.when(c.between("0", "9"), pick(48, 10)).when(c.between("a", "z"), pick(97, 26)).when(c.between("A", "Z"), pick(65, 26))
            .when(c.between("а", "я"), wide("абвгдежзиклмнопрстуфхцчшщэюя")).when(c.between("А", "Я"), wide("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"))
            .when(c.rlike(r"^\p{Lu}$"), pick(65, 26)).when(c.rlike(r"^\p{Ll}$"), pick(97, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex(h: Column, text: Column, upper: Column) -> Column:
    out = F.array_join(F.transform(F.split(text, ""), lambda c, i: F.lower(F.conv(_nibble(h, i, 16).cast("string"), 10, 16))), "")
    return F.when(upper, F.upper(out)).otherwise(out)


def _luhn(digits: Column) -> Column:
    """The sum whose last digit a card number's check makes 0."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )


def drawn(kind: Column, canon: Column) -> tuple[Column, Column]:
    """The type and text of the part of an entity for which a replacement is drawn."""
    part = F.when(kind == "name", F.regexp_extract(canon, r"(\S+)$", 1)).when(kind == "phone", F.right(canon, F.lit(10))).otherwise(canon)
    return F.when(kind == "name", F.lit("family")).otherwise(kind), part


def surrogate(kind: Column, part: Column, key: str, draw: Column) -> Column:
    """The replacement of a drawn part at a draw."""
    more = F.floor(draw / WIDER).cast("int")
    wide = F.when(kind == "email", F.concat(F.repeat(F.lit("x"), more), part)).when(kind.isin("family", "secret"), F.concat(part, F.repeat(F.lit("a"), more))).otherwise(part)
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, part, draw.cast("string")), 512)
    return let(F.struct(h.alias("h"), kind.alias("kind"), wide.alias("canon")), lambda x: _surrogate(x["h"], x["kind"], x["canon"]))


def whole(kind: Column, canon: Column, new: Column, key: str) -> Column:
    """The canonical replacement of an entity, from that of its drawn part."""
    return F.when(kind == "phone", F.concat(F.substring(canon, F.lit(1), F.greatest(F.length(canon) - 10, F.lit(0))), new)).when(kind == "name", _named(canon, new, key)).otherwise(new)


def _named(canon: Column, new: Column, key: str) -> Column:
    """A name with the family name ``new``; its other words move by steps that key and family name set."""
    family, before = F.regexp_extract(canon, r"(\S+)$", 1), F.regexp_extract(canon, r"^(.*?)\S+$", 1)
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("given"), family), 512)

    def moved(h: Column) -> Column:
        def one(word: Column, place: Column) -> Column:
            out = None
            for pool in _POOLS:
                at = F.array_position(F.array(*[F.lit(x) for x in pool]), word).cast("int")
                step = 1 + F.conv(F.substring(h, 1, 6), 16, 10).cast("int") % (len(pool) - 1)
                pick = F.element_at(F.array(*[F.lit(x) for x in pool]), 1 + (at - 1 + step) % len(pool))
                is_one = word.isin(pool)
                out = F.when(is_one, pick) if out is None else out.when(is_one, pick)
            return out.otherwise(F.array_join(F.transform(F.split(word, ""), lambda c, i: _turned(h, c, i)), ""))

        return F.array_join(F.transform(F.split(before, "(?<= )|(?= )"), one), "")

    return F.concat(F.when(before != "", let(h, moved)).otherwise(F.lit("")), new)


def _turned(h: Column, c: Column, i: Column) -> Column:
    """A letter moved along its alphabet by a step of its place; letters of no listed alphabet become one of their case."""
    step = F.conv(F.substring(h, 7 + (i * 2) % 100, F.lit(2)), 16, 10).cast("int")
    out = F.when(c == "", c)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"):
        at = F.instr(F.lit(letters), c)
        pick = F.substring(F.lit(letters), 1 + (at - 1 + 1 + step % (len(letters) - 1)) % len(letters), F.lit(1))
        out = out.when(at > 0, pick)
    return out.when(c.rlike(r"^\p{Lu}$"), F.char(65 + step % 26)).when(c.rlike(r"^\p{Ll}$"), F.char(97 + step % 26)).otherwise(c)


def _surrogate(h: Column, kind: Column, canon: Column) -> Column:
    letters = _letters(h, canon)
    number = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.char(F.lit(48) + F.when(i == 0, 1 + _nibble(h, i, 9)).otherwise(_nibble(h, i, 10)))), "")
    stem = F.substring(number, F.lit(1), F.length(number) - 1)
    check = ((10 - _luhn(F.concat(stem, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(_luhn(canon) % 10 == 0, F.concat(stem, check)).otherwise(number)
    # a phone keeps its country and an exchange that may exist: the last ten digits change
    phone = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.char(F.lit(48) + F.when(i.isin(0, 3), 2 + _nibble(h, i, 8)).otherwise(_nibble(h, i, 10)))), "")
    ip = F.array_join(F.transform(F.split(canon, r"\."), lambda c, i: (1 + _nibble(h, i * 7, 254)).cast("string")), ".")
    # an address keeps its top domain and shape
    top = F.regexp_extract(canon, r"(\.[A-Za-z]+)$", 1)
    email = F.concat(_letters(h, F.substring(canon, F.lit(1), F.length(canon) - F.length(top))), top)
    secret = F.when(canon.rlike("^[0-9a-f]+$"), _hex(h, canon, F.lit(False))).when(canon.rlike("^[0-9A-F]+$"), _hex(h, canon, F.lit(True))).otherwise(
        F.concat(F.regexp_extract(canon, r"^(AKIA|ghp_|sk-|xox[bp]-|)", 1), _letters(h, F.regexp_replace(canon, r"^(?:AKIA|ghp_|sk-|xox[bp]-)", ""))))
    iban = F.concat(F.substring(canon, 1, 2), F.substring(letters, F.lit(3), F.length(letters)))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "ssn", number).when(kind == "iban", iban).when(kind == "family", letters).otherwise(secret)
    )


def dress(kind: Column, entity: Column, new: Column) -> Column:
    """A canonical replacement written as the entity was."""
    place = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
    spaced = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(entity, i + 1, F.lit(1)).between("A", "Z"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(entity, f"^({_TITLES})", 1)
    return F.when(kind.isin("phone", "card", "ssn"), spaced).when(kind == "email", cased).when(kind == "name", F.concat(title, new)).otherwise(new)


def entities(texts: DataFrame) -> DataFrame:
    """Distinct drawn parts (kind, canon) of the entities of all of ``texts`` (text)."""
    e = texts.select(F.explode(F.regexp_extract_all("text", F.lit(ALL), F.lit(0))).alias("e"))
    e = e.select(kind_of(F.col("e")).alias("kind"), "e")
    e = e.select("kind", canonical(F.col("kind"), F.col("e")).alias("canon"))
    kind, canon = drawn(F.col("kind"), F.col("canon"))
    return e.select(kind.alias("kind"), canon.alias("canon")).distinct()


def redraws(known: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canon, draw) for the entities whose first replacement won't do; draw counts from 1.

    Of entities that share a replacement the least keeps it; a replacement that is itself an
    entity of the corpus is given up by whoever drew it. Each turn only redraws what failed and
    checks it against all. What fails at draw ``MOST`` keeps it: then a type of one length has hardly a free spelling left.
    """
    now = scratch.write(known.select("kind", "canon", F.lit(0).alias("draw"), surrogate(F.col("kind"), F.col("canon"), key, F.lit(0)).alias("new")), "drawn")
    while True:
        shared = now.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min(F.struct("draw", "canon")).alias("first"))
        taken = known.select("kind", F.col("canon").alias("new"))
        bad = now.join(shared.filter("n > 1"), ["kind", "new"]).filter(F.struct("draw", "canon") != F.col("first")).select("kind", "canon", "draw")
        bad = bad.union(now.join(taken, ["kind", "new"], "left_semi").select("kind", "canon", "draw")).distinct()
        bad = scratch.write(bad.filter(F.col("draw") < MOST), "bad")
        if bad.isEmpty():
            return now.filter("draw > 0").select("kind", "canon", "draw")
        again = bad.select("kind", "canon", (F.col("draw") + 1).alias("draw"))
        again = again.withColumn("new", surrogate(F.col("kind"), F.col("canon"), key, F.col("draw")))
        now = scratch.write(now.join(bad, ["kind", "canon"], "left_anti").select("kind", "canon", "draw", "new").union(again), "drawn")


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``n_entities`` (long) added.

    A null text stays null with 0 entities, a text without entities stays as it is. Rows and other columns
    are kept; a column named ``n_entities`` is replaced. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    docs = docs.drop("n_entities")
    text = F.col(f"`{text_col}`")
    known = scratch.write(entities(docs.select(text.cast("string").alias("text"))), "entities")
    again = redraws(known, key, scratch)
    rows = [tuple(r) for r in again.limit(LITERAL + 1).collect()]
    matches = F.regexp_extract_all(text, F.lit(ALL), F.lit(0))
    split = docs.withColumns({"_weir_found": matches, })
    # only the few texts that have an entity are split
    split = split.withColumn("_weir_parts", F.when(F.size("_weir_found") > 0, F.split(text, ALL, -1)))
    if len(rows) <= LITERAL:
        table = F.create_map(*[F.lit(x) for k, c, d in rows for x in (f"{k}\x1f{c}", d)]) if rows else None

        def draw(kind: Column, canon: Column) -> Column:
            return F.coalesce(F.element_at(table, F.concat_ws("\x1f", kind, canon)), F.lit(0)) if table is not None else F.lit(0)

        def one(e: Column) -> Column:
            def with_kind(kind: Column) -> Column:
                def with_canon(canon: Column) -> Column:
                    def with_part(x: Column) -> Column:
                        return let(whole(kind, canon, surrogate(x["kind"], x["part"], key, draw(x["kind"], x["part"])), key), lambda s: dress(kind, e, s))

                    of, part = drawn(kind, canon)
                    return let(F.struct(of.alias("kind"), part.alias("part")), with_part)

                return let(canonical(kind, e), with_canon)

            return let(kind_of(e), with_kind)

        new = split.withColumn("_weir_new", F.transform("_weir_found", one))
    else:
        # rows get a written number, entities go their own way, and what they become comes back in order
        numbered = scratch.write(split.withColumn("_weir_row", F.monotonically_increasing_id()), "rows")
        e = numbered.select("_weir_row", F.posexplode("_weir_found").alias("at", "e")).withColumn("kind", kind_of(F.col("e")))
        e = e.withColumn("canon", canonical(F.col("kind"), F.col("e")))
        of, part = drawn(F.col("kind"), F.col("canon"))
        e = e.withColumns({"of": of, "part": part}).join(again.select(F.col("kind").alias("of"), F.col("canon").alias("part"), "draw"), ["of", "part"], "left")
        new = whole(F.col("kind"), F.col("canon"), surrogate(F.col("of"), F.col("part"), key, F.coalesce("draw", F.lit(0))), key)
        e = e.withColumn("new", dress(F.col("kind"), F.col("e"), new))
        back = e.groupBy("_weir_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("_weir_new"))
        new = numbered.join(back, "_weir_row", "left").withColumn("_weir_new", F.coalesce("_weir_new", F.array().cast("array<string>")))
    joined = F.array_join(F.transform("_weir_parts", lambda p, i: F.concat(p, F.coalesce(F.get("_weir_new", i), F.lit("")))), "")
    out = F.when(F.size("_weir_found") > 0, joined).otherwise(text)
    columns = [out.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return new.select(*columns, F.coalesce(F.size("_weir_found"), F.lit(0)).cast("long").alias("n_entities"))


def op10_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their entities replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, spark.conf.get("weir.pii.key", "weir-demonstration-key"))
