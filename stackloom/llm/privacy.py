"""Surrogates for personal data by DataFrame functions only (operator 6).

Entities are found with fixed patterns and replaced in place by keyed surrogates of the same type and
format: digits stay digits, letters keep their case and script, separators, prefixes and lengths stay;
card numbers keep their check digit rule, IP addresses their ranges, phone numbers their exchange and
e-mail addresses end in a reserved domain.  Names after a title get first names of the title's gender
and a surname, in the same script, word by word.

A surrogate is a function of the key, the type and the entity, so one entity has the same surrogate in
all documents, and a person's surname alone has the same one as with the first name.  Distinctness is
checked over the whole table, of names by first names and surnames: entities whose surrogates collide
with another's, or with an entity that occurs, are keyed anew until none collide; names and e-mail addresses
get longer thereby, small private IP ranges give way to a large one, and where a fixed format has too
few surrogates an error says so.  Texts are searched twice: once to list the entities with a hash of
their text, which also tells which texts hold entities keyed anew, and once to replace them.  The turns
of such texts come by a join, a broadcast only where Spark knows the written table to be small; otherwise texts are shuffled by their
hash, frequent ones and those without entities dealt over all tasks.

Names are found behind a title only: a name alone is not told from other words and stays.

Null texts stay null, empty ones empty; documents without entities stay as they are; repeated rows
are treated alike; other columns pass through (an existing ``n_entities`` is replaced), working
columns take names that are free; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop
from stackloom.llm._jobs import hot_keys, spread_join, unused

#: Rounds of keying anew without fewer collisions, after which a space of surrogates counts as exhausted.
STALLED = 40
#: Turns after which an address leaves a small private range for a large one.
CROWDED = 3

# Titles by gender, and the types' patterns, all told by what they start with.
TITLES = {
    "man": r"Mr|Mister|Herrn?|Monsieur|Sr|Señor|Don|господин|г-н|Κύριος|Κύριο",
    "woman": r"Mrs|Ms|Miss|Frau|Mme|Madame|Mademoiselle|Sra|Señora|Doña|госпожа|г-жа|Κυρία|Κα",
}
#: Each pattern first looks at the next character alone, as most places of a text fail there.
_TITLE = rf"(?=[{''.join(sorted({t[0] for x in TITLES.values() for t in x.split('|')}))}])(?<!\p{{L}})(?:{TITLES['man']}|{TITLES['woman']})\.? (?=\p{{Lu}}\p{{L}})"
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+\-])(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?=[tpsa])\b(?:token|password|secret|api_key) ?= ?\"?[A-Za-z0-9]{12,}",
    "access": r"(?=A)\bAKIA[A-Z0-9]{16}\b",
    "ip": r"(?=\d)\b\d{1,3}(?:\.\d{1,3}){3}\b(?!\.\d)",
    "ssn": r"(?=\d)\b\d{3}-\d{2}-\d{4}\b",
    "card": r"(?=\d)\b\d{4}(?:[ \-]?\d{4}){3}\b",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}\b|\(\d{3}\) ?\d{3}[.\-]\d{4}\b|(?=\d)\b\d{3}-\d{3}-\d{4}\b",
    "iban": r"(?=[A-Z])\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": _TITLE + r"\p{Lu}[\p{L}'’\-]+(?: \p{Lu}(?:[\p{L}'’\-]+|\.(?= \p{Lu})))*",
}
# First names by gender and script, and syllables of surnames by script.
FIRST = {
    ("man", "latin"): "Adam Alan Bruno Carl Daniel Emil Felix Hugo Ivan Jonas Leo Lucas Martin Noel Oscar Paul Simon Thomas Victor Walter".split(),
    ("woman", "latin"): "Ada Alice Bella Clara Diana Emma Flora Helen Iris Julia Laura Lena Maria Nora Olga Paula Rosa Sofia Vera Wanda".split(),
    ("man", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("woman", "cyrillic"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Юлия".split(),
    ("man", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Κώστας Λεωνίδας Μανώλης Νίκος Πέτρος Σπύρος".split(),
    ("woman", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Χριστίνα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe go ha ka ke la le lo ma me mi na ne no pa pe ra re ri ro sa se ta te to".split(),
    "cyrillic": "ба бе бо ва ве да де до за зе ка ке ко ла ле ло ма ме ми на не но па пе ра ре ри ро са се та то".split(),
    "greek": "βα βε βο γα γε δα δε δο ζα ζε κα κε κο λα λε λο μα με μι να νε νο πα πε ρα ρε ρι ρο σα σε τα το".split(),
}
FIRST_ENDS = {("man", "latin"): "n", ("woman", "latin"): "na", ("man", "cyrillic"): "н", ("woman", "cyrillic"): "на", ("man", "greek"): "νης", ("woman", "greek"): "να"}
ENDS = {("man", "latin"): "son", ("woman", "latin"): "son", ("man", "cyrillic"): "ов", ("woman", "cyrillic"): "ова", ("man", "greek"): "ίδης", ("woman", "greek"): "ίδου"}

#: Kinds of the words of names: surnames, and the names before them.
NAMES = ("man", "woman", "man first", "woman first")
_ANY = "|".join(PATTERNS.values())
#: Every entity has one of these; most texts have none.
_SIGN = rf"[@0-9]|AKIA|(?:token|password|secret|api_key) ?=|{_TITLE}"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _kind(entity: Column) -> Column:
    starts = lambda p: entity.rlike(f"^(?:{p})")
    out = F.when(entity.contains("@"), "email").when(starts("token|password|secret|api_key"), "secret").when(starts(r"AKIA[A-Z0-9]{16}$"), "access")
    out = out.when(starts(r"\d{1,3}\."), "ip").when(starts(r"\d{3}-\d{2}-"), "ssn").when(starts(r"\d{4}"), "card").when(starts(r"[+(\d]"), "phone")
    return out.when(starts(r"[A-Z]{2}\d{2}"), "iban").when(starts(rf"(?:{TITLES['woman']})\.? "), "woman").otherwise("man")


def _lead(entity: Column, kind: Column) -> Column:
    """What stands before the entity proper and stays: a title, or the name of a secret."""
    secret = F.regexp_extract(entity, r"^([a-z_]+ ?= ?\"?)", 1)
    return F.when(kind == "secret", secret).when(kind.isin("man", "woman"), F.regexp_extract(entity, r"^([^ ]+ )", 1)).otherwise("")


def _hash(key: str, kind: Column, entity: Column, turn: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, turn.cast("string"), entity).cast("binary"), 256)


def _number(digest: Column, at: int, size: int = 7) -> Column:
    """A number out of ``size`` hex digits of a digest."""
    return F.conv(F.substring(digest, at, size), 16, 10).cast("long")


def _reformed(body: Column, digest: Column) -> Column:
    """Each digit becomes a digit, each ASCII letter one of its case, hex stays hex; other characters stay."""
    stream = F.concat(digest, F.sha2(F.concat(digest, F.lit("1")).cast("binary"), 256), F.sha2(F.concat(digest, F.lit("2")).cast("binary"), 256))
    hexes = body.rlike("^(?=.*[a-f])[0-9a-f]{12,}$")

    def one(i: Column, s: Column) -> Column:
        n = F.conv(F.substr(s.stream, F.pmod(i * 4, F.lit(188)) + 1, F.lit(4)), 16, 10).cast("int")
        pick = lambda letters: F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
        c = F.substr(s.body, i, F.lit(1))
        out = F.when(s.hexes, pick("0123456789abcdef")).when(c.between("0", "9"), pick("0123456789"))
        return out.when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    def whole(s: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s.body), F.lit(1))), lambda i: one(i, s)), "")

    return _let(F.struct(body.alias("body"), stream.alias("stream"), hexes.alias("hexes")), whole)


def _luhn(card: Column) -> Column:
    """The card number with its last digit set by the check digit rule."""
    digits = F.regexp_replace(card, r"[ \-]", "")
    value = lambda i: F.coalesce(F.substr(digits, i + 1, F.lit(1)).try_cast("int"), F.lit(0))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(14)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i)))
    return F.concat(F.substr(card, F.lit(1), F.length(card) - 1), F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _of(items: list[str], n: Column) -> Column:
    # One literal that Spark folds into an array; a literal an item would make the plan, and the calls that build it, many times larger.
    return F.element_at(F.split(F.lit(" ".join(items)), " "), (F.pmod(n, F.lit(len(items))) + 1).cast("int"))


def _syllables(letters: str, numbers: list[Column], turn: Column, least: int) -> Column:
    """A capitalised word of ``least`` syllables, and of one more for each turn, as far as the numbers reach."""
    parts = [_of(SYLLABLES[letters], n) for n in numbers]
    return F.initcap(F.concat(*parts[:least], *(F.when(turn > k, part).otherwise("") for k, part in enumerate(parts[least:]))))


def _name(key: str, kind: Column, name: Column, turn: Column) -> Column:
    """One word of a name, by gender and script: a surname of syllables, or a first name.

    First names are of the fixed lists, and from the second turn on syllables with an end that tells the
    gender, so that there is room for any number of them.
    """
    script = _script(name)
    whole = F.lit(None).cast("string")
    seed = F.struct(_hash(key, F.lit("surname"), name, turn).alias("last"), _hash(key, F.lit("first"), name, turn).alias("first"))

    def made(s: Column) -> Column:
        out = whole
        numbers = {c: [_number(s[c], 1 + 7 * k) for k in range(9)] for c in ("last", "first")}
        last = {x: _syllables(x, numbers["last"], turn, 4) for x in SYLLABLES}
        later = {x: _syllables(x, numbers["first"], turn - 1, 3) for x in SYLLABLES}
        for (gender, letters), end in ENDS.items():
            surname = F.concat(last[letters], F.lit(end))
            first = F.when(turn == 0, _of(FIRST[gender, letters], numbers["first"][0])).otherwise(F.concat(later[letters], F.lit(FIRST_ENDS[gender, letters])))
            out = F.when((kind == gender) & (script == letters), surname).when((kind == f"{gender} first") & (script == letters), first).otherwise(out)
        return out

    return _let(seed, made)


def units(kind: Column, entity: Column) -> Column:
    """What must stay distinct, as (kind, unit): each word of a name, the surname last, or the whole of another entity.

    Where first names and surnames are distinct each, so are full names.
    """
    words = F.split(entity, " ")
    named = F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, kind).otherwise(F.concat(kind, F.lit(" first"))).alias("kind"), w.alias("unit")))
    return F.when(kind.isin("man", "woman"), named).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("unit"))))


#: First parts of addresses of which some are not public: private, shared, loopback, link-local, for tests.
_MIXED = (10, 100, 127, 169, 172, 192, 198, 203)


def _ip(entity: Column, digest: Column, turn: Column) -> Column:
    """An address whose private and local ranges stay, and that stays public otherwise; where a small range is crowded, later turns take the largest private one."""
    part = lambda k: (F.pmod(_number(digest, 1 + 7 * k), F.lit(254)) + 1).cast("string")
    public = F.pmod(_number(digest, 1), F.lit(223 - len(_MIXED))) + 1
    for n in _MIXED:
        public = public + F.when(public >= n, 1).otherwise(0)
    own = F.regexp_extract(entity, r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    range_ = F.when((F.length(own) > 4) & (turn > CROWDED), "10.").otherwise(own)
    out = F.when(range_ == "", F.concat_ws(".", public.cast("string"), part(1), part(2), part(3)))
    return out.when(F.length(range_) <= 4, F.concat(range_, F.concat_ws(".", part(1), part(2), part(3)))).otherwise(F.concat(range_, F.concat_ws(".", part(2), part(3))))


def _longer(address: Column, digest: Column, turn: Column) -> Column:
    """An e-mail address with a letter more before the @ for each turn, as far as the digest reaches."""
    letters = F.translate(F.substring(digest, 17, 40), "0123456789", "ghijklmnop")
    at = F.instr(address, "@")
    return F.when(turn > 0, F.concat(F.left(address, at - 1), F.left(letters, turn), F.substr(address, at))).otherwise(address)


def surrogate(key: str, kind: Column, entity: Column, turn: Column) -> Column:
    """The replacement of a unit; ``turn`` counts how often it was keyed anew."""
    head = F.when(kind == "card", F.left(entity, F.lit(1))).when(kind == "access", "AKIA").when(kind == "iban", F.left(entity, F.lit(2)))
    head = head.when(kind == "phone", F.regexp_extract(entity, r"^(\+\d{1,3}(?=[ .\-(]))", 1)).otherwise("")

    def made(s: Column) -> Column:
        body = F.substr(s.entity, F.length(s.head) + 1, F.length(s.entity) - F.length(s.head) - F.when(s.kind == "email", F.length(F.substring_index(s.entity, "@", -1)) - F.length(F.substring_index(F.substring_index(s.entity, "@", -1), ".", 1))).otherwise(0))
        new = F.concat(s.head, _reformed(body, s.digest))
        plain = F.when(s.kind == "email", F.concat(_longer(new, s.digest, s.turn), F.lit(".example.org"))).when((s.kind == "phone") & s.entity.contains(") 555-"), F.regexp_replace(new, r"\) \d{3}-", ") 555-"))
        plain = plain.when((s.kind == "card") & s.valid, _luhn(new)).otherwise(new)
        return F.when(s.kind == "ip", _ip(s.entity, s.digest, s.turn)).when(s.kind.isin(*NAMES), _name(key, s.kind, s.entity, s.turn)).otherwise(plain)

    valid = (kind == "card") & (_luhn(entity) == entity)
    return _let(F.struct(kind.alias("kind"), entity.alias("entity"), turn.alias("turn"), head.alias("head"), valid.alias("valid"), _hash(key, kind, entity, turn).alias("digest")), made)


def found(df: DataFrame, text: str, parts: str, entities: str) -> DataFrame:
    """``df`` with ``parts`` (text between the entities) and ``entities`` (lead, units), null where there are none."""
    raw = unused("_raw", df.columns, [parts, entities])
    df = df.withColumn(raw, F.when(F.col(text).rlike(_SIGN), F.regexp_extract_all(F.col(text), F.lit(_ANY), F.lit(0))))
    some = F.size(raw) > 0

    def told(e: Column) -> Column:
        return _let(F.struct(e.alias("whole"), _kind(e).alias("kind")), lambda s: F.struct(_lead(s.whole, s.kind).alias("lead"), s.whole.alias("whole"), s.kind.alias("kind")))

    proper = F.transform(F.transform(raw, told), lambda s: F.struct(s.lead.alias("lead"), units(s.kind, F.substr(s.whole, F.length(s.lead) + 1)).alias("units")))
    return df.withColumn(parts, F.when(some, F.split(F.col(text), _ANY, -1))).withColumn(entities, F.when(some, proper)).drop(raw)


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, unit, turn) of the distinct ``entities(kind, unit)`` that have to be keyed anew, in a written table.

    A surrogate collides with that of a smaller unit of its kind, or with any unit that occurs.  What collides is keyed anew, against
    all that have found a surrogate, and nothing else is looked at again.
    """
    kind = F.when(F.col("kind").isin("man", "woman"), "man").otherwise(F.col("kind"))
    known = cut(entities.select("kind", "unit").distinct())
    real = known.select(F.col("unit").alias("new"), kind.alias("class")).distinct()
    settled: list[DataFrame] = []
    written: list[DataFrame] = []
    again, turn, fewest, stalled = known, 0, None, 0
    while True:
        # The surrogates' expression is large; behind the written table the plans below stay small.
        now = cut(again.withColumn("turn", F.lit(turn)).withColumn("new", surrogate(key, F.col("kind"), F.col("unit"), F.col("turn"))).withColumn("class", kind))
        clash = now.groupBy("class", "new").agg(F.min("unit").alias("low"))
        marked = now.join(clash, ["class", "new"]).join(real.withColumn("real", F.lit(True)), ["class", "new"], "left")
        if settled:
            others = reduce(DataFrame.union, settled).groupBy("class", "new").agg(F.min("unit").alias("other"))
            marked = marked.join(others, ["class", "new"], "left")
        bad = (F.col("unit") > F.col("low")) | F.col("real").isNotNull()
        if settled:
            bad = bad | (F.col("unit") != F.col("other"))
        marked = cut(marked.select("kind", "unit", "turn", "new", "class", F.coalesce(bad, F.lit(False)).alias("bad")))
        drop(now)
        written.append(marked)
        settled.append(marked.filter("not bad").drop("bad"))
        again = marked.filter("bad").select("kind", "unit")
        n = again.count()
        if not n:
            break
        stalled = 0 if fewest is None or n < fewest else stalled + 1
        fewest = n if fewest is None else min(n, fewest)
        if stalled >= STALLED:
            kinds = sorted(r.kind for r in again.select("kind").distinct().collect())
            raise ValueError(f"too few surrogates of the kinds {', '.join(kinds)}: {n} entities have none of their own")
        turn += 1
    out = cut(reduce(DataFrame.union, settled).filter("turn > 0").select("kind", "unit", "turn"))
    drop(known, *written)
    return out


def replace(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Replaces the entities of ``text`` and adds ``n_entities``."""
    columns = [c for c in df.columns if c != "n_entities"]
    df = df.select(*columns)
    parts, entities, row, turns = (unused(name, columns) for name in ("_parts", "_entities", "_row", "_turns"))
    each = F.explode(F.flatten(F.transform("entities", lambda e: e.units))).alias("e")
    listed = found(df.select(F.col(text).alias("text")), "text", "parts", "entities").filter("entities is not null")
    listed = listed.select(F.xxhash64("text").alias("row"), each).groupBy("row", "e.kind", "e.unit").agg(F.count("*").alias("times"))
    listed = cut(listed.select("row", "kind", "unit", "times"))
    exceptions = collisions(listed, key)
    anew = listed.join(exceptions, ["kind", "unit"])
    code = lambda kind, unit: F.concat_ws("\x1f", kind, unit)
    held = cut(anew.groupBy(F.col("row").alias(row)).agg(F.map_from_entries(F.collect_list(F.struct(code("kind", "unit"), "turn"))).alias(turns)))
    hot = hot_keys(listed.groupBy("row").agg(F.max("times").alias("times")), "row")
    drop(listed, exceptions)
    # A hash stands for a text; where two texts share one, each finds its own entities among the turns of both.  Texts without
    # an entity meet nothing, and are dealt by their place.
    own = F.when(F.col(text).rlike(_SIGN), F.xxhash64(text)).otherwise(F.xxhash64(F.lit(row), F.monotonically_increasing_id()))
    marked = found(spread_join(df.withColumn(row, own), held, [row], hot, "left"), text, parts, entities)
    turn = lambda u: F.coalesce(F.element_at(turns, code(u["kind"], u["unit"])), F.lit(0))
    made = lambda e: F.array_join(F.transform(e.units, lambda u: surrogate(key, u["kind"], u["unit"], turn(u))), " ")
    news = F.transform(entities, lambda e: F.concat(e.lead, made(e)))
    pieces = F.zip_with(parts, news, lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    out = F.when(F.col(entities).isNotNull(), F.array_join(pieces, "")).otherwise(F.col(text))
    picked = [out.alias(c) if c == text else F.col(c) for c in columns]
    return marked.select(*picked, F.coalesce(F.size(entities), F.lit(0)).cast("int").alias("n_entities"))
