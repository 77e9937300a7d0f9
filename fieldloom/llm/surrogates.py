"""Surrogates for personal data, in SQL expressions only.

Entities are found by one regular expression, and every distinct entity of the
whole table gets a keyed replacement of its own kind: a card number keeps its
length and its checksum where it had a right one, an address stays private or
public, a secret keeps what tells its issuer, a name keeps gender and script,
and a mention keeps its punctuation, spacing and letter case.  The replacement hangs on the key and the entity alone,
so an entity reads the same wherever it is mentioned, in whatever format.

Candidates are then checked against one another and against all entities of
their kind: of equal ones, all but the first, and those that equal a real
entity, are drawn again, until none are left; names grow by a syllable where
draws fail, and formats with too few values are dealt out exactly.  So two
entities never share a surrogate.  Texts are moved only where they mention something.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm.common import cut, table

KEY = "change-me"  # a deployment passes its own secret
#: Draws for one entity before its format counts as too narrow to draw from; its values are then dealt out exactly.
ATTEMPTS = 64
#: Draws after which a name gets a further syllable, and after which the kinds of ENUMERATED are dealt out exactly.
LENGTHEN, CLOSED = 4, 8
#: Kinds whose free values of a format can be listed, and how many values a row of the listing stands for.
ENUMERATED, CHUNK = ("ip", "phone", "ssn"), 65536

#: Titles and given names by gender and script (fixed lists).
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|madame|Mme|Señora|señora|Signora|signora|Госпожа|госпожа"
TITLES_M = "Mr|Herr|Monsieur|monsieur|Señor|señor|Signor|signor|Господин|господин"
TITLES_N = "Dr|Prof"
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Camille Carmen Charlotte Claire Claudia Elena Elizabeth Emily Emma Greta Hannah Helga Ingrid Isabel Jane Julia Karen Laura Lucia Margaret Maria Mary Monika Nicole Olivia Patricia Rosa Sarah Sofia Sophie Susan Ursula".split(),
    ("m", "latin"): "Alexander Andreas Antonio Benjamin Carlos Charles Daniel David Diego Edward Eric Felix Fernando Francisco Frank George Hans Henri Jacques James Javier John Jonathan Joseph Juan Klaus Lucas Louis Luis Manuel Mark Matthew Michael Miguel Paul Pedro Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    ("f", "cyrillic"): "Анна Вера Галина Екатерина Елена Ирина Людмила Марина Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Владимир Виктор Григорий Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
}
SYLLABLES = {
    "latin": "ba bel bor cal dan der dor fen gar hal hol kel kir lan lor mar mel mor nan nor pel ran rin ros sal sel sor tan tel tor val ver vin wal wen zel".split(),
    "cyrillic": "ба бел бор вал вен гор дан дор зел кам кир лав лен лор мал мел мор нов рав рин рос сал сел сор тал тор".split(),
}

_NAME = r"\p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}"
_SEP = r"[ .\-!*#$%&|]{0,6}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: What a secret's surrogate keeps: the letters that its issuer puts first.
_ISSUER = "AKIA|(?:sk|ghp|xoxb|xoxp)[-_]"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?!\.)[\p{L}\p{N}.-]*(?<=[\p{L}\p{N}-])\.\p{L}{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|(?:sk|ghp|xoxb|xoxp)[-_][A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ipv6": rf"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|[0-9A-Fa-f]{{3,4}}(?::{_GROUP}){{0,5}}::{_GROUP}(?::{_GROUP}){{0,5}})(?![\w:])",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w)",
    "phone": rf"(?<![\w+])(?:\+(?=(?:[ .\-!*#$%&|()]{{0,8}}\d){{8}})\d{{1,3}}{_SEP}\(?\d{{1,4}}\)?(?:{_SEP}\d{{2,4}}){{1,4}}|\(\d{{3}}\){_SEP}\d{{3}}-\d{{4}}|(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}})(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "person": rf"(?=[A-ZА-ЯЁmsг])(?<!\p{{L}})(?:(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? {_NAME}|(?:{'|'.join(n for names in GIVEN.values() for n in names)}) \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?)(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every kind but these needs one of HINT's characters, so texts without them are searched for these alone.
HINT, UNHINTED = "[0-9@]", ("secret", "person")


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values) -> str:
    return "array(" + ", ".join(map(_text, values)) + ")"


def _kind_of(mention: str) -> str:
    """SQL that names a mention's kind: the first pattern that matches the whole of it; null where what follows it in its text made it one."""
    return "case " + " ".join(f"when {mention} rlike {_text(f'^(?:{_alone(p)})$')} then '{k}'" for k, p in PATTERNS.items()) + " end"


def _alone(pattern: str) -> str:
    """The pattern without the looks to either side, for a string that is the mention alone."""
    return re.sub(r"\(\?<?!(?:\[[^\]]*\]|\\.|[^()\[\]])*\)", "", pattern)


def _byte(i: str) -> str:
    """SQL: the i-th (from 0) pseudo-random byte drawn for an entity; column ``draw`` holds 64 of them in hex."""
    return f"cast(conv(substr(draw, 1 + 2 * (({i}) % 64), 2), 16, 10) as int)"


def _digits(n: str) -> str:
    return f"array_join(transform(sequence(0, {n} - 1), i -> cast({_byte('i')} % 10 as string)), '')"


def _luhn(digits: str) -> str:
    """SQL: the sum of a number's digits, every second from the right doubled; a multiple of 10 where its checksum is right."""
    return (
        f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> cast(c as int) * if(i % 2 = 1, 2, 1)), 0, (s, d) -> s + if(d > 9, d - 9, d))"
    )


def _syllables(script: str, n: int) -> str:
    """SQL: ``n`` syllables, and one more for every LENGTHEN draws that were in vain."""
    names = SYLLABLES[script]
    return f"array_join(transform(sequence(0, {n - 1} + attempt div {LENGTHEN}), i -> element_at({_array(names)}, 1 + {_byte('i')} % {len(names)})), '')"


def _classes(value: str) -> str:
    """SQL: ``value`` with each letter and digit drawn anew within its class: digits, A-Z, other letters."""
    b = _byte("i")
    return (
        f"array_join(transform(split({value}, ''), (c, i) -> case when c rlike '[0-9]' then cast({b} % 10 as string)"
        f" when c rlike '[A-Z]' then chr(65 + {b} % 26) when c rlike '\\\\p{{L}}' then chr(97 + {b} % 26) else c end), '')"
    )


def _hexes(value: str) -> str:
    """SQL: ``value`` with each of 0-9 and a-f drawn anew."""
    return f"array_join(transform(split({value}, ''), (c, i) -> if(c rlike '[0-9a-f]', lower(hex({_byte('i')} % 16)), c)), '')"


#: SQL: the start of a private address; of a secret and of a phone number, what stays of it.
_PRIVATE = "regexp_extract(entity, '^(10\\\\.|127\\\\.|192\\\\.168\\\\.|172\\\\.(?:1[6-9]|2[0-9]|3[01])\\\\.|169\\\\.254\\\\.)', 1)"
_KEPT = f"regexp_extract(entity, '^({_ISSUER})', 1)"
_HEX = "entity rlike '^[0-9a-f]+$'"
_PREFIX = "if(entity like '+%', if(entity like '+1%', '+1', substr(entity, 1, least(3, length(entity) - 4))), '')"


def _ring(key: str, which: str, names: list[str]) -> list[str]:
    """The names of a list in a keyed order, in which each one's surrogate is the next: a permutation of one cycle, so that a known pair tells no other one."""
    return sorted((x.lower() for x in names), key=lambda x: hashlib.sha256(f"{key}|{which}|{x}".encode()).digest())


def _candidate(key: str) -> F.Column:
    """The surrogate of (kind, entity) in the column ``draw``'s bytes, in canonical form."""
    rest = f"substr(entity, length({_KEPT}) + 1)"
    secret = f"if({_HEX}, {_hexes('entity')}, concat({_KEPT}, {_classes(rest)}))"
    ipv6 = f"concat(substring_index(entity, ':', 1), {_hexes("substr(entity, locate(':', entity))")})"
    host = "concat('h', substr(draw, 100, 10), '.example.net')"
    body = f"concat(substr(entity, 1, 1), {_digits('(length(entity) - 2)')})"
    check = "cast(pmod(-" + _luhn("concat(body, '0')") + ", 10) as string)"
    card = f"element_at(transform(array({body}), body -> concat(body, if({_luhn('entity')} % 10 = 0, {check}, cast({_byte('60')} % 10 as string)))), 1)"
    private = _PRIVATE
    octets = "concat_ws('.', " + ", ".join(f"cast({x} as string)" for x in (f"11 + {_byte('0')} % 89", _byte("1"), _byte("2"), f"1 + {_byte('3')} % 254")) + ")"
    ip = f"if({private} <> '', concat({private}, substring_index({octets}, '.', -(4 - (length({private}) - length(replace({private}, '.', '')))))), {octets})"
    prefix = _PREFIX
    phone = f"concat({prefix}, {_digits(f'(length(entity) - length({prefix}))')})"
    rest = "substr(entity, 5)"
    iban_body = f"array_join(transform(sequence(1, length({rest})), i -> case when substr({rest}, i, 1) rlike '[0-9]' then cast({_byte('i')} % 10 as string) else chr(65 + {_byte('i')} % 26) end), '')"
    number = "aggregate(split(concat(body, substr(entity, 1, 2), '00'), ''), 0L, (s, c) -> if(c rlike '[0-9]', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"
    iban = f"element_at(transform(array({iban_body}), body -> concat(substr(entity, 1, 2), lpad(cast(98 - {number} as string), 2, '0'), body)), 1)"
    name = "case " + " ".join(
        [
            f"when kind = 'given-{g}' and array_contains({_array(ring)}, entity) then element_at({_array(ring[1:] + ring[:1])}, cast(array_position({_array(ring)}, entity) as int))"
            for (g, s), names in GIVEN.items()
            for ring in (_ring(key, g + s, names),)
        ]
        + [f"when entity rlike '[а-яё]' then concat({_syllables('cyrillic', 3)}, if(kind = 'surname-f', 'ова', if(kind = 'surname-m', 'ов', '')))", f"else {_syllables('latin', 3)} end"]
    )
    kinds = {"email": f"concat({_classes('substring_index(entity, chr(64), 1)')}, '@', {host})", "iban": iban, "secret": secret, "ip": ip, "ipv6": ipv6, "card": card, "phone": phone, "ssn": _digits("9")}
    return F.expr("case kind " + " ".join(f"when '{k}' then {x}" for k, x in kinds.items()) + f" else {name} end")


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.col("entity"), F.col("attempt").cast("string"))
    return entities.withColumn("draw", F.concat(F.sha2(seed.cast("binary"), 256), F.sha2(F.concat(seed, F.lit("+")).cast("binary"), 256))).withColumn("surrogate", _candidate(key)).drop("draw")


def _shape() -> list[F.Column]:
    """(fixed, width) of an entity's format: what its surrogates keep, and how many octets or digits are drawn (0: not listed)."""
    like = "regexp_replace(regexp_replace(regexp_replace(entity, '[0-9]', '0'), '[A-Z]', 'A'), '[^\\\\P{L}A]', 'a')"
    ipv6 = "concat(substring_index(entity, ':', 1), regexp_replace(substr(entity, locate(':', entity)), '[0-9a-f]', '0'))"
    card = f"concat(substr(entity, 1, 1), length(entity), ' ', {_luhn('entity')} % 10 = 0)"
    fixed = f"case kind when 'ip' then {_PRIVATE} when 'phone' then {_PREFIX} when 'ssn' then '' when 'card' then if(entity rlike '^[0-9]+$', {card}, {like}) when 'iban' then concat(substr(entity, 1, 2), {like}) when 'ipv6' then {ipv6}"
    fixed += f" when 'secret' then if({_HEX}, concat('hex ', length(entity)), concat({_KEPT}, {like})) else {like} end"
    width = f"case kind when 'ip' then 4 - (length({_PRIVATE}) - length(replace({_PRIVATE}, '.', ''))) when 'phone' then length(entity) - length({_PREFIX}) when 'ssn' then 9 else 0 end"
    return [F.expr(fixed).alias("fixed"), F.expr(width).cast("int").alias("width")]


def _ranked(rows: DataFrame, by: list[str], column: str, key: str, name: str) -> DataFrame:
    """``rows`` with a number from 0 within ``by``, in an order keyed by SHA-256.

    Rows lie in up to 65536 ranges of the hash; numbers within a range go on from
    the sum of the ranges before it, so that no task sorts a whole format.
    """
    hashed = cut(rows.withColumn("__hash", F.sha2(F.concat_ws("|", F.lit(key), "kind", column).cast("binary"), 256)).withColumn("__range", F.substring("__hash", 1, 4)), "hashed")
    sizes = hashed.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("__n")
    starts = cut(sizes.withColumn("__before", before).drop("__n"), "starts")
    within = F.row_number().over(W.partitionBy(*by, "__range").orderBy("__hash", column)) - 1
    return hashed.join(starts, [*by, "__range"]).withColumn(name, F.col("__before") + within).drop("__hash", "__range", "__before")


def _dealt(entities: DataFrame, formats: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of all entities of some formats, dealt out in keyed order.

    Each gets a value of its format that is no entity and that ``done`` gives to
    no other format's entity; where those do not
    suffice (or are not listed), the rest get one another's values, in a circle.
    Drawing in vain so often means that the entities are a good part of the
    format's values, so that listing these costs no more than the entities do.
    Values are listed in chunks, a row each, and numbered as :func:`_ranked` does.
    """
    by = ["kind", "fixed", "width"]
    members = cut(entities.select("kind", "entity", *_shape()).join(formats, by), "narrow")
    sizes = members.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("values", F.expr(
        "case when kind = 'ip' then element_at(array(0L, 256L * 254, 65536L * 254, 89L * 65536 * 254), width) when width > 0 then cast(pow(10, width) as bigint) else 0L end"
    ))
    sizes = cut(sizes, "narrow_sizes")
    octets = "concat_ws('.', 11 + id div (254 * 65536L), id div (254 * 256) % 256, id div 254 % 256, 1 + id % 254)"
    value = f"concat(fixed, if(kind = 'ip', substring_index({octets}, '.', -width), lpad(cast(id as string), width, '0')))"
    chunks = sizes.where("values > 0").select(*by, "values", F.expr(f"explode(sequence(0L, values - 1, {CHUNK}L))").alias("begin")).repartition(*by, "begin")
    free = chunks.select(*by, F.expr(f"explode(sequence(begin, least(begin + {CHUNK}, values) - 1))").alias("id")).select(*by, F.expr(value).alias("entity"))
    free = free.where((F.col("fixed") == _shape()[0]) & (F.col("width") == _shape()[1])).withColumnRenamed("entity", "surrogate")
    taken = done.join(members, ["kind", "entity"], "left_anti").select("kind", "surrogate").unionByName(members.select("kind", F.col("entity").alias("surrogate")))
    free = _ranked(free.join(taken, ["kind", "surrogate"], "left_anti"), by, "surrogate", key, "at")
    free = cut(free.join(sizes.drop("values"), by).where("at < n").drop("n"), "free")
    counts = sizes.join(free.groupBy(*by).agg(F.count(F.lit(1)).alias("free")), by, "left").withColumn("free", F.coalesce("free", F.lit(0)))
    if not counts.where("n = 1 and free = 0").isEmpty():
        raise ValueError("an entity has a format with no other value")
    counts = cut(counts.withColumn("own", F.expr("if(n - free = 1, n - 2, least(n, free))")).select(*by, "n", "own"), "quotas")  # a circle takes two
    placed = cut(_ranked(members, by, "entity", key, "place").join(counts, by), "placed")
    first = placed.where("place < own").withColumn("at", F.col("place")).join(free, [*by, "at"])
    circle = placed.where("place >= own")
    after = circle.withColumn("at", F.expr("own + (place - own + 1) % (n - own)")).join(circle.select(*by, F.col("place").alias("at"), F.col("entity").alias("surrogate")), [*by, "at"])
    return first.select("kind", "entity", "surrogate").unionByName(after.select("kind", "entity", "surrogate"))


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) with no surrogate given twice within a kind or, but for names and formats that are too full, equal to an entity of it."""
    done = None
    state = cut(_drawn(entities.withColumn("attempt", F.lit(0)), key), "candidates")
    for drawn in range(1, ATTEMPTS + 1):
        every = state if done is None else done.unionByName(state)
        owners = every.groupBy("kind", "surrogate").agg(F.min(F.struct(F.col("attempt"), F.col("entity"))).alias("owner"))
        real = entities.where("kind not like 'given%' and kind not like 'surname%'").select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        judged = state.join(owners, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        judged = cut(judged.withColumn("good", (F.col("owner.entity") == F.col("entity")) & F.col("real").isNull()).drop("owner", "real"), "judged")
        good = judged.where("good").drop("good")
        done = good if done is None else done.unionByName(good)
        again = judged.where("not good")
        if again.isEmpty():
            return done.select("kind", "entity", "surrogate")
        if drawn >= CLOSED and again.where(~F.col("kind").isin(*ENUMERATED)).isEmpty():
            break
        state = cut(_drawn(again.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), key), "candidates")
    formats = cut(again.select("kind", *_shape()).distinct(), "formats")
    dealt = cut(_dealt(entities, formats, done, key), "dealt")
    return done.select("kind", "entity", "surrogate").join(dealt, ["kind", "entity"], "left_anti").unionByName(dealt)


def _poured(mention: str, chars: str, which: str) -> str:
    """SQL: ``mention`` with its characters of class ``which`` replaced by those of ``chars`` in order, letter case kept."""
    c = f"substr({mention}, i, 1)"
    k = f"length(regexp_replace(substr({mention}, 1, i), '[^{which}]', ''))"
    new = f"substr({chars}, {k}, 1)"
    return f"array_join(transform(sequence(1, length({mention})), i -> if({c} rlike '[{which}]', if({c} rlike '\\\\p{{Lu}}', upper({new}), {new}), {c})), '')"


def _by_hint(sql: str) -> F.Column:
    """``sql`` with {pattern}: the whole pattern where the text has a hint, else that of the kinds that need none."""
    few = "|".join(f"(?:{PATTERNS[k]})" for k in UNHINTED)
    return F.expr(f"if(text rlike '{HINT}', {sql.format(pattern=_text(PATTERN))}, {sql.format(pattern=_text(few))})")


def mentions() -> F.Column:
    """All mentions in the column ``text``, in order."""
    return _by_hint("regexp_extract_all(text, {pattern}, 0)")


def surrogate_table(mentions: DataFrame, key: str) -> DataFrame:
    """Rows (mention, replacement, kind) for distinct ``mention`` strings."""
    title = rf"^(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? "
    said = mentions.select("mention", F.expr(_kind_of("mention")).alias("kind"))
    plain = said.where("kind <> 'person'").withColumn("entity", F.expr(
        "case kind when 'email' then lower(mention) when 'ipv6' then lower(mention) when 'secret' then if(mention rlike '^[0-9A-Fa-f]+$', lower(mention), mention) when 'iban' then upper(replace(mention, ' ', '')) when 'ip' then mention"
        " when 'phone' then regexp_replace(mention, '[^0-9+]', '') else regexp_replace(mention, '[^0-9]', '') end"
    ))
    f_names, m_names = (_array(x for (g, _), names in GIVEN.items() if g == want for x in names) for want in "fm")
    people = said.where("kind = 'person'").withColumn("title", F.regexp_extract("mention", title, 0)).withColumn("parts", F.expr("split(substr(mention, length(title) + 1), ' ')")).withColumn(
        "gender", F.expr(f"case when array_contains({f_names}, parts[0]) then 'f' when array_contains({m_names}, parts[0]) then 'm' when title rlike {_text(f'^(?:{TITLES_F})')} then 'f' when title rlike {_text(f'^(?:{TITLES_M})')} then 'm' else 'n' end")
    )
    cyrillic = "if(part rlike '[А-Яа-яЁё]' and gender <> 'n', concat('surname-', gender), 'surname')"
    tokens = people.select("mention", "title", "gender", F.size("parts").alias("n"), F.posexplode("parts").alias("place", "part")).select(
        "mention", "title", "place", F.lower("part").alias("entity"), F.expr(f"if(place = 0 and (n > 1 or title = ''), concat('given-', gender), {cyrillic})").alias("kind")
    )
    plain, tokens = cut(plain, "mentions"), cut(tokens, "names")
    entities = cut(plain.select("kind", "entity").union(tokens.select("kind", "entity")).distinct(), "entities")
    settled = cut(_settled(entities, key), "settled")
    classes = {"email": None, "secret": None, "iban": "0-9A-Z", "ip": None, "ipv6": None, "card": "0-9", "ssn": "0-9", "phone": "0-9+"}
    made = " ".join(f"when '{k}' then {_poured('mention', 'surrogate', which) if which else 'surrogate'}" for k, which in classes.items())
    shaped = F.expr("case kind " + made + " end")
    letters = F.col("kind").isin("email", "ipv6") | F.col("mention").rlike("^[0-9A-F]+$") & (F.col("kind") == "secret")  # their case is the mention's, not the entity's
    loud = letters & (F.col("mention") == F.upper("mention")) & (F.col("mention") != F.lower("mention"))
    upper = F.when(loud, F.upper("surrogate")).otherwise(shaped)
    one = plain.join(settled, ["kind", "entity"]).select("mention", upper.alias("replacement"), "kind")
    two = tokens.join(settled, ["kind", "entity"]).groupBy("mention", "title").agg(F.array_sort(F.collect_list(F.struct("place", F.initcap("surrogate").alias("word")))).alias("words"))
    return one.unionByName(two.select("mention", F.concat("title", F.array_join("words.word", " ")).alias("replacement"), F.lit("person").alias("kind")))


#: A name that stands bare; it is a mention where the same text names a person so.
_BARE = r"(?<!\p{L})\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)*+(?!\p{L})"


def _bare_names(said: DataFrame, given: DataFrame) -> DataFrame:
    """(row, length, names): for each text the words of the people it mentions, and their surrogates; titles are no names."""
    both = said.join(given.where("kind = 'person'"), "mention").select("row", "length", F.explode(F.arrays_zip(F.split("mention", " ").alias("word"), F.split("replacement", " ").alias("new"))).alias("pair"))
    words = both.select("row", "length", "pair.*").where("word <> new").groupBy("row", "length", "word").agg(F.min("new").alias("new"))
    return words.groupBy("row", "length").agg(F.map_from_entries(F.collect_list(F.struct("word", "new"))).alias("names"))


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All columns of ``docs`` with personal data in ``text`` replaced, and ``n_entities``: mentions replaced (in place of such a column).

    Null texts stay null, texts without mentions stay as they are, an empty table
    stays empty.  Repeated rows read alike, whatever their doc_id.  Other columns
    are carried along whatever their names.  A given name or surname of a person
    that a text mentions is replaced wherever it stands alone in that text.

    Not found: names without a title or a listed given name (but for such later
    mentions), postal addresses, dates of birth, signed numbers of fewer than eight
    digits, secrets of other issuers shorter than 32 hexadecimal digits.
    """
    holds = F.coalesce(_by_hint("text rlike {pattern}"), F.lit(False))
    keyed = docs.select("text", F.struct("*").alias("doc")).withColumn("row", F.xxhash64("text")).withColumn("length", F.length("text"))
    said = cut(keyed.select("row", "length", F.explode(F.array_distinct(mentions())).alias("mention")).distinct(), "said")
    given = cut(surrogate_table(said.select("mention").distinct(), key), "given")
    maps = said.join(given, "mention").groupBy("row", "length").agg(F.map_from_entries(F.collect_list(F.struct("mention", "replacement"))).alias("given"))
    maps = cut(maps.join(_bare_names(said, given), ["row", "length"], "left"), "maps")
    replaced = keyed.where(holds).join(maps, ["row", "length"], "left").withColumn("said", mentions()).withColumn("gaps", _by_hint("split(text, {pattern}, -1)"))
    bare = _text(_BARE)
    named = f"array_join(zip_with(split(gap, {bare}, -1), regexp_extract_all(gap, {bare}, 0), (g, w) -> concat(g, coalesce(names[w], w, ''))), '')"
    replaced = replaced.withColumn("n_bare", F.expr(f"if(names is null, 0, aggregate(gaps, 0, (n, gap) -> n + size(filter(regexp_extract_all(gap, {bare}, 0), w -> names[w] is not null))))"))
    parts = F.expr(f"zip_with(if(names is null, gaps, transform(gaps, gap -> {named})), said, (gap, m) -> concat(gap, coalesce(given[m], m, '')))")

    def out(rows: DataFrame, text: F.Column, n) -> DataFrame:
        return rows.select(*((text if c == "text" else F.col("doc")[c]).alias(c) for c in docs.columns if c != "n_entities"), n.cast("long").alias("n_entities"))

    clean = out(keyed.where(~holds), F.col("text"), F.lit(0))
    return clean.unionByName(out(replaced, F.array_join(parts, ""), F.expr("n_bare + size(filter(said, m -> given[m] is not null))")))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_pii_surrogates": op7_pii_surrogates}
ORACLES: dict[str, str] = {}
