"""Surrogates for personal data, in DataFrame and SQL functions only.

Entities are found by pattern: e-mail and IP addresses, telephone and card numbers, account numbers, secrets, and names after a title.
Each distinct entity of the corpus gets one replacement drawn from a keyed hash: digits for digits, letters for letters in the
same script, hexadecimal for hexadecimal, octets of the same length, card numbers that pass the check digit if the
original does, given names of the title's gender. So one entity is replaced alike wherever and however it is written (upper case, other
separators, with or without given name). Replacements are compared with each other and with all originals of
their type, and drawn again until they are distinct and new.

Defined results: null text stays null, empty text empty; a text without entities is returned as it is; repeated rows are replaced
alike; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import column, numbered, shared_folder, write

# Titles by gender, syllables of replacement names by script
MALE = "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Don|Signor|господин"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Signora|госпожа"
LATIN = "ba be bo da de do fa fi ga go ka ke la li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te ti to va vi".split()
CYRILLIC = "ба бе бо ва ве во га го да де до ка ке ла ли ло ма ме ми мо на не но па пе ра ре ри ро са се та те ти то".split()
ENDINGS = {"given_m": ("n", "н"), "given_f": ("a", "а"), "surname": ("l", "л")}

WORD = r"\p{Lu}[\p{L}'\-]+"
PATTERNS = {
    "secret": r"(?<=(?:token|TOKEN|secret|SECRET|password|PASSWORD|api_key|API_KEY)\s?[=:]\s?[\x22'])[\p{L}\p{Nd}][^\s\x22']{5,}",
    "email": r"[\p{L}\p{Nd}._%+\-]+@(?:[\p{L}\p{Nd}\-]+\.)+\p{L}{2,}",
    "ip": r"(?<![\p{Nd}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\p{Nd}]|\.[\p{Nd}])",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3}[ .\-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}|(?<![\p{Nd}\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{Nd}\-])",
    "ssn": r"(?<![\p{Nd}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{Nd}\-])",
    "account": r"(?<![\p{L}\p{Nd}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{Nd}])",
    "card": r"(?<![\p{Nd}])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{Nd}])",
    "hex": r"(?<![\p{L}\p{Nd}])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,}(?![\p{L}\p{Nd}])",
    "name": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE})\.? {WORD}(?: {WORD})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[0-9@]|[\x22']|(?:{MALE}|{FEMALE})\.? "  # a text without one of these has no entity
DRAWS = 64
CROWDED = 16  # draws that keep the length


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(raw: str) -> str:
    """SQL: type of a found entity; the patterns that need their surroundings are told apart by form."""
    order = ["email", "name", "ip", "ssn", "phone", "account", "card"]
    return "CASE " + " ".join(f"WHEN {raw} RLIKE {quoted(f'^(?:{PATTERNS[k]})$')} THEN '{k}'" for k in order) + " ELSE 'secret' END"


def found(docs: DataFrame, text: str, row: str) -> DataFrame:
    """row, pos, part, kind, raw, entity: the parts of every entity; fixed parts (titles) have no kind."""
    hits = docs.where(column(text).rlike(HINT)).select(
        column(row).alias("row"), F.expr(f"posexplode(regexp_extract_all(`{text}`, {quoted(ANY)}, 0))").alias("pos", "raw"))
    hits = hits.withColumn("kind", F.expr(kind_of("raw")))
    parts = F.expr("CASE WHEN kind = 'name' THEN split(raw, ' ') ELSE array(raw) END")
    given = F.when(F.col("raw").rlike(rf"^(?:{FEMALE})\.? "), "given_f").otherwise("given_m")
    spread = hits.withColumn("n", F.size(parts)).select("row", "pos", "kind", "n", given.alias("given"),
                                                       F.posexplode(parts).alias("part", "raw"))
    kind = (F.when(F.col("kind") != "name", F.col("kind")).when(F.col("part") == 0, F.lit(None))
            .when((F.col("n") == 3) & (F.col("part") == 1), F.col("given")).otherwise(F.lit("surname")))
    spread = spread.select("row", "pos", "part", kind.alias("kind"), "raw")
    entity = (F.when(F.col("kind").isin("email", "ip", "secret"), F.lower("raw"))
              .when(F.col("kind").isNotNull(), F.lower(F.regexp_replace("raw", r"[^\p{L}\p{Nd}]", ""))))
    return spread.withColumn("entity", entity)


def drawn(key: str) -> Column:
    """Replacement of an entity: its letters and digits one by one from a keyed hash of entity, type and draw."""
    # 64 hex digits a block, as many blocks as the entity is long; two hex digits choose one character
    stream = (f"array_join(transform(sequence(0, length(entity) DIV 32), b -> "
              f"sha2(concat_ws('/', {quoted(key)}, kind, entity, CAST(draw AS string), CAST(b AS string)), 256)), '')")
    number = "CAST(conv(substr(s, 2 * i + 1, 2), 16, 10) AS int)"
    letter = "substr(entity, i + 1, 1)"
    tail = "kind = 'email' AND i >= length(entity) - length(substring_index(entity, '.', -1))"
    abroad = "kind = 'phone' AND i < length(entity) - 10"  # the country's code
    hexed = "kind = 'secret' AND entity RLIKE '^[0-9a-f]+$'"
    by_char = f"""CASE
        WHEN {tail} OR {abroad} THEN {letter}
        WHEN {hexed} AND {letter} RLIKE '[a-f]' THEN substr('abcdef', {number} % 6 + 1, 1)
        WHEN {letter} RLIKE '[0-9]' THEN substr('0123456789', {number} % 10 + 1, 1)
        WHEN {letter} RLIKE '[a-z]' THEN substr('abcdefghijklmnopqrstuvwxyz', {number} % 26 + 1, 1)
        WHEN {letter} RLIKE '\\\\p{{IsCyrillic}}' THEN substr('абвгдежзиклмнопрстуфхцчшыэюя', {number} % 28 + 1, 1)
        WHEN {letter} RLIKE '\\\\p{{IsGreek}}' THEN substr('αβγδεζηθικλμνξοπρστυφχψω', {number} % 24 + 1, 1)
        WHEN {letter} RLIKE '\\\\p{{L}}' THEN substr('abcdefghijklmnopqrstuvwxyz', {number} % 26 + 1, 1)
        ELSE {letter} END"""
    # where a short form runs out of distinct replacements, later draws are longer
    spelled = (f"concat(array_join(transform(sequence(0, length(entity) - 1), i -> {by_char}), ''), "
               f"IF(draw < {CROWDED}, '', substr(translate(s, 'abcdef', '012345'), 1, draw DIV 4)))")
    # octets keep their number of digits
    octet = (f"CASE IF(draw < {CROWDED}, length(o), 3) WHEN 1 THEN CAST(1 + n % 9 AS string) WHEN 2 THEN CAST(10 + n % 90 AS string) "
             "ELSE CAST(100 + n % 156 AS string) END")
    octets = (f"array_join(transform(split(entity, '[.]'), (o, i) -> transform(array(CAST(conv(substr(s, 4 * i + 1, 4), 16, 10) AS int)), "
              f"n -> {octet})[0]), '.')")
    names = []
    for script, syllables in ((1, CYRILLIC), (0, LATIN)):
        listed = "array(" + ", ".join(quoted(x) for x in syllables) + ")"
        ending = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[script]}'" for k, v in ENDINGS.items()) + " END"
        names.append(f"concat(array_join(transform(sequence(0, 2 + draw DIV 4), i -> element_at({listed}, {number} % {len(syllables)} + 1)), ''), {ending})")
    name = f"CASE WHEN entity RLIKE '\\\\p{{IsCyrillic}}' THEN {names[0]} ELSE {names[1]} END"
    # the last digit that makes the check sum of the others, doubled alternately from the right, a multiple of ten
    total = ("aggregate(sequence(1, length(c) - 1), 0L, (a, i) -> a + CASE WHEN (length(c) - i) % 2 = 1 THEN "
             "(2 * CAST(substr(c, i, 1) AS int)) DIV 10 + (2 * CAST(substr(c, i, 1) AS int)) % 10 ELSE CAST(substr(c, i, 1) AS bigint) END)")
    check = f"CAST((10 - {total} % 10) % 10 AS string)"
    valid = f"transform(array(entity), c -> substr(c, length(c), 1) = {check})[0]"
    card = f"CASE WHEN {valid} THEN transform(array({spelled}), c -> concat(substr(c, 1, length(c) - 1), {check}))[0] ELSE {spelled} END"
    chosen = (f"CASE WHEN kind = 'ip' THEN {octets} WHEN kind IN ('given_m', 'given_f', 'surname') THEN {name} "
              f"WHEN kind = 'card' THEN {card} ELSE {spelled} END")
    return F.expr(f"transform(array({stream}), s -> {chosen})[0]")


def assign(entities: DataFrame, key: str, root: str) -> DataFrame:
    """kind, entity, surrogate: distinct within a kind and no original of it."""
    done, waiting = None, entities
    for draw in range(DRAWS):
        tried = write(waiting.withColumn("draw", F.lit(draw)).withColumn("surrogate", drawn(key)).drop("draw"), f"{root}/draw{draw}")
        first = tried.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        fresh = first.join(entities.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            fresh = fresh.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        fresh = write(fresh.select("kind", "entity", "surrogate"), f"{root}/fresh{draw}")
        done = fresh if done is None else done.union(fresh)
        waiting = tried.select("kind", "entity").join(fresh, ["kind", "entity"], "left_anti")
        if waiting.isEmpty():
            return done
    raise ValueError("more entities of one form than this form can tell apart")


def dressed() -> Column:
    """The surrogate in the form of ``raw``: its separators, and capitals where it has them."""
    spelled = ("aggregate(split(raw, ''), struct('' AS o, 1 AS i), (a, c) -> CASE WHEN c RLIKE '[\\\\p{L}\\\\p{Nd}]' THEN "
               "struct(concat(a.o, CASE WHEN c = lower(c) THEN substr(s, a.i, 1) ELSE upper(substr(s, a.i, 1)) END) AS o, a.i + 1 AS i) "
               "ELSE struct(concat(a.o, c) AS o, a.i AS i) END, a -> concat(a.o, substr(s, a.i)))")
    named = "CASE WHEN raw = upper(raw) THEN upper(surrogate) ELSE initcap(surrogate) END"
    return F.expr(
        f"CASE WHEN kind IS NULL THEN raw WHEN kind = 'ip' THEN surrogate WHEN kind IN ('given_m', 'given_f', 'surname') THEN {named} "
        f"ELSE transform(array(regexp_replace(surrogate, '[^\\\\p{{L}}\\\\p{{Nd}}]', '')), s -> {spelled})[0] END")


def replace_entities(docs: DataFrame, secret: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, text with surrogates, n_entities for every row; ``secret`` keys the replacements."""
    rows, row = numbered(docs.select(column(key).alias("doc"), column(text).alias("text")))
    root = shared_folder(docs.sparkSession, "surrogates")
    parts = write(found(rows, "text", row), f"{root}/parts")
    entities = write(parts.where("kind IS NOT NULL").groupBy("kind", "entity").count().drop("count"), f"{root}/entities")
    surrogates = assign(entities, secret, root)
    new = parts.join(surrogates, ["kind", "entity"], "left").select("row", "pos", "part", dressed().alias("new"))
    new = new.groupBy("row", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))),
                                                              lambda x: x["new"]), " ").alias("new"))
    new = write(new.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new")),
                f"{root}/new")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain = rows.where(~hinted).select(F.col("doc").alias(key), F.col("text").alias(text), F.lit(0).cast("long").alias("n_entities"))
    woven = F.expr(f"array_join(flatten(zip_with(split(text, {quoted(ANY)}), new, (a, b) -> array(a, coalesce(b, '')))), '')")
    touched = rows.where(hinted).join(new, F.col(row) == F.col("row"), "left").select(
        F.col("doc").alias(key), F.when(F.col("new").isNull(), F.col("text")).otherwise(woven).alias(text),
        F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_entities"))
    return plain.union(touched)
