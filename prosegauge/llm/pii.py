"""Surrogates for personal data. DataFrame functions only.

Entities found in the texts are gathered as one distinct table; each gets a replacement drawn from a
keyed digest of its value that keeps its type, format and script (given names also their gender).
Replacements that meet each other, or a value that is itself in the texts, are drawn again, so
different values keep different replacements and equal values equal ones, across all documents.
Spellings of one value (case in an address, spaces in a number) are one entity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, cut, join_by_key, join_few, row_key, table

# Given names by gender and script, and parts of surnames by script.
GIVEN = {
    ("f", "latin"): "Alice Ana Anna Barbara Carla Chloé Claudia Elena Emily Eva Helen Ingrid Jane Julia Karen Laura Linda Lucia Maria Marie Mary Nadia Nina Olivia Paula Rosa Sara Sofia Susan Teresa Ursula Vera Zoë".split(),
    ("m", "latin"): "Adam Albert André Andreas Bruno Carlos Daniel David Edward Felix Francisco George Hans Henry Hugo Ivan James John Jorge José Jürgen Karl Luis Marco Martin Michael Oscar Paul Peter René Robert Stefan Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Софья Татьяна".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Григорий Дмитрий Иван Константин Михаил Николай Олег Павел Сергей".split(),
}
SURNAME = {
    "latin": ("Al Bar Bel Cor Dan Del Far Gar Hal Har Kel Lan Lor Mar Mil Nor Pel Ros Sal Ster Tor Val Ver Wes".split(), "ba da le li ma na ne ra ri ro ta ve vi wa".split(), "berg burn dale feld ford lin man mer mont nell rick ser son stein ton well".split()),
    "cyrillic": ("Бар Вол Гор Дан Зим Кар Лав Мар Нов Орл Пет Сав".split(), "а е и о у".split(), "вин ков лев нин ров сов тин хин".split()),
}
#: Small words inside surnames; they stay.
PARTICLES = "van von de der den da di du la le del dos".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Sr Sra Señor Señora M Mme".split()
#: Letters of other scripts in runs without gaps: (first, last), lower and upper case apart.
LETTERS = [
    (0x430, 0x44F), (0x410, 0x42F), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x561, 0x586), (0x531, 0x556), (0x10D0, 0x10F0), (0x5D0, 0x5EA), (0x628, 0x63A),
    (0x915, 0x939), (0xE01, 0xE2E), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
SIGNS = list("!#$%&*+-=?@^_~")
#: Country codes of telephone numbers by their first digits: one digit, two, else three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_TITLE = "(?:" + "|".join(TITLES) + ")"
_SMALL = "(?:(?:" + "|".join(PARTICLES) + ") )"
_CAP = rf"{_SMALL}{{0,2}}(?:[OD]['’]|Mc|Mac)?\p{{Lu}}\p{{Ll}}++(?:-\p{{Lu}}\p{{Ll}}++)?"
_NAMES = [n for names in GIVEN.values() for n in names]
_GIVEN = "(?:" + "|".join(_NAMES) + ")"
_LOUD = "(?:" + "|".join(n.upper() for n in _NAMES) + ")"
#: A sign of an address: letters and digits of any script.
_ADDRESS = r"[\p{L}\p{N}_.%+\-]"
_LABEL = r"[\p{L}\p{N}\-]++"
_SECRET = r"(?i:password|passwd|secret|api_key|token)"

#: Entity types with their patterns, in order of precedence. No pattern can match nothing; runs are possessive.
#: Each begins with what is quickest to fail.
PATTERNS = {
    "email": rf"(?<!{_ADDRESS}){_ADDRESS}++@{_LABEL}(?:\.{_LABEL})+",
    "secret": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![0-9A-Za-z])gh[pousr]_[0-9A-Za-z]{16,255}(?![0-9A-Za-z])"
    rf"|(?<=[=:])(?<={_SECRET} ?[=:])[^\s\"']++|(?<= )(?<={_SECRET} ?= )[^\s\"']++|(?<= )(?<={_SECRET} ?: )(?=[^\s\"']*[0-9!@#$%&*+/_\-])[^\s\"']++"
    r"|(?<=:)(?<=://[^\s/@:]{1,64}:)[^\s/@]++(?=@)|(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "card": r"(?=\d)(?<![\w.])(?:\d{4}[ \-]?\d{4}[ \-]?\d{4}[ \-]?\d{3,4}|\d{4}[ \-]?\d{6}[ \-]?\d{5})(?![\w\-])",
    "ssn": r"(?=\d)(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "phone": r"(?=[+(\d])(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\w\-])|(?=\+)(?<![\w+])\+\d{8,15}(?!\w)"
    r"|(?=0)(?<![\w.,+\-])0[1-9]\d{7,10}(?![\w\-]|[.,]\d)|(?=[2-9])(?<![\w.,+\-/])[2-9]\d{2}-\d{4}(?![\w\-/]|[.,]\d)",
    "ip": r"(?=\d)(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)|(?<![\w:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])|(?=[0-9a-fA-F:]{0,40}\d)(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6}(?![\w:])",
    "iban": r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}_])(?:(?:{_TITLE}\.? )?{_GIVEN} {_CAP}(?![\p{{L}}\p{{N}}_])|{_TITLE}\.? {_CAP}(?![\p{{L}}\p{{N}}_])|{_LOUD} \p{{Lu}}{{2,40}}+(?![\p{{L}}\p{{N}}_])"
    rf"|(?<= )(?<=[Mm]y name is ){_CAP}(?: {_CAP})?(?![\p{{L}}\p{{N}}_]))",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_NO_EMAIL = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "email")


def by_entity(text: Column, make: Callable[[str], Column]) -> Column:
    """make(pattern of all entities); a text without @ holds no address and is spared the search for one."""
    return F.when(text.contains("@"), make(ENTITY)).otherwise(make(_NO_EMAIL))


def entity_type(value: Column) -> Column:
    """The first type whose pattern is the whole value (what stands before a secret is not part of it)."""
    kind = F.lit("secret")
    for name, pattern in reversed(list(PATTERNS.items())):
        if name != "secret":
            kind = F.when(value.rlike(rf"\A(?:{pattern})\z"), name).otherwise(kind)
    return kind


def _draw(digest: Column, i: Column) -> Column:
    """A number below 2**32 for each place, from 64 hex digits of digest and the place."""
    return F.xxhash64(digest, i).bitwiseAND(F.lit(0xFFFFFFFF))


def _letter(first: int, last: int, n: Column) -> Column:
    """The n-th letter of a run, counted round and round."""
    code = F.lit(first) + n % (last - first + 1)
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _alike(value: Column, digest: Column) -> Column:
    """Each digit by a digit, each letter by a letter of its case and script; signs stay where there is a letter or digit beside them, else they are drawn too.

    A number's first digit stays clear of 0. Letters of scripts without a table become a-z.
    """
    letters = F.split(value, "")
    blank = ~value.rlike(r"[\p{L}\p{N}]")

    def one(ch: Column, i: Column) -> Column:
        n, code = _draw(digest, i), F.ascii(ch)
        first = (i == 0) | ~F.get(letters, i - 1).rlike("[0-9]")
        out = (
            F.when(ch.rlike("[1-9]") & first, (n % 9 + 1).cast("string"))
            .when(ch.rlike("[0-9]"), (n % 10).cast("string"))
            .when(ch.rlike("[a-z]"), F.char(n % 26 + 97))
            .when(ch.rlike("[A-Z]"), F.char(n % 26 + 65))
            .when((code < 128) & ~blank, ch)
        )
        for lo, hi in LETTERS:
            out = out.when(code.between(lo, hi), _letter(lo, hi, n))
        return out.when(ch.rlike(r"\p{Lu}"), F.char(n % 26 + 65)).when(ch.rlike(r"\p{L}"), F.char(n % 26 + 97)).otherwise(F.get(F.array(*map(F.lit, SIGNS)), (n % len(SIGNS)).cast("int")))

    return F.array_join(F.transform(letters, one), "")


def _hexlike(value: Column, digest: Column) -> Column:
    """As _alike, but hex digits stay hex digits."""
    return F.array_join(F.transform(F.split(value, ""), lambda ch, i: F.when(ch.rlike("[0-9a-f]"), F.lower(F.hex(_draw(digest, i) % 16))).otherwise(ch)), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda ch, i: F.when(i % 2 == 0, ch.cast("int")).otherwise((2 * ch.cast("int")) % 10 + F.floor(ch.cast("int") / 5)))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda s, x: s + x) % 10


def _card(value: Column, digest: Column) -> Column:
    """A number of the same issuer digit and grouping; if the value passes the Luhn test, so does the replacement."""
    drawn = F.concat(F.substring(value, 1, 1), F.substring(_alike(value, digest), 2, 40))
    off = _luhn(F.regexp_replace(F.regexp_replace(drawn, r"\d\z", "0"), r"\D", ""))
    fixed = F.concat(F.regexp_replace(drawn, r"\d\z", ""), ((10 - off) % 10).cast("string"))
    return F.when(_luhn(F.regexp_replace(value, r"\D", "")) == 0, fixed).otherwise(drawn)


def _email(value: Column, digest: Column) -> Column:
    """Local part and domain labels alike in format; the last label, which names no one, stays."""
    return F.concat(_alike(F.regexp_replace(value, r"\.[^.]*\z", ""), digest), F.regexp_extract(value, r"\.[^.]*\z", 0))


def _ip(value: Column, digest: Column) -> Column:
    v4 = F.array_join(F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: (_draw(digest, k) % 254 + 1).cast("string")), ".")
    return F.when(value.contains(":"), _hexlike(F.lower(value), digest)).otherwise(v4)


def _phone(value: Column, digest: Column) -> Column:
    """Digits with + before them where the value has it; the country code stays."""
    code = F.regexp_extract(value, COUNTRY, 0)
    return F.concat(code, _alike(F.substr(value, F.length(code) + 1), digest))


def _iban(value: Column, digest: Column) -> Column:
    """The same country, and the check digits that the drawn account number asks for."""
    country, account = F.substring(value, 1, 2), _alike(F.substring(value, 5, 60), digest)
    number = F.split(F.concat(account, country, F.lit("00")), "")
    rest = F.aggregate(number, F.lit(0).cast("bigint"), lambda r, ch: F.when(ch.rlike("[0-9]"), (r * 10 + ch.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(ch) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _surname(value: Column, digest: Column, attempt: Column) -> Column:
    def made(script: str) -> Column:
        head, mid, tail = (F.array(*map(F.lit, part)) for part in SURNAME[script])
        pick = lambda part, k: F.get(part, (_draw(digest, k) % F.size(part)).cast("int"))
        middle = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda k: pick(mid, k + 10)), "")
        return F.concat(pick(head, F.lit(1)), middle, pick(tail, F.lit(2)))

    return F.when(value.rlike(r"\A\p{IsCyrillic}"), made("cyrillic")).when(value.rlike(r"\A\p{IsLatin}"), made("latin")).otherwise(_alike(value, digest))


def _given(value: Column, digest_of_list: str) -> Column:
    """Another given name of the same gender and script: a rotation of each list by a keyed step, so none meets another."""
    out = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        array = F.array(*map(F.lit, names))
        step = F.pmod(F.xxhash64(F.lit(digest_of_list), F.lit(gender + script)), F.lit(len(names) - 1)) + 1
        at = F.array_position(array, F.initcap(value))
        out = F.when(at > 0, F.get(array, ((at - 1 + step) % len(names)).cast("int"))).otherwise(out)
    return F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(out)).otherwise(out)


def canonical(kind: Column, value: Column) -> Column:
    """What the spellings of one entity have in common: an address without case, a number without spaces and signs."""
    return (
        F.when(kind.isin("email", "ip"), F.lower(value))
        .when(kind == "phone", F.regexp_replace(value, r"[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, r"[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


def spelt(kind: Column, value: Column, drawn: Column) -> Column:
    """A drawn surrogate in the spelling of the value: its groups and signs, its case. What a longer one has left stands at the end."""
    plain = F.regexp_replace(drawn, r"[^0-9A-Za-z]", "")
    nth = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), r"[^0-9A-Za-z]", ""))
    laid = F.array_join(F.transform(F.split(value, ""), lambda ch, i: F.when(ch.rlike("[0-9A-Za-z]"), F.substr(plain, nth(i), F.lit(1))).otherwise(ch)), "")
    laid = F.concat(laid, F.substr(plain, F.length(F.regexp_replace(value, r"[^0-9A-Za-z]", "")) + 1))
    loud = kind.isin("email", "ip", "surname") & (value == F.upper(value)) & (value != F.lower(value))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), laid).when(loud, F.upper(drawn)).otherwise(drawn)


#: Attempts within a value's own format; later ones are longer by a letter or digit each, so there is always a free value.
IN_FORMAT = {"secret": 2, "email": 2}


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The draw of one attempt for a canonical value."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 256)
    drawn = (
        F.when(kind == "email", _email(value, digest))
        .when(kind == "card", _card(value, digest))
        .when(kind == "phone", _phone(value, digest))
        .when(kind == "ip", _ip(value, digest))
        .when(kind == "surname", _surname(value, digest, attempt))
        .when((kind == "secret") & value.rlike(r"\A[0-9a-f]{32,128}\z"), _hexlike(value, digest))
        .when((kind == "secret") & value.rlike(r"\AAKIA[0-9A-Z]{16}\z"), F.concat(F.lit("AKIA"), F.substring(_alike(value, digest), 5, 16)))
        .when((kind == "secret") & value.rlike(r"\Agh[pousr]_[0-9A-Za-z]+\z"), F.concat(F.substring(value, 1, 4), F.substr(_alike(value, digest), F.lit(5))))
        .when(kind == "iban", _iban(value, digest))
        .otherwise(_alike(value, digest))
    )
    free = F.lit(8)
    for name, n in IN_FORMAT.items():
        free = F.when(kind == name, n).otherwise(free)
    more = F.greatest(attempt - free, F.lit(0))
    digits = F.substr(F.regexp_replace(F.sha2(F.concat(digest, F.lit("+")), 512), "[^0-9]", ""), F.lit(1), more)
    letters = F.substr(F.translate(F.sha2(F.concat(digest, F.lit("+")), 512), "0123456789", "ghijkmnpqr"), F.lit(1), more)
    return F.when(kind == "email", F.concat(letters, drawn)).when(kind.isin("secret", "surname"), F.concat(drawn, letters)).otherwise(F.concat(drawn, digits))


def surrogate_table(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """kind, value (distinct, canonical) -> kind, value, surrogate, with no two values of a kind alike in surrogate.

    A surrogate that another value drew, or that is itself a value in the texts, is drawn again
    with the next attempt; of values that drew alike the smallest keeps it. Formats with few values
    run full (nine secrets of one digit), so after a few attempts draws grow longer. What has
    still met another after `rounds` attempts gets its whole keyed digest; nothing is ever raised. Each
    round is two joins over distinct values; only a flag reaches the driver.
    """
    at = cut(entities.select("kind", "value", F.lit(0).alias("attempt")))
    real = cut(entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("_real")))
    for n in range(rounds):
        drawn = cut(at.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)))
        keeper = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("_keeper"))
        judged = drawn.join(keeper, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        again = (F.col("value") != F.col("_keeper")) | F.coalesce("_real", F.lit(False))
        judged = cut(judged.select("kind", "value", "attempt", "surrogate", again.alias("_again")))
        if not judged.where("_again").limit(1).count():
            return judged.select("kind", "value", "surrogate")
        if n + 1 < rounds:
            at = cut(judged.select("kind", "value", (F.col("attempt") + F.col("_again").cast("int")).alias("attempt")))
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value"), 256)
    return judged.select("kind", "value", F.when(F.col("_again"), digest).otherwise(F.col("surrogate")).alias("surrogate"))


def _parts(entity: Column) -> Column:
    """An entity as the pieces that get surrogates of their own: a name is title, given name and surname, others are whole."""
    word = lambda w: F.when(F.btrim(w, F.lit(". ")).isin(TITLES + PARTICLES), "title").when(F.initcap(F.btrim(w)).isin(_NAMES), "given").otherwise("surname")
    names = F.transform(F.split(entity, "(?<= )"), lambda w: F.struct(word(w).alias("kind"), w.alias("value")))
    return bind(entity_type(entity), lambda kind: F.when(kind == "name", names).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("value")))))


def with_surrogates(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with its entities replaced.

    Returns the id, text (null stays null), n_entities and kinds (sorted types found, of a name its
    parts). Equal values get equal surrogates wherever they stand, different ones different
    surrogates; spellings of one value count as equal. Given names rotate within their list: they
    need no draw and no check. Where two entities overlap, the one that begins first is taken, then the first kind in
    PATTERNS. No match begins or ends inside a word. Empty texts stay empty; texts of any length are read whole; rows that are alike in id and
    text are replaced alike; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_key", row_key(F.col("doc_id"), F.col("_text")))
    text = F.col("_text")
    found = rows.select("_key", F.posexplode(by_entity(text, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0)))).alias("_at", "_entity"))
    marked = found.select("_key", "_at", F.posexplode(_parts(F.col("_entity"))).alias("_sub", "_part"))
    parts = marked.select("_key", "_at", "_sub", "_part.kind", F.rtrim("_part.value").alias("_value"), F.when(F.col("_part.value").endswith(" "), " ").otherwise("").alias("_gap"))
    parts = cut(parts.withColumn("value", canonical(F.col("kind"), F.col("_value"))).distinct())
    drawn = parts.where(~F.col("kind").isin("title", "given"))
    counted = cut(drawn.groupBy("kind", "value").agg(F.count("*").alias("_n")))
    names = cut(surrogate_table(counted, key).join(counted, ["kind", "value"]))
    new = join_by_key(drawn, names, ["kind", "value"], "inner").withColumn("_new", spelt(F.col("kind"), F.col("_value"), F.col("surrogate")))
    rest = parts.where(F.col("kind").isin("title", "given")).withColumn("_new", F.coalesce(_given(F.col("_value"), key), F.col("_value")))
    both = new.select("_key", "_at", "_sub", "kind", F.concat("_new", "_gap").alias("_new")).union(rest.select("_key", "_at", "_sub", "kind", F.concat("_new", "_gap").alias("_new")))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_sub", "_new"))), lambda x: x["_new"]), "")
    each = both.groupBy("_key", "_at").agg(pieces.alias("_new"), F.collect_set(F.when(F.col("kind") != "title", F.col("kind"))).alias("_kinds"))
    whole = each.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_new"))).alias("_new"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_kinds")))).alias("kinds"))
    joined = join_few(rows, cut(whole), "_key")
    gaps = by_entity(text, lambda p: F.split(text, p, -1))
    filled = bind(F.col("_new"), lambda new: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i)["_new"], F.lit("")))), ""))
    n = F.greatest(F.coalesce(F.size("_new"), F.lit(0)), F.lit(0)).cast("bigint")
    return joined.select("doc_id", F.when(F.col("_new").isNull(), text).otherwise(filled).alias("text"), n.alias("n_entities"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents"))
