"""Personal data and secrets replaced by keyed surrogates of the same kind and format.

Mentions are found by one pattern. What a mention names (a phone number's digits, an address in lower case, a given name, a surname)
is its identity; every identity of the corpus gets one surrogate, made from a keyed hash, so mentions of one identity agree across
documents and writings. Two identities never share a surrogate and no surrogate is an identity that occurs: clashes are found by
grouping the surrogates, and all but one of a clash are drawn again. Mentions are then rendered in their own format: separators,
letter case, prefixes, title, gender and script stay. All of it is column expressions, joins and groupings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable

# fixed values: given names by script and gender, syllables for surnames, titles by gender
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Emma Clara Sofia Helena Lucia Carmen Camille Isabel Margaret Elizabeth Susan Linda Patricia Barbara Mary Jennifer".split(),
    ("latin", "m"): "James Robert Michael William David Richard Thomas Daniel Matthew Peter Martin Stefan Lukas Pierre Carlos Miguel Javier Antonio John Andreas".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Павел Игорь".split(),
}
SYLLABLES = {"latin": "bar ber cal dan del far gar hol kel lan mar mor nor per ros sal tan tor val wen".split(),
             "cyrillic": "бар вер гор дан жел кор лан мор нов пет рас сол тар уль фед".split()}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra госпожа г-жа".split(), "m": "Mr Herr Monsieur Señor Sr господин г-н".split(), "": "Dr Prof".split()}

# words that stand inside a name, and words that end one though they are written with a capital
PARTICLES = "van von der den de del della di da dos du la le bin ibn zu ter ten".split()
NO_NAME = "A An And As At But By For From He Her His If In Is It Of On Or She So That The Then They This To Was We When With Und Oder Der Die Das Ein Eine Er Es Ich Ist Im Sie Et Ou Est Une El En Los Las Un Una".split()

_END = r"(?![\p{L}\p{N}_])"
_PART = "|".join(PARTICLES)
_WORD = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]++"
_NAME = rf"(?!(?:{'|'.join(NO_NAME)}){_END}){_WORD}(?:[-'’]{_WORD}){{0,3}}+"
_NAMES = rf"[ ](?:(?:{_PART})[ ]){{0,3}}{_NAME}"
_TITLE = "|".join(dict.fromkeys(x for ts in TITLES.values() for t in ts for x in (t, t.upper())))
_KNOWN = "|".join(n for names in GIVEN.values() for n in names)
_HEX = "[0-9A-Fa-f]"
_ESCAPED = r"""[^{q}\\\r\n]*+(?:\\.[^{q}\\\r\n]*+){{0,1000}}+"""


def _quoted(q: str) -> str:
    """A quoted value of 8 signs or more, up to the closing quote or the end of the text; a quote behind a backslash closes nothing."""
    return rf"{q}(?=(?:[^{q}\\\r\n]|\\.){{8}}){_ESCAPED.format(q=q)}(?={q}|$)"


#: What is found, by kind, in this order where two could begin at the same place. Each begins behind no letter, digit or underscore; a secret word may
#: stand behind an underscore. A secret runs to its closing quote, or to white space or a quote without the punctuation before it.
PATTERNS = {
    "mac": rf"(?:(?:{_HEX}{{2}}:){{5}}|(?:{_HEX}{{2}}-){{5}}){_HEX}{{2}}(?![\p{{L}}\p{{N}}_:\-])",
    "ip6": rf"(?=[A-Fa-f:]{{0,30}}\d)(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?:{_HEX}{{1,4}}:){{1,6}}(?::{_HEX}{{1,4}}){{1,6}})(?![\p{{L}}\p{{N}}_:])",
    "ip": r"(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}_]|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,3}|00\d{2}[ .\-]\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})" + _END,
    "ssn": r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_\-])",
    "card": r"(?<!\d-)[3-6](?:\d{12,18}|\d{3}(?:[ \-]\d{4}){3}|\d{3}[ \-]\d{6}[ \-]\d{5})(?![\p{L}\p{N}_\-])",
    "iban": r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?" + _END,
    "person": rf"(?:(?:{_TITLE})\.?(?:{_NAMES}){{1,31}}|(?:{_KNOWN})(?:-{_WORD})?(?:{_NAMES}){{1,30}})" + _END,
    "secret": rf"""(?i:password|passwd|secret|token|api[_\-]?key|access[_\-]?key)["']?[ \t]{{0,3}}[=:][ \t]{{0,3}}(?:{_quoted('"')}|{_quoted("'")}|["']?[^\s"']{{7,}}[^\s"'.,;:!?)\]}}>])"""
              r"""|(?i:bearer)[ \t]{1,3}(?=[A-Za-z._~+/\-]{0,200}\d)[A-Za-z0-9._~+/\-]{15,}[A-Za-z0-9=_]""",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s{0,3}[A-Z][A-Za-z]{1,10}-[A-Z][a-z]{1,10}:[^\r\n]*+){0,4}[^-]{16,}+(?=-----END|$)",
    "key": r"(?:AKIA[0-9A-Z]{16,}|ghp_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,})(?![A-Za-z0-9])",
    "email": r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+\-]*+@(?:[\p{L}\p{M}\p{N}\-]{1,63}\.){1,20}\p{L}{2,24}(?![\p{L}\p{N}\-])",
}


def _any(*kinds: str) -> str:
    return "|".join(PATTERNS[k] for k in kinds)


# most places are ruled out by one sign; the patterns are tried at the others only
_PLAIN = (r"(?=[0-9(+A-Za-hpst\-Ѐ-ӿ])(?<![\p{L}\p{N}_])(?:(?=[0-9(+])(?:" + _any("mac", "ip6", "ip", "phone", "ssn", "card") + r")|(?=[A-ZЀ-ӿ])(?:"
          + _any("iban", "person") + r")|(?=[Ags])(?:" + _any("key") + r")|(?=[A-Fa-f])(?:" + _any("mac", "ip6") + r")|(?=-)(?:" + _any("pem")
          + r"))|(?=[aAbBpPsStT])(?<![\p{L}\p{N}])(?:" + _any("secret") + ")")
_ANY = rf"{_PLAIN}|(?=[\p{{L}}\p{{N}}])(?<![\p{{L}}\p{{M}}\p{{N}}._%+\-])(?:{_any('email')})"
#: the same, or else one word with a capital, which may be a name found elsewhere in the text
_BARE = rf"(?<![\p{{L}}\p{{N}}_\-])(?:\p{{Lu}}['’])?\p{{Lu}}[\p{{L}}\p{{M}}]++(?![\p{{N}}_\-])"
_ANY_OR_BARE = f"{_ANY}|{_BARE}"
_LETTERS = {"digit": "0123456789", "hex": "0123456789abcdef", "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_BYTES = 96


def _keyed(key: Column, *parts: Column) -> Column:
    """Hex digits of a keyed hash: the key goes first and last, so the hash cannot be continued without it."""
    return F.sha2(F.concat_ws("\u0001", key, *parts, key), 256)


def _bytes(text: Column) -> Column:
    """A string of hex digits as an array of numbers from 0 to 255."""
    return F.transform(F.sequence(F.lit(0), F.lit(_BYTES - 1)), lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _chars(text: Column) -> Column:
    return F.split(text, "", -1)


def _at(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters)).cast("int") + 1, F.lit(1))


def _poured(text: Column, bits: Column, hexadecimal: Column | None = None) -> Column:
    """``text`` with each digit and letter replaced by another of its kind; all other characters stay."""
    def one(c, i):
        n = bits[i % _BYTES]
        kind = F.when(c.rlike("[0-9]"), _at(_LETTERS["digit"], n)).when(c.rlike("[a-z]"), _at(_LETTERS["lower"], n)).when(
            c.rlike("[A-Z]"), _at(_LETTERS["upper"], n)).when(c.rlike(r"[\p{L}\p{M}\p{N}]"), _at(_LETTERS["lower"], n)).otherwise(c)
        return kind if hexadecimal is None else F.when(hexadecimal & c.rlike("[0-9a-z]"), _at(_LETTERS["hex"], n)).otherwise(kind)
    return F.array_join(F.transform(F.filter(_chars(text), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of a Luhn check over a string of digits, the last one included."""
    n = F.length(digits)
    value = lambda c, i: (lambda d: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))(c.cast("int"))
    return F.aggregate(F.transform(F.filter(_chars(digits), lambda c: c != ""), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters, letters read as 10 to 35."""
    def step(a, c):
        n = F.ascii(c)
        return F.when(n < 58, (a * 10 + n - 48) % 97).otherwise((a * 100 + n - 55) % 97)
    return F.aggregate(F.filter(_chars(text), lambda c: c != ""), F.lit(0), step)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(title: Column, given: Column) -> Column:
    out = F.lit("")
    title = F.upper(title)
    caps = {g: [t.upper() for t in ts] for g, ts in TITLES.items()}
    for gender in "fm":
        names = [n for (_, g), ns in GIVEN.items() if g == gender for n in ns]
        neutral = ~title.isin(*caps["f"], *caps["m"])
        out = F.when(title.isin(caps[gender]) | (neutral & given.isin(names)), F.lit(gender)).otherwise(out)
    return out


def _settled(parts: DataFrame) -> DataFrame:
    """``kind, identity`` of ``parts(part_kind, identity, gender)``, each once; a given name's kind ends with its one gender in the corpus.

    That is the gender it is listed with, else that of most of its mentions, else none.
    """
    votes = F.sum((F.col("gender") == "f").cast("long") - (F.col("gender") == "m").cast("long"))
    known = _gender(F.lit(""), F.col("identity"))
    gender = F.when(known != "", known).when(F.col("votes") > 0, "f").when(F.col("votes") < 0, "m").otherwise("")
    given = F.col("part_kind").startswith("given:")
    return parts.groupBy("part_kind", "identity").agg(votes.alias("votes")).select(
        F.when(given, F.concat("part_kind", F.lit(":"), gender)).otherwise(F.col("part_kind")).alias("kind"), "identity")


def mentions_of(text: Column) -> Column:
    """All mentions in a text, in order. Only texts with an at sign are searched for addresses."""
    return F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(_ANY), 0)).otherwise(F.regexp_extract_all(text, F.lit(_PLAIN), 0))


def genuine(mention: Column) -> Column:
    """Long numbers are card numbers, and groups behind a country accounts, only if their check digits are right; other mentions are taken as found."""
    plain = F.replace(mention, F.lit(" "), F.lit(""))
    account = _mod97(F.concat(plain.substr(F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    return F.when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$"), account).otherwise(~mention.rlike(r"^[3-6][\d \-]{12,22}$") | (_luhn(F.regexp_replace(mention, r"\D", "")) % 10 == 0))


def kind_of(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


KEPT = "kept"  # the kind of a word that is no identity


def name_of(word: Column) -> Column:
    """A name without regard to the case it is written in."""
    return F.initcap(F.lower(word))


def _identified(mentions: DataFrame) -> DataFrame:
    """Add ``kind`` and what a mention consists of: ``prefix`` (kept), ``title``, and ``parts``, its identities as (kind, identity)."""
    m = F.col("mention")
    words = F.split(m, " ", -1)
    titled = m.rlike(rf"^(?:{_TITLE})\.? ")
    names = F.when(titled, F.slice(words, 2, F.size(words))).otherwise(words)
    bare = F.when(titled, F.regexp_replace(words[0], r"\.$", "")).otherwise("")
    prefix = (F.when(F.col("kind") == "secret", F.regexp_extract(m, r"""(?i)^(bearer[ \t]+|[a-z_\-]+["']?[ \t]*[=:][ \t]*["']?)""", 1))
              .when(F.col("kind") == "pem", F.regexp_extract(m, "^(-----BEGIN [A-Z ]*-----)", 1))
              .when((F.col("kind") == "person") & titled, F.concat(words[0], F.lit(" ")))
              .when((F.col("kind") == "phone") & m.startswith("00"), "00").otherwise(""))
    body = m.substr(F.length("prefix") + 1, F.length(m))
    one = lambda kind, identity: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), identity.alias("identity"))
    last = F.size(names) - 1  # the surname; all names before it are given names, but for the words between names, which stay
    person = F.transform(names, lambda x, i: F.when(x.isin(PARTICLES), one(KEPT, x)).otherwise(one(
        F.when(i < last, F.concat(F.lit("given:"), _script(x))).otherwise(F.concat(F.lit("surname:"), _script(x))), name_of(x))))
    digits = F.regexp_replace(body, r"\D", "")
    parts = (F.when(F.col("kind") == "person", person)
             .when(F.col("kind").isin("email", "mac", "ip6"), F.array(one(F.col("kind"), F.lower(m))))
             .when(F.col("kind").isin("phone", "card", "ssn"), F.array(one(F.col("kind"), digits)))
             .when(F.col("kind") == "iban", F.array(one("iban", F.replace(m, F.lit(" "), F.lit("")))))
             .otherwise(F.array(one(F.col("kind"), body))))
    found = mentions.withColumn("kind", kind_of(m)).withColumn("gender", _gender(bare, name_of(names[0])))
    return found.withColumn("prefix", prefix).withColumn("parts", parts)


def _drawn(kind: Column, identity: Column, attempt: int, bits: Column, host: Column) -> Column:
    """The surrogate of an identity at an attempt. Later attempts draw from ever larger sets, so distinct ones are found in the end."""
    extra = max(0, attempt - 5)  # where a format of fixed length runs out, surrogates grow by a sign at each attempt
    tail = lambda letters: F.concat(F.lit(""), *(_at(letters, bits[80 + i % 16]) for i in range(extra)))
    after = lambda text, n: text.substr(n + 1, F.length(text))
    local = F.concat(F.lower(_poured(F.substring_index(identity, "@", 1), bits)), F.lit("." * (attempt > 1)), F.lit(str(attempt) if attempt > 1 else ""))
    email = F.concat(local, F.lit("@"), host, F.lit(".example."), F.element_at(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.pmod(F.hash(host), F.lit(3)) + 1))
    first = F.lit(10) if attempt < 2 else 240 + bits[0] % 15 if attempt < 4 else 1 + bits[0] % 223  # private, then reserved, then any addresses
    ip = F.concat_ws(".", first.cast("string"), *(bits[i].cast("string") for i in (1, 2, 3)))
    if extra:
        ip = F.concat(F.lit("fd"), F.concat_ws(":", *(F.lower(F.hex(bits[2 * i] * 256 + bits[2 * i + 1])) for i in range(4, 12))))
    country = F.when(identity.startswith("1"), F.concat(F.lit("1"), _at("23456789", bits[90]))).otherwise(F.substring(identity, 1, 2))
    phone = F.concat(country, _poured(after(identity, F.length(country)), bits), tail(_LETTERS["digit"]))
    body = F.concat(F.substring(identity, 1, 1), _poured(identity.substr(F.lit(2), F.length(identity) - 2), bits), tail(_LETTERS["digit"]))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    secret = F.concat(_poured(identity, bits, identity.rlike("^[0-9a-f]+$")), tail(_LETTERS["hex"]))
    account = F.concat(F.upper(_poured(after(identity, F.lit(4)), bits)), tail(_LETTERS["digit"]))
    checked = F.lpad((98 - _mod97(F.concat(account, F.substring(identity, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    account = F.concat(F.substring(identity, 1, 2), checked, account)
    hexadecimal = _poured(identity, bits, identity.rlike("."))
    known = F.regexp_extract(identity, "^(AKIA|ghp_|sk-)", 1)
    known = F.concat(known, _poured(after(identity, F.length(known)), bits), tail(_LETTERS["upper"]))
    out = (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "secret", secret)
           .when(kind == "key", known).when(kind == "iban", account).when(kind.isin("mac", "ip6"), hexadecimal).otherwise(F.concat(_poured(identity, bits), tail(_LETTERS["digit"]))))
    pick = lambda names, i: F.element_at(F.array(*(F.lit(x) for x in names)), ((bits[i] * 256 + bits[i + 1]) % len(names)) + 1)
    for script, syllables in SYLLABLES.items():
        parts = [pick(syllables, 2 * i) for i in range(min(3 + attempt, 40))]  # one more syllable at each attempt
        out = F.when(kind == f"surname:{script}", F.initcap(F.concat(*parts))).otherwise(out)
        for gender in ("f", "m", ""):
            names = [n for (s, g), ns in GIVEN.items() if s == script and gender in ("", g) for n in ns]
            parts = [pick(names, 2 * i) for i in range(min(1 + attempt // 2, 40))]  # compound names where single ones run out
            out = F.when(kind == f"given:{script}:{gender}", F.concat_ws("-", *parts)).otherwise(out)
    return out


def assign(identities: DataFrame, key: Column) -> DataFrame:
    """``kind, identity, surrogate`` for different ``identities(kind, identity)``: distinct within a kind, and none an identity itself.

    Every pass draws for the identities that are left and keeps, of each surrogate, the least identity, unless the surrogate is taken or
    occurs as an identity. Given names of different gender or script count as one kind here, and so do writings in small and capital letters.
    """
    family = lambda kind: F.regexp_replace(kind, ":.*$", "")
    all_of = durable(identities.select("kind", "identity").distinct())
    given = all_of.select(family(F.col("kind")).alias("family"), F.lower("identity").alias("low")).distinct()
    left, done, attempt = all_of, None, 0
    while True:
        digits = F.concat(*(_keyed(key, F.col("kind"), F.col("identity"), F.lit(f"{attempt}:{i}")) for i in range(_BYTES // 32)))
        host = F.substring(_keyed(key, F.lit("domain"), F.substring_index("identity", "@", -1)), 1, 8)
        hashed = durable(left.withColumns({"digits": digits, "host": host})).withColumn("bits", _bytes(F.col("digits")))
        drawn = durable(hashed.select("kind", "identity", family(F.col("kind")).alias("family"),
                                      _drawn(F.col("kind"), F.col("identity"), attempt, F.col("bits"), F.col("host")).alias("surrogate")).withColumn("low", F.lower("surrogate")))
        taken = given if done is None else given.unionByName(done.select("family", "low"))
        free = drawn.join(taken, ["family", "low"], "left_anti")
        first = free.groupBy("family", "low").agg(F.min(F.struct("identity", "kind", "surrogate")).alias("w")).select(
            "family", "low", F.col("w.surrogate").alias("surrogate"), F.col("w.identity").alias("identity"), F.col("w.kind").alias("kind"))
        won = durable(first)
        done = won if done is None else done.unionByName(won)
        left = durable(drawn.join(won, ["kind", "identity"], "left_anti").select("kind", "identity"))
        if left.isEmpty():
            return done.select("kind", "identity", "surrogate")
        attempt += 1


def _cased(surrogate: Column, like: Column) -> Column:
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(surrogate)).otherwise(surrogate)


def _rendered(mention: Column, kind: Column, prefix: Column, words: Column, surrogates: Column) -> Column:
    """A mention's replacement: the surrogate in the mention's own format. ``words`` are the words of a person's names."""
    def spaced(signs: str) -> Column:
        body = mention.substr(F.length(prefix) + 1, F.length(mention))
        count = lambda text: F.length(F.regexp_replace(text, f"[^{signs}]", ""))
        chars = F.filter(_chars(body), lambda c: c != "")
        filled = F.transform(chars, lambda c, i: F.when(c.rlike(f"[{signs}]"), F.substring(surrogates[0], count(body.substr(F.lit(1), i + 1)), F.lit(1))).otherwise(c))
        return F.concat(prefix, F.array_join(filled, ""), surrogates[0].substr(count(body) + 1, F.length(surrogates[0])))  # the rest of a grown one
    return (F.when(kind.isin("phone", "card", "ssn"), spaced("0-9")).when(kind == "iban", spaced("0-9A-Z"))
            .when(kind.isin("email", "mac", "ip6"), _cased(surrogates[0], mention))
            .when(kind == "person", F.concat(prefix, F.array_join(F.zip_with(surrogates, words, _cased), " "))).otherwise(F.concat(prefix, surrogates[0])))


def replace(docs: DataFrame, secret_key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``entities`` added, the number of mentions replaced.

    All other columns and rows stay as they are (a column ``entities`` is replaced); a null text stays null with 0 entities. Texts without mentions are not moved: only the
    others are joined with their replacements, one row a mention of each different text, by its position, so a text may be long and full of mentions; it is still one row.
    Where a person is named in a text, single words of that name in the same text are replaced too and counted. Equal keys and corpora give
    equal results. The key enters by a scalar subquery, so it is not part of the plan's text.
    """
    key = docs.sparkSession.createDataFrame([(secret_key,)], "secret_key string").scalar()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col(f"`{text}`").cast("string").alias("_text"))
    found = whole.withColumn("_found", F.coalesce(mentions_of(F.col("_text")), F.array().cast("array<string>")))
    found = found.withColumn("_true", F.filter("_found", genuine))

    def out(rows: DataFrame, entities: Column) -> DataFrame:
        kept = (F.col("_text").alias(c) if c == text else F.col("_doc").getField(c).alias(c) for c in docs.columns if c != "entities")
        return rows.select(*kept, entities.cast("long").alias("entities"))

    row = ["_row", "_row2"]  # two hashes: a text is known by 128 bits
    dirty = found.filter(F.size("_true") > 0).withColumns({"_row": F.xxhash64("_text"), "_row2": F.xxhash64(F.lit(1), "_text")})
    named = F.array_distinct(F.flatten(F.transform(F.filter("_true", lambda m: m.rlike(f"^(?:{PATTERNS['person']})$")), lambda m: F.split(m, " "))))
    alone = F.regexp_extract_all("_text", F.lit(_ANY_OR_BARE), 0)
    # words of the names that stand alone: compared as they are written, so PETER and Peter are two here
    wider = dirty.withColumn("_named", named).withColumn("_alone", F.when(F.size("_named") > 0, alone))
    wider = wider.withColumn("_wide", F.coalesce(F.size(F.array_intersect("_alone", "_named")) > 0, F.lit(False)))
    wider = wider.withColumn("_all", F.when(F.col("_wide"), F.col("_alone")).otherwise(F.col("_found")))
    texts = wider.select(*row, "_all", "_wide").dropDuplicates(row)
    places = durable(texts.select(*row, "_wide", F.posexplode("_all").alias("at", "mention")))
    true = places.filter(genuine(F.col("mention"))).withColumn("kind", kind_of(F.col("mention"))).filter("kind IS NOT NULL")
    mentions = durable(_identified(true.select("mention").distinct()))
    parts = mentions.select("mention", "kind", "prefix", "gender", F.posexplode("parts").alias("at", "part")).select(
        "mention", "kind", "prefix", "gender", "at", F.col("part.kind").alias("part_kind"), F.col("part.identity").alias("identity"))
    assigned = assign(_settled(parts.filter(F.col("part_kind") != KEPT)), key).select(
        F.regexp_replace("kind", "^(given:[a-z]+):.*$", "$1").alias("part_kind"), "identity", "surrogate")
    drawn = durable(parts.join(assigned, ["part_kind", "identity"], "left").withColumn("surrogate", F.coalesce("surrogate", "identity")))
    whole = drawn.groupBy("mention", "kind", "prefix").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("s"))
    words = F.split(F.expr("substring(mention, length(prefix) + 1)"), " ", -1)
    new = durable(whole.select("mention", _rendered(F.col("mention"), F.col("kind"), F.col("prefix"), words, F.transform("s", lambda x: x["surrogate"])).alias("new")))
    people = places.filter("_wide").select(*row, "mention").distinct().join(drawn.filter("kind = 'person'"), "mention")
    people = people.filter(F.col("part_kind") != KEPT).groupBy(*row, "identity").agg(F.max(F.struct("part_kind", "surrogate"))["surrogate"].alias("again"))
    filled = places.join(new, "mention", "left").withColumn("identity", F.when(F.col("_wide") & F.col("new").isNull(), name_of(F.col("mention"))))
    filled = filled.join(people, [*row, "identity"], "left")
    put = F.coalesce("new", _cased(F.col("again"), F.col("mention")), "mention")
    tables = filled.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("at", put.alias("put")))).alias("_put"),
                                      F.count(F.coalesce("new", "again")).alias("_entities"))
    gaps = F.when(F.col("_wide"), F.split("_text", _ANY_OR_BARE, -1)).otherwise(F.split("_text", _ANY, -1))
    fill = F.concat(F.transform("_put", lambda x: x["put"]), F.array(F.lit("")))
    changed = wider.join(tables, row).withColumn("_text", F.array_join(F.zip_with(gaps, fill, lambda a, b: F.concat(a, b)), ""))
    return out(found.filter(F.size("_true") == 0), F.lit(0)).unionByName(out(changed, F.col("_entities")))
