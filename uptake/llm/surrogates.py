"""Personal data replaced by keyed surrogates.

Entities are found by patterns and cut into atoms: an e-mail address into mailbox and
domain, a name into words, a number into its digits.  Every distinct atom of the corpus
gets one surrogate of its own kind, made from a keyed SHA-512:

* digits stay digits, letters stay letters of their script and case, other signs stay; a
  card number that satisfies the Luhn check does so afterwards; octets stay octets; a
  domain keeps its last label; hexadecimal secrets stay hexadecimal;
* words of a name become made-up names of their script, given names with an ending of the
  gender that the title tells.

A name is a title and all capitalised words and initials behind it.  Its words are looked for
in the rest of their text too, so mentions without a title get the same surrogate (kind
``name``); an initial alone is not.

Collision check: if two atoms of a kind would get the same surrogate, or one that is itself
an atom of the corpus, the later one is made anew with the next attempt number, until
there is no clash; from the eighth attempt on surrogates get longer, so this ends.  Equal
atoms have equal surrogates everywhere, whatever the format around them (coreference), and
different ones different surrogates (distinctness).

The patterns start behind a sign that can't belong to them and don't backtrack, so very
long texts cost time in proportion.  Texts without an entity pass straight through; of the
others the matches move, and the text once to meet its surrogates.  Null texts stay null,
empty ones empty, both without entities; repeated rows are rewritten one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lexing import once
from ..plans.stages import materialize

_RUN = r"\p{L}\p{N}._%+-"
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Г-жа|Κυρία"
TITLES_M = "Mr|Herr|Señor|Sr|Monsieur|Г-н|Κύριος"
_WORD = r"\p{Lu}[\p{L}'’-]*+"
_PART = rf" (?!(?:{TITLES_F}|{TITLES_M})(?!\p{{L}}))(?:(?:\p{{Lu}}\.)++(?:-?\p{{Lu}}\.)*+|(?:Dr|Prof)\.|{_WORD})"

#: Kind and pattern; the first that fits a match names its kind.
PATTERNS = (
    ("email", rf"(?<![{_RUN}])[{_RUN}]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{{2,}}+"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("card", r"(?<![\p{L}\d])\d{4}(?:[ -]?\d{4}){3}(?![\p{L}\d])"),
    ("card", r"(?<![\p{L}\d])3\d{3}[ -]?\d{6}[ -]?\d{4,5}(?![\p{L}\d])"),
    ("phone", r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"),
    ("phone", r"(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("phone", r"(?<![\p{L}\d+])(?:\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\p{L}\d])"),
    ("phone", r"(?<![\p{L}\d+])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\p{L}\d])"),
    ("ssn", r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("iban", r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"),
    ("secret", r"(?<![\p{L}\d])[0-9a-fA-F]{32,}+(?![\p{L}\d])"),
    ("secret", r"(?<![\p{L}\d])(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}+"),
    ("name_f", rf"(?<!\p{{L}})(?:{TITLES_F})\.?(?:{_PART})++"),
    ("name_m", rf"(?<!\p{{L}})(?:{TITLES_M})\.?(?:{_PART})++"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
NAMES = "|".join(f"(?:{p})" for kind, p in PATTERNS if kind.startswith("name"))
TITLED = ("name_f", "name_m")

#: Letters of made-up words by script: pattern, letters, syllables, endings of given names (f, m).
SCRIPTS = (
    ("[\\p{IsCyrillic}]", "абвгдежзиклмнопрстуфхцчшюя", "ба ве ги до лу ма не ри со та ву зи ко ле па ре", "а", "н"),
    ("[\\p{IsGreek}]", "αβγδεζηθικλμνξοπρστυφχψω", "βα γε δι λο μα νε ρι σο τα θυ κι λε πα ρε ζω φι", "α", "ς"),
    ("[\\p{L}]", "abcdefghijklmnopqrstuvwxyz", "ba ve gi do lu ma ne ri so ta fu zi ko le pa re", "a", "n"),
)
FREE = 8


def _kind(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _atoms(kind: Column, match: Column) -> Column:
    """The atoms of a match as structs (kind, atom)."""
    atom = lambda k, a: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), a.alias("atom"))
    words = F.split(F.regexp_replace(match, r"^\S+ ", ""), " ")
    given = F.when(kind == "name_f", "given_f").otherwise("given_m")
    named = F.transform(words, lambda w, i: atom(F.when(i < F.size(words) - 1, given).otherwise("family"), w))
    return (F.when(kind == "email", F.array(atom("mailbox", F.substring_index(match, "@", 1)), atom("domain", F.substring_index(match, "@", -1))))
            .when(kind.isin("card", "phone", "ssn"), F.array(atom(kind, _digits(match))))
            .when(kind.isin(*TITLED), named)
            .otherwise(F.array(atom(kind, match))))


def _rebuilt(kind: Column, match: Column, parts: Column) -> Column:
    """The match with its atoms' surrogates, in the match's own format."""
    number = F.get(parts, F.lit(0))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(a: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(a["out"], F.when(digit, F.substring(number, a["at"], F.lit(1))).otherwise(c)).alias("out"),
                        (a["at"] + digit.cast("int")).alias("at"))

    formatted = F.aggregate(F.split(match, ""), start, put, lambda a: F.concat(a["out"], F.substring(number, a["at"], F.length(number))))
    title = F.regexp_extract(match, r"^(\S+ )", 1)
    return (F.when(kind == "email", F.concat_ws("@", parts))
            .when(kind.isin("card", "phone", "ssn"), formatted)
            .when(kind.isin(*TITLED), F.concat(title, F.array_join(parts, " ")))
            .otherwise(number))


def _byte(h: Column, i: Column) -> Column:
    """A number from the hash for place ``i``; places beyond its 64 bytes use them shifted."""
    return F.conv(F.substring(h, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int") + 5 * F.floor(i / 64).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _masked(text: Column, h: Column, keep: int = 0) -> Column:
    """Every letter and digit replaced by one of its script, case and kind; the first ``keep`` signs stay."""
    def one(c: Column, i: Column) -> Column:
        n = _byte(h, i)
        out = F.when(c.rlike("^[0-9]$"), _pick("0123456789", n))
        for pattern, letters, *_ in SCRIPTS:
            small = _pick(letters, n)
            out = out.when(c.rlike(f"^{pattern}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(small)).otherwise(small))
        out = out.otherwise(c)
        return F.when(i < keep, c).otherwise(out) if keep else out
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a number."""
    def add(a: Column, c: Column) -> Column:
        d = c.cast("int") * (1 + a["odd"])
        return F.struct((a["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum"), (1 - a["odd"]).alias("odd"))
    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("odd")), add, lambda a: F.pmod(a["sum"], F.lit(10)))


def _card(atom: Column, h: Column) -> Column:
    made = _masked(atom, h, 1)
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    return F.when(_luhn(atom) == 0, F.concat(body, check.cast("string"))).otherwise(made)


def _taken(table: Column, places: Column) -> Column:
    return F.transform(places, lambda n: F.get(table, n))


def _name(kind: Column, atom: Column, h: Column, attempt: Column) -> Column:
    made = F.lit(None).cast("string")
    for pattern, _, syllables, female, male in reversed(SCRIPTS):
        table = F.array(*(F.lit(s) for s in syllables.split()))
        count = 2 + F.pmod(_byte(h, F.lit(40)), F.lit(2)) + F.floor(attempt / 2).cast("int")
        picks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.pmod(_byte(h, i), F.lit(16)))
        body = F.array_join(_taken(table, picks), "")
        ending = F.when(kind == "given_f", female).when(kind == "given_m", male).otherwise("")
        body = F.when(kind == "given_f", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
        made = F.when(atom.rlike(f"^{pattern}"), F.initcap(F.concat(body, ending))).otherwise(made)
    return made


def surrogate(kind: Column, atom: Column, attempt: Column, key: str) -> Column:
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, atom, attempt.cast("string")), 512)
    label = F.substring_index(atom, ".", -1)
    host = F.substring(atom, F.lit(1), F.length(atom) - F.length(label))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(_byte(h, i), F.lit(254))).cast("string")), ".")
    small = F.array_join(F.transform(F.split(atom, ""), lambda c, i: _pick("0123456789abcdef", _byte(h, i))), "")
    hexadecimal = F.when(atom.rlike("[A-F]") & ~atom.rlike("[a-f]"), F.upper(small)).otherwise(small)
    longer = F.when(attempt >= FREE, F.substring(F.translate(h, "abcdef", "012345"), F.lit(1), attempt - FREE + 1)).otherwise("")
    return (F.when(kind == "mailbox", F.concat(_masked(atom, h), longer))
            .when(kind == "domain", F.concat(_masked(host, h), label))
            .when(kind == "ip", octets)
            .when(kind == "card", F.concat(_card(atom, h), longer))
            .when(kind.isin("phone", "ssn"), F.concat(_masked(atom, h, 1), longer))
            .when(kind == "iban", F.concat(_masked(atom, h, 2), longer))
            .when((kind == "secret") & atom.rlike("^[0-9a-fA-F]+$"), F.concat(hexadecimal, longer))
            .when(kind == "secret", F.concat(_masked(atom, h, 4), longer))
            .otherwise(_name(kind, atom, h, attempt)))


def assign(atoms: DataFrame, key: str) -> DataFrame:
    """(kind, atom, made): a surrogate for each distinct atom, distinct within its kind."""
    make = surrogate(F.col("kind"), F.col("atom"), F.col("attempt"), key)
    real = materialize(atoms.select("kind", "atom").distinct())
    now = materialize(real.withColumn("attempt", F.lit(0)).withColumn("made", make))
    while True:
        owner = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "atom")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = owner.join(real.select("kind", F.col("atom").alias("made"), F.lit(True).alias("real")), ["kind", "made"], "left")
        clashing = taken.filter((F.col("n") > 1) | F.col("real")).select("kind", "made", "first", "real")
        again = materialize(now.join(clashing, ["kind", "made"]).filter(F.col("real") | (F.col("atom") != F.col("first.atom")))
                            .select("kind", "atom", (F.col("attempt") + 1).alias("attempt")))
        if not again.limit(1).count():
            return now.select("kind", "atom", "made")
        now = materialize(now.join(again, ["kind", "atom"], "left_anti").unionByName(again.withColumn("made", make)))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, text with surrogates, n_entities, kinds (distinct, sorted, comma-joined)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    some = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    plain = rows.filter(~some).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    titled = F.filter(F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)), lambda m: m != "")
    known = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(titled, lambda m: _atoms(_kind(m), m))), lambda a: a["atom"].rlike(f"^{_WORD}$") & (F.length(a["atom"]) > 1))))
    named = once(rows.filter(some), names=F.when(F.col("text").rlike(NAMES), known).otherwise(F.array().cast("array<struct<kind:string,atom:string>>")))
    # words of the text's own names, the longest first
    longest = F.reverse(F.array_sort(F.array_distinct(F.transform("names", lambda a: F.struct(F.length(a["atom"]).alias("n"), a["atom"].alias("atom"))))))
    again = F.concat(F.lit(ANY + r"|(?<!\p{L})(?=\p{Lu})(?:"), F.array_join(F.transform(longest, lambda a: a["atom"]), "|"), F.lit(r")(?!\p{L})"))
    named = once(named, pattern=F.when(F.size("names") > 0, again).otherwise(F.lit(ANY)))
    match = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    found = materialize(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "names", "pattern", match.alias("matches")))

    kinds = F.transform("matches", lambda m: F.struct(F.coalesce(_kind(m), F.lit("name")).alias("kind"), m.alias("match")))
    each = found.select("row", "names", F.posexplode(kinds).alias("at", "m")).select("row", "at", F.col("m.kind").alias("of"), "m.match", F.when(
        F.col("m.kind") == "name", F.slice(F.filter("names", lambda a: a["atom"] == F.col("m.match")), F.lit(1), F.lit(1))).alias("own"))
    each = each.select("row", "at", "of", "match", F.posexplode(F.coalesce("own", _atoms(F.col("of"), F.col("match")))).alias("part", "a"))
    atoms = materialize(each.select("row", "at", "of", "match", "part", "a.kind", "a.atom"))
    made = assign(atoms, key)
    known = atoms.join(made, ["kind", "atom"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "made"))), lambda p: p["made"])
    rebuilt = (known.groupBy("row", "at", "of", "match").agg(parts.alias("parts"))
               .select("row", F.struct("at", F.col("of"), _rebuilt(F.col("of"), F.col("match"), F.col("parts")).alias("out")).alias("hit")))
    per_row = rebuilt.groupBy("row").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    # text between the matches, and what takes their place, in turn
    gaps = F.split("text", F.col("pattern"), -1)
    put = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("hits", i)["out"], F.lit(""))))
    changed = found.join(per_row, "row").select(
        "doc_id", F.array_join(put, "").alias("text"), F.size("hits").cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["of"]))), ",").alias("kinds"))
    return plain.unionByName(changed)
