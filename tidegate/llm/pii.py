"""Personal information inside free text (problem 7).

What a term discloses is estimated from the corpus.  Emails, phone numbers, identity numbers and
streets have a form, which marks them as candidates; where the form alone is ambiguous (nine bare
digits), the words before it decide: the share of identity numbers among all numbers they announce.
Names have no form.  For every word the information that the name columns give about it,
log P(word | name column) / P(word | notes), decides whether it stands for a given name by itself;
for words the name columns do not know, how often names occur together with their left and right
neighbours decides; and a word beside a given name is a surname if its own surprise in the notes,
-log P(word | notes), exceeds the threshold.  Terms beyond the thresholds are taken out and replaced
by a placeholder of their type.

Notes are parted into words once, each distinct note with its number of copies; the table of words
with their neighbours is stored, and all co-occurrences are aggregates over it.  The statistics cover
all rows.  Only words with a share of at least ``SHARE`` of all words are sent to the tasks, so there
are never more than 1 / ``SHARE`` of them, and contexts of a quarter of that share.

Defined results
---------------
* a note that occurs several times counts as often in the statistics;
* null, empty and blank notes have no details; the rest of a note is kept to the letter;
* a detail is reported once per note, as written, without labels; repeated rows each report theirs;
* very long notes are searched whole; empty tables give empty results; further columns are ignored;
* order, ticket, invoice, case, version, serial and batch numbers are not personal.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.cutting import store
from tidegate.operators.badrows import ETL_COLUMNS, classify

#: Words below this share of all words are never sent to the tasks.
SHARE = 1e-4
#: Disclosure of a given name: log ratio between name columns and notes; share of names in a context; share of a word's places that are names', or beside given names for surnames; a common word's least count.
REVEALS, CONTEXT, PLACED, FAMILY, COMMON = 0.0, 0.5, 0.5, 0.8, 12
#: Distinct notes whose details a worker remembers; it changes no result.
REMEMBERED = 20_000

# The shapes of the details that have a form.
_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+'\-]*"
_DOT = r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_AT = r"(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9])(?:{_LOCAL}\s?@\s?[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+|{_LOCAL}(?:{_DOT}{_LOCAL})*(?:{_AT}|\s?@\s?)[A-Za-z0-9\-]+(?:(?:{_DOT}|\.)[A-Za-z0-9\-]+)*{_DOT}[A-Za-z0-9\-]+)", re.I)
_END = r"(?![\w]|[-/.][0-9])"
PHONE = re.compile(
    rf"(?<![\w/#])\+(?=(?:[ .\-]?\(?[0-9]\)?){{10,15}}(?![0-9]))[0-9]{{1,3}}(?:[ .\-]?\(?[0-9]+\)?){{1,6}}{_END}"
    rf"|(?:(?<=ph\.)|(?<![\w/#.\-]))(?:001[ .\-])?(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .\-]?)[0-9]{{3}}[ .\-]?[0-9]{{4}}{_END}"
    rf"|(?:(?<=ph\.)|(?<![\w/#.\-])(?<![0-9] ))[0-9]{{3}}[ .\-][0-9]{{4}}{_END}",
    re.I,
)
ID_NUMBER = re.compile(r"(?<![\w/+\-.])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4}|[0-9]{3}\.[0-9]{2}\.[0-9]{4}|[0-9]{6}/[0-9]{3,4}|(?-i:[A-Z][0-9]{7}[A-Z]|[A-Z]{1,2}[0-9]{6,8}))(?![\w/\-]|\.[0-9])", re.I)
# nine digits without a sign: an identity number or the number of anything else
BARE = re.compile(r"(?<![\w/+\-.#])[0-9]{9}(?![\w/\-]|\.[0-9])")
NUMBER = re.compile(r"(?<![\w/+\-.])[A-Za-z]{0,2}[0-9][0-9/.\-]{2,}[A-Za-z]?(?![\w])")
_BEFORE = re.compile(r"(?:([^\W\d_]+)[\s.,:#/\-]+)?([^\W\d_]+)[.,]?[ :#]{1,2}\Z")
_KIND = r"(?:Road|Rd|Lane|Ln|Street|St|Avenue|Ave|Drive|Dr|Blvd|Boulevard|Close|Court|Ct|Row|Way|Square|Sq|Terrace|Ter|Place|Pl|Crescent|Gardens|Hill|Park|Walk|Mews)"
_CAP = r"(?-i:[A-ZÀ-ÖØ-Þ][\w'’\-]*)"
_OF = r"(?: (?:de la|des|du|de|das|dos|da|do|del|della|de l['’]))?"
STREET = re.compile(
    rf"(?<![\w\-/])[0-9]{{1,5}}[A-Za-z]?,? (?:[^\W\d_][\w'’\-]* ){{1,4}}?{_KIND}\b(?: (?:Blvd|Boulevard|Road|Rd|Lane|Street|St|Avenue|Ave|Drive|Dr|Close|Court|Way|Terrace)\b)?(?:(?<=\bSt)\.)?"
    rf"|(?<![\w\-/])[0-9]{{1,5}}[A-Za-z]?,? (?:rue|avenue|place|chemin|quai|boulevard|via|calle|rua){_OF}(?: {_CAP}(?: {_CAP})?| [^\W\d_]+)"
    rf"|(?<!\w)(?:(?:ul|al)\. [^\W\d_]+|(?:am|an der|auf dem|im) (?:[^\W\d_]+ )?[^\W\d_]+|[^\W\d_]+(?:straße|strasse|str\.|gasse|weg|platz|allee)|(?:rua|calle|via|avenida|plaza|rue){_OF}(?: [^\W\d_]+){{1,2}}),?\s[0-9]{{1,4}}[A-Za-z]?\b",
    re.I,
)
WORD = re.compile(r"[^\W\d_](?:[\w]|['’](?=[^\W\d_]))*")
# Particles inside surnames.
PARTICLES = frozenset(("van", "von", "de", "del", "der", "den", "da", "di", "la", "le", "dos"))


@dataclass
class Disclosure:
    """What the corpus says: given names, common words of the notes, contexts that announce a name."""

    given: frozenset[str] = frozenset()
    doubtful: frozenset[str] = frozenset()
    common: frozenset[str] = frozenset()
    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()
    announce: frozenset[str] = frozenset()


class Token:
    __slots__ = ("text", "start", "end", "low")

    def __init__(self, text: str, start: int, end: int) -> None:
        self.text, self.start, self.end, self.low = text, start, end, text.lower()


def announced(note: str, start: int) -> tuple[str, str]:
    """The two words and the one word before a number, empty where none stands right before it."""
    m = _BEFORE.search(note, max(0, start - 60), start)
    if not m:
        return "", ""
    one = m[2].lower()
    return (f"{m[1].lower()} {one}" if m[1] else f"^ {one}"), one


_DIGIT, _SPELT = re.compile("[0-9]"), re.compile(r"\bdot\b", re.I)


def formed(note: str, announce: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    """Spans of the details that have a form, leftmost first, none overlapping."""
    out: list[tuple[int, int, str]] = []
    digits = _DIGIT.search(note) is not None
    for kind, pattern, asked in (("email", EMAIL, "@" in note or _SPELT.search(note)), ("id_number", ID_NUMBER, digits), ("id_number", BARE, digits and announce), ("phone", PHONE, digits), ("street", STREET, digits)):
        if asked:
            for m in pattern.finditer(note):
                if pattern is BARE and not announce.intersection(announced(note, m.start())):
                    continue
                if all(m.end() <= a or m.start() >= b for a, b, _ in out):
                    out.append((m.start(), m.end(), kind))
    return sorted(out)


def words(note: str, spans: list[tuple[int, int, str]]) -> list[Token]:
    """The words outside of the spans, without a possessive's ending."""
    out, k = [], 0
    for m in WORD.finditer(note):
        start, end = m.span()
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        if end - start > 3 and note[end - 2 : end] in ("'s", "’s", "'S", "’S"):
            end -= 2
        out.append(Token(note[start:end], start, end))
    return out


_BREAK = re.compile(r"[;\n.,!?]| - ")


def joints(note: str, tokens: list[Token], spans: list[tuple[int, int, str]]) -> tuple[list[str], list[str], list[str]]:
    """For each word what parts it from the one before and behind it: # a detail that has a form, ^ the clause's edge, else nothing; and the sign right behind it."""
    starts = [a for a, *_ in spans]

    def between(a: int, b: int) -> str:
        if starts and (k := bisect_left(starts, a)) < len(starts) and starts[k] < b:
            return "#"
        gap = note[a:b]
        if gap == " ":
            return ""
        return "^" if _BREAK.search(gap) and gap != ". " or not gap and a == 0 else ""

    left = [between(tokens[i - 1].end, t.start) if i else ("#" if any(x < t.start for x in starts) else "^") for i, t in enumerate(tokens)]
    right = [between(t.end, tokens[i + 1].start if i + 1 < len(tokens) else len(note)) for i, t in enumerate(tokens)]
    return left, right, [note[t.end : t.end + 1].strip() for t in tokens]


def contexts(note: str, tokens: list[Token], spans: list[tuple[int, int, str]], common: frozenset[str]) -> list[tuple[str, str]]:
    """For each word what stands before it (two words) and behind it (one): a common word itself, ? for any other, or a joint."""
    label = [t.low if t.low in common else "?" for t in tokens]
    left, right, signs = joints(note, tokens, spans)
    out = []
    for i in range(len(tokens)):
        one = left[i] or label[i - 1]
        two = (left[i - 1] or label[i - 2]) if not left[i] else ""
        after = right[i] or (label[i + 1] if i + 1 < len(tokens) else "^")
        out.append((f"{two} {one}".strip(), f"{signs[i]}{after}"))
    return out


def find_names(note: str, spans: list[tuple[int, int, str]], d: Disclosure) -> list[tuple[int, int, str]]:
    tokens = words(note, spans)
    out: list[tuple[int, int, str]] = []
    gap = lambda i: note[tokens[i].end : tokens[i + 1].start] if i + 1 < len(tokens) else "\n"

    def rare(t: Token) -> bool:
        return len(t.low) > 2 and t.low not in d.common and t.low not in d.given and t.low not in PARTICLES

    def surname(i: int) -> int:
        """Index behind a surname that starts at i, or i: particles and one rare word."""
        j = i
        while j < len(tokens) and tokens[j].low in PARTICLES and gap(j) == " ":
            j += 1
        return j + 1 if j < len(tokens) and (rare(tokens[j]) or tokens[j].low in d.given and tokens[j].low not in d.doubtful) else i

    around = contexts(note, tokens, spans, d.common)

    def named(i: int) -> bool:
        """Whether the word stands in a place that is taken by names."""
        return around[i][0] in d.before or around[i][1] in d.after

    i = 0
    while i < len(tokens):
        t = tokens[i]
        end = None
        single = len(t.text) == 1 and t.text.isupper() and note[t.end : t.end + 2] == ". "
        is_given = t.low in d.given
        # Given [Initial.] [particles] Surname
        stranger = rare(t) and t.text[:1].isupper() and gap(i) == " " and rare(tokens[i + 1]) and tokens[i + 1].text[:1].isupper() and (named(i) or named(i + 1))
        if is_given or single or stranger or (rare(t) and named(i)):
            j = i + 1
            if is_given and j < len(tokens) and gap(i) == " " and len(tokens[j].text) == 1 and tokens[j].text.isupper() and note[tokens[j].end : tokens[j].end + 2] == ". ":
                j += 1
            link = gap(j - 1)
            if link == " " or (single and link == ". ") or (j > i + 1 and link == ". "):
                k = surname(j)
                if k > j and not (is_given and tokens[k - 1].low in d.common):
                    end = k
            # Surname, Given [Initial.]
            if end is None and not single and not is_given and gap(i).strip() == "," and gap(i) in (", ", ",") and i + 1 < len(tokens) and (tokens[i + 1].low in d.given or (named(i) and rare(tokens[i + 1]) and tokens[i + 1].text[:1].isupper())):
                end = i + 2
            if end is None and not single and (is_given or t.text[:1].isupper()):
                doubtful = t.low in d.doubtful
                if (is_given and not doubtful) or named(i):
                    end = i + 1
        elif rare(t) and gap(i) in (", ", ",") and i + 1 < len(tokens) and tokens[i + 1].low in d.given and tokens[i + 1].low not in d.doubtful and (t.text[:1].isupper() or t.text.islower() == tokens[i + 1].text.islower()):
            end = i + 2
        elif rare(t) and t.text[:1].isupper() and gap(i) in (", ", ",") and i + 1 < len(tokens) and rare(tokens[i + 1]) and tokens[i + 1].text[:1].isupper() and named(i + 1):
            end = i + 2
        elif t.low in PARTICLES and surname(i) > i and (k := surname(i)) < len(tokens) and gap(k - 1) == ", " and tokens[k].low in d.given:
            end = k + 1
        if end is None:
            i += 1
            continue
        last = tokens[end - 1].end
        if end < len(tokens) and gap(end - 1) == " " and len(tokens[end].text) == 1 and tokens[end].text.isupper() and note[tokens[end].end : tokens[end].end + 1] == "." and note[t.end : t.end + 1] == ",":
            last, end = tokens[end].end + 1, end + 1
        out.append((t.start, last, "name"))
        i = end
    return out


def find_details(note: str | None, d: Disclosure) -> list[tuple[int, int, str]]:
    """All details of a note as (start, end, kind), in order."""
    if not note or not note.strip():
        return []
    spans = formed(note, d.announce)
    return sorted(spans + find_names(note, spans, d))


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street": "[STREET]", "name": "[NAME]"}


def redact(note: str | None, d: Disclosure) -> str | None:
    if note is None:
        return None
    parts, at = [], 0
    for a, b, kind in find_details(note, d):
        parts += (note[at:a], PLACEHOLDERS[kind])
        at = b
    return "".join(parts) + note[at:]


WORDS = "copies long, word array<string>, cap array<boolean>, left array<string>, right array<string>, sign array<string>, gap array<string>, two array<string>, one array<string>, formed array<boolean>"


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(note, copies) to the note's words and numbers: for each word its joints, the sign and the text up to the next one; for each number the words before it."""
    names = [f.split()[0] for f in WORDS.split(", ")]
    kinds = {"cap": pa.bool_(), "formed": pa.bool_()}
    for b in batches:
        flat: dict[str, list] = {n: [] for n in names[1:]}
        ends_w, ends_n = [0], [0]
        for note in b.column(0).to_pylist():
            spans = formed(note)
            tokens = words(note, spans)
            left, right, signs = joints(note, tokens, spans)
            flat["word"] += [t.low for t in tokens]
            flat["cap"] += [t.text[0].isupper() for t in tokens]
            flat["left"] += left
            flat["right"] += right
            flat["sign"] += signs
            if tokens:
                flat["gap"] += [note[t.end : u.start] for t, u in zip(tokens, tokens[1:])]
                flat["gap"].append("")
            if _DIGIT.search(note):
                ids = [(a, True) for a, _, kind in spans if kind == "id_number"]
                others = [(m.start(), False) for m in NUMBER.finditer(note) if not BARE.match(note, m.start()) and all(m.end() <= a or m.start() >= e for a, e, _ in spans)]
                for start, yes in ids + others:
                    two, one = announced(note, start)
                    if one:
                        flat["two"].append(two)
                        flat["one"].append(one)
                        flat["formed"].append(yes)
            ends_w.append(len(flat["word"]))
            ends_n.append(len(flat["one"]))
        lists = [pa.ListArray.from_arrays(pa.array(ends_n if n in ("two", "one", "formed") else ends_w, pa.int32()), pa.array(flat[n], kinds.get(n, pa.string()))) for n in names[1:]]
        yield pa.RecordBatch.from_arrays([b.column(1), *lists], names=names)


def _words(table: DataFrame) -> DataFrame:
    """A row per word of the stored notes, with its neighbours."""
    at = lambda c, i: F.get(F.col(c), i)
    each = F.transform("word", lambda w, i: F.struct(
        w.alias("word"), at("cap", i).alias("cap"), at("word", i - 1).alias("prev"), at("word", i - 2).alias("prev2"), at("word", i + 1).alias("next"),
        at("left", i).alias("left"), F.coalesce(at("left", i - 1), F.lit("")).alias("left_prev"), at("right", i).alias("right"), at("sign", i).alias("sign"),
        ((at("gap", i) == " ") & (i + 1 < F.size("word"))).alias("runs_on"), at("gap", i).isin(", ", ",").alias("lists"), F.coalesce(at("gap", i - 1) == " ", F.lit(False)).alias("ran_on"),
    ))
    return table.select("copies", F.inline(each))


def _flagged(table: DataFrame, common: frozenset[str], given: frozenset[str]) -> DataFrame:
    """Adds what is known about a word and its neighbours, and its contexts as contexts() writes them."""
    spark = table.sparkSession
    known = spark.createDataFrame([(w, w in common, w in given) for w in sorted(common | given)], "w string, common boolean, given boolean")  # at most 1 / SHARE words and the nicknames
    for c in ("word", "prev", "prev2", "next"):
        table = table.join(F.broadcast(known.select(F.col("w").alias(c), F.col("common").alias(f"{c}_common"), F.col("given").alias(f"{c}_given"))), c, "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    label = lambda c: F.when(flag(f"{c}_common"), F.col(c)).otherwise("?")
    one = F.when(F.col("left") != "", F.col("left")).otherwise(label("prev"))
    two = F.when(F.col("left") != "", "").otherwise(F.when(F.col("left_prev") != "", F.col("left_prev")).otherwise(label("prev2")))
    after = F.when(F.col("right") != "", F.col("right")).when(F.col("next").isNull(), "^").otherwise(label("next"))
    return table.select(
        "copies", "word", "cap", "lists", "ran_on",
        flag("word_common").alias("common"), flag("word_given").alias("given"), flag("prev_given").alias("prev_given"), flag("next_given").alias("next_given"),
        (F.col("runs_on") & ~flag("next_common")).alias("goes_on"),
        F.trim(F.concat(two, F.lit(" "), one)).alias("before"), F.concat("sign", after).alias("after"),
    )


def learn(names: DataFrame, nicknames: DataFrame, notes: DataFrame) -> Disclosure:
    """Estimates disclosure from the whole corpus: ``names`` has the column full_name, ``notes`` the column note, without nulls."""
    split = r"[^\p{L}'’]+"
    firm = F.col("full_name").rlike(r"(?i)\b(?:inc|llc|ltd|gmbh|corp|co|sa|holdings|services)\b")
    parts = names.where("full_name is not null").select(firm.alias("firm"), F.explode(F.split(F.lower("full_name"), split)).alias("term")).where(F.length("term") > 2)
    in_names = parts.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if("firm").alias("firms"))
    table = store(notes.groupBy("note").agg(F.count(F.lit(1)).alias("copies")).mapInArrow(_part, WORDS))
    in_notes = table.select("copies", F.explode("word").alias("term")).groupBy("term").agg(F.sum("copies").alias("n"), F.lit(0).cast("bigint").alias("firms"))

    def frequent(df: DataFrame, least: int) -> tuple[dict[str, int], int, dict[str, int]]:
        df = store(df)
        total = df.agg(F.sum("n")).first()[0] or 0
        rows = df.where(F.col("n") >= max(least, SHARE * total)).collect()
        return {r.term: r.n for r in rows}, total, {r.term: r.firms for r in rows}

    name_n, name_total, firms = frequent(in_names, 3)
    note_n, note_total, _ = frequent(in_notes, COMMON)
    nick = {x.lower() for r in nicknames.select("nickname", "given_name").distinct().toLocalIterator() for x in r if x}  # a table of a language's names
    # a surname is spread over few records, a given name over many: given names carry most of the name columns' mass
    least = max(3, name_total * 6e-4)
    given = {w for w, n in name_n.items() if n >= least and firms[w] < least and w not in PARTICLES} | nick
    info = lambda w: math.log((name_n.get(w, 1) / max(name_total, 1)) / (note_n[w] / max(note_total, 1))) if w in note_n else 9.0
    sure = frozenset(w for w in given if w in name_n and info(w) >= REVEALS)
    common = frozenset(w for w in note_n if w not in sure)
    seen = _flagged(_words(table), common, sure)
    seen = store(seen)
    least = max(3, SHARE * note_total / 4)
    family = ~F.col("common") & ~F.col("given")
    sides = F.array(
        F.struct(F.when(family, None).when(F.col("given"), "before name").otherwise("before other").alias("kind"), F.col("before").alias("term")),
        F.struct(F.when(F.col("given") & F.col("goes_on"), None).when(F.col("given") | family & F.col("prev_given"), "after name").otherwise("after other").alias("kind"), F.col("after").alias("term")),
    )
    rows = seen.select("copies", F.explode(sides).alias("x")).where("x.kind is not null").groupBy("x.kind", "x.term").agg(F.sum("copies").alias("n")).where(F.col("n") >= least).collect()
    n = {(r.kind, r.term): r.n for r in rows}
    share = lambda side, c: n.get((f"{side} name", c), 0) / max(1, n.get((f"{side} name", c), 0) + n.get((f"{side} other", c), 0))
    side = lambda s: frozenset(c for k, c in n if k == f"{s} name" and c.strip("^#? ") and share(s, c) >= CONTEXT)
    before, after = side("before"), side("after")
    spark = table.sparkSession
    places = lambda c, items: F.broadcast(spark.createDataFrame([(x,) for x in sorted(items)], f"{c} string").withColumn(f"by_{c}", F.lit(True)))
    placed = seen.where("common").join(places("before", before), "before", "left").join(places("after", after), "after", "left")
    within = F.col("by_before").isNotNull() | F.col("by_after").isNotNull() | F.col("goes_on") & F.col("cap")
    beside = F.col("prev_given") & F.col("ran_on") | F.col("next_given") & F.col("lists")
    at = {r.word: r for r in placed.groupBy("word").agg(F.sum("copies").alias("n"), F.sum(F.when(within, F.col("copies")).otherwise(0)).alias("inside"), F.sum(F.when(beside, F.col("copies")).otherwise(0)).alias("beside")).collect()}
    families = {w for w, r in at.items() if len(w) > 3 and r.n >= 2 and r.beside >= FAMILY * r.n}
    taken = {w for w, r in at.items() if w not in families and len(w) > 2 and r.inside >= PLACED * r.n}
    given |= taken
    doubtful = frozenset(w for w in given if w in common and w not in taken)
    numbers = table.select("copies", F.inline(F.arrays_zip("two", "one", "formed"))).select("copies", "formed", F.explode(F.array("two", "one")).alias("term"))
    told = numbers.groupBy("term").agg(F.sum("copies").alias("n"), F.sum(F.when(F.col("formed"), F.col("copies")).otherwise(0)).alias("ids")).where(F.col("n") >= least).collect()
    announce = {r.term for r in told if r.ids >= CONTEXT * r.n}
    # one word announces identity numbers only if no two words with it say otherwise
    against = {r.term.split(" ")[1] for r in told if " " in r.term and r.term not in announce}
    return Disclosure(frozenset(given), doubtful, frozenset(common - given - families) | doubtful, before, after, frozenset(announce - against))


def loaded_notes(customers: DataFrame, lines: DataFrame) -> DataFrame:
    """(tbl, row_key, note, full_name) of customer_export and of the records of etl_lines that load."""
    cells = classify(lines.select("line_id", "raw_line"), "raw_line").where("`#reason` is null").select(
        F.lit("etl_lines").alias("tbl"), F.col("line_id").alias("row_key"), F.col("`#cells`")[ETL_COLUMNS.index("internal_notes")].alias("note"), F.col("`#cells`")[ETL_COLUMNS.index("full_name")].alias("full_name")
    )
    return customers.select(F.lit("customer_export").alias("tbl"), F.col("rec_id").alias("row_key"), F.col("internal_notes").alias("note"), "full_name").unionByName(cells)


def _tag(d: Disclosure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}  # notes repeat
        for b in batches:
            out: list[tuple] = []
            for tbl, key, note in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = known.get(note)
                if found is None:
                    found = tuple(dict.fromkeys((kind, note[a:e]) for a, e, kind in find_details(note, d)))
                    if len(note) < 500:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[note] = found
                out += ((tbl, key, kind, text) for kind, text in found)
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())], names=["tbl", "row_key", "kind", "found"])

    return run


def _redact(d: Disclosure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([redact(x, d) for x in b.column(2).to_pylist()], pa.string())], names=["tbl", "row_key", "clean"])

    return run


def disclosure(customers: DataFrame, lines: DataFrame, nicknames: DataFrame) -> tuple[DataFrame, Disclosure]:
    notes = loaded_notes(customers, lines)
    return notes, learn(notes.select("full_name"), nicknames, notes.where(F.trim("note") != "").select("note"))


def found(customers: DataFrame, lines: DataFrame, nicknames: DataFrame) -> DataFrame:
    """p7_found: one row per distinct detail of a note."""
    notes, d = disclosure(customers, lines, nicknames)
    return notes.where(F.trim("note") != "").select("tbl", "row_key", "note").mapInArrow(_tag(d), "tbl string, row_key long, kind string, found string")


def redacted(customers: DataFrame, lines: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(tbl, row_key, clean): every note with its details replaced."""
    notes, d = disclosure(customers, lines, nicknames)
    return notes.select("tbl", "row_key", "note").mapInArrow(_redact(d), "tbl string, row_key long, clean string")
