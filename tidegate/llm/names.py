"""Variant spellings of names typed by people (problem 4).

Records are normalised and collapsed into profiles.  A profile counts under its name as written and as its email
spells it.  Pairs come from two places.

Suffix blocking needs no contact: every long word of a name is indexed under its suffixes, the whole word and its
last ``MIN_SUFFIX`` letters, which any longer common suffix ends in.  A suffix alone is common, so each is refined by
the other words of the name: the given names a word may stand for, their initials and beginnings, or all the rest.
Pairs that meet are compared word by word by the ratio of their longest common subsequence, with nicknames,
initials, cut-off and joined words; whether the name alone decides depends on how many people are expected to bear
it by chance, which the corpus tells.

Profiles that share a contact value are compared, all of them: names are grouped, and values of more than ``LIMIT``
names are compared in strips in which word by word only pairs that cannot be accepted are passed over.  What two
profiles share beside the name decides how close it must be.  Links make components, and the components' records
whose names differ as written are the result.

No key is discarded: groups of equal names are linked through their smallest id, so that a key's pairs are
pairs of different names.

Defined results
---------------
* null and blank names are linked to nothing; null or blank contact fields support nothing;
* a contact value used by many different names supports a link only as far as the names agree;
* an email that spells another person's name, of another initial, changes nothing;
* names of one frequent surname and given name are linked without contact only if a contact is missing;
* repeated rows are records of their own and are paired as such; ties cannot arise;
* very long names are compared whole; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache
from hashlib import blake2b
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.cutting import cut, store

#: Letters of an indexed suffix, of a surname that is long whatever its frequency, and of the longest beginning in a key; the names of a contact value that are paired outright; names of a strip of a more common one.
MIN_SUFFIX, LONG, MAX_SUFFIX, LIMIT, STRIP = 6, 8, 24, 40, 1000
#: Letters of a word whose subsequences are found in arrays, and words of a name that are compared there; longer ones are compared one by one.
WORD, WORDS = 63, 5
#: Records of one strip of an entity when its pairs are written out.
HOT = 2000
#: Least ratios of the longest common subsequence: of surnames, of given names, of whole names joined.
SURNAME, GIVEN, JOINED = 0.8, 0.72, 0.86
#: The same of a misspelt word where no contact can be compared, and of a word and its spelling in the email.
MISSPELT, RESPELT = 0.9, 0.8
#: Most people expected to bear a name by chance if names alone decide, and the share of a word that is not frequent.
NAMESAKES, SCARCE = 1.0, 1 / 2000

# Titles, and legal forms of companies.
TITLES = frozenset("mr mrs ms miss dr prof sir jr sr ii iii phd md the".split())
LEGAL = {"inc": "inc", "incorporated": "inc", "llc": "llc", "ltd": "ltd", "limited": "ltd", "gmbh": "gmbh", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "sa": "sa", "ag": "ag", "plc": "plc"}
FORMS = frozenset(LEGAL.values())
DOTTED, WORDLIKE, NO_DIGIT = re.compile(r"\b(?:[a-z]\.){2,}"), re.compile(r"[^\W_]+"), re.compile(r"[^0-9]")
SPECIAL = str.maketrans({"ł": "l", "Ł": "l", "ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "’": "'", "​": "", "﻿": "", "­": ""})


def name_words(name: str | None) -> list[str]:
    """Lower-case words without accents, apostrophes and titles; digits typed for letters are letters again."""
    text = name or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(SPECIAL))
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = DOTTED.sub(lambda m: m[0].replace(".", "") + " ", text.replace("'", "")).replace("gesellschaft mbh", "gmbh")
    out = []
    for w in WORDLIKE.findall(text):
        if not w.isalpha() and not w.isdigit():
            w = w.replace("0", "o").replace("1", "l")
        if w not in TITLES:
            out.append(LEGAL.get(w, w))
    return out


def name_form(name: str | None) -> str:
    """The words that stand for a name: in order of writing for companies, else sorted."""
    words = name_words(name)
    return " ".join(words if any(w in FORMS for w in words) else sorted(words))


def reading(words: str, email: str, nicknames: dict[str, frozenset[str]]) -> str:
    """The name as the email spells it, as far as the email holds it: a misspelt word that a token of its local part
    ends in correctly is replaced, and so is a given name by the whole one beside the surname.  Else the words as they are."""
    tokens = re.findall(r"[^\W\d_]+", email.split("@")[0].split("+")[0])
    ws = words.split()
    if not tokens or len(tokens) > 4 or len(ws) > 8:
        return words
    out = list(ws)
    for i, w in enumerate(ws):
        if len(w) >= 4 and w not in FORMS and not any(w in t for t in tokens):
            ends = {t[-n:] for t in tokens for n in (len(w) - 1, len(w), len(w) + 1) if n == len(t) or len(w) >= MIN_SUFFIX and n < len(t) and n >= MIN_SUFFIX}
            best = max(((lcs_ratio(w, e), e) for e in ends), default=(0, ""))
            if best[0] >= RESPELT:
                out[i] = best[1]
    if not any(w in FORMS for w in ws):
        for w in {w for w in out if len(w) >= MIN_SUFFIX}:
            first = next((t for t in tokens if t != w and len(t) >= 4), "") if w in tokens and len(tokens) == 2 else tokens[0][: -len(w)] if len(tokens) == 1 and tokens[0].endswith(w) and len(tokens[0]) >= len(w) + 4 else ""
            rest = [v for v in out if v != w and v not in PARTICLES]
            if len(first) >= 4 and rest and first not in out:
                x = max(rest, key=len)
                if len(rest) == 1 and x[0] == first[0] or first in nicknames.get(x, ()) or len(x) > 1 and first.startswith(x):
                    out[out.index(x)] = first
                    break
    return words if out == ws else " ".join(out if any(w in FORMS for w in out) else sorted(out))


def email_key(text: str | None) -> str:
    if not text or "@" not in text:
        return ""
    t = re.sub(r"[\s​ <>\"();,]", "", (text or "").lower()).strip(".")
    return t if re.fullmatch(r"[^@]+@[^@]+\.[^@]+", t) else ""


def digits_key(text: str | None, n: int) -> str:
    if not text:
        return ""
    d = NO_DIGIT.sub("", text.split("x")[0])
    if n == 10 and len(d) == 11 and d[0] == "1":
        d = d[1:]
    return d if len(d) == n else ""


def lcs_ratio(a: str, b: str) -> float:
    """2 * |longest common subsequence| / (|a| + |b|), bit-parallel."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - bin(v).count("1")) / (len(a) + len(b))


def _mark(w: str) -> int:
    """A bit for each letter; some letters share one."""
    mark = 0
    for c in w:
        mark |= 1 << (ord(c) & 63)
    return mark


def _inside(short: str, long: str) -> bool:
    """Whether the letters of one word stand in another in their order."""
    rest = iter(long)
    return all(c in rest for c in short)


class Comparer:
    def __init__(self, nicknames: dict[str, frozenset[str]], given: frozenset[str] = frozenset(), sectors: frozenset[str] = frozenset(), shares: dict[str, float] | None = None) -> None:
        """``given``: frequent words of names, which are not misspellings of each other; ``sectors``: those of them that stand
        beside legal forms, which say little about which company it is; ``shares``: the share of names that hold a frequent word."""
        self.nicknames, self.given, self.sectors, self.shares = nicknames, given, sectors, shares or {}
        self.marks = [(k, _mark(k)) for k in self.sectors]
        self.stands_for: dict[str, frozenset[str]] = {}
        self.matched: dict[tuple[str, str], bool] = {}
        self.weights: dict[str, float] = {}

    def trade(self, w: str) -> frozenset[str]:
        """The sector words that a word may stand for: itself, misspelt, cut off or shortened."""
        if w not in self.stands_for:
            if len(self.stands_for) > 100_000:
                self.stands_for.clear()
            n, mark = len(w), _mark(w)
            # letters of one that the other lacks are in no common subsequence
            alike = lambda k, m: 2 * min(n - (mark & ~m).bit_count(), len(k) - (m & ~mark).bit_count()) >= 0.85 * (n + len(k)) - 1e-6 and lcs_ratio(w, k) >= 0.85
            hits = {w} & self.sectors or {k for k, m in self.marks if n > 2 and w[0] == k[0] and _inside(w, k) or n > 4 and alike(k, m)}
            self.stands_for[w] = frozenset(hits)
        return self.stands_for[w]

    def weight(self, w: str) -> float:
        """The share of names with a given name that begins with a word or that it may stand for."""
        if w not in self.weights:
            if len(self.weights) > 100_000:
                self.weights.clear()
            stands = self.nicknames.get(w, frozenset()) | {w}
            self.weights[w] = max(SCARCE, sum(share for k, share in self.shares.items() if k in stands or k.startswith(w)))
        return self.weights[w]

    def split_firm(self, ws: list[str]) -> tuple[list[str], list[frozenset[str]]]:
        """A company's own words and its sectors."""
        ws = [w for w in ws if w not in FORMS]
        trades = [self.trade(w) for w in ws]
        return [w for w, t in zip(ws, trades) if not t], [t for t in trades if t]

    def fits(self, x: str, y: str) -> bool:
        """Whether two given names are the same, or one an initial, a nickname or a beginning of the other."""
        nick = lambda w: self.nicknames.get(w, frozenset((w,)))
        if x == y or nick(x) & nick(y):
            return True
        short, long = sorted((x, y), key=len)
        if len(short) == 1:
            return any(n[0] == short for n in nick(long) | {long})
        if x in self.given and y in self.given and len(short) > 4:
            return False
        return len(short) >= 3 and any(n.startswith(short) for n in nick(long) | {long})

    def alone(self, a: list[str], b: list[str], beside_a: dict[str, int], beside_b: dict[str, int]) -> bool:
        """Whether two names are so rare that they alone make it one person or company, whatever the contacts.

        ``beside``: how many different words stand beside a word in all names.  Times the share of the given name it is how
        many others are expected to be called so by chance; at most ``NAMESAKES`` may be."""
        if any(w in FORMS for w in (*a, *b)) or (self.sectors and any(self.trade(w) for w in a) and any(self.trade(w) for w in b)):
            (own_a, sectors_a), (own_b, sectors_b) = self.split_firm(a), self.split_firm(b)
            if sorted(own_a) != sorted(own_b) or not any(len(w) >= MIN_SUFFIX for w in own_a):
                return False
            if not sectors_a and not sectors_b and not (any(w in FORMS for w in a) and any(w in FORMS for w in b)):
                return False
            apart = max(max(beside_a.get(w, 1), beside_b.get(w, 1)) for w in own_a if len(w) >= MIN_SUFFIX) * max((self.weight(k) for t in (*sectors_a, *sectors_b) for k in t), default=SCARCE)
            return apart <= NAMESAKES and (not sectors_a or not sectors_b or any(x & y for x in sectors_a for y in sectors_b))
        for w in {w for w in a if w in b and len(w) >= MIN_SUFFIX and w not in self.given}:
            rest = [[v for v in ws if v != w and v not in PARTICLES] for ws in (a, b)]
            full = [sorted((v for v in ws if len(v) > 1), key=len, reverse=True) for ws in rest]
            one = [{v for v in ws if len(v) == 1} for ws in rest]
            if not rest[0] or not rest[1]:
                continue
            agree = lambda x, y: not x or not y or bool(x & y)
            if full[0] and full[1]:
                x, y = full[0][0], full[1][0]
                met = self.fits(x, y) and agree(one[0], one[1]) and len(full[0]) == len(full[1])
            elif not full[0] and not full[1]:
                x = y = min(one[0] & one[1], default="")
                met = bool(x) and agree(one[0] - {x}, one[1] - {x})
            else:
                k = 0 if full[1] else 1
                y = full[1 - k][0]
                x = next((v for v in sorted(one[k]) if self.fits(v, y) and agree(one[k] - {v}, one[1 - k])), "")
                met = bool(x)
            if met and max(beside_a.get(w, 1), beside_b.get(w, 1)) * max(self.weight(x), self.weight(y)) <= NAMESAKES:
                return True
        return False

    def given_match(self, a: str, b: str) -> bool:
        """Whether two words may be one given name: equal, initial, nickname, cut off or mistyped."""
        if a == b or (len(a) == 1 or len(b) == 1) and a[:1] == b[:1]:
            return True
        x, y = self.nicknames.get(a, frozenset((a,))), self.nicknames.get(b, frozenset((b,)))
        if x & y or a in y or b in x:
            return True
        if a in self.given and b in self.given and min(len(a), len(b)) > 4:
            return False
        short, long = sorted((a, b), key=len)
        if len(short) >= 2 and long.startswith(short):
            return True
        if lcs_ratio(a, b) >= GIVEN and min(len(a), len(b)) >= 3:
            return True
        # a nickname that is mistyped or cut off itself
        return any(len(n) > 3 and lcs_ratio(n, o) >= 0.85 for n in x | {a} for o in y | {b})

    def may_match(self, a: str, b: str) -> bool:
        """given_match() of words that many names share, remembered."""
        if (a, b) not in self.matched:
            if len(self.matched) > 100_000:
                self.matched.clear()
            self.matched[a, b] = self.given_match(a, b)
        return self.matched[a, b]

    def person(self, a: list[str], b: list[str], exact: bool) -> bool:
        """Whether two names may be one person's; ``exact``: nothing but nicknames and order may differ."""
        full_a, full_b = [w for w in a if len(w) > 1], [w for w in b if len(w) > 1]
        mid_a, mid_b = {w for w in a if len(w) == 1}, {w for w in b if len(w) == 1}
        if not full_a or not full_b:
            return False
        if exact:
            if len(full_a) < 2 or len(full_b) < 2 or (len(full_a) == len(a) - 1 == len(full_b) == len(b) - 1 and mid_a != mid_b):
                return False
            if sorted(full_a) == sorted(full_b):
                return True
            return any(sorted(full_a[:i] + full_a[i + 1 :]) == sorted(full_b[:j] + full_b[j + 1 :]) and (self.nicknames.get(x, frozenset((x,))) & self.nicknames.get(y, frozenset((y,)))) for i, x in enumerate(full_a) for j, y in enumerate(full_b))
        best = max(((lcs_ratio(x, y) if min(len(x), len(y)) >= 4 else float(x == y), len(x) + len(y), i, j) for i, x in enumerate(full_a) for j, y in enumerate(full_b)), key=lambda t: (t[0] >= SURNAME, t[1], t[0]))
        if best[0] >= SURNAME:
            rest_a = [w for k, w in enumerate(full_a) if k != best[2]] or sorted(mid_a)
            rest_b = [w for k, w in enumerate(full_b) if k != best[3]] or sorted(mid_b)
            if not rest_a or not rest_b:
                return False
            rest_a += [w for w in mid_a if w not in rest_a] if len(full_a) == 1 else []
            return any(self.given_match(x, y) for x in rest_a for y in rest_b if x not in PARTICLES and y not in PARTICLES)
        if min(len(full_a), len(full_b)) == 1 and max(len(full_a), len(full_b)) in (2, 3):
            one, more = sorted((full_a, full_b), key=len)
            return any(lcs_ratio(one[0], "".join(p)) >= JOINED for p in permutations(more))
        return len(full_a) == len(full_b) and all(max(lcs_ratio(x, y) for y in full_b) >= GIVEN for x in full_a) and lcs_ratio("".join(full_a), "".join(full_b)) >= JOINED - 0.1

    def shortened(self, a: list[str], b: list[str]) -> bool:
        """Whether a long surname is the same and the given name at most an initial, a nickname or cut off."""
        shared = [w for w in a if w in b and len(w) >= LONG]
        if not shared:
            return False
        rest = [sorted((w for w in ws if w != shared[0] and w not in PARTICLES), key=len, reverse=True) for ws in (a, b)]
        if not rest[0] or not rest[1]:
            return False
        x, y = rest[0][0], rest[1][0]
        if len(x) == 1 or len(y) == 1:
            return x[0] == y[0]
        mid = [{w for w in ws if len(w) == 1} for ws in rest]
        if mid[0] and mid[1] and mid[0] != mid[1]:
            return False
        if x in self.given and y in self.given and min(len(x), len(y)) > 4 and not self.nicknames.get(x, frozenset((x,))) & self.nicknames.get(y, frozenset((y,))):
            return False
        short, long = sorted((x, y), key=len)
        return bool(self.nicknames.get(x, frozenset((x,))) & self.nicknames.get(y, frozenset((y,)))) or (len(short) >= 3 and long.startswith(short))

    def misspelt(self, a: list[str], b: list[str]) -> bool:
        """Whether all is the same but one word, and that ends in the same long suffix and is nearly the same."""
        for x in {w for w in a if len(w) > MIN_SUFFIX - 1 and w not in b}:
            for y in {w for w in b if len(w) > MIN_SUFFIX - 1 and w not in a}:
                rest = [[w for w in ws if w not in (x, y)] for ws in (a, b)]
                if x[-MIN_SUFFIX:] == y[-MIN_SUFFIX:] and any(len(w) > 1 for w in rest[0]) and rest[0] == rest[1] and not (x in self.given and y in self.given) and lcs_ratio(x, y) >= MISSPELT:
                    return True
        return False

    def company(self, a: list[str], b: list[str]) -> bool:
        x, y = ([w for w in ws if w not in FORMS] for ws in (a, b))
        (own_x, sectors_x), (own_y, sectors_y) = self.split_firm(a), self.split_firm(b)
        if own_x and own_y and lcs_ratio(" ".join(own_x), " ".join(own_y)) >= SURNAME and (not sectors_x or not sectors_y or any(s & t for s in sectors_x for t in sectors_y)):
            return True
        # an acronym stands for a company, not for a person's initials
        if not all(any(w in FORMS for w in ws) or sectors for ws, sectors in ((a, sectors_x), (b, sectors_y))):
            return False
        initials = lambda ws: "".join(w[0] for w in ws)
        forms = lambda ws, core: {initials(core), initials(ws)}
        return "".join(x) in forms(b, y) or "".join(y) in forms(a, x) or "".join(a) in forms(b, y) or "".join(b) in forms(a, x)

    def name_keys(self, words: str) -> set[tuple[str, bool]]:
        """(key, reaches) of a name: two names that same() can accept without an equal contact share a key under which not both reach.

        ``w``: the full words with each in turn replaced by the given names it may stand for, which is what person() asks
        for if exact.  ``s``: the longest suffix of a surname, the whole word, refined by the given name beside it, which shorter
        forms (an initial, a beginning) are and longer ones reach, as shortened() and alone() ask.  ``x``: a long word's suffix
        of ``MIN_SUFFIX`` letters, which any longer common suffix ends in, refined by all other words, as misspelt() asks.
        ``o``: a company's own words."""
        ws = words.split()
        stands = lambda w: self.nicknames.get(w, frozenset()) | {w}
        full, keys = [w for w in ws if len(w) > 1], set()
        own, sectors = self.split_firm(ws)
        firm = any(w in FORMS for w in ws)
        if firm or sectors:
            keys |= {(_short(f"o{' '.join(sorted(own))}"), False)} if own else set()
            keys |= {(_short(f"O{words}"), False)} if firm else set()
        if firm:
            return keys
        if len(full) >= 2:
            keys |= {(_short("w" + " ".join(sorted([*full[:i], n, *full[i + 1 :]]))), False) for i, w in enumerate(full) for n in stands(w)}
        for w in {w for w in ws if len(w) >= LONG or len(w) >= MIN_SUFFIX and w not in self.given}:
            rest = [v for v in ws if v != w and v not in PARTICLES]
            x = max(rest, key=len, default="")
            for v in {x} if len(x) > 1 else set(rest):
                keys |= {(_short(f"s{w}|{n[:MAX_SUFFIX]}"), False) for n in stands(v)}
                keys |= {(_short(f"s{w}|{v[:n]}"), True) for n in range(3, min(MAX_SUFFIX, len(v)))}
                keys |= {(_short(f"s{w}|{n[:k]}"), True) for n in stands(v) if len(n) > 1 for k in (1, *range(3, min(MAX_SUFFIX, len(n))))}
            others = " ".join(v for v in ws if v != w)
            if len(others) > 1:
                keys.add((_short(f"x{w[-MIN_SUFFIX:]}|{others}"), False))
        return keys

    def same(self, a: tuple, b: tuple, beside_a: dict[str, int] | None = None, beside_b: dict[str, int] | None = None) -> bool:
        """Profiles are (words, email, phone, ssn); ``beside`` as in alone(), which is not asked without it."""
        wa, wb = a[0].split(), b[0].split()
        if not wa or not wb:
            return False
        email, phone, ssn = (bool(a[k]) and a[k] == b[k] for k in (1, 2, 3))
        if beside_a is not None and self.alone(wa, wb, beside_a, beside_b or {}):
            return True
        org = any(w in FORMS for w in wa), any(w in FORMS for w in wb)
        if any(org):
            return (email or phone or ssn) and self.company(wa, wb) or wa == wb and all(org)
        if email:
            return self.person(wa, wb, False) or lcs_ratio("".join(sorted(wa)), "".join(sorted(wb))) >= 0.55
        if phone or ssn:
            return self.person(wa, wb, False)
        both = bool(a[1] and b[1]), bool(a[2] and b[2])
        if self.person(wa, wb, True):
            initials = [{w for w in ws if len(w) == 1} for ws in (wa, wb)]
            return not all(both) or bool(initials[0]) and initials[0] == initials[1]
        if not both[0] and self.shortened(wa, wb):
            return True
        # contacts that contradict nothing, one side's missing
        present = [(bool(a[k]), bool(b[k])) for k in (1, 2, 3)]
        return not any(map(all, present)) and any(map(any, present)) and self.misspelt(wa, wb)


def _short(key: str) -> str:
    """A key of bounded length."""
    return key if len(key) <= 64 else key[0] + blake2b(key.encode(), digest_size=16).hexdigest()


PARTICLES = frozenset("van von de del der den da di la le".split())


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        name, first, second, ssn = (b.column(i).to_pylist() for i in range(1, 5))
        emails = [email_key(x) or email_key(y) for x, y in zip(first, second)]
        phones = [digits_key(y, 10) or digits_key(x, 10) for x, y in zip(first, second)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([name_form(n) for n in name], pa.string()), pa.array(emails, pa.string()), pa.array(phones, pa.string()), pa.array([digits_key(s, 9) for s in ssn], pa.string())], names=["rec_id", "full_name", "words", "email", "phone", "ssn"])


def _read(nicknames: dict[str, frozenset[str]]):
    """Adds the name as the email spells it to each profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, email = (b.column(k).to_pylist() for k in ("words", "email"))
            yield b.append_column("spelt", pa.array([reading(w, e, nicknames) for w, e in zip(words, email)], pa.string()))

    return run


def _beside(forms: DataFrame) -> DataFrame:
    """(words, beside): for each word of a name how many different words are the longest beside it in all ``forms``; 0 for short words."""
    words = F.split("words", " ")
    at = forms.select("words", F.posexplode(words).alias("pos", "w")).where(F.length("w") >= MIN_SUFFIX)
    others = F.expr("array_max(transform(array_remove(split(words, ' '), w), v -> struct(length(v) as n, v as v)))")
    counts = at.select("w", others["v"].alias("other")).distinct().groupBy("w").agg(F.count("other").cast("int").alias("k"))
    known = at.join(counts, "w").groupBy("words").agg(F.map_from_entries(F.collect_list(F.struct("pos", "k"))).alias("k"))  # as many entries as the name has words
    return known.select("words", F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.coalesce(F.col("k")[i], F.lit(0))).alias("beside"))


@lru_cache(maxsize=200_000)
def _letters(t: str) -> tuple[int, int]:
    """64 bits that hold the first two of each letter, and the number of further ones; some letters share bits."""
    mark, twice, more = 0, 0, 0
    for ch in t:
        bit = 1 << (ord(ch) & 31)
        if not mark & bit:
            mark |= bit
        elif not twice & bit:
            twice |= bit
        else:
            more += 1
    return mark | twice << 32, more


class _Texts:
    """Texts as arrays: their lengths and letters."""

    def __init__(self, texts: list[str]) -> None:
        self.texts, self.n = texts, np.array([len(t) for t in texts], np.int64)
        letters = [_letters(t) for t in texts]
        # numbers of letters of short texts fit into bytes, which many fewer steps go through
        self.kind = np.uint8 if self.n.max(initial=0) <= 100 else np.int64
        self.marks, self.more = np.array([m for m, _ in letters], np.uint64), np.array([k for _, k in letters], np.int64).astype(self.kind)

    def common(self, others: _Texts, least: float) -> Iterator[tuple[int, np.ndarray]]:
        """For each text the others that have letters enough in common for a subsequence ratio of ``least``."""
        needs: dict[int, np.ndarray] = {}
        kind = np.promote_types(self.kind, others.kind)
        more = others.more.astype(kind)
        for i, n in enumerate(self.n.tolist()):
            if n not in needs:
                needs[n] = np.ceil((least * (others.n + n) - 1e-6) / 2).astype(kind)
            yield i, np.flatnonzero(np.bitwise_count(others.marks & self.marks[i]) + np.minimum(more, self.more[i]) >= needs[n])

    def codes(self, letters: dict[str, int]) -> np.ndarray:
        """A row of letters for each text of at most ``WORD`` letters, filled up with one that stands nowhere, as do all others."""
        out = np.full((len(self.texts), int(min(WORD, self.n.max(initial=0)))), len(letters), np.int32)
        for i, t in enumerate(self.texts):
            if len(t) <= WORD:
                out[i, : len(t)] = [letters.get(ch, len(letters)) for ch in t]
        return out


def _alike(left: _Texts, right: _Texts, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, ratios) of all pairs whose subsequence ratio is at least ``least``.

    A pair is passed over only if the two have too few letters in common; the ratio of the others is computed bit-parallel
    in arrays."""
    rows, columns = [], []
    for i, hits in left.common(right, least):
        rows.append(np.full(len(hits), i, np.int32))
        columns.append(hits.astype(np.int32))
    i, k = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (rows, columns))
    ratio = np.empty(len(i))
    letters = {ch: n for n, ch in enumerate(sorted({ch for t in left.texts if len(t) <= WORD for ch in t}))}
    where = np.zeros((len(left.texts), len(letters) + 1), np.uint64)
    for n, t in enumerate(left.texts):
        if len(t) <= WORD:
            for at, ch in enumerate(t):
                where[n, letters[ch]] |= np.uint64(1 << at)
    codes = right.codes(letters)
    short = (left.n[i] <= WORD) & (right.n[k] <= WORD)
    for at in np.flatnonzero(~short):
        ratio[at] = lcs_ratio(left.texts[i[at]], right.texts[k[at]])
    short = np.flatnonzero(short)
    for at in np.array_split(short, len(short) // 65_536 + 1):
        x, y = i[at], k[at]
        v = np.full(len(at), 2**64 - 1, np.uint64)
        for step in range(int(right.n[y].max(initial=0))):
            u = v & where[x, codes[y, step]]
            v = (v + u) | (v - u)
        both = left.n[x] + right.n[y]
        ratio[at] = np.where(both > 0, 2.0 * np.bitwise_count(~v) / np.maximum(both, 1), 1.0)
    kept = ratio >= least
    return i[kept], k[kept], ratio[kept]


class _Names:
    """Names as arrays: the words, and for each name the numbers of its first ``WORDS`` words, filled up with one past the last."""

    def __init__(self, names: list[str]) -> None:
        self.split, self.firm = [n.split() for n in names], None
        self.words = sorted({w for ws in self.split for w in ws})
        at = {w: k for k, w in enumerate(self.words)}
        self.texts, self.length = _Texts(self.words), np.array([len(w) for w in self.words] + [0], np.int32)
        self.full = np.array([sum(len(w) > 1 for w in ws) for ws in self.split], np.int32)
        self.org = np.array([any(w in FORMS for w in ws) for ws in self.split], bool)
        self.many = np.array([len(ws) > WORDS for ws in self.split], bool)
        self.at = np.full((len(names), WORDS), len(self.words), np.int32)
        pairs = []
        for i, ws in enumerate(self.split):
            for p, w in enumerate(ws):
                if p < WORDS:
                    self.at[i, p] = at[w]
                pairs.append((at[w], i, p))
        found = np.array(sorted(pairs), np.int32).reshape(-1, 3)
        self.name, self.place = found[:, 1], found[:, 2]
        self.start = np.searchsorted(found[:, 0], np.arange(len(self.words) + 1))

    @cached_property
    def rest(self) -> np.ndarray:
        """Which words may stand beside a surname: the full ones of several, else initials."""
        n = self.length[self.at]
        return np.where(self.full[:, None] > 1, n > 1, n == 1)

    @cached_property
    def joined(self) -> list[tuple[np.ndarray, _Texts]]:
        """(names, their full words joined) of those with one full word, and of those with two or three."""
        which = [np.flatnonzero(self.full == 1), np.flatnonzero((self.full == 2) | (self.full == 3))]
        return [(ks, _Texts(["".join(w for w in self.split[k] if len(w) > 1) for k in ks])) for ks in which]

    def firms(self, compare: Comparer) -> tuple[list[str], list[set[str]], list[set[str]]]:
        """Of each name as a company's: its own words, its initials and its words joined."""
        if self.firm is None:
            split = [[w for w in ws if w not in FORMS] for ws in self.split]
            initials = lambda ws: "".join(w[0] for w in ws)
            self.firm = [" ".join(compare.split_firm(ws)[0]) for ws in split], [{initials(ws), initials(n)} for ws, n in zip(split, self.split)], [{"".join(ws), "".join(n)} for ws, n in zip(split, self.split)]
        return self.firm

    def begin(self, w: str) -> slice:
        """The words that begin so."""
        return slice(bisect_left(self.words, w), bisect_left(self.words, w + chr(0x10FFFF)))


def _pairs(left: _Names, right: _Names, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """(which pair, left name, its word's place, right name, its word's place) for all names that hold the words of pairs (x, y)."""
    n, m = left.start[x + 1] - left.start[x], right.start[y + 1] - right.start[y]
    which = np.repeat(np.arange(len(x)), n * m)
    rest = np.arange(len(which)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    a, b = left.start[x[which]] + rest // m[which], right.start[y[which]] + rest % m[which]
    return which, left.name[a], left.place[a], right.name[b], right.place[b]


def near(left: list[str], right: list[str], compare: Comparer) -> np.ndarray:
    """Whether person() or company() can accept the name of a row and that of a column: no pair that they accept is left out."""
    return _near(_Names(left), _Names(right), compare)


def _near(a: _Names, b: _Names, compare: Comparer) -> np.ndarray:
    out = np.zeros((len(a.split), len(b.split)), bool)
    if not out.size:
        return out
    x, y, ratio = _alike(a.texts, b.texts, min(GIVEN, SURNAME))
    # word by word, a row and a column of False at the end: alike, and what given_match() may accept
    alike = np.zeros((len(a.words) + 1, len(b.words) + 1), bool)
    alike[x[ratio >= GIVEN], y[ratio >= GIVEN]] = True
    given = alike.copy()
    for k, w in enumerate(a.words):
        given[k, b.begin(w)] = True
    for k, w in enumerate(b.words):
        given[a.begin(w), k] = True
    known = [[k for k, w in enumerate(side.words) if w in compare.nicknames] for side in (a, b)]
    for one, two, ks, table in ((a, b, known[0], given), (b, a, known[1], given.T)):
        stands = [(k, n) for k in ks for n in compare.nicknames[one.words[k]]]
        n, m, _ = _alike(_Texts([n for _, n in stands]), two.texts, 0.85)
        table[np.array([k for k, _ in stands], int)[n], m] = True
    few = len(known[0]) * len(known[1]) <= 40_000
    for k in known[0]:
        for m in known[1]:
            given[k, m] = not few or compare.may_match(a.words[k], b.words[m])
    given[[k for k, w in enumerate(a.words) if w in PARTICLES]] = False
    given[:, [k for k, w in enumerate(b.words) if w in PARTICLES]] = False
    # a word of each side agrees; two lines of a table may name a pair again
    which, i, p, j, q = _pairs(a, b, x, y)
    shorter = np.minimum(a.length[x], b.length[y])
    surname = (shorter > 1) & ((ratio == 1) | (ratio >= SURNAME) & (shorter >= 4))
    at = np.flatnonzero(surname[which])
    beside = a.many[i[at]] | b.many[j[at]]
    for s in range(WORDS):
        for t in range(WORDS):
            beside |= (p[at] != s) & (q[at] != t) & a.rest[i[at], s] & b.rest[j[at], t] & given[a.at[i[at], s], b.at[j[at], t]]
    out[i[at][beside], j[at][beside]] = True
    # every word of one side is alike one of the other
    at = np.flatnonzero((ratio >= GIVEN)[which] & (a.full[i] == b.full[j]))
    for one, two, i_, j_, table in ((a, b, i[at], j[at], alike), (b, a, j[at], i[at], alike.T)):
        every = np.ones(len(at), bool)
        for s in range(WORDS):
            hit = one.length[one.at[i_, s]] <= 1
            for t in range(WORDS):
                hit |= table[one.at[i_, s], two.at[j_, t]]
            every &= hit
        every |= one.many[i_] | two.many[j_]
        out[i[at][every], j[at][every]] = True
    # one word against several joined
    for (rows, some), (columns, others) in ((a.joined[0], b.joined[1]), (a.joined[1], b.joined[0])):
        for k, hits in some.common(others, JOINED):
            out[rows[k], columns[hits]] = True
    out &= ~(a.org[:, None] | b.org)  # companies are compared by company()
    if a.org.any() or b.org.any():
        own, forms, wholes = zip(a.firms(compare), b.firms(compare))
        for rows, columns in ((a.org, np.ones(len(b.org), bool)), (~a.org, b.org)):
            r, c = (np.array([k for k in np.flatnonzero(ks) if texts[k]], int) for ks, texts in zip((rows, columns), own))
            k, m, _ = _alike(*(_Texts([texts[n] for n in ns]) for texts, ns in zip(own, (r, c))), SURNAME)
            out[r[k], c[m]] = True
        for mine, theirs in ((forms[0], wholes[1]), (wholes[0], forms[1])):
            where: dict[str, list[int]] = {}
            for j, texts in enumerate(theirs):
                for t in texts:
                    where.setdefault(t, []).append(j)
            for i, texts in enumerate(mine):
                for t in texts:
                    out[i, where.get(t, [])] = True
    return out


def _spread(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links (key, a, b) between the smallest profiles of groups, for all members (key, least, pid) of the groups: those of linked groups to the smallest of the other."""
    both = links.unionByName(links.select("key", F.col("b").alias("a"), F.col("a").alias("b"))).withColumnRenamed("a", "least")
    spread = members.where("pid <> least").join(both, ["key", "least"]).select(F.least("pid", "b").alias("a"), F.greatest("pid", "b").alias("b"))
    return links.select("a", "b").unionByName(spread).where("a <> b").distinct()


def link_contacts(profiles: DataFrame, comparer, limit: int) -> DataFrame:
    """(a, b): links between profiles of one email, phone or ssn.

    Profiles of one value and name are one group.  All names of a value are compared; those of a value of more than
    ``limit`` names in strips of ``STRIP`` against the half of the others that follow in a circle, where word by word the
    pairs that no comparison can accept are passed over.  No value is left out, however common."""
    contact = F.array(*(F.when(F.col(c) != "", F.concat(F.lit(c[0]), F.col(c))) for c in ("email", "phone", "ssn")))
    values = profiles.select("pid", "words", F.explode(contact).alias("key")).where("key is not null")
    groups = values.groupBy("key", "words").agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("most")).where("k > 1 or most > 1")
    keyed = cut(groups.join(sizes, "key"))

    def accepts(compare: Comparer, key: str, wa: str, wb: str) -> bool:
        contacts = [key if key[0] == c else "" for c in "eps"]
        return compare.same((wa, *contacts), (wb, *contacts))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = comparer()
        for b in batches:
            hits = [(key, x, y) for key, x, wx, y, wy in zip(*(b.column(i).to_pylist() for i in range(5))) if accepts(compare, key, wx, wy)]
            if hits:
                yield _links(hits)

    def strip(t: pa.Table) -> pa.Table:
        compare, key = comparer(), t.column("key")[0].as_py()
        rows = list(zip(*(t.column(c).to_pylist() for c in ("pid", "words", "first"))))
        left, right, hits = [r for r in rows if r[2]], [r for r in rows if not r[2]], []
        own, names = {r[0] for r in left}, _Names([r[1] for r in left])
        for k in range(0, len(right), 2048):
            part = right[k : k + 2048]
            every = np.ones((len(left), len(part)), bool) if key[0] == "e" else _near(names, _Names([r[1] for r in part]), compare)
            for i, j in np.argwhere(every):
                a, b = sorted((left[i][:2], part[j][:2]))
                if (left[i][0] < part[j][0] or part[j][0] not in own) and accepts(compare, key, a[1], b[1]):
                    hits.append((key, a[0], b[0]))
        return pa.Table.from_batches([_links(hits)])

    side = lambda df, s: df.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("pid", "words")))
    few = keyed.where(F.col("k") <= limit)
    pairs = side(few, "a").join(side(few, "b"), "key").where("pid_a < pid_b")
    own = keyed.where("n > 1").select("key", F.col("pid").alias("pid_a"), F.col("words").alias("words_a"), F.col("pid").alias("pid_b"), F.col("words").alias("words_b"))
    strips = F.ceil(F.col("k") / STRIP)
    hot = keyed.where(F.col("k") > limit)
    dealt = hot.select("key", "pid", "words", strips.alias("strips"), F.pmod(F.xxhash64("words"), strips).alias("strip"))
    # in a circle every two strips are at most half of it apart, one way or the other
    others = dealt.select("key", "pid", "words", "strips", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("strips") / 2))).alias("back"), "strip")
    others = others.select("key", "pid", "words", F.lit(False).alias("first"), F.pmod(F.col("strip") - F.col("back"), "strips").alias("strip"))
    # as many partitions as named: a strip is few bytes but long work, and small ones would be put together
    parts = int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "pid", "words", F.lit(True).alias("first"), "strip").unionByName(others).repartition(parts, "key", "strip")
    schema = "key string, a long, b long"
    links = cut(pairs.unionByName(own).mapInArrow(decide, schema).unionByName(dealt.groupBy("key", "strip").applyInArrow(strip, schema)))
    members = values.join(keyed.where("n > 1").select("key", "words", F.col("pid").alias("least")), ["key", "words"]).select("key", "least", "pid")
    return _spread(links, members)


def _links(hits: list[tuple]) -> pa.RecordBatch:
    key, a, b = zip(*hits) if hits else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])


def link_names(profiles: DataFrame, comparer) -> DataFrame:
    """(a, b): links that need no equal contact.

    They depend on the words, on how rare these are and on which contacts are present only, so profiles equal in these are
    one class with its smallest id.  A profile whose email spells its name otherwise belongs to the class of that spelling
    too.  Classes that are linked are linked through these ids: every profile to the smallest of each other class, which
    gives the components of all pairs.  No class and no key is left out, however common.  A pair is compared where it
    meets and only its links are shuffled."""
    flags = [(F.col(c) != "").alias(f"has_{c}") for c in ("email", "phone", "ssn")]
    flagged = profiles.select("pid", F.explode(F.array_distinct(F.array("words", "spelt"))).alias("words"), *flags)
    same = ["words", "has_email", "has_phone", "has_ssn"]
    sizes = cut(flagged.groupBy(*same).agg(F.min("pid").alias("pid"), F.count(F.lit(1)).alias("n")))
    classes = cut(sizes.join(_beside(sizes.select("words").distinct()), "words", "left").select("pid", *same, "n", "beside"))
    fields = ["pid", *same, "beside"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = comparer()
        for b in batches:
            keys, reaches, at = [], [], []
            for i, words in enumerate(b.column(1).to_pylist()):
                for key, r in sorted(compare.name_keys(words)):
                    keys.append(key)
                    reaches.append(r)
                    at.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(reaches, pa.bool_())] + [c.take(pa.array(at, pa.int32())) for c in b.columns], names=["key", "reaches", *fields])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = comparer()
        for b in batches:
            hits, seen = [], set()
            for a, wa, ea, pa_, sa, ka, c, wc, ec, pc, sc, kc in zip(*(b.column(i).to_pylist() for i in range(12))):
                if (a, c) in seen:
                    continue
                seen.add((a, c))
                near_a, near_c = (dict(zip(w.split(" "), k or ())) for w, k in ((wa, ka), (wc, kc)))
                if compare.same((wa, "a" * ea, "a" * pa_, "a" * sa), (wc, "b" * ec, "b" * pc, "b" * sc), near_a, near_c):
                    hits.append(("", a, c))
            if hits:
                yield _links(hits)

    keyed = cut(classes.select(*fields).mapInArrow(index, "key string, reaches boolean, pid long, words string, has_email boolean, has_phone boolean, has_ssn boolean, beside array<int>"))
    side = lambda df, s: df.select("key", "reaches", *(F.col(c).alias(f"{c}_{s}") for c in fields))
    met = side(keyed.where("not reaches"), "a").drop("reaches").join(side(keyed, "b"), "key").where("(reaches or pid_a < pid_b) and (pid_a <> pid_b or words_a <> words_b)")
    # a class whose own profiles are not linked to each other is written as a pair with itself and comes back only if they are
    several = classes.where("n > 1")
    both = [f"{c}_{s}" for s in "ab" for c in fields]
    own = several.select(*(F.col(c).alias(f"{c}_{s}") for s in "ab" for c in fields))
    found = "key string, a long, b long"
    links = cut(met.select(*both).mapInArrow(decide, found).unionByName(own.mapInArrow(decide, found)).distinct())
    members = flagged.join(several.select(*same, F.col("pid").alias("least")), same).select(F.lit("").alias("key"), "least", "pid")
    return _spread(links, members)


def profiles_of(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their profile's fields, profiles): ``records`` has rec_id, full_name, email, phone and ssn."""
    normal = records.select("rec_id", "full_name", "email", "phone", "ssn").where("rec_id is not null and full_name is not null").mapInArrow(_normalise, "rec_id long, full_name string, words string, email string, phone string, ssn string").where("words <> ''")
    normal = store(normal)  # read twice
    return normal, normal.groupBy("words", "email", "phone", "ssn").agg(F.min("rec_id").alias("pid")).select("pid", "words", "email", "phone", "ssn")


def _nicknames(nicknames: DataFrame) -> dict[str, frozenset[str]]:
    """The given names a nickname may stand for; a given name stands for itself.  Two columns of a table of names: its size is that of a language, not of the data."""
    nick: dict[str, set[str]] = {}
    for r in nicknames.select("nickname", "given_name").distinct().toLocalIterator():
        for n in name_words(r.nickname)[:1]:
            nick.setdefault(n, {n}).update(name_words(r.given_name)[:1])
    for n in {g for v in nick.values() for g in v}:
        nick.setdefault(n, {n}).add(n)
    return {k: frozenset(v) for k, v in nick.items()}


def link_profiles(profiles: DataFrame, table: dict[str, frozenset[str]], *, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between profile ids."""
    # words of at least one in two thousand names: at most 2,000 times the words a name has
    n_names = max(1, profiles.count())
    firm = F.arrays_overlap(F.split("words", " "), F.array(*map(F.lit, sorted(FORMS))))
    frequent = profiles.select(firm.alias("firm"), F.explode(F.split("words", " ")).alias("w")).where(F.length("w") > 2).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if("firm").alias("firms")).where(F.col("n") >= max(20, n_names * SCARCE)).collect()
    given = frozenset(r.w for r in frequent if len(r.w) > 3) | frozenset(g for v in table.values() for g in v)
    sectors = frozenset(r.w for r in frequent if 2 * r.firms >= r.n and r.w not in FORMS)
    shares = {r.w: r.n / n_names for r in frequent}

    comparer = lambda: Comparer(table, given, sectors, shares)
    return link_contacts(profiles, comparer, limit).unionByName(link_names(profiles, comparer))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest id of each node's component.

    Every node moves to the smallest node next to it and the edges move along, which keeps what is connected connected,
    until no edge is left: the largest node of a component goes in every round, of a clique or star all nodes but the
    smallest in the first, of a path about half.  The moves are put together from the last to the first."""
    edges = store(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    moves = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        moves.append(move)
        to = lambda c: move.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: B023, E731
        edges = store(edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        if edges.isEmpty():
            break
    roots = moves.pop().withColumnRenamed("to", "root")
    while moves:
        move, last = moves.pop(), roots.select(F.col("node").alias("to"), "root")
        roots = store(move.join(last, "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return roots


def groups(records: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(rec_id, full_name, entity): every record with a name, with the smallest record id of its entity."""
    normal, profiles = profiles_of(records)
    table = _nicknames(nicknames)
    profiles = cut(profiles.mapInArrow(_read(table), "pid long, words string, email string, phone string, ssn string, spelt string"))
    roots = components(link_profiles(profiles, table))
    entity = profiles.join(roots, profiles["pid"] == roots["node"], "left").select("words", "email", "phone", "ssn", F.coalesce("root", "pid").alias("entity"))
    return normal.join(entity, ["words", "email", "phone", "ssn"]).select("rec_id", "full_name", "entity")


def people(customers: DataFrame, showcase: DataFrame) -> DataFrame:
    fields = ("rec_id", "full_name", "email", "phone")
    return customers.select(*fields, "ssn").unionByName(showcase.select(*fields, F.lit(None).cast("string").alias("ssn")))


def found(customers: DataFrame, showcase: DataFrame, nicknames: DataFrame) -> DataFrame:
    """p4_found: all pairs of records of one entity whose names differ as written."""
    g = store(groups(people(customers, showcase), nicknames))
    several = g.groupBy("entity").agg(F.min("full_name").alias("x"), F.max("full_name").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y")
    # the records of an entity of many are dealt to strips, each paired with all of them in a task of its own
    g = cut(g.join(several.select("entity", F.ceil(F.col("n") / HOT).alias("strips")), "entity"))
    side = lambda s: [F.col("rec_id").alias(f"rec_{s}"), F.col("full_name").alias(f"name_{s}")]
    a = g.select("entity", F.pmod(F.xxhash64("rec_id"), "strips").alias("strip"), *side("a"))
    b = g.select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1)).alias("strip"), *side("b"))
    return a.join(b, ["entity", "strip"]).where("rec_a < rec_b and name_a <> name_b").select("rec_a", "rec_b")
