"""Garbled text from wrong character encoding (problem 10).

The garbled sequences of all encoding pairs are computed beforehand and matched with multi-pattern
automata; only matched spans are replaced.  For text written as UTF-8 and read as a single-byte
encoding they are the garbled forms of every character of a repertoire of scripts; pass after pass is
made until nothing matches (each shortens the text; text garbled twice takes two).  Text written in
one single-byte encoding and read in another has no byte structure: its letters become letters of
another alphabet or signs, one for one.  For every such pair the sequences that no sound text holds,
a plain letter beside such a character, are computed; the pair that explains most of the sequences
found on a page is taken, and the words (for signs the lines) that hold them are replaced.  Pairs
under which a letter becomes another Latin letter leave no such sequence and are not told.

Defined results
---------------
* null, empty and blank texts, and texts without garbled spans, are no cases;
* a page in which a replacement character stands has lost characters: restored is the empty string;
* an upper-case letter that meets a hyphen, quote or misread letter and thereby looks like a garbled
  character is left alone unless its line, or all of the page, is garbled for certain;
* very long texts take time in proportion to their length; repeated rows give one result each;
* further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The single-byte encodings in which UTF-8 text may have been read.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "koi8-r", "cp866")
# The single-byte encodings in which Latin text may have been written, and in which it may have been read instead.
WRITTEN_IN = ("cp1252", "cp1250", "cp1254", "cp1257", "mac_roman", "cp437", "cp850", "cp852")
MISREAD_AS = ("cp1251", "koi8-r", "cp866", "cp1253", "cp1252", "cp1250", "mac_roman", "cp437", "cp850")
# The scripts and signs of the repertoire, as ranges of code points.
REPERTOIRE = ((0x80, 0x17F), (0x192, 0x192), (0x218, 0x21B), (0x2C6, 0x2C7), (0x2D8, 0x2DD), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x2010, 0x2044), (0x20AC, 0x20AC), (0x2116, 0x2116), (0x2122, 0x2122), (0x2202, 0x2265), (0x2500, 0x25A1), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF))
LOST = "\ufffd"
# Letters of cp1251 that stand where cp1252 has the signs £, ½ and ¾.
SIGNS_1251 = "ЈЅѕ"
# Signs that may stand for letters of another encoding beside a letter, and those that may only between capitals.
SIGNS, MONEY = "¹³¿", "£"


def byte_table(encoding: str) -> dict[int, str]:
    """Byte to character; bytes that the encoding leaves undefined stand for the control character of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def garbled_forms() -> dict[str, str]:
    """Garbled form to character, over all encodings; a form that stands for two characters keeps the reading of the encoding named first."""
    forms: dict[str, str] = {}
    for encoding in READ_AS:
        table = byte_table(encoding)
        for lo, hi in REPERTOIRE:
            for cp in range(lo, hi + 1):
                form = "".join(table[b] for b in chr(cp).encode())
                forms.setdefault(form, chr(cp))
    return forms


def alphabet(char: str) -> str:
    """The alphabet of a letter, as far as it is told here, else nothing."""
    c = ord(char)
    return "cyrillic" if 0x400 <= c <= 0x4FF else "greek" if 0x370 <= c <= 0x3FF and char.isalpha() else ""


def misread_pairs() -> list[tuple[dict[str, str], dict[str, str], str]]:
    """For every pair of single-byte encodings (character that no Latin word holds to letter or sign, garbled letter to letter, letters that only the right reading has)."""
    out = []
    for written in WRITTEN_IN:
        right = byte_table(written)
        for read in MISREAD_AS:
            wrong = byte_table(read)
            moved = {wrong[b]: right[b] for b in right if wrong[b] != right[b] and not alphabet(right[b])}
            told = {g: c for g, c in moved.items() if alphabet(g) or g in SIGNS + MONEY}
            if read != written and any(c.isalpha() for c in told.values()):
                known = set(wrong.values())
                out.append((told, told if any(map(alphabet, told)) else {g: c for g, c in moved.items() if c.isalpha()}, "".join(sorted(c for c in moved.values() if c.isalpha() and c not in known))))
    return out


ASCII_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CAPITALS = ASCII_LETTERS[26:]


def impossible_forms(pairs: list[tuple[dict[str, str], dict[str, str], str]]) -> dict[str, tuple[int, ...]]:
    """Sequence that no sound text holds to the pairs it may come from: those under which the letter has the case of the plain one beside it."""
    forms: dict[str, list[int]] = {}
    for k, (told, *_) in enumerate(pairs):
        for g, c in told.items():
            if not c.isalpha() and not (alphabet(g) and c in "£½¼¾"):
                continue
            beside = [a + g + z for a in CAPITALS for z in CAPITALS] if g in MONEY else [a + g for a in ASCII_LETTERS if a.isupper() or not c.isupper()] + [g + a for a in ASCII_LETTERS if a.islower() or not c.islower()]
            beside += [g + h for h in SIGNS if g in SIGNS and h in told]
            for form in beside:
                forms.setdefault(form, []).append(k)
    return {form: tuple(ks) for form, ks in forms.items()}


class Restorer:
    """Restores texts; built once per Python worker."""

    def __init__(self) -> None:
        import ahocorasick

        self.forms = garbled_forms()
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(form, form)
        self.automaton.make_automaton()
        self.leads = re.compile("[" + "".join(sorted({re.escape(f[0]) for f in self.forms})) + "]")
        self.pairs = misread_pairs()
        self.misread = ahocorasick.Automaton()
        for form, ks in impossible_forms(self.pairs).items():
            self.misread.add_word(form, (len(form), ks))
        self.misread.make_automaton()
        self.tables = [str.maketrans(table) for _, table, _ in self.pairs]
        self.own = [re.compile(f"[{own}]") if own else None for *_, own in self.pairs]
        letters = "A-Za-zÀ-ÖØ-öø-ſ"
        other = "Ѐ-ӿͰ-Ͽ"
        self.word = re.compile(f"[{other}{letters}]+")
        self.run = re.compile(f"[{other}]{{3}}")
        self.lone = re.compile(f"(?<![{other}{letters}])[{other}](?![{other}{letters}])")
        self.signs_beyond = re.compile(r"[^\x00-\x7f]")
        self.any_other = re.compile(f"[{other}]")
        self.strange = re.compile(f"[{other}{SIGNS}{MONEY}]")

    def _spans(self, text: str) -> list[tuple[int, int, str]]:
        """Leftmost longest garbled spans."""
        best: dict[int, int] = {}
        for end, form in self.automaton.iter(text):
            start = end - len(form) + 1
            if best.get(start, 0) < end + 1:
                best[start] = end + 1
        out, at = [], 0
        for start in sorted(best):
            if start >= at:
                at = best[start]
                out.append((start, at, self.forms[text[start:at]]))
        return out

    @staticmethod
    def _doubtful(text: str, start: int, end: int, char: str) -> bool:
        """An upper-case letter behind another one whose span gives no upper-case letter and no word goes on: rather a capital before a hyphen, a quote or a misread letter."""
        return end - start == 2 and text[start].isupper() and start > 0 and text[start - 1].isupper() and not char.isupper() and not (char.isalpha() and text[end : end + 1].islower())

    def _utf8(self, text: str) -> str:
        while self.leads.search(text):
            spans = [(a, b, c, self._doubtful(text, a, b, c)) for a, b, c in self._spans(text)]
            if any(d for *_, d in spans):
                certain = [s for s in spans if not s[3]]
                sound = len(self.signs_beyond.findall(text)) - sum(len(self.signs_beyond.findall(text[a:b])) for a, b, *_ in spans)
                lines = {text.count("\n", 0, a) for a, *_ in certain}
                spans = [s for s in spans if not s[3] or (certain and (not sound or text.count("\n", 0, s[0]) in lines))]
            if not spans:
                break
            parts, at = [], 0
            for a, b, c, _d in spans:
                parts += (text[at:a], c)
                at = b
            text = "".join(parts) + text[at:]
        return text

    def _misread(self, text: str) -> str:
        """Text of one single-byte encoding read in another: the pair that explains most of the impossible sequences is undone where they stand."""
        hits = [(end - n + 1, end + 1, ks) for end, (n, ks) in self.misread.iter(text)]
        if not hits and not any(c in text for c in SIGNS_1251):
            return text
        letters = self.any_other.search(text) is not None
        if hits and self.run.search(text):
            # three letters of another alphabet together are rather a word of it that was joined to its neighbour
            joined = [m.span() for m in self.word.finditer(text) if self.run.search(m[0])]
            hits = [h for h in hits if not any(a < h[1] and h[0] < b for a, b in joined)]
        votes = [0] * len(self.pairs)
        for _, _, ks in hits:
            for k in ks:
                votes[k] += 1
        best = max(range(len(votes)), key=lambda k: (votes[k], -k))
        table, own = self.tables[best], self.own[best]
        if any(map(alphabet, self.pairs[best][0])) and letters:
            # letters of another alphabet: the words that hold a sequence, and single letters
            spans = [(a, b) for a, b, ks in hits if best in ks]
            starts, surely = sorted(a for a, _ in spans), bool(spans)
            within = lambda m: (i := bisect_left(starts, m.start())) < len(starts) and starts[i] < m.end()
            text = self.word.sub(lambda m: m[0].translate(table) if surely and within(m) else m[0], text)
            return self._lone(text, surely, table)
        lines, at = [], 0
        marked = {text.count("\n", 0, a) for a, _, ks in hits if best in ks}
        for at, line in enumerate(text.split("\n")):
            # once signs stand for letters on a page they do so on every line, but for those that hold the right letters
            lines.append(line.translate(table) if marked and not (own and own.search(line)) else line)
        return "\n".join(lines)

    def _lone(self, text: str, surely: bool, table: dict[int, str]) -> str:
        """Single letters of another alphabet, unless a broken word of that alphabet goes on."""

        def one(m: re.Match) -> str:
            before = text[: m.start()].rstrip(" \n¬\u00ad-")[-1:]
            after = text[m.end() :][:4].lstrip(" \n¬\u00ad-")[:1]
            if (self.any_other.match(before) and before not in SIGNS_1251) or self.any_other.match(after):
                return m[0]
            return m[0].translate(table) if surely or m[0] in SIGNS_1251 else m[0]

        return self.lone.sub(one, text)

    def __call__(self, text: str | None) -> str | None:
        """The restored text, the empty string if characters were lost, None if the text is sound."""
        if not text or text.isascii():
            return None
        if LOST in text:
            return ""
        new = self._utf8(text)
        if self.strange.search(new):
            new = self._misread(new)
        return None if new == text else new


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    restore = Restorer()
    for b in batches:
        keys, texts = [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            new = restore(text)
            if new is not None:
                keys.append(key)
                texts.append(new)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "restored"])


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, restored) of the garbled pages. One scan, no shuffle; plain ASCII pages do not leave the JVM."""
    pages = documents.select("doc_id", "text").where(F.col("text").rlike("[^\\x00-\\x7f]"))
    return pages.mapInArrow(_restore, "doc_id long, restored string")


def found(documents: DataFrame) -> DataFrame:
    """p10_found."""
    return restored(documents).select("doc_id", F.when(F.col("restored") == "", "").otherwise(F.md5(F.encode("restored", "UTF-8"))).alias("restored_md5"))
