"""One form for texts that look the same.

Tables are computed once, on the driver, by rule: from the Unicode character database the width forms, ligatures, kinds of
space and hyphen, invisible characters and accents; from the confusables data of ICU, which Spark ships, the letters of
other alphabets that look like a Latin letter of the same case. They are bounded by Unicode and broadcast:

* `singles`: a character -> its look, where that is another;
* `clusters`: a letter with accents, in every spelling of one that can be written as a single character (the letter itself
  or one that looks like it, each accent apart or composed with the letter, in any order) -> its look;
* `parts`, `order` and `pairs`: what a character is made of, the class that accents are ordered by, and which two
  characters compose to one. They give the look of the clusters that are in no finite table.

They are checked for conflicts: every look is its own look, no spelling has two, and no two letters of one alphabet and
case have the same. They are compiled into a longest-match transducer: one regular expression whose first branches take a
whole grapheme cluster with its marks, and the next runs of mapped characters, each rewritten by the tables in one pass;
text without such characters is only scanned.

Equality then is equality of a 128-bit digest of the form, so only digests are shuffled.

Defined results: case, accents, digits, words, line breaks, tabs, other punctuation and the number of spaces stay as they
are. Joiners stay where they change what is drawn: in emoji and after letters of scripts that join. Where a text has a
character that turns the direction (like U+202E), its direction marks stay. A null text has a null form. Null texts and
texts without a visible character are in no pair; texts of identical characters are no pair; repeated rows count once;
other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata as u
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactionloom.storage import written

LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HYPHENS = "‐‑﹣"
#: Format characters that are drawn, and characters without any look that are no format characters.
_DRAWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_NOTHING = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)}
#: Direction marks, and those of them that turn text written from left to right.
_DIRECTION, _TURNING = "\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069", "\u202b\u202d\u202e\u2067"
_JOINERS = "\u200c\u200d"
#: Scripts whose letters join, by their blocks.
_JOINING = (range(0x600, 0x1090), range(0x1780, 0x18B0), range(0xA840, 0xAC00))
#: Rows of one part of a group whose pairs are built in several tasks.
GROUP_ROWS = 1_000
_MEMO = 100_000


def _alphabet(letter: str) -> str:
    return u.name(letter, "").split(" ")[0]


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Letter of another alphabet -> the Latin letter that it looks like, by the confusables data of Unicode in ICU.

    Both have the same case; letters without case count if only one Latin letter is meant. Of letters of one alphabet that
    look like one Latin letter only one is taken: rather one whose other case looks like the other case of the Latin one,
    then the first in the order of Unicode. Letters written from right to left are left out.
    """
    apart = range(0x3400, 0xA000), range(0xAC00, 0xD7A4), range(0x17000, 0x19000), range(0x20000, 0x40000)  # ideographs, syllables
    codes = (c for c in range(0x80, sys.maxunicode + 1) if not any(c in r for r in apart))
    letters = [ch for ch in map(chr, codes) if u.category(ch) in ("Lu", "Ll", "Lo") and not u.decomposition(ch) and u.bidirectional(ch) == "L" and _alphabet(ch) != "LATIN"]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shapes = checker.getSkeleton("\n".join([*LATIN, *letters])).split("\n")
    latin: dict[str, list[str]] = {}
    for ch, shape in zip(LATIN, shapes, strict=False):
        latin.setdefault(shape, []).append(ch)
    meant: dict[str, str] = {}
    for ch, shape in zip(letters, shapes[len(LATIN) :], strict=True):
        case = u.category(ch)
        found = [x for x in latin.get(shape, []) if case == "Lo" or u.category(x) == case]
        if len(found) == 1:
            meant[ch] = found[0]
    chosen: dict[tuple[str, str, str], tuple[bool, str]] = {}
    for ch, x in meant.items():
        other = meant.get(ch.swapcase()) == x.swapcase()
        key = (_alphabet(ch), u.category(ch), x)
        chosen[key] = min(chosen.get(key, (not other, ch)), (not other, ch))
    return {ch: x for (_, _, x), (_, ch) in chosen.items()}


def _own_look(ch: str, letters: dict[str, str]) -> str:
    """What one character is made of and looks like, its accents apart."""
    code, kind, parts = ord(ch), u.category(ch), u.decomposition(ch)
    if code in _NOTHING or kind == "Cf" and code not in _DRAWN or kind == "Cc" and not ch.isspace():
        return ""
    if kind == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    if parts.startswith(("<wide>", "<narrow>")) or parts.startswith("<compat>") and "LIGATURE" in u.name(ch, ""):
        return "".join(_own_look(c, letters) for c in u.normalize("NFKC", ch))
    if parts and not parts.startswith("<"):
        return "".join(letters.get(c, c) for c in u.normalize("NFD", ch))
    return letters.get(ch, ch)


@dataclass
class Tables:
    """The tables of the transducer, see above."""

    letters: dict[str, str]
    parts: dict[str, str] = field(default_factory=dict)
    order: dict[str, int] = field(default_factory=dict)
    pairs: dict[tuple[str, str], str] = field(default_factory=dict)
    singles: dict[str, str] = field(default_factory=dict)
    clusters: dict[str, str] = field(default_factory=dict)
    #: Marks that are drawn on the character before them, and characters after which a joiner changes what is drawn.
    marks: str = ""
    joins: str = ""

    @cached_property
    def transducer(self) -> Transducer:
        """One for each Python process that has the tables."""
        return Transducer(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "transducer"}

    def composed(self, text: str) -> str:
        """Parts put together: accents in their order, then each composed with its letter where the two are one character."""
        out: list[str] = []
        marks, at = list(text), 0
        while at < len(marks):  # runs of accents are sorted by their class
            end = at
            while end < len(marks) and marks[end] in self.order:
                end += 1
            marks[at:end] = sorted(marks[at:end], key=self.order.__getitem__)
            at = end + 1
        start, last = None, -1
        for c in marks:
            rank = self.order.get(c, 0)
            both = self.pairs.get((out[start], c)) if start is not None else None
            free = last < rank if rank else last == -1  # nothing stands between that holds the accent off
            if both is not None and free:
                out[start] = both
                continue
            if rank == 0:
                start, last = len(out), -1
            else:
                last = rank
            out.append(c)
        return "".join(out)

    def look(self, text: str) -> str:
        """The look of a cluster or run by the tables of its parts."""
        return self.composed("".join(self.parts.get(c, c) for c in text))


def _spellings(ch: str, tables: Tables, alike: dict[str, list[str]]) -> set[str]:
    """Ways to write the letter with accents `ch`: whatever looks like its letter, and its accents in any order, some composed."""
    parts = u.normalize("NFD", ch)
    base, marks = parts[0], parts[1:]
    if len(marks) > 3 or not all(m in tables.order for m in marks):
        return set()
    first = tables.parts.get(base, base)
    if len(first) != 1:
        return set()
    out = set()
    for turn in set(permutations(marks)):
        if tables.composed(first + "".join(turn)) != tables.composed(first + marks):
            continue  # accents of one class keep their order
        for letter in {base, first, *alike.get(first, [])}:
            out.add(letter + "".join(turn))
            for k in range(1, len(turn)):
                begun = u.normalize("NFC", letter + "".join(turn[:k]))
                if len(begun) == 1:
                    out.add(begun + "".join(turn[k:]))
    return out


def build_tables(letters: dict[str, str]) -> Tables:
    """All tables for the look-alike `letters` (letter -> Latin letter), checked for conflicts."""
    own: dict[tuple[str, str, str], str] = {}
    for ch, x in letters.items():
        if own.setdefault((_alphabet(ch), u.category(ch), x), ch) != ch:
            raise ValueError(f"{ch!r} and another letter of its alphabet look like {x!r}")
    t = Tables(dict(letters))
    with_accents = []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if 0xAC00 <= code < 0xD7A4:
            parts = u.normalize("NFD", ch)
            t.pairs[(u.normalize("NFC", parts[:-1]), parts[-1])] = ch
            continue
        if u.combining(ch):
            t.order[ch] = u.combining(ch)
        look = _own_look(ch, letters)
        if look != ch:
            t.parts[ch] = look
        parts = u.decomposition(ch)
        if parts and not parts.startswith("<") and u.normalize("NFC", ch) == ch:
            two = [chr(int(p, 16)) for p in parts.split()]
            if len(two) == 2:
                t.pairs[(two[0], two[1])] = ch
                with_accents.append(ch)
    everything = [chr(c) for c in range(sys.maxunicode + 1)]
    joining = [chr(c) for r in _JOINING for c in r if u.category(chr(c)) in ("Lo", "Lm", "Mn", "Mc")]
    t.joins = "".join([*joining, "\ufe0f", *(ch for ch in everything[0x2190:] if u.category(ch) in ("So", "Sk"))])
    for ch in t.parts:
        look = t.look(ch)
        if look != ch:
            t.singles[ch] = look
    t.marks = "".join(ch for ch in everything if u.category(ch) in ("Mn", "Mc", "Me") and ch not in t.singles)
    alike: dict[str, list[str]] = {}
    for ch, look in t.singles.items():
        if len(look) == 1 and look not in t.order:
            alike.setdefault(look, []).append(ch)
    for ch in with_accents:
        look = t.look(ch)
        for raw in _spellings(ch, t, alike):
            if t.clusters.setdefault(raw, look) != look:
                raise ValueError(f"{raw!r} has two looks")
    for look in {*t.singles.values(), *t.clusters.values()}:
        if any(c in t.singles for c in look) or t.look(look) != look:
            raise ValueError(f"the look {look!r} has another look")
    return t


def _ranges(chars) -> str:
    codes, out = sorted(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a < b else f"\\U{a:08x}" for a, b in out)


class Transducer:
    """The compiled tables. `form(text)` rewrites a text in one pass.

    There are two compilations of the same rules: one for texts whose characters all have 16-bit codes, for which the
    engine tests a character set in constant time, and one for all others. Each is made twice, the second time with the
    direction marks kept.
    """

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self._translate = str.maketrans(tables.singles)
        self._nothing = str.maketrans(dict.fromkeys((c for c, look in tables.singles.items() if not look), ""))
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search
        self._plain = re.compile("[\t\n\r -~]*").fullmatch
        self._turned = re.compile(f"[{_TURNING}]").search
        self._memo: dict[str, str] = {}
        self._made: dict[tuple[bool, bool], tuple] = {}

    def _compiled(self, beyond: bool, turned: bool) -> tuple:
        if (beyond, turned) not in self._made:
            self._made[beyond, turned] = self._compile(beyond, turned)
        return self._made[beyond, turned]

    def _compile(self, beyond: bool, turned: bool) -> tuple:
        fits = lambda chars: [c for c in chars if beyond or c <= "\uffff"]
        left = set(_JOINERS) | (set(_DIRECTION) if turned else set())
        mapped = [c for c in fits(self.tables.singles) if c not in left]
        none = _ranges([c for c in mapped if not self.tables.singles[c]])
        mark, joins, runs, zw, jamo = _ranges(fits(self.tables.marks)), _ranges(fits(self.tables.joins)), _ranges(mapped), _JOINERS, "\u1100-\u11ff"
        joiner = f"[{zw}](?<![{joins}][{zw}])[{zw}]*"  # a joiner that joins nothing
        cluster = f"[^{joins}][{none}{zw}]*[{mark}][{mark}{none}{zw}]*|[{joins}][{none}]*[{mark}][{mark}{none}]*"
        with_marks = re.compile(f"(?s:{cluster})|[{jamo}]+|[{runs}]+(?![{none}]*[{mark}])|{joiner}")
        return re.compile(f"[{mark}{jamo}]").search, with_marks.sub, re.compile(f"[{runs}]+|{joiner}").sub, re.compile(f"[{runs}]+").sub

    def _look(self, match: re.Match) -> str:
        found = match.group()
        look = self._memo.get(found)
        if look is None:
            t = self.tables
            look = t.clusters.get(found)
            if look is None:
                held = found if found[0] in self._joined else found.translate(self._nothing)
                look = t.clusters.get(held)
            if look is None:
                look = t.look(held) if any(c in t.order or "\u1100" <= c <= "\u11ff" for c in held) else held.translate(self._translate)
            if len(self._memo) > _MEMO:
                self._memo.clear()
            self._memo[found] = look
        return look

    @cached_property
    def _joined(self) -> frozenset[str]:
        return frozenset(self.tables.joins)

    def form(self, text: str) -> str:
        if text.isascii() and self._plain(text):
            return text
        has_marks, clusters, runs, without_joiners = self._compiled(self._beyond(text) is not None, self._turned(text) is not None)
        if has_marks(text):
            return clusters(self._look, text)
        return (runs if any(c in text for c in _JOINERS) else without_joiners)(self._look, text)


@lru_cache(4)
def _built(letters: frozenset[tuple[str, str]]) -> Tables:
    return build_tables(dict(letters))


def tables_for(spark: SparkSession, letters: dict[str, str] | None = None) -> Tables:
    """The tables for these look-alike letters, by default the confusable ones."""
    return _built(frozenset((confusable_letters(spark) if letters is None else letters).items()))


def visible(form: str) -> bool:
    """True if a form has a character that is seen."""
    return bool(form) and not form.isspace()


def canonical_forms(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, form) for every row."""
    spark = documents.sparkSession
    tables = spark.sparkContext.broadcast(tables_for(spark, letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = tables.value.transducer.form
        for batch in batches:
            forms = [None if t.as_py() is None else form(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[doc_id, "form"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, form string")


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def look_digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: dict[str, str] | None = None) -> DataFrame:
    """(doc, look, raw): digests of the form and of the text itself, for texts with a visible character."""
    spark = documents.sparkSession
    tables = spark.sparkContext.broadcast(tables_for(spark, letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = tables.value.transducer.form
        for batch in batches:
            docs, looks, raws = [], [], []
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                raw = value.as_py()
                seen = None if raw is None else form(raw)
                if seen is not None and visible(seen):
                    docs.append(doc.as_py())
                    looks.append(_digest(seen))
                    raws.append(_digest(raw))
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.column(0).type), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=["doc", "look", "raw"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"doc {kind}, look binary, raw binary")


def lookalike_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS, letters: dict[str, str] | None = None) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts that look the same and are not the same characters.

    Texts of the same characters are one class. Only looks with more than one class reach the join; it pairs the classes of
    a look, and only then each pair of classes becomes the pairs of their documents, so equal copies never meet. A class of
    more than `group_rows` documents is split: its documents go to parts, those of the other class to every part.
    """
    digests = written(look_digests(documents, doc_id, text, letters).distinct(), "looks")
    mixed = digests.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look")
    rows = written(digests.join(mixed, "look"), "mixed")
    kinds = rows.groupBy("look", "raw").agg(F.count("*").alias("n"))
    one = lambda s: kinds.select("look", F.col("raw").alias(f"raw_{s}"), F.col("n").alias(f"n_{s}"))
    parts = lambda s: F.ceil(F.col(f"n_{s}") / group_rows).cast("int")
    # Both classes may be large: the pair is cut into parts of the one times parts of the other.
    pairs = one("a").join(one("b"), "look").where("raw_a < raw_b").select("look", "raw_a", "raw_b", parts("a").alias("parts_a"), parts("b").alias("parts_b"))
    cut = pairs.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
    placed = rows.join(kinds, ["look", "raw"]).withColumn("part", F.pmod(F.xxhash64("doc"), F.ceil(F.col("n") / group_rows)).cast("int"))
    own = lambda s: placed.select("look", F.col("raw").alias(f"raw_{s}"), F.col("part").alias(f"part_{s}"), F.col("doc").alias(f"doc_{s}"))
    met = cut.join(own("a"), ["look", "raw_a", "part_a"]).join(own("b"), ["look", "raw_b", "part_b"])
    return met.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).where("doc_a < doc_b").distinct()
