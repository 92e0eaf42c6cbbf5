"""Forms of texts, and pairs against all pairs."""

import random
import unicodedata
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reactionloom.llm import lookalike as L

SAME = [("Ａ１", "A1"), ("é", "é"), ("a​b­c﻿", "abc"), ("a b c　", "a b c "), ("ﬁﬂ", "fifl"), ("a‐b‑c", "a-b-c"), ("Сор", "Cop"), ("ΑΒο", "ABo"), ("ё", "ë"), ("ό", "ó"), ("e​́", "é"), ("가", "가"), ("\U0001f58b️", "\U0001f58b")]
DIFFERENT = [("a", "A"), ("e", "é"), ("1", "2"), ("a\nb", "a b"), ("a  b", "a b"), ("…", "..."), ("–", "-"), ("№", "No"), ("a\tb", "a b"), ("и", "u"), ("й", "и")]


#: Letters by which the tests run without a session.
LETTERS = {"С": "C", "о": "o", "р": "p", "Α": "A", "Β": "B", "ο": "o", "е": "e", "а": "a"}
FORM = L.build_tables(LETTERS).transducer.form


def test_same_and_different(spark):
    form = L.tables_for(spark).transducer.form
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in DIFFERENT:
        assert form(a) != form(b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from([*"aeo AE-́̈​ оСοéＡﬁ가\U0001f58b️й\n"]), max_size=12))
def test_form_is_stable(text):
    assert FORM(FORM(text)) == FORM(text)


def test_letters_of_all_alphabets(spark):
    letters = L.confusable_letters(spark)
    for ch, latin in zip("νιһԁԝօᎪꓮОІΙ", "vihdwoAAOII", strict=True):
        assert letters[ch] == latin, ch
    assert not {"σ", "и", "б", "З", "т", "Ь", "ı", "Ӏ"} & set(letters)


def test_conflicts_are_refused():
    for letters in ({"ο": "o", "σ": "o"}, {"а": "б", "б": "a"}):
        try:
            L.build_tables(letters)
        except ValueError:
            continue
        raise AssertionError(letters)


def test_against_normalisation():
    """With no look-alike letters, accents alone: the tables give what Unicode's normal form gives."""
    form = L.build_tables({}).transducer.form
    rng = random.Random(6)
    for _ in range(3_000):
        text = "".join(rng.choice("aeouyAιηω가ệǖŝ") + "".join(rng.choice("\u0301\u0302\u0308\u0323\u0331\u0345\u030c") for _ in range(rng.randrange(4))) for _ in range(2))
        for variant in (text, unicodedata.normalize("NFD", text), unicodedata.normalize("NFC", text)):
            assert form(variant) == unicodedata.normalize("NFC", text), ascii(variant)


def test_joiners_and_directions():
    assert FORM("a\u200db\u200c") == "ab"
    assert FORM("\U0001f468\u200d\U0001f469") != FORM("\U0001f468\U0001f469")
    assert FORM("\u0646\u200c\u0645") != FORM("\u0646\u0645")
    assert FORM("ab \u202ecd\u202c e") != FORM("ab cd e") and FORM("ab \u202acd\u202c e\u200e") == FORM("ab cd e")


def pairs(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, look string")
    return sorted(tuple(r) for r in L.lookalike_pairs(docs, **more).collect())


def test_pairs_against_brute_force_and_hot_group(spark):
    rng = random.Random(1)
    spell = {"a": ["a", "а", "ａ"], "o": ["o", "о", "ο"], " ": [" ", " "]}
    rows = [(i, "".join(rng.choice(spell.get(c, [c])) for c in rng.choice(["a o", "oo", "x"])), "k") for i in range(60)]
    rows += [(100, None, "k"), (101, "", "k"), (102, " ", "k"), (103, " ​", "k"), rows[0], (104, "z" * 50_000 + "о", "k"), (105, "z" * 50_000 + "o", "k")]
    form = L.tables_for(spark).transducer.form
    seen = {i: t for i, t, _ in rows if t and L.visible(form(t))}
    expected = sorted((min(i, j), max(i, j)) for i, j in combinations(seen, 2) if seen[i] != seen[j] and form(seen[i]) == form(seen[j]))
    assert pairs(spark, rows) == expected
    assert pairs(spark, rows, group_rows=4) == expected  # the groups are split over several tasks


def test_empty_table(spark):
    assert pairs(spark, []) == []


def test_many_equal_copies_and_one_variant(spark):
    """The work follows the pairs: copies do not meet one another."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 70_000, "cоpy").otherwise("copy").alias("text"))
    got = L.lookalike_pairs(docs)
    assert got.count() == 99_999 and got.where("doc_a = 70000 or doc_b = 70000").count() == 99_999
