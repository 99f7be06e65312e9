import random
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def awkward():
    """Rows with nulls in every column, empty and long texts, ties, repeated rows and odd characters."""
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(120))
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, base.upper(), "de", None, None), (4, base + " tail", None, "a", 1), (5, "", "en", "a", 0), (6, None, None, None, None),
        (None, base, "en", "a", 1), (None, None, None, None, None), (7, "one", "en", "c", 3), (8, "ONE", "en", "c", 3), (9, "one two", "en", "c", 3), (10, "\t\n ", "en", "c", 3),
        (11, "x<|endoftext|>y <|endoftext|>", "en", "c", 3), (12, "日本語 текст 🎉 é́ x", "en", "é", 3), (13, "w" * 50_000, "en", "a", 3), (14, " ".join(f"t{i}" for i in range(30_000)), "en", "a", 3),
        (1, base, "en", "a", 1), (15, "a\x00b \x1c \x85 c", "en", "a", 3),
    ]
    for i in range(60):
        rows.append((100 + i, " ".join(rng.choice(("loser", "tree", "house", "river", "idiot", "cloud")) + rng.choice("xyz") * rng.randint(0, 2) for _ in range(rng.randint(1, 60))), "en", rng.choice("abc"), 1))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA).selectExpr("*", "'own' as size", "1 as _key", "2 as component_id", "'other' as TEXT", "9 as Doc_Id")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
