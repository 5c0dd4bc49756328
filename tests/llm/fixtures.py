"""Small tables with every odd case, and plain-Python versions of what operators do."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int, cuts string, __row string, overlaps string, n_words string, root string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(rng, n, per_line=12, vocabulary=400):
    words = [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n)]
    return "\n".join(" ".join(words[k : k + per_line]) for k in range(0, n, per_line))


def texts():
    """Texts by id; some ids and texts are null."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    base = prose(rng, 200, 40)
    rows = [(k, prose(rng, rng.randrange(60, 200), 40)) for k in range(24)]
    rows += [(100, base), (101, base), (102, base.replace("w1 ", "zz ", 1)), (103, base + " tail"), (104, base.upper())]
    rows += [(200 + k, f"{prose(rng, 70, 35)}\n{passage}\n{prose(rng, 70, 35)}") for k in range(3)]
    rows += [(203, f"{prose(rng, 80, 40)}\n{passage.replace('p30 ', 'changed ')}")]
    rows += [(300, ""), (301, None), (302, "   \n\t\n"), (303, "one"), (304, "one two three"), (305, "x" * 3000), (306, "the the the the " * 100), (307, "\n".join(["same line of words"] * 40))]
    rows += [(400, "Große Übung, ÉTÉ à l'île 12 345 日本語 don't <|endoftext|> ½ é " * 9), (401, prose(rng, 9000, 30)), (402, "a\x0bb\x0cc\rd\x1ce\x85f\xa0g " * 20)]
    rows += [(None, base), (None, None), (500, passage), (500, passage), (501, "bench mark item number one has exactly these words in this order for all to see " * 2)]
    return rows


def documents(spark):
    rows = [(i, t, ["en", "de", None][k % 3], f"src{k % 2}" if k % 5 else None, None if t is None else len(t), "x", 1, None, "r", "o", "n", "root") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
