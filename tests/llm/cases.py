"""Small tables with the cases that operators must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "and", "river", "stone", "light", "cloud", "green", "walk", "under", "été", "straße", "niño", "42", "a"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "."]) for _ in range(n))


def documents(n=40, seed=3):
    """Prose with exact and near copies, shared lines, null, empty, blank and long texts, and repeated rows."""
    rng = random.Random(seed)
    shared = prose(rng, 40)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared)
        if i % 4 == 0:
            lines.append(f"Page {i} of {rng.randint(1, 900)} printed")
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr"]), "s", 0))
    for i in range(n, n + 12):
        words = rows[i % 5][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(n + 20, None, None, None, None), (n + 21, "", "en", "s", 0), (n + 22, "   \n\t ", "en", "s", 0), (n + 23, "a", "en", "s", 1), (n + 24, "123 456!", "en", "s", 8)]
    rows += [(n + 25, prose(rng, 4000), "fr", "s", 0), (n + 26, "Shti " * 300, "en", "s", 0), rows[1], rows[1]]
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)
