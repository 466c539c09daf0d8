"""Small documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, th string, m long, size string, shard string, slot string, row string, kept string"


def odd_documents(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(400)]

    def prose(k):
        return " ".join(r.choice(vocabulary) for _ in range(k)) + "."

    passage, line = prose(60), prose(12)
    rows = []
    for i in range(n):
        parts = [prose(r.randint(1, 120)) for _ in range(r.randint(1, 3))]
        if i % 4 == 0:
            parts.insert(r.randint(0, len(parts)), passage)
        if i % 3 == 0:
            parts += [line] * r.randint(1, 4)
        rows.append((i * 3, "\n".join(parts)))
    for i in range(0, n, 6):
        words = rows[i][1].split(" ")
        for _ in range(max(1, len(words) // 60)):
            words[r.randrange(len(words))] = "xx"
        rows.append((1000 + i, " ".join(words)))
        rows.append((2000 + i, rows[i][1].upper() if i % 12 else rows[i][1]))
    rows += [(5000, None), (5001, ""), (5002, " \t\n\x0b\x0c\r"), (5003, "one"), (5004, "one two three"), (5005, "one two three"), (5006, "a" * 3000), (5007, "ab" * 700 + "\n" + "ab" * 150)]
    rows += [(5008, prose(6000)), (5009, "   café \U0001f600 \x1c\x85 ok ok"), (5010, (line + "\n") * 30), (5010, (line + "\n") * 30), (5010, "the same id, another text"), (None, "no id at all here"), (None, None)]
    rows += [(5011, "|  # # $$ %% && << >> ** word " * 8), (5012, "x"), (5013, "word " * 100)]
    langs, sources = ["en", "fr", None, "de"], ["b", "a", None, "é", "z", ""]
    return [(d, t, langs[k % 4], sources[k % 6], None if k % 5 else k, "did", "th", k, "s", "sh", "sl", "row", None) for k, (d, t) in enumerate(rows)]


def frame(spark, rows=None, seed=0):
    return spark.createDataFrame(odd_documents(seed) if rows is None else rows, SCHEMA).repartition(3)
