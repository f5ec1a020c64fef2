"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = ("doc_id bigint, text string, source string, lang string, n_chars bigint, "
          "size bigint, shard int, class int, key bigint, start int, batch int, toxic int")


def texts(seed=7):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Zoë", "don't", "a.b", "é"]

    def prose(n):
        return " ".join(rng.choice(vocab) + rng.choice(("", "", "", ".", ",")) for _ in range(n))

    passage = prose(70)
    base = prose(120)
    out = [None, "", "   \t\n", "one", "two words", "One  TWO\tthree four", prose(49), prose(50), prose(51), prose(3000)]
    out += [base, base, base.upper(), base + " tail"]
    words = base.split()
    for i in (5, 40, 80, 110):
        out.append(" ".join(words[:i] + ["changed"] + words[i + 1:]))
    out += [prose(30) + " " + passage + " " + prose(20), passage, prose(200) + "\n" + passage]
    out += [prose(rng.randrange(5, 150)) for _ in range(30)]
    out += ["x" * 5000, "ab " * 400, "same line\n" * 90, "日本語 のテキスト", "\u00a0non-breaking\u2003space"]
    return out


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    table = [(i, t, (None, "b", "a", "c")[(i or 0) % 4], "en", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in rows]
    return spark.createDataFrame(table, SCHEMA)


def odd_rows():
    """Rows with repeats, a null id and ids out of order."""
    rows = list(enumerate(texts()))
    return [*reversed(rows), rows[10], rows[10], (None, rows[12][1]), (None, None), (3, "another text of id three")]


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()
