"""Small tables with the awkward rows that every operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, score string, root long, shard int"


def documents(spark, seed=7, n=60):
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows, clashing extra columns."""
    r = random.Random(seed)
    vocab = {"en": "the of and to in is that for it with as was on are by this be from or an".split(), "de": "der die und ist von mit das nicht ein für über groß".split(), "fr": "le la les des et être que pour dans élève ça où".split()}
    rows = []
    for k in range(n):
        lang = r.choice(list(vocab))
        lines = [" ".join(r.choice(vocab[lang]) + r.choice(["", "a", "ion", "er"]) for _ in range(r.randint(3, 14))) for _ in range(r.randint(1, 9))]
        rows.append([k, "\n".join(lines), lang])
    rows += [[100 + k, rows[k][1], rows[k][2]] for k in range(8)]
    for k in range(10, 18):
        w = rows[k][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append([200 + k, " ".join(w), rows[k][2]])
    rows += [[300, None, "en"], [301, "", None], [302, "12 34 !!", "de"], [303, "word", "en"], [304, "Ünïcode 😀 straße", None], [305, " \n \n", "fr"], [306, (rows[3][1] + "\n") * 60, None], [None, "no id at all here", "en"], [None, None, None]]
    rows += [rows[5], rows[5]]
    return spark.createDataFrame([(i, t, g, "hot" if k % 3 else None, None if t is None else len(t), 1, "k", "s", 2, 3) for k, (i, t, g) in enumerate(rows)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
