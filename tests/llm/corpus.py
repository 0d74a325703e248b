"""A small corpus with the awkward cases: nulls, empty and long texts, copies, near copies, repeated rows, clashing columns."""

import random

from pyspark.sql import Row

LETTERS = {"en": "the and of ing tion er".split(), "de": "sch ein ung keit der ich".split(), "fr": "eau que les ment oi aux".split()}


def prose(rng, n, lang="en"):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=1):
    rng = random.Random(seed)
    rows = []
    base = [prose(rng, 150) for _ in range(6)]
    passage = prose(rng, 60, "fr")
    for i in range(60):
        lang = rng.choice(list(LETTERS))
        rows.append((i, prose(rng, rng.randint(3, 200), lang), lang))
    for k, text in enumerate(base):
        for i in range(12):
            words = text.split(" ")
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = prose(rng, 1) + "x"
            rows.append((100 + 20 * k + i, " ".join(words), "en"))
    for i in range(5):
        rows.append((300 + i, prose(rng, 40) + "\n" + passage + "  " + prose(rng, 30), "en"))
    rows += [(400, None, "en"), (401, "", None), (402, "", "de"), (403, " \t\n", "fr"), (404, "one", "en"), (405, "one two  three four five", "en"), (405, "other text of one id", "en")]
    rows += [(406, "exact copy of a text " * 12, "en"), (407, "exact copy of a text " * 12, "en"), (407, "exact copy of a text " * 12, "en"), (None, "no id at all here", "en")]
    rows += [(408, prose(rng, 6000), "en"), (409, "日本語 の 文 é\u3000x \xa0 y <|endoftext|> z", "de"), (410, "1234 !!! 5678", "en")]
    return [Row(doc_id=a, text=b, lang=c, source="src0", n_chars=len(b or ""), rest="clash", block=7, node=3, score=0.1) for a, b, c in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest string, block int, node int, score double"
