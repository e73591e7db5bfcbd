"""Small document tables with the cases that every operator must bear."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def documents(spark, texts: dict[int, str | None], schema: str = SCHEMA, **extra):
    rows = [(k, t, "en", "s", len(t or ""), *extra.values()) for k, t in texts.items()]
    return spark.createDataFrame(rows, schema + "".join(f", {name} string" for name in extra))


#: Null, empty, blank, one word, fewer than five words, accents, and a long text.
ODD = {900: None, 901: "", 902: " \n\t ", 903: "word", 904: "just three words", 905: "ünïcode ñandú ça 日本語", 906: prose(4000, 99)}


def rows(df):
    return [tuple(r) for r in df.collect()]
