"""A small table with the cases that every operator has to bear."""

import random
from functools import cache

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, kept string, n_bytes string"

rng = random.Random(5)
WORDS = ["the", "and", "of", "thion", "erst", "ñando", "éleve", "straße", "x", "12", "it's", "ΑΣ", "你好"]


def prose(n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("," if rng.random() < 0.1 else "") for _ in range(n))


LONG = prose(6000)
PASSAGE = "".join(rng.choice("abcdefghij klmnop") for _ in range(700))
BASE = prose(120)


@cache
def rows() -> list[tuple]:
    texts = [
        BASE,
        BASE,  # a copy
        BASE.replace(" ", "  ", 3),  # a copy but for blanks
        BASE + " more",  # a near copy
        None,
        "",
        "   \n\t ",
        "one two",
        LONG,
        PASSAGE + prose(40),
        prose(40) + PASSAGE,
        "a" * 1500,  # periodic
        "# $ % ###" * 30,
        "same line\nother " + prose(3) + "\nsame line\n\n  same line  ",
        "<|im_end|> <|endoftext|> <|startoftext|>  end \r\n tail ",
        "é" * 700 + "z",
        "é" * 700 + "y",
    ]
    out = [(i, t, "en", f"s{i % 4}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    out += [(3, BASE + " more", "en", "s1", 1, None, None, None), (3, "another text of one id " + prose(15), None, None, None, None, None, None), (None, BASE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    out += [(100 + i, "boiler plate line\n" + prose(12), "en", f"site{i}", 0, "", "", "") for i in range(12)]
    return out


def frame(spark, some=None):
    made = rows() if some is None else some
    return spark.createDataFrame(made, SCHEMA).repartition(3)
