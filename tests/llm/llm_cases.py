"""Small documents with everything that may go wrong, and brute-force helpers."""

import random

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho".split()
COLUMNS = (
    "doc_id long, text string, id long, row string, first boolean, b int, key string, "
    "`odd name` string, tails string"
)


def sentence(seed: int, length: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(30)) for _ in range(length))


def texts() -> list[str | None]:
    shared = sentence(99, 30)
    base = sentence(1, 60)
    return [
        base,
        base,
        base.replace(" ", "\n\t ", 5),
        sentence(2, 60) + " " + shared,
        sentence(3, 50) + " " + shared + " " + sentence(4, 20),
        shared,
        None,
        "",
        "  \n ",
        None,
        "one",
        "One two",
        sentence(5, 4000),
        "Ünïcode wörds ÄÖ 中文 text, with  punctuation! and <|endoftext|> marks",
        "same same same same same same same same same same same same same same same same same",
        "x\x00y \x1c z　w\xa0v",
    ]


def rows() -> list[tuple]:
    found = [
        (None if i == 15 else 100 - i, t, 7, "r", True, 1, "k", "o", "t")
        for i, t in enumerate(texts())
    ]
    found.append(found[0])  # a repeated row
    found.append((5, texts()[3], *found[0][2:]))
    return found


def documents(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
