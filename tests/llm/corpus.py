"""Small corpora for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "r", "st", "")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def awkward(rng: random.Random) -> list[tuple]:
    """Nulls in every column, empty, wordless and very long texts, ties, repeated rows and repeated ids."""
    shared = prose(rng, 70)
    texts = [
        (1, prose(rng, 120)),
        (2, f"{prose(rng, 20)}\n{shared}\n\n{prose(rng, 20)}"),
        (3, f"{prose(rng, 5)}\t{shared}"),
        (4, shared),
        (5, ""),
        (6, None),
        (7, "!!! --- ###"),
        (8, "one two"),
        (9, "Ün ñandú  über alles " * 30),
        (10, prose(rng, 30_000)),
        (None, f"{shared} {prose(rng, 4)}"),
        (None, None),
        (11, "same " * 200),
        (12, "same " * 160),
        (13, f"{shared} <|endoftext|> 漢字かな交じり文 \x1c\x85 1²3 x_y 'll"),
    ]
    texts += [(1, texts[0][1]), (14, texts[0][1]), (4, prose(rng, 60))]  # a repeated row, a copy, an id with two texts
    langs = ["en", "de", None]
    return [(i, t, langs[n % 3], None if n % 4 == 0 else f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(texts)]
