"""Words of a public vocabulary by rank, and what a letter costs after the two before it in these words."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from math import log2

# Shorter words of the vocabulary are mostly pieces and abbreviations.
LEAST_WORD = 4
# Added to every count, so that letters never seen together cost much, not endlessly much.
SMOOTHING = 0.02
END = 0  # start or end of a word; 1 to 26 are a to z


class Letters:
    """``rank`` of words, 1 first, and costs of unlisted ones by letters.

    The vocabulary is a file of the tokenizers library whose whole words carry an end mark; they stand by the order in which they
    were merged, the most usual first. ``first`` are words that come before all of these.
    """

    def __init__(self, path: str, first: tuple[str, ...] = ()):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        whole = re.compile(rf"([a-z]{{{LEAST_WORD},}}){re.escape(model['end_of_word_suffix'])}")
        places = sorted((place, m.group(1)) for token, place in model["vocab"].items() if (m := whole.fullmatch(token)))
        words = [word for _, word in places]
        self.rank = {word: k for k, word in enumerate(dict.fromkeys([*first, *words]), 1)}
        self.longest = max(map(len, self.rank))
        counts = [[SMOOTHING] * 27 for _ in range(27 * 27)]
        for word in words:
            a = b = END
            for c in [*(ord(char) - 96 for char in word), END]:
                counts[a * 27 + b][c] += 1
                a, b = b, c
        self.bits = [[log2(sum(row) / n) for n in row] for row in counts]

    def costs(self, run: str) -> list[float]:
        """Cost of each beginning of ``run`` (a to z) as a whole word, from that of one letter on."""
        out, bits, a, b = [], 0.0, END, END
        for char in run:
            c = ord(char) - 96
            bits += self.bits[a * 27 + b][c]
            a, b = b, c
            out.append(bits + self.bits[a * 27 + b][END])
        return out


@lru_cache(maxsize=2)
def letters_of(path: str, first: tuple[str, ...] = ()) -> Letters:
    """Read once in each process."""
    return Letters(path, first)
