"""Made-up text for the tests."""

import random

WORDS = [a + b for a in "ka lo mi nu re sta vo zi pel dra".split() for b in "ne to ri sa lum gor ".split(" ")]


def prose(seed, n):
    """Made-up text of ``n`` words with a line break now and then."""
    pick = random.Random(seed)
    return "".join(pick.choice(WORDS) + ("\n" if pick.random() < 0.1 else " ") for _ in range(n)).strip()
