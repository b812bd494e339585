"""Texts for tests."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
EDGE_TEXTS = [None, "", " \n\t", "a", "\n\n", "é" * 50, "x" * 5000, "one two three", "$$$ %%% 123", "<|endoftext|> plain", "  a  b  ", "A, b. C! d?"]


def prose(seed: int, n: int) -> str:
    """n words in sentences and lines, mostly its own."""
    rng = random.Random(seed)
    out, left = [], 0
    for i in range(n):
        if left == 0:
            left = rng.randint(4, 12)
        w = rng.choice(WORDS) + str(rng.randint(0, 99))
        left -= 1
        out.append(w + ("." if left == 0 else "") + ("\n" if left == 0 and rng.random() < 0.3 else " "))
    return "".join(out).strip()
