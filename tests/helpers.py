"""Small builders for tests."""

import hashlib
import random


def h(x):
    """Digest of a text."""
    return hashlib.sha256(str(x).encode()).hexdigest()


def spelled(text, k):
    """A hash in one of several spellings."""
    return [text, text.upper(), f" {text}\n", f"{text[:2]}/{text[2:]}", text][k % 5]


def rng(seed):
    return random.Random(seed)
