"""Small builders for the training-data tests."""


def prose(rng, n, words=None):
    words = words or [f"w{i}" for i in range(5000)]
    return " ".join(rng.choice(words) for _ in range(n))
