"""Work in one text grows with its length, not with its square."""

import time

import numpy as np

from clickloom.llm import decontam, secret_scan


def seconds(work, *sizes):
    """The best of three runs each."""
    took = []
    for size in sizes:
        given = work(size)
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            given()
            runs.append(time.perf_counter() - start)
        took.append(min(runs))
    return took


def test_many_candidates_in_a_text():
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNPQRSTUVWXYZ0123456789"))

    def work(n):
        text = " ".join("".join(rng.choice(letters, 32)) for _ in range(n))
        return lambda: secret_scan.added_spans(text, secret_scan.base_spans(text))

    small, large = seconds(work, 4_000, 8_000)
    assert large < 2.5 * small + 0.05
    assert len(work(500)()) > 400


def test_spans_never_overlap_taken_ones():
    rng = np.random.default_rng(2)
    parts = ["secret=aB3" + "x" * 20, "0123456789abcdef0123", "https://me:Zq8sLk3jQw7d@host/", "AKIA" + "B" * 18, "eyJabcdefgh1.eyJabcdefgh2.abcdefgh3", "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7", "ghp_" + "a1B2" * 9]
    for _ in range(200):
        text = "".join(rng.choice(["", " ", "/", "="]) + rng.choice(parts) for _ in range(12))
        base = secret_scan.base_spans(text)
        taken = list(base)
        for start, kind, end, secret in secret_scan.added_spans(text, base):
            assert text[start:end] == secret and kind > 2
            assert all(end <= s or e <= start for s, _, e, _ in taken)
            taken.append((start, kind, end, secret))


def test_a_long_item_in_many_copies():
    def work(n):
        item = " ".join(f"w{i}" for i in range(n)).encode()
        found = decontam.Benchmark.build(["long"], [item])
        texts = [b"before " + item + b" after"] * 20
        return lambda: list(found.matches(texts))

    small, large = seconds(work, 2_000, 4_000)
    assert large < 2.6 * small + 0.05
    assert {(size, tuple(items), longest) for size, _, items, longest in work(300)()} == {(302, ("long",), 300)}
