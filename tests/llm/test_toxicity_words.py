"""Insults that are rare beside others, or many, are scored as such."""

import random

import numpy as np

from tallyline.llm import toxicity

LETTERS = "bcdfghjklmnpqrstvwz"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return sorted({"".join(r.choice(LETTERS) + r.choice("aeiou") for _ in range(r.choice((3, 4)))) for _ in range(n)})


def scores(model, texts):
    return model.score(toxicity.Margins(model).best_two(texts))


def corpus(counts: dict[str, int], clean: int):
    r, plain = random.Random(1), words(900, 2)
    plain = [w for w in plain if w not in counts]
    text = lambda *more: " ".join([*(r.choice(plain) for _ in range(12)), *more])
    toxic = [text(u) for u, k in counts.items() for _ in range(k)]
    return toxic + [text() for _ in range(clean)], [1] * len(toxic) + [0] * clean, text


def test_rare_insult():
    common, rare = words(10, 3), "xyqhuxyo"
    texts, labels, text = corpus({**{u: 40 for u in common}, rare: 12}, 412)
    model = toxicity.fit(texts, labels)
    assert (scores(model, [text(rare) for _ in range(20)]) >= 0.5).all()
    assert (scores(model, [text(u) for u in common]) >= 0.5).all()
    assert np.mean(scores(model, [text() for _ in range(100)]) >= 0.5) <= 0.05


def test_more_insults_than_landmarks_before():
    insults = words(50, 4)
    texts, labels, text = corpus({u: 40 for u in insults}, 2000)
    found = toxicity.typical_units([set(t.split()) for t, label in zip(texts, labels) if label], toxicity.Counter(w for t in texts[-2000:] for w in set(t.split())), 2000)
    assert set(found) == set(insults)
    model = toxicity.fit(texts[::2], labels[::2])
    assert model.screen.passed(insults).all()
    assert np.mean(scores(model, [text(u) for u in insults]) >= 0.5) >= 0.95


def test_copies_are_one_witness():
    r = random.Random(5)
    one = {f"w{r.random()}" for _ in range(200)}
    copies = [(one - set(r.sample(sorted(one), 10))) | {f"x{i}"} for i in range(6)]
    assert toxicity.distinct([*copies, {"a", "b"}, {"a", "c", "d"}, set(), set()], [1, 1, 1, 1, 1, 0, 1, 1, 1, 1]) == [0, 5, 6, 7, 8, 9]


def test_inserted_and_dropped_letters():
    """Insults the model has only seen plain, with a letter put in, two letters, a letter missing, and separators; clean texts stay clean."""
    insults = words(12, 6)
    texts, labels, text = corpus({u: 40 for u in insults}, 900)
    model = toxicity.fit(texts, labels)
    r = random.Random(8)
    letter = lambda: r.choice(LETTERS + "aeiou")
    edits = {"plain": lambda u: u, "one": lambda u: u[:3] + letter() + u[3:], "two": lambda u: u[:3] + letter() + letter() + u[3:], "dropped": lambda u: u[:2] + u[3:], "separated": "-".join}
    found = {name: np.mean(scores(model, [text(edit(r.choice(insults)), edit(r.choice(insults))) for _ in range(60)]) >= 0.5) for name, edit in edits.items()}
    assert found["plain"] >= 0.98 and found["separated"] >= 0.98 and found["one"] >= 0.8 and found["dropped"] >= 0.6 and found["two"] >= 0.5, found
    assert np.mean(scores(model, [text() for _ in range(300)]) >= 0.5) <= 0.02
