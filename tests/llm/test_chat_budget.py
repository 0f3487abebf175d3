"""Chat windows keep their budget."""

import random

from foliospark.llm import chat


def test_no_window_is_over_the_budget_unless_it_holds_a_single_turn(spark):
    rng = random.Random(4)
    said = lambda n: "w " * max(n - 4, 0)  # noqa: E731  n tokens
    talks = {0: [("system", 300)] + [("user", n) for n in (300, 211, 500, 12, 255, 256, 500, 12)], 1: [("system", 900), ("user", 500), ("assistant", 30)], 2: [("system", 2000), ("user", 5), ("assistant", 6)], 3: [("user", 3000), ("assistant", 4)], 4: [("system", 9)]}
    for c in range(5, 80):
        talks[c] = [(rng.choice(["system", "user"]) if i == 0 else rng.choice(["user", "assistant"]), rng.choice([4, 9, 40, 128, 255, 256, 257, 511, 512, 513, 600, 1100])) for i in range(rng.randrange(1, 25))]
    rows = [(c, i, role, said(n)) for c, turns in talks.items() for i, (role, n) in enumerate(turns)]
    found = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    seen: dict = {}
    for w in found:
        turns = talks[w.conv_id]
        system = turns[0][0] == "system"
        held = [t.n for t in w.turns]
        assert w.tokens == sum(turns[n - 1][1] for n in held)
        assert held == sorted(set(held)) and (not system or held[0] == 1)
        others = held[1:] if system else held
        assert w.tokens <= chat.BUDGET or len(others) == 1, (w.conv_id, w.window, w.tokens)
        assert others or len(turns) == 1
        assert others == [] or others == list(range(others[0], others[-1] + 1))
        first = [t.n for t in w.turns if t.first]
        assert not seen.get(w.conv_id, set()) & set(first)
        seen.setdefault(w.conv_id, set()).update(first)
        assert all(not t.loss for t in w.turns if not t.first)
    assert all(seen[c] == set(range(1, len(t) + 1)) for c, t in talks.items())
    assert sum(len(w.turns) - sum(t.first for t in w.turns) for w in found) > 50  # history is repeated
