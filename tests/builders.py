"""Tiny judgement tables."""

from __future__ import annotations

OBS = (
    "model string, evaluation_regime string, contrast_id string, category string, story_1_id string, story_2_id string, "
    "story_a_id string, story_b_id string, assignment string, position string, replicate_id int, choice string, choice_mode string"
)


def block(wins, n=10, pair=("s1", "s2"), regime="naturalistic", contrast="k", mode="forced", model="m"):
    """Rows of one block: ``wins[(assignment, position)]`` of ``n`` replicates go to item 1."""
    rows = []
    for (assignment, position), w in wins.items():
        a, b = pair if position == "story1_as_a" else pair[::-1]
        for r in range(1, n + 1):
            winner = pair[0] if r <= w else pair[1]
            choice = "A" if winner == a else "B"
            rows.append((model, regime, contrast, "overall_quality", *pair, a, b, assignment, position, r, choice, mode))
    return rows


def four(fa, fb, la, lb):
    return {
        ("forward", "story1_as_a"): fa, ("forward", "story2_as_a"): fb,
        ("flipped", "story1_as_a"): la, ("flipped", "story2_as_a"): lb,
    }
