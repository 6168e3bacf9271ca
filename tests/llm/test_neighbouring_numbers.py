"""Numbers next to each other have candidates of their own."""

import pytest

from citeloom.llm import pii


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("see 7536784127813050 4845168114407329 here", [(2, "7536784127813050"), (2, "4845168114407329")]),
        ("2353820953013749 4550997810720808", [(2, "2353820953013749"), (2, "4550997810720808")]),
        ("+1 (826) 555-4081 190.137.223.204", [(3, "+1 (826) 555-4081")]),
        ("+1 (843) 555-7672 170.106.47.218", [(3, "+1 (843) 555-7672")]),
        ("12 555 0199 (826) 555-4081", [(3, "(826) 555-4081")]),
    ],
)
def test_neighbours_are_proposed(text, spans):
    found = pii.candidates(text)
    for kind, own in spans:
        at = text.index(own)
        assert (at, kind, at + len(own)) in found


def test_a_run_of_many_groups_stays_linear():
    text = "1 22 333 " * 5000
    assert len(pii.candidates(text)) < 20 * 15000


def test_only_a_failed_check_is_a_wrong_example():
    card = "7536784127813050"
    text = f"{card} 4845168114407329"
    assert pii.luhn(card) and pii.weak_label(text, (0, 2, 16), pii.base_spans(text)) == -1
    wrong = "7536784127813051"
    assert pii.weak_label(wrong, (0, 2, 16), pii.base_spans(wrong)) == 0
