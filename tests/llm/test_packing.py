"""Bin completion: bounds and packings against exhaustive search, and what it saves against best fit."""

import random
from collections import Counter

import pytest

from pingmill.llm import packing


def fewest(lengths: list[int], capacity: int) -> int:
    best = len(lengths)

    def place(rest: list[int], bins: list[int]) -> None:
        nonlocal best
        if not rest:
            best = min(best, len(bins))
            return
        for room in {b for b in bins if b + rest[0] <= capacity}:
            at = bins.index(room)
            place(rest[1:], [*bins[:at], room + rest[0], *bins[at + 1 :]])
        if len(bins) + 1 < best:
            place(rest[1:], [*bins, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("low_share", [0.02, 0.2, 0.3])
def test_packings_are_optimal_and_bounds_hold_in_small_cases(low_share):
    draws = random.Random(11)
    for _ in range(40):
        capacity = draws.choice([20, 30, 50, 97])
        lengths = [draws.randint(max(1, int(low_share * capacity)), capacity * 6 // 10) for _ in range(draws.randint(1, 9))]
        counts = dict(Counter(lengths))
        plan, least = packing.complete_bins(counts, capacity), fewest(lengths, capacity)
        assert packing._pieces_of(plan) == counts
        assert all(sum(x * n for x, n in items) <= capacity for _, items in plan)
        assert packing.lower_bound(counts, capacity) <= least == sum(times for times, _ in plan)


def test_fillings_are_all_undominated_ones_the_fullest_first():
    counts, room = {7: 2, 5: 1, 4: 3, 2: 1}, 13
    found = list(packing._fillings(counts, room, room, [10**6]))
    assert [left for left, _ in found] == sorted(left for left, _ in found)

    def subsets(lengths):
        if not lengths:
            yield {}
            return
        for rest in subsets(lengths[1:]):
            for n in range(counts[lengths[0]] + 1):
                yield {lengths[0]: n, **rest} if n else rest

    def undominated(used):
        left = room - sum(x * n for x, n in used.items())
        spare = [x for x in counts if counts[x] > used.get(x, 0)]
        return left >= 0 and not any(x <= left or any(y < x <= y + left for y in used) for x in spare)

    assert {frozenset(dict(items).items()) for _, items in found} == {frozenset(u.items()) for u in subsets(list(counts)) if undominated(u)}


def test_completion_needs_fewer_bins_than_best_fit():
    draws = random.Random(1)
    counts = dict(Counter(draws.randint(300, 700) for _ in range(600)))
    plan, again = packing.complete_bins(counts, rounds=300), packing.complete_bins(counts, rounds=300)
    assert plan == again and packing._pieces_of(plan) == counts
    assert sum(t for t, _ in plan) < sum(t for t, _ in packing.best_fit(counts, packing.CAPACITY))
    many = {x: 1_000 * n for x, n in counts.items()}
    assert packing._pieces_of(packing.complete_bins(many, work=10_000, rounds=50)) == many
