"""The search for fewest sequences doesn't depend on the number of pieces."""

import random

import pytest

from lexweave.llm import packing


def bins(counts, capacity):
    fillings, used = packing.pack_counts(counts, capacity), {}
    for fill, many in fillings:
        assert sum(x * n for x, n in fill) <= capacity
        for x, n in fill:
            used[x] = used.get(x, 0) + n * many
    assert used == counts
    return sum(m for _, m in fillings)


def test_full_bins_of_many_pieces():
    assert bins(dict.fromkeys((547, 485, 424, 422, 394, 359, 305, 297, 244, 233, 206, 180), 20), 1024) == 80


@pytest.mark.parametrize("seed", range(40))
def test_full_bins_of_random_pieces(seed):
    rng = random.Random(seed)
    counts: dict[int, int] = {}
    for _ in range(4):
        cuts = sorted(rng.sample(range(150, 875), 2))
        for x in (cuts[0], cuts[1] - cuts[0], 1024 - cuts[1]):
            counts[x] = counts.get(x, 0) + 20
    assert packing.lower_bound(counts, 1024) == 80
    assert bins(counts, 1024) == 80
