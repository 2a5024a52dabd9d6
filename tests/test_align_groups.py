"""Pages are aligned many at a time, as each would be alone."""

import random

import numpy as np
import pytest

from tessera.operators import align


@pytest.mark.parametrize("pairs, moves", [(1 << 18, 1 << 26), (60, 1 << 26), (1 << 18, 500), (1, 1)])
def test_groups_as_alone(monkeypatch, pairs, moves):
    r = random.Random(4)
    words = [None, "", "a", "aab", "bb--", "ab", "ba", "c", "ccccccc", "cccccccc", "São", "sao"]
    side = lambda: [r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 14]))]
    pages = [(side(), side()) for _ in range(60)]
    alone = [[x.tolist() for x in align.alignment(*p)] for p in pages]
    monkeypatch.setattr(align, "PAIRS", pairs)
    monkeypatch.setattr(align, "MOVES", moves)
    groups = list(align.groups(*(np.array([len(p[k]) for p in pages]) for k in (0, 1))))
    assert sorted(k for g in groups for k in g) == list(range(60)) and (pairs > 100 and moves > 1000) == (len(groups) == 1)
    for g in groups:
        assert [[x.tolist() for x in way] for way in align.alignments([pages[k] for k in g])] == [alone[k] for k in g]


def test_words_apart_need_no_edits(monkeypatch):
    """Pairs with more letters apart than may be wrong aren't compared letter by letter."""
    compared, edits = [], align.edit_distances
    monkeypatch.setattr(align, "edit_distances", lambda a, b, i, j: (compared.append(len(i)), edits(a, b, i, j))[1])
    assert align.pair_scores(["abcde", "aabbb"], ["vwxyz", "abxyz", "abbbb"]).tolist() == [[-3, -3, -3], [-3, -3, 7]]
    assert sum(compared) == 2  # the last pair, as written and as it sounds


@pytest.mark.parametrize("steps", [1 << 16, 10])
def test_udtf_of_parts(spark, monkeypatch, steps):
    """The table function takes many pages of a part, some at a time."""
    monkeypatch.setattr(align, "STEPS", steps)
    one = align.AlignWords()
    rows = [{"page_id": f"p{k}", "side": side, "idx": 5 * i, "word": w} for k in range(9) for side, text in (("heard", "o gato vio lua"), ("ref", "o gato viu a lua")) for i, w in enumerate(text.split()[: 1 + k])]
    got = [x for row in rows for x in one.eval(row) or ()] + list(one.terminate())
    want = []
    for k in range(9):
        way = align.align_words("o gato viu a lua".split()[: 1 + k], "o gato vio lua".split()[: 1 + k])
        want += [(f"p{k}", n, None if i is None else 5 * i, None if j is None else 5 * j, op) for n, (i, j, op) in enumerate(way)]
    assert sorted(got, key=str) == sorted(want, key=str)
