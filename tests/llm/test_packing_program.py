"""The configuration program: its bound, its cover, and the rounding."""

import numpy as np
import pytest

from rowmill.llm.packing import Places, best_fit, plan, rounded, solve

CAPACITY = 2048


def document_like(times=1):
    """Many lengths with a few pieces each, and many full pieces."""
    g = np.random.default_rng(11)
    hist = np.bincount(np.clip(g.lognormal(5.6, 1.1, 9000).astype(int), 3, CAPACITY), minlength=CAPACITY + 1)
    return hist * times


def seven(seed):
    g = np.random.default_rng(seed)
    hist = np.zeros(CAPACITY + 1, np.int64)
    hist[g.choice(np.arange(200, 1500), 7, replace=False)] = g.integers(100, 900, 7)
    return hist


def covered(program, hist):
    got = np.bincount(program.piece, program.times[program.row], minlength=len(hist))
    volume = np.bincount(program.row, program.piece)
    return (got >= hist - 1e-6).all() and volume.max() <= CAPACITY and (program.times >= 0).all()


@pytest.mark.parametrize("hist,gap", [(document_like(), 0.002), (document_like(100), 0.002), (seven(5), 0.03), (seven(1), 0.03)])
def test_value_meets_bound(hist, gap):
    program = solve(hist, CAPACITY)
    assert covered(program, hist)
    volume = (hist * np.arange(len(hist))).sum() / CAPACITY
    assert volume <= program.bound * 1.001 and program.bound <= program.value + 1e-6
    assert program.value <= (1 + gap) * program.bound + 2


def test_program_places_nearly_all_pieces():
    hist = document_like(100)
    runs, left = rounded(solve(hist, CAPACITY), hist)
    whole = plan(hist, CAPACITY)
    total, mine = sum(t for _, t in whole), sum(t for _, t in runs)
    assert mine >= 0.9 * total and left.sum() < 0.1 * hist.sum()
    assert total <= 1.001 * -(-(hist * np.arange(len(hist))).sum() // CAPACITY)


def test_beats_best_fit_where_it_wastes():
    hist = np.zeros(CAPACITY + 1, np.int64)
    hist[[447, 504, 542, 566, 764, 1044, 1172]] = 400
    plain = sum(t for _, t in best_fit(hist, CAPACITY))
    assert sum(t for _, t in plan(hist, CAPACITY)) < 0.97 * plain


@pytest.mark.parametrize("hist", [seven(2), document_like(), np.eye(CAPACITY + 1, dtype=np.int64)[CAPACITY] * 5,
                                  np.eye(CAPACITY + 1, dtype=np.int64)[1] * 5000, np.zeros(CAPACITY + 1, np.int64)])
def test_plan_holds_each_piece_once(hist):
    configs = plan(hist, CAPACITY)
    held = np.zeros_like(hist)
    for conf, times in configs:
        assert times > 0 and sum(s * n for s, n in conf.items()) <= CAPACITY
        for s, n in conf.items():
            held[s] += n * times
    assert (held == hist).all()
    assert Places(configs).sequences == sum(t for _, t in configs)
