"""Filters undone over pictures with flat areas, where most columns are as the one before them."""

import numpy as np
import pytest

from maskwright.sources import pictures as module
from maskwright.sources.pictures import decode, decode_all, encode, filtered, unfiltered

from .test_pictures import _plainly


def _screen(n, seed):
    pixels = np.full((-(-n // 8) * 20, 640, 3), 250, np.uint8)
    for k in range(n):
        x, y, level = k % 8 * 80, k // 8 * 20, 60 + (seed + k) * 37 % 180
        pixels[y : y + 14, x : x + 76] = level, level // 2, 255 - level
    return pixels


@pytest.mark.parametrize("kinds", [(0,), (1, 2), (3, 4, 1), (4, 0, 2), (4,), (3,), (2, 4, 3, 3, 1, 0)])
def test_screens_read_together(kinds):
    screens = [_screen(n, n) for n in (86, 1, 8, 299, 40)]
    for level in (1, 6):
        got = list(decode_all([encode(p, kinds, level) for p in screens]))
        assert all((a == b).all() and a.shape == b.shape for a, b in zip(got, screens, strict=True))


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_any_flat_bytes_by_definition(step):
    dice = np.random.default_rng(step)
    for _ in range(12):
        raw = np.repeat(dice.integers(0, 3, (11, 6, step), np.uint8) * dice.integers(0, 2, (11, 6, 1), np.uint8) * 90, dice.integers(1, 9, 6), axis=1).reshape(11, -1)
        kinds = dice.integers(0, 5, 11)
        assert unfiltered(raw, kinds, step).tolist() == _plainly(raw.tolist(), kinds.tolist(), step)
        again = np.frombuffer(filtered(unfiltered(raw, kinds, step), kinds, step), np.uint8).reshape(11, -1)
        assert (again[:, 1:] == raw).all() and (again[:, 0] == kinds).all()


def test_flat_columns_are_not_computed_each(monkeypatch):
    """Of 640 columns few are taken one by one."""
    steps, where = [], np.where
    monkeypatch.setattr(module.np, "where", lambda *a: steps.append(1) or where(*a))
    data = encode(_screen(86, 3), (3, 4, 1))
    steps.clear()
    assert (decode(data) == _screen(86, 3)).all()
    assert len(steps) < 400
