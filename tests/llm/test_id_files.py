"""Boundaries read by select from packed bits."""

import random

import numpy as np
import pytest

from tallyline.llm import id_files


@pytest.mark.parametrize("seed", range(40))
def test_select_on_random_images(seed):
    draw = random.Random(seed)
    counts = [draw.choice([0, 0, 1, 2, draw.randrange(40), draw.randrange(5000) if seed % 5 == 0 else 3]) for _ in range(draw.choice([1, 2, 63, 700, 3000]))]
    ids = np.arange(sum(counts), dtype="<u4") % 50_000
    for width in (2, 4):
        file = id_files.IdFile(id_files.image_of(ids.tobytes(), counts, width))
        ends = np.cumsum(counts)
        assert file.n == len(counts) and file.total == len(ids)
        for i in [0, len(counts) - 1, *(draw.randrange(len(counts)) for _ in range(30))]:
            assert file.select(i) == ends[i] and file.select(i - 1) == (ends[i - 1] if i else 0)
            assert (file.ids(i) == ids[ends[i] - counts[i]: ends[i]]).all()
            j = draw.randrange(i, len(counts) + 1)
            assert (file.ends(i, j) == ends[i:j]).all()
        assert (file.ends(0, len(counts)) == ends).all()


def test_space():
    """The select table adds a small part of what 64-bit boundaries would take."""
    counts = [300] * 50_000
    file = id_files.IdFile(id_files.image_of(np.zeros(sum(counts), "<u4").tobytes(), counts, 2))
    assert file.high.nbytes + file.low_part.nbytes + file.before.nbytes < 0.2 * 8 * len(counts)


def test_no_documents():
    file = id_files.IdFile(id_files.image_of(b"", [], 2))
    assert (file.n, file.total, file.select(-1), len(file.ends(0, 0))) == (0, 0, 0, 0)
